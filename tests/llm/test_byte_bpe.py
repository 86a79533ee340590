import hashlib

import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


TEXTS = [None, "", " ", "plain words here", "\n\n a\t\tb   c", "Größe señor 東京 🎉🎉 <|endoftext|>", "a" * 5000, "x1y22z333 don't WE'LL", "\u0000\u0001 �", "word " * 30000, "plain words here"]


def test_matches_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, __both string")
    for out in (byte_bpe.round_trip(df, PATH, PATTERN), byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH)):
        rows = {r.doc_id: r for r in byte_bpe.with_digests(out).collect()}
        for i, t in enumerate(TEXTS):
            ids = library.encode_ordinary(t or "")
            assert rows[i].ids == ids
            assert rows[i].n_tokens == len(ids)
            assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            assert rows[i]["__both"] == "x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.with_digests(byte_bpe.round_trip(df, PATH, PATTERN)).collect() == []


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids_sha256 for r in queries.op1_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, library.encode_ordinary(r.text or ""))).encode()).hexdigest()
