"""Training against a plain loop, saved tokenizers, special tokens."""

import random
import re
from collections import Counter

import pytest

from corpusloom.functions import bpe


def plain_train(counts, merges):
    """All pairs of all words counted anew for each merge, but words without the merged pair left as they are."""
    words = [(list(w.encode()), n) for w, n in counts.items()]
    stats, where, out = Counter(), {}, []
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:]):
            stats[p] += n
            where.setdefault(p, set()).add(i)
    while len(out) < merges and any(stats.values()):
        best = max(stats, key=lambda p: (stats[p], p))
        new = 256 + len(out)
        out.append(best)
        for i in where.pop(best):
            w, n = words[i]
            for p in zip(w, w[1:]):
                stats[p] -= n
            coded, j = [], 0
            while j < len(w):
                hit = tuple(w[j : j + 2]) == best
                coded.append(new if hit else w[j])
                j += 1 + hit
            words[i] = coded, n
            for p in zip(coded, coded[1:]):
                stats[p] += n
                where.setdefault(p, set()).add(i)
        stats.pop(best)
    return out


def plain_encode(text, merges):
    ranks = {p: 256 + i for i, p in enumerate(merges)}
    out = []
    for piece in re.findall(bpe.PATTERN, text):
        ids = list(piece.encode())
        while len(ids) > 1:
            pair = min(zip(ids, ids[1:]), key=lambda p: ranks.get(p, 1 << 60))
            if pair not in ranks:
                break
            coded, j = [], 0
            while j < len(ids):
                hit = tuple(ids[j : j + 2]) == pair
                coded.append(ranks[pair] if hit else ids[j])
                j += 1 + hit
            ids = coded
        out += ids
    return out


def counts_of(spark, path):
    counts = bpe.word_counts(spark.read.parquet(path).select("text"))
    return counts, {r.piece: r.n for r in counts.collect()}


def test_a_thousand_merges_equal_a_plain_loop(spark, monkeypatch):
    counts, plain = counts_of(spark, "/root/testdata/sf0.01/documents.parquet")
    jobs, original = [], bpe._changed
    monkeypatch.setattr(bpe, "_changed", lambda done, tried: jobs.append(len(tried)) or original(done, tried))
    got = [(r.a, r.b) for r in bpe.train(counts, 1000).orderBy("rank").collect()]
    assert got == plain_train(plain, 1000)
    assert len(jobs) < 150, jobs


@pytest.mark.parametrize("known, sample, pending", [(20_000, 20_000, 256), (12, 3, 2), (40, 50, 1000)])
def test_runs_ties_and_small_bounds(spark, monkeypatch, known, sample, pending):
    """Runs of one byte, ties, a floor that is soon reached, a sample that says little, and pairs that run out."""
    for name, value in (("KNOWN", known), ("SAMPLE", sample), ("PENDING", pending), ("BATCH", 7)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(3)
    plain = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 12))): rng.randint(1, 40) for _ in range(80)} | {"aaaa": 50, "aaa": 7, "xyxyxyx": 30, "q" * 40: 9}
    df = spark.createDataFrame([*plain.items(), (None, 4), ("", 5)], "piece string, n long").repartition(4)
    got = [(r.a, r.b) for r in bpe.train(df, 10_000).orderBy("rank").collect()]
    assert got == plain_train(plain, 10_000)


def test_train_edges(spark):
    assert bpe.train(spark.createDataFrame([], "piece string, n long"), 5).count() == 0
    assert bpe.train(spark.createDataFrame([("a", 4)], "piece string, n long"), 5).count() == 0
    assert bpe.train(spark.createDataFrame([("ab", 4)], "piece string, n long"), 0).count() == 0


def test_merged_of_long_pieces():
    rng = random.Random(1)
    merges = [(97, 97), (256, 256), (97, 98), (258, 256), (257, 97)]
    ranks = {p: 256 + i for i, p in enumerate(merges)}
    for _ in range(200):
        text = "".join(rng.choice("aab") for _ in range(rng.randint(0, 40)))
        assert bpe.merged(list(text.encode()), ranks) == plain_encode(text, merges)
    assert len(bpe.merged([97] * 200_000, ranks)) == 50_000


def test_saved_tokenizer(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    merges = bpe.train(bpe.word_counts(docs.select("text")), 120)
    one = bpe.Tokenizer.trained(merges, ["<|end|>", "<|end|>x", "<s>", ""])
    one.save(spark, f"{tmp_path}/t")
    two = bpe.Tokenizer.load(spark, f"{tmp_path}/t")
    assert (two.merges, two.specials, two.pattern, two.vocabulary) == (one.merges, one.specials, one.pattern, one.vocabulary)
    texts = [("a", "a<|end|>xb <s>"), ("b", None), ("c", ""), ("d", "<s><s>"), ("e", "<|en"), ("f", "e " * 5000), ("g", "é ü")]
    df = docs.selectExpr("cast(doc_id as string) k", "text").union(spark.createDataFrame(texts, "k string, text string"))
    for specials in (False, True):
        coded = two.decode(two.encode(df, "text", "ids", specials), "ids", "back").collect()
        for r in coded:
            parts = [p for p in re.split(r"(<\|end\|>|<s>)", r.text or "") if p] if specials else [r.text or ""]
            assert r.ids == [i for p in parts for i in ([one.specials[p]] if specials and p in one.specials else plain_encode(p, one.merges))], r.k
            assert r.back == (r.text or "")
    # a vocabulary that does not fit is refused
    spark.createDataFrame([('{"id": 0, "bytes": "00"}',)], "value string").write.mode("overwrite").text(f"{tmp_path}/t/vocabulary")
    with pytest.raises(ValueError):
        bpe.Tokenizer.load(spark, f"{tmp_path}/t")


def test_unknown_ids_and_broken_bytes(spark):
    t = bpe.Tokenizer([(97, 98)], ["<s>"])
    df = spark.createDataFrame([([256, 257, 99999, 0xC3],), (None,)], "ids array<int>")
    assert [r.text for r in t.decode(df, "ids", "text").collect()] == ["ab<s>�", None]


@pytest.mark.parametrize("held, known, depth", [(0, 20_000, 16), (0, 12, 3), (1 << 22, 12, 2), (40, 30, 1000)])
def test_segments_on_the_driver_and_in_tasks(spark, monkeypatch, held, known, depth):
    """Many floors, segments that the driver does not take, and more pairs with the highest count than it knows."""
    for name, value in (("HELD", held), ("KNOWN", known), ("DEPTH", depth), ("TABLE", 5), ("SAMPLE", 30)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(5)
    plain = {"".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 9))): rng.choice([1, 1, 2, 3, 20]) for _ in range(50)} | {"aaaaa": 50, "aaa": 7, "b" * 31: 9, "é" * 6: 4}
    df = spark.createDataFrame([*plain.items()], "piece string, n long").repartition(3)
    got = [(r.a, r.b) for r in bpe.train(df, 10_000).orderBy("rank").collect()]
    assert got == plain_train(plain, 10_000)


def test_two_hundred_merges_need_few_passes_over_the_pieces(spark, monkeypatch):
    counts, plain = counts_of(spark, "/root/testdata/sf0.001/documents.parquet")
    jobs, original = [], bpe._changed
    monkeypatch.setattr(bpe, "_changed", lambda done, tried: jobs.append(len(tried)) or original(done, tried))
    assert [(r.a, r.b) for r in bpe.train(counts, 200).orderBy("rank").collect()] == plain_train(plain, 200)
    assert len(jobs) <= 5, jobs


def test_white_space_beside_spaces(spark, monkeypatch):
    """Texts that are cut at their spaces give the pieces of the pattern, also where the memory of chunks is full."""
    for name, value in (("MEMO", 4), ("AT_ONCE", 10), ("TABLE", 3)):
        monkeypatch.setattr(bpe, name, value)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a\nb c", "\n\n", "x\t\x0b\x0c\ry z", "a\xa0b c d e\x85f g\x1ch", "é ü é", "q" * 300 + " " + "ab" * 200, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").repartition(2)
    expected = Counter(p for t in texts for p in re.findall(bpe.PATTERN, t or ""))
    assert {r.piece: r.n for r in bpe.word_counts(df.select("text")).collect()} == expected
    merges = [(97, 98), (256, 256), (32, 32), (10, 98), (97, 10), (195, 169), (113, 113), (262, 262)]
    for specials in ([], ["\n", "ab"]):
        t = bpe.Tokenizer(merges, specials)
        for r in t.decode(t.encode(df, "text", "ids", True), "ids", "back").collect():
            parts = [p for p in re.split("(\n|ab)", r.text or "") if p] if specials else [r.text or ""]
            assert r.ids == [i for p in parts for i in ([t.specials[p]] if p in t.specials else plain_encode(p, t.merges))], r.text
            assert r.back == (r.text or "")


def test_saved_query_codes_a_document_once(spark, tmp_path):
    """A row a document, whatever its id; nothing is coded twice to be joined."""
    from corpusloom.plans import catalog

    docs = [(1, "a b\nc"), (1, "a b"), (None, "b\n\n"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["bpe_save"](spark, str(tmp_path))
    assert Counter((r.doc_id, r.specials, r.same) for r in found.collect()) == Counter([(1, 2, True), (1, 1, True), (None, 3, True), (2, 0, None), (3, 1, True)])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
