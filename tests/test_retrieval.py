"""Searches for more queries than a block holds."""

import random
import re
from pathlib import Path

import duckdb
import psutil

import __spark_entry__ as entry
from corpusloom.operators import retrieval
from corpusloom.plans import search_queries


def test_no_query_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 64)
    e = spark.range(1001).selectExpr("id AS vec_id", "array(cast(1 + id % 7 AS float), cast(1 + id % 5 AS float)) AS embedding", "0 AS label").cache()
    queries = search_queries.asked(e)
    for search in (retrieval.search, retrieval.search_blocked):
        got = search(queries, e, 2).collect()
        assert sorted((r.query_id, r["rank"]) for r in got) == [(q, rank) for q in range(0, 1001, 100) for rank in (1, 2)]


def test_negative_numbers_that_round_to_zero(spark, tmp_path):
    """Their sign is that of SQL's round, which comparisons of files see."""
    values = [-4e-8, 4e-8, -0.0, 0.0, -6e-7, 1.0, -1.0, 0.0078125, -0.0078125]
    spark.createDataFrame([(1, values)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("vec_pack", "vec_normalise"):
        sql = entry.oracle_sql()[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        expected = dict(zip(("vec_id", "v") if name == "vec_normalise" else ("vec_id", "bytes", "v"), duckdb.connect().execute(sql).fetchone()))
        assert str(entry.queries()[name](spark, str(tmp_path)).first()["v"]) == str(expected["v"])


def test_scores_of_odd_vectors(spark, tmp_path, monkeypatch):
    """Ties, a missing vector, missing components and unequal lengths, in many cells, as SQL has them."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieval, "PAIRS", 16)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0, 3.25]) for _ in range(4)], i % 3) for i in range(700)]
    rows[7], rows[200], rows[301], rows[9], rows[10] = (7, None, 0), (200, None, 0), (301, [1.0, None, 2.0, None], 0), (9, [1.0, 2.0], 1), (10, [1.0, 2.0, 0.5, -1.0, 8.0], 1)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("vec_cosine", "flt_score_positive", "search_topk"):
        sql = entry.oracle_sql()[name].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'")
        found = duckdb.connect().execute(sql)
        expected = sorted(str(r) for r in found.fetchall())
        got = entry.queries()[name](spark, str(tmp_path)).select(*(c[0] for c in found.description)).collect()
        assert sorted(str(tuple(r)) for r in got) == expected, name


def test_cells_are_scored_in_slices(spark):
    """Four thousand queries against tens of thousands of vectors: a Python worker holds a slice of the pairs, not a cell of them."""
    workers = lambda: [p.pid for p in psutil.Process().children(recursive=True) if "python" in p.name()]
    for pid in workers():
        Path(f"/proc/{pid}/clear_refs").write_text("5")
    made = lambda n, step, name: spark.range(0, n, step).selectExpr(f"id AS {name}", "array(cast(1 + id % 97 AS float), cast(1 + id % 89 AS float)) AS embedding")
    e, q = made(32_000, 1, "vec_id"), made(32_000, 8, "query_id")
    assert retrieval.scored(q, e, above=0.9999999).count() > 0
    peaks = [int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) // 1024 for pid in workers()]
    assert max(peaks) < 400


def test_many_needles(spark, monkeypatch):
    """Ten thousand needles against a plain count; overlaps, cases, parts of one another, and several automata."""
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abAB c") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaa")]
    needles = ["aa", "AB", "a", "ba b", "", None] + ["".join(rng.choice("abc ") for _ in range(rng.randint(2, 9))) for _ in range(10_000)]
    docs, wanted = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame([(n,) for n in needles], "n string")
    plain = sorted((i, n, t.lower().count(n)) for i, t in texts if t for n in {x.lower() for x in needles if x} if n in t.lower())
    for size in (16 << 20, 300_000):
        monkeypatch.setattr(retrieval, "NEEDLE_BYTES", size)
        assert sorted(tuple(r) for r in retrieval.needle_counts(docs, wanted).collect()) == plain
    assert retrieval.needle_counts(docs, wanted.where("false")).count() == 0
