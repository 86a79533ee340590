"""The vector index: every row is in it, it is saved and loaded, lists are pruned, and recall against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, vector_index
from corpusloom.plans import search_queries

SF = "/root/testdata/sf0.1/embeddings.parquet"


def test_recall_cover_and_persistence(spark, tmp_path):
    e = spark.read.parquet(SF)
    vector_index.build(e, f"{tmp_path}/i")
    index = vector_index.Index.load(spark, f"{tmp_path}/i")
    held = index.rows(spark)
    assert sorted(r.id for r in held.select("id").collect()) == sorted(r.vec_id for r in e.select("vec_id").collect())
    assert held.join(e.withColumnRenamed("label", "own"), held.id == e.vec_id).where("label = own").count() == e.count()
    assert sum(index.sizes.values()) == e.count() and 1 <= index.probes < len(index.centroids)
    queries = search_queries.asked(e)
    exact = {(r.query_id, r.vec_id) for r in retrieval.search_blocked(queries, e, 10).collect()}
    found = {(r.query_id, r.id) for r in index.search(queries).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    every = {(r.query_id, r.id) for r in index.search(queries, probes=len(index.centroids)).collect()}
    assert len(exact & every) / len(exact) > 0.99  # all lists: exact but for rounding to floats


def test_clusters_need_few_lists_and_few_files(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    rows = [(i, (centre[i % 40] + 0.05 * rng.normal(size=16) if i % 3 else centre[0]).tolist(), f"p{i}") for i in range(4000)]
    monkeypatch.setattr(vector_index, "CELL", 300)  # a third of the rows are copies in one list: many cells
    index = vector_index.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>, name string"), f"{tmp_path}/i", lists=40)
    assert index.probes <= 8 and max(index.sizes.values()) > 1000
    asked = spark.createDataFrame([(10, rows[10][1]), (11, rows[11][1])], "query_id long, embedding array<float>")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = index.search(asked, 5).collect()
    for q in (10, 11):
        order = np.argsort(-(v @ v[q]))
        assert len({r.id for r in got if r.query_id == q} & set(order[order != q][:5].tolist())) >= 4
        assert sorted(r["rank"] for r in got if r.query_id == q) == [1, 2, 3, 4, 5]
    plan = index.rows(spark, [3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_edges(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (4, [1.0], 1), (5, [float("nan"), 1.0], 1), (6, [0.5, 0.5], None), (7, [None, 1.0], 1)]
    index = vector_index.build(spark.createDataFrame(rows, schema), f"{tmp_path}/i")
    assert sorted(r.id for r in index.rows(spark).collect()) == [1, 1, 6]
    asked = spark.createDataFrame([(6, [2.0, 2.0]), (8, None), (9, [1.0]), (10, [-1.0, -1.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r.id, r["rank"]) for r in index.search(asked, 5, probes=9).orderBy("rank").collect()] == [(6, 1, 1), (6, 1, 2)]
    none = vector_index.build(spark.createDataFrame([], schema), f"{tmp_path}/n")
    assert none.search(asked).count() == 0 and vector_index.Index.load(spark, f"{tmp_path}/n").search(asked).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([], "vec_id long, embedding array<float>, V int"), f"{tmp_path}/x")
