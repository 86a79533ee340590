"""Running sums over ranges, and order statistics by refined histograms, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordered


def plain(rows, order):
    total, top, n, out = {}, {}, {}, {}
    for k, o, v, i in sorted(rows, key=order):
        total[k] = total.get(k, 0) + (v or 0)
        n[k] = n.get(k, 0) + 1
        if v is not None:
            top[k] = max(top.get(k, v), v)
        out[i] = (total[k], n[k], top.get(k))
    return out


def test_scan_of_hashed_ids_and_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(-(1 << 62), 1 << 62), rng.choice([None, 1, 5, -3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long, i long").repartition(6)
    got = ordered.scan(df, ["k"], ["o"], {"total": F.col("v"), "n": F.lit(1)}, {"top": F.col("v")})
    assert got.columns == ["k", "o", "v", "i", "total", "n", "top"]
    assert {r.i: (r.total, r.n, r.top) for r in got.collect()} == plain(rows, lambda r: (r[0] is not None, r[0] or "", r[1]))
    every = ordered.numbered(df, [], ["o", "i"]).select("i", "rank").collect()
    assert [r.i for r in sorted(every, key=lambda r: r["rank"])] == [r[3] for r in sorted(rows, key=lambda r: (r[1], r[3]))]
    # no range holds much more than its share, though five in eight rows are of one key
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "o").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * 3000 / 8


def test_scan_ties_and_edges(spark):
    df = spark.createDataFrame([("x", 1)] * 5000 + [("x", None), (None, None)], "k string, o int")
    assert sorted(r["rank"] for r in ordered.numbered(df, ["k"], ["o"]).collect()) == [1, *range(1, 5002)]
    assert ordered.numbered(df.where("false"), ["k"], ["o"]).count() == 0
    assert sorted((r.k or "", r.n) for r in ordered.with_count(df, ["k"]).distinct().collect()) == [("", 1), ("x", 5001), ("x", 5001)]
    assert ordered.with_count(df, []).first().n == 5002


VALUES = {
    "wide": lambda r: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300),
    "near": lambda r: 1 + r.randrange(5000) * 2.0**-52,
    "ties": lambda r: r.choice([0.0, -0.0, 1.5, 7.0, float("inf"), float("-inf")]),
    "big": lambda r: float(r.randrange(1 << 60)),
    "max": lambda r: r.choice([1.7976931348623157e308, -1.7976931348623157e308, 5e-324, 1.0]),
}


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [(k, f(rng)) for k, f in VALUES.items() for _ in range(700)] + [("one", 4.5), (None, 2.0), (None, 9.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = {"p0": 0.0, "p3": 0.03, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in ordered.order_statistics(df, ["k"], "v", ordered.nearest_ranks(qs)).collect()}
    assert set(got) == {*VALUES, "one", None}
    for k, r in got.items():
        values = sorted(v for key, v in rows if key == k)
        assert r.n == len(values)
        for name, q in qs.items():
            assert r[name] == values[max(1, math.ceil(q * len(values))) - 1], (k, name)
    (whole,) = ordered.order_statistics(df, [], "v", {"third": F.lit(3)}).collect()
    assert whole.third == sorted(v for _, v in rows if v is not None and v == v)[2]


def test_interpolated(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", 3.0)], "k string, v double")
    got = {r.k: (r.m, r.p) for r in ordered.interpolated(df, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert got["a"] == pytest.approx((3.0, 8.2)) and got["b"] == (3.0, 3.0)
    assert ordered.interpolated(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
