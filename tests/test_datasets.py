"""Quotas and overlap of answers against plain loops."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import datasets


def plain_greedy(seeds, quotas):
    rooms, out = dict(quotas), []
    for at, ok in sorted(seeds):
        name = next((n for n in quotas if n in ok and rooms[n]), None)
        if name:
            rooms[name] -= 1
            out.append((at, name))
    return out


def test_greedy_quotas(spark):
    rng = random.Random(4)
    for quotas in ({"a": 40, "b": 15, "c": 30}, {"a": 0, "b": 5, "c": 10_000}):
        seeds = [(i * 97, "".join(n for n in "abc" if rng.random() < 0.5)) for i in range(200)]
        df = spark.createDataFrame(seeds, "at long, ok string").repartition(3)
        got = datasets.greedy_quotas(df, quotas, "at", {n: F.col("ok").contains(n) for n in quotas})
        assert sorted((r["at"], r.variant) for r in got.collect()) == plain_greedy(seeds, quotas)
    assert datasets.greedy_quotas(df.where("false"), quotas, "at", {n: F.lit(True) for n in quotas}).count() == 0
    assert datasets.greedy_quotas(df, {"a": 3}, "at", {"a": F.lit(None).cast("boolean")}).count() == 0


def test_assign_quotas(spark):
    df = spark.createDataFrame([(i * 31 % 101,) for i in range(50)], "at long").repartition(4)
    quotas = spark.createDataFrame([("x", 0, 20), ("y", 1, 0), ("z", 2, 25)], "name string, ord int, n int")
    got = sorted((r["at"], r.name) for r in datasets.assign_quotas(df, quotas, "at").collect())
    order = sorted(i * 31 % 101 for i in range(50))
    assert got == sorted(zip(order, ["x"] * 20 + ["z"] * 25))


def plain_common(p, q):
    row = [0] * (len(q) + 1)
    for u in p:
        last = 0
        for j, v in enumerate(q, 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_l(spark):
    rng = random.Random(6)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 200))], [rng.choice("abce") for _ in range(rng.randint(0, 150))]) for _ in range(150)] + [([], []), (["a"], []), (None, ["a"]), (None, None)]
    assert all(datasets.common_length(p or [], q or []) == plain_common(p or [], q or []) for p, q in pairs)
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, p array<string>, q array<string>")
    for r in df.withColumn("f", datasets.rouge_l(F.col("p"), F.col("q"))).collect():
        p, q = r.p or [], r.q or []
        assert abs(r.f - (2 * plain_common(p, q) / (len(p) + len(q)) if p or q else 0)) < 1e-12
    long = [str(i % 977) for i in range(20_000)]
    assert datasets.common_length(long, long[1:]) == len(long) - 1
