"""Retrieval evaluation: hits, recall and reciprocal ranks, sweeps, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
EPS = 1e-9


def hit(relevant: Column, retrieved: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), relevant), F.lit(False)).cast("double") if k > 0 else F.lit(0.0)


def recall(relevant: Column, retrieved: Column, k: int, total: Column | None = None) -> Column:
    """``total``: how many relevant keys there are, where ``relevant`` lists only those that were retrieved."""
    wanted = F.array_distinct(relevant)
    n = F.size(wanted) if total is None else total
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), wanted)) / n
    return F.when(n > 0, found).otherwise(0.0) if k > 0 else F.lit(0.0)


def reciprocal_rank(relevant: Column, retrieved: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    place = F.array_position(F.transform(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x)), True)
    return F.when(place > 0, 1.0 / place).otherwise(0.0)


METRICS = {"hit": hit, "recall": recall, "mrr": reciprocal_rank}


def score(items: DataFrame, ranked: str, relevant: str = "relevant", ks: tuple[int, ...] = KS, total: str | None = None) -> DataFrame:
    """Every metric at every k as a column; ``total`` as in ``recall``."""
    more = {"recall": (F.col(total),)} if total else {}
    return items.withColumns({f"{name}_{k}": f(F.col(relevant), F.col(ranked), k, *more.get(name, ())) for name, f in METRICS.items() for k in ks})


def aggregate(scored: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over the items, one row."""
    return scored.agg(*(F.round(F.avg(f"{name}_{k}"), 6).alias(f"{name}_{k}") for name in METRICS for k in ks))


def melt(row: DataFrame, ks: tuple[int, ...] = KS, value: str = "value") -> DataFrame:
    """(metric, value) of a one-row result."""
    names = [f"{name}_{k}" for name in METRICS for k in ks]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias(value)) for n in names))).alias("m")).select("m.*")


def reranked(keys: str, scores: str, k: Column) -> Column:
    """The first k keys by their scores, ties by position."""
    zipped = F.transform(F.slice(F.arrays_zip(F.col(keys).alias("key"), F.col(scores).alias("score")), F.lit(1), F.greatest(k, F.lit(0))), lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x["key"].alias("key")))
    return F.transform(F.array_sort(zipped), lambda x: x["key"])


def sweep(items: DataFrame, candidates: list[int], ks: tuple[int, ...] = KS, total: str | None = None) -> DataFrame:
    """For each number of candidates the means before and after reranking; items have keys, scores and relevant."""
    wide = items.withColumn("candidates", F.explode(F.array(*map(F.lit, candidates))))
    sides = F.array(F.struct(F.lit("base").alias("side"), F.slice(F.col("keys"), F.lit(1), F.col("candidates")).alias("ranked")), F.struct(F.lit("teacher").alias("side"), reranked("keys", "scores", F.col("candidates")).alias("ranked")))
    rows = wide.withColumn("x", F.explode(sides)).select("relevant", "candidates", "x.side", "x.ranked", *([total] if total else []))
    return score(rows, "ranked", ks=ks, total=total).groupBy("candidates", "side").agg(*(F.round(F.avg(f"{n}_{k}"), 6).alias(f"{n}_{k}") for n in METRICS for k in ks))


def gate_failures(measured: DataFrame, floors: DataFrame) -> DataFrame:
    """Thresholds that are missed. ``measured``: metric, base, teacher; ``floors``: metric, kind (floor or delta), least."""
    value = F.when(F.col("kind") == "floor", F.coalesce("teacher", F.lit(0.0))).otherwise(F.coalesce("teacher", F.lit(0.0)) - F.coalesce("base", F.lit(0.0)))
    joined = floors.join(F.broadcast(measured), "metric", "left").withColumn("value", F.round(value, 6))
    return joined.where(F.col("value") + EPS < F.col("least")).select("metric", "kind", "value", "least")


def student_gate(base: DataFrame, student: DataFrame, least: float = 0.05) -> DataFrame:
    """Whether a student gains enough at the top without losing recall; one row with the deltas."""
    a, b = base.alias("a"), student.alias("b")
    both = a.crossJoin(b)  # one row each
    delta = {m: F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 4) for m in ("hit_1", "mrr_5", "recall_5")}
    gains = (delta["mrr_5"] + EPS >= least) | (delta["hit_1"] + EPS >= least)
    return both.select(*(c.alias(f"d_{m}") for m, c in delta.items()), (gains & (delta["recall_5"] + EPS >= 0)).alias("passed"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of two (metric, value) tables; the delta is null where one lacks the metric."""
    left, right = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    return left.join(right, "metric", "full").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))
