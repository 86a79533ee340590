"""Running sums and order statistics of any number of rows a key, without a task that holds a key.

``scan`` deals the rows to ranges of (keys, order) by Spark's sampled boundaries, so that a key with a third of all rows is many
ranges, whatever the values look like. Sums within a range are windows; what a range adds to the ranges
after it is one row a range, at most as many as there are partitions.

``order_statistics`` finds the rows of given ranks by histograms that are refined around them: each pass counts the values of at most
``BUCKETS`` intervals between the bounds known and goes on with the one that holds the rank. The first pass divides the logarithms, the others
the values, and the bounds are values that occur; a number has 52 bits, so that seven passes suffice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import cut

BUCKETS, PASSES = 4096, 12


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys), F.lit(True))


def scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums and maxima, each up to and with its row, in the order given within the keys.

    Nulls come first in order; null keys are a key; rows that tie in all of ``order`` come in an order that the result shows but
    that is not defined. A null value adds nothing. Added columns replace columns of their name.
    """
    spark, added = df.sparkSession, [*(sums or {}), *(maxima or {})]
    own = [c for c in df.columns if c not in added]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v{i}": c for i, c in enumerate([*(F.coalesce(x, F.lit(0)) for x in (sums or {}).values()), *(maxima or {}).values()])}
    rows = df.select(*own, *(c.alias(n) for n, c in values.items()), F.monotonically_increasing_id().alias("__m"))
    dealt = cut(rows.repartitionByRange(parts, *(F.asc(c) for c in [*keys, *order, "__m"])).withColumn("__part", F.spark_partition_id()))
    total = {f"__v{i}": F.sum if i < len(sums or {}) else F.max for i in range(len(added))}
    ends = dealt.groupBy(*keys, "__part").agg(*(f(n).alias(n) for n, f in total.items()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a key goes on in a later range at most once a range
    ends = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), F.count("*").over(before).alias("__ranges"), *(f(n).over(before).alias(f"__b{n[3:]}") for n, f in total.items())).where("__ranges > 0")
    inside = Window.partitionBy("__part", *keys).orderBy(*order, "__m").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(f(n).over(inside).alias(f"__l{n[3:]}") for n, f in total.items()))
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__p"))
    joined = local.join(F.broadcast(ends), match, "left")
    out = [F.coalesce(F.col(f"__l{i}") + F.coalesce(f"__b{i}", F.lit(0)), F.lit(0)).alias(n) if i < len(sums or {}) else F.greatest(f"__l{i}", f"__b{i}").alias(n) for i, n in enumerate(added)]
    return joined.select(*own, *out)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Add the row's number within the keys, from 1."""
    return scan(df, keys, order, {out: F.lit(1).cast("long")})


def with_count(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Add the number of rows of the row's key; counts are made before they are joined, a row a key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(out)).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), out)
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.lit(True))
    return df.join(counts, match).select(*df.columns, out) if keys else df.crossJoin(F.broadcast(counts))  # without keys: one row


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, a column of each rank): the values of the given ranks, which are expressions of the keys and of the number ``n`` of a key's values.

    Ranks count from 1 and are held between 1 and n. Nulls and NaN are no values; keys without values have no row.
    """
    names = list(ranks)
    v = F.col(value).cast("double")
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), (v + 0.0).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    bounds = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.greatest(F.lit(1), F.least(F.col("n"), ranks[x].cast("long"))).alias("left")) for i, x in enumerate(names))))
    seen = bounds.select("*", *(F.col(o).alias(k) for k, o in zip(keys, own)))  # the ranks may ask for the key
    found = cut(seen.select(*own, "n", "low", "high", wanted.alias("w")).select(*own, "n", "low", "high", "w.t", "w.left"))
    # rises with the value: the sign and the logarithm, which is between -745 and 710; infinities beyond
    span = lambda x: F.when(x == 0, 0.0).when(F.abs(x) == float("inf"), F.signum(x) * 1600).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))
    for turn in range(PASSES):
        going = found.where("low < high")
        if going.isEmpty():
            break
        f = span if turn == 0 else (lambda x: x)
        spans = going.select(*(F.col(o).alias(f"__s{o}") for o in own), "low", "high").distinct()
        match = reduce(lambda a, b: a & b, (F.col(o).eqNullSafe(F.col(f"__s{o}")) for o in own), F.lit(True))
        within = rows.join(spans if own else F.broadcast(spans), match & F.col("__v").between(F.col("low"), F.col("high")))
        share = F.try_divide(f(F.col("__v")) - f(F.col("low")), f(F.col("high")) - f(F.col("low")))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS))
        counts = within.groupBy(*own, "low", "high", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("__v").alias("first"), F.max("__v").alias("last"))
        upto = F.sum("c").over(Window.partitionBy(*own, "low", "high").orderBy("bucket"))  # BUCKETS rows at most
        counts = counts.withColumn("upto", upto).select(*(F.col(o).alias(f"__s{o}") for o in own), F.col("low").alias("l"), F.col("high").alias("h"), "c", "upto", "first", "last")
        match = match & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("left") > F.col("upto") - F.col("c")) & (F.col("left") <= F.col("upto"))
        next_ = going.join(counts, match).select(*own, "n", F.col("first").alias("low"), F.col("last").alias("high"), "t", (F.col("left") - F.col("upto") + F.col("c")).alias("left"))
        found = cut(found.where("low >= high").unionByName(next_))
    else:
        raise RuntimeError(f"values of {value} are not told apart after {PASSES} passes")
    at = [F.max(F.when(F.col("t") == i, F.col("low"))).alias(x) for i, x in enumerate(names)]
    return found.groupBy(*own).agg(F.max("n").alias("n"), *at).select(*(F.col(o).alias(k) for k, o in zip(keys, own)), "n", *(F.col(f"`{x}`") for x in names))


def nearest_ranks(quantiles: dict[str, float]) -> dict[str, Column]:
    """Ranks of quantiles by nearest rank: the first value that the share of the values does not exceed."""
    return {name: F.ceil(F.lit(q) * F.col("n")) for name, q in quantiles.items()}


def interpolated(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, a column of each quantile), linear between the two values beside it."""
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in quantiles.items()}
    sides = {f"__{side}_{name}": F.floor(p) + 1 + i for name, p in place.items() for i, side in enumerate(("low", "high"))}
    found = order_statistics(df, keys, value, sides)
    between = lambda name, p: F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (p - F.floor(p))
    return found.select(*keys, "n", *(between(name, p).alias(name) for name, p in place.items()))
