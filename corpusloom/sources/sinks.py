"""Sinks: upserts, idempotent appends, manifests, exports and swaps, all through Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import ordered


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("__rn = 1").drop("__rn")


def upsert(current: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``current`` whose key does not come in, and the last of each incoming key. A null key is an error."""
    checked = incoming.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is missing"))).otherwise(F.col(key)))
    return current.join(incoming.select(key), key, "left_anti").unionByName(latest(checked, [key], [F.desc(seq)]))


def once(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key; rows without the last key are all kept."""
    keyed = F.col(keys[-1]).isNotNull()
    return latest(df.where(keyed), keys, order).unionByName(df.where(~keyed))


def manifest(df: DataFrame, group: str, text: str, key: str, short: int = 500, fan: int = 256) -> DataFrame:
    """Per group: rows, bytes, short texts and the MD5 at the root of a tree of digests.

    A group's texts are numbered by key (ties: by their digests; null texts count as empty). Each ``fan`` neighbouring digests are one digest, of
    their hexadecimal digits side by side, and so are ``fan`` of these; the root is that of what is left in order. So no buffer
    holds a group's texts, and two manifests that differ can be followed down to the leaf that does.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.md5(body).alias("d"), F.octet_length(body).cast("long").alias("b"), (F.length(body) < short).alias("s"))
    rows = ordered.numbered(rows, ["g"], ["k", "d"], "at").withColumn("at", F.col("at") - 1)
    in_order = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "")).alias("d")
    sums = (F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    level = rows.select("g", "at", "d", F.lit(1).cast("long").alias("n"), "b", F.col("s").cast("long").alias("s"))
    for _ in range(2):
        level = level.withColumn("leaf", F.floor(F.col("at") / fan)).groupBy("g", "leaf").agg(in_order, *sums).withColumnRenamed("leaf", "at")
    return level.groupBy("g").agg(in_order, *sums).select(F.col("g").alias(group), F.col("n").alias("articles"), F.col("b").alias("bytes"), F.col("s").alias("suspicious"), F.col("d").alias("md5"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Exported rows; those that lack a required column's value are skipped."""
    rows = spark.read.parquet(path)
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def swap(spark: SparkSession, alias: str, df: DataFrame, path: str) -> None:
    """Write a new version, check that it has rows, and point the view at it; the old version stays until then."""
    df.write.mode("overwrite").parquet(path)
    fresh = spark.read.parquet(path)
    if fresh.isEmpty():
        raise ValueError(f"the new version of {alias} is empty; the old one stays")
    fresh.createOrReplaceTempView(alias)
