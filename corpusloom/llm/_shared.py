"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a temporary one and any other an error, as executors share no local folder. Spark removes
    the files of results that are no longer referred to where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoints-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from ``stems`` that do not clash with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str) -> Column:
    """The column as text, null read as the empty text."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """At most ``n`` rows, those of the smallest ``order`` (a hash) among every m-th hash; m grows with the
    table, so that tasks send few rows to be merged however many tasks there are."""
    every = max(1, df.count() // (2 * n))
    return df.where(F.pmod(F.col(order), F.lit(every)) == 0).orderBy(order, *ties).limit(n)
