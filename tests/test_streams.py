"""Tables as streams, and timers: the last silence of a key, and nothing else, is found when the watermark has passed it."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.sources.stores import scratch
from corpusloom.streaming import ingest


def test_timeouts_by_event_and_by_timer(spark):
    day0 = datetime(2024, 1, 1)
    events = [(1, 0), (1, 10), (1, 100), (2, 0), (3, 95), (None, 1), (4, 0), (4, 24), (4, 48.5)]
    path = scratch(spark, "stream")
    rows = [(k, day0 + timedelta(hours=h)) for k, h in events]
    spark.createDataFrame(rows, "k long, ts timestamp").repartition(3).write.parquet(path)
    stream = ingest.source(spark, path, "*.parquet", spark.read.parquet(path).schema)
    out = scratch(spark, "out")
    ingest.to_files(ingest.timeouts(stream, "k", "ts", 24 * 3600), out, scratch(spark, "state")).awaitTermination()
    hours = lambda x: round((x - day0.timestamp()) / 3600, 3)
    got = sorted((r.k or 0, round(r["at"])) for r in spark.read.parquet(out).collect())
    at = lambda h: round((day0 + timedelta(hours=h)).timestamp())
    # key 1 after hour 10; 2 and the null key by timers; 4 within and at its end; 1 and 3 are still watched at hour 99
    assert got == sorted([(1, at(34)), (2, at(24)), (0, at(25)), (4, at(48)), (4, at(72.5))]), [(k, hours(x)) for k, x in got]


@pytest.mark.parametrize("files", [None, 3])
@pytest.mark.parametrize("roles", [["user", "assistant"], ["user"]])
def test_tables_that_are_one_file_or_a_folder(spark, tmp_path, files, roles):
    n = 40
    rows = spark.range(n).select(F.expr("id div 4").alias("conv_id"), (F.col("id") % 4).alias("turn"), F.array(*map(F.lit, roles))[F.col("id") % len(roles)].alias("role"), F.lit("one two").alias("text"))
    path = tmp_path / "conversations.parquet"
    if files:
        rows.repartition(files).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    found = entry.queries()["st_sse"](spark, str(tmp_path))
    expected = [(i // 4, i % 4, k, t) for i in range(n) if roles[i % len(roles)] == "assistant" for k, t in enumerate(("one", "two"))]
    assert sorted(map(tuple, found.collect())) == expected
