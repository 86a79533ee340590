"""Structured Streaming: file-source ingest, idempotent events, service levels and a rate limit with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, pattern: str, schema, files_per_batch: int = 64) -> DataFrame:
    """What in ``path`` matches ``pattern``, Parquet files or folders of them, as a stream; few files a batch keep a batch's memory bounded."""
    # in braces even a plain name is a pattern, for which Spark takes a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/{{{pattern}}}")


def ingest(stream: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run ``build`` on each batch and write the result; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(stream: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """The first of repeated keys; keys older than the watermark are forgotten."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def service_levels(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rate and share of errors in windows of five minutes."""
    seen = stream.withWatermark(ts, delay).groupBy(F.window(ts, "5 minutes"))
    return seen.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def rate_limit(stream: DataFrame, key: str = "user_id", ts: str = "ts", most: int = 10, seconds: int = 60) -> DataFrame:
    """Whether each request is accepted: at most ``most`` accepted ones of a key within ``seconds``."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for batch in batches:
            rows = batch.sort_values([ts, "event_id"])
            accepted = []
            for at in rows[ts].astype("int64") / 1e9 if rows[ts].dtype.kind != "M" else rows[ts].map(lambda t: t.timestamp()):
                recent = [x for x in recent if x > at - seconds]
                accepted.append(len(recent) < most)
                if accepted[-1]:
                    recent.append(at)
            yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "accepted": accepted})
        state.update((recent,))

    return stream.groupBy(key).applyInPandasWithState(run, "event_id long, accepted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def to_files(stream: DataFrame, out: str, state: str):
    """Append a stream's rows to Parquet files, until what there is has been read."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


def last_batch(stream: DataFrame, out: str, state: str) -> DataFrame:
    """The complete result of an aggregate after the last batch, through files that each batch writes anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


class Silence(StatefulProcessor):
    """Per key the time of its last event and a timer ``seconds`` after it; at the timer the key is reclaimed and its state dropped."""

    def __init__(self, key: str, ts: str, seconds: int):
        self.key, self.ts, self.seconds = key, ts, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def _found(self, key: tuple, ms: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(ms), "at": [x / 1000 for x in ms]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wait = self.seconds * 1000
        at = sorted(int(t.value // 1_000_000) for batch in rows for t in batch[self.ts])
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + wait)
        found = []
        for t in at:
            if last is not None and t - last > wait:
                found.append(last + wait)
            last = t if last is None else max(last, t)
        self.last.update((last,))
        self.handle.registerTimer(last + wait)
        yield self._found(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield self._found(key, [expiredTimerInfo.getExpiryTimeInMs()])

    def close(self) -> None:
        pass


def timeouts(stream: DataFrame, key: str, ts: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """(key, at): the times at which a key had been silent for ``seconds``.

    Found when its next event comes or, by a timer on event time, when the watermark (``delay`` behind the latest event) has passed
    that time; so the silence after a key's last event is found too, and nothing is kept of a key that was reclaimed. Needs the state
    store that keeps timers, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("at", T.DoubleType())])
    watched = stream.select(key, ts).withWatermark(ts, delay).groupBy(key)
    return watched.transformWithStateInPandas(Silence(key, ts, seconds), out, "Append", "EventTime")
