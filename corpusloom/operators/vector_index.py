"""An approximate vector index: coarse k-means lists as partitioned files, of which a search reads the lists it probes.

``build`` fits centroids on a bounded sample, puts every row into the list of its nearest centroid and writes the rows partitioned
by list, with the payload columns beside the vectors; then it measures on a sample of rows how many lists a query must probe
for the recall asked for, and keeps that number with the index. ``Index.load`` reads the small tables back; ``search`` sends each
query to its nearest lists, prunes the other lists at the scan, and scores lists and queries in blocks as matrices.

Similarity is the cosine; vectors are kept at length 1. Null ids and vectors that are null, of another length than the first, zero, or not finite are
in no list: they have no cosine above 0. Lists of more than ``CELL`` rows are split into cells, so that a list with a third of all rows is
many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import first_k
from corpusloom.sources.shared import cut

#: Rows the centroids are fitted on, most lists, rounds of k-means, rows of a cell, and rows that measure the recall.
SAMPLE, LISTS, ROUNDS, CELL, MEASURED = 1 << 16, 4096, 8, 1 << 15, 64


_SETTINGS = "probes int, rows long, width int, fields string"


def _unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((length > 0) & (length < float("inf")), F.transform(vector, lambda x: (x.cast("double") / length).cast("float")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(centroids: Broadcast, probes: int) -> Callable:
    """Each row as often as it has lists to go to, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _matrix(batch["v"]) @ centroids.value.T
            few = min(probes, score.shape[1])
            lists = np.argsort(-score, axis=1, kind="stable")[:, :few].ravel()
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), few)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists.astype(np.int32))], names=[*rows.schema.names, "list"])

    return run


def _sums(centroids: Broadcast) -> Callable:
    """Of each task the sum and number of the rows nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch["v"])
                nearest = (v @ c.T).argmax(axis=1)
                np.add.at(total, nearest, v)
                n += np.bincount(nearest, minlength=len(c))
        at, d = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
        yield pa.record_batch({"list": pa.array(at, pa.int32()), "d": pa.array(d, pa.int32()), "total": pa.array(total[at, d]), "n": pa.array(n[at])})

    return run


def centroids(rows: DataFrame, lists: int) -> np.ndarray:
    """Spherical k-means on ``rows`` (v of length 1, h a hash that orders them); begins with the rows of least hash."""
    spark = rows.sparkSession
    c = _matrix(rows.orderBy("h", "id").limit(lists).select("v").toArrow()["v"]).astype(np.float32)
    for _ in range(ROUNDS if len(c) else 0):
        found = rows.select("v").mapInArrow(_sums(spark.sparkContext.broadcast(c)), "list int, d int, total double, n long")
        sums = found.groupBy("list", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        new = c.astype(np.float64)
        new[sums["list"].to_numpy(), sums["d"].to_numpy()] = sums["total"].to_numpy()
        length = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(length > 0, new / np.maximum(length, 1e-30), c).astype(np.float32)
    return c


@dataclass
class Index:
    """The small tables of an index; the vectors stay in files."""

    path: str
    centroids: np.ndarray
    sizes: dict[int, int]
    schema: str
    probes: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        c = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
        settings = spark.read.schema(_SETTINGS).json(f"{path}/settings").first()
        return cls(path, _matrix(c["v"]), dict(zip(c["list"].to_pylist(), c["n"].to_pylist())), settings.fields, settings.probes)

    def rows(self, spark: SparkSession, lists: list[int] | None = None) -> DataFrame:
        """The indexed rows; of some lists only their folders are read."""
        every = spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return every if lists is None else every.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): the k best rows above 0 of the lists probed, ties to the smaller id; a query's own id is left out."""
        spark = queries.sparkSession
        width = self.centroids.shape[1] if len(self.centroids) else 0
        asked = queries.select(F.col(id_col).cast("long").alias("query_id"), _unit(F.col(vector_col)).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width))
        sent = spark.sparkContext.broadcast(self.centroids)
        asked = cut(asked.mapInArrow(_nearest(sent, probes or self.probes), "query_id long, v array<float>, list int"))
        lists = sorted(r.list for r in asked.select("list").distinct().collect())  # at most LISTS
        cells = {n: max(1, ceil(self.sizes.get(n, 0) / CELL)) for n in lists}
        many = spark.createDataFrame([(n, m) for n, m in cells.items()], "list int, cells int")
        rows = self.rows(spark, lists).join(F.broadcast(many), "list").select("list", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("cell"), "id", "v")
        asked = asked.join(F.broadcast(many), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "query_id", "v")

        def block(chunk: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
            if chunk.empty or query.empty:
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            a, b = np.vstack(chunk.v.to_numpy()).astype(np.float64), np.vstack(query.v.to_numpy()).astype(np.float64)
            ids, names, out = chunk.id.to_numpy(), query.query_id.to_numpy(), []
            for at in range(0, len(b), 256):
                score = np.round(b[at : at + 256] @ a.T, 6)
                score[names[at : at + 256, None] == ids[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(names[at : at + 256], best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()}))
            out = pd.concat(out)
            return out[out.score > 0]

        found = rows.groupBy("list", "cell").cogroup(asked.groupBy("list", "cell")).applyInPandas(block, "query_id long, id long, score double")
        return first_k(found, ["query_id"], [F.desc("score"), "id"], k)


def build(df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 10) -> Index:
    """Write an index of all rows to ``path`` and return it; the other columns of ``df`` are its payload."""
    spark = df.sparkSession
    payload = [c for c in df.columns if c not in (id_col, vector_col)]
    if clash := {c.lower() for c in payload} & {"id", "v", "list", "h"}:
        raise ValueError(f"payload columns are called like those of the index: {sorted(clash)}")
    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), _unit(F.col(vector_col)).alias("v"), *payload).where(F.col("id").isNotNull() & F.col("v").isNotNull()))
    width = rows.agg(F.min_by(F.size("v"), "id")).first()[0]
    rows = rows.where(F.size("v") == (width or 0))
    n = rows.count()
    hashed = rows.select("id", "v", F.xxhash64("id", F.lit(17)).alias("h"))
    sample = cut(hashed.where(F.pmod("h", F.lit(max(1, n // SAMPLE))) == 0))
    c = centroids(sample, lists or min(LISTS, max(1, isqrt(n))))
    schema = f"id long, v array<float>, {''.join(f'`{f.name}` {f.dataType.simpleString()}, ' for f in rows.schema.fields if f.name in payload)}list int"
    placed = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(c), 1), schema)
    # a list's rows go to as many files as they fill, whatever the size of the list
    dealt = placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, ceil(n / CELL / max(1, len(c)))))))
    dealt.write.mode("overwrite").partitionBy("list").option("maxRecordsPerFile", CELL).parquet(f"{path}/vectors")
    held = {r["list"]: r["count"] for r in spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("list").count().collect()}
    table = spark.createDataFrame([(i, v.tolist(), held.get(i, 0)) for i, v in enumerate(c)], "list int, v array<float>, n long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index = Index(path, c, held, schema, len(c))
    index.probes = measured_probes(index, sample.orderBy("h", "id").limit(MEASURED), recall, k) if n else 1
    spark.createDataFrame([(index.probes, n, width or 0, schema)], _SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    return index


def measured_probes(index: Index, sample: DataFrame, recall: float, k: int) -> int:
    """The fewest lists that hold ``recall`` of the sample's k best rows of all lists."""
    spark = sample.sparkSession
    asked = sample.select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
    best = index.search(asked, k, probes=len(index.centroids)).join(index.rows(spark).select("id", "list"), "id").select("query_id", "list").collect()
    order = {r.query_id: np.argsort(-(index.centroids @ np.array(r.embedding, np.float32)), kind="stable") for r in asked.collect()}
    # how many lists must be probed until each of the best rows is reached
    depth = np.sort([int(np.flatnonzero(order[r.query_id] == r.list)[0]) + 1 for r in best])
    return int(depth[min(len(depth) - 1, ceil(recall * len(depth)) - 1)]) if len(depth) else 1
