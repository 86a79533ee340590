"""Hard-negative mining by a secondary-sort shuffle.

An anchor's positives are its ``POSITIVES`` best other rows of its label; for each positive, the
``NEGATIVES`` best rows of other labels whose score is between ``LOW`` and ``HIGH`` per cent of the positive's
are returned. Scores are inner products of the integers floor(``SCALE`` * x); higher ones come first, ties by
smaller id.

Scored pairs are packed into keys of 33 bytes whose byte order is (anchor, score descending, positives
before negatives, id, row). ``repartitionAndSortWithinPartitions`` brings each anchor's keys together in that order,
and an iterator reads them as a stream: a positive opens a window, a negative is emitted for every open window
that holds its score and is not full. Nothing is held but the open windows. A positive comes before its
negatives, as the window of a positive score ends below it and that of score 0 is 0 itself, where positives
sort first; negative scores have empty windows.

Which pairs are shuffled. The anchors are broadcast in blocks of at most ``GROUP_BYTES``, and each task
scores its own rows against a block. A first pass over the vectors keeps each task's best positives of every anchor, and
a window merges them; a second pass keeps each task's best negatives of each positive's window. What a task
leaves out is beaten by as many of its own rows, so that no row of the result is lost, and what it sends
is at most ``POSITIVES * NEGATIVES`` keys an anchor.

Rows with a null id or label, and vectors that are null or hold null or non-finite components, take no part. Vectors of
unlike length meet in the components that both have; an empty one scores 0. A row is no partner of its own id; repeated
rows of another id are partners each, and each anchor row is answered for itself. Scores
beyond 2**62 are held there. An empty table gives an empty result. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import cut, quoted
from corpusloom.llm.topk import _exact, _read, usable

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Bytes of a block of anchors, and cells of the score matrices a task works on.
GROUP_BYTES, CELLS = 8 << 20, 1 << 21
_EDGE = 1 << 62
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
_UNPACK = struct.Struct(">QQBQQ")
_FLIP = np.uint64(1 << 63)
_SCHEMA = "n long, anchor_id long, score long, id long, row long"


class Anchors(NamedTuple):
    """A block of anchors by rising number; ``low`` and ``high`` are the windows, one column a positive."""

    numbers: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    labels: pa.Array
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component, held within 2**62."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(_EDGE)), F.least(F.lit(float(_EDGE)), x.cast("double") * SCALE))))


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both."""
    width = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :width], vectors[:, :width]
    kind = _exact(queries, vectors)
    out = queries.astype(kind) @ vectors.astype(kind).T
    return np.clip(out, -_EDGE, _EDGE).astype(np.int64)


class Best:
    """The k best (score, id) of some lists, as flat arrays; ``least`` is the k-th score of a full list."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.least = np.full(lists, np.iinfo(np.int64).min)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))

    def offer(self, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``score`` and ``allowed`` have a row a list and a column for each of ``ids``."""
        least = self.least
        if allowed.shape[1] > self.k and (least == np.iinfo(np.int64).min).any():
            known = np.where(allowed, score, np.iinfo(np.int64).min)
            least = np.maximum(least, np.partition(known, -self.k, axis=1)[:, -self.k])
        number, at = np.nonzero(allowed & (score >= least[:, None]))
        new = (number, score[number, at], ids[at], rows[at])
        number, score, ids, rows = (np.concatenate(x) for x in zip(self.held, new))
        order = np.lexsort((rows, ids, -score, number))
        number = number[order]
        place = np.arange(len(number)) - np.searchsorted(number, number)
        order, number = order[place < self.k], number[place < self.k]
        self.held = (number, score[order], ids[order], rows[order])
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[number[full]] = self.held[1][full]


def _chunks(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[np.ndarray, ...]]:
    """Scores, whether labels are the same, whether ids differ, ids and row numbers of some rows at a time."""
    labels = pc.index_in(anchors.labels, anchors.labels.unique()).to_numpy(zero_copy_only=False)
    step = max(1, CELLS // max(1, len(anchors.ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids, vectors = _read(part)
            own = pc.fill_null(pc.index_in(part["label"], anchors.labels.unique()), -1).to_numpy(zero_copy_only=False)
            yield scores(anchors.vectors, vectors), labels[:, None] == own[None, :], anchors.ids[:, None] != ids[None, :], ids, part["row"].to_numpy()


def _batch(anchors: Anchors, held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    number, score, ids, rows = held
    return pa.record_batch({"n": pa.array(anchors.numbers[number]), "anchor_id": pa.array(anchors.ids[number]), "score": pa.array(score), "id": pa.array(ids), "row": pa.array(rows)})


def _positives(block: Broadcast, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        best = Best(len(anchors.ids), k)
        for score, same, other, ids, rows in _chunks(batches, anchors):
            best.offer(score, same & other, ids, rows)
        yield _batch(anchors, best.held)

    return run


def _negatives(block: Broadcast, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        windows = [Best(len(anchors.ids), k) for _ in range(anchors.low.shape[1])]
        for score, same, other, ids, rows in _chunks(batches, anchors):
            for window, low, high in zip(windows, anchors.low.T, anchors.high.T):
                if (low <= high).any():
                    window.offer(score, ~same & other & (score >= low[:, None]) & (score <= high[:, None]), ids, rows)
        # a row that several windows keep is sent once
        every = np.unique(np.concatenate([np.stack(w.held, axis=1) for w in windows]), axis=0)
        yield _batch(anchors, tuple(every.T))

    return run


def _packed(kind: int) -> Callable:
    """Keys of scored pairs, in the order described above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, _KEY)
            key["anchor"] = batch["n"].to_numpy().astype(np.uint64)
            key["score"] = ~(batch["score"].to_numpy().astype(np.uint64) ^ _FLIP)
            key["kind"] = kind
            key["id"] = batch["id"].to_numpy().astype(np.uint64) ^ _FLIP
            key["row"] = batch["row"].to_numpy().astype(np.uint64)
            yield pa.record_batch({"key": pa.array([x.tobytes() for x in key], pa.binary()), "anchor_id": batch["anchor_id"]})

    return run


def _signed(x: int) -> int:
    return x - (1 << 63)


def windows(keys: Iterator[tuple[bytes, int]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from one partition's sorted keys."""
    anchor, opened = None, []
    for key, anchor_id in keys:
        number, score, kind, name, _ = _UNPACK.unpack(key)
        score, name = _signed((1 << 64) - 1 - score), _signed(name)
        if number != anchor:
            anchor, opened = number, []
        if kind == 0:
            if len(opened) < positives:
                opened.append([name, score, 0])
            continue
        for window in opened:
            positive, best, emitted = window
            if emitted < negatives and low * best <= 100 * score <= high * best:
                window[2] += 1
                yield anchor_id, positive, window[2], name, best, score


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of which ``is_anchor`` holds."""
    if not 0 <= low <= high < 100:
        raise ValueError("a window must end below its positive")
    spark = df.sparkSession
    rows = df.where(usable(quoted(vector_col)) & quoted(id_col).isNotNull() & label.isNotNull())
    rows = rows.select(quoted(id_col).cast("long").alias("id"), label.cast("string").alias("label"), quantised(quoted(vector_col)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    asked, longest = rows.agg(F.count_if("anchor"), F.max(F.size("v"))).first()
    blocks = max(1, ceil((asked or 0) * 8 * max(1, longest or 0) / GROUP_BYTES))
    keys = []
    for block in range(blocks):
        held = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).toArrow().sort_by("row")
        anchors = Anchors(held["row"].to_numpy(), *_read(held), held["label"].combine_chunks())
        sent = spark.sparkContext.broadcast(anchors)
        found = rows.select("id", "label", "v", "row").mapInArrow(_positives(sent, positives), _SCHEMA)
        order = Window.partitionBy("n").orderBy(F.desc("score"), "id", "row")
        found = cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
        top = found.select("n", "place", "score").toArrow()
        ends = [np.full((len(anchors.ids), positives), x) for x in (_EDGE, -_EDGE)]
        number, place = np.searchsorted(anchors.numbers, top["n"].to_numpy()), top["place"].to_numpy() - 1
        score = top["score"].to_numpy().astype(object)
        ends[0][number, place] = -(-score * low // 100)
        ends[1][number, place] = score * high // 100
        sent = spark.sparkContext.broadcast(anchors._replace(low=ends[0], high=ends[1]))
        hard = rows.select("id", "label", "v", "row").mapInArrow(_negatives(sent, negatives), _SCHEMA)
        both = [part.mapInArrow(_packed(kind), "key binary, anchor_id long") for kind, part in enumerate((found.drop("place"), hard))]
        keys.append(both[0].union(both[1]) if blocks == 1 else cut(both[0].union(both[1])))
    pairs = reduce(DataFrame.union, keys).rdd.map(lambda r: (bytes(r[0]), r[1]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    mined = dealt.mapPartitions(lambda part: windows(part, positives, negatives, low, high))
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
