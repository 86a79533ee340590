"""Exact top-k by inner product with MaxScore over dimension postings.

A vector's components are turned into the integers floor(``SCALE`` * x). Each dimension is a term; its
postings in a shard are the rows that are not zero there, kept term by term (a whole column where
most rows are not zero, as in dense vectors). A query's terms are split by score bounds: by Cauchy and
Schwarz its terms of least weight can together add at most their norm times the vector's, so the
most of them whose bound stays below the query's threshold are non-essential, and a vector that the
essential terms give nothing is no candidate. The essential postings are traversed; the other terms
are probed ``PROBE`` at a time, and only for vectors that are still competitive, which means that what
they have reached and the bound of the terms left come to the threshold.

Thresholds. A pilot of at most ``PILOT`` rows, a sample by hash, gives every query the k-th best score among
them to start with, which no better answer can fall short of. It rises with each shard of a task. The tasks'
lists are merged by a window.

Layout. The vectors stay where they are, in shards of ``SHARD_CELLS`` components within a task; the
queries are broadcast in blocks of at most ``GROUP_BYTES``, one pass over the vectors a block, and so is
the pilot. Nothing but the best rows of each task is shuffled.

A vector that is null or holds a null or non-finite component takes no part, neither as query nor as
candidate; nor does a null id. Vectors of unlike length meet in the components that both have, however
long they are. A query's own id is no candidate; repeated rows of another id are candidates each, and
each query row is answered for itself. Ties go to the smaller id. A score beyond 64 bits is given as the
nearest number of 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import bounded_sample, cut, quoted

SCALE = 1024
PILOT, PROBE, SHARD_CELLS, GROUP_BYTES = 2048, 8, 1 << 19, 8 << 20
#: Bounds are floats; so much more than their rounding is allowed for.
SLACK = 1 + 1e-9
_TOP = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component, held within 64 bits."""
    edge = float(1 << 62)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x.cast("double") * SCALE))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` numbers, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _exact(queries: np.ndarray, vectors: np.ndarray) -> type:
    """A type in which all partial sums are exact: doubles up to 2**53, 64-bit integers, else Python's."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    return np.float64 if top < 2**53 else np.int64 if top < 2**62 else object


class Work:
    """How much a search did: products of two components, and what all pairs in all terms would have taken."""

    def __init__(self) -> None:
        self.products = self.every = self.scored = self.pairs = 0


class Best:
    """The k best (score, -id) of each query so far; ``least`` is the threshold."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.score = np.zeros((queries, k), object)
        self.ids = np.zeros((queries, k), np.int64)
        self.held = np.zeros(queries, int)
        self.least = np.full(queries, -np.inf) if least is None else least.copy()

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        n, k = self.held[q], self.score.shape[1]
        s, i = np.concatenate([self.score[q, :n], score]), np.concatenate([self.ids[q, :n], ids])
        order = sorted(range(len(s)), key=lambda at: (-s[at], i[at]))[:k]
        self.held[q] = n = len(order)
        self.score[q, :n], self.ids[q, :n] = s[order], i[order]
        if n == k:
            self.least[q] = max(self.least[q], float(s[order[-1]]))


class Shard:
    """The postings of some vectors: for each term the rows that are not zero and their values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(vectors.T)
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        filled = np.count_nonzero(self.columns, axis=1)
        self.whole = filled * 2 > len(ids)
        self.rows = {d: np.flatnonzero(self.columns[d]) for d in np.flatnonzero(~self.whole)}

    def traverse(self, q: np.ndarray, terms: np.ndarray, work: Work) -> np.ndarray:
        """What the terms' postings add up to for each row."""
        dense = terms[self.whole[terms]]
        out = q[dense] @ self.columns[dense]
        work.products += len(dense) * len(self.ids)
        for d in terms[~self.whole[terms]]:
            rows = self.rows[d]
            out[rows] += q[d] * self.columns[d, rows]
            work.products += len(rows)
        return out

    def search(self, query_id: int, q: np.ndarray, best: Best, number: int, work: Work) -> None:
        """Offer the rows that may belong to the best of one query."""
        least = best.least[number]
        order = np.argsort(-np.abs(q.astype(np.float64)), kind="stable")
        weight = q[order].astype(np.float64) ** 2
        # norm of the terms from each position on
        rest = np.sqrt(np.append(np.cumsum(weight[::-1])[::-1], 0.0)) * SLACK
        longest = self.norm.max(initial=0.0)
        # the fewest essential terms: the bound of all others stays below the threshold
        at = int(np.argmax(rest * longest < least)) if least > 0 and (rest * longest < least).any() else len(q)
        work.pairs += len(self.ids)
        work.every += len(self.ids) * len(q)
        if not at and len(q):
            return
        reached = self.traverse(q, order[:at], work)
        keep = np.flatnonzero((reached.astype(np.float64) + rest[at] * self.norm >= least) & (self.ids != query_id))
        reached = reached[keep]
        while at < len(q) and len(keep):
            terms = order[at : at + PROBE]
            reached = reached + q[terms] @ self.columns[np.ix_(terms, keep)]
            work.products += len(terms) * len(keep)
            at += len(terms)
            go_on = reached.astype(np.float64) + rest[at] * self.norm[keep] >= least
            keep, reached = keep[go_on], reached[go_on]
        work.scored += len(keep)
        if not len(keep):
            return
        k = best.score.shape[1]
        if len(keep) > k:
            # all that tie with the k-th stay
            edge = np.partition(reached, len(reached) - k)[len(reached) - k]
            keep, reached = keep[reached >= edge], reached[reached >= edge]
        if reached.dtype != object:
            reached = reached.astype(np.int64).astype(object)
        best.offer(number, self.ids[keep], reached)


def maxscore(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best, work: Work) -> None:
    """Bring the best rows of each query up to date with some more vectors."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (queries, vectors))
    kind = _exact(queries, vectors)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    rows = max(1, SHARD_CELLS // max(1, width))
    for at in range(0, len(ids), rows):
        shard = Shard(ids[at : at + rows], vectors[at : at + rows])
        for number, name in enumerate(query_ids):
            shard.search(name, queries[number], best, number, work)


class Asked(NamedTuple):
    """A block of queries: number and id of each row, the vectors, and the thresholds to start from."""

    numbers: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    least: np.ndarray


def _read(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = table["v"] if isinstance(table, pa.RecordBatch) else _one(table["v"])
    return table["id"].to_numpy(), _matrix(v, int(np.diff(v.offsets.to_numpy()).max(initial=0)))


def _thresholds(pilot: Broadcast, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = _read(batch)
            best = Best(len(ids), k)
            maxscore(ids, vectors, *pilot.value, best, Work())
            yield pa.record_batch({"n": batch["n"], "least": pa.array(best.least)})

    return run


def _search(asked: Broadcast, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        best = Best(len(own.ids), k, own.least)
        for batch in batches:
            ids, vectors = _read(batch)
            maxscore(own.ids, own.vectors, ids, vectors, best, Work())
        kept = np.arange(k)[None, :] < best.held[:, None]
        score = pa.array([min(max(int(s), -_TOP - 1), _TOP) for s in best.score[kept]], pa.int64())
        yield pa.record_batch({"n": pa.array(np.repeat(own.numbers, best.held)), "query_id": pa.array(np.repeat(own.ids, best.held)), "vec_id": pa.array(best.ids[kept]), "score": score})

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row of which ``is_query`` holds."""
    rows = df.where(usable(quoted(vector_col)) & quoted(id_col).isNotNull())
    rows = rows.select(quoted(id_col).cast("long").alias("id"), quantised(quoted(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()))
    asked, longest = rows.agg(F.count_if("q"), F.max(F.size("v"))).first()
    sc = df.sparkSession.sparkContext
    bound = max(1, GROUP_BYTES // (8 * max(1, longest or 0)))
    pilot = sc.broadcast(_read(bounded_sample(rows.select("id", "v", F.xxhash64("n").alias("h")), "h", min(PILOT, bound), "id").toArrow()))
    blocks = max(1, ceil((asked or 0) / bound))
    lists = []
    for block in range(blocks):
        part = cut(rows.where(F.col("q") & (F.pmod(F.xxhash64("n"), F.lit(blocks)) == block)).select("n", "id", "v"))
        held = part.toArrow().sort_by("n")
        least = part.mapInArrow(_thresholds(pilot, k), "n long, least double").toArrow().sort_by("n")["least"].to_numpy()
        own = sc.broadcast(Asked(held["n"].to_numpy(), *_read(held), least))
        found = rows.select("id", "v").mapInArrow(_search(own, k), "n long, query_id long, vec_id long, score long")
        lists.append(found if blocks == 1 else cut(found))
    best = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.union, lists).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
