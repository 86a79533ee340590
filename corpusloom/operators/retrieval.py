"""Search, filters, reranking, citations and context over chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine

#: Rows of one cell of the blocked search: queries and vectors. Pairs scored at a time, and the most partitions.
QUERY_BLOCK, VECTOR_BLOCK, PAIRS, PARTITIONS = 4096, 16384, 1 << 15, 4096
#: Needles of one automaton.
NEEDLE_BYTES = 16 << 20


@dataclass(frozen=True)
class SearchFilters:
    """Filters of a tenant's search; ``revision_mode`` is current, historical or all."""

    tenant_id: str
    owner: str | None = None
    tags: tuple[str, ...] = ()
    act_type: str | None = None
    issuer: str | None = None
    reg_number: str | None = None
    is_active: bool | None = None
    revision_mode: str = "current"

    def __post_init__(self) -> None:
        if not self.tenant_id.strip():
            raise ValueError("tenant_id is required for search")

    def exact(self) -> Column:
        """Case-sensitive conditions that a scan can push down; an unknown is_active matches no revision."""
        out = F.col("tenant_id") == self.tenant_id
        for name in ("owner", "act_type", "reg_number"):
            if value := getattr(self, name):
                out &= F.col(name) == value
        for tag in self.tags:
            out &= F.array_contains("tags", tag)
        if self.issuer:
            out &= F.col("issuer").contains(self.issuer)
        if self.is_active is not None:
            out &= F.col("is_active") == self.is_active
        if self.revision_mode in ("current", "historical"):
            out &= F.col("is_active") == (self.revision_mode == "current")
        return out

    def lenient(self) -> Column:
        """Case-insensitive conditions; a missing is_active counts as active and passes both revision modes."""
        low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
        out = low(F.coalesce("tenant_id", "owner")) == self.tenant_id.lower()
        for name in ("owner", "act_type", "reg_number"):
            if value := getattr(self, name):
                out &= low(F.col(name)) == value.lower()
        if self.tags:
            wanted = F.array(*(F.lit(t.lower()) for t in self.tags))
            out &= F.size(F.array_except(wanted, F.transform(F.col("tags"), lambda t: F.lower(F.trim(t))))) == 0
        if self.issuer:
            out &= low(F.col("issuer")).contains(self.issuer.lower())
        if self.is_active is not None:
            out &= F.coalesce("is_active", F.lit(True)) == self.is_active
        if self.revision_mode in ("current", "historical"):
            out &= F.coalesce(F.col("is_active") == (self.revision_mode == "current"), F.lit(True))
        return out


def first_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the k chunks of the highest positive cosine for each of a few queries.

    All queries are broadcast, as those of one request; for a table of queries use ``search_blocked``.
    """
    q = F.broadcast(queries.select("query_id", F.col("embedding").alias("q")))
    same = F.size("q") == F.size("embedding")
    scored = chunks.join(q, same & (F.col("query_id") != F.col("vec_id"))).select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return first_k(scored.where("score > 0"), ["query_id"], [F.desc("score"), "vec_id"], k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as doubles, shorter ones and null components filled with zeros, which add nothing to a product."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _products(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the columns, component after component as SQL's sum adds them."""
    if b.shape[1] > a.shape[1]:  # numpy is fast along long rows
        return _products(a, b).T
    out = np.zeros((b.shape[1], a.shape[1]))
    one = np.empty_like(out)
    for x, y in zip(b, a):
        out += np.multiply.outer(x, y, out=one)
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero, with the sign kept, as SQL rounds."""
    size = np.abs(x) * 1e6
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), x) / 1e6


class Queries:
    """The queries of a cell, and their scores against vectors."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, cosine: bool):
        self.ids, self.cosine = ids, cosine
        self.known = vectors.is_valid().to_numpy(zero_copy_only=False)
        self.columns = np.ascontiguousarray(_matrix(vectors).T)
        self.norms = self._norms(self.columns)

    @staticmethod
    def _norms(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1])
        for x in columns:
            out += x * x
        return np.sqrt(out)

    def scores(self, vectors: pa.Array) -> np.ndarray:
        """(queries, vectors): not rounded; a zero vector's cosine is 0, a missing vector's score is NaN."""
        a = np.ascontiguousarray(_matrix(vectors).T)
        out = _products(self.columns, a)
        if self.cosine:
            length = np.multiply.outer(self.norms, self._norms(a))
            out = np.divide(out, length, out=np.zeros_like(out), where=length != 0)
        out[~self.known] = np.nan
        out[:, ~vectors.is_valid().to_numpy(zero_copy_only=False)] = np.nan
        return out


def _cells(queries: DataFrame, chunks: DataFrame, cosine: bool, score: Callable[[Queries, Iterator[tuple[pa.Array, pa.Array]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``score`` over cells of at most about VECTOR_BLOCK vectors and QUERY_BLOCK queries, which together meet all pairs once.

    A cell's queries come first, its vectors stream past them in slices of at most about PAIRS pairs, so that a task holds the queries
    of one cell and the scores of one slice.
    """
    n, m = chunks.count(), queries.count()
    rows, cols = max(1, -(-n // VECTOR_BLOCK), min(32, -(-n // 1024))), max(1, -(-m // QUERY_BLOCK))
    part = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    all_of = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = chunks.select(F.col("vec_id").cast("long").alias("id"), "embedding", part("vec_id", rows).alias("r"), all_of(cols).alias("c"), F.lit(True).alias("chunk"))
    right = queries.select(F.col("query_id").cast("long").alias("id"), "embedding", all_of(rows).alias("r"), part("query_id", cols).alias("c"), F.lit(False).alias("chunk"))
    both = right.union(left).select((F.col("r").cast("long") * cols + F.col("c")).alias("cell"), "chunk", "id", "embedding")
    parts = min(rows * cols, PARTITIONS)
    dealt = both.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "chunk")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        """Runs of rows of one cell and kind."""
        for batch in batches:
            kind = batch["cell"].to_numpy() * 2 + batch["chunk"].to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for x, y in zip(ends, ends[1:]):
                if y > x:
                    yield int(kind[x]) // 2, bool(kind[x] % 2), batch.slice(x, y - x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(slices(batches), key=lambda s: s[0]):
            asked, rest = [], iter(cell)
            for _, chunk, batch in rest:
                if chunk:
                    rest = chain([(None, True, batch)], rest)
                    break
                asked.append(batch)
            else:
                continue
            if asked:
                held = Queries(pa.concat_arrays([b["id"] for b in asked]), pa.concat_arrays([b["embedding"] for b in asked]), cosine)
                step = max(1, PAIRS // len(held.ids))
                yield from score(held, ((b["id"].slice(x, step), b["embedding"].slice(x, step)) for _, _, b in rest for x in range(0, len(b), step)))

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _pairs(query_ids: pa.Array, ids: pa.Array, scores: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([query_ids, ids, scores], ["query_id", "vec_id", "score"])


def search_blocked(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """As ``search`` for any number of queries: blocks of vectors meet blocks of queries as matrices."""

    def best(held: Queries, vectors: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        names = held.ids.to_numpy()
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        least = np.zeros(len(names))  # a score that k found ones of the query reach

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, found, top = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((found, -top, q))
            q, found, top = q[order], found[order], top[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            least[q[place == k - 1]] = top[place == k - 1]
            return q[place < k], found[place < k], top[place < k]

        waiting = 0
        for ids, own in vectors:
            ids, score = ids.to_numpy(), held.scores(own)
            x, y = np.nonzero((score >= least[:, None] - 1e-6) & (names[:, None] != ids[None, :]))
            near = _rounded(score[x, y])
            keep = (near > 0) & (near >= least[x])
            parts.append((x[keep], ids[y[keep]], near[keep]))
            waiting += np.count_nonzero(keep)
            if waiting > max(PAIRS, len(names) * k):
                parts, waiting = [merged()], 0
        q, found, top = merged()
        yield _pairs(pa.array(names[q], pa.int64()), pa.array(found, pa.int64()), pa.array(top))

    whole = lambda df, name: df.where(F.col(name).isNotNull() & F.col("embedding").isNotNull())
    found = _cells(whole(queries, "query_id"), whole(chunks, "vec_id"), True, best)
    return first_k(found, ["query_id"], [F.desc("score"), "vec_id"], k)


def scored(queries: DataFrame, chunks: DataFrame, cosine: bool = True, above: float | None = None) -> DataFrame:
    """(query_id, vec_id, score): every query against every vector, itself included; with ``above`` only higher scores.

    A zero vector's cosine is 0, a missing vector's score is null.
    """

    def every(held: Queries, vectors: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for ids, own in vectors:
            score = _rounded(held.scores(own)).ravel()
            none = (~held.known[:, None] | ~own.is_valid().to_numpy(zero_copy_only=False)[None, :]).ravel()
            at = np.arange(len(score)) if above is None else np.flatnonzero(score > above)
            yield _pairs(held.ids.take(pa.array(at // len(ids))), ids.take(pa.array(at % len(ids))), pa.array(score[at], mask=none[at]))

    return _cells(queries, chunks, cosine, every)


def substring_search(chunks: DataFrame, needle: str, k: int, filters: SearchFilters) -> DataFrame:
    """The fallback: share of occurrences in the text, a bonus for active and for numbered acts."""
    low = F.lower("text")
    hits = (F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)
    score = hits / F.greatest(F.length("text"), F.lit(1)) + F.when(F.coalesce("is_active", F.lit(True)), 0.2).otherwise(0.0)
    if filters.reg_number:
        score = score + F.when(F.coalesce("reg_number", F.lit("")) != "", 0.2).otherwise(0.0)
    return chunks.where(filters.lenient() & low.contains(needle.lower())).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "chunk_id").limit(k)


def _finder(needles: Broadcast) -> Callable:
    @F.pandas_udf("array<struct<needle: string, hits: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for needle in needles.value:
            tree.add_word(needle, needle)
        if len(tree):
            tree.make_automaton()
        for batch in batches:
            out = []
            for text in batch:
                ends: dict[str, int] = {}
                hits: dict[str, int] = {}
                for last, needle in tree.iter(text) if text and len(tree) else ():
                    if last - len(needle) >= ends.get(needle, -1):
                        ends[needle] = last
                        hits[needle] = hits.get(needle, 0) + 1
                out.append([{"needle": n, "hits": k} for n, k in hits.items()])
            yield pd.Series(out)

    return run


def needle_counts(chunks: DataFrame, needles: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, needle, hits) of every needle in every text, upper and lower case alike: occurrences from the left that do not overlap.

    One automaton of all needles passes over each text once, however many needles there are. Needles of at most ``NEEDLE_BYTES`` in
    all are broadcast; more of them go in as many parts, each a pass over the texts. Null and empty needles are left out, repeated ones count once.
    """
    wanted = needles.select(F.lower(F.col(needles.columns[0])).alias("needle")).where("needle <> ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    parts = max(1, -(-size // NEEDLE_BYTES))
    found = []
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part).toArrow()["needle"].to_pylist()
        sent = chunks.sparkSession.sparkContext.broadcast(own)

        found.append(chunks.select(F.col(id_col), F.explode(_finder(sent)(F.lower(F.col(text_col)))).alias("x")).select(id_col, "x.needle", "x.hits"))
    return reduce(DataFrame.union, found)


def rerank(hits: DataFrame, score: str, k: int, group: str = "query_id", position: str = "rank", cut: int | None = None) -> DataFrame:
    """Order by score, ties by the old position; with ``cut`` only the first hits take part."""
    rows = hits.where(F.col(position) <= cut) if cut is not None else hits
    return first_k(rows, [group], [F.desc(score), position], k, "new_rank")


def citations(hits: DataFrame, minimum: int = 3, maximum: int = 5, group: str = "query_id") -> DataFrame:
    """Distinct (file, page) hits in rank order, at most ``maximum``, and whether there are ``minimum``."""
    known = F.col("file").isNotNull() | F.col("page").isNotNull()
    key = F.when(known, F.to_json(F.struct("file", "page"))).otherwise(F.to_json(F.struct("chunk_id", "text")))
    unique = first_k(hits.withColumn("key", key), [group, "key"], ["rank"], 1, "seen")
    kept = first_k(unique, [group], ["rank"], maximum, "citation")
    return kept.withColumn("has_minimum", F.count("*").over(Window.partitionBy(group)) >= minimum).drop("key", "seen")


def context(hits: DataFrame, budget: int = 3000, group: str = "query_id") -> DataFrame:
    """The hits' texts in rank order, joined by blank lines and cut at the budget."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = F.filter(F.transform(ordered, lambda h: h["text"]), lambda t: t != "")
    return hits.groupBy(group).agg(F.left(F.array_join(texts, "\n\n"), F.lit(budget)).alias("context"))


def numbered_context(hits: DataFrame, label: str, group: str = "query_id") -> DataFrame:
    """``[i] label`` blocks in rank order, joined by rules."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(label).alias("label"), "text")))
    blocks = F.transform(ordered, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["label"], F.lit("\n"), h["text"]))
    return hits.groupBy(group).agg(F.array_join(blocks, "\n\n---\n\n").alias("context"))
