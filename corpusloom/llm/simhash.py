"""SimHash near-duplicates: 64-bit fingerprints linked at a Hamming distance of at most 3, found with vantage points.

Fingerprints. A text is lower-cased in A-Z and split into words at white space; the XXH64 hashes
(seed 42) of its shingles of three words vote on each bit. A text of fewer words is hashed as a
whole; one of none gets the fingerprint zero.

Links. Exact copies are one fingerprint, so only distinct fingerprints are compared. A link of 3 bits
differs by one bit at most in one of the two halves of 32 bits, so each half is searched by itself, as a metric
space with radius 1 in which the border between two regions is thin. A vantage-point tree over a
bounded sample of fingerprints cuts the space into regions: an inner one of all that are near a
vantage point, an outer one of the rest. Each fingerprint is a resident of the one shard whose region
holds it; by the triangle inequality a linked one in another region lies in the shell around the
border, and those of the outer shell also visit the inner shard. Where a half does not tell
fingerprints apart, their whole distance (radius 3) cuts on. In a shard a vantage-point tree over the
fingerprints themselves finds the links of residents with one another and with visitors, entering
only branches that the triangle inequality leaves open. A shard reports a spanning forest of its
links, not all pairs, and the forests are joined into components.

Why halves. In one space of 64 bits at radius 3 a median cut leaves over half of all points in the
shell, so that each level of the tree would copy them about 1.5 times; with halves it is 1.13 to 1.27
times, twice. The sample holds ``SAMPLE`` fingerprints at most and an eighth of them all; shards hold about
``SHARD`` residents and grow with the table only beyond ``SAMPLE`` / 16 shards.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows are exact
copies. A null id is never the smallest id of a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._shared import as_text, bounded_sample, cut, fresh, quoted
from corpusloom.llm.components import components

RADIUS = 3
#: (bits compared, largest distance in them) by half; the whole distance decides and cuts where a half cannot.
HALVES = ((0xFFFFFFFF, 1), (0xFFFFFFFF00000000, 1))
WHOLE = (0xFFFFFFFFFFFFFFFF, RADIUS)
SHARD, SAMPLE = 2048, 1 << 17
#: Up to so many points a branch is compared directly.
LEAF = 48
_PAIRS = 1 << 21


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array((fingerprint(t.as_py() or "") for t in texts), pa.int64())


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    return df.withColumn(out_col, _fingerprints(as_text(text_col)))


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Join the classes of the pairs in ``root``, where each point names the smallest known of its class."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


class Work:
    """How many nodes of vantage trees were entered and pairs compared."""

    def __init__(self) -> None:
        self.nodes = self.pairs = 0


def _direct(points: np.ndarray, a: np.ndarray, b: np.ndarray, root: np.ndarray, work: Work) -> None:
    step = max(1, _PAIRS // max(1, len(b)))
    work.pairs += len(a) * len(b)
    for at in range(0, len(a), step):
        i, j = np.nonzero(_distance(points[a[at : at + step], None], points[b][None, :]) <= RADIUS)
        _forest(a[at : at + step][i], b[j], root)


def _cut(points: np.ndarray, half: tuple[int, int]) -> tuple[np.uint64, int, np.uint64, int] | None:
    """(mask, radius, vantage point, border) that parts the points: in the half's bits where they differ, else in all."""
    vantage = points[len(points) // 2]
    for mask, radius in (half, WHOLE):
        d = _distance(points & np.uint64(mask), vantage & np.uint64(mask))
        least, most = int(d.min()), int(d.max())
        if least < most:
            return np.uint64(mask), radius, vantage & np.uint64(mask), min(int(np.median(d)), most - 1)
    return None


def _across(points: np.ndarray, a: np.ndarray, b: np.ndarray, half: tuple[int, int], root: np.ndarray, work: Work) -> None:
    """Links between the points numbered ``a`` and those numbered ``b``."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        work.nodes += 1
        cut_at = _cut(points[a], half) if min(len(a), len(b)) > LEAF else None
        if cut_at is None:
            _direct(points, a, b, root, work)
            continue
        mask, radius, vantage, border = cut_at
        near, far = _distance(points[a] & mask, vantage), _distance(points[b] & mask, vantage)
        stack += [(a[near <= border], b[far <= border + radius]), (a[near > border], b[far > border - radius])]


def link(points: np.ndarray, visitor: np.ndarray | None = None, half: tuple[int, int] = WHOLE, work: Work | None = None) -> np.ndarray:
    """For each of the distinct ``points`` the number of the first point of its class of links within them.

    Links of two visitors are left out, and so are those that differ more in the bits of ``half`` than it allows.
    """
    root, work = np.arange(len(points)), work or Work()
    residents = root.copy() if visitor is None else np.flatnonzero(~visitor)
    stack = [residents]
    while stack:
        at = stack.pop()
        work.nodes += 1
        cut_at = _cut(points[at], half) if len(at) > LEAF else None
        if cut_at is None:
            _direct(points, at, at, root, work)
            continue
        mask, radius, vantage, border = cut_at
        d = _distance(points[at] & mask, vantage)
        stack += [at[d <= border], at[d > border]]
        # only the shell around the border can hold links across it
        _across(points, at[(d <= border) & (d > border - radius)], at[(d > border) & (d <= border + radius)], half, root, work)
    if visitor is not None:
        _across(points, residents, np.flatnonzero(visitor), half, root, work)
    return root


class Regions:
    """A vantage-point tree over a sample, whose leaves are the shards of one half."""

    def __init__(self, sample: np.ndarray, half: tuple[int, int], leaf: int):
        #: (mask, radius, vantage point, border, inner node, outer node); leaves are None
        self.nodes: list[tuple | None] = [None]
        waiting = [(0, sample)]
        while waiting:
            number, points = waiting.pop()
            cut_at = _cut(points, half) if len(points) > leaf else None
            if cut_at is None:
                continue
            mask, _, vantage, border = cut_at
            inner = _distance(points & mask, vantage) <= border
            n = len(self.nodes)
            self.nodes[number] = (*cut_at, n, n + 1)
            self.nodes += [None, None]
            waiting += [(n, points[inner]), (n + 1, points[~inner])]

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, numbers of the points in its shard, whether each is a visitor)."""
        waiting = [(0, np.arange(len(points)), np.zeros(len(points), bool))]
        while waiting:
            number, at, guest = waiting.pop()
            node = self.nodes[number]
            if node is None:
                if len(at):
                    yield number, at, guest
                continue
            mask, radius, vantage, border, inner, outer = node
            d = _distance(points[at] & mask, vantage)
            into = d <= border + radius
            waiting.append((inner, at[into], (guest | (d > border))[into]))
            out_of = np.where(guest, d > border - radius, d > border)
            waiting.append((outer, at[out_of], guest[out_of]))


def _router(regions: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            for h, tree in enumerate(regions.value):
                for leaf, at, guest in tree.route(points):
                    shard = pa.array(np.full(len(at), 2 * leaf + h, np.int64))
                    yield pa.record_batch({"shard": shard, "fp": pa.array(points[at].view(np.int64)), "visitor": pa.array(guest)})

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each shard; rows are sorted by shard, and a shard that goes on in the next batch waits for it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def solved() -> pa.RecordBatch:
        points, visitor = (np.concatenate(x) for x in zip(*held))
        root = link(points, visitor, HALVES[now % 2])
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pa.record_batch({"a": points[moved].view(np.int64), "b": points[root[moved]].view(np.int64)})

    for batch in batches:
        shard, points, visitor = batch["shard"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["visitor"].to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(shard))):
            if shard[a] != now:
                if held:
                    yield solved()
                held, now = [], int(shard[a])
            held.append((points[a:b], visitor[a:b]))
    if held:
        yield solved()


def links(prints: DataFrame, size: int = SHARD) -> DataFrame:
    """(a, b) of a spanning set of links among the distinct fingerprints ``fp``, from shards of about ``size``."""
    total = prints.count()
    sample = bounded_sample(prints.select("fp", F.xxhash64("fp").alias("h")), "h", min(SAMPLE, max(1, total // 8)), "fp").toArrow()["fp"].to_numpy().view(np.uint64)
    leaf = max(16, ceil(len(sample) * size / max(1, total)))
    regions = prints.sparkSession.sparkContext.broadcast([Regions(sample, half, leaf) for half in HALVES])  # SAMPLE / 16 leaves at most
    dealt = prints.select("fp").mapInArrow(_router(regions), "shard long, fp long, visitor boolean")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, component_id, class) of every row.

    th is a hash of the text that tells rows of one id apart, class the smallest fingerprint of the
    component.
    """
    rows = docs.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    prints = cut(with_fingerprint(rows).drop("text"))
    smallest = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(smallest.select("fp")))
    joined = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    joined = cut(joined.join(smallest, "fp"))
    classes = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined.join(classes, "root").select("fp", "root", "component_id")
    known = smallest.join(moved, "fp", "left")
    known = cut(known.select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("class")))
    return prints.join(known, "fp").select("id", "th", "fp", "component_id", "class")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, of its rows any; rows of a component without ids: one of them."""
    i, h, n = fresh(docs, "id", "th", "n")
    found = cut(near_duplicates(docs, id_col, text_col))
    rows = found.groupBy("class", "id", "th").agg(F.count("*").alias("rows"))
    owners = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th", "rows")).alias("k"))
    owners = cut(owners.select(F.col("k.id").alias(i), F.col("k.th").alias(h), F.col("k.rows").alias(n)))
    keyed = docs.withColumn(i, quoted(id_col)).withColumn(h, F.xxhash64(as_text(text_col)))
    on = [keyed[i].eqNullSafe(owners[i]), keyed[h] == owners[h]]
    single = keyed.join(owners.where(quoted(n) == 1), on, "left_semi")
    several = keyed.join(owners.where(quoted(n) > 1), on, "left_semi").dropDuplicates([i, h])
    return single.union(several).select(*map(quoted, docs.columns))
