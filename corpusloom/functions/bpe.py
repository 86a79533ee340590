"""Byte-pair encoding: counts of pieces, training, and a tokenizer that is saved, loaded, and encodes with special tokens.

Training takes the pair with the highest count each time, ties to the larger pair, as a plain loop over all words would;
the result is the same whatever the partitions. The distinct pieces with their counts stay packed in the tasks that hold them.

The driver knows the exact counts of all pairs above a floor (at most ``KNOWN``). Counts only fall, but for pairs with a
new token; and wherever the new token meets a neighbour, its last or first part met it before, so that such a pair is no more
frequent than the one it came from. A pair that is not above the floor is thus never merged, in part or in whole, until the highest comes down to the floor. So
the pieces are cut between the two tokens of such pairs, and equal segments are added up; as the floor rises with the table,
they are few where the pieces are many. Merges above the floor are found in the segments alone, and change them as they
change the pieces. Segments of at most ``HELD`` tokens in all are merged on the driver. More are left in tasks, where a round is one job:

- The driver predicts the next merges from the exact counts; how a merge changes the counts of the pairs beside it
  is estimated from ``SAMPLE`` of the commonest segments.
- Each task applies the predicted merges to its own segments, finding the places of a pair by an inverted index and
  bringing only them up to date, and sends what every merge changes in the counts. These changes are summed.
- With the exact changes the driver checks the prediction step by step: merges are accepted up to the first that is not
  the highest pair. The first always is, and most rounds accept tens of them.

When the highest comes down to the floor, the merges are applied to the pieces and their pairs counted anew. The driver holds the merges,
the segments or the sample, the pairs above the floor, and of a round's changes at most ``BATCH`` times twice the vocabulary.
"""

from __future__ import annotations

import copy
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import cut

#: Runs of white space and of other characters; white space is the six ASCII characters in both engines and in Python.
PATTERN = "[ \\t\\n\\x0B\\f\\r]+|[^ \\t\\n\\x0B\\f\\r]+"
KNOWN, SAMPLE, BATCH, GROUP, PENDING = 20_000, 20_000, 96, 1 << 16, 64
#: The floor is the highest count divided by DEPTH, or higher; tokens of all segments that the driver takes.
DEPTH, HELD = 16, 1 << 22
#: Entries of a task's table of pieces or segments before it is sent, and of its memory of coded ones; characters or tokens of texts that are coded at once.
TABLE, MEMO, AT_ONCE = 1 << 18, 1 << 18, 1 << 20
#: A space beside other white space. Where a text has none, each space of it is a piece of PATTERN.
_BESIDE = [*(" " + c for c in " \t\n\x0b\f\r"), *(c + " " for c in "\t\n\x0b\f\r")]
_MERGES = "rank int, a int, b int, id int"


def pieces(text: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


class _Splitter:
    """Texts as chunks of whole pieces. With PATTERN most texts are cut at their spaces, much faster than by an expression."""

    def __init__(self, pattern: str):
        found = re.compile(pattern)
        self.split = (lambda text: [m[0] for m in found.finditer(text)]) if found.groups else found.findall
        self.plain = pattern == PATTERN

    def chunks(self, text: str) -> tuple[list[str], bool]:
        """Chunks, and whether there is a piece of a space between any two of them."""
        if self.plain and not any(pair in text for pair in _BESIDE):
            return text.split(" "), True
        return self.split(text), False

    def pieces(self, chunk: str) -> list[str]:
        return self.split(chunk) if self.plain and chunk.split() != [chunk] else [chunk]


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about AT_ONCE in all each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield slice(at, to)
        at = to


def _texts(texts: pa.Array) -> Iterator[list[str | None]]:
    for part in _portions(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
        yield texts[part].to_pylist()


def _counted(pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, table, spaces = _Splitter(pattern), Counter(), 0

        def send() -> pa.RecordBatch:
            out, more = {}, Counter({" ": spaces} if spaces else {})
            for chunk, n in table.items():
                found = splitter.pieces(chunk)
                if found == [chunk]:
                    out[chunk] = n
                else:
                    more.update({p: m * n for p, m in Counter(found).items()})
            for piece, n in more.items():
                out[piece] = out.get(piece, 0) + n
            return pa.record_batch({"piece": pa.array(out.keys(), pa.string()), "n": pa.array(out.values(), pa.int64())})

        for batch in batches:
            for texts in _texts(batch.column(0)):
                for text in texts:
                    if text:
                        chunks, spaced = splitter.chunks(text)
                        table.update(chunks)
                        spaces += (len(chunks) - 1) * spaced
                if len(table) >= TABLE:
                    yield send()
                    table, spaces = Counter(), 0
        yield send()

    return run


def word_counts(df: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """(piece, n); the only step that reads the texts. A task adds up its own pieces before they are sent."""
    return df.select(df.columns[0]).mapInArrow(_counted(pattern), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def byte_words(counts: DataFrame) -> DataFrame:
    """(ids, n): pieces as arrays of byte values."""
    digits = F.hex(F.encode("piece", "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length("piece") - 1)
    return counts.where("piece <> ''").select(F.transform(at, lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")).alias("ids"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(F.element_at("ids", i).alias("a"), F.element_at("ids", i + 1).alias("b")))
    return words.where(F.size("ids") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


class Pieces:
    """Some pieces as one sequence of tokens with links, so that a merge touches only the places where it applies."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        n = len(ids)
        self.ids, self.counts = ids.astype(np.int64), np.repeat(counts.astype(np.int64), lengths)
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        self.after[ends[lengths > 0] - 1] = -1
        self.before[(ends - lengths)[lengths > 0]] = -1
        self.piece_counts = counts.astype(np.int64)
        self.places: dict[int, list[np.ndarray]] = {}

    def copy(self) -> Pieces:
        out = copy.copy(self)
        out.ids, out.after, out.before, out.places = self.ids.copy(), self.after.copy(), self.before.copy(), {}
        return out

    @staticmethod
    def key(a, b):
        return a << 32 | b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all pairs."""
        at = np.flatnonzero(self.after >= 0)
        key, place = np.unique(self.key(self.ids[at], self.ids[self.after[at]]), return_inverse=True)
        return key, np.bincount(place, self.counts[at], len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)

    def index(self, wanted: np.ndarray) -> None:
        """Find the places of the pairs that are about to be merged."""
        at = np.flatnonzero(self.after >= 0)
        key = self.key(self.ids[at], self.ids[self.after[at]])
        chosen = np.isin(key, wanted)
        at, key = at[chosen], key[chosen]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        self.places = {int(key[c]): [p] for c, p in zip(cuts, np.split(at, cuts[1:]))}

    def merge(self, a: int, b: int, new: int, wanted: set[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Merge a pair wherever it is; keys of pairs and the changes of their counts. Places of new pairs in ``wanted`` (None: all) are kept."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = self.places.pop(self.key(a, b), None)
        if held is None:
            return none
        p = np.unique(np.concatenate(held))
        p = p[(self.ids[p] == a) & (self.after[p] >= 0)]
        p = p[self.ids[self.after[p]] == b]
        if a == b:  # of a run, every second from its left
            taken, last = [], -1
            for x in p.tolist():
                if x != last:
                    taken.append(x)
                    last = self.after[x]
            p = np.array(taken, np.int64)
        if not len(p):
            return none
        q = self.after[p]
        left, right, w = self.before[p], self.after[q], self.counts[p]
        merged = np.zeros(len(self.ids), bool) if len(p) > 1000 else None
        if merged is None:
            right_merged, left_merged = np.isin(right, p), np.isin(left, q)
        else:
            merged[p] = True
            right_merged = merged[right] & (right >= 0)
            merged[p], merged[q] = False, True
            left_merged = merged[left] & (left >= 0)
        has_right, has_left = right >= 0, (left >= 0) & ~left_merged
        changes = [
            (np.full(len(p), self.key(a, b)), -w),
            (self.key(b, self.ids[right[has_right]]), -w[has_right]),
            (self.key(self.ids[left[has_left]], a), -w[has_left]),
            (self.key(np.int64(new), np.where(right_merged, new, self.ids[right])[has_right]), w[has_right]),
            (self.key(self.ids[left[has_left]], np.int64(new)), w[has_left]),
        ]
        self.ids[p], self.ids[q] = new, -1
        self.after[p] = right
        self.before[right[has_right]] = p[has_right]
        for (key, _), at in ((changes[3], p[has_right]), (changes[4], left[has_left])):
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, int)
            for k, found in zip(key[order][cuts].tolist(), np.split(at[order], cuts[1:])):
                if wanted is None or k in wanted:
                    self.places.setdefault(k, []).append(found)
        key, place = np.unique(np.concatenate([k for k, _ in changes]), return_inverse=True)
        change = np.bincount(place, np.concatenate([c for _, c in changes]), len(key)).astype(np.int64)
        return key[change != 0], change[change != 0]

    def apply(self, merges: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        wanted = {self.key(a, b) for a, b, _ in merges}
        self.index(np.array(sorted(wanted), np.int64))
        return [self.merge(*m, wanted) for m in merges]

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left, as (ids, lengths, counts); pieces of a single token are in no pair and left out."""
        live = self.ids >= 0
        lengths = np.bincount(self.of[live], minlength=len(self.piece_counts))
        kept = lengths > 1
        return self.ids[live & kept[self.of]], lengths[kept], self.piece_counts[kept]


def _row(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({name: pa.array([x.astype(kind).tobytes()], pa.binary()) for name, x, kind in (("ids", ids, np.int32), ("lengths", lengths, np.int32), ("counts", counts, np.int64))})


_PACKED, _CHANGES = "ids binary, lengths binary, counts binary", "step int, pair long, n long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most GROUP pieces each."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            data = [p.encode() for p in part["piece"].to_pylist()]
            yield _row(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]), part["n"].to_numpy())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in batches:
        for ids, lengths, counts in zip(*(batch[c] for c in ("ids", "lengths", "counts"))):
            yield Pieces(*(np.frombuffer(x.as_py(), kind) for x, kind in ((ids, np.int32), (lengths, np.int32), (counts, np.int64))))


def _changed(done: list[tuple[int, int, int]], tried: list[tuple[int, int, int]]) -> Callable:
    """Changes of the pairs' counts at each of the merges tried, after those done; with none tried, all counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            held.apply(done)
            for step, (key, n) in enumerate(held.apply(tried) if tried else [held.pairs()]):
                yield pa.record_batch({"step": pa.array(np.full(len(key), step, np.int32)), "pair": pa.array(key), "n": pa.array(n)})

    return run


def _segments(kept: np.ndarray) -> Callable:
    """(ids, n): what is left of the pieces between pairs that are not ``kept``, if it is longer than a token."""
    a, b = kept >> 32, kept & 0xFFFFFFFF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        send = lambda: pa.record_batch({"ids": pa.array(table.keys(), pa.binary()), "n": pa.array(table.values(), pa.int64())})
        for batch in batches:
            for row in zip(*(batch[c] for c in ("ids", "lengths", "counts"))):
                ids, lengths, counts = (np.frombuffer(x.as_py(), kind) for x, kind in zip(row, (np.int32, np.int32, np.int64)))
                if not len(ids):
                    continue
                wide = int(max(ids.max(), a.max(initial=0), b.max(initial=0))) + 1
                joined = np.isin(ids[:-1].astype(np.int64) * wide + ids[1:], a * wide + b)
                ends = np.cumsum(lengths, dtype=np.int64)
                joined[ends[:-1] - 1] = False
                begins = np.flatnonzero(np.append(True, ~joined))
                stops = np.append(begins[1:], len(ids))
                longer = stops - begins > 1
                begins, stops = begins[longer], stops[longer]
                data = ids.tobytes()
                for i, j, n in zip((4 * begins).tolist(), (4 * stops).tolist(), counts[np.searchsorted(ends, begins, "right")].tolist()):
                    segment = data[i:j]
                    table[segment] = table.get(segment, 0) + n
                if len(table) >= TABLE:
                    yield send()
                    table.clear()
        yield send()

    return run


def _pack_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _pack does, of (ids, n)."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield _row(*_flat(batch.slice(at, GROUP)))


def _flat(segments: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = segments["ids"].to_pylist()
    return np.frombuffer(b"".join(data), np.int32), np.array([len(d) // 4 for d in data], int), segments["n"].to_numpy()


def _applied(done: list[tuple[int, int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            held.apply(done)
            yield _row(*held.packed())

    return run


class _Known:
    """Counts of pairs with the highest at hand: by count, then by pair."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.heap = [(-n, -k) for k, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int] | None:
        while self.heap:
            n, k = -self.heap[0][0], -self.heap[0][1]
            if n > 0 and self.counts.get(k) == n:
                return k, n
            heapq.heappop(self.heap)
        return None

    def change(self, key: int, by: float, create: bool) -> None:
        """A pair that is not known is below the floor, unless it has the new token."""
        if key in self.counts or create:
            self.counts[key] = now = self.counts.get(key, 0) + by
            heapq.heappush(self.heap, (-now, -key))


def _predicted(known: _Known, sample: Pieces, first: int, most: int, floor: int) -> list[tuple[int, int, int]]:
    """The next merges, by exact counts where they are known and by what they do to the sample elsewhere."""
    guess, out, seen = _Known(known.counts), [], dict(zip(*(x.tolist() for x in sample.pairs())))
    ids = first
    sample.index(np.array(sorted(guess.counts), np.int64))
    while len(out) < most and (best := guess.best()) is not None and best[1] > floor:
        key, n = best
        a, b = key >> 32, key & 0xFFFFFFFF
        out.append((a, b, ids))
        changed, by = sample.merge(a, b, ids, None)
        share = n / seen[key] if seen.get(key) else 0
        guess.counts.pop(key)
        for k, d in zip(changed.tolist(), by.tolist()):
            seen[k] = seen.get(k, 0) + d
            if k != key:
                fresh = (k >> 32) == ids or (k & 0xFFFFFFFF) == ids
                guess.change(k, d * share if fresh or share else d, fresh)
        if not share:
            break  # the sample says nothing about what follows
        ids += 1
    return out


def train(counts: DataFrame, merges: int) -> DataFrame:
    """(rank, a, b, id) of the first merges, at most ``merges`` and no more than there are pairs.

    ``counts``: piece, n. Null and empty pieces count for nothing; repeated pieces are added up. Without any piece of two bytes
    the result is empty.
    """
    spark = counts.sparkSession
    whole = counts.where("piece IS NOT NULL AND piece <> ''").groupBy("piece").agg(F.sum("n").alias("n")).where(F.octet_length("piece") > 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # held for all rounds, so not left to be coalesced
    packed = cut(whole.repartition(parts, "piece").mapInArrow(_pack, _PACKED))
    found: list[tuple[int, int, int]] = []
    pending: list[tuple[int, int, int]] = []
    while len(found) < merges:
        packed = cut(packed.mapInArrow(_applied(pending), _PACKED)) if pending else packed
        pairs = packed.mapInArrow(_changed([], []), _CHANGES).groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.where("n > 0").orderBy(F.desc("n"), F.desc("pair")).limit(KNOWN + 1).toArrow()
        pair, n = top["pair"].to_numpy(), top["n"].to_numpy()
        if not len(n):
            break
        # pairs with as many occurrences as the last row are not all there
        floor = max(int(n[-1]) if len(n) > KNOWN else 0, int(n[0]) // DEPTH)
        if floor == n[0]:  # the first of more pairs than are known
            pending = [(int(pair[0]) >> 32, int(pair[0]) & 0xFFFFFFFF, 256 + len(found))]
        else:
            known = _Known({k: c for k, c in zip(pair.tolist(), n.tolist()) if c > floor})
            segments = cut(packed.mapInArrow(_segments(pair[n > floor]), "ids binary, n long").groupBy("ids").agg(F.sum("n").alias("n")))
            tokens = segments.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
            pending = (_held_merges if tokens <= HELD else _spread_merges)(segments, known, floor, 256 + len(found), merges - len(found))
        found += pending
    return spark.createDataFrame([(k, a, b, new) for k, (a, b, new) in enumerate(found)], _MERGES)


def _held_merges(segments: DataFrame, known: _Known, floor: int, first: int, most: int) -> list[tuple[int, int, int]]:
    """The merges of counts above the floor, at most ``most``, of segments that the driver holds."""
    held, out = Pieces(*_flat(segments.toArrow())), []
    held.index(np.array(sorted(known.counts), np.int64))
    while len(out) < most and (best := known.best()) is not None and best[1] > floor:
        a, b, new = best[0] >> 32, best[0] & 0xFFFFFFFF, first + len(out)
        for k, d in zip(*(x.tolist() for x in held.merge(a, b, new, None))):
            known.change(k, d, (k >> 32) == new or (k & 0xFFFFFFFF) == new)
        known.counts.pop(best[0])
        out.append((a, b, new))
    return out


def _spread_merges(segments: DataFrame, known: _Known, floor: int, first: int, most: int) -> list[tuple[int, int, int]]:
    """The same of segments that stay in tasks, in rounds of a prediction and a job."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cut(segments.repartition(parts, "ids").mapInArrow(_pack_segments, _PACKED))
    sample = Pieces(*_flat(segments.orderBy(F.desc("n"), "ids").limit(SAMPLE).toArrow()))
    found: list[tuple[int, int, int]] = []
    pending: list[tuple[int, int, int]] = []
    size = 16
    while len(found) < most and (best := known.best()) is not None and best[1] > floor:
        tried = _predicted(known, sample.copy(), first + len(found), min(size, most - len(found)), floor)
        changes = packed.mapInArrow(_changed(pending, tried), _CHANGES).groupBy("step", "pair").agg(F.sum("n").alias("n")).toArrow()
        step = changes["step"].to_numpy()
        order = np.argsort(step, kind="stable")
        ends = np.searchsorted(step[order], np.arange(len(tried) + 1))
        pair, change = changes["pair"].to_numpy()[order], changes["n"].to_numpy()[order]
        accepted = []
        for i, (a, b, new) in enumerate(tried):
            best = known.best()
            if best is None or best[1] <= floor or best[0] != Pieces.key(a, b):
                break
            for k, d in zip(pair[ends[i] : ends[i + 1]].tolist(), change[ends[i] : ends[i + 1]].tolist()):
                known.change(k, d, (k >> 32) == new or (k & 0xFFFFFFFF) == new)
            known.counts.pop(Pieces.key(a, b), None)
            accepted.append((a, b, new))
        sample.apply(accepted)
        # what is not above the floor does not come back
        known = _Known({k: n for k, n in known.counts.items() if n > floor})
        found, pending = found + accepted, pending + accepted
        size = min(BATCH, 2 * max(4, len(accepted)))
        if len(pending) >= PENDING:
            packed, pending = cut(packed.mapInArrow(_applied(pending), _PACKED)), []
    return found


def merged(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """The merge of lowest rank first, from left to right, as long as there is one; n log n in the length."""
    n = len(ids)
    ids, after, before = [*ids], [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        new, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or ranks.get((ids[i], ids[j])) != new:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (rank := ranks.get((ids[left], ids[after[left]]))) is not None:
                heapq.heappush(heap, (rank, left))
    return [t for t in ids if t >= 0]


class _Segments(dict):
    """Bytes with their ids as packed numbers; what is not there is merged. Long ones are not kept."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        self.ranks = ranks

    def __missing__(self, segment: bytes) -> bytes:
        coded = array("i", merged(list(segment), self.ranks)).tobytes()
        if len(segment) <= 256:
            if len(self) >= MEMO:
                self.clear()
            self[segment] = coded
        return coded


class _Coder:
    """Ids of texts as packed numbers. What chunks become is remembered; those not seen before are cut between
    bytes that no merge joins, into segments that are seen far more often."""

    def __init__(self, merges: list[tuple[int, int]], vocabulary: dict[int, bytes], pattern: str):
        self.splitter, self.memo, self.segments = _Splitter(pattern), {}, _Segments({pair: 256 + i for i, pair in enumerate(merges)})
        self.joined = np.zeros(1 << 16, bool)
        self.joined[[vocabulary[a][-1] << 8 | vocabulary[b][0] for a, b in merges]] = True
        self.space = array("i", [32]).tobytes()  # a piece of a single byte

    def learn(self, chunks: list[str]) -> None:
        split = list(map(self.splitter.pieces, chunks))
        pieces = [p.encode() for found in split for p in found]
        data, ends = b"".join(pieces), np.cumsum([0, *map(len, pieces)])
        byte = np.frombuffer(data, np.uint8).astype(np.int64)
        begins = np.append(True, ~self.joined[byte[:-1] << 8 | byte[1:]])[: len(byte)]
        begins[ends[ends < len(byte)]] = True
        at = np.flatnonzero(begins)
        coded = list(map(self.segments.__getitem__, map(data.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(data)]))))
        cuts = np.searchsorted(at, ends[np.cumsum([0, *map(len, split)])]).tolist()
        self.memo.update(zip(chunks, [b"".join(coded[i:j]) for i, j in zip(cuts, cuts[1:])]))

    def code(self, texts: list[str]) -> list[bytes]:
        """The texts should be few, as all their chunks are held at once."""
        split = list(map(self.splitter.chunks, texts))
        chunks = set().union(*(found for found, _ in split))
        missing = chunks.difference(self.memo)
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = chunks
        if missing:
            self.learn(list(missing))
        out = [(self.space if spaced else b"").join(map(self.memo.__getitem__, found)) for found, spaced in split]
        for chunk in missing:
            if len(chunk) > 256:
                del self.memo[chunk]
        return out


class Trie:
    """Finds given strings in a text: the leftmost, of those that begin at one place the first given."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for i, word in enumerate(words):
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node.setdefault("", i)
        self.words = words
        begins = "".join(re.escape(c) for c in self.root if c)
        self.next = re.compile(f"[{begins}]").search if begins else lambda text, at: None

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(what is between, None) and (word, its number) in order; empty parts are left out."""
        begin = at = 0
        while place := self.next(text, at):
            at = place.start()
            node, found = self.root, None
            for c in range(at, len(text)):
                node = node.get(text[c])
                if node is None:
                    break
                if "" in node and (found is None or node[""] < found):
                    found = node[""]
            if found is None or not self.words[found]:
                at += 1
                continue
            if begin < at:
                yield text[begin:at], None
            yield self.words[found], found
            begin = at = at + len(self.words[found])
        if begin < len(text):
            yield text[begin:], None


class Tokenizer:
    """A vocabulary of 256 bytes, one token a merge, and special tokens with the numbers after them."""

    def __init__(self, merges: list[tuple[int, int]], specials: list[str] | None = None, pattern: str = PATTERN):
        self.merges, self.pattern = [tuple(m) for m in merges], pattern
        self.vocabulary = {i: bytes([i]) for i in range(256)}
        for i, (a, b) in enumerate(self.merges):
            self.vocabulary[256 + i] = self.vocabulary[a] + self.vocabulary[b]
        self.specials = {t: len(self.vocabulary) + i for i, t in enumerate(dict.fromkeys(specials or []))}

    @classmethod
    def trained(cls, merges: DataFrame, specials: list[str] | None = None, pattern: str = PATTERN) -> Tokenizer:
        """From ``train``'s result, which is as long as the vocabulary asked for."""
        return cls([(r.a, r.b) for r in merges.orderBy("rank").collect()], specials, pattern)

    def save(self, spark: SparkSession, path: str) -> None:
        """Four text tables under ``path``: vocabulary (id, hexadecimal bytes), merges, special tokens and configuration."""
        parts = {
            "vocabulary": [json.dumps({"id": i, "bytes": b.hex()}) for i, b in self.vocabulary.items()],
            "merges": [json.dumps({"rank": i, "a": a, "b": b}) for i, (a, b) in enumerate(self.merges)],
            "special_tokens": [json.dumps({"id": i, "token": t}) for t, i in self.specials.items()],
            "configuration": [json.dumps({"pattern": self.pattern})],
        }
        for name, lines in parts.items():
            spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        """A saved tokenizer; a vocabulary that does not follow from the merges is an error."""
        read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
        merges = [(r.a, r.b) for r in read("merges", "rank int, a int, b int").orderBy("rank").collect()]
        specials = [r.token for r in read("special_tokens", "id int, token string").orderBy("id").collect()]
        out = cls(merges, specials, read("configuration", "pattern string").first().pattern)
        if {r.id: r.bytes for r in read("vocabulary", "id int, bytes string").collect()} != {i: b.hex() for i, b in out.vocabulary.items()}:
            raise ValueError(f"the vocabulary in {path} is not that of its merges")
        return out

    def encode(self, df: DataFrame, text_col: str, out_col: str, specials: bool = False) -> DataFrame:
        """Token ids of each text (null: none). With ``specials`` the special tokens are cut out before anything is merged;
        else they are text like any other."""
        merges, vocabulary, numbers, pattern, words = self.merges, self.vocabulary, list(self.specials.values()), self.pattern, list(self.specials) if specials else []

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            coder, tree = _Coder(merges, vocabulary, pattern), Trie(words) if words else None
            special = [array("i", [n]).tobytes() for n in numbers]
            for batch in batches:
                for texts in _texts(batch):  # results go out in parts, so that a batch of long texts is never held as ids
                    parts = [list(tree.split(text or "")) if tree else [(text or "", None)] for text in texts]
                    plain = iter(coder.code([part for found in parts for part, word in found if word is None]))
                    ids = [b"".join([next(plain) if word is None else special[word] for _, word in found]) for found in parts]
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))

        return df.withColumn(out_col, run(text_col))

    def decode(self, df: DataFrame, ids_col: str, out_col: str) -> DataFrame:
        """The text of token ids; ids that no token has are left out, bytes that are no UTF-8 become replacement characters."""
        known = self.vocabulary | {i: t.encode() for t, i in self.specials.items()}
        tokens = [known[i] for i in range(len(known))]

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = pa.array([*tokens, b""], pa.large_binary())
            for batch in batches:
                lengths = batch.value_lengths().fill_null(0).to_numpy()
                for part in _portions(lengths):
                    ids = batch[part].flatten().fill_null(-1).to_numpy()
                    _, offsets, data = (coded := table.take(pa.array(np.where((ids >= 0) & (ids < len(tokens)), ids, len(tokens))))).buffers()
                    starts = np.frombuffer(offsets, np.int64, len(coded) + 1)[np.cumsum([0, *lengths[part]])].tolist()
                    view = memoryview(data or b"")
                    yield pa.array([str(view[i:j], errors="replace") if valid else None for i, j, valid in zip(starts, starts[1:], batch[part].is_valid().to_pylist())], pa.string())

        return df.withColumn(out_col, run(ids_col))
