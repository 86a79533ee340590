"""Phrase collocation mining with an FM-index per shard over word ids.

A text is lower-cased (A-Z), split at ``.,;:!?`` and 0x0A-0x0D into pieces and those at spaces and tabs into words.
Per language (null: ``und``), n counts all words and f(phrase) all contiguous occurrences within pieces. Candidates are
phrases of 2 to ``LONGEST`` words with a = f(phrase) >= ``LEAST``. A cut into two parts with l and r occurrences
scores floor(1000 * a * n / (l * r)); the lowest cut counts, ties to the one after fewest words. Candidates within a candidate
of one more word that ``COVER`` per cent of their occurrences are part of are dropped (occurrences only fall as phrases grow, so
that no longer one need be asked). Each language's ``TOP`` best are returned, by score, then a, then the phrase.

Passes, each summed across all shards before the next, so that counts are exact:

1. Words are counted.
2. Each task gathers shards of at most ``SHARD_WORDS`` words of one language and indexes them: word ids, broken at the ends
   of pieces and at infrequent words, and the Burrows-Wheeler transforms of the sequence and of its reverse, sorted
   by as many words as phrases have. The index is kept in the checkpoint folder. Extending every word's interval to
   the left counts all pairs.
3. From the same index the intervals of frequent pairs are extended to the right and to the left by turns. Both intervals
   of a phrase are kept in step, so that either side can be extended: the symbols in an interval are its left (right)
   extensions, and how often each occurs is the count of the longer phrase. A phrase is extended only where the pair that it gains is frequent.

What is frequent reaches the tasks as a bitmap of 2**``BITS`` hashes, of one size however many words or pairs
there are. A pair that shares the hash of a frequent one is counted in vain and falls out of the sums. Before the pairs, and
before the longer phrases, are counted by name, each shard sends its counts by hash alone, three bytes a phrase;
only phrases whose hash comes to ``LEAST`` in all shards together can be frequent, and only they are sent by name, packed by ranges of
hashes, which are merged one after another.

Null and empty texts have no words. Repeated rows count each time, a null language as the
language ``und``. Texts of any length are read whole, in pieces. An empty table gives an empty result. Other columns are not
read. Counts and scores are exact as long as the terms of a score have 38 digits at most; a score of more than 64 bits cannot occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import _words
from corpusloom.llm._shared import as_text, cut, quoted
from corpusloom.llm.toxicity import segments

LEAST, LONGEST, TOP, COVER, UNKNOWN = 100, 5, 2000, 100, "und"
SHARD_WORDS, BITS = 1 << 20, 26
#: Hashes of one row of a shard's counts by hash.
RANGE = 16
#: Languages that are broadcast with their word counts, and parts in which a language's best are chosen first.
LANGUAGES, PARTS = 1 << 16, 64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
_COUNTS = "lang string, phrase string, f long"


def words_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of the texts in order, and whether each begins a piece; in parts of bounded size."""
    for data, bounds, first_is_new in _parts(texts):
        data = data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        inside = ~_OUTSIDE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = bounds[1:-1][bounds[1:-1] < len(data)]
        opens[cuts] = inside[cuts]
        start = np.flatnonzero(opens)
        if not len(start):
            continue
        shut = np.append(inside, False)
        shut[:-1] &= ~np.append(inside[1:], False) | np.append(opens[1:], False)
        end = np.flatnonzero(shut) + 1
        breaks = np.cumsum(_BREAK[data])[start]
        text = np.searchsorted(bounds, start, side="right")
        begins = np.ones(len(start), bool)
        begins[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
        begins[0] = first_is_new or breaks[0] > 0
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        yield pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])), begins


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Segments with what the next one of the same text has to know: whether a piece has ended since its last word."""
    new = True
    for data, bounds, _, goes_on in segments(texts):
        yield data, bounds, new
        if not goes_on:
            new = True
            continue
        seen = np.flatnonzero(~_OUTSIDE[data])
        new = bool(_BREAK[data[seen[-1] + 1 :]].any()) if len(seen) else new or bool(_BREAK[data].any())


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, words, begins) of about SHARD_WORDS words each at most, or of one piece where that has more."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> tuple[str, pa.Array, np.ndarray]:
        parts = held.pop(lang)
        size.pop(lang)
        return lang, pa.concat_arrays([w for w, _ in parts]), np.concatenate([b for _, b in parts])

    for batch in batches:
        lang = batch["lang"].dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            for words, begins in words_of(batch["text"].filter(pc.equal(lang.indices, code))):
                if size.get(name, 0) + len(words) > SHARD_WORDS and name in held:
                    # a shard ends where a piece does
                    if begins.any():
                        at = int(begins.argmax())
                        held[name].append((words.slice(0, at), begins[:at]))
                        yield flush(name)
                        words, begins = words.slice(at), begins[at:]
                held.setdefault(name, []).append((words, begins))
                size[name] = size.get(name, 0) + len(words)
            if sum(size.values()) > 2 * SHARD_WORDS:
                yield flush(max(size, key=size.get))
    for name in list(held):
        yield flush(name)


def _hash(lang: str, phrases: pa.Array) -> np.ndarray:
    """The place in the bitmap of each phrase of one language."""
    phrases = phrases.cast(pa.large_string())
    _, offsets, values = phrases.buffers()
    offset = np.frombuffer(offsets, np.int64)[phrases.offset : phrases.offset + len(phrases) + 1]
    data = np.frombuffer(values, np.uint8)[offset[0] : offset[-1]] if values is not None and values.size else np.zeros(0, np.uint8)
    own = np.frombuffer(lang.encode(), np.uint8)
    salt = _words._hash(own, np.array([0]), np.array([len(own)]))[0]
    return (_words.mix(_words._hash(data, offset[:-1] - offset[0], offset[1:] - offset[0]) ^ salt) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch["lang"].dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            yield pa.record_batch({"place": pa.array(np.unique(_hash(name, batch["phrase"].filter(pc.equal(lang.indices, code)))), pa.int64())})


def bitmap(frequent: DataFrame) -> Broadcast:
    """2**BITS bits, those of the frequent phrases set."""
    places = frequent.select("lang", "phrase").mapInArrow(_places, "place long")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))"))
    found = places.groupBy(F.shiftright("place", 6).alias("at")).agg(bits.alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def _ranges(phrases: Callable, least: int) -> Callable:
    """Counts by hash of each shard, a row a range of hashes: places in the range and counts, which need not exceed ``least``."""
    kind = np.uint8 if least < 1 << 8 else np.uint32 if least < 1 << 32 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _opened(batches):
            place, f = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for found, names in phrases(*shard):
                place.append(_hash(shard[0], names))
                f.append(found.size)
            place, at = np.unique(np.concatenate(place), return_inverse=True)
            f = np.minimum(np.bincount(at, np.concatenate(f), len(place)), least).astype(kind)
            cuts = np.searchsorted(place, np.arange((1 << BITS - RANGE) + 1) << RANGE)
            full = np.flatnonzero(np.diff(cuts))
            parts = [(place[a:b] & ((1 << RANGE) - 1)).astype(np.uint16).tobytes() + f[a:b].tobytes() for a, b in zip(cuts[full], cuts[full + 1])]
            yield pa.record_batch({"range": pa.array(full, pa.int32()), "data": pa.array(parts, pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of the hashes that come to ``least``; rows come by range."""
        last, total = None, np.zeros(1 << RANGE, np.int64)
        bits = lambda: pa.record_batch({"range": pa.array([last], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})
        for batch in batches:
            for number, data in zip(batch["range"].to_pylist(), batch["data"]):
                if number != last:
                    if last is not None:
                        yield bits()
                    last, total[:] = number, 0
                data = data.as_py()
                n = len(data) // (2 + np.dtype(kind).itemsize)
                total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, kind, n, 2 * n).astype(np.int64)
        if last is not None:
            yield bits()

    run.summed = summed
    return run


def possible(index: DataFrame, phrases: Callable, least: int) -> Broadcast:
    """A bitmap of the hashes whose phrases occur ``least`` times in all shards together."""
    spark, run = index.sparkSession, _ranges(phrases, least)
    found = _by_range(index.mapInArrow(run, "range int, data binary")).mapInArrow(run.summed, "range int, bits binary").toArrow()
    out = np.zeros((1 << BITS - RANGE, 1 << RANGE - 3), np.uint8)
    for number, bits in zip(found["range"].to_pylist(), found["bits"].to_pylist()):
        out[number] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(out.reshape(-1).view(np.uint64))


def _known(bits: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    place = _hash(lang, phrases)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Frontier(NamedTuple):
    """Phrases of one length: their word ids, and their intervals in both directions, which are of one size."""

    words: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray

    def where(self, chosen: np.ndarray) -> Frontier:
        return Frontier(*(x[chosen] for x in self))


class Side:
    """One direction of the index: the symbol before each suffix in sorted order, with ranks by binary search."""

    def __init__(self, transform: np.ndarray):
        self.transform, self.n = transform.astype(np.int64), len(transform) + 1
        self.sorted = np.sort(self.transform * self.n + np.arange(len(transform)))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First suffix of the symbol followed by the suffixes from ``at``."""
        return np.searchsorted(self.sorted, symbol * self.n + at)

    def extensions(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, symbol, count, count of smaller symbols) for every symbol in the intervals."""
        ends = np.cumsum(size)
        phrase = np.repeat(np.arange(len(low)), size)
        symbol = self.transform[np.arange(len(phrase)) + np.repeat(low - (ends - size), size)]
        key = np.sort(phrase * self.n + symbol)  # there are fewer symbols than suffixes
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        phrase, symbol = np.divmod(key[first], self.n)
        return phrase, symbol, np.diff(np.append(first, len(key))), first - (ends - size)[phrase]


def _transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes sorted by their first ``depth`` symbols, the sequence read as a circle."""
    base = int(ids.max(initial=0)) + 1
    key, top = ids.astype(np.int64), base
    for k in range(1, depth):
        if top > (1 << 62) // base:
            key, top = np.unique(key, return_inverse=True)[1], len(ids)
        key, top = key * base + np.roll(ids, -k), top * base
    return np.roll(ids, 1)[np.argsort(key, kind="stable")]


class Index:
    """A bidirectional FM-index over word ids; 0 is the break between pieces, and first and last."""

    def __init__(self, backward: np.ndarray, forward: np.ndarray):
        self.left, self.right = Side(backward), Side(forward)

    @staticmethod
    def transforms(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        return _transform(ids, depth), _transform(ids[::-1], depth)

    def single(self) -> Frontier:
        """All words but the break."""
        count = np.bincount(self.left.transform, minlength=1)
        low = np.cumsum(count) - count
        symbol = np.flatnonzero(count[1:]) + 1
        return Frontier(symbol[:, None], low[symbol], low[symbol], count[symbol])

    def extend(self, f: Frontier, to_left: bool) -> Frontier:
        """Every phrase with every word that stands before (after) it."""
        own, side = (f.left, self.left) if to_left else (f.right, self.right)
        phrase, symbol, count, smaller = side.extensions(own, f.size)
        kept = symbol > 0
        phrase, symbol, count, smaller = phrase[kept], symbol[kept], count[kept], smaller[kept]
        stepped, other = side.step(symbol, own[phrase]), (f.right if to_left else f.left)[phrase] + smaller
        words = (symbol[:, None], f.words[phrase]) if to_left else (f.words[phrase], symbol[:, None])
        return Frontier(np.concatenate(words, axis=1), *((stepped, other) if to_left else (other, stepped)), count)


def _joined(vocabulary: pa.Array, words: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(vocabulary.take(pa.array(c - 1)) for c in words.T), " ")


def _counts(lang: str, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array([lang]).take(pa.array(np.zeros(len(f), np.int32))), "phrase": phrases.cast(pa.string()), "f": pa.array(f, pa.int64())})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each shard; that of no word is the number of all."""
    for lang, words, _ in shards(batches):
        found = words.value_counts()
        yield _counts(lang, found.field("values"), found.field("counts").to_numpy())
        yield _counts(lang, pa.nulls(1, pa.string()), np.array([len(words)]))


def sequence(words: pa.Array, begins: np.ndarray, is_known: Callable[[pa.Array], np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Vocabulary and word ids from 1 of what can be part of a phrase, with breaks (0) between."""
    coded = words.dictionary_encode()
    kept = is_known(coded.dictionary)
    ids = np.where(kept, np.cumsum(kept), 0)[coded.indices.to_numpy()]
    # a word with no neighbour in its piece is in no phrase
    after = np.append((ids[1:] > 0) & ~begins[1:], False)
    before = np.append(False, after[:-1] & (ids[:-1] > 0))
    used = (ids > 0) & (after | before)
    opens = used & ~before
    out = np.zeros(int(used.sum() + opens.sum()) + 1, np.int64)
    out[(np.cumsum(used) + np.cumsum(opens) - 1)[used]] = ids[used]
    return coded.dictionary.filter(pa.array(kept)), out


def _index(frequent: Broadcast, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, begins in shards(batches):
            vocabulary, ids = sequence(words, begins, lambda w: _known(frequent.value, lang, w))
            kind = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
            both = Index.transforms(ids, depth)
            yield pa.record_batch({"lang": [lang], "vocabulary": pa.array([vocabulary.to_pylist()], pa.list_(pa.string())), "width": pa.array([np.dtype(kind).itemsize], pa.int32())} | {name: pa.array([x.astype(kind).tobytes()], pa.binary()) for name, x in zip(("backward", "forward"), both)})

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Index]]:
    for batch in batches:
        for i in range(batch.num_rows):
            kind = np.uint16 if batch["width"][i].as_py() == 2 else np.uint32
            vocabulary = batch["vocabulary"][i].values
            yield batch["lang"][i].as_py(), vocabulary, Index(*(np.frombuffer(batch[c][i].as_buffer(), kind) for c in ("backward", "forward")))


def _pairs(lang: str, vocabulary: pa.Array, index: Index) -> Iterator[tuple[Frontier, pa.Array]]:
    """All pairs of a shard and their names."""
    found = index.extend(index.single(), to_left=True)
    yield found, _joined(vocabulary, found.words)


def _longer(frequent: Broadcast, longest: int, chosen: Broadcast | None = None) -> Callable:
    """Phrases of three words and more all of whose pairs are frequent, and where given only those in ``chosen``."""

    def run(lang: str, vocabulary: pa.Array, index: Index) -> Iterator[tuple[Frontier, pa.Array]]:
        pairs = index.extend(index.single(), to_left=True)
        pairs = found = pairs.where(_known(frequent.value, lang, _joined(vocabulary, pairs.words)))
        base = len(vocabulary) + 1
        known = np.sort(pairs.words[:, 0] * base + pairs.words[:, 1])
        for length in range(3, longest + 1):
            to_left = length % 2 == 0
            found = index.extend(found, to_left)
            gained = found.words[:, :2] if to_left else found.words[:, -2:]
            key = gained[:, 0] * base + gained[:, 1]
            place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            found = found.where(known[place] == key if len(known) else np.zeros(len(key), bool))
            names = _joined(vocabulary, found.words)
            if chosen is not None:  # parts of a frequent phrase are frequent
                held = _known(chosen.value, lang, names)
                found, names = found.where(held), names.filter(pa.array(held))
            yield found, names

    return run


_BY_RANGE = "range int, lang string, phrases array<string>, f array<long>"


def _named(phrases: Callable, chosen: Broadcast) -> Callable:
    """Counts by name of each shard's chosen phrases, a row a range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _opened(batches):
            names, f = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for found, own in phrases(*shard):
                held = _known(chosen.value, shard[0], own)
                names.append(own.filter(pa.array(held)).cast(pa.string()))
                f.append(found.size[held])
            names, f = pa.concat_arrays(names), np.concatenate(f)
            part = _hash(shard[0], names) >> RANGE
            order = np.argsort(part, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(part[order]) != 0))[: len(order)], len(order)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x.take(pa.array(order))) for x in (names, pa.array(f, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(part[order[cuts[:-1]]], pa.int32()), pa.array([shard[0]] * (len(cuts) - 1), pa.string()), *lists], names=["range", "lang", "phrases", "f"])

    return run


def _merged(least: int) -> Callable:
    """The sums of all shards that come to ``least``; rows come by range, and a range's phrases are held until the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for lang, own in total.items():
                kept = {p: n for p, n in own.items() if n >= least}
                yield _counts(lang, pa.array(list(kept), pa.string()), np.array(list(kept.values()), np.int64))

        for batch in batches:
            for number, lang, names, f in zip(*(batch[c] for c in ("range", "lang", "phrases", "f"))):
                if number.as_py() != last:
                    yield from done()
                    last, total = number.as_py(), {}
                own = total.setdefault(lang.as_py(), {})
                for name, n in zip(names.as_py(), f.as_py()):
                    own[name] = own.get(name, 0) + n
        yield from done()

    return run


def _by_range(parts: DataFrame) -> DataFrame:
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range")


def counted(index: DataFrame, phrases: Callable, chosen: Broadcast, least: int) -> DataFrame:
    """(lang, phrase, f) of the chosen phrases that occur ``least`` times in all shards together."""
    return cut(_by_range(index.mapInArrow(_named(phrases, chosen), _BY_RANGE)).mapInArrow(_merged(least), _COUNTS))


def _summed(parts: DataFrame, least: int) -> DataFrame:
    return cut(parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()))


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times; the null phrase is the number of words."""
    texts = df.select(F.coalesce(quoted(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), as_text(text_col).alias("text"))
    words = _summed(texts.mapInArrow(_count_words, _COUNTS), least)
    if longest < 2:
        return words
    frequent = bitmap(words.where(F.col("phrase").isNotNull()))
    index = cut(texts.mapInArrow(_index(frequent, longest), "lang string, vocabulary array<string>, width int, backward binary, forward binary"))
    pairs = counted(index, _pairs, possible(index, _pairs, least), least)
    if longest < 3:
        return words.union(pairs)
    frequent = bitmap(pairs)
    chosen = possible(index, _longer(frequent, longest), least)
    longer = counted(index, _longer(frequent, longest, chosen), chosen, least)
    return words.union(pairs).union(longer)


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut) of each language's best phrases."""
    counts = phrase_counts(df, text_col, lang_col, least, longest)
    phrases = counts.where(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    found = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.size(words).alias("k")).where(F.col("k") > 1)
    inner = found.where(F.col("k") > 2).select("lang", "a", F.explode(F.array(_part(F.col("w"), 2, F.col("k") - 1), _part(F.col("w"), 1, F.col("k") - 1))).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("w"), 1, F.col("cut")).alias("first"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    totals = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    totals = F.broadcast(totals) if totals.limit(LANGUAGES + 1).count() <= LANGUAGES else totals
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumns({"over": (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")})
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the best of each part first, so that no language's candidates meet in one task
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
