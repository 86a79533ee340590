"""Collocations against brute force, the index against plain counting, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _words, collocations, queries
from tests.conftest import oracle_rows, rows_of

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower) if (w := re.findall(r"[^\x20\x09]+", piece))]


def brute(rows, least, longest, top, cover=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        count = f[lang]
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= cover * a and p in inside and inside[p]:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), k, count[p[:k]], count[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s, k) for rank, (s, a, p, k, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made(seed, texts=150):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "Ø", "b-c", "x y", "rare%d"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ", ", "!", "\n", ";", "\r\n", "\x0b", "?:"]
    out = []
    for i in range(texts):
        parts = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words)
            parts += [w % rng.randint(0, 500) if "%" in w else w, rng.choice(seps)]
            if rng.random() < 0.1:
                parts += ["New York city hall", rng.choice(seps)]
        out.append((rng.choice(["en", "de", "und", None, ""]), "".join(parts)))
    return [*out, ("en", None), ("en", ""), ("fr", " . "), (None, "New York " * 3000), ("de", "of the " * 1000 + "." * 500 + "x" * 5000), out[0], out[0]]


@pytest.mark.parametrize("shard_words, bits, segment", [(1 << 20, 26, 1 << 18), (200, 16, 300)])
def test_against_brute_force(spark, monkeypatch, shard_words, bits, segment):
    """Also with many small shards, a bitmap full of collisions, and long texts in many parts. Patched values reach the tasks in local functions."""
    rows = made(1)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "f", "rank", "doc_id")}).repartition(5)
    if bits == 26:
        got = collocations.collocations(df, least=8, top=60).collect()
        assert sorted(map(tuple, got)) == brute(rows, 8, 5, 60)
        assert sorted(map(tuple, collocations.collocations(df, least=5, longest=3, top=10_000, cover=80).collect())) == brute(rows, 5, 3, 10_000, 80)
        assert sorted(map(tuple, collocations.collocations(df, least=5, longest=2, top=3).collect())) == brute(rows, 5, 2, 3)
        return
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(_words, "SEGMENT", segment)
    batches = [pa.record_batch({"lang": ["und" if r[0] is None else r[0] for r in rows[a : a + 40]], "text": ["" if r[1] is None else r[1] for r in rows[a : a + 40]]}) for a in range(0, len(rows), 40)]
    assert len(list(collocations.shards(iter(batches)))) > 20
    total, bits_set = Counter(), np.zeros(1 << 10, np.uint64)
    for part in collocations._count_words(iter(batches)):
        total.update({(r["lang"], r["phrase"]): r["f"] for r in part.to_pylist()})
    frequent = [k for k, v in total.items() if v >= 8 and k[1] is not None]
    for lang, word in frequent:
        place = int(collocations._hash(lang, pa.array([word]))[0])
        bits_set[place >> 6] |= np.uint64(1 << (place & 63))
    sent = type("Sent", (), {"value": bits_set})
    index = list(collocations._index(sent, 5)(iter(batches)))
    counted, ranges = Counter(), collocations._ranges(collocations._pairs, 8)
    every = type("Sent", (), {"value": np.full(1 << 10, ~np.uint64(0))})
    for part in [*collocations._named(collocations._pairs, every)(iter(index)), *collocations._named(collocations._longer(every, 5), every)(iter(index))]:
        for r in part.to_pylist():
            counted.update({(r["lang"], p): f for p, f in zip(r["phrases"], r["f"])})
    # sums by hash: a bit is set where the phrases of that hash come to 8
    by_hash = Counter()
    for (lang, phrase), n in counted.items():
        if phrase.count(" ") == 1:
            by_hash[int(collocations._hash(lang, pa.array([phrase]))[0])] += n
    rows_of_ranges = sorted((r for part in ranges(iter(index)) for r in part.to_pylist()), key=lambda r: r["range"])
    (bits_found,) = [r for part in ranges.summed(iter([pa.RecordBatch.from_pylist(rows_of_ranges[i : i + 3], pa.schema([("range", pa.int32()), ("data", pa.binary())])) for i in range(0, len(rows_of_ranges), 3)])) for r in part.to_pylist()]
    assert set(np.flatnonzero(np.unpackbits(np.frombuffer(bits_found["bits"], np.uint8), bitorder="little")).tolist()) == {h for h, n in by_hash.items() if n >= 8}
    plain = Counter()
    for lang, text in rows:
        for words in pieces(text):
            for k in range(2, 6):
                plain.update(("und" if lang is None else lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    wanted = {k: v for k, v in plain.items() if all((k[0], w) in set(frequent) for w in k[1].split(" "))}
    assert {k: v for k, v in counted.items() if k in wanted} == wanted
    assert all(plain[k] == v for k, v in counted.items())


def test_index_intervals():
    """Both intervals of every phrase hold its occurrences, whichever side it grew by."""
    rng = np.random.default_rng(4)
    ids = np.concatenate([[0], *(np.append(rng.integers(1, 5, rng.integers(1, 9)), 0) for _ in range(40))])
    index = collocations.Index(*collocations.Index.transforms(ids, 5))
    plain = Counter()
    for k in range(1, 6):
        plain.update(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
    for turns in ([True] * 4, [False] * 4, [True, False, False, True], [False, True, True, False]):
        f = index.single()
        for k, to_left in enumerate([None, *turns], 1):
            f = f if to_left is None else index.extend(f, to_left)
            assert dict(zip(map(tuple, f.words.tolist()), f.size.tolist())) == {p: c for p, c in plain.items() if len(p) == k}


def test_equals_sql(spark):
    got = rows_of(queries.op13_collocations(spark, LARGER))
    assert got == oracle_rows(queries.OP13_SQL, LARGER) and sum(got[1].values()) > 20


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    big = 9_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7), ("en", None, 3 * big + 11)], "lang string, phrase string, f long")
    original = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *a: counts
        (r,) = collocations.collocations(counts).collect()
    finally:
        collocations.phrase_counts = original
    assert (r.l, r.r, r.score, r["rank"]) == (big, big - 1, 1000 * (big - 7) * (3 * big + 11) // (big * (big - 1)), 1)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0
