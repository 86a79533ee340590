"""SimHash components, exact top-k and line deduplication against plain Python over all rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpusloom.llm import line_dedup, queries, simhash, topk
from tests.conftest import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint) pairs -> id to the smallest id reachable."""
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, (name, _) in enumerate(prints):
        members[top(i)].append(name)
    return {name: min(m) for m in members.values() for name in m}


def test_simhash_query(spark):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = brute_components(docs)
    got = queries.op7_simhash(spark, SF).collect()
    assert len(got) == len(docs)
    prints = dict(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == expected[r.doc_id]


def made_points(n, steps=6):
    rng = np.random.default_rng(3)
    points = [int(c) for c in rng.integers(0, 1 << 63, 40, np.uint64)]
    for _ in range(n):
        p = points[int(rng.integers(len(points)))]
        for b in rng.choice(64, int(rng.integers(1, steps)), replace=False):
            p ^= 1 << int(b)
        points.append(p)
    return np.unique(np.array(points, np.uint64))


def test_vantage_tree_finds_every_link():
    points, work = made_points(2500), simhash.Work()
    found = simhash.link(points, work=work)
    expected = brute_components(list(enumerate(points.tolist())))
    assert {i: int(r) for i, r in enumerate(found)} == expected
    assert work.nodes > 100 and work.pairs < len(points) ** 2 / 2


def test_vantage_trees_do_less_than_all_pairs():
    points = np.unique(np.random.default_rng(8).integers(0, 1 << 64, 6000, np.uint64))
    for half in simhash.HALVES:
        work = simhash.Work()
        simhash.link(points, half=half, work=work)
        assert work.nodes > 100 and work.pairs < len(points) ** 2 / 15


@pytest.mark.parametrize("size", [40, 400])
def test_regions_with_visitors_find_every_link(spark, size):
    random_ones = np.random.default_rng(9).integers(0, 1 << 64, 2000, np.uint64)
    same_half = made_points(600) & np.uint64(0xFFFFFFFF)  # one half tells nothing apart
    points = np.unique(np.concatenate([made_points(1500, 4), random_ones, random_ones ^ np.uint64(1 << 9 | 1 << 40 | 1 << 50), same_half]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(5)
    pairs = [(r.a, r.b) for r in simhash.links(df, size).collect()]
    number = {int(p): i for i, p in enumerate(points.view(np.int64))}
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        i, j = sorted((top(number[a]), top(number[b])))
        root[j] = i
    expected = brute_components(list(enumerate(points.tolist())))
    classes = defaultdict(set)
    for i in range(len(points)):
        classes[top(i)].add(i)
    wanted = defaultdict(set)
    for i, r in expected.items():
        wanted[r].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "Alpha beta gamma delta"), (4, "alpha BETA gamma delta"), (None, "alpha beta gamma delta"), (5, "one two"), (5, "one two"), (6, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS fp", "1 AS id", "2 AS component_id")
    got = {(r.id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (5, 5), (6, 6)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert simhash.keep_one(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op3_html_extract", "op8_topk"])
def test_queries_with_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == oracle_rows(queries.oracle_sql()[name], SF)


def test_maxscore_is_exact():
    rng = np.random.default_rng(1)
    for size in (3, 700, 2600):
        vectors = rng.integers(-40, 40, (size, 12)) * (rng.random((1, 12)) < 0.7)
        vectors[:, 10:] *= rng.random((size, 2)) < 0.2  # sparse postings
        ids = rng.permutation(size)
        asked = vectors[:5]
        best = topk.Best(len(asked), 10)
        topk.maxscore(ids[:5], asked, ids, vectors, best, topk.Work())
        for q in range(min(5, size)):
            every = sorted((-int(v @ asked[q]), int(i)) for i, v in zip(ids, vectors) if i != ids[q])[:10]
            assert [(-int(s), int(i)) for s, i in zip(best.score[q], best.ids[q][: best.held[q]])] == every


def test_maxscore_leaves_terms_and_vectors_out(spark):
    vectors = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    vectors, ids = np.floor(vectors * 1024).astype(np.int64), np.arange(len(vectors))
    first, work = topk.Best(20, 10), topk.Work()
    topk.maxscore(ids[::100], vectors[::100], ids[:1024], vectors[:1024], first, topk.Work())
    best = topk.Best(20, 10, first.least)
    topk.maxscore(ids[::100], vectors[::100], ids, vectors, best, work)
    # most pairs never get a score, and many terms of those that fail are never probed
    assert work.scored < work.pairs / 20 and work.products < 0.7 * work.every
    score = vectors[::100] @ vectors.T
    score[np.arange(20), ids[::100]] = -(1 << 60)
    assert all(best.ids[q].tolist() == np.lexsort((ids, -score[q]))[:10].tolist() for q in range(20))
    # a sparse term in which no other vector is high rules all of them out
    far = np.zeros((500, 4), np.int64)
    far[np.arange(500), np.arange(500) % 2] = 5
    far[-1], work, best = [0, 0, 9, 9], topk.Work(), topk.Best(1, 2, np.array([50.0]))
    topk.maxscore(np.array([-1]), np.array([[1, 1, 9, 9]]), np.arange(500), far, best, work)
    assert best.held[0] == 1 and work.products < 20


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS shard")
    got = [tuple(r) for r in topk.top_k(df, df.vec_id % 100 == 0).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 1, 5 * one), (0, 2, 1, 5 * one), (0, 3, 7, 0), (0, 4, 100, -3 * one // 2), (100, 1, 7, 0), (100, 2, 0, -3 * one // 2), (100, 3, 1, -3 * one // 2), (100, 4, 1, -3 * one // 2)]
    assert topk.top_k(df.where("false"), df.vec_id % 100 == 0).count() == 0


def test_topk_several_blocks_long_vectors_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(100, [1.0] * 9), (100, [1.0] * 9), (900, [0.25] * 20_000), (7, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "GROUP_BYTES", 8 * 20_000 * 3)  # three queries a block
    got = Counter(tuple(r) for r in topk.top_k(df, df.vec_id % 100 == 0, k=4).collect())
    whole = [(i, [int(np.floor(max(-(2.0**62), min(2.0**62, x * 1024)))) for x in v]) for i, v in rows]
    expected = Counter()
    for i, q in whole:
        if i % 100 == 0:
            every = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in whole if j != i)[:4]
            expected.update((i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(every))
    assert got == expected


def made_texts(seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 12, 30, 60]))) for _ in range(60)]
    passages = [[rng.choice(lines) for _ in range(rng.randrange(2, 9))] for _ in range(8)]
    texts = []
    for _ in range(60):
        body = []
        for _ in range(rng.randrange(1, 5)):
            body += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(lines), f"own {rng.random()}", ""]
        texts.append("\n".join(body))
    return texts


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(55))
    rows = [(3, long, "c"), (1, f"head\n{long}\ntail", "a"), (None, long, "n"), (4, None, "d"), (5, "", "e"), (6, f"{long}\n\n{long}", "f"), (7, "short line\nshort line", "g"), (1, f"head\n{long}\ntail", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __runs string")
    out = line_dedup.dedup(df, count_col="n")
    assert out.columns == ["doc_id", "text", "__runs", "n"]
    got = {r["__runs"]: (r.text, r.n) for r in out.collect()}
    assert got == {"a": (rows[1][1], 0), "again": (rows[1][1], 0), "c": ("", 1), "n": ("", 1), "d": (None, 0), "e": ("", 0), "f": ("", 2), "g": ("short line\nshort line", 0)}
    assert line_dedup.dedup(df.where("false")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_runs(rows, least=50):
    """Deletes later repeats of runs of whole non-blank lines that hold ``least`` words, by comparing all places; a run goes on as far as it does at any earlier place."""
    places, gone = defaultdict(list), defaultdict(set)
    split = {key: [(n, line.strip(" \t\n\v\f\r")) for n, line in enumerate((key[1] or "").split("\n")) if line.strip(" \t\n\v\f\r")] for key in sorted(set(rows))}
    for key, lines in split.items():
        for a in range(len(lines)):
            words, b = 0, a
            while b < len(lines) and words < least:
                words += len(lines[b][1].split())
                b += 1
            if words < least:
                continue
            earlier = places[tuple(x[1] for x in lines[a:b])]
            for other, at in earlier:
                end = b
                while end < len(lines) and at + end - a < len(split[other]) and lines[end][1] == split[other][at + end - a][1]:
                    end += 1
                gone[key] |= set(range(lines[a][0], lines[end - 1][0] + 1))
            earlier.append((key, a))
    return {key[0]: "\n".join(x for n, x in enumerate(key[1].split("\n")) if n not in gone[key]) if gone[key] else key[1] for key in rows}


def test_line_dedup_goes_on_along_any_earlier_place(spark):
    window = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"{window}\nother end"), (2, f"{window}\nshort one\nshort two\nown b"), (3, f"{window}\nshort one\n\nshort two\nown c"), (4, f"{window}\nother end\nown d")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "short one\nshort two\nown b", 3: "own c", 4: "own d"}
    rng = random.Random(5)
    endings = [[rng.choice(["aa bb", "cc", "dd ee ff", ""]) for _ in range(6)] for _ in range(9)]
    rows = [(i, "\n".join([rng.choice([window, f"head\n{window}", f"{window}\n{window}"]), *rng.choice(endings)[: rng.randrange(7)], f"own {i}"])) for i in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_runs(rows)
    for seed in (1, 2):
        rows = list(enumerate(made_texts(seed)))
        got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_runs(rows)


def test_line_dedup_query(spark):
    """All documents, and fewer fingerprints than lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in queries.op9_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    expected = brute_runs(rows)
    assert got == expected
    assert any(expected[i] != t for i, t in rows)
    every = line_dedup.lines(docs, "doc_id", "text")
    kept = line_dedup.winnowed(every, line_dedup.MIN_WORDS)
    assert kept.count() < 0.8 * every.count()


def test_winnowing_keeps_few_of_short_lines(spark):
    rows = [(i, "\n".join(f"line {i} {n}" for n in range(2000))) for i in range(3)]
    every = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    kept = line_dedup.winnowed(every, line_dedup.MIN_WORDS)
    # windows of 17 lines: about 2 of 18 lines are minima
    assert kept.count() < every.count() / 6
