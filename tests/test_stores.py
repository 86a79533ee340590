"""Versions, restores, packed vectors, slugs and manifests: brute force and what must be refused."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import memory
from corpusloom.sources import sinks, stores


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_never_used_twice(spark, tmp_path):
    v = stores.Versions(spark, "a", f"{tmp_path}/v")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert v.shown == 0 and v.log() == []
    with pytest.raises(ValueError):
        v.table()
    assert v.publish(frame(1)) == 1 and v.publish(frame(2, 3)) == 2
    pinned = v.table()
    assert v.roll_back() == 1 and rows(v.table()) == [(1,)]
    assert v.publish(frame(4)) == 3
    assert [rows(v.at(n)) for n in (1, 2, 3)] == [[(1,)], [(2,), (3,)], [(4,)]]
    assert rows(pinned) == [(2,), (3,)]  # a reader keeps its version
    with pytest.raises(ValueError):
        v.publish(frame())
    again = stores.Versions(spark, "a", f"{tmp_path}/v")  # the state is in storage
    assert again.shown == 3 and [e["action"] for e in again.log()] == ["publish", "publish", "roll back", "publish"]
    assert again.roll_back() == 1
    with pytest.raises(ValueError):
        again.roll_back()
    assert rows(v.table()) == [(1,)]
    with pytest.raises(ValueError):
        v.at(9)


def test_of_two_writers_one_wins(spark, tmp_path):
    frame = spark.createDataFrame([(1,)], "i int")
    one, two = (stores.Versions(spark, "a", f"{tmp_path}/v") for _ in range(2))
    seen = len(one.log())
    assert one.publish(frame, after=seen) == 1
    with pytest.raises(stores.Conflict):
        two.publish(frame, after=seen)
    # both read the same log, then both write
    log = one.log()
    one._commit(log, "publish", 2, 2, log[0]["data"])
    with pytest.raises(stores.Conflict):
        two._commit(log, "publish", 2, 2, log[0]["data"])
    assert len(two.log()) == 2 and not [p for p in (tmp_path / "v" / "log").iterdir() if p.name.endswith(".tmp")]
    assert len([p for p in (tmp_path / "v").iterdir() if p.name.startswith("data")]) == 1  # what lost is removed


def test_restore_modes(spark, tmp_path):
    schema = "k int, x string"
    stores.backup(spark.createDataFrame([(1, "new"), (2, "new"), (None, "new")], schema), f"{tmp_path}/b", "e5")
    spark.createDataFrame([(2, "old"), (3, "old")], schema).write.parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/t", "e5")
    assert rows(stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/t", "e5", "merge", "k").fillna(0)) == [(0, "new"), (1, "new"), (2, "old"), (3, "old")]
    with pytest.warns(UserWarning, match="anew"):
        assert stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/t", "hash", force=True).count() == 3
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e")
    assert stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/e", None).count() == 3  # an empty target needs no force
    assert stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/n", None, "merge", "k").count() == 3
    with pytest.raises(ValueError):
        stores.restore(spark, f"{tmp_path}/b", f"{tmp_path}/n", None, "merge")


def test_packed_vectors(spark):
    v = [[1.5, -2.0], None, [], [3.25]]
    df = spark.createDataFrame([(x,) for x in v], "v array<float>").coalesce(1)
    got = df.select(stores.pack(F.col("v")).alias("b")).select("b", stores.unpack(F.col("b")).alias("v")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [None if x is None else struct.pack(f"<{len(x)}f", *x) for x in v]
    assert [r.v for r in got] == v


def plain_slugs(names):
    taken, following, out = set(), 1, []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9_-]+", "-", name or "").strip("-_")
        if base:
            found, n = base, 1
            while found in taken:
                n += 1
                found = f"{base}-{n}"
            if m := re.search(r"(\d+)$", found):
                following = max(following, int(m[1]) + 1)
        else:
            found, following = f"doc-{following}", following + 1
        assert found not in taken
        taken.add(found)
        out.append(found)
    return out


def test_unique_slugs_as_one_after_another(spark):
    rng = random.Random(1)
    names = ["Report", "Report", "Report-2", "doc-2", None, "doc-2", "_x_", "-", "doc"]
    names += [rng.choice(["Report", "Report", "Report-2", "Report-2-2", "Report-3", "doc", "doc-2", "doc-12", None, "", "a b", "a-b", "№", "x_7"]) for _ in range(40)]
    df = spark.createDataFrame([(i * 1_000_003, n, "kept") for i, n in enumerate(names)], "at long, name string, slug string").repartition(5)
    got = memory.unique_slugs(df, "name", "at")
    assert got.columns == ["at", "name", "slug"]
    assert [r.slug for r in sorted(got.collect(), key=lambda r: r["at"])] == plain_slugs(names)
    assert memory.unique_slugs(df.where("false"), "name", "at").count() == 0


def test_manifest_tree(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", None]), i * 7919 % 100_003, rng.choice(["x" * 600, f"t{i}", None])) for i in range(700)] + [("a", 5, "same")] * 3
    df = spark.createDataFrame(data, "g string, k long, text string").repartition(4)
    got = {r.g: r for r in sinks.manifest(df, "g", "text", "k", fan=4).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for g in ("a", None):
        own = sorted((k, md5(t or "")) for key, k, t in data if key == g)
        level = [d for _, d in own]
        for _ in range(2):
            level = [md5("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        texts = [t or "" for key, _, t in data if key == g]
        assert (got[g].articles, got[g].bytes, got[g].suspicious, got[g].md5) == (len(own), sum(map(len, texts)), sum(len(t) < 500 for t in texts), md5("".join(level)))
