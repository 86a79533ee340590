"""Hard-negative mining against brute force, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives, queries
from tests.conftest import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"


def brute(rows, is_anchor):
    """Every anchor against every row, as the statement of the operator says."""
    usable = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in usable:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, other == label) for i, other, v in usable if i != a))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [(i, -t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(inside, 1)]
    return sorted(out)


def test_equals_sql(spark):
    found = rows_of(queries.op12_hard_negatives(spark, SF))
    assert found == oracle_rows(queries.OP12_SQL, SF)
    assert sum(found[1].values()) > 20


@pytest.mark.parametrize("group_bytes, cells", [(8 << 20, 1 << 21), (400, 64)])
def test_against_brute_force(spark, monkeypatch, group_bytes, cells):
    """Ties, copies, zero and negative scores, unlike lengths; also with many blocks and small chunks."""
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 6) / 2]) for i in range(120)]
    rows += [(200 + i, i % 2, [1.0, 0.5, 0.0, 0.0, 0.5, 1.0]) for i in range(30)] + [(300 + i, i % 2, [-1.0] * 6) for i in range(4)]
    rows += [(i, *rows[3][1:]) for i in (7, 7, 8)] + [(400, 1, []), (401, 1, [1.0]), (402, 2, [0.0] * 9), (-5, 0, [1.0] * 6)]
    rows += [(500, None, [1.0] * 6), (None, 1, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")] * 6), (504, 1, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("row", "anchor", "id", "v", "score", "rank")}).repartition(7)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert any(r[4] == 0 for r in got) and any(r[2] == 3 for r in got)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, 0, [2.0**20, 1.0]), (1, 0, [2.0**20, 1.0]), (2, 1, [2.0**20 * 0.9, 3.0]), (3, 1, [2.0**20 * 0.9, 3.0 + 2**-8]), (4, 1, [2.0**20, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0, F.col("label")).collect())
    assert got == brute(rows, lambda i: i == 0) and [r[3] for r in got] == [3, 2]


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df.where("false"), F.lit(True), F.col("label")).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean"), F.col("label")).count() == 0
    assert hard_negatives.mine(df, F.lit(True), F.col("label")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(df, F.lit(True), F.col("label"), high=100)


def test_windows_hold_no_more_than_the_open_ones():
    """The stream is read lazily: a result comes before the rest of the anchor's keys is asked for."""
    key = lambda score, kind, name: hard_negatives._UNPACK.pack(1, (1 << 64) - 1 - (score + (1 << 63)), kind, name + (1 << 63), 0)

    def keys():
        yield key(100, 0, 5), 1
        yield key(90, 1, 6), 1
        raise AssertionError("read too far")

    assert next(hard_negatives.windows(keys(), 5, 3, 50, 95)) == (1, 5, 1, 6, 100, 90)
