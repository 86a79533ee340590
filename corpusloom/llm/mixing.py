"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Token capacity
flows from the patterns to the sources' quotas; the first copy of a pattern's tokens is free and
each further copy costs more (convex repetition costs), so repetition is the last resort. The flow
says how many tokens to take of each pattern; documents are then taken whole in the order of a
seeded hash, after as many full rounds as the pattern's share holds. The document at the end of a
share is taken in part, so that a source's words meet its target to the word.

The order of documents is never materialised: hash bins are summed per pattern, only the bin that
holds the end of a share is looked into, and the plan that documents are matched with has one row
per pattern. The driver holds one row per pattern and source.

Sources are ordered by code point, null last. A null text has size 0 and is never taken. Documents
of no source (an empty or null membership) are not taken. The hash is of id and text, so that only equal rows tie
in it; those that tie at the end of a share divide what is left by size, rounded down. An empty table gives an
empty result; an empty source has target 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._flow import Flow
from corpusloom.llm._shared import as_text, cut, fresh, quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many patterns the plan is broadcast.
BROADCAST_PATTERNS = 20_000

Source = str | None


class Plan(NamedTuple):
    sizes: dict[Source, int]
    targets: dict[Source, float]
    taken: dict[tuple, int]  # words by pattern


def in_order(sources) -> list[Source]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[Source, int], total: float, weights: dict[Source, float], limit: float) -> dict[Source, float]:
    """Shares of ``total`` by weight; what exceeds ``limit`` times a source's size is reshared until none is above."""
    out: dict[Source, float] = {}
    open_, left = in_order(sizes), total
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        full = [s for s in open_ if share[s] > limit * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def plan(patterns: dict[tuple, int], weights: dict[Source, float], share: float, copies: int) -> Plan:
    """Solve the flow from pattern sizes to source quotas."""
    sizes: dict[Source, int] = {}
    for pattern, size in patterns.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + size
    goal = targets(sizes, share * sum(n for p, n in patterns.items() if p), weights, copies)
    graph = Flow()
    for pattern, size in patterns.items():
        for copy in range(copies):
            graph.add("from", ("pattern", pattern), size, copy * copy)
        for s in pattern:
            graph.add(("pattern", pattern), ("source", s), copies * size)
    for s in in_order(sizes):
        graph.add(("source", s), "to", int(goal[s] + 0.5))
    graph.run("from", "to")
    taken = {pattern: 0 for pattern in patterns}
    for arc in range(0, len(graph.ends), 2):
        if graph.ends[arc ^ 1] == "from":
            taken[graph.ends[arc][1]] += graph.sent(arc)
    return Plan(sizes, goal, taken)


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(as_text(text_col), F.lit(WORD)).cast("long")


def repeating(values: tuple[float, ...], sources) -> dict[Source, float]:
    return {s: values[i % len(values)] for i, s in enumerate(in_order(sources))}


NAMES = ("size", "source_size", "target", "taken")


def mix(df: DataFrame, membership: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, copies: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """Add size, source_size, target and taken, called by ``names``, to every row; a column of such a name is replaced.

    ``membership`` gives the array of sources of a row; source_size and target are those of the
    first of its sources.
    """
    size_col, source_col, target_col, taken_col = names
    p, h, rounds, edge, rest, tied = fresh(df, "pattern", "hash", "rounds", "edge", "rest", "tied")
    keys = F.array_sort(F.array_distinct(F.transform(F.coalesce(membership, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n")))))
    order = F.xxhash64(F.lit(seed), quoted(id_col).cast("string"), as_text(text_col))
    based = df.withColumn(p, keys).withColumn(h, order)
    bin_of = F.shiftrightunsigned(quoted(h), 52)
    spark = df.sparkSession

    # one number per pattern and bin; the driver gets one row per pattern
    bins = cut(based.select(quoted(p).alias("p"), bin_of.alias("bin"), size_of(text_col).alias("n")).groupBy("p", "bin").agg(F.sum("n").alias("n")))
    listed = bins.groupBy("p").agg(F.sum("n").alias("n")).collect()
    decode = lambda key: tuple(x[1:] if x[0] == "s" else None for x in key)
    found = plan({decode(r.p): r.n for r in listed}, repeating(weights, {s for r in listed for s in decode(r.p)}), share, copies)
    shares = []
    for r in listed:
        members = decode(r.p)
        full, left = divmod(found.taken[members], r.n) if r.n else (0, 0)
        one = in_order(members)[0] if members else None
        shares.append((list(r.p), full, left, found.sizes.get(one, 0), float(found.targets.get(one, 0.0))))
    small = (lambda x: F.broadcast(x)) if len(shares) <= BROADCAST_PATTERNS else (lambda x: x)

    # the bin in which a pattern's share ends, and what is left for it there
    left = spark.createDataFrame([x[:3] for x in shares], "p array<string>, rounds long, left long").drop("rounds")
    summed = bins.join(small(left), "p").withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("bin")))
    plans = summed.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left"))).select("p", "bin", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"))

    # the documents of the bin in which a pattern's share ends
    ends = (
        based.select(quoted(p).alias("p"), quoted(h).alias("h"), bin_of.alias("bin"), as_text(text_col).alias("text"))
        .join(small(plans), ["p", "bin"])
        .groupBy("p", "h")
        .agg(F.sum(size_of("text")).alias("n"), F.first("rest").alias("rest"))
    )
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    running = ends.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy(unsigned)))
    edges = running.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))).groupBy("p").agg(F.min_by(F.struct("h", "n", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), unsigned).alias("e"))
    known = {tuple(r.p): r.e for r in edges.collect()}
    rows = [(key, full, e.h if (e := known.get(tuple(key))) else None, e.left if e else 0, e.n if e else 1, s, t) for key, full, _, s, t in shares]
    final = spark.createDataFrame(rows, f"{p} array<string>, {rounds} long, {edge} long, {rest} long, {tied} long, `{source_col}` long, `{target_col}` double")
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    sized = based.select(*map(quoted, kept), quoted(p), quoted(h), size_of(text_col).alias(size_col))
    flip = F.lit(-(1 << 63))
    part = (
        F.when(quoted(edge).isNull(), 0)
        .when(quoted(h).bitwiseXOR(flip) < quoted(edge).bitwiseXOR(flip), quoted(size_col))
        .when(quoted(h) == quoted(edge), F.floor(quoted(rest) * quoted(size_col) / F.greatest(quoted(tied), F.lit(1))))
        .otherwise(0)
    )
    taken = (quoted(size_col) * quoted(rounds) + part).cast("long").alias(taken_col)
    return sized.join(small(final), p).select(*map(quoted, kept), *map(quoted, names[:3]), taken)


def sample(df: DataFrame, membership: Column, **options) -> DataFrame:
    """``df`` with one row for each time that the mix takes a document; a part of half a document or more counts as one.

    The columns are those of ``df``, whatever their names.
    """
    own = fresh(df, *NAMES, "copy")
    size, taken, copy = own[0], own[3], own[4]
    mixed = mix(df, membership, names=tuple(own[:4]), **options)
    times = F.when(quoted(size) > 0, F.floor(quoted(taken) / quoted(size) + F.lit(0.5))).otherwise(0).cast("int")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*map(quoted, df.columns))
