"""Resharding that moves the fewest bytes, solved as a minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity. A byte that stays in its home
shard (the new shard with the old one's number) is free, any other costs one. The flow over all bytes gives the
blocks: for each pair of shards, how many bytes go from one to the other, in all no more than what old shards hold
above their capacity. An old shard's documents, laid out in the order of a seeded hash, are cut into consecutive
runs; a document goes where its middle lies. The long documents are cut in proportion to the blocks; the
smallest ones, about an eighth of all bytes, are then placed by a second flow against the room that is left, so
that they level out what long documents overshoot. Together they move what the first flow says, but for the
documents at the cuts. ``rewrite`` does it on a folder with one subfolder of Parquet files a shard, and writes only
shards whose content changes.

Positions come from sums of hash bins and a running sum within a bin, so no task holds a shard.
The driver holds one row per old shard and transfer.

A null text has no bytes. Repeated rows keep their own places. The order of rows that tie in id,
size and checksum is free, as they are equal; rows with null ids are told apart by their texts' checksums. Null old
shards form one old shard, the last. An empty table gives an empty result. Columns called like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._flow import Flow
from corpusloom.llm._shared import as_text, cut, fresh, quoted

#: Up to so many old shards the plan is broadcast.
BROADCAST_SHARDS = 20_000


def transfers(old: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each old shard the (new shard, bytes) blocks that move the fewest bytes; the home shard's comes first."""
    graph = Flow()
    arcs: dict[tuple[int, int], int] = {}
    for i, size in enumerate(old):
        graph.add("from", ("old", i), size)
        for j in range(len(capacity)):
            arcs[i, j] = graph.add(("old", i), ("new", j), size, int(i != j))
    for j, room in enumerate(capacity):
        graph.add(("new", j), "to", room)
    graph.run("from", "to")
    return [[(j, n) for j in sorted(range(len(capacity)), key=lambda j: (j != i, j)) if (n := graph.sent(arcs[i, j]))] for i in range(len(old))]


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def _cuts(blocks: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Blocks as (end, new shard) along an old shard's bytes."""
    out = []
    for block in blocks:
        at, ends = 0, []
        for j, n in block:
            at += n
            ends.append((at, j))
        out.append(ends)
    return out


def _split(listed: list) -> int:
    """The octave of sizes up to which documents count as small: they hold an eighth of the bytes or more."""
    total, held = sum(r.n for r in listed), 0
    for octave in sorted({r.octave for r in listed}):
        held += sum(r.n for r in listed if r.octave == octave)
        if held * 8 >= total:
            return octave
    return 0


def _shared_out(blocks: list[tuple[int, int]], part: int) -> list[tuple[int, int]]:
    """The blocks scaled down to ``part`` bytes in all, rounded along their running sum."""
    whole, at, done, out = sum(n for _, n in blocks), 0, 0, []
    for j, n in blocks:
        at += n
        upto = part * at // max(1, whole)
        out.append((j, upto - done))
        done = upto
    return out


def _filled(room: list[int], used: list[int]) -> list[int]:
    """What is left of each shard's room; an overshoot is taken from the others' in turn."""
    left = [a - b for a, b in zip(room, used)]
    over = -sum(x for x in left if x < 0)
    left = [max(0, x) for x in left]
    while over > 0:
        j = max(range(len(left)), key=left.__getitem__)
        step = min(over, max(1, left[j] - sorted(left)[-2] if len(left) > 1 else left[j]), left[j])
        left[j] -= step
        over -= step
    return left


def reshard(df: DataFrame, old: Column, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", numbered: bool = False, slack: float = 0.0) -> DataFrame:
    """Replace the columns of ``df`` that are called size, text_crc32, old_shard, shard or slot; the text itself is left out.

    old_shard is the number of the old shard in the order of ``old`` as text, null last, or ``old`` itself where
    old shards are ``numbered``; slot numbers the rows of a new shard from 0. A home shard may keep its bytes where they
    exceed the capacity by a share of ``slack`` at most.
    """
    own = ("size", "text_crc32", "old_shard", "shard", "slot")
    kept = [c for c in df.columns if c.lower() not in (*own, text_col.lower())]
    k, h, lane, upto, rn, before, cuts = fresh(df, "key", "bin", "lane", "upto", "rn", "before", "cuts")
    text = as_text(text_col).cast("binary")
    rows = df.select(
        *map(quoted, kept),
        F.coalesce(F.concat(F.lit("s"), F.lpad(old.cast("string"), 12, "0") if numbered else old.cast("string")), F.lit("t")).alias(k),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), quoted(id_col).cast("string"), F.crc32(text)), 52).alias(h),
    )
    rows = cut(rows)  # a few numbers a document, in place of several passes over the texts
    octave = F.floor(F.log2("size")).cast("int")
    listed = rows.groupBy(quoted(k).alias("k"), octave.alias("octave")).agg(F.sum("size").alias("n")).collect()
    names = sorted({r.k for r in listed})
    if numbered:
        # gaps are old shards without bytes
        names = sorted({*names, *(f"s{i:012d}" for i in range(int(max((n[1:] for n in names if n != "t"), default="-1")) + 1))})
    room = even(sum(r.n for r in listed), shards)
    small = _split(listed)
    rows = rows.withColumn(lane, (octave <= small).cast("int"))
    spark = df.sparkSession

    held = {(name, lane_): 0 for name in names for lane_ in (0, 1)}
    for r in listed:
        held[r.k, int(r.octave <= small)] += r.n
    for i, n in enumerate(names[:shards]):
        room[i] = max(room[i], min(held[n, 0] + held[n, 1], int(room[i] * (1 + slack))))
    blocks = transfers([held[n, 0] + held[n, 1] for n in names], room)
    large = [_shared_out(block, held[n, 0]) for n, block in zip(names, blocks)]

    def listed_cuts(which: int, found: list[list[tuple[int, int]]]) -> list[tuple]:
        return [(name, which, i, ends) for i, (name, ends) in enumerate(zip(names, _cuts(found)))]

    def place(part: DataFrame, plan: list[tuple]) -> DataFrame:
        plan = spark.createDataFrame(plan, f"{k} string, {lane} int, old_shard int, {cuts} array<struct<upto: long, shard: int>>")
        plan = F.broadcast(plan) if len(names) <= BROADCAST_SHARDS else plan
        starts = part.groupBy(k, lane, h).agg(F.sum("size").alias("n"))
        starts = starts.withColumn(before, F.sum("n").over(Window.partitionBy(k, lane).orderBy(h)) - F.col("n")).drop("n")
        inside = Window.partitionBy(k, lane, h).orderBy(F.xxhash64(F.lit(seed), quoted(id_col).cast("string")), "size", "text_crc32")
        middle = quoted(before) + quoted(upto) - F.col("size") / 2
        return (
            part.withColumn(upto, F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .join(starts, [k, lane, h])
            .join(plan, [k, lane])
            .withColumn("shard", F.element_at(F.transform(F.filter(quoted(cuts), lambda c: c["upto"] > middle), lambda c: c["shard"]), 1))
        )

    long = listed_cuts(0, large)
    used = {r[0]: r[1] for r in place(rows.where(quoted(lane) == 0), long).groupBy("shard").agg(F.sum("size")).collect()}
    rest = transfers([held[n, 1] for n in names], _filled(room, [used.get(j, 0) for j in range(shards)]))
    placed = place(rows, long + listed_cuts(1, rest))
    placed = placed.withColumn(rn, F.row_number().over(Window.partitionBy(k, lane, h, "shard").orderBy(upto)))
    counts = placed.groupBy(k, lane, h, "shard").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy(k, lane, h)) - F.col("n")).drop("n")
    return placed.join(offsets, [k, lane, h, "shard"]).select(*map(quoted, kept), "size", "text_crc32", "old_shard", "shard", (F.col("offset") + quoted(rn) - 1).cast("long").alias("slot"))


def affected(df: DataFrame) -> DataFrame:
    """The shards that differ from the old shard of their number, with rows and bytes to write (0 where one becomes empty)."""
    moved = F.col("old_shard") != F.col("shard")
    gone = df.where(moved).select(F.col("old_shard").alias("shard"))
    touched = gone.union(df.where(moved).select("shard")).distinct()
    sizes = df.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return touched.join(sizes, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def rewrite(spark: SparkSession, path: str, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.05) -> DataFrame:
    """Reshard a folder of ``shard=N`` subfolders in place; returns (shard, rows, bytes) of the shards that were written.

    The files of shards whose content stays are not touched. What moves is first kept in the checkpoint folder, so that
    no row is only in memory while its file is replaced; a shard that becomes empty is deleted.
    """
    (i,) = fresh(spark.read.parquet(path), "row")
    rows = cut(spark.read.parquet(path).withColumn(i, F.monotonically_increasing_id()))
    placed = cut(reshard(rows, F.col("shard"), shards, seed, id_col, text_col, numbered=True, slack=slack).select(i, F.col("old_shard"), F.col("shard").alias("to"), "slot", "size"))
    touched = cut(affected(placed.select("old_shard", F.col("to").alias("shard"), "size")))
    whole = rows.drop("shard").join(placed.join(touched.select(F.col("shard").alias("to")), "to"), i)
    whole = whole.withColumn("shard", F.col("to")).repartition("shard").sortWithinPartitions("shard", "slot").select(*[quoted(c) for c in rows.columns if c not in (i, "shard")], "shard")
    whole.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard").parquet(path)
    emptied = [r.shard for r in touched.where("rows = 0").select("shard").collect()]
    for shard in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
