"""Named documents: unique identifiers, tags, and replacing those of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ordered
from corpusloom.sources.shared import cut


def slug(name: Column) -> Column:
    """Letters, digits, _ and -; other characters become -, and neither - nor _ is at an end."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "-"), r"^[-_]+|[-_]+$", "")


def unique_slugs(df: DataFrame, name: str, order: str, out: str = "slug") -> DataFrame:
    """A slug per row, as if the rows came one after another in ``order``.

    A name takes its slug, or where an earlier row has that, the first of slug-2, slug-3 ... that none has. Rows without a name
    (null, or nothing left of it) take doc-N, where N follows the largest number that ends any earlier row's slug. Ties in
    ``order`` come in some order.

    The rows are resolved together, in rounds. The r-th row of a name begins at its r-th candidate; of the rows that meet in
    one slug the first keeps it, and the others of its name move on by one, those behind them with them. What a row is refused once it never
    gets, so that the rounds end, in as many as names like "a" and "a-2" are interleaved.
    """
    base = F.coalesce(slug(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(""))
    rows = ordered.numbered(df.withColumn("__base", base), [], [order], "__at")
    rows = ordered.scan(rows, ["__base"], ["__at"], {"__r": F.lit(1).cast("long")}).withColumn("__k", F.col("__r"))
    # unnamed rows up to each row
    rows = ordered.scan(rows, [], ["__at"], {"__u": F.when(F.col("__base") != "", 0).otherwise(1).cast("long")})
    own = F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), "__k"))
    named = F.col("__base") != ""
    ends = F.regexp_extract("__slug", r"(\d+)$", 1)
    number = F.when(ends != "", F.right(ends, F.lit(18)).cast("long"))  # of longer numbers the last 18 digits
    while True:
        rows = rows.withColumn("__slug", F.when(named, own))
        # N of the u-th unnamed row: one more than all numbers before it, those of unnamed rows among them
        counted = ordered.scan(rows, [], ["__at"], maxima={"__top": F.when(named, number + 1 - F.col("__u"))})
        placed = counted.withColumn("__slug", F.coalesce("__slug", F.concat(F.lit("doc-"), F.col("__u") - 1 + F.greatest(F.coalesce("__top", F.lit(1)), F.lit(1)))))
        first = placed.groupBy("__slug").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
        judged = cut(placed.join(first, "__slug", "left").withColumn("__lost", named & (F.coalesce("__first", F.col("__at")) < F.col("__at"))))
        if judged.where("__lost").isEmpty():
            return judged.select(*(F.col(c) for c in df.columns if c != out), F.col("__slug").alias(out))
        # each row's candidate is behind that of the row of its name before it
        moved = judged.withColumn("__d", F.col("__k") + F.col("__lost").cast("long") - F.col("__r")).drop("__slug", "__top", "__first", "__n", "__lost")
        rows = ordered.scan(moved, ["__base"], ["__at"], maxima={"__most": F.col("__d")}).withColumn("__k", F.col("__most") + F.col("__r")).drop("__d", "__most")


def add(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Documents of the same key are replaced."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def remove(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")


def tagged(current: DataFrame, tags: list[str]) -> DataFrame:
    """Documents that carry all the tags; no tags: all documents."""
    wanted = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    return current.where(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def substantial(text: Column, least: int = 200) -> Column:
    """Whether a cleaned text is long enough to keep."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")) >= least


def since_summary(exchanges: DataFrame, saved: DataFrame, conversation: str, turn: str, due: int = 6) -> DataFrame:
    """``exchanges`` with ``since``, the messages since the conversation's last saved summary (two an exchange, its own among
    them), ``summary``, the number of that turn (null before the first), and ``due`` once there are so many messages.

    ``saved``: conversation and turn of the summaries; one saved at an exchange's turn comes after it. Repeated summaries count once, those of other
    conversations not at all.
    """
    both = exchanges.select(conversation, turn, F.lit(0).alias("__saved")).unionByName(saved.select(conversation, turn, F.lit(1).alias("__saved")))
    counted = ordered.scan(both, [conversation], [turn, "__saved"], {"__n": 1 - F.col("__saved")})
    last = {"__from": F.when(F.col("__saved") == 1, F.col("__n")), "summary": F.when(F.col("__saved") == 1, F.col(turn))}
    rows = ordered.scan(counted, [conversation], [turn, "__saved"], maxima=last).where("__saved = 0")
    since = (2 * (F.col("__n") - F.coalesce("__from", F.lit(0)))).cast("int")
    return rows.select(conversation, turn, since.alias("since"), "summary", (since >= due).alias("due"))


def warm_up(queries: DataFrame, key: str, n: str, least: int, limit: int, first: int) -> DataFrame:
    """At most ``limit`` queries with enough candidates by key, the first of them as warm-up."""
    chosen = queries.where(F.col(n) >= least).orderBy(key).limit(limit)
    return chosen.withColumn("part", F.when(F.row_number().over(Window.orderBy(key)) <= first, "warmup").otherwise("timed"))


def answerable(items: DataFrame, relevant: str) -> DataFrame:
    """Items to be scored, by the keys in ``relevant`` or their number; none at all is an error rather than a perfect score."""
    kept = items.where((F.size(relevant) if dict(items.dtypes)[relevant].startswith("array") else F.col(relevant)) > 0)
    total = kept.agg(F.count("*").alias("__n"))
    checked = F.when(F.col("__n") == 0, F.raise_error(F.lit("no item has relevant keys"))).otherwise(F.col("__n"))
    return kept.crossJoin(F.broadcast(total.select(checked.alias("__n")))).where("__n > 0").drop("__n")


def mixed(left: DataFrame, right: DataFrame, text: str, order: str) -> DataFrame:
    """(side, order, text): rows of both in order, as far as the bytes of the smaller side reach (a 50/50 mix).

    Running sums are taken by ranges of the order, so that no task holds a side.
    """
    both = left.select(F.lit("left").alias("side"), order, text).unionByName(right.select(F.lit("right").alias("side"), order, text))
    both = both.withColumn("bytes", (F.octet_length(text) + 1).cast("long"))
    budget = both.groupBy("side").agg(F.sum("bytes").alias("n")).agg(F.min("n").alias("budget"))
    upto = running(both, ["side"], order, "bytes")
    return upto.crossJoin(F.broadcast(budget)).where("upto <= budget").select("side", order, text, "bytes")


def running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add ``upto``, the running sum of ``value``, and ``rank`` from 1, in the order given within the keys."""
    return ordered.scan(df, keys, [order], {"upto": F.col(value), "rank": F.lit(1).cast("long")})
