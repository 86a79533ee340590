"""Line deduplication by winnowing, with DataFrame functions only.

A text's lines are split at line feeds and compared without surrounding white space; blank lines
have no part in matching. From every line a window reaches on until it holds ``MIN_WORDS`` words. Each
window selects its smallest line hash, the first of equal ones; neighbouring windows mostly select the
same line, so that of all lines only these minima are kept as fingerprints. Two places that share a run of
lines of ``MIN_WORDS`` words or more share the window it begins with and hence a fingerprint at the
same line of it, wherever the run begins: the fingerprints are guaranteed. They are joined on the line hash
alone, and only documents that share one are looked at again, there only the windows that selected a
shared one.

Such a fingerprint is verified and extended. To the left, to the beginnings of all windows that
selected it; to the right, to the windows' ends and on along any earlier place, over less than another
``MIN_WORDS`` words, beyond which a window of its own takes over. Each of these stretches around a
fingerprint is compared as a whole, by the hash of its line hashes; the first place of a stretch, by id and
position, is the original, and every later one is a repeat. The later runs are deleted, with blank
lines inside them; all other lines stay as they are, in order.

Only line hashes are shuffled and windowed. A place is never paired with other places: groups are reduced
to their first place and count, by key and salt before they meet, and the result goes back by key and salt, so a
passage in a third of all rows is ``SALTS`` rows where its group meets and a ``SALTS``-th of its places in a task.

Runs repeated within one text are deleted as well. Rows with the same id and text are one document:
both keep what it keeps. A null id comes after all others. A null text stays null, an empty one empty;
a text that is all repeats becomes empty. An empty table stays empty. Columns other than the text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import as_text, cut, fresh, quoted

MIN_WORDS, SALTS = 50, 64
_SPACE = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-blank line of a distinct document: its hash, its words and the words before it."""
    docs = df.select(quoted(id_col).alias("id"), as_text(text_col).alias("text")).where("text <> ''").withColumn("th", F.xxhash64("text"))
    rows = docs.select("id", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.select("id", "th", "pos", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line"))
    rows = rows.where("line <> ''").select("id", "th", "pos", F.xxhash64("line").alias("h"), _words(F.col("line")).cast("int").alias("words"))
    rows = rows.repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    return rows.withColumn("at", F.sum("words").over(Window.partitionBy("id", "th").orderBy("pos")) - F.col("words"))


def _near(min_words: int) -> Window:
    """The lines of the window that begins at a line."""
    return Window.partitionBy("id", "th").orderBy("at").rangeBetween(0, min_words - 1)


def winnowed(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, mark, mark_pos): the lines that some window selects as its minimum, each once."""
    near = _near(min_words)
    least = rows.withColumn("m", F.min(F.struct("h", "pos")).over(near)).withColumn("held", F.sum("words").over(near))
    return least.where(F.col("held") >= min_words).select("id", "th", F.col("m.h").alias("mark"), F.col("m.pos").alias("mark_pos")).distinct()


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` occur several times, with the first place of their group as ``o``.

    A group is reduced by key and salt before it meets, and is met by its rows again by key and salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("th", "id"), F.lit(SALTS)).cast("int"))
    place = F.struct(F.col("id").isNull().alias("no"), "id", "th", "pos")
    parts = salted.groupBy(*keys, "salt").agg(F.min(place).alias("o"), F.count("*").alias("n"))
    whole = parts.groupBy(*keys).agg(F.min("o").alias("o"), F.sum("n").alias("n")).where("n > 1").drop("n")
    return salted.join(parts.select(*keys, "salt").join(whole, keys), [*keys, "salt"]).drop("salt")


def windows(rows: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """The windows that selected a shared fingerprint: their ends, content and the lines that follow them."""
    by = Window.partitionBy("id", "th")
    near = _near(min_words)
    # the lines that end less than min_words words after a line
    after = by.orderBy(F.col("at") + F.col("words")).rangeBetween(1, min_words - 1)
    spans = (
        rows.join(shared, rows["id"].eqNullSafe(shared["of"]) & (rows["th"] == shared["of_th"]))
        .withColumn("tail", F.collect_list(F.struct("h", "pos")).over(after))
        .withColumn("tail", F.last("tail").over(near))
        .withColumn("hashes", F.collect_list("h").over(near))
        .withColumn("m", F.min(F.struct("h", "pos")).over(near))
        .withColumn("held", F.sum("words").over(near))
        .withColumn("end", F.max("pos").over(near))
        .where((F.col("held") >= min_words) & F.array_contains("marks", F.col("m.pos")))
    )
    return spans.select("id", "th", "pos", "end", F.col("m.h").alias("mark"), F.xxhash64("hashes").alias("content"), F.col("tail.h").alias("tail"), F.col("tail.pos").alias("tail_pos"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): the later runs of each document as disjoint (first line, last line) pairs, in order."""
    rows = cut(lines(df, id_col, text_col))
    prints = winnowed(rows, min_words).select("id", "th", "mark", F.col("mark_pos").alias("pos"))
    shared = _groups(cut(prints), ["mark"]).groupBy(F.col("id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_set("pos").alias("marks"))
    spans = _groups(cut(windows(rows, shared, min_words)), ["mark", "content"]).drop("o")
    # the window with none, one, two ... of the lines after it
    none = F.array().cast("array<bigint>")
    ends = F.concat(F.array("end"), F.coalesce(F.col("tail_pos").cast("array<int>"), none.cast("array<int>")))
    hashed = lambda n: F.xxhash64("content", n, F.slice(F.coalesce("tail", none), F.lit(1), n))
    stretches = F.transform(ends, lambda end, n: F.struct(hashed(n).alias("stretch"), end.alias("end")))
    matched = cut(spans.select("id", "th", "pos", "mark", F.explode(stretches).alias("s")).select("id", "th", "pos", "mark", "s.*"))
    first = F.col("o.id").eqNullSafe(F.col("id")) & (F.col("o.th") == F.col("th")) & (F.col("o.pos") == F.col("pos"))
    found = _groups(matched, ["mark", "stretch"]).where(~first).groupBy("id", "th", "pos").agg(F.max("end").alias("end"))
    # overlapping and touching intervals become one run
    by = Window.partitionBy("id", "th").orderBy("pos", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.coalesce(F.col("pos") > before + 1, F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(by)).groupBy("id", "th", "run").agg(F.min("pos").alias("a"), F.max("end").alias("b"))
    return runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """``df`` with later repeated runs deleted from the text; optionally the number of lines that went."""
    i, h, runs = fresh(df, "id", "th", "runs")
    found = cut(repeats(df, id_col, text_col, min_words)).select(F.col("id").alias(i), F.col("th").alias(h), F.col("runs").alias(runs))
    keyed = df.withColumn(h, F.xxhash64(as_text(text_col)))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(found[i]) & (keyed[h] == found[h]), "left").drop(found[h])
    kept = F.filter(_lines(quoted(text_col)), lambda line, n: ~F.exists(quoted(runs), lambda r: (n >= r["a"]) & (n <= r["b"])))
    text = F.when(quoted(runs).isNull(), quoted(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate(quoted(runs), F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0))
    columns = [text.alias(c) if c.lower() == text_col.lower() else quoted(c) for c in df.columns]
    return joined.select(*columns, *([gone.cast("long").alias(count_col)] if count_col else []))
