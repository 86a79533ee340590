"""Chunkers as Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def window_step(window: int, overlap: int) -> tuple[int, int]:
    """A window of at least 1 and a step that always moves on."""
    window = max(int(window), 1)
    return window, max(window - max(0, min(int(overlap), window - 1)), 1)


def windows(text: Column, window: int = 900, overlap: int = 140) -> Column:
    """Fixed windows of characters; a last one is anchored at the end of the text, so its tail is always covered."""
    size, step = window_step(window, overlap)
    n = F.length(text)
    last = F.greatest(n - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size))))


def plain_windows(text: Column, window: int, overlap: int) -> Column:
    """Windows one step after another until one reaches the end of the text."""
    size, step = window_step(window, overlap)
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - size + step - 1, F.lit(0)), F.lit(step))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; lambdas evaluate what they refer to anew in each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_windows(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Windows of up to ``size`` characters that end at the last space if that lies beyond the middle."""
    overlap = max(0, size // 4 if overlap >= size else overlap)
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"), F.lit(False).alias("done"))
    # a window moves on by more than half its size less the overlap
    least = max(1, size // 2 - overlap)

    def windows_of(body: Column, n: Column) -> Column:
        def moved(acc: Column, segment: Column) -> Column:
            stop = F.least(acc["at"] + size, n)
            behind = F.locate(" ", F.reverse(segment))
            space = F.length(segment) - behind
            cut = (stop < n) & (behind > 0) & (space > size // 2)
            end = F.when(cut, acc["at"] + space).otherwise(stop)
            piece = strip(F.when(cut, F.left(segment, space)).otherwise(segment))
            return F.struct(
                F.greatest(end - overlap, acc["at"] + 1).alias("at"),
                F.when(piece != "", F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
                (end >= n).alias("done"),
            )

        def step(acc: Column, _: Column) -> Column:
            segment = F.substr(body, acc["at"] + 1, F.lit(size))
            return F.when(acc["done"], acc).otherwise(_let(segment, lambda s: moved(acc, s)))

        rounds = F.ceil(n / least) + 1
        found = F.aggregate(F.sequence(F.lit(1), rounds.cast("int")), zero, step)["out"]
        return F.when(n == 0, none).when(n <= size, F.array(body)).otherwise(found)

    return _let(strip(F.coalesce(text, F.lit(""))), lambda body: _let(F.length(body), lambda n: windows_of(body, n)))


def articles(text: Column) -> Column:
    """(article, text) structs, split at headings of statute articles; what stands before the first goes."""
    marked = F.regexp_replace(text, r"(?m)^(Статья\s+\d+(?:\.\d+)?[^\n]*)", "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "\u0002", 1)).alias("article"), strip(F.substring_index(p, "\u0002", -1)).alias("text")))


def number_chunks(df: DataFrame, pages: str, doc: str = "doc_id", window: int = 900, overlap: int = 140) -> DataFrame:
    """Chunks of each page with a running index over the document and the batch each chunk falls in."""
    paged = df.select(doc, F.posexplode(pages).alias("page", "body"))
    rows = paged.select(doc, "page", F.posexplode(windows(F.col("body"), window, overlap)).alias("pos", "chunk"))
    index = F.row_number().over(Window.partitionBy(doc).orderBy("page", "pos")) - 1
    return rows.withColumn("chunk_index", index).withColumn("batch", F.floor(index / 64).cast("int"))


def chunk_id(doc_sha: Column, page: Column, offset: Column, chunk: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_sha, page.cast("string"), offset.cast("string"), chunk), 256)
