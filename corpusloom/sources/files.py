"""Documents from files: one row per page of text. Parsers run Arrow-batched over ``binaryFile`` rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X

PAGES = "path string, page int, text string"
#: A virtual page ends with the paragraph that takes it over so many characters.
PAGE_CHARS = 8000


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a folder whose names fit the pattern, with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines split at line feeds only; blank lines are skipped, broken ones are kept in _corrupt_record."""
    rows = spark.read.text(path, lineSep="\n").where("trim(value) <> ''")
    full = f"{schema}, _corrupt_record string"
    return rows.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def extension(name: Column) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def parser_name(name: Column) -> Column:
    """Which parser takes a file; null for unknown kinds."""
    kind = extension(name)
    return F.when(kind.isin("md", "markdown"), "md").when(kind.isin("html", "htm"), "html").when(kind.isin("txt", "pdf", "docx", "pptx", "xlsx"), kind)


def virtual_pages(pieces: list[str], joint: str) -> list[str]:
    """Pieces joined into pages of over PAGE_CHARS characters, white space squeezed."""
    pages, held = [], ""
    for piece in filter(None, (p.strip() for p in pieces)):
        held = f"{held}{joint}{piece}" if held else piece
        if len(held) > PAGE_CHARS:
            pages.append(held)
            held = ""
    return [page for raw in [*pages, held] if (page := " ".join(raw.split()))]


def decode_text(data: bytes) -> str:
    for encoding in ("utf-8", "utf-8-sig", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _members(data: bytes, pattern: str) -> list[ElementTree.Element]:
    """XML members of an archive in the order of the numbers in their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if re.fullmatch(pattern, n)]
        return [ElementTree.fromstring(archive.read(n)) for n in sorted(names, key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))]


def _local(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in node.iter() if e.tag.rpartition("}")[2] == name]


def docx_pages(data: bytes) -> list[str]:
    paragraphs = ["".join(t.text or "" for t in _local(p, "t")) for part in _members(data, r"word/document\.xml") for p in _local(part, "p")]
    return virtual_pages(paragraphs, "\n")


def pptx_pages(data: bytes) -> list[str]:
    """One page per slide with text."""
    slides = (" ".join(t.text or "" for t in _local(s, "t")) for s in _members(data, r"ppt/slides/slide\d+\.xml"))
    return [page for s in slides if (page := " ".join(s.split()))]


def xlsx_pages(data: bytes) -> list[str]:
    """One page per sheet: cells joined by spaces, rows by line feeds, then squeezed."""
    shared = ["".join(t.text or "" for t in _local(si, "t")) for part in _members(data, r"xl/sharedStrings\.xml") for si in _local(part, "si")]

    def value(cell: ElementTree.Element) -> str:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in _local(cell, "t"))
        raw = "".join(v.text or "" for v in _local(cell, "v"))
        return shared[int(raw)] if cell.get("t") == "s" and raw else raw

    sheets = ("\n".join(" ".join(filter(None, map(value, _local(row, "c")))) for row in _local(sheet, "row")) for sheet in _members(data, r"xl/worksheets/sheet\d+\.xml"))
    return [page for s in sheets if (page := " ".join(s.split()))]


def pdf_pages(data: bytes) -> list[str]:
    """Pages of a PDF through an optional reader."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from missing
    return [page for p in PdfReader(io.BytesIO(data)).pages if (page := " ".join((p.extract_text() or "").split()))]


BINARY_PARSERS: dict[str, Callable[[bytes], list[str]]] = {
    "txt": lambda data: virtual_pages(data.decode(errors="ignore").splitlines(), " "),
    "docx": docx_pages,
    "pptx": pptx_pages,
    "xlsx": xlsx_pages,
    "pdf": pdf_pages,
}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] = BINARY_PARSERS) -> DataFrame:
    """(path, page, text) of files with columns path and content, routed by extension; unknown kinds have no pages.

    HTML and Markdown stay in the JVM; the other kinds go through the parsers.
    """
    routed = files.select("path", "content", parser_name(F.col("path")).alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.path, i + 1, page) for r in batch.itertuples() for i, page in enumerate(parsers[r.kind](bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    binary = routed.where(F.col("kind").isin(*parsers)).mapInPandas(run, PAGES)
    body = F.decode("content", "UTF-8")
    html = F.when(F.col("kind") == "md", X.markdown_html(body)).otherwise(body)
    native = routed.where(F.col("kind").isin("md", "html")).select("path", F.lit(1).alias("page"), F.array_join(X.html_sections(html), "\n\n").alias("text")).where("text <> ''")
    return binary.union(native)


def text_pages(text: Column) -> Column:
    """Virtual pages of a text column, as for text files."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: virtual_pages((t or "").splitlines(), " "))

    return run(text)


def decoded(data: Column) -> Column:
    """Bytes as text: UTF-8 in the JVM, other encodings by a helper for the rows that need it."""

    @F.pandas_udf("string")
    def other(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else decode_text(bytes(b)))

    return F.coalesce(F.try_validate_utf8(data.cast("string")), other(F.when(~F.is_valid_utf8(data.cast("string")), data)))
