"""Stores in files: scratch folders, JSON lines, packed vectors, backups with manifests, versioned tables behind an alias."""

from __future__ import annotations

import io
import json
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import shared, sinks


def scratch(spark: SparkSession, name: str) -> str:
    """The name of a new folder for files in the folder that driver and executors share."""
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- JSON lines ---
def append_json_lines(df: DataFrame, path: str) -> None:
    """Add rows; Spark's commit protocol shows all of them or none."""
    df.write.mode("append").json(path)


def numbered_export(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines and return the count that heads the export."""
    sinks.write_json_lines(df, path)
    return df.sparkSession.read.text(path).agg(F.count("*").alias("count"))


# --- vectors as blobs of 32-bit floats ---
@F.arrow_udf(T.BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        lists = batch.cast(pa.list_(pa.float32()))
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<f4")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(size)]) * 4
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes())])
        yield pc.if_else(lists.is_valid(), blobs, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unpacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        blobs = batch.cast(pa.large_binary())
        size = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False) // 4
        flat = np.frombuffer(b"".join(b for b in pc.drop_null(blobs).to_pylist()), "<f4")
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(blobs.is_null().to_numpy(zero_copy_only=False), False))
        yield pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))


def pack(vector: Column) -> Column:
    """Little-endian 32-bit floats side by side; null stays null."""
    return _packed(vector)


def unpack(blob: Column) -> Column:
    return _unpacked(blob)


# --- export and import, backups ---
def import_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Exported JSON lines; rows that lack a required value, or have an empty one, are skipped."""
    rows = spark.read.json(path)
    for name in required:
        held = F.size(name) > 0 if dict(rows.dtypes)[name].startswith("array") else F.trim(name) != ""
        rows = rows.where(F.col(name).isNotNull() & held)
    return rows


def backup(df: DataFrame, path: str, embedder: str) -> None:
    """The rows and, beside them, a manifest read back from the files written."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    manifest = files.agg(F.count("*").alias("file_count"), F.sum("length").alias("total_bytes")).withColumn("embedder", F.lit(embedder))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, target: str, embedder: str | None, mode: str = "replace", key: str | None = None, force: bool = False) -> DataFrame:
    """Bring a backup's rows to ``target`` and return what is there then.

    ``replace`` overwrites the target; one that holds rows only with ``force``. ``merge`` adds the rows whose ``key`` the target does not
    hold (null keys: all) and leaves those that are there as they are. ``embedder`` is the target's (None: not known); another one in the backup is a warning, as the
    vectors need to be built anew.
    """
    kept = spark.read.json(f"{path}/manifest").first()
    if mode not in ("replace", "merge") or (mode == "merge" and key is None):
        raise ValueError(f"no way to restore: {mode}, key {key}")
    if embedder is not None and kept.embedder != embedder:
        warnings.warn(f"the backup was made with {kept.embedder}, the target uses {embedder}: build the vectors anew", stacklevel=2)
    rows = spark.read.parquet(f"{path}/data")
    held = spark.read.schema(rows.schema).parquet(target) if exists(spark, target) else rows.limit(0)
    if mode == "merge":
        rows.join(held.select(key), key, "left_anti").write.mode("append").parquet(target)
    else:
        if not force and not held.isEmpty():
            raise ValueError(f"{target} holds rows")
        rows.write.mode("overwrite").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def changed_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, sha256) of the files whose digest is not the expected one; equal ones need no copy."""
    now = files.select("path", F.sha2("content", 256).alias("sha256"))
    return now.join(expected.select("path", "sha256"), ["path", "sha256"], "left_anti")


# --- files by Spark's own file systems ---
def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _path(spark, path)
    return files.exists(where)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that no other writer has written; False where there is one. The text is complete before the name is
    taken: it is moved there from a name of its own, which no file system does over a file that is there."""
    files, where = _path(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        taken = files.exists(where) or not files.rename(own, where)
    except Exception as e:  # a file system may say so by an exception instead
        if "FileAlreadyExists" not in str(e):
            raise
        taken = True
    if taken:
        files.delete(own, False)
    return not taken


# --- versions behind an alias ---
class Conflict(ValueError):
    """Another writer was first."""


class Versions:
    """A table in versions under ``folder``, with a log that says which one is shown.

    The state is what the log's files say, so that any process sees the same; nothing is kept in the object. Each change is the log's next
    entry, written only if no other writer has written it. A version's number is never used twice, and its data stay as they are: a
    DataFrame got from ``table`` or ``at`` keeps its version, whatever is published later.
    """

    def __init__(self, spark: SparkSession, alias: str, folder: str):
        self.spark, self.alias, self.folder = spark, alias, folder

    def log(self) -> list[dict]:
        """Entries in order: entry, action, version, shown and the folder of the version's data."""
        if not exists(self.spark, f"{self.folder}/log"):
            return []
        rows = self.spark.read.schema("entry int, action string, version int, shown int, data string").option("pathGlobFilter", "*.json").json(f"{self.folder}/log")
        return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["entry"])  # an entry a change of the table

    @property
    def shown(self) -> int:
        """The version that is shown, 0 before the first."""
        return self.log()[-1]["shown"] if self.log() else 0

    def _commit(self, log: list[dict], action: str, version: int, shown: int, data: str) -> None:
        entry = {"entry": len(log) + 1, "action": action, "version": version, "shown": shown, "data": data}
        if not put_if_absent(self.spark, f"{self.folder}/log/{len(log) + 1:010d}.json", json.dumps(entry) + "\n"):
            raise Conflict(f"entry {len(log) + 1} of {self.alias} is another writer's")

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Write a version, check that it has rows, and show it. Raises ``ValueError`` for an empty one and ``Conflict`` where the log
        has grown meanwhile, or since the entry ``after``; then what is shown stays, and the data are removed."""
        log, data = self.log(), f"data-{uuid.uuid4().hex}"
        if after is not None and len(log) != after:
            raise Conflict(f"{self.alias} has {len(log)} entries, not {after}")
        version = max((e["version"] for e in log), default=0) + 1
        try:
            df.write.parquet(f"{self.folder}/{data}")
            if self.spark.read.parquet(f"{self.folder}/{data}").isEmpty():
                raise ValueError(f"version {version} of {self.alias} is empty; version {log[-1]['shown'] if log else 0} stays")
            self._commit(log, "publish", version, version, data)
        except ValueError:
            files, where = _path(self.spark, f"{self.folder}/{data}")
            files.delete(where, True)
            raise
        return version

    def roll_back(self) -> int:
        """Show the version that was shown before the one that is; each call goes one further back."""
        log = self.log()
        back: list[int] = []
        for e in log:
            back = [*back, e["shown"]] if e["action"] == "publish" else back[:-1]
        if len(back) < 2:
            raise ValueError(f"{self.alias} has no version before the one shown")
        self._commit(log, "roll back", next(e["version"] for e in log if e["version"] == back[-2]), back[-2], next(e["data"] for e in log if e["version"] == back[-2]))
        return back[-2]

    def at(self, version: int) -> DataFrame:
        """The rows of a version, shown or not."""
        data = next((e["data"] for e in self.log() if e["version"] == version and e["action"] == "publish"), None)
        if data is None:
            raise ValueError(f"{self.alias} has no version {version}")
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def table(self) -> DataFrame:
        return self.at(self.shown)


def reindexed(current: DataFrame, key: str, start: int, build: Column, column: str) -> DataFrame:
    """The table with ``column`` built anew from ``start`` on; the rest keeps its values."""
    return current.withColumn(column, F.when(F.col(key) >= start, build).otherwise(F.col(column)))


# --- an index of payloads and ordered ids ---
def save_index(payloads: DataFrame, ids: DataFrame, path: str) -> None:
    payloads.write.mode("overwrite").parquet(f"{path}/payloads")
    ids.write.mode("overwrite").parquet(f"{path}/ids")


def load_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Ids in their order with payloads; ids without one are dropped."""
    return spark.read.parquet(f"{path}/ids").join(spark.read.parquet(f"{path}/payloads"), key)


# --- Office archives made of lines, as inputs for the readers ---
_PARTS = {
    "docx": ("word/document.xml", "<w:document xmlns:w='w'><w:body>{}</w:body></w:document>", "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"),
    "xlsx": ("xl/worksheets/sheet1.xml", "<worksheet><sheetData>{}</sheetData></worksheet>", "<row><c t='inlineStr'><is><t>{}</t></is></c></row>"),
}


def office_bytes(kind: str, lines: list[str]) -> bytes:
    """A minimal docx (a paragraph a line), xlsx (a row a line) or pptx (a slide a line)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        if kind == "pptx":
            for n, line in enumerate(lines):
                archive.writestr(f"ppt/slides/slide{n + 1}.xml", f"<p:sld xmlns:p='p' xmlns:a='a'><a:t>{escape(line)}</a:t></p:sld>")
        else:
            name, whole, part = _PARTS[kind]
            archive.writestr(name, whole.format("".join(part.format(escape(line)) for line in lines)))
    return out.getvalue()


def office(kind: str, text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: office_bytes(kind, (t or "").split("\n")))

    return run(text)
