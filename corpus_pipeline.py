"""The corpus pipeline, registered as the query ``pipeline``.

Documents that the quality classifier rejects go; repeated runs of lines are deleted from the later
texts; of each group of near-duplicates one document stays; sources are mixed to their target
weights, a document once for each time it is taken; the texts that are left are coded as token ids.
Every stage but the last returns the columns of documents, whatever others than doc_id, text, lang and source there
are; the last returns doc_id, lang, source and what the coding yields.

A null text counts as an empty one: it is scored by the classifier's intercept, has no lines or ids, is a copy of any
other empty text and is never taken by the mix. Null ids and sources are values like any other, last in order.
Repeated rows are scored alike, keep the same lines, are one group of near-duplicates of which one row stays. Texts of any
length are worked through whole. An empty table gives an empty result. ``run`` writes each stage to the
checkpoint folder and goes on from there, so that no stage is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, line_dedup, mixing, quality, simhash
from corpusloom.llm._shared import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = byte_bpe.round_trip(docs, path, pattern)
    return byte_bpe.with_digests(coded).select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", delete_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
