"""The pipeline's stages on nulls, empty and long texts, repeated rows, an empty table and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHES = ("score", "__score", "size", "taken", "ids", "decoded", "n_tokens", "fp", "component_id", "h", "row", "v", "shard", "pos", "line")


def strange(spark):
    text = "A long and plain sentence about the river and the town in which nothing else is said, told once more for the length of it. " * 6
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + "And an end.", "en", "b"), (3, None, "de", "a"), (4, "", None, None), (5, "One word", "fr", "b"), (None, text.replace("river", "lake"), "en", None), (6, "word " * 200_000, "en", "a"), (7, "x" * 300_000, "es", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return docs.withColumns({c: F.lit(f"kept {c}") for c in CLASHES})


def test_stages_on_strange_rows(spark):
    docs = strange(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES), name
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None), name
            docs = out
        else:
            assert all(r.n_tokens == len(r.ids) for r in rows)


def test_each_stage_on_all_strange_rows(spark):
    """Each stage by itself, so that the classifier's choice hides nothing from the others."""
    docs = strange(spark)
    stages = dict(corpus_pipeline.STAGES)
    dedup = stages["line dedup"](spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in dedup) == sorted((r.doc_id or 0) for r in docs.select("doc_id").collect())
    kept = stages["SimHash near-dedup"](spark, docs, SF).collect()
    # one of the repeated row, and one of the null and the empty text
    assert sum(r.doc_id == 1 for r in kept) <= 1 and sum(not r.text for r in kept) == 1
    coded = stages["byte-level BPE encoding and decoding"](spark, docs, SF).collect()
    assert len(coded) == docs.count() and all(r.n_tokens == 0 for r in coded if r.doc_id in (3, 4))
    mixed = stages["mixing sources to target weights"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.where("text IS NULL OR text = ''").count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_an_empty_table(spark, k):
    docs = strange(spark).where("false")
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0
