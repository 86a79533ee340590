"""Builders of training sets: retrieval-augmented variants, preference pairs, quotas and features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import ordered
from corpusloom.sources.shared import cut

#: Quotas that are broadcast.
MOST_QUOTAS = 10_000


def joined_chunks(chunks: Column) -> Column:
    """Blocks of (id, text) structs in order, blank ones left out."""
    kept = F.filter(chunks, lambda c: F.trim(c["text"]) != "")
    return F.array_join(F.transform(kept, lambda c: F.concat(F.lit("Фрагмент "), F.lit(X.CITATION_MARKER), c["id"].cast("string"), F.lit("]:\n"), F.trim(c["text"]))), "\n\n")


def ids(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c["id"])


def variant(seeds: DataFrame, name: str, chunks: Column, output: Column) -> DataFrame:
    """Rows of one variant of retrieval-augmented samples."""
    return seeds.select("seed_id", "instruction", output.alias("output"), joined_chunks(chunks).alias("context"), F.lit(name).alias("variant"), ids(chunks).alias("chunk_ids"))


def relevant(seeds: DataFrame) -> DataFrame:
    """Seeds whose own chunk was retrieved, with what was retrieved."""
    return variant(seeds.where(F.array_contains(ids(F.col("retrieved")), F.col("chunk_id"))), "relevant", F.col("retrieved"), F.col("output"))


def irrelevant(seeds: DataFrame, pool: Column) -> DataFrame:
    return variant(seeds, "irrelevant", pool, F.lit(X.IRRELEVANT_REFUSAL))


def partial(seeds: DataFrame, pool: Column) -> DataFrame:
    """The seed's chunk before the distractors, the answer with a cautious beginning."""
    own = F.array(F.struct(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text")))
    return variant(seeds, "partial", F.concat(own, pool), F.concat(F.lit(X.PARTIAL_PREFIX), "output"))


def empty(seeds: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<id: bigint, text: string>>")
    return variant(seeds, "empty", none, X.strip_citations(F.col("output")))


def apportion(shares: DataFrame, total: int) -> DataFrame:
    """Whole counts that add up to ``total`` by largest remainders, ties by order. ``shares``: name, ord, share."""
    raw = F.col("share") * total
    rows = shares.withColumn("floor", F.floor(raw).cast("int")).withColumn("rest", raw - F.floor(raw))
    by = Window.orderBy(F.desc("rest"), "ord")  # a handful of shares
    left = total - F.sum("floor").over(Window.partitionBy())
    return rows.withColumn("n", (F.col("floor") + (F.row_number().over(by) <= left).cast("int")).cast("int")).select("name", "ord", "n")


def assign_quotas(seeds: DataFrame, quotas: DataFrame, order: str) -> DataFrame:
    """Seeds in order fill the quotas one after another, where every seed suits every quota. ``quotas``: name, ord, n, a handful of rows."""
    ends = quotas.withColumn("upto", F.sum("n").over(Window.orderBy("ord"))).withColumn("from", F.col("upto") - F.col("n"))
    rows = ordered.numbered(seeds, [], [order], "__rn").withColumn("__rn", F.col("__rn") - 1)
    return rows.join(F.broadcast(ends.limit(MOST_QUOTAS)), (F.col("__rn") >= F.col("from")) & (F.col("__rn") < F.col("upto"))).drop("__rn", "from", "upto", "n", "ord")


def greedy_quotas(seeds: DataFrame, quotas: dict[str, int], order: str, buildable: dict[str, Column]) -> DataFrame:
    """(order, variant): each seed in order takes the first variant with room that can be built from it; others take none.

    Between two moments at which a variant fills up, the variants that can be built alone decide. A moment is the place of the
    seed that takes the last room: of the seeds that go to a variant from here on, the one of that rank. So the driver sees as many
    numbers as there are variants, and finds the moments one after another. Ties in ``order`` come in some order.
    """
    names = [n for n in quotas]
    pattern = F.concat(F.lit(""), *(F.when(buildable[n], "1").otherwise("0") for n in names))
    rows = cut(ordered.numbered(seeds.select(order, pattern.alias("__pattern")), [], [order], "__at"))
    patterns = [r[0] for r in rows.select("__pattern").distinct().collect()]  # at most two to the number of variants
    rooms, here, spans = dict(quotas), 1, []
    while True:
        takes = {p: next((n for n, ok in zip(names, p) if ok == "1" and rooms[n] > 0), None) for p in patterns}
        wanted = {n for n in takes.values() if n}
        if not wanted:
            break
        of = F.lit(None).cast("string")
        for p, n in takes.items():
            of = F.when(F.col("__pattern") == p, n).otherwise(of)
        rest = rows.where(F.col("__at") >= here).select(of.alias("variant"), F.col("__at").cast("double").alias("at")).where("variant IS NOT NULL")
        room = F.lit(0)
        for n in wanted:
            room = F.when(F.col("variant") == n, rooms[n]).otherwise(room)
        found = {r.variant: r for r in ordered.order_statistics(rest, ["variant"], "at", {"last": room}).collect()}
        full = {n: int(r["last"]) for n, r in found.items() if r.n >= rooms[n]}
        end = min(full.values(), default=None)
        spans += [(p, n, here, end) for p, n in takes.items() if n]
        if end is None:
            break
        taken = {r.variant: r["count"] for r in rest.where(F.col("at") <= end).groupBy("variant").count().collect()}
        rooms = {n: rooms[n] - taken.get(n, 0) for n in names}
        here = end + 1
    table = seeds.sparkSession.createDataFrame(spans, "p string, variant string, first long, last long")
    # a row a pattern and moment
    return rows.join(F.broadcast(table), (F.col("__pattern") == F.col("p")) & (F.col("__at") >= F.col("first")) & (F.col("last").isNull() | (F.col("__at") <= F.col("last")))).select(order, "variant")


def no_citation_pairs(seeds: DataFrame) -> DataFrame:
    """Preference for the answer with its citation over the same without."""
    return seeds.where(F.col("output").contains(X.CITATION_MARKER)).select("seed_id", F.col("instruction").alias("prompt"), F.col("output").alias("chosen"), X.strip_citations(F.col("output")).alias("rejected"), F.lit("no_citation").alias("strategy"))


def teacher_pairs(seeds: DataFrame, strategy: str) -> DataFrame:
    """Preference over a teacher's answer: without sources (generic) or with an invented one (hallucination)."""
    raw = X.strip(F.col("teacher"))
    rejected = X.strip_citations(raw) if strategy == "generic" else X.fake_citation(raw, F.col("seed_id"))
    return seeds.where(raw != "").select("seed_id", F.col("instruction").alias("prompt"), F.col("output").alias("chosen"), rejected.alias("rejected"), F.lit(strategy).alias("strategy"))


def lm_features(prompt: Column, response: Column, length: int, pad: int = 0) -> dict[str, Column]:
    """Token arrays cut from the left to ``length``, padded on the left; the prompt and padding have label -100."""
    both = F.concat(prompt, response)
    over = F.greatest(F.size(both) - length, F.lit(0))
    p = F.when(over >= F.size(prompt), F.array().cast("array<int>")).otherwise(F.slice(prompt, over + 1, F.size(prompt)))
    skip = F.greatest(over - F.size(prompt), F.lit(0))
    r = F.slice(response, skip + 1, F.greatest(F.size(response), F.lit(1)))
    gap = F.greatest(F.lit(length) - F.size(p) - F.size(r), F.lit(0))
    return {
        "input_ids": F.concat(F.array_repeat(F.lit(pad), gap), p, r),
        "labels": F.concat(F.array_repeat(F.lit(-100), gap + F.size(p)), r),
        "attention_mask": F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(p) + F.size(r))),
    }


def common_length(p: list, q: list) -> int:
    """Length of the longest common subsequence: a row of the table is one whole number, a bit a word of ``q``."""
    masks: dict = {}
    for i, word in enumerate(q):
        masks[word] = masks.get(word, 0) | 1 << i
    every = row = (1 << len(q)) - 1
    for word in p:
        if mask := masks.get(word):
            both = row & mask
            row = (row + both | row - both) & every
    return len(q) - row.bit_count()


def rouge_l(a: Column, b: Column) -> Column:
    """F-measure of the longest common subsequence of two word arrays; 0 where both are empty or null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q) -> float:
            p, q = [] if p is None else list(p), [] if q is None else list(q)
            return 2.0 * common_length(p, q) / (len(p) + len(q)) if len(p) + len(q) else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=float)

    return run(a, b)
