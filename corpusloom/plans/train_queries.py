"""Registered queries of evaluation, dataset building and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import datasets as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import ordered as B
from corpusloom.plans import ops_queries as P
from corpusloom.plans import search_queries as Q
from corpusloom.plans._registry import Registry, table
from corpusloom.streaming import ingest as I

R = Registry()


def add(name, build, sql=None):
    R.add(name, sql)(build)


# --- evaluation items: a query's neighbours by cosine; relevant are the vectors of its label ---
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked keys with those of them that are relevant, how many relevant ones there are, and the first of all.

    Labels are counted before they are joined: no query meets the rows of its label.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    lowest = e.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    second = e.join(lowest.select("label", "first"), "label").where("vec_id > first").groupBy("label").agg(F.min("vec_id").alias("second"))
    asked = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").join(lowest.join(second, "label", "left"), "label").where("n > 1")
    asked = asked.select("query_id", "label", (F.col("n") - 1).alias("n_relevant"), F.when(F.col("first") == F.col("query_id"), F.col("second")).otherwise(F.col("first")).alias("first"))
    judged = Q.top(spark, sf_dir, 10).join(e.withColumnRenamed("label", "own"), "vec_id").join(asked, "query_id")
    ranked = judged.groupBy("query_id", "n_relevant", "first").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", (F.col("own") == F.col("label")).alias("good")))).alias("r"))
    keys = F.transform("r", lambda x: x["vec_id"])
    scores = F.transform(keys, lambda v: (F.pmod(v * 37, F.lit(11)) / 10.0))
    return ranked.select("query_id", F.transform(F.filter("r", lambda x: x["good"]), lambda x: x["vec_id"]).alias("relevant"), "n_relevant", "first", keys.alias("keys"), scores.alias("scores"))


def side(spark, sf_dir, name):
    ranked = F.col("keys") if name == "base" else E.reranked("keys", "scores", F.lit(10))
    return E.score(items(spark, sf_dir).withColumn("ranked", ranked), "ranked", total="n_relevant")


_ITEMS = f"""WITH r AS ({Q._RANKED.format(k=10)}), i AS (SELECT query_id, list(vec_id ORDER BY rank) AS keys, list(vec_id ORDER BY vec_id * 37 % 11 DESC, rank) AS teacher FROM r GROUP BY query_id),
l AS (SELECT q.vec_id AS query_id, list(c.vec_id) AS relevant FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id), t AS (SELECT * FROM i JOIN l USING (query_id))"""
_HIT = "CAST(CASE WHEN len(list_intersect(list_slice({r}, 1, {k}), relevant)) > 0 THEN 1 ELSE 0 END AS DOUBLE)"
_REC = "len(list_intersect(list_slice({r}, 1, {k}), relevant)) / CAST(len(relevant) AS DOUBLE)"
_MRR = "coalesce(1.0 / list_position(list_transform(list_slice({r}, 1, {k}), lambda x: list_contains(relevant, x)), true), 0.0)"
_ALL = [(n, k, f) for n, f in (("hit", _HIT), ("recall", _REC), ("mrr", _MRR)) for k in E.KS]


def mean(r: str) -> str:
    return ", ".join(f"round(avg({f.format(r=r, k=k)}), 6) AS {n}_{k}" for n, k, f in _ALL)


for _n, _f in (("hit", _HIT), ("recall", _REC), ("mrr", _MRR)):
    add(f"ev_{_n}", lambda s, d, n=_n: side(s, d, "base").select("query_id", *(F.round(f"{n}_{k}", 6).alias(f"{n}_{k}") for k in E.KS)), f"{_ITEMS} SELECT query_id, " + ", ".join(f"round({_f.format(r='keys', k=k)}, 6) AS {_n}_{k}" for k in E.KS) + " FROM t")
add("ev_score_item", lambda s, d: side(s, d, "teacher").select("query_id", *(F.round(f"{n}_{k}", 6).alias(f"{n}_{k}") for n in E.METRICS for k in E.KS)), f"{_ITEMS} SELECT query_id, " + ", ".join(f"round({f.format(r='teacher', k=k)}, 6) AS {n}_{k}" for n, k, f in _ALL) + " FROM t")
for _name in ("ev_aggregate",):
    add(_name, lambda s, d: E.aggregate(side(s, d, "base")), f"{_ITEMS} SELECT {mean('keys')} FROM t")
_SWEEP = _ITEMS + " " + " UNION ALL ".join(
    f"SELECT {c} AS candidates, '{s}' AS side, {mean('k')} FROM (SELECT relevant, {e} AS k FROM t)" for c in (3, 5, 10) for s, e in (("base", f"list_slice(keys, 1, {c})"), ("teacher", f"list_filter(teacher, lambda x: list_contains(list_slice(keys, 1, {c}), x))"))
)
for _name in ("ev_sweep_candidates",):
    add(_name, lambda s, d: E.sweep(items(s, d), [3, 5, 10], total="n_relevant"), _SWEEP)


def measured(s, d):
    return E.melt(E.aggregate(side(s, d, "base")), value="base").join(E.melt(E.aggregate(side(s, d, "teacher")), value="teacher"), "metric")


_FLOORS = [("hit_1", "floor", 0.9), ("mrr_5", "floor", 0.01), ("recall_10", "delta", 0.05), ("hit_5", "delta", -1.0), ("ndcg", "floor", 0.1)]
_LONG = _ITEMS + f", b AS (SELECT {mean('keys')} FROM t), h AS (SELECT {mean('teacher')} FROM t), m AS (SELECT * FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE base) JOIN (UNPIVOT h ON COLUMNS(*) INTO NAME metric VALUE teacher) USING (metric))"
add(
    "ev_gate_floor",
    lambda s, d: E.gate_failures(measured(s, d), s.createDataFrame(_FLOORS, "metric string, kind string, least double")),
    _LONG + ", f(metric, kind, least) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in _FLOORS) + "), v AS (SELECT metric, kind, least, round(CASE WHEN kind = 'floor' THEN coalesce(teacher, 0) ELSE coalesce(teacher, 0) - coalesce(base, 0) END, 6) AS value FROM f LEFT JOIN m USING (metric)) SELECT metric, kind, value, least FROM v WHERE value + 1e-9 < least",
)
_GATE = _ITEMS + f", b AS (SELECT {mean('keys')} FROM t), h AS (SELECT {mean('teacher')} FROM t), x AS (SELECT round(h.hit_1 - b.hit_1, 4) AS d_hit_1, round(h.mrr_5 - b.mrr_5, 4) AS d_mrr_5, round(h.recall_5 - b.recall_5, 4) AS d_recall_5 FROM b, h) SELECT *, (d_mrr_5 + 1e-9 >= 0.05 OR d_hit_1 + 1e-9 >= 0.05) AND d_recall_5 + 1e-9 >= 0 AS passed FROM x"
for _name in ("ev_gate_student",):
    add(_name, lambda s, d: E.student_gate(E.aggregate(side(s, d, "base")), E.aggregate(side(s, d, "teacher"))), _GATE)
add(
    "ev_compare",
    lambda s, d: E.compare(measured(s, d).where("metric not like 'mrr%'").select("metric", F.col("base").alias("value")), measured(s, d).where("metric not like 'hit%'").select("metric", F.col("teacher").alias("value"))),
    _LONG + " SELECT metric, a, b, round(b - a, 6) AS delta FROM (SELECT metric, base AS a FROM m WHERE metric NOT LIKE 'mrr%') FULL JOIN (SELECT metric, teacher AS b FROM m WHERE metric NOT LIKE 'hit%') USING (metric)",
)
add("eval_answerable_filter", lambda s, d: items(s, d).where("n_relevant > 0").select("query_id"), f"{_ITEMS} SELECT query_id FROM t WHERE len(relevant) > 0")
add("join_label_cut", lambda s, d: items(s, d).select("query_id", F.arrays_overlap(F.slice("keys", 1, 3), "relevant").alias("cut")), f"{_ITEMS} SELECT query_id, len(list_intersect(list_slice(keys, 1, 3), relevant)) > 0 AS cut FROM t")
add(
    "ev_generation",
    lambda s, d: table(s, d, "labels").agg(F.round(F.avg(F.when(F.col("toxic") == 0, (F.col("quality") * 4 + 1 - 1) / 4.0)), 6).alias("judge"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("quality").cast("double"))), 6).alias("refusal_correct"), F.count_if(F.col("toxic") == 0).alias("n_answerable"), F.count_if(F.col("toxic") == 1).alias("n_refusal")),
    "SELECT round(avg(CASE WHEN toxic = 0 THEN quality * 4 / 4.0 END), 6) AS judge, round(avg(CASE WHEN toxic = 1 THEN quality END), 6) AS refusal_correct, count(*) FILTER (WHERE toxic = 0) AS n_answerable, count(*) FILTER (WHERE toxic = 1) AS n_refusal FROM labels",
)


# --- seeds: user questions with the answer that follows, the chunk it is from, and what a search found ---
def seeds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = F.col("doc_id")
    hit = lambda k: F.struct((own + k).alias("id"), F.concat(F.lit(" chunk "), own + k).alias("text"))
    found = F.when(own % 3 == 0, F.array(hit(1), hit(2))).otherwise(F.array(hit(1), hit(0)))
    return d.select(own.alias("seed_id"), F.concat(F.lit("question "), own).alias("instruction"), F.concat(F.col("text"), F.when(own % 4 > 0, F.concat(F.lit(" [doc_chunk:"), own, F.lit("]"))).otherwise("")).alias("output"), own.alias("chunk_id"), F.concat(F.lit("own "), own).alias("chunk_text"), found.alias("retrieved"), F.when(own % 5 > 0, F.concat(F.lit("answer "), own, F.when(own % 2 == 0, " [doc_chunk:12]").otherwise(""))).otherwise(" ").alias("teacher"))


_SEEDS = "s AS (SELECT doc_id AS seed_id, 'question ' || doc_id AS instruction, text || CASE WHEN doc_id % 4 > 0 THEN ' [doc_chunk:' || doc_id || ']' ELSE '' END AS output, doc_id AS i, CASE WHEN doc_id % 5 > 0 THEN 'answer ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' [doc_chunk:12]' ELSE '' END ELSE '' END AS teacher FROM documents)"
_BLOCK = "'Фрагмент [doc_chunk:' || ({n}) || ']:' || chr(10) || '{p} ' || ({n})"
_NL = " || chr(10) || chr(10) || "


def pool():
    return F.array(*(F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(f"far {i}").alias("text")) for i in (900, 901)))


_FAR = _NL.join(_BLOCK.format(n=i, p="far") for i in (900, 901))
_OUT = r"regexp_replace(regexp_replace({}, '\s*\[doc_chunk:\d+\]\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')"
add("ds_rag_relevant", lambda s, d: T.relevant(seeds(s, d)), f"WITH {_SEEDS} SELECT seed_id, instruction, output, {_BLOCK.format(n='i + 1', p='chunk')}{_NL}{_BLOCK.format(n='i', p='chunk')} AS context, 'relevant' AS variant, [i + 1, i] AS chunk_ids FROM s WHERE i % 3 > 0")
add("ds_rag_irrelevant", lambda s, d: T.irrelevant(seeds(s, d), pool()), f"WITH {_SEEDS} SELECT seed_id, instruction, '{X.IRRELEVANT_REFUSAL}' AS output, {_FAR} AS context, 'irrelevant' AS variant, [900, 901] AS chunk_ids FROM s")
add("ds_rag_partial", lambda s, d: T.partial(seeds(s, d), pool()), f"WITH {_SEEDS} SELECT seed_id, instruction, '{X.PARTIAL_PREFIX}' || output AS output, {_BLOCK.format(n='i', p='own')}{_NL}{_FAR} AS context, 'partial' AS variant, [i, 900, 901] AS chunk_ids FROM s")
add("ds_rag_empty", lambda s, d: T.empty(seeds(s, d)), f"WITH {_SEEDS} SELECT seed_id, instruction, {_OUT.format('output')} AS output, '' AS context, 'empty' AS variant, [] AS chunk_ids FROM s")
add("ds_negative_pool", lambda s, d: table(s, d, "documents").where("source <> 'src0'").orderBy("doc_id").limit(50).select("doc_id"), "SELECT doc_id FROM documents WHERE source <> 'src0' ORDER BY doc_id LIMIT 50")
add("ds_dpo_no_citation", lambda s, d: T.no_citation_pairs(seeds(s, d)), f"WITH {_SEEDS} SELECT seed_id, instruction AS prompt, output AS chosen, {_OUT.format('output')} AS rejected, 'no_citation' AS strategy FROM s WHERE contains(output, '[doc_chunk:')")
add("ds_dpo_generic", lambda s, d: T.teacher_pairs(seeds(s, d), "generic"), f"WITH {_SEEDS} SELECT seed_id, instruction AS prompt, output AS chosen, {_OUT.format('teacher')} AS rejected, 'generic' AS strategy FROM s WHERE teacher <> ''")
_FK = "CAST(900 + CAST('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS VARCHAR)"
add("ds_dpo_hallucination", lambda s, d: T.teacher_pairs(seeds(s, d), "hallucination"), f"WITH {_SEEDS} SELECT seed_id, instruction AS prompt, output AS chosen, 'answer ' || i || ' [doc_chunk:' || {_FK} || ']' AS rejected, 'hallucination' AS strategy FROM s WHERE teacher <> ''")
_SHARES = [("relevant", 0, 0.55), ("irrelevant", 1, 0.15), ("partial", 2, 0.15), ("empty", 3, 0.15)]


def shares(spark):
    return spark.createDataFrame(_SHARES, "name string, ord int, share double")


_APP = "q(name, ord, share) AS (VALUES " + ", ".join(f"('{a}', {b}, CAST({c} AS DOUBLE))" for a, b, c in _SHARES) + "), f AS (SELECT *, CAST(floor(share * 97) AS INTEGER) AS fl FROM q), c AS (SELECT name, ord, fl + CASE WHEN row_number() OVER (ORDER BY share * 97 - fl DESC, ord) <= 97 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS n FROM f)"
add("win_apportion", lambda s, d: T.apportion(shares(s), 97), f"WITH {_APP} SELECT name, ord, n FROM c")
add("win_quota_assign", lambda s, d: T.assign_quotas(table(s, d, "benchmark").select("item_id"), T.apportion(shares(s), 37), "item_id").select("item_id", "name"), f"WITH {_APP.replace('97', '37')}, e AS (SELECT name, sum(n) OVER (ORDER BY ord) AS upto, n FROM c), s AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rn FROM benchmark) SELECT item_id, name FROM s JOIN e ON rn < upto AND rn >= upto - n")
add("win_quota_greedy", lambda s, d: T.greedy_quotas(seeds(s, d), {"relevant": 20, "irrelevant": 10, "empty": 10}, "seed_id", {"relevant": F.col("seed_id") % 3 > 0, "irrelevant": F.lit(True), "empty": F.lit(True)}))


add("agg_rouge_l", lambda s, d: P.O.preceding_question(P.messages(s, d)).where("question is not null").select("message_id", F.round(T.rouge_l(X.word_tokens(F.col("text")), X.word_tokens(F.col("question"))), 6).alias("rouge_l")))
add(
    "ds_qa_filter",
    lambda s, d: seeds(s, d).where(~X.is_refusal(F.col("output")) & F.length(X.strip(F.col("instruction"))).between(10, 200) & F.length(X.strip(F.col("output"))).between(30, 2000)).select("seed_id"),
    f"WITH {_SEEDS} SELECT seed_id FROM s WHERE length(instruction) BETWEEN 10 AND 200 AND length(regexp_replace(output, '^\\s+|\\s+$', '', 'g')) BETWEEN 30 AND 2000",
)
add("ds_rerank_pairs", lambda s, d: Q.top(s, d, 5).join(table(s, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score"), f"WITH r AS ({Q._RANKED.format(k=5)}) SELECT query_id, vec_id, score FROM r WHERE query_id NOT IN (SELECT item_id FROM benchmark)")
add("ds_mrtydi_pairs", lambda s, d: items(s, d).select("query_id", F.explode(F.concat(F.array(F.struct(F.col("first").alias("vec_id"), F.lit(1).alias("y"))), F.transform(F.slice(F.array_except("keys", "relevant"), 1, 3), lambda v: F.struct(v.alias("vec_id"), F.lit(0).alias("y"))))).alias("p")).select("query_id", "p.*"), f"{_ITEMS}, n AS (SELECT query_id, list_slice(list_filter(keys, lambda x: NOT list_contains(relevant, x)), 1, 3) AS neg, list_min(relevant) AS pos FROM t) SELECT query_id, pos AS vec_id, 1 AS y FROM n UNION ALL SELECT query_id, unnest(neg), 0 FROM n")
add("articles_to_queries", lambda s, d: seeds(s, d).select("seed_id", X.heading_query(F.concat(F.lit("Статья 1. "), F.when(F.col("seed_id") % 2 == 0, F.col("chunk_text")).otherwise(""))).alias("q")).where("q <> ''"), f"WITH {_SEEDS} SELECT seed_id, 'own ' || seed_id AS q FROM s WHERE seed_id % 2 = 0")
_ordered = "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents"


def lm_split(s, d):
    rows = B.with_count(B.numbered(table(s, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "rn"), ["source"])
    return rows.select("doc_id", F.when(F.col("rn") > F.col("n") - F.floor(F.col("n") * 0.05), "val").otherwise("train").alias("part"))


add("lm_split", lm_split, f"SELECT doc_id, CASE WHEN rn > n - floor(n * 0.05) THEN 'val' ELSE 'train' END AS part FROM ({_ordered})")


# --- streams: each runs what there is and returns it as a table ---
def events_stream(spark, sf_dir):
    stream = I.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # files without a time zone


