"""Registered queries of sources, sinks, joins, aggregates, windows and maintenance over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import operations as O
from corpusloom.operators import ordered as B
from corpusloom.plans._registry import Registry, table
from corpusloom.sources import files as S
from corpusloom.sources import sinks as K

R = Registry()
D, C, V = "documents", "conversations", "events"
NOW = "2025-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- stand-in tables, in Spark and in SQL ---
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, D).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "queued").when(F.col("quality") == 1, "completed").otherwise("failed")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), status.alias("status"), F.col("n_chars").alias("size"), F.ceil(F.col("n_chars") / 900).cast("long").alias("chunks"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 60).alias("created_at"))


FILES = "files AS (SELECT doc_id AS id, source AS tenant_id, CASE WHEN quality IS NULL THEN 'queued' WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status, n_chars AS size, CAST(ceil(n_chars / 900.0) AS BIGINT) AS chunks, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS created_at FROM documents LEFT JOIN labels USING (doc_id))"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, V)
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return e.select(
        F.col("event_id").alias("id"), status.alias("status"), F.floor("value").cast("int").alias("priority"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("updated_at"), F.when(status.isin("completed", "failed"), F.col("ts") + F.expr("interval 2 hours")).alias("finished_at"),
        (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(None).cast("string").alias("error"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("payload"),
    )


JOBS = "jobs AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CAST(floor(value) AS INTEGER) AS priority, ts AS created_at, CAST(NULL AS TIMESTAMP) AS started_at, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS updated_at, CASE WHEN event_type NOT IN ('view', 'click') THEN ts + INTERVAL 2 HOUR END AS finished_at, CAST(event_id % 4 AS INTEGER) AS attempt, CAST(NULL AS VARCHAR) AS error FROM events)"
MID = "2024-01-08 00:00:00"


def mid():
    """A time inside the events' range, taken from the data so that every size has rows on both sides."""
    return F.lit(MID).cast("timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, C).withColumn("message_id", F.col("conv_id") * 100 + F.col("turn"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where("role = 'assistant'").withColumn("n", F.explode(F.array(*map(F.lit, range(4)))))
    return m.select(
        (F.col("message_id") * 10 + F.col("n")).alias("id"), "message_id", F.concat(F.lit("u"), F.col("n") % 2).alias("user_id"), F.when((F.col("conv_id") + F.col("turn") + F.col("n")) % 3 == 0, -1).otherwise(1).alias("rating"),
        F.when((F.col("conv_id") + F.col("n")) % 2 == 0, F.concat(F.lit("alt "), "n")).alias("alternative"), F.timestamp_seconds(1_700_000_000 + F.col("n") * 60).alias("created_at"),
    )


MESSAGES = "messages AS (SELECT *, conv_id * 100 + turn AS message_id FROM conversations)"
FEEDBACK = MESSAGES + ", feedback AS (SELECT message_id * 10 + n AS id, message_id, 'u' || (n % 2) AS user_id, CASE WHEN (conv_id + turn + n) % 3 = 0 THEN -1 ELSE 1 END AS rating, CASE WHEN (conv_id + n) % 2 = 0 THEN 'alt ' || n END AS alternative, make_timestamp((1700000000 + n * 60) * 1000000) AS created_at FROM (SELECT *, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS n FROM messages WHERE role = 'assistant'))"
# --- end of stand-in tables ---


def add(name, build, sql=None):
    R.add(name, sql)(build)


# sources
add("src_txt", lambda s, d: table(s, d, D).select("doc_id", F.posexplode(S.text_pages(F.col("text"))).alias("page", "body")).select("doc_id", "page", F.length("body").alias("n")))
add(
    "src_dispatch",
    lambda s, d: table(s, d, D).select("doc_id", S.parser_name(F.concat("source", F.element_at(F.array(*map(F.lit, [".PDF", ".htm", ".md", "", ".exe"])), (F.col("doc_id") % 5 + 1).cast("int")))).alias("parser")),
    "SELECT doc_id, ['pdf', 'html', 'md', NULL, NULL][1 + doc_id % 5] AS parser FROM documents",
)
add(
    "src_jsonl",
    lambda s, d: table(s, d, V).where("trim(props) <> ''").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.size("m").alias("n")),
    "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events WHERE trim(props) <> ''",
)
add("count_rows", lambda s, d: table(s, d, V).agg(F.count_if(F.trim("props") != "").alias("n")), "SELECT count(*) FILTER (WHERE trim(props) <> '') AS n FROM events")
add("src_hf_stream", lambda s, d: table(s, d, D).orderBy("doc_id").limit(50).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")

# sinks
_pairs = lambda s, d: table(s, d, D).select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"), "lang")
add(
    "sink_vector_upsert",
    lambda s, d: K.upsert(_pairs(s, d).where("seq % 2 = 0"), _pairs(s, d).where("seq % 3 = 0"), "sha256", "seq"),
    "WITH p AS (SELECT sha256(text) AS sha256, doc_id AS seq, lang FROM documents), i AS (SELECT * FROM p WHERE seq % 3 = 0) SELECT * FROM p WHERE seq % 2 = 0 AND sha256 NOT IN (SELECT sha256 FROM i) UNION ALL SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) = 1",
)
_usage = lambda s, d: table(s, d, V).select("event_id", F.col("user_id").alias("tenant"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("key"))
_USAGE = "WITH u AS (SELECT event_id, user_id AS tenant, CASE WHEN event_id % 3 > 0 THEN event_type END AS key FROM events) SELECT * FROM u WHERE key IS NULL UNION ALL SELECT * FROM u WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant, key ORDER BY event_id) = 1"
for _name in ("sink_usage",):
    add(_name, lambda s, d: K.once(_usage(s, d), ["tenant", "key"], [F.asc("event_id")]), _USAGE)
_LEVEL = "SELECT source, x.i // 256 AS i, md5(string_agg(d, '' ORDER BY x.i)) AS d, sum(n) AS n, sum(b) AS b, sum(s) AS s FROM {} x GROUP BY source, x.i // 256"
_MANIFEST = (
    "WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, md5(text)) - 1 AS i, md5(text) AS d, 1 AS n, octet_length(encode(text)) AS b, CAST(length(text) < 500 AS INTEGER) AS s FROM documents), "
    f"l AS ({_LEVEL.format('r')}), m AS ({_LEVEL.format('l')}) "
    "SELECT source, CAST(sum(n) AS BIGINT) AS articles, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(s) AS BIGINT) AS suspicious, md5(string_agg(d, '' ORDER BY i)) AS md5 FROM m GROUP BY source"
)
add("sink_manifest", lambda s, d: K.manifest(table(s, d, D), "source", "text", "doc_id"), _MANIFEST)
add("agg_manifest", lambda s, d: K.manifest(table(s, d, D), "lang", "text", "doc_id").agg(F.count("*").alias("sources"), F.sum("articles").alias("articles"), F.sum("bytes").alias("bytes")), "SELECT count(DISTINCT lang) AS sources, count(*) AS articles, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")

# joins
add("join_chunk_doc", lambda s, d: table(s, d, D).select("doc_id", F.explode(F.split("text", "\n")).alias("chunk")).groupBy("doc_id").agg(F.count("*").alias("n")).join(table(s, d, D).select("doc_id", "lang"), "doc_id"), "SELECT doc_id, lang, len(string_split(text, chr(10))) AS n FROM documents")
add("join_file_doc", lambda s, d: table(s, d, D).join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality").orderBy(F.desc("doc_id")), "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
add("join_feedback_msg", lambda s, d: feedback(s, d).join(messages(s, d), "message_id").select("id", "rating", "conv_id", "turn"), f"WITH {FEEDBACK} SELECT id, rating, conv_id, turn FROM feedback JOIN messages USING (message_id)")
add("join_asof_user_turn", lambda s, d: O.preceding_question(messages(s, d)).where("role = 'assistant'").select("message_id", "question"), f"WITH {MESSAGES} SELECT a.message_id, u.text AS question FROM messages a ASOF LEFT JOIN (SELECT * FROM messages WHERE role = 'user') u ON a.conv_id = u.conv_id AND a.turn > u.turn WHERE a.role = 'assistant'")
add("join_key_map", lambda s, d: table(s, d, "embeddings").join(table(s, d, D).select(F.col("doc_id").alias("vec_id"), F.concat("source", F.lit(":"), F.col("doc_id") % 7).alias("key")), "vec_id").select("vec_id", "key"), "SELECT vec_id, source || ':' || (doc_id % 7) AS key FROM embeddings JOIN documents ON vec_id = doc_id")
_src = lambda: F.when(F.col("doc_id") % 10 > 0, F.col("doc_id"))
add("join_anti_done", lambda s, d: table(s, d, D).select("doc_id", _src().alias("key")).join(table(s, d, "labels").select(F.col("doc_id").alias("key")), "key", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)")
_LINE = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '[?!.… ]+$', '')"


def leak(s, d):
    """Lines of the corpus that are no benchmark item after normalisation."""
    from corpusloom.functions.text import normal_question

    lines = table(s, d, D).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("q", normal_question(F.col("line")))
    return lines.join(table(s, d, "benchmark").select(normal_question(F.col("text")).alias("q")).distinct(), "q", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


add("join_anti_leak", leak, f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE {_LINE.format('line')} NOT IN (SELECT {_LINE.format('text')} FROM benchmark) GROUP BY doc_id")
add("golden_questions", lambda s, d: table(s, d, "benchmark").select(F.lower("text").alias("q")).distinct(), "SELECT DISTINCT lower(text) AS q FROM benchmark")
add("plan_output", lambda s, d: table(s, d, D).select("doc_id", "source").join(table(s, d, D).where("doc_id % 40 = 1").select("source").distinct(), "source", "left_anti"), "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 40 = 1)")

# aggregates
add("agg_file_stats", lambda s, d: O.file_stats(files(s, d)), f"WITH {FILES} SELECT s AS status, count(id) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks FROM (VALUES ('queued'), ('processing'), ('completed'), ('failed')) k(s) LEFT JOIN files ON status = s GROUP BY s")
add("agg_file_totals", lambda s, d: O.file_totals(files(s, d)), f"WITH {FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(created_at) AS oldest, max(created_at) AS newest, round(sum(size) / count(*), 6) AS average FROM files")
_AGE = f"greatest(epoch(TIMESTAMP '{NOW}') - epoch(created_at), 0)"
add(
    "agg_queue_metrics",
    lambda s, d: O.queue_metrics(files(s, d), now()),
    f"WITH {FILES} SELECT count(*) AS files, count(*) FILTER (WHERE status = 'queued') AS depth, CAST(max(CASE WHEN status = 'queued' THEN {_AGE} END) AS BIGINT) AS oldest_age, round(avg(CASE WHEN status = 'queued' THEN {_AGE} END), 6) AS average_age, max(created_at) AS last_activity, (SELECT list(id ORDER BY created_at DESC, id) FROM (SELECT * FROM files WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 5)) AS recent_failures FROM files",
)
add("queue_depth", lambda s, d: files(s, d).where("status = 'queued' and tenant_id = 'src1'").agg(F.count("*").alias("n")), f"WITH {FILES} SELECT count(*) AS n FROM files WHERE status = 'queued' AND tenant_id = 'src1'")
_CHILD = "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"
for _name in ("agg_child_count",):
    add(_name, lambda s, d: O.child_count(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "orders"), _CHILD)
add("agg_signature", lambda s, d: table(s, d, "embeddings").agg(F.count("*").alias("docs"), F.max("vec_id").alias("max_id"), F.countDistinct(F.size("embedding")).alias("dims")), "SELECT count(*) AS docs, max(vec_id) AS max_id, count(DISTINCT len(embedding)) AS dims FROM embeddings")
add("agg_group_ordered", lambda s, d: table(s, d, C).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.min("turn").alias("first")), "SELECT conv_id, list(role ORDER BY turn) AS roles, min(turn) AS first FROM conversations GROUP BY conv_id")
add("agg_metric_mean", lambda s, d: table(s, d, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")), "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")


def token_stats(s, d):
    """Numbers, means and interpolated quantiles of the texts' lengths by language."""
    docs = table(s, d, D).select("lang", "n_chars")
    plain = docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("top"))
    exact = B.interpolated(docs, ["lang"], "n_chars", {"median": 0.5, "p95": 0.95})
    return plain.join(exact.select(F.col("lang").alias("l"), "median", F.round("p95", 6).alias("p95")), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")


add("agg_token_stats", token_stats, "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS top FROM documents GROUP BY lang")


def nearest(s, d):
    """Order statistics by nearest rank, per group."""
    found = B.order_statistics(table(s, d, V), ["event_type"], "value", B.nearest_ranks({"p50": 0.5, "p95": 0.95}))
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


for _name in ("agg_percentile_nearest",):
    add(_name, nearest, "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
add(
    "agg_dataset_report",
    lambda s, d: table(s, d, D).agg(
        F.count("*").alias("size"), (F.count("*") - F.count_distinct(F.struct("lang", "text"))).alias("duplicates"), F.count_if(F.length("text") == 0).alias("empty"), F.count_if(F.length("text") > 8000).alias("overlong"), F.count_if(F.length("text") < 200).alias("short"), (F.count_if(F.length("text") < 200) / F.greatest(F.lit(1), F.count("*")) > 0.5).alias("mostly_short")
    ),
    "SELECT count(*) AS size, count(*) - count(DISTINCT (lang, text)) AS duplicates, count(*) FILTER (WHERE length(text) = 0) AS empty, count(*) FILTER (WHERE length(text) > 8000) AS overlong, count(*) FILTER (WHERE length(text) < 200) AS short, count(*) FILTER (WHERE length(text) < 200) / greatest(1, count(*)) > 0.5 AS mostly_short FROM documents",
)
add("agg_exact_match", lambda s, d: table(s, d, "labels").agg((F.sum((F.col("quality") == F.col("toxic")).cast("double")) / F.greatest(F.lit(1), F.count("*"))).alias("x")).select(F.round("x", 6).alias("x")), "SELECT round(sum(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) / greatest(1, count(*)), 6) AS x FROM labels")
add("agg_pearson", lambda s, d: table(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r")), "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
add("agg_cost_total", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.when(F.count_if(F.col("o_custkey") % 500 == 0) > 0, None).otherwise(F.round(F.sum("o_totalprice"), 2)).alias("total")), "SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_custkey % 500 = 0) > 0 THEN NULL ELSE round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY o_orderpriority")
add(
    "agg_metrics_counters",
    lambda s, d: table(s, d, V).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), *(F.count_if(F.col("value") <= le).alias(f"le_{le}") for le in (1, 10, 50, 100))),
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, " + ", ".join(f"count(*) FILTER (WHERE value <= {le}) AS le_{le}" for le in (1, 10, 50, 100)) + " FROM events GROUP BY event_type",
)
add(
    "agg_slo",
    lambda s, d: table(s, d, V).groupBy(F.window("ts", "5 minutes")["start"].alias("start")).agg(F.round(F.count("*") / 300.0, 6).alias("qps"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate")),
    "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, round(count(*) / 300.0, 6) AS qps, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1",
)

# windows over conversations, feedback and documents
add("win_last_n_chrono", lambda s, d: O.last_turns(table(s, d, C), 3).select("conv_id", "turn", "pos"), "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)")
add("win_latest_feedback", lambda s, d: K.latest(feedback(s, d), ["message_id", "user_id"], [F.desc("created_at"), F.desc("id")]).select("message_id", "user_id", "id", "rating"), f"WITH {FEEDBACK} SELECT message_id, user_id, id, rating FROM feedback QUALIFY row_number() OVER (PARTITION BY message_id, user_id ORDER BY created_at DESC, id DESC) = 1")
_PAIRS = f"""WITH {FEEDBACK}, r AS (SELECT *, row_number() OVER w AS rn, first_value(CASE WHEN rating = -1 AND alternative IS NOT NULL THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS older FROM feedback WINDOW w AS (PARTITION BY message_id, user_id ORDER BY created_at DESC, id DESC)),
q AS (SELECT a.message_id, a.text AS answer, u.text AS question FROM messages a ASOF JOIN (SELECT * FROM messages WHERE role = 'user') u ON a.conv_id = u.conv_id AND a.turn > u.turn),
j AS (SELECT r.*, answer, question, o.alternative AS older_alt FROM r JOIN q USING (message_id) LEFT JOIN feedback o ON o.id = r.older WHERE rn = 1)
"""
add(
    "ds_dpo_live",
    lambda s, d: O.feedback_pairs(feedback(s, d), messages(s, d)),
    _PAIRS + "SELECT question AS prompt, CASE WHEN alternative IS NOT NULL THEN alternative ELSE answer END AS chosen, CASE WHEN alternative IS NOT NULL THEN answer ELSE older_alt END AS rejected, CASE WHEN alternative IS NOT NULL THEN 'live_alt' ELSE 'live_paired' END AS strategy, CASE WHEN alternative IS NOT NULL THEN [id] ELSE [id, older] END AS feedback_ids FROM j WHERE alternative IS NOT NULL OR (rating = 1 AND older IS NOT NULL)",
)


def prev_down(s, d):
    by = Window.partitionBy("message_id", "user_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(1, Window.unboundedFollowing)
    return feedback(s, d).withColumn("older", F.first(F.when((F.col("rating") == -1) & F.col("alternative").isNotNull(), F.col("id")), ignorenulls=True).over(by)).select("id", "older")


add("win_prev_downvote", prev_down, _PAIRS.replace("q AS (", "q0 AS (", 1).split(",\nq0 AS")[0] + " SELECT id, older FROM r")
add("win_dedup_first", lambda s, d: K.latest(table(s, d, D), [F.md5("text")], [F.asc("doc_id")]).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
add("win_byte_budget", lambda s, d: B.scan(table(s, d, D).select("source", "doc_id", F.octet_length("text").cast("long").alias("b")), ["source"], ["doc_id"], {"upto": F.col("b")}).select("doc_id", (F.col("upto") - F.col("b")).alias("before")).where("before < 50000"), "SELECT doc_id, CAST(before AS BIGINT) AS before FROM (SELECT doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(text)) AS before FROM documents) WHERE before < 50000")
_LINES = "l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), b AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS upto FROM l)"


def truncated(s, d, budget=1000):
    """Whole lines of each text within a byte budget."""
    lines = table(s, d, D).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    upto = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    kept = lines.withColumn("upto", upto).where(F.col("upto") <= budget)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))


for _name in ("win_truncate_bytes",):
    add(_name, truncated, f"WITH {_LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM b WHERE upto <= 1000 GROUP BY doc_id")
_by_source = lambda s, d: B.numbered(table(s, d, D).select("source", "doc_id"), ["source"], ["doc_id"], "rn")
add("win_stride_sample", lambda s, d: _by_source(s, d).where("pmod(rn - 1 - 1, 3) = 0 and rn > 1").select("doc_id"), "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 2) % 3 = 0 AND rn > 1")
add(
    "win_multi_hop_batch",
    lambda s, d: _by_source(s, d).withColumn("batch", F.floor((F.col("rn") - 1) / 3).cast("int")).groupBy("source", "batch").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where("size(ids) >= 2"),
    "SELECT source, batch, list(doc_id ORDER BY doc_id) AS ids FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 3) AS INTEGER) AS batch FROM documents) GROUP BY ALL HAVING count(*) >= 2",
)


_MD5 = "CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT)"


def split_queries(s, d):
    """Query-disjoint halves by the order of a hash: max(1, a tenth) of the queries validate."""
    from corpusloom.functions.text import stable_number

    keys = table(s, d, C).select("conv_id").distinct()
    rows = B.with_count(B.numbered(keys.withColumn("h", stable_number(F.col("conv_id"), 1 << 32)), [], ["h", "conv_id"], "rn"), [])
    return rows.select("conv_id", F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), "val").otherwise("train").alias("part"))


add("win_split_by_query", split_queries, f"WITH k AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY {_MD5}, conv_id) AS rn FROM k) SELECT conv_id, CASE WHEN rn <= greatest(1, floor((SELECT count(*) FROM k) * 0.1)) THEN 'val' ELSE 'train' END AS part FROM r")
add("select_queries", lambda s, d: table(s, d, C).groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 4").orderBy("conv_id").limit(20).withColumn("part", F.when(F.row_number().over(Window.orderBy("conv_id")) <= 3, "warmup").otherwise("timed")), "SELECT conv_id, n, CASE WHEN row_number() OVER (ORDER BY conv_id) <= 3 THEN 'warmup' ELSE 'timed' END AS part FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 4 ORDER BY conv_id LIMIT 20)")
add(
    "win_rate_limit",
    lambda s, d: table(s, d, V).withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-59, 0))).select("event_id", "n"),
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM events",
)

# jobs and maintenance
_T = f"TIMESTAMP '{MID}'"
_CO = "coalesce(updated_at, started_at, created_at)"
add("flt_stale", lambda s, d: O.stale(jobs(s, d), mid()).select("id"), f"WITH {JOBS} SELECT id FROM jobs WHERE status = 'processing' AND {_CO} <= {_T}")
add("flt_jobs", lambda s, d: jobs(s, d).where("status = 'queued' and priority >= 50").orderBy(F.desc("created_at")).select("id", "priority"), f"WITH {JOBS} SELECT id, priority FROM jobs WHERE status = 'queued' AND priority >= 50")
add("win_dequeue", lambda s, d: O.next_job(jobs(s, d), mid()).select("id", "status", "priority"), f"WITH {JOBS} SELECT id, status, priority FROM jobs WHERE status = 'queued' OR (status = 'processing' AND {_CO} <= {_T}) ORDER BY CASE WHEN status = 'queued' THEN 0 ELSE 1 END, priority DESC, created_at, id LIMIT 1")
add("fifo_queue", lambda s, d: jobs(s, d).where("status = 'queued'").groupBy("priority").agg(F.min_by("id", F.struct("created_at", "id")).alias("first")), f"WITH {JOBS} SELECT priority, arg_min(id, (created_at, id)) AS first FROM jobs WHERE status = 'queued' GROUP BY priority")
add("mut_recover_stuck", lambda s, d: O.recover(jobs(s, d), mid(), now()).select("id", "attempt", "error", F.col("payload")["recovery_reason"].alias("reason"), F.size("payload").alias("keys")), f"WITH {JOBS} SELECT id, attempt + 1 AS attempt, 'RECOVERED_STUCK_JOB' AS error, 'RECOVERED_STUCK_JOB' AS reason, 4 AS keys FROM jobs WHERE status = 'processing' AND {_CO} <= {_T}")
add("mut_backoff", lambda s, d: O.retry(jobs(s, d), 0.5, 3), f"WITH {JOBS} SELECT id, attempt + 1 AS attempt, CASE WHEN attempt < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempt < 3 THEN 0.5 * power(2.0, attempt) END AS delay FROM jobs WHERE status = 'failed'")
add("mut_job_transition", lambda s, d: O.transition(jobs(s, d), F.when(F.col("id") % 2 == 0, "processing").otherwise("completed")).groupBy("status", "claimed").agg(F.count("*").alias("n")), f"WITH {JOBS}, t AS (SELECT status, CASE WHEN id % 2 = 0 THEN status = 'queued' ELSE status = 'processing' END AS claimed, CASE WHEN id % 2 = 0 THEN 'processing' ELSE 'completed' END AS w FROM jobs) SELECT CASE WHEN claimed THEN w ELSE status END AS status, claimed, count(*) AS n FROM t GROUP BY ALL")
add("mut_maintenance", lambda s, d: O.maintain(jobs(s, d), mid(), mid()).groupBy("status", "error").agg(F.count("*").alias("n")), f"WITH {JOBS}, k AS (SELECT CASE WHEN status = 'processing' AND updated_at < {_T} THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' AND updated_at < {_T} THEN 'STALE_PROCESSING' END AS error FROM jobs WHERE finished_at IS NULL OR finished_at >= {_T}) SELECT status, error, count(*) AS n FROM k GROUP BY ALL")
add("mut_purge_audit", lambda s, d: O.purge(table(s, d, V), "ts", mid(), 3).select("event_id"), f"SELECT event_id FROM events WHERE ts >= {_T} - INTERVAL 3 DAY")
add("flt_ttl", lambda s, d: table(s, d, V).where(F.col("ts") >= mid() - F.expr("interval 1 day")).select("event_id"), f"SELECT event_id FROM events WHERE ts >= {_T} - INTERVAL 1 DAY")
add("flt_audit", lambda s, d: table(s, d, V).where((F.col("event_type") == "error") & (F.col("ts") < mid())).select("event_id", "user_id"), f"SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < {_T}")
add("audit_page", lambda s, d: O.page(table(s, d, V).select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20, 10), "SELECT event_id, ts, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 20")
_up = lambda s, d: table(s, d, D).select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant_id"), F.md5("text").alias("sha256"))
add(
    "mut_register",
    lambda s, d: O.register(_up(s, d).where("id % 2 = 0").groupBy("tenant_id", "sha256").agg(F.min("id").alias("id")).withColumn("status", F.when(F.col("id") % 4 == 0, "failed").otherwise("completed")), _up(s, d).where("id % 3 = 0")),
    "WITH u AS (SELECT doc_id AS id, lang AS tenant_id, md5(text) AS sha256 FROM documents), c AS (SELECT tenant_id, sha256, min(id) AS known FROM u WHERE id % 2 = 0 GROUP BY ALL), i AS (SELECT tenant_id, sha256, max(id) AS id FROM u WHERE id % 3 = 0 GROUP BY ALL) SELECT tenant_id, sha256, coalesce(known, id) AS id, CASE WHEN known IS NULL THEN 'create' WHEN known % 4 = 0 THEN 'requeue' ELSE 'keep' END AS action FROM i LEFT JOIN c USING (tenant_id, sha256)",
)
add("mut_replace_pages", lambda s, d: table(s, d, "pages").where("page_id % 2 = 0").select("page_id", F.lit("old").alias("v")).join(table(s, d, "pages").where("page_id % 3 = 0").select("page_id"), "page_id", "left_anti").union(table(s, d, "pages").where("page_id % 3 = 0").select("page_id", F.lit("new"))), "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
add("mut_delete_cascade", lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
add("conversation_ownership", lambda s, d: table(s, d, V).select("event_id", "user_id").join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("own")), "user_id", "left").select("event_id", F.when(F.col("own").isNull(), "create").otherwise("open").alias("action")), "SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'create' ELSE 'open' END AS action FROM events LEFT JOIN customer ON user_id = c_custkey")
add("rolling_summary", lambda s, d: O.last_turns(table(s, d, C), 5).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), F.left(x["text"], F.lit(20)))), "\n").alias("prompt")), "SELECT conv_id, string_agg(role || ': ' || left(text, 20), chr(10) ORDER BY turn) AS prompt FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id")

# health
_reasons = ["vector_backend_down", "hashing_embedder", "embedding_dim_mismatch", "search_truncated"]


def reports(s, d):
    e = table(s, d, V)
    return e.select("event_id", "ts", F.element_at(F.array(*map(F.lit, _reasons)), (F.col("user_id") % 4 + 1).cast("int")).alias("reason"), (F.col("event_type") != "view").alias("degraded"))


_LAST = "SELECT max(ts) AS t FROM events"


def health(s, d):
    last = table(s, d, V).agg(F.max("ts")).first()[0]
    return O.health(reports(s, d), F.lit(last), 30 * 24 * 3600)


_HEALTH = f"WITH r AS (SELECT event_id, ts, ['vector_backend_down', 'hashing_embedder', 'embedding_dim_mismatch', 'search_truncated'][1 + user_id % 4] AS reason, event_type <> 'view' AS degraded FROM events), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY reason ORDER BY ts DESC, event_id DESC) = 1) SELECT reason, CASE WHEN reason = 'search_truncated' THEN 'warning' ELSE 'critical' END AS severity, CAST(floor(epoch((SELECT t FROM ({_LAST})))) - floor(epoch(ts)) AS BIGINT) AS age_s FROM l WHERE degraded"
add("retrieval_payload", lambda s, d: health(s, d).agg(F.array_sort(F.collect_list("reason")).alias("reasons"), F.max(F.when(F.col("severity") == "critical", 2).otherwise(1)).alias("level")).select(F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"), "level"), f"SELECT string_agg(reason, ',' ORDER BY reason) AS reasons, max(CASE WHEN severity = 'critical' THEN 2 ELSE 1 END) AS level FROM ({_HEALTH})")
add("iter_chunks", lambda s, d: table(s, d, D).select("doc_id", F.trim("text").alias("t")).where("t <> ''").orderBy("doc_id").select("doc_id", F.length("t").alias("n")), "SELECT doc_id, length(trim(text, ' ')) AS n FROM documents WHERE trim(text, ' ') <> ''")
