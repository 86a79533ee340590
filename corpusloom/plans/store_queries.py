"""Registered queries that write and read stores, parse archives, keep document memory, and run streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import chunks
from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.operators import evaluation as E
from corpusloom.operators import memory as M
from corpusloom.plans import ops_queries as P
from corpusloom.plans import train_queries as T
from corpusloom.plans._registry import Registry, table
from corpusloom.sources import files as S
from corpusloom.sources import sinks as K
from corpusloom.sources import stores as W
from corpusloom.streaming import ingest as I

R = Registry()
D, C, V_, EMB = "documents", "conversations", "events", "embeddings"


def add(name, build, sql=None):
    R.add(name, sql)(build)


# --- readers over archives made of the documents' lines ---
def office(kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, D).select(F.concat(F.lit("d/"), "doc_id", F.lit(f".{kind}")).alias("path"), W.office(kind, F.col("text")).alias("content"))
        return S.parse(made).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "page", F.col("text").alias("body"))

    return run


_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
add("src_docx", office("docx"))
add("src_pptx", office("pptx"), f"WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, {_SQUEEZED.format('unnest(ls)')} AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS page, body FROM l WHERE body <> ''")
add("src_xlsx", office("xlsx"), f"SELECT doc_id, 1 AS page, {_SQUEEZED.format('text')} AS body FROM documents WHERE {_SQUEEZED.format('text')} <> ''")


def src_dir(spark, sf_dir):
    """Text files in folders of a language, listed recursively by extension."""
    path = W.scratch(spark, "files")
    table(spark, sf_dir, D).select("lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("lang").text(path)
    listed = S.directory(spark, path, "*.txt")
    return listed.groupBy(F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang")).agg(F.sum("length").alias("bytes"))


add("src_dir", src_dir, "SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
_CP1251 = "CFF0E8E2E5F220"


def src_decode(spark, sf_dir):
    """UTF-8, UTF-8 with a mark, CP1251, and bytes that only Latin-1 reads."""
    digits = F.encode(F.col("doc_id").cast("string"), "UTF-8")
    kind = F.col("doc_id") % 4
    data = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(kind == 2, F.concat(F.unhex(F.lit(_CP1251)), digits)).otherwise(F.concat(F.unhex(F.lit("98")), digits))
    return table(spark, sf_dir, D).select("doc_id", S.decoded(data).alias("body"))


add("src_decode", src_decode, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN chr(65279) || text WHEN 2 THEN 'Привет ' || doc_id ELSE chr(152) || doc_id END AS body FROM documents")


def src_rebuild(spark, sf_dir):
    """The chunk table written anew from a directory, twice: the second run leaves nothing of the first."""
    path, store = W.scratch(spark, "docs"), W.scratch(spark, "chunks")
    docs = table(spark, sf_dir, D)
    for part in (docs, docs.where("doc_id % 2 = 0")):
        part.select("doc_id", "text").write.mode("overwrite").parquet(path)
        chunks = spark.read.parquet(path).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk")).where("trim(chunk) <> ''")
        chunks.write.mode("overwrite").parquet(store)
    return spark.read.parquet(store).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


add("src_rebuild", src_rebuild, "SELECT doc_id, count(*) AS chunks, CAST(sum(length(c)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents WHERE doc_id % 2 = 0) WHERE trim(c, ' ') <> '' GROUP BY doc_id")


# --- sinks ---
def sink_jsonl(spark, sf_dir):
    """Rows appended in two runs, read back whole."""
    path = W.scratch(spark, "jsonl")
    rows = table(spark, sf_dir, C).select("conv_id", "turn", "role", "text")
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        W.append_json_lines(rows.where(part), path)
    return S.json_lines(spark, path, "conv_id long, turn long, role string, text string").where("_corrupt_record IS NULL").drop("_corrupt_record")


add("sink_jsonl", sink_jsonl, "SELECT conv_id, turn, role, text FROM conversations")


def export_import(spark, sf_dir):
    path = W.scratch(spark, "export")
    e = table(spark, sf_dir, EMB)
    rows = e.select("vec_id", F.when(F.col("vec_id") % 5 > 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 7 > 0, F.concat(F.lit("text "), "vec_id")).otherwise(F.lit(" ")).alias("text"))
    K.write_json_lines(rows, path)
    return W.import_rows(spark, path, ["text", "embedding"]).select("vec_id", "text", F.size("embedding").alias("dim"))


add("sink_export_import", export_import, "SELECT vec_id, 'text ' || vec_id AS text, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id % 5 > 0 AND vec_id % 7 > 0 AND embedding IS NOT NULL")


def restored(spark, sf_dir):
    path, target = W.scratch(spark, "backup"), W.scratch(spark, "restored")
    W.backup(table(spark, sf_dir, "labels"), path, "hash-384")
    manifest = spark.read.json(f"{path}/manifest")
    # the manifest counts what is there
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data").agg(F.count("*").alias("f"), F.sum("length").alias("b"))
    good = manifest.crossJoin(F.broadcast(held)).select(((F.col("file_count") == F.col("f")) & (F.col("total_bytes") == F.col("b"))).alias("complete"), "embedder")
    return W.restore(spark, path, target, "hash-384").crossJoin(F.broadcast(good))


add("sink_backup", restored, "SELECT *, true AS complete, 'hash-384' AS embedder FROM labels")


def restore_modes(spark, sf_dir):
    """What a target with some changed rows holds after each way of restoring over it."""
    path = W.scratch(spark, "backup")
    rows = table(spark, sf_dir, "labels")
    W.backup(rows, path, "hash-384")
    out = []
    for mode, force in (("merge", False), ("replace", False), ("replace", True)):
        target = W.scratch(spark, "target")
        rows.where("doc_id % 2 = 0").withColumn("quality", F.lit(9)).write.parquet(target)
        try:
            held = W.restore(spark, path, target, "hash-384", mode, "doc_id", force)
        except ValueError:
            held = spark.read.parquet(target)
        out.append(held.select(F.lit(f"{mode}{' by force' if force else ''}").alias("mode"), "doc_id", "quality", "toxic"))
    return out[0].unionByName(out[1]).unionByName(out[2])


add("restore_modes", restore_modes, "WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE quality END AS quality, toxic FROM labels) SELECT 'merge' AS mode, * FROM l UNION ALL SELECT 'replace', * FROM l WHERE doc_id % 2 = 0 UNION ALL SELECT 'replace by force', * FROM labels")


def sha_verify(spark, sf_dir):
    """Files whose digest is the expected one are skipped: of a file a language, that of one language changes."""
    path = W.scratch(spark, "models")
    d = table(spark, sf_dir, "region").select("r_name", F.concat("r_name", F.lit(" v1")).alias("value"))
    d.write.partitionBy("r_name").text(path)
    expected = S.directory(spark, path, "*.txt").select("path", F.sha2("content", 256).alias("sha256"))
    named = lambda x: x.withColumn("path", F.regexp_extract("path", r"r_name=([^/]+)", 1))
    files = named(S.directory(spark, path, "*.txt")).withColumn("content", F.when(F.col("path") == "ASIA", F.encode(F.lit("ASIA v2\n"), "UTF-8")).otherwise(F.col("content")))
    return W.changed_files(files, named(expected)).select(F.col("path").alias("r_name"), "sha256")


add("sha_verify_skip", sha_verify, "SELECT r_name, sha256('ASIA v2' || chr(10)) AS sha256 FROM region WHERE r_name = 'ASIA'")


def audit_rows(spark, sf_dir):
    """Audit rows are appended as they come, each with its fields; none replaces another."""
    path = W.scratch(spark, "audit")
    rows = table(spark, sf_dir, V_).select("event_id", F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("props").alias("payload_json"), F.sha1(F.col("event_id").cast("string")).alias("correlation_id"))
    for n in range(2):
        rows.where(f"event_id % 2 = {n}").write.mode("append").parquet(path)
    return spark.read.parquet(path)


add("sink_audit", audit_rows, "SELECT event_id, event_type AS event, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, props AS payload_json, sha1(CAST(event_id AS VARCHAR)) AS correlation_id FROM events")


def billing(spark, sf_dir):
    """Charges once a (tenant, key), priced, summed by tenant; an unpriced kind leaves the tenant's total null."""
    prices = spark.createDataFrame([("view", 1), ("click", 2), ("purchase", 40), ("signup", 10)], "event_type string, price long")
    u = table(spark, sf_dir, V_).select("event_id", F.col("user_id").alias("tenant"), "event_type", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("key"))
    once = K.once(u, ["tenant", "key"], [F.asc("event_id")])
    priced = once.join(F.broadcast(prices), "event_type", "left")
    return priced.groupBy("tenant").agg(F.count("*").alias("charges"), F.when(F.count("price") == F.count("*"), F.sum("price")).alias("total"))


add("sink_billing", billing, "WITH u AS (SELECT event_id, user_id AS tenant, event_type, CASE WHEN event_id % 3 > 0 THEN event_type END AS key FROM events), o AS (SELECT * FROM u WHERE key IS NULL UNION ALL SELECT * FROM u WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant, key ORDER BY event_id) = 1), p(event_type, price) AS (VALUES ('view', 1), ('click', 2), ('purchase', 40), ('signup', 10)) SELECT tenant, count(*) AS charges, CASE WHEN count(price) = count(*) THEN CAST(sum(price) AS BIGINT) END AS total FROM o LEFT JOIN p USING (event_type) GROUP BY tenant")


def index(spark, sf_dir):
    """Payloads and ordered ids written apart; ids that have no payload are dropped on load."""
    path = W.scratch(spark, "index")
    e = table(spark, sf_dir, EMB)
    ids = e.select("vec_id", (F.col("vec_id") * 3 + 1).alias("position"))
    W.save_index(e.where("vec_id % 4 > 0").select("vec_id", "label", W.pack(F.col("embedding")).alias("blob")), ids, path)
    return W.load_index(spark, path, "vec_id").select("position", "vec_id", "label", F.octet_length("blob").cast("long").alias("bytes"))


add("faiss_persist", index, "SELECT vec_id * 3 + 1 AS position, vec_id, label, CAST(4 * len(embedding) AS BIGINT) AS bytes FROM embeddings WHERE vec_id % 4 > 0")
add("vec_pack", lambda s, d: table(s, d, EMB).select("vec_id", W.pack(F.col("embedding")).alias("blob")).select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), F.transform(W.unpack(F.col("blob")), lambda x: V.rounded(x.cast("double"))).alias("v")), "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM embeddings")


def feedback_export(spark, sf_dir):
    """The pairs as JSON lines, read back, each with the count that heads the export."""
    path = W.scratch(spark, "feedback")
    count = W.numbered_export(P.O.feedback_pairs(P.feedback(spark, sf_dir), P.messages(spark, sf_dir)), path)
    rows = S.json_lines(spark, path, "prompt string, chosen string, rejected string, strategy string")
    return rows.where("_corrupt_record IS NULL").select("prompt", "chosen", "rejected", "strategy").crossJoin(F.broadcast(count))


add("feedback_export", feedback_export, f"SELECT prompt, chosen, rejected, strategy, count(*) OVER () AS count FROM ({P.R.sql['ds_dpo_live']})")


def write_reports(spark, sf_dir):
    """The report as JSON and as Markdown lines, read back."""
    path = W.scratch(spark, "report")
    report = P.R.queries["agg_dataset_report"](spark, sf_dir)
    names = ("size", "duplicates", "empty", "overlong", "short")
    lines = report.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("r")).select("r.*")
    K.write_json_lines(report, f"{path}/json")
    lines.select(F.concat(F.lit("- **"), "metric", F.lit("**: "), "value").alias("value")).write.text(f"{path}/md")
    size = spark.read.json(f"{path}/json").select(F.col("size").alias("rows"))
    return spark.read.text(f"{path}/md").select(F.col("value").alias("line")).crossJoin(F.broadcast(size))


add("write_reports", write_reports, f"WITH r AS ({P.R.sql['agg_dataset_report']}), l AS (UNPIVOT (SELECT size, duplicates, empty, overlong, short FROM r) ON COLUMNS(*) INTO NAME metric VALUE value) SELECT '- **' || metric || '**: ' || value AS line, (SELECT size FROM r) AS rows FROM l")


def load_examples(spark, sf_dir):
    """Aliased fields of JSON lines with their line's number; broken and empty rows are told apart from good ones."""
    rows = table(spark, sf_dir, V_).select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).when(F.col("event_id") % 13 == 0, F.lit('{"question": " ", "answer": "x"}')).when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"question": "q '), "event_id", F.lit('", "answer": "a"}'))).otherwise(F.concat(F.lit('{"instruction": "q '), "event_id", F.lit('", "output": "a"}'))).alias("value"))
    parsed = rows.withColumn("r", F.from_json("value", "question string, instruction string, answer string, output string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    prompt, reply = F.coalesce("r.instruction", "r.question"), F.coalesce("r.output", "r.answer")
    fault = F.when(F.col("r._corrupt_record").isNotNull(), "invalid").when((F.trim(prompt) == "") | (F.trim(reply) == ""), "empty")
    return parsed.select("line", F.when(fault.isNull(), prompt).alias("instruction"), fault.alias("fault"))


add("load_examples", load_examples, "SELECT event_id AS line, CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 THEN 'q ' || event_id END AS instruction, CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 13 = 0 THEN 'empty' END AS fault FROM events")


# --- reindexing and versions ---
def versions(spark, sf_dir):
    return W.Versions(spark, "vectors", W.scratch(spark, "versions"))


def mut_reindex(spark, sf_dir):
    """Vectors from an id on are normalised anew in a new version, and the alias moves to it."""
    v = versions(spark, sf_dir)
    e = table(spark, sf_dir, EMB).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v.publish(e)
    v.publish(W.reindexed(v.table(), "vec_id", 100, F.transform("v", lambda x: x * 2), "v"))
    return v.table().select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x), 4).alias("square"))


add("mut_reindex", mut_reindex, "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * CASE WHEN vec_id >= 100 THEN 4 ELSE 1 END, 4) AS square FROM embeddings")


def mut_alias_swap(spark, sf_dir):
    """What each entry of the log shows: two versions, a roll back, and a third; an empty one and one that comes too late are refused."""
    v = versions(spark, sf_dir)
    e = table(spark, sf_dir, EMB).select("vec_id", "label")
    v.publish(e.where("label < 5"))
    v.publish(e)
    v.roll_back()
    v.publish(e.where("label >= 5"))
    for rows, after in ((e.where("false"), None), (e, 1)):
        try:
            v.publish(rows, after)
        except ValueError:
            continue
        raise AssertionError("a version was to be refused")
    shown = [v.at(x["shown"]).select(F.lit(x["entry"]).alias("entry"), F.lit(x["shown"]).alias("version"), "vec_id") for x in v.log()]
    return shown[0].union(shown[1]).union(shown[2]).union(shown[3])


add("mut_alias_swap", mut_alias_swap, "SELECT 1 AS entry, 1 AS version, vec_id FROM embeddings WHERE label < 5 UNION ALL SELECT 2, 2, vec_id FROM embeddings UNION ALL SELECT 3, 1, vec_id FROM embeddings WHERE label < 5 UNION ALL SELECT 4, 3, vec_id FROM embeddings WHERE label >= 5")

# --- document memory ---
add("is_substantial", lambda s, d: table(s, d, D).where(M.substantial(F.col("text"))).select("doc_id"), r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200")
_NAMES = lambda s, d: table(s, d, D).select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit(" Report №"), F.col("doc_id") % 40, F.lit("!"))).alias("name"))
add(
    "mut_unique_slug",
    lambda s, d: M.unique_slugs(_NAMES(s, d), "name", "doc_id").select("doc_id", "slug"),
    r"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN 'Report-' || (doc_id % 40) END AS base FROM documents),
k AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n, count(*) FILTER (WHERE base IS NULL) OVER (ORDER BY doc_id) AS u FROM b),
g AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS own FROM k),
t AS (SELECT *, max(CASE WHEN base IS NOT NULL THEN CAST(regexp_extract(own, '(\d+)$', 1) AS BIGINT) + 1 - u END) OVER (ORDER BY doc_id) AS top FROM g)
SELECT doc_id, coalesce(CASE WHEN base IS NOT NULL THEN own END, 'doc-' || (u - 1 + greatest(coalesce(top, 1), 1))) AS slug FROM t""",
)


def doc_memory(spark, sf_dir):
    """Documents with tags: some added anew, some removed, those with two tags listed."""
    rows = table(spark, sf_dir, D).select("doc_id", F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.lit(1).alias("version"))
    held = M.add(rows, rows.where("doc_id % 6 = 0").withColumn("version", F.lit(2)), "doc_id")
    held = M.remove(held, rows.where("doc_id % 10 = 0"), "doc_id")
    return M.tagged(held, ["en", "even"]).select("doc_id", "version")


add("mut_doc_memory", doc_memory, "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 AND doc_id % 10 > 0")
add(
    "mut_ingest_corpus",
    lambda s, d: M.add(table(s, d, D).where("doc_id % 2 = 0").select(F.concat("source", F.lit("/"), F.col("doc_id") % 60).alias("name"), "doc_id"), table(s, d, D).where("doc_id % 2 = 1 OR doc_id % 6 = 0").select(F.concat("source", F.lit("/"), F.col("doc_id") % 60).alias("name"), (F.col("doc_id") + 1_000_000).alias("doc_id")), "name"),
    "WITH n AS (SELECT source || '/' || (doc_id % 60) AS name, doc_id FROM documents), i AS (SELECT name, doc_id + 1000000 AS doc_id FROM n WHERE doc_id % 2 = 1 OR doc_id % 6 = 0) SELECT * FROM n WHERE doc_id % 2 = 0 AND name NOT IN (SELECT name FROM i) UNION ALL SELECT * FROM i",
)


def update_summary(spark, sf_dir):
    """A summary is saved after each answer whose length is a multiple of five, which sets the counter back; due from six messages on."""
    c = table(spark, sf_dir, C).where("role = 'assistant'")
    return M.since_summary(c.select("conv_id", "turn"), c.where("length(text) % 5 = 0").select("conv_id", "turn"), "conv_id", "turn")


add(
    "mut_update_summary",
    update_summary,
    "WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 5 = 0 AS saved FROM conversations WHERE role = 'assistant'), s AS (SELECT *, max(CASE WHEN saved THEN n END) OVER w AS f, max(CASE WHEN saved THEN turn END) OVER w AS summary FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, CAST(2 * (n - coalesce(f, 0)) AS INTEGER) AS since, summary, 2 * (n - coalesce(f, 0)) >= 6 AS due FROM s",
)


def crud(spark, sf_dir):
    """Files added, removed and given another status, then listed by tenant, newest first."""
    f = P.files(spark, sf_dir).select("id", "tenant_id", "status", "created_at")
    held = M.add(f, f.where("id % 8 = 0").withColumn("status", F.lit("queued")), "id")
    held = M.remove(held, f.where("id % 10 = 3"), "id").withColumn("status", F.when(F.col("id") % 10 == 4, "processing").otherwise(F.col("status")))
    return held.select("id", "tenant_id", "status", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "id")).alias("position"))


add("file_store_crud", crud, f"WITH {P.FILES} SELECT id, tenant_id, CASE WHEN id % 10 = 4 THEN 'processing' WHEN id % 8 = 0 THEN 'queued' ELSE status END AS status, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id) AS INTEGER) AS position FROM files WHERE id % 10 <> 3")
add(
    "docs_listing",
    lambda s, d: table(s, d, D).join(table(s, d, D).select("doc_id", F.explode(F.split("text", "\n")).alias("c")).where("trim(c) <> ''").groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").select("doc_id", "source", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)).alias("preview")),
    r"WITH c AS (SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE trim(c, ' ') <> '' GROUP BY doc_id) SELECT doc_id, source, coalesce(chunks, 0) AS chunks, left(regexp_replace(text, '\s+', ' ', 'g'), 40) AS preview FROM documents LEFT JOIN c USING (doc_id)",
)

# --- evaluation ---


def flt_empty(spark, sf_dir):
    """Items with relevant keys among every third vector."""
    e = table(spark, sf_dir, EMB).select("vec_id", "label")
    thirds = e.where("vec_id % 3 = 0").groupBy("label").agg(F.count("*").alias("c"))
    own = e.join(thirds, "label").select(F.col("vec_id").alias("query_id"), (F.col("c") - F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)).cast("int").alias("n"))
    return M.answerable(T.items(spark, sf_dir).select("query_id").join(own, "query_id"), "n")


add("flt_empty", flt_empty, f"{T._ITEMS} SELECT query_id, CAST(len(list_filter(relevant, lambda v: v % 3 = 0)) AS INTEGER) AS n FROM t WHERE len(list_filter(relevant, lambda v: v % 3 = 0)) > 0")
add("ev_run", lambda s, d: T.side(s, d, "base").select("query_id", F.slice("ranked", 1, 5).alias("top"), *(F.round(f"{n}_5", 6).alias(f"{n}_5") for n in E.METRICS)), f"{T._ITEMS} SELECT query_id, list_slice(keys, 1, 5) AS top, " + ", ".join(f"round({f.format(r='keys', k=5)}, 6) AS {n}_5" for n, k, f in T._ALL if k == 5) + " FROM t")


def sweep_table(spark, sf_dir):
    """A row for each top_k."""
    long = E.melt(E.aggregate(T.side(spark, sf_dir, "base"))).where("metric rlike '^(hit|recall|mrr)_[0-9]+$'")
    parts = long.select(F.regexp_extract("metric", r"_(\d+)$", 1).cast("int").alias("top_k"), F.regexp_extract("metric", r"^([a-z]+)_", 1).alias("m"), "value")
    return parts.groupBy("top_k").pivot("m", ["hit", "recall", "mrr"]).agg(F.first("value"))


add("ev_sweep_topk", sweep_table, T._ITEMS + " " + " UNION ALL ".join(f"SELECT {k} AS top_k, " + ", ".join(f"round(avg({next(f for n, q, f in T._ALL if n == m and q == k).format(r='keys', k=k)}), 6) AS {m}" for m in ("hit", "recall", "mrr")) + " FROM t" for k in E.KS))


def latency(spark, sf_dir):
    """Percentiles by nearest rank over counted values, with the verdict on a budget."""
    e = table(spark, sf_dir, V_).select("event_type", F.round("value", 2).alias("value"))
    counted = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type")
    upto = counted.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col("value")))
    return upto.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95")).withColumn("within", F.col("p95") <= 200)


add("ev_latency", latency, "SELECT event_type, quantile_disc(round(value, 2), 0.5) AS p50, quantile_disc(round(value, 2), 0.95) AS p95, quantile_disc(round(value, 2), 0.95) <= 200 AS within FROM events GROUP BY event_type")
add("gate_side", lambda s, d: E.melt(E.aggregate(T.side(s, d, "teacher"))).where("metric <> 'n'").select("metric", "value"), T._ITEMS + f", h AS (SELECT {T.mean('teacher')} FROM t) SELECT metric, value FROM (UNPIVOT h ON COLUMNS(*) INTO NAME metric VALUE value) WHERE metric <> 'n'")


def gate_decide(spark, sf_dir):
    """The metrics of two sides joined; a metric that one side lacks is an error; GO where none falls by more than 0.05."""
    base, head = (E.melt(E.aggregate(T.side(spark, sf_dir, n)), value=n).where("metric rlike '_[0-9]+$'") for n in ("base", "teacher"))
    both = base.join(head, "metric", "full")
    checked = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no value of "), "metric"))).otherwise(F.col(c))
    delta = F.round(checked("teacher") - checked("base"), 6)
    return both.select("metric", delta.alias("delta")).agg(F.min("delta").alias("worst"), F.when(F.min("delta") >= -0.05, "GO").otherwise("NO-GO").alias("decision"))


add("gate_decide", gate_decide, T._LONG + " SELECT min(round(teacher - base, 6)) AS worst, CASE WHEN min(round(teacher - base, 6)) >= -0.05 THEN 'GO' ELSE 'NO-GO' END AS decision FROM m WHERE regexp_matches(metric, '_[0-9]+$')")


def pairs_within(spark, sf_dir):
    """Ordered pairs of a query's few candidates whose scores differ by more than the margin."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_quantity").alias("q2"))
    return a.join(b, "l_orderkey").where("l_quantity - q2 > 5").select("l_orderkey", "l_linenumber", "other")


_PW = "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_quantity - b.l_quantity > 5"
add("win_pairs_within_query", pairs_within, _PW)
add("group_by_query", lambda s, d: pairs_within(s, d).groupBy("l_orderkey").agg(F.count("*").alias("pairs")).where("pairs >= 2"), f"SELECT l_orderkey, count(*) AS pairs FROM ({_PW}) GROUP BY l_orderkey HAVING count(*) >= 2")


def batches(spark, sf_dir):
    """Queries with enough pairs in batches of 32 by key; ranks come from ranges of the key, not from one task."""
    groups = R.queries["group_by_query"](spark, sf_dir).withColumn("all", F.lit(1))
    return M.running(groups, ["all"], "l_orderkey", "pairs").groupBy(F.floor((F.col("rank") - 1) / 32).cast("long").alias("batch")).agg(F.count("*").alias("queries"), F.sum("pairs").alias("pairs"), F.min("l_orderkey").alias("first"))


add("query_batches", batches, f"WITH g AS (SELECT l_orderkey, count(*) AS pairs FROM ({_PW}) GROUP BY l_orderkey HAVING count(*) >= 2) SELECT CAST(floor((rn - 1) / 32) AS BIGINT) AS batch, count(*) AS queries, CAST(sum(pairs) AS BIGINT) AS pairs, min(l_orderkey) AS first FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey) AS rn FROM g) GROUP BY 1")
add("split_warmup", lambda s, d: M.warm_up(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "l_orderkey", "n", 4, 40, 5), "SELECT l_orderkey, n, CASE WHEN row_number() OVER (ORDER BY l_orderkey) <= 5 THEN 'warmup' ELSE 'timed' END AS part FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4 ORDER BY l_orderkey LIMIT 40)")


def frozen(spark, sf_dir):
    """Normalised passages and queries written with their keys in order, and read back."""
    path = W.scratch(spark, "frozen")
    e = table(spark, sf_dir, EMB)
    rows = e.select(F.when(F.col("vec_id") % 100 == 0, "query").otherwise("passage").alias("side"), F.col("vec_id").alias("key"), W.pack(V.normalised(F.col("embedding"))).alias("blob"))
    rows.repartitionByRange(4, "side", "key").sortWithinPartitions("side", "key").write.partitionBy("side").parquet(path)
    return spark.read.parquet(path).select("side", "key", F.round(F.aggregate(W.unpack(F.col("blob")), F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")), 4).alias("square"))


add("frozen_build", frozen, "SELECT CASE WHEN vec_id % 100 = 0 THEN 'query' ELSE 'passage' END AS side, vec_id AS key, CAST(1 AS DOUBLE) AS square FROM embeddings")

# --- data sets ---
add(
    "ds_mix_corpora",
    lambda s, d: M.mixed(table(s, d, D).where("lang = 'en'"), table(s, d, D).where("lang = 'de'"), "text", "doc_id").select("side", "doc_id", "bytes"),
    "WITH b AS (SELECT CASE lang WHEN 'en' THEN 'left' ELSE 'right' END AS side, doc_id, octet_length(encode(text)) + 1 AS n FROM documents WHERE lang IN ('en', 'de')), m AS (SELECT min(n) AS budget FROM (SELECT side, sum(n) AS n FROM b GROUP BY side)) SELECT side, doc_id, CAST(n AS BIGINT) AS bytes FROM (SELECT *, sum(n) OVER (PARTITION BY side ORDER BY doc_id) AS upto FROM b), m WHERE upto <= budget",
)


def golden_structural(spark, sf_dir):
    """Per document its heading without the article's number as the question, and all its chunks as the relevant set; those without either are left out."""
    d = table(spark, sf_dir, D)
    heading = F.when(F.col("doc_id") % 7 > 0, F.split("text", "\n")[0]).otherwise("")
    title = F.concat(F.lit("Статья "), (F.col("doc_id") % 50 + 1).cast("string"), F.lit(". "), heading)
    n = F.size(chunks.windows(X.squeeze(F.col("text"))))
    keys = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt:"), i.cast("string")))
    return d.where(n > 0).select("doc_id", X.heading_query(title).alias("question"), keys.alias("relevant"), F.lit("auto").alias("origin")).where("question <> ''")


add(
    "ds_golden_structural",
    golden_structural,
    r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, regexp_replace(regexp_replace('Статья ' || (doc_id % 50 + 1) || '. ' || CASE WHEN doc_id % 7 > 0 THEN string_split(text, chr(10))[1] ELSE '' END, '^\s*Статья\s+[\d.]+\.?\s*', ''), '^\s+|\s+$', '', 'g') AS question FROM documents), "
    "n AS (SELECT doc_id, question, len(list_distinct(list_concat(range(0, greatest(length(t) - 900, 0) + 1, 760), [greatest(length(t) - 900, 0)]))) AS n FROM t WHERE length(t) > 0 AND question <> '') "
    "SELECT doc_id, question, list_transform(range(0, n), lambda i: 'd' || doc_id || '.txt:' || i) AS relevant, 'auto' AS origin FROM n",
)


def lm_batch(spark, sf_dir):
    """Windows of 16 code points from eight starts spread over the whole of each text, and the same moved by one."""
    t = table(spark, sf_dir, D).where("length(text) > 16").select("doc_id", "text", (F.length("text") - 16).alias("room"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.pmod(F.col("doc_id") * 31 + i * 7919, F.col("room")) + 1).cast("int"))
    at = t.select("doc_id", F.posexplode(F.transform(starts, lambda p: F.struct(p.alias("start"), F.substr("text", p, F.lit(16)).alias("x"), F.substr("text", p + 1, F.lit(16)).alias("y")))).alias("pos", "w"))
    return at.select("doc_id", "pos", "w.*")


add("lm_batch", lm_batch, "SELECT doc_id, CAST(i AS INTEGER) AS pos, p AS start, substr(text, p, 16) AS x, substr(text, p + 1, 16) AS y FROM (SELECT doc_id, text, i, CAST((doc_id * 31 + i * 7919) % (length(text) - 16) + 1 AS INTEGER) AS p FROM documents, range(8) r(i) WHERE length(text) > 16)")


def features(spark, sf_dir):
    """Code points of whole prompts and answers, cut from the left to 24."""
    points = lambda c: F.transform(F.split(c, ""), F.ascii)
    f = T.T.lm_features(points("instruction"), points("output"), 24)
    return T.seeds(spark, sf_dir).select("seed_id", *(c.alias(n) for n, c in f.items()))


_LM_FEATURES = r"""WITH s AS (SELECT doc_id AS seed_id, 'question ' || doc_id AS instruction, text || CASE WHEN doc_id % 4 > 0 THEN ' [doc_chunk:' || doc_id || ']' ELSE '' END AS output, doc_id AS i, CASE WHEN doc_id % 5 > 0 THEN 'answer ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' [doc_chunk:12]' ELSE '' END ELSE '' END AS teacher FROM documents), t AS (SELECT seed_id, list_transform(string_split(instruction, ''), lambda x: ascii(x)) AS p, list_transform(string_split(output, ''), lambda x: ascii(x)) AS r FROM s), u AS (SELECT seed_id, p, r, list_slice(list_concat(p, r), -24, -1) AS x, greatest(len(p) - greatest(len(p) + len(r) - 24, 0), 0) AS np, greatest(24 - len(p) - len(r), 0) AS gap FROM t) SELECT seed_id, list_concat(list_resize([]::INTEGER[], gap, 0), x) AS input_ids, list_concat(list_resize([]::INTEGER[], gap + np, -100), list_slice(x, np + 1, 24)) AS labels, list_concat(list_resize([]::INTEGER[], gap, 0), list_resize([]::INTEGER[], len(x), 1)) AS attention_mask FROM u"""
add("ds_lm_features", features, _LM_FEATURES)


# --- streams ---
def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream yields from what there is, through Parquet files; in ``complete`` mode the last batch's."""
    spark = stream.sparkSession
    base = W.scratch(spark, "stream")
    if mode == "append":
        I.to_files(stream, f"{base}/out", f"{base}/state").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    return I.last_batch(stream, f"{base}/out", f"{base}/state")


def st_idempotency(spark, sf_dir):
    """Events with repeats as a stream: the first of each (tenant, key) within the watermark stays."""
    stream = T.events_stream(spark, sf_dir).select("ts", F.col("user_id").alias("tenant"), F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("key"))
    return drained(I.idempotent(stream, ["tenant", "key"], "ts", "60 days")).select("tenant", "key")


add("st_dedup_idempotency", st_idempotency, "SELECT DISTINCT user_id AS tenant, event_type || '-' || strftime(ts, '%Y%m%d') AS key FROM events")


def st_stuck(spark, sf_dir):
    """A user's session that is silent for a day is reclaimed: when the next event comes, or by its timer."""
    return drained(I.timeouts(T.events_stream(spark, sf_dir), "user_id", "ts", 24 * 3600)).groupBy("user_id").agg(F.count("*").alias("reclaimed"))


add("st_stuck_timeout", st_stuck, "WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(ts) OVER () - INTERVAL 1 HOUR AS now FROM events) SELECT user_id, count(*) AS reclaimed FROM e WHERE next - ts > INTERVAL 1 DAY OR (next IS NULL AND ts + INTERVAL 1 DAY <= now) GROUP BY user_id")


def st_health(spark, sf_dir):
    """The last report of each reason as a running aggregate; those within 30 days of the newest count."""
    named = T.events_stream(spark, sf_dir).select("ts", F.element_at(F.array(*map(F.lit, P._reasons)), (F.col("user_id") % 4 + 1).cast("int")).alias("reason"), (F.col("event_type") != "view").alias("degraded"))
    last = drained(named.groupBy("reason").agg(F.max_by("degraded", F.struct("ts", "degraded")).alias("degraded"), F.max("ts").alias("ts")), "complete")
    newest = last.agg(F.max("ts").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where("degraded AND ts >= newest - INTERVAL 30 DAYS").select("reason", F.when(F.col("reason").isin("vector_backend_down", "embedding_dim_mismatch"), "critical").otherwise("warning").alias("severity"))


add("st_health_ttl", st_health, "WITH r AS (SELECT ts, ['vector_backend_down', 'hashing_embedder', 'embedding_dim_mismatch', 'search_truncated'][1 + user_id % 4] AS reason, event_type <> 'view' AS degraded FROM events), l AS (SELECT reason, arg_max(degraded, (ts, degraded)) AS degraded, max(ts) AS ts FROM r GROUP BY reason) SELECT reason, CASE WHEN reason IN ('vector_backend_down', 'embedding_dim_mismatch') THEN 'critical' ELSE 'warning' END AS severity FROM l WHERE degraded AND ts >= (SELECT max(ts) FROM l) - INTERVAL 30 DAY")


def st_sse(spark, sf_dir):
    """Answers as a stream of token deltas, each with its index and as an event's lines."""
    stream = I.source(spark, sf_dir, "conversations.parquet", table(spark, sf_dir, C).schema)
    deltas = stream.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("token_index", "token"))
    event = F.concat(F.lit("event: token\ndata: "), F.to_json(F.struct("token_index", "token")), F.lit("\n\n"))
    return drained(deltas.withColumn("event", event)).where("event LIKE 'event: token%'").select("conv_id", "turn", "token_index", "token")


add("st_sse", st_sse, "SELECT conv_id, turn, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS token_index, unnest(t) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations WHERE role = 'assistant')")
add("st_rate_limit", lambda s, d: drained(I.rate_limit(T.events_stream(s, d), most=2, seconds=3600)).groupBy("accepted").agg(F.count("*").alias("n")))
add("st_dedup_stream", lambda s, d: drained(I.idempotent(T.events_stream(s, d), ["event_id"], "ts", "60 days")).groupBy("event_type").agg(F.count("*").alias("n")), 'SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type')


def ingest_loop(spark, sf_dir):
    base = W.scratch(spark, "ingest")
    I.ingest(T.events_stream(spark, sf_dir), lambda b: b.select("event_id", "event_type"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


add("st_ingest_loop", ingest_loop, 'SELECT event_type, count(*) AS n FROM events GROUP BY event_type')


def st_slo(spark, sf_dir):
    levels = drained(I.service_levels(T.events_stream(spark, sf_dir)), "complete")
    return levels.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "errors")


add("st_slo", st_slo, "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
