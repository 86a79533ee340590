"""Registered queries of the scalar and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import payloads, text as X
from corpusloom.plans._registry import Registry, table

R = Registry()
D, P, C = "documents", "pages", "conversations"


def sq(x: str) -> str:
    """SQL: squeezed white space."""
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def st(x: str) -> str:
    """SQL: stripped white space."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def entities(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


R.over("str_clean", D, lambda d: d.select("doc_id", X.squeeze(F.col("text")).alias("clean")), f"SELECT doc_id, {sq('text')} AS clean FROM documents")
R.over("str_tokenize", D, lambda d: d.select("doc_id", X.word_tokens(F.col("text")).alias("tokens")), r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents")
R.over(
    "str_char_tokenize",
    D,
    lambda d: d.select("doc_id", F.length("text").cast("long").alias("n"), F.left("text", F.lit(100)).alias("truncated"), F.array_join(F.slice(X.char_tokens(F.col("text")), 1, 50), "|").alias("head")),
    "SELECT doc_id, length(text) AS n, left(text, 100) AS truncated, array_to_string(list_slice(string_split(text, ''), 1, 50), '|') AS head FROM documents",
)
_STRIP_SQL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script(?:\s[^>]*)?>.*?</script>', ' ', 'g'), '(?is)<style(?:\s[^>]*)?>.*?</style>', ' ', 'g'), '(?i)</(?:{X.BLOCK_TAGS})>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g')"
R.over("str_html_strip", P, lambda p: p.select("page_id", X.html_strip(F.col("html")).alias("body")), f"SELECT page_id, {_STRIP_SQL} AS body FROM pages")
_LINE_SQL = "array_to_string(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: CASE WHEN regexp_full_match(trim(x, ' '), '=+') THEN '' ELSE regexp_replace(x, '^ *#+ *', '') END), chr(10))"
_POST_SQL = entities(rf"regexp_replace({_LINE_SQL}, '\s+([,.;:!?])', '\1', 'g')", X.PAGE_ENTITIES)
R.over("str_html_post", P, lambda p: p.select("page_id", X.html_post(X.html_strip(F.col("html"))).alias("body")), f"WITH s AS (SELECT page_id, {_STRIP_SQL} AS body FROM pages) SELECT page_id, {_POST_SQL} AS body FROM s")
_SECTIONS_SQL = rf"""WITH s AS (SELECT page_id, {_STRIP_SQL} AS body FROM pages), t AS (SELECT page_id, {_POST_SQL} AS body FROM s),
u AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '(?m)^[ \t]+$', '', 'g'), '\n\s*\n'), lambda x: regexp_replace({sq('x')}, '\s+([,.;:!?])', '\1', 'g')), lambda x: x <> '') AS parts FROM t)
SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS section FROM u"""
R.over("str_html_sections", P, lambda p: p.select("page_id", F.posexplode(X.html_sections(F.col("html"))).alias("pos", "section")), _SECTIONS_SQL)
R.queries["src_html"], R.sql["src_html"] = R.queries["str_html_sections"], R.sql["str_html_sections"]

_MD = "'# Title ' || doc_id || chr(10) || chr(10) || 'Some **bold** and *soft* and `code` and [link](http://x) ' || text"
_MD_SQL = _MD
for _p, _b in X.MARKDOWN:
    _MD_SQL = f"regexp_replace({_MD_SQL}, '{_p}', '{_b.replace('$1', chr(92) + '1')}', 'g')"
_MD_SQL = f"'<p>' || {_MD_SQL} || '</p>'"
_md = lambda d: d.select("doc_id", X.markdown_html(F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\nSome **bold** and *soft* and `code` and [link](http://x) "), F.col("text"))).alias("html"))
R.over("str_md_fallback", D, _md, f"SELECT doc_id, {_MD_SQL} AS html FROM documents")
R.over(
    "src_md",
    D,
    lambda d: _md(d).select("doc_id", F.array_join(X.html_sections(F.col("html")), "\n\n").alias("body")),
    "WITH pages AS (SELECT doc_id AS page_id, " + _MD_SQL + " AS html FROM documents), q AS (" + _SECTIONS_SQL + ") SELECT page_id AS doc_id, string_agg(section, chr(10) || chr(10) ORDER BY pos) AS body FROM q GROUP BY page_id",
)
R.over(
    "str_ws_lines",
    D,
    lambda d: d.select("doc_id", X.clean_lines(F.concat(F.lit("12\n\n"), F.col("text"), F.lit("\n 7 "))).alias("body")),
    r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split('12' || chr(10) || chr(10) || text || chr(10) || ' 7 ', chr(10)), lambda x: trim(regexp_replace(x, '[ \t ]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+')), chr(10)) AS body FROM documents",
)
R.over("str_strip_entities", P, lambda p: p.select("page_id", X.strip_entities(F.col("html")).alias("body")), "SELECT page_id, " + entities("regexp_replace(html, '<[^>]+>', chr(10), 'g')", X.ENTITIES) + " AS body FROM pages")
_WIKI = "'== Head ==' || chr(10) || text || chr(10) || chr(10) || chr(10) || '=== Tail ===' || chr(10)"
_WIKI_SQL = st(rf"regexp_replace(regexp_replace({_WIKI}, '(?m)^\s*=={{1,}}.*?=={{1,}}\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
R.over(
    "str_wiki_clean",
    D,
    lambda d: d.select("doc_id", X.wiki_clean(F.concat(F.lit("== Head ==\n"), F.col("text"), F.lit("\n\n\n=== Tail ===\n"))).alias("body")).withColumn("is_substantial", F.length("body") >= 200),
    f"WITH s AS (SELECT doc_id, {_WIKI_SQL} AS body FROM documents) SELECT doc_id, body, length(body) >= 200 AS is_substantial FROM s",
)
R.over("str_heading_query", D, lambda d: d.select("doc_id", X.heading_query(F.concat(F.lit(" Статья "), F.col("doc_id"), F.lit(".1. "), F.col("text"))).alias("query")), "SELECT doc_id, " + st(r"regexp_replace(' Статья ' || doc_id || '.1. ' || text, '^\s*Статья\s+[\d.]+\.?\s*', '')") + " AS query FROM documents")
_NORM_Q = "regexp_replace(" + sq("lower({})") + ", '[?!.… ]+$', '')"
R.over("str_normalize_question", "benchmark", lambda b: b.select("item_id", X.normal_question(F.concat("text", F.lit(" ?! … "))).alias("q")), "SELECT item_id, " + _NORM_Q.format("text || ' ?! … '") + " AS q FROM benchmark")
R.over("str_normalize_answer", D, lambda d: d.select("doc_id", X.normal_answer(F.col("text")).alias("a")), "SELECT doc_id, regexp_replace(" + sq("lower(text)") + r", '[^\p{L}\p{N}_\s]', '', 'g') AS a FROM documents")
_CITED = "text || ' [doc_chunk:' || doc_id || '] more [doc_chunk:' || (doc_id % 1000) || ']'"
_cited = lambda: F.concat(F.col("text"), F.lit(" [doc_chunk:"), F.col("doc_id"), F.lit("] more [doc_chunk:"), F.col("doc_id") % 1000, F.lit("]"))
_STRIP_CITES = r"regexp_replace({}, '\s*\[doc_chunk:\d+\]\s*', ' ', 'g')"
R.over("str_strip_citations", D, lambda d: d.select("doc_id", X.strip_citations(_cited()).alias("body")), "SELECT doc_id, " + st(_STRIP_CITES.format(_CITED)) + " AS body FROM documents")
R.over(
    "str_trailing_citation_run",
    D,
    lambda d: d.select("doc_id", X.strip_citation_run(F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(" [1] [2] [3.1] [4] [5")).otherwise(F.lit(" [1] [2]")))).alias("body")),
    r"SELECT doc_id, regexp_replace(regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN ' [1] [2] [3.1] [4] [5' ELSE ' [1] [2]' END, '(?:\s*\[\s*\d[\d.]*\s*\]){4,}(?:\s*\[\s*\d[\d.]*)?\s*$', ''), '\s+$', '') AS body FROM documents",
)
_FAKE = "CAST(900 + CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS VARCHAR)"
R.over(
    "str_fake_citation",
    D,
    lambda d: d.select("doc_id", X.fake_citation(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(_cited()), F.col("doc_id")).alias("body")),
    f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE {_CITED} END AS t, {_FAKE} AS f FROM documents)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '\\[doc_chunk:(\\d+)\\]') THEN t || ' [doc_chunk:' || f || ']'
  WHEN CAST(regexp_extract(t, '\\[doc_chunk:(\\d+)\\]', 1) AS BIGINT) BETWEEN 900 AND 999 THEN t
  ELSE regexp_replace(t, '\\[doc_chunk:(\\d+)\\]', '[doc_chunk:' || f || ']') END AS body FROM s""",
)
_ACT = "'Вид НПА: Приказ ' || doc_id || chr(10) || 'Издатель - Минтруд' || chr(10) || 'номер: ' || doc_id || '-А/1' || chr(10) || 'Дата принятия: 0' || (1 + doc_id % 9) || '.02.2020' || chr(10) || 'редакция: ' || text"
_act = lambda: F.concat(F.lit("Вид НПА: Приказ "), F.col("doc_id"), F.lit("\nИздатель - Минтруд\nномер: "), F.col("doc_id"), F.lit("-А/1\nДата принятия: 0"), 1 + F.col("doc_id") % 9, F.lit(".02.2020\nредакция: "), F.col("text"))
_meta = lambda: F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("issuer"), F.lit("Meta office"), F.lit("is_active"), F.when(F.col("doc_id") % 2 == 0, F.lit("да")).otherwise(F.lit("no"))))
_ex = lambda p: f"nullif({st(f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 1)')}, '')"
R.over(
    "str_npa_fields",
    D,
    lambda d: d.select("doc_id", _act().alias("t"), _meta().alias("m")).select("doc_id", *(c.alias(k) for k, c in X.act_fields(F.col("t"), F.col("m")).items())),
    f"WITH s AS (SELECT doc_id, {_ACT} AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"coalesce({'CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + 'Meta office' + chr(39) + ' END, ' if k == 'issuer' else ''}{', '.join(_ex(p.replace('(?iu)', '(?i)')) for p in ps)}) AS {k}" for k, ps in X.ACT_PATTERNS.items())
    + ", CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 ELSE true END AS is_active FROM s",
)
_dates = lambda: F.when(F.col("doc_id") % 4 == 0, F.lit("31.02.2020")).when(F.col("doc_id") % 4 == 1, F.lit("bad")).when(F.col("doc_id") % 4 == 2, F.lit("15.03.2021")).otherwise(F.lit(None).cast("string"))
R.over("str_parse_date", D, lambda d: d.select("doc_id", X.act_date(_dates()).alias("day")), "SELECT doc_id, try_strptime(CASE doc_id % 4 WHEN 0 THEN '31.02.2020' WHEN 1 THEN 'bad' WHEN 2 THEN '15.03.2021' END, '%d.%m.%Y') AS day FROM documents")
R.over("str_slug", D, lambda d: d.select("doc_id", X.slug(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.col("doc_id")).alias("slug")), "SELECT doc_id, regexp_replace(" + st("' ' || text || ' '") + r", '\s+', '_', 'g') || '__a' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS slug FROM documents")
R.over(
    "str_title",
    D,
    lambda d: d.select("doc_id", X.derive_title(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n # "), F.col("text"))).otherwise(F.col("text")), F.concat(F.lit("dir/"), F.col("source"), F.lit(".v1.md"))).alias("title")),
    r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN " + st("string_split(text, chr(10))[1]") + r" ELSE source || '.v1' END AS title FROM documents",
)
_SNIP = "CASE WHEN length(t) > 400 THEN regexp_replace(left(t, 400), ' [^ ]*$', '') || '…' ELSE t END"
R.over("str_snippet", D, lambda d: d.select("doc_id", X.snippet(F.col("text")).alias("snippet")), f"WITH s AS (SELECT doc_id, {st('text')} AS t FROM documents) SELECT doc_id, {_SNIP} AS snippet FROM s")
R.over("str_sha256", D, lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha2(F.concat_ws(":", "source", "doc_id", F.length("text")), 256).alias("page_sha")), "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha256(source || ':' || doc_id || ':' || length(text)) AS page_sha FROM documents")


def role_format(df):
    """One transcript per conversation, a line for each turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return df.groupBy("conv_id").agg(F.array_join(turns, "\n").alias("transcript"))


R.over("str_role_format", C, role_format, "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
R.over(
    "str_prompts",
    C,
    lambda c: c.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Фрагменты базы знаний:\n"), F.col("text"), F.lit("\n\nВопрос пользователя: "), "text", F.lit("\nОтвет:")).alias("prompt"), F.concat(X.role_label(F.col("role")), F.lit(": "), X.snippet(F.col("text"), 1000)).alias("history")),
    f"WITH s AS (SELECT *, {st('text')} AS b FROM conversations WHERE role = 'user') SELECT conv_id, turn, 'Фрагменты базы знаний:' || chr(10) || text || chr(10) || chr(10) || 'Вопрос пользователя: ' || text || chr(10) || 'Ответ:' AS prompt, 'Пользователь: ' || CASE WHEN length(b) > 1000 THEN regexp_replace(left(b, 1000), ' [^ ]*$', '') || '…' ELSE b END AS history FROM s",
)
R.over(
    "str_e5_prefix",
    D,
    lambda d: d.select("doc_id", X.e5_prefix(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("query")).otherwise(F.lit("passage")), F.when(F.col("doc_id") % 3 == 0, F.lit("bge")).otherwise(F.lit("multilingual-E5-small")), F.col("doc_id") % 5 != 0).alias("t")),
    "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'query' ELSE 'passage' END || ': ' || text ELSE text END AS t FROM documents",
)
_qa = lambda: F.concat(F.lit('Sure! ```json\n[{"instruction": " Q'), F.col("doc_id"), F.lit(' ", "output": "A ]} [doc_chunk:1]", "input": null}, {"instruction": "only"}]\n``` bye'))
R.over("json_parse_qa", D, lambda d: d.select("doc_id", F.explode(payloads.parse_qa(_qa())).alias("qa")).select("doc_id", "qa.*"), "SELECT doc_id, 'Q' || doc_id AS instruction, 'None' AS input, 'A ]} [doc_chunk:1]' AS output FROM documents")
_verdict = lambda: F.concat(F.lit('Verdict: {"faithfulness": '), F.col("doc_id") % 9, F.lit('.5, "relevance": 3, "completeness": "x"} done'))
R.over(
    "json_parse_verdict",
    D,
    lambda d: d.select("doc_id", X.verdict_payload(_verdict()).alias("p")).select("doc_id", *(X.verdict_score(F.col("p"), k).alias(k) for k in ("faithfulness", "relevance", "completeness"))).withColumn("norm", (F.col("faithfulness") - 1) / 4.0),
    "WITH s AS (SELECT doc_id, CAST(greatest(least(round_even(doc_id % 9 + 0.5, 0), 5), 1) AS INTEGER) AS faithfulness FROM documents) SELECT doc_id, faithfulness, 3 AS relevance, 1 AS completeness, (faithfulness - 1) / 4.0 AS norm FROM s",
)
_golden = lambda: F.concat(F.lit('{"instruction": "q'), F.col("item_id"), F.lit('", "meta": {'), F.when(F.col("item_id") % 3 == 0, F.lit('"relevant_chunks": ["a:1", "b:2"]')).when(F.col("item_id") % 3 == 1, F.lit('"relevant_chunk_ids": [4, 5]')).otherwise(F.lit('"source_chunk_id": 7')), F.lit("}}"))


def golden(df):
    """The three generations of keys of a golden item: composite keys, chunk ids, one source id."""
    meta = F.from_json(_golden(), "instruction string, meta struct<relevant_chunks: array<string>, relevant_chunk_ids: array<long>, source_chunk_id: long>")
    keys = F.coalesce(F.col("g.meta.relevant_chunks"), F.col("g.meta.relevant_chunk_ids").cast("array<string>"), F.array(F.col("g.meta.source_chunk_id").cast("string")))
    return df.select("item_id", meta.alias("g")).select("item_id", F.col("g.instruction").alias("question"), keys.alias("keys"))


R.over("json_golden", "benchmark", golden, "SELECT item_id, 'q' || item_id AS question, CASE item_id % 3 WHEN 0 THEN ['a:1', 'b:2'] WHEN 1 THEN ['4', '5'] ELSE ['7'] END AS keys FROM benchmark")
R.over("field_alias_pick", D, lambda d: d.select("doc_id", X.pick(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")), F.when(F.col("doc_id") % 3 == 0, F.lit(" q ")), F.col("lang")).alias("v")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'q' ELSE lang END AS v FROM documents")
R.over(
    "num_clamps",
    D,
    lambda d: d.select("doc_id", F.greatest(F.lit(100), F.least(F.col("n_chars") * 1000, F.lit(1_000_000))).alias("hard_limit"), X.clamp(F.when(F.col("doc_id") % 2 == 0, F.lit("x")).otherwise(F.col("doc_id").cast("string")), 1, 200, 20).alias("k")),
    "SELECT doc_id, greatest(100, least(n_chars * 1000, 1000000)) AS hard_limit, CASE WHEN doc_id % 2 = 0 THEN 20 ELSE CAST(greatest(1, least(doc_id, 200)) AS INTEGER) END AS k FROM documents",
)


@R.add(
    "num_cost",
    "WITH p(provider, model, a, b) AS (VALUES " + ", ".join(f"('{p}', '{m}', {a}, {b})" for p, m, a, b in X.PRICES) + """), s AS (SELECT doc_id, ['openai', 'groq', 'none'][1 + doc_id % 3] AS provider, ['gpt-4o-mini', 'llama-3.3-70b-versatile', 'x'][1 + doc_id % 3] AS model, greatest(1, CAST(floor(n_chars / 4.0) AS BIGINT)) AS tokens FROM documents)
SELECT doc_id, round(((tokens + 200) * a + 200 * b) / 1000000.0, 9) AS cost FROM s LEFT JOIN p USING (provider, model)""",
)
def num_cost(spark, sf_dir):
    prices = spark.createDataFrame(X.PRICES, "provider string, model string, a double, b double")  # four rows
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, D).select("doc_id", pick("openai", "groq", "none").alias("provider"), pick("gpt-4o-mini", "llama-3.3-70b-versatile", "x").alias("model"), X.tokens_of(F.col("n_chars")).alias("tokens"))
    cost = ((F.col("tokens") + 200) * F.col("a") + X.OUTPUT_TOKENS["single"] * F.col("b")) / 1_000_000
    return docs.join(F.broadcast(prices), ["provider", "model"], "left").select("doc_id", F.round(cost, 9).alias("cost"))


R.queries["join_price"], R.sql["join_price"] = R.queries["num_cost"], R.sql["num_cost"]


@R.add("num_lr", "SELECT i AS step, round(CASE WHEN i < 100 THEN 0.0003 * (i + 1) / 100.0 WHEN i >= 2000 THEN 0.00003 ELSE 0.00003 + 0.5 * 0.00027 * (1 + cos(pi() * (i - 100) / 1900.0)) END, 12) AS lr FROM range(2100) t(i)")
def num_lr(spark, sf_dir):
    return spark.range(2100).select(F.col("id").alias("step"), F.round(X.learning_rate(F.col("id"), 100, 2000, 3e-4, 3e-5), 12).alias("lr"))


R.over("num_soft_label", "embeddings", lambda e: e.select("vec_id", F.round(X.soft_label(F.col("embedding")[0].cast("double") * 3), 9).alias("p")), "SELECT vec_id, round(CASE WHEN x BETWEEN 0 AND 1 THEN x ELSE 1 / (1 + exp(-x)) END, 9) AS p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 3 AS x FROM embeddings)")
