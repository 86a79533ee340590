"""Registered queries of chunking, vectors, filters and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import bpe, chunks, text as X, vectors as V
from corpusloom.operators import retrieval as S
from corpusloom.operators import vector_index
from corpusloom.plans._registry import Registry, table
from corpusloom.plans.text_queries import sq
from corpusloom.sources import stores

R = Registry()
D, E = "documents", "embeddings"

_WIN = "list_transform(list_distinct(list_concat(range(0, greatest(length({t}) - 900, 0) + 1, 760), [greatest(length({t}) - 900, 0)])), lambda s: substr({t}, s + 1, 900))"
_WINDOWS = "SELECT doc_id, unnest(" + _WIN.format(t="t") + ") AS chunk FROM (SELECT doc_id, " + sq("text") + " AS t FROM documents) WHERE length(t) > 0"
R.over("chunk_window", D, lambda d: d.select("doc_id", F.explode(chunks.windows(X.squeeze(F.col("text")))).alias("chunk")), _WINDOWS)
R.over(
    "chunk_window_simple",
    D,
    lambda d: d.select("doc_id", F.posexplode(chunks.plain_windows(F.col("text"), 500, 100)).alias("pos", "chunk")),
    "SELECT doc_id, CAST(s / 400 AS INTEGER) AS pos, substr(text, CAST(s AS BIGINT) + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 500 + 399, 0) + 1, 400)) AS s FROM documents WHERE length(text) > 0)",
)
R.over(
    "chunk_small_plan",
    D,
    lambda d: d.select("doc_id", F.explode(chunks.windows(F.col("text"), 64, 0)).alias("chunk")),
    "SELECT doc_id, unnest(" + _WIN.format(t="text").replace("900", "64").replace("760", "64") + ") AS chunk FROM documents WHERE length(text) > 0",
)
R.over(
    "chunk_split_text",
    D,
    lambda d: d.select("doc_id", F.posexplode(chunks.word_windows(F.col("text"))).alias("pos", "chunk")),
    r"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), w AS (
  SELECT doc_id, t, 0 AS start, CAST(NULL AS BIGINT) AS fin, 0 AS turn FROM b WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, CASE WHEN turn = 0 THEN 0 ELSE greatest(fin - 100, start + 1) END AS start,
    CASE WHEN length(t) <= 600 THEN length(t) ELSE (CASE WHEN least(s + 600, length(t)) < length(t) AND sp > 300 THEN s + sp ELSE least(s + 600, length(t)) END) END AS fin, turn + 1
  FROM (SELECT *, length(seg) - instr(reverse(seg), ' ') AS sp0, CASE WHEN instr(reverse(seg), ' ') > 0 THEN length(seg) - instr(reverse(seg), ' ') ELSE -1 END AS sp
        FROM (SELECT *, substr(t, CAST(s AS BIGINT) + 1, 600) AS seg FROM (SELECT *, CASE WHEN turn = 0 THEN 0 ELSE greatest(fin - 100, start + 1) END AS s FROM w WHERE turn = 0 OR fin < length(t))))
), p AS (SELECT doc_id, turn, regexp_replace(substr(t, CAST(start AS BIGINT) + 1, CAST(fin - start AS BIGINT)), '^\s+|\s+$', '', 'g') AS chunk FROM w WHERE turn > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS INTEGER) AS pos, chunk FROM p WHERE chunk <> ''""",
)
_ART = "Статья 1. Общие\nтело один\nСтатья 2.1 Права\nтело два\nещё"
R.over(
    "chunk_articles",
    D,
    lambda d: d.select("doc_id", F.posexplode(chunks.articles(F.concat(F.lit("intro\n" + _ART + "\n"), F.col("text")))).alias("pos", "a")).select("doc_id", "pos", "a.*"),
    r"""SELECT doc_id, 0 AS pos, 'Статья 1. Общие' AS article, 'тело один' AS text FROM documents
UNION ALL SELECT doc_id, 1, 'Статья 2.1 Права', regexp_replace('тело два' || chr(10) || 'ещё' || chr(10) || text, '\s+$', '') FROM documents""",
)
R.queries["ds_articles"], R.sql["ds_articles"] = R.queries["chunk_articles"], R.sql["chunk_articles"]
_PAGED = f"""WITH pg AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS page, unnest(ps) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
ch AS (SELECT doc_id, page, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS chunk FROM (SELECT doc_id, page, {_WIN.format(t='body')} AS cs FROM pg WHERE length(body) > 0))
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INTEGER) AS chunk_index, length(chunk) AS n, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1) / 64) AS INTEGER) AS batch FROM ch"""
_paged = lambda d: chunks.number_chunks(d.select("doc_id", F.split("text", "\n").alias("pages")), "pages").select("doc_id", "page", "chunk_index", F.length("chunk").alias("n"), "batch")
R.over("chunk_per_page", D, _paged, _PAGED)
R.over("chunk_batch_no", D, lambda d: _paged(d).groupBy("doc_id", "batch").agg(F.count("*").alias("n")), f"SELECT doc_id, batch, count(*) AS n FROM ({_PAGED}) GROUP BY ALL")
R.over("chunk_id", D, lambda d: d.select("doc_id", chunks.chunk_id(F.sha2("text", 256), F.lit(1), F.lit(0), F.left("text", F.lit(900))).alias("id")), "SELECT doc_id, sha256(sha256(text) || ':1:0:' || left(text, 900)) AS id FROM documents")
R.over("emb_hash", D, lambda d: d.select("doc_id", F.transform(V.hash_embedding(X.word_tokens(F.col("text"))), lambda x: F.round(x.cast("double"), 6)).alias("embedding")))
_gram = lambda d: d.select(F.explode(X.word_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
R.over(
    "emb_trigrams",
    D,
    lambda d: _gram(d).select("n", F.explode(V.trigrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n")),
    r"""WITH w AS (SELECT '#' || unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) || '#' AS t FROM documents)
SELECT gram, count(*) AS n FROM (SELECT substr(t, unnest(range(1, greatest(length(t) - 2, 1) + 1)), 3) AS gram FROM w) GROUP BY gram""",
)


def signature(e):
    """One row per embedder and dimension; a store must have a single one."""
    return e.select(F.lit("table").alias("embedder"), F.size("embedding").alias("dim")).groupBy("embedder", "dim").agg(F.count("*").alias("n"))


R.over("emb_sig_check", E, signature, "SELECT 'table' AS embedder, CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY ALL")
_N = "sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
R.over("vec_normalise", E, lambda e: e.select("vec_id", F.transform(V.normalised(F.col("embedding")), lambda x: V.rounded(x)).alias("v")), "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / " + _N.format(v="embedding") + ", 6)) AS v FROM embeddings")
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"round({_DOT.format(a='q.embedding', b='c.embedding')} / ({_N.format(v='q.embedding')} * {_N.format(v='c.embedding')}), 6)"
_TOPK = f"""SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id"""
_RANKED = f"WITH s AS ({_TOPK}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= {{k}}"
def asked(e):
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def top(spark, sf_dir, k=5):
    e = table(spark, sf_dir, E)
    return S.search_blocked(asked(e), e, k)


R.over("join_vector_topk", E, lambda e: S.search_blocked(asked(e), e, 5), _RANKED.format(k=5))
R.add("search_topk", _RANKED.format(k=5))(lambda s, d: top(s, d))
R.add("win_topk_search", _RANKED.format(k=10))(lambda s, d: top(s, d, 10))
R.over("flt_dim", E, lambda e: e.where(F.size("embedding") == 64).select("vec_id"), "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
R.over("vec_cosine", E, lambda e: S.scored(asked(e), e), f"SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0")
_PRODUCT = f"round({_DOT.format(a='q.embedding', b='c.embedding')}, 6)"
R.over("flt_score_positive", E, lambda e: S.scored(asked(e), e, cosine=False, above=0.0), f"SELECT q.vec_id AS query_id, c.vec_id, {_PRODUCT} AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 WHERE {_PRODUCT} > 0")


def payloads(d):
    """Documents as a filterable chunk table."""
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("tenant_id"),
        F.concat(F.lit("Owner"), F.col("doc_id") % 3).alias("owner"),
        F.array("lang", F.lit("Doc")).alias("tags"),
        F.when(F.col("doc_id") % 2 == 0, "Order").otherwise("Law").alias("act_type"),
        F.concat(F.lit("Ministry "), F.col("doc_id") % 4).alias("issuer"),
        (F.col("doc_id") % 7).cast("string").alias("reg_number"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % 9 != 1).alias("is_active"),
        "text",
    )


_PAY = "WITH c AS (SELECT doc_id AS chunk_id, source AS tenant_id, 'Owner' || (doc_id % 3) AS owner, [lang, 'Doc'] AS tags, CASE WHEN doc_id % 2 = 0 THEN 'Order' ELSE 'Law' END AS act_type, 'Ministry ' || (doc_id % 4) AS issuer, CAST(doc_id % 7 AS VARCHAR) AS reg_number, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 9 <> 1 END AS is_active, text FROM documents) "
R.over("flt_search", D, lambda d: payloads(d).where(S.SearchFilters("src1", tags=("Doc",), issuer="Ministry").exact()).select("chunk_id", "tenant_id"), _PAY + "SELECT chunk_id, tenant_id FROM c WHERE tenant_id = 'src1' AND list_contains(tags, 'Doc') AND contains(issuer, 'Ministry') AND is_active")
R.over(
    "flt_search_lenient",
    D,
    lambda d: payloads(d).where(S.SearchFilters("SRC1", act_type="law", tags=("DOC",), revision_mode="historical").lenient()).select("chunk_id", "tenant_id"),
    _PAY + "SELECT chunk_id, tenant_id FROM c WHERE lower(tenant_id) = 'src1' AND lower(act_type) = 'law' AND (is_active IS NULL OR NOT is_active)",
)
R.over(
    "join_contains",
    D,
    lambda d: S.substring_search(payloads(d), "the ", 20, S.SearchFilters("src1", revision_mode="all")).select("chunk_id", "score"),
    _PAY + "SELECT chunk_id, round(((length(text) - length(replace(lower(text), 'the ', ''))) / 4.0) / greatest(length(text), 1) + CASE WHEN coalesce(is_active, true) THEN 0.2 ELSE 0 END, 6) AS score FROM c WHERE tenant_id = 'src1' AND contains(lower(text), 'the ') ORDER BY score DESC, chunk_id LIMIT 20",
)


_NEEDLES = r"SELECT DISTINCT lower(w) AS needle FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM benchmark)"


def contains_many(spark, sf_dir):
    """How often each longer word of the benchmark is in each document, and in how many."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"), 1)).alias("w"))
    return S.needle_counts(table(spark, sf_dir, D), words, "doc_id").groupBy("needle").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))


R.add(
    "join_contains_many",
    f"WITH n AS ({_NEEDLES}), d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT needle, count(*) AS docs, CAST(sum((length(t) - length(replace(t, needle, ''))) / length(needle)) AS BIGINT) AS hits FROM n JOIN d ON contains(t, needle) GROUP BY needle",
)(contains_many)


def built_index(spark, sf_dir):
    path = stores.scratch(spark, "vector-index")
    vector_index.build(table(spark, sf_dir, E), path)
    return vector_index.Index.load(spark, path)


R.add("index_search")(lambda s, d: built_index(s, d).search(asked(table(s, d, E))))
R.add("index_cover", "SELECT vec_id AS id, label FROM embeddings")(lambda s, d: built_index(s, d).rows(s).select("id", "label"))


def hits(spark, sf_dir, k=10):
    """Search hits with a file, a page and a text: the vectors' labels stand for files."""
    e = table(spark, sf_dir, E)
    return top(spark, sf_dir, k).join(e.select("vec_id", "label"), "vec_id").select("query_id", "rank", "score", F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), "label").alias("file"), (F.col("vec_id") % 3).alias("page"), F.concat(F.lit("text "), "vec_id").alias("text"), "label")


_HITS = f"WITH r AS ({_RANKED.format(k=10)}), h AS (SELECT query_id, rank, score, r.vec_id AS chunk_id, 'f' || label AS file, r.vec_id % 3 AS page, 'text ' || r.vec_id AS text, label FROM r JOIN embeddings USING (vec_id)) "
_TEACHER = lambda: (F.pmod(F.col("chunk_id") * 37, F.lit(11)) / 10.0)
R.add("win_rerank", _HITS + "SELECT query_id, chunk_id, new_rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 37 % 11 DESC, rank) AS INTEGER) AS new_rank FROM h) WHERE new_rank <= 5")(
    lambda s, d: S.rerank(hits(s, d).withColumn("t", _TEACHER()), "t", 5).select("query_id", "chunk_id", "new_rank")
)
R.add("win_rerank_cut", _HITS + "SELECT query_id, chunk_id, new_rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 37 % 11 DESC, rank) AS INTEGER) AS new_rank FROM h WHERE rank <= 4)")(
    lambda s, d: S.rerank(hits(s, d).withColumn("t", _TEACHER()), "t", 10, cut=4).select("query_id", "chunk_id", "new_rank")
)
R.add("rerank_passthrough", _HITS + "SELECT query_id, chunk_id, rank FROM h WHERE rank <= 3")(lambda s, d: hits(s, d).where("rank <= 3").select("query_id", "chunk_id", "rank"))
R.add("base_topk", _HITS + "SELECT query_id, list(chunk_id ORDER BY rank)[1:3] AS keys FROM h GROUP BY query_id")(
    lambda s, d: hits(s, d).groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), 1, 3).alias("keys"))
)
R.add(
    "win_citations",
    _HITS + "SELECT query_id, file, page, chunk_id, citation, count(*) OVER (PARTITION BY query_id) >= 3 AS has_minimum FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS citation FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file, page ORDER BY rank) AS seen FROM h) WHERE seen = 1) WHERE citation <= 5",
)(lambda s, d: S.citations(hits(s, d)).select("query_id", "file", "page", "chunk_id", "citation", "has_minimum"))
R.add("win_context_budget", _HITS + "SELECT query_id, left(string_agg(text, chr(10) || chr(10) ORDER BY rank), 60) AS context FROM h GROUP BY query_id")(lambda s, d: S.context(hits(s, d), 60))
R.add("format_numbered_context", _HITS + "SELECT query_id, string_agg('[' || rank || '] ' || file || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id")(lambda s, d: S.numbered_context(hits(s, d), "file"))
R.add("join_chunks_text", _HITS + "SELECT query_id, string_agg('Фрагмент [doc_chunk:' || chunk_id || ']:' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id")(
    lambda s, d: hits(s, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: F.concat(F.lit("Фрагмент [doc_chunk:"), x["chunk_id"], F.lit("]:\n"), x["text"])), "\n\n").alias("context"))
)
R.add("hits_to_documents", _HITS + "SELECT query_id, rank, text AS page_content, file AS meta_file, CAST(page AS VARCHAR) AS meta_page FROM h")(
    lambda s, d: hits(s, d).select("query_id", "rank", F.col("text").alias("page_content"), F.map_filter(F.create_map(F.lit("file"), "file", F.lit("page"), F.col("page").cast("string")), lambda k, v: v.isNotNull()).alias("meta")).select("query_id", "rank", "page_content", F.col("meta")["file"].alias("meta_file"), F.col("meta")["page"].alias("meta_page"))
)
R.over("bpe_wordcount", D, lambda d: bpe.word_counts(d.select(F.col("text"))), r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\s+|\S+')) AS piece FROM documents) GROUP BY piece")


def merges(spark, sf_dir, n):
    return bpe.train(bpe.word_counts(table(spark, sf_dir, D).select("text")), n)


R.add("bpe_train")(lambda spark, sf_dir: merges(spark, sf_dir, 1000))


def _digest(coded, *more):
    return coded.select("doc_id", F.size("ids").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), (F.col("back") == F.col("text")).alias("same"), *more)


@R.add("bpe_encode")
def bpe_encode(spark, sf_dir):
    """The documents in a tokenizer of 200 merges learned from them, and back."""
    t = bpe.Tokenizer.trained(merges(spark, sf_dir, 200))
    return _digest(t.decode(t.encode(table(spark, sf_dir, D), "text", "ids"), "ids", "back"))


@R.add("bpe_save")
def bpe_save(spark, sf_dir):
    """A tokenizer with special tokens, saved and loaded; they stay whole between the documents' lines."""
    path = stores.scratch(spark, "tokenizer")
    bpe.Tokenizer.trained(merges(spark, sf_dir, 200), ["<|line|>", "<|end|>"]).save(spark, path)
    t = bpe.Tokenizer.load(spark, path)
    docs = table(spark, sf_dir, D).select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("<|line|>")), F.lit("<|end|>")).alias("text"))
    coded = t.decode(t.encode(docs, "text", "ids", specials=True), "ids", "back")
    specials = F.size(F.filter("ids", lambda i: i >= min(t.specials.values())))
    return _digest(coded, specials.alias("specials"))


@R.add("bpe_first_merge", r"WITH w AS (SELECT hex(encode(piece)) AS h, n FROM (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\s+|\S+')) AS piece FROM documents) GROUP BY piece)), p AS (SELECT n, substr(h, 2 * i + 1, 4) AS pair FROM (SELECT h, n, unnest(range(0, greatest(CAST(length(h) / 2 AS BIGINT) - 1, 0))) AS i FROM w)) SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY pair ORDER BY n DESC, pair DESC LIMIT 1")
def bpe_first_merge(spark, sf_dir):
    return bpe.pair_counts(bpe.byte_words(bpe.word_counts(table(spark, sf_dir, D).select("text")))).orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(1).select(F.concat(F.lpad(F.hex("a"), 2, "0"), F.lpad(F.hex("b"), 2, "0")).alias("pair"), "n")


R.over(
    "flt_length_ok",
    "conversations",
    lambda c: c.where(F.length(X.strip(F.col("text"))).between(10, 200)).select("conv_id", "turn"),
    r"SELECT conv_id, turn FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 10 AND 200",
)
_REF = " OR ".join(f"contains(lower(t), '{m.replace(chr(39), chr(39) * 2)}')" for m in X.REFUSAL_MARKERS)
R.over(
    "flt_refusal",
    D,
    lambda d: d.select("doc_id", X.is_refusal(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Well, I CANNOT help "), "lang")).otherwise(F.col("text"))).alias("refusal")),
    f"SELECT doc_id, {_REF} AS refusal FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Well, I CANNOT help ' || lang ELSE text END AS t FROM documents)",
)
_JAC = r"WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS x, list_distinct(regexp_extract_all(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[\p{L}\p{N}_]+')) AS y FROM conversations) SELECT conv_id, turn, round(coalesce(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 0), 6) AS jaccard FROM s"


def consistency(c):
    """Word overlap of each turn with the next of its conversation, and whether it reaches 0.4."""
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("next", nxt).select("conv_id", "turn", F.round(X.jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


R.over("flt_self_consistent", "conversations", lambda c: consistency(c).withColumn("ok", F.col("jaccard") >= 0.4), f"SELECT *, jaccard >= 0.4 AS ok FROM ({_JAC})")
R.over("flt_suspicious", D, lambda d: d.where(F.length("text") < 500).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) < 500")


@R.add(
    "flagship",
    f"""WITH r AS ({_RANKED.format(k=10)}), h AS (SELECT query_id, rank, q.label = c.label AS good FROM r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = r.vec_id)
SELECT query_id, CAST(bool_or(good AND rank <= 1) AS INTEGER) AS hit1, CAST(bool_or(good AND rank <= 5) AS INTEGER) AS hit5, round(coalesce(1.0 / min(CASE WHEN good THEN rank END), 0), 6) AS mrr FROM h GROUP BY query_id""",
)
def flagship(spark, sf_dir):
    """Search each query's neighbours and score them by label: retrieval and evaluation in one plan."""
    e = table(spark, sf_dir, E)
    found = top(spark, sf_dir, 10).join(e.select("vec_id", F.col("label").alias("own")), "vec_id")
    judged = found.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").withColumn("good", F.col("own") == F.col("label"))
    hit = lambda k: F.max((F.col("good") & (F.col("rank") <= k)).cast("int"))
    return judged.groupBy("query_id").agg(hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("good"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))
