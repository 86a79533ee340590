"""Main text of web pages by wrapper induction.

Pages of one host and layout (the kinds of nodes of the upper levels) have one pivot, that of the smallest id
of those with any text. Every other page's DOM tree is aligned with the pivot's by simple tree matching. For
each pivot node the aligned pages tell in how many different articles it has a text, how often the commonest one, how
long and how much of it in links. Pages of one article (the same longest blocks, under whatever menus) count once.
A node that is constant across articles becomes template, one that varies a slot. The smallest part of the
page that holds most of the slots' text outside of links is the article's region. A recurring paragraph among varying ones of its kind
stays content. In a page, the blocks of the region are taken, without those aligned with template nodes.

Menus, adverts and comments may vary as well and are slots then; those that tags, roles or names mark as such weigh nothing and
are left out, and where the slots leave it open, an article or main element is preferred. A page whose layout
fewer than ``_dom.LEAST`` articles share has no wrapper; there the marks decide alone.

Only skeletons (22 bytes a node) and counts are shuffled for the alignment. The wrappers, one row a host, are
broadcast up to ``BROADCAST_BYTES`` and joined beyond. A host with a third of all pages is one pivot a layout
and counts by node and text.

Null and empty html give an empty text. A page without a host, or alone on it, has no template. Repeated
rows give the same text each. Pages of any length, depth and number of siblings are aligned in full. An empty table
gives an empty result. Text in a block has its white space collapsed and character references
decoded; blocks are joined by line feeds; nothing else is dropped or cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import _dom
from corpusloom.llm._shared import as_text, cut, fresh, quoted

BROADCAST_BYTES = 32 << 20


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_VOTE = T.ArrayType(_struct(node=_INT, text=_LONG, chars=_INT, linked=_INT))
_SEEN = T.ArrayType(_struct(node=_INT, n=_LONG, top=_LONG, chars=_DOUBLE, linked=_DOUBLE))


@F.arrow_udf(_struct(layout=_LONG, article=_LONG, page=T.BinaryType()))
def _skeletons(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("layout", pa.int64()), ("article", pa.int64()), ("page", pa.binary())])
    for pages in batches:
        out = []
        for html in pages:
            page = _dom.Page(html.as_py() or "")
            # a page without text says nothing about its host
            out.append({"layout": page.layout(), "article": page.article(), "page": page.skeleton().tobytes()} if page.blocks else None)
        yield pa.array(out, kind)


@F.arrow_udf(_VOTE)
def _votes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())]))
    known: tuple[bytes | None, _dom.Tree | None] = (None, None)
    for pages, pivots in batches:
        out = []
        for page, pivot in zip(pages, pivots):
            if pivot.as_py() != known[0]:
                known = (pivot.as_py(), _dom.Tree(np.frombuffer(pivot.as_py(), _dom.NODE)))
            tree = _dom.Tree(np.frombuffer(page.as_py(), _dom.NODE))
            nodes = tree.nodes
            out.append([{"node": y, "text": tree.text[x], "chars": int(nodes["chars"][x]), "linked": int(nodes["linked"][x])} for x, y in _dom.align(tree, known[1]) if tree.text[x]])
        yield pa.array(out, kind)


@F.arrow_udf(_struct(region=_INT, template=T.ArrayType(_INT)))
def _induced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("region", pa.int32()), ("template", pa.list_(pa.int32()))])
    for pivots, seen in batches:
        out = []
        for pivot, rows in zip(pivots, seen):
            rows = rows.as_py()
            region, template = _dom.induce(pivot.as_py(), *(np.array([r[k] for r in rows]) for k in ("node", "n", "top", "chars", "linked")))
            out.append({"region": region, "template": template})
        yield pa.array(out, kind)


@F.arrow_udf(T.StringType())
def _texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    known: dict[tuple, _dom.Wrapper] = {}
    for pages, wrappers in batches:
        out = []
        for html, own in zip(pages, wrappers):
            page, wrapper = _dom.Page(html.as_py() or ""), None
            if own.is_valid:
                layout = page.layout()
                for w in own:
                    if w["layout"].as_py() == layout:
                        key = (w["pivot"].as_py(), w["region"].as_py(), tuple(w["template"].as_py()))
                        if key not in known:
                            if len(known) > 256:
                                known.clear()
                            known[key] = _dom.Wrapper(*key)
                        wrapper = known[key]
            out.append(page.content(wrapper))
        yield pa.array(out, pa.string())


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(host, layout, pivot, region, template): the pivot's skeleton, its region's node and its template nodes."""
    rows = pages.select(host(quoted(url_col)).alias("host"), quoted(id_col).alias("id"), as_text(html_col).alias("html")).where("host <> ''")
    rows = rows.select("host", "id", _skeletons("html").alias("s")).where("s IS NOT NULL").select("host", "id", "s.*")
    # one page an article
    rows = cut(rows.groupBy("host", "layout", "article").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "page")).alias("p")))
    pivots = rows.groupBy("host", "layout").agg(F.min("p")["page"].alias("pivot"), F.count("*").alias("n"))
    pivots = cut(pivots.where(F.col("n") >= _dom.LEAST).drop("n"))
    voted = rows.select("host", "layout", F.col("p.page").alias("page")).join(pivots, ["host", "layout"]).select("host", "layout", F.explode(_votes("page", "pivot")).alias("v"))
    texts = voted.groupBy("host", "layout", "v.node", "v.text").agg(F.count("*").alias("n"), F.sum("v.chars").alias("chars"), F.sum("v.linked").alias("linked"))
    nodes = texts.groupBy("host", "layout", "node").agg(F.sum("n").alias("n"), F.max("n").alias("top"), (F.sum("chars") / F.sum("n")).alias("chars"), (F.sum("linked") / F.sum("n")).alias("linked"))
    seen = nodes.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "n", "top", "chars", "linked")).cast(_SEEN).alias("seen"))
    return seen.join(pivots, ["host", "layout"]).select("host", "layout", "pivot", _induced("pivot", "seen").alias("w")).select("host", "layout", "pivot", "w.*")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text; a column called like ``text_col`` is replaced."""
    h, w = fresh(pages, "host", "wrappers")
    found = wrappers(pages, url_col, html_col, id_col).groupBy(F.col("host").alias(h)).agg(F.collect_list(F.struct("layout", "pivot", "region", "template")).alias(w))
    found = cut(found)
    size = F.aggregate(quoted(w), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["pivot"]) + 4 * F.size(x["template"]) + 16)
    held = found.agg(F.sum(size + F.octet_length(quoted(h)))).first()[0] or 0
    if held <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = pages.withColumn(h, host(quoted(url_col))).join(found, h, "left")
    text = _texts(as_text(html_col), quoted(w))
    return joined.withColumn(text_col, text).select(*[quoted(c) for c in pages.columns if c.lower() != text_col.lower()], quoted(text_col))
