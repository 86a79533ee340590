"""Values of queries that have no SQL, against plain loops over the same tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from corpusloom.plans import catalog
from corpusloom.sources import files

SF = "/root/testdata/sf0.001"


def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_emb_hash(spark):
    got = {r.doc_id: r.embedding for r in catalog.queries()["emb_hash"](spark, SF).collect()}
    texts = docs(spark)
    assert set(got) == set(texts)
    for i, text in texts.items():
        v = [0.0] * 256
        for token in re.findall(r"\w+", text.lower()):
            padded = f"#{token}#"
            for at in range(len(padded) - 2):
                digest = hashlib.blake2s(padded[at : at + 3].encode(), digest_size=4).digest()
                v[int.from_bytes(digest, "big") % 256] += 1 if digest[-1] & 1 else -1
        length = math.sqrt(sum(x * x for x in v)) or 1
        assert all(abs(x - y / length) < 2e-6 for x, y in zip(got[i], v, strict=True)), i


def plain_pages(pieces, joint):
    """Pieces gathered until there are over 8,000 characters."""
    pages, held = [], []
    for piece in (p.strip() for p in pieces):
        if not piece:
            continue
        held.append(piece)
        if len(joint.join(held)) > files.PAGE_CHARS:
            pages.append(joint.join(held))
            held = []
    return [" ".join(p.split()) for p in [*pages, joint.join(held)] if p.split()]


def test_src_docx(spark):
    got = defaultdict(dict)
    for r in catalog.queries()["src_docx"](spark, SF).collect():
        got[r.doc_id][r.page] = r.body
    wanted = {i: dict(enumerate(plain_pages(t.split("\n"), "\n"), 1)) for i, t in docs(spark).items()}
    assert got == {i: p for i, p in wanted.items() if p}
    assert any(len(p) > 1 for p in got.values())


def test_st_rate_limit(spark):
    events = sorted((r.user_id, r.ts.timestamp(), r.event_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    wanted, recent = Counter(), defaultdict(list)
    for user, at, _ in events:
        recent[user] = [x for x in recent[user] if x > at - 3600]
        accepted = len(recent[user]) < 2
        wanted[accepted] += 1
        if accepted:
            recent[user].append(at)
    assert {r.accepted: r.n for r in catalog.queries()["st_rate_limit"](spark, SF).collect()} == dict(wanted)


def test_src_txt(spark):
    got = defaultdict(dict)
    for r in catalog.queries()["src_txt"](spark, SF).collect():
        got[r.doc_id][r.page] = r.n
    wanted = {i: {k: len(p) for k, p in enumerate(plain_pages(t.splitlines(), " "))} for i, t in docs(spark).items()}
    assert got == {i: p for i, p in wanted.items() if p}
