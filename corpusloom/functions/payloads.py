"""Functions that need a scan of the text beyond regular expressions: Arrow-batched, small helpers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"\s*```(?:json)?\s*(.*?)\s*```\s*", re.S)


def first_payload(text: str) -> str | None:
    """The first balanced JSON array, else object, in the text; brackets in JSON strings do not count."""
    for opening, closing in ("[]", "{}"):
        depth, start = 0, 0
        for m in re.finditer(rf'"(?:\\.|[^"\\])*(?:"|\Z)|[\{opening}\{closing}]', text, re.S):
            if m[0] == opening:
                start = start if depth else m.start()
                depth += 1
            elif m[0] == closing and depth:
                depth -= 1
                if not depth:
                    return text[start : m.end()]
    return None


def qa_items(raw: str | None) -> list[dict[str, str]]:
    """Question-answer pairs of a model's response; incomplete ones are dropped, unreadable text has none."""
    body = (raw or "").strip()
    if fence := _FENCE.fullmatch(body):
        body = fence[1].strip()
    for candidate in (body, first_payload(body)):
        try:
            data = json.loads(candidate or "")
            break
        except ValueError:
            continue
    else:
        return []
    rows = [data] if isinstance(data, dict) else [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    fields = [{k: str(x.get(k, "")).strip() for k in ("instruction", "input", "output")} for x in rows]
    return [x for x in fields if x["instruction"] and x["output"]]


def parse_qa(raw: Column) -> Column:
    @F.pandas_udf("array<struct<instruction: string, input: string, output: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(qa_items)

    return run(raw)
