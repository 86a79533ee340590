"""Vector arithmetic in doubles over array<float> columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """``x`` to so many decimals, halves away from zero; a negative number that rounds to zero keeps its sign, as in SQL's round."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def trigrams(token: Column) -> Column:
    """The trigrams of the token between number signs."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3)))


def hash_embedding(tokens: Column, dim: int = 256) -> Column:
    """Signed trigram counts in ``dim`` slots, of length 1: slot and sign from the 4-byte BLAKE2s digest of the trigram."""

    def slot(gram: str) -> tuple[int, float]:
        digest = hashlib.blake2s(gram.encode(), digest_size=4).digest()
        return int.from_bytes(digest, "big") % dim, 1.0 if digest[-1] & 1 else -1.0

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = []
            for words in batch:
                v = np.zeros(dim)
                for word in words:
                    padded = f"#{word}#"
                    for i in range(len(padded) - 2):
                        gram = padded[i : i + 3]
                        if gram not in memo:
                            memo[gram] = slot(gram)
                        at, sign = memo[gram]
                        v[at] += sign
                length = np.linalg.norm(v)
                out.append((v / length if length else v).astype(np.float32))
            yield pd.Series(out)

    return embed(tokens)
