"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text are its word unigrams and bigrams and the unigrams, bigrams and trigrams of word
shapes (capitals, other letters, digits and punctuation, runs collapsed; a bigram also says whether
a word repeats the one before), hashed into ``2**BITS`` slots. A slot's value is its share of the
text's n-grams times ``SCALE``. Nothing but the text is an input.

Training is distributed. At most ``TRAIN_DOCS`` labelled rows, a sample by the hash of their
id, are dealt to groups of about ``GROUP`` rows and ``GROUP_ENTRIES`` vector entries; each group runs FTRL-proximal over its own
rows, and the slot weights are averaged (parameter mixing), in fixed point, so that reruns agree to the bit. The
weights are a table of at most ``2**BITS`` rows, which bounds what is broadcast for scoring.

Null and empty texts have no features and get the score of the intercept. Without any labelled
rows the score is 0.5 for every text. Repeated rows are scored alike; a repeated row with a label is learned from each
time. An empty table gives an empty result. Other columns pass through; ``score`` replaces a column called like its
result, ``keep_good`` replaces none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import _words
from corpusloom.llm._shared import as_text, bounded_sample, cut, fresh, quoted

BITS, SCALE = 18, 16.0
#: Bound of the labelled sample and the size of the groups it is dealt to.
TRAIN_DOCS, GROUP = 8192, 1024
#: A group holds about so many entries of sparse vectors; weights are summed as multiples of 1 / FIXED.
GROUP_ENTRIES, FIXED = 1 << 22, 1 << 32
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.001
_BIAS = 1 << BITS
_SALTS = [np.uint64(0x1234567 * (2 * i + 1)) for i in range(5)]


def _features(found: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of every n-gram of the words found."""
    word, shape, text, run, carried = found
    second, third = run[1:] >= 1, run[2:] >= 2
    # n-grams that end in a carried word were counted with the segment before
    second[: max(0, carried - 1)] = False
    third[: max(0, carried - 2)] = False
    with np.errstate(over="ignore"):
        pair = (word[:-1] * np.uint64(3) + word[1:])[second]
        same = (word[:-1] == word[1:]).astype(np.uint64)
        shapes2 = (shape[:-1] * np.uint64(5) + shape[1:] + same)[second]
        shapes3 = (shape[:-2] * np.uint64(7) + shape[1:-1] * np.uint64(11) + shape[2:])[third]
        grams = [word[carried:], pair, shape[carried:], shapes2, shapes3]
        slots = np.concatenate([_words.mix(g ^ salt) & np.uint64(_BIAS - 1) for g, salt in zip(grams, _SALTS)])
    own = text[carried:]
    return np.concatenate([own, text[1:][second], own, text[1:][second], text[2:][third]]), slots.astype(np.int64)


def _vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector of each text: slots (the intercept's first) and values."""
    parts = [_features(found) for found in _words.words(texts, shapes=True)]
    text = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    slot = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    key, count = np.unique(text << (BITS + 1) | slot, return_counts=True)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) << (BITS + 1))
    out = []
    for a, b in zip(ends, ends[1:]):
        share = count[a:b] / max(1, count[a:b].sum())
        out.append((np.concatenate([[_BIAS], key[a:b] & (2 * _BIAS - 1)]), np.concatenate([[1.0], share * SCALE])))
    return out


def _sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes of FTRL-proximal updates over the rows in the order given."""
    z, n = np.zeros(_BIAS + 1), np.zeros(_BIAS + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (slots, values), label in zip(rows, labels):
            w = weights(slots)
            g = (_sigmoid(w @ values) - label) * values
            step = n[slots] + g * g
            z[slots] += g - (np.sqrt(step) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] = step
    return weights(slice(None))


@F.arrow_udf(T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
def _sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sparse vector of each text, so that no text is shuffled or held by a group."""
    for texts in batches:
        for at in range(0, len(texts), 64):
            rows = _vectors(texts.slice(at, 64))
            parts = [pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.StructArray.from_arrays(parts, ["slots", "values"])


def _fit(group: pa.Table) -> pa.Table:
    """One group's weights: its non-zero slots, as whole multiples of 1 / FIXED so that their sums have no order."""
    order = np.lexsort((group["key"].to_numpy(), group["order"].to_numpy()))
    x = group["x"].combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    slots, values = x.field("slots"), x.field("values")
    rows = [(slots[int(i)].values.to_numpy(), values[int(i)].values.to_numpy()) for i in order]
    w = np.rint(ftrl(rows, group["label"].to_numpy()[order]) * FIXED).astype(np.int64)
    kept = np.flatnonzero(w)
    return pa.table({"slot": pa.array(kept, pa.int32()), "w": pa.array(w[kept], pa.int64())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> np.ndarray:
    """Mixed weights, as one dense array of ``2**BITS + 1`` numbers.

    ``labels`` holds the rows to learn from; a label other than 0 and 1 and a null id or label are
    left out, and of an id with several labels the largest counts.
    """
    key = quoted(id_col)
    chosen = (
        labels.where(quoted(label_col).isin(0, 1) & key.isNotNull())
        .groupBy(key.alias("id"))
        .agg(F.max(quoted(label_col)).cast("double").alias("label"))
        .withColumn("order", F.xxhash64("id"))
    )
    chosen = bounded_sample(chosen, "order", TRAIN_DOCS, "id")
    # TRAIN_DOCS rows of three numbers bound the broadcast side
    rows = docs.select(key.alias("id"), as_text(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = cut(rows.select(_sparse("text").alias("x"), "label", "order", F.xxhash64("text").alias("key")))
    found, entries = rows.agg(F.count("*"), F.sum(F.size("x.slots"))).first()
    shards = max(1, found // GROUP, (entries or 0) // GROUP_ENTRIES)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("order", "key"), F.lit(shards)))
    mixed = dealt.groupBy("shard").applyInArrow(_fit, "slot int, w long").groupBy("slot").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(_BIAS + 1)
    out[mixed["slot"].to_numpy()] = mixed["w"].to_numpy() / (FIXED * shards)
    return out


def score_texts(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for found in _words.words(texts, shapes=True):
        text, slots = _features(found)
        total += np.bincount(text, w[slots], len(texts))
        count += np.bincount(text, minlength=len(texts))
    return _sigmoid(w[_BIAS] + SCALE * total / np.maximum(count, 1))


def _scorer(model: Broadcast) -> Callable:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_texts(texts, model.value))

    return score


def score(df: DataFrame, w: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the probability that the text is of good quality."""
    model = df.sparkSession.sparkContext.broadcast(w)  # 2 MB at most
    return df.withColumn(out_col, _scorer(model)(as_text(text_col)))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of 5; null ids are held out."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted; learns from labels that are not held out."""
    w = train(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), w).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns."""
    (name,) = fresh(docs, "score")
    return score(docs, train(docs, labels.where(~held_out())), out_col=name).where(quoted(name) >= threshold).select(*map(quoted, docs.columns))
