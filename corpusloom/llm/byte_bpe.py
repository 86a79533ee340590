"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from a rank file.

The rank file gives byte strings in the order of their merges. Each byte string becomes a piece of
a sentencepiece BPE model: its bytes are mapped one to one to printable code points, its score is
the negated rank, and the normaliser is the identity. A text is split by the tokenizer's pattern;
each match is encoded by itself: as one id when it is in the vocabulary, else by the model's
merges. Decoding maps ids back to their bytes.

Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded alike; other
columns pass through the JVM untouched.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import as_text, fresh, quoted

#: Pre-tokens remembered per Python worker; beyond it the memory starts anew. Longer ones than
#: LONG_PIECE are forgotten at once. Results depend on neither.
MEMO, LONG_PIECE = 150_000, 64
#: Characters of text that are split at once.
AT_ONCE = 1 << 19
#: Code points that stand for the bytes: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> list[str]:
    """The code point that stands for each byte; no byte stands for white space."""
    shifted = iter(range(256, 512))
    return [chr(b) if b in _PRINTABLE else chr(next(shifted)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, length-delimited or float by the type of ``value``."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, the others follow by rank."""
    alphabet = byte_alphabet()
    ordered = sorted(ranks, key=ranks.__getitem__)
    spelled = ["".join(alphabet[b] for b in piece) for piece in ordered]
    unknown = "<unk>"
    while unknown in spelled:
        unknown += "_"
    pieces = [_field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, text.encode()) + _field(2, -float(ranks[piece])) + _field(3, 1) for piece, text in zip(ordered, spelled)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, unknown.encode())
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Encoder of one rank file, made once per Python worker.

    A pre-token is remembered as packed piece numbers; a text's are joined as bytes and turned into
    ids in one step.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.ids = np.array([-1, *(ranks[p] for p in ordered)], np.int32)
        self.whole = {piece: array("i", [i + 1]).tobytes() for i, piece in enumerate(ordered)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.spell = dict(enumerate(byte_alphabet()))
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Put pre-tokens into the memory; all that need merges go to the model in one call."""
        if len(self.memo) + len(pieces) > MEMO:
            self.memo.clear()
        whole = {p: self.whole.get(p.encode()) for p in pieces}
        rest = [p for p, known in whole.items() if known is None]
        found = self.model.encode([p.encode().decode("latin-1").translate(self.spell) for p in rest], num_threads=1)
        whole.update(zip(rest, (array("i", x).tobytes() for x in found)))
        self.memo.update(whole)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts should be few, as all their pre-tokens are held at once."""
        split = list(map(self.split, texts))
        needed = set().union(*split)
        missing = needed.difference(self.memo)
        if missing:
            self.learn(needed if len(self.memo) + len(missing) > MEMO else missing)
        out = [self.ids[np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), np.int32)] for pieces in split]
        for piece in missing:
            if len(piece) > LONG_PIECE:
                del self.memo[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


class Decoder:
    """The inverse mapping from ids to bytes."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about AT_ONCE characters."""
    portion, held = [], 0
    for text in texts:
        portion.append(text.as_py() or "")
        held += len(portion[-1])
        if held >= AT_ONCE:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


def _encoder(path: str, pattern: str) -> Callable:
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder_of(path, pattern)
        for texts in batches:
            for portion in _portions(texts):  # results go out in pieces, so that a batch of long texts is never held as ids
                ids = own.encode_batch(portion)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return encode


def _decoder(path: str) -> Callable:
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = decoder_of(path)
        for ids in batches:
            for at in range(0, len(ids), 256):
                yield pa.array((own.decode(x.values.to_pylist()) if x.is_valid else b"" for x in ids.slice(at, 256)), pa.binary())

    return decode


def _both(path: str, pattern: str) -> Callable:
    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, back = encoder_of(path, pattern), decoder_of(path)
        for texts in batches:
            for portion in _portions(texts):
                ids = own.encode_batch(portion)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                decoded = pa.array((back.decode(x.tolist()) for x in ids), pa.binary())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), decoded], ["ids", "decoded"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return code


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of the whole text as ``array<int>``."""
    return df.withColumn(ids_col, _encoder(path, pattern)(as_text(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (null ids: none)."""
    return df.withColumn(bytes_col, _decoder(path)(quoted(ids_col)))


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one Python worker a task in place of two: ids are decoded where they are made."""
    (both,) = fresh(df, "both")
    coded = df.withColumn(both, _both(path, pattern)(as_text(text_col)))
    return coded.withColumn(ids_col, quoted(both)["ids"]).withColumn(bytes_col, quoted(both)["decoded"]).drop(both)


def with_digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    ids = quoted(ids_col)
    return (
        df.withColumn("n_tokens", F.size(ids).cast("long"))
        .withColumn("ids_sha256", F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256))
        .withColumn("decoded_sha256", F.sha2(quoted(bytes_col), 256))
    )
