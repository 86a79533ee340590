"""Vectorised word hashes over Arrow text: one pass of numpy for a whole batch, no loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a polynomial of its
bytes modulo 2**64 with a final mix. Texts are worked through in segments of at most
``SEGMENT`` bytes, cut at white space, so that memory is bounded for texts of any length (a word of more
bytes is one segment). The last two words of a segment go along in front of the next one of the same text, so that
no n-gram of up to three words is lost at a cut; ``carried`` tells how many such words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# byte -> class for word shapes: capitals, other letters, digits; every other byte is its own class
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 1, 2, 2, 3
_powers: tuple[np.ndarray, np.ndarray] | None = None


class Words(NamedTuple):
    """The words of some texts; ``text`` numbers the text a word is from."""

    hashes: np.ndarray
    shapes: np.ndarray | None
    text: np.ndarray
    run: np.ndarray  # position of the word in its text's segment
    carried: int = 0  # words in front that the segment before had already


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, SEGMENT + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (_P, _INV))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * inverse[start])


def _segment(data: np.ndarray, bounds: np.ndarray, shapes: bool) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    opens[cuts] = inside[cuts]
    start = np.flatnonzero(opens)
    shut = np.zeros(len(data) + 1, bool)
    shut[1:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    if len(data):
        shut[-1] = inside[-1]
    end = np.flatnonzero(shut)
    text = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds[:-1])
    run = np.arange(len(start)) - first[text]
    shape = None
    if shapes:
        kind = _SHAPE[data]
        keep = inside.copy()
        keep[1:] &= (kind[1:] != kind[:-1]) | opens[1:]
        at = np.concatenate([[0], np.cumsum(keep)])
        shape = _hash(kind[keep], at[start], at[end])
    return Words(_hash(data, start, end), shape, text, run)


def _cut_long(data: np.ndarray) -> list[int]:
    """Segment bounds of one long text, each after white space."""
    out, at = [0], 0
    while len(data) - at > SEGMENT:
        spaces = np.flatnonzero(_SPACE[data[at : at + SEGMENT]])
        if len(spaces):
            at += int(spaces[-1]) + 1
        else:
            step = at + SEGMENT
            while step < len(data) and not _SPACE[data[step : step + SEGMENT]].any():
                step += SEGMENT
            if step >= len(data):
                break
            at = step + int(np.argmax(_SPACE[data[step : step + SEGMENT]])) + 1
        out.append(at)
    return [*out, len(data)] if out[-1] < len(data) else out


def _joined(before: Words | None, found: Words) -> Words:
    """``found`` with the last two words of the segment before in front."""
    if before is None or not len(before.hashes):
        return found
    n = min(2, len(before.hashes))
    shapes = None if found.shapes is None else np.concatenate([before.shapes[-n:], found.shapes])
    text = np.concatenate([before.text[-n:], found.text])
    return Words(np.concatenate([before.hashes[-n:], found.hashes]), shapes, text, np.arange(len(found.hashes) + n), n)


def words(texts: pa.Array, shapes: bool = False) -> Iterator[Words]:
    """The words of all texts (null: none), in several pieces of bounded size; ``text`` counts from 0 in ``texts``."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, values = texts.buffers()
    offset = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + SEGMENT, side="right")) - 1)
        j = min(j, len(texts))
        part = data[offset[i] : offset[j]]
        if j == i + 1 and len(part) > SEGMENT:
            cuts = _cut_long(part)
            found = None
            for a, b in zip(cuts, cuts[1:]):
                found = _joined(found, _segment(part[a:b], np.array([0, b - a]), shapes))
                yield found._replace(text=found.text + i)
        else:
            found = _segment(part, offset[i : j + 1] - offset[i], shapes)
            yield found._replace(text=found.text + i)
        i = j
