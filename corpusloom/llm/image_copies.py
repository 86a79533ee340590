"""Copies of images found by local descriptors: cropped, scaled, rotated, brightened and noisy ones too.

Images are binary columns (PNG of 8 bits without interlacing, PGM/PPM P5/P6, uncompressed BMP). Each gets
corners at several scales, the ``PER_TILE`` strongest of each tile so that their number grows with the image and a crop
keeps its own, a direction for each corner from the intensity centroid of its patch, and
256 binary tests of smoothed intensities in the turned patch. Descriptors are cut into ``BANDS`` bands of 32 bits,
all of which are keys of the Hamming tables. Descriptors that share a key are compared in all bits at once, and only those
within ``DISTANCE`` become matches, which vote for a similarity transform (turn, scale, shift); a pair is a copy where
``VOTES`` distinct corners agree in one of the grids of bins, shifted by half a bin in each dimension. Classes are the
components of the pairs.

Images are dealt into blocks of ``BLOCK`` corners, and every two blocks meet in one task, which has the Hamming tables of both. A table
holds the images of a key as bits, so that one pass over a block's corners tells which two images share keys at ``VOTES`` corners of
either; no others can agree. Of these all pairs of corners that share a key are compared, whatever their number, and vote. Only pairs
found to be copies leave the task; for classes only those that join images which the task has not joined by others, so that a group of
copies leaves it as a tree. The bits grow with the product of the blocks, and thus with the square of the images.

Images that share a part with so many corners, say a large logo, are linked as well.

Images of equal bytes are one image from the start, null counting as empty. Undecodable images match
no others, nor do images with too few corners. Pictures of more than ``PIXELS`` are scaled down by whole factors
first. Repeated rows are one image; of corners of equal strength the upper left ones count. An empty table gives an
empty result; columns other than id and image are not read. Null ids belong to the class of their pixels but never
name it, unless it has no other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._shared import cut, quoted
from corpusloom.llm.components import components

SCALES, TILE, PER_TILE, PIXELS = (1.0, 0.7, 0.5), 32, 3, 1 << 22
RADIUS, TESTS, TURNS, BANDS = 9, 256, 30, 8
#: Corners that must agree on a transform, and the bits in which two matching descriptors may differ.
VOTES, DISTANCE = 6, 64
#: Corners of a block of images, pairs of corners compared at a time, at most held of some pairs of images, and pairs of images taken at a time.
BLOCK, PAIRS, PART, SOME = 1 << 15, 1 << 17, 1 << 20, 2048
#: Images to a partition, and the most partitions on a side of the product of blocks.
IMAGES, PARTITIONS = 2048, 64
_rng = np.random.default_rng(11)
#: Ends of the binary tests in the upright patch, and turned in steps of a circle's 1/TURNS.
_PATTERN = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS / 1.5, RADIUS / 1.5)
_TURNED = np.stack([np.rint(_PATTERN @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])) for a in np.arange(TURNS) * 2 * np.pi / TURNS]).astype(int)
_DISC = np.array([(x, y) for x in range(-RADIUS, RADIUS + 1) for y in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def _png(data: bytes) -> np.ndarray | None:
    at, packed, palette = 8, b"", None
    width = height = depth = kind = lace = 0
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or lace or not channels:
        return None
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        row, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            row = row + above & 255
        elif how in (1, 3, 4):
            for x in range(len(row)):
                a = row[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if how == 4:
                    p = a + b - c
                    best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = row[x] + (a if how == 1 else (a + b) // 2 if how == 3 else best) & 255
        out[y], above = row, row
    image = out.reshape(height, width, channels)
    return palette[image[..., 0]] if kind == 3 and palette is not None else image[..., : 1 if channels < 3 else 3]


def _pnm(data: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    channels = 3 if data[1:2] == b"6" else 1
    return None if top > 255 else np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray | None:
    offset, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed:
        return None
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8]
    image = rows.reshape(abs(height), width, bits // 8)[..., 2::-1]
    return image[::-1] if height > 0 else image


def gray(data: bytes | None) -> np.ndarray | None:
    """The image as grey levels, None where it cannot be read."""
    try:
        if not data:
            return None
        image = _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _pnm(data) if data[:2] in (b"P5", b"P6") else _bmp(data) if data[:2] == b"BM" else None
        if image is None or not image.size:
            return None
        image = image.mean(axis=2, dtype=np.float32)
        while image.size > PIXELS:
            h, w = (n // 2 * 2 for n in image.shape)
            image = image[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
        return image
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _scaled(stack: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling of a stack of images."""
    if scale == 1:
        return stack
    h, w = (max(1, int(n * scale)) for n in stack.shape[1:])
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, stack.shape[1] - 2 if stack.shape[1] > 1 else 0), np.clip(x.astype(int), 0, stack.shape[2] - 2 if stack.shape[2] > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, stack.shape[1] - 1), np.minimum(x0 + 1, stack.shape[2] - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    rows = lambda r: stack[:, r][:, :, x0] * (1 - fx) + stack[:, r][:, :, x1] * fx
    return (rows(y0) * (1 - fy) + rows(y1) * fy).astype(np.float32)


def _box(stack: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    n = 2 * r + 1
    padded = np.pad(stack, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1, dtype=np.float64).cumsum(axis=2)
    return ((padded[:, n:, n:] - padded[:, :-n, n:] - padded[:, n:, :-n] + padded[:, :-n, :-n]) / n**2).astype(np.float32)


class Corners(NamedTuple):
    image: np.ndarray
    x: np.ndarray
    y: np.ndarray
    scale: np.ndarray
    angle: np.ndarray
    bits: np.ndarray  # (n, TESTS / 8) bytes


def describe(stack: np.ndarray) -> Corners:
    """Corners of a stack of images of one size, with their descriptors."""
    parts = []
    margin = RADIUS + 1
    for scale in SCALES:
        level = _scaled(stack, scale)
        n, h, w = level.shape
        if min(h, w) <= 2 * margin:
            continue
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = np.pad(response, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        peak = np.max([top[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        response = np.where((response == peak) & (response > 1), response, -np.inf)
        response[:, :margin], response[:, -margin:], response[:, :, :margin], response[:, :, -margin:] = (-np.inf,) * 4
        image, y, x = np.nonzero(np.isfinite(response))
        tile = (image * (h // TILE + 1) + (y - margin) // TILE) * (w // TILE + 1) + (x - margin) // TILE
        order = np.lexsort((x, y, -response[image, y, x], tile))
        tile = tile[order]
        first = np.searchsorted(tile, tile, side="left")
        best = np.sort(order[np.arange(len(order)) - first < PER_TILE])
        image, y, x = image[best], y[best], x[best]
        patch = level[image[:, None], y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2(patch @ _DISC[:, 1].astype(np.float32), patch @ _DISC[:, 0].astype(np.float32))
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        smooth = _box(level, 1)
        ends = _TURNED[turn]
        at = smooth[image[:, None, None], np.clip(y[:, None, None] + ends[..., 1], 0, h - 1), np.clip(x[:, None, None] + ends[..., 0], 0, w - 1)]
        bits = np.packbits(at[..., 0] < at[..., 1], axis=1)
        parts.append(Corners(image, (x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), angle, bits))
    if not parts:
        return Corners(*(np.zeros(0) for _ in range(5)), np.zeros((0, TESTS // 8), np.uint8))
    return Corners(*(np.concatenate(x) for x in zip(*parts)))


_FLOATS = ("x", "y", "scale", "angle")
_WORDS = tuple(f"d{n}" for n in range(TESTS // 64))
_CORNER = T.ArrayType(T.StructType([*(T.StructField(n, T.FloatType()) for n in _FLOATS), *(T.StructField(n, T.LongType()) for n in _WORDS)]))


@F.arrow_udf(_CORNER)
def _described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([*((n, pa.float32()) for n in _FLOATS), *((n, pa.int64()) for n in _WORDS)])
    for batch in batches:
        for at in range(0, len(batch), 128):
            sizes: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            part = batch.slice(at, 128)
            for i, data in enumerate(part):
                if (image := gray(data.as_py())) is not None:
                    sizes.setdefault(image.shape, []).append((i, image))
            owner, values = [np.zeros(0, int)], []
            for group in sizes.values():
                step = max(1, PIXELS // group[0][1].size)
                for a in range(0, len(group), step):
                    found = describe(np.stack([image for _, image in group[a : a + step]]))
                    owner.append(np.array([i for i, _ in group[a : a + step]])[found.image.astype(int)])
                    values.append([*found[1:5], *np.ascontiguousarray(found.bits).view("<i8").reshape(-1, len(_WORDS)).T])
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            columns = [pa.array(np.concatenate(c)[order], f.type) for c, f in zip(zip(*values), kind)] if values else [pa.array([], f.type) for f in kind]
            ends = np.searchsorted(owner[order], np.arange(len(part) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(kind)))


def corners(images: DataFrame, image_col: str = "image", id_col: str = "img") -> DataFrame:
    """(img, k, x, y, scale, angle, d0 ...): one row per corner."""
    rows = images.select(quoted(id_col).alias("img"), F.posexplode(_described(quoted(image_col))).alias("k", "c"))
    return rows.select("img", "k", "c.*")


#: A block of images: their names, how many corners each has, and all these corners one after another (_ROW each).
_BLOCK = "imgs array<long>, counts array<int>, corners binary"
_ROW = np.dtype([*((n, "<f4") for n in _FLOATS), ("bits", "<u8", len(_WORDS))])


class Block(NamedTuple):
    """Images and their corners; ``of`` is the place of a corner's image."""

    imgs: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.imgs)), self.counts)

    def part(self, start: int, stop: int) -> Block:
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        return Block(self.imgs[start:stop], self.counts[start:stop], self.rows[ends[start] : ends[stop]])

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def keys(self) -> np.ndarray:
        """The keys of the corners in each band."""
        return np.ascontiguousarray(self.rows["bits"]).view(np.uint32).reshape(-1, BANDS).T

    def matching(self) -> Block:
        """The images that have corners enough for a copy."""
        enough = self.counts >= VOTES
        return self if enough.all() else Block(self.imgs[enough], self.counts[enough], self.rows[np.repeat(enough, self.counts)])


def _dealt(named: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``most`` corners, or a single image, from (names, corners of each, corners)."""
    held: list[Block] = []

    def packed() -> pa.RecordBatch:
        imgs, counts, rows = (np.concatenate(x) for x in zip(*held))
        kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((imgs, counts, rows.tobytes()), kinds)], ["imgs", "counts", "corners"])

    size = 0
    for imgs, counts, rows in named:
        rest = Block(imgs, counts, rows)
        while len(rest.imgs):
            room = int(np.searchsorted(np.cumsum(rest.counts) + size, most, side="right"))
            if not room and held:
                yield packed()
                held, size = [], 0
                continue
            held.append(rest.part(0, max(1, room)))
            size += len(held[-1].rows)
            rest = rest.part(max(1, room), len(rest.imgs))
    if held:
        yield packed()


def _rows(c: pa.StructArray | pa.RecordBatch) -> np.ndarray:
    get = c.field if isinstance(c, pa.StructArray) else c.column
    out = np.empty(len(c), _ROW)
    for n in _FLOATS:
        out[n] = get(n).to_numpy(zero_copy_only=False)
    for n, word in enumerate(_WORDS):
        out["bits"][:, n] = get(word).to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def blocks(described: DataFrame) -> DataFrame:
    """Blocks of about BLOCK corners from (img, c), c being the corners as ``_described`` returns them."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                c = batch["c"]
                counts = np.diff(c.offsets.to_numpy())
                yield batch["img"].to_numpy()[counts > 0], counts[counts > 0], _rows(c.flatten())

        return _dealt(named(), most)

    return described.select("img", "c").mapInArrow(run, _BLOCK)


def _candidates(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each band the corners of ``a`` whose key ``b`` has: (corners, first place and number of the partners in the order), order of ``b``."""
    for x, y in zip(a, b):
        order = np.argsort(y)
        key, first, n = np.unique(y[order], return_index=True, return_counts=True)
        at = np.searchsorted(key, x)
        at[at == len(key)] = 0
        own = np.flatnonzero(key[at] == x) if len(key) else np.zeros(0, int)
        yield own, first[at[own]], n[at[own]], order


def _near(a: Block, b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the corners (i, j) that share a key and differ in at most DISTANCE bits, once each."""
    p, q = (np.ascontiguousarray(x.rows["bits"]) for x in (a, b))
    for band, (own, first, n, order) in enumerate(_candidates(a.keys, b.keys)):
        ends = np.cumsum(n)
        start = 0
        while start < len(own):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            k = n[start:stop]
            i, j = np.repeat(own[start:stop], k), order[np.repeat(first[start:stop], k) + _counted(k)]
            apart = p[i] ^ q[j]
            close = np.bitwise_count(apart).sum(axis=1, dtype=np.int32) <= DISTANCE
            # two corners meet under the first of the keys they share
            close[close] = (apart[close].view(np.uint32)[:, :band] != 0).all(axis=1)
            yield i[close], j[close]
            start = stop


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1 ... n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _shared(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each corner of ``a`` the images of ``b`` that have one of its keys, as bits, and the other way round."""
    out = [np.zeros((len(x.rows), -(-len(y.imgs) // 8)), np.uint8) for x, y in ((a, b), (b, a))]
    of = [x.of for x in (a, b)]
    for x, y in zip(a.keys, b.keys):
        names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        at = at[: len(x)], at[len(x) :]
        has = [np.bincount(v, minlength=len(names)) > 0 for v in at]
        both = has[0] & has[1]
        place = np.cumsum(both) - 1
        own = [np.flatnonzero(both[v]) for v in at]
        row = [place[v[o]] for v, o in zip(at, own)]
        for side, other in ((0, 1), (1, 0)):
            held = np.zeros((np.count_nonzero(both), out[side].shape[1]), np.uint8)
            image = of[other][own[other]]
            np.bitwise_or.at(held, (row[other], image >> 3), (128 >> (image & 7)).astype(np.uint8))
            out[side][own[side]] |= held[row[side]]
    return out[0], out[1]


def _often(bits: np.ndarray, block: Block) -> np.ndarray:
    """For each image of the block the bits that at least VOTES of its corners have: counters of a few bits, which run over there."""
    size = VOTES.bit_length()
    start = (1 << size) - VOTES
    planes = [np.full((len(block.imgs), bits.shape[1]), 255 * (start >> n & 1), np.uint8) for n in range(size)]
    over, first = np.zeros((len(block.imgs), bits.shape[1]), np.uint8), block.first
    for k in range(block.counts.max(initial=0)):
        some = np.flatnonzero(block.counts > k)
        carry = bits[first[some] + k]
        for plane in planes:
            old = plane[some]
            plane[some], carry = old ^ carry, old & carry
        over[some] |= carry
    return over


def _having(block: Block, image: np.ndarray, bits: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, corner): the corners of the n-th image that share a key with the n-th other image."""
    n = block.counts[image]
    which, corner = np.repeat(np.arange(len(image)), n), np.repeat(block.first[image], n) + _counted(n)
    to = other[which]
    has = (bits[corner, to >> 3] << (to & 7).astype(np.uint8) & 128) > 0
    return which[has], corner[has]


def _distinct(group: np.ndarray, corner: np.ndarray, groups: int) -> np.ndarray:
    """How many different corners each group has."""
    span = int(corner.max(initial=0)) + 1
    return np.bincount(np.unique(group * span + corner) // span, minlength=groups)


def _votes(pair: np.ndarray, p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs whose matches agree on a transform: those of which VOTES corners on both sides fall into one bin of one of the 16 grids."""
    turn = (q["angle"] - p["angle"]).astype(np.float64)
    grow = q["scale"].astype(np.float64) / p["scale"]
    x = q["x"] - grow * (np.cos(turn) * p["x"] - np.sin(turn) * p["y"])
    y = q["y"] - grow * (np.sin(turn) * p["x"] + np.cos(turn) * p["y"])
    places, pair = np.unique(pair, return_inverse=True)
    agreed = np.zeros(len(places), bool)
    held = [pair, i.astype(np.int64), j.astype(np.int64), turn, np.log(grow) / np.log(2), x, y]
    for grid in range(16):
        if not len(held[0]):
            break
        pair, i, j = held[:3]
        half = [(grid >> n & 1) * 0.5 for n in range(4)]
        bins = [np.floor(v / width + h).astype(np.int64) for v, width, h in zip(held[3:], (np.pi / 6, 0.5, 16.0, 16.0), half)]
        bins[0] %= 12
        # bins far apart may fall together in the 64 bits, so that they are compared again below
        mixed = pair.astype(np.uint64)
        for v in bins:
            mixed = (mixed ^ v.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)
        begin = np.flatnonzero(np.diff(mixed[order], prepend=~mixed[order[:1]]))
        some = order[np.repeat(np.diff(begin, append=len(order)) >= VOTES, np.diff(begin, append=len(order)))]
        if not len(some):
            continue
        names = np.stack([pair[some], *(v[some] for v in bins)])
        order = np.lexsort(names)
        some, names = some[order], names[:, order]
        group = np.cumsum(np.concatenate([[False], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
        enough = np.minimum(_distinct(group, i[some], group[-1] + 1), _distinct(group, j[some], group[-1] + 1)) >= VOTES
        agreed[names[0, enough[group]]] = True
        held = [v[~agreed[pair]] for v in held]
    return places[agreed]


def _agreed(a: Block, b: Block, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs of images whose matches (i, j) agree on a transform."""
    # a pair with too few matches cannot agree
    keep = np.bincount(pair, minlength=1)[pair] >= VOTES
    i, j, pair = i[keep], j[keep], pair[keep]
    p, q = a.rows[i], b.rows[j]
    swap = a.imgs[a.of[i]] > b.imgs[b.of[j]]
    return _votes(pair, np.where(swap, q, p), np.where(swap, p, q), i, j)


def _of_large(a: Block, b: Block) -> bool:
    """Whether two single images are copies."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for found in _near(a, b):
        held.append(found)
        waiting += len(found[0])
        if waiting > PART:  # what agrees by now is enough
            held, waiting = [tuple(np.concatenate(x) for x in zip(*held))], 0
            if len(_agreed(a, b, np.zeros(len(held[0][0]), int), *held[0])):
                return True
    i, j = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, int),) * 2
    return len(_agreed(a, b, np.zeros(len(i), int), i, j)) > 0


def _of_some(a: Block, b: Block, x: np.ndarray, y: np.ndarray, bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the pairs of images (x, y) are copies."""
    (m, own), (n, other) = _having(a, x, bits[0], y), _having(b, y, bits[1], x)
    partners = np.bincount(n, minlength=len(y))
    k = partners[m]
    pair, i, j = np.repeat(m, k), np.repeat(own, k), other[np.repeat((np.cumsum(partners) - partners)[m], k) + _counted(k)]
    p, q = (np.ascontiguousarray(v.rows["bits"].T) for v in (a, b))
    close = [np.zeros(0, int)]
    for at in range(0, len(i), PAIRS):
        apart = [u[i[at : at + PAIRS]] ^ v[j[at : at + PAIRS]] for u, v in zip(p, q)]
        near = np.flatnonzero(sum(np.bitwise_count(word).astype(np.uint16) for word in apart) <= DISTANCE)
        same = np.zeros(len(near), bool)
        for word in apart:
            same |= (word[near].view(np.uint32).reshape(-1, 2) == 0).any(axis=1)
        close.append(near[same] + at)
    close = np.concatenate(close)
    return _agreed(a, b, pair[close], i[close], j[close])


class Forest:
    """Which images of the blocks that a task has seen are joined."""

    def __init__(self) -> None:
        self.begin: dict[int, int] = {}
        self.root = np.zeros(0, np.int64)

    def places(self, block: Block) -> int:
        """The place of the block's first image."""
        begin = self.begin.setdefault(int(block.imgs[0]), len(self.root))
        if begin == len(self.root):
            self.root = np.concatenate([self.root, np.arange(begin, begin + len(block.imgs))])
        return begin

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Join the pairs one after another; the pairs that were not joined by those before."""
        new = []
        for n, ends in enumerate(zip(x.tolist(), y.tolist())):
            u, v = ends
            while self.root[u] != u:
                u = int(self.root[u])
            while self.root[v] != v:
                v = int(self.root[v])
            if u != v:
                self.root[max(u, v)] = min(u, v)
                new.append(n)
        while not np.array_equal(over := self.root[self.root], self.root):
            self.root = over
        return np.array(new, int)


def _linked(a: Block, b: Block, same: bool, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the images of the blocks that are copies, the smaller first; with ``forest`` only such as join images not joined yet."""
    a, b = a.matching(), b.matching()
    if not len(a.imgs) or not len(b.imgs):
        return
    bits = _shared(a, b)
    often, back = _often(bits[0], a), _often(bits[1], b)
    left, right = (forest.places(a), forest.places(b)) if forest else (0, 0)
    step = max(8, PART // len(b.imgs) // 8 * 8)
    for at in range(0, len(a.imgs), step):
        some = np.unpackbits(often[at : at + step], axis=1, count=len(b.imgs))
        some &= np.unpackbits(back[:, at // 8 : (at + step) // 8], axis=1)[:, : len(some)].T
        x, y = np.nonzero(some)
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        if forest:  # the links of a group are met in any order, so that few join it
            order = np.random.default_rng(len(x)).permutation(len(x))
            x, y = x[order], y[order]
        while len(x):
            if forest:
                apart = forest.root[left + x] != forest.root[right + y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
            work = a.counts[x[:SOME]].astype(np.int64) * b.counts[y[:SOME]]
            n = max(1, int(np.searchsorted(np.cumsum(work), PART, side="right")))
            if work[0] > PART:
                found = np.arange(n)[: _of_large(a.part(x[0], x[0] + 1), b.part(y[0], y[0] + 1))]
            else:
                found = _of_some(a, b, x[:n], y[:n], bits)
            if forest and len(found):
                found = found[forest.join(left + x[found], right + y[found])]
            if len(found):
                p, q = a.imgs[x[found]], b.imgs[y[found]]
                yield np.minimum(p, q), np.maximum(p, q)
            x, y = x[n:], y[n:]


def linked(dealt: DataFrame, every: bool = True) -> DataFrame:
    """(a, b): the image pairs found to be copies, from blocks written out: every block meets every other and itself once.

    Without ``every`` a task leaves out pairs of images that others of its pairs join already; the components are the same.
    Both sides of the product are read from the files anew by each task, so that nothing but the blocks and the pairs takes disk.
    """
    most = max(1, min(dealt.rdd.getNumPartitions(), PARTITIONS))
    side = lambda n: dealt.coalesce(most).select(*(F.col(c).alias(c + n) for c in dealt.columns))
    # no image is in two blocks
    met = side("1").hint("shuffle_replicate_nl").join(side("2"), F.element_at("imgs1", 1) <= F.element_at("imgs2", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None if every else Forest()
        for batch in batches:
            for n in range(len(batch)):
                one, two = (Block(*(batch[c + s][n].values.to_numpy() for c in ("imgs", "counts")), np.frombuffer(batch["corners" + s][n].as_buffer(), _ROW)) for s in "12")
                for a, b in _linked(one, two, one.imgs[0] == two.imgs[0], forest):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def copies(found: DataFrame) -> DataFrame:
    """(a, b): the image pairs found to be copies, from rows as of ``corners``."""
    c = F.transform(F.array_sort(F.collect_list(F.struct("k", *_FLOATS, *_WORDS))), lambda x: F.struct(*(x[n].alias(n) for n in (*_FLOATS, *_WORDS))))
    return linked(cut(blocks(found.where("img is not null").groupBy("img").agg(c.alias("c")))))


def classes(df: DataFrame, id_col: str = "vec_id", image_col: str = "image") -> DataFrame:
    """(id, class_id, n_corners) of every row; class_id is the smallest id of the copies that reach one another."""
    rows = df.select(quoted(id_col).alias("id"), quoted(image_col).alias("image"))
    rows = rows.withColumn("img", F.xxhash64(F.coalesce("image", F.lit(b""))))
    ids = cut(rows.select("id", "img"))
    distinct = rows.groupBy("img").agg(F.min("image").alias("image"))
    parts = max(1, min(PARTITIONS, -(-ids.count() // IMAGES)))
    dealt = cut(blocks(distinct.repartition(parts, "img").select("img", _described("image").alias("c"))))
    roots = components(linked(dealt, every=False))
    roots = cut(roots.union(roots.select("root", "root").distinct()))
    least = ids.groupBy("img").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    found = dealt.select(F.explode(F.arrays_zip("imgs", "counts")).alias("x")).select(F.col("x.imgs").alias("img"), F.col("x.counts").cast("long").alias("n_corners"))
    counted = least.join(found, "img", "left").join(roots, F.col("img") == F.col("node"), "left")
    counted = cut(counted.select("img", "least", F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("root", "img").alias("root")))
    named = counted.groupBy("root").agg(F.min("least").alias("class_id"))
    known = cut(counted.join(named, "root").select("img", "class_id", "n_corners"))
    return ids.join(known, "img").select("id", "class_id", "n_corners")


#: Pixels per component, side by side, of a rendered vector.
CELL = 8


@F.arrow_udf(T.BinaryType())
def _rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for vectors in batches:
        out = []
        for v in vectors:
            x = np.array([0.0 if c is None or not np.isfinite(c) else c for c in v.as_py() or []], np.float64)
            if not len(x):
                out.append(None)
                continue
            side = int(np.ceil(np.sqrt(len(x))))
            grid = np.zeros(side * side)
            spread = np.ptp(x) or 1.0
            grid[: len(x)] = np.rint((x - x.min()) / spread * 255)
            out.append(pgm(np.kron(grid.reshape(side, side), np.ones((CELL, CELL)))))
        yield pa.array(out, pa.binary())


def with_rendering(df: DataFrame, vector_col: str = "embedding", out_col: str = "image") -> DataFrame:
    """Add a picture of each vector, a square of grey cells, as a media column for tables that have none."""
    return df.withColumn(out_col, _rendered(quoted(vector_col)))
