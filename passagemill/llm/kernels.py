"""NumPy kernels over whole Arrow batches of text: words, word hashes, shingles.

Words are runs of bytes outside ASCII white space (0x20, 0x09-0x0D); no UTF-8
byte of a longer character falls there, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, dtype=np.uint64)
_BASE = (int(_random.integers(0, 1 << 60)) * 8 + 3) % (1 << 64)
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers for the words of an n-gram, by place.
PLACE = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text worked on at once.
CHUNK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _segments(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and documents of pieces of at most ``limit`` bytes, cut after white space; a longer single word stays whole."""
    lengths = np.diff(offsets)
    if not len(lengths) or lengths.max() <= limit:
        return offsets, np.arange(len(lengths))
    bounds, owners = [0], []
    for d in range(len(lengths)):
        at, end = int(offsets[d]), int(offsets[d + 1])
        while end - at > limit:
            spaces = np.flatnonzero(SPACE[data[at : at + limit]])
            if len(spaces):
                cut = at + int(spaces[-1]) + 1
            else:
                ahead = np.flatnonzero(SPACE[data[at + limit : end]])
                cut = at + limit + int(ahead[0]) + 1 if len(ahead) else end
            bounds.append(cut)
            owners.append(d)
            at = cut
        bounds.append(end)
        owners.append(d)
    return np.array(bounds, dtype=np.int64), np.array(owners, dtype=np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds of the pieces in them, document of each piece), about ``limit`` bytes at a time."""
    bounds, owners = _segments(data, offsets, limit)
    low = 0
    while low < len(owners):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1)
        yield data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], owners[low:high]
        low = high


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a bound."""
    solid = ~SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    full = bounds[:-1][np.diff(bounds) > 0]
    starts[full] = solid[full]
    full = bounds[1:][np.diff(bounds) > 0] - 1
    ends[full] = solid[full]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by one running polynomial over all of them."""
    up, down = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts])


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column in order, and len + 1 bounds of each text's words. ``lower`` folds A-Z."""
    data, offsets = text_buffer(column)
    hashes, counts = [], np.zeros(len(column), dtype=np.int64)
    for part, bounds, owners in chunks(data, offsets):
        part = LOWER[part] if lower else part
        starts, ends = word_bounds(part, bounds)
        hashes.append(span_hashes(part, starts, ends))
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, bounds)))
    limits = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(counts, out=limits[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), limits


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that starts at each word; callers keep those inside one text."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = words[: len(words) - n + 1] * PLACE[0]
    for k in range(1, n):
        total += words[k : len(words) - n + 1 + k] * PLACE[k]
    return mix(total)


def shingle_sets(words: np.ndarray, limits: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-word shingles; fewer words count as one shingle, none as no shingle."""
    grams = ngram_hashes(words, n)
    for low, high in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if high - low >= n:
            yield np.unique(grams[low : high - n + 1])
        elif high > low:
            short = words[low:high]
            yield mix((short * PLACE[: len(short)]).sum(dtype=np.uint64, keepdims=True) + PLACE[32 + len(short) % 16])
        else:
            yield np.zeros(0, dtype=np.uint64)
