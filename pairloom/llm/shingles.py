"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D; only A-Z are lower-cased. A text's shingles are its
runs of ``k`` consecutive words; with fewer words the whole sequence is its one shingle; without words it has none.
A shingle is named by a 64-bit hash: the chance that two different shingles of a compared pair collide is below 2**-40
for sets of a thousand, so set sizes and intersections are taken as exact.

Work is done in blocks of about ``BLOCK`` bytes cut at white space, so a text of any length needs bounded memory besides
its own hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 1 << 19
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.empty(0, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte block."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    if len(word) and word[-1]:
        edge = np.concatenate((edge, [len(word)]))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _blocks(data: np.ndarray, cuts: np.ndarray):
    """Ranges of about BLOCK bytes that end at a cut, or at white space inside a text longer than that."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + BLOCK)
        if to < end:
            cut = cuts[np.searchsorted(cuts, to, "right") - 1]
            if cut > at:
                to = int(cut)
            else:
                limit = int(cuts[np.searchsorted(cuts, at, "right")])
                while to < limit:
                    gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(limit, to + 4096)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and each text's first place among them (one more at the end).

    data: the texts' bytes, offsets: where each begins, and the end.
    """
    parts, begins = [], []
    cuts = np.asarray(offsets, np.int64)
    for at, to in _blocks(data, cuts):
        # A text border inside the block separates words even without white space.
        block = data[at:to]
        inner = cuts[(cuts > at) & (cuts < to)]
        if len(inner):
            spread = np.full(len(block) + len(inner), 32, np.uint8)
            move = np.searchsorted(inner, np.arange(at, to), "right")
            spread[np.arange(len(block)) + move] = block
            starts, _, found = _word_hashes(spread)
            begins.append(starts - np.searchsorted(inner - at + np.arange(len(inner)), starts, "left") + at)
        else:
            starts, _, found = _word_hashes(block)
            begins.append(starts + at)
        parts.append(found)
    if not parts:
        return _EMPTY, np.zeros(len(cuts), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(begins), cuts, "left")


def shingles(found: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, from what words() gives."""
    n = len(found)
    every = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        every += found[j : n - k + 1 + j] * _PLACE[j]
    every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(mix((found[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(_EMPTY)
    return out


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_shingles(column, k: int = SHINGLE) -> list[np.ndarray]:
    """The shingle set of every text of an Arrow string array."""
    return shingles(*words(*column_bytes(column)), k)


def digest(x: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()
