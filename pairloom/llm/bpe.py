"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by a pattern. Tier one: a minimal perfect hash over the vocabulary's byte strings names the
one slot a whole pre-token could have; if the slot's bytes are equal, its id is the result. Tier two, for the rest: the
bytes form a doubly linked list, and a heap gives the adjacent pair of lowest rank, leftmost first, until none can be
merged. Either result is remembered per worker (a repeated pre-token gives the same ids) in a table of ``ROOM`` bytes, which
is asked for many pre-tokens at once: two rows for a hash of a pre-token's bytes, each of fewer than ``ROW`` ids. A row counts
only if its ids stand for the very bytes asked for. A new one takes the first row, what was there the second. Short
pre-tokens of more ids are in a dictionary of at most ``MEMO``, which is emptied when full.

The vocabulary is read on the driver from a path given by the caller and broadcast: its size is that of the file, which
``Codec`` refuses above ``MAX_VOCABULARY`` entries. Whole texts of any length are encoded; a null is an empty text; special
tokens are never made from text. Decoding an id outside the vocabulary raises a KeyError.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import sys
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import portions, returning

MEMO, MEMO_BYTES, ROWS, BLOCK = 1 << 17, 64, 200, 1 << 15
#: Bytes of the table of remembered ids, and numbers in a row of it: how many ids, then the ids.
ROOM, ROW = 1 << 24, 8
#: An odd number, its inverse modulo 2^64 and a mixer, for the hashes of pieces.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(BASE, -1, 1 << 64)
_AFTER, _BEFORE = list(range(1, 257)), list(range(-1, 255))
SHIFT = 24
MAX_VOCABULARY = 2_000_000
#: The pre-token pattern in terms of the standard library's classes, for texts in which these agree with \p{L} and \p{N}.
_PLAIN = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PerfectHash:
    """A minimal perfect hash by hash and displace: keys fall in buckets of two on average; the largest bucket first, a
    seed is sought for each that sends its keys to free slots; buckets of one key are given the slots left over."""

    def __init__(self, keys: list[bytes]):
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        self.n = n = len(keys)
        self.buckets = m = max(1, n // 2)
        groups: list[list[int]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            groups[hashed(key) % m].append(i)
        slot_of, taken, seeds = [-1] * n, bytearray(n), array("q", bytes(8 * m))
        order = sorted(range(m), key=lambda b: -len(groups[b]))
        for at, b in enumerate(order):
            group = groups[b]
            if len(group) < 2:
                break
            seed = 1
            while True:
                slots = {hashed(keys[i], seed) % n for i in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                seed += 1
            seeds[b] = seed
            for i in group:
                slot_of[i] = hashed(keys[i], seed) % n
                taken[slot_of[i]] = 1
        else:
            at = len(order)
        free = (s for s in range(n) if not taken[s])
        for b in order[at:]:
            for i in groups[b]:
                slot_of[i] = next(free)
                seeds[b] = -slot_of[i] - 1
        self.seeds, self.slots = seeds, slot_of

    def slot(self, key: bytes) -> int:
        """The only slot that ``key`` can have; any key gives some slot."""
        import xxhash

        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        return -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n


class Codec:
    """A vocabulary of byte strings with ranks: encodes pre-tokens and texts, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = _GENERAL):
        if not 0 < len(ranks) <= MAX_VOCABULARY:
            raise ValueError(f"a vocabulary has 1 to {MAX_VOCABULARY} entries, not {len(ranks)}")
        self.pattern = pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.key_at, self.id_at = [b""] * len(keys), [0] * len(keys)
        for i, slot in enumerate(self.hash.slots):
            self.key_at[slot], self.id_at[slot] = keys[i], ranks[keys[i]]
        self.hash.slots = []
        self.bytes_of = {i: k for k, i in ranks.items()}
        if not 0 <= min(self.bytes_of) <= max(self.bytes_of) < 1 << SHIFT:
            raise ValueError(f"ranks are from 0 to {(1 << SHIFT) - 1}")
        self.part_len = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, part in self.bytes_of.items():
            self.part_len[i] = len(part)
        self.part_at = np.cumsum(self.part_len) - self.part_len
        self.parts = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.byte_id = [ranks[bytes([c])] for c in range(256)]
        self.first = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self._known, self._pairs = _Known(self), _Pairs(self)

    @classmethod
    def from_file(cls, path: str, pattern: str = _GENERAL) -> Codec:
        """A file of lines "base64 rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}, pattern)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._known, self._pairs = _Known(self), _Pairs(self)

    def whole(self, piece: bytes) -> int:
        """The id of a piece that is in the vocabulary as a whole, else -1."""
        slot = self.hash.slot(piece)
        return self.id_at[slot] if self.key_at[slot] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by merging its bytes' pairs, the lowest rank first and the leftmost of equals.

        ids[i] is the part that begins at byte i, or -1 once it is merged into one before it. now[i] is the heap's entry, rank
        and place in one number, of the pair that begins there, or -1; another entry of the place has been overtaken. live counts
        the entries that have not.
        """
        n, pairs, first, push, pop = len(piece), self._pairs, self.first, heapq.heappush, heapq.heappop
        width = n.bit_length()
        place = (1 << width) - 1
        ids = [self.byte_id[c] for c in piece]
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= len(_AFTER) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        now, heap = [-1] * n, []
        row = first[piece[0]] if piece else None
        for i, c in enumerate(piece[1:]):
            if (r := row[c]) >= 0:
                now[i] = x = r << width | i
                heap.append(x)
            row = first[c]
        live = len(heap)
        heapq.heapify(heap)
        while live:
            x = pop(heap)
            i = x & place
            if now[i] != x:
                continue
            rank, j = x >> width, after[i]
            live -= 1 + (now[j] >= 0)
            ids[i], ids[j], now[i], now[j] = rank, -1, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank << SHIFT | ids[k]]) >= 0:
                    now[i] = x = r << width | i
                    push(heap, x)
                    live += 1
            h = before[i]
            if h >= 0:
                live -= now[h] >= 0
                if (r := pairs[ids[h] << SHIFT | rank]) >= 0:
                    now[h] = x = r << width | h
                    push(heap, x)
                    live += 1
                else:
                    now[h] = -1
        return [x for x in ids if x >= 0]

    def piece(self, piece: bytes) -> list[int]:
        found = self.whole(piece)
        return [found] if found >= 0 else self.merge(piece)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text: each match of the pattern."""
        if self.pattern == _GENERAL and _known.holds(text):
            return _plain().findall(text)
        return [x for x in _general(self.pattern).findall(text) if x]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, of one text: without the table."""
        return pack([i for x in self.cut(text) for i in self.piece(x.encode())])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; what the table of remembered ids holds is found for up to BLOCK pre-tokens at once."""
        cuts = [self.cut(x) for x in texts]
        pieces = list(itertools.chain.from_iterable(cuts))
        found = [self._known.ids(pieces[at : at + BLOCK]) for at in range(0, len(pieces), BLOCK)]
        ids = b"".join(x.tobytes() for x, _ in found)
        upto = np.cumsum(np.concatenate([[0], *(n for _, n in found)])) * 4
        cuts = upto[np.cumsum([0, *map(len, cuts)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that each packed list of ids stands for."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.part_len) or (self.part_len[ids] == 0).any()):
            raise KeyError("an id outside the vocabulary")
        size = self.part_len[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        data = self.parts[np.repeat(self.part_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cuts = upto[np.cumsum([0, *(len(x) // 4 for x in packed)])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class _Known:
    """The ids of pieces met before, in ``rows``, and in ``long`` those that do not fit a row."""

    def __init__(self, codec: Codec):
        self.codec, self.long, self.rows, self.powers = codec, {}, None, None

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each has."""
        if self.rows is None:  # only where texts are encoded
            kind = np.dtype("u2" if len(self.codec.part_len) <= 1 << 16 else "u4")
            self.rows = np.zeros((ROOM // (ROW * kind.itemsize), ROW), kind)
        whole = "".join(pieces)
        data = whole.encode()
        buf = np.frombuffer(data, np.uint8)
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
        if len(data) > len(whole):  # from code points to bytes
            upto = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(data))[upto]
        begin, size = upto[:-1], np.diff(upto)
        at = self.places(buf, upto)
        rest, parts, n = np.arange(len(pieces)), [], np.zeros(len(pieces), np.int64)
        for second in (0, 1):
            rows = self.rows[at[rest] + second]
            same = self.same(rows, buf, begin[rest], size[rest])
            rows = rows[same]
            parts.append((rest[same], rows[:, 1:][np.arange(1, ROW) <= rows[:, :1]]))
            n[rest[same]] = rows[:, 0]
            rest = rest[~same]
        if len(rest):
            parts.append((rest, self.found(data, begin[rest].tolist(), upto[rest + 1].tolist(), at, rest, n)))
        out, to = np.empty(n.sum(), "<u4"), np.cumsum(n) - n
        for where, ids in parts:
            m = n[where]
            out[np.repeat(to[where] - (np.cumsum(m) - m), m) + np.arange(len(ids))] = ids
        return out, n

    def places(self, buf: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The first row of each piece: by its bytes as digits to an odd base, from sums over the whole block."""
        if self.powers is None:
            self.powers = _powers(BLOCK * 8)
        up, down = self.powers if len(buf) < len(self.powers[0]) else _powers(len(buf))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf + np.uint64(1)) * up[: len(buf)])))[upto]
        mixed = (sums[1:] - sums[:-1]) * down[upto[:-1]]
        mixed = (mixed ^ mixed >> np.uint64(32)) * MIX
        return (mixed >> np.uint64(32)).astype(np.int64) % (len(self.rows) // 2) * 2

    def same(self, rows: np.ndarray, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each row, whether its ids stand for the bytes of the piece beside it."""
        codec, used = self.codec, np.arange(1, ROW) <= rows[:, :1]
        length = np.where(used, codec.part_len[rows[:, 1:]], 0)
        same = length.sum(axis=1) == size
        if same.any():
            begin, size = begin[same], size[same]
            ids = rows[same][:, 1:][used[same]]
            length = length[same][used[same]]
            steps = np.arange(length.sum())
            theirs = codec.parts[np.repeat(codec.part_at[ids] - (np.cumsum(length) - length), length) + steps]
            starts = np.cumsum(size) - size
            same[same] = ~np.logical_or.reduceat(theirs != buf[np.repeat(begin - starts, size) + steps], starts)
        return same

    def found(self, data: bytes, begin: list[int], end: list[int], at: np.ndarray, rest: np.ndarray, n: np.ndarray) -> list[int]:
        """The ids of the pieces ``rest``, which no row has: each different one is encoded once. Sets their numbers in n."""
        codec, long, new, out, many = self.codec, self.long, {}, [], []
        for k, (a, b) in enumerate(zip(begin, end)):
            piece = data[a:b]
            if (ids := new.get(piece)) is None:
                ids = long.get(piece)
                ids = (codec.piece(piece) if ids is None else unpack(ids).tolist(), k)
                new[piece] = ids
            out += ids[0]
            many.append(len(ids[0]))
        n[rest] = many
        rows = []
        for piece, (ids, k) in new.items():
            if len(ids) < ROW:
                rows.append((at[rest[k]], [len(ids), *ids, *[0] * (ROW - 1 - len(ids))]))
            elif len(piece) <= MEMO_BYTES and piece not in long:
                if len(long) >= MEMO:
                    long.clear()
                long[piece] = pack(ids)
        if rows:
            to = np.array([x for x, _ in rows])
            self.rows[to + 1] = self.rows[to]
            self.rows[to] = [x for _, x in rows]
        return out


class _Pairs(dict):
    """The rank of two adjacent parts, or -1: the perfect hash's answer for their bytes, remembered."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: int) -> int:
        parts = self.codec.bytes_of
        if len(self) >= MEMO:
            self.clear()
        found = self[pair] = self.codec.whole(parts[pair >> SHIFT] + parts[pair & (1 << SHIFT) - 1])
        return found


def _powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers of 0 to n."""
    powers = [np.full(n + 1, x, np.uint64) for x in (BASE, INVERSE)]
    for x in powers:
        x[0] = 1
        np.cumprod(x, out=x)
    return powers


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpack(packed: bytes) -> array:
    out = array("I", packed)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@functools.cache
def _general(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.cache
def _plain():
    return re.compile(_PLAIN)


class _Plain(set):
    """Characters seen so far whose classes agree between the standard library and \\p{L}, \\p{N} and White_Space."""

    def holds(self, text: str) -> bool:
        rest = set(text) - self
        for c in rest:
            kind = unicodedata.category(c)
            word, number = c.isalnum(), c.isdecimal()
            if (word and not number) != (kind[0] == "L") or number != (kind[0] == "N") or "\x1c" <= c <= "\x1f" or kind == "Cn":
                return False
            self.add(c)
        return True


_known = _Plain()


def encode(docs: DataFrame, codec: Codec, *, text: str = "text", packed: bool = False, decoded: bool = False, drop_text: bool = False) -> DataFrame:
    """docs with ``n_tokens`` (long) and ``ids``: array<int>, or with packed=True binary of little-endian 32-bit integers.

    decoded=True adds ``decoded``, the bytes the ids stand for. These replace columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    added = ["n_tokens", "ids", *["decoded"] * decoded]
    kept = [c for c in docs.columns if c not in added and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in kept])
    schema.add("n_tokens", T.LongType()).add("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))
    if decoded:
        schema.add("decoded", T.BinaryType())

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in portions(batches, text):
            ids = own.encode_all([x or "" for x in batch.column(text).to_pylist()])
            out = [batch.column(c) for c in kept] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if packed:
                out.append(pa.array(ids, pa.binary()))
            else:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            if decoded:
                out.append(pa.array(own.decode(ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*kept, *added])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(returning(run), schema)


def decode(docs: DataFrame, codec: Codec, *, ids: str = "ids") -> DataFrame:
    """docs with ``decoded``: the bytes that an array<int> or packed binary column of ids stands for (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    kept = [c for c in docs.columns if c != "decoded"]
    schema = T.StructType([docs.schema[c] for c in kept]).add("decoded", T.BinaryType())
    packed = isinstance(docs.schema[ids].dataType, T.BinaryType)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                found = batch.column(ids).to_pylist()
                texts = own.decode([x or b"" if packed else array("I", x or ()).tobytes() for x in found])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.binary())], [*kept, "decoded"])

    return docs.select(*kept).mapInArrow(returning(run), schema)
