"""What a Python worker holds at once comes on top of an executor's heap: it must not follow the rows or texts of a batch."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import bpe, common, toxicity


def _points(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def test_features_of_many_texts_are_found_in_little_memory():
    table = np.full(toxicity.DIMS, -1, np.int32)
    table[::64] = np.arange(toxicity.DIMS // 64)
    texts = [_points(8_000, i) for i in range(256)]
    tracemalloc.start()
    try:
        pairs = toxicity.hits(texts, table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6, peak
    again = [toxicity.hits([t], table) for t in texts[:5]]
    assert all(np.array_equal(pairs[pairs[:, 0] == i, 1], x[:, 1]) for i, x in enumerate(again))


def test_features_of_a_text_longer_than_a_block():
    text, table = _points(3 * toxicity.BLOCK + 11, 7), np.full(toxicity.DIMS, -1, np.int32)
    table[::16] = np.arange(toxicity.DIMS // 16)
    pieces = [text[at : at + 999] for at in range(0, len(text), 995)]  # every run of 5 is in one of them
    whole, parts = toxicity.hits(["", text, None, text], table), toxicity.hits(pieces, table)
    assert set(whole[:, 0]) == {1, 3} and np.array_equal(whole[whole[:, 0] == 1, 1], whole[whole[:, 0] == 3, 1])
    extra = set(whole[whole[:, 0] == 1, 1]) ^ set(parts[:, 1])
    edges = toxicity.hits([x for p in pieces for x in (p[:4], p[-4:])], table)
    assert extra <= set(edges[:, 1])  # the spaces set at a piece's ends


def test_portions_hold_every_row_once_and_are_bounded():
    texts = [None, "", "x" * 700, *("é" * 60 for _ in range(40)), "y" * 5_000, None, "z"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["id", "text"])
        got = list(common.portions([batch.slice(0, 0), batch, batch.slice(3, 5)], "text", rows=7, size=600))
        assert [i for b in got for i in b.column("id").to_pylist()] == [*range(len(texts)), *range(3, 8)]
        assert all(0 < b.num_rows <= 7 and (b.num_rows == 1 or sum(len((x or "").encode()) for x in b.column("text").to_pylist()) <= 600) for b in got)


def test_remembered_tokens_are_bounded():
    codec = bpe.Codec({bytes([c]): c for c in range(256)} | {b"ab": 256, b"abc": 257})
    before = codec.encode("abcab abd")
    tracemalloc.start()
    try:
        for i in range(150_000):
            codec.encode(f"ab{i:x}")
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 32e6 and codec.encode("abcab abd") == before, held


def test_many_different_pieces_are_merged_once_in_bounded_memory(monkeypatch):
    """More than the dictionary of old held, twice: emptied when full, it had nearly all of them merged again."""
    codec = bpe.Codec({bytes([c]): c for c in range(256)} | {b"ab": 256, b"abc": 257})
    calls, merge, letters = [0], codec.merge, "abcdefghijklmnopqrstuvwxyz"

    def counted(piece):
        calls[0] += 1
        return merge(piece)

    def texts():
        words = map("".join, itertools.islice(itertools.product(letters, repeat=4), 200_000))
        while some := list(itertools.islice(words, 5_000)):
            yield [" ".join(some[at : at + 500]) for at in range(0, len(some), 500)]

    monkeypatch.setattr(codec, "merge", counted)
    tracemalloc.start()
    try:
        for _ in range(2):
            for some in texts():
                ids = codec.encode_all(some)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert ids == [codec.encode(x) for x in some]
    assert calls[0] < 1.3 * 200_000 and held < 32e6, (calls, held)


@pytest.mark.parametrize("wide", [False, True])
def test_rows_of_other_pieces_are_never_taken(monkeypatch, wide):
    """Two rows for all pieces there are: a hit must be of the piece's own bytes."""
    monkeypatch.setattr(bpe, "ROOM", 2 * bpe.ROW * (4 if wide else 2))
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, "é".encode(): 70_000 if wide else 259}
    codec, rng = bpe.Codec(ranks), random.Random(5)
    texts = ["", *("".join(rng.choices("aabbcé 1", k=rng.randrange(60))) for _ in range(600)), "a" * 300 + " " + "b" * 300]
    for got, text in zip(codec.encode_all(texts) + codec.encode_all(texts[::-1])[::-1], texts * 2):
        assert list(bpe.unpack(got)) == [i for p in codec.cut(text) for i in ([codec.whole(p.encode())] if p.encode() in ranks else codec.merge(p.encode()))]
    assert b"".join(codec.decode(codec.encode_all(texts))) == "".join(texts).encode()
