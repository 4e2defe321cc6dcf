import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import queries, syncmers


def _x(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def codes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if not words:
        return []
    if len(words) < 5:
        return [(_x(" ".join(words)) & (1 << 64) - 1) >> 32]
    g = [_x(a, b) for a, b in zip(words, words[1:])]
    out = []
    for i in range(len(words) - 4):
        s = g[i : i + 4]
        if min(s) in (s[0], s[3]):
            out.append((_x(*s) & (1 << 64) - 1) >> 32)
    return out


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def model(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        a, b, c = codes(text), codes(edited), codes(after)
        hexed = lambda x: "".join(f"{v:08x}" for v in x)
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)


@pytest.mark.parametrize("rows", [
    [(1, None), (2, ""), (5, "é a b c d e f g h"), (9, "A b\tc d"), (7, "x " * 3000), (-3, "one two three four five six"), (100, "x " * 3000)],
    [(4, "alone here with some words in it")],
    [(i, " ".join(str((i * j) % 17) for j in range(i % 23))) for i in range(200)],
])
def test_matches_a_plain_model(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_syncmers(spark, str(tmp_path))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(model(rows))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a", 1), (None, "b", 2), (3, "c", 3), (3, "c", 4), (1, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r long")
    got = syncmers.with_next(docs).orderBy(F.col("doc_id").desc_nulls_last(), "text").collect()
    assert len(got) == 5 and {r.next_text for r in got if r.doc_id == 3} == {"c", ""}
    assert [r.next_text for r in got if r.doc_id == 1][0] in ("a", "b")
    assert syncmers.with_next(docs.limit(0)).count() == 0
