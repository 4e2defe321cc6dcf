"""op1's operator against plain Python, and the linking of groups whose leaders stay undecided."""
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm import linking, paragraphs


def text_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copied_sentences_inside_lines_are_found(spark):
    rng, rows, wanted = random.Random(3), [], set()
    for i in range(60):
        one = text_of(rng, rng.randrange(50, 120)).split()
        two = list(one)
        two[rng.randrange(len(two))] = "other"
        a, b = " ".join(one), " ".join(two)
        if 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)):
            wanted |= {2 * i, 2 * i + 1}
        rows += [(2 * i + j, f"{text_of(rng, 40)}. {x}. {text_of(rng, 40)}.") for j, x in enumerate((a, b))]
    rows += [(1000 + i, f"{text_of(rng, 60)}. {text_of(rng, 60)}.\n{text_of(rng, 30)}") for i in range(40)]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id for r in found}
    assert len(wanted & got) >= 0.95 * len(wanted) and not [x for x in got if x >= 1000]


def test_text_that_does_not_repeat_stays(spark):
    rng = random.Random(5)
    first, second, own = text_of(rng, 40), text_of(rng, 40), text_of(rng, 9)
    rows = [(1, first), (2, second), (3, f"{first}\nUnique note 4711 kept here.\n{second}\n{own}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_passages(docs)
    assert {(r.doc_id, r.removed, r.words) for r in found.collect()} == {(1, False, 40), (2, False, 40), (3, True, 40)}
    left = {r.doc_id: r.text for r in paragraphs.without(docs, found).collect()}
    assert left[1] == first and left[2] == second and left[3].split() == ("Unique note 4711 kept here. " + own).split()


def test_defined_results(spark):
    rng = random.Random(6)
    line = text_of(rng, 30)
    rows = [(1, f"{line}\n{text_of(rng, 12)}\n{line}"), (None, None), (3, ""), (4, " \n\t"), (5, "a")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, removed int")
    assert paragraphs.repeated_passages(docs).count() == 0  # inside one text only
    same = spark.createDataFrame([rows[0], *rows], "doc_id long, text string")
    assert paragraphs.repeated_passages(same).count() == 0  # rows alike count once
    got = {(r.start, r.removed) for r in paragraphs.repeated_passages(same, inside=True).collect()}
    assert len(got) == 2 and (0, False) in got
    null = spark.createDataFrame([(None, line), (7, line), (7, "x " + line + " y")], "doc_id long, text string")
    assert {(r.doc_id, r.removed) for r in paragraphs.repeated_passages(null, span=20).where("words >= 30").collect()} == {(7, False), (None, True), (7, True)}
    long = text_of(rng, 60_000)
    huge = spark.createDataFrame([(1, long), (2, line + "\n" + long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id for r in paragraphs.repeated_passages(huge).collect()} == {1, 2}
    assert paragraphs.repeated_passages(docs.limit(0)).count() == 0


def test_groups_over_one_block_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(12):  # chains: each a step from the one before, so leaders' members link though leaders don't
        now = rng.choice(10**6, 60, replace=False).astype(np.uint64)
        for _ in range(12):
            now = now.copy()
            now[rng.choice(60, 5, replace=False)] = rng.integers(10**6, 10**9, 5).astype(np.uint64)
            sets.append(np.unique(now))
    names = [i.to_bytes(4, "big") for i in range(len(sets))]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    rows = spark.createDataFrame([(1, bytearray(n), bytearray(s.tobytes())) for n, s in zip(names, sets)], "grp long, item binary, items binary")
    sizes = rows.groupBy("grp").agg(F.count("item").alias("n"), F.sum(F.length("items") / 8).alias("m"))
    for merged in (0.5, 0.99):  # by half blocks at once, and only where leaders stop merging
        plain, linking.MERGED = linking.MERGED, merged
        try:
            got = linking.link_groups(linking.Workspace(spark, "test"), linking.blocked(rows, sizes, 90, 10**6), 80, True, 90, 10**6).collect()
        finally:
            linking.MERGED = plain
        label = {bytes(r.item): bytes(r.root) for r in got}
        assert len(label) == len(sets)
        for i in range(len(sets)):
            for j in range(i):
                assert (label[names[i]] == label[names[j]]) == (root(i) == root(j))
