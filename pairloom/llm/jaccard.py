"""N-gram Jaccard join of texts by T-occurrence search.

Two texts link when their sets of distinct k-word shingles have 100 * intersection >= percent * union. The result is exact:

1. One pass hashes every text to its set's size and digest, and counts shingles in a table of ``CELLS`` counters (a few MB
   at any input size). Equal sets form a class, searched once.
2. A shingle's list is short or long by its counter: shingles are ordered rare first. By DivideSkip's bound, all but
   n - ceil(percent * n) + 1 lists of a text may count as long, so each text is posted only under its rarest shingles. Two
   texts that link share one of these at least. How many they share is counted: what is left of the text whose posted
   shingles end first must make up for the rest of the overlap, which drops nearly all chance pairs and no link.
   A shingle with very many texts, ``LONG`` or twice what its counter can tell from chance, is never paired up: its texts are
   chained by size, which keeps every pair that shares it and may link in one candidate group, and a task sends on only one
   text for each size bin of such a list. The counters' noise grows with the input, and lists under it are paired up: chained,
   they joined unlike texts to candidate groups of tens of thousands.
3. Components of the candidate pairs are candidate groups; ``linking`` searches each exactly (heap-merged short lists,
   binary-probed long ones).

Defined results: a null or empty text, or one of separators only, has no shingles and links with nothing; a text of fewer
words than k has its whole sequence as its one shingle; rows with equal sets are linked, repeated rows and repeated ids
included; null ids are kept, and a class's label is its smallest id that isn't null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import OWN, Workspace, returning, shuffle_partitions
from .components import connected, forest
from .linking import blocked, link_groups

CELL_BITS, RANGE_BITS = 22, 6
CELLS, LONG, FLUSH, ROWS = 1 << CELL_BITS, 64, 500_000, 256
#: Marks a posting that stands for others of its size bin.
_REPRESENTS = np.uint32(0xFFFFFFFF)


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _class(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _signed(texts: DataFrame, k: int) -> DataFrame:
    """By text: n, digest, class; and by range of counters one row of the partition's counts."""
    schema = T.StructType([T.StructField(c, texts.schema[c].dataType) for c in ("id", "place")])
    schema.add("n", T.LongType()).add("digest", T.BinaryType()).add("class", T.LongType()).add("cells", T.IntegerType()).add("counts", T.BinaryType())

    def run(batches):
        import pyarrow as pa

        cells = np.zeros(CELLS, np.uint32)
        kinds = None
        for batch in _slices(batches):
            sets = S.text_shingles(batch.column("text"), k)
            np.add.at(cells, _cell(np.concatenate(sets)), 1)
            names = [S.digest(x) for x in sets]
            m, kinds = len(sets), [batch.schema.field("id").type, batch.schema.field("place").type]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("place"), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary()),
                 pa.array(map(_class, names), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema.names)
        if kinds:
            parts = cells.reshape(1 << RANGE_BITS, -1)
            blobs = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                 pa.array(range(m), pa.int32()), pa.array(blobs, pa.binary())], schema.names)

    return texts.select("id", "place", "text").mapInArrow(returning(run), schema)


def _levels(signed: DataFrame) -> tuple[np.ndarray, int]:
    """By counter how common its shingles are: 0 for no more than chance, then one more for each doubling; and how many texts a
    list has at most to be paired up.

    The counts are added up on the executors; the driver gets two bytes a counter, CELLS in all. They keep a count to one
    part in 90: coarser steps would hide what chance doesn't.
    """
    width = CELLS >> RANGE_BITS

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(pa.decompress(counts.as_py(), width * 4, "zstd"), np.uint32)
                sums[cells] = sums.get(cells, np.zeros(width, np.uint64)) + got
        for cells, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([cells], pa.int32()), pa.array([np.round(64 * np.log2(x + 1.0)).astype(np.uint16).tobytes()], pa.binary())], ["cells", "q"])

    rows = signed.where("cells is not null").select("cells", "counts").repartition("cells").mapInArrow(returning(run), "cells int, q binary").collect()
    q = np.zeros((1 << RANGE_BITS, width), np.uint16)
    for row in rows:
        q[row.cells] = np.frombuffer(row.q, np.uint16)
    counts = 2 ** (q.ravel() / 64.0) - 1
    mean = counts.mean()
    chance = 3 * mean**0.5
    return np.log2(np.maximum(counts - mean, 0) / max(4, chance) + 1).astype(np.uint8), max(LONG, int(2 * chance))


def _bins(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sizes whose ratio allows a link are in the same or adjacent bins."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _spread(keys, classes, n, lasts, percent, most):
    """Chain edges of the long lists, and the postings to send on: of long lists one for each size bin."""
    order = np.lexsort((n, keys))
    keys, classes, n, lasts = keys[order], classes[order], n[order], lasts[order]
    first = np.flatnonzero(_starts(keys))
    size = np.diff(np.append(first, len(keys)))
    long = np.repeat(size > most, size)
    bins = _bins(n, percent)
    at = np.flatnonzero(long[1:] & (keys[1:] == keys[:-1]) & (bins[1:] - bins[:-1] <= 1))
    edges = np.stack([classes[at], classes[at + 1]], 1)
    keep = ~long | _starts(keys, bins)
    lasts = np.where(long, _REPRESENTS, lasts)
    return edges, keys[keep], classes[keep], n[keep], lasts[keep]


def _postings(texts: DataFrame, levels, k: int, percent: int, ranges: int, most: int = LONG) -> DataFrame:
    """Blobs of postings (shingle, class, size, first bits of the text's last posted shingle) by range of shingles."""
    def run(batches):
        import pyarrow as pa

        level, seen = levels.value, set()
        parts, waiting = [], 0

        def flush():
            edges, *rest = _spread(*(np.concatenate(x) for x in zip(*parts)), percent, most)
            keys = rest[0]
            to = (S.mix(keys) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(ranges + 1))
            rest = [x[order] for x in rest]
            blobs = [[x[a:b].tobytes() for x in rest] for a, b in zip(cuts, cuts[1:]) if b > a]
            at = np.flatnonzero(np.diff(cuts))
            linked = np.array(forest(map(tuple, edges.tolist())), np.int64).reshape(-1, 2)
            columns = [pa.array(at, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*blobs)), pa.nulls(len(at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            if len(linked):
                columns = [pa.array([int(linked[0, 0]) % ranges], pa.int32()), *[pa.nulls(1, pa.binary())] * 4, pa.array([linked.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["range", "keys", "classes", "n", "lasts", "edges"]
        for batch in _slices(batches):
            for x in S.text_shingles(batch.column("text"), k):
                if not len(x):
                    continue
                me = _class(S.digest(x))
                if me in seen:
                    continue
                seen.add(me)
                n = len(x)
                short = n - (percent * n + 99) // 100 + 1
                own = (level[_cell(x)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                own = np.sort(np.partition(own, short - 1)[:short]) if short < n else np.sort(own)
                parts.append((own, np.full(short, me), np.full(short, n, np.uint32), np.full(short, own[-1] >> np.uint64(48), np.uint32)))
                waiting += short
            if waiting >= FLUSH:
                yield from flush()
                parts, waiting = [], 0
                seen.clear()
        if parts:
            yield from flush()

    return texts.select("text").mapInArrow(returning(run), "range int, keys binary, classes binary, n binary, lasts binary, edges binary")


def _pairs(keys, classes, n, lasts, percent, most=LONG) -> np.ndarray:
    """Rows (class, class, shared shingles, shared shingles needed) from the postings of a range."""
    order = np.lexsort((classes, n, keys))
    keys, classes, n, lasts = keys[order], classes[order], n[order].astype(np.int64), lasts[order]
    new = _starts(keys, classes)
    if not len(new):
        return np.empty((0, 4), np.int64)
    flag = np.maximum.reduceat(lasts == _REPRESENTS, np.flatnonzero(new))
    keys, classes, n, lasts = keys[new], classes[new], n[new], lasts[new].astype(np.int64)
    first = np.flatnonzero(_starts(keys))
    size = np.diff(np.append(first, len(keys)))
    long = np.repeat((size > most) | np.maximum.reduceat(flag, first), size)
    bins = _bins(n, percent)
    at = np.flatnonzero(long[1:] & (keys[1:] == keys[:-1]) & (bins[1:] - bins[:-1] <= 1))
    out = [_pair_rows(classes[at], classes[at + 1], np.zeros(len(at), np.int64))]
    left = np.repeat(first + size, size) - np.arange(len(keys)) - 1
    rest = (percent * n + 99) // 100 - 1  # elements that aren't posted
    at = np.flatnonzero(~long & (left > 0))
    for step in range(1, most):
        at = at[left[at] >= step]
        if not len(at):
            break
        to = at + step
        ok = 100 * n[at] >= percent * n[to]
        x, y = at, to = at[ok], to[ok]  # what comes after a text that is too large is no smaller
        overlap = (percent * (n[x] + n[y]) + 99 + percent) // (100 + percent)
        beyond = np.where(lasts[x] < lasts[y], rest[x], np.where(lasts[x] > lasts[y], rest[y], np.maximum(rest[x], rest[y])))
        out.append(_pair_rows(classes[x], classes[y], np.maximum(overlap - beyond, 0)))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.flatnonzero(_starts(rows[:, 0], rows[:, 1]))
    if not len(new):
        return np.empty((0, 4), np.int64)
    need = np.minimum.reduceat(rows[:, 2], new)
    return np.column_stack([rows[new, :2], np.diff(np.append(new, len(rows))), need])


def _pair_rows(a, b, need):
    return np.column_stack([np.minimum(a, b), np.maximum(a, b), need])


def _candidates(postings: DataFrame, percent: int, most: int = LONG) -> DataFrame:
    """Edges a, b between classes that may link."""
    names = ["a", "b", "shared", "need"]

    def run(batches):
        import pyarrow as pa

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i]), pa.int64()) for i in range(4)], names)

        def flush(rows):
            arrays = [np.frombuffer(b"".join(c), d) for c, d in zip(zip(*rows), (np.uint64, np.int64, np.uint32, np.uint32))]
            return table(_pairs(*arrays, percent, most))

        last, rows = None, []
        for batch in batches:
            for to, *blobs, edges in zip(*(c.to_pylist() for c in batch.columns)):
                if edges is not None:
                    pairs = np.frombuffer(edges, np.int64).reshape(-1, 2)
                    yield table(np.column_stack([pairs, np.ones(len(pairs), np.int64), np.zeros(len(pairs), np.int64)]))
                    continue
                if to != last and rows:
                    yield flush(rows)
                    rows = []
                last = to
                rows.append(blobs)
        if rows:
            yield flush(rows)

    found = postings.repartition("range").sortWithinPartitions("range").mapInArrow(returning(run), "a long, b long, shared long, need long")
    enough = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    return enough.select("a", "b")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """grp, block, k, item (digest) and items of texts whose class is the one expected."""
    kind = "grp long, block long, k long, item binary, items binary"

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            sets = S.text_shingles(batch.column("text"), k)
            rows = zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "k", "class")), sets)
            out = [(g, b, n, d, x.tobytes()) for g, b, n, c, x in rows if _class(d := S.digest(x)) == c]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["grp", "block", "k", "item", "items"])

    return texts.mapInArrow(returning(run), kind)


def _in_bitmap(rows: DataFrame, place: str, keys: DataFrame, at: str, name: str) -> DataFrame:
    """rows with the boolean ``name``: false only if no key has ``at`` equal to the row's ``place``. A bitmap of 2**24 hashes as at
    most 2**18 rows of 64 bits, whose size bounds the broadcast. With very many keys it is true for more rows, never for fewer."""
    word = lambda c: F.shiftrightunsigned(c, 46)
    bits = keys.groupBy(word(F.col(at)).alias(OWN + "word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({at}, 40) & 63 as int))")).alias(OWN + "bits"))
    held = F.expr(f"shiftrightunsigned({OWN}bits, cast(shiftrightunsigned({place}, 40) & 63 as int)) & 1") == 1
    rows = rows.join(F.broadcast(bits), word(F.col(place)) == F.col(OWN + "word"), "left")
    return rows.withColumn(name, F.coalesce(held, F.lit(False))).drop(OWN + "word", OWN + "bits")


def _among(texts: DataFrame, members: DataFrame) -> DataFrame:
    """texts without most of those that are no member, so that these aren't shuffled."""
    return _in_bitmap(texts, "place", members, "at_place", "held").where("held").drop("held")


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = S.SHINGLE, percent: int = 80) -> DataFrame:
    """One row a row of docs: its id under its name, n_shingles, component_id (the smallest id of all that links reach),
    component_class (a digest that names the component even where ids are null or repeated) and text_hash (xxhash64)."""
    return _joined(Workspace(docs.sparkSession, "ngram-join"), docs, doc_id, text, k, percent)


def _joined(space: Workspace, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    spark = space.spark
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    signed = space.save(_signed(texts, k))
    levels, most = _levels(signed)
    levels = spark.sparkContext.broadcast(levels)
    rows = signed.where("cells is null").select("id", "place", "n", "digest", "class")
    edges = space.save(_candidates(_postings(texts, levels, k, percent, 4 * shuffle_partitions(spark), most), percent, most))
    groups = connected(space, edges)
    space.drop(edges)
    classes = space.save(rows.where("n > 0").groupBy("digest").agg(
        F.first("class").alias("class"), F.first("n").alias("n"), F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "place")).alias("at")))
    members = classes.join(groups, F.col("class") == F.col("node")).select(
        F.col("digest").alias("item"), "class", "n", F.col("root").alias("grp"), F.col("at.id").alias("at_id"), F.col("at.place").alias("at_place"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("m"))
    members = space.save(blocked(members, sizes))
    found = _among(texts, members).join(members, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("place") == F.col("at_place")))
    split = not members.where("k > 1").isEmpty()
    linked = space.save(link_groups(space, _sets(found.select("text", "grp", "block", "k", "class"), k), percent, split))
    labels = linked.join(classes, F.col("item") == F.col("digest")).select("item", "root", "id")
    least = labels.groupBy("root").agg(F.min("id").alias("least"), F.min("item").alias("name")).withColumnRenamed("root", "r")
    labels = labels.join(least, F.col("root") == F.col("r")).select("item", "least", "name")
    own = classes.select(F.col("digest").alias("d"), F.col("id").alias("own"))
    label = space.save(own.join(labels, F.col("d") == F.col("item"), "left").select("d", F.coalesce("least", "own").alias("least"), F.coalesce("name", "d").alias("name")))
    out = rows.join(label, (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.coalesce("name", "digest").alias("component_class"), F.col("place").alias("text_hash"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = S.SHINGLE, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the one of the smallest id (null last), then of the smallest text
    hash. Rows without shingles all stay.

    Texts are not shuffled to learn which of them stay: a bitmap of what doesn't stay whole lets most kept rows pass where they
    are read, a bitmap of kept rows that the first one holds drops most others, and only rows in both are joined."""
    spark = docs.sparkSession
    join, space = Workspace(spark, "ngram-join"), Workspace(spark, "keep-one")
    key = [OWN + "id", OWN + "hash"]
    found = _joined(join, docs, doc_id, text, k, percent).select(F.col(doc_id).alias(key[0]), F.col("text_hash").alias(key[1]), F.col("component_class").alias("class"), "n_shingles")
    found = space.save(found)
    join.clear()
    row = F.struct(F.col(key[0]).isNull().alias("no"), *key)
    alone = F.when(F.col("n_shingles") == 0, row)
    kept = found.groupBy("class", alone.alias("alone")).agg(F.min(row).alias("row"), F.max("n_shingles").alias("n"))
    kept = kept.select("row.*", (F.col("n") == 0).alias("every"), F.lit(0).alias("times")).drop("no")
    both = kept.unionByName(found.select(*key, F.lit(None).cast("boolean").alias("every"), F.lit(1).alias("times")))
    marks = both.groupBy(*key).agg(F.max("every").alias("every"), F.sum("times").alias("times"))
    # stays: null for rows that all go, true for rows that all stay, false for repeated rows of which one stays.
    marks = marks.select(*key, F.when(F.col("every").isNotNull(), F.col("every") | (F.col("times") == 1)).alias("stays"))
    marks = space.save(_placed(marks, key))
    space.drop(found)
    partly = marks.where("stays is null or not stays")
    near = _in_bitmap(marks.where("stays is not null"), OWN + "one", partly, OWN + "one", "held").where("held")
    near = space.save(near.select(F.col(key[0]).alias("near_id"), F.col(key[1]).alias("near_hash"), F.col("stays").alias(OWN + "stays"), F.col(OWN + "two").alias("near_two")))
    rows = docs.withColumn(key[0], F.col(doc_id)).withColumn(key[1], F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = _in_bitmap(_placed(rows, key), OWN + "one", partly, OWN + "one", OWN + "partly")
    doubt = _in_bitmap(rows.where(OWN + "partly"), OWN + "two", near, "near_two", OWN + "near").where(OWN + "near")
    doubt = doubt.join(near, F.col(key[0]).eqNullSafe(F.col("near_id")) & (F.col(key[1]) == F.col("near_hash")))
    again = Window.partitionBy(*key).orderBy(OWN + "stays")
    doubt = doubt.withColumn(OWN + "n", F.row_number().over(again)).where(F.col(OWN + "stays") | (F.col(OWN + "n") == 1))
    columns = [F.col(c) for c in docs.columns]
    return rows.where(~F.col(OWN + "partly")).select(*columns).unionByName(doubt.select(*columns))


def _placed(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with two hashes of their key, for two bitmaps."""
    return rows.withColumn(OWN + "one", F.xxhash64(*key)).withColumn(OWN + "two", F.xxhash64(*key, F.lit(2)))
