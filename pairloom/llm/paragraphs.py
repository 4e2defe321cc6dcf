"""Substring dedup: repeated paragraphs by MinHash banding, exact Jaccard and components.

Units are a text's lines; the sentences of lines that hold more than one, and runs of those under ``least`` words, which show a
passage set into other text; and windows of ``window`` words that need no line break or punctuation: of every ``window`` that
begin one after another, the one of the smallest hash, so that a passage of 2 * ``window`` - 1 words or more has a window in
common with its copy wherever it begins and ends. Lines, sentences and runs have ``least`` words or more; their set is their
distinct ``k``-word shingles. They are banded: ``tune`` finds the bands and rows a band that give the wanted recall at the
threshold with fewest hashes. Sentences and runs too short to link to an equally long one with another word (13 words at 0.8)
match if their sets are equal, and windows if their words are.

The texts are read twice rather than kept. The first pass sends on band values only: units that share one and may be of linking
sizes are chained into candidate groups, never paired up. The second sends on where units are, by ranges of their names, and
keeps those that occur again or are in a candidate group. ``linking`` verifies each group by exact Jaccard. Units of one
component form a cluster; its first occurrence (smallest id, then text hash and place) stays and all others are removals.
Removals of a text that overlap or follow each other word by word are merged, kept occurrences likewise; so a span never holds
a word that isn't part of a repeated unit. Spans under ``span`` words are no passages.

Both passes work in chunks of ``CHUNK`` units. What a chunk holds more than once of a unit is not gathered by its name, so a
unit that very many texts share reaches the task of its name once a chunk.

Defined results: a null or empty text has no units; null ids sort last; rows alike in id and text count once; a passage that
only repeats inside one text is found if ``inside`` says so; an empty table gives no rows. Whole texts are read; offsets are code points, ends
exclusive. Units and texts go by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import OWN, Workspace, returning, shuffle_partitions
from .components import connected, forest
from .jaccard import _among, _bins, _starts
from .linking import blocked, link_groups

LEAST, SPAN, WINDOW, RECALL = 8, 25, 25, 0.99
#: Units a chunk, bytes of text looked at together, units cut out of a text together.
CHUNK, BYTES, CUTS = 40_000, 1 << 18, 2048
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
#: Keeps names of windows apart from those of sets.
_WINDOWS, _ITEM = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
_SPOT = ("start", "end", "words", "word")


def tune(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows a band) with the most rows of those that reach the recall at the threshold with up to 32 hashes; with more
    hashes if none does."""
    limit = 32
    while True:
        fit = [(b, r) for r in range(1, limit + 1) for b in range(1, limit // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
        if fit or limit >= most:
            return max(fit, key=lambda x: (x[1], -x[0])) if fit else (most, 1)
        limit *= 2


def _runs(keep: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the runs of kept places that no break (True: a run can't go on here) cuts."""
    new = keep.copy()
    new[1:] &= ~keep[:-1] | np.logical_or.reduce([b[1:] for b in breaks])
    first = np.flatnonzero(new)
    last = keep.copy()
    last[:-1] &= ~keep[1:] | new[1:]
    return first, np.flatnonzero(last) + 1


class _Sets:
    """The shingle sets of units that don't overlap: sizes, names, and minima under any hash."""

    def __init__(self, every: np.ndarray, a: np.ndarray, b: np.ndarray, k: int):
        size = b - a - k + 1
        self.begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(a)), size)
        self.flat = every[np.arange(len(owner)) - (self.begin - a)[owner]]
        bits = np.uint64(max(1, len(a).bit_length()))
        one = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (self.flat >> bits)  # sorts every unit's shingles at once
        one.sort()
        again = np.flatnonzero(one[1:] == one[:-1]) + 1
        self.n = size - np.bincount(owner[again], minlength=len(a))
        short = S.mix((one << bits) >> np.uint64(24) ^ _ITEM)  # 40 bits whatever the number of units
        short[again] = 0
        self.names = S.mix(np.add.reduceat(short, self.begin) + self.n.astype(np.uint64) * _ITEM) if len(a) else S._EMPTY

    def keys(self, factors: np.ndarray):
        """A value a band and unit."""
        for band, own in enumerate(factors):
            key = np.full(len(self.n), band + 1, np.uint64)
            for f in own:
                key = S.mix(key * np.uint64(31) + np.minimum.reduceat(self.flat * f, self.begin))
            yield key


class _Words:
    """The words of some texts and the units they make up."""

    def __init__(self, column, least: int, k: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column, "").cast(pa.large_string())
        data, offsets = S.column_bytes(pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
        self.hashes, _ = S.words(data, offsets[[0, -1]])
        edge = np.flatnonzero(np.diff(~S._SPACE[data], prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data, self.offsets, self.least, self.k = data, offsets, least, k
        m = max(len(self.hashes) - k + 1, 0)
        self.every = np.zeros(m, np.uint64)
        for j in range(k):
            self.every += self.hashes[j : m + j] * S._PLACE[j]
        self.every = S.mix(self.every)

    def lines_and_sentences(self, other: float = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and past-the-last words of the lines, and of the sentences and runs of short ones inside lines; of the latter
        those with at least ``other`` words."""
        none = (np.empty(0, np.int64),) * 2
        if not len(self.starts):
            return [none, none]
        line = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        new_line = _starts(line)
        a = np.flatnonzero(new_line)
        b = np.append(a[1:], len(line))
        ended = new_line.copy()
        ended[1:] |= _ENDS[self.data[self.ends[:-1] - 1]]
        s = np.flatnonzero(ended)
        e = np.append(s[1:], len(line))
        per = np.diff(np.append(np.searchsorted(s, a), len(s)))
        several = np.repeat(per > 1, per)
        opens = new_line[s]
        long = e - s >= self.least
        first, last = _runs(several & ~long, opens)
        whole = opens[first] & np.append(opens, True)[last]  # the line again
        run_a, run_b = s[first[~whole]], e[last[~whole] - 1]
        sa, sb = np.concatenate([s[several & long], run_a]), np.concatenate([e[several & long], run_b])
        order = np.argsort(sa)
        keep = lambda x, y, least: (x[y - x >= least], y[y - x >= least])
        return [keep(a, b, self.least), keep(sa[order], sb[order], max(self.least, other))]

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and names of the windows chosen."""
        n = len(self.hashes) - w + 1
        whole = np.flatnonzero(self.text[2 * w - 2 :] == self.text[: max(n - w + 1, 0)])
        if not len(whole):
            return np.empty(0, np.int64), S._EMPTY
        keys, power = np.zeros(n, np.uint64), np.uint64(1)
        for j in range(w):
            keys += self.hashes[j : n + j] * power
            power = np.uint64(int(power) * 0x9E3779B97F4A7C15 % (1 << 64))
        keys = S.mix(keys ^ _WINDOWS)
        least = np.lib.stride_tricks.sliding_window_view(keys, w).argmin(1)
        chosen = np.zeros(n, bool)
        chosen[whole + least[whole]] = True
        at = np.flatnonzero(chosen)
        # Of equal windows that overlap, as in a text of one word, one stays.
        by = at[np.lexsort((at, keys[at], self.text[at]))]
        if ((keys[by[1:]] == keys[by[:-1]]) & (by[1:] - by[:-1] < w)).any():
            last = kept = None
            for x, key in zip(by.tolist(), keys[by].tolist()):
                if last is not None and key == last and 0 <= x - kept < w:
                    chosen[x] = False
                else:
                    last, kept = key, x
            at = np.flatnonzero(chosen)
        return at, keys[at]

    def spots(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers, and places in code points and words, of the units from word a to before word b."""
        if not hasattr(self, "_points"):
            points = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
            self._points = points[self.starts], points[self.ends], points[self.offsets]
        start, end, base = self._points
        text = self.text[a]
        return text, np.stack([start[a] - base[text], end[b - 1] - base[text], b - a, a - self.first[text]], 1).astype(np.int32)


def _slices(batches, column: str):
    """Parts of batches with about BYTES of text, or one text."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _banded(texts: DataFrame, k: int, least: int, bands: int, rows: int, percent: int, ranges: int) -> DataFrame:
    """Blobs of band values, units' names and size bins by range; and of chained units (names only) where keys is null."""
    factors = np.random.default_rng(5).integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    borders = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)

    def run(batches):
        import pyarrow as pa

        parts, waiting = [], 0

        def flush():
            keys, names, bins = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((bins, keys))
            keys, names, bins = keys[order], names[order], bins[order]
            # Of a band value's units of one size bin that meet here one is sent on, chained to the rest.
            first = _starts(keys, bins)
            at = np.flatnonzero(~first)
            at = at[names[at - 1] != names[at]]
            chain = np.array(forest(zip(names[at - 1].tolist(), names[at].tolist())), np.int64).reshape(-1, 2)
            keys, names, bins = keys[first], names[first], bins[first]
            cuts = np.searchsorted(keys, borders).tolist() + [len(keys)]
            keys = (keys * np.uint64(ranges)).view(np.uint8).reshape(-1, 8)[:, 3:]  # a range's keys differ in these 40 bits
            blobs = [(r, keys[a:b].tobytes(), names[a:b].tobytes(), bins[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if len(chain):
                blobs.append((int(chain[0, 0]) % ranges, None, chain.tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["range", "keys", "names", "bins"])

        for part in _slices(batches, "text"):
            words = _Words(part.column("text"), least, k)
            for a, b in words.lines_and_sentences(other=(200 if percent == 100 else (100 + percent) / (100 - percent)) + k - 1):
                if not len(a):
                    continue
                sets = _Sets(words.every, a, b, k)
                bins = _bins(sets.n, percent).astype(np.int8)
                parts += [(key, sets.names.view(np.int64), bins) for key in sets.keys(factors)]
                waiting += len(a)
            if waiting >= CHUNK:
                yield flush()
                parts, waiting = [], 0
        if parts:
            yield flush()

    return texts.select("text").mapInArrow(returning(run), "range int, keys binary, names binary, bins binary")


def _edges(blobs: DataFrame) -> DataFrame:
    """Chains (a, b) of the units that share a band value and may be of linking sizes."""
    def run(batches):
        import pyarrow as pa

        def table(pairs):
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i], pa.int64()) for i in (0, 1)], ["a", "b"])

        def flush(rows):
            short, names, bins = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*rows), (np.uint8, np.int64, np.int8)))
            keys = np.zeros((len(names), 8), np.uint8)
            keys[:, :5] = short.reshape(-1, 5)
            keys = keys.view(np.uint64).ravel()
            order = np.lexsort((bins, keys))
            keys, names, bins = keys[order], names[order], bins[order]
            at = np.flatnonzero((keys[1:] == keys[:-1]) & (bins[1:] - bins[:-1] <= 1) & (names[1:] != names[:-1]))
            return table(np.array(forest(zip(names[at].tolist(), names[at + 1].tolist())), np.int64).reshape(-1, 2))

        last, rows = None, []
        for batch in batches:
            for to, keys, names, bins in zip(*(c.to_pylist() for c in batch.columns)):
                if keys is None:
                    yield table(np.frombuffer(names, np.int64).reshape(-1, 2))
                    continue
                if to != last and rows:
                    yield flush(rows)
                    rows = []
                last = to
                rows.append((keys, names, bins))
        if rows:
            yield flush(rows)

    return blobs.repartition("range").sortWithinPartitions("range").mapInArrow(returning(run), "a long, b long")


def _packed(spots: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(spots.T).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(blob, 4 * n * len(_SPOT), "zstd", asbytes=True), np.int32).reshape(len(_SPOT), n)


def _located(texts: DataFrame, k: int, least: int, window: int, ranges: int) -> DataFrame:
    """Blobs of units (names, texts' keys, places) by range of names. more: by unit whether its chunk holds it again; null
    for units whose name's first one in the chunk is in another blob."""
    def run(batches):
        import pyarrow as pa

        parts, waiting, flushed = [], 0, 0

        def flush():
            names, keys, spots = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(names, kind="stable")
            names, keys, spots = names[order], keys[order], spots[order]
            first = _starts(names)
            more = np.append(~first[1:], False)[first]
            known = flushed % ranges, names[~first].tobytes(), keys[~first].tobytes(), _packed(spots[~first]), None
            names, keys, spots = names[first], keys[first], spots[first]
            to = names % ranges
            order = np.argsort(to, kind="stable")
            names, keys, spots, more, to = names[order], keys[order], spots[order], more[order], to[order]
            cuts = np.searchsorted(to, np.arange(ranges + 1))
            blobs = [(r, names[a:b].tobytes(), keys[a:b].tobytes(), _packed(spots[a:b]), more[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if known[1]:
                blobs.append(known)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.int32(), *[pa.binary()] * 4))], ["range", "names", "keys", "spots", "more"])

        for part in _slices(batches, "text"):
            words, own = _Words(part.column("text"), least, k), part.column("key").to_numpy(zero_copy_only=False)
            flushed = flushed or int(own[0]) if len(own) else flushed  # where a task begins to deal out what needs no range
            found = [(a, b, _Sets(words.every, a, b, k).names) for a, b in words.lines_and_sentences() if len(a)]
            at, names = words.windows(window)
            for a, b, names in [*found, (at, at + window, names)]:
                if len(a):
                    text, spots = words.spots(a, b)
                    parts.append((names.view(np.int64), own[text], spots))
                    waiting += len(a)
            if waiting >= CHUNK:
                yield flush()
                parts, waiting, flushed = [], 0, flushed + 1
        if parts:
            yield flush()

    return texts.select("key", "text").mapInArrow(returning(run), "range int, names binary, keys binary, spots binary, more binary")


def _again(blobs: DataFrame, groups: DataFrame, ranges: int) -> DataFrame:
    """(class, key, start, end, words, word) of the units that occur again or are in a candidate group."""
    def run(batches):
        import pyarrow as pa

        def table(names, keys, spots):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (names, keys, *spots)], ["class", "key", *_SPOT])

        def flush(rows, nodes):
            names, keys, more = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((0, np.int64), (1, np.int64), (3, bool)))
            spots = np.hstack([_unpacked(r[2], len(r[0]) // 8) for r in rows])
            order = np.argsort(names, kind="stable")
            names = names[order]
            first = np.flatnonzero(_starts(names))
            size = np.diff(np.append(first, len(names)))
            keep = (size > 1) | np.logical_or.reduceat(more[order], first)
            if nodes:
                keep |= np.isin(names[first], np.concatenate(nodes))
            keep = np.repeat(keep, size)
            return table(names[keep], keys[order[keep]], spots[:, order[keep]])

        last, rows, nodes = None, [], []
        for batch in batches:
            for to, node, *blob in zip(batch.column("range").to_pylist(), batch.column("nodes").to_pylist(), *(batch.column(c).to_pylist() for c in ("names", "keys", "spots", "more"))):
                if to != last:
                    if rows:
                        yield flush(rows, nodes)
                    last, rows, nodes = to, [], []
                if node is not None:
                    nodes.append(np.array(node, np.int64))
                elif blob[3] is None:
                    yield table(np.frombuffer(blob[0], np.int64), np.frombuffer(blob[1], np.int64), _unpacked(blob[2], len(blob[0]) // 8))
                else:
                    rows.append(blob)
        if rows:
            yield flush(rows, nodes)

    named = groups.select(F.pmod("node", F.lit(ranges)).cast("int").alias("range"), "node").groupBy("range", F.pmod(F.xxhash64("node"), F.lit(16)).alias("part"))
    named = named.agg(F.collect_list("node").alias("nodes")).drop("part")
    both = blobs.unionByName(named, allowMissingColumns=True).repartition("range").sortWithinPartitions("range")
    kind = "class long, key long, " + ", ".join(f"{c} int" for c in _SPOT)
    return both.mapInArrow(returning(run), kind)


def _members(found: DataFrame, k: int) -> DataFrame:
    """grp, block, k, item and items of the ``units`` of texts."""
    kinds = {"grp": "long", "block": "long", "k": "long", "item": "binary"}

    def run(batches):
        import pyarrow as pa

        def table(parts, cut):
            columns = [pa.chunked_array([p.field(c) for p in parts]).combine_chunks() for c in kinds]
            sets = S.text_shingles(pa.array(cut, pa.large_string()), k)
            return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sets], pa.binary())], [*kinds, "items"])

        parts, cut = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                text, units = batch.column("text")[i].as_py(), batch.column("units")[i].values
                for at in range(0, len(units), CUTS):
                    part = units.slice(at, CUTS)
                    parts.append(part)
                    cut += [text[a:b] for a, b in zip(part.field("start").to_pylist(), part.field("end").to_pylist())]
                    if len(cut) >= CUTS:
                        yield table(parts, cut)
                        parts, cut = [], []
        if cut:
            yield table(parts, cut)

    return found.select("text", "units").mapInArrow(returning(run), ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", items binary")


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = S.SHINGLE, percent: int = 80, recall: float = RECALL, least: int = LEAST, span: int = SPAN, window: int = WINDOW, inside: bool = False) -> DataFrame:
    """One row a repeated passage of a text: the id under its name, text_hash, start, end, words, cluster (of its first unit),
    first_id (where that cluster's kept occurrence is) and removed (false where all its units are kept ones). inside: also those
    that only repeat inside one text."""
    spark = docs.sparkSession
    space, ranges, least = Workspace(spark, "paragraphs"), 4 * shuffle_partitions(spark), max(least, k)
    bands, rows = tune(percent / 100, recall)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    texts = texts.withColumn("key", F.xxhash64("id", "place"))
    groups = connected(space, _edges(_banded(texts, k, least, bands, rows, percent, ranges)))
    found = _again(_located(texts, k, least, window, ranges), groups, ranges)
    named = texts.select(F.col("key").alias("own"), "id", "place").dropDuplicates(["own"])
    seen = space.save(found.join(named.select("own", "id"), F.col("key") == F.col("own")).drop("own").dropDuplicates(["key", "start", "end", "class"]))
    at = F.struct(F.col("id").isNull().alias("no"), "id", "key", "start", "end")
    classes = seen.groupBy("class").agg(F.min(at).alias("at"), F.max("words").alias("n"), F.count(F.lit(1)).alias("times"), F.min("key").alias("low"), F.max("key").alias("high"))
    repeated = F.col("times") > 1 if inside else F.col("low") != F.col("high")
    classes = space.save(classes.join(groups, F.col("class") == F.col("node"), "left").where(repeated | F.col("node").isNotNull()))
    grouped = classes.where("node is not null").withColumn("item", F.unhex(F.lpad(F.hex("class"), 16, "0")))
    members = grouped.select("item", "n", F.col("root").alias("grp"), F.col("at.key").alias("at_place"), "at.start", "at.end")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("m"))
    members = space.save(blocked(members, sizes))
    # A text comes once for all of its units, of which it has no more than words.
    wanted = members.groupBy("at_place").agg(F.collect_list(F.struct("start", "end", "grp", "block", "k", "item")).alias("units"))
    once = _among(texts.select(F.col("key").alias("place"), "text"), members).join(wanted, F.col("place") == F.col("at_place"))
    split = not members.where("k > 1").isEmpty()
    linked = space.save(link_groups(space, _members(once, k), percent, split))
    own = grouped.select("class", "times", "at", "low", "high", F.col("item").alias("own")).join(linked, F.col("own") == F.col("item"))
    whole = own.groupBy("root").agg(F.sum("times").alias("times"), F.min("at").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = whole.where(repeated).select(F.col("root").alias("r"), "first")
    first = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "key", "start")]
    label = own.join(whole, F.col("root") == F.col("r")).select(F.col("class").alias("cls"), F.conv(F.hex("root"), 16, -10).cast("long").alias("cluster"), *first)
    lone = classes.where("node is null").select(F.col("class").alias("cls"), F.col("class").alias("cluster"), F.col("at").alias("first"))
    label = space.save(label.unionByName(lone.select("cls", "cluster", *first)))
    removed = (F.col("first_key") != F.col("key")) | (F.col("first_start") != F.col("start"))
    hits = seen.select("class", "key", "start", "end", "words", "word").join(label, F.col("class") == F.col("cls"))
    hits = hits.select("key", removed.alias("removed"), "start", "end", "word", (F.col("word") + F.col("words")).alias("upto"), "cluster", "first_id")
    text_order = Window.partitionBy("key", "removed").orderBy("word", "upto", "cluster")
    before = F.max("upto").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce(F.col("word") > before, F.lit(True)).cast("int"))
    hits = hits.withColumn("span", F.sum("new").over(text_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = hits.groupBy("key", "removed", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("upto") - F.min("word")).alias("words"), F.min(F.struct("word", "upto", "cluster", "first_id")).alias("first"))
    merged = merged.where(F.col("words") >= span).join(named, F.col("key") == F.col("own"))
    return merged.select(F.col("id").alias(doc_id), F.col("place").alias("text_hash"), "start", "end", "words", F.lower(F.hex("first.cluster")).alias("cluster"), F.col("first.first_id").alias("first_id"), "removed")


def without(docs: DataFrame, passages: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed passages cut out of the texts."""
    from .spans import masked

    cuts = passages.where("removed").groupBy(F.col(doc_id).alias(OWN + "id"), F.col("text_hash").alias(OWN + "hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(OWN + "cuts"))
    safe = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(OWN + "place", F.xxhash64(safe))
    rows = rows.join(cuts, F.col(doc_id).eqNullSafe(F.col(OWN + "id")) & (F.col(OWN + "place") == F.col(OWN + "hash")), "left")
    new = F.when(F.col(OWN + "cuts").isNotNull(), masked(safe, F.col(OWN + "cuts"), lambda x: F.lit(""))).otherwise(F.col(text))
    return rows.withColumn(text, new).select(*docs.columns)
