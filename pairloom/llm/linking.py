"""Exact links of similar sets inside candidate groups, by T-occurrence search with DivideSkip.

Two sets link when 100 * intersection >= percent * union. A group's sets are searched one after another against an
inverted index of leaders. A set within the link distance of a leader becomes its member; one within no leader's reach
becomes a leader. As the Jaccard distance is a metric, a set can only link to a leader's member if it is within the link
distance plus the member's own distance of the leader, so leaders in between are looked at more closely: their members
are compared until one links. So no link between different components is missed, yet a group of n near copies costs about
n searches of a few leaders and not n * n.

Groups over ``BLOCK`` sets or ``BLOCK_ITEMS`` elements are split into blocks by hash. Up to ``WIDE`` blocks every two half
blocks of the group's sets meet in a task of their own. In larger groups each block is linked on its own; then the blocks'
leaders, with the radius of what they stand for, form the next round's groups, until each group is one block. Where a round
leaves most of a group's sets leaders, another one would not help, and its half blocks meet. Pairs of leaders that are too
far to link but near enough for their members to do so are settled last: of each one's members those that may reach the
other's are dealt to a grid of half blocks, and searched for each other. Near copies of one text leave nearly all pairs of
leaders in doubt, so a group whose half blocks meet with fewer rows than that takes lets these meet instead.

Where half blocks meet, and in blocks of more than ``FEW`` sets, the T-occurrence search runs on differences from what most
of the sets hold, as ``components_of`` says.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, returning, shuffle_partitions
from .components import UnionFind, connected

BLOCK, BLOCK_ITEMS = 2048, 500_000
#: A group of which a round leaves more than this share as leaders gets no other round.
MERGED = 0.5
#: Blocks up to which a group's half blocks meet at once.
WIDE = 64
#: Sets up to which a block is linked by leaders even if none of them stands for others.
FEW = 32
#: How many leaders are tried directly before a search.
TRIED = 16
#: Weight of a probe against a merge step, for choosing how many lists count as long.
PROBE = 0.1
_SLACK = 1e-9


class Index:
    """Inverted lists over the sets added so far."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, items: list[int]) -> int:
        me = len(self.sizes)
        self.sizes.append(len(items))
        for x in items:
            self.lists.setdefault(x, []).append(me)
        return me

    def search(self, items: list[int], least: float) -> list[tuple[int, int]]:
        """(set, overlap) of every set whose Jaccard similarity to items is ``least`` (above 0) or more.

        Such a set shares at least t elements with items. Of its lists, the longest are set aside, fewer than t: a set
        still has to occur in the others, merged by a heap, t less their number times. What does is sought in the long
        ones by binary search, and dropped as soon as the lists left can't bring it to its own overlap.
        """
        n, share = len(items), least / (1 + least)
        found = [x for i in items if (x := self.lists.get(i))]
        t = max(1, math.ceil(least * n - _SLACK))
        if len(found) < t:
            return []
        found.sort(key=len)
        n_long = min(t - 1, int(t / (PROBE * math.log2(len(found[-1])) + 1)))
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        if len(short[-1]) == 1:
            merged = groupby(sorted(x[0] for x in short))
        else:
            merged = groupby(heapq.merge(*short))
        out = []
        for me, run in merged:
            count, left = sum(1 for _ in run), n_long
            if count + left < t:
                continue
            need = math.ceil(share * (n + self.sizes[me]) - _SLACK)
            for x in long:
                if count + left < need:
                    break
                left -= 1
                at = bisect_left(x, me)
                count += at < len(x) and x[at] == me
            if count >= need:
                out.append((me, count))
        return out


def distance(a: np.ndarray, b: np.ndarray) -> float:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - inter / (len(a) + len(b) - inter)


def link(sets: list[np.ndarray], radii: list[float], percent: int) -> tuple[list[int], list[int], list[float], list[float], list[tuple[int, int]]]:
    """Links sets that stand for themselves (radius 0) or for others around them.

    Returns by set: its component's first set, its leader and the distance to it; by leader the radius of all it stands
    for; and pairs of leaders in different components that stand for sets which may link.
    """
    reach, index, leaders, unsure = 1 - percent / 100, Index(), [], []

    def linked(a, b) -> bool:
        inter = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * inter >= percent * (len(a) + len(b) - inter)

    def alone(found, leaders) -> bool:
        first = found.root(leaders[0])
        return all(found.root(p) == first for p in leaders)

    def popular(leaders, members):
        return sorted(leaders, key=lambda p: -len(members[p]))[:TRIED]

    found, members = UnionFind(), {}
    leader_of, away, radius = [0] * len(sets), [0.0] * len(sets), [0.0] * len(sets)
    widest = 0.0
    for me, own in enumerate(sets):
        # All leaders so far in one component: a link to any of them settles where the set belongs, so the ones with the most
        # members are tried first.
        if leaders and not radii[me] and not widest > reach and alone(found, leaders):
            home = next((p for p in popular(leaders, members) if linked(own, sets[p])), None)
            if home is not None:
                d = distance(own, sets[home])
                found.join(home, me)
                leader_of[me], away[me] = home, d
                members[home].append((d, me))
                radius[home], widest = max(radius[home], d), max(widest, d)
                continue
        items = own.tolist()
        least = 1 - min(1.0, reach + max(widest, reach) + radii[me])
        if least > _SLACK:
            near = index.search(items, least)
        else:  # everything is in reach
            near = [(k, len(np.intersect1d(own, sets[p], assume_unique=True))) for k, p in enumerate(leaders)]
        near = sorted((1 - c / (len(own) + len(sets[leaders[k]]) - c), leaders[k], c) for k, c in near)
        home = None
        for d, p, c in near:
            union = len(own) + len(sets[p]) - c
            if 100 * c >= percent * union:
                found.join(p, me)
                if home is None:
                    home = p
                    leader_of[me], away[me] = p, d
                    members[p].append((d, me))
                    radius[p] = max(radius[p], d + radii[me])
                    widest = max(widest, radius[p])
        for d, p, c in near:
            if found.root(p) == found.root(me):
                continue
            if radii[me] == 0 and not any(radii[x] for _, x in members[p]):
                for far, x in members[p]:
                    if far + reach + _SLACK >= d:
                        inter = len(np.intersect1d(own, sets[x], assume_unique=True))
                        if 100 * inter >= percent * (len(own) + len(sets[x]) - inter):
                            found.join(x, me)
                            break
            elif d <= reach + radius[p] + radii[me] + _SLACK:
                unsure.append((p, me))
        if home is None:
            leader_of[me] = me
            leaders.append(me)
            index.add(items)
            members[me] = [(0.0, me)]
            radius[me] = radii[me]
            widest = max(widest, radii[me])
    roots = [found.root(i) for i in range(len(sets))]
    return roots, leader_of, away, radius, [(a, b) for a, b in unsure if roots[a] != roots[b]]


def _differences(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How each set differs from the elements that over half of the sets hold: the number of elements, and (set, element) of
    those that another set differs by too, elements being numbered."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    names, item = np.unique(np.concatenate(sets), return_inverse=True)
    common = 2 * np.bincount(item) > m
    column = np.cumsum(common) - 1
    held = np.zeros((m, int(common.sum())), bool)  # at most twice as many cells as the sets have elements
    inside = common[item]
    held[row[inside], column[item[inside]]] = True
    lacks, which = np.nonzero(~held)
    row = np.concatenate([row[~inside], lacks])
    item = np.concatenate([item[~inside], np.flatnonzero(common)[which]])
    total = np.bincount(row, minlength=m)
    shared = np.bincount(item, minlength=len(names))[item] > 1
    return total, row[shared], item[shared]


def components_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """By set the first set of its component under all links between the sets, which must not be empty.

    Sets that differ from a common set by a and b elements, c of them the same, differ from each other by a + b - 2c. So they
    link if and only if their weights add up to at most 2 * (100 + percent) * c, a set's weight being (100 + percent) * a -
    (100 - percent) * its size. All sets that link whatever they share with the set of least weight are one component, and no
    two others link without sharing differences. For each of the others this is a T-occurrence search: of the lists of its
    differences the longest are set aside, fewer than T; the others are merged by counting, and what occurs often enough
    is sought in the long ones.
    """
    m, each = len(sets), 2 * (100 + percent)
    label = np.arange(m)
    total, row, item = _differences(sets)
    weight = (100 + percent) * total - (100 - percent) * np.array([len(x) for x in sets])
    least = int(np.argmin(weight))
    label[weight + weight[least] <= 0] = label[weight + weight[least] <= 0].min(initial=least)
    order = np.lexsort((row, item))
    lists, ends = row[order], np.cumsum(np.bincount(item, minlength=int(item.max(initial=-1)) + 1))
    begins = np.concatenate([[0], ends[:-1]])
    order = np.argsort(row, kind="stable")
    own, cuts = item[order], np.searchsorted(row[order], np.arange(m + 1))
    for me in np.flatnonzero(weight + weight[least] > 0).tolist():
        mine = own[cuts[me] : cuts[me + 1]]
        t = -(-int(weight[me] + weight[least]) // each)
        if len(mine) < t:
            continue
        size = ends[mine] - begins[mine]
        mine = mine[np.argsort(size, kind="stable")]
        n_long = min(t - 1, int(t / (PROBE * math.log2(int(size.max())) + 1)))
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        count = np.bincount(np.concatenate([lists[a:b] for a, b in zip(begins[short].tolist(), ends[short].tolist())]), minlength=m)
        near = np.flatnonzero((each * (count + n_long) >= weight + weight[me]) & (label != label[me]) & (count > 0))
        if not len(near):
            continue
        count, left = count[near], n_long
        for a, b in zip(begins[long].tolist(), ends[long].tolist()):
            x = lists[a:b]
            at = np.searchsorted(x, near)
            count = count + (x[np.minimum(at, len(x) - 1)] == near)
            left -= 1
            keep = each * (count + left) >= weight[near] + weight[me]
            near, count = near[keep], count[keep]
            if not len(near):
                break
        if len(near := near[each * count >= weight[near] + weight[me]]):
            met = np.unique(np.append(label[near], label[me]))
            label[np.isin(label, met)] = met[0]
    return label


def _blocks(batches, keys: int):
    """Rows of a partition sorted by its first ``keys`` columns, gathered by these."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last and rows:
                yield last, rows
                rows = []
            last = row[:keys]
            rows.append(row[keys:])
    if rows:
        yield last, rows


_LINKED = "grp long, split boolean, item binary, root binary, leader binary, away double, radius double, items binary, other binary"


def _round(parts: DataFrame, percent: int, wide: int = 0) -> DataFrame:
    """parts: grp, block, k (the group's number of blocks), item, items, radius. Rows with ``other`` are unsure pairs of
    leaders, ``away`` being their distance; ``items`` is returned for groups of more than one block. Those of at most ``wide``
    are not linked: ``root`` and ``leader`` are null."""
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 3, pa.float64(), pa.float64(), pa.binary(), pa.binary()]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _LINKED.split(", ")])

        out, held = [], 0
        for (group, _, k), rows in _blocks(batches, 3):
            split, rows = k > 1, sorted({r[0]: r for r in rows}.values())
            names = [r[0] for r in rows]
            sets = [np.frombuffer(r[1], np.uint64) for r in rows]
            if 1 < k <= wide:
                out += [(group, True, r[0], None, None, None, None, r[1], None) for r in rows]
                roots = unsure = ()
            elif not split and len(sets) > FEW and not any(r[2] for r in rows):
                roots, unsure = components_of(sets, percent).tolist(), ()
                leader, away, radius = roots, [0.0] * len(sets), [0.0] * len(sets)
            else:
                roots, leader, away, radius, unsure = link(sets, [r[2] for r in rows], percent)
            out += [(group, split, names[i], names[roots[i]], names[leader[i]], away[i], radius[i], rows[i][1] if split else None, None) for i in range(len(roots))]
            out += [(group, split, names[a], None, None, distance(sets[a], sets[b]), None, None, names[b]) for a, b in unsure]
            held += sum(len(r[1]) for r in rows) if split else 0
            if len(out) >= BLOCK or held >= 8 * BLOCK_ITEMS:
                yield table(out)
                out, held = [], 0
        if out:
            yield table(out)

    dealt = parts.select("grp", "block", "k", "item", "items", "radius")
    # By number: a few sets can be much work, which partitions joined by their size would put into one task.
    dealt = dealt.repartition(shuffle_partitions(parts.sparkSession), "grp", "block")
    dealt = dealt.sortWithinPartitions("grp", "block")
    return dealt.mapInArrow(returning(run), _LINKED)


def _settle(cells: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between the sets of the two sides of each cell that link, one for each of side 1 and cell. cells: left, right,
    i, j (what names a cell), side, item, items."""
    def run(batches):
        import pyarrow as pa

        for _, rows in _blocks(batches, 4):
            one, two = ([(n, np.frombuffer(x, np.uint64)) for s, n, x in rows if s == k] for k in (0, 1))
            index, out = Index(), []
            for _, x in one:
                index.add(x.tolist())
            for name, x in two:
                if hit := index.search(x.tolist(), percent / 100):
                    out.append((one[hit[0][0]][0], name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    cell = ("left", "right", "i", "j")
    dealt = cells.select(*cell, "side", "item", "items").repartition(shuffle_partitions(cells.sparkSession), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(returning(run), "a binary, b binary")


def _cells(doubt: DataFrame, under: DataFrame, block: int) -> DataFrame:
    """What _settle takes, without items. doubt: left, right, apart (their distance), reach (the link distance); under: leader,
    item, away (at least its distance). An item can only link to one of the other side if their distances to the leaders and
    the link distance add up to the leaders' distance; both sides are dealt to half blocks, every two of which meet."""
    widest = under.groupBy("leader").agg(F.max("away").alias("widest"))
    names = ("left", "right")
    sides = []
    for k, (own, other) in enumerate((names, names[::-1])):
        far = widest.select(F.col("leader").alias("o"), "widest")
        side = doubt.join(far, F.col(other) == F.col("o")).join(under, F.col(own) == F.col("leader"))
        sides.append(side.where(F.col("away") + F.col("widest") + F.col("reach") + _SLACK >= F.col("apart")).select(*names, F.lit(k).alias("side"), "item"))
    both = sides[0].unionByName(sides[1])
    n = both.groupBy(*names).agg(*[F.ceil(F.count(F.when(F.col("side") == k, 1)) / (block / 2)).alias(f"k{k}") for k in (0, 1)]).where("k0 > 0 and k1 > 0")
    n = n.select(F.col("left").alias("l"), F.col("right").alias("r"), "k0", "k1")
    both = both.join(n, (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")))
    one = F.col("side") == 0
    both = both.withColumn("own", F.pmod(F.xxhash64("item"), F.when(one, F.col("k0")).otherwise(F.col("k1"))))
    both = both.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.when(one, F.col("k1")).otherwise(F.col("k0")) - 1)))
    return both.select(*names, F.when(one, F.col("own")).otherwise(F.col("to")).alias("i"), F.when(one, F.col("to")).otherwise(F.col("own")).alias("j"), "side", "item")


def _heavy(doubt: DataFrame, under: DataFrame, sizes: DataFrame, block: int, block_items: int) -> DataFrame:
    """Groups g whose half blocks meet with fewer rows than the members of all their leaders in doubt (see _cells) have."""
    n = under.groupBy("leader").agg(F.count(F.lit(1)).alias("n_under"))
    ends = doubt.select("grp", F.explode(F.array("left", "right")).alias("end")).groupBy("grp", "end").agg(F.count(F.lit(1)).alias("times"))
    rows = ends.join(n, F.col("end") == F.col("leader")).groupBy(F.col("grp").alias("g")).agg(F.sum(F.col("times") * F.col("n_under")).alias("rows"))
    halves = F.ceil(2 * F.greatest(F.col("n") / float(block), F.col("m") / float(block_items)))
    return rows.join(sizes, F.col("grp") == F.col("g")).where(F.col("rows") > F.col("n") * halves).select("g")


def blocked(members: DataFrame, sizes: DataFrame, block: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """members (grp, item, ...) with their block and their group's number of blocks k. sizes: grp, n (sets), m (elements)."""
    sizes = sizes.select(F.col("grp").alias("g"), F.ceil(F.greatest(F.col("n") / float(block), F.col("m") / float(block_items), F.lit(1.0))).alias("k"))
    return members.join(sizes, F.col("grp") == F.col("g")).drop("g").withColumn("block", F.pmod(F.xxhash64("item"), F.col("k")))


def _crossed(sets: DataFrame, sizes: DataFrame, percent: int, block: int, block_items: int) -> DataFrame:
    """Edges a, b with the components of all links of groups' sets (grp, item, items): every two half blocks meet in a task, and
    a spanning forest of the links found there is returned."""
    def run(batches):
        import pyarrow as pa

        for _, rows in _blocks(batches, 3):
            names = sorted(items := dict(rows))
            label = components_of([np.frombuffer(items[x], np.uint64) for x in names], percent)
            out = [(names[i], names[r]) for i, r in enumerate(label.tolist()) if i != r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    # The links inside a half block are found wherever it meets another one, so it meets itself only if it is the whole group.
    halves = blocked(sets, sizes, block / 2, block_items / 2).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    halves = halves.where((F.col("block") != F.col("other")) | (F.col("k") == 1))
    dealt = halves.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "item", "items")
    dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return dealt.mapInArrow(returning(run), "a binary, b binary")


def link_groups(space: Workspace, sets: DataFrame, percent: int, split: bool, block: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, root) for sets (grp, block, k as from blocked(), item binary, items binary of sorted uint64): root is the same for
    linked items. split: whether any group has more than one block. A set is in one group."""
    first = space.save(_round(sets.withColumn("radius", F.lit(0.0)), percent, WIDE))
    done = first.where("other is null and not split").select("item", "root")
    if not split:
        return done
    first = first.where("split")  # from here on only groups of more than one block count, of which it has the sets
    edge = lambda x: x.where("other is null").select(F.col("item").alias("a"), F.col("root").alias("b"))
    pairs = lambda x: x.where("other is not null").select("grp", F.col("item").alias("left"), F.col("other").alias("right"), F.col("away").alias("apart"))
    count = lambda x: x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("items") / 8).alias("m"))
    k = F.ceil(F.greatest(F.col("n") / float(block), F.col("m") / float(block_items)))

    def cross(whole: DataFrame) -> DataFrame:
        return space.save(_crossed(whole.select("grp", "item", "items"), count(whole), percent, block, block_items))

    edges, unsure, crossed = [cross(first.where("items is not null and leader is null"))], [], []
    every = first.where("other is null").select("item").distinct()
    first = first.where("leader is not null or other is not null")  # and from here on those of more than WIDE
    wide = not first.isEmpty()
    if wide:
        edges.append(edge(first))
        unsure.append(pairs(first))
    under = first.where("other is null").select("leader", "item", "away")  # what a leader of the last round stands for, itself too
    now, was = first, count(first.where("items is not null")).select(F.col("grp").alias("g"), F.col("n").alias("was"))
    while wide:
        tops = now.where("items is not null and item = leader").select("grp", "item", "items", "radius")
        sums = space.save(count(tops).join(was, F.col("grp") == F.col("g")).withColumn("many", k > 1).withColumn("stuck", F.col("many") & (F.col("n") > MERGED * F.col("was"))).drop("g", "was"))
        kinds = {(r.many, r.stuck) for r in sums.select("many", "stuck").distinct().collect()}  # at most three rows
        if (True, True) in kinds:
            hard = sums.where("stuck").select(F.col("grp").alias("g"))
            edges.append(cross(first.where("items is not null").join(hard, F.col("grp") == F.col("g"), "left_semi")))
            crossed.append(hard)
        if not kinds - {(True, True)}:
            break
        sums = sums.where("not stuck")
        now = space.save(_round(blocked(tops, sums, block, block_items), percent))
        edges.append(edge(now))
        unsure.append(pairs(now))
        # Members of a leader of the round before are now also those of its own leader.
        over = now.where("other is null and item != leader").select(F.col("leader").alias("upper"), F.col("item").alias("lower"), F.col("away").alias("more"))
        lower = under.join(over, F.col("leader") == F.col("lower")).select(F.col("upper").alias("leader"), "item", (F.col("away") + F.col("more")).alias("away"))
        under = space.save(under.unionByName(lower).groupBy("leader", "item").agg(F.min("away").alias("away")))
        if (True, False) not in kinds:
            break
        was = sums.select(F.col("grp").alias("g"), F.col("n").alias("was"))
    union = lambda x: x[0] if len(x) == 1 else x[0].unionByName(union(x[1:]))
    roots = connected(space, union(edges))
    if wide:
        doubt = union(unsure)
        if crossed:  # where all sets have met nothing is left undecided
            doubt = doubt.join(union(crossed), F.col("grp") == F.col("g"), "left_anti")
        doubt = doubt.groupBy("grp", "left", "right").agg(F.min("apart").alias("apart"))
        for side in ("left", "right"):
            doubt = doubt.join(roots.select(F.col("node").alias(side), F.col("root").alias(side + "_root")), side, "left")
        doubt = space.save(doubt.where(F.coalesce("left_root", "left") != F.coalesce("right_root", "right")).select("grp", "left", "right", "apart", F.lit(1 - percent / 100).alias("reach")))
        if not doubt.isEmpty():
            items = first.where("items is not null").select("grp", "item", "items").dropDuplicates(["item"])
            heavy = space.save(_heavy(doubt, under, count(items), block, block_items))
            known = [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            known.append(cross(items.join(heavy, F.col("grp") == F.col("g"), "left_semi")))
            doubt = doubt.join(heavy, F.col("grp") == F.col("g"), "left_anti")
            cells = _cells(doubt, under, block).withColumnRenamed("item", "at").join(items.drop("grp"), F.col("at") == F.col("item")).drop("at")
            known.append(_settle(cells, percent))
            roots = connected(space, union(known))
    lone = every.join(roots, F.col("item") == F.col("node"), "left_anti").select("item", F.col("item").alias("root"))
    return done.unionByName(roots.select(F.col("node").alias("item"), "root")).unionByName(lone)
