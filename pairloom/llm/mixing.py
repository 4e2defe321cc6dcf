"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every document has a fixed 60-bit hash. A source that is to give ``e`` whole epochs and a rest takes all its documents
``e`` times and those below a hash threshold once more. The threshold is found without sorting: token counts are summed by
source and hash bucket, running sums over the (at most 4096) buckets of a source find the bucket in which the budget is
reached, and only the documents of that bucket are looked at in the next, 4096 times finer round. Budgets are nested: the
threshold of a smaller budget is lower, so its selection is part of a larger one's.

Defined results: a null text has size 0; null sources form a source of their own, last in order; rows alike in id and text
share a hash and are taken or left together; a source of size 0 has target 0 and gives nothing; an empty table gives an
empty result. Input columns are kept whatever their names; the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Workspace

WORD = r"[^\x20\x09-\x0D]+"
BITS, ROUND = 60, 12

_S, _N, _H = OWN + "source", OWN + "size", OWN + "hash"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, which other engines can compute too."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.0, epochs: int = 3) -> DataFrame:
    """Adds each source's target to (source, size) rows, one a source.

    Sources in code-point order, null last, weigh cycle[0], cycle[1], ... repeating, and share ``share`` of all sizes. No
    target exceeds ``epochs`` times the size; what is over goes to the others by weight. That is min(epochs * size, level *
    weight) for the level at which the targets add up, found from running sums in the order in which sources fill up.
    A mix's sources are its configuration (one row each), so these two windows see few rows.
    """
    rank = F.row_number().over(Window.orderBy(F.col(_S).asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((rank - 1) % len(cycle) + 1).cast("int"))
    total = F.least(F.sum(_N).over(Window.partitionBy()) * F.lit(float(share)), F.sum(_N).over(Window.partitionBy()) * float(epochs))
    t = sources.withColumn("w", weight).withColumn("cap", F.col(_N) * float(epochs)).withColumn("total", total)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col(_S).asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    # Ordered by cap / w, the first level that its own source can take is the level of all.
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("at")))).over(Window.partitionBy())
    t = t.withColumn("level", first["at"])
    return t.select(_S, F.col(_N).alias("source_size"), F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(space: Workspace, slim: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``full`` (whole epochs) and ``below`` (hash threshold of one more) to goals (source, source_size, target).

    slim: (source, size, hash) of every document, already written, as it is read once a round until each boundary bucket
    holds one hash: five rounds of twelve bits at most.
    """
    goals = goals.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = space.save(goals.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    state = goals.select(_S, F.lit(0.0).alias("base"), "rest").where(F.col("rest") > 0)
    rows, done, shift = slim.select(_S, _N, _H), [], BITS
    while True:
        shift -= ROUND
        bucket = F.shiftright(_H, shift)
        hist = rows.groupBy(_S, bucket.alias("b")).agg(F.sum(_N).alias("n"), F.min(_H).alias("lo"), F.max(_H).alias("hi"))
        upto = Window.partitionBy(_S).orderBy("b")
        hist = hist.withColumnRenamed(_S, "s").join(state, F.col("s").eqNullSafe(F.col(_S))).drop("s")
        hist = hist.withColumn("after", F.col("base") + F.sum("n").over(upto)).withColumn("before", F.col("after") - F.col("n"))
        edge = space.save(hist.where((F.col("after") > F.col("rest")) & (F.col("before") <= F.col("rest"))))
        one = F.col("lo") == F.col("hi")
        nearer = (F.col("after") - F.col("rest")) < (F.col("rest") - F.col("before"))
        done.append(edge.where(one).select(_S, (F.col("lo") + nearer.cast("long")).alias("below")))
        more = edge.where(~one)
        if not shift or more.isEmpty():
            break
        more = more.select(F.col(_S).alias("s"), "b", F.col("before").alias("base"), "rest")
        inside = F.col("s").eqNullSafe(F.col(_S)) & (F.col("b") == bucket)
        rows = space.save(rows.join(more, inside, "left_semi"))
        state = more.select(F.col("s").alias(_S), "base", "rest")
    below = done[0]
    for x in done[1:]:
        below = below.unionByName(x)
    below = below.withColumnRenamed(_S, "s")
    joined = goals.join(below, F.col("s").eqNullSafe(F.col(_S)), "left").drop("s")
    return joined.select(_S, "source_size", "target", "full", F.coalesce("below", F.lit(0)).alias("below"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cycle: Sequence[float] = (5, 2, 1),
        share: float = 1.0, epochs: int = 3, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes it) and taken (copies * size)."""
    space = Workspace(docs.sparkSession, "mix")
    own = {_S: F.col(source), _N: words(F.col(text)), _H: row_hash(F.col(doc_id), F.col(text))}
    sized = docs.withColumns(own)
    if not keep_text:
        sized = space.save(sized.drop(text))
    slim = sized if not keep_text else space.save(sized.select(_S, _N, _H))
    goals = targets(slim.groupBy(_S).agg(F.sum(_N).alias(_N)), cycle, share, epochs)
    plan = thresholds(space, slim, goals)
    plan = plan.select(F.col(_S).alias(OWN + "s"), *[F.col(c).alias(OWN + c) for c in ("source_size", "target", "full", "below")])
    found = sized.join(plan, F.col(OWN + "s").eqNullSafe(F.col(_S)), "left").drop(OWN + "s")
    copies = F.col(OWN + "full") + (F.col(_H) < F.col(OWN + "below")).cast("long")
    found = found.withColumns({"size": F.col(_N), "source_size": F.col(OWN + "source_size"), "target": F.col(OWN + "target"), "copies": copies})
    return found.withColumn("taken", F.col("copies") * F.col("size")).drop(*[c for c in found.columns if c.startswith(OWN)])


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.where(F.col("copies") > 0).withColumn(OWN + "i", F.explode(copies)).drop(OWN + "i")
