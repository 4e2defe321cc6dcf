"""Document fingerprints from closed syncmers (DataFrame operations only).

A text's k-mers are its runs of ``K`` consecutive words (lower-cased, cut at white space); their inner substrings are runs of
``S`` words. A k-mer is a closed syncmer if the smallest hash among its inner substrings is the first's or the last's.
Whether it is depends on its own words only and not on what stands around it, so the same passage gives the same anchors in
any text, at places that line up. A fingerprint is the sequence of its anchors' 32-bit codes in the text's order; likeness is
the share of common codes among all distinct codes of two fingerprints.

Defined results: a null text is an empty one; a text of fewer than K words has one anchor for the whole sequence; without
words it has none, and its fingerprint is empty. Two empty fingerprints have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, shuffle_partitions

K, S = 5, 2
_GAP = r"[\x20\x09-\x0D]+"


def _code(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def anchors(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds by pair (text column, name) an array ``name`` of the codes of the text's closed syncmers, in order."""
    g, n = (lambda c: OWN + "g_" + c), (lambda c: OWN + "w_" + c)
    words = {n(out): F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP), lambda w: w != "") for text, out in columns.items()}
    docs = docs.withColumns(words)

    def inner(words: Column) -> Column:
        m = F.size(words) - 1
        return F.when(m > 0, F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), lambda a, b: F.xxhash64(a, b)))

    docs = docs.withColumns({g(out): inner(F.col(n(out))) for out in columns.values()})

    def chosen(out: str) -> Column:
        own, m = F.col(g(out)), F.size(n(out)) - K
        at = lambda i, j: F.get(own, i + j)
        last = K - S
        edge = lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, j) for j in range(1, last)])
        found = F.transform(F.sequence(F.lit(0), m), lambda i: F.when(edge(i), _code(F.xxhash64(*[at(i, j) for j in range(last + 1)]))))
        whole = F.array(_code(F.xxhash64(F.array_join(F.col(n(out)), " "))))
        none = F.expr("cast(array() as array<bigint>)")
        return F.when(m >= 0, F.filter(found, lambda c: c.isNotNull())).when(m > -K, whole).otherwise(none)

    docs = docs.withColumns({out: chosen(out) for out in columns.values()})
    return docs.drop(*[f(out) for out in columns.values() for f in (g, n)])


def fingerprint(codes: Column) -> Column:
    """Eight hexadecimal digits an anchor."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Common codes among all codes of two arrays of distinct codes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``next_text``: the text of the next document by descending id, after the last the first's.

    Null ids come last; rows alike in id go by a hash of the text and the text. Rows are dealt to ranges of ids found from
    approximate quantiles (which balance the work and don't change the result), ordered inside each, and a range's last row
    gets the next range's first text. One shuffle of the texts; the first rows are one for each of a fixed number of ranges.
    Ids are numeric.
    """
    spark = docs.sparkSession
    n = min(4000, 4 * shuffle_partitions(spark))
    shares = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]) if n > 1 else F.array(F.lit(0.5))
    cuts = docs.agg(F.percentile_approx(doc_id, shares, F.lit(20_000)).alias("cuts")).first().cuts or []
    bounds = F.array(*[F.lit(c).cast("double") for c in sorted(set(cuts))]) if cuts else F.expr("cast(array() as array<double>)")
    own_id, range_, r = F.col(doc_id), OWN + "range", OWN + "r"
    place = F.coalesce(F.size(F.filter(bounds, lambda b: b < own_id.cast("double"))), F.lit(-1))
    place = F.when(own_id.isNull(), -1).otherwise(place)
    safe = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({range_: place, OWN + "text": safe, OWN + "hash": F.xxhash64(safe)})
    top = rows.groupBy(range_).agg(F.max(F.struct(F.col(doc_id).alias("id"), F.col(OWN + "hash").alias("hash"))).alias("top"))
    top = F.broadcast(top.select(F.col(range_).alias(OWN + "r"), F.col("top.id").alias(OWN + "top_id"), F.col("top.hash").alias(OWN + "top_hash")))  # one row a range, at most 4001
    first = rows.join(top, (F.col(range_) == F.col(r)) & own_id.eqNullSafe(F.col(OWN + "top_id")) & (F.col(OWN + "hash") == F.col(OWN + "top_hash")))
    first = first.groupBy(r).agg(F.max(OWN + "text").alias("first"))
    down = Window.orderBy(F.col(r).desc())
    whole = Window.partitionBy()
    turn = F.coalesce(F.lead("first").over(down), F.max_by("first", r).over(whole))
    follow = first.select(r, turn.alias(OWN + "follow"))
    order = Window.partitionBy(range_).orderBy(F.col(doc_id).desc_nulls_last(), F.col(OWN + "hash").desc(), F.col(OWN + "text").desc())
    rows = rows.withColumn("next_text", F.lead(OWN + "text").over(order))
    rows = rows.join(follow, F.col(range_) == F.col(r))
    return rows.withColumn("next_text", F.coalesce("next_text", OWN + "follow")).drop(*[c for c in rows.columns if c.startswith(OWN)])
