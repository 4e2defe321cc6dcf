"""Where a regular expression matches, as DataFrame expressions.

split() and regexp_extract_all() run the same matcher, so the pieces between matches and the matches add up to the text and
give every match its place. Offsets count code points from 0, ends are exclusive.

Patterns given here should use possessive groups, so that Java matches them in a loop and not by recursion, and look-behinds
that let a match start only where the leftmost one can: then their cost grows with a text's length and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN


def scan(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds by pattern an array of (gap, match, before): code points since the last match, the match, and up to 40 code
    points before it. A null text has no matches."""
    safe = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({f"{OWN}m_{k}": F.regexp_extract_all(safe, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    pieces = {f"{OWN}p_{k}": F.when(F.size(f"{OWN}m_{k}") > 0, F.split(safe, p, -1)) for k, p in patterns.items()}
    docs = docs.withColumns(pieces)
    found = {}
    for k in patterns:
        m, p = F.col(f"{OWN}m_{k}"), F.col(f"{OWN}p_{k}")
        zipped = F.zip_with(m, F.slice(p, 1, F.size(m)), lambda a, b: F.struct(F.length(b).alias("gap"), a.alias("match"), F.right(b, F.lit(40)).alias("before")))
        found[OWN + k] = F.when(F.size(m) > 0, zipped)
    return docs.withColumns(found).drop(*[f"{OWN}{x}_{k}" for k in patterns for x in "mp"])


#: Elements folded into one list before it is added to the whole.
PIECE = 128


def folded(items: Column, begin: Column, step: Callable[[Column, Column], Column], none: Column) -> Column:
    """The list ``out`` that a fold of structs (at, out) gathers. As a list is copied to add to it, pieces of PIECE elements are
    gathered by themselves first: a text's matches cost few copies of the whole."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), lambda i: F.slice(items, i * PIECE + 1, F.lit(PIECE)))

    def whole(acc, piece):
        own = F.aggregate(piece, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], own["out"]).alias("out"))

    one = F.aggregate(items, begin, step, lambda acc: acc["out"])
    return F.when(F.size(items) <= PIECE, one).otherwise(F.aggregate(pieces, begin, whole, lambda acc: acc["out"]))


def located(column: str, fields: Callable[[Column, Column], dict[str, Column]], keep: Callable[[Column, Column], Column], empty: str) -> Column:
    """Structs (start, end, *fields) of the matches of a scan()ned column that ``keep(match, before)`` accepts.

    empty: the type of an empty result.
    """
    none = F.expr(f"cast(array() as {empty})")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), *[v.alias(k) for k, v in fields(x["match"], x["before"]).items()])
        return F.struct(end.alias("at"), F.when(keep(x["match"], x["before"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.col(column).isNull(), none).otherwise(folded(F.col(column), begin, step, none))


SPAN = "array<struct<start:int,end:int>>"


def ordered(spans: dict[str, Column]) -> Column:
    """All spans as (start, rank, end, kind), by start and then by the order of kinds."""
    def ranked(rank: int, kind: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [ranked(i, k, c) for i, (k, c) in enumerate(spans.items())]
    return F.sort_array(F.concat(*parts))


def text_form(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each span of a sorted list replaced by mark(span); of overlapping spans the first is replaced, and the
    others' rest after it is removed too."""
    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        new = F.when(x["end"] > acc["at"], F.struct(x["end"].alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, mark(x))).otherwise(acc["out"]).alias("out")))
        return F.coalesce(new, acc)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
