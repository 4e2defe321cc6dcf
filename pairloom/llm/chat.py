"""Chat formatting by perspective rotation (DataFrame operations only).

For every participant of a dialogue the dialogue is rendered with that speaker as the assistant and the others as named
users; the mask covers what the assistant says and its end mark. System turns are rendered as such and take no part.

A dialogue is rendered in parts of ``SPAN`` consecutive turn numbers, so that a very long one never meets in one row or task;
offsets count from the dialogue's start, and ``part`` orders its parts. Within a part turns go by number, speaker and text.

Defined results: a turn without a number counts as turn 0 of the dialogue's first part; a null speaker is named "unknown", a null
text is empty; a null dialogue id is a dialogue of its own; repeated rows are repeated turns; a dialogue of system turns only has no
participants and no rows. Marks inside texts and names are escaped so that no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", span: int = SPAN) -> DataFrame:
    """Rows conversation, participant, part, n_turns, start (offset of the part), rendered, mask ("start:end" joined by commas,
    offsets in the whole dialogue), n_masked (code points under the mask)."""
    safe = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
    rows = turns.select(F.col(conversation).alias("conv"), F.coalesce(F.col(turn), F.lit(0)).alias("turn"),
                        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), safe(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    part = F.floor(F.col("turn") / span)
    rows = rows.withColumn("part", part).withColumn("name", safe(F.regexp_replace("speaker", r"\s+", "_")))
    people = rows.where(F.col("speaker") != system).select("conv", F.col("speaker").alias("participant")).distinct()
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text", "name"))).alias("turns"))
    both = parts.withColumnRenamed("conv", "c").join(people, F.col("c").eqNullSafe(F.col("conv")))
    head = lambda x: F.when(x["speaker"] == system, F.lit("system")).when(x["speaker"] == F.col("participant"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x["name"]))
    pieces = F.transform("turns", lambda x: F.struct(F.concat(F.lit(OPEN), head(x), F.lit("\n")).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["speaker"] == F.col("participant")).alias("own")))
    both = both.withColumn("pieces", pieces)
    both = both.withColumn("rendered", F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), ""))

    def step(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    places = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    both = both.withColumn("places", places).withColumn("length", F.length("rendered").cast("long"))
    before = Window.partitionBy("conv", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    mask = F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["start"] + F.col("start"), x["end"] + F.col("start"))), ",")
    masked = F.aggregate("places", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return both.select(F.col("conv").alias(conversation), "participant", "part", F.size("turns").cast("long").alias("n_turns"), "start", "rendered", mask.alias("mask"), masked.alias("n_masked"))
