"""Seeded subsets, shuffles, halves and batches.

A row's place is by the MD5 of "seed:id" and then the id: deterministic on any cluster, uniform, without replacement. These
are not the draws of any particular random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("None"))))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def subset(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """min(k, N) rows in random order; k = -1 gives all of them."""
    return shuffled(df, key, seed) if k == -1 else shuffled(df, key, seed).limit(k)


def ranked(df: DataFrame, key: str, by: list[str], seed: int | None = 0) -> DataFrame:
    """df with ``rn`` from 1 inside each group, in the drawn order or, without a seed, in the key's."""
    order = [draw(seed, key), F.col(key)] if seed is not None else [F.col(key)]
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def halves(df: DataFrame, key: str, by: list[str], seed: int = 0) -> DataFrame:
    """df with ``split``: val for the first half of each group in the drawn order, test for the rest and the odd row."""
    rows = ranked(df, key, by, seed).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return rows.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") / 2), "val").otherwise("test")).drop("rn", "n")


def positions(df: DataFrame, key: str, by: list[str], start: int, stop: int, seed: int | None = 0) -> DataFrame:
    """Rows at places start to stop - 1 of each group."""
    return ranked(df, key, by, seed).where((F.col("rn") > start) & (F.col("rn") <= stop)).drop("rn")


def batches(df: DataFrame, key: str, by: list[str], size: int, seed: int | None = None) -> DataFrame:
    """df with ``batch_id`` from 0; a seed shuffles first."""
    return ranked(df, key, by, seed).withColumn("batch_id", F.floor((F.col("rn") - 1) / size)).drop("rn")


def step_count(df: DataFrame, by: list[str], size: int, epochs: int, warmup_ratio: float) -> DataFrame:
    """by, batches, steps (at least 1) and warm-up steps."""
    out = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("batches"))
    out = out.withColumn("steps", F.greatest(F.lit(1), F.col("batches") * epochs).cast("long"))
    return out.withColumn("warmup", F.floor(F.col("steps") * float(warmup_ratio)).cast("long"))


def first_batches(batched: DataFrame, m: int) -> DataFrame:
    return batched.where(F.col("batch_id") < m)


def until_seen(batched: DataFrame, key: str, by: list[str], m: int, head: int) -> DataFrame:
    """Batches cut to their first ``head`` rows, taken while fewer than m rows have been seen: the last one may overshoot."""
    inside = Window.partitionBy(*by, "batch_id").orderBy(key)
    cut = batched.withColumn("at", F.row_number().over(inside)).where(F.col("at") <= head).drop("at")
    sizes = cut.groupBy(*by, "batch_id").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*by).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = sizes.withColumn("seen", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("seen") < m)
    return cut.join(taken.select(*by, "batch_id"), [*by, "batch_id"], "left_semi")
