"""Arithmetic on parameter vectors given as tables: diagonal Fisher information, quadratic penalties, orthogonality of low-rank
bases and low-rank merges. Vectors are rows (name, idx, value); ``exploded`` makes them from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, idx, value (double)."""
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("idx", "value"))


def trainable(params: DataFrame, flag: str = "requires_grad") -> DataFrame:
    return params.where(F.col(flag))


def snapshot(params: DataFrame, flag: str = "requires_grad") -> DataFrame:
    """(name, idx, value) of the trainable parameters."""
    return trainable(params, flag).select("name", "idx", "value")


def fisher(gradients: DataFrame, divisor: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, name, idx, fisher: squares of the batches' gradients (batch, name, idx, value), summed and divided.

    divisor: an aggregate such as the number of samples; the number of distinct batches unless given.
    """
    per = F.count_distinct("batch") if divisor is None else divisor
    return gradients.groupBy(*by, "name", "idx").agg((F.sum(F.col("value") * F.col("value")) / per).alias("fisher"))


def online_fisher(history: DataFrame, gamma: float) -> DataFrame:
    """(name, idx, fisher) after folding tasks t = 0, 1, ...: F <- gamma * F + F_t, in closed form."""
    last = history.groupBy("name", "idx").agg(F.max("t").alias("last"))
    both = history.join(last, ["name", "idx"])
    return both.groupBy("name", "idx").agg(F.sum(F.pow(F.lit(float(gamma)), F.col("last") - F.col("t")) * F.col("fisher")).alias("fisher"))


def online_means(history: DataFrame) -> DataFrame:
    """(name, idx, value) of the latest task."""
    return history.groupBy("name", "idx").agg(F.max_by("value", "t").alias("value"))


def penalty(params: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row ``penalty``: the sum over snapshots of fisher * (value - anchor) squared. anchors: name, idx, fisher, anchor and
    any snapshot column. 0 without anchors."""
    both = anchors.join(params.select("name", "idx", "value"), ["name", "idx"])
    gap = F.col("value") - F.col("anchor")
    return both.agg(F.coalesce(F.sum(F.col("fisher") * gap * gap), F.lit(0.0)).alias("penalty"))


def scaled_penalty(value: Column, strength: float, task_index: Column) -> Column:
    """Half the strength times the penalty, from the second task on."""
    return F.when(task_index > 0, value * (0.5 * float(strength))).otherwise(F.lit(0.0))


def orthogonality(current: DataFrame, earlier: DataFrame, norms: DataFrame | None = None, least: float = 1e-6) -> DataFrame:
    """(module, loss): the squared products of the current bases with every earlier task's, summed.

    Bases are rows module, side, row, col, value (earlier ones with task). norms: (module, norm) of the current B; modules
    under ``least`` are skipped.
    """
    now = current.select("module", "side", "row", F.col("col").alias("i"), F.col("value").alias("u"))
    then = earlier.select("task", "module", "side", "row", F.col("col").alias("j"), F.col("value").alias("v"))
    if norms is not None:
        now = now.join(norms.where(F.col("norm") >= least).select("module"), "module", "left_semi")
    dots = now.join(then, ["module", "side", "row"]).groupBy("task", "module", "side", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    return dots.groupBy("module").agg(F.sum(F.col("dot") * F.col("dot")).alias("loss"))


def reduced_qr(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, value of the reduced Q of each matrix (keys, row, col, value). One matrix is one task's memory."""
    import pyarrow as pa

    schema = ", ".join(f"{c} {t}" for c, t in matrices.select(*keys).dtypes) + ", row int, col int, value double"

    def run(group):
        import numpy as np

        row, col = (np.asarray(group.column(c)).astype(int) for c in ("row", "col"))
        m = np.zeros((row.max() + 1, col.max() + 1))
        m[row, col] = np.asarray(group.column("value"), float)
        q = np.linalg.qr(m, mode="reduced")[0]
        i, j = np.indices(q.shape).reshape(2, -1)
        own = [pa.array([group.column(k)[0].as_py()] * len(i), group.column(k).type) for k in keys]
        return pa.Table.from_arrays([*own, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(q.ravel())], [*keys, "row", "col", "value"])

    return matrices.select(*keys, "row", "col", "value").groupBy(*keys).applyInArrow(run, schema)


def low_rank_merge(weights: DataFrame, b: DataFrame, a: DataFrame, scale: float) -> DataFrame:
    """(module, row, col, value): weights plus B times A times scale. b: module, row, rank, value; a: module, rank, col, value."""
    product = b.select("module", "row", "rank", F.col("value").alias("u")).join(a.select("module", "rank", "col", F.col("value").alias("v")), ["module", "rank"])
    change = product.groupBy("module", "row", "col").agg((F.sum(F.col("u") * F.col("v")) * float(scale)).alias("change"))
    both = weights.join(change, ["module", "row", "col"], "left")
    return both.select("module", "row", "col", (F.col("value") + F.coalesce("change", F.lit(0.0))).alias("value"))


def zeroed(factors: DataFrame) -> DataFrame:
    """The factors after a merge: all zero."""
    return factors.withColumn("value", F.lit(0.0))


def scale(by_adapter: Column, single: Column, alpha: Column, rank: Column) -> Column:
    """The adapter's own scaling, else the module's, else alpha / rank, else 1."""
    return F.coalesce(by_adapter, single, alpha / F.when(rank != 0, rank), F.lit(1.0))
