"""Exact match, evaluation by task and split, the score matrix over training steps, and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .bleu import task_bleu


def exact_match(pred: Column, gold: Column) -> Column:
    """1 if both texts are equal once normalised, else 0."""
    return (X.normalise(X.as_text(pred)) == X.normalise(X.as_text(gold))).cast("int")


def exact_match_rate(pairs: DataFrame, by: list[str], *, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """by, em (0 where there are no pairs) and n (double)."""
    hit = exact_match(F.col(pred), F.col(gold))
    out = pairs.select(*by, hit.alias("hit")).groupBy(*by).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("c"))
    return out.select(*by, (F.col("s") / F.greatest(F.lit(1), F.col("c"))).alias("em"), F.col("c").cast("double").alias("n"))


def evaluate(pairs: DataFrame, by: list[str], *, task: str = "task", plain_smooth: bool = False, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """by (with the task), em, bleu, metric, n."""
    em = exact_match_rate(pairs, by, pred=pred, gold=gold)
    return em.join(task_bleu(pairs, task=task, by=by, plain_smooth=plain_smooth, pred=pred, refs=gold).drop("n"), by)


def preview(pairs: DataFrame, key: str, *, pred: str = "pred", gold: str = "gold", n: int = 5, width: int = 200) -> DataFrame:
    """The first n pairs by key, texts cut to width, with their exact match."""
    first = pairs.orderBy(key).limit(n)
    return first.select(key, X.prefix(F.col(pred), width).alias(pred), X.prefix(F.col(gold), width).alias(gold), exact_match(F.col(pred), F.col(gold)).alias("em"))


def matrix(scores: DataFrame, steps: list[int]) -> DataFrame:
    """The long table (eval_task, step, score) as one column a step."""
    return scores.groupBy("eval_task").pivot("step", steps).agg(F.max("score"))


def forgetting(scores: DataFrame, n_steps: int, *, after_trained: bool = False) -> DataFrame:
    """eval_task, j, best, final, forgetting from (eval_task, j, step, score): how far the last step's score is below the best
    earlier one, at least 0; 0 without an earlier or a last score. Earlier steps include those before task j was trained,
    unless after_trained."""
    last = n_steps - 1
    earlier = F.col("step") < last
    if after_trained:
        earlier = earlier & (F.col("step") >= F.col("j"))
    out = scores.groupBy("eval_task", "j").agg(F.max(F.when(earlier, F.col("score"))).alias("best"), F.max(F.when(F.col("step") == last, F.col("score"))).alias("final"))
    fall = F.when(F.col("best").isNull() | F.col("final").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("best") - F.col("final")))
    return out.withColumn("forgetting", fall)


def average_forgetting(lost: DataFrame, n_tasks: int) -> DataFrame:
    """Mean over all tasks but the last listed."""
    return lost.agg((F.coalesce(F.sum(F.when(F.col("j") < n_tasks - 1, F.col("forgetting"))), F.lit(0.0)) / max(1, n_tasks - 1)).alias("avg_forgetting"))


def final_scores(scores: DataFrame, n_steps: int) -> DataFrame:
    """eval_task, final: the last step's score, 0 where it is missing."""
    return scores.groupBy("eval_task").agg(F.coalesce(F.max(F.when(F.col("step") == n_steps - 1, F.col("score"))), F.lit(0.0)).alias("final"))


def macro_average(scores: DataFrame, column: str) -> DataFrame:
    """The unweighted mean over tasks, 0 without any."""
    return scores.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias(f"avg_{column}"))


def summary(scores: DataFrame, test: DataFrame, n_steps: int, n_tasks: int) -> DataFrame:
    """By task its final validation score, forgetting and test score, with the three averages on every row.

    test: (eval_task, test). Each task shows its own test score.
    """
    rows = forgetting(scores, n_steps).select("eval_task", "j", "forgetting", F.coalesce("final", F.lit(0.0)).alias("val")).join(test, "eval_task", "left")
    every = Window.partitionBy()
    rows = rows.withColumn("test", F.coalesce("test", F.lit(0.0)))
    lost = F.sum(F.when(F.col("j") < n_tasks - 1, F.col("forgetting"))).over(every)
    return rows.withColumns({"avg_val": F.avg("val").over(every), "avg_test": F.avg("test").over(every), "avg_forgetting": F.coalesce(lost, F.lit(0.0)) / max(1, n_tasks - 1)})


def step_scores(preds: DataFrame, tasks: list[str], steps: list[int], *, split: str = "val", **options) -> DataFrame:
    """eval_task, j, step, score (BLEU), em, n: every task evaluated after every step, from (eval_task, step, split, pred, gold).

    A task without predictions after a step keeps its row, without a score. The grid is tasks times steps, both given.
    """
    found = evaluate(preds.where(F.col("split") == split), ["eval_task", "step"], task="eval_task", **options)
    names, at = F.array(*[F.lit(t) for t in check_tasks(tasks)]), F.array(*[F.lit(s).cast("int") for s in steps])
    grid = preds.sparkSession.range(1).select(F.posexplode(names).alias("j", "eval_task")).select("eval_task", "j", F.explode(at).alias("step"))
    return grid.join(found, ["eval_task", "step"], "left").select("eval_task", "j", "step", F.col("bleu").alias("score"), "em", F.coalesce("n", F.lit(0.0)).alias("n"))


def training_report(preds: DataFrame, tasks: list[str], steps: list[int], *, val: str = "val", test: str = "test", **options) -> DataFrame:
    """summary() of predictions: all tasks on the validation split after each step, and on the test split after the last."""
    last = step_scores(preds, tasks, steps[-1:], split=test, **options)
    return summary(step_scores(preds, tasks, steps, split=val, **options), last.select("eval_task", F.col("score").alias("test")), len(steps), len(tasks))


def metric_label(task: Column, smooth_tasks: tuple[str, ...] = ("CodeSearchNet",)) -> Column:
    return F.when(task.isin(*smooth_tasks), "SmoothBLEU").otherwise("BLEU")


def check_tasks(tasks: list[str]) -> list[str]:
    """The list itself; repeated names are refused."""
    if len(set(tasks)) != len(tasks):
        raise ValueError("task names repeat")
    return tasks


def running_mean(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """log with ``running_mean``: of all values of the group up to this one."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("running_mean", F.avg(value).over(upto))


def running_sum(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """log with ``running_sum``: of all values of the group up to this one."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("running_sum", F.sum(value).over(upto))


def every_kth(log: DataFrame, step: str, k: int) -> DataFrame:
    """Rows whose step is a multiple of k (k below 1 counts as 1)."""
    return log.where(F.col(step) % max(1, int(k)) == 0)
