"""Word n-grams of token arrays as column expressions, and their counts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(tokens: Column, k: int) -> Column:
    """The runs of k tokens, as arrays; none if there are fewer tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.slice(tokens, i, k))
    return F.when(F.size(tokens) >= k, runs).otherwise(F.expr("cast(array() as array<array<string>>)"))


def possible(length: Column, k: int) -> Column:
    """How many n-grams of order k a sequence of that length has."""
    return F.greatest(length - (k - 1), F.lit(0))


def ngram_counts(df: DataFrame, keys: list[str], tokens: str, n: int = 4) -> DataFrame:
    """Rows keys..., k, gram, cnt for orders 1 to n."""
    every = F.concat(*[F.transform(ngrams(F.col(tokens), k), lambda g: F.struct(F.size(g).alias("k"), g.alias("gram"))) for k in range(1, n + 1)])
    rows = df.select(*keys, F.explode(every).alias("g"))
    return rows.groupBy(*keys, F.col("g.k").alias("k"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


def merge_references(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The largest count of each gram over a pair's references (counts with a column ref_id)."""
    return counts.groupBy(*keys, "k", "gram").agg(F.max("cnt").alias("cnt"))


def clipped(hyps: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, correct: the sum over grams of the smaller of both counts. One tagged aggregation instead of a join."""
    tagged = hyps.select(*keys, "k", "gram", F.col("cnt").alias("h"), F.lit(0).alias("r")).unionByName(
        refs.select(*keys, "k", "gram", F.lit(0).alias("h"), F.col("cnt").alias("r")))
    both = tagged.groupBy(*keys, "k", "gram").agg(F.least(F.sum("h"), F.sum("r")).alias("m"))
    return both.groupBy(*keys, "k").agg(F.sum("m").alias("correct"))
