"""Sources and sinks: task tables by split, JSON lines, parallel text files, metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.prep import Task, task

#: What splits are called in exported files, and which split of a table each is.
SPLITS = {"train": "train", "valid": "validation", "dev": "validation", "validation": "validation", "test": "test"}


def split_name(name: str) -> str:
    """A table's split for an export's; an unknown one is refused."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; known: {', '.join(SPLITS)}")
    return SPLITS[name]


def read_task(spark: SparkSession, name: str, paths: Mapping[str, str], split: str | None = None, known: Mapping[str, Task] | None = None) -> DataFrame:
    """A task's Parquet table, its two columns (and the split's partition, if one is asked for). Unknown tasks are refused."""
    spec = task(name, dict(known)) if known else task(name)
    if name not in paths:
        raise ValueError(f"no path for task {name!r}")
    df = spark.read.parquet(paths[name])
    if split is not None:
        df = df.where(F.col("split") == split_name(split))
    return df.select(spec.text, spec.label)


def write_json_lines(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """One object a line, UTF-8. Files keep no order among each other."""
    df.select(*columns).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).json(path)


def write_parallel_text(df: DataFrame, path: str, key: str, columns: list[str], mode: str = "error") -> None:
    """A folder of text for each column; line i of each is row i by key, line ends written as \\n.

    Line numbers pair the files up, so each column is one file written by one task: meant for exports, not for corpora.
    """
    for c in columns:
        lines = df.select(key, X.escape_newlines(X.as_text(F.col(c))).alias("value"))
        lines.repartition(1).sortWithinPartitions(key).select("value").write.mode(mode).text(f"{path}/{c}")


def read_parallel_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """line (from 0) and the columns, paired by line number."""
    schema = T.StructType([T.StructField("line", T.LongType())])
    out = None
    for c in columns:
        lines = spark.read.text(f"{path}/{c}", wholetext=True)
        one = lines.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("line", c)).select(F.col("line").cast("long").alias("line"), c)
        out = one if out is None else out.join(one, "line", "full")
    return out if out is not None else spark.createDataFrame([], schema)


def count_report(df: DataFrame, name: str) -> DataFrame:
    """(name, rows)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Adds rows to the metrics kept in a folder, which is made if it is not there."""
    metrics.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clear(spark: SparkSession, path: str) -> int:
    """Removes the plain files of a folder (not its folders) on any file system Spark reaches; how many were removed."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    return sum(bool(fs.delete(s.getPath(), False)) for s in fs.listStatus(at) if s.isFile())
