"""What the operators share: tables written to the shared folder, and guards for names."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Prefix of every column an operator adds only for its own work, so that columns of the input never clash with it.
OWN = "__pl_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset and all run
    on this machine. A cluster without one is refused: a machine's own folder would lose what an executor wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or "/tmp/checkpoints").rstrip("/")


#: Shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written once to the shared folder. A reader of such a table does not depend on the executors that wrote it,
    so a lost executor costs its own tasks only. drop() removes tables that later steps don't read, clear() all of them. What a
    table was shuffled for is removed as soon as it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        was = self.spark.conf.get(FREED, None)
        self.spark.conf.set(FREED, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREED, was) if was is not None else self.spark.conf.unset(FREED)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pl_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._pl_path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def returning(run):
    """run for mapInArrow, giving freed memory back to the system when a task ends: workers are kept for the tasks after it."""
    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def portions(batches, column: str, rows: int = 256, size: int = 1 << 18):
    """Arrow batches in portions of at most so many rows and, where it is more than a row, so many bytes of a text column."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, upto[at] + size, "right")) - 1
            end = min(max(end, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
