import random
from pathlib import Path

from pairloom.llm import jaccard
from pairloom.llm.common import Workspace


def _shuffled(spark) -> int:
    """Bytes of the shuffle files that lie on disk."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for top in tops for p in Path(top).rglob("shuffle_*.data"))


def _texts(n, words=900):
    rnd = random.Random(5)
    return [" ".join(f"{rnd.getrandbits(48):x}" for _ in range(words)) for _ in range(n)]


def test_kept_texts_are_not_shuffled(spark, tmp_path):
    texts = _texts(400)
    rows = [(i, x) for i, x in enumerate(texts)] + [(1000 + i, x + " more") for i, x in enumerate(texts[:40])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    before = _shuffled(spark)
    jaccard.keep_one(docs).write.parquet(str(tmp_path / "out"))
    assert _shuffled(spark) - before < sum(len(x) for x in texts) / 4
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == rows[:400]


def test_shuffle_files_go_when_a_table_is_saved(spark):
    before = _shuffled(spark)
    saved = Workspace(spark, "test").save(spark.range(200_000).selectExpr("id", "md5(cast(id as string)) as x").repartition(4, "x"))
    assert saved.count() == 200_000
    assert _shuffled(spark) - before < 100_000


def test_repeated_rows_and_ids(spark):
    a, b, c = _texts(3, 30)
    rows = [(1, a, 0), (1, a, 1), (2, a + " x", 2), (3, b, 3), (3, c, 4), (None, c, 5), (None, None, 6), (None, None, 7), (4, " ", 8), (4, " ", 9), (5, None, 10), (None, b + " y", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    kept = {r.n for r in got.collect()}
    assert len(kept & {0, 1}) == 1 and kept - {0, 1} == {3, 4, 6, 7, 8, 9, 10}
