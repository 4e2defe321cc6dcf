"""A corpus pipeline of five stages, each an operator of pairloom.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, jaccard, mixing, queries, secret_scan, toxicity
from pairloom.llm.common import Workspace, table

REJECT = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under REJECT."""
    scored = toxicity.score(docs, queries.toxicity_model(spark, docs, sf_dir))
    return scored.where(F.col("score") < REJECT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a Jaccard similarity of 0.8 reach."""
    return jaccard.keep_one(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in a text replaced by its kind; n_chars follows the text."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target weight takes them, at most three times."""
    return mixing.repeat(mixing.mix(docs, cycle=(5, 2, 1), share=1.0, epochs=3)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    import public_tokenizers

    codec = bpe.Codec.from_file(queries.vocabulary(), public_tokenizers.PATTERN)
    coded = bpe.encode(docs, codec, decoded=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("toxicity", toxic), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        now = space.save(stage(spark, docs, sf_dir))
        if last is not None:
            space.drop(last)
        last = docs = now
    return docs
