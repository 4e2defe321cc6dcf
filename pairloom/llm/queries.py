"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, graph_search, jaccard, mixing, paragraphs, pii, secret_scan, syncmers, toxicity
from .common import table
from .spans import text_form


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraphs.repeated_passages(docs, k=5, percent=80)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(docs, labels, label="toxic", usable=~toxicity.held_out("id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), drop_text=True)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.ngram_join(docs, k=5, percent=80).select("doc_id", "n_shingles", "component_id")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    counts = [_count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text_form(F.col("base")), 256).alias("base_sha256"), text_form(F.col("spans")).alias("spans"))


def _count(kind: str):
    return F.size(F.filter(F.col("base"), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(pii.annotate(docs, pii.fit(docs)), pii.KINDS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(secret_scan.find_secrets(docs), secret_scan.KINDS)


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = syncmers.with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    found = syncmers.anchors(docs.withColumn("edited", edited), {"text": "own", "edited": "changed", "next_text": "other"})
    found = found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), syncmers.fingerprint(F.col("own")).alias("fingerprint"),
                         syncmers.fingerprint(F.col("changed")).alias("edited_fingerprint"), *[F.array_distinct(c).alias(c) for c in ("own", "changed", "other")])
    near = {f"near_{name}": syncmers.likeness(F.col("own"), F.col(c)) for name, c in (("edited", "changed"), ("next", "other"))}
    return found.withColumns(near).drop("own", "changed", "other")


def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest(vectors, F.col("id") % 50 == 0, k=5)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, cycle=(5, 2, 1), share=1.0, epochs=3, keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.Codec.from_file(vocabulary(), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, codec, packed=True, decoded=True, drop_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_paragraphs, op2_toxicity, op3_ngram_join, op4_pii, op5_secret_scan, op6_syncmers, op7_graph_search, op8_mixing, op9_bpe, op10_chat)}
