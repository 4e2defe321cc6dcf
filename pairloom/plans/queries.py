"""The registered queries: every operator over the driver's tables.

Predictions are made from gold texts by fixed edits, as text generation is not part of this engine.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ngrams as G
from ..functions import text as X
from ..operators import bleu, evaluate, params, prep, sampling
from ..sources import tables

QUERIES = {}
TASK_ORDER = ("click", "login", "logout", "purchase", "view")
STEPS = 5


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves without every seventh word."""
    kept = F.array_join(F.filter(X.tokens(F.col("text")), lambda t, i: i % 7 != 6), " ")
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("gold"), kept.alias("pred"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns that follow them."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(order), "gold": F.lead("text").over(order)})
    return rows.where("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") % 4).alias("part"), "conv_id", "turn", F.col("text").alias("pred"), "gold")


@query
def em_rate_by_lang(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("gold"))
    edit = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the "), "gold", F.lit(" !"))).when(F.col("doc_id") % 3 == 1, F.concat("gold", F.lit(" more"))).otherwise(F.replace("gold", F.lit(" "), F.lit("  ")))
    return rounded(evaluate.exact_match_rate(docs.withColumn("pred", edit), ["lang"]), "em")


@query
def bleu_smooth_by_lang(spark, sf_dir):
    out = bleu.corpus_bleu(pairs(spark, sf_dir), ["lang"], kind="smooth", smooth=1)
    return rounded(out, "bleu", "p1", "p2", "p3", "p4").select("lang", "n_pairs", "testlen", "reflen", "bleu", "p1", "p2", "p3", "p4")


@query
def bleu_plain_by_lang(spark, sf_dir):
    out = bleu.corpus_bleu(pairs(spark, sf_dir), ["lang"], kind="plain", smooth=False)
    return rounded(out, "bleu").select("lang", "n_pairs", "testlen", "reflen", "bleu")


@query
def bleu_plain_turns(spark, sf_dir):
    out = bleu.corpus_bleu(turns(spark, sf_dir), ["part"], kind="plain", smooth=False)
    return rounded(out, "bleu").select("part", "n_pairs", "testlen", "reflen", "bleu")


@query
def bleu_plain_smoothed_turns(spark, sf_dir):
    out = bleu.corpus_bleu(turns(spark, sf_dir), ["part"], kind="plain", smooth=True)
    return rounded(out, "bleu").select("part", "n_pairs", "testlen", "reflen", "bleu")


@query
def bleu_smooth_turns(spark, sf_dir):
    out = bleu.corpus_bleu(turns(spark, sf_dir), ["part"], kind="smooth", smooth=1)
    return rounded(out, "bleu", "p1", "p2", "p3", "p4").select("part", "n_pairs", "testlen", "reflen", "bleu", "p1", "p2", "p3", "p4")


@query
def bleu_native_turns(spark, sf_dir):
    """As bleu_plain_turns, by column expressions and aggregations only."""
    rows = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    parts = bleu.native_components(rows, "key", smooth_tokens=False).join(rows.select("key", "part"), "key")
    return rounded(bleu.plain_bleu(bleu.corpus_sums(parts, ["part"]), smooth=False), "bleu").select("part", "n_pairs", "testlen", "reflen", "bleu")


def _references(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    golds = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("g"))
    golds = golds.select(F.col("conv_id").alias("c"), F.transform("g", lambda x: x["text"]).alias("golds"))
    return rows.where("role = 'user'").join(golds, F.col("conv_id") == F.col("c")).select((F.col("conv_id") % 4).alias("part"), F.col("text").alias("pred"), "golds")


@query
def bleu_multi_reference(spark, sf_dir):
    """Every user turn against all assistant turns of its dialogue, with each choice of the reference length."""
    out = None
    for which in bleu.LENGTHS:
        one = bleu.corpus_bleu(_references(spark, sf_dir), ["part"], kind="smooth", smooth=1, refs="golds", eff_ref_len=which, nonorm=True)
        one = rounded(one, "bleu").select(F.lit(which).alias("ref_len"), "part", "n_pairs", "testlen", "reflen", "bleu")
        out = one if out is None else out.unionByName(one)
    return out


@query
def bleu_by_task(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("task", F.when(F.col("part") == 0, "CodeSearchNet").otherwise(F.concat(F.lit("task"), F.col("part"))))
    return rounded(bleu.task_bleu(rows), "bleu")


@query
def evaluation_by_task(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("task", F.when(F.col("part") == 0, "CodeSearchNet").otherwise(F.concat(F.lit("task"), F.col("part"))))
    out = evaluate.evaluate(rows, ["task"]).withColumn("label", evaluate.metric_label(F.col("task")))
    return rounded(out, "em", "bleu")


@query
def unpaired_turns(spark, sf_dir):
    """All user turns, the assistant's answer being their reference: how many lack one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)}).where("role = 'user'")
    rows = rows.select((F.col("conv_id") % 4).alias("part"), F.col("text").alias("pred"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("gold"))
    return bleu.unpaired(rows, ["part"])


def predictions(spark, sf_dir):
    """After step s, a prediction is the gold text without one in s + 3 words; half of the dialogues are for validation."""
    rows = turns(spark, sf_dir).withColumn("eval_task", F.when(F.col("part") == 0, "CodeSearchNet").otherwise(F.concat(F.lit("task"), F.col("part"))))
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    kept = F.filter(X.tokens(F.col("gold")), lambda t, i: i % (F.col("step") + 3) != F.col("step"))
    split = F.when(F.floor(F.col("conv_id") / 4) % 2 == 0, "val").otherwise("test")
    return rows.select("eval_task", "step", split.alias("split"), F.array_join(kept, " ").alias("pred"), "gold")


TRAINED = ["task1", "CodeSearchNet", "task2", "task3", "task9"]


@query
def scores_after_steps(spark, sf_dir):
    return rounded(evaluate.step_scores(predictions(spark, sf_dir), TRAINED, [0, 1, 2]), "score", "em")


@query
def training_report(spark, sf_dir):
    out = evaluate.training_report(predictions(spark, sf_dir), TRAINED, [0, 1, 2])
    return rounded(out, "val", "forgetting", "test", "avg_val", "avg_test", "avg_forgetting")


@query
def normalised_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("norm"))


@query
def scored_page_tokens(spark, sf_dir):
    tok = X.scored_tokens(F.col("html"))
    plain = X.scored_tokens(F.col("html"), nonorm=True)
    cased = X.scored_tokens(F.col("html"), preserve_case=True)
    return read(spark, sf_dir, "pages").select("page_id", F.size(tok).cast("long").alias("n"), F.md5(X.joined(tok)).alias("tokens"), F.md5(X.joined(plain)).alias("plain"), F.md5(X.joined(cased)).alias("cased"))


@query
def listed_turn_tokens(spark, sf_dir):
    """The turns of a dialogue as a list of strings, tokenised as one text."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    tok = X.scored_tokens(F.transform("t", lambda x: x["text"]), listed=True)
    return rows.select("conv_id", F.size(tok).cast("long").alias("n"), F.md5(X.joined(tok)).alias("tokens"))


@query
def text_pieces(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.prefix(t).alias("head"), F.md5(X.escape_newlines(t)).alias("escaped"), F.md5(X.collapse(t)).alias("collapsed"), F.md5(X.drop_punctuation(F.lower(t))).alias("bare"))


@query
def ngram_totals(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("tok"))
    counts = G.ngram_counts(rows, ["conv_id", "turn"], "tok")
    return counts.groupBy("k").agg(F.count(F.lit(1)).alias("grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


@query
def previews(spark, sf_dir):
    return evaluate.preview(pairs(spark, sf_dir), "doc_id")


@query
def seeded_subset(spark, sf_dir):
    return sampling.subset(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, seed=7)


@query
def seeded_subset_all(spark, sf_dir):
    return sampling.subset(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", -1, seed=7)


@query
def half_split(spark, sf_dir):
    return sampling.halves(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"], seed=7)


@query
def range_select(spark, sf_dir):
    return sampling.positions(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 10, 60, seed=7)


@query
def order_batches(spark, sf_dir):
    return sampling.batches(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 16, seed=7)


@query
def first_batches(spark, sf_dir):
    return sampling.first_batches(sampling.batches(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 16), 5)


@query
def batches_until_seen(spark, sf_dir):
    rows = sampling.batches(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 16)
    return sampling.until_seen(rows, "o_orderkey", ["o_orderpriority"], 100, 12)


@query
def step_counts(spark, sf_dir):
    return sampling.step_count(read(spark, sf_dir, "orders"), ["o_orderpriority"], 16, 3, 0.1)


@query
def prompts(spark, sf_dir):
    spec = prep.catalogue("tagged")["CodeSearchNet"]
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("code"), F.col("role").alias("docstring"), "role")
    return prep.examples(rows, spec, keep=("conv_id", "turn"))


@query
def assembled_examples(spark, sf_dir):
    """A dataset of three tasks, each from a table of its own."""
    by_task = {
        "CodeTrans": read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("java"), F.col("role").alias("cs")),
        "CONCODE": read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("nl"), F.col("lang").alias("code")),
        "BFP": read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("buggy"), F.lit("x").alias("fixed")),
    }
    out = prep.assembled(by_task, prep.catalogue("short"), keep=("id",))
    return out.select("id", "task", F.md5("text").alias("text"), "label")


@query
def encoded_turns(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", "pred", "gold")
    out = prep.encoded(rows, "pred", "gold", 32, 48)
    back = prep.unmasked(F.col("labels"))
    flat = lambda c: F.array_join(c.cast("array<string>"), ",")
    return out.select("conv_id", "turn", flat(F.col("input_ids")).alias("ids"), flat(F.col("attention_mask")).alias("mask"), flat(F.col("labels")).alias("labels"), flat(back).alias("unmasked"))


@query
def decoded_roles(spark, sf_dir):
    vocabulary = F.create_map(*[F.lit(x) for pair in enumerate(("user", "assistant", "system"), 3) for x in pair])
    roles = F.array(*[F.lit(x) for x in ("user", "assistant", "system")])
    ids = F.array((F.array_position(roles, F.col("role")) + 2).cast("int"), (F.lit(3) + F.col("turn") % 3).cast("int"))
    full = prep.unmasked(prep.masked(prep.padded(ids, 6), prep.attention(ids, 6)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", prep.decoded(full, vocabulary).alias("words"))


def score_table(spark, sf_dir):
    """Events as scores: the mean value by type (task) and event_id modulo the steps."""
    names = F.array(*[F.lit(t) for t in TASK_ORDER])
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("eval_task"), (F.col("event_id") % STEPS).cast("int").alias("step"), "value")
    rows = rows.groupBy("eval_task", "step").agg(F.avg("value").alias("score"))
    return rows.withColumn("j", F.greatest(F.array_position(names, F.col("eval_task")) - 1, F.lit(0)).cast("int"))


@query
def score_matrix(spark, sf_dir):
    out = evaluate.matrix(score_table(spark, sf_dir), list(range(STEPS)))
    return out.select("eval_task", *[F.round(str(i), 6).alias(f"step_{i}") for i in range(STEPS)])


@query
def forgetting(spark, sf_dir):
    return rounded(evaluate.forgetting(score_table(spark, sf_dir), STEPS), "best", "final", "forgetting")


@query
def forgetting_after_training(spark, sf_dir):
    return rounded(evaluate.forgetting(score_table(spark, sf_dir), STEPS, after_trained=True), "best", "final", "forgetting")


@query
def average_forgetting(spark, sf_dir):
    lost = evaluate.forgetting(score_table(spark, sf_dir), STEPS)
    return rounded(evaluate.average_forgetting(lost, len(TASK_ORDER)), "avg_forgetting")


@query
def macro_averages(spark, sf_dir):
    return rounded(evaluate.macro_average(evaluate.final_scores(score_table(spark, sf_dir), STEPS), "final"), "avg_final")


@query
def evaluation_summary(spark, sf_dir):
    scores = score_table(spark, sf_dir)
    test = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("eval_task")).agg(F.max("value").alias("test"))
    out = evaluate.summary(scores, test, STEPS, len(TASK_ORDER))
    return rounded(out, "val", "forgetting", "test", "avg_val", "avg_test", "avg_forgetting")


@query
def running_means(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return evaluate.running_mean(rows, ["event_type"], "event_id", "value").withColumn("running_mean", F.floor(F.col("running_mean") * 10_000 + 0.123456) / 10_000)


@query
def running_sums(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("epoch"), "value")
    return evaluate.running_sum(rows, ["event_type", "epoch"], "event_id", "value").withColumn("running_sum", F.round("running_sum", 4))


@query
def logged_steps(spark, sf_dir):
    return evaluate.every_kth(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 50)


def gradients(spark, sf_dir):
    """Embeddings as gradients: their label names the parameter, blocks of ten ids are batches."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), F.floor(F.col("vec_id") / 10).alias("batch"), "embedding")
    return params.exploded(rows, ["name", "batch"], "embedding")


@query
def fisher_by_batches(spark, sf_dir):
    return rounded(params.fisher(gradients(spark, sf_dir)), "fisher")


@query
def fisher_by_samples(spark, sf_dir):
    return rounded(params.fisher(gradients(spark, sf_dir), F.greatest(F.lit(1), F.count(F.lit(1)))), "fisher")


def fisher_history(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("t"), F.col("label").cast("string").alias("name"), F.col("vec_id").alias("batch"), "embedding")
    return params.fisher(params.exploded(rows, ["t", "name", "batch"], "embedding"), by=("t",))


@query
def fisher_online(spark, sf_dir):
    return rounded(params.online_fisher(fisher_history(spark, sf_dir), 0.95), "fisher")


@query
def online_anchor_means(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("label").cast("string").alias("name"), "embedding")
    return rounded(params.online_means(params.exploded(rows, ["t", "name"], "embedding")), "value")


@query
def quadratic_penalty(spark, sf_dir):
    grads = gradients(spark, sf_dir)
    now = grads.groupBy("name", "idx").agg(F.max("value").alias("value"), (F.max("idx") >= 0).alias("requires_grad"))
    anchors = params.fisher(grads).join(grads.groupBy("name", "idx").agg(F.avg("value").alias("anchor")), ["name", "idx"])
    out = params.penalty(params.snapshot(now), anchors)
    return rounded(out.withColumn("scaled", params.scaled_penalty(F.col("penalty"), 40.0, F.lit(1))), "penalty", "scaled")


def _factors(spark, sf_dir):
    """Every eight vectors of a label, by vec_id, are the factors of a module."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", "label", "embedding")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    module = F.concat(F.lit("m"), F.col("label"), F.lit("."), F.floor(F.col("place") / 8))
    return params.exploded(rows.select(module.alias("module"), (F.col("place") % 8).alias("rank"), "embedding"), ["module", "rank"], "embedding")


@query
def low_rank_merges(spark, sf_dir):
    f = _factors(spark, sf_dir)
    a = f.where("rank < 4").select("module", F.col("rank"), F.col("idx").alias("col"), "value")
    b = f.where("rank >= 4").select("module", F.col("idx").alias("row"), (F.col("rank") - 4).alias("rank"), "value")
    w = f.where("rank = 0").select("module", F.col("idx").alias("row"), F.lit(0).alias("col"), "value")
    return rounded(params.low_rank_merge(w, b, a, 2.0), "value")


@query
def basis_orthogonality(spark, sf_dir):
    f = _factors(spark, sf_dir).select("module", F.lit("a").alias("side"), F.col("idx").alias("row"), F.col("rank").alias("col"), "value")
    current = f.where("col < 4")
    earlier = f.where("col >= 4").withColumn("task", (F.col("col") % 2).cast("int"))
    norms = current.groupBy("module").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rounded(params.orthogonality(current, earlier, norms), "loss")


@query
def qr_bases(spark, sf_dir):
    """By module how far the reduced Q of its factors is from orthonormal (0), and its shape."""
    f = _factors(spark, sf_dir).select("module", F.col("idx").alias("row"), F.col("rank").alias("col"), "value")
    q = params.reduced_qr(f, ["module"])
    r = q.select(F.col("module").alias("m"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))
    dots = q.join(r, (F.col("module") == F.col("m")) & (F.col("row") == F.col("r"))).groupBy("module", "col", "c").agg(F.sum(F.col("value") * F.col("v")).alias("d"))
    off = F.max(F.abs(F.col("d") - (F.col("col") == F.col("c")).cast("double")))
    return dots.groupBy("module").agg(F.round(off, 6).alias("off"), (F.max("col") + 1).cast("long").alias("columns"))


@query
def adapter_scales(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    none = F.lit(None).cast("double")
    k = F.col("p_partkey") % 4
    own, one = F.when(k == 0, F.col("p_size") / 2.0).otherwise(none), F.when(k == 1, F.col("p_size") / 4.0).otherwise(none)
    alpha, rank = F.when(k == 2, F.col("p_retailprice")).otherwise(none), F.col("p_size") % 8
    return p.select("p_partkey", F.round(params.scale(own, one, alpha, rank), 6).alias("scale"))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, or a local one where none is set and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = at or tempfile.gettempdir()
    return f"{at}/pairloom-{uuid.uuid4().hex}"


@query
def json_lines_round_trip(spark, sf_dir):
    path = scratch(spark)
    rows = read(spark, sf_dir, "documents").select(F.col("text").alias("nl"), F.col("lang").alias("code"))
    tables.write_json_lines(rows, path, ["nl", "code"])
    return tables.read_json_lines(spark, path, ["nl", "code"])


@query
def parallel_text_round_trip(spark, sf_dir):
    path = scratch(spark)
    rows = read(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn")).select("key", F.col("role").alias("java"), F.col("text").alias("cs"))
    tables.write_parallel_text(rows, path, "key", ["java", "cs"])
    return tables.read_parallel_text(spark, path, ["java", "cs"])


@query
def task_table_scan(spark, sf_dir):
    path = scratch(spark)
    split = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    read(spark, sf_dir, "documents").select(F.col("text").alias("nl"), F.col("lang").alias("code"), split.alias("split")).write.partitionBy("split").parquet(path)
    return tables.read_task(spark, "CONCODE", {"CONCODE": path}, "dev")


@query
def metric_log_round_trip(spark, sf_dir):
    path = scratch(spark)
    for name in ("documents", "pages"):
        tables.append_metrics(tables.count_report(read(spark, sf_dir, name), name), path)
    return tables.read_metrics(spark, path)


@query
def row_counts(spark, sf_dir):
    out = [tables.count_report(read(spark, sf_dir, n), n) for n in ("documents", "pages", "conversations", "benchmark")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
