"""Corpus BLEU in two definitions, from components of each pair.

``components`` computes, without a shuffle, a pair's lengths, n-gram counts and clipped matches in Arrow batches; corpora are
then sums of fixed size (partial and final hash aggregation). ``native_components`` gives the same by column expressions and
aggregations only; it shuffles every n-gram and is kept as the check of the other.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ngrams as G
from ..functions import text as X

LENGTHS = ("shortest", "average", "closest")
TINY = 1e-16


def reference_length(lengths: Column, hyp: Column, which: str) -> Column:
    """Of several references' lengths the shortest, the mean (double), or the one closest to hyp (the first of equals)."""
    if which == "shortest":
        return F.array_min(lengths).cast("double")
    if which == "average":
        return F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(lengths), F.lit(1))
    if which == "closest":
        near = F.transform(lengths, lambda x, i: F.struct(F.abs(x - hyp).alias("d"), i.alias("i"), x.alias("n")))
        return F.array_min(near)["n"].cast("double")
    raise ValueError(f"the reference length is one of {LENGTHS}, not {which!r}")


def tokenised(pairs: DataFrame, pred: str, refs: str, smooth_tokens: bool, **options) -> DataFrame:
    """pairs with ``hyp`` (tokens) and ``golds`` (arrays of tokens); refs: a string column or an array of strings."""
    cut = (lambda c: X.scored_tokens(c, **options)) if smooth_tokens else X.tokens
    many = isinstance(pairs.schema[refs].dataType, T.ArrayType)
    golds = F.transform(F.col(refs), lambda r: cut(X.as_text(r))) if many else F.array(cut(X.as_text(F.col(refs))))
    return pairs.withColumns({"hyp": cut(X.as_text(F.col(pred))), "golds": golds})


def unpaired(pairs: DataFrame, by: list[str], *, pred: str = "pred", refs: str = "gold") -> DataFrame:
    """by, pairs, no_pred and no_refs: how many pairs there are, and how many lack a side (null)."""
    lacking = {f"no_{name}": F.count_if(F.col(c).isNull()) for name, c in (("pred", pred), ("refs", refs))}
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *[c.alias(name) for name, c in lacking.items()])


def paired(pairs: DataFrame, *, pred: str = "pred", refs: str = "gold") -> DataFrame:
    """The pairs themselves; the job that reads them fails at the first that lacks a side, without a pass of its own."""
    whole = F.col(pred).isNotNull() & F.col(refs).isNotNull()
    return pairs.withColumn(pred, F.when(whole, F.col(pred)).otherwise(F.raise_error(F.lit("a pair lacks its prediction or its reference"))))


def components(pairs: DataFrame, keys: list[str], *, pred: str = "pred", refs: str = "gold", n: int = 4, smooth_tokens: bool = True, eff_ref_len: str = "shortest", **options) -> DataFrame:
    """keys, testlen, reflen, guess and correct (arrays by order) of every pair. A pair without references counts as one with
    an empty one."""
    tok = tokenised(pairs.select(*dict.fromkeys([*keys, pred, refs])), pred, refs, smooth_tokens, **options)
    sizes = F.when(F.size("golds") > 0, F.transform("golds", lambda g: F.size(g))).otherwise(F.array(F.lit(0)))
    hyp = F.size("hyp")
    # Tokens hold no spaces and no control separator: joined, they cross to Python as two plain strings.
    tok = tok.select(*keys, hyp.cast("long").alias("testlen"), reference_length(sizes, hyp, eff_ref_len).alias("reflen"),
                     F.array_join("hyp", " ").alias("h"), F.array_join(F.transform("golds", lambda g: F.array_join(g, " ")), "\n").alias("g"))
    kept = [*keys, "testlen", "reflen"]
    schema = T.StructType([T.StructField(c, tok.schema[c].dataType) for c in kept])
    schema.add("guess", T.ArrayType(T.LongType())).add("correct", T.ArrayType(T.LongType()))

    def grams(tokens, k):
        return Counter(zip(*(tokens[i:] for i in range(k)))) if k > 1 else Counter(tokens)

    def pair(hyp, golds):
        h = hyp.split(" ") if hyp else []
        refs = [g.split(" ") if g else [] for g in golds.split("\n")]
        correct = []
        for k in range(1, n + 1):
            best = grams(refs[0], k)
            for r in refs[1:]:
                best |= grams(r, k)
            correct.append(sum(min(c, best[g]) for g, c in grams(h, k).items() if g in best))
        return [max(len(h) - k + 1, 0) for k in range(1, n + 1)], correct

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [pair(h, g) for h, g in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist())]
            kind = pa.list_(pa.int64())
            out = [*[batch.column(c) for c in kept], pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return tok.mapInArrow(run, schema)


def native_components(pairs: DataFrame, key: str, *, pred: str = "pred", refs: str = "gold", n: int = 4, smooth_tokens: bool = True, eff_ref_len: str = "shortest", **options) -> DataFrame:
    """As components(), for one unique key, by DataFrame operations only."""
    tok = tokenised(pairs.select(key, pred, refs), pred, refs, smooth_tokens, **options)
    sizes = F.when(F.size("golds") > 0, F.transform("golds", lambda g: F.size(g))).otherwise(F.array(F.lit(0)))
    tok = tok.withColumn("reflen", reference_length(sizes, F.size("hyp"), eff_ref_len)).withColumn("testlen", F.size("hyp").cast("long")).repartition(key)
    hyps = G.ngram_counts(tok, [key], "hyp", n)
    each = tok.select(key, F.posexplode("golds").alias("ref_id", "gold_tokens"))
    golds = G.merge_references(G.ngram_counts(each, [key, "ref_id"], "gold_tokens", n), [key])
    found = G.clipped(hyps, golds, [key]).groupBy(key).agg(*[F.sum(F.when(F.col("k") == k, F.col("correct"))).alias(f"c{k}") for k in range(1, n + 1)])
    out = tok.select(key, "testlen", "reflen").join(found, key, "left")
    orders = range(1, n + 1)
    return out.select(key, "testlen", "reflen", F.array(*[G.possible(F.col("testlen"), k) for k in orders]).alias("guess"),
                      F.array(*[F.coalesce(f"c{k}", F.lit(0)).cast("long") for k in orders]).alias("correct"))


def corpus_sums(parts: DataFrame, by: list[str], n: int = 4) -> DataFrame:
    """by, n_pairs, testlen, reflen and g1..gn, c1..cn. A mean reference length is cut to a whole number pair by pair."""
    sums = [F.sum(F.floor("reflen").cast("long")).alias("reflen"), F.sum("testlen").alias("testlen"), F.count(F.lit(1)).alias("n_pairs")]
    sums += [F.sum(F.get(F.col(c), F.lit(k - 1))).alias(f"{c[0]}{k}") for c in ("guess", "correct") for k in range(1, n + 1)]
    total = parts.groupBy(*by).agg(*sums)
    return total.na.fill(0, [c for c in total.columns if c not in by])


def smooth_bleu(sums: DataFrame, n: int = 4, smooth: int = 1) -> DataFrame:
    """sums with ``bleu`` (one added to the counts of orders above 1 if smooth is 1) and the plain precisions p1..pn."""
    log = lambda c, add: F.log(c + float(add) + TINY)
    added = lambda k: 1 if smooth == 1 and k > 1 else 0
    mean = sum((log(F.col(f"c{k}"), added(k)) - log(F.col(f"g{k}"), added(k)) for k in range(1, n + 1)), F.lit(0.0)) / float(n)
    short = F.least(F.lit(0.0), 1 - (F.col("reflen") + 1.0) / (F.col("testlen") + 1.0))
    precise = {f"p{k}": F.when(F.col(f"g{k}") == 0, F.lit(0.0)).otherwise(F.exp(log(F.col(f"c{k}"), 0) - log(F.col(f"g{k}"), 0))) for k in range(1, n + 1)}
    return sums.withColumns({"bleu": F.exp(mean + short), **precise})


def plain_bleu(sums: DataFrame, *, smooth: bool, n: int = 4) -> DataFrame:
    """sums with ``bleu``: geometric mean of the orders' precisions, each with one added to both counts if smooth, times the
    brevity penalty; 0 as soon as one precision is 0."""
    ps = []
    for k in range(1, n + 1):
        c, g = F.col(f"c{k}"), F.col(f"g{k}")
        ps.append((c + 1.0) / (g + 1.0) if smooth else F.when(g > 0, c / g).otherwise(0.0))
    mean = F.exp(sum((F.log(F.when(p > 0, p).otherwise(1.0)) for p in ps), F.lit(0.0)) / float(n))
    ratio = F.col("testlen") / F.greatest(F.lit(1), F.col("reflen"))
    brevity = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / F.greatest(ratio, F.lit(1e-9))))
    return sums.withColumn("bleu", F.when(F.least(*ps) > 0, mean * brevity).otherwise(0.0))


def corpus_bleu(pairs: DataFrame, by: list[str], *, kind: str, smooth: int | bool, pred: str = "pred", refs: str = "gold", n: int = 4, strict: bool = False, **options) -> DataFrame:
    """by, bleu, n_pairs (and the sums) of pairs; kind "smooth" or "plain". smooth has no default on purpose: scores made with
    different settings must not be compared. A null side counts as the text "None", or fails the job with strict."""
    if kind not in ("smooth", "plain"):
        raise ValueError(f"kind is smooth or plain, not {kind!r}")
    if kind == "plain" and options:
        raise ValueError("options are for the smooth kind")
    if strict:
        pairs = paired(pairs, pred=pred, refs=refs)
    sums = corpus_sums(components(pairs, by, pred=pred, refs=refs, n=n, smooth_tokens=kind == "smooth", **options), by, n)
    return smooth_bleu(sums, n, int(smooth)) if kind == "smooth" else plain_bleu(sums, smooth=bool(smooth), n=n)


def task_bleu(pairs: DataFrame, *, task: str = "task", smooth_tasks: tuple[str, ...] = ("CodeSearchNet",), plain_smooth: bool = False, by: list[str] | None = None, pred: str = "pred", refs: str = "gold") -> DataFrame:
    """by (at least the task), metric and bleu: the smoothed score for smooth_tasks, the plain one for all others."""
    by = by or [task]
    special = F.coalesce(F.col(task).isin(*smooth_tasks), F.lit(False))
    one = corpus_bleu(pairs.where(special), by, kind="smooth", smooth=1, pred=pred, refs=refs)
    two = corpus_bleu(pairs.where(~special), by, kind="plain", smooth=plain_smooth, pred=pred, refs=refs)
    pick = lambda d, name: d.select(*by, F.lit(name).alias("metric"), "bleu", F.col("n_pairs").cast("double").alias("n"))
    return pick(one, "SmoothBLEU").unionByName(pick(two, "BLEU"))
