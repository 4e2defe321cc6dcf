import pytest
from model import normalise, plain, scored, smooth
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.operators import bleu, evaluate, params, prep, sampling
from pairloom.sources import tables

TEXTS = ["", " ", "<pad> The</s>", "éa b éthe the", "A-an the_a", "a\xa0b c", "x.y, 3.14 1,000 a-1 7-b", "don't <skipped>stop-\nping\nnow",
         "&lt;b&gt; &amp;lt; &quot;q&quot;", "the cat sat on the mat", "The Cat, sat on the mat!", "1 2 3 4 5 6 7 8", "ΑΣ ß   x　y", "a" * 300, "a b a b a b a b"]


def column(spark, f, texts=TEXTS):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.withColumn("x", f(F.col("t"))).orderBy("i").collect()]


def test_text_functions_match_the_model(spark):
    assert column(spark, X.normalise) == [normalise(t) for t in TEXTS]
    assert column(spark, X.scored_tokens) == [scored(t) for t in TEXTS]
    assert column(spark, lambda c: X.scored_tokens(c, preserve_case=True)) == [scored(t, True) for t in TEXTS]
    assert column(spark, X.tokens) == [t.split() for t in TEXTS]
    assert column(spark, X.strip) == [t.strip() for t in TEXTS]
    assert column(spark, X.as_text, [None, "x"]) == ["None", "x"]
    assert column(spark, X.escape_newlines, ["a\nb"]) == ["a\\nb"]


def pairs(spark):
    rows = [(i, i % 3, TEXTS[i], [TEXTS[(i * 7 + j) % len(TEXTS)] for j in range(1 + i % 3)] + [TEXTS[i][:-2]]) for i in range(len(TEXTS))]
    return rows, spark.createDataFrame(rows, "key int, part int, pred string, golds array<string>")


@pytest.mark.parametrize("length", bleu.LENGTHS)
def test_smooth_bleu_with_many_references(spark, length):
    rows, df = pairs(spark)
    got = {r.part: r.bleu for r in bleu.corpus_bleu(df, ["part"], kind="smooth", smooth=1, refs="golds", eff_ref_len=length).collect()}
    for part in range(3):
        assert got[part] == pytest.approx(smooth([(r[2], r[3]) for r in rows if r[1] == part], length=length), abs=1e-12)


@pytest.mark.parametrize("add", [True, False])
def test_plain_bleu(spark, add):
    rows, df = pairs(spark)
    got = {r.part: r.bleu for r in bleu.corpus_bleu(df, ["part"], kind="plain", smooth=add, refs="golds").collect()}
    for part in range(3):
        assert got[part] == pytest.approx(plain([(r[2], r[3]) for r in rows if r[1] == part], add), abs=1e-12)


def test_native_components_equal_the_arrow_ones(spark):
    _, df = pairs(spark)
    for cut in (True, False):
        one = bleu.components(df, ["key"], refs="golds", smooth_tokens=cut, eff_ref_len="closest")
        two = bleu.native_components(df, "key", refs="golds", smooth_tokens=cut, eff_ref_len="closest")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_known_scores(spark):
    one = lambda p, g: spark.createDataFrame([(1, p, g)], "t int, pred string, gold string")
    score = lambda df, **o: bleu.corpus_bleu(df, ["t"], **o).first().bleu
    assert score(one("a b c d e", "a b c d e"), kind="smooth", smooth=1) == pytest.approx(1)
    assert score(one("", "x y"), kind="smooth", smooth=1) == pytest.approx(2.718281828 ** -2)
    assert score(one("", "x y"), kind="plain", smooth=False) == 0
    assert score(one("a b c", "d e f"), kind="plain", smooth=False) == 0
    with pytest.raises(ValueError):
        bleu.reference_length(F.col("x"), F.col("y"), "longest")
    assert bleu.task_bleu(one("a", "a").withColumn("task", F.lit("CodeSearchNet"))).first().metric == "SmoothBLEU"


def test_exact_match_of_nothing(spark):
    empty = spark.createDataFrame([], "pred string, gold string")
    assert tuple(evaluate.exact_match_rate(empty, []).first()) == (0.0, 0.0)


def test_forgetting(spark):
    rows = [("a", 0, 0, 0.9), ("a", 0, 1, 0.5), ("a", 0, 2, 0.4), ("b", 1, 0, 0.2), ("b", 1, 2, 0.5), ("c", 2, 0, 0.3), ("c", 2, 2, None)]
    scores = spark.createDataFrame(rows, "eval_task string, j int, step int, score double")
    lost = evaluate.forgetting(scores, 3)
    assert {r.eval_task: round(r.forgetting, 9) for r in lost.collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}
    assert evaluate.average_forgetting(lost, 3).first()[0] == pytest.approx(0.25)
    assert evaluate.forgetting(scores.where("step = 0"), 1).agg(F.sum("forgetting")).first()[0] == 0
    with pytest.raises(ValueError):
        evaluate.check_tasks(["a", "a"])


def test_sampling_sizes(spark):
    df = spark.range(129).withColumnRenamed("id", "k").withColumn("g", F.lit(1))
    assert sampling.subset(df, "k", 500).count() == 129 and sampling.subset(df, "k", 10).distinct().count() == 10
    split = {r.split: r["count"] for r in sampling.halves(df, "k", ["g"]).groupBy("split").count().collect()}
    assert split == {"val": 64, "test": 65}
    b = sampling.batches(df, "k", ["g"], 16)
    assert b.agg(F.max("batch_id")).first()[0] == 8 and sampling.first_batches(b, 2).count() == 32
    assert sampling.until_seen(b, "k", ["g"], 40, 16).count() == 48


def test_sequences(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    ids = F.col("ids")
    row = df.select(prep.padded(ids, 5).alias("p"), prep.attention(ids, 5).alias("m"), prep.padded(ids, 2).alias("t"), prep.truncated(ids, 2).alias("u")).first()
    assert row == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6], [5, 6])
    masked = prep.masked(prep.padded(ids, 5), prep.attention(ids, 5))
    row = df.select(masked.alias("x"), prep.unmasked(masked).alias("y"), prep.decoded(prep.unmasked(masked), F.expr("map(5,'a',6,'b',7,'c')")).alias("z")).first()
    assert row == ([5, 6, 7, -100, -100], [5, 6, 7, 0, 0], "a b c")
    with pytest.raises(ValueError):
        prep.task("none")
    df = spark.createDataFrame([(None, "y")], "nl string, code string")
    assert prep.examples(df, prep.task("CONCODE")).first().text.endswith("None")


def test_parameters(spark):
    now = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0)], "name string, idx int, value double")
    anchors = spark.createDataFrame([("w", 0, 2.0, 0.0), ("w", 1, 1.0, 4.0)], "name string, idx int, fisher double, anchor double")
    assert params.penalty(now, anchors).first()[0] == 6.0
    assert params.penalty(now, anchors.limit(0)).first()[0] == 0.0
    hist = spark.createDataFrame([(0, "w", 0, 1.0), (1, "w", 0, 2.0)], "t int, name string, idx int, fisher double")
    assert params.online_fisher(hist, 0.5).first().fisher == 2.5


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "é"), (2, "", "y"), (3, "c", None)], "k int, java string, cs string")
    tables.write_parallel_text(df, str(tmp_path / "t"), "k", ["java", "cs"])
    assert [tuple(r) for r in tables.read_parallel_text(spark, str(tmp_path / "t"), ["java", "cs"]).orderBy("line").collect()] == [(0, "a\\nb", "é"), (1, "", "y"), (2, "c", "None")]
    tables.write_json_lines(df, str(tmp_path / "j"), ["java", "cs"])
    assert tables.read_json_lines(spark, str(tmp_path / "j"), ["java", "cs"]).count() == 3
    with pytest.raises(ValueError):
        tables.split_name("other")
    with pytest.raises(ValueError):
        tables.read_task(spark, "other", {})
    assert tables.clear(spark, str(tmp_path / "j")) > 0 and tables.clear(spark, str(tmp_path / "none")) == 0


def test_lists_are_joined_before_tokenising(spark):
    df = spark.createDataFrame([(1, ["A b,", None, "c-1"]), (2, [])], "i int, t array<string>")
    got = [r.x for r in df.select("i", X.scored_tokens(F.col("t"), listed=True).alias("x")).orderBy("i").collect()]
    assert got == [scored("A b, c-1"), []]
    with pytest.raises(ValueError):
        X.scored_tokens(F.col("t"), nonorm=True, listed=True)


def test_pairs_that_lack_a_side(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, None, "a"), (1, "a", None)], "t int, pred string, gold string")
    assert tuple(bleu.unpaired(df, ["t"]).first()) == (1, 3, 1, 1)
    assert bleu.corpus_bleu(df, ["t"], kind="plain", smooth=True).first().n_pairs == 3
    assert bleu.corpus_bleu(df.na.drop(), ["t"], kind="plain", smooth=True, strict=True).first().n_pairs == 1
    with pytest.raises(Exception, match="lacks its prediction"):
        bleu.corpus_bleu(df, ["t"], kind="plain", smooth=True, strict=True).collect()


def test_every_task_has_a_score_after_every_step(spark):
    text = "a b c d e f"
    rows = [("x", 0, "val", text, text), ("x", 1, "val", "z", text), ("x", 1, "test", text, text), ("y", 1, "val", text, text)]
    preds = spark.createDataFrame(rows, "eval_task string, step int, split string, pred string, gold string")
    scores = {(r.eval_task, r.step): r.score for r in evaluate.step_scores(preds, ["x", "y"], [0, 1]).collect()}
    assert scores == {("x", 0): pytest.approx(1), ("x", 1): 0, ("y", 0): None, ("y", 1): pytest.approx(1)}
    out = {r.eval_task: r for r in evaluate.training_report(preds, ["x", "y"], [0, 1]).collect()}
    assert out["x"].forgetting == pytest.approx(1) and out["x"].test == pytest.approx(1) and out["y"].test == 0
    assert out["y"].avg_val == pytest.approx(0.5) and out["y"].avg_forgetting == pytest.approx(1)


def test_datasets_of_several_tasks(spark):
    one = spark.createDataFrame([("n", "c")], "nl string, code string")
    two = spark.createDataFrame([(None, "f", 1)], "buggy string, fixed string, more int")
    got = {r.task: (r.text, r.label) for r in prep.assembled({"CONCODE": one, "BFP": two}, prep.catalogue("short")).collect()}
    assert got == {"CONCODE": ("generate java: n", "c"), "BFP": ("refactor java: None", "f")}
    for wrong in ({}, {"other": one}):
        with pytest.raises(ValueError):
            prep.assembled(wrong)


def test_metrics_are_appended(spark, tmp_path):
    at = str(tmp_path / "new" / "metrics")
    for name in ("a", "b"):
        tables.append_metrics(tables.count_report(spark.range(3), name), at)
    assert sorted(map(tuple, tables.read_metrics(spark, at).collect())) == [("a", 3), ("b", 3)]
