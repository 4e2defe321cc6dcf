import corpus_pipeline


def test_every_stage_takes_effect(spark, tmp_path):
    rows = [(i, f"some words here for text number {i} and more of them {i * 7} end", "en", f"s{i % 3}", 60) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s2", 60), (101, 'set token = "0123456789abcdef0123" in a text', "en", "s1", 40), (102, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        got = {r.doc_id: r.text for r in now.collect()}
        if name == "ngram_join":
            assert 100 not in got and 102 in got and len(got) == 62
        if name == "secret_scan":
            assert got[101] == 'set [assign]" in a text'
    assert now.agg({"doc_id": "count"}).first()[0] > 0
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert last and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
