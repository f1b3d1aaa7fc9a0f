"""The pipeline drops leaked rows, not ids."""


def test_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    item = "the quick brown fox jumps over the lazy dog again and again"
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x " + item), (None, "clean"), (7, item), (7, "clean too"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == [(-1, "clean"), (7, "clean too"), (8, "")]
