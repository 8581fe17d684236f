import corpus_pipeline
from tidewright.llm.common import table


def test_stages_keep_columns_and_work(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() == before and "pieces" in docs.columns


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_last_stage_draws_the_operators_samples(spark, sf):
    """Nulls, empty texts and repeated rows included: each row keeps its own, samples differ, and all decode to the text."""
    from tidewright.llm import pieces

    docs = spark.createDataFrame([(1, "ein Wort, zwei", 1.0), (1, "ein Wort, zwei", 1.0), (2, None, 2.0), (3, "", 3.0), (None, "xyz ", 4.0)], "doc_id long, text string, log_prob double")
    rows = pieces.stage(spark, docs, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["others"])) for r in rows) == [(False, 1, 1), (False, 1, 1), (False, 2, 0), (False, 3, 0), (True, 0, 1)]
    for r in rows:
        assert r["round_trip"] and all(o["pieces"] != r["pieces"] and o["log_inclusion"] <= 0 for o in r["others"])
    assert len({tuple(r["pieces"]) for r in rows if r["doc_id"] == 1}) == 1
    assert pieces.stage(spark, docs.where("false"), sf).count() == 0
