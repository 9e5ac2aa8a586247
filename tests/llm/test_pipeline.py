import corpus_pipeline
from plainly import components, words
from test_results import brute_hits

from coincide.llm import pieces


def test_every_stage_on_its_own_input(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "near_duplicates", "decontamination", "sentencepiece"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and docs.count() == len(after)
        if name == "near_duplicates":
            rows = list(before.items())
            roots, _ = components(rows)
            assert set(after) == {key for i, (key, _) in enumerate(rows) if roots[i] == key}
        if name == "decontamination":
            assert set(after) == {key for key, text in before.items() if not brute_hits(benchmark, text)[-1]}
    decoded = {r.doc_id: r.back for r in pieces.decode(docs, output="back").collect()}
    assert decoded == after and all(words(t) for t in after.values())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(after)


def test_odd_rows_pass_through_every_stage(spark, odd, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, small)
        assert out.count() <= odd.count()
        if name != "sentencepiece":
            assert out.columns == odd.columns and {r.score for r in out.collect()} <= {0.5}
        assert stage(spark, odd.limit(0), small).count() == 0


def test_one_row_of_a_repeated_one_stays(spark, small):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, small).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "x"), (1, "a b c d e f"), (3, "")]
