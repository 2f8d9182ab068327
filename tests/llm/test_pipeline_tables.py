"""What the pipeline leaves in the shared folder."""

import corpus_pipeline
from chartlake.sources import staging


def test_a_stage_leaves_only_what_it_keeps(spark, tmp_path, monkeypatch):
    def stage(spark, docs, sf_dir):
        return staging.staged(docs.where("doc_id % 10 <> 0"), "own")

    spark.range(100).selectExpr("id as doc_id", "'a' as text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("s", stage)] * 3 + [("last", lambda spark, docs, sf_dir: docs)])
    before = len(staging._STAGED)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 90
    assert len(staging._STAGED) == before + 1
