"""Every stage of the pipeline against brute force, each on what the stage before kept."""

import corpus_pipeline
from flowloom.llm import decontaminate, quality
from flowloom.llm.common import documents, stage

from . import brute
from .test_operators import check_packed


def test_stages(spark):
    docs, done = documents(spark, brute.SF), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = stage(step(spark, docs, brute.SF), name)
        if name != "packing":
            assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality":
            scores = quality.quality_scores(docs, documents(spark, brute.SF, "labels"))
            want = {r.doc_id for r in scores.where("predicted = 1").collect()}
        elif name == "exact_dedup":
            want = {i for i, keep, *_ in brute.exact_groups(before) if i == keep}
        elif name == "near_dedup":
            want = {c for *_, c in brute.near_components(before)}
        elif name == "decontamination":
            texts = [t for t, in documents(spark, brute.SF, "benchmark").select("text").collect()]
            want = {i for i, t in before if not any(b in t for b in texts)}
            assert decontaminate.contamination_report(docs, documents(spark, brute.SF, "benchmark")).count() > 0
        else:
            want = ids
            check_packed(after.toPandas(), before)
        assert ids == want and len(ids) > 0, name
        done[name] = len(ids)
        docs = after
    assert len(done) == 5


def test_run_has_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, brute.SF).select("sequence_id", "offset").distinct().count() > 0
