"""The pipeline stage by stage on a small corpus."""

import corpus_pipeline
from tests.llm.test_copies import held, shingle_list
from urlrisk.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, bench = documents, spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), "stage")
        assert after.columns == documents.columns
        kept = [(r.doc_id, r.text) for r in after.collect()]
        before = [(r.doc_id, r.text) for r in docs.collect()]
        assert {k for k, _ in kept} <= {k for k, _ in before}
        if name == "MinHash near-dedup":
            sets = [s for s in (set(shingle_list(t, 5)) for _, t in kept) if s]
            assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1:])
        if name == "substring dedup":
            assert len(kept) == len(before)
        if name == "benchmark decontamination":
            leaking = {k for k, _ in held(before, items)}
            assert {k for k, _ in kept} == {k for k, _ in before} - leaking
        docs = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
