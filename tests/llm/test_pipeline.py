"""The pipeline against its stages by brute force."""

import corpus_pipeline
from skylane.llm import decision_lists, entropy_secrets
from tests.conftest import SAMPLE
from tests.llm.samples import empty
from tests.llm.test_dedup import brute_classes, brute_digests
from tests.llm.test_texts import brute_statistics


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    labels = spark.read.parquet(f"{SAMPLE}/labels.parquet")
    rules = decision_lists.fit(decision_lists.training_rows(docs, labels))
    learned = {r.doc_id for r in decision_lists.judge(docs, rules).filter("kept OR base_failed").select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(k, t) for k, t in rows if k in learned and not brute_statistics(t)[-1]]
    rows = [(k, t) for (k, t) in rows if k in {d[0] for d in brute_digests(rows) if d[3]}]
    first = {c[2] for c in brute_classes(rows, corpus_pipeline.NEAR)}
    rows = [(k, entropy_secrets.without(t)) for k, t in rows if k in first]
    packed = corpus_pipeline.run(spark, SAMPLE).collect()
    assert {r.doc_id for r in packed} == {k for k, _ in rows}
    expected = corpus_pipeline.packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), SAMPLE).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in expected}


def test_stages_return_the_columns_of_documents_even_for_no_rows(spark):
    none = spark.read.parquet(f"{SAMPLE}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SAMPLE)
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), SAMPLE).count() == 0
