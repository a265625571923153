"""Each stage keeps the documents' columns, and what the pipeline packs is what its stages let through."""

import corpus_pipeline
from parchmill.session import read_table, settled

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
