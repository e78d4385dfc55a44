import corpus_pipeline as p
from weft.llm import wu_manber
from weft.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        docs, seen = out, set(ids)
    assert not wu_manber.hits(docs, table(spark, SF, "benchmark")).where("contaminated").count()
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == seen


def test_run(spark):
    assert p.run(spark, SF).count() > 0
