import corpus_pipeline
from quarry.llm.store import written


def test_stages(spark, sf, docs):
    """The five stages in order, each on what the one before has kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    table, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, sf), name)
        assert table.columns == docs.columns and 0 < table.count() <= before
        before = table.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, table, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in table.select("doc_id").collect()}


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048
