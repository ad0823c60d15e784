"""The corpus pipeline: each stage on all that its predecessor kept."""

import corpus_pipeline as P
from feedpulse.llm.exact_dedup import exact_dedup
from feedpulse.llm.jaccard_join import jaccard_components
from feedpulse.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark, table):
    docs = table("documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(P.STAGES):
        found = stage(spark, docs, SF)
        if k + 1 < len(P.STAGES):
            assert found.columns == columns
            kept = {r["doc_id"] for r in found.select("doc_id").collect()}
            assert kept <= before
            if k == 1:
                assert kept == {r["doc_id"] for r in exact_dedup(docs).filter("kept").collect()}
            if k == 2:
                assert kept == {r["doc_id"] for r in jaccard_components(docs).filter("component_id = doc_id").collect()}
            docs, before = P.written(found, f"test-{k}"), kept
        else:
            assert {r["doc_id"] for r in found.select("doc_id").collect()} == before
    assert {r["doc_id"] for r in P.run(spark, SF).select("doc_id").collect()} == before


def test_clean_documents_pass_the_language_stage(spark, table):
    docs = table("documents")
    assert P.language_id(spark, docs, SF).count() >= 0.99 * docs.count()


def test_odd_rows_pass_through_every_stage(spark, frame):
    from .conftest import ODD_ROWS
    docs = frame(ODD_ROWS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_one_query_for_each_operator():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(names)
