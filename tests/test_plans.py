"""Physical plans: pushed filters, pruned columns, no Python, no cross joins, limits before the shuffle."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as contract
from check_queries import DATA
from reportloom.operators import lookup
from reportloom.plans.catalog import all_queries


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


# Those of the report engine; the operators of the optional subpackage choose their own style and store steps. The
# iterative ones and those that store run jobs while they are planned; searches multiply matrices in Arrow batches.
ITERATIVE = {"statement_order", "period_matrix", "unique_sections", "unique_by_title", "export_cells", "export_some_periods",
             "unmatched_rows"}
SEARCHES = {
    "search_knowledge", "search_knowledge_filtered", "search_knowledge_table", "search_knowledge_texts", "semantic_sections",
    "semantic_sections_table", "hybrid_sections", "hybrid_sections_table", "text_hits", "text_hits_table", "search_sections",
    "search_sections_hybrid", "search_sections_table",
}
STORED = {
    "replaced_periods", "added_vector_counts", "streamed_file_plan", "streamed_first_events", "file_hashes", "loaded_knowledge", "sorted_labels",
    "stored_export",
}
LAZY = sorted(set(all_queries()) - ITERATIVE - SEARCHES - STORED)


@pytest.mark.parametrize("name", LAZY)
def test_stays_in_the_engine(spark, name):
    text = plan(contract.queries()[name](spark, str(DATA)))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert node not in text, node


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "periods")
    spark.range(100).selectExpr("id", "id % 5 AS company_id", "cast(id % 4 + 1 as int) AS quarter",
                                "cast(2000 + id % 3 as int) AS year", "'x' AS pdf_hash", "'y' AS big").write.parquet(path)
    text = plan(lookup.period_row(spark.read.parquet(path), 3, 2, 2001).select("id"))
    assert "EqualTo(company_id,3)" in text and "EqualTo(quarter,2)" in text and "EqualTo(year,2001)" in text
    assert "ReadSchema: struct<id:bigint,company_id:bigint,quarter:int,year:int>" in text


@pytest.mark.parametrize("name", sorted(SEARCHES))
def test_searches_have_no_cross_join(spark, name):
    text = plan(contract.queries()[name](spark, str(DATA)))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


@pytest.mark.parametrize("name", ["search_knowledge", "hybrid_sections", "text_hits", "first_unmatched_rows"])
def test_rank_limit_before_shuffle(spark, name):
    text = plan(contract.queries()[name](spark, str(DATA)))
    assert text.count("WindowGroupLimit") >= 2
