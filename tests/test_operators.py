"""Golden cases of operators on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reportloom.operators import compare, knowledge, lookup, normalise, quality, search, stats, status
from reportloom.operators.search import Query
from reportloom.streaming import streams

ROW = "struct<label:string,label_en:string,values:array<string>,type:string>"
TABLE = f"report int, id string, title string, page int, columns array<string>, rows array<{ROW}>"


def findings(df):
    return sorted((r["item_id"], r["error_type"], r["row_index"], r["severity"]) for r in df.collect())


def row(label, values, kind="data"):
    return (label, None, values, kind)


def test_table_findings(spark):
    tables = spark.createDataFrame([
        (1, "empty", "T", 1, ["", "a"], []),
        (1, "t", "T", 1, ["", "a"], [
            row("label: 1", [None, "1"]), row("Kassa", [None]), row("X", ["1999", "2"]), row("Y", ["5", None]),
            row("H", [None, None], "header"), row("2025", [None, "1"]), row("", [None, "1", "2"]),
        ]),
        (1, None, None, 1, [], [row("ok", ["a"])]),
    ], TABLE)
    assert findings(quality.table_findings(tables)) == [
        ("empty", "empty_table", None, "error"),
        ("t", "first_value_not_null", 3, "warning"),
        ("t", "invalid_label", 0, "error"), ("t", "invalid_label", 6, "error"),
        ("t", "no_data_values", 3, "warning"),
        ("t", "values_length_mismatch", 1, "error"), ("t", "values_length_mismatch", 6, "error"),
        ("unknown", "first_value_not_null", 0, "warning"),
    ]


def test_column_counts(spark):
    tables = spark.createDataFrame([(1, str(n), "T", 1, ["c"] * n, []) for n in (5, 4, 3, 0)], TABLE)
    expected = tables.select("report", "id", "title", "page", F.array_repeat(F.lit("h"), 5).alias("column_headers"))
    assert findings(quality.column_count_findings(expected, tables)) == [
        ("3", "column_count_mismatch", None, "error"), ("4", "column_count_warning", None, "warning")]


def test_completeness(spark):
    def table(name, filled):
        return 1, name, "T", 1, ["", "a"], [row("x", [None, "1" if i < filled else None]) for i in range(100)]

    tables = spark.createDataFrame([table(str(n), n) for n in (49, 50, 69, 70)], TABLE)
    out = quality.completeness_findings(tables)
    assert findings(out) == [
        ("49", "data_completeness_error", None, "error"), ("50", "data_completeness_warning", None, "warning"),
        ("69", "data_completeness_warning", None, "warning")]
    assert out.filter("item_id = '49'").first()["message"] == "Endast 49% dataceller har värden (min 50% krävs)"


def test_heuristics(spark):
    reports = spark.createDataFrame([(1, 8), (2, 3), (3, 3)], "report int, pages int")
    tables = spark.createDataFrame([(1, "a", "T", 1, [], [row("x", []), row("y", [])]), (3, "b", "T", 1, [], [row("x", [])])], TABLE)
    none = spark.createDataFrame([], "report int, content string, title string")
    out = quality.report_heuristics(reports, tables, none, none)
    assert sorted((r["report"], r["error_type"], r["severity"]) for r in out.collect()) == [
        (1, "few_tables", "warning"), (2, "few_tables", "warning"), (2, "no_tables", "error"), (3, "thin_table", "warning")]


def test_promotion(spark):
    rows = f"array<{ROW}>"
    tables = spark.createDataFrame([
        (1, 1, ["Income statement"], [row("NOKm", ["Q3 2023", "Q4 2023", "Q1 2024"]), row("Revenues", ["356", "545", "1"])]),
        (1, 2, ["x"], [row("NOKm", ["Q3 2023", "b", "c", "d"])]),
        (1, 3, ["x"], [row("NOKm", ["2024"])]),
        (1, 4, ["x"], []),
    ], f"period_id int, id int, columns array<string>, rows {rows}")
    out = normalise.promote_headers(tables).orderBy("id").collect()
    assert out[0]["columns"] == ["NOKm", "Q3 2023", "Q4 2023", "Q1 2024"] and len(out[0]["rows"]) == 1
    assert [r["promoted"] for r in out] == [True, False, True, False]
    assert out[2]["columns"] == ["NOKm", "2024"] and out[2]["rows"] == []


def _table_rows(spark, rows):
    return spark.createDataFrame(
        rows, "period_id int, table_id int, page_number int, row_no int, label string, label_en string, values array<string>"
    )


def test_compare_companies(spark):
    rows = compare.canonical_labels(_table_rows(spark, [
        (1, 1, 1, 0, "Nettoomsättning", "Net sales", [None, "959"]),
        (1, 1, 1, 1, "Igen", "Net revenue", [None, "1"]),
        (1, 1, 1, 2, "Eget", "Only here", [None, "1"]),
        (1, 1, 1, 3, "Tom", "", [None, "1"]),
        (1, 1, 1, 4, "Noll", "EBIT", [None, "abc"]),
        (2, 2, 1, 0, "Omsetning", "Net revenue", [None, "904"]),
        (2, 2, 1, 1, "EBIT", "ebit", [None, "0"]),
    ]))
    pairs = spark.createDataFrame([(9, 1, 2), (8, 2, 1)], "pair_id int, period_1 int, period_2 int")
    out = {(r["pair_id"], r["canonical"]): r for r in compare.compare_companies(rows, pairs).collect()}
    sales, back = out[9, "net sales"], out[8, "net sales"]
    assert (sales["difference"], sales["ratio"], sales["matched_via"]) == (55.0, 1.06, None)
    assert (back["difference"], back["ratio"], back["matched_via"]) == (-55.0, 0.94, "net sales")
    assert (out[9, "ebit"]["value_1"], out[9, "ebit"]["difference"], out[9, "ebit"]["ratio"]) == (None, None, None)
    left = compare.unmatched_rows(rows, pairs).orderBy("pair_id", "place").collect()
    assert [(r["pair_id"], r["label_en"]) for r in left] == [(9, "Net revenue"), (9, "Only here")]


def test_unmatched_limit(spark):
    rows = compare.canonical_labels(_table_rows(spark, [(1, 1, 1, i, "x", f"row {i:02}", []) for i in range(15)]))
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id int, period_1 int, period_2 int")
    assert compare.unmatched_rows(rows, pairs).count() > 10
    out = compare.unmatched_rows(rows, pairs, limit=10).orderBy("place").collect()
    assert [r["label_en"] for r in out] == [f"row {i:02}" for i in range(10)]


def test_retry_pages(spark):
    items = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "c", 5), (3, "d", None)], "report int, id string, page int")
    reports = spark.createDataFrame([(1, 10), (2, 6), (3, 4), (4, 4)], "report int, pages int")
    pages = sorted(tuple(r) for r in compare.retry_pages(items, reports).collect())
    assert pages == [(1, 1), (1, 2)] + [(2, p) for p in range(1, 7)]
    scope = {r["report"]: r["partial"] for r in compare.retry_scope(items, reports).collect()}
    assert scope == {1: True, 2: False, 3: False}


def test_resolve_and_sort(spark):
    companies = spark.createDataFrame([(1, "Beta AB", "beta"), (2, "Alfa beta", "alfa")], "id int, name string, slug string")
    out = {r["term"]: r["id"] for r in lookup.resolve_companies(companies, ["beta", "BETA", "x"]).collect()}
    assert out == {"beta": 1, "BETA": 2}
    labels = spark.createDataFrame([("Q2 2024",), ("Q4 2023",), ("?",)], "period string")
    assert [r[0] for r in lookup.sort_by_period(labels).collect()] == ["?", "Q4 2023", "Q2 2024"]


def test_costs(spark):
    calls = spark.createDataFrame([("haiku", 1_000_000, 0), ("sonnet", 0, 1_000_000), ("x", 1, 0)], "m string, i bigint, o bigint")
    costs = [r[0] for r in calls.select(stats.model_cost_sek(F.col("m"), F.col("i"), F.col("o"))).collect()]
    assert costs == [Decimal("8.400000"), Decimal("157.500000"), Decimal("0.000032")]
    assert calls.limit(1).select(stats.ocr_cost_usd(F.lit(12))).first()[0] == Decimal("0.012000")


def test_merge_passes(spark):
    one = spark.sql("SELECT 1 report, 'haiku' model, 1000000L input_tokens, 0L output_tokens, named_struct('metadata', 'm') data")
    two = spark.sql("SELECT 1 report, 'haiku' model, 0L input_tokens, 0L output_tokens, named_struct('tables', 't', 'charts', 'c') data")
    three = spark.sql("SELECT 1 report, 'haiku' model, 0L input_tokens, 0L output_tokens, named_struct('sections', 's') data")
    row_ = stats.merge_passes(one, two, three).first()
    assert (row_["metadata"], row_["tables"], row_["charts"], row_["sections"], float(row_["total_cost_sek"])) == ("m", "t", "c", "s", 8.4)


@pytest.mark.parametrize("states, want", [
    (["done", "done"], "done"), (["done", "failed"], "partial_failure"), (["failed", "failed"], "failed"),
    (["done", "pending"], "processing"), (["pending"], "pending"),
])
def test_batch_status(spark, states, want):
    jobs = spark.createDataFrame([(1, i, s, 2.0) for i, s in enumerate(states)], "batch_id int, job_id int, status string, cost_sek double")
    out = status.batch_status(jobs).first()
    assert (out["status"], out["total_cost_sek"]) == (want, 2.0 * states.count("done"))


def test_window_is_strict(spark):
    df = spark.sql("SELECT 'k' AS key, id AS event_id, timestamp_seconds(s) AS ts FROM VALUES (1, 0), (2, 59), (3, 60) AS t(id, s)")
    out = streams.requests_in_window(df, limit=2).orderBy("event_id").collect()
    assert [(r["in_window"], r["at_limit"]) for r in out] == [(1, False), (2, True), (2, True)]


KNOWLEDGE = """id int, domain string, category string, title string, content string, tags array<string>,
  related_metrics array<string>, source string, embedding array<float>, updated_at timestamp"""


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        (1, "bransch", "a", "Marginal", "Om EBIT", ["x"], ["ebit"], None, [1.0, 0.0], None),
        (2, "bransch", "b", "Tillväxt", "Om omsättning", ["y"], [], None, [0.0, 1.0], None),
        (3, "värdering", "a", "Multipel", "EV/EBIT", [], [], None, None, None),
    ]
    return spark.createDataFrame(rows, KNOWLEDGE)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_knowledge_search(entries):
    hits = search.search_knowledge(entries, [Query(1, "q", [1.0, 0.1])], 5).orderBy("place")
    assert ids(hits) == [1, 2]
    assert ids(search.search_knowledge_text(entries, "EV/omsättning")) == [2, 3]
    assert ids(search.search_knowledge_text(entries, "ebit", domain="bransch")) == [1]
    assert ids(search.search_knowledge_text(entries, "")) == [1, 2, 3]
    assert ids(search.with_any_tag(entries, ["x", "z"])) == [1] and ids(search.with_metric(entries, "ebit")) == [1]


def test_knowledge_changes(spark, entries):
    patches = spark.createDataFrame(
        [(1, "Ny", None, None, None, None, None), (2, None, None, "c", [], None, None), (7, "?", None, None, None, None, None)],
        "id int, title string, content string, category string, tags array<string>, related_metrics array<string>, source string",
    )
    out = {r["id"]: r for r in knowledge.update_entries(entries, patches).collect()}
    assert (out[1]["title"], out[1]["embedding"], out[2]["category"], out[2]["tags"]) == ("Ny", None, "c", [])
    assert out[2]["embedding"] == [0.0, 1.0] and out[3]["updated_at"] is None and out[2]["updated_at"] is not None
    assert ids(knowledge.unknown_ids(patches, entries)) == [7]
    assert sorted(ids(knowledge.delete_entries(entries, patches))) == [3]
    bad = spark.createDataFrame([("fel", "c", "t", "x", None, None, None), ("bransch", "c", "t", "x", None, None, None)],
                                "domain string, category string, title string, content string, tags array<string>, "
                                "related_metrics array<string>, source string")
    assert knowledge.split_by_domain(bad)[1].first()["error"].startswith("Ogiltig domain: fel")
    assert knowledge.new_entries(bad).first()["tags"] == []


def test_search_chain(spark):
    sections = spark.createDataFrame([
        (1, 1, "A", "t", 1, "Resultatet ökade " + "x" * 400, [1.0, 0.0], "acme"),
        (2, 1, "B", "t", 2, "Ingen vektor men resultat", None, "acme"),
        (3, 2, "C", "t", 1, "Annat", [0.0, 1.0], "other"),
    ], "id int, period_id int, title string, section_type string, page_number int, content string, embedding array<float>, slug string")
    queries = [Query(1, "resultatet", [1.0, 0.0], "acme"), Query(2, "RESULTAT"), Query(3, "annat", [1.0, 0.0], "nobody")]
    out = search.search_sections(sections, queries).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["search_type"], r["id"]) for r in out] == [(1, "hybrid", 1), (2, "text", 1), (2, "text", 2)]
    assert out[0]["score"] == 1.0 and out[0]["excerpt"].endswith("...") and len(out[0]["excerpt"]) == 303
    due = search.missing_vectors(sections)
    assert [(r["id"], r["token_estimate"]) for r in due.collect()] == [(2, 7)]

    def encoder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    def failing(texts):
        raise RuntimeError("nere")

    assert [(r["id"], r["vector"], r["error"]) for r in search.encode(due, failing).collect()] == [(2, None, "RuntimeError: nere")]
    short = search.encode(due, lambda texts: []).first()
    assert short["vector"] is None and short["error"].startswith("ValueError")
    filled = search.fill_vectors(sections, search.encode(due, encoder)).orderBy("id").collect()
    assert filled[1]["embedding"] == [28.0, 1.0] and filled[0]["embedding"] == [1.0, 0.0]
