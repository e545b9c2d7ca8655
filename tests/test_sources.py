import hashlib
import json

import pytest
from pyspark.sql import functions as F

from reportloom.schemas import MODEL_TABLES, PAYLOAD
from reportloom.sources import pages, payloads, store
from reportloom.sources.files import file_inventory
from reportloom.sources.sinks import extraction_report, write_databook
from reportloom.sources.tables import read_knowledge_items, read_table

REPORT = {
    "metadata": {"bolag": "Åhléns & Co AB", "period": "Q3 2024", "valuta": "MSEK"},
    "tables": [{"id": "t1", "title": "Resultat", "type": "income_statement", "page": 2, "columns": ["", "2024"],
                "rows": [{"label": "Nettoomsättning", "values": [None, 12.5], "order": 1}]}],
    "sections": [{"title": "VD", "page": 1, "type": "narrative", "content": "Text"}, {"page": 3}],
    "charts": [{"title": "Graf", "page": 4, "data_points": [{"label": "a", "value": 1.5}]}],
    "resultatrakning": [{"rad": "", "namn": "Summa", "varde": 3}, {"rad": "Skatt", "varde": None, "typ": "total"}],
    "_pipeline_info": {"total_cost_sek": 4.25, "pass1_counts": {"tables": 2, "sections": 2, "charts": 1}},
}
GOOD = json.dumps(REPORT, ensure_ascii=False)


def parse(spark, texts):
    rows = [(i, i, f"h{i}", t) for i, t in enumerate(texts)]
    return payloads.parse_payloads(spark.createDataFrame(rows, "id int, seq int, pdf_hash string, raw string"), PAYLOAD)


def raw_texts(spark, texts):
    return parse(spark, texts).select("seq", "pdf_hash", "raw")


def test_repairs(spark):
    texts = [
        GOOD,
        f"```json\n{GOOD}\n```\nmer",
        '{"metadata": {"period": "Q1 2024",}, "tables": [],}',
        '{"metadata": {"period": "Q1 2024"}, "tables": [{"id": "a"}, {"id": "b}',
        '{"metadata": {"period": "Q1 2024"}} och } sen',
        "ingen data",
        '{"metadata": oj',
        f"Här är svaret: {GOOD}",
        '{"a": 1} {"b": 2}',
        None,
    ]
    out = parse(spark, texts).orderBy("id").collect()
    assert [r["repair"] for r in out] == ["none", "none", "commas", "closed", "balanced", None, None, "none", None, None]
    assert out[3]["payload"]["tables"][0]["id"] == "a"
    rejected = {r["id"]: r["reason"] for r in payloads.rejected_payloads(parse(spark, texts)).collect()}
    unreadable = dict.fromkeys([5, 6, 8, 9], "no readable JSON object")
    assert rejected == unreadable | dict.fromkeys([2, 3, 4], "no company")


@pytest.fixture(scope="module")
def companies(spark):
    names = spark.createDataFrame([("Åhléns & Co AB",), ("Åhléns & Co AB ",), ("Nytt",)], "name string")
    none = spark.createDataFrame([], MODEL_TABLES["companies"])
    made = payloads.new_companies(names, none)
    assert {r["slug"] for r in made.collect()} == {"åhléns-co-ab", "nytt"}
    assert payloads.new_companies(names, made).count() == 0
    return made


def test_rows(spark, companies):
    later = dict(REPORT, metadata=dict(REPORT["metadata"], sprak="no"), tables=[])
    periods = payloads.period_rows(parse(spark, [GOOD, json.dumps(later), '{"metadata": {"period": "oj"}}']), companies)
    (row,) = periods.collect()
    assert (row["quarter"], row["year"], row["language"], row["tables_count"], row["sections_count"]) == (3, 2024, "no", 0, 2)
    assert (float(row["cost_sek"]), row["extraction_status"], row["pdf_hash"]) == (4.25, "extracting", "h1")
    first = payloads.period_rows(parse(spark, [GOOD]), companies)
    assert first.first()["language"] == "sv"
    (table,) = payloads.report_table_rows(first).collect()
    assert table["rows"][0]["values"] == [None, "12.5"] and table["table_key"] == "t1"
    sections = payloads.section_rows(first).orderBy("page_number").collect()
    assert [(s["title"], s["content"]) for s in sections] == [("VD", "Text"), ("", "")]
    (chart,) = payloads.chart_table_rows(first).collect()
    assert chart["estimated"] is True and float(chart["data_points"][0]["value"]) == 1.5
    legacy = payloads.financial_rows(first).orderBy("row_order").collect()
    assert [(r["row_name"], r["statement_type"], r["row_type"]) for r in legacy] == [
        ("Summa", "resultatrakning", None), ("Skatt", "resultatrakning", "total")]


def children(periods):
    return {
        "financial_data": payloads.financial_rows(periods),
        "sections": payloads.section_rows(periods),
        "report_tables": payloads.report_table_rows(periods),
        "charts": payloads.chart_table_rows(periods),
    }


def stored(spark, root, name):
    return spark.read.parquet(f"{root}/{name}")


def test_replace_periods(spark, companies, tmp_path):
    root = str(tmp_path / "store")
    other = dict(REPORT, metadata=dict(REPORT["metadata"], period="Q3 2024", bolag="Nytt"))
    both = payloads.period_rows(parse(spark, [GOOD, json.dumps(other)]), companies)
    store.replace_periods(spark, root, both.drop("payload"), children(both))
    assert stored(spark, root, "periods").count() == 2 and stored(spark, root, "sections").count() == 4
    again = payloads.period_rows(parse(spark, [json.dumps(dict(REPORT, sections=[], tables=[]))]), companies)
    for _ in range(2):
        store.replace_periods(spark, root, again.drop("payload"), children(again))
        assert stored(spark, root, "periods").count() == 2
        assert stored(spark, root, "sections").count() == 2
        assert stored(spark, root, "report_tables").count() == 1
        assert stored(spark, root, "charts").count() == 2


def test_ingest(spark, companies, tmp_path):
    raw = parse(spark, [GOOD, "trasig"]).select("seq", "pdf_hash", "raw")
    for _ in range(2):
        store.ingest(spark, str(tmp_path / "s"), raw, companies)
    counts = {n: stored(spark, str(tmp_path / "s"), n).count() for n in ("periods", "sections", "report_tables", "charts", "financial_data")}
    assert counts == {"periods": 1, "sections": 2, "report_tables": 1, "charts": 1, "financial_data": 2}
    assert list((tmp_path / "s" / "_staging").iterdir()) == []


def test_last_row_of_a_partition_goes(spark, companies, tmp_path):
    root = str(tmp_path / "store")
    store.ingest(spark, root, raw_texts(spark, [GOOD]), companies)
    other = json.dumps(dict(REPORT, metadata=dict(REPORT["metadata"], period="Q4 2024")))
    store.ingest(spark, root, raw_texts(spark, [other]), companies)
    bare = json.dumps({"metadata": REPORT["metadata"]})
    for _ in range(2):
        store.ingest(spark, root, raw_texts(spark, [bare]), companies)
        for name in ("sections", "report_tables", "charts", "financial_data"):
            assert {(r["year"], r["quarter"]) for r in stored(spark, root, name).collect()} == {(2024, 4)}, name
    assert stored(spark, root, "periods").count() == 2


def test_unknown_company_is_added(spark, tmp_path):
    root = str(tmp_path / "store")
    none = spark.createDataFrame([], MODEL_TABLES["companies"])
    for _ in range(2):
        store.ingest(spark, root, raw_texts(spark, [GOOD, "trasig"]), none)
        (company,) = stored(spark, root, "companies").collect()
        (period,) = stored(spark, root, "periods").collect()
        assert company["slug"] == "åhléns-co-ab" and period["company_id"] == company["id"]


def test_equal_seq_has_one_winner(spark, companies):
    low, high = (json.dumps(dict(REPORT, metadata=dict(REPORT["metadata"], valuta=v))) for v in ("SEK", "EUR"))
    rows = [(1, "h", low), (1, "h", high)]
    winners = set()
    for order in (rows, rows[::-1]):
        raw = spark.createDataFrame(order, "seq int, pdf_hash string, raw string")
        winners.add(payloads.period_rows(payloads.parse_payloads(raw), companies).first()["valuta"])
    assert len(winners) == 1


def test_failed_child_leaves_store(spark, companies, tmp_path):
    root = str(tmp_path / "store")
    one = payloads.period_rows(parse(spark, [GOOD]), companies)
    store.replace_periods(spark, root, one.drop("payload"), children(one))
    broken = children(one)
    broken["sections"] = broken["sections"].withColumn("title", F.raise_error(F.lit("trasig")).cast("string"))
    with pytest.raises(Exception, match="trasig"):
        store.replace_periods(spark, root, one.drop("payload").withColumn("valuta", F.lit("X")), broken)
    assert stored(spark, root, "periods").first()["valuta"] == "MSEK"
    only_charts = children(one)
    only_charts["charts"] = only_charts["charts"].withColumn("title", F.raise_error(F.lit("trasig")).cast("string"))
    with pytest.warns(UserWarning, match="charts"):
        store.replace_periods(spark, root, one.drop("payload").withColumn("valuta", F.lit("Y")), only_charts)
    assert stored(spark, root, "periods").first()["valuta"] == "Y"
    assert stored(spark, root, "charts").count() == 0 and stored(spark, root, "sections").count() == 2


def test_markdown_table(spark):
    text = "| A || B |\n|---|---|\n\n| x || 2 |\n| :--| y |\n"
    row = pages.parse_markdown_tables(spark.createDataFrame([(1, text), (2, "")], "id int, markdown string")).orderBy("id").collect()
    assert row[0]["columns"] == ["A", "B"]
    assert [(r["label"], r["values"], r["order"]) for r in row[0]["rows"]] == [("x", ["2"], 1), (":--", ["y"], 2)]
    assert row[1]["columns"] == [] and row[1]["rows"] == []


def test_page_sections(spark):
    long = "Ord " * 13 + "slut"
    rows = [
        (1, 1, f"kort\n{long}\nmer text\n| a | b |"),
        (1, 2, f"fortsätter här {'x' * 60}\n# Rubrik\n" + "a" * 99),
        (1, 3, "## VD har ordet \n" + "b" * 50 + "\n---|---\n\n"),
        (1, 4, "b" * 49 + "\n#Ingen rubrik\n### Tom\n### Sista\n" + "c" * 100),
        (2, 1, "kort\nrad"),
        (3, 1, None),
    ]
    out = pages.page_sections(spark.createDataFrame(rows, "doc_id int, page_num int, markdown string")).orderBy("section_no").collect()
    assert [(r["title"], r["page"], r["section_type"]) for r in out] == [
        ("Text från sida 1", 1, "other"), ("VD har ordet", 3, "narrative"), ("Sista", 4, "other")]
    assert out[0]["content"] == f"{long}\nmer text\nfortsätter här {'x' * 60}"
    assert out[1]["content"] == "b" * 50 + "\n" + "b" * 49 + "\n#Ingen rubrik"
    exact = spark.createDataFrame([(1, 1, "# R\n" + "a" * 100), (2, 1, "# R\n" + "a" * 99)], "doc_id int, page_num int, markdown string")
    assert [r["doc_id"] for r in pages.page_sections(exact).collect()] == [1]


def test_document_texts(spark):
    rows = [(1, 2, "två"), (1, 1, "ett"), (1, 3, "")]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, markdown string")
    assert pages.document_texts(df).first()["full_text"] == "--- Sida 1 ---\nett\n\n--- Sida 2 ---\ntvå"


def test_files_and_tables(spark, tmp_path):
    folder = tmp_path / "skall_extractas"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"innehall")
    (folder / "b.txt").write_bytes(b"annat")
    (row,) = file_inventory(spark, str(tmp_path)).collect()
    assert (row["folder"], row["name"], row["md5_12"]) == ("skall_extractas", "a.pdf", hashlib.md5(b"innehall").hexdigest()[:12])
    spark.createDataFrame([("net revenue", "net sales")], MODEL_TABLES["label_synonyms"]).write.parquet(str(tmp_path / "label_synonyms"))
    assert read_table(spark, str(tmp_path), "label_synonyms").count() == 1
    items = tmp_path / "items.json"
    items.write_text('{"domain": "bransch", "title": "T", "tags": ["a"]}\n')
    assert read_knowledge_items(spark, str(items)).first()["tags"] == ["a"]


def test_outputs(spark, companies, tmp_path):
    periods = payloads.period_rows(parse(spark, [GOOD]), companies)
    parts = children(periods)
    (line,) = extraction_report(companies, periods, parts["report_tables"], parts["sections"], parts["charts"]).collect()
    assert (line["period"], line["tables_status"], line["sections_status"]) == ("Q3 2024", "1/2", "2/2")
    sheet = spark.createDataFrame([(1, "x"), (2, "y")], "company_id int, label string")
    for fmt in ("parquet", "csv"):
        write_databook({"Nyckeltal": sheet}, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", "true").format(fmt).load(str(tmp_path / fmt))
        assert {(r["company_id"], r["label"], r["sheet"]) for r in back.collect()} == {(1, "x", "Nyckeltal"), (2, "y", "Nyckeltal")}


def test_every_schema_parses(spark):
    for name, schema in MODEL_TABLES.items():
        assert spark.createDataFrame([], schema).columns, name
