"""The composed export on a few reports."""

from decimal import Decimal

import pytest

from reportloom.operators import export

TABLE = "struct<label:string,values:array<string>,type:string>"


@pytest.fixture(scope="module")
def reports(spark):
    periods = spark.createDataFrame(
        [("a1", "a", 2023, 4), ("a2", "a", 2024, 1), ("b1", "b", 2024, 1), ("c1", "c", 2024, 1)], "id string, company_id string, year int, quarter int"
    )
    financial = spark.createDataFrame(
        [("b1", "resultatrakning", i, n, float(i), "data") for i, n in enumerate(["Intäkter", "Kostnader"])] + [("a1", "resultatrakning", 0, "X", 1.0, "data")],
        "period_id string, statement_type string, row_order int, row_name string, value double, row_type string",
    )
    tables = spark.createDataFrame(
        [("t1", "a1", "kpi", "Mått", 3, ["MSEK", "2023"], [("Vinst", [None, "5"], "data")]),
         ("t2", "a2", "weird", None, None, ["", "2024"], [("Antal", [None, "7", "8"], "data")])],
        f"id string, period_id string, table_type string, title string, page_number int, columns array<string>, rows array<{TABLE}>",
    )
    charts = spark.createDataFrame(
        [("g1", "a2", "Kurva", 2, "kr", False, [("jan", Decimal("1.5"), None), ("feb", Decimal("2.5"), None)])],
        "id string, period_id string, title string, page_number int, y_axis string, estimated boolean, "
        "data_points array<struct<label:string,value:decimal(28,6),segment:string>>",
    )
    long = "En mening som är tillräckligt lång för att räknas som den första meningen här."
    sections = spark.createDataFrame(
        [("s1", "a1", 0, "VD: ord", 2, long + "\n• punkt\n\n  rad två "), ("s2", "a2", 0, "VD: ord", 2, long), ("s3", "a2", 1, "Utsikter", None, "Helt annat xyz"),
         ("s4", "a2", 2, "Kopia", 9, long), ("s5", "c1", 0, "Ensam", 1, "text")],
        "id string, period_id string, position int, title string, page_number int, content string",
    )
    return export.Reports(periods, financial, tables, charts, sections)


def shown(cells):
    rows = cells.orderBy("company_id", *export.PLACE[1:]).collect()
    return [(r["company_id"], r["sheet"], r["period"], r["part"], r["label"], r["text"] if r["number"] is None else float(r["number"]), r["kind"]) for r in rows]


def test_all_periods(reports):
    got = shown(export.databook_cells(reports))
    long = "En mening som är tillräckligt lång för att räknas som den första meningen här."
    assert [g for g in got if g[0] == "a"] == [
        ("a", "═ SIFFROR & GRAFER ═", None, None, None, "═ SIFFROR & GRAFER ═", "separator"),
        ("a", "Nyckeltal", "Q4 2023", "Mått (s. 3)", "Vinst", "5", "data"),
        ("a", "Övrigt", "Q1 2024", "Övrigt", "Antal", "7", "data"),
        ("a", "Övrigt", "Q1 2024", "Övrigt", "Antal", "8", "data"),
        ("a", "Grafer", "Q1 2024", "Kurva", "jan", 1.5, "point"),
        ("a", "Grafer", "Q1 2024", "Kurva", "feb", 2.5, "point"),
        ("a", "═ TEXT ═", None, None, None, "═ TEXT ═", "separator"),
        ("a", "VD ord", "Q4 2023", "VD: ord (s. 2)", None, long, "text"),
        ("a", "VD ord", "Q4 2023", "VD: ord (s. 2)", None, "• punkt", "bullet"),
        ("a", "VD ord", "Q4 2023", "VD: ord (s. 2)", None, "rad två", "subheader"),
        ("a", "Utsikter", "Q1 2024", "Utsikter", None, "Helt annat xyz", "subheader"),
    ]
    assert [g[:6] for g in got if g[0] == "b"] == [
        ("b", "═ SIFFROR ═", None, None, None, "═ SIFFROR ═"),
        ("b", "Resultaträkning", "Q1 2024", None, "Intäkter", 0.0),
        ("b", "Resultaträkning", "Q1 2024", None, "Kostnader", 1.0),
    ]
    assert not [g for g in got if g[0] == "c"]  # neither tables nor statements


def test_some_periods(reports):
    got = shown(export.databook_cells(reports, ["Q1 2024"]))
    assert {g[2] for g in got} == {None, "Q1 2024"} and ("a", "Nyckeltal") not in {g[:2] for g in got}
    assert [g[5][:10] for g in got if g[1] == "VD ord"] == ["En mening "]
    assert export.databook_cells(reports, ["Q1 1990"]).count() == 0


def test_one_dataset_for_each_sheet(spark, reports, tmp_path):
    cells = export.databook_cells(reports)
    assert cells.columns == export.CELL
    for fmt in ("parquet", "csv"):
        export.write_cells(cells, f"{tmp_path}/{fmt}", fmt)
        stored = spark.read.option("header", "true").format(fmt).load(f"{tmp_path}/{fmt}")
        assert stored.count() == cells.count() and {r[0] for r in stored.select("sheet").distinct().collect()} == {
            r[0] for r in cells.select("sheet").distinct().collect()
        }
    assert (tmp_path / "parquet" / "company_id=a" / "sheet=Nyckeltal").is_dir()
