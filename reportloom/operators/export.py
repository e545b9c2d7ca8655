"""Composed databook export: the cells of all sheets of a scope of periods, in one typed table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.periods import period_label
from reportloom.functions.text import line_kind, strip
from reportloom.operators import databook
from reportloom.operators.lookup import filter_periods
from reportloom.session import cut_lineage
from reportloom.vocabulary import CHART_SHEET, LEGACY_SHEETS, SHEET_ORDER

#: Columns of a cell, in reading order: where it stands, then what it holds.
PLACE = ["company_id", "block", "spot", "tie", "period_no", "part_id", "row_no", "cell_no"]
CELL = [*PLACE, "sheet", "period", "part", "label", "header", "number", "text", "kind"]
_POSITIONS = 1 << 32
_PASSED_ON = 1 << 12  # periods of a scope that travel with the plan


@dataclass(frozen=True)
class Reports:
    """Stored reports: periods (id, company_id, year, quarter) and their children by ``period_id``.

    ``sections`` have a ``position`` within their period; the other tables are those of the model.
    """

    periods: DataFrame
    financial: DataFrame
    tables: DataFrame
    charts: DataFrame
    sections: DataFrame


def _cells(rows: DataFrame, **values: Column | str) -> DataFrame:
    """Rows as cells; what a kind of sheet does not have is null."""
    types = {
        "period_no": "bigint", "part_id": "string", "row_no": "bigint", "cell_no": "int", "period": "string", "part": "string",
        "label": "string", "header": "string", "number": "decimal(28,6)", "text": "string", "kind": "string",
    }
    return rows.select(*[
        (F.lit(None) if c in types and c not in values else F.col(values[c]) if isinstance(values.get(c), str) else values[c] if c in values else F.col(c))
        .cast(types[c]).alias(c) if c in types else F.col(c) for c in CELL
    ])


def databook_cells(reports: Reports, labels: list[str] | None = None, name_limit: int | None = None) -> DataFrame:
    """Every cell of the databooks of all companies, with its sheet.

    ``labels`` names one or some periods (Q1 2024), None takes all; a company without any of them has no databook. A
    company with report tables gets a sheet for each type of table, one of charts, and one for each title of a kept
    section; one with statements only gets the legacy sheets. Cells are in reading order by ``PLACE``; statement cells
    span the periods and have ``period_no`` 0. Amounts are in ``number``, values of tables and lines in ``text``; a
    separator is a cell of its own. Runs jobs.
    """
    chosen = reports.periods if labels is None else filter_periods(reports.periods, labels)
    within = Window.partitionBy("company_id").orderBy("year", "quarter")
    placed = cut_lineage(chosen.select(
        F.col("id").alias("period_id"), "company_id", period_label(F.col("quarter"), F.col("year")).alias("period"),
        (F.row_number().over(within) - 1).cast("bigint").alias("period_no"),
    ))

    if placed.limit(_PASSED_ON + 1).count() <= _PASSED_ON:
        # Rows of known size, so Catalyst can keep texts and tables where they are read instead of dealing them by period.
        placed = placed.sparkSession.createDataFrame(placed.toArrow(), placed.schema)

    def of_scope(rows: DataFrame) -> DataFrame:
        return rows.drop("company_id", "period", "period_no").join(placed, "period_id")

    financial, tables, charts = (of_scope(rows) for rows in (reports.financial, reports.tables, reports.charts))
    sections = of_scope(reports.sections).withColumns({
        "section_no": F.col("period_no") * _POSITIONS + F.col("position"), "page": F.col("page_number"),
    })
    kept = cut_lineage(databook.unique_sections(sections))
    plan = cut_lineage(databook.sheet_plan(chosen, tables, financial, charts, kept, name_limit))
    parts = [
        _separators(plan), _statement_cells(plan, financial, tables), _table_cells(plan, tables), _chart_cells(plan, charts),
        _text_cells(plan, kept, sections),
    ]
    return reduce(DataFrame.unionByName, parts)


def _separators(plan: DataFrame) -> DataFrame:
    heads = plan.filter("(block = 0 AND spot = 0) OR (block = 1 AND spot = -1)")
    return _cells(heads, text="sheet", kind=F.lit("separator"))


def _on_sheet(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the number sheets that are planned (company_id, sheet)."""
    return rows.join(plan.filter("block = 0"), ["company_id", "sheet"])


def _sheet_of(pairs: list[tuple[str, str]], kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[kind]


def _statement_cells(plan: DataFrame, financial: DataFrame, tables: DataFrame) -> DataFrame:
    """Legacy statements, aligned over the periods of the scope."""
    modern = tables.select("company_id").distinct()
    rows = financial.join(modern, "company_id", "left_anti").select(
        "company_id", F.col("statement_type").alias("statement"), "period", "period_no", F.col("row_order").alias("row_no"),
        F.col("row_name").alias("name"), "value", "row_type",
    )
    matrix = databook.period_matrix(rows, databook.statement_order(rows))
    shown = matrix.withColumn("sheet", _sheet_of(LEGACY_SHEETS, F.col("statement")))
    return _cells(
        _on_sheet(plan, shown).withColumn("spread", F.lit(0)), period_no="spread", row_no="position", cell_no="period_no", period="period",
        label="label", header="period", number="value", kind="row_class",
    )


def _table_cells(plan: DataFrame, tables: DataFrame) -> DataFrame:
    shown = databook.table_dump(tables).withColumn("sheet", _sheet_of(SHEET_ORDER, F.col("sheet_type")))
    return _cells(
        _on_sheet(plan, shown), period_no="period_no", part_id="id", row_no="row_no", cell_no="cell_no", period="period",
        part="table_title", label="label", header="header", text="value", kind="row_type",
    )


def _chart_cells(plan: DataFrame, charts: DataFrame) -> DataFrame:
    known = charts.select("company_id", "period", "period_no", "id")
    shown = databook.chart_rows(charts).withColumn("sheet", F.lit(CHART_SHEET)).join(known.drop("period"), ["company_id", "id"])
    return _cells(
        _on_sheet(plan, shown), period_no="period_no", part_id="id", row_no="point_no", cell_no=F.lit(0), period="period", part="title",
        label="label", header="caption", number="value", kind=F.lit("point"),
    )


def _text_cells(plan: DataFrame, kept: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines of all texts of a sheet's title, without near copies of earlier ones."""
    sheets = plan.filter("block = 1 AND spot >= 0").join(
        kept.select("company_id", F.col("section_no").alias("tie"), F.col("title").alias("part")), ["company_id", "tie"]
    )
    titled = cut_lineage(sheets.select("company_id", F.col("part").alias("title")))
    texts = sections.join(titled, ["company_id", "title"], "left_semi")
    unique = databook.unique_by_title(texts.select("company_id", "title", "section_no", "content"))
    whole = texts.join(unique.select("company_id", "section_no"), ["company_id", "section_no"], "left_semi").select(
        "company_id", F.col("title").alias("part"), F.col("id").alias("part_id"), "period", "period_no",
        F.col("section_no"), "page", F.posexplode(F.split("content", "\n")).alias("row_no", "line"),
    ).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    page = F.col("page")
    shown = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat("part", F.lit(" (s. "), page.cast("string"), F.lit(")"))).otherwise(F.col("part"))
    placed = whole.join(sheets, ["company_id", "part"])
    return _cells(
        placed, period_no="period_no", part_id="part_id", row_no="row_no", cell_no=F.lit(0), period="period", part=shown, text="line",
        kind=line_kind(F.col("line")),
    )


def write_cells(cells: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cells as one dataset for each company and sheet, in reading order.

    Ranges of places, not sheets, are dealt to the tasks, so a sheet that holds most cells is written by many.
    """
    writer = cells.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).write.mode("overwrite").partitionBy("company_id", "sheet").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
