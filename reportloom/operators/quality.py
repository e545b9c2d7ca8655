"""Data-quality rules. Every rule gives one row per finding; row rules run inside the table row, without a shuffle.

Tables: report, id, title, page, columns, rows. Sections: report, id, position, title, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.labels import is_placeholder_label
from reportloom.functions.text import is_blank, let
from reportloom.schemas import FINDING_COLUMNS

ERROR, WARNING = "error", "warning"
_UNKNOWN_TABLE = "Okänd tabell"


def _finding(kind: str, message: Column, severity: str, row_index: Column | None = None) -> Column:
    index = F.lit(None).cast("int") if row_index is None else row_index.cast("int")
    return F.struct(
        F.lit(kind).alias("error_type"),
        message.alias("message"),
        index.alias("row_index"),
        F.lit(severity).alias("severity"),
    )


def _exploded(df: DataFrame, findings: Column, item: Column, title: Column, *more: str) -> DataFrame:
    found = F.explode(F.filter(findings, lambda f: f.isNotNull())).alias("f")
    return df.select("report", item.alias("item_id"), title.alias("title"), *more, found).select(
        "report", "item_id", "title", *more, "f.error_type", "f.message", "f.row_index", "f.severity"
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _is_year_value(value: Column) -> Column:
    return value.rlike(r"^[0-9]+$") & value.try_cast("int").between(1900, 2099)


def _after_label(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def _row_findings(row: Column, index: Column) -> Column:
    label = F.coalesce(row["label"], F.lit(""))
    values = F.coalesce(row["values"], F.array().cast("array<string>"))
    columns = F.coalesce(F.col("columns"), F.array().cast("array<string>"))
    first = F.get(values, F.lit(0))
    data = _after_label(values)
    header = F.coalesce(row["type"], F.lit("data")) == "header"
    return F.array(
        F.when(
            is_placeholder_label(label),
            _finding("invalid_label", _text("Ogiltig label '", label, "' - ska vara verklig text från PDF"), ERROR, index),
        ),
        F.when(
            (F.size(columns) > 0) & (F.size(values) != F.size(columns)),
            _finding(
                "values_length_mismatch",
                _text("Rad '", label, "' har ", F.size(values), " values men ", F.size(columns), " columns"),
                ERROR,
                index,
            ),
        ),
        F.when(
            first.isNotNull() & ~F.coalesce(_is_year_value(first), F.lit(False)),
            _finding(
                "first_value_not_null",
                _text("Rad '", label, "' har forsta vardet ", F.coalesce(first, F.lit("")), " istallet for null"),
                WARNING,
                index,
            ),
        ),
        F.when(
            ~header & (F.size(data) > 0) & F.forall(data, lambda v: v.isNull()),
            _finding("no_data_values", _text("Rad '", label, "' har inga numeriska varden (alla null)"), WARNING, index),
        ),
    )


def table_findings(tables: DataFrame) -> DataFrame:
    """Empty table, placeholder label, wrong width, filled label slot, row without values."""
    return _on_tables(tables, _row_rules())


def _row_rules() -> Column:
    empty = F.array(_finding("empty_table", F.lit("Tabellen har inga rader"), ERROR))
    per_row = F.flatten(F.transform("rows", _row_findings))
    return F.when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, empty).otherwise(per_row)


def _on_tables(tables: DataFrame, found: Column) -> DataFrame:
    return _exploded(tables, found, F.coalesce("id", F.lit("unknown")), F.coalesce("title", F.lit(_UNKNOWN_TABLE)))


def missing_table_findings(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of the structure map that were not extracted."""
    lost = expected.join(tables.select("report", "id"), ["report", "id"], "left_anti")
    page = F.coalesce(F.col("page").cast("string"), F.lit("?"))
    message = _text("Tabell saknas i extraktion (identifierad på sida ", page, ")")
    return _exploded(
        lost, F.array(_finding("missing_table", message, ERROR)), F.col("id"), F.coalesce("title", F.lit("Okänd"))
    )


def column_count_findings(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """Header count against the structure map: off by one warns, more is an error; empty lists are skipped."""
    headers = expected.select("report", "id", F.size("column_headers").alias("want"))
    joined = tables.join(headers, ["report", "id"]).withColumn("have", F.size("columns"))
    want, have = F.col("want"), F.col("have")
    both = (want > 0) & (have > 0)
    gap = F.abs(want - have)
    found = F.array(
        F.when(
            both & (gap > 1),
            _finding("column_count_mismatch", _text("Förväntade ", want, " kolumner men fick ", have), ERROR),
        ),
        F.when(
            both & (gap == 1),
            _finding(
                "column_count_warning", _text("Kolumnantal skiljer: ", want, " (Pass 1) vs ", have, " (Pass 2)"), WARNING
            ),
        ),
    )
    return _exploded(joined, found, F.col("id"), F.coalesce("title", F.lit(_UNKNOWN_TABLE)))


def completeness_findings(tables: DataFrame) -> DataFrame:
    """Share of filled data cells: under half is an error, under 70 % a warning."""
    return _on_tables(tables, _completeness_rule())


def _completeness_rule() -> Column:
    def data(row: Column) -> Column:
        return F.when(F.size(row["values"]) > 1, _after_label(row["values"])).otherwise(row["values"])

    body = F.filter("rows", lambda r: F.coalesce(r["type"], F.lit("data")) != "header")
    cells = F.flatten(F.transform(body, data))
    share = let(cells, lambda c: F.try_divide(F.size(F.filter(c, lambda v: v.isNotNull())), F.size(c)))

    def judged(part: Column) -> Column:
        percent = _text(F.bround(part * 100, 0).cast("int"), "%")
        low = _finding(
            "data_completeness_error", _text("Endast ", percent, " dataceller har värden (min 50% krävs)"), ERROR
        )
        thin = _finding("data_completeness_warning", _text(percent, " dataceller har värden"), WARNING)
        return F.array(F.when(part < 0.5, low).when(part < 0.7, thin))

    checked = (F.size("rows") > 0) & (F.size("columns") > 0)
    return F.when(checked, let(share, judged)).otherwise(F.array())


def section_findings(sections: DataFrame) -> DataFrame:
    """Sections without content or title; warnings only."""
    numbered = _text("Section ", F.col("position"))
    title = F.when(F.coalesce("title", F.lit("")) == "", numbered).otherwise(F.col("title"))
    item = F.coalesce("id", _text("section_", F.col("position")))
    no_content = _finding("empty_content", F.lit("Sektionen har inget innehall"), WARNING)
    no_title = _finding("missing_title", F.lit("Sektionen saknar titel"), WARNING)
    found = F.array(F.when(is_blank(F.col("content")), no_content), F.when(is_blank(F.col("title")), no_title))
    shown = F.when(F.col("error_type") == "missing_title", F.col("_numbered")).otherwise(F.col("title")).alias("title")
    out = _exploded(sections.withColumn("_numbered", numbered), found, item, title, "_numbered")
    return out.select(*[shown if c == "title" else F.col(c) for c in FINDING_COLUMNS])


def all_findings(tables: DataFrame, sections: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """All rules together; without a structure map the rules that need one are left out.

    The rules that look at one table only run in one pass over the tables.
    """
    in_table = F.concat(_row_rules(), _completeness_rule())
    parts = [_on_tables(tables, in_table), section_findings(sections)]
    if expected is not None:
        parts += [missing_table_findings(expected, tables), column_count_findings(expected, tables)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*FINDING_COLUMNS)


def verdict(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Per report: number of errors and warnings; valid when there is no error."""
    counts = findings.groupBy("report").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings")
    )
    errors = F.coalesce("errors", F.lit(0))
    return reports.select("report").join(counts, "report", "left").select(
        "report", errors.alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (errors == 0).alias("is_valid")
    )


def report_heuristics(reports: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame) -> DataFrame:
    """Plausibility of a report against its page count (reports: report, pages): one row per message."""
    rows = F.coalesce(F.size("rows"), F.lit(0))
    t = tables.groupBy("report").agg(F.count("*").alias("tables"))
    s = sections.groupBy("report").agg(F.count_if(F.length(F.coalesce("content", F.lit(""))) < 50).alias("short"))
    c = charts.groupBy("report").agg(F.count_if(F.coalesce("title", F.lit("")) == "").alias("untitled"))
    joined = reports
    for counts in (t, s, c):
        joined = joined.join(counts, "report", "left")
    n = F.coalesce("tables", F.lit(0))
    least = F.greatest(F.lit(1), F.floor(F.col("pages") / 4).cast("int"))
    found = F.array(
        F.when(
            n < least,
            _finding(
                "few_tables",
                _text("Få tabeller extraherade: ", n, " (förväntade minst ", least, " för ", F.col("pages"), " sidor)"),
                WARNING,
            ),
        ),
        F.when(
            F.col("short") > 0, _finding("short_sections", _text(F.col("short"), " sektion(er) har mindre än 50 tecken"), WARNING)
        ),
        F.when(
            F.col("untitled") > 0, _finding("untitled_charts", _text(F.col("untitled"), " graf(er) saknar titel"), WARNING)
        ),
        F.when(
            (n == 0) & (F.col("pages") > 2),
            _finding("no_tables", F.lit("Inga tabeller extraherade från ett flersidigt dokument"), ERROR),
        ),
    )
    whole = _exploded(joined, found, F.lit(None).cast("string"), F.lit(None).cast("string"))
    thin = tables.filter(rows < 2)
    message = _text("Tabell '", F.coalesce("title", F.lit("?")), "' har bara ", rows, " rad(er)")
    return whole.unionByName(
        _exploded(thin, F.array(_finding("thin_table", message, WARNING)), F.col("id").cast("string"), F.col("title"))
    )


def retry_labels(tables: DataFrame, findings: DataFrame) -> DataFrame:
    """What a retry has to fix, one row per table and problem, in order of the rows."""
    kinds = ["invalid_label", "values_length_mismatch", "empty_table", "column_count_mismatch", "no_data_values",
             "data_completeness_error"]
    kept = findings.filter(F.col("error_type").isin(kinds))
    where = tables.select("report", F.col("id").alias("item_id"), F.coalesce(F.col("page").cast("string"), F.lit("?")).alias("page"))
    return kept.join(where, ["report", "item_id"]).select(
        "report", "item_id", "title", "page", "row_index", "error_type", "message"
    )
