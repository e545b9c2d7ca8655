"""Look-ups: companies, periods, statements, sections, charts, whole payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.periods import label_quarter, label_year, loose_label, period_label
from reportloom.functions.scale import first_per_key
from reportloom.functions.text import cut
from reportloom.vocabulary import LEGACY_STATEMENT


def companies_with_counts(companies: DataFrame, periods: DataFrame) -> DataFrame:
    """Every company with its number of periods, companies without any included."""
    counts = periods.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("period_count"))
    return (
        companies.join(counts, "id", "left")
        .select("id", "name", "slug", F.coalesce("period_count", F.lit(0)).alias("period_count"))
        .orderBy("name")
    )


def company_by_slug(companies: DataFrame, slug: str) -> DataFrame:
    return companies.filter(F.col("slug") == slug)


def resolve_companies(companies: DataFrame, terms: list[str]) -> DataFrame:
    """One company per term: exact slug first, else a name containing the term in any case.

    The terms are the few of one request, so they are matched inside the scan, without a join.
    """
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = F.filter(
        wanted, lambda t: (F.col("slug") == t) | F.ilike(F.col("name"), F.concat(F.lit("%"), t, F.lit("%")))
    )
    matched = companies.select("id", "name", "slug", F.explode(hits).alias("term"))
    rank = F.when(F.col("slug") == F.col("term"), 0).otherwise(1)
    return first_per_key(matched.withColumn("rank", rank), ["term"], ["rank", "name", "id"]).drop("rank")


def company_periods(periods: DataFrame, company: DataFrame) -> DataFrame:
    """Periods of the given companies in time order."""
    owner = company.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return (
        periods.join(owner, "company_id")
        .withColumn("period", period_label(F.col("quarter"), F.col("year")))
        .orderBy("company_id", "year", "quarter")
    )


def child_counts(
    periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame
) -> DataFrame:
    """Tables, sections and charts per period, zero where there are none.

    Each child is counted before the join, so nothing fans out.
    """

    def counted(child: DataFrame, name: str) -> DataFrame:
        return child.groupBy(F.col("period_id").alias("id")).agg(F.count("*").alias(name))

    out = periods
    for child, name in ((tables, "tables"), (sections, "sections"), (charts, "charts")):
        out = out.join(counted(child, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def periods_with_counts(
    periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame
) -> DataFrame:
    counted = child_counts(periods, tables, sections, charts)
    return counted.select(
        "id",
        "company_id",
        period_label(F.col("quarter"), F.col("year")).alias("period"),
        "quarter",
        "year",
        "tables",
        "sections",
        "charts",
        F.col("extraction_meta").isNotNull().alias("has_meta"),
    ).orderBy("company_id", "year", "quarter")


def latest_periods(periods: DataFrame) -> DataFrame:
    """Newest period of every company."""
    return first_per_key(periods, ["company_id"], [-F.col("year"), -F.col("quarter"), "id"])


def pick_periods(periods: DataFrame, label: str | None = None) -> DataFrame:
    """The labelled period of every company, or its newest one without a label.

    A label that is not ``Qn YYYY`` picks nothing.
    """
    if label is None:
        return latest_periods(periods)
    wanted = F.lit(label)
    return periods.filter((F.col("quarter") == label_quarter(wanted)) & (F.col("year") == label_year(wanted)))


def period_row(periods: DataFrame, company_id: object, quarter: int, year: int) -> DataFrame:
    return periods.filter(
        (F.col("company_id") == F.lit(company_id)) & (F.col("quarter") == quarter) & (F.col("year") == year)
    )


_FILE_KEY = ["company_id", "quarter", "year", "pdf_hash"]


def already_stored(incoming: DataFrame, periods: DataFrame) -> DataFrame:
    """Incoming files whose period is stored with the same content hash: a cache hit."""
    return incoming.join(periods.select(*_FILE_KEY), _FILE_KEY, "left_semi")


def not_yet_stored(incoming: DataFrame, periods: DataFrame) -> DataFrame:
    return incoming.join(periods.select(*_FILE_KEY), _FILE_KEY, "left_anti")


def _page_order() -> list[Column]:
    return [F.col("page_number").asc_nulls_last(), F.col("id").asc()]


def statement_tables(tables: DataFrame, statement_type: str | None = None) -> DataFrame:
    """Report tables of the wanted type; a missing type reads as ``other``."""
    wanted = tables if statement_type is None else tables.filter(F.col("table_type") == statement_type)
    return wanted.withColumn("table_type", F.coalesce("table_type", F.lit("other")))


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows of report tables, one per output row, with their place in the table."""
    flat = tables.select(
        "period_id",
        F.col("id").alias("table_id"),
        "table_type",
        "title",
        "page_number",
        "columns",
        F.posexplode("rows").alias("row_no", "row"),
    )
    return flat.select(
        "period_id",
        "table_id",
        "table_type",
        "title",
        "page_number",
        "columns",
        "row_no",
        F.col("row.label").alias("label"),
        F.col("row.label_en").alias("label_en"),
        F.col("row.type").alias("row_type"),
        F.col("row.values").alias("values"),
    )


def statements(
    picked: DataFrame, tables: DataFrame, financial: DataFrame, statement_type: str | None = None
) -> DataFrame:
    """Statement rows of the picked periods.

    Report tables come first; a period with no table left after the type filter falls back to its
    legacy rows under the legacy statement name.
    """
    keys = picked.select(F.col("id").alias("period_id"))
    modern = statement_tables(tables, statement_type).join(keys, "period_id", "left_semi")
    legacy = financial.join(keys, "period_id", "left_semi")
    if statement_type is not None:
        legacy = legacy.filter(F.col("statement_type") == LEGACY_STATEMENT.get(statement_type, statement_type))
    legacy = legacy.join(modern.select("period_id").distinct(), "period_id", "left_anti")
    new_rows = table_rows(modern).select(
        "period_id",
        F.lit("table").alias("source"),
        "table_type",
        "table_id",
        "title",
        "page_number",
        F.col("row_no").alias("row_order"),
        "label",
        "label_en",
        "row_type",
        "values",
    )
    old_rows = legacy.select(
        "period_id",
        F.lit("legacy").alias("source"),
        F.col("statement_type").alias("table_type"),
        F.lit(None).cast(tables.schema["id"].dataType).alias("table_id"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("page_number"),
        "row_order",
        F.col("row_name").alias("label"),
        F.lit(None).cast("string").alias("label_en"),
        "row_type",
        F.array(F.col("value").cast("string")).alias("values"),
    )
    return new_rows.unionByName(old_rows)


def kpi_tables(picked: DataFrame, tables: DataFrame) -> DataFrame:
    """KPI tables of the picked periods; no legacy fall-back."""
    keys = picked.select(F.col("id").alias("period_id"))
    return tables.filter(F.col("table_type") == "kpi").join(keys, "period_id", "left_semi").orderBy(*_page_order())


def text_sections(
    picked: DataFrame, sections: DataFrame, section_type: str | None = None, limit: int = 2000
) -> DataFrame:
    """Sections of the picked periods with their content cut for display."""
    keys = picked.select(F.col("id").alias("period_id"), "company_id", "quarter", "year")
    wanted = sections if section_type is None else sections.filter(F.col("section_type") == section_type)
    return wanted.join(keys, "period_id").select(
        "period_id",
        period_label(F.col("quarter"), F.col("year")).alias("period"),
        "id",
        "title",
        "section_type",
        "page_number",
        cut(F.col("content"), limit).alias("content"),
    )


def chart_points(picked: DataFrame, charts: DataFrame) -> DataFrame:
    """Charts of the picked periods, one row per data point; charts without points stay."""
    keys = picked.select(F.col("id").alias("period_id"))
    flat = charts.join(keys, "period_id", "left_semi").select(
        "period_id", "id", "title", "page_number", "chart_type", "x_axis", "y_axis", "estimated", "image_path",
        F.posexplode_outer("data_points").alias("point_no", "point"),
    )
    return flat.select("*", "point.label", "point.value", "point.segment").drop("point")


def period_components(
    companies: DataFrame,
    periods: DataFrame,
    tables: DataFrame,
    sections: DataFrame,
    charts: DataFrame,
    financial: DataFrame,
) -> DataFrame:
    """Whole periods as component rows, so a large period is never gathered in one cell.

    Tables, sections and charts where a period has any table or section, else its legacy rows.
    ``body`` holds the nested content as JSON; order by (period_id, component, page, item_id).
    """
    head = periods.join(
        companies.select(F.col("id").alias("company_id"), F.col("name").alias("bolag")), "company_id", "left"
    ).select(
        F.col("id").alias("period_id"),
        F.coalesce("bolag", F.lit("Okänt")).alias("bolag"),
        period_label(F.col("quarter"), F.col("year")).alias("period"),
        "year",
        "quarter",
        "valuta",
        F.col("language").alias("sprak"),
        F.coalesce("source_file", F.lit("")).alias("source_file"),
    )
    modern = tables.select("period_id").unionByName(sections.select("period_id")).distinct()

    def part(df: DataFrame, name: Column, kind: str, order: Column, title: Column, *body: Column) -> DataFrame:
        return df.select(
            "period_id",
            name.alias("component"),
            order.cast("int").alias("page"),
            F.col("id").cast("string").alias("item_id"),
            title.alias("title"),
            F.col(kind).alias("type"),
            F.to_json(F.struct(*body)).alias("body"),
        )

    page = F.col("page_number")
    pieces = [
        part(tables, F.lit("table"), "table_type", page, F.col("title"), F.col("columns"), F.col("rows")),
        part(sections, F.lit("section"), "section_type", page, F.col("title"), F.col("content")),
        part(charts, F.lit("chart"), "chart_type", page, F.col("title"), F.col("x_axis"), F.col("y_axis"),
             F.col("estimated"), F.col("data_points")).join(modern, "period_id", "left_semi"),
        part(financial, F.col("statement_type"), "row_type", F.col("row_order"), F.col("row_name"), F.col("value"))
        .filter(F.col("component").isin(list(LEGACY_STATEMENT.values()))).join(modern, "period_id", "left_anti"),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return head.join(out, "period_id", "left")


def filter_periods(periods: DataFrame, labels: list[str], loose: bool = False) -> DataFrame:
    """Periods with one of the labels; loose matching ignores case and blanks."""
    label = period_label(F.col("quarter"), F.col("year"))
    if not loose:
        return periods.filter(label.isin(labels))
    return periods.filter(loose_label(label).isin([x.upper().replace(" ", "") for x in labels]))


def sort_by_period(df: DataFrame, label: str = "period") -> DataFrame:
    """Time order by label; labels that are no period come first."""
    zero = F.lit(0)
    return df.orderBy(
        F.coalesce(label_year(F.col(label)), zero), F.coalesce(label_quarter(F.col(label)), zero), label
    )


def period_span(periods: DataFrame, companies: DataFrame) -> DataFrame:
    """First and last period of each company in short form, as in an export name."""
    key = F.struct("year", "quarter")
    label = period_label(F.col("quarter"), F.col("year"))
    ends = periods.groupBy("company_id").agg(
        F.min_by(label, key).alias("first_period"), F.max_by(label, key).alias("last_period")
    )
    names = companies.select(F.col("id").alias("company_id"), "name")

    def short(c: str) -> Column:
        return F.regexp_replace(c, r"([0-9]{2})([0-9]{2})$", "$2")

    return ends.join(names, "company_id").select(
        "company_id",
        "first_period",
        "last_period",
        F.concat("name", F.lit(" "), short("first_period"), F.lit(" - "), short("last_period")).alias("export_name"),
    )
