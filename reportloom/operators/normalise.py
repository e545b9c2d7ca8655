"""Normalisation jobs over whole tables: labels, headers, types, cells, file names, text lines, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import naming
from reportloom.functions.classify import keyword_section_type, keyword_table_type, mapped_table_type
from reportloom.functions.labels import is_placeholder_label, row_class, row_key
from reportloom.functions.numbers import loose_number, parse_cell, reject_reason
from reportloom.functions.periods import find_period, header_year, is_period_header, label_quarter, label_year
from reportloom.functions.text import excerpt, line_kind, strip
from reportloom.operators.compare import canonical_labels


def normalise_labels(rows: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Exploded table rows plus row_key, row_class, label_ok and canonical."""
    return canonical_labels(rows, synonyms).select(
        "*",
        row_key(F.col("label")).alias("row_key"),
        row_class(F.col("row_type"), F.col("label")).alias("row_class"),
        (~is_placeholder_label(F.col("label"))).alias("label_ok"),
    )


def promote_headers(tables: DataFrame) -> DataFrame:
    """Tables whose first row holds the periods get them as headers.

    Needs at least min(3, half of the values plus one) period headers in the first row.
    """
    first = F.get("rows", F.lit(0))
    values = F.coalesce(first["values"], F.array().cast("array<string>"))
    hits = F.size(F.filter(values, is_period_header))
    wanted = F.least(F.lit(3), F.floor(F.size(values) / 2).cast("int") + 1)
    marked = tables.withColumn("promoted", (F.size(values) > 0) & (hits >= wanted))
    rest = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    new_columns = F.concat(F.array(F.coalesce(first["label"], F.lit(""))), values)
    return marked.withColumn(
        "_c", F.when(F.col("promoted"), new_columns).otherwise(F.col("columns"))
    ).withColumn("_r", F.when(F.col("promoted"), rest).otherwise(F.col("rows"))).select(
        *[F.col({"columns": "_c", "rows": "_r"}.get(c, c)).alias(c) for c in tables.columns], "promoted"
    )


def normalise_headers(tables: DataFrame) -> DataFrame:
    """Promoted tables, one row per header: its year, and its quarter and year if it is a period label."""
    flat = promote_headers(tables).select("period_id", "id", "promoted", F.posexplode("columns").alias("column_no", "header"))
    return flat.select(
        "*",
        header_year(F.col("header")).alias("header_year"),
        is_period_header(F.col("header")).alias("is_period"),
        label_quarter(F.col("header")).alias("quarter"),
        label_year(F.col("header")).alias("year"),
    )


def current_year(headers: DataFrame, fallback: int = 2025) -> DataFrame:
    """Newest year in the headers of each company."""
    return headers.groupBy("company_id").agg(
        F.coalesce(F.max(F.when(F.col("header_year") > 0, F.col("header_year"))), F.lit(fallback)).alias("current_year")
    )


def type_tables(tables: DataFrame) -> DataFrame:
    """Tables plus mapped_type (from the stored type) and keyword_type (from title, headers and labels)."""
    labels = F.transform("rows", lambda r: r["label"])
    return tables.select(
        "*",
        mapped_table_type(F.col("table_type"), F.col("title")).alias("mapped_type"),
        keyword_table_type(F.col("title"), F.col("columns"), labels).alias("keyword_type"),
    )


def type_sections(sections: DataFrame) -> DataFrame:
    return sections.withColumn("keyword_type", keyword_section_type(F.col("title"), F.col("content")))


def _with_label_slot(values: str, columns: str) -> Column:
    """Values with a leading null where the producer left out the label slot."""
    short = F.size(values) == F.size(columns) - 1
    return F.when(short, F.concat(F.array(F.lit(None).cast("string")), F.col(values))).otherwise(F.col(values))


def parse_cells(rows: DataFrame) -> DataFrame:
    """Data cells of table rows as decimals by the report's language, with the reason where there is none.

    ``rows`` are exploded table rows plus ``language``.
    """
    slotted = rows.withColumn("values", _with_label_slot("values", "columns"))
    flat = slotted.select(
        "period_id", "table_id", "row_no", "label", "language", "columns", F.posexplode("values").alias("column_no", "cell")
    ).filter(F.col("column_no") > 0)
    return flat.select(
        "period_id", "table_id", "row_no", "label", "column_no",
        F.get("columns", F.col("column_no")).alias("header"),
        "cell",
        parse_cell(F.col("cell"), F.col("language")).alias("value"),
        loose_number(F.col("cell")).alias("loose_value"),
        reject_reason(F.col("cell"), F.col("language")).alias("reject_reason"),
    )


def named_files(files: DataFrame) -> DataFrame:
    """Company, period, language and canonical name of each report file (folder, name, text of the first pages).

    ``settled``: keep (already canonical) or failed (no name found); null where the file is to be renamed.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    facts = F.struct(
        naming.is_canonical_file(F.col("name")).alias("canonical"),
        naming.company_name(F.col("text"), stem).alias("company"),
        find_period(F.col("text"), stem).alias("p"),
        naming.language(F.col("text")).alias("language"),
    )
    # Generated, so that later filters do not repeat the searches.
    found = files.select("folder", "name", F.explode(F.array(facts)).alias("f")).select("folder", "name", "f.*")
    named = found.select(
        "folder", "name", "canonical", "company", "p.quarter", "p.year", "language",
        naming.report_file_name(F.col("company"), F.col("p.year"), F.col("p.quarter"), F.col("language")).alias("new_name"),
    )
    settled = F.when(F.col("canonical"), "keep").when(F.col("new_name").isNull(), "failed").when(
        F.col("new_name") == F.col("name"), "keep"
    )
    return named.withColumn("settled", settled)


def file_plan(files: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Rename plan for report files (folder, name, text of the first pages).

    Action: keep (already canonical), rename, collision (the new name is taken or wanted twice), or failed. ``others``
    (folder, name) are further names that are taken.
    """
    named = named_files(files)
    # Counts by aggregation, not by a window: a folder or name with very many files is reduced on the map side.
    moving = named.filter(~F.col("canonical") & F.col("new_name").isNotNull())
    wanted = moving.groupBy("folder", "new_name").agg(F.count("*").alias("_wanted"))
    names = files.select("folder", "name")
    names = names if others is None else names.union(others.select("folder", "name"))
    taken = names.select("folder", F.col("name").alias("new_name"), F.lit(True).alias("_taken")).distinct()
    action = F.coalesce(
        "settled", F.when((F.col("_wanted") > 1) | F.col("_taken").isNotNull(), "collision").otherwise("rename")
    )
    return (
        named.join(wanted, ["folder", "new_name"], "left").join(taken, ["folder", "new_name"], "left")
        .withColumn("action", action).drop("_wanted", "_taken", "settled")
    )


def text_lines(sections: DataFrame) -> DataFrame:
    """Non-empty lines of section contents with their kind."""
    flat = sections.select("id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    return (
        flat.withColumn("line", strip(F.col("raw"))).filter(F.col("line") != "")
        .select("id", "line_no", "line", line_kind(F.col("line")).alias("kind"))
    )


def excerpts(hits: DataFrame, query: str) -> DataFrame:
    """Hits with the excerpt around the query."""
    return hits.withColumn("excerpt", excerpt(F.col("content"), F.lit(query)))
