"""Databook and report outputs: one dataset per sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators.lookup import child_counts
from reportloom.operators.stats import found_and_extracted, with_found_counts
from reportloom.functions.periods import period_label


def write_databook(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write every sheet under ``path/sheet=<name>``, split by company."""
    for name, rows in sheets.items():
        writer = rows.write.mode("overwrite").partitionBy("company_id").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.save(f"{path}/sheet={name}")


def extraction_report(
    companies: DataFrame, periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame
) -> DataFrame:
    """Report line of every period: extracted against found, cost and time."""
    counted = found_and_extracted(with_found_counts(child_counts(periods, tables, sections, charts)))
    names = companies.select(F.col("id").alias("company_id"), "name")
    return counted.join(names, "company_id").select(
        "company_id", "name", period_label(F.col("quarter"), F.col("year")).alias("period"), "year", "quarter",
        "tables_status", "sections_status", "charts_status", "cost_sek", "extraction_time_seconds", "source_file",
    )
