"""Comparisons, set differences and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.labels import row_key, seed_canonical
from reportloom.functions.numbers import loose_number
from reportloom.functions.periods import period_label
from reportloom.functions.scale import first_per_key, ranked
from reportloom.functions.text import strip


def canonical_labels(rows: DataFrame, synonyms: DataFrame | None = None, label: str = "label_en") -> DataFrame:
    """Rows with ``canonical``: the stored synonym, else the built-in one, else the label itself.

    No broadcast hint: Catalyst broadcasts the synonym table while its size is under the threshold.
    """
    low = strip(F.lower(F.coalesce(label, F.lit(""))))
    if synonyms is None:
        return rows.withColumn("canonical", seed_canonical(F.coalesce(F.col(label), F.lit(""))))
    stored = synonyms.select(F.col("synonym").alias("_label"), F.col("canonical").alias("_stored"))
    return (
        rows.withColumn("_label", low)
        .join(stored, "_label", "left")
        .withColumn("canonical", F.coalesce("_stored", seed_canonical(F.col("_label"))))
        .drop("_label", "_stored")
    )


def first_value(values: str | Column) -> Column:
    """First non-null cell as a number."""
    return loose_number(F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)))


_ROW_ORDER = ["page_number", "table_id", "row_no"]


def _first_rows(rows: DataFrame) -> DataFrame:
    usable = rows.filter(F.col("canonical") != "").select(
        "period_id", "canonical", *_ROW_ORDER, "label", "label_en", "values"
    )
    return first_per_key(usable, ["period_id", "canonical"], _ROW_ORDER)


def _sides(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, period_1, period_2) as one row per side."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(f"period_{n}").alias("period_id")) for n in (1, 2)
    ])).alias("s")
    return pairs.select("pair_id", sides).select("pair_id", "s.*")


def _beside(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows of both sides of each pair next to each other as structs ``r1`` and ``r2``.

    ``rows`` has one row per period and key. One join and one aggregate: the rows are read once for both sides.
    """
    row = F.struct(*[c for c in rows.columns if c not in ("period_id", key)])
    return _sides(pairs).join(rows, "period_id").groupBy("pair_id", key).agg(
        *[F.max(F.when(F.col("side") == n, row)).alias(f"r{n}") for n in (1, 2)]
    )


def compare_companies(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched rows of every pair (pair_id, period_1, period_2).

    ``rows`` are table rows with ``canonical``. Only the first row per label counts on either side.
    """
    firsts = _first_rows(rows).select("period_id", "canonical", "label", "label_en", first_value("values").alias("value"))
    both = _beside(firsts, pairs, "canonical").filter("r1 IS NOT NULL AND r2 IS NOT NULL")
    v1, v2 = F.col("r1.value"), F.col("r2.value")
    return both.select(
        "pair_id",
        "canonical",
        F.col("r1.label_en").alias("label_en"),
        F.when(F.col("canonical") != strip(F.lower("r1.label_en")), F.col("canonical")).alias("matched_via"),
        F.col("r1.label").alias("label_1"),
        v1.alias("value_1"),
        F.col("r2.label").alias("label_2"),
        v2.alias("value_2"),
        F.round(v1 - v2, 2).alias("difference"),
        F.when(v2 != 0, F.round(F.try_divide(v1, v2), 2)).alias("ratio"),
    )


def unmatched_rows(rows: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of side 1 of each pair that found no partner, repeats of a label included; with ``limit`` the first of them.

    Without a limit the places are numbered over ranges, not in a task for each pair, which runs a job.
    """
    firsts = _first_rows(rows).select("period_id", "canonical", *[F.col(c).alias(f"f_{c}") for c in _ROW_ORDER])
    side1 = (
        rows.filter((F.col("canonical") != "") & (F.coalesce("label_en", F.lit("")) != ""))
        .select("period_id", "canonical", *_ROW_ORDER, "label_en")
        .join(firsts, ["period_id", "canonical"])
    )
    repeat = ~(
        F.col("page_number").eqNullSafe(F.col("f_page_number"))
        & F.col("table_id").eqNullSafe(F.col("f_table_id"))
        & (F.col("row_no") == F.col("f_row_no"))
    )
    other = firsts.select(F.col("period_id").alias("period_2"), "canonical", F.lit(True).alias("found"))
    candidates = (
        pairs.join(side1.withColumnRenamed("period_id", "period_1"), "period_1")
        .join(other, ["period_2", "canonical"], "left")
        .filter(repeat | F.col("found").isNull())
    )
    if limit is None:
        last = candidates.withColumn("_pageless", F.col("page_number").isNull())
        return ranked(last, ["pair_id"], ["_pageless", "page_number", "table_id", "row_no"], "place").select(
            "pair_id", F.col("place").cast("int").alias("place"), "label_en"
        )
    order = Window.partitionBy("pair_id").orderBy(F.col("page_number").asc_nulls_last(), "table_id", "row_no")
    placed = candidates.withColumn("place", F.row_number().over(order)).select("pair_id", "place", "label_en")
    return placed.filter(F.col("place") <= limit)


def compare_periods(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of every pair (pair_id, period_1, period_2) under each other, marked by ``side``."""
    return _sides(pairs).join(rows, "period_id")


def align_periods(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of every pair row by row, on the normalised row name (row: period_id, row_order, label, value)."""
    keyed = rows.withColumn("row_key", row_key(F.col("label"))).filter(F.col("row_key") != "")
    firsts = first_per_key(
        keyed.select("period_id", "row_key", "row_order", "label", "value"), ["period_id", "row_key"], ["row_order"]
    )
    both = _beside(firsts.select("period_id", "row_key", "label", "value"), pairs, "row_key")
    return both.select(
        "pair_id", "row_key", F.col("r1.label").alias("label_1"), F.col("r1.value").alias("value_1"),
        F.col("r2.label").alias("label_2"), F.col("r2.value").alias("value_2"),
    )


def missing_items(expected: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Expected items that were not extracted."""
    return expected.join(extracted.select(*keys), keys, "left_anti")


def retry_items(expected: DataFrame, extracted: DataFrame, findings: DataFrame) -> DataFrame:
    """Tables to extract again: the missing ones, and those with error findings, with the issue text."""
    lost = missing_items(expected, extracted, ["report", "id"]).select(
        "report", "id", "title", "type", "page", F.lit("SAKNAS - extrahera från PDF").alias("issue")
    )
    errors = (
        findings.filter(F.col("severity") == "error")
        .join(extracted.select("report", F.col("id").alias("item_id")), ["report", "item_id"], "left_semi")
        .groupBy("report", F.col("item_id").alias("id"))
        .agg(F.sort_array(F.collect_set("message")).alias("messages"))
    )
    wrong = extracted.join(errors, ["report", "id"]).select(
        "report", "id", "title", "type", "page",
        F.concat(F.lit("FEL: "), F.array_join("messages", "; ")).alias("issue"),
    )
    return lost.unionByName(wrong)


def retry_pages(items: DataFrame, reports: DataFrame) -> DataFrame:
    """Pages a retry needs: each table's page and its neighbours, inside the document (report, pages)."""
    near = items.filter(F.col("page") >= 1).select(
        "report", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")
    )
    return (
        near.distinct().join(reports.select("report", "pages"), "report")
        .filter(F.col("page").between(1, F.col("pages"))).select("report", "page")
    )


def retry_scope(items: DataFrame, reports: DataFrame) -> DataFrame:
    """Per report: pages needed, and whether they are few enough (under half) to send only them."""
    needed = retry_pages(items, reports).groupBy("report").agg(F.count("*").alias("needed"))
    retried = items.groupBy("report").agg(F.count("*").alias("tables_to_fix"))
    count = F.coalesce("needed", F.lit(0))
    return (
        reports.join(retried, "report").join(needed, "report", "left")
        .select("report", "pages", "tables_to_fix", count.alias("needed"),
                ((count > 0) & (count < F.col("pages") * 0.5)).alias("partial"))
    )


def apply_retry(current: DataFrame, fixed: DataFrame) -> DataFrame:
    """Current tables with the retried ones replaced by id, new ones added."""
    return current.join(fixed.select("report", "id"), ["report", "id"], "left_anti").unionByName(
        fixed, allowMissingColumns=True
    )


def reconcile_files(inventory: DataFrame, periods: DataFrame) -> DataFrame:
    """Action per file, by folder and by whether its content hash is stored."""
    stored = periods.filter(F.coalesce("pdf_hash", F.lit("")) != "").select(
        F.col("pdf_hash").alias("md5_12"), F.lit(True).alias("stored")
    ).distinct()
    waiting, known = F.col("folder") == "skall_extractas", F.col("stored").isNotNull()
    action = (
        F.when(waiting & known, "moved_to_db").when(waiting, "not_in_db")
        .when((F.col("folder") == "ligger_i_databasen") & known, "already_correct")
        .when(F.col("folder") == "ligger_i_databasen", "moved_to_extract")
    )
    return inventory.join(stored, "md5_12", "left").withColumn("action", action).drop("stored").filter("action is not null")


def reconcile_counts(inventory: DataFrame, periods: DataFrame) -> DataFrame:
    return reconcile_files(inventory, periods).groupBy("action").agg(F.count("*").alias("files"))


def open_errors(errors: DataFrame, periods: DataFrame) -> DataFrame:
    """Unresolved errors with the label of their period."""
    labels = periods.select(
        F.col("id").alias("period_id"), "company_id", period_label(F.col("quarter"), F.col("year")).alias("label")
    )
    return errors.filter(~F.col("resolved")).join(labels, "period_id", "left").select(
        "company_id", F.coalesce("label", F.lit("Okänd")).alias("period"), "id", "error_type", "severity",
        "component", "details",
    )


def with_period_and_company(hits: DataFrame, periods: DataFrame, companies: DataFrame) -> DataFrame:
    """Hits (with ``period_id``) plus company name, period label and source file."""
    where = periods.join(
        companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "slug"), "company_id"
    ).select(
        F.col("id").alias("period_id"), "company_id", "company", "slug",
        period_label(F.col("quarter"), F.col("year")).alias("period"), "source_file",
    )
    return hits.join(where, "period_id")


def one_shape(parts: list[DataFrame]) -> DataFrame:
    """Rows of several producers under one set of columns; what a producer lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def remaining_inputs(inputs: DataFrame, completed: DataFrame) -> DataFrame:
    """Inputs (batch_id, path) that are not completed."""
    return inputs.join(completed.select("batch_id", "path"), ["batch_id", "path"], "left_anti")
