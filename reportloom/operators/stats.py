"""Statistics over periods: counts, costs, coverage, consistency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.classify import severity_class
from reportloom.functions.periods import period_label
from reportloom.operators.lookup import child_counts
from reportloom.vocabulary import MODEL_PRICES, OCR_USD_PER_PAGE, OTHER_MODEL, SEK_PER_USD


def _sum0(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def global_stats(companies: DataFrame, periods: DataFrame) -> DataFrame:
    """Counts, sums and status counts per company; companies without periods stay with zeros.

    Periods are aggregated before the join: one shuffle of small partial sums.
    """
    status = F.col("extraction_status")
    per_company = periods.groupBy(F.col("company_id").alias("id")).agg(
        F.count("id").alias("reports_count"),
        F.sum("tables_count").alias("tables_total"),
        F.sum("sections_count").alias("sections_total"),
        F.sum("charts_count").alias("charts_total"),
        F.sum("embeddings_count").alias("embeddings_total"),
        F.sum("cost_sek").alias("cost_total"),
        F.sum("extraction_time_seconds").alias("time_total"),
        F.count_if(status == "success").alias("success_count"),
        F.count_if(status == "partial").alias("partial_count"),
        F.count_if(status == "failed").alias("failed_count"),
    )
    measures = [c for c in per_company.columns if c != "id"]
    return companies.join(per_company, "id", "left").select(
        F.col("id").alias("company_id"),
        F.col("name").alias("company_name"),
        F.col("slug").alias("company_slug"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in measures],
    )


def grand_totals(per_company: DataFrame) -> DataFrame:
    """Totals over all companies, cost rounded to two decimals."""
    return per_company.agg(
        F.count("*").alias("total_companies"),
        _sum0("reports_count").alias("total_reports"),
        _sum0("tables_total").alias("total_tables"),
        _sum0("sections_total").alias("total_sections"),
        _sum0("charts_total").alias("total_charts"),
        F.round(_sum0("cost_total"), 2).alias("total_cost_sek"),
    )


def company_stats(periods: DataFrame, company_id: object) -> DataFrame:
    """Per-period statistics of one company, newest first."""
    return (
        periods.filter(F.col("company_id") == F.lit(company_id))
        .select(
            F.col("id").alias("period_id"), "quarter", "year", "extraction_status", "tables_count", "sections_count",
            "charts_count", "embeddings_count", "cost_sek", "extraction_time_seconds", "error_count", "warning_count",
        )
        .orderBy(F.col("year").desc(), F.col("quarter").desc())
    )


def company_rollup(companies: DataFrame, periods: DataFrame, errors: DataFrame) -> DataFrame:
    """Company totals with time, cost, vectors and the number of open errors."""
    totals = periods.groupBy("company_id").agg(
        F.count("*").alias("total_reports"),
        _sum0("tables_count").alias("total_tables"),
        _sum0("sections_count").alias("total_sections"),
        _sum0("charts_count").alias("total_charts"),
        _sum0("embeddings_count").alias("total_embeddings"),
        F.round(_sum0("cost_sek"), 2).alias("total_cost_sek"),
        F.round(_sum0("extraction_time_seconds"), 2).alias("total_time_seconds"),
    )
    owner = periods.select(F.col("id").alias("period_id"), "company_id")
    open_count = (
        errors.filter(~F.col("resolved")).groupBy("period_id").agg(F.count("*").alias("n"))
        .join(owner, "period_id").groupBy("company_id").agg(F.sum("n").alias("open_errors"))
    )
    measures = [c for c in totals.columns if c != "company_id"] + ["open_errors"]
    return (
        companies.select(F.col("id").alias("company_id"), "name", "slug")
        .join(totals, "company_id", "left").join(open_count, "company_id", "left")
        .select("company_id", "name", "slug", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in measures])
    )


def company_child_counts(
    periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame
) -> DataFrame:
    counted = child_counts(periods, tables, sections, charts)
    return counted.groupBy("company_id").agg(
        *[F.sum(c).alias(c) for c in ("tables", "sections", "charts")]
    )


def embedding_coverage(periods: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with and without a vector per company, with a verdict."""
    per_period = sections.groupBy(F.col("period_id").alias("id")).agg(
        F.count("*").alias("n"), F.count("embedding").alias("v")
    )
    counts = periods.select("id", "company_id").join(per_period, "id", "left").groupBy("company_id").agg(
        _sum0("n").alias("sections_total"), _sum0("v").alias("sections_with_embedding")
    )
    total, have = F.col("sections_total"), F.col("sections_with_embedding")
    verdict = F.when(total == 0, "none").when(total == have, "complete").otherwise("missing")
    return counts.withColumn("missing", total - have).withColumn("verdict", verdict)


def found_and_extracted(counted: DataFrame) -> DataFrame:
    """Extracted against found per kind as ``X/Y``, or ``X/?`` where the found count is unknown.

    ``counted`` has tables, sections, charts and their found_* counts.
    """

    def shown(kind: str) -> Column:
        found = F.coalesce(F.col(f"found_{kind}").cast("string"), F.lit("?"))
        return F.concat(F.col(kind).cast("string"), F.lit("/"), found).alias(f"{kind}_status")

    return counted.select("*", *[shown(k) for k in ("tables", "sections", "charts")])


def with_found_counts(counted: DataFrame) -> DataFrame:
    """Adds the counts of the first pass kept in the extraction metadata."""
    first = F.col("extraction_meta.pass1_counts")
    return counted.select(
        "*", *[first.getField(k).alias(f"found_{k}") for k in ("tables", "sections", "charts")]
    )


def consistency_check(periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame) -> DataFrame:
    """Stored counters against counted children, per company and kind."""
    counted = child_counts(periods, tables, sections, charts)
    kinds = ("tables", "sections", "charts")
    sums = counted.groupBy("company_id").agg(
        *[_sum0(f"{k}_count").alias(f"logged_{k}") for k in kinds], *[_sum0(k).alias(f"stored_{k}") for k in kinds]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"logged_{k}").cast("bigint").alias("logged"),
                 F.col(f"stored_{k}").cast("bigint").alias("stored")) for k in kinds
    ])).alias("r")
    return sums.select("company_id", rows).select(
        "company_id", "r.*", F.col("r.logged").eqNullSafe(F.col("r.stored")).alias("ok")
    )


def all_problems(periods: DataFrame, companies: DataFrame) -> DataFrame:
    """Missing tables, table errors and section warnings of every report with their class."""
    name = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    base = periods.join(name, "company_id").select(
        F.col("id").alias("period_id"),
        F.concat(period_label(F.col("quarter"), F.col("year")), F.lit(" "), "company").alias("rapport"),
        "extraction_meta",
    )

    def known(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("?"))

    def rows(path: str, text: Column, kind: Column) -> DataFrame:
        return base.select("period_id", "rapport", F.explode(path).alias("e")).select(
            "period_id", "rapport", text.alias("beskrivning"), severity_class(kind).alias("bedomning")
        )

    lost = F.concat(
        F.lit("SAKNAD: '"), known(F.col("e.table_title")), F.lit("' (sida "), known(F.col("e.page")), F.lit(")")
    )
    wrong = F.concat(F.lit("FEL: '"), known(F.col("e.table_title")), F.lit("' - "), known(F.col("e.message")))
    warned = F.concat(
        F.lit("VARNING: Sektion '"), known(F.col("e.section_title")), F.lit("' - "), known(F.col("e.message"))
    )
    return (
        rows("extraction_meta.missing_tables", lost, F.lit("missing_table"))
        .unionByName(rows("extraction_meta.validation.tables.errors", wrong, F.coalesce("e.error_type", F.lit(""))))
        .unionByName(
            rows("extraction_meta.validation.sections.warnings", warned, F.coalesce("e.warning_type", F.lit("")))
        )
    )


def model_cost_sek(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost of a model call; a model without its own price costs as the larger one.

    Prices per token are exact decimals, so the sum is rounded only once.
    """

    def per_token(i: int) -> Column:
        def sek(usd: str) -> Column:
            return F.lit(Decimal(usd) * Decimal(SEK_PER_USD) / 1_000_000).cast("decimal(10,10)")

        out = sek(MODEL_PRICES[OTHER_MODEL][i])
        for name, pair in MODEL_PRICES.items():
            out = F.when(model == name, sek(pair[i])).otherwise(out)
        return out

    total = tokens_in.cast("decimal(18,0)") * per_token(0) + tokens_out.cast("decimal(18,0)") * per_token(1)
    return total.cast("decimal(28,6)")


def ocr_cost_usd(pages: Column) -> Column:
    return (pages.cast("decimal(18,0)") * F.lit(OCR_USD_PER_PAGE).cast("decimal(6,4)")).cast("decimal(28,6)")


def pass_totals(passes: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """Tokens, cost and time per report over its passes, a retry included (report, model, tokens, seconds)."""
    calls = passes.select(
        "report", "model", "input_tokens", "output_tokens", "elapsed_seconds", F.lit(0).alias("is_retry")
    )
    if retries is not None:
        calls = calls.unionByName(
            retries.select(
                "report", F.lit(OTHER_MODEL).alias("model"), "input_tokens", "output_tokens", "elapsed_seconds",
                F.lit(1).alias("is_retry"),
            )
        )
    cost = model_cost_sek(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return calls.groupBy("report").agg(
        F.count_if(F.col("is_retry") == 0).alias("passes"),
        F.sum("is_retry").alias("retries"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("elapsed_seconds").alias("total_elapsed_seconds"),
        F.sum(cost).alias("total_cost_sek"),
    )


def merge_passes(structure: DataFrame, tables: DataFrame, sections: DataFrame) -> DataFrame:
    """Three passes of a report in one row: metadata of the first, tables and charts of the second,
    sections of the third, costs added (each: report, model, input_tokens, output_tokens, data)."""

    def costed(df: DataFrame, n: int, *fields: tuple[str, str]) -> DataFrame:
        cost = model_cost_sek(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
        return df.select("report", cost.alias(f"cost_{n}"), *[F.col(f"data.{src}").alias(dst) for src, dst in fields])

    one = costed(structure, 1, ("metadata", "metadata"))
    two = costed(tables, 2, ("tables", "tables"), ("charts", "charts"))
    three = costed(sections, 3, ("sections", "sections"))
    return (
        one.join(two, "report").join(three, "report")
        .withColumn("total_cost_sek", F.col("cost_1") + F.col("cost_2") + F.col("cost_3"))
        .drop("cost_1", "cost_2", "cost_3")
    )


def final_status(reports: DataFrame, errors: DataFrame) -> DataFrame:
    """``partial`` for a report with table errors or failed vectors, else ``success`` (errors: report, component,
    severity)."""
    bad = (
        errors.filter((F.col("severity") == "error") & F.col("component").isin("tables", "embeddings"))
        .groupBy("report").agg(F.count("*").alias("bad"))
    )
    return reports.join(bad, "report", "left").select(
        *reports.columns, F.when(F.col("bad") > 0, "partial").otherwise("success").alias("final_status")
    )


def backfill_counters(
    periods: DataFrame, tables: DataFrame, sections: DataFrame, charts: DataFrame
) -> DataFrame:
    """Counters, cost and status of pending periods from their children and metadata; others unchanged."""
    vectors = sections.groupBy(F.col("period_id").alias("id")).agg(F.count("embedding").alias("_vectors"))
    counted = child_counts(periods, tables, sections, charts).join(vectors, "id", "left")
    meta = F.col("extraction_meta")
    checked = F.col("extraction_meta.validation.tables")
    errors = F.coalesce(checked.getField("error_count"), F.lit(0))
    status = (
        F.when(meta.isNull(), "success").when(checked.getField("is_valid") == F.lit(False), "partial")
        .when(errors > 0, "partial").otherwise("success")
    )
    fresh = {
        "tables_count": F.col("tables"),
        "sections_count": F.col("sections"),
        "charts_count": F.col("charts"),
        "embeddings_count": F.coalesce("_vectors", F.lit(0)),
        "cost_sek": F.coalesce(meta.getField("total_cost_sek"), F.lit(0)),
        "extraction_time_seconds": F.coalesce(meta.getField("total_elapsed_seconds"), F.lit(0)),
        "extraction_status": status,
        "error_count": errors,
        "warning_count": F.coalesce(checked.getField("warning_count"), F.lit(0)),
    }
    due = F.col("extraction_status").isNull() | (F.col("extraction_status") == "pending")
    out = []
    for field in periods.schema:
        old = F.col(field.name)
        out.append(
            F.when(due, fresh[field.name].cast(field.dataType)).otherwise(old).alias(field.name)
            if field.name in fresh else old
        )
    return counted.select(*out)


def apply_status_updates(periods: DataFrame, updates: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Periods with new status and counts; what an update leaves null is kept.

    ``updates``: id, status, embeddings_count, one row per period. ``errors`` (period_id, severity) gives
    the error and warning counts of the periods that have any.
    """
    new = updates.select("id", F.col("status").alias("_s"), F.col("embeddings_count").alias("_v"))
    out = periods.join(new, "id", "left")
    if errors is None:
        counts = None
    else:
        counts = errors.groupBy(F.col("period_id").alias("id")).agg(
            F.count_if(F.col("severity").isin("critical", "error")).alias("_e"),
            F.count_if(F.col("severity") == "warning").alias("_w"),
        )
        out = out.join(counts, "id", "left")
    replaced = {"extraction_status": "_s", "embeddings_count": "_v"}
    if counts is not None:
        replaced |= {"error_count": "_e", "warning_count": "_w"}
    return out.select(*[
        F.coalesce(F.col(replaced[c]), F.col(c)).alias(c) if c in replaced else F.col(c) for c in periods.columns
    ])


def company_summary(companies: DataFrame, periods: DataFrame) -> DataFrame:
    """Summary line per company and one for all of them (``company`` is null there)."""
    stats = global_stats(companies, periods)
    return stats.rollup(F.col("company_name").alias("company")).agg(
        F.sum("reports_count").alias("reports"),
        F.sum("tables_total").alias("tables"),
        F.sum("sections_total").alias("sections"),
        F.sum("charts_total").alias("charts"),
    )
