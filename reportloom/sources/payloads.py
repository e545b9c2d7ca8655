"""Report payloads: lenient parsing, and their rows in the model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.naming import slug
from reportloom.functions.periods import label_quarter, label_year
from reportloom.functions.scale import first_per_key
from reportloom.functions.text import let, strip
from reportloom.schemas import PAYLOAD
from reportloom.vocabulary import LEGACY_STATEMENT


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _body(raw: Column) -> Column:
    """From the first to the last brace, fences taken off."""
    text = strip(raw)
    opened = F.regexp_replace(text, r"(?s)^```[^\n]*\n", "")
    closed = F.regexp_extract(opened, r"(?s)^(.*)\n[ \t]*```[ \t]*(?:\n.*)?$", 1)
    inner = F.when(text.startswith("```"), F.when(closed != "", closed).otherwise(opened)).otherwise(text)
    return F.regexp_extract(inner, r"(?s)\{.*\}", 0)


def _without_trailing_commas(body: Column) -> Column:
    return F.regexp_replace(body, r",(\s*[}\]])", "$1")


def _closed_after_cut_string(text: Column) -> Column:
    """A text that ends inside a string: cut after the last closed part before it, then brackets closed."""
    head = F.regexp_extract(text, r'(?s)^(.*)"[^"]*$', 1)

    def closed(cut: Column) -> Column:
        def closers(opening: str, closing: str) -> Column:
            return F.repeat(F.lit(closing), F.greatest(_count(cut, opening) - _count(cut, closing), F.lit(0)))

        whole = F.concat(cut, closers("[", "]"), closers("{", "}"))
        return F.when((_count(text, '"') % 2 == 1) & (cut != ""), whole).otherwise(text)

    return let(F.regexp_extract(head, r"(?s)^.*[}\]]", 0), closed)


def _last_balanced(body: Column) -> Column:
    """The longest leading part whose braces balance outside strings; empty if there is none."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("last"),
        F.lit(False).alias("quoted"), F.lit(False).alias("escaped"),
    )

    def step(s: Column, c: Column) -> Column:
        plain = ~s["escaped"] & ~s["quoted"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        pos = s["pos"] + 1
        return F.struct(
            depth.alias("depth"),
            pos.alias("pos"),
            F.when(plain & (c == "}") & (depth == 0), pos).otherwise(s["last"]).alias("last"),
            F.when(~s["escaped"] & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (~s["escaped"] & (c == "\\")).alias("escaped"),
        )

    last = F.aggregate(F.split(body, ""), start, step, lambda s: s["last"])
    return F.substring(body, F.lit(1), last)


def _is_object(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else; in a list, trailing text does not go unnoticed."""
    return let(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))),
        lambda v: (text != "") & v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(),
    )


def _readable(body: Column) -> Column:
    """Readable text and the repair it needed, null if there is none. A repair runs only if the one before failed."""

    def taken(text: Column, repair: str, otherwise: Column | None = None) -> Column:
        good = F.when(_is_object(text), F.struct(text.alias("text"), F.lit(repair).alias("repair")))
        return good if otherwise is None else good.otherwise(otherwise)

    balanced = let(_last_balanced(body), lambda text: taken(text, "balanced"))

    def from_commas(fixed: Column) -> Column:
        closed = let(_closed_after_cut_string(fixed), lambda text: taken(text, "closed", balanced))
        return taken(fixed, "commas", closed)

    return taken(body, "none", let(_without_trailing_commas(body), from_commas))


def parse_payloads(raw: DataFrame, schema: str = PAYLOAD) -> DataFrame:
    """Payload texts (raw) parsed leniently: as they are, without trailing commas, closed, cut to balance.

    Adds ``payload`` and ``repair``; both are null where nothing helps. The result is generated, so a filter on
    it stays above and the text is parsed once.
    """

    def read(t: Column) -> Column:
        return F.struct(F.from_json(t["text"], schema).alias("payload"), t["repair"].alias("repair"))

    return raw.select("*", F.explode(F.array(let(let(_body(F.col("raw")), _readable), read))).alias("_p")).select(
        *raw.columns, "_p.payload", "_p.repair"
    )


def rejected_payloads(parsed: DataFrame) -> DataFrame:
    """Payloads that hold no readable object, no period, or no company name."""
    reason = F.when(F.col("repair").isNull(), "no readable JSON object").when(
        label_quarter(F.col("payload.metadata.period")).isNull(), "no period"
    ).when(F.coalesce(slug(F.col("payload.metadata.bolag")), F.lit("")) == "", "no company")
    return parsed.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("payload")


def new_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies (name) that are not stored yet, one per slug."""
    incoming = names.withColumn("slug", slug(F.col("name"))).filter(F.coalesce("slug", F.lit("")) != "")
    one = incoming.groupBy("slug").agg(F.min("name").alias("name"))
    return one.join(companies.select("slug"), "slug", "left_anti").select(
        F.sha2("slug", 256).alias("id"), "name", "slug", F.current_timestamp().alias("created_at")
    )


def period_rows(parsed: DataFrame, companies: DataFrame) -> DataFrame:
    """Readable payloads as period rows with their counts; of two for one period the later (seq) wins.

    ``parsed`` has seq and pdf_hash besides the parsed columns. Of equal seq, the smaller pdf_hash wins, then the
    smaller digest of the text, of equal rows any one. Only these keys are compared; the winner fetches its payload by a
    join on them, so payloads are never in the buffer of an aggregate. The payload stays on the row for the child tables.
    A company that is not in ``companies`` gives no row: add ``new_companies`` first, as ``store.ingest`` does.
    """
    head = parsed.filter(F.col("repair").isNotNull()).select(
        "seq", "pdf_hash", "payload", F.sha2("raw", 256).alias("raw_hash"),
        slug(F.col("payload.metadata.bolag")).alias("slug"),
        label_quarter(F.col("payload.metadata.period")).alias("quarter"),
        label_year(F.col("payload.metadata.period")).alias("year"),
    ).filter(F.col("quarter").isNotNull())
    owned = head.join(companies.select(F.col("id").alias("company_id"), "slug"), "slug")
    keyed = owned.withColumn("id", F.sha2(F.concat_ws("|", "company_id", "year", "quarter"), 256))
    first = first_per_key(keyed.select("id", "seq", "pdf_hash", "raw_hash"), ["id"], [-F.col("seq"), "pdf_hash", "raw_hash"])
    wins = keyed["id"].eqNullSafe(F.col("_id")) & (keyed["raw_hash"] == F.col("_raw"))
    for column, won in (("seq", "_seq"), ("pdf_hash", "_pdf")):
        wins &= keyed[column].eqNullSafe(F.col(won))
    fetched = keyed.join(
        first.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"), F.col("pdf_hash").alias("_pdf"), F.col("raw_hash").alias("_raw")), wins
    )
    alike = Window.partitionBy("id", "seq", "pdf_hash", "raw_hash").orderBy(F.lit(0))
    newest = fetched.withColumn("_copy", F.row_number().over(alike)).filter("_copy = 1")
    meta = F.col("payload._pipeline_info")

    def size(kind: str) -> Column:
        return F.coalesce(F.size(F.col(f"payload.{kind}")), F.lit(0))

    return newest.select(
        "id", "company_id", "quarter", "year",
        F.col("payload.metadata.valuta").alias("valuta"),
        F.coalesce("payload.metadata.sprak", F.lit("sv")).alias("language"),
        "pdf_hash",
        F.col("payload._source_file").alias("source_file"),
        meta.alias("extraction_meta"),
        F.lit("extracting").alias("extraction_status"),
        F.greatest(size("tables"), F.lit(0)).alias("tables_count"),
        F.greatest(size("sections"), F.lit(0)).alias("sections_count"),
        F.greatest(size("charts"), F.lit(0)).alias("charts_count"),
        F.lit(0).alias("embeddings_count"),
        F.coalesce(meta["total_cost_sek"], F.lit(0)).cast("decimal(10,4)").alias("cost_sek"),
        F.coalesce(meta["total_elapsed_seconds"], F.lit(0)).cast("decimal(10,2)").alias("extraction_time_seconds"),
        F.lit(0).alias("error_count"),
        F.lit(0).alias("warning_count"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
        "payload",
    )


def _items(periods: DataFrame, kind: str) -> DataFrame:
    flat = periods.select(F.col("id").alias("period_id"), F.posexplode(f"payload.{kind}").alias("pos", "item"))
    return flat.withColumn("id", F.sha2(F.concat_ws("|", "period_id", F.lit(kind), "pos"), 256))


def section_rows(periods: DataFrame) -> DataFrame:
    return _items(periods, "sections").select(
        "id", "period_id", F.coalesce("item.title", F.lit("")).alias("title"), F.col("item.page").alias("page_number"),
        F.col("item.type").alias("section_type"), F.coalesce("item.content", F.lit("")).alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def report_table_rows(periods: DataFrame) -> DataFrame:
    items = _items(periods, "tables")
    rows_type = items.schema["item"].dataType["rows"].dataType
    return items.select(
        "id", "period_id", F.col("item.id").alias("table_key"), F.col("item.entity").alias("entity"),
        F.coalesce("item.title", F.lit("")).alias("title"), F.col("item.page").alias("page_number"),
        F.col("item.type").alias("table_type"),
        F.coalesce("item.columns", F.array().cast("array<string>")).alias("columns"),
        F.coalesce("item.rows", F.array().cast(rows_type)).alias("rows"),
    )


def chart_table_rows(periods: DataFrame) -> DataFrame:
    items = _items(periods, "charts")
    points_type = items.schema["item"].dataType["data_points"].dataType
    return items.select(
        "id", "period_id", F.coalesce("item.title", F.lit("")).alias("title"), F.col("item.page").alias("page_number"),
        "item.chart_type", "item.x_axis", "item.y_axis", F.coalesce("item.estimated", F.lit(True)).alias("estimated"),
        F.coalesce("item.data_points", F.array().cast(points_type)).alias("data_points"), "item.image_path",
    )


def financial_rows(periods: DataFrame) -> DataFrame:
    """Legacy statement rows of all three statements."""
    out = None
    for statement in LEGACY_STATEMENT.values():
        part = _items(periods, statement).select(
            "id", "period_id", F.lit(statement).alias("statement_type"), F.col("pos").alias("row_order"),
            F.coalesce(F.when(F.col("item.rad") != "", F.col("item.rad")), "item.namn", F.lit("")).alias("row_name"),
            F.col("item.varde").alias("value"), F.col("item.typ").alias("row_type"),
        )
        out = part if out is None else out.unionByName(part)
    return out
