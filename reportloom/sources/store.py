"""Stored model tables: replace whole periods, publish only when all parts are written.

Periods and children lie under ``root/<table>`` partitioned by year and quarter. A replacement touches only the
partitions of its periods: their surviving rows and the new rows are staged first, then published by dynamic
partition overwrite; a partition that has no row left is overwritten with an empty file. The staged rows go once all
tables are published.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reportloom.functions.periods import label_quarter
from reportloom.schemas import MODEL_TABLES
from reportloom.session import cut_lineage
from reportloom.sources.payloads import (
    chart_table_rows,
    financial_rows,
    new_companies,
    parse_payloads,
    period_rows,
    report_table_rows,
    section_rows,
)

_PARTITION = ["year", "quarter"]
#: Last batch of each stream of vectors that a stored period has counted.
_COUNTED, _COUNTED_TYPE = "vector_batches", "map<string,bigint>"
_PASSED_ON = 1 << 12  # keys of periods that travel with the plan
MANDATORY = ["financial_data", "sections", "report_tables"]
OPTIONAL = ["charts"]


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Stored rows; none where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _partitions(rows: DataFrame) -> set[tuple[int, int]]:
    """The (year, quarter) pairs of the rows: four digits and one, so the set is short by its nature."""
    return {(r["year"], r["quarter"]) for r in rows.select(*_PARTITION).distinct().collect()}


def _publish(spark: SparkSession, staged: str, target: str, like: DataFrame, touched: Column) -> None:
    rows = read_or_empty(spark, staged, like.schema)
    emptied = _partitions(read_or_empty(spark, target, like.schema).filter(touched)) - _partitions(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTITION).parquet(target)
    for year, quarter in emptied:
        none = spark.createDataFrame([], like.drop(*_PARTITION).schema)
        none.write.mode("overwrite").parquet(f"{target}/year={year}/quarter={quarter}")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _passed_on(keys: DataFrame) -> DataFrame:
    """Stored rows; while they are few as rows of known size, so Catalyst brings them to the children where these are read."""
    keys = cut_lineage(keys)
    if keys.limit(_PASSED_ON + 1).count() > _PASSED_ON:
        return keys
    return keys.sparkSession.createDataFrame(keys.toArrow(), keys.schema)


def replace_periods(spark: SparkSession, root: str, periods: DataFrame, children: dict[str, DataFrame]) -> None:
    """Replace periods by (company, quarter, year) together with all their children.

    A failing mandatory child leaves the stored tables as they were; failing charts only warn, and the charts of the
    replaced periods are gone. Running it again with the same input changes nothing. The periods are computed once. Runs jobs.
    """
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    same = ["company_id", *_PARTITION]
    periods = cut_lineage(periods)
    keys = _passed_on(periods.select(F.col("id").alias("period_id"), *same))
    touched = _touched(keys)

    if _COUNTED not in periods.columns:
        periods = periods.withColumn(_COUNTED, F.lit(None).cast(_COUNTED_TYPE))
    old = read_or_empty(spark, f"{root}/periods", periods.schema).filter(touched)
    # A period that comes again keeps what it has counted, so an older batch that runs again stays without effect.
    periods = periods.drop(_COUNTED).join(old.select("id", _COUNTED), "id", "left").select(periods.columns)
    replaced = old.join(keys.select(*same), same, "left_semi").select(F.col("id").alias("period_id"))
    gone = _passed_on(replaced.unionByName(keys.select("period_id")).distinct())
    merged = old.join(keys.select(*same), same, "left_anti").unionByName(periods)
    merged.write.mode("overwrite").partitionBy(*_PARTITION).parquet(f"{stage}/periods")

    staged: dict[str, DataFrame] = {}
    for name in [*MANDATORY, *OPTIONAL]:
        if name not in children:
            continue
        placed = children[name].join(keys.select("period_id", *_PARTITION), "period_id")
        old = read_or_empty(spark, f"{root}/{name}", placed.schema).filter(touched)
        kept = old.join(gone, "period_id", "left_anti")

        def put(rows: DataFrame, path: str = f"{stage}/{name}") -> None:
            rows.write.mode("overwrite").partitionBy(*_PARTITION).parquet(path)

        try:
            put(kept.unionByName(placed))
        except PySparkException as error:
            if name in MANDATORY:
                raise
            warnings.warn(f"{name} were not stored: {error.getCondition()}", stacklevel=2)
            put(kept)
        staged[name] = placed

    for name, like in staged.items():
        _publish(spark, f"{stage}/{name}", f"{root}/{name}", like, touched)
    _publish(spark, f"{stage}/periods", f"{root}/periods", periods, touched)
    _remove(spark, stage)


def _touched(keys: DataFrame) -> Column:
    """Filter on the partitions of the keys, known before the scan, so that no other partition is read."""
    return (F.col("year") * 10 + F.col("quarter")).isin([year * 10 + quarter for year, quarter in _partitions(keys)])


def ingest(spark: SparkSession, root: str, raw: DataFrame, companies: DataFrame) -> None:
    """Store the readable payload texts (seq, pdf_hash, raw). Parses each text once. Runs jobs.

    A report of a company that is neither in ``companies`` nor in ``root/companies`` adds the company there first.
    """
    parsed = cut_lineage(parse_payloads(raw))
    given = companies.select(F.col("id").cast("string").alias("id"), "slug")
    stored = read_or_empty(spark, f"{root}/companies", MODEL_TABLES["companies"]).select("id", "slug")
    known = given.unionByName(stored.join(given.select("slug"), "slug", "left_anti"))
    dated = parsed.filter(F.col("repair").isNotNull() & label_quarter(F.col("payload.metadata.period")).isNotNull())
    added = cut_lineage(new_companies(dated.select(F.col("payload.metadata.bolag").alias("name")), known))
    if not added.isEmpty():
        append(added, f"{root}/companies")
    periods = cut_lineage(period_rows(parsed, known.unionByName(added.select("id", "slug"))))
    children = {
        "financial_data": financial_rows(periods),
        "sections": section_rows(periods),
        "report_tables": report_table_rows(periods),
        "charts": chart_table_rows(periods),
    }
    replace_periods(spark, root, periods.drop("payload"), children)


def add_vector_counts(spark: SparkSession, root: str, counts: DataFrame, stream: str, batch: int) -> None:
    """Adds ``embeddings_count`` (period_id) of a numbered batch to the stored periods; a batch counts once. Runs jobs.

    Only the partitions of the counted periods are read whole and rewritten. Every changed row notes the batch, so a
    run that ended between two partitions can be repeated. Periods that are not stored have no row.
    """
    try:
        stored = spark.read.parquet(f"{root}/periods")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    counts = cut_lineage(counts.select("period_id", F.col("embeddings_count").cast("bigint").alias("_more")))
    places = stored.select(F.col("id").alias("period_id"), *_PARTITION).join(counts, "period_id", "left_semi")
    touched = _touched(places)
    names = [*stored.columns, *([] if _COUNTED in stored.columns else [_COUNTED])]
    types = {f.name: f.dataType.simpleString() for f in stored.schema.fields} | {_COUNTED: _COUNTED_TYPE}
    rows = read_or_empty(spark, f"{root}/periods", ", ".join(f"`{n}` {types[n]}" for n in names)).filter(touched)
    last = F.coalesce(F.try_element_at(_COUNTED, F.lit(stream)), F.lit(-1))
    due = F.col("_more").isNotNull() & (last < batch)
    others = F.map_filter(F.coalesce(_COUNTED, F.create_map().cast(_COUNTED_TYPE)), lambda name, _: name != stream)
    noted = F.map_concat(others, F.create_map(F.lit(stream), F.lit(batch).cast("bigint")))
    changed = {
        "embeddings_count": F.when(due, F.coalesce("embeddings_count", F.lit(0)) + F.col("_more")).otherwise(F.col("embeddings_count")).cast(types["embeddings_count"]),
        _COUNTED: F.when(due, noted).otherwise(F.col(_COUNTED)),
    }
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    joined = rows.join(counts, rows["id"] == counts["period_id"], "left")
    joined.select(*[changed[n].alias(n) if n in changed else F.col(n) for n in names]).write.partitionBy(*_PARTITION).parquet(f"{stage}/periods")
    _publish(spark, f"{stage}/periods", f"{root}/periods", rows, touched)
    _remove(spark, stage)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
