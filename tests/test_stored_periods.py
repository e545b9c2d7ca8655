"""Storing periods computes what the children are derived from once, and brings the keys to the children."""

import re

from pyspark.sql import DataFrameWriter

from check_queries import DATA
from reportloom.plans import stored
from reportloom.plans.views import Views
from reportloom.sources import store
from test_search_tables import plan_text


def counted(df, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_lines_and_orders_are_not_read_for_each_child(spark):
    v = Views(spark, str(DATA))
    rows, seen = {}, {}
    for name in ("lineitem", "orders"):
        rows[name], seen[name] = v[name].count(), spark.sparkContext.accumulator(0)
        v._made[name] = counted(v[name], seen[name])
    assert stored.replaced_periods(v).count() == v["periods"].count()
    assert seen["lineitem"].value == rows["lineitem"]
    assert seen["orders"].value <= 3 * rows["orders"]  # counts, lines and charts


def test_periods_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    periods = spark.createDataFrame([(f"p{i}", "c", 1 + i % 4, 2020 + i // 4) for i in range(12)], "id string, company_id string, quarter int, year int")
    store.replace_periods(spark, str(tmp_path / "s"), counted(periods, seen), {})
    assert seen.value == 12 and spark.read.parquet(f"{tmp_path}/s/periods").count() == 12


def test_texts_are_not_dealt_by_period(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        plans.append((path, plan_text(self._df)))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # the texts are more
    try:
        stored.replaced_periods(Views(spark, str(DATA)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = [plan for path, plan in plans if re.search(r"/_staging/\w+/sections$", path)]
    assert len(texts) == 2 and not any(re.search(r"hashpartitioning\((\w+\.)?period_id#\d+L?, \d+\)", plan) for plan in texts)


def test_more_keys_than_travel_with_the_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_PASSED_ON", 2)
    root = str(tmp_path / "s")
    periods = spark.createDataFrame([(f"p{i}", "c", 1 + i % 4, 2020) for i in range(4)], "id string, company_id string, quarter int, year int")
    sections = spark.createDataFrame([(f"p{i}", "x") for i in (0, 1, 1, 3, 7)], "period_id string, title string")
    for _ in range(2):
        store.replace_periods(spark, root, periods, {"sections": sections})
        assert sorted(r["period_id"] for r in spark.read.parquet(f"{root}/sections").collect()) == ["p0", "p1", "p1", "p3"]
