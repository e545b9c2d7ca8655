"""Times the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Names as arguments, or ``all``, choose other queries.
Every query runs once unmeasured at the smallest scale to warm the JVM, then is written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from reportloom.plans.catalog import all_queries
from reportloom.session import local_session

HEADLINE = [
    "global_stats", "company_rollup", "periods_with_counts", "income_statements", "period_components",
    "compare_companies", "unmatched_rows", "align_periods", "missing_items", "retry_scope",
    "table_findings", "verdict", "normalise_labels", "parse_cells", "type_tables", "report_language", "text_lines",
    "parse_payloads", "page_sections", "statement_order", "period_matrix", "table_dump", "unique_sections",
    "search_knowledge", "hybrid_sections", "search_sections", "pass_totals", "requests_in_window", "latest_job_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    warm = Path(folder).parent / "sf0.001"
    seconds: dict[str, float] = {}
    for name in names:
        if warm.exists():
            queries[name](spark, str(warm)).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
