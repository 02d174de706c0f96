"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each headline query runs once to warm up and then RUNS times, of which the median
counts; ``value`` is their sum. ``more`` has others, run once after a warm-up, as
far as they can begin within $BENCH_MORE_SECONDS of the start.
"""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["doi_clean", "verify_pmid", "dedup_explicit_first", "cache_upsert", "extract_doi", "ref_vancouver"]
MORE = ["verify_doi", "lint_sheet", "decode_ncbi", "report_text", "title_search", "cjk_title_search"]
RUNS, MEMORY = 3, "8g"


def main() -> None:
    from refsieve.plans import catalog, catalog_flow  # noqa: F401

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", MEMORY)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str, runs: int = RUNS) -> float:
        took = []
        for _ in range(1 + runs):
            began = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return round(median(took[1:]), 3)

    started, most = time.time(), float(os.environ.get("BENCH_MORE_SECONDS", "300"))
    claims = spark.read.parquet(f"{folder}/orders.parquet").count()
    took = {name: seconds(name) for name in HEADLINE}
    more = {name: seconds(name, 1) for name in MORE if time.time() - started < most}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "more": more, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus), "memory": MEMORY, "runs": RUNS, "claims_per_second": round(claims / took["verify_pmid"])}))


if __name__ == "__main__":
    main()
