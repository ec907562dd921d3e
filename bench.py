"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

"land" writes the raw extracts and "ingest" is one whole run over them (parse,
clean, deduplicate, append, tiers, alerts, log). The views then read the fact
table that the run has written. Every query is run to the end, with all of its
columns, into a sink that keeps nothing.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

VIEWS = (
    "normalized",
    "cleaned",
    "validation_counts",
    "dedup_first_wins",
    "tier_90d",
    "kpi",
    "summary_row",
    "by_source",
    "by_plant",
    "by_defect_top15",
    "by_customer_top20",
    "customer_plant_top15",
    "plant_defect_top15",
    "quarter_pivot",
    "month_trend",
    "detail_filtered",
    "pareto_topn",
    "heat_plant_defect",
    "heat_customer_defect",
    "scorecard",
    "tier_counts",
    "high_value",
    "repeat_customers",
    "weekly_ops",
    "weekly_payload",
    "facets",
    "report_totals",
    "stream_incidents",
    "stream_weekly",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from faultledger.testbed import star_extracts as star
    from faultledger.testbed.catalog import QUERIES

    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    def to_the_end(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timed("land", lambda: star.landing(spark, sf_dir))
    timed("ingest", lambda: star.store(spark, sf_dir))
    for name in VIEWS:
        timed(name, lambda name=name: to_the_end(name))
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
