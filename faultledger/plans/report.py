"""The ten report tables of a run.

Nine of them are small sums of the same facts. They are taken from one rollup
over grouping sets, so that the fact table is scanned once for all of them, or
from the sums that a store keeps, without the facts. The raw rows are a copy of
the facts, or a bound up to which they are read.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultledger.fixed_values import REPORT_CUSTOMERS, REPORT_DEFECTS, REPORT_PAIRS
from faultledger.functions.dates import quarter_label
from faultledger.functions.money import as_double
from faultledger.functions.text import currency_text, joined_set
from faultledger.operators.ranking import by_credit, top
from faultledger.plans.detail import CSV_OPTIONS
from faultledger.plans.sums import REPORT_SETS, is_any_set, is_set, rollup
from faultledger.schemas import MONTH

def tables(
    rolled: DataFrame, run_id: str, generated_at: str, sources: Sequence[str]
) -> dict[str, DataFrame]:
    """The nine summed tables from a rollup."""

    def totals(*keys: str) -> DataFrame:
        return rolled.where(is_set(*keys)).dropna(subset=list(keys))

    def shown(ranked: DataFrame, *columns: str) -> DataFrame:
        return ranked.select(*columns, as_double(F.col("credit_usd")).alias("credit_usd"))

    of_source = is_set("source")
    summary = rolled.agg(
        F.sum(F.when(of_source, F.col("incidents"))).alias("incidents"),
        F.sum(F.when(of_source, F.col("credit_usd"))).alias("credit"),
        joined_set(F.when(of_source, F.col("source"))).alias("sources"),
        F.count(F.when(is_set("plant"), F.col("plant"))).alias("plants"),
        F.count(F.when(is_set("customer"), F.col("customer"))).alias("customers"),
    ).select(
        F.lit(run_id).alias("run_id"),
        F.lit(generated_at).alias("generated_at"),
        "incidents",
        currency_text(F.col("credit"), 2).alias("credit_usd"),
        "sources",
        "plants",
        "customers",
    )
    quarters = (
        totals("source", "quarter")
        .groupBy("quarter")
        .pivot("source", list(sources))
        .agg(F.sum("credit_usd"))
        .orderBy("quarter")
        .select(
            quarter_label(F.col("quarter")).alias("quarter"),
            *[F.coalesce(as_double(F.col(f"`{s}`")), F.lit(0.0)).alias(s) for s in sources],
        )
    )
    defect, customer = "defect_category", "customer"
    return {
        "summary": summary,
        "by_source": shown(by_credit(totals("source"), "source"), "source", "incidents"),
        "quarter_pivot": quarters,
        "by_plant": shown(by_credit(totals("plant"), "plant"), "plant", "incidents"),
        "by_defect": shown(top(totals(defect), REPORT_DEFECTS, defect), defect, "incidents"),
        "by_customer": shown(
            top(totals(customer), REPORT_CUSTOMERS, customer), customer, "incidents"
        ),
        "source_span": totals("source")
        .select("source", "earliest_date", "latest_date")
        .orderBy("source"),
        "customer_plant": shown(
            top(totals(customer, "plant"), REPORT_PAIRS, customer, "plant"), customer, "plant"
        ),
        "plant_defect": shown(
            top(totals("plant", defect), REPORT_PAIRS, "plant", defect), "plant", defect
        ),
    }


def raw_export(incidents: DataFrame) -> DataFrame:
    """The facts without the columns that only serve storage."""
    return incidents.drop("id", MONTH)


def _write(table: DataFrame, target: str, name: str, fmt: str) -> None:
    options = CSV_OPTIONS if fmt == "csv" else {}
    table.write.mode("overwrite").options(**options).format(fmt).save(f"{target}/{name}")


def raw_of_report(incidents: DataFrame, target: str) -> DataFrame:
    """The raw rows of a written report: its copy, or the facts up to its bound.

    Facts are only ever added, so later loads change neither.
    """
    reader = incidents.sparkSession.read
    bound = reader.parquet(f"{target}/raw_through").first()["loaded_through"]
    return raw_export(incidents.where(F.col("loaded_at") <= F.lit(bound)))


def write_report(
    incidents: DataFrame,
    out_dir: str,
    run_id: str,
    generated_at: str,
    fmt: str = "parquet",
    sums: DataFrame | None = None,
    copy_raw: bool = True,
) -> str:
    """One directory per table under ``run_id=...``; "" and nothing written if there are no rows.

    A repeated run replaces its own tables. With ``sums``, those
    that a store keeps, the summed tables come from there. Without ``copy_raw`` the
    bundle has ``raw_through`` in place of ``raw``: the time of the last load in it,
    with which ``raw_of_report`` reads the same rows from the facts.
    """
    if incidents.isEmpty():
        return ""
    target = f"{out_dir.rstrip('/')}/run_id={run_id}"
    spark = incidents.sparkSession
    # written once for the nine small tables, beside the bundle, and removed after them
    rolled_path = f"{out_dir.rstrip('/')}/_rollup/run_id={run_id}"
    kept = rollup(incidents) if sums is None else sums.where(is_any_set(REPORT_SETS))
    kept.write.mode("overwrite").parquet(rolled_path, compression="zstd")
    rolled = spark.read.parquet(rolled_path)
    sources = [
        r["source"]
        for r in rolled.where(is_set("source")).select("source").orderBy("source").collect()
        if r["source"] is not None
    ]
    bundle = tables(rolled, run_id, generated_at, sources)
    if copy_raw:
        bundle["raw"] = raw_export(incidents)
    for name, table in bundle.items():
        _write(table, target, name, fmt)
    if not copy_raw:
        last = incidents.agg(F.max("loaded_at").alias("loaded_through"))
        if sums is not None:
            last = rolled.agg(F.timestamp_micros(F.max("through")).alias("loaded_through"))
        _write(last, target, "raw_through", "parquet")
    scratch = spark._jvm.org.apache.hadoop.fs.Path(rolled_path)
    scratch.getFileSystem(spark._jsc.hadoopConfiguration()).delete(scratch, True)
    return target
