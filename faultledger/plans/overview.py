"""Company-wide numbers. Every view takes incidents and returns a DataFrame."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultledger.fixed_values import REPORT_CUSTOMERS, REPORT_DEFECTS, REPORT_PAIRS
from faultledger.functions.dates import (
    month_label,
    month_start,
    quarter_label,
    quarter_start,
)
from faultledger.functions.money import as_double
from faultledger.operators.ranking import by_credit, credit_sum, grouped, incident_count, top


def _in_double(totals: DataFrame) -> DataFrame:
    return totals.withColumn("credit_usd", as_double(F.col("credit_usd")))


def kpi(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        incident_count(),
        F.coalesce(as_double(F.sum("credit_requested_usd")), F.lit(0.0)).alias("credit_usd"),
        F.count_distinct("plant").alias("plants"),
        F.count_distinct("customer").alias("customers"),
    )


def distinct_names(sketches: DataFrame, *keys: str) -> DataFrame:
    """Distinct customers and plants, about, from the sketches of months instead of the incidents.

    With ``MONTH`` as key per month, without one over all that are given, so a filter by
    month is one on the sketches. The exact counts of ``kpi`` stay the default.
    """
    names = ("plants", "customers")
    about = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).alias(name) for name in names]
    return sketches.groupBy(*keys).agg(*about)


def _totals(incidents: DataFrame, *keys: str) -> DataFrame:
    return grouped(incidents, *keys).agg(incident_count(), credit_sum())


def by_source(incidents: DataFrame) -> DataFrame:
    return _in_double(by_credit(_totals(incidents, "source"), "source"))


def by_plant(incidents: DataFrame) -> DataFrame:
    return _in_double(by_credit(_totals(incidents, "plant"), "plant"))


def by_defect(incidents: DataFrame, n: int = REPORT_DEFECTS) -> DataFrame:
    key = "defect_category"
    return _in_double(top(_totals(incidents, key), n, key))


def by_customer(incidents: DataFrame, n: int = REPORT_CUSTOMERS) -> DataFrame:
    return _in_double(top(_totals(incidents, "customer"), n, "customer"))


def _top_pairs(incidents: DataFrame, n: int, *keys: str) -> DataFrame:
    return _in_double(top(grouped(incidents, *keys).agg(credit_sum()), n, *keys))


def customer_plant(incidents: DataFrame, n: int = REPORT_PAIRS) -> DataFrame:
    return _top_pairs(incidents, n, "customer", "plant")


def plant_defect(incidents: DataFrame, n: int = REPORT_PAIRS) -> DataFrame:
    return _top_pairs(incidents, n, "plant", "defect_category")


def source_span(incidents: DataFrame) -> DataFrame:
    return (
        grouped(incidents, "source")
        .agg(
            F.min("incident_date").alias("earliest_date"),
            F.max("incident_date").alias("latest_date"),
        )
        .orderBy("source")
    )


def quarter_source(incidents: DataFrame) -> DataFrame:
    return (
        grouped(incidents.withColumn("_q", quarter_start(F.col("incident_date"))), "_q", "source")
        .agg(credit_sum())
        .orderBy("_q", "source")
        .select(
            quarter_label(F.col("_q")).alias("quarter"),
            "source",
            as_double(F.col("credit_usd")).alias("credit_usd"),
        )
    )


def quarter_pivot(incidents: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row per quarter, one column per source, 0 where there is nothing.

    The sources are given, which spares Spark a job to find them.
    """
    return (
        grouped(incidents.withColumn("_q", quarter_start(F.col("incident_date"))), "_q")
        .pivot("source", list(sources))
        .agg(F.sum("credit_requested_usd"))
        .orderBy("_q")
        .select(
            quarter_label(F.col("_q")).alias("quarter"),
            *[
                F.coalesce(as_double(F.col(f"`{s}`")), F.lit(0.0)).alias(s) for s in sources
            ],
        )
    )


def month_trend(incidents: DataFrame) -> DataFrame:
    return (
        _totals(incidents.withColumn("_m", month_start(F.col("incident_date"))), "_m")
        .orderBy("_m")
        .select(
            month_label(F.col("_m")).alias("month"),
            "incidents",
            as_double(F.col("credit_usd")).alias("credit_usd"),
        )
    )


def facets(incidents: DataFrame) -> DataFrame:
    """(facet, value): the choices of every filter, the date span, and the last load.

    One grouping-sets aggregate, hence one scan for all of them.
    """
    names = ("source", "plant", "customer", "defect_category")
    has_load = "loaded_at" in incidents.columns
    loaded = F.max(F.col("loaded_at") if has_load else F.lit(None).cast("timestamp"))
    sets = incidents.groupingSets([[n] for n in names] + [[]], *names).agg(
        F.grouping_id().alias("gid"),
        F.min("incident_date").cast("string").alias("first"),
        F.max("incident_date").cast("string").alias("last"),
        loaded.cast("string").alias("loaded"),
    )

    def pair(facet, value):
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    # In the grouping id, the bit of a column that is in the set is 0.
    every = (1 << len(names)) - 1
    rows = F.when(
        F.col("gid") == every,
        F.array(
            pair("first_date", F.col("first")),
            pair("last_date", F.col("last")),
            pair("last_load", F.col("loaded")),
        ),
    )
    for i, name in enumerate(names):
        in_set = F.col("gid") == every ^ (1 << (len(names) - 1 - i))
        rows = rows.when(in_set, F.array(pair(name, F.col(name))))
    return (
        sets.select(F.inline(rows)).where(F.col("value").isNotNull()).orderBy("facet", "value")
    )
