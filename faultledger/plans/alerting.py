"""What needs attention: large incidents, repeat customers, weekly totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.fixed_values import ALERT_COLUMNS, SINGLE_INCIDENT_USD, WEEKLY_TOTAL_USD
from faultledger.functions.dates import day_label, month_label, month_start, week_start
from faultledger.functions.money import as_double
from faultledger.functions.text import currency_text, joined_set
from faultledger.operators.filters import at_least, existing
from faultledger.operators.ranking import CREDIT, credit_sum, grouped, incident_count


def high_value(incidents: DataFrame, threshold: float = SINGLE_INCIDENT_USD) -> DataFrame:
    """Incidents of at least the threshold, largest first, with the shown columns."""
    rows = existing(at_least(incidents, threshold), ALERT_COLUMNS)
    return rows.orderBy(F.desc(CREDIT), *[F.asc(c) for c in rows.columns if c != CREDIT])


def high_value_display(incidents: DataFrame, threshold: float = SINGLE_INCIDENT_USD) -> DataFrame:
    return high_value(incidents, threshold).withColumn(CREDIT, currency_text(F.col(CREDIT), 2))


def alert_rows(batch: DataFrame, threshold: float = SINGLE_INCIDENT_USD) -> DataFrame:
    """One alert per large incident of a batch."""
    return at_least(batch, threshold).select(
        F.lit("high_credit").alias("kind"),
        CREDIT,
        "plant",
        "customer",
        "defect_category",
        "incident_date",
        "source",
    )


def repeat_customers(incidents: DataFrame) -> DataFrame:
    """Customers with more than one incident in a calendar month."""
    months = incidents.withColumn("_m", month_start(F.col("incident_date")))
    return (
        grouped(months, "customer", "_m")
        .agg(incident_count())
        .where("incidents > 1")
        .orderBy(F.desc("incidents"), "customer", "_m")
        .select("customer", month_label(F.col("_m")).alias("month"), "incidents")
    )


def weekly_operations(incidents: DataFrame) -> DataFrame:
    """Per week from Monday, the latest week first."""
    weeks = incidents.withColumn("_w", week_start(F.col("incident_date")))
    return (
        grouped(weeks, "_w")
        .agg(
            incident_count(),
            credit_sum(),
            F.count_distinct("plant").alias("plants"),
            F.count_distinct("customer").alias("customers"),
        )
        .orderBy(F.desc("_w"))
        .select(
            day_label(F.col("_w")).alias("week_start"),
            "incidents",
            as_double(F.col("credit_usd")).alias("credit_usd"),
            "plants",
            "customers",
        )
    )


def weeks_over(incidents: DataFrame, threshold: float = WEEKLY_TOTAL_USD) -> DataFrame:
    """Weeks whose total is more than the threshold."""
    return weekly_operations(incidents).where(F.col("credit_usd") > threshold)


def _rolled_up(incidents: DataFrame) -> DataFrame:
    """Counts and sums per source, per plant and per customer, in one scan."""
    return incidents.groupingSets(
        [["source"], ["plant"], ["customer"]], "source", "plant", "customer"
    ).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum(CREDIT).alias("credit")
    )


def _in_set(name: str) -> Column:
    # In the grouping id, the bit of the column that is in the set is 0.
    return F.col("gid") == {"source": 0b011, "plant": 0b101, "customer": 0b110}[name]


def _headline():
    return (
        F.coalesce(F.sum(F.when(_in_set("source"), F.col("n"))), F.lit(0)).alias("incidents"),
        F.coalesce(F.sum(F.when(_in_set("source"), F.col("credit"))), F.lit(0)).alias("credit"),
        joined_set(F.when(_in_set("source"), F.col("source"))).alias("sources"),
        F.count(F.when(_in_set("plant"), F.col("plant"))).alias("plants"),
        F.count(F.when(_in_set("customer"), F.col("customer"))).alias("customers"),
    )


def weekly_payload(incidents: DataFrame) -> DataFrame:
    """The one row of the weekly message; N/A stands for no top plant or customer."""

    def leader(name):
        named = _in_set(name) & F.col(name).isNotNull()
        largest = F.min(F.when(named, F.struct(-F.col("credit"), F.col(name))))
        return F.coalesce(largest[name], F.lit("N/A")).alias(f"top_{name}")

    return (
        _rolled_up(incidents)
        .agg(*_headline(), leader("plant"), leader("customer"))
        .select(
            "incidents",
            as_double(F.col("credit")).alias("credit_usd"),
            "top_plant",
            "top_customer",
            "sources",
            "plants",
            "customers",
        )
    )


def summary_row(incidents: DataFrame, run_id: str) -> DataFrame:
    """The first table of the report, with the total as text."""
    return _rolled_up(incidents).agg(*_headline()).select(
        F.lit(run_id).alias("run_id"),
        "incidents",
        currency_text(F.col("credit"), 2).alias("credit_usd"),
        "sources",
        "plants",
        "customers",
    )
