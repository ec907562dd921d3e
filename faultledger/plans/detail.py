"""The record list and its summary, usually after ``detail_filter``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultledger.fixed_values import DETAIL_HEADERS
from faultledger.functions.dates import month_label, month_start
from faultledger.functions.money import as_double, mean
from faultledger.operators.filters import existing
from faultledger.operators.ranking import CREDIT, credit_sum, grouped, incident_count


def summary(incidents: DataFrame) -> DataFrame:
    """Count, sum and mean; both amounts are 0 when there is no row."""
    return incidents.agg(incident_count(), credit_sum()).select(
        "incidents",
        F.coalesce(as_double(F.col("credit_usd")), F.lit(0.0)).alias("credit_usd"),
        F.coalesce(mean(F.col("credit_usd"), F.col("incidents")), F.lit(0.0)).alias(
            "avg_credit_usd"
        ),
    )


def month_source(incidents: DataFrame) -> DataFrame:
    return (
        grouped(incidents.withColumn("_m", month_start(F.col("incident_date"))), "_m", "source")
        .agg(credit_sum())
        .orderBy("_m", "source")
        .select(
            month_label(F.col("_m")).alias("month"),
            "source",
            as_double(F.col("credit_usd")).alias("credit_usd"),
        )
    )


def records(incidents: DataFrame) -> DataFrame:
    """The shown columns, in no order, with their raw names; this is what is exported."""
    return existing(incidents, tuple(DETAIL_HEADERS))


def sorted_records(incidents: DataFrame) -> DataFrame:
    """Largest credit first.

    The other columns break ties, so that the sort can also split the many
    rows that have the same credit.
    """
    rows = records(incidents)
    return rows.orderBy(F.desc(CREDIT), *[F.asc(c) for c in rows.columns if c != CREDIT])


def display(incidents: DataFrame) -> DataFrame:
    return sorted_records(incidents).withColumnsRenamed(DETAIL_HEADERS)


# Texts are written as they are, blanks at their ends included.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(frame: DataFrame, path: str) -> None:
    """A directory of CSV files, written by all tasks."""
    frame.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
