from collections.abc import Collection
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultledger.schemas import MONTH


def in_dates(incidents: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Both ends inclusive; also prunes the month partitions of the fact table."""
    for bound, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is None:
            continue
        incidents = incidents.where(keep(F.col("incident_date"), F.lit(bound)))
        if MONTH in incidents.columns:
            incidents = incidents.where(keep(F.col(MONTH), F.lit(f"{bound:%Y-%m}")))
    return incidents


def facet_filter(
    incidents: DataFrame,
    sources: Collection[str] = (),
    plants: Collection[str] = (),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """The global filter; an empty choice means no filter."""
    if sources:
        incidents = incidents.where(F.col("source").isin(*sources))
    if plants:
        incidents = incidents.where(F.col("plant").isin(*plants))
    return in_dates(incidents, start, end)


def detail_filter(
    incidents: DataFrame,
    customer: str | None = None,
    defect: str | None = None,
    min_credit: float = 0,
) -> DataFrame:
    if customer is not None:
        incidents = incidents.where(F.col("customer") == customer)
    if defect is not None:
        incidents = incidents.where(F.col("defect_category") == defect)
    if min_credit > 0:
        incidents = at_least(incidents, min_credit)
    return incidents


def at_least(incidents: DataFrame, threshold: float) -> DataFrame:
    return incidents.where(F.col("credit_requested_usd") >= threshold)


def in_tiers(customers: DataFrame, tiers: Collection[str]) -> DataFrame:
    """Unlike the global filter, an empty choice gives an empty result."""
    return customers.where(F.col("risk_tier").isin(*tiers))


def existing(frame: DataFrame, columns: Collection[str]) -> DataFrame:
    """Of the listed columns, those that the frame has."""
    return frame.select(*[c for c in columns if c in frame.columns])
