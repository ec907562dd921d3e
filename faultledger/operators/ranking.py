from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREDIT = "credit_requested_usd"


def incident_count() -> Column:
    return F.count(F.lit(1)).alias("incidents")


def credit_sum() -> Column:
    return F.sum(CREDIT).alias("credit_usd")


def grouped(incidents: DataFrame, *keys: str):
    """Groups on the given columns; rows without a key are in no group."""
    return incidents.dropna(subset=list(keys)).groupBy(*keys)


def by_credit(totals: DataFrame, *keys: str) -> DataFrame:
    """Largest credit first; equal sums in the order of the keys."""
    return totals.orderBy(F.desc("credit_usd"), *[F.asc(k) for k in keys])


def top(totals: DataFrame, n: int, *keys: str) -> DataFrame:
    return by_credit(totals, *keys).limit(n)
