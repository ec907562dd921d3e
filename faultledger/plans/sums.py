"""Counts, sums and spans of incidents by the keys that reports and scorecards group by.

The sums of two sets of incidents merge into those of both, so a store can keep
them per load, and a view of the whole history reads them instead of the facts.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.functions.dates import quarter_start
from faultledger.operators.ranking import CREDIT

KEYS = ("source", "plant", "defect_category", "customer", "quarter")
REPORT_SETS = (
    ("source",),
    ("plant",),
    ("defect_category",),
    ("customer",),
    ("source", "quarter"),
    ("customer", "plant"),
    ("plant", "defect_category"),
)
SCORECARD_SETS = (("customer", "defect_category"), ("customer", "plant"), ("customer", "source"))
ALL_SETS = tuple(dict.fromkeys(REPORT_SETS + SCORECARD_SETS))
# All sets in groups that a store sums one after another: each set sends nearly every row of a load into a shuffle.
SET_GROUPS = (REPORT_SETS, tuple(s for s in ALL_SETS if s not in REPORT_SETS))

# Each measure, and how those of two sets of incidents merge.
_MERGE = {
    "incidents": F.sum,
    "credit_usd": F.sum,
    "max_credit_usd": F.max,
    "earliest_date": F.min,
    "latest_date": F.max,
    "through": F.max,
}


def rollup(incidents: DataFrame, sets: Sequence[Sequence[str]] = REPORT_SETS) -> DataFrame:
    """The measures for every key of some grouping sets, in one scan."""
    rows = incidents.withColumn("quarter", quarter_start(F.col("incident_date")))
    return rows.groupingSets([list(s) for s in sets], *KEYS).agg(
        F.grouping_id().cast("bigint").alias("gid"),
        F.count(F.lit(1)).alias("incidents"),
        F.sum(CREDIT).cast("decimal(38,6)").alias("credit_usd"),
        F.max(CREDIT).alias("max_credit_usd"),
        F.min("incident_date").alias("earliest_date"),
        F.max("incident_date").alias("latest_date"),
    )


def merged(sums: DataFrame) -> DataFrame:
    """One row per set and key, of sums that several loads have written.

    ``through`` is the time of the last load among them, in microseconds.
    """
    measures = [how(name).alias(name) for name, how in _MERGE.items()]
    one = sums.groupBy("gid", *KEYS).agg(*measures)
    return one.withColumn("credit_usd", F.col("credit_usd").cast("decimal(38,6)"))


def _set_id(keys: Sequence[str]) -> int:
    # In the grouping id, the bit of a column that is in the set is 0.
    return int("".join("0" if k in keys else "1" for k in KEYS), 2)


def is_set(*keys: str) -> Column:
    """Whether a row is of this grouping set."""
    return F.col("gid") == _set_id(keys)


def is_any_set(sets: Sequence[Sequence[str]]) -> Column:
    """Whether a row is of one of these grouping sets."""
    return F.col("gid").isin([_set_id(keys) for keys in sets])
