"""Customers: totals, risk tiers, and what goes wrong for them."""

from collections.abc import Collection
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.config import Settings
from faultledger.fixed_values import RISK_TIERS, SCORECARD_HEADERS, TOP_CUSTOMERS
from faultledger.functions.money import as_double, mean, risk_tier
from faultledger.functions.text import currency_text, joined_set
from faultledger.operators.filters import in_dates, in_tiers
from faultledger.operators.ranking import CREDIT, credit_sum, grouped, incident_count
from faultledger.plans.sums import SCORECARD_SETS, is_set, rollup


def _tier(total: Column, settings: Settings | None) -> Column:
    settings = settings or Settings()
    return risk_tier(total, settings.high_risk_usd, settings.medium_risk_usd)


def scorecard(incidents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per customer, largest total first.

    The first aggregate counts each (customer, defect), (customer, plant) and
    (customer, source) in one scan. It is combined before its shuffle, so a
    customer that holds a large part of all rows arrives as a few rows per
    task, and the most frequent defect needs no list of the incidents.
    """
    return scorecard_of_sums(rollup(incidents.dropna(subset=["customer"]), SCORECARD_SETS), settings)


def scorecard_of_sums(sums: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``scorecard`` from one row of sums per set and key, as of all loads of a store that keeps them."""
    customer, defect, plant, source = "customer", "defect_category", "plant", "source"
    counted = sums.where(F.col(customer).isNotNull())
    of_defect, of_plant, of_source = (is_set(customer, other) for other in (defect, plant, source))
    # Most incidents first, then the name.
    lead = F.when(
        of_defect & F.col(defect).isNotNull(), F.struct(-F.col("incidents"), F.col(defect).alias("name"))
    )
    # This aggregate holds texts and sets, so it sorts; the hash, first among its
    # keys, settles the order of nearly every two names without reading them.
    return (
        counted.groupBy(F.xxhash64(customer).alias("_customer_hash"), customer)
        .agg(
            F.sum(F.when(of_defect, F.col("incidents"))).alias("incidents"),
            F.sum(F.when(of_defect, F.col("credit_usd"))).alias("total"),
            F.max(F.when(of_defect, F.col("max_credit_usd"))).alias("largest"),
            F.min(lead)["name"].alias("top_defect"),
            joined_set(F.when(of_source, F.col(source))).alias("sources"),
            F.count(F.when(of_plant, F.col(plant))).alias("plants"),
        )
        .orderBy(F.desc("total"), customer)
        .select(
            customer,
            "incidents",
            as_double(F.col("total")).alias("credit_usd"),
            mean(F.col("total"), F.col("incidents")).alias("avg_credit_usd"),
            as_double(F.col("largest")).alias("max_credit_usd"),
            F.coalesce("top_defect", F.lit("N/A")).alias("top_defect"),
            "sources",
            "plants",
            _tier(F.col("total"), settings).alias("risk_tier"),
        )
    )


def customer_tiers(incidents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Tier by the whole total of the given incidents."""
    return (
        grouped(incidents, "customer")
        .agg(incident_count(), credit_sum())
        .select(
            "customer",
            as_double(F.col("credit_usd")).alias("credit_usd"),
            _tier(F.col("credit_usd"), settings).alias("risk_tier"),
        )
    )


def tier_counts(incidents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Customers per tier; every tier has a row."""
    counts = customer_tiers(incidents, settings).agg(
        *[F.count_if(F.col("risk_tier") == tier).alias(tier) for tier in RISK_TIERS]
    )
    pairs = [
        F.struct(F.lit(tier).alias("risk_tier"), F.col(tier).alias("customers"))
        for tier in RISK_TIERS
    ]
    return counts.select(F.inline(F.array(*pairs)))


def top_customers(
    incidents: DataFrame,
    tiers: Collection[str] = RISK_TIERS,
    n: int = TOP_CUSTOMERS,
    settings: Settings | None = None,
) -> DataFrame:
    """The first customers of the scorecard, after the choice of tiers."""
    chosen = in_tiers(scorecard(incidents, settings), tiers)
    return chosen.orderBy(F.desc("credit_usd"), "customer").limit(n)


def display(customers: DataFrame) -> DataFrame:
    """A scorecard as shown, with amounts as text."""
    amounts = {
        c: currency_text(F.col(c)) for c in ("credit_usd", "avg_credit_usd", "max_credit_usd")
    }
    return (
        customers.withColumns(amounts)
        .select(*SCORECARD_HEADERS)
        .withColumnsRenamed(SCORECARD_HEADERS)
    )


def rolling_credit(incidents: DataFrame, as_of: date, days: int) -> DataFrame:
    """Credit per customer since ``days`` before ``as_of``, that day included, with no upper end."""
    recent = in_dates(incidents, as_of - timedelta(days=days), None)
    return grouped(recent, "customer").agg(credit_sum())


def rolling_tiers(incidents: DataFrame, as_of: date, settings: Settings | None = None) -> DataFrame:
    """Tier by the credit of the recent window; not the tier of the scorecard."""
    settings = settings or Settings()
    recent = rolling_credit(incidents, as_of, settings.risk_window_days)
    return recent.select(
        "customer",
        as_double(F.col("credit_usd")).alias("credit_usd"),
        _tier(F.coalesce("credit_usd", F.lit(0)), settings).alias("risk_tier"),
    )
