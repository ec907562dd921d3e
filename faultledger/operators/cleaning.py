"""Rules that make the unified rows fit to load."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.fixed_values import FIRST_VALID_YEAR
from faultledger.functions.money import LARGEST
from faultledger.functions.text import clean_label
from faultledger.schemas import MONEY, REJECT

_LABELS = ("source", "plant", "customer", "defect_category")


def has_date(day: str = "incident_date") -> Column:
    return F.col(day).isNotNull()


def has_valid_date(first_year: int = FIRST_VALID_YEAR, day: str = "incident_date") -> Column:
    # A missing date does not pass this comparison, so no test for null is needed.
    return F.col(day) >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1))


def is_rejected(rows: DataFrame) -> Column:
    """Whether a row was marked by its reader as one that does not fit."""
    line = REJECT[1].name
    return F.col(line).isNotNull() if line in rows.columns else F.lit(False)


def validate(unified: DataFrame, first_year: int = FIRST_VALID_YEAR) -> DataFrame:
    """Keep dated rows, clip credits at zero, fill numbers with 0 and labels with ``Unknown``.

    Quantities are not clipped. Rows marked by their reader stay as well, marked.
    """
    zero = F.lit(0).cast(MONEY)
    credit = F.greatest(F.coalesce("credit_requested_usd", zero), zero)
    return unified.where(has_valid_date(first_year) | is_rejected(unified)).withColumns(
        {
            "credit_requested_usd": credit.cast(MONEY),
            "qty_affected": F.coalesce("qty_affected", F.lit(0.0)),
            **{name: clean_label(F.col(name)) for name in _LABELS},
        }
    )


def date_counts(first_year: int = FIRST_VALID_YEAR, day: str = "incident_date") -> tuple[Column, ...]:
    """Aggregates over all rows with their dates: how many the rules of dates drop."""
    return (
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~has_date(day)).alias("dropped_no_date"),
        F.count_if(has_date(day) & ~has_valid_date(first_year, day)).alias("dropped_old_date"),
    )


def value_counts(first_year: int = FIRST_VALID_YEAR) -> tuple[Column, ...]:
    """Aggregates over unified rows, of which those without a valid date count for nothing."""
    kept = has_valid_date(first_year)
    credit, quantity = F.col("credit_requested_usd"), F.col("qty_affected")
    return (
        F.count_if(kept & (credit < 0)).alias("clipped_credit"),
        F.count_if(kept & credit.isNull()).alias("filled_credit"),
        F.count_if(kept & (F.abs(credit) >= LARGEST)).alias("oversized_credit"),
        F.count_if(kept & quantity.isNull()).alias("filled_quantity"),
        F.count_if(kept).alias("kept_rows"),
    )


def rule_counts(first_year: int = FIRST_VALID_YEAR) -> tuple[Column, ...]:
    """Aggregates over unified rows: how many each rule drops or changes."""
    return (*date_counts(first_year), *value_counts(first_year))


def validation_counts(unified: DataFrame, first_year: int = FIRST_VALID_YEAR) -> DataFrame:
    """The rule counts as a table of one row."""
    return unified.agg(*rule_counts(first_year))
