from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultledger.fixed_values import HIGH_RISK_USD, MEDIUM_RISK_USD
from faultledger.schemas import MONEY

# A plain decimal number; keeps 1500d, nan, inf and hexadecimal floats out of
# the cast to double, which would accept them.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# The largest amount that the type holds. Larger ones become this, so that they
# stay the largest claims and are counted on their own.
LARGEST = Decimal(10) ** (MONEY.precision - MONEY.scale) - Decimal(1).scaleb(-MONEY.scale)


def largest(negative: Column) -> Column:
    return F.when(negative, F.lit(-LARGEST)).otherwise(F.lit(LARGEST)).cast(MONEY)


def to_money(text: Column) -> Column:
    """Exact amount, null when the text is not a number, +-``LARGEST`` beyond that."""
    too_large = F.when(text.rlike(_NUMBER), largest(text.rlike(r"^\s*-")))
    return F.coalesce(text.try_cast(MONEY), too_large)


def to_quantity(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def cents(amount: Column) -> Column:
    return F.round(amount, 2)


def as_double(amount: Column) -> Column:
    """Sums stay decimal, hence exact, until this last step of a view."""
    return amount.cast("double")


def mean(total: Column, count: Column) -> Column:
    return F.try_divide(as_double(total), count)


def risk_tier(
    total: Column, high: float = HIGH_RISK_USD, medium: float = MEDIUM_RISK_USD
) -> Column:
    return F.when(total >= high, "High").when(total >= medium, "Medium").otherwise("Low")
