from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.functions.money import LARGEST, largest
from faultledger.schemas import MONEY, RATE
from faultledger.sources.local import small_frame

# Beyond this many plants the rate table is joined without a broadcast hint.
BROADCAST_RATES = 100_000

_RATES = T.StructType([T.StructField("plant", T.StringType()), T.StructField("rate", RATE)])


def convert_to_usd(
    spark: SparkSession, incidents: DataFrame, rates: Mapping[str, Decimal | float | str]
) -> DataFrame:
    """Multiply each credit by the rate of its plant; plants without a rate count as 1.

    An amount beyond the type, or that was beyond it, is the largest amount that it holds.
    """
    if not rates:
        return incidents
    table = small_frame(spark, [(p, Decimal(str(r))) for p, r in rates.items()], _RATES)
    if len(rates) <= BROADCAST_RATES:
        table = F.broadcast(table)
    rate = F.coalesce("rate", F.lit(1).cast(RATE))
    credit = F.col("credit_requested_usd")
    too_large = F.when(credit.isNotNull(), largest(credit < 0))
    product = F.when(F.abs(credit) < LARGEST, (credit * rate).try_cast(MONEY))
    return (
        incidents.join(table, "plant", "left")
        .withColumn("credit_requested_usd", F.coalesce(product, too_large))
        .select(*incidents.columns)
    )
