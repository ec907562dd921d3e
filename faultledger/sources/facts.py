"""The fact rows that views start from."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from faultledger.schemas import FACT
from faultledger.sources.local import small_frame


def read_or_none(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at a path, or None where there is nothing."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def load_incidents(
    spark: SparkSession, fact_path: str, snapshot_path: str | None = None
) -> DataFrame:
    """The fact table; a Parquet snapshot where it is absent or has no rows."""
    fact = read_or_none(spark, fact_path, FACT)
    if fact is not None and not fact.isEmpty():
        return fact
    snapshot = read_or_none(spark, snapshot_path) if snapshot_path else None
    if snapshot is not None:
        return snapshot
    return fact if fact is not None else small_frame(spark, [], FACT)
