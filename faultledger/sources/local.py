from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_frame(spark: SparkSession, rows: Iterable[tuple], schema: StructType) -> DataFrame:
    """A frame of a few rows that the driver knows, such as settings or a log row.

    Sent as Arrow it is a local relation of known size, which Spark can
    broadcast, and no Python worker takes part.
    """
    rows = list(rows)
    fields = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, schema=fields), schema)
