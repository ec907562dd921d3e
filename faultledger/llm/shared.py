"""Helpers that several operators use."""

from __future__ import annotations

from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only a local session, whose one machine is the whole cluster, may do without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return mkdtemp(prefix="run-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    A checkpointed frame keeps what the optimizer knows of its columns, which grows
    from round to round in a loop; a table that is read again knows nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if it was counted and has at most ``rows`` narrow rows.

    Beyond that the join shuffles, and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column of ``df`` is called so."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    mine = {name.lower() for name in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in mine))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in fields)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
