"""Which extract of each source is the newest."""

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultledger.sources.extracts import exact

log = logging.getLogger(__name__)


def name_regex(pattern: str) -> str:
    """A file name pattern (``*``, ``?``, ``[a-z]``) as a regular expression."""
    out, rest = "", pattern
    while rest:
        group = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if group:
            inner = group[2].replace("\\", r"\\").replace("[", r"\[")
            out += f"[{'^' if group[1] else ''}{inner}]"
            rest = rest[group.end():]
            continue
        out += {"*": ".*", "?": "."}.get(rest[0], re.escape(rest[0]))
        rest = rest[1:]
    return f"(?s)^{out}$"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as file listings give it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString().rstrip("/")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Path, name and modification time of the entries of a directory; contents are not read.

    A folder of part files is one entry, as new as its newest file.
    """
    root = f"{qualified(spark, directory)}/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(exact(directory))
    name = F.substring_index(F.substring("path", len(root) + 1, 2**31 - 1), "/", 1)
    return (
        found.select(name.alias("name"), "modificationTime")
        .groupBy("name")
        .agg(F.max("modificationTime").alias("modificationTime"))
        .withColumn("path", F.concat(F.lit(root), "name"))
    )


def newest_files(
    spark: SparkSession, directory: str, patterns: Mapping[str, str | Sequence[str]]
) -> DataFrame:
    """(source, path): the file of the first listed pattern that matches anything, newest first.

    The directory is listed once for all sources.
    """
    ranked = [
        F.when(
            F.col("name").rlike(name_regex(pattern)),
            F.struct(F.lit(key).alias("source"), F.lit(-rank).alias("preference")),
        )
        for key, choices in patterns.items()
        for rank, pattern in enumerate([choices] if isinstance(choices, str) else choices)
    ]
    return (
        list_files(spark, directory)
        .select("path", "modificationTime", F.inline(F.array_compact(F.array(*ranked))))
        .groupBy("source")
        .agg(F.max(F.struct("preference", "modificationTime", "path")).alias("newest"))
        .select("source", "newest.path")
    )


def detect_source_files(
    spark: SparkSession, directory: str, patterns: Mapping[str, str | Sequence[str]]
) -> dict[str, str | None]:
    """One entry per source, in the order of ``patterns``; None where nothing matches."""
    try:
        found = {r["source"]: r["path"] for r in newest_files(spark, directory, patterns).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = {}
    for key in patterns:
        log.info("%s: %s", key, found.get(key, "no file"))
    return {key: found.get(key) for key in patterns}


def find_latest_file(spark: SparkSession, directory: str, pattern: str) -> str | None:
    return detect_source_files(spark, directory, {"file": pattern})["file"]
