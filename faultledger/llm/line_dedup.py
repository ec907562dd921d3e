"""Line deduplication by site-relative frequency, in DataFrame operations only.

A line that stands on a large share of one host's pages is boilerplate of that host.
Pages containing each line are counted by host and divided by the host's pages;
lines beyond the ratio are dropped from that host's pages. Only hashes of lines are
shuffled, combined before the shuffle; texts stay where they are as long as the
boilerplate of all hosts is small enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.llm.shared import checkpoint, quoted

#: Boilerplate lines (8 bytes each) and hosts up to which they are broadcast.
FEW_LINES = 500_000
FEW_HOSTS = 50_000
#: Salts of a host's name beyond that.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, text: str, host: str, ratio: float, min_pages: int) -> DataFrame:
    """host, drop: hashes of the lines that stand on more than ``ratio`` of the host's pages."""
    hashes = F.transform(F.filter(F.transform(_lines(quoted(text)), _bare), lambda line: line != ""), lambda line: F.xxhash64(line))
    pages = docs.select(quoted(host).alias("host"), F.explode(F.array_distinct(hashes)).alias("line"))
    counts = pages.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(quoted(host).alias("of")).agg(F.count(F.lit(1)).alias("total"))
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > F.col("total") * ratio)
    # at most (lines of a page on average) / ratio lines of a host can be so frequent
    return checkpoint(often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop")))


def drop_lines(
    docs: DataFrame, text: str = "text", host: str = "host", ratio: float = 0.1, min_pages: int = 5, lines: str | None = None, dropped: str | None = None
) -> DataFrame:
    """``docs`` without the boilerplate lines of each host; ``lines`` and ``dropped`` name columns of counts to add.

    Lines are compared without blanks at their ends; blank lines are no lines. A
    line must stand on at least ``min_pages`` pages and on more than ``ratio`` of
    the host's pages; several times on a page count once, repeated rows are pages
    each. A page of which no other line would be left is a copy, not boilerplate,
    and stays whole. A null host is a host; null and empty texts stay as they are.
    """
    found = boilerplate(docs, text, host, ratio, min_pages)
    size = found.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("lines")).first()
    packed = docs.select(quoted(host).alias("host"), F.struct(*(quoted(c) for c in docs.columns)).alias("row"), quoted(text).alias("text"))
    marked = found.select(F.col("host").alias("of"), "drop")
    same = F.col("host").eqNullSafe(F.col("of"))
    if size["hosts"] <= FEW_HOSTS and size["lines"] <= FEW_LINES:
        joined = packed.join(F.broadcast(marked), same, "left")
    else:
        marked = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        packed = packed.withColumn("page_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = packed.join(marked, same & (F.col("page_salt") == F.col("salt")), "left")
    every = F.coalesce(_lines(F.col("text")), F.array().cast("array<string>"))
    real = F.filter(every, lambda line: _bare(line) != "")
    kept = F.filter(every, lambda line: ~F.array_contains("drop", F.xxhash64(_bare(line))) | (_bare(line) == ""))
    some = F.exists(kept, lambda line: _bare(line) != "")
    changed = F.col("drop").isNotNull() & (F.size(kept) < F.size(every)) & some
    counted = joined.select(
        "row",
        F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        F.size(real).cast("bigint").alias("lines"),
        F.when(changed, F.size(every) - F.size(kept)).otherwise(0).cast("bigint").alias("dropped"),
    )
    own = [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in {(lines or "").lower(), (dropped or "").lower()}]
    extra = [F.col(name).alias(wish) for name, wish in (("lines", lines), ("dropped", dropped)) if wish]
    return counted.select(*own, *extra)
