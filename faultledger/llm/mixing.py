"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a fixed hash. A source takes all its documents as often as its
target holds its size, and for the rest of the target those documents whose hash is
at most a threshold. The threshold is found without sorting: a histogram sums the
words by source and hash bucket, running sums give the bucket in which the budget
runs out, and only the documents of that bucket go into the next, finer histogram.
After the last digit of the hash the boundary holds equal hashes only, of rows with
one id and text. As many of them are taken as bring the source nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultledger.llm.shared import broadcast_if_small, checkpoint, quoted

#: Hexadecimal digits of the hash, and those that one histogram resolves.
DIGITS = 12
STEP = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, so no source can have a larger share.
MOST = 3
#: Sources up to which their budgets are broadcast (some 100 bytes each).
FEW_SOURCES = 10_000
#: Salts of a source's name beyond that.
SALTS = 64


def size_of(text: Column) -> Column:
    """Words of a text, split at ASCII white space; 0 for null."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def hash_of(key: Column, text: Column) -> Column:
    """48 bits of a hash that other engines have too, of a row's id and whole text; null is empty."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources by code point, null last, have the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size and the excess is
    shared out again by weight. The end of that has all open targets in proportion
    to their weights, so with the sources in order of size per weight the closed
    ones come first: the first source whose share of what is left fits is open, and
    so are all after it. A list of sources is all that is sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (place + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = ranked.select("source", "source_size", "weight", rest.alias("rest"), weight_left.alias("left"))
    # open where (rest * weight / left) <= most * source_size, in whole numbers of any length
    wide = "decimal(38,0)"
    fits = F.col("rest").cast(wide) * F.col("weight") <= F.col("source_size").cast(wide) * F.col("left") * most
    level = F.first(F.when(fits, F.struct("rest", "left")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = (level["rest"] * F.col("weight")).cast("double") / level["left"].cast("double")
    capped = (F.col("source_size") * most).cast("double")
    return filled.select("source", "source_size", F.coalesce(F.when(level.isNotNull(), share), capped).alias("target"))


def _with_budgets(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Documents joined with their source's budget: broadcast if the sources are few, else on a salted name."""
    small = broadcast_if_small(budgets, FEW_SOURCES)
    same = F.col("source").eqNullSafe(F.col("of"))
    if small is not budgets:
        return docs.join(small.withColumnRenamed("source", "of"), same).drop("of")
    salted = budgets.withColumnRenamed("source", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("doc_salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    return docs.join(salted, same & (F.col("doc_salt") == F.col("salt"))).drop("of", "salt", "doc_salt")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, full, threshold, edge, more: take all documents ``full`` times, and once more where h <= threshold.

    Where rows with one hash can't all be taken, ``edge`` is that hash and ``more`` of
    its rows are taken once more; otherwise both are null. ``sized`` has source, size, h; ``budgets`` source, source_size, target.
    """
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("bigint")
    state = budgets.select("source", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("budget"))
    # prefix: the digits of the boundary found so far; used: words below the boundary
    state = checkpoint(state.select("source", "full", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("used")))
    for level in range(1, DIGITS // STEP + 1):
        shift = 4 * (DIGITS - STEP * level)
        boundary = _with_budgets(sized, state.where("prefix is not null").select("source", "prefix"))
        boundary = boundary.where(F.shiftright("h", shift + 4 * STEP) == F.col("prefix"))
        histogram = boundary.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        sums = histogram.select("source", "bucket", "words", "rows", running.alias("through"))
        joined = sums.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        over = joined.where(F.col("used") + F.col("through") > F.col("budget"))
        nearest = over.groupBy("source").agg(F.min(F.struct("bucket", "words", "rows", "through")).alias("b"))
        found = nearest.select(F.col("source").alias("of"), F.col("b.bucket").alias("bucket"), (F.col("b.through") - F.col("b.words")).alias("below"), F.col("b.words").alias("last"), F.col("b.rows").alias("rows"))
        met = state.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        state = checkpoint(
            met.select(
                "source",
                "full",
                "budget",
                F.col("bucket").alias("prefix"),
                (F.col("used") + F.coalesce("below", F.lit(0))).alias("used"),
                "last",
                "rows",
            )
        )
        if level < DIGITS // STEP:
            state = state.drop("last", "rows")
    nearest = F.ceil((F.col("budget") - F.col("used")) * F.col("rows") / F.col("last") - 0.5)
    more = F.greatest(F.lit(0), F.least(nearest, "rows")).cast("bigint")
    # no boundary: the budget is never exceeded, which takes everything
    threshold = F.when(F.col("prefix").isNull(), F.lit(2 ** (4 * DIGITS))).when(more == F.col("rows"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    parted = (more > 0) & (more < F.col("rows"))
    return state.select("source", "full", threshold.alias("threshold"), F.when(parted, F.col("prefix")).alias("edge"), F.when(parted, more).alias("more"))


def _with_times(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (source, h and others) with the columns of ``limits`` and ``times``, how often each is taken.

    Of rows at an edge, which are equal, the first ``more`` are taken once more. They
    are written with a number that rises within a partition; a place is the rows of
    the partitions before and the place in its own, so no task sees all of them.
    """
    met = _with_budgets(rows, limits)
    plain = met.withColumn("times", F.col("full") + (F.col("h") <= F.col("threshold")).cast("bigint"))
    if limits.where("edge is not null").isEmpty():
        return plain
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    number = F.monotonically_increasing_id()
    edge = checkpoint(met.where(at_edge).withColumn("number", number)).withColumn("part", F.shiftright("number", 33))
    counts = edge.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy("number"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    placed = edge.withColumn("own", own).join(offsets, same)
    once_more = (F.col("before") + F.col("own") <= F.col("more")).cast("bigint")
    parted = placed.withColumn("times", F.col("full") + once_more).select(*plain.columns)
    return plain.where(~at_edge).unionByName(parted)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, size, source_size, target, taken of every row of ``docs``.

    ``taken`` is a whole number of times the document's size, at most three. A null
    source is a source; a null text has size 0; a source without words has target 0.
    Hashes are of id and text, so rows that share an id, or have none, are told apart
    by their texts, and of equal rows as many are taken as the target asks for.
    Reruns agree. An empty table gives an empty result.
    """
    h = hash_of(quoted(key), quoted(text))
    sized = checkpoint(docs.select(quoted(key).alias("key"), quoted(source).alias("source"), size_of(quoted(text)).alias("size"), h.alias("h")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = checkpoint(targets(sizes, weights))
    limits = thresholds(sized, budgets).withColumnRenamed("source", "of")
    plan = checkpoint(budgets.join(limits, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    met = _with_times(sized, plan)
    return met.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    A row without words is never taken: it adds nothing to any target. Of rows that
    differ only in columns other than id and text, which ones are taken is open.
    """
    h = hash_of(quoted(key), quoted(text)).alias("h")
    sized = checkpoint(docs.select(quoted(source).alias("source"), size_of(quoted(text)).alias("size"), h))
    budgets = checkpoint(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    limits = checkpoint(thresholds(sized, budgets))
    packed = docs.select(quoted(source).alias("source"), h, F.struct(*(quoted(c) for c in docs.columns)).alias("row"), size_of(quoted(text)).alias("size"))
    copies = F.when(F.col("size") > 0, F.col("times")).otherwise(0).cast("int")
    times = _with_times(packed, limits).select("row", F.explode(F.array_repeat(F.lit(True), copies)).alias("taken"))
    return times.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
