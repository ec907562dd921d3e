"""Five raw extracts made from the star-schema tables (see FIXTURES.md, section 2).

Order lines stand in for incident reports. Return flag and line status pick the
source system, and remainders of the order key put dirt into the cells: the
modulo expressions below are that dirt, they select no part of the tables.
"""

from dataclasses import replace
from decimal import Decimal
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultledger.config import Settings
from faultledger.plans.ingest import ingest
from faultledger.plans.store import IncidentStore
from faultledger.sources.contracts import CONTRACTS, Field
from faultledger.sources.extracts import Extract, prepare, quoted
from faultledger.sources.shuffles import released_shuffles

_ORDER = ("order_key", "line_no")

# The engine's own contracts, with the labels that FIXTURES.md uses.
_RELABELLED = {
    "Radius": {"label": "radius"},
    "Fusion": {"label": "fusion", "plant": Field(default="FUSION PLANT")},
    "Vision_OAK": {"label": "vision_a"},
    "Vision_MAS": {"label": "vision_b", "plant": Field(("Plant",), "VISION B PLANT")},
    "OBI": {"label": "obi"},
}
SETTINGS = Settings(
    contracts={
        key: replace(CONTRACTS[key], row_order=_ORDER, **names)
        for key, names in _RELABELLED.items()
    },
    fx_rates={
        "NATION_5": Decimal("0.05"),
        "NATION_6": Decimal("0.05"),
        "NATION_7": Decimal("0.74"),
    },
    # The largest credit of the fixture is about 10,500.
    single_incident_usd=9_000,
)
SOURCES = tuple(sorted(c.label for c in SETTINGS.contracts.values()))

# Raw header -> column of ``raw_lines``, per source.
HEADERS = {
    "Radius": {
        "Report#": "report_no",
        "Plant Name": "plant",
        "Customer": "cust",
        "ReportDate": "d",
        "Reason for Rejection": "t",
        "Value": "credit",
        "Quantity": "qty",
    },
    "Fusion": {
        "Customer": "cust",
        "Create Date": "d",
        "Defect Type Sub Cat": "t",
        "Total Credit Requested": "credit",
        "Total Labels Rejected": "qty",
    },
    "Vision_OAK": {
        "Plant": "plant",
        "Customer Name": "cust",
        "Report Date": "d",
        "Type": "t",
        "Sub-Type": "sub_type",
        "Net Credit $": "credit",
        "Defective Qty": "qty",
    },
    # This export has neither a plant nor a second defect level.
    "Vision_MAS": {
        "Customer Name": "cust",
        "Report Date": "d",
        "Type": "t",
        "Net Credit $": "credit",
        "Defective Qty": "qty",
    },
    # This export has the alternate date header.
    "OBI": {
        "Plant Name": "plant",
        "Customer": "cust",
        "Received Dt": "d",
        "General Category": "t",
        "Specific Category": "b",
        "Feedback Total Credit Requested": "credit",
        "Qty in Question": "qty",
    },
}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all extracts, with the source key of each row; lazy."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    extract = (
        F.when(flag == "R", "Radius")
        .when((flag == "A") & (status == "F"), "Fusion")
        .when((flag == "A") & (status == "O"), "Vision_OAK")
        .when((flag == "N") & (status == "F"), "Vision_MAS")
        .when((flag == "N") & (status == "O"), "OBI")
    )
    credit = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    # Each join may shuffle the lines, so they come with no more than the extracts have of them, as numbers.
    cells = table("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("day"),
        credit.cast("decimal(14,2)").alias("credit"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.array_position(F.lit(list(HEADERS)), extract).cast("tinyint").alias("extract"),
    )
    # The customer comes to the order, so the lines, four times as many, are not shuffled for it. Its name is
    # the widest cell and comes last; the nation comes to the line, so the size of the suppliers is known.
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        cells.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    key = F.col("l_orderkey")
    null = F.lit(None).cast("string")
    plant, customer, defect = F.col("n_name"), F.col("c_name"), F.col("p_type")
    day, credit, quantity = (F.col(name).cast("string") for name in ("day", "credit", "quantity"))
    # Every seventh order is sent a second time, with another quantity.
    file = F.explode(
        F.when(key % 7 == 0, F.array(F.lit("f1"), F.lit("f2"))).otherwise(F.array(F.lit("f1")))
    )
    return lines.select("*", file.alias("file")).select(
        F.when(key % 31 == 0, F.concat(F.lit("  "), plant, F.lit(" ")))
        .when(key % 37 == 0, null)
        .otherwise(plant)
        .alias("plant"),
        F.when(key % 43 == 0, F.lit("   ")).otherwise(customer).alias("cust"),
        F.when(key % 89 == 0, null)
        .when(key % 101 == 0, F.lit("1900-01-01"))
        .when(key % 103 == 0, F.lit("junk"))
        .otherwise(day)
        .alias("d"),
        F.when(key % 41 == 0, null).otherwise(defect).alias("t"),
        F.col("p_brand").alias("b"),
        F.when(key % 47 == 0, null).otherwise(F.col("p_brand")).alias("sub_type"),
        F.when(key % 83 == 0, F.lit("1,500"))
        .when(key % 79 == 0, F.concat(F.lit("-"), credit))
        .when(key % 73 == 0, null)
        .otherwise(credit)
        .alias("credit"),
        F.when(F.col("file") == "f2", F.lit("999"))
        .when(key % 71 == 0, null)
        .otherwise(quantity)
        .alias("qty"),
        F.when(key % 97 != 0, F.concat(F.lit("R"), key.cast("string"))).alias("report_no"),
        F.col("file"),
        key.alias("order_key"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.get(F.lit(list(HEADERS)), F.col("extract") - 1).alias("extract"),
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster names.

    Only a local session, whose one machine is the whole cluster, may do without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/faultledger/{uuid4().hex}"


# Lines are landed in a slice for so many bytes of their table, up to so many slices.
SLICE_BYTES, MOST_SLICES = 64 * 1024 * 1024, 4

# Files that a task may have open at once; one for each source, and one for lines of none.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

_landed: dict[tuple[str | None, str], str] = {}
_loaded: dict[tuple[str | None, str], str] = {}
_summed: dict[tuple[str | None, str], str] = {}


def _once(known: dict, spark: SparkSession, sf_dir: str, build) -> str:
    """The folder that ``build`` filled for these tables, once per process."""
    key = (spark.conf.get("spark.checkpoint.dir", None), sf_dir)
    if key not in known:
        target = shared_dir(spark)
        build(target)
        known[key] = target
    return known[key]


def _slices(lines: DataFrame) -> list[DataFrame]:
    """The rows in a few frames by their orders; the joins of one shuffle no more than its own at a time.

    Each of them reads the tables again, so there are few, however large the tables.
    """
    leaves = lines._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max(leaves.apply(n).stats().sizeInBytes() for n in range(leaves.size()))
    count = min(MOST_SLICES, size // SLICE_BYTES + 1) if lines.inputFiles() else 1
    whose = F.pmod(F.xxhash64("order_key"), F.lit(count)) if count > 1 else F.lit(0)
    return [lines.where(whose == n) for n in range(count)]


def landing(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the extracts, one directory per source.

    They are written once, as exports would be: the five sources then read
    their own files, where five filters on one lazy join would run it five times.
    """

    def build(target: str) -> None:
        # A task keeps a file open for each source, where it would otherwise sort all its rows by source.
        before = spark.conf.get(_WRITERS, None)
        spark.conf.set(_WRITERS, str(len(HEADERS) + 1))
        try:
            with released_shuffles(spark):
                for lines in _slices(raw_lines(spark, sf_dir)):
                    lines.write.mode("append").partitionBy("extract").parquet(target, compression="zstd")
        finally:
            spark.conf.unset(_WRITERS) if before is None else spark.conf.set(_WRITERS, before)

    return _once(_landed, spark, sf_dir, build)


def header_columns(key: str):
    """The landed columns of a source under its own headers."""
    named = [F.col(column).alias(header) for header, column in HEADERS[key].items()]
    return [*named, *_ORDER]


def extracts(spark: SparkSession, sf_dir: str, condition=None, change=None) -> dict[str, Extract]:
    """The five raw extracts, optionally only the rows that meet a condition, or with changed cells."""
    landed = spark.read.parquet(landing(spark, sf_dir))
    if change is not None:
        landed = change(landed)
    if condition is not None:
        landed = landed.where(condition)
    found = {}
    for key, contract in SETTINGS.contracts.items():
        # The source is the partition of the folder, so only its files are read.
        frame = landed.where(F.col("extract") == key).select(*header_columns(key), F.col("file").alias("_file"))
        found[key] = Extract(prepare(frame, contract), quoted("_file"))
    return found


def store(spark: SparkSession, sf_dir: str) -> IncidentStore:
    """A store into which one run has loaded the extracts of these tables."""

    def build(target: str) -> None:
        fresh = IncidentStore(spark, target).create(SETTINGS)
        ingest(fresh, extracts(spark, sf_dir), "run-1", SETTINGS)

    return IncidentStore(spark, _once(_loaded, spark, sf_dir, build))


def summed_store(spark: SparkSession, sf_dir: str) -> IncidentStore:
    """A store that keeps sums, loaded in two runs: two sources, then all; compacted in between."""

    def build(target: str) -> None:
        fresh = IncidentStore(spark, target).create(SETTINGS)
        every = extracts(spark, sf_dir)
        ingest(fresh, dict(list(every.items())[:2]), "batch-1", SETTINGS)
        fresh.start_sums()
        fresh.compact()
        ingest(fresh, every, "batch-2", SETTINGS)

    return IncidentStore(spark, _once(_summed, spark, sf_dir, build))


def new_store(spark: SparkSession) -> IncidentStore:
    return IncidentStore(spark, shared_dir(spark)).create(SETTINGS)
