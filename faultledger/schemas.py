"""Column types of the unified frame and of the stored tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 6)
# A rate keeps nine places; credit * rate then has 32 digits before the point and 6 after it.
RATE = T.DecimalType(18, 9)

UNIFIED = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("plant", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("incident_date", T.DateType()),
        T.StructField("defect_category", T.StringType()),
        T.StructField("credit_requested_usd", MONEY),
        T.StructField("qty_affected", T.DoubleType()),
        T.StructField("raw_source_file", T.StringType()),
        T.StructField("pipeline_run_id", T.StringType()),
    ]
)

# Position of a row within its extract: the part file, and where it stands there.
ROW_ORDER = T.StructField(
    "row_order",
    T.StructType(
        [T.StructField("part", T.StringType()), T.StructField("at", T.ArrayType(T.LongType()))]
    ),
)

# Marks of a staged row that does not fit: the reason, and the row as it stands in its file.
REJECT = (
    T.StructField("reject_reason", T.StringType()),
    T.StructField("reject_line", T.StringType()),
)
REJECTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("raw_source_file", T.StringType()),
        T.StructField("row_order", ROW_ORDER.dataType),
        T.StructField("reason", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# Entries of a watched folder, in the states in which they were read.
ARRIVALS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("failure", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# The fact table is partitioned by month, so that date filters, the rolling
# risk window and the duplicate check read only the months they need.
MONTH = "incident_month"
FACT = T.StructType(
    UNIFIED.fields
    + [
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField(MONTH, T.StringType()),
    ]
)

DIM_PLANT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("plant_name", "region", "country", "erp_system", "currency")
    ]
)

DIM_CUSTOMER = T.StructType(
    [
        T.StructField("customer_name", T.StringType()),
        T.StructField("risk_tier", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# What each load has added per customer and day; ``load`` orders the loads.
CUSTOMER_DAYS = T.StructType(
    [
        T.StructField("customer", T.StringType()),
        T.StructField("incident_date", T.DateType()),
        T.StructField("credit_usd", T.DecimalType(38, 6)),
        T.StructField("load", T.LongType()),
        T.StructField("loaded", T.LongType()),
    ]
)

# What each load has added per grouping set and key; ``through`` is the time of the load.
INCIDENT_SUMS = T.StructType(
    [
        T.StructField("gid", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("plant", T.StringType()),
        T.StructField("defect_category", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("quarter", T.DateType()),
        T.StructField("incidents", T.LongType()),
        T.StructField("credit_usd", T.DecimalType(38, 6)),
        T.StructField("max_credit_usd", MONEY),
        T.StructField("earliest_date", T.DateType()),
        T.StructField("latest_date", T.DateType()),
        T.StructField("through", T.LongType()),
        T.StructField("loaded", T.LongType()),
    ]
)

# Sketches of the distinct names that each load has added to a month.
MONTH_SKETCHES = T.StructType(
    [
        T.StructField(MONTH, T.StringType()),
        T.StructField("customers", T.BinaryType()),
        T.StructField("plants", T.BinaryType()),
        T.StructField("loaded", T.LongType()),
    ]
)

# Up to which load, and for which window and limits, the tiers are made.
TIER_RUNS = T.StructType(
    [
        T.StructField("window_start", T.DateType()),
        T.StructField("high_risk_usd", T.LongType()),
        T.StructField("medium_risk_usd", T.LongType()),
        T.StructField("through_load", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("run_id", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("sources_detected", T.StringType()),
        T.StructField("sources_loaded", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("credit_requested_usd", MONEY),
        T.StructField("plant", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("defect_category", T.StringType()),
        T.StructField("incident_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# Two incidents are the same when these agree, with the credit taken in cents.
KEY_COLUMNS = ("source", "plant", "customer", "incident_date", "defect_category")
