"""Extracts and incidents as they arrive."""

import json
from collections.abc import Callable, Iterable, Mapping
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultledger.config import Settings
from faultledger.functions.money import as_double
from faultledger.operators.cleaning import validate
from faultledger.operators.mapping import normalize
from faultledger.operators.ranking import credit_sum, incident_count
from faultledger.plans.alerting import alert_rows
from faultledger.plans.store import IncidentStore
from faultledger.schemas import FACT, ROW_ORDER
from faultledger.sources.contracts import Contract
from faultledger.sources.extracts import (
    CORRUPT,
    TOO_WIDE,
    Extract,
    beyond,
    exact,
    marked,
    position,
    prepare,
    split_start,
)


def read_extract_stream(
    spark: SparkSession,
    path: str,
    contract: Contract,
    headers: Iterable[str] | None = None,
    fmt: str = "csv",
    name_pattern: str | None = None,
    max_files_per_trigger: int | None = None,
    multi_line: bool | None = None,
) -> Extract:
    """New files of one source, all columns as text.

    A stream needs its columns declared; ``headers`` are those the files have,
    by default all that the contract knows. A file is read once, by its path,
    so each drop needs a new name. Quoted line breaks are taken as possible unless
    ``multi_line`` (``Settings.csv_multi_line``) says that there are none.
    """
    names = list(headers or contract.headers())
    marks = [CORRUPT] if fmt == "csv" else []
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*names, *marks]])
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        # enforceSchema=False makes a file with other headers an error, where
        # Spark would otherwise read its columns by position.
        reader = reader.options(
            header=True, multiLine=multi_line is not False, quote='"', escape='"', enforceSchema=False
        ).option("columnNameOfCorruptRecord", CORRUPT)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    file = F.col("_metadata.file_path").alias("_file")
    # the order within a split is added where the batch arrives
    place = position(split_start())
    frame = reader.format(fmt).load(path).select("*", file, place)
    if marks:
        frame = marked(frame, TOO_WIDE, beyond(names)).drop(CORRUPT)
    return Extract(prepare(frame, contract), F.col("_file"))


def incident_stream(
    spark: SparkSession, extracts: Mapping[str, Extract], run_id: str, settings: Settings
) -> DataFrame:
    """Cleaned incidents of all sources as one stream, by the same steps as a batch."""
    unified = normalize(
        spark, extracts, run_id, settings.contracts, settings.fx_rates, settings.strict_nulls, True
    )
    return validate(unified)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a streaming query, which lives in its checkpoint and is in no other."""
    return json.loads(spark.read.text(f"{exact(checkpoint)}/metadata").first()["value"])["id"]


def load_batch(
    store: IncidentStore,
    settings: Settings,
    run_id: str,
    checkpoint: str | None = None,
    as_of: date | None = None,
) -> Callable[[DataFrame, int], None]:
    """The function that runs one micro-batch: load, re-tier, log and alert, as a batch run does.

    A run is named by ``run_id``, the query's id and the number of the batch. A batch
    that is replayed after a failure inserts nothing twice, since the rows are then
    in the history, and it replaces its own alerts, never those of another query.
    """
    name: list[str] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        if not name:
            name.append(f"{run_id}-{query_id(store.spark, checkpoint)}" if checkpoint else run_id)
        batch_run = f"{name[0]}-{batch_id}"
        started_at = datetime.now(timezone.utc)
        arrived = batch.withColumn("pipeline_run_id", F.lit(batch_run))
        if ROW_ORDER.name in batch.columns:
            at = F.concat(f"{ROW_ORDER.name}.at", F.array(F.monotonically_increasing_id()))
            placed = F.struct(F.col(f"{ROW_ORDER.name}.part").alias("part"), at.alias("at"))
            arrived = arrived.withColumn(ROW_ORDER.name, placed)
        staged, facts = store.stage(arrived, batch_run)
        staged = store.set_aside(staged, facts, batch_run)
        if facts.rows:
            sources = [r["source"] for r in staged.select("source").distinct().collect()]
            # the labels of the contracts, however many rows there are
            failed = store.try_load(
                staged, batch_run, started_at, sorted(sources), settings=settings, as_of=as_of, facts=facts
            )[1]
            if failed:
                raise RuntimeError(f"batch {batch_run} failed: {failed}")
            new_only = settings.alert_on_new_rows_only
            alert_on = store.rows_of_run(batch_run, facts) if new_only else staged
            store.write_alerts(alert_rows(alert_on, settings.single_incident_usd), batch_run)
        store.unstage(batch_run)

    return load


def start_ingest(
    incidents: DataFrame,
    store: IncidentStore,
    checkpoint: str,
    run_id: str,
    settings: Settings | None = None,
    as_of: date | None = None,
) -> StreamingQuery:
    """Load what has arrived since the last start, then stop."""
    load = load_batch(store, settings or Settings(), run_id, checkpoint, as_of)
    return (
        incidents.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_incidents(store: IncidentStore) -> DataFrame:
    """The rows that loads add to the fact table, as a stream with an ``event_time``: each incident once."""
    rows = store.spark.readStream.schema(FACT).parquet(store.path("quality_incidents"))
    return rows.withColumn("event_time", F.col("incident_date").cast("timestamp"))


def weekly_totals(incidents: DataFrame, watermark: str | None = None) -> DataFrame:
    """Count and sum per week, from Monday in UTC, over a stream with an ``event_time``.

    The state is one row per week. Without a watermark every week is open, for
    complete output; with one, later rows are dropped and closed weeks come out
    in append output.
    """
    if watermark:
        incidents = incidents.withWatermark("event_time", watermark)
    # Windows are counted from 1970-01-01, a Thursday; four days later is a Monday.
    week = F.window("event_time", "7 days", "7 days", "4 days")
    return (
        incidents.groupBy(week.alias("week"))
        .agg(incident_count(), credit_sum())
        .select(
            F.col("week.start").alias("week_start"),
            "incidents",
            as_double(F.col("credit_usd")).alias("credit_usd"),
        )
    )


def land_complete(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current totals at a path; each trigger replaces them."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_closed(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the weeks that the watermark has closed."""
    return (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def land_changes(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the weeks whose totals have changed, as a version of their own per trigger.

    So a late row corrects its week, and weeks without news are not written again. A
    trigger that is replayed replaces its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_weeks(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each week that ``land_changes`` has written."""
    versions = spark.read.parquet(path)
    rest = [c for c in versions.columns if c not in ("week_start", "version")]
    newest = F.max_by(F.struct(*rest), "version").alias("newest")
    return versions.groupBy("week_start").agg(newest).select("week_start", "newest.*")
