"""One ingestion run: detect, read, map, clean, load, alert, report."""

import logging
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession

from faultledger.config import Settings
from faultledger.operators.cleaning import validate, value_counts
from faultledger.operators.mapping import DateRule, normalize
from faultledger.plans.alerting import alert_rows
from faultledger.plans.report import write_report
from faultledger.plans.store import BatchFacts, IncidentStore
from faultledger.sources.detect import detect_source_files
from faultledger.sources.extracts import Extract, read_extracts
from faultledger.sources.shuffles import released_shuffles

log = logging.getLogger(__name__)

# Sources that are staged at the same time.
SOURCES_AT_ONCE = 8


@dataclass(frozen=True)
class RunResult:
    run_id: str
    inserted: int
    counts: Mapping[str, int]
    report: str = ""
    # Sources that could not be read, with the reason; the others were loaded.
    failures: Mapping[str, str] = field(default_factory=dict)
    status: str = "SUCCESS"


def clean_batch(
    spark: SparkSession, extracts: Mapping[str, Extract], run_id: str, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """(unified, cleaned) rows; nothing is computed yet."""
    unified = normalize(
        spark, extracts, run_id, settings.contracts, settings.fx_rates, settings.strict_nulls
    )
    return unified, validate(unified)


@dataclass(frozen=True)
class _Staged:
    batch: DataFrame
    facts: BatchFacts
    counts: Mapping[str, int]
    folder: str


def _stage(
    store: IncidentStore, extracts: Mapping[str, Extract], run_id: str, settings: Settings, folder: str
) -> _Staged:
    counted, dates = Observation(), DateRule()
    unified = normalize(
        store.spark, extracts, run_id, settings.contracts, settings.fx_rates, settings.strict_nulls, True, dates
    )
    batch, facts = store.stage(validate(unified.observe(counted, *value_counts())), folder)
    # rows that do not fit have no date; they are counted by themselves
    counts = {**dates.counts(), **counted.get}
    for name in ("total_rows", "dropped_no_date"):
        counts[name] -= facts.rejected
    return _Staged(batch, facts, {**counts, "rejected_rows": facts.rejected}, folder)


def _stage_sources(
    store: IncidentStore, extracts: Mapping[str, Extract], run_id: str, settings: Settings
) -> tuple[list[_Staged], dict[str, str]]:
    """Each source in a job of its own, several at once; those that fail are left out.

    No source is parsed again because another one is broken, and the executors that
    a small source leaves idle work on the next.
    """

    context = store.spark.sparkContext

    def one(key: str) -> _Staged | str:
        # names the jobs of a source and, with the FAIR scheduler, gives each source its share
        context.setLocalProperty("spark.job.description", f"stage {key}")
        context.setLocalProperty("spark.scheduler.pool", key)
        folder = f"{run_id}-{key}"
        try:
            return _stage(store, {key: extracts[key]}, run_id, settings, folder)
        except Exception as error:  # noqa: BLE001 - a page or row of one source can break in many ways
            log.error("cannot read source %s: %s", key, error)
            store.unstage(folder)
            return str(error)

    with ThreadPoolExecutor(max(1, min(len(extracts), SOURCES_AT_ONCE))) as pool:
        # wrapped for each source: the properties of a wrapper are shared by its threads
        jobs = {key: pool.submit(inheritable_thread_target(store.spark)(one), key) for key in extracts}
        done = {key: job.result() for key, job in jobs.items()}
    failures = {key: found for key, found in done.items() if isinstance(found, str)}
    return [found for found in done.values() if not isinstance(found, str)], failures


def ingest(
    store: IncidentStore,
    extracts: Mapping[str, Extract],
    run_id: str,
    settings: Settings | None = None,
    detected: Mapping[str, str | None] | None = None,
    as_of: date | None = None,
) -> RunResult | None:
    """Load a set of extracts into the store; None if no valid row is left.

    The extracts are parsed once, into a staged batch; the counts of the rules
    come from that pass, and the load and the alerts read the staged rows. Rows
    that do not fit their header go to the table of rejects, the others are loaded. A
    source that breaks while it is read is left out and named in the run log.
    """
    settings = settings or Settings()
    started_at = datetime.now(timezone.utc)
    names = [k for k, path in detected.items() if path] if detected else list(extracts)
    staged, failures = _stage_sources(store, extracts, run_id, settings)
    note = "; ".join(f"{key}: {reason.splitlines()[0][:300]}" for key, reason in failures.items())
    if not staged:
        store.log_run(run_id, started_at, datetime.now(timezone.utc), "FAILED", 0, names, [], note)
        return RunResult(run_id, 0, {}, failures=failures, status="FAILED")
    batch = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.batch for s in staged))
    facts = reduce(lambda a, b: a + b, (s.facts for s in staged))
    counts = {name: sum(s.counts[name] for s in staged) for name in staged[0].counts}
    batch = store.set_aside(batch, facts, run_id)
    if facts.rows == 0:
        log.error("no valid rows after cleaning")
        for one in staged:
            store.unstage(one.folder)
        return None
    loaded = [key for key in extracts if key not in failures]
    inserted, failed = store.try_load(
        batch, run_id, started_at, names, loaded, settings, as_of, facts, note
    )
    alert_on = store.rows_of_run(run_id, facts) if settings.alert_on_new_rows_only else batch
    store.write_alerts(alert_rows(alert_on, settings.single_incident_usd), run_id)
    for one in staged:
        store.unstage(one.folder)
    status = "FAILED" if failed else "SUCCESS"
    return RunResult(run_id, inserted, counts, failures=failures, status=status)


def run_pipeline(
    spark: SparkSession,
    data_dir: str,
    root: str,
    settings: Settings | None = None,
    report_only: bool = False,
    run_id: str | None = None,
    as_of: date | None = None,
    report_format: str = "parquet",
) -> RunResult | None:
    """The whole run over a directory of extracts; None where there is nothing to load."""
    with released_shuffles(spark):
        return _run_pipeline(spark, data_dir, root, settings, report_only, run_id, as_of, report_format)


def _run_pipeline(
    spark: SparkSession,
    data_dir: str,
    root: str,
    settings: Settings | None,
    report_only: bool,
    run_id: str | None,
    as_of: date | None,
    report_format: str,
) -> RunResult | None:
    settings = settings or Settings()
    run_id = run_id or str(uuid4())
    store = IncidentStore(spark, root).create(settings)
    if settings.keep_sums:
        store.start_sums()
    result = None
    failures: Mapping[str, str] = {}
    if not report_only:
        detected = detect_source_files(spark, data_dir, settings.source_patterns)
        if not any(detected.values()):
            log.error("no extract found in %s", data_dir)
            return None
        extracts, failures = read_extracts(
            spark, detected, settings.contracts, settings.csv_multi_line
        )
        if not extracts:
            log.error("no extract could be read")
            return None
        result = ingest(store, extracts, run_id, settings, detected, as_of)
        if result is None or result.status == "FAILED" and not result.counts:
            return result and replace(result, failures={**failures, **result.failures})
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M")
    kept = store.incident_sums() if store.has_sums() else None
    report = write_report(
        store.incidents(), store.path("report"), run_id, now, report_format, kept, settings.report_copies_raw
    )
    return RunResult(
        run_id,
        result.inserted if result else 0,
        result.counts if result else {},
        report,
        {**failures, **(result.failures if result else {})},
        result.status if result else "SUCCESS",
    )
