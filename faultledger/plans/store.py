"""The stored tables.

All tables are append-only Parquet. "Replace by key" is an append, and the
current state is a view that takes the latest row per key, so no job reads and
overwrites one path. ``compact`` writes the current state of such a table into a
new generation, a folder that is published by one rename. Where a committer renames atomically, a failed job leaves
nothing half written; on an object store use a committer made for it.
"""

import logging
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from threading import Event, Thread
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger import schemas
from faultledger.config import Settings
from faultledger.functions.dates import month_label
from faultledger.operators.cleaning import is_rejected
from faultledger.operators.dedup import first_per_incident, has_whole_key, not_in_history
from faultledger.functions.money import risk_tier
from faultledger.operators.filters import in_dates
from faultledger.plans import sums
from faultledger.schemas import FACT, KEY_COLUMNS, MONTH
from faultledger.sources.local import small_frame
from faultledger.sources.shuffles import released_shuffles

log = logging.getLogger(__name__)

# A batch whose keys are known to be smaller than this is broadcast to the history.
BROADCAST_KEY_BYTES = 64 * 1024 * 1024
# Per key: the date, the amount and the row itself, on top of the texts.
_KEY_OVERHEAD_BYTES = 128

# Codec of the files that grow with the loads.
CODEC = "zstd"

# How long a load waits for another one on the same store, how often that one renews
# its mark, and after how long without that it counts as dead.
LEASE_WAIT_SECONDS = 600
LEASE_RENEW_SECONDS = 30
LEASE_STALE_SECONDS = 900


_MARK = T.StructType([T.StructField("month", T.StringType())])
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(at: datetime) -> int:
    return (at.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


class StoreBusy(RuntimeError):
    """Another load has held the store for longer than this one would wait."""


# Tables that are compacted, and the generations that stay for readers that have begun.
COMPACTED = ("dim_customer", "pipeline_run_log", "tier_runs", "customer_days", "incident_sums")
# Those of them whose folder has a part for each load.
_BY_LOAD = ("customer_days", "incident_sums")
GENERATIONS_KEPT = 2

# 2 to this power registers in a sketch of distinct names; the standard error is 0.8 %.
SKETCH_LOG_REGISTERS = 14

_TEXT_KEYS = [c for c in KEY_COLUMNS if c != "incident_date"]


@dataclass(frozen=True)
class BatchFacts:
    """What decides how a batch is loaded; all of bounded size."""

    rows: int
    key_bytes: int
    months: tuple[str, ...]
    # No key has a null part.
    whole_keys: bool
    # Rows beside them that do not fit.
    rejected: int = 0

    @property
    def is_small(self) -> bool:
        return self.key_bytes <= BROADCAST_KEY_BYTES

    @staticmethod
    def columns(counts: Column | None = None) -> tuple[Column, ...]:
        """The aggregates over the rows that count; there are only as many months as the calendar has."""
        counts = F.lit(True) if counts is None else counts
        text_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in _TEXT_KEYS), F.lit(0))
        months = F.transform(F.collect_set(F.when(counts, F.trunc("incident_date", "month"))), month_label)
        return (
            F.count_if(counts).alias("rows"),
            F.sum(F.when(counts, (text_bytes + _KEY_OVERHEAD_BYTES).cast("bigint"))).alias("key_bytes"),
            F.array_join(months, ",").alias("months"),
            F.count_if(counts & ~has_whole_key()).alias("partial_keys"),
            F.count_if(~counts).alias("rejected"),
        )

    @staticmethod
    def of(found: Mapping) -> "BatchFacts":
        months = tuple(sorted(m for m in found["months"].split(",") if m))
        whole_keys = found["partial_keys"] == 0
        return BatchFacts(found["rows"], found["key_bytes"] or 0, months, whole_keys, found["rejected"])

    def __add__(self, other: "BatchFacts") -> "BatchFacts":
        return BatchFacts(
            self.rows + other.rows,
            self.key_bytes + other.key_bytes,
            tuple(sorted({*self.months, *other.months})),
            self.whole_keys and other.whole_keys,
            self.rejected + other.rejected,
        )


def batch_facts(batch: DataFrame) -> BatchFacts:
    """The facts of a batch, by one pass over it."""
    return BatchFacts.of(batch.agg(*BatchFacts.columns()).first().asDict())


class IncidentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # -- tables ------------------------------------------------------------

    def create(self, settings: Settings | None = None) -> "IncidentStore":
        """Write the tables that are absent, and the plants that are new."""
        for table, schema, parts in (
            ("quality_incidents", FACT, [MONTH]),
            ("dim_plant", schemas.DIM_PLANT, []),
            ("dim_customer", schemas.DIM_CUSTOMER, []),
            ("pipeline_run_log", schemas.RUN_LOG, []),
            ("alerts", schemas.ALERTS, ["run_id"]),
            ("tier_runs", schemas.TIER_RUNS, []),
            ("rejects", schemas.REJECTS, ["run_id"]),
            ("arrivals", schemas.ARRIVALS, []),
        ):
            empty = small_frame(self.spark, [], schema)
            empty.write.mode("ignore").partitionBy(*parts).parquet(self.path(table))
        system, days = self._file(self._folder("customer_days"))
        if not system.exists(days):
            # also the loads of a store that is older than this table
            self._write_days(self.incidents(), 0)
        self.seed_plants((settings or Settings()).plants)
        return self

    def _table(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(self._folder(table)))

    def _generations(self, table: str) -> list[int]:
        """The published generations of a table, oldest first; one that is being written has no number."""
        system, folder = self._file(f"generations/{table}")
        if not system.exists(folder):
            return []
        names = (status.getPath().getName() for status in system.listStatus(folder))
        return sorted(int(name) for name in names if name.isdecimal())

    def _folder(self, table: str) -> str:
        """The folder of a table's newest generation; its first one has the table's name."""
        numbers = self._generations(table) if table in COMPACTED else []
        return f"generations/{table}/{numbers[-1]}" if numbers else table

    def incidents(self) -> DataFrame:
        return self._table("quality_incidents", FACT)

    def rows_of_run(self, run_id: str, facts: BatchFacts) -> DataFrame:
        """What a run with these facts has added."""
        added = F.col(MONTH).isin(*facts.months) & (F.col("pipeline_run_id") == run_id)
        return self.incidents().where(added)

    def plants(self) -> DataFrame:
        return self._table("dim_plant", schemas.DIM_PLANT)

    def alerts(self) -> DataFrame:
        return self._table("alerts", schemas.ALERTS)

    def rejects(self) -> DataFrame:
        """The rows of extracts that did not fit, by run."""
        return self._table("rejects", schemas.REJECTS)

    def arrivals(self) -> DataFrame:
        """The states of watched extracts that were read."""
        return self._table("arrivals", schemas.ARRIVALS)

    def customer_days(self) -> DataFrame:
        """Credit per customer, day and load: partial sums of the fact table."""
        return self._table("customer_days", schemas.CUSTOMER_DAYS)

    def customers(self) -> DataFrame:
        """The latest tier of each customer; a customer without news keeps the old tier."""
        return (
            self._table("dim_customer", schemas.DIM_CUSTOMER)
            .groupBy("customer_name")
            .agg(F.max(F.struct("updated_at", "run_id", "risk_tier")).alias("latest"))
            .select("customer_name", "latest.risk_tier", "latest.updated_at")
        )

    def tier_history(self) -> DataFrame:
        """Every tier that a run has written since the last compaction, and the latest ones of that time."""
        return self._table("dim_customer", schemas.DIM_CUSTOMER)

    def runs(self) -> DataFrame:
        """The latest log row of each run."""
        rest = [c for c in schemas.RUN_LOG.names if c not in ("run_id", "finished_at")]
        return (
            self._table("pipeline_run_log", schemas.RUN_LOG)
            .groupBy("run_id")
            .agg(F.max(F.struct("finished_at", *rest)).alias("latest"))
            .select("run_id", *[f"latest.{c}" for c in schemas.RUN_LOG.names if c != "run_id"])
        )

    # -- writes ------------------------------------------------------------

    def _file(self, name: str):
        """(file system, path) of something below the root."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @contextmanager
    def lease(self) -> Iterator[Callable[[], None]]:
        """One load at a time: what is new is decided on a history that stands still.

        The mark names its owner, who renews it all the while; one that was not
        renewed for long is of a load that has died. The function that is given
        raises if the store was taken over meanwhile, as from a load that stood still.
        """
        system, mark = self._file("_lease")
        own = uuid4().hex
        until = time.monotonic() + LEASE_WAIT_SECONDS
        while not self._marked(system, mark, own):
            if time.monotonic() > until:
                raise StoreBusy(f"{self.root} is being loaded")
            time.sleep(0.2)
        done = Event()

        def renew() -> None:
            while not done.wait(LEASE_RENEW_SECONDS):
                if self._owner(system, mark) != own:
                    return
                self._write_mark(system, mark, own, True)

        def check() -> None:
            if self._owner(system, mark) != own:
                raise StoreBusy(f"another load has taken over {self.root}")

        renewing = Thread(target=renew, daemon=True)
        renewing.start()
        try:
            yield check
        finally:
            done.set()
            renewing.join()
            if self._owner(system, mark) == own:
                system.delete(mark, False)

    @staticmethod
    def _write_mark(system, mark, owner: str, again: bool) -> None:
        out = system.create(mark, again)
        out.write(bytearray(owner.encode()))
        out.close()

    def _owner(self, system, mark) -> str | None:
        """Who has written the mark; None where there is none, or where it is being written."""
        try:
            data = system.open(mark)
            try:
                return self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
            finally:
                data.close()
        except Py4JJavaError as error:
            if "FileNotFound" in str(error) or "ChecksumException" in str(error):
                return None
            raise

    def _marked(self, system, mark, own: str) -> bool:
        try:
            if not system.exists(mark):
                self._write_mark(system, mark, own, False)
                # where creating a file is not atomic, the last writer has it
                return self._owner(system, mark) == own
            before = self._owner(system, mark)
            age = time.time() - system.getFileStatus(mark).getModificationTime() / 1000
            if age > LEASE_STALE_SECONDS and self._owner(system, mark) == before:
                log.warning("%s was held by a load that has died", self.root)
                system.delete(mark, False)
        except Py4JJavaError as error:
            # made or removed by another one in between
            if "Exist" not in str(error) and "FileNotFound" not in str(error):
                raise
        return False

    def seed_plants(self, plants: Sequence[tuple[str, ...]]) -> None:
        """Add the plants whose name is not there yet."""
        seed = small_frame(self.spark, plants, schemas.DIM_PLANT)
        new = seed.join(self.plants().select("plant_name"), "plant_name", "left_anti")
        if not new.isEmpty():
            new.coalesce(1).write.mode("append").parquet(self.path("dim_plant"))

    def stage(self, batch: DataFrame, run_id: str) -> tuple[DataFrame, BatchFacts]:
        """Write a batch once and read it from there, with its facts.

        A batch is read more than once, and a written one does not have to be
        parsed again when an executor is lost. The facts are counted in the
        stage that writes, where each partition reports once. Rows that do not
        fit are staged beside the others, and are told apart by their marks.
        """
        target = f"{self.path('staging')}/run_id={run_id}"
        facts = Observation()
        counted = batch.observe(facts, *BatchFacts.columns(~is_rejected(batch)))
        counted.write.mode("overwrite").parquet(target, compression=CODEC)
        staged = self.spark.read.schema(batch.schema).parquet(target)
        return staged, BatchFacts.of(facts.get)

    def unstage(self, run_id: str) -> None:
        """Remove a staged batch."""
        system, folder = self._file(f"staging/run_id={run_id}")
        system.delete(folder, True)

    def new_incidents(self, batch: DataFrame, facts: BatchFacts | None = None) -> DataFrame:
        """The rows of a cleaned batch that the fact table does not have yet.

        The incident date is part of the key, so only the months of the batch
        are read from the history.
        """
        facts = facts or batch_facts(batch)
        history = self.incidents().where(F.col(MONTH).isin(*facts.months))
        first = first_per_incident(batch, facts.whole_keys)
        return not_in_history(first, history, batch if facts.is_small else None)

    def insert_new(
        self,
        batch: DataFrame,
        loaded_at: datetime | None = None,
        facts: BatchFacts | None = None,
    ) -> int:
        """Append the new rows of a cleaned batch and return how many there were.

        Running it again, also after a failure, adds nothing twice, nor do two
        loads at once: the second waits.
        """
        with self.lease() as still_ours, released_shuffles(self.spark):
            return self._insert_new(batch, loaded_at or datetime.now(timezone.utc), facts, still_ours)

    def _insert_new(
        self, batch: DataFrame, loaded_at: datetime, facts: BatchFacts | None, still_ours: Callable[[], None]
    ) -> int:
        facts = facts or batch_facts(batch)
        new = (
            self.new_incidents(batch, facts)
            .withColumns(
                {
                    "loaded_at": F.lit(loaded_at),
                    MONTH: month_label(F.col("incident_date")),
                }
            )
            .select(*FACT.names)
        )
        loaded = _micros(loaded_at)
        chosen = f"new-{loaded}"
        try:
            if not facts.is_small:
                # written before they are dealt out by month, so that the shuffles of both steps are not kept at once
                target = f"{self.path('staging')}/run_id={chosen}"
                new.write.mode("overwrite").parquet(target, compression=CODEC)
                new = self.spark.read.schema(new.schema).parquet(target)
            self._add_pending_days()
            self._mark_pending(loaded, facts.months)
            still_ours()
            written = Observation()
            (
                # Few files per month, and a month that holds much is split over tasks.
                new.hint("rebalance", MONTH)
                .observe(written, F.count(F.lit(1)).alias("rows"))
                .write.mode("append")
                .partitionBy(MONTH)
                .parquet(self.path("quality_incidents"), compression=CODEC)
            )
        finally:
            self.unstage(chosen)
        self._add_pending_days()
        return written.get["rows"]

    # -- tiers -------------------------------------------------------------

    def _mark_pending(self, loaded: int, months: Sequence[str]) -> None:
        """A mark that a load is about to add rows to some months; it goes when their sums are written."""
        mark = small_frame(self.spark, [(month,) for month in months], _MARK).coalesce(1)
        mark.write.mode("overwrite").parquet(self.path(f"pending_days/loaded={loaded}"))

    def _add_pending_days(self) -> None:
        """Write the sums per customer and day of the loads that are marked, also of one that has died."""
        system, marks = self._file("pending_days")
        if not system.exists(marks):
            return
        for status in system.listStatus(marks):
            loaded = int(status.getPath().getName().rsplit("=", 1)[1])
            mark = self.spark.read.schema(_MARK).parquet(self.path(f"pending_days/loaded={loaded}"))
            months = [row["month"] for row in mark.collect()]
            at = F.col("loaded_at") == F.timestamp_micros(F.lit(loaded))
            added = self.incidents().where(F.col(MONTH).isin(*months) & at)
            self._write_days(added, loaded)
            if self.has_sketches():
                self._write_sketches(added, loaded)
            if self.has_sums():
                self._write_sums(added, loaded)
            system.delete(status.getPath(), True)

    def _write_days(self, rows: DataFrame, loaded: int) -> None:
        days = rows.dropna(subset=["customer"]).groupBy("customer", "incident_date")
        totals = days.agg(F.sum("credit_requested_usd").cast("decimal(38,6)").alias("credit_usd"))
        numbered = totals.withColumn("load", F.lit(time.time_ns()))
        numbered.write.mode("overwrite").parquet(
            f"{self.path(self._folder('customer_days'))}/loaded={loaded}", compression=CODEC
        )

    # -- sketches of distinct names ----------------------------------------

    def has_sketches(self) -> bool:
        system, done = self._file("month_sketches/loaded=0/_SUCCESS")
        return system.exists(done)

    def start_sketches(self) -> None:
        """Keep sketches of the distinct customers and plants of each month from now on.

        The history is read once; after that each load adds the sketches of its own
        rows. A sketch that is merged twice counts once, so a repeated load does no harm.
        """
        with self.lease():
            self._add_pending_days()
            if not self.has_sketches():
                self._write_sketches(self.incidents(), 0)

    def _write_sketches(self, rows: DataFrame, loaded: int) -> None:
        sketches = [
            F.hll_sketch_agg(name, SKETCH_LOG_REGISTERS).alias(alias)
            for name, alias in (("customer", "customers"), ("plant", "plants"))
        ]
        by_month = rows.groupBy(MONTH).agg(*sketches)
        by_month.write.mode("overwrite").parquet(f"{self.path('month_sketches')}/loaded={loaded}")

    def month_sketches(self) -> DataFrame:
        """The sketches of each load and month; only after ``start_sketches``."""
        return self._table("month_sketches", schemas.MONTH_SKETCHES)

    # -- sums of incidents -------------------------------------------------

    def has_sums(self) -> bool:
        system, done = self._file(f"{self._folder('incident_sums')}/loaded=0/_SUCCESS")
        return system.exists(done)

    def start_sums(self) -> None:
        """Keep the sums behind reports and scorecards from now on.

        The history is read once; after that each load adds the sums of its own rows,
        before the next load or compaction begins, also for a load that has died.
        """
        if self.has_sums():
            return
        with self.lease():
            self._add_pending_days()
            if not self.has_sums():
                self._write_sums(self.incidents(), 0)

    def _write_sums(self, rows: DataFrame, loaded: int) -> None:
        # nothing is known of the loads of the history but the last one's time
        last = rows.agg(F.max(F.unix_micros("loaded_at"))).first()[0] or 0 if loaded == 0 else loaded
        folder = self._folder("incident_sums")
        # readers pass over this name until all groups are there
        system, new = self._file(f"{folder}/_new")
        system.delete(new, True)
        for sets in sums.SET_GROUPS:
            of_load = sums.rollup(rows, sets).withColumn("through", F.lit(last))
            of_load.write.mode("append").parquet(self.path(f"{folder}/_new"), compression=CODEC)
        _, target = self._file(f"{folder}/loaded={loaded}")
        system.delete(target, True)
        if not system.rename(new, target):
            raise OSError(f"cannot publish {target}")

    def incident_sums(self) -> DataFrame:
        """One row per grouping set and key over all loads; only after ``start_sums``.

        A load that has died between its rows and its sums is in neither a report nor
        a scorecard that is made of these until the next load has made up for it.
        """
        return sums.merged(self._table("incident_sums", schemas.INCIDENT_SUMS))

    def update_risk_tiers(
        self,
        as_of: date,
        run_id: str,
        settings: Settings | None = None,
        updated_at: datetime | None = None,
    ) -> None:
        """Append the tiers that may have changed since the last time.

        These are of customers with days that a load has added since, or that have
        come into the window or left it. The sums come from the days of customers, so
        neither the history is read nor is a customer without news written again.
        With other limits than the last time all customers count. A customer without
        incidents in the window keeps the old tier. Nobody else loads or compacts the
        store meanwhile.
        """
        with self.lease() as still_ours:
            self._update_risk_tiers(
                as_of, run_id, settings or Settings(), updated_at or datetime.now(timezone.utc), still_ours
            )

    def _update_risk_tiers(
        self, as_of: date, run_id: str, settings: Settings, updated_at: datetime, still_ours: Callable[[], None]
    ) -> None:
        days = self.customer_days()
        through = days.agg(F.max("load")).first()[0] or 0
        days = days.where(F.col("load") <= through)
        start = as_of - timedelta(days=settings.risk_window_days)
        limits = (settings.high_risk_usd, settings.medium_risk_usd)
        last = self._table("tier_runs", schemas.TIER_RUNS).orderBy(F.desc("at")).first()
        recent = in_dates(days, start, None)
        if last is not None and (last["high_risk_usd"], last["medium_risk_usd"]) == limits:
            first, end = sorted((last["window_start"], start))
            day = F.col("incident_date")
            moved = (day >= F.lit(first)) & (day < F.lit(end))
            news = days.where(moved | (F.col("load") > last["through_load"])).select("customer").distinct()
            recent = recent.join(news, "customer", "left_semi")
        tiers = recent.groupBy("customer").agg(F.sum("credit_usd").alias("total"))
        still_ours()
        tiers.select(
            F.col("customer").alias("customer_name"),
            risk_tier(F.col("total"), *limits).alias("risk_tier"),
            F.lit(updated_at).alias("updated_at"),
            F.lit(run_id).alias("run_id"),
        ).write.mode("append").parquet(self.path(self._folder("dim_customer")))
        done = (start, *limits, through, time.time_ns(), run_id)
        small_frame(self.spark, [done], schemas.TIER_RUNS).coalesce(1).write.mode("append").parquet(
            self.path(self._folder("tier_runs"))
        )

    # -- compaction --------------------------------------------------------

    def _compacted(self, table: str) -> DataFrame:
        """The rows of a table that its views and the next run need, in the table's columns."""
        if table == "dim_customer":
            latest = F.max(F.struct("updated_at", "run_id", "risk_tier")).alias("latest")
            rows = self.tier_history().groupBy("customer_name").agg(latest)
            return rows.select("customer_name", "latest.risk_tier", "latest.updated_at", "latest.run_id")
        if table == "pipeline_run_log":
            return self.runs()
        if table == "incident_sums":
            return self.incident_sums()
        last = self._table("tier_runs", schemas.TIER_RUNS).orderBy(F.desc("at")).limit(1)
        if table == "tier_runs":
            return last
        # sums that tiers were made of have the number of the newest of them; later ones stay news
        used = last.first()
        load = F.greatest("load", F.lit(used["through_load"] if used else 0)).alias("load")
        days = self.customer_days().groupBy("customer", "incident_date", load)
        totals = days.agg(F.sum("credit_usd").cast("decimal(38,6)").alias("credit_usd"))
        return totals.select("customer", "incident_date", "credit_usd", "load")

    def compact(self, tables: Sequence[str] = COMPACTED) -> None:
        """Write the current state of tables into new generations and publish each by a rename.

        Views give the same before and after. A job that dies leaves a folder without
        a number, which nobody reads and the next one overwrites. Readers that have
        begun find their files: the generation before stays until the next compaction.
        """
        with self.lease() as still_ours:
            # sums of a load that has died are written before others are merged
            self._add_pending_days()
            for table in tables:
                if table == "incident_sums" and not self.has_sums():
                    continue
                self._publish(table, self._compacted(table), still_ours)

    def _publish(self, table: str, rows: DataFrame, still_ours: Callable[[], None]) -> None:
        numbers = self._generations(table)
        system, new = self._file(f"generations/{table}/_new")
        part = "/loaded=0" if table in _BY_LOAD else ""
        system.delete(new, True)
        rows.write.mode("overwrite").parquet(f"{self.path(f'generations/{table}/_new')}{part}", compression=CODEC)
        still_ours()
        _, target = self._file(f"generations/{table}/{numbers[-1] + 1 if numbers else 1}")
        if system.exists(target) or not system.rename(new, target):
            raise OSError(f"cannot publish {target}")
        # the table's own folder is its first generation
        older = [table, *(f"generations/{table}/{number}" for number in numbers)]
        for folder in older[: len(older) + 1 - GENERATIONS_KEPT]:
            _, old = self._file(folder)
            system.delete(old, True)

    def log_run(
        self,
        run_id: str,
        started_at: datetime,
        finished_at: datetime,
        status: str,
        total_rows: int,
        sources_detected: Iterable[str],
        sources_loaded: Iterable[str] = (),
        error_message: str = "",
    ) -> None:
        row = (
            run_id,
            started_at,
            finished_at,
            status,
            total_rows,
            ",".join(sources_detected),
            ",".join(sources_loaded),
            error_message,
        )
        with self.lease():
            small_frame(self.spark, [row], schemas.RUN_LOG).coalesce(1).write.mode("append").parquet(
                self.path(self._folder("pipeline_run_log"))
            )

    def write_arrivals(self, rows: Sequence[tuple]) -> None:
        small_frame(self.spark, rows, schemas.ARRIVALS).coalesce(1).write.mode("append").parquet(
            self.path("arrivals")
        )

    def set_aside(self, staged: DataFrame, facts: BatchFacts, run_id: str) -> DataFrame:
        """The rows of a staged batch that fit; the others go to the table of rejects."""
        marks = [field.name for field in schemas.REJECT]
        if marks[-1] not in staged.columns:
            return staged
        if facts.rejected:
            log.warning("%s rows do not fit and are set aside", facts.rejected)
            self.write_rejects(staged, run_id)
        return staged.where(F.col(marks[-1]).isNull()).drop(*marks)

    def write_rejects(self, staged: DataFrame, run_id: str) -> None:
        """The marked rows of a staged batch; a repeated run replaces its own.

        Files of the batch without such a row are left out by the statistics of their column.
        """
        reason, line = (field.name for field in schemas.REJECT)
        place = F.col(schemas.ROW_ORDER.name) if schemas.ROW_ORDER.name in staged.columns else F.lit(None)
        found = staged.where(F.col(line).isNotNull()).select(
            "source",
            "raw_source_file",
            place.cast(schemas.ROW_ORDER.dataType).alias("row_order"),
            F.col(reason).alias("reason"),
            F.col(line).alias("line"),
        )
        found.write.mode("overwrite").parquet(f"{self.path('rejects')}/run_id={run_id}")

    def write_alerts(self, alerts: DataFrame, run_id: str) -> None:
        """One directory per run, so that a repeated run replaces its own alerts."""
        names = [c for c in schemas.ALERTS.names if c != "run_id"]
        alerts.select(*names).write.mode("overwrite").parquet(
            f"{self.path('alerts')}/run_id={run_id}"
        )

    def load(
        self,
        batch: DataFrame,
        run_id: str,
        started_at: datetime,
        sources_detected: Iterable[str],
        sources_loaded: Iterable[str] | None = None,
        settings: Settings | None = None,
        as_of: date | None = None,
        facts: BatchFacts | None = None,
    ) -> int:
        """``try_load``, and how many rows it inserted."""
        return self.try_load(
            batch, run_id, started_at, sources_detected, sources_loaded, settings, as_of, facts
        )[0]

    def try_load(
        self,
        batch: DataFrame,
        run_id: str,
        started_at: datetime,
        sources_detected: Iterable[str],
        sources_loaded: Iterable[str] | None = None,
        settings: Settings | None = None,
        as_of: date | None = None,
        facts: BatchFacts | None = None,
        note: str = "",
    ) -> tuple[int, str]:
        """Insert, re-tier, log; the rows inserted so far and the failure, if there was one.

        ``note`` goes into the log of a run that succeeds.
        """
        status, message, total = "SUCCESS", "", 0
        try:
            total = self.insert_new(batch, facts=facts)
            self.update_risk_tiers(as_of or datetime.now(timezone.utc).date(), run_id, settings)
        except Exception as error:  # noqa: BLE001 - the failure belongs in the run log
            log.error("load failed: %s", error)
            status, message = "FAILED", str(error)
        self.log_run(
            run_id,
            started_at,
            datetime.now(timezone.utc),
            status,
            total,
            sources_detected,
            sources_loaded if sources_loaded is not None else sources_detected,
            message or note,
        )
        return total, message
