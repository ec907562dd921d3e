"""Extracts that are new or were rewritten in place, as a stream of a folder's listing.

Spark's file stream keys on the path and never reads one again. Here the stream is
the listing itself: a row per entry of the folder with the time and size of its
newest state, sent whenever the listing has changed. What of it is new is decided in
the batch, against the table of arrivals in the store, so a batch that is replayed
after a failure loads nothing twice.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping
from datetime import date
from hashlib import sha256

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from faultledger.config import Settings
from faultledger.plans.ingest import ingest
from faultledger.plans.store import IncidentStore
from faultledger.sources.detect import name_regex, qualified
from faultledger.sources.extracts import POSITION, Extract, read_extracts
from faultledger.streaming.incidents import query_id

# the reader below runs in a process that need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "folder_listing"
_SCHEMA = "path string, modified bigint, size bigint"


def entries(folder: str) -> list[tuple[str, int, int]]:
    """(path, newest modification in ns, size) of the entries of a folder; a folder of part files is one."""
    from pyarrow import fs

    if folder.startswith("file:"):
        system, root = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    else:
        system, root = fs.FileSystem.from_uri(folder)
    found: dict[str, tuple[int, int]] = {}
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        inside = info.path[len(root) :].strip("/").split("/")
        if info.type == fs.FileType.File and not any(name.startswith(("_", ".")) for name in inside):
            newest, size = found.get(inside[0], (0, 0))
            found[inside[0]] = (max(newest, info.mtime_ns or 0), size + (info.size or 0))
    return [(f"{folder.rstrip('/')}/{name}", *state) for name, state in sorted(found.items())]


class FolderListing(DataSource):
    """``spark.readStream.format("folder_listing").load(folder)``; the folder is given as a URI."""

    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return _SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ListingReader(self.options["path"])


class _ListingReader(SimpleDataSourceStreamReader):
    """The offset is a digest of the listing: equal listings make no batch."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = entries(self.folder)
        digest = sha256(repr(rows).encode()).hexdigest()
        if not rows or digest == start["listing"]:
            return iter(()), start
        return iter(rows), {"listing": digest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A replayed batch sees the folder as it is now; what it had loaded before is in the arrivals."""
        return iter(entries(self.folder) if start != end else ())


def listing_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.readStream.format(LISTING).load(qualified(spark, folder))


def changed_extracts(listing: DataFrame, store: IncidentStore, settings: Settings) -> DataFrame:
    """source, path, modified, size of the entries of known sources that have not arrived in this state.

    Where several patterns of a source match, all of them count: in a stream every drop is read.
    """
    name = F.substring_index("path", "/", -1)
    keys = [
        F.when(name.rlike(name_regex(pattern)), F.lit(key))
        for key, choices in settings.source_patterns.items()
        for pattern in ([choices] if isinstance(choices, str) else choices)
    ]
    known = listing.withColumn("source", F.coalesce(*keys)).where(F.col("source").isNotNull())
    return known.join(store.arrivals(), ["path", "modified", "size"], "left_anti")


def load_changes(
    store: IncidentStore, settings: Settings, run_id: str, checkpoint: str | None = None, as_of: date | None = None
) -> Callable[[DataFrame, int], None]:
    """The function that runs one batch of a listing: read what has changed, and load it as a run does.

    A rewritten extract is read whole; its rows that the history has are not added
    again. An extract that can't be read is named in the run log and tried again when
    it changes; the others are loaded.
    """
    name: list[str] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        if not name:
            name.append(f"{run_id}-{query_id(store.spark, checkpoint)}" if checkpoint else run_id)
        batch_run = f"{name[0]}-{batch_id}"
        # the names of the files that one trigger reads, as any reader's listing has them
        changed = changed_extracts(batch, store, settings).orderBy("path").collect()
        by_source: dict[str, list[str]] = {}
        for row in changed:
            by_source.setdefault(row["source"], []).append(row["path"])
        extracts, failures = _read(store.spark, by_source, settings)
        if extracts:
            result = ingest(store, extracts, batch_run, settings, dict.fromkeys(by_source, "x"), as_of)
            if result is not None and result.status == "FAILED" and result.counts:
                raise RuntimeError(f"batch {batch_run} failed")
        if changed:
            store.write_arrivals([(r["path"], r["modified"], r["size"], failures.get(r["path"], ""), batch_run) for r in changed])

    return load


def _read(spark: SparkSession, by_source: Mapping[str, list[str]], settings: Settings) -> tuple[dict[str, Extract], dict[str, str]]:
    """One extract per source, of all its files, each row with its own file; and failures by path."""
    extracts, failures = {}, {}
    for key, paths in by_source.items():
        frames: list[DataFrame] = []
        for path in paths:
            found, failed = read_extracts(spark, {key: path}, settings.contracts, settings.csv_multi_line)
            failures |= {path: reason for reason in failed.values()}
            frames += [frame for one in found.values() for frame in one.frames]
        if frames:
            extracts[key] = Extract(frames[0], F.col(f"{POSITION}.part"), tuple(frames[1:]))
    return extracts, failures


def start_watch(
    store: IncidentStore,
    folder: str,
    checkpoint: str,
    run_id: str,
    settings: Settings | None = None,
    as_of: date | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Load what is new or rewritten in a folder, then stop; with ``every`` (such as "60 seconds") go on watching."""
    settings = settings or Settings()
    trigger = {"processingTime": every} if every else {"once": True}
    return (
        listing_stream(store.spark, folder)
        .writeStream.foreachBatch(load_changes(store, settings, run_id, checkpoint, as_of))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
