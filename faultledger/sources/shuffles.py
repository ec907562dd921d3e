"""Shuffle files that go as soon as the action that wrote them has ended."""

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

# Read by Spark when an action begins.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = Lock()
# How many blocks a session is in, and what it had before the first of them.
_open: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions within the block remove their shuffle files when they end.

    Otherwise these stay until a collection of the driver's garbage, so a run of many
    actions holds those of all. A frame that is acted on twice shuffles twice, as its files are
    gone by then. Blocks may be nested, and of several threads.
    """
    with _lock:
        blocks, before = _open.get(spark, (0, None))
        if not blocks:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _open[spark] = (blocks + 1, before)
    try:
        yield
    finally:
        with _lock:
            blocks, before = _open[spark]
            _open[spark] = (blocks - 1, before)
            if blocks == 1:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
