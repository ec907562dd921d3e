"""URL filters: a trie over reversed host labels and path segments, longest match first.

An entry is a host and a path. It fits the host itself and all of its subdomains,
if the URL's path starts with the entry's path. The labels of a host, read from the
right, and then the whole segments of a path lead down one trie, so that a URL walks
past all entries that fit it; the last part of a path, which may end within a
segment, is compared at the node that the walk has reached. The trie is broadcast in
pieces of a bounded size, and the pages pass the pieces one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import free_name, quoted, schema_with, without

#: Bytes of hosts and paths that one broadcast trie is built of.
TRIE_BYTES = 16 * 1024 * 1024
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


class Entry(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def rule(self) -> str:
        return self.host + self.path


class Trie:
    """Nodes are dictionaries: labels lead down the host, ``_PATH`` into the paths below it, segments down the path.

    ``_TAILS`` of a node in the paths has the entries that end there, by the part of
    a segment with which their path ends.
    """

    _PATH, _TAILS = 0, 1

    def __init__(self, entries: Iterable[Entry]) -> None:
        self.root: dict = {}
        for entry in entries:
            node = self.root
            for label in reversed(entry.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self._PATH, {})
            *whole, tail = entry.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(self._TAILS, {})[tail] = entry

    def longest(self, host: str, path: str) -> Entry | None:
        """The entry with the longest host that fits and, under it, the longest path."""
        best, node = None, self.root
        segments: list[str] | None = None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self._PATH in node:
                segments = path.split("/") if segments is None else segments
                best = self._under(node[self._PATH], segments) or best
        return best

    def _under(self, node: dict, segments: list[str]) -> Entry | None:
        best = None
        for segment in segments:
            tails = node.get(self._TAILS)
            if tails:
                # whichever are fewer: the tails, or the beginnings of the segment
                few = tails if len(tails) <= len(segment) else (segment[:n] for n in range(len(segment) + 1))
                fits = [tail for tail in few if tail in tails and segment.startswith(tail)]
                best = tails[max(fits, key=len)] if fits else best
            node = node.get(segment)
            if node is None:
                break
        return best


def entries_of(block: Iterable[tuple[str, str]], allow: Iterable[tuple[str, str]]) -> list[Entry]:
    """One entry per host and path, hosts with A-Z in lower case; what is in both lists is allowed."""
    both = {(host.translate(_FOLD), path): BLOCK for host, path in block}
    both |= {(host.translate(_FOLD), path): ALLOW for host, path in allow}
    if any(not host for host, _ in both):
        raise ValueError("an entry needs a host")
    return [Entry(*key, verdict) for key, verdict in sorted(both.items())]


def _pieces(entries: list[Entry], size: int) -> Iterator[list[Entry]]:
    piece, full = [], 0
    for entry in entries:
        own = len(entry.rule.encode())
        if piece and full + own > size:
            yield piece
            piece, full = [], 0
        piece.append(entry)
        full += own
    yield piece


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty where the URL is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge(
    pages: DataFrame,
    block: Iterable[tuple[str, str]],
    allow: Iterable[tuple[str, str]] = (),
    url: str = "url",
    default: str = ALLOW,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the entry, or null) and verdict.

    The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#``
    or the end, with user and port if there are any; the path goes on to ``?``, ``#``
    or the end. Of the entries that fit, that with the longest host wins, then that
    with the longest path; an entry of both lists allows. A URL that none fits, a null
    or an empty one, or one without ``://``, gets ``default``. An entry without a
    path fits every path; one with ``/`` fits no empty path. Rows are kept as they
    are, repeated ones too; columns of these four names are replaced. A trie is made
    of at most ``trie_bytes`` of entries; longer lists are passed in several tries.
    """
    entries = entries_of(block, allow)
    names = ("host", "path", "rule", "verdict")
    source = free_name(pages, "_judged_url")
    kept = pages.withColumn(source, quoted(url))
    host, path = host_and_path(quoted(source))
    parts = without(kept, *names).withColumns({"host": host, "path": path}).drop(source)
    size = free_name(parts, "_host_size")
    best = parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias(size))
    schema = schema_with(parts, ("rule", T.StringType()), ("verdict", T.StringType()), (size, T.IntegerType()))
    context = pages.sparkSession.sparkContext
    for piece in _pieces(entries, trie_bytes):
        best = best.mapInArrow(_pass(context.broadcast(Trie(piece))), schema)
    return best.drop(size)


def _pass(trie):
    """One trie's longest match, where it is longer than that of the tries before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = trie.value.longest
        for batch in batches:
            at = batch.num_columns - 5
            rules, verdicts, sizes = (batch.column(at + i).to_pylist() for i in (2, 3, 4))
            for row, (host, path) in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)):
                found = longest(host, path)
                if found is not None and (len(found.host), len(found.rule)) > (sizes[row], len(rules[row] or "")):
                    rules[row], verdicts[row], sizes[row] = found.rule, found.verdict, len(found.host)
            columns = [*batch.columns[: at + 2], pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run
