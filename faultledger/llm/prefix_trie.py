"""Prefix trie of conversations, rolled up by centroid decomposition.

A conversation is a sequence of turns; every distinct beginning of one is a node of
the trie, and a node's key is a hash of that beginning: with t the first 120 bits of
a turn's SHA-256, key(d) = key(d - 1) * BASE + t(d) modulo the prime 2**127 - 1. Such
hashes can be put together from pieces, so a conversation is hashed where its rows
lie after one sort, however many tasks it spans.

Sums over subtrees are made on the forest of parent edges. A component that is too
large for one task is split at its centroid, the deepest node below which more than
half of the component's weight lies: the sum below the centroid is added to the nodes
on the path from it to the component's top, and the children's subtrees and the rest
become components of their own. So no component is split more often than the
logarithm of its weight, however deep the trie is. Components that fit into a task
are decomposed there in the same way down to single nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultledger.llm.shared import broadcast_if_small, checkpoint, quoted, written

PRIME = 2**127 - 1
BASE = 0x5DEECE66D1F83D9ABFB41BD6B5A7E19B
#: Key of the textless beginning.
ROOT = (1).to_bytes(16, "big")
#: Turns of a conversation that may come from another one.
LEAD = 8
#: Rows of a conversation that are joined under one key.
STRIDE = 4096
#: Weight of a component that one task decomposes, at least; and how many larger ones there may be.
TASK_WEIGHT, LARGE_PARTS = 5_000, 100_000
#: Ids of one link in the chain of a digest.
LINK = 4096
#: Rows of the tables that are broadcast after they were counted.
FEW = 200_000

#: Columns that are summed over subtrees.
SUMMED = ("leaf", "saved")


def _number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


# -- keys of all beginnings -----------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int]]]:
    """(conversation, turn hashes) of neighbouring rows, batch by batch."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        turns = [_number(value[:15]) for value in batch.column(1).to_pylist()]
        at = 0
        for conv, same in groupby(ids):
            n = sum(1 for _ in same)
            yield conv, turns[at : at + n]
            at += n


def _extend(length: int, key: int, turns: list[int]) -> tuple[int, int]:
    for turn in turns:
        key = (key * BASE + turn) % PRIME
    return length + len(turns), key


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), bytes, before, after: keys up to each turn, from (conv_id, turn, digest, bytes)."""
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    placed = checkpoint(turns.repartitionByRange(*order).sortWithinPartitions(*order))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for conv, hashes in _runs(batches):
            if last is None or last[0] != conv:
                first = first or last
                last = (conv, 0, 0)
            last = (conv, *_extend(last[1], last[2], hashes))
        found = [run for run in (first, last) if run]
        part = TaskContext.get().partitionId()
        rows = [(part, n, conv, length, _bytes(key)) for n, (conv, length, key) in enumerate(found)]
        if rows:
            names = ["part", "n", "conv_id", "length", "key"]
            yield pa.record_batch([pa.array(column) for column in zip(*rows, strict=True)], names=names)

    # two rows of every partition: what its first and its last conversation have there
    known = placed.select("conv_id", "digest").mapInArrow(edges, "part bigint, n bigint, conv_id bigint, length bigint, key binary").collect()
    carried: dict[int, tuple[int, int, int]] = {}
    open_run: tuple[int, int, int] | None = None
    for row in sorted(known, key=lambda r: (r["part"], r["n"])):
        length, key = 0, _number(ROOT)
        if open_run and open_run[0] == row["conv_id"]:
            length, key = open_run[1:]
            carried[row["part"]] = open_run
        joined = (key * pow(BASE, row["length"], PRIME) + _number(row["key"])) % PRIME
        open_run = (row["conv_id"], length + row["length"], joined)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, key = carried.get(TaskContext.get().partitionId(), (None, 0, _number(ROOT)))
        for batch in batches:
            places, before, after = [], [], []
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != conv:
                    conv, place, key = own, 0, _number(ROOT)
                before.append(_bytes(key))
                place, key = _extend(place, key, [_number(value[:15])])
                places.append(place)
                after.append(_bytes(key))
            columns = [batch.column(0), batch.column(2), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.record_batch(columns, names=["conv_id", "bytes", "place", "before", "after"])

    schema = "conv_id bigint, bytes bigint, place bigint, before binary, after binary"
    return placed.select("conv_id", "digest", "bytes").mapInArrow(number, schema)


def digested(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, digest, bytes of every row that has an id; null roles and texts are empty."""
    said, by = (F.coalesce(quoted(name).cast("string"), F.lit("")) for name in (text, role))
    # the length of the role keeps "a" + "bc" and "ab" + "c" apart
    digest = F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256))
    rows = conversations.select(
        quoted(conv_id).cast("bigint").alias("conv_id"), quoted(turn).cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("bytes")
    )
    return rows.where(F.col("conv_id").isNotNull())


def rebuilt(own: DataFrame, donor: Column, lead: Column) -> tuple[DataFrame, DataFrame]:
    """(paths, ends) of the conversations whose first ``lead`` turns are those of ``donor``.

    ``paths`` has a row for every beginning of every conversation (conv_id, depth, key,
    parent, bytes of its last turn, left: how many it and those after it are), ``ends``
    one per conversation (conv_id, depth, key). ``own`` is what ``hashed_turns`` gives;
    ``donor`` and ``lead`` (at most ``LEAD``) are made of ``conv_id``.
    """
    first = F.when(F.col("place") <= LEAD, F.struct("place", "after", "bytes"))
    heads = own.groupBy("conv_id").agg(
        F.max("place").alias("length"), F.sort_array(F.collect_list(first)).alias("head")
    )
    heads = checkpoint(heads.withColumns({"donor": donor, "lead": lead.cast("bigint")}))
    gives = heads.select(F.col("conv_id").alias("donor"), F.col("head").alias("given"))
    known = heads.join(gives, "donor", "left").withColumn("self", F.col("donor") == F.col("conv_id"))
    taken = F.when(F.col("self") | F.col("given").isNull(), 0).otherwise(F.least("lead", F.size("given").cast("bigint")))
    skipped = F.when(F.col("self"), 0).otherwise(F.least("lead", "length"))
    known = known.withColumns({"taken": taken.cast("bigint"), "skipped": skipped.cast("bigint")})

    def key_at(head: Column, place: Column) -> Column:
        return F.when(place > 0, F.get(head, (place - 1).cast("int"))["after"]).otherwise(F.lit(ROOT))

    known = known.select(
        *("conv_id", "length", "taken", "skipped"),
        (F.col("taken") + F.col("length") - F.col("skipped")).alias("depth"),
        F.slice(F.coalesce("given", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("taken").cast("int")).alias("given"),
        key_at(F.col("given"), F.col("taken")).alias("swap_in"),
        key_at(F.col("head"), F.col("skipped")).alias("swap_out"),
    )
    known = checkpoint(known)
    stride = F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / STRIDE))).alias("block")
    rest = own.withColumn("block", F.floor(F.col("place") / STRIDE)).join(
        known.select("conv_id", "taken", "skipped", "swap_in", "swap_out", F.col("depth").alias("whole"), stride), ["conv_id", "block"]
    )
    rest = rest.where(F.col("place") > F.col("skipped"))
    tail = rest.select(
        "conv_id", (F.col("place") - F.col("skipped") + F.col("taken")).alias("depth"), "bytes", "whole", (F.col("place") - F.col("skipped")).alias("after_swap"),
        "swap_in", "swap_out", "before", "after",
    ).mapInArrow(_swap, "conv_id bigint, depth bigint, bytes bigint, whole bigint, key binary, parent binary")
    lent = known.select("conv_id", F.col("depth").alias("whole"), F.posexplode("given").alias("at", "turn"), "given").select(
        "conv_id", (F.col("at") + 1).cast("bigint").alias("depth"), "turn.bytes", "whole", F.col("turn.after").alias("key"), key_at(F.col("given"), F.col("at")).alias("parent")
    )
    roots = known.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("bytes"), F.col("depth").alias("whole"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"))
    paths = checkpoint(tail.unionByName(lent).unionByName(roots).withColumn("left", F.col("whole") - F.col("depth") + 1).drop("whole"))
    return paths, paths.where(F.col("left") == 1).select("conv_id", "depth", "key")


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a conversation's own turns with another beginning before them."""
    powers = [1]
    for _ in range(STRIDE):
        powers.append(powers[-1] * BASE % PRIME)
    for batch in batches:
        keys, parents = [], []
        for n, new, old, before, after in zip(*(column.to_pylist() for column in batch.columns[4:]), strict=True):
            if new != old:
                change = _number(new) - _number(old)
                power, last = (powers[n], powers[n - 1]) if n <= STRIDE else (pow(BASE, n, PRIME), pow(BASE, n - 1, PRIME))
                before, after = _bytes((_number(before) + change * last) % PRIME), _bytes((_number(after) + change * power) % PRIME)
            keys.append(after)
            parents.append(before)
        yield pa.record_batch([*batch.columns[:4], pa.array(keys, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "depth", "bytes", "whole", "key", "parent"])


# -- digests of the conversations that end at a node ---------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the ids that end there, in numerical order, joined by commas.

    The ids of a node may be a third of all: they are sorted over all tasks and
    joined to links of some thousand ids, and the links are hashed as a stream.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple[bytes | None, list[int]] = (None, [])
        for batch in batches:
            out: list[tuple[bytes, int, str]] = []
            for key, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != pending[0] or len(pending[1]) >= LINK:
                    if pending[1]:
                        out.append((pending[0], pending[1][0], ",".join(map(str, pending[1]))))
                    pending = (key, [])
                pending[1].append(conv)
            yield _links(out)
        if pending[1]:
            yield _links([(pending[0], pending[1][0], ",".join(map(str, pending[1])))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, sha256()
        for batch in batches:
            out = []
            for key, _, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = key, sha256()
                state.update(ids.encode())
            yield _pairs(out)
        if last is not None:
            yield _pairs([(last, state.hexdigest())])

    rows = ends.select("key", "conv_id")
    links = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(link, "key binary, first bigint, ids string")
    return links.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def _links(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["key", "first", "ids"])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], []]
    return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["key", "ends"])


# -- centroid decomposition within a task ---------------------------------------------------


def decompose(parents: list[int], weights: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums of ``weights`` over the subtree of every node of a forest whose parents stand before their children.

    A root has the parent -1.
    """
    width = len(weights[0]) if weights else 0
    sums = [[0] * width for _ in parents]
    trees: dict[int, list[int]] = {}
    top = list(range(len(parents)))
    for node, parent in enumerate(parents):
        top[node] = node if parent < 0 else top[parent]
        trees.setdefault(top[node], []).append(node)
    open_parts = list(trees.values())
    while open_parts:
        part = open_parts.pop()
        if len(part) == 1:
            sums[part[0]] = [a + b for a, b in zip(sums[part[0]], weights[part[0]], strict=True)]
            continue
        size = dict.fromkeys(part, 1)
        for node in reversed(part):
            if parents[node] in size:
                size[parents[node]] += size[node]
        # nodes with more than half below them are a chain from the top; the last is the deepest
        centroid = next(node for node in reversed(part) if 2 * size[node] > len(part))
        pieces: dict[int, list[int]] = {}
        piece = dict.fromkeys(part, -1)
        below = list(weights[centroid])
        for node in part:
            if node == centroid:
                continue
            parent = parents[node]
            piece[node] = node if parent == centroid else piece.get(parent, -1)
            pieces.setdefault(piece[node], []).append(node)
            if piece[node] >= 0:
                below = [a + b for a, b in zip(below, weights[node], strict=True)]
        node = centroid
        while node in size:
            sums[node] = [a + b for a, b in zip(sums[node], below, strict=True)]
            node = parents[node]
        open_parts.extend(pieces.values())
    return sums


def _per_component(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one component after the other, from batches sorted by their first column."""
    current: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if current and current[0][0] != row[0]:
                yield current
                current = []
            current.append(row)
    if current:
        yield current


_PART = "part binary, depth bigint, key binary, parent binary, leaf bigint, saved bigint, conv_id bigint, n_convs bigint, ends string"
_DONE = _PART + ", n_children bigint, parent_conv_id bigint, children_known boolean"
_DONE_NAMES = [field.strip().split(" ")[0] for field in _DONE.split(",")]


def _in_task(count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over subtrees of whole components, their rows sorted by part and depth.

    With ``count``, the components are whole subtrees of the trie: children are
    counted, childless nodes are leaves, and parents within the component are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _per_component(batches):
            place = {row[2]: at for at, row in enumerate(rows)}
            parents = [place.get(row[3], -1) for row in rows]
            children = [0] * len(rows)
            for parent in parents:
                if parent >= 0:
                    children[parent] += 1
            weights = [(int(not n) if count else row[4], row[5]) for row, n in zip(rows, children, strict=True)]
            for row, parent, n, total in zip(rows, parents, children, decompose(parents, weights), strict=True):
                named = rows[parent][6] if parent >= 0 else None
                out.append((*row[:4], *total, *row[6:], n, named, count))
            if len(out) >= 5000:
                yield _done(out)
                out = []
        if out:
            yield _done(out)

    return run


def _done(rows: list[tuple]) -> pa.RecordBatch:
    binary, whole = pa.binary(), pa.int64()
    kinds = [binary, whole, binary, binary, whole, whole, whole, whole, pa.string(), whole, whole, pa.bool_()]
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_DONE_NAMES)


def _decomposed(parts: DataFrame, count: bool) -> DataFrame:
    """Components of bounded weight, many in a task, each whole in one."""
    names = [field.strip().split(" ")[0] for field in _PART.split(",")]
    rows = parts.select(*names).repartition("part").sortWithinPartitions("part", "depth")
    return rows.mapInArrow(_in_task(count), _DONE)


# -- the forest ------------------------------------------------------------------------------


def nodes_of(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """key, depth, parent, conv_id, n_convs, bytes, weight, ends: a row per node; ``weight`` counts the paths' rows below."""
    rows = paths.withColumns({"n": F.lit(1).cast("bigint"), "ends": F.lit(None).cast("string")})
    digests = end_digests(ends).select(
        "key", "ends", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("conv_id", "depth", "parent", "bytes", "left", "n"))
    )
    return (
        rows.unionByName(digests)
        .groupBy("key")
        .agg(
            F.max("depth").alias("depth"),
            F.max("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"),
            F.max("bytes").alias("bytes"),
            F.sum("left").alias("weight"),
            F.max("ends").alias("ends"),
        )
    )


def split_large(heavy: DataFrame, ways: DataFrame, limit: int) -> DataFrame:
    """``heavy`` nodes in components of a weight of at most ``limit``, with what is already known of their sums.

    ``heavy`` holds key, parent, depth, owner (a conversation that passes the node),
    weight and the summed columns; ``ways`` the beginnings (conv_id, depth, key, parent) of
    the owners. In each round all components that are too large are split at their
    centroids; of the components only those are named by a table that is broadcast,
    and their number is at most the whole weight divided by ``limit``. Returned are
    the nodes with part, ``more_*`` (to be added to the sums within their part) and
    ``whole`` (a former centroid, whose sums are complete).
    """
    more = {f"more_{c}": F.lit(0).cast("bigint") for c in SUMMED}
    active = heavy.withColumns({"part": F.lit(ROOT), **more, "whole": F.lit(False)})
    finished: list[DataFrame] = []
    while True:
        totals = active.groupBy("part").agg(F.max("weight").alias("total")).where(F.col("total") > limit)
        known = active.join(F.broadcast(totals), "part").withColumn("on_path", 2 * F.col("weight") > F.col("total"))
        # the nodes on the path are a chain, so the deepest is one
        deepest = F.max(F.when(F.col("on_path"), F.struct("depth", "key", "weight"))).alias("c")
        found = known.groupBy("part").agg(deepest, F.max("total").alias("total"))
        centroids = written(found.select("part", "total", F.col("c.key").alias("c_key"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        if centroids.isEmpty():
            return _union([*finished, active])
        finished.append(active.join(F.broadcast(centroids.select("part")), "part", "left_anti"))
        marked = active.join(F.broadcast(centroids), "part").withColumn("on_path", 2 * F.col("weight") > F.col("total"))
        asked = marked.where(F.col("depth") > F.col("c_depth")).select("part", "owner", "c_key", (F.col("c_depth") + 1).alias("at")).distinct()
        steps = ways.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("key").alias("piece"), F.col("parent").alias("c_key"))
        pieces = asked.join(steps, ["owner", "at", "c_key"]).select("part", "owner", "piece")
        labelled = marked.join(pieces, ["part", "owner"], "left")
        # an owner may also own nodes of the part that lie above the centroid
        labelled = labelled.withColumn("piece", F.when(F.col("depth") > F.col("c_depth"), F.col("piece")))
        labelled = written(labelled.withColumn("centroid", F.col("key") == F.col("c_key")))
        below = labelled.where(F.col("centroid") | F.col("piece").isNotNull()).groupBy("part").agg(*(F.sum(c).alias(f"below_{c}") for c in SUMMED))
        summed = labelled.join(F.broadcast(below), "part")
        summed = summed.withColumns(
            {
                **{f"more_{c}": F.col(f"more_{c}") + F.when(F.col("on_path"), F.col(f"below_{c}")).otherwise(0) for c in SUMMED},
                "weight": F.when(F.col("on_path") & ~F.col("centroid"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")),
                "part": F.coalesce("piece", "part"),
                "whole": F.col("centroid"),
            }
        )
        summed = summed.select(*active.columns)
        finished.append(summed.where("whole"))
        active = summed.where(~F.col("whole"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def rolled_up(paths: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes`` with parent_conv_id, n_children, n_leaves and saved_tokens."""
    nodes = checkpoint(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    heavy = nodes.where(F.col("weight") > limit)
    few = broadcast_if_small(heavy.select("key"), FEW)
    # the last heavy node on the way of a conversation; below it all is light
    light = nodes.where(F.col("weight") <= limit).select("conv_id").distinct()
    on_way = paths.join(few, "key", "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
    starts = light.join(on_way, "conv_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint")))
    parts = paths.join(starts, ["conv_id", "depth"]).select("conv_id", F.col("key").alias("part"))
    bare = F.lit(0).cast("bigint").alias("leaf")
    subtrees = checkpoint(_decomposed(nodes.where(F.col("weight") <= limit).join(parts, "conv_id").withColumn("leaf", bare), count=True))
    tops = subtrees.where(F.col("key") == F.col("part")).select(F.col("parent").alias("key"), *SUMMED)
    # what hangs below a heavy node: light subtrees, and heavy children
    children = tops.unionByName(heavy.select(F.col("parent").alias("key"), *(F.lit(None).cast("bigint").alias(c) for c in SUMMED)))
    hanging = children.groupBy("key").agg(F.count(F.lit(1)).alias("n_children"), *(F.sum(c).alias(f"h_{c}") for c in SUMMED))
    childless = F.col("n_children").isNull()
    large = checkpoint(
        heavy.join(hanging, "key", "left").select(
            *("key", "depth", "parent", "conv_id", "n_convs", "weight", "ends"),
            F.col("conv_id").alias("owner"),
            F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
            (F.coalesce("h_leaf", F.lit(0).cast("bigint")) + F.when(childless, 1).otherwise(0)).cast("bigint").alias("leaf"),
            (F.coalesce("h_saved", F.lit(0).cast("bigint")) + F.col("saved")).alias("saved"),
        )
    )
    owners = broadcast_if_small(large.select(F.col("owner").alias("conv_id")).distinct(), FEW)
    ways = checkpoint(paths.join(few, "key", "left_semi").join(owners, "conv_id", "left_semi").select("conv_id", "depth", "key", "parent"))
    split = checkpoint(split_large(large, ways, limit))
    inside = _decomposed(split.where(~F.col("whole")), count=False).select("key", *(F.col(c).alias(f"in_{c}") for c in SUMMED))
    sums = split.join(inside, "key", "left")
    upper = sums.select(
        *("key", "depth", "parent", "conv_id", "n_convs", "ends", "n_children"),
        *((F.col(f"more_{c}") + F.coalesce(F.col(f"in_{c}"), F.lit(0))).alias(c) for c in SUMMED),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
    )
    lower = subtrees.select(*upper.columns)
    named = heavy.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    every = upper.unionByName(lower).join(broadcast_if_small(named, FEW), "parent", "left")
    return every.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))


def prefix_trie(
    conversations: DataFrame,
    donor: Column | None = None,
    lead: Column | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    task_weight: int = TASK_WEIGHT,
) -> DataFrame:
    """A row per distinct beginning of a conversation, the empty one included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens
    (over the subtree, the bytes of a node's last text times its members but one) and
    ends_sha256 (of the ids of members that end here, in order, joined by commas).

    Turns are ordered by ``turn``, null first; equal turns by the SHA-256 of role and
    text. Null roles and texts are empty; rows without a conversation are left out;
    repeated rows are turns each. With ``donor`` and ``lead`` (columns made of
    ``conv_id``; ``lead`` is at most 8) the first ``lead`` turns of a conversation are
    replaced by those of its donor, all if it has fewer, none if it doesn't exist; a
    conversation without any turn left is a member of the root. Other columns are
    ignored, and an empty table has no node. ``task_weight`` bounds the rows that a task
    decomposes; it grows with the table where it has to.
    """
    own = checkpoint(hashed_turns(digested(conversations, conv_id, turn, role, text)))
    itself = F.col("conv_id")
    paths, ends = rebuilt(own, itself if donor is None else donor, F.lit(0) if lead is None else lead)
    limit = max(task_weight, paths.count() // LARGE_PARTS)
    out = rolled_up(paths, nodes_of(paths, ends), limit)
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )
