"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits differ in at most
as many of their 8 bytes, hence share at least ``8 - max_bits`` positional bytes:
the guaranteed minimum. A single (position, byte) posting holds one fingerprint in
256, so postings are intersected before they are read: of the guaranteed matches at
least half, rounded up, lie in the front or in the back half of the bytes, and the
index key is every such choice of positions with its bytes (for 3 bits: 8 keys of 3
bytes). Whoever meets in a posting has the shared bytes tallied, is dropped below
the minimum, and is verified by its differing bits.

A posting passes on a spanning forest of its links, not its pairs: components need
no more. Long postings are cut into blocks, and every two blocks meet in a row of
their own, so no task holds a whole posting. Copies count once: fingerprints are
made distinct before they are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import broadcast_if_small, checkpoint, free_name, quoted, schema_with, without, written

#: Fingerprints of a posting that one row holds.
BLOCK = 1024
SEED = 42
#: Links among distinct fingerprints (16 bytes each) that one task labels.
EDGES_OF_A_TASK = 200_000
#: Rows that go whose numbers (some 30 bytes each) are broadcast.
FEW_LOSERS = 1_000_000


def fingerprint_of(text: str | None, size: int) -> int:
    """The fingerprint of one text, signed.

    Words are split at ASCII white space, A-Z lower-cased; fewer than ``size`` words
    are one shingle; no word gives zero. A bit is set if over half the hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, out: str = "simhash") -> DataFrame:
    """Add the SimHash of every whole ``text`` as a long; a null text has no words, so zero."""
    docs = without(docs, out)
    schema = schema_with(docs, (out, T.LongType()))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(value, size) for value in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def index_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of the index keys: each pair within ``max_bits`` agrees on all bytes of one."""
    if not 0 <= max_bits <= 7:
        raise ValueError("a byte index needs a distance of 0 to 7 bits")
    need = (8 - max_bits + 1) // 2
    return [chosen for half in (range(4), range(4, 8)) for chosen in combinations(half, need)]


def _forest(left: np.ndarray, right: np.ndarray, within: bool, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``left`` (if ``within``) or between it and ``right``."""
    nodes = left if within else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least = 8 - max_bits
    shift = 0 if within else len(left)
    out = []
    for i in range(len(left)):
        others = right[i + 1 :] if within else right
        if not len(others):
            break
        differing = others ^ left[i]
        shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        survivors = np.flatnonzero(shared >= least)
        survivors = survivors[np.bitwise_count(differing.view(np.uint64)[survivors]) <= max_bits]
        for j in (survivors + (i + 1 if within else shift)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links(prints: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """src, dst: links among distinct fingerprints (column ``fp``) that connect whatever is linked."""
    parts = []
    for number, positions in enumerate(index_positions(max_bits)):
        mask = sum(0xFF << 8 * p for p in positions)
        mask -= (mask >> 63) << 64
        parts.append(F.struct(F.lit(number).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes")))
    key = F.explode(F.array(*parts)).alias("key")
    postings = prints.select("fp", key)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = (
        postings.join(sizes, "key")
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("cuts"), "fp")
        .withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .groupBy("key", "cuts", "cut")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = checkpoint(blocks)
    alone = blocks.select("fps", F.lit(None).cast("array<bigint>").alias("others")).where(F.size("fps") > 1)
    lower = blocks.where("cuts > 1").select("key", "cut", "fps", F.explode(F.sequence("cut", F.col("cuts") - 1)).alias("other"))
    lower = lower.where("other > cut")
    upper = blocks.where("cuts > 1").select("key", F.col("cut").alias("other"), F.col("fps").alias("others"))
    met = alone.unionByName(lower.join(upper, ["key", "other"]).select("fps", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for fps, others in zip(batch.column(0), batch.column(1), strict=True):
                left = np.sort(fps.values.to_numpy())
                right = np.sort(others.values.to_numpy()) if others.is_valid else left
                found += _forest(left, right, not others.is_valid, max_bits)
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])

    return met.mapInArrow(run, "src bigint, dst bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for all nodes that ``edges`` (src, dst) name.

    Labels fall to the least of the neighbours' labels, then to the label of their
    label, until none changes; a chain of n nodes takes about log n rounds. Up to
    ``EDGES_OF_A_TASK`` edges a round is one task without shuffles, beyond that its
    joins are shuffled; the steps are the same.
    """
    edges = checkpoint(edges.select("src", "dst"))
    few = edges.count() <= EDGES_OF_A_TASK

    def gathered(frame: DataFrame) -> DataFrame:
        return frame.coalesce(1) if few else frame

    both = gathered(checkpoint(gathered(edges.union(edges.select("dst", "src"))).distinct()))
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
    labels = checkpoint(labels.select("node", F.least("node", "near").alias("label")))
    while True:
        labels = gathered(labels)
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        # the label of a node takes the least that any of its followers has seen
        seen = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = seen.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("pulled"))
        stepped = seen.join(hooked, "node", "left").select("node", "old", F.least("label", F.coalesce("pulled", "label")).alias("label"))
        stepped = gathered(checkpoint(stepped))
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        again = checkpoint(stepped.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")))
        labels = again.select("node", "label")
        if again.where("label <> old").isEmpty():
            return labels


def simhash_groups(prints: DataFrame, doc_id: str = "doc_id", fp: str = "simhash", max_bits: int = 3) -> DataFrame:
    """fp, component_id, keeper: of every distinct fingerprint its component.

    ``component_id`` is the smallest id in the component, null only if no id in it is
    known; ``keeper`` is the smallest fingerprint among the rows with that id.
    """
    distinct = checkpoint(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    labels = components(links(distinct, max_bits))
    joined = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    joined = checkpoint(joined)
    best = joined.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "fp")).alias("best"))
    return joined.join(best, "label").select("fp", F.col("best.least").alias("component_id"), F.col("best.fp").alias("keeper"))


def _prints(docs: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    pair = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return checkpoint(fingerprints(pair, "text", size).select("doc_id", "simhash"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, simhash, component_id of every row of ``docs``, whatever else it holds.

    Links join fingerprints at ``max_bits`` or fewer differing bits; documents
    without words have fingerprint zero and are linked like any other. Repeated
    rows are repeated in the result; a null id never names a component that has a
    known one; an empty table gives an empty result.
    """
    prints = _prints(docs, text, doc_id, size)
    groups = simhash_groups(prints, max_bits=max_bits).select(F.col("fp").alias("simhash"), "component_id")
    return prints.join(groups, "simhash").select("doc_id", "simhash", "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` of each component: that with its smallest id.

    Of repeated rows with that id one stays; where rows with one id differ, that
    with the smallest fingerprint. Columns are those of ``docs``. The rows that go
    are found by number: up to ``FEW_LOSERS`` of them are broadcast and no text is
    shuffled, beyond that rows meet by their numbers, of which none is hot.
    """
    fp, number = free_name(docs, "simhash"), free_name(docs, "row_number")
    # every text is hashed once; from here on a row is its number
    whole = written(fingerprints(docs, text, size, fp).withColumn(number, F.monotonically_increasing_id()))
    prints = whole.select(quoted(doc_id).alias("doc_id"), quoted(fp).alias("simhash"), quoted(number).alias("number"))
    groups = simhash_groups(prints, max_bits=max_bits)
    # joined on the id as well: the copies of a hot fingerprint spread over all tasks
    best = groups.where("fp = keeper").select(F.col("fp").alias("simhash"), _id_key(F.col("component_id")).alias("key"))
    found = prints.withColumn("key", _id_key(F.col("doc_id"))).join(best, ["simhash", "key"])
    kept = found.groupBy("simhash", "key").agg(F.min("number").alias("number"))
    losers = checkpoint(prints.join(kept, "number", "left_anti").select(F.col("number").alias(number)))
    left = whole.join(broadcast_if_small(losers, FEW_LOSERS), number, "left_anti")
    return left.select(*(quoted(c) for c in docs.columns))


def _id_key(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("unknown"))
