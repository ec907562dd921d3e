"""Substring deduplication: seeds from winnowed anchors, extended both ways to maximal repeats.

A text is a sequence of words. Of the word k-grams in each window of ``length``
words, winnowing takes the one with the least hash as the window's anchor, so equal
windows have equal anchors wherever they stand. Neighbouring windows with equal
anchors form a span: the anchor extended to both sides as far as it decides (in a
text that repeats itself, over all the repetitions).

* Seed: anchors that occur in two documents or more; the others' windows are unique.
* Extend: occurrences of an anchor whose whole spans are equal match over the whole
  span, and all but those of the first document are repeats. Where the spans of an
  anchor differ, one of each kind is extended word by word: its windows are compared
  with the windows that the other kinds have around that anchor.
* Keep: the matched windows of a document, joined, are its maximal repeats; all are
  at least ``length`` words long, and they are cut out.

Documents are never paired. Copies meet in the first step with one row per span, and
are combined before the shuffle; the number of rows is linear in the number of words
whatever the groups are.

A word is hashed by a sum of mixed (letter, place) pairs, an anchor by a polynomial over
its few words, spans and windows by XXH3 over the hashes of their words. So no two of
the three share a structure: what is taken as equal has an equal anchor by one function
and an equal span or window by another one, 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import checkpoint, free_name, quoted, schema_with, without

#: Words of an anchor; below the window's length.
GRAM = 8
#: Bytes of text that are hashed at once.
SLAB = 1_000_000
#: Parts of the kinds of one anchor, which may have very many.
SALTS = 16
#: An unknown id comes after all others.
LAST = 2**63 - 1

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a winnowing key that hold the place; the rest are of the hash.
PLACES = np.uint64((1 << 30) - 1)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the hash base and of its inverse, modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(max(n + 1, SLAB + 1), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.reach(len(values))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)])

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from starts to ends, wherever they stand."""
        return scrambled((prefix[ends] - prefix[starts]) * self.down[starts])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    out, reach = keys, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - reach :][: len(keys) - width + 1])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word: its letters, each mixed with its place in the word, added up and mixed with their number."""
    sizes = ends - starts
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = data[np.repeat(starts, sizes) + within]
    mixed = scrambled((within.astype(np.uint64) << np.uint64(8)) + letters + np.uint64(BASE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    last = np.cumsum(sizes)
    return np.ascontiguousarray(scrambled(sums[last] - sums[last - sizes] + sizes.astype(np.uint64)))


class Slab:
    """Some texts as one sequence of words with running hashes."""

    def __init__(self, texts: list[bytes], powers: Powers) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[data]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.words = _word_hashes(data, starts, ends)
        self.powers = powers
        self.sums = powers.prefix(self.words)
        #: First word of each text, and the end.
        self.first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))

    def grams(self, starts: np.ndarray) -> np.ndarray:
        return self.powers.between(self.sums, starts, starts + GRAM)

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words from starts to ends, of any length."""
        said, digest = memoryview(self.words).cast("B"), xxhash.xxh3_64_intdigest
        places = zip((8 * starts).tolist(), (8 * ends).tolist(), strict=True)
        return np.fromiter((digest(said[a:b]) for a, b in places), np.uint64, len(starts))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and the text each is in."""
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        skipped = np.cumsum(counts) - counts
        return self.first[text] + np.arange(len(text)) - skipped[text], text

    def spans(self, length: int) -> tuple[np.ndarray, ...]:
        """text, anchor, span hash, first window (from the text's start) and number of windows of all spans."""
        at, text = self.windows(length)
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        grams = np.arange(len(self.sums) - GRAM)
        hashes = self.grams(grams)
        # of equal hashes the last counts
        keys = (hashes & ~PLACES) | (PLACES - grams.astype(np.uint64))
        least = _sliding_least(keys, length - GRAM + 1)[at]
        anchor = (PLACES - (least & PLACES)).astype(np.int64)
        said = hashes[anchor]
        new = np.concatenate([[True], (said[1:] != said[:-1]) | (np.diff(text) != 0)])
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        starts = at[heads]
        inside = self.stretches(starts, starts + counts + length - 1)
        whole = scrambled(inside + counts.astype(np.uint64))
        return text[heads], said[heads].view(np.int64), whole.view(np.int64), starts - self.first[text[heads]], counts


def _slabs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= SLAB:
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _texts(column: pa.Array) -> list[bytes]:
    return [(value or "").encode() for value in column.to_pylist()]


def spans(docs: DataFrame, length: int) -> DataFrame:
    """doc, body, anchor, span, first, windows of every span of ``docs`` (doc, body, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = _texts(batch.column(2))
            for a, b in _slabs(texts):
                text, *found = Slab(texts[a:b], powers).spans(length)
                ids = [batch.column(c).take(pa.array(text + a)) for c in (0, 1)]
                yield pa.record_batch([*ids, *(pa.array(x.astype(np.int64)) for x in found)], names=["doc", "body", "anchor", "span", "first", "windows"])

    return docs.mapInArrow(run, "doc bigint, body bigint, anchor bigint, span bigint, first bigint, windows bigint")


def _window_hashes(asked: DataFrame, length: int) -> DataFrame:
    """doc, body, anchor, window, first of every window of the spans asked for (doc, body, text, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = _texts(batch.column(2))
            wanted = batch.column(3)
            for a, b in _slabs(texts):
                slab = Slab(texts[a:b], powers)
                part = wanted.slice(a, b - a)
                text = np.repeat(np.arange(b - a), [len(x) for x in part])
                flat = part.flatten()
                anchor, first, windows = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "first", "windows"))
                row = np.repeat(np.arange(len(text)), windows)
                step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                place = first[row] + step
                at = slab.first[text[row]] + place
                hashes = slab.stretches(at, at + length).view(np.int64)
                ids = [batch.column(c).take(pa.array(text[row] + a)) for c in (0, 1)]
                yield pa.record_batch([*ids, pa.array(anchor[row]), pa.array(hashes), pa.array(place)], names=["doc", "body", "anchor", "window", "first"])

    return asked.mapInArrow(run, "doc bigint, body bigint, anchor bigint, window bigint, first bigint")


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """doc, body, cuts: starts and ends (in words) of what stands in an earlier document too."""
    texts = docs.select("doc", "body", "text")
    found = spans(texts, length)
    # checkpointed, so that the joins below have an exchange on both sides and hot keys can be split
    seeds = checkpoint(found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"))
    seeded = checkpoint(found.join(seeds, "anchor", "left_semi"))
    kinds = checkpoint(seeded.groupBy("anchor", "span").agg(F.min("doc").alias("owner")))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # one of several anchors may have a large part of all kinds, so its kinds are dealt by their spans too
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = kinds.withColumn("salt", F.pmod("span", F.lit(SALTS)).cast("int"))
    kinds = salted.join(several, ["anchor", "salt"], "left").select("anchor", "span", "owner", F.col("kinds").isNotNull().alias("open"))
    met = checkpoint(seeded.join(kinds, ["anchor", "span"]).where("doc > owner or open"))
    whole = met.where("doc > owner").select("doc", "body", "first", (F.col("first") + F.col("windows") + length - 1).alias("end"))
    asked = met.where("doc = owner").groupBy("doc", "body").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("asked"))
    windows = checkpoint(_window_hashes(texts.join(asked, ["doc", "body"]).select("doc", "body", "text", "asked"), length))
    owners = windows.groupBy("anchor", "window").agg(F.min("doc").alias("owner"), F.max("doc").alias("high")).where("owner < high")
    owners = checkpoint(owners.drop("high"))
    single = windows.join(owners, ["anchor", "window"]).where("doc > owner").select("doc", "body", "first", (F.col("first") + length).alias("end"))
    return whole.unionByName(single).groupBy("doc", "body").agg(F.collect_set(F.struct("first", "end")).alias("cuts"))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (columns of these names are replaced).

    A word goes if it is covered by a window of ``length`` words whose word sequence
    also starts in a row with a smaller ``key``; windows are those of the input.
    Words are split at ASCII white space and kept ones joined by one space. Repeats
    within a row or among rows of one key stay. A null key comes after all others;
    a null or empty text has no words and ``kept`` is empty; texts below ``length``
    words are kept. Repeated rows stay repeated.
    """
    if length <= GRAM:
        raise ValueError(f"windows need more than {GRAM} words")
    docs = without(docs, "n_words", "n_removed", "kept")
    doc, body, cuts = (free_name(docs, name) for name in ("doc", "body", "cuts"))
    named = (F.coalesce(quoted(key).cast("bigint"), F.lit(LAST)), F.xxhash64(quoted(text)))
    keyed = docs.select(named[0].alias("doc"), named[1].alias("body"), quoted(text).alias("text"))
    found = repeats(keyed, length).select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("cuts").alias(cuts))
    joined = docs.withColumns({doc: named[0], body: named[1]}).join(found, [doc, body], "left").select(*(quoted(c) for c in docs.columns), cuts)
    schema = schema_with(docs, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for value, gone in zip(_texts(batch.column(at)), batch.column(batch.num_columns - 1), strict=True):
                words = value.split()
                total = len(words)
                if gone.is_valid:
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, gone.values.field("first").to_numpy(), 1)
                    np.add.at(step, gone.values.field("end").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                counts.append((total, total - len(words)))
                kept.append(b" ".join(words).decode())
            numbers = np.array(counts, np.int64).reshape(-1, 2)
            yield pa.record_batch([*batch.columns[:-1], pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(kept, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
