"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte trigrams within words, weighted by TF-IDF and
scaled to length one. The model is fitted on a bounded sample of labelled rows: the
sample's trigram statistics give the IDF, and the vectors of each language are
clustered into a few centroids by spherical k-means. Prediction is the language of
the centroid with the largest cosine. A text further from that centroid than the
centroid's own radius allows is rejected; a text of few trigrams is far from every
centroid by chance alone, so its cosine is held against the one to be expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.llm.shared import quoted, schema_with, without

#: Hash buckets of a vector; a power of two.
WIDTH = 4096
#: Bytes of text that are made into vectors at once.
SLAB = 1_000_000
UNKNOWN = "und"

#: Lower-case ASCII letters and all bytes of longer characters stay, the rest separates words.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row for each text: how often each bucket's trigrams occur, over the whole text.

    Trigrams are the bytes of a letter with both neighbours, where a space stands
    for whatever is no letter.
    """
    out = np.zeros((len(texts), WIDTH), np.float32)
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= SLAB:
            size += len(texts[stop])
            stop += 1
        _count(texts[at:stop], out[at:stop])
        at = stop
    return out


def _count(texts: list[bytes], out: np.ndarray) -> None:
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    codes = LETTERS[joined].astype(np.uint32)
    middle = np.flatnonzero(codes[1:-1] != 32) + 1
    mixed = (codes[middle - 1] * np.uint32(0x9E3779B1)) ^ (codes[middle] * np.uint32(0x85EBCA77)) ^ (codes[middle + 1] * np.uint32(0xC2B2AE3D))
    buckets = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - WIDTH.bit_length() + 1)
    ends = np.cumsum([len(text) + 1 for text in texts])
    cuts = np.searchsorted(middle, [0, *(ends + 1)])
    for row, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        out[row] = np.bincount(buckets[a:b], minlength=WIDTH)


def unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: Of each centroid: position in ``languages``, variance of its trigrams, and the
    #: smallest share of the expected cosine that is not rejected.
    owner: np.ndarray
    spread: np.ndarray
    floor: np.ndarray

    def expected(self, sizes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Cosines of texts of so many trigrams drawn from the centroids ``near``."""
        return 1 / np.sqrt(1 + self.spread[near] / np.maximum(sizes, 1))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines in 0..1, and whether each text is too far from its centroid."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        counts = term_counts(texts)
        sizes = counts.sum(axis=1)
        cosines = unit(counts * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = cosines[np.arange(len(texts)), best].astype(np.float64).clip(0, 1)
        # a count of n scatters by a share of 1 / sqrt(n)
        floor = self.floor[best] * self.expected(sizes, best) * (1 - 1 / np.sqrt(np.maximum(sizes, 1)))
        return [self.languages[o] for o in self.owner[best]], score, (score < floor) | (score == 0)


def spread(centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of each centroid, the squared length that one drawn trigram adds by chance, as a share of the squared mean."""
    parts = np.maximum(centroids / idf, 0).astype(np.float64)
    parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1e-12)
    mean = ((parts * idf) ** 2).sum(axis=1)
    return (parts * (1 - parts) * idf**2).sum(axis=1) / np.maximum(mean, 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 20, least: float = 0.02) -> np.ndarray:
    """Centroids of spherical k-means; at most ``k``, each of ``least`` of the rows and of two at least.

    The first centroids are rows at even steps of the distance from the mean. A
    cluster of a few odd rows is dissolved: its centroid would be an outlier, and its
    radius would say nothing.
    """
    nearness = np.argsort(vectors @ unit(vectors.mean(axis=0, keepdims=True))[0], kind="stable")
    centroids = vectors[np.unique(nearness[((np.arange(k) + 0.5) * len(vectors) / k).astype(int)])]
    for _ in range(rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        sizes = np.bincount(owner, minlength=len(centroids))
        large = np.flatnonzero(sizes >= max(2, least * len(vectors)))
        if not len(large):
            large = sizes.argmax(keepdims=True)
        moved = unit(np.array([vectors[owner == c].mean(axis=0) for c in large]))
        if moved.shape == centroids.shape and np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str | None = None,
    per_language: int = 500,
    max_languages: int = 200,
    clusters: int = 4,
    quantile: float = 0.05,
    slack: float = 0.35,
) -> Model:
    """Fit on about ``per_language`` rows of each language, those with the smallest hash of ``key`` and text.

    The sample is a hash threshold, so it is the same in every run and has at most
    ``per_language * max_languages`` rows, give or take the chance of the hash; more
    languages than that raise an error. Null texts, null languages and texts
    without a letter are left out, repeated rows count once; no row at all gives a
    model that answers ``und``. Only counts over 4,096 buckets leave the executors,
    never texts. Rejection starts at the share ``slack`` of the ``quantile`` of a
    centroid's own rows, whose cosines are taken as shares of the expected ones; up
    to so many odd rows do not move it.
    """
    turn = F.xxhash64(quoted(key), quoted(text)) if key else F.xxhash64(quoted(text))
    rows = labelled.select(quoted(lang).alias("lang"), quoted(text).alias("text"), turn.alias("turn"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model([], np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(0), np.zeros(0))
    chosen = F.lit(False)
    for row in sizes:
        last = min(int((2 * per_language / row.n - 1) * 2**63), 2**63 - 1) if row.n > per_language else 2**63 - 1
        chosen = chosen | ((F.col("lang") == F.lit(row.lang)) & (F.col("turn") <= F.lit(last)))
    sample = rows.where(chosen).dropDuplicates(["lang", "turn"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                counts = term_counts([value.encode() for value in batch.column(1).to_pylist()])
                terms = [np.flatnonzero(row).astype("<i4") for row in counts]
                values = [row[t].astype("<f4").tobytes() for row, t in zip(counts, terms, strict=True)]
                columns = [batch.column(0), batch.column(2), pa.array([t.tobytes() for t in terms]), pa.array(values)]
                yield pa.record_batch(columns, names=["lang", "turn", "terms", "counts"])

    found = sample.select("lang", "text", "turn").mapInArrow(sparse, "lang string, turn bigint, terms binary, counts binary").collect()
    found.sort(key=lambda row: (row.lang, row.turn))
    counts = np.zeros((len(found), WIDTH), np.float32)
    for i, row in enumerate(found):
        counts[i, np.frombuffer(row.terms, "<i4")] = np.frombuffer(row.counts, "<f4")
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    vectors = unit(counts * idf)
    languages = sorted({row.lang for row in found})
    centroids, owner = [], []
    for number, language in enumerate(languages):
        mine = cluster(vectors[[row.lang == language for row in found]], clusters)
        centroids.append(mine)
        owner += [number] * len(mine)
    every = np.vstack(centroids)
    model = Model(languages, idf, every, np.array(owner), spread(every, idf), np.full(len(owner), slack))
    cosines = vectors @ model.centroids.T
    best = cosines.argmax(axis=1)
    share = cosines.max(axis=1) / model.expected(counts.sum(axis=1), best)
    for c in range(len(owner)):
        own = share[best == c]
        model.floor[c] = slack * min(np.quantile(own, quantile), 1) if len(own) else slack
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected (columns of these names are replaced).

    The whole text counts, and nothing else of the row. A text that is null or has
    no letter gives ``und``, score 0, rejected. A text with letters always gets a
    learned language (``und`` only if none was learned); ``rejected`` tells that it
    is too far from it. Repeated rows stay; a table without rows gives none.
    """
    docs = without(docs, "lang_pred", "score", "rejected")
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))
    flagged = docs.withColumn("lang_pred", has_letter(quoted(text)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                lettered = batch.column(batch.num_columns - 1).to_pylist()
                texts = [value.encode() if ok else b"" for value, ok in zip(batch.column(at).to_pylist(), lettered, strict=True)]
                langs, score, far = spread.value.predict(texts)
                langs = [lang if ok else UNKNOWN for lang, ok in zip(langs, lettered, strict=True)]
                known = np.array(lettered, bool)
                out = [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far | ~known)]
                yield pa.record_batch([*batch.columns[:-1], *out], names=schema.names)

    return flagged.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only."""
    return predict(docs, model, text).where("not rejected").select(*(quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")))
