"""A corpus pipeline over documents: each stage is one operator of ``faultledger.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
as Parquet below the folder in ``spark.checkpoint.dir`` and reads it again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultledger.llm import language_id, line_dedup, mixing, queries, simhash  # noqa: E402
from faultledger.llm.shared import shared_folder, table  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; those that it rejects go."""
    return language_id.identified(docs, queries.language_model(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on too many documents of their source."""
    out = line_dedup.drop_lines(docs, host="source", ratio=queries.LINE_RATIO, min_pages=queries.LINE_PAGES)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return simhash.simhash_dedup(docs, size=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, or one to three times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return queries.bpe_round_trip(docs)


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", drop_boilerplate_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The first stage's model, and the hashes of the third and the last, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
