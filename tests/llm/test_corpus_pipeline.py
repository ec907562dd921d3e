"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import hashlib

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken
from oracle import rows_of
from pyspark.sql import functions as F
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint

from faultledger.llm import byte_bpe, language_id, mixing, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """documents, then the rows after each stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for number, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{folder}/{number}")
        out.append(spark.read.parquet(f"{folder}/{number}"))
    return out


def test_columns(stages):
    for frame in stages[:-1]:
        assert tuple(frame.columns) == cp.COLUMNS
    assert len(cp.STAGES) == 5


def test_language(stages):
    docs, kept = stages[0], stages[1]
    model = queries.language_model(docs)
    ids = {r.doc_id for r in language_id.predict(docs, model).where("not rejected").collect()}
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where(F.col("doc_id").isin(list(ids))).collect()))
    assert kept.count() >= 0.98 * docs.count()


def test_lines(stages, tmp_path):
    stages[1].coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows, names = rows_of(queries.ORACLES["op6_line_dedup"], str(tmp_path))
    want = {(dict(zip(names, r, strict=True))["doc_id"], dict(zip(names, r, strict=True))["text"]) for r in rows}
    got = stages[2].collect()
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_duplicates(stages):
    before = stages[2].collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before}
    roots = plain_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    got = stages[3].collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())
    assert {repr(r) for r in got} <= {repr(r) for r in before}


def test_mix(stages):
    before, after = stages[3].collect(), stages[4].collect()
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    for source, target in plain_targets(sizes, mixing.WEIGHTS).items():
        largest = max(len(r.text.encode().split()) for r in before if r.source == source)
        assert abs(taken.get(source, 0) - target) <= largest / 2 + 1
    counts = {}
    for r in after:
        counts[r] = counts.get(r, 0) + 1
    assert set(counts) <= set(before) and max(counts.values()) <= 3


def test_tokens(stages):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, library.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()) == want


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(repr, cp.run(spark, SF_DIR).collect())) == sorted(map(repr, stages[5].collect()))


def test_edge_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "the cat sat on the mat", "en", "a", 22), (4, "the cat sat on the mat", "en", "a", 22), (None, "the dog sat by the door", "en", "a", 23), (5, "le chat est sur la table", "fr", "b", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, name in ((docs, "some"), (docs.limit(0), "none")):
        now = frame
        for number, (_, stage) in enumerate(cp.STAGES):
            stage(spark, now, SF_DIR).write.parquet(f"{tmp_path}/{name}{number}")
            now = spark.read.parquet(f"{tmp_path}/{name}{number}")
        assert (now.count() > 0) == (name == "some")
