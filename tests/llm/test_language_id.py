"""Language identification: held-out accuracy, vectors against plain counting, edge rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from faultledger.llm import language_id, queries


def plain_trigrams(text):
    data = b" " + bytes(language_id.LETTERS[b] for b in text) + b" "
    return Counter(data[i - 1 : i + 2] for i in range(1, len(data) - 1) if data[i] != 32)


def test_counts_are_those_of_plain_trigrams(monkeypatch):
    texts = [b"", b"A", "Où est l'été?".encode(), b"ab ab\nab", b"..", b"x" * 50]
    alone = language_id.term_counts(texts)
    for text, row in zip(texts, alone, strict=True):
        want = plain_trigrams(text)
        assert row.sum() == sum(want.values())
        assert sorted(row[row > 0]) == sorted(want.values())
    monkeypatch.setattr(language_id, "SLAB", 3)
    assert (language_id.term_counts(texts) == alone).all()


def test_clusters_are_unit_and_several():
    points = language_id.unit(np.array([[1, 0, 0], [1, 0.1, 0], [0, 1, 0], [0, 1, 0.1]], np.float32))
    centroids = language_id.cluster(points, 2)
    assert centroids.shape == (2, 3)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1)
    owner = (points @ centroids.T).argmax(axis=1)
    assert owner[0] == owner[1] != owner[2] == owner[3]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_only_learns_from_rows_that_are_not_held_out(spark):
    rows = [(i, "aaa bbb" if i % 2 else "xyz xyz", ("p" if i % 2 else "q") if zlib.crc32(str(i).encode()) % 4 != 2 else "never", "s", 7) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert queries.language_model(docs).languages == ["p", "q"]


def test_edge_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("no lang", None), ("123", "fr")] * 3, "text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en"]
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 34 !", 0.5), (4, "the dog", 0.5), (4, "the dog", 0.5), (None, "die katze " * 30000, None), (6, "漢字漢字", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    out = language_id.predict(docs, model).collect()
    assert [r.lang_pred for r in out[:5]] == ["und", "und", "und", "en", "en"]
    assert out[5].lang_pred == "de" and out[6].lang_pred in ("de", "en") and out[6].rejected
    assert [r.rejected for r in out[:5]] == [True, True, True, False, False]
    kept = language_id.identified(docs.withColumnRenamed("Score", "n"), model)
    assert kept.columns == ["doc_id", "text", "n"] and kept.count() == 3
    assert language_id.predict(docs.limit(0), model).count() == 0
    empty = language_id.fit(train.where(F.lit(False)))
    assert [r.lang_pred for r in language_id.predict(docs, empty).collect()] == ["und"] * 7


ITALIAN = "La nostra casa si trova vicino al mare e ogni mattina andiamo a fare una passeggiata sulla spiaggia con il cane prima di tornare per la colazione"
HUNGARIAN = "A mi házunk a tenger közelében van és minden reggel sétálni megyünk a kutyával a parton mielőtt hazatérünk reggelizni a gyerekeinkkel"


def test_foreign_text_is_rejected_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(5)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 400)) for _ in range(50)]
    with open(language_id.__file__) as file:
        code = [part for part in file.read().split("\n\n\n") if len(part) > 300]
    foreign = [text.encode() for text in [ITALIAN, HUNGARIAN, *letters, *code]]
    clean = [r.text for r in docs.where(queries.held_out() & language_id.has_letter(F.col("text"))).collect()]
    short = [" ".join(text.split()[:6]).encode() for text in clean]
    model = queries.language_model(docs)
    assert model.predict(foreign)[2].mean() >= 0.9
    assert model.predict([text.encode() for text in clean])[2].mean() <= 0.01
    assert model.predict(short)[2].mean() <= 0.01


def test_an_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("lang <> 'de'"), key="doc_id")
    german = [r.text.encode() for r in docs.where("lang = 'de'").collect() if r.text]
    assert model.predict(german)[2].mean() >= 0.9


def test_odd_labelled_rows_do_not_move_the_radius(spark):
    words = ["the", "cat", "and", "dog", "sat", "on", "mat", "by", "door", "with", "bone"]
    rng = np.random.default_rng(6)
    rows = [(" ".join(rng.choice(words, 30)), "en") for _ in range(200)]
    odd = [("qqxz jjkw", "en"), ("zzvv wwyy", "en")]
    schema = "text string, lang string"
    alone, mixed = (language_id.fit(spark.createDataFrame(r, schema), clusters=1) for r in (rows, rows + odd))
    assert mixed.floor[0] > 0.9 * alone.floor[0] > 0
