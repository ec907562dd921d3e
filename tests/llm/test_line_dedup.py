"""Line deduplication against SQL, and edge rows."""

import pytest
from oracle import assert_same

from faultledger.llm import line_dedup, queries


@pytest.mark.parametrize("few", [50_000, -1])
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, monkeypatch, few, folder):
    monkeypatch.setattr(line_dedup, "FEW_HOSTS", few)
    sf_dir = f"/root/testdata/{folder}"
    rows = assert_same(queries.op6_line_dedup(spark, sf_dir), queries.ORACLES["op6_line_dedup"], sf_dir)
    assert folder == "sf0.001" or sum(r[1] for r in rows) > 0


def test_edge_rows(spark):
    footer = "all rights reserved"
    rows = [(i, f"page {i}\n  {footer}\t\n\nend {i}\n{footer}", "h", "x", None) for i in range(6)]
    rows += [(10, footer, "h", "x", None), (10, footer, "h", "x", None), (11, None, "h", "x", None), (12, "", None, "x", None), (13, footer, "other", "x", None)]
    rows += [(20 + i, f"{footer}\nown {i}", None, "x", None) for i in range(5)] + [(30, "long line " * 50_000 + f"\n{footer}", "h", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, `row` string, `drop` string")
    out = line_dedup.drop_lines(docs, lines="lines", dropped="dropped")
    assert out.columns == ["doc_id", "text", "host", "row", "drop", "lines", "dropped"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r["lines"], r.dropped))
    assert got[0] == [("page 0\n\nend 0", 4, 2)]
    assert got[10] == [(footer, 1, 0)] * 2, "a page of boilerplate alone is left whole"
    assert got[11] == [(None, 0, 0)] and got[12] == [("", 0, 0)] and got[13] == [(footer, 1, 0)]
    assert got[20] == [("own 0", 2, 1)]
    assert got[30][0][0] == "long line " * 50_000
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_edge_lines_of_a_few_hundredths_of_a_source_go(spark, tmp_path):
    def text(i):
        header = ["section news"] if i % 25 == 0 else []
        footer = ["printed by the press"] if i % 50 == 1 else []
        chance = ["so it goes"] if i % 100 == 2 else []
        return "\n".join([*header, f"first {i}", *chance, f"last {i}", *footer])

    rows = [(i, text(i), "en", "a", 0) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0] == ("first 0\nlast 0", 1) and got[1] == ("first 1\nlast 1", 1)
    assert got[2] == ("first 2\nso it goes\nlast 2", 0), "four pages are chance"
    assert sum(dropped for _, dropped in got.values()) == 16 + 8
