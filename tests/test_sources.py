import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from faultledger.fixed_values import NA_TOKENS, SOURCE_PATTERNS
from faultledger.operators.mapping import to_unified
from faultledger.schemas import FACT
from faultledger.sources import html_table
from faultledger.sources.contracts import CONTRACTS, FUSION, OBI, RADIUS, Field, vision
from faultledger.sources.detect import detect_source_files, find_latest_file, name_regex
from faultledger.sources.extracts import (
    NOT_JSON,
    POSITION,
    REJECT_LINE,
    REJECT_REASON,
    TOO_WIDE,
    Extract,
    ExtractError,
    csv_frames,
    read_csv,
    read_extract,
    read_extracts,
    rejected,
    unique_names,
)
from faultledger.sources.facts import load_incidents
from faultledger.sources.html_table import parse_first_table, read_html_table


def _file(folder, name, content="a\n1\n", mtime=None):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    if mtime:
        os.utime(path, (mtime, mtime))
    return str(path)


def _name(path):
    return path and path.rsplit("/", 1)[-1]


@pytest.mark.parametrize(
    "pattern,name,hit",
    [
        ("*Radius*MDA*.csv", "2025 Radius x MDA Log.csv", True),
        ("*Radius*MDA*.csv", "2025 Radius x MDA Log.csv.bak", False),
        ("*Radius*MDA*.csv", "radius mda.csv", False),
        ("a?c.[cx]sv", "abc.xsv", True),
        ("a?c.[!c]sv", "abc.csv", False),
        ("a+(b).csv", "a+(b).csv", True),
    ],
)
def test_name_patterns(spark, pattern, name, hit):
    frame = spark.createDataFrame([(name,)], "n string")
    assert frame.where(F.col("n").rlike(name_regex(pattern))).count() == int(hit)


def test_newest_file_per_source(spark, tmp_path):
    _file(tmp_path, "1 Radius MDA.csv", mtime=1_000)
    _file(tmp_path, "2 Radius MDA.csv", mtime=3_000)
    _file(tmp_path, "3 Radius MDA.csv", mtime=2_000)
    (tmp_path / "sub").mkdir()
    _file(tmp_path / "sub", "4 Radius MDA.csv", mtime=9_000)
    found = detect_source_files(spark, str(tmp_path), SOURCE_PATTERNS)
    assert list(found) == list(SOURCE_PATTERNS)
    assert _name(found["Radius"]) in ("2 Radius MDA.csv", "2%20Radius%20MDA.csv")
    assert found["Fusion"] is None
    assert find_latest_file(spark, str(tmp_path), "*.txt") is None


def test_missing_directory_has_no_files(spark, tmp_path):
    assert set(detect_source_files(spark, str(tmp_path / "no"), SOURCE_PATTERNS).values()) == {None}


def test_preferred_format_wins_over_a_newer_file(spark, tmp_path):
    _file(tmp_path, "Feedback_Report_01QUALC009.xls", mtime=9_000)
    found = detect_source_files(spark, str(tmp_path), SOURCE_PATTERNS)
    assert _name(found["OBI"]) == "Feedback_Report_01QUALC009.xls"
    _file(tmp_path, "Feedback_Report_01QUALC009.csv", mtime=1_000)
    found = detect_source_files(spark, str(tmp_path), SOURCE_PATTERNS)
    assert _name(found["OBI"]) == "Feedback_Report_01QUALC009.csv"


def test_a_detected_file_with_blanks_in_its_name_can_be_read(spark, tmp_path):
    _file(tmp_path, "Log of Radius MDA 2025.csv", "Report#,Customer\nR1,Acme\n")
    path = detect_source_files(spark, str(tmp_path), SOURCE_PATTERNS)["Radius"]
    assert read_extract(spark, path, RADIUS).frame.count() == 1


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_byte_order_mark_and_quotes(spark, tmp_path, multi_line):
    body = '\ufeffPlant Name,Customer\n"Acme, Inc","say ""hi"""\n'
    path = _file(tmp_path, "x.csv", body)
    frame = read_csv(spark, path, multi_line).drop(POSITION)
    assert frame.columns == ["Plant Name", "Customer"]
    assert [tuple(r) for r in frame.collect()] == [("Acme, Inc", 'say "hi"')]


def test_csv_quoted_line_break(spark, tmp_path):
    path = _file(tmp_path, "x.csv", 'a,b\n"one\ntwo",3\n')
    assert [tuple(r) for r in read_csv(spark, path).drop(POSITION).collect()] == [("one\ntwo", "3")]


def test_na_tokens_become_nulls(spark, tmp_path):
    lines = "".join(f'R{i},"{token}"\n' for i, token in enumerate(NA_TOKENS))
    path = _file(tmp_path, "x.csv", "Report#,Customer\n" + lines + "R99,NAN\nR100, NA \n")
    rows = read_extract(spark, path, RADIUS).frame.collect()
    assert len(rows) == len(NA_TOKENS) + 2
    assert sorted(r["Customer"] for r in rows if r["Customer"]) == [" NA ", "NAN"]


def test_noise_rows_are_dropped_only_if_the_id_column_exists(spark, tmp_path):
    with_id = _file(tmp_path, "a.csv", "Report#,Customer\nR1,Acme\n,Total\nN/A,x\n")
    without = _file(tmp_path, "b.csv", "Customer\nAcme\nTotal\n")
    assert read_extract(spark, with_id, RADIUS).frame.count() == 1
    assert read_extract(spark, without, RADIUS).frame.count() == 2


def test_json_and_parquet_extracts_are_text(spark, tmp_path):
    json = _file(tmp_path, "x.json", '{"Customer": "Acme", "Total Credit Requested": 12.5}\n{"Customer": "B"}\n')
    frame = read_extract(spark, json, FUSION).frame
    assert {f.dataType.simpleString() for f in frame.drop(POSITION).schema} == {"string"}
    assert {r["Total Credit Requested"] for r in frame.collect()} == {"12.5", None}
    folder = str(tmp_path / "x.parquet")
    spark.sql("select 'Acme' Customer, date'2025-06-05' `Create Date`, 12.5d `Total Credit Requested`").write.parquet(folder)
    row = read_extract(spark, folder, FUSION).frame.first()
    assert (row["Create Date"], row["Total Credit Requested"]) == ("2025-06-05", "12.5")


def test_plant_tag(spark, tmp_path):
    path = _file(tmp_path, "x.csv", "Plant\nA\n")
    assert read_extract(spark, path, vision("oak")).frame.first()["_plant_tag"] == "OAK"
    assert vision("xyz").label == "Vision (XYZ)" and vision("xyz").plant.default == "XYZ"


HTML = """<html><head><style>td {color: red}</style></head><body>
<!-- <table><tr><td>not this</td></tr></table> -->
<TABLE border="1"><THEAD><TR><TH>Plant Name</TH><TH>Customer</TH><th>Feedback Total Credit Requested</th></TR></THEAD>
<tbody>
<tr><td>Niles Plant</td><td> <b>Beta &amp; Sons</b> </td><td align="right">1,500</td></tr>
<tr><td>A &lt;B&gt;</td><td></td><td>3,200.50</td></tr>
<tr><td>one,two</td><td>Q&amp;lt;A</td><td>n/a
</tbody></TABLE>
<table><tr><td>second table</td></tr></table></body></html>"""


def test_html_table(spark, tmp_path):
    path = _file(tmp_path, "x.xls", HTML)
    frame = read_html_table(spark, path).drop(POSITION)
    assert frame.columns == ["Plant Name", "Customer", "Feedback Total Credit Requested"]
    assert [tuple(r) for r in frame.collect()] == [
        ("Niles Plant", "Beta & Sons", "1500"),
        ("A <B>", "", "3200.50"),
        ("one,two", "Q&lt;A", "n/a"),
    ]
    extract = read_extract(spark, path, OBI).frame
    assert [r["Customer"] for r in extract.collect()] == ["Beta & Sons", None, "Q&lt;A"]


@pytest.mark.parametrize(
    "text,value",
    [("1,500", "1500"), ("-1,234,567.89", "-1234567.89"), ("12,5", "125"), ("5,", "5"), ("1,5e3", "15e3"),
     ("1,,5", "1,,5"), (",5", ",5"), ("a,b", "a,b"), ("$1,500", "$1,500"), ("1500", "1500")],
)
def test_html_numbers_lose_separators(spark, tmp_path, text, value):
    path = _file(tmp_path, "x.xls", f"<table><tr><th>a</th></tr><tr><td> {text}\n</td></tr></table>")
    assert read_html_table(spark, path).first()["a"] == value


def test_html_table_without_header_row(spark, tmp_path):
    path = _file(tmp_path, "x.xls", "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td></tr></table>")
    frame = read_html_table(spark, path).drop(POSITION)
    assert frame.columns == ["0", "1"]
    assert [tuple(r) for r in frame.collect()] == [("a", "1"), ("b", None)]


def test_html_table_with_equal_headers(spark, tmp_path):
    path = _file(tmp_path, "x.xls", "<table><tr><th>a</th><th>a</th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert read_html_table(spark, path).drop(POSITION).columns == ["a", "a.1"]


DIRTY = """<p>x</p><table><tr></tr></table>
<table><thead><tr><td colspan=2>Where</td><td>How many</td></tr><tr><td>Plant Name</td><td>Customer</td><td>Qty in Question</td></tr></thead>
<tr><td rowspan="2">Caf&eacute; &#233; &#xE9;</td><td>A<table><tr><td>in</td></tr></table></td><td>1</td></tr>
<tr><td>B</td><td>2</td></tr>
<tr><td colspan="2">both</td><td>3</td></tr>
<tr><td>C</td><td>D</td><td>4,000</td></tr></table><table><tr><td>no</td></tr></table>"""


def test_html_spans_references_nested_tables_and_headings_of_plain_cells(spark, tmp_path):
    frame = read_html_table(spark, _file(tmp_path, "x.xls", DIRTY))
    assert frame.columns[:3] == ["Plant Name", "Customer", "Qty in Question"]
    assert [tuple(r)[:3] for r in frame.collect()] == [
        ("Café é é", "A in", "1"),
        ("Café é é", "B", "2"),
        ("both", "both", "3"),
        ("C", "D", "4000"),
    ]


def test_html_rowspan_covers_all_its_rows():
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 2500))
    table = "<table><tr><th>plant</th><th>n</th></tr><tr><td rowspan={}>A</td><td>0</td></tr>" + rows + "{}</table>"
    long = parse_first_table(table.format(2500, "<tr><td>B</td><td>9</td></tr>"))
    assert long[1:] == [(False, ["A", str(i)]) for i in range(2500)] + [(False, ["B", "9"])]
    group = parse_first_table(table.format(0, "<tfoot><tr><td>all</td><td>9</td></tr></tfoot>"))
    assert group[1:] == [(False, ["A", str(i)]) for i in range(2500)] + [(False, ["all", "9"])]
    wide = parse_first_table("<table><tr><td colspan=5000>x</td></tr></table>")
    assert len(wide[0][1]) == 1000


def test_html_rows_longer_than_the_header_fail(spark, tmp_path):
    table = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td>{}</tr><tr><td>3</td></tr></table>"
    path = _file(tmp_path, "x.xls", table.format("<td></td><td>3</td>"))
    with pytest.raises(Exception, match="more cells than its header"):
        read_html_table(spark, path).collect()
    blank = _file(tmp_path, "y.xls", table.format("<td> </td>"))
    assert [tuple(r)[:2] for r in read_html_table(spark, blank).collect()] == [("1", "2"), ("3", None)]


def test_html_table_without_header_is_as_wide_as_its_widest_row(spark, tmp_path):
    path = _file(tmp_path, "x.xls", "<table><tr><td>a</td></tr><tr><td>b</td><td>1</td><td>2</td></tr></table>")
    frame = read_html_table(spark, path).drop(POSITION)
    assert frame.columns == ["0", "1", "2"]
    assert [tuple(r) for r in frame.collect()] == [("a", None, None), ("b", "1", "2")]


def test_headers_that_occur_twice(spark, tmp_path):
    assert unique_names(["a", "a", None, "A", "a"], ["A"]) == ["a (0)", "a.1", "Unnamed: 2", "A", "a.2"]
    path = _file(tmp_path, "x.csv", "Customer,Customer,plant,Plant\nfirst,second,p,P\n")
    row = read_extract(spark, path, vision("oak")).frame.first()
    assert (row["Customer"], row["Customer.1"], row["Plant"]) == ("first", "second", "P")


def test_rows_longer_than_the_header_are_marked_with_their_line(spark, tmp_path):
    body = 'a,b\n1,2\n1,2,3\n1,2,,LOST\n5,6,,\n"7","8,9",""\n,"x ""y"", z",,"q"\n,,\n7\n'
    path = _file(tmp_path, "x.csv", body)
    (frame,) = csv_frames(spark, path)
    rejects = [tuple(r) for r in frame.where(rejected(frame)).select(REJECT_REASON, REJECT_LINE).collect()]
    assert rejects == [(TOO_WIDE, line) for line in ("1,2,3", "1,2,,LOST", ',"x ""y"", z",,"q"')]
    # whatever columns a query reads
    assert frame.where(rejected(frame)).count() == 3
    assert [tuple(r) for r in frame.where(~rejected(frame)).select("b").collect()] == [("2",), ("6",), ("8,9",), (None,), (None,)]
    assert [tuple(r)[:2] for r in read_csv(spark, path).collect()] == [("1", "2"), ("5", "6"), ("7", "8,9"), (None, None), ("7", None)]
    short = _file(tmp_path, "y.csv", "a,b\n1\n1,2\n")
    assert [tuple(r)[:2] for r in read_csv(spark, short).collect()] == [("1", None), ("1", "2")]


def test_long_cells_and_breaks_in_a_line_that_does_not_fit(spark, tmp_path):
    long = "p" * 100_000 + '""' + "\n" + "q,"
    path = _file(tmp_path, "x.csv", f'a,b\n1,"{long}"\n1,"{long}",3\n')
    (frame,) = csv_frames(spark, path)
    assert [r[REJECT_LINE] for r in frame.where(rejected(frame)).collect()] == [f'1,"{long}",3']
    assert [r["b"] for r in read_csv(spark, path).collect()] == [long.replace('""', '"')]


def test_json_lines_that_are_no_record_are_marked(spark, tmp_path):
    path = _file(tmp_path, "x.json", '{"Customer": "Acme"}\n{"Customer": "B", \n{"Customer": "C", "Create Date": "2025-01-01"}\n')
    frame = read_extract(spark, path, FUSION).frame
    assert [tuple(r) for r in frame.where(rejected(frame)).select(REJECT_REASON, REJECT_LINE).collect()] == [(NOT_JSON, '{"Customer": "B", ')]
    assert [r["Customer"] for r in frame.where(~rejected(frame)).collect()] == ["Acme", "C"]


def _parts(tmp_path, name, *bodies):
    folder = tmp_path / name
    folder.mkdir()
    for n, body in enumerate(bodies):
        _file(folder, f"part {n}.{name.rsplit('.', 1)[1]}", body)
    return str(folder)


def test_csv_parts_are_read_by_their_own_headers(spark, tmp_path):
    path = _parts(
        tmp_path, "x.csv", "Customer,Credit\nacme,1\n", "\n\nCredit,Customer\n7,bolt\n", "Customer,Credit\nbeta,2\n",
        "\ufeffNote,Credit,customer \nn,3,gamma\n", "", "Customer\ndelta\n",
    )
    assert len(csv_frames(spark, path)) == 4
    rows = read_csv(spark, path)
    assert {(r["Customer"], r["Credit"], r["Note"], r["customer "]) for r in rows.collect()} == {
        ("acme", "1", None, None), ("beta", "2", None, None), ("bolt", "7", None, None), (None, "3", "n", "gamma"), ("delta", None, None, None),
    }
    places = [r[POSITION]["part"].rsplit("/", 1)[1] for r in rows.orderBy(POSITION).collect()]
    assert places == sorted(places) and len(places) == 5
    assert len(csv_frames(spark, _parts(tmp_path, "y.csv", "a,b\n1,2\n", "a,b\n3,4\n"))) == 1


def test_a_header_that_goes_on_after_its_first_line(spark, tmp_path):
    path = _parts(tmp_path, "x.csv", '"a\nb",c\n1,2\n', '"a\nB",d\n3,4\n', '"a\nb",c\n5,6\n')
    frames = csv_frames(spark, path)
    assert sorted(tuple(frame.columns[:2]) for frame in frames) == [("a\nB", "d"), ("a\nb", "c"), ("a\nb", "c")]


def test_defaults_apply_to_the_parts_that_lack_a_column(spark, tmp_path):
    path = _parts(tmp_path, "x.csv", "Plant,Customer Name\n,acme\nOslo,acme\n", "Customer Name\nacme\n")
    contract = vision("oak")
    rows = to_unified(read_extract(spark, path, contract), contract, "r").orderBy("row_order").collect()
    assert [r["plant"] for r in rows] == ["nan", "Oslo", contract.plant.default]


def test_html_parts_are_read_by_their_own_headers(spark, tmp_path):
    def page(head, *rows):
        cells = ["".join(f"<td>{cell}</td>" for cell in row) for row in rows]
        return f"<table><tr>{''.join(f'<th>{h}</th>' for h in head)}</tr>" + "".join(f"<tr>{c}</tr>" for c in cells) + "</table>"

    path = _parts(tmp_path, "x.xls", page("ab", "12"), page("ba", "34"), page("ab", "56"), page("cab", "789"), "no table")
    rows = read_html_table(spark, path)
    assert {(r["a"], r["b"], r["c"]) for r in rows.collect()} == {("1", "2", None), ("4", "3", None), ("5", "6", None), ("8", "9", "7")}
    same = read_html_table(spark, _parts(tmp_path, "y.xls", page("ab", "12"), page("ab", "34")))
    assert sorted(tuple(r)[:2] for r in same.collect()) == [("1", "2"), ("3", "4")]


def test_parquet_parts_are_read_by_name(spark, tmp_path):
    folder = str(tmp_path / "x.parquet")
    spark.sql("select 'Acme' Customer, 1 Credit").write.parquet(folder)
    spark.sql("select 'n' Note, 2 Credit, 'Bolt' Customer").write.mode("append").parquet(folder)
    frame = read_extract(spark, folder, FUSION).frame
    assert {(r["Customer"], r["Credit"], r["Note"]) for r in frame.collect()} == {("Acme", "1", None), ("Bolt", "2", "n")}


@pytest.mark.parametrize("span,rows", [("²", 1), (" 2 ", 2), ("-2", 1), ("2.5", 1)])
def test_spans_are_plain_numbers(span, rows):
    html = f"<table><tr><td rowspan='{span}'>x</td><td>1</td></tr><tr><td>y</td><td>z</td></tr></table>"
    assert parse_first_table(html)[1][1] == (["x", "y", "z"] if rows == 2 else ["y", "z"])


def test_pattern_characters_in_a_name(spark, tmp_path):
    _file(tmp_path, "Radius [1] {MDA} x.csv", "Report#,Customer\nR1,Acme\n")
    _file(tmp_path, "Radius 1 MDA.txt", "Report#,Customer\nR1,Acme\n")
    path = find_latest_file(spark, str(tmp_path), "*Radius*MDA*.csv")
    assert read_extract(spark, path, RADIUS).frame.count() == 1


def test_a_folder_of_part_files_is_one_extract(spark, tmp_path):
    _file(tmp_path, "old Radius MDA.csv", "Report#,Customer\nR0,Old\n", mtime=1_000)
    rows = spark.range(100).selectExpr("concat('R', id) as `Report#`", "'Acme' as Customer")
    rows.repartition(4).write.csv(str(tmp_path / "new Radius MDA.csv"), header=True)
    path = find_latest_file(spark, str(tmp_path), "*Radius*MDA*.csv")
    assert path.endswith("new Radius MDA.csv")
    assert read_extract(spark, path, RADIUS).frame.count() == 100


def test_a_large_csv_is_split_unless_it_has_quoted_breaks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        body = "a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(5000))
        path = _file(tmp_path, "x.csv", body)
        plain = read_csv(spark, path)
        assert plain.rdd.getNumPartitions() > 2
        contract = replace(FUSION, customer=Field(("a",)))
        rows = to_unified(Extract(plain, path), contract, "r").orderBy("row_order").collect()
        assert [r["customer"] for r in rows] == [str(i) for i in range(5000)], "the file's order under any splitting"
        broken = read_csv(spark, _file(tmp_path, "y.csv", body + '5,"p\nq"\n'))
        assert broken.rdd.getNumPartitions() == 1 and broken.count() == 5001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_bad_source_does_not_stop_the_others(spark, tmp_path):
    good = _file(tmp_path, "good.csv", "Customer\nAcme\n")
    files = {
        "Fusion": good,
        "Radius": str(tmp_path / "absent.csv"),
        "OBI": _file(tmp_path, "empty.xls", "<p>no table</p>"),
        "Vision_OAK": _file(tmp_path, "book.xyz", "x"),
        "Vision_MAS": None,
        "other": good,
    }
    extracts, failures = read_extracts(spark, files, CONTRACTS)
    assert list(extracts) == ["Fusion"]
    assert sorted(failures) == ["OBI", "Radius", "Vision_OAK"]
    with pytest.raises(ExtractError, match="Radius: cannot read"):
        read_extract(spark, files["Radius"], RADIUS)


def test_snapshot_stands_in_for_an_absent_or_empty_fact_table(spark, tmp_path):
    fact, snapshot = str(tmp_path / "fact"), str(tmp_path / "snapshot")
    assert load_incidents(spark, fact, snapshot).count() == 0
    rows = spark.sql("select 's' source, 'p' plant")
    rows.write.parquet(snapshot)
    assert load_incidents(spark, fact, snapshot).count() == 1
    spark.createDataFrame([], FACT).write.parquet(fact)
    assert load_incidents(spark, fact, snapshot).columns == ["source", "plant"]
    spark.range(2).select(F.lit("s").alias("source")).write.mode("append").parquet(fact)
    assert load_incidents(spark, fact, snapshot).count() == 2


@pytest.mark.parametrize(
    "html",
    [
        "<table><thead><tr><td>a</td></tr></thead><tr><td>1 &amp; 2</td><td>x</td></tr>\n<tr><td>&#62;</td><td></td></tr></table>",
        "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=3>A</td><td>0</td></tr><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>",
        "<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr><tr><td>1</td></tr></table><table><tr><td>no</td></tr></table>",
        "<table><tr><th>a<tr><td>1</td></tr><tr><td>2</td></tr><!-- <tr><td>no</td></tr> --><tr><td>3</td></tr></table>",
        "<table><tr><th>a</th></tr><script><tr><td>no</td></tr></script><tr><td>1</td></tr></table>",
        "<tr><td>no</td></tr><table><tr><td>&am<tr><td>p;</td></tr></table><tr><td>no</td></tr>",
        "<table><thead><tr><td>a</td></tr><tr><td>b</td></tr><tbody><tr><td>1</td></tr></table>",
    ],
)
def test_plain_html_rows_are_split_as_the_parser_reads_them(html, monkeypatch):
    found = parse_first_table(html)
    monkeypatch.setattr(html_table, "_PLAIN_ROWS", re.compile("(?!)"))
    assert found == parse_first_table(html)


def test_html_rows_are_parsed_once(spark, tmp_path):
    table = "<table><tr><th>a</th></tr><tr><td>{}</td></tr></table>"
    for at in range(3):
        _file(tmp_path, f"x{at}.xls", table.format(at))
    rows = read_html_table(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert sorted(r["a"] for r in rows.collect()) == ["0", "1", "2"]
    assert len(parse_first_table(table.format(1) + table, head_only=True)) == 2
