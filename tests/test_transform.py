from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from faultledger.config import Settings
from faultledger.functions.dates import parse_date
from faultledger.operators.cleaning import rule_counts, validate, validation_counts, value_counts
from faultledger.operators.currency import convert_to_usd
from faultledger.operators.mapping import DateRule, normalize
from faultledger.schemas import UNIFIED
from faultledger.sources.contracts import CONTRACTS
from faultledger.sources.extracts import Extract, prepare
from faultledger.testbed import star_extracts

RADIUS_ROW = {
    "Report#": "Q-4417", "Plant Name": "Harborside", "Customer": "Tern Bottling", "ReportDate": "2024-03-09",
    "Reason for Rejection": "Torn edge", "Value": "812.40", "Quantity": "37",
}
OBI_ROW = {
    "Plant Name": "Eastgate", "Customer": "Lark Foods", "Received Date": "2024-11-21",
    "General Category": "DIE CUT", "Specific Category": "SHIFTED",
    "Feedback Total Credit Requested": "94", "Qty in Question": "61",
}
VISION_ROW = {
    "Plant": "Oak", "Customer Name": "Acme", "Report Date": "2025-01-02", "Type": "Print",
    "Sub-Type": "Color", "Net Credit $": "10", "Defective Qty": "1",
}
FUSION_ROW = {
    "Customer": "Acme", "Create Date": "2025-01-02", "Defect Type Sub Cat": "Sticking",
    "Total Credit Requested": "10", "Total Labels Rejected": "1",
}


@pytest.fixture
def unify(spark):
    def run(run_id="run-1", fx=None, strict=False, contracts=CONTRACTS, **sources):
        extracts = {}
        for key, rows in sources.items():
            rows = rows if isinstance(rows, list) else [rows]
            schema = ", ".join(f"`{h}` string" for h in rows[0])
            frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
            contract = contracts.get(key)
            extracts[key] = Extract(prepare(frame, contract) if contract else frame, f"{key}.csv")
        return normalize(spark, extracts, run_id, contracts, fx, strict)

    return run


def _without(row, *headers):
    return {h: v for h, v in row.items() if h not in headers}


def test_unified_schema_and_values(unify):
    frame = unify(Radius=RADIUS_ROW, OBI=OBI_ROW)
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in UNIFIED]
    radius, obi = sorted(frame.collect(), key=lambda r: r["source"], reverse=True)
    assert tuple(radius) == (
        "Radius (L-MCC)", "Harborside", "Tern Bottling", date(2024, 3, 9), "Torn edge",
        Decimal("812.400000"), 37.0, "Radius.csv", "run-1",
    )
    assert tuple(obi)[:6] == (
        "OBI (L-FDC)", "Eastgate", "Lark Foods", date(2024, 11, 21), "DIE CUT - SHIFTED",
        Decimal("94.000000"),
    )


def test_run_id_is_stamped(unify):
    assert {r["pipeline_run_id"] for r in unify("night-7", Radius=RADIUS_ROW).collect()} == {"night-7"}


def test_radius_drops_rows_without_date_others_keep_them(unify):
    assert unify(Radius=RADIUS_ROW | {"ReportDate": None}).count() == 0
    assert unify(Radius=_without(RADIUS_ROW, "ReportDate")).count() == 0
    assert unify(Radius=RADIUS_ROW | {"ReportDate": "junk"}).first()["incident_date"] is None
    assert unify(Fusion=FUSION_ROW | {"Create Date": None}).count() == 1


def test_fusion_plant_is_constant(unify):
    assert unify(Fusion=FUSION_ROW | {"Plant": "x"}).first()["plant"] == "Rochester"


def test_default_is_for_an_absent_column_not_for_an_empty_cell(unify):
    assert unify(Vision_OAK=_without(VISION_ROW, "Plant")).first()["plant"] == "OAK CREEK PLANT"
    assert unify(Vision_MAS=_without(VISION_ROW, "Plant")).first()["plant"] == "MASON PLANT"
    empty = unify(Vision_OAK=VISION_ROW | {"Plant": None})
    assert empty.first()["plant"] == "nan"
    assert validate(empty).first()["plant"] == "Unknown"
    assert unify(Radius=_without(RADIUS_ROW, "Plant Name")).first()["plant"] == "Unknown"


def test_alternate_date_header_is_chosen_by_presence(unify):
    other = _without(OBI_ROW, "Received Date") | {"Received Dt": "2025-01-02"}
    assert unify(OBI=other).first()["incident_date"] == date(2025, 1, 2)
    both = OBI_ROW | {"Received Date": None, "Received Dt": "2025-01-02"}
    assert unify(OBI=both).first()["incident_date"] is None


@pytest.mark.parametrize(
    "cells,defect",
    [
        ({"Sub-Type": None}, "Print - nan"),
        ({"Type": None, "Sub-Type": None}, "nan - nan"),
        ({"Type": "- Print ", "Sub-Type": " -"}, "Print"),
        ({"Type": "-", "Sub-Type": "-"}, "Unknown"),
    ],
)
def test_two_level_category(unify, cells, defect):
    assert validate(unify(Vision_OAK=VISION_ROW | cells)).first()["defect_category"] == defect


def test_two_level_category_with_absent_columns(unify):
    def defect(**sources):
        return validate(unify(**sources)).first()["defect_category"]

    assert defect(Vision_OAK=_without(VISION_ROW, "Sub-Type")) == "Print"
    assert defect(Vision_OAK=_without(VISION_ROW, "Type")) == "Unknown - Color"
    assert defect(OBI=_without(OBI_ROW, "General Category", "Specific Category")) == "Unknown"


def test_strict_nulls_clean_missing_levels(unify):
    def defect(**cells):
        return validate(unify(strict=True, Vision_OAK=VISION_ROW | cells)).first()["defect_category"]

    assert defect(**{"Sub-Type": None}) == "Print"
    assert defect(**{"Type": None, "Sub-Type": None}) == "Unknown"


def test_numbers_that_do_not_parse_are_null_then_zero(unify):
    rows = [RADIUS_ROW | {"Value": v, "Quantity": v} for v in ("1,500", "$5", "1500d", "abc", None)]
    frame = unify(Radius=rows)
    assert {(r["credit_requested_usd"], r["qty_affected"]) for r in frame.collect()} == {(None, None)}
    assert {(r["credit_requested_usd"], r["qty_affected"]) for r in validate(frame).collect()} == {(0, 0.0)}


def test_unknown_source_is_left_out_and_nothing_gives_an_empty_frame(unify):
    assert unify(Radius=RADIUS_ROW, Other=RADIUS_ROW).count() == 1
    empty = unify(Other=RADIUS_ROW)
    assert empty.count() == 0 and empty.schema == UNIFIED


def test_a_source_that_cannot_be_mapped_does_not_stop_the_others(spark, unify):
    broken = Extract(None, "x.csv")
    good = Extract(prepare(spark.createDataFrame([tuple(FUSION_ROW.values())], list(FUSION_ROW)), CONTRACTS["Fusion"]), "f")
    assert normalize(spark, {"Radius": broken, "Fusion": good}, "r", CONTRACTS).count() == 1


def test_currency(spark):
    frame = spark.createDataFrame(
        [("Southfork", Decimal(240)), ("Quay", Decimal(33)), (None, Decimal(7)), ("Southfork", None)],
        "plant string, credit_requested_usd decimal(18,6)",
    )
    got = convert_to_usd(spark, frame, {"Southfork": 0.25}).collect()
    assert [r["credit_requested_usd"] for r in got] == [Decimal(60), Decimal(33), Decimal(7), None]
    assert got[0]["plant"] == "Southfork"
    assert convert_to_usd(spark, frame, {}) is frame


def test_default_rates(unify):
    rows = [RADIUS_ROW | {"Plant Name": p, "Value": "100"} for p in ("MCC Monterrey", "MCC Guadalajara", "MCC Montreal", "MCC Napa")]
    got = unify(fx=Settings().fx_rates, Radius=rows).orderBy("plant").collect()
    assert {r["plant"]: float(r["credit_requested_usd"]) for r in got} == {
        "MCC Monterrey": 5.0, "MCC Guadalajara": 5.0, "MCC Montreal": 74.0, "MCC Napa": 100.0,
    }


def test_a_plant_is_matched_after_its_spaces_are_stripped(unify):
    row = RADIUS_ROW | {"Plant Name": " MCC Montreal\t", "Value": "100"}
    assert unify(fx=Settings().fx_rates, Radius=row).first()["credit_requested_usd"] == Decimal(74)


def test_old_dates_are_dropped(incidents):
    rows = incidents(
        ("src", "Quay", "k", "1931-07-04", "d", 11, 3),
        ("src", "Quay", "k", "1999-12-31", "d", 12, 3),
        ("src", "Quay", "k", None, "d", 13, 3),
        ("src", "Quay", "k", "2000-01-01", "d", 14, 3),
        ("src", "Quay", "k", "2023-02-08", "d", 15, 3),
    )
    assert sorted(r["credit_requested_usd"] for r in validate(rows).collect()) == [14, 15]


def test_negative_credit_is_clipped_quantity_is_not(incidents):
    row = validate(incidents(("src", "Quay", "k", "2023-02-08", "d", -41, -3))).first()
    assert (row["credit_requested_usd"], row["qty_affected"]) == (0, -3.0)


def test_null_texts_become_unknown(spark):
    rows = spark.createDataFrame(
        [(None, None, None, date(2025, 1, 1), None, None, None, "f", "r")], UNIFIED
    )
    assert tuple(validate(rows).first())[:7] == (
        "Unknown", "Unknown", "Unknown", date(2025, 1, 1), "Unknown", 0, 0.0,
    )
    assert validate(rows).schema["credit_requested_usd"].dataType == UNIFIED["credit_requested_usd"].dataType


def test_conversion_comes_before_clipping(unify):
    row = RADIUS_ROW | {"Plant Name": "MCC Montreal", "Value": "-100"}
    assert validate(unify(fx=Settings().fx_rates, Radius=row)).first()["credit_requested_usd"] == 0


def test_rule_counts(spark):
    day = date(2025, 1, 1)
    rows = spark.createDataFrame(
        [
            ("s", "p", "c", None, "d", Decimal(-1), None, "f", "r"),
            ("s", "p", "c", date(1970, 1, 1), "d", None, None, "f", "r"),
            ("s", "p", "c", day, "d", Decimal(-1), None, "f", "r"),
            ("s", "p", "c", day, "d", None, 1.0, "f", "r"),
            ("s", "p", "c", day, "d", Decimal(1), 1.0, "f", "r"),
        ],
        UNIFIED,
    )
    assert validation_counts(rows).first().asDict() == {
        "total_rows": 5, "dropped_no_date": 1, "dropped_old_date": 1, "clipped_credit": 1,
        "filled_credit": 1, "oversized_credit": 0, "filled_quantity": 1, "kept_rows": 3,
    }


def test_rows_are_dropped_by_date_before_their_cells_are_mapped(spark):
    cells = [("c1", "2025-04-01", "-5"), ("c2", "1999-12-31", "-7"), ("c3", None, "1"), ("c4", "2001-1-4 ", None)]
    frame = spark.createDataFrame(cells, "Customer string, `Create Date` string, `Total Credit Requested` string")
    extracts = {"Fusion": Extract(frame, "f.json")}
    dates, values = DateRule(), Observation()
    unified = normalize(spark, extracts, "r", CONTRACTS, dates=dates)
    got = sorted(r["customer"] for r in validate(unified.observe(values, *value_counts())).collect())
    assert got == ["c1", "c4"]
    whole = normalize(spark, extracts, "r", CONTRACTS)
    assert {**dates.counts(), **values.get} == whole.agg(*rule_counts()).first().asDict()
    # the mapping of the other cells stands above the filter, which stands above the parsing of the date
    plan = normalize(spark, extracts, "r", CONTRACTS, dates=DateRule())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS credit_requested_usd") < plan.index("Filter") < plan.index("CollectMetrics")
    assert plan.index("CollectMetrics") < plan.index("AS _incident_date")


def test_dates_of_a_source_that_cannot_be_mapped_are_not_waited_for(spark):
    frame = spark.createDataFrame([("c1", "2025-04-01")], "Customer string, `Create Date` string")
    dates = DateRule()
    rows = normalize(spark, {"Fusion": Extract(frame, F.col("absent"))}, "r", CONTRACTS, dates=dates)
    assert rows.count() == 0
    assert dates.counts() == {"total_rows": 0, "dropped_no_date": 0, "dropped_old_date": 0}


def test_plain_dates_are_what_the_whole_parser_makes_of_them(spark):
    texts = ["2025-04-01", "2025-13-01", "2025-1-4 ", "2025-1-4T1", "20255-1-04", "+202-01-01", " 025-01-01", "2025--1-01"]
    # white space around them keeps texts from the short way
    both = [(t, f"\t{t}\t") for t in texts]
    found = spark.createDataFrame(both, "a string, b string").select(parse_date(F.col("a")), parse_date(F.col("b")))
    rows = [tuple(r) for r in found.collect()]
    assert [a for a, _ in rows] == [b for _, b in rows]
    assert str(rows[0][0]) == "2025-04-01" and rows[1][0] is None


def test_lines_are_not_joined_to_customers(spark, sf_dir):
    plan = star_extracts.raw_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    depth = {name: len(line) - len(line.lstrip(" :+-")) for line in joins for name in ("o_custkey", "l_orderkey") if name in line}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_landing_keeps_a_file_open_for_each_source(spark, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    default = spark.conf.get(name, None)
    rows = [(str(n), (*star_extracts.HEADERS, None)[n % 6]) for n in range(60)]

    def lines(session, _sf_dir):
        seen.append(session.conf.get(name, None))
        return session.createDataFrame(rows, "cust string, extract string")

    monkeypatch.setattr(star_extracts, "raw_lines", lines)
    landed = spark.read.parquet(star_extracts.landing(spark, "tables of this test"))
    assert sorted(tuple(r) for r in landed.fillna("", "extract").collect()) == sorted((c, e or "") for c, e in rows)
    assert seen == ["6"] and spark.conf.get(name, None) == default
