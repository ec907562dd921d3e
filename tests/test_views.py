from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultledger.config import Settings
from faultledger.operators.filters import detail_filter, facet_filter, in_tiers
from faultledger.plans import alerting, detail, overview, report, root_cause, scorecard


def _rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture
def few(incidents):
    return incidents(
        ("B", "P1", "c1", "2025-03-31", "d1", 100, 1),
        ("B", "P1", "c1", "2025-04-01", "d2", 100, 1),
        ("A", "P2", "c1", "2025-04-06", "d2", 50, 1),
        ("A", "P2", "c2", "2025-04-07", "d3", 200, 1),
        ("A", "P1", "c3", "2025-04-30", "d1", 0, 1),
    )


@pytest.fixture
def none(incidents, few):
    return few.limit(0)


def test_kpi(few, none):
    assert _rows(overview.kpi(few)) == [(5, 450.0, 2, 3)]
    assert _rows(overview.kpi(none)) == [(0, 0.0, 0, 0)]


def test_sorting_is_by_credit_then_key(few):
    assert _rows(overview.by_source(few)) == [("A", 3, 250.0), ("B", 2, 200.0)]
    assert _rows(overview.by_plant(few)) == [("P2", 2, 250.0), ("P1", 3, 200.0)]
    assert _rows(overview.by_defect(few)) == [("d3", 1, 200.0), ("d2", 2, 150.0), ("d1", 2, 100.0)]
    assert _rows(overview.by_defect(few, 1)) == [("d3", 1, 200.0)]
    assert _rows(overview.by_customer(few, 2)) == [("c1", 3, 250.0), ("c2", 1, 200.0)]
    assert _rows(overview.customer_plant(few, 2)) == [("c1", "P1", 200.0), ("c2", "P2", 200.0)]
    assert _rows(overview.plant_defect(few, 2)) == [("P2", "d3", 200.0), ("P1", "d1", 100.0)]


def test_periods(few):
    assert _rows(overview.quarter_source(few)) == [
        ("2025Q1", "B", 100.0), ("2025Q2", "A", 250.0), ("2025Q2", "B", 100.0),
    ]
    pivot = overview.quarter_pivot(few, ["A", "B"])
    assert pivot.columns == ["quarter", "A", "B"]
    assert _rows(pivot) == [("2025Q1", 0.0, 100.0), ("2025Q2", 250.0, 100.0)]
    assert _rows(overview.month_trend(few)) == [("2025-03", 1, 100.0), ("2025-04", 4, 350.0)]
    assert _rows(detail.month_source(few)) == [
        ("2025-03", "B", 100.0), ("2025-04", "A", 250.0), ("2025-04", "B", 100.0),
    ]
    assert _rows(overview.source_span(few)) == [
        ("A", date(2025, 4, 6), date(2025, 4, 30)), ("B", date(2025, 3, 31), date(2025, 4, 1)),
    ]


def test_rows_without_a_date_are_in_no_period(few, incidents):
    more = few.unionByName(incidents(("A", "P1", "c1", None, "d1", 7, 1)))
    assert _rows(overview.month_trend(more)) == _rows(overview.month_trend(few))
    assert _rows(alerting.weekly_operations(more)) == _rows(alerting.weekly_operations(few))
    assert _rows(overview.kpi(more))[0][0] == 6


def test_facet_filter(few):
    assert facet_filter(few).count() == facet_filter(few, [], []).count() == 5
    assert facet_filter(few, ["A"]).count() == 3
    assert facet_filter(few, ["A"], ["P1"]).count() == 1
    assert facet_filter(few, start=date(2025, 4, 1), end=date(2025, 4, 7)).count() == 3


def test_detail_filter(few):
    assert detail_filter(few).count() == 5
    assert detail_filter(few, customer="c1", defect="d2", min_credit=60).count() == 1
    assert detail_filter(few, min_credit=100).count() == 3


def test_detail_summary(few, none):
    assert _rows(detail.summary(few)) == [(5, 450.0, 90.0)]
    assert _rows(detail.summary(none)) == [(0, 0.0, 0.0)]


def test_detail_display_and_export(spark, few, tmp_path):
    shown = detail.display(few)
    assert shown.columns == [
        "Incident Date", "Source System", "Plant", "Customer", "Defect Category",
        "Credit Requested (USD)", "Quantity Affected",
    ]
    assert [r[5] for r in shown.collect()] == [200, 100, 100, 50, 0]
    detail.export_csv(detail.records(few), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns[0] == "incident_date" and back.count() == 5


def test_export_keeps_texts_as_they_are(spark, tmp_path):
    texts = [" padded ", 'say "hi", twice', "two\nlines", "back\\slash", "tab\t"]
    detail.export_csv(spark.createDataFrame([(t,) for t in texts], "customer string"), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True)
    assert sorted(r[0] for r in back.collect()) == sorted(texts)


def test_pareto(few):
    more = root_cause.pareto(few, 5)
    assert [r[:3] for r in _rows(more)] == [("d3", 1, 200.0), ("d2", 2, 150.0), ("d1", 2, 100.0)]
    assert [round(r[3], 6) for r in _rows(more)] == [44.444444, 77.777778, 100.0]
    for n in (4, 21):
        with pytest.raises(ValueError):
            root_cause.pareto(few, n)


def test_pareto_share_is_of_the_listed_defects(incidents):
    many = incidents(*[("s", "p", "c", "2025-01-01", f"d{i:02}", 100 - i, 1) for i in range(12)])
    assert _rows(root_cause.pareto(many, 5))[-1][3] == 100.0


def test_pareto_of_nothing_but_zeros(incidents):
    zero = incidents(("s", "p", "c", "2025-01-01", "d", 0, 1))
    assert _rows(root_cause.pareto(zero)) == [("d", 1, 0.0, None)]


def test_heatmaps(few):
    cells = root_cause.heatmap_plant_defect(few)
    assert sorted(_rows(cells)) == [("P1", "d1", 100.0), ("P1", "d2", 100.0), ("P2", "d2", 50.0), ("P2", "d3", 200.0)]
    grid = root_cause.matrix(cells, "plant")
    assert grid.columns == ["plant", "d1", "d2", "d3"]
    assert _rows(grid) == [("P1", 100.0, 100.0, 0.0), ("P2", 0.0, 50.0, 200.0)]
    assert len(_rows(root_cause.heatmap_customer_defect(few))) == 4


def test_heatmap_keeps_only_the_leaders(incidents):
    many = incidents(*[("s", f"p{i:02}", "c", "2025-01-01", f"d{i % 12:02}", 1000 - i, 1) for i in range(24)])
    cells = root_cause.heatmap_plant_defect(many)
    assert {r[0] for r in _rows(cells)} == {f"p{i:02}" for i in range(10)}


def test_scorecard(few):
    assert _rows(scorecard.scorecard(few)) == [
        ("c1", 3, 250.0, 250 / 3, 100.0, "d2", "A, B", 2, "Low"),
        ("c2", 1, 200.0, 200.0, 200.0, "d3", "A", 1, "Low"),
        ("c3", 1, 0.0, 0.0, 0.0, "d1", "A", 1, "Low"),
    ]


def test_top_defect_is_by_count_then_by_name(incidents):
    rows = incidents(
        ("s", "p", "c", "2025-01-01", "costly", 900, 1),
        ("s", "p", "c", "2025-01-01", "often", 1, 1),
        ("s", "p", "c", "2025-01-02", "often", 1, 1),
        ("s", "p", "e", "2025-01-01", "b", 1, 1),
        ("s", "p", "e", "2025-01-01", "a", 1, 1),
    )
    assert {r["customer"]: r["top_defect"] for r in scorecard.scorecard(rows).collect()} == {"c": "often", "e": "a"}


def test_tiers_of_the_scorecard(few):
    limits = Settings(high_risk_usd=250, medium_risk_usd=200)
    assert _rows(scorecard.tier_counts(few, limits)) == [("High", 1), ("Medium", 1), ("Low", 1)]
    assert _rows(scorecard.tier_counts(few)) == [("High", 0), ("Medium", 0), ("Low", 3)]
    assert [r[0] for r in _rows(scorecard.top_customers(few, ["Medium", "Low"], settings=limits))] == ["c2", "c3"]
    assert [r[0] for r in _rows(scorecard.top_customers(few, n=1))] == ["c1"]
    assert in_tiers(scorecard.scorecard(few), []).count() == 0


def test_scorecard_display(few):
    shown = scorecard.display(scorecard.scorecard(few))
    assert shown.columns == [
        "Risk Classification", "Customer", "Incidents", "Total Credit (USD)", "Avg Credit (USD)",
        "Max Credit (USD)", "Primary Defect Type", "No. of Plants", "Source Systems",
    ]
    assert _rows(shown)[0] == ("Low", "c1", 3, "$250", "$83", "$100", "d2", 2, "A, B")


def test_high_value(few):
    rows = alerting.high_value(few, 100)
    assert rows.columns == ["incident_date", "source", "customer", "plant", "credit_requested_usd", "defect_category"]
    assert [r["credit_requested_usd"] for r in rows.collect()] == [200, 100, 100]
    assert alerting.high_value_display(few, 200).first()["credit_requested_usd"] == "$200.00"
    assert alerting.high_value(few).count() == 0


def test_repeat_customers(few, incidents):
    assert _rows(alerting.repeat_customers(few)) == [("c1", "2025-04", 2)]


def test_weeks_begin_on_monday(few):
    assert _rows(alerting.weekly_operations(few)) == [
        ("2025-04-28", 1, 0.0, 1, 1), ("2025-04-07", 1, 200.0, 1, 1), ("2025-03-31", 3, 250.0, 2, 1),
    ]
    assert _rows(alerting.weeks_over(few, 200)) == [("2025-03-31", 3, 250.0, 2, 1)]


def test_weekly_payload(few, none):
    assert _rows(alerting.weekly_payload(few)) == [(5, 450.0, "P2", "c1", "A, B", 2, 3)]
    assert _rows(alerting.weekly_payload(none)) == [(0, 0.0, "N/A", "N/A", "", 0, 0)]
    assert _rows(alerting.summary_row(few, "r")) == [("r", 5, "$450.00", "A, B", 2, 3)]


def test_equal_leaders_give_the_first_name(incidents):
    rows = incidents(("s", "q", "z", "2025-01-01", "d", 5, 1), ("s", "p", "y", "2025-01-01", "d", 5, 1))
    assert _rows(alerting.weekly_payload(rows))[0][2:4] == ("p", "y")


def test_facets(few):
    got = {}
    for facet, value in _rows(overview.facets(few)):
        got.setdefault(facet, []).append(value)
    assert got == {
        "source": ["A", "B"], "plant": ["P1", "P2"], "customer": ["c1", "c2", "c3"],
        "defect_category": ["d1", "d2", "d3"], "first_date": ["2025-03-31"], "last_date": ["2025-04-30"],
    }


def test_report_tables_equal_the_views(spark, facts, tmp_path):
    target = report.write_report(facts, str(tmp_path), "run-1", "2025-07-01 08:00")
    sources = sorted(r[0] for r in facts.select("source").distinct().collect())
    views = {
        "by_source": overview.by_source(facts),
        "quarter_pivot": overview.quarter_pivot(facts, sources),
        "by_plant": overview.by_plant(facts),
        "by_defect": overview.by_defect(facts),
        "by_customer": overview.by_customer(facts),
        "source_span": overview.source_span(facts),
        "customer_plant": overview.customer_plant(facts),
        "plant_defect": overview.plant_defect(facts),
        "summary": alerting.summary_row(facts, "run-1").withColumn("generated_at", F.lit("2025-07-01 08:00")),
    }
    for name, view in views.items():
        written = spark.read.parquet(f"{target}/{name}")
        assert sorted(written.columns) == sorted(view.columns), name
        assert sorted(_rows(written.select(*view.columns))) == sorted(_rows(view)), name
    raw = spark.read.parquet(f"{target}/raw")
    assert raw.count() == facts.count() and "incident_month" not in raw.columns


def test_report_as_csv_and_of_nothing(spark, few, none, tmp_path):
    assert report.write_report(none, str(tmp_path), "r", "now") == ""
    assert not list(tmp_path.iterdir())
    target = report.write_report(few, str(tmp_path), "r", "now", "csv")
    assert spark.read.csv(f"{target}/by_source", header=True).columns == ["source", "incidents", "credit_usd"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("pqr"), st.sampled_from("xyz"), st.integers(1, 28), st.sampled_from("de"), st.integers(0, 10**9)), min_size=1, max_size=30))
def test_sums_agree_and_partitioning_does_not_matter(incidents, drawn):
    rows = incidents(*[(s, p, c, f"2025-02-{d:02}", k, a / 1000, 1) for s, p, c, d, k, a in drawn])
    total = _rows(overview.kpi(rows))[0]
    for view in (overview.by_source, overview.by_plant, overview.month_trend, scorecard.scorecard):
        got = view(rows).agg(F.sum("incidents"), F.sum("credit_usd")).first()
        assert got[0] == total[0] and got[1] == pytest.approx(total[1])
    for view in (scorecard.scorecard, alerting.weekly_operations, root_cause.pareto):
        assert _rows(view(rows)) == _rows(view(rows.repartition(5)))
