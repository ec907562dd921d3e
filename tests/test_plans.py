"""The physical plans are the ones that hold at scale."""

import io
import re
from contextlib import redirect_stdout
from datetime import date

import pytest

from faultledger.functions.dates import DATE_FORMATS
from faultledger.operators.dedup import first_per_incident, not_in_history
from faultledger.operators.filters import detail_filter, facet_filter
from faultledger.plans import alerting, overview, root_cause, scorecard
from faultledger.testbed import star_extracts as star
from faultledger.testbed.catalog import AS_OF, _cleaned


def plan(frame, mode="formatted"):
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain(mode)
    return text.getvalue()


def read_columns(text):
    schema = re.search(r"ReadSchema: struct<(.*?)>\n", text)[1]
    return set(re.findall(r"(\w+):(?:string|date|double|timestamp|decimal|array)", schema))


VIEWS = {
    "kpi": (overview.kpi, {"plant", "customer", "credit_requested_usd"}),
    "by_source": (overview.by_source, {"source", "credit_requested_usd"}),
    "by_customer": (overview.by_customer, {"customer", "credit_requested_usd"}),
    "month_trend": (overview.month_trend, {"incident_date", "credit_requested_usd"}),
    "repeat": (alerting.repeat_customers, {"customer", "incident_date"}),
    "weekly": (alerting.weekly_operations, {"plant", "customer", "incident_date", "credit_requested_usd"}),
    "payload": (alerting.weekly_payload, {"source", "plant", "customer", "credit_requested_usd"}),
    "scorecard": (scorecard.scorecard, {"source", "plant", "customer", "defect_category", "credit_requested_usd"}),
    "pareto": (root_cause.pareto, {"defect_category", "credit_requested_usd"}),
    "heatmap": (root_cause.heatmap_customer_defect, {"customer", "defect_category", "credit_requested_usd"}),
}


@pytest.mark.parametrize("name", VIEWS)
def test_views_read_only_their_columns_in_one_scan(facts, name):
    view, columns = VIEWS[name]
    text = plan(view(facts))
    assert read_columns(text) == columns
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "partial_" in text


@pytest.mark.parametrize("name", ["kpi", "weekly", "payload", "scorecard", "pareto"])
def test_one_scan(facts, name):
    tree = plan(VIEWS[name][0](facts)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1


def test_heatmap_scans_once_when_it_runs(facts):
    cells = root_cause.heatmap_plant_defect(facts)
    cells.collect()
    tree = cells._jdf.queryExecution().executedPlan().toString()
    final = tree.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    assert "BroadcastHashJoin" in final


def test_filters_reach_the_scan(facts):
    text = plan(detail_filter(facet_filter(facts, ["radius"], start=date(2000, 3, 1), end=date(2000, 5, 2)), min_credit=9_000))
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", text)[1]
    for name in ("source", "incident_date", "credit_requested_usd"):
        assert name in pushed
    parts = re.search(r"PartitionFilters: \[(.*?)\]\n", text)[1]
    assert "incident_month" in parts and "2000-03" in parts and "2000-05" in parts


def test_rolling_window_reads_its_months(facts):
    text = plan(scorecard.rolling_tiers(facts, AS_OF))
    assert "2001-08" in re.search(r"PartitionFilters: \[(.*?)\]\n", text)[1]


def test_ranked_tables_keep_only_their_rows_per_task(facts):
    assert "TakeOrderedAndProject" in plan(overview.by_defect(facts))


def test_duplicates_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(first_per_incident(_cleaned(spark, sf_dir), whole_keys=True), "simple")
    assert text.count("Exchange hashpartitioning") == 1
    before = text.split("Exchange hashpartitioning")[1]
    assert "partial_min" in before and "Window" not in text


def test_history_is_not_shuffled_for_a_small_batch(spark, facts, sf_dir):
    batch = first_per_incident(_cleaned(spark, sf_dir), whole_keys=True)
    tree = plan(not_in_history(batch, facts, _cleaned(spark, sf_dir)), "simple")
    # The history is the scan whose columns are typed; what is above it, up to
    # the semi join, must not move rows.
    history = next(line for line in tree.splitlines() if "PartitionFilters: []" in line and "incident_date" in line)
    above = tree[: tree.index(history)].rsplit("LeftSemi", 1)
    assert len(above) == 2 and "Exchange" not in above[1] and "BroadcastHashJoin" in above[0].splitlines()[-1]
    assert "LeftSemi" not in plan(not_in_history(batch, facts), "simple")


def test_each_source_reads_its_own_files(spark, sf_dir):
    text = plan(_cleaned(spark, sf_dir))
    assert text.split("\n\n")[0].count("Scan parquet") == 5
    assert "Python" not in text and "hashpartitioning" not in text and "LocalTableScan" in text
    for key in star.HEADERS:
        assert re.search(rf"PartitionFilters: \[.*extract#\d+ = {key}\)", text)


def test_dates_are_parsed_once(spark, sf_dir):
    frame = _cleaned(spark, sf_dir)
    optimized = frame._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("gettimestamp(") == len(DATE_FORMATS) * len(star.HEADERS)
