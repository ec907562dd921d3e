from datetime import date

import pytest

from faultledger.config import Settings
from faultledger.plans import ingest as ingest_module
from faultledger.plans.ingest import ingest, run_pipeline
from faultledger.plans.store import IncidentStore
from faultledger.sources.contracts import CONTRACTS
from faultledger.sources.extracts import NOT_JSON, TOO_WIDE, Extract

RADIUS = """Report#,Plant Name,Customer,ReportDate,Reason for Rejection,Value,Quantity
R1,MCC Louisville,Acme Corp,2025-06-15,Color mismatch,60000.00,200
R2,MCC Monterrey,Acme Corp,6/16/2025,,1000,N/A
R2,MCC Monterrey,Acme Corp,6/16/2025,,1000,5
,,Total,,,61000,
R3,MCC Napa,Gone,,Color,10,1
R4,MCC Napa,Old,1900-01-01,Color,10,1
"""
OBI_HTML = """<table><tr><th>Plant Name</th><th>Customer</th><th>Received Dt</th><th>General Category</th>
<th>Specific Category</th><th>Feedback Total Credit Requested</th><th>Qty in Question</th></tr>
<tr><td>Niles Plant</td><td>Beta &amp; Co</td><td>2025-06-20</td><td>PRINT</td><td>COLOR</td><td>1,500</td><td>2,000</td></tr>
</table>"""
FUSION_JSON = """{"Customer": "Acme Corp", "Create Date": "2025-06-17 08:30:00", "Defect Type Sub Cat": "Sticking", "Total Credit Requested": 12.5, "Total Labels Rejected": 7}
"""


@pytest.fixture
def data_dir(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "Log Radius MDA.csv").write_text(RADIUS)
    (folder / "Feedback_Report_01QUALC009.xls").write_text(OBI_HTML)
    (folder / "Fusion Quality.json").write_text(FUSION_JSON)
    (folder / "Vision OAK.parquet").write_text("this is not a parquet file")
    return folder


def _run(spark, data_dir, tmp_path, **kwargs):
    return run_pipeline(spark, str(data_dir), str(tmp_path / "store"), as_of=date(2025, 7, 1), **kwargs)


def test_run_over_mixed_formats(spark, data_dir, tmp_path):
    result = _run(spark, data_dir, tmp_path, run_id="run-1")
    assert result.inserted == 4
    assert result.counts["dropped_old_date"] == 1
    assert list(result.failures) == ["Vision_OAK"]
    store = IncidentStore(spark, str(tmp_path / "store"))
    rows = {
        (r["source"], r["customer"]): r for r in store.incidents().collect() if r["customer"] != "Acme Corp" or r["source"] != "Radius (L-MCC)"
    }
    obi = rows["OBI (L-FDC)", "Beta & Co"]
    assert (float(obi["credit_requested_usd"]), obi["qty_affected"], obi["defect_category"]) == (1500.0, 2000.0, "PRINT - COLOR")
    fusion = rows["Fusion (Rochester)", "Acme Corp"]
    assert (fusion["incident_date"], fusion["plant"]) == (date(2025, 6, 17), "Rochester")
    converted = store.incidents().where("plant = 'MCC Monterrey'").first()
    assert (float(converted["credit_requested_usd"]), converted["defect_category"]) == (50.0, "Unknown")
    assert "Radius" in converted["raw_source_file"]
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == {"Acme Corp": "Medium", "Beta & Co": "Low"}
    assert [(r["customer"], r["run_id"]) for r in store.alerts().collect()] == [("Acme Corp", "run-1")]
    log = store.runs().first()
    assert (log["sources_detected"], log["sources_loaded"]) == ("Radius,Fusion,Vision_OAK,OBI", "Radius,Fusion,OBI")
    assert spark.read.parquet(f"{result.report}/summary").first()["incidents"] == 4

    again = _run(spark, data_dir, tmp_path, run_id="run-2")
    assert again.inserted == 0
    # The batch alerts again, although nothing was new.
    assert store.alerts().count() == 2
    only_new = _run(spark, data_dir, tmp_path, run_id="run-3", settings=Settings(alert_on_new_rows_only=True))
    assert only_new.inserted == 0 and store.alerts().count() == 2

    report = _run(spark, data_dir, tmp_path, run_id="run-4", report_only=True, report_format="csv")
    assert report.inserted == 0 and report.report.endswith("run_id=run-4")
    assert store.runs().count() == 3


def test_no_files_no_readable_file_no_valid_row(spark, tmp_path):
    empty = tmp_path / "in"
    empty.mkdir()
    assert _run(spark, empty, tmp_path) is None
    (empty / "Vision OAK.parquet").write_text("junk")
    assert _run(spark, empty, tmp_path) is None
    (empty / "Fusion Quality.csv").write_text("Customer,Create Date\nAcme,1900-01-01\n")
    assert _run(spark, empty, tmp_path) is None
    store = IncidentStore(spark, str(tmp_path / "store"))
    assert store.incidents().count() == store.runs().count() == 0
    assert run_pipeline(spark, str(empty), str(tmp_path / "store"), report_only=True).report == ""


def test_no_source_that_can_be_mapped(spark, tmp_path):
    store = IncidentStore(spark, str(tmp_path / "store")).create()
    assert ingest(store, {"Radius": Extract(None, "x"), "other": Extract(None, "y")}, "r") is None
    assert store.runs().count() == 0


def test_a_source_that_breaks_while_it_is_read(spark, data_dir, tmp_path, monkeypatch):
    """The cells of a row with too many of them can't be told apart; the other sources go on, staged once each."""
    stage, staged = ingest_module._stage, []
    monkeypatch.setattr(ingest_module, "_stage", lambda store, found, *rest: staged.append(*found) or stage(store, found, *rest))
    (data_dir / "Vision OAK.parquet").unlink()
    longer = "<tr>" + "<td>1</td>" * 8 + "</tr></table>"
    (data_dir / "Feedback_Report_01QUALC009.xls").write_text(OBI_HTML.replace("</table>", longer))
    result = _run(spark, data_dir, tmp_path, run_id="run-1")
    assert result.inserted == 3 and list(result.failures) == ["OBI"] and result.status == "SUCCESS"
    log = IncidentStore(spark, str(tmp_path / "store")).runs().first()
    assert (log["status"], log["sources_loaded"]) == ("SUCCESS", "Radius,Fusion")
    assert "more cells than its header" in log["error_message"]
    assert sorted(staged) == ["Fusion", "OBI", "Radius"]


def test_a_run_in_which_every_source_breaks_is_logged(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "Feedback_Report_01QUALC009.xls").write_text("<table><tr><th>Customer</th></tr><tr><td>Acme</td><td>x</td></tr></table>")
    result = _run(spark, folder, tmp_path, run_id="run-1")
    store = IncidentStore(spark, str(tmp_path / "store"))
    assert result.status == "FAILED" and result.inserted == 0 and list(result.failures) == ["OBI"]
    assert store.runs().first()["status"] == "FAILED" and store.incidents().count() == 0
    assert not list((tmp_path / "store").glob("staging/*")), "nothing staged stays"


def test_the_first_row_of_the_file_wins(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "Customer,Create Date,Defect Type Sub Cat,Total Credit Requested,Total Labels Rejected\n"
    (folder / "Fusion Quality.csv").write_text(head + "A,2025-06-01,Color,5,200\nA,2025-06-01,Color,5,100\n")
    _run(spark, folder, tmp_path)
    assert IncidentStore(spark, str(tmp_path / "store")).incidents().first()["qty_affected"] == 200


def test_amounts_beyond_the_type_stay_the_largest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "Report#,Plant Name,Customer,ReportDate,Reason for Rejection,Value,Quantity\n"
    rows = "R1,P,A,2025-06-01,c,1e12,1\nR2,MCC Montreal,B,2025-06-01,c,1e30,1\nR3,P,C,2025-06-01,c,inf,1\n"
    (folder / "Radius MDA.csv").write_text(head + rows)
    result = _run(spark, folder, tmp_path)
    assert (result.counts["oversized_credit"], result.counts["filled_credit"]) == (1, 1)
    store = IncidentStore(spark, str(tmp_path / "store"))
    credits = {r["customer"]: r["credit_requested_usd"] for r in store.incidents().collect()}
    assert credits["A"] == 10**12 and credits["B"] > 10**21 and credits["C"] == 0
    assert {r["customer"] for r in store.alerts().collect()} == {"A", "B"}
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == {"A": "High", "B": "High", "C": "Low"}


def test_two_loads_at_once_add_each_incident_once(spark, tmp_path, incidents):
    from concurrent.futures import ThreadPoolExecutor

    store = IncidentStore(spark, str(tmp_path / "store")).create()
    rows = incidents(*[("s", "p", f"c{i}", "2025-06-10", "d", i, 1) for i in range(20)])
    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(lambda _: IncidentStore(spark, store.root).insert_new(rows), range(3)))
    assert sorted(added) == [0, 0, 20] and store.incidents().count() == 20


def test_a_dead_lease_is_taken_over_and_a_live_one_is_not(spark, tmp_path, monkeypatch, incidents):
    from faultledger.plans import store as stores

    store = IncidentStore(spark, str(tmp_path / "store")).create()
    (tmp_path / "store" / "_lease").touch()
    monkeypatch.setattr(stores, "LEASE_WAIT_SECONDS", 0.5)
    rows = incidents(("s", "p", "c", "2025-06-10", "d", 1, 1))
    with pytest.raises(stores.StoreBusy):
        store.insert_new(rows)
    monkeypatch.setattr(stores, "LEASE_STALE_SECONDS", -1)
    assert store.insert_new(rows) == 1
    assert not (tmp_path / "store" / "_lease").exists()


def test_a_load_that_stood_still_adds_nothing_after_it_was_taken_over(spark, tmp_path, monkeypatch, incidents):
    from faultledger.plans import store as stores

    stalled, other = (IncidentStore(spark, str(tmp_path / "store")).create() for _ in range(2))
    rows = incidents(("s", "p", "c", "2025-06-10", "d", 1, 1))
    monkeypatch.setattr(stores, "LEASE_STALE_SECONDS", -1)
    decide = stalled.new_incidents

    def slow(*args):
        new = decide(*args)
        # meanwhile another load finds the mark too old, takes over and finishes
        assert other.insert_new(rows) == 1
        return new

    monkeypatch.setattr(stalled, "new_incidents", slow)
    with pytest.raises(stores.StoreBusy):
        stalled.insert_new(rows)
    assert other.incidents().count() == 1


def test_a_lease_is_renewed_while_it_is_held(spark, tmp_path, monkeypatch):
    from faultledger.plans import store as stores

    store = IncidentStore(spark, str(tmp_path / "store")).create()
    monkeypatch.setattr(stores, "LEASE_RENEW_SECONDS", 0.2)
    monkeypatch.setattr(stores, "LEASE_STALE_SECONDS", 2)
    monkeypatch.setattr(stores, "LEASE_WAIT_SECONDS", 4)
    with store.lease() as still_ours:
        with pytest.raises(stores.StoreBusy), IncidentStore(spark, store.root).lease():
            pass
        still_ours()
    with store.lease():
        # the end of a load takes away its own mark only
        (tmp_path / "store" / "._lease.crc").unlink()
        (tmp_path / "store" / "_lease").write_text("someone else")
    assert (tmp_path / "store" / "_lease").read_text() == "someone else"


def test_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    drop = tmp_path / "in"
    drop.mkdir()
    head = "Report#,Plant Name,Customer,ReportDate,Reason for Rejection,Value,Quantity\n"
    good = "R1,Oslo,Acme,2025-06-05,Print,10,1\n"
    (drop / "x Radius y MDA.csv").write_text(head + good + "R2,Oslo,Acme,2025-06-05,Print,1,500,1\n,Total,,,,,,9\n" + good)
    (drop / "x Fusion Quality.json").write_text('{"Customer": "B", "Create Date": "2025-06-01", "Total Credit Requested": 5}\n{"Customer"\n')
    for run in ("one", "two"):
        result = run_pipeline(spark, str(drop), str(tmp_path / "store"), run_id=run)
        assert result.counts["rejected_rows"] == 3 and result.counts["total_rows"] == 3
        assert result.counts["dropped_no_date"] == 0 and result.failures == {}
    store = IncidentStore(spark, str(tmp_path / "store"))
    assert store.incidents().count() == 2
    rows = store.rejects().where("run_id = 'two'").orderBy("source", "row_order").collect()
    assert [(r["source"], r["reason"], r["line"]) for r in rows] == [
        (CONTRACTS["Fusion"].label, NOT_JSON, '{"Customer"'),
        (CONTRACTS["Radius"].label, TOO_WIDE, "R2,Oslo,Acme,2025-06-05,Print,1,500,1"),
        (CONTRACTS["Radius"].label, TOO_WIDE, ",Total,,,,,,9"),
    ]
    assert rows[1]["raw_source_file"].endswith("MDA.csv") and rows[1]["row_order"]["part"].endswith("MDA.csv")
    assert store.rejects().count() == 6
    # nothing but rejects: they are kept, and nothing is loaded
    (drop / "x Fusion Quality.json").unlink()
    (drop / "x Radius y MDA.csv").write_text(head + "R2,Oslo,Acme,2025-06-05,Print,1,500,1\n")
    assert run_pipeline(spark, str(drop), str(tmp_path / "other"), run_id="bad") is None
    assert IncidentStore(spark, str(tmp_path / "other")).rejects().count() == 1
