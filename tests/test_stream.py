import os
from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from faultledger.config import Settings
from faultledger.plans.store import IncidentStore
from faultledger.sources.contracts import CONTRACTS, FUSION
from faultledger.streaming import changes
from faultledger.streaming import incidents as streaming

SETTINGS = Settings(single_incident_usd=100)
HEADER = "Customer,Create Date,Defect Type Sub Cat,Total Credit Requested,Total Labels Rejected\n"


@pytest.fixture
def drop(spark, tmp_path):
    """Drop files into a folder, and load what has arrived."""
    folder = tmp_path / "in"
    folder.mkdir()
    store = IncidentStore(spark, str(tmp_path / "store")).create()

    class Drop:
        incidents = store.incidents
        alerts = store.alerts

        def file(self, name, *rows, header=HEADER):
            (folder / name).write_text(header + "".join(f"{r}\n" for r in rows))

        def load(self, checkpoint="checkpoint", settings=SETTINGS, **kwargs):
            extract = streaming.read_extract_stream(spark, str(folder), FUSION, name_pattern="*.csv", **kwargs)
            rows = streaming.incident_stream(spark, {"Fusion": extract}, "s", settings)
            query = streaming.start_ingest(rows, store, str(tmp_path / checkpoint), "s", settings)
            query.awaitTermination()
            return store.incidents().count()

    drop = Drop()
    drop.store = store
    return drop


def test_only_new_files_are_loaded_and_nothing_twice(drop):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,1", "Beta,2025-06-11,Color,150,1")
    assert drop.load() == 2
    assert drop.load() == 2
    # The same rows under a new name, and one that is new.
    drop.file("2.csv", "Acme,2025-06-10,Sticking,50,9", "Beta,2025-06-11,Color,150,1", "Beta,2025-06-12,Color,200,1")
    assert drop.load() == 3
    # A lost checkpoint replays every file.
    assert drop.load("other") == 3
    assert "2.csv" in drop.incidents().where("incident_date = '2025-06-12'").first()["raw_source_file"]


def test_alerts_at_arrival(drop):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,1", "Beta,2025-06-11,Color,150,1")
    drop.load()
    (alert,) = drop.alerts().collect()
    assert alert["customer"] == "Beta" and alert["run_id"].startswith("s-") and alert["run_id"].endswith("-0")
    # A second query of the same name starts at batch 0 too; the first one's alerts stay.
    drop.file("2.csv", "Gamma,2025-06-12,Color,300,1")
    drop.load("other")
    assert sorted(r["customer"] for r in drop.alerts().collect()) == ["Beta", "Beta", "Gamma"]


def test_a_stream_tiers_and_logs_like_a_run(drop):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,1", "Beta,2025-06-11,Color,150,1")
    drop.load()
    assert sorted(r["customer_name"] for r in drop.store.customers().collect()) in ([], ["Acme", "Beta"])
    (run,) = drop.store.runs().collect()
    assert (run["status"], run["total_rows"], run["sources_loaded"]) == ("SUCCESS", 2, FUSION.label)


def test_alerts_on_new_rows_only(drop):
    settings = replace(SETTINGS, alert_on_new_rows_only=True)
    drop.file("1.csv", "Beta,2025-06-11,Color,150,1")
    drop.load(settings=settings)
    drop.file("2.csv", "Beta,2025-06-11,Color,150,9", "Gamma,2025-06-12,Color,300,1")
    drop.load(settings=settings)
    assert sorted(r["customer"] for r in drop.alerts().collect()) == ["Beta", "Gamma"]


def test_the_first_row_of_a_streamed_file_wins(drop):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,200", "Acme,2025-06-10,Sticking,50,100")
    drop.load()
    assert drop.incidents().first()["qty_affected"] == 200


def test_weekly_totals_of_the_incident_stream_are_those_of_the_facts(drop, spark, tmp_path):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,1", "Beta,2025-06-11,Color,150,1", "Beta,2025-06-20,Color,10,1")
    drop.load()
    drop.file("2.csv", "Acme,2025-06-10,Sticking,50,7", "Beta,2025-06-21,Color,20,1")
    drop.load()
    totals = streaming.weekly_totals(streaming.new_incidents(drop.store))
    streaming.land_complete(totals, str(tmp_path / "weeks"), str(tmp_path / "w")).awaitTermination()
    got = {(str(r["week_start"].date()), r["incidents"], r["credit_usd"]) for r in spark.read.parquet(str(tmp_path / "weeks")).collect()}
    assert got == {("2025-06-09", 2, 200.0), ("2025-06-16", 2, 30.0)}


def test_a_batch_may_be_split(drop):
    for i in range(4):
        drop.file(f"{i}.csv", "Acme,2025-06-10,Sticking,50,1", f"C{i},2025-06-11,Color,150,1")
    assert drop.load(max_files_per_trigger=1) == 5


def test_dirty_rows_are_cleaned_as_in_a_batch(drop):
    drop.file("1.csv", "N/A,2025-06-10,,-5,x", "Acme,junk,Color,1,1", "Acme,1900-01-01,Color,1,1")
    assert drop.load() == 1
    row = drop.incidents().first()
    assert (row["customer"], row["defect_category"], row["credit_requested_usd"], row["qty_affected"]) == ("Unknown", "Unknown", 0, 0.0)


def test_a_replayed_batch_adds_nothing(drop, incidents):
    load = streaming.load_batch(drop.store, SETTINGS, "s")
    rows = incidents(("s", "p", "c", "2025-06-10", "d", 500, 1))
    for _ in range(2):
        load(rows, 7)
    assert drop.incidents().count() == 1 and drop.alerts().count() == 1
    assert drop.incidents().first()["pipeline_run_id"] == "s-7"


def test_other_headers_are_an_error(drop):
    drop.file("1.csv", "2025-06-10,Acme,Sticking,50,1", header="Create Date,Customer,Defect Type Sub Cat,Total Credit Requested,Total Labels Rejected\n")
    with pytest.raises(StreamingQueryException):
        drop.load()


def test_declared_headers_decide_which_defaults_apply(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "a.csv").write_text("Customer Name,Report Date,Type,Net Credit $,Defective Qty\nAcme,2025-06-10,Print,5,1\n")
    contract = CONTRACTS["Vision_OAK"]
    headers = ["Customer Name", "Report Date", "Type", "Net Credit $", "Defective Qty"]
    extract = streaming.read_extract_stream(spark, str(folder), contract, headers)
    rows = streaming.incident_stream(spark, {"Vision_OAK": extract}, "s", SETTINGS)
    store = IncidentStore(spark, str(tmp_path / "store")).create()
    streaming.start_ingest(rows, store, str(tmp_path / "c"), "s").awaitTermination()
    row = store.incidents().first()
    assert (row["plant"], row["defect_category"]) == ("OAK CREEK PLANT", "Print")


def _events(spark, folder, *rows):
    data = [(datetime.fromisoformat(t), Decimal(a)) for t, a in rows]
    spark.createDataFrame(data, "event_time timestamp, credit_requested_usd decimal(18,6)").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("event_time timestamp, credit_requested_usd decimal(18,6)").parquet(folder)


def _weeks(spark, path):
    rows = spark.read.parquet(path).select(F.date_format("week_start", "yyyy-MM-dd").alias("w"), "incidents", "credit_usd")
    return sorted(tuple(r) for r in rows.collect())


def test_weekly_totals(spark, tmp_path):
    folder, out, closed = (str(tmp_path / n) for n in ("events", "out", "closed"))
    first = (("2025-06-15T23:59:59", 1), ("2025-06-16T00:00:00", 2), ("2025-06-18T00:00:00", 3))
    stream = _events(spark, folder, *first)
    streaming.land_complete(streaming.weekly_totals(stream), out, out + "_c").awaitTermination()
    streaming.land_closed(streaming.weekly_totals(stream, "1 day"), closed, closed + "_c").awaitTermination()
    assert _weeks(spark, out) == [("2025-06-09", 1, 1.0), ("2025-06-16", 2, 5.0)]
    assert _weeks(spark, closed) == [("2025-06-09", 1, 1.0)]
    # A late row counts in the complete totals, and is too late for a closed week.
    _events(spark, folder, ("2025-06-10T00:00:00", 10), ("2025-06-30T00:00:00", 1))
    streaming.land_complete(streaming.weekly_totals(stream), out, out + "_c").awaitTermination()
    streaming.land_closed(streaming.weekly_totals(stream, "1 day"), closed, closed + "_c").awaitTermination()
    assert _weeks(spark, out) == [("2025-06-09", 2, 11.0), ("2025-06-16", 2, 5.0), ("2025-06-30", 1, 1.0)]
    assert _weeks(spark, closed) == [("2025-06-09", 1, 1.0), ("2025-06-16", 2, 5.0)]


def test_rows_that_do_not_fit_are_set_aside_in_a_stream(drop):
    drop.file("1.csv", "Acme,2025-06-10,Sticking,50,1", "Beta,2025-06-11,Color,1,500,1,x", "Beta,2025-06-12")
    assert drop.load() == 2
    (row,) = drop.store.rejects().collect()
    assert (row["source"], row["line"]) == (FUSION.label, "Beta,2025-06-11,Color,1,500,1,x")


def test_an_extract_rewritten_in_place_is_read_again(spark, tmp_path):
    folder = tmp_path / "watched in"
    folder.mkdir()
    store = IncidentStore(spark, str(tmp_path / "store")).create()
    first = folder / "a Fusion Quality.csv"

    def write(path, *rows, at):
        path.write_text(HEADER + "".join(f"{r}\n" for r in rows))
        os.utime(path, (at, at))

    def watch():
        changes.start_watch(store, str(folder), str(tmp_path / "checkpoint"), "w", SETTINGS).awaitTermination()
        return store.incidents().count()

    assert watch() == 0
    write(first, "Acme,2025-06-10,Sticking,50,1", at=1000)
    (folder / "_b Fusion Quality.csv").write_text(HEADER + "Hidden,2025-06-10,Sticking,50,1\n")
    (folder / "no extract.csv").write_text("x\n")
    (folder / "x Vision OAK.parquet").write_text("this is not a parquet file")
    assert watch() == 1
    assert watch() == 1
    # the rows that are known, one that is new; and another file of the same source with other headers
    write(first, "Acme,2025-06-10,Sticking,50,9", "Beta,2025-06-11,Color,150,1", at=2000)
    (folder / "c Fusion Quality.csv").write_text("Create Date,Customer\n2025-06-12,Gamma\n")
    assert watch() == 3
    runs = store.runs().orderBy("started_at").collect()
    assert [r["total_rows"] for r in runs] == [1, 2]
    assert store.incidents().where("customer = 'Acme'").first()["qty_affected"] == 1
    assert store.incidents().where("customer = 'Beta'").first()["raw_source_file"].endswith("Quality.csv")
    states = store.arrivals().collect()
    assert len(states) == 4 and [r["failure"] != "" for r in states].count(True) == 1
    # a batch that is replayed finds all of it arrived
    load = changes.load_changes(store, SETTINGS, "again")
    load(spark.createDataFrame(changes.entries(f"file:{folder}"), "path string, modified bigint, size bigint"), 7)
    assert store.incidents().count() == 3 and store.runs().count() == 2


def test_a_late_row_corrects_its_week_alone(spark, tmp_path):
    def drop(*rows):
        schema = "event_time timestamp, credit_requested_usd decimal(18,6)"
        frame = spark.createDataFrame([(datetime.fromisoformat(d), Decimal(c)) for d, c in rows], schema)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        totals = streaming.weekly_totals(stream)
        streaming.land_changes(totals, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        weeks = streaming.latest_weeks(spark, str(tmp_path / "out")).orderBy("week_start").collect()
        return [(str(r["week_start"])[:10], r["incidents"], r["credit_usd"]) for r in weeks]

    assert drop(("2025-06-02", "1"), ("2025-06-10", "2"), ("2025-06-17", "4")) == [("2025-06-02", 1, 1.0), ("2025-06-09", 1, 2.0), ("2025-06-16", 1, 4.0)]
    assert drop(("2025-06-03", "8")) == [("2025-06-02", 2, 9.0), ("2025-06-09", 1, 2.0), ("2025-06-16", 1, 4.0)]
    versions = spark.read.parquet(str(tmp_path / "out")).groupBy("version").count().orderBy("version").collect()
    assert [r["count"] for r in versions] == [3, 1]
