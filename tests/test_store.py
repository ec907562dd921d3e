from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultledger.config import Settings
from faultledger.fixed_values import PLANTS
from faultledger.operators.dedup import first_per_incident, not_in_history, with_key
from faultledger.plans import overview, report, scorecard, sums
from faultledger.plans import store as store_module
from faultledger.plans.alerting import alert_rows
from faultledger.plans.scorecard import rolling_tiers
from faultledger.plans.store import IncidentStore, batch_facts
from faultledger.schemas import FACT, MONTH, ROW_ORDER, UNIFIED
from faultledger.testbed import star_extracts as star
from faultledger.testbed.catalog import _cleaned

NOW = datetime(2025, 7, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return IncidentStore(spark, str(tmp_path / "store")).create()


def _three(incidents, run_id):
    return incidents(
        *[("Fusion (Rochester)", "Rochester", f"Customer {i}", "2025-06-10", "Sticking", 1000 * i, 100 * i) for i in (1, 2, 3)],
        run_id=run_id,
    )


def _load(store, rows, run_id, **kwargs):
    return store.load(rows, run_id, NOW, ["Fusion"], as_of=date(2025, 7, 1), **kwargs)


def test_tables_exist_and_are_empty(store):
    assert store.incidents().schema == FACT and store.incidents().count() == 0
    assert store.customers().count() == store.runs().count() == store.alerts().count() == 0
    assert store.plants().count() == len(PLANTS) == 30


def test_create_again_changes_nothing(store, incidents):
    _load(store, _three(incidents, "r"), "r")
    store.create(Settings(plants=PLANTS + (("New", "West", "US", "OBI", "USD"), ("Rochester", "x", "x", "x", "x"))))
    assert store.incidents().count() == 3
    assert store.plants().count() == 31
    assert store.plants().where("plant_name = 'Rochester'").first()["region"] == "Northeast"


def test_load_inserts_rows(store, incidents):
    assert _load(store, _three(incidents, "run-001"), "run-001") == 3
    row = store.incidents().where("customer = 'Customer 2'").first()
    assert row["credit_requested_usd"] == Decimal(2000) and row["incident_month"] == "2025-06"
    assert row["loaded_at"] is not None


def test_load_is_idempotent(store, incidents):
    for run_id in ("run-dup", "run-dup", "other"):
        _load(store, _three(incidents, run_id), run_id)
    assert store.incidents().count() == 3
    assert store.incidents().where("pipeline_run_id = 'run-dup'").count() == 3
    assert {r["run_id"]: r["total_rows"] for r in store.runs().collect()} == {"run-dup": 0, "other": 0}


def test_run_log(store, incidents):
    rows = _three(incidents, "run-log")
    store.load(rows, "run-log", NOW, ["Fusion", "Radius"], ["Fusion"])
    row = store.runs().first()
    assert (row["run_id"], row["status"], row["total_rows"]) == ("run-log", "SUCCESS", 3)
    assert (row["sources_detected"], row["sources_loaded"], row["error_message"]) == ("Fusion,Radius", "Fusion", "")


def test_failure_after_the_insert_keeps_the_row_count(store, incidents, monkeypatch):
    def fail(*args, **kwargs):
        raise RuntimeError("tiers failed")

    monkeypatch.setattr(store, "update_risk_tiers", fail)
    assert _load(store, _three(incidents, "r"), "r") == 3
    row = store.runs().first()
    assert (row["status"], row["total_rows"], row["error_message"]) == ("FAILED", 3, "tiers failed")


def test_latest_log_row_of_a_run_counts(store):
    for minute, status in ((1, "FAILED"), (2, "SUCCESS")):
        store.log_run("r", NOW, NOW + timedelta(minutes=minute), status, minute, ["a"])
    assert [(r["status"], r["total_rows"]) for r in store.runs().collect()] == [("SUCCESS", 2)]


def test_key_ignores_quantity_file_and_sub_cent_credit(store, incidents):
    first = incidents(("s", "p", "c", "2025-06-10", "d", "10.001", 5), file="a", run_id="1")
    assert store.insert_new(first) == 1
    again = incidents(("s", "p", "c", "2025-06-10", "d", "10.004", 7), file="b", run_id="2")
    assert store.insert_new(again) == 0
    for change in (("s", "p", "c", "2025-06-11", "d", 10, 5), ("s", "p", "c", "2025-06-10", "d", "10.01", 5),
                   ("s", "p", "c", "2025-06-10", "e", 10, 5), ("s", "q", "c", "2025-06-10", "d", 10, 5)):
        assert store.insert_new(incidents(change)) == 1
    assert store.incidents().where("qty_affected = 7").count() == 0


def test_first_row_in_the_batch_wins(spark):
    day = date(2025, 6, 10)
    rows = [
        ("s", "p", "c", day, "d", Decimal("10.002"), 1.0, "f1", "r", ("", [2, 1])),
        ("s", "p", "c", day, "d", Decimal("10.001"), 9.0, "f1", "r", ("", [1, 9])),
        ("s", "p", "c", day, "d", Decimal("10.000"), 0.0, "f2", "r", ("", [0, 0])),
    ]
    frame = spark.createDataFrame(rows, T.StructType([*UNIFIED.fields, ROW_ORDER]))
    got = first_per_incident(frame).collect()
    assert [(r["qty_affected"], r["raw_source_file"]) for r in got] == [(9.0, "f1")]


def test_rows_with_a_null_in_the_key_never_collide(spark, store):
    day = date(2025, 6, 10)
    rows = spark.createDataFrame(
        [("s", "p", "c", d, k, Decimal(1), 1.0, "f", "r") for d, k in ((None, "d"), (None, "d"), (day, None), (day, None), (day, "d"), (day, "d"))],
        UNIFIED,
    )
    assert first_per_incident(rows).count() == 5
    assert not batch_facts(rows).whole_keys
    assert [store.insert_new(rows) for _ in range(2)] == [5, 4]


def test_any_partitioning_gives_the_same_rows(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).cache()
    columns = [c for c in UNIFIED.names]
    want = first_per_incident(rows).select(*columns)
    for other in (rows.repartition(7), rows.orderBy(F.rand(3)), rows.coalesce(1)):
        got = first_per_incident(other, whole_keys=True).select(*columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    rows.unpersist()


def test_one_key_that_holds_most_rows(spark, incidents):
    hot = incidents(("s", "p", "Unknown", "2025-06-10", "d", 0, 3)).crossJoin(spark.range(20_000)).drop("id")
    hot = hot.withColumn("qty_affected", F.rand(5) + 1).unionByName(incidents(("s", "p", "Unknown", "2025-06-10", "d", 0, 0.5)))
    assert [r["qty_affected"] for r in first_per_incident(hot.repartition(8)).collect()] == [0.5]


def test_broadcast_and_shuffle_find_the_same_new_rows(spark, sf_dir):
    batch = first_per_incident(_cleaned(spark, sf_dir), whole_keys=True).cache()
    history = batch.where("crc32(customer) % 3 = 0").withColumn("qty_affected", F.lit(-1.0))
    small, large = not_in_history(batch, history, _cleaned(spark, sf_dir)), not_in_history(batch, history)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert small.count() == batch.count() - history.count()
    batch.unpersist()


def test_a_batch_beyond_the_broadcast_bound_is_loaded_the_same(spark, store, sf_dir, monkeypatch):
    rows = _cleaned(spark, sf_dir)
    facts = batch_facts(rows)
    assert facts.is_small and facts.whole_keys and facts.rows == rows.count()
    monkeypatch.setattr(store_module, "BROADCAST_KEY_BYTES", 0)
    assert not facts.is_small
    assert store.insert_new(rows, facts=facts) == 1583
    assert store.insert_new(rows, facts=facts) == 0


def test_second_batch_adds_what_the_first_has_not(spark, store, sf_dir):
    even = _cleaned(spark, sf_dir, F.col("order_key") % 2 == 0)
    every = _cleaned(spark, sf_dir, run_id="run-2")
    assert store.insert_new(even) == 1583 - 792
    assert store.insert_new(every) == 792
    keys = with_key(store.incidents())
    assert keys.select("_key_hash").distinct().count() == 1583


def test_months_of_the_batch(incidents, store):
    rows = incidents(("s", "p", "c", "2025-06-10", "d", 1, 1), ("s", "p", "c", "2025-06-30", "d", 1, 1), ("s", "p", "c", "2024-01-01", "d", 1, 1))
    assert batch_facts(rows).months == ("2024-01", "2025-06")
    store.insert_new(rows)
    assert sorted(r[0] for r in store.incidents().select(MONTH).distinct().collect()) == ["2024-01", "2025-06"]
    empty = batch_facts(rows.limit(0))
    assert (empty.rows, empty.key_bytes, empty.months) == (0, 0, ())
    assert store.insert_new(rows.limit(0)) == 0


def test_rolling_tiers(store, incidents):
    as_of = date(2025, 6, 30)
    edge = as_of - timedelta(days=90)
    rows = incidents(
        ("s", "p", "edge", f"{edge}", "d", 100_000, 1),
        ("s", "p", "late", f"{edge - timedelta(days=1)}", "d", 900_000, 1),
        ("s", "p", "mid", "2025-06-01", "d", 30_000, 1),
        ("s", "p", "low", "2025-06-01", "d", "29999.99", 1),
        ("s", "p", "future", "2026-06-01", "d", 100_000, 1),
    )
    store.insert_new(rows)
    store.update_risk_tiers(as_of, "r1", updated_at=NOW)
    tiers = {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()}
    assert tiers == {"edge": "High", "mid": "Medium", "low": "Low", "future": "High"}


def test_a_customer_without_news_keeps_the_tier(store, incidents):
    store.insert_new(incidents(("s", "p", "old", "2025-01-10", "d", 200_000, 1), ("s", "p", "new", "2025-01-10", "d", 200_000, 1)))
    store.update_risk_tiers(date(2025, 2, 1), "r1", updated_at=NOW)
    store.insert_new(incidents(("s", "p", "new", "2025-06-10", "d", 5, 1)))
    store.update_risk_tiers(date(2025, 6, 30), "r2", updated_at=NOW + timedelta(days=1))
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == {"old": "High", "new": "Low"}


def _full_tiers(store, as_of):
    rows = rolling_tiers(store.incidents(), as_of).collect()
    return {r["customer"]: r["risk_tier"] for r in rows}


def test_only_customers_with_news_are_tiered_again(spark, store, incidents):
    def rows(*customers, day="2025-06-10", credit=40_000):
        return incidents(*[("s", "p", c, day, "d", credit, 1) for c in customers])

    def tier(as_of, run_id, **kwargs):
        store.update_risk_tiers(as_of, run_id, **kwargs)
        return sorted(r["customer_name"] for r in store.tier_history().where(F.col("run_id") == run_id).collect())

    many = [f"c{i}" for i in range(30)]
    store.insert_new(rows(*many))
    store.insert_new(rows("old", day="2025-04-05"))
    assert tier(date(2025, 7, 1), "r1") == sorted([*many, "old"])
    # nothing new, then one customer touched twice, by two loads of one time stamp
    assert tier(date(2025, 7, 1), "r2") == []
    store.insert_new(rows("c1", day="2025-06-11", credit=70_000), NOW)
    store.insert_new(rows("c2", day="2025-06-11", credit=10), NOW)
    assert tier(date(2025, 7, 1), "r3") == ["c1", "c2"]
    # days that leave the window: of a customer with others in it, and of one without
    store.insert_new(rows("old", day="2025-07-02", credit=5))
    assert tier(date(2025, 7, 1), "r4") == ["old"]
    assert tier(date(2025, 7, 20), "r5") == ["old"]
    want = _full_tiers(store, date(2025, 7, 20))
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == want
    assert (want["c1"], want["old"]) == ("High", "Low")
    # a window that moves back, and other limits
    assert tier(date(2025, 7, 1), "r6") == ["old"]
    assert len(tier(date(2025, 7, 1), "r7", settings=Settings(high_risk_usd=1))) == 31
    days = store.customer_days().groupBy("customer").agg(F.sum("credit_usd").alias("t"))
    facts = store.incidents().groupBy("customer").agg(F.sum("credit_requested_usd").alias("t"))
    assert sorted(days.collect()) == sorted(facts.collect())


def test_the_sums_of_a_load_that_died_are_made_up_for(store, incidents, monkeypatch):
    def die(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_write_days", die)
        with pytest.raises(RuntimeError):
            store._mark_pending(5, ["2025-06"])
            store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 40_000, 1)), NOW)
    with monkeypatch.context() as broken:
        write = store._write_days
        # the rows are there, their sums are not
        broken.setattr(store, "_write_days", lambda rows, loaded: write(rows, loaded) if loaded == 5 else die())
        with pytest.raises(RuntimeError):
            store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 40_000, 1)), NOW)
    assert store.incidents().count() == 1 and store.customer_days().count() == 0
    store.insert_new(incidents(("s", "p", "b", "2025-06-11", "d", 5, 1)))
    store.update_risk_tiers(date(2025, 7, 1), "r")
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == {"a": "Medium", "b": "Low"}


def test_sketches_of_months(store, incidents):
    def counts(*keys):
        return sorted(tuple(r) for r in overview.distinct_names(store.month_sketches(), *keys).collect())

    store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 1, 1), ("s", "p", None, "2025-05-10", "d", 1, 1)))
    assert not store.has_sketches()
    store.start_sketches()
    store.start_sketches()
    assert counts(MONTH) == [("2025-05", 1, 0), ("2025-06", 1, 1)]
    rows = incidents(("s", "p", "a", "2025-06-11", "d", 1, 1), ("s", "q", "b", "2025-07-10", "d", 1, 1))
    store.insert_new(rows)
    store.insert_new(rows)
    assert counts(MONTH) == [("2025-05", 1, 0), ("2025-06", 1, 1), ("2025-07", 1, 1)]
    assert counts() == [(2, 2)]
    many = rows.sparkSession.range(20_000).select(F.concat(F.lit("c"), "id").alias("customer"), F.lit("p").alias("plant"), F.lit("2025-08").alias(MONTH))
    store._write_sketches(many, 7)
    (found,) = [c for month, _, c in counts(MONTH) if month == "2025-08"]
    assert abs(found - 20_000) <= 3 * 0.0081 * 20_000


def _views(store):
    days = store.customer_days().groupBy("customer", "incident_date").agg(F.sum("credit_usd").alias("t"))
    return [sorted(map(tuple, view.collect())) for view in (store.customers(), store.runs(), days)]


def test_compaction_keeps_the_views_and_one_row_per_key(store, incidents):
    store.compact()
    assert _views(store) == [[], [], []]
    for i in range(3):
        _load(store, incidents(("s", "p", "a", f"2025-06-1{i}", "d", 40_000, 1), ("s", "p", "b", f"2025-06-1{i}", "d", 5, 1)), f"r{i}")
    _load(store, _three(incidents, "r0"), "r0")
    before = _views(store)
    assert store.tier_history().count() > store.customers().count()
    store.compact()
    assert _views(store) == before
    assert store.tier_history().count() == store.customers().count() == 5
    assert store._table("pipeline_run_log", store.runs().schema).count() == 3
    # 3 days of a and of b, and one of each other customer
    assert store.customer_days().count() == 9
    # what was used is no news, what comes later is
    store.update_risk_tiers(date(2025, 7, 1), "r5")
    assert store.tier_history().where("run_id = 'r5'").count() == 0
    _load(store, incidents(("s", "p", "b", "2025-06-20", "d", 90_000, 1)), "r6")
    assert [r["customer_name"] for r in store.tier_history().where("run_id = 'r6'").collect()] == ["b"]
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == _full_tiers(store, date(2025, 7, 1))
    before = _views(store)
    for _ in range(3):
        store.compact()
        store.create()
    assert _views(store) == before
    assert len(store._generations("dim_customer")) == store_module.GENERATIONS_KEPT


def test_news_since_the_last_tiers_stay_news_after_a_compaction(store, incidents):
    _load(store, incidents(("s", "p", "a", "2025-06-10", "d", 5, 1)), "r1")
    store.insert_new(incidents(("s", "p", "a", "2025-06-11", "d", 60_000, 1)))
    store.compact()
    store.update_risk_tiers(date(2025, 7, 1), "r2")
    assert {r["customer_name"]: r["risk_tier"] for r in store.customers().collect()} == _full_tiers(store, date(2025, 7, 1))


def test_a_compaction_that_dies_changes_nothing(store, incidents, monkeypatch):
    for i in range(2):
        _load(store, incidents(("s", "p", "a", f"2025-06-1{i}", "d", 40_000, 1)), f"r{i}")
    before, old = _views(store), store.customers()

    def overtaken():
        raise store_module.StoreBusy("gone")

    with pytest.raises(store_module.StoreBusy):
        store._publish("dim_customer", store._compacted("dim_customer"), overtaken)
    assert _views(store) == before and store._generations("dim_customer") == []
    store.compact()
    assert _views(store) == before
    # a reader that has begun before finds its files
    assert sorted(map(tuple, old.collect())) == before[0]


def test_alerts_of_a_repeated_run_are_replaced(store, incidents):
    rows = incidents(("s", "p", "c", "2025-06-10", "d", 50_000, 1), ("s", "p", "c", "2025-06-11", "d", 49_999, 1))
    for run_id in ("r1", "r1", "r2"):
        store.write_alerts(alert_rows(rows), run_id)
    assert sorted(r["run_id"] for r in store.alerts().collect()) == ["r1", "r2"]


def test_settings_of_the_fixture_cover_every_source():
    assert list(star.HEADERS) == list(star.SETTINGS.contracts)


def _summed(store):
    return {tuple(r) for r in store.incident_sums().drop("through").collect()}


def _plain_sums(store):
    whole = sums.merged(sums.rollup(store.incidents(), sums.ALL_SETS).withColumn("through", F.lit(0)))
    return {tuple(r) for r in whole.drop("through").collect()}


def test_sums_of_loads_are_those_of_the_facts(store, incidents):
    store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 1, 1), ("s", None, None, "2025-05-10", "d", 2, 1)))
    assert not store.has_sums()
    store.start_sums()
    store.start_sums()
    assert _summed(store) == _plain_sums(store)
    rows = incidents(("s", "p", "a", "2025-07-11", "e", 5, 1), ("t", "q", "b", "2024-07-10", "d", 7.25, 1))
    for _ in range(2):
        store.insert_new(rows)
        assert _summed(store) == _plain_sums(store)
        store.compact()
        assert _summed(store) == _plain_sums(store)
    assert store.incident_sums().agg(F.max("through")).first()[0] == store.incidents().agg(F.max(F.unix_micros("loaded_at"))).first()[0]


def test_sums_of_a_load_that_died_come_with_the_next(store, incidents, monkeypatch):
    store.start_sums()
    assert _summed(store) == set()

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_write_sums", die)
        with pytest.raises(RuntimeError):
            store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 1, 1)))
    assert _summed(store) == set()
    store.compact()
    assert _summed(store) == _plain_sums(store) != set()
    store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 1, 1), ("s", "p", "a", "2025-06-11", "d", 1, 1)))
    assert _summed(store) == _plain_sums(store)


def test_report_of_sums_stays_what_it_was(spark, store, incidents, tmp_path):
    store.start_sums()
    store.insert_new(incidents(("s", "p", "a", "2025-06-10", "d", 1, 1), ("s", "p", "a", "2025-06-11", "e", 3, 1)))
    args = (store.incidents(), str(tmp_path / "out"), "r", "now")
    target = report.write_report(*args, sums=store.incident_sums(), copy_raw=False)
    old = report.write_report(store.incidents(), str(tmp_path / "old"), "r", "now")
    for name in ("summary", "by_source", "quarter_pivot", "customer_plant", "plant_defect", "source_span"):
        got, want = (spark.read.parquet(f"{folder}/{name}").collect() for folder in (target, old))
        assert got == want
    store.insert_new(incidents(("s", "p", "b", "2025-06-12", "d", 1, 1)))
    raw = report.raw_of_report(store.incidents(), target)
    assert sorted(raw.collect()) == sorted(spark.read.parquet(f"{old}/raw").collect()) and raw.count() == 2
    assert not (tmp_path / "out" / "run_id=r" / "raw").exists()
    cards = [scorecard.scorecard(store.incidents()), scorecard.scorecard_of_sums(store.incident_sums())]
    assert cards[0].collect() == cards[1].collect()
