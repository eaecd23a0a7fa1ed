"""Stored scans: updates by key, compaction, joins without a shuffle of a table, orphans."""

import pytest

from veilmark.plans import catalogue
from veilmark.sources.store import ScanStore


@pytest.fixture
def store(spark):
    own = ScanStore(spark, "store_test", buckets=4).create()
    yield own
    own.drop()


def current(store):
    return {r["scan_id"]: (r["filename"], r["pei_after"], r["version"]) for r in store.current().collect()}


def test_updates_and_compaction(spark, store):
    store.insert("scans", spark.createDataFrame([("a", "x.png", 1.0, 7), ("b", "y.png", None, 8), (None, "z.png", 2.0, 9)], "scan_id string, filename string, pei_after double, extra int"))
    assert current(store) == {"a": ("x.png", 1.0, 1), "b": ("y.png", None, 1)}
    store.update(spark.createDataFrame([("a", None), ("b", 3.0), ("b", 2.0), ("unknown", 1.0)], "scan_id string, pei_after double"))
    assert current(store) == {"a": ("x.png", None, 2), "b": ("y.png", 3.0, 2)}
    store.update(spark.createDataFrame([("a", 5.0)], "scan_id string, pei_after double"))
    assert current(store) == {"a": ("x.png", 5.0, 3), "b": ("y.png", 3.0, 2)} and store.table("scans").count() == 6
    store.compact()
    assert current(store) == {"a": ("x.png", 5.0, 3), "b": ("y.png", 3.0, 2)} and store.table("scans").count() == 2
    store.update(spark.createDataFrame([("b", 1.0)], "scan_id string, pei_after double"))
    assert current(store)["b"] == ("y.png", 1.0, 3)


def test_nothing_stored(spark, store):
    assert store.current().count() == store.joined().count() == store.orphans().count() == 0
    store.update(spark.createDataFrame([("a", 1.0)], "scan_id string, pei_after double"))
    store.compact()
    assert store.current().count() == 0


def test_a_write_that_ran_twice(spark, store):
    rows = spark.createDataFrame([("a", "x.png")], "scan_id string, filename string")
    store.insert("scans", rows)
    store.insert("scans", rows)
    assert current(store) == {"a": ("x.png", None, 1)}


def test_joins_and_orphans(spark, store):
    store.insert("scans", spark.createDataFrame([("a", "x.png"), ("b", "y.png")], "scan_id string, filename string"))
    store.insert("fields", spark.createDataFrame([("a", "name"), ("a", "dob"), ("c", "name"), (None, "dob")], "scan_id string, field_name string"))
    store.insert("audit_events", spark.createDataFrame([("b", "uploaded"), ("d", "uploaded")], "scan_id string, event_type string"))
    store.update(spark.createDataFrame([("a", "w.png")], "scan_id string, filename string"))
    assert sorted((r["scan_id"], r["field_name"], r["filename"]) for r in store.joined().collect()) == [("a", "dob", "w.png"), ("a", "name", "w.png")]
    assert [(r["scan_id"], r["filename"]) for r in store.joined("audit_events").collect()] == [("b", "y.png")]
    assert sorted((r["scan_id"] or "", r["field_name"]) for r in store.orphans().collect()) == [("", "dob"), ("c", "name")]
    assert [r["scan_id"] for r in store.orphans("audit_events").collect()] == ["d"]


def test_bucketed_tables_are_read_without_a_shuffle(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (store.current(), store.joined(), store.orphans()):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fields_are_detected_for_the_fields_alone(spark, sf_dir, monkeypatch):
    seen = []
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ScanStore, "create", lambda self: self)
    monkeypatch.setattr(ScanStore, "compact", lambda self: None)
    monkeypatch.setattr(ScanStore, "insert", lambda self, table, rows: seen.append((table, "rule_pos" in plan(rows))))
    monkeypatch.setattr(ScanStore, "update", lambda self, changes: seen.append(("update", "rule_pos" in plan(changes))))
    catalogue._store(spark, sf_dir)
    assert seen == [("scans", False), ("fields", True), ("update", False), ("audit_events", False), ("update", False), ("audit_events", False)]


def test_buckets_grow_with_the_cards(spark, sf_dir, monkeypatch):
    """A bucket is written by one task, so that it holds a bounded number of cards."""
    monkeypatch.setattr(catalogue, "CARDS_A_BUCKET", 10, raising=False)
    store = catalogue._store(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert store.buckets == -(-n // 10) > 8
    assert store.table("fields").select("scan_id").distinct().count() == n
    store.drop()
