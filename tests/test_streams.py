"""Scans in a stream's state: late, repeated and replayed versions."""

from collections import Counter

from pyspark.sql import functions as F

from veilmark.operators import history
from veilmark.sources.store import ScanStore
from veilmark.streaming.scan_stream import latest_stream, update_stream

SCHEMA = "scan_id string, version long, filename string, pei_after double"
BATCHES = [
    [("a", 1, "x", 1.0), ("b", 2, "y", None), (None, 9, "z", 1.0)],
    [("a", 3, "x3", 3.0), ("c", 1, "w", 0.5), ("a", 3, "x3", 3.0)],
    [("a", 2, "late", 2.0), ("b", 2, "y", None), ("c", 1, "w", 0.5)],
    [("b", 3, None, 4.0)],
]


def run(spark, folder, start):
    """Batches come one after the other, each in a run of its own over the same checkpoint."""
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        query = start(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        query.processAllAvailable()
        query.stop()


def test_latest_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    out = []

    def start(rows):
        keep = lambda df, _: out.append({r["scan_id"]: tuple(r) for r in df.collect()})
        return latest_stream(rows).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").start()

    run(spark, tmp_path, start)
    for n in range(1, len(BATCHES) + 1):
        rows = spark.createDataFrame([r for b in BATCHES[:n] for r in b if r[0]], SCHEMA)
        assert Counter(out[n - 1].values()) == Counter(map(tuple, history.latest(rows.distinct()).select(*rows.columns).collect()))


def test_stored_scans_follow_a_stream(spark, tmp_path):
    store = ScanStore(spark, "stream_test", buckets=2).create()
    try:
        store.insert("scans", spark.createDataFrame([("a", "old"), ("b", "old"), ("d", "old")], "scan_id string, filename string"))
        run(spark, tmp_path, lambda rows: update_stream(rows, store, f"{tmp_path}/checkpoint"))
        got = {r["scan_id"]: (r["filename"], r["pei_after"]) for r in store.current().select("scan_id", F.col("filename"), "pei_after").collect()}
        assert got == {"a": ("x3", 3.0), "b": (None, 4.0), "d": ("old", None)}
    finally:
        store.drop()
