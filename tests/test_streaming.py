"""The change feed: late and repeated changes leave the manifest as the largest seq says."""

from __future__ import annotations

from codeloom.operators.store import Store
from codeloom.streaming.feed import follow

SCHEMA = "path string, hash string, seq bigint, deleted boolean"


def test_changes_fold_into_a_manifest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batches = [[("a", "1", 1, False), ("b", "1", 2, False)], [("a", "2", 4, False), ("b", "1", 3, True)], [("a", "late", 2, False), ("c", "1", 5, False)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        follow(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    out = {r.path: (r.hash, r.deleted) for r in store.read("manifest").collect()}
    assert out == {"a": ("2", False), "b": ("1", True), "c": ("1", False)}
