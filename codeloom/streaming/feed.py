"""An extension beyond the batch engine: a stream of file changes folded into a manifest.

Changes are rows of path, hash, seq and deleted. Each micro-batch is merged by path, the largest seq
wins, and the new manifest is written as a version of its own, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.store import Store


def fold(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """path, hash, seq, deleted after some changes; of each path the largest seq counts, deletions stay as marks."""
    rows = manifest.unionByName(changes.select(*manifest.columns))
    best = F.max_by(F.struct("hash", "seq", "deleted"), F.struct("seq", "deleted", "hash"))
    return rows.groupBy("path").agg(best.alias("b")).select("path", "b.*")


def follow(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Keep the store's ``manifest`` table up to date with a streaming DataFrame of changes."""

    def merge(batch: DataFrame, _: int) -> None:
        old = store.read("manifest") if store.version() else batch.select("path", "hash", "seq", "deleted").limit(0)
        store.write({"manifest": fold(old, batch.select("path", "hash", "seq", "deleted"))})

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
