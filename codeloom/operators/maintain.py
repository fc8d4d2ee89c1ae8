"""Incremental maintenance: manifest differences, upserts, deletes that cascade, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of two manifests (path, hash): new, modified, deleted or unchanged."""
    both = old.select("path", F.col("hash").alias("was"), F.lit(True).alias("old")).join(new.select("path", F.col("hash").alias("is"), F.lit(True).alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("was") == F.col("is"), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


def status_summary(changes: DataFrame) -> DataFrame:
    """One row: counts, sorted paths of each change, and whether an index run is due."""

    def paths(change: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("change") == change, F.col("path")))).alias(change)

    out = changes.where("change <> 'unchanged'").agg(paths("new"), paths("modified"), paths("deleted"))
    changed = F.sort_array(F.concat("new", "modified"))
    return out.withColumn("changed", changed).withColumn("needs_index", F.size("changed") + F.size("deleted") > 0)


def remove_missing(files: DataFrame, seen: DataFrame) -> DataFrame:
    """The files that were seen."""
    return files.join(seen.select("path").distinct(), "path", "left_semi")


def clear_files(nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes, edges and chunks without those of some files (file_id); edges go with either end."""
    gone = nodes.join(files.select("file_id").distinct(), "file_id", "left_semi").select("id")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    kept_chunks = chunks.join(files.select("file_id").distinct(), "file_id", "left_anti") if chunks is not None else None
    return nodes.join(gone, "id", "left_anti"), kept_edges.select(*edges.columns), kept_chunks


def clear_derived(edges: DataFrame) -> DataFrame:
    """Edges without those that import resolution made."""
    return edges.where(~F.col("is_derived"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; of several new rows of a key the one with the largest ``seq`` counts."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("__row")).select(*keys, "__row.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def integrity(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """check, problems: repeated node ids, repeated edges, edges without a source or target.

    ``tasks``: how many tasks ids are dealt to, and with them the ends of edges; the session's number of shuffle partitions without it.
    """
    ids = nodes.select("id")
    if tasks is not None:
        ids = ids.repartition(tasks, "id")  # the joins deal the edges' ends to as many

    def row(name: str, found: DataFrame) -> DataFrame:
        return found.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(name).alias("check"), "problems")

    twice = ids.groupBy("id").count().where("count > 1")
    repeated = edges.groupBy("source_id", "target_id", "kind").count().where("count > 1")
    no_source = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    no_target = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    checks = [row("node_ids", twice), row("edge_keys", repeated), row("edge_sources", no_source), row("edge_targets", no_target)]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])
