"""Budgets and brief views: how much of a result is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(pieces: DataFrame, column: str, order: list[str], budget: int) -> DataFrame:
    """The pieces that fit, in order, up to the first that does not; ``used`` is the running size in bytes.

    Null and empty pieces take nothing. No more than ``budget`` pieces that take something can fit, so
    only the first of those are summed, in one task; where they end decides all the others by ``order``.
    """
    key, size = F.struct(*order), F.coalesce(F.octet_length(column), F.lit(0))
    first = pieces.where(size > 0).select(key.alias("key"), size.alias("size")).orderBy("key").limit(budget + 1)
    running = first.withColumn("used", F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    marks = running.agg(
        F.sort_array(F.collect_list(F.when(F.col("used") <= budget, F.struct("key", "used")))).alias("fit"),
        F.min(F.when(F.col("used") > budget, F.col("key"))).alias("cut"),
    )
    placed = pieces.withColumn("__key", key).join(F.broadcast(marks), F.lit(True)).where(F.col("cut").isNull() | (F.col("__key") < F.col("cut")))
    upto = F.filter("fit", lambda m: m["key"] <= F.col("__key"))
    used = F.coalesce(F.try_element_at(upto, F.lit(-1))["used"], F.lit(0).cast("bigint"))
    return placed.withColumn("used", used).drop("__key", "fit", "cut")


def edge_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source -KIND-> target`` by name, for edges whose ends are nodes."""
    names = nodes.select("id", "name")
    named = edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    return named.select(F.concat("s", F.lit(" -"), "kind", F.lit("-> "), "t").alias("edge"))


def scaled_limit(tokens: int, per_item: int, least: int, most: int) -> int:
    """How many items a token budget allows."""
    return max(least, min(most, tokens // per_item))
