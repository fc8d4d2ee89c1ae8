"""Graph queries over nodes and edges.

Edges are ordered by ``EDGE_ORDER`` where a limit applies, which makes every cut repeatable. An edge
touches a node by either end; unions of two equi-joins stand for that, never a join on an OR.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import like_ignoring_ascii_case, like_literal
from codeloom.schemas import OUTLINE_KINDS, SYMBOL_KINDS
from codeloom.session import checkpoint

EDGE_ORDER = ["source_id", "target_id", "kind"]
REFERENCE_KINDS = ["CALLS", "REFERENCES", "TESTS", "IMPORTS"]
SUMMARY_KINDS = ["File", "Function", "Method", "Class", "Type", "Test", "Doc", "Endpoint"]
#: Seeds of the graph around search hits.
MAX_SEEDS = 12


def edges_of_kinds(edges: DataFrame, kinds: Sequence[str], limit: int) -> DataFrame:
    """The first edges of some kinds; none without kinds."""
    order = [c for c in ("id",) if c in edges.columns and "seq" not in edges.columns] or EDGE_ORDER
    return edges.where(F.col("kind").isin(list(kinds))).orderBy(*order).limit(limit)


def nodes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes at either end of some edges, once each."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first edges of some kinds and their nodes."""
    chosen = edges_of_kinds(edges, kinds, limit)
    return nodes_of(nodes, chosen), chosen


def edges_for_node(edges: DataFrame, node_id: int, kinds: Sequence[str], direction: str, limit: int) -> DataFrame:
    """Edges into (``incoming``), out of (``outgoing``) or at (anything else) a node; no kinds mean all."""
    ends = {"incoming": F.col("target_id") == node_id, "outgoing": F.col("source_id") == node_id}
    both = (F.col("target_id") == node_id) | (F.col("source_id") == node_id)
    found = edges.where(ends.get(direction, both))
    if kinds:
        found = found.where(F.col("kind").isin(list(kinds)))
    return found.orderBy(*EDGE_ORDER).limit(limit)


def references(edges: DataFrame, node_id: int, limit: int) -> DataFrame:
    """What refers to a node."""
    return edges_for_node(edges, node_id, REFERENCE_KINDS, "incoming", limit)


def call_hierarchy(edges: DataFrame, node_id: int, direction: str, limit: int) -> DataFrame:
    """Callers, callees or both, one step away."""
    return edges_for_node(edges, node_id, ["CALLS"], direction, limit)


def imports(edges: DataFrame, node_id: int, limit: int) -> DataFrame:
    """What a node imports."""
    return edges_for_node(edges, node_id, ["IMPORTS"], "outgoing", limit)


def dependents(edges: DataFrame, node_id: int, limit: int) -> DataFrame:
    """What imports a node."""
    return edges_for_node(edges, node_id, ["IMPORTS"], "incoming", limit)


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id, depth: the least number of steps from any seed, along edges of all kinds either way.

    Each round joins the newest nodes with both ends of the edges and drops what was reached before.
    """
    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for depth in range(1, hops + 1):
        ahead = edges.join(frontier.select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id"))
        back = edges.join(frontier.select(F.col("id").alias("target_id")), "target_id").select(F.col("source_id").alias("id"))
        new = ahead.unionByName(back).distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = checkpoint(new) if hops > 2 else new
        reached = reached.unionByName(frontier)
    return reached


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the seeds with their depth, and the edges at nodes nearer than that.

    Edges between two nodes at the full depth are not part of it. A seed that is no node yields edges
    but no node of its own.
    """
    reached = reach(edges, seeds, hops)
    inner = reached.where(F.col("depth") < hops).select("id")
    touching = edges.join(inner.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(
        edges.join(inner.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    )
    return nodes.join(reached, "id"), touching.dropDuplicates(EDGE_ORDER)


def _nulls_first(column: str, instead: object) -> Column:
    return F.coalesce(F.col(column), F.lit(instead))


def nodes_by_kinds(nodes: DataFrame, kinds: Sequence[str], limit: int) -> DataFrame:
    """Nodes of some kinds by path, line and id."""
    return nodes.where(F.col("kind").isin(list(kinds))).orderBy(_nulls_first("path", ""), _nulls_first("start_line", 0), "id").limit(limit)


def semantic_summaries(nodes: DataFrame, limit: int) -> DataFrame:
    """Nodes that have a summary."""
    told = nodes.where(F.col("kind").isin(SUMMARY_KINDS) & F.col("summary").isNotNull() & (F.col("summary") != ""))
    return told.orderBy(_nulls_first("path", ""), _nulls_first("start_line", 0), "id").limit(limit)


def symbols_matching(nodes: DataFrame, query: str, kinds: Sequence[str] = SYMBOL_KINDS, limit: int = 100) -> DataFrame:
    """Nodes whose name, qualified name, path or summary holds the query, exact names first, with rank."""
    like = like_literal(query)

    def has(c: str) -> Column:
        return F.coalesce(like_ignoring_ascii_case(F.col(c), like), F.lit(False))

    rank = F.when(F.col("name") == query, 0).when(F.col("qualified_name") == query, 1).when(has("name"), 2).otherwise(3)
    found = nodes.where(F.col("kind").isin(list(kinds)) & (has("name") | has("qualified_name") | has("path") | has("summary")))
    return found.withColumn("rank", rank).orderBy("rank", _nulls_first("path", ""), _nulls_first("start_line", 0), "id").limit(limit)


def document_symbols(nodes: DataFrame, path: str) -> DataFrame:
    """A file's symbols by line, then its endpoints, with their position."""
    own = nodes.where(F.col("path") == path)
    group = F.when(F.col("kind").isin(OUTLINE_KINDS), 0).when(F.col("kind") == "Endpoint", 1)
    order = Window.partitionBy("path").orderBy("group", "start_line", "id")
    return own.withColumn("group", group).where("group is not null").withColumn("position", F.row_number().over(order).cast("bigint")).drop("group")


def top_symbols(nodes: DataFrame, limit: int) -> DataFrame:
    """The first symbols of every file, with their position."""
    order = Window.partitionBy("file_id").orderBy("start_line", "id")
    own = nodes.where(F.col("kind").isin(SYMBOL_KINDS) & F.col("file_id").isNotNull())
    return own.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit)


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """For places (place_id, file_id, line) the tightest symbol around each: least span, largest id.

    symbols: id, file_id, start_line, end_line. Places outside all symbols yield nothing.
    """
    around = places.join(symbols, "file_id").where("start_line <= line and line <= end_line")
    best = F.min_by(F.struct("id", "start_line", "end_line"), F.struct(F.expr("end_line - start_line"), -F.col("id")))
    return around.groupBy("place_id", "file_id", "line").agg(best.alias("s")).select("place_id", "file_id", "line", "s.*")


def calls_in_symbols(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Every symbol with each call (file_id, line, seq, name, qualifier) between its first and last line."""
    return symbols.join(calls, "file_id").where("start_line <= line and line <= end_line")
