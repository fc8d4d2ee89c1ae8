"""From files and parsed facts to nodes, edges and chunks, and from imports to derived edges.

Everything is joins over facts keyed by path. Order that matters (first or last wins) is kept in
``seq``. Ids are hashes of what identifies a node, so they are stable across runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.operators import build
from codeloom.schemas import NODES

_BIG = 1 << 20


def node_id(kind: Column, qualified_name: Column, path: Column, line: Column) -> Column:
    """The id of a node: a hash of kind, qualified name, path and first line."""
    return F.xxhash64(kind, qualified_name, F.coalesce(path, F.lit("")), F.coalesce(line.cast("bigint"), F.lit(-1).cast("bigint")))


def _nodes(rows: DataFrame, kind: Column, name: Column, qualified: Column, path: Column, start: Column, end: Column, summary: Column, metadata: Column, file_id: Column, seq: Column) -> DataFrame:
    values = {
        "id": node_id(kind, qualified, path, start), "file_id": file_id, "kind": kind, "name": name, "qualified_name": qualified,
        "path": path, "start_line": start, "end_line": end, "summary": summary, "metadata": metadata, "seq": seq,
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in NODES])


def _null() -> Column:
    return F.lit(None)


def file_node_id(path: Column) -> Column:
    return node_id(F.lit("File"), path, path, _null())


def directory_node_id(path: Column) -> Column:
    return node_id(F.lit("Directory"), path, path, _null())


def repository_node_id() -> Column:
    return node_id(F.lit("Repository"), F.lit("."), F.lit(""), _null())


def import_node_id(source: Column) -> Column:
    return node_id(F.lit("Symbol"), F.concat(F.lit("import:"), source), _null(), _null())


def symbols_of(facts: DataFrame) -> DataFrame:
    """One row for each symbol: path, seq, kind, name, lines, texts, and its node id."""
    rows = facts.select("path", F.posexplode("symbols").alias("seq", "s")).select("path", "seq", "s.*")
    return rows.withColumn("id", node_id(F.col("kind"), F.col("qualified_name"), F.col("path"), F.col("start_line")))


def calls_of(facts: DataFrame) -> DataFrame:
    rows = facts.select("path", F.posexplode("calls").alias("call", "c")).select("path", "call", "c.*")
    return rows.withColumn("callee", F.concat_ws(".", "qualifier", "name"))


def routes_of(facts: DataFrame) -> DataFrame:
    rows = facts.select("path", F.posexplode("routes").alias("seq", "r")).select("path", "seq", F.col("r.method").alias("method"), F.col("r.path").alias("route"), "r.handler", "r.line")
    name = F.concat_ws(" ", "method", "route")
    rows = rows.withColumn("name", name).withColumn("qualified_name", F.concat(F.col("path"), F.lit("::route::"), name))
    return rows.withColumn("id", node_id(F.lit("Endpoint"), F.col("qualified_name"), F.col("path"), F.col("line")))


def imports_of(facts: DataFrame) -> DataFrame:
    """One row for each file and import source: the last import of a source counts."""
    rows = facts.select("path", F.posexplode("imports").alias("seq", "i")).select("path", "seq", "i.*")
    return build.last_by(rows, ["path", "source"], ["seq"], ["seq", "line", "bindings"])


def symbol_calls(facts: DataFrame) -> DataFrame:
    """Symbols with ``calls``: name and qualified name of each call between their lines, in order."""
    symbols, calls = symbols_of(facts), calls_of(facts)
    inside = symbols.join(calls.select("path", "call", "callee", F.col("name").alias("called"), "line"), "path").where("start_line <= line and line <= end_line")
    listed = inside.groupBy("id", "path").agg(F.sort_array(F.collect_list(F.struct("call", "called", "callee"))).alias("own"))
    names = F.flatten(F.transform("own", lambda c: F.when(c.called == c.callee, F.array(c.called)).otherwise(F.array(c.called, c.callee))))
    return symbols.join(listed.select("id", "path", names.alias("calls")), ["id", "path"], "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


def nodes_of_files(files: DataFrame, facts: DataFrame, repo_name: str) -> DataFrame:
    """All nodes: repository, directories, files, symbols, endpoints and imported sources."""
    none, empty = _null(), F.lit("{}")
    ids = files.select("path", F.col("id").alias("file_id"))
    place = F.xxhash64("path")
    spark = files.sparkSession
    repo = _nodes(spark.range(1), F.lit("Repository"), F.lit(repo_name), F.lit("."), F.lit(""), none, none, none, empty, none, F.lit(0))
    dirs = _nodes(build.directory_chain(files), F.lit("Directory"), F.col("name"), F.col("path"), F.col("path"), none, none, none, empty, none, place)
    base = F.element_at(F.split("path", "/"), -1)
    own = _nodes(ids, F.lit("File"), base, F.col("path"), F.col("path"), none, none, F.lit("Source file"), empty, F.col("file_id"), place)
    told = F.coalesce("summary", "signature")
    about = F.to_json(F.struct(F.col("calls"), F.col("summary").alias("doc_summary"), F.col("signature")))
    symbols = _nodes(symbol_calls(facts).join(ids, "path"), F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("path"), F.col("start_line"), F.col("end_line"), told, about, F.col("file_id"), F.col("seq"))
    route = F.to_json(F.struct("handler", "method", F.col("route").alias("path"), F.lit(True).alias("product_flow")))
    endpoints = _nodes(routes_of(facts).join(ids, "path"), F.lit("Endpoint"), F.col("name"), F.col("qualified_name"), F.col("path"), F.col("line"), F.col("line"), F.col("name"), route, F.col("file_id"), F.col("seq") + _BIG)
    first = build.first_by(imports_of(facts), ["source"], ["path", "seq"], ["line", "bindings"])
    outside = F.to_json(F.struct("bindings", F.lit(True).alias("external"), "line"))
    imported = _nodes(first, F.lit("Symbol"), F.col("source"), F.concat(F.lit("import:"), F.col("source")), none, none, none, F.lit("Imported dependency"), outside, none, F.lit(0))
    every = repo
    for part in (dirs, own, symbols, endpoints, imported):
        every = every.unionByName(part)
    return build.last_by(every, ["id"], ["seq", "end_line", "name"], [c for c in every.columns if c != "id"]).select(*every.columns)


def _edge(rows: DataFrame, source: Column, target: Column, kind: Column, metadata: Column, seq: Column, derived: bool = False) -> DataFrame:
    return rows.select(source.alias("source_id"), target.alias("target_id"), kind.alias("kind"), metadata.alias("metadata"), F.lit(derived).alias("is_derived"), "path", seq.cast("bigint").alias("seq"))


def _with_tests(rows: DataFrame) -> DataFrame:
    """CALLS, and TESTS besides where the caller is a test."""
    kinds = F.when(F.col("caller_kind") == "Test", F.array(F.lit("CALLS"), F.lit("TESTS"))).otherwise(F.array(F.lit("CALLS")))
    return rows.withColumn("edge", F.explode(kinds))


def raw_edges(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges inside files and directories; of edges with the same ends and kind the last counts."""
    zero, empty = F.lit(0), F.lit("{}")
    dirs = build.directory_chain(files)
    above = P.parent(F.col("path"))
    holder = F.when(above == "", repository_node_id()).otherwise(directory_node_id(above))
    contains = F.lit("CONTAINS")
    parts = [
        _edge(dirs, holder, directory_node_id(F.col("path")), contains, empty, zero),
        _edge(files, holder, file_node_id(F.col("path")), contains, empty, zero),
    ]
    symbols, calls, routes = symbols_of(facts), calls_of(facts), routes_of(facts)
    in_file = file_node_id(F.col("path"))
    parts.append(_edge(symbols, in_file, F.col("id"), F.lit("DEFINES"), empty, F.col("seq")))
    parts.append(_edge(routes, in_file, F.col("id"), F.lit("DEFINES"), F.to_json(F.struct(F.col("name").alias("route"))), F.col("seq")))

    targets = build.first_by(symbols, ["path", "name"], ["seq"], ["id"]).withColumnRenamed("id", "target")
    around = calls.join(symbols.select("path", F.col("id").alias("caller"), F.col("kind").alias("caller_kind"), "seq", "start_line", "end_line"), "path").where("start_line <= line and line <= end_line")
    tightest = F.min_by(F.struct("caller", "caller_kind"), F.struct(F.expr("end_line - start_line"), "seq")).alias("c")
    callers = around.groupBy("path", "call", "name", "callee", "line").agg(tightest).select("path", "call", "name", "callee", "line", "c.*")
    called = _with_tests(callers.join(targets, ["path", "name"]).where("caller <> target"))
    parts.append(_edge(called, F.col("caller"), F.col("target"), F.col("edge"), F.to_json(F.struct("callee", "line")), F.col("call")))

    handled = routes.join(targets.withColumnRenamed("name", "handler"), ["path", "handler"])
    parts.append(_edge(handled, F.col("id"), F.col("target"), F.lit("REFERENCES"), F.to_json(F.struct("handler")), F.col("seq")))
    imports = imports_of(facts)
    parts.append(_edge(imports, in_file, import_node_id(F.col("source")), F.lit("IMPORTS"), F.to_json(F.struct("bindings", "line")), F.col("seq")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return last_edges(every)


def last_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends and kind."""
    return build.last_by(edges, ["source_id", "target_id", "kind"], ["seq", "metadata"], ["metadata", "is_derived", "path", "seq"])


def derived_edges(files: DataFrame, facts: DataFrame, aliases: list[tuple[str, list[str]]], base_url: str | None) -> DataFrame:
    """IMPORTS between files, and CALLS, TESTS and REFERENCES across them.

    A call counts if its name is a binding's local name; a namespace binding counts for the first
    ``local.x`` that a symbol calls. A target name means the file's last symbol of that name.
    """
    imports = imports_of(facts).withColumnsRenamed({"path": "source_path", "source": "imported"})
    found = build.resolve_imports(imports, files, aliases, base_url)
    own = found.withColumn("path", F.col("source_path"))
    resolved = F.to_json(F.struct(F.col("target_path").alias("resolved"), F.col("imported").alias("source")))
    parts = [_edge(own.where("source_path <> target_path"), file_node_id(F.col("source_path")), file_node_id(F.col("target_path")), F.lit("IMPORTS"), resolved, F.col("seq"), True)]

    symbols = symbols_of(facts)
    last = build.last_by(symbols, ["path", "name"], ["start_line", "seq"], ["id"])
    targets = last.select(F.col("path").alias("target_path"), F.col("name").alias("target_name"), F.col("id").alias("target"))
    bound = found.select("source_path", "target_path", "seq", F.posexplode("bindings").alias("nth", "b")).select("source_path", "target_path", "seq", "nth", "b.*")
    callers = symbol_calls(facts).select(F.col("path").alias("source_path"), F.col("id").alias("caller"), F.col("kind").alias("caller_kind"), "calls")
    space = F.concat(F.col("local"), F.lit("."))
    first = F.get(F.filter("calls", lambda c: F.startswith(c, space)), F.lit(0))
    name = F.when(F.col("imported") == "*", F.substring(first, F.length(space) + 1, F.length(first))).when(F.array_contains("calls", F.col("local")), F.col("imported"))
    crossing = bound.join(callers, "source_path").withColumn("target_name", name).where("target_name is not null")
    crossing = _with_tests(crossing.join(targets, ["target_path", "target_name"]).where("caller <> target").withColumn("path", F.col("source_path")))
    about = F.to_json(F.struct(F.col("local").alias("callee"), F.col("target_name").alias("resolved_import"), "target_path"))
    parts.append(_edge(crossing, F.col("caller"), F.col("target"), F.col("edge"), about, F.col("seq") * _BIG + F.col("nth"), True))

    endpoints = routes_of(facts).select(F.col("path").alias("source_path"), F.col("id").alias("endpoint"), F.col("handler").alias("local"))
    handled = endpoints.join(bound, ["source_path", "local"]).withColumn("target_name", F.col("imported")).join(targets, ["target_path", "target_name"]).withColumn("path", F.col("source_path"))
    named = F.to_json(F.struct(F.col("local").alias("handler"), F.col("target_name").alias("resolved_import"), "target_path"))
    parts.append(_edge(handled, F.col("endpoint"), F.col("target"), F.lit("REFERENCES"), named, F.col("seq") * _BIG + F.col("nth"), True))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return last_edges(every)


def all_edges(raw: DataFrame, derived: DataFrame) -> DataFrame:
    """Raw edges, and derived ones where no raw edge has the same ends and kind; with ids."""
    keys = ["source_id", "target_id", "kind"]
    new = derived.join(raw.select(*keys), keys, "left_anti").select(*raw.columns)
    return raw.unionByName(new).withColumn("id", F.xxhash64(*keys))


def chunks_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Line groups of every file, and one chunk for each symbol."""
    own = build.file_chunks(files).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    of_files = own.select("file_id", file_node_id(F.col("path")).alias("node_id"), F.lit("file").alias("kind"), "text", "start_line", "end_line", F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("summary"), "seq")
    symbols = symbols_of(facts).join(files.select(F.col("id").alias("file_id"), "path"), "path")
    of_symbols = symbols.select("file_id", F.col("id").alias("node_id"), "kind", F.col("snippet").alias("text"), "start_line", "end_line", F.coalesce("summary", "signature").alias("summary"), F.col("seq").cast("bigint").alias("seq"))
    every = of_files.unionByName(of_symbols)
    return every.withColumn("id", F.xxhash64("file_id", "node_id", "kind", "start_line", "seq"))
