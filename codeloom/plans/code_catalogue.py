"""Parsing and graph construction bound to generated sources, with their DuckDB counterparts.

Each customer becomes a TypeScript module and every fifth one a test file besides. What a parser must
find in them follows from the template, so SQL can state it without parsing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import code_graph, graph, maintain
from codeloom.operators import context as ctx
from codeloom.sources import files as src
from codeloom.sources.parse import parse_files
from codeloom.session import spread, stored, table

MODULE = """import { f{t} as up{k} } from '../g{s}/m{t}';
import base{k} from '@/g{s}/m{t}';
import fs from 'node:fs';

// Work of c{k}.
export function f{k}(a) {
  return h{k}(up{k}(a));
}

function h{k}(a) {
  return a + 1;
}

export class C{k} {
  run(a) {
    return f{k}(a);
  }
}

app.get('/c/{k}', f{k});
"""
TEST = """import * as m from './m{k}';

function testF{k}() {
  return m.f{k}(1);
}
"""
REPOSITORY = "modules"
ALIASES = [("@/*", ["src/*"])]
#: Ids of test files start here.
TEST_FILE = 1_000_000_000
#: Modules that one task generates and parses.
MODULES_A_TASK = 4096


def _filled(template: str, k: Column, t: Column) -> Column:
    values = {"{k}": k, "{t}": t, "{s}": t % 7}
    return reduce(lambda text, v: F.replace(text, F.lit(v[0]), v[1].cast("string")), values.items(), F.lit(template))


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """The modules and tests as a table of files (id, path, language, hash, size, text).

    A few bytes of input make a module, so neither the input's splits nor its size fit the work: the keys are
    dealt out by number, and the hint keeps joins from broadcasting what looks small.
    """
    k, t = F.col("k"), F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("k") / 2).cast("bigint"))
    keys = spread(table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("k")), MODULES_A_TASK, "k")
    stem = F.concat(F.lit("src/g"), (k % 7).cast("string"), F.lit("/m"), k.cast("string"))
    modules = keys.select(k.alias("id"), F.concat(stem, F.lit(".ts")).alias("path"), _filled(MODULE, k, t).alias("text"))
    tests = keys.where("k % 5 = 0").select((k + TEST_FILE).alias("id"), F.concat(stem, F.lit(".test.ts")).alias("path"), _filled(TEST, k, t).alias("text"))
    raw = F.col("text").cast("binary")
    return modules.unionByName(tests).select("id", "path", F.lit("typescript").alias("language"), F.sha2(raw, 256).alias("hash"), F.octet_length("text").cast("bigint").alias("size"), "text").hint("merge")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return parse_files(code_files(spark, sf)).hint("merge")


def _parsed(files: DataFrame) -> DataFrame:
    """The files' facts, parsed once for all that is read from them."""
    return stored(parse_files(files)).hint("merge")


def _sql_text(template: str) -> str:
    quoted = template.replace("'", "''")
    return f"replace(replace(replace('{quoted}', '{{k}}', CAST(k AS VARCHAR)), '{{t}}', CAST(t AS VARCHAR)), '{{s}}', CAST(t % 7 AS VARCHAR))"


_F = "function f{k}(a) {\n  return h{k}(up{k}(a));\n}"
_H = "function h{k}(a) {\n  return a + 1;\n}"
_C = "class C{k} {\n  run(a) {\n    return f{k}(a);\n  }\n}"
_R = "run(a) {\n    return f{k}(a);\n  }"
_T = "function testF{k}() {\n  return m.f{k}(1);\n}"


def _symbol_sql(source: str, seq: int, kind: str, name: str, start: int, end: int, summary: str, snippet: str) -> str:
    signature = snippet.split("\n", 1)[0]
    return (
        f"SELECT id, k, path, {seq} AS seq, '{kind}' AS kind, {_sql_text(name)} AS name, path || '::' || {_sql_text(name)} AS qualified_name, {start} AS start_line,"
        f" {end} AS end_line, {_sql_text(signature)} AS signature, {summary} AS summary, {_sql_text(snippet)} AS snippet FROM {source}"
    )


_SYMBOLS_SQL = " UNION ALL ".join(
    [
        _symbol_sql("code", 0, "Function", "f{k}", 6, 8, _sql_text("Work of c{k}."), _F),
        _symbol_sql("code", 1, "Function", "h{k}", 10, 12, "NULL", _H),
        _symbol_sql("code", 2, "Class", "C{k}", 14, 18, "NULL", _C),
        _symbol_sql("code", 3, "Method", "run", 15, 17, "NULL", _R),
        _symbol_sql("tests", 0, "Test", "testF{k}", 3, 5, "NULL", _T),
    ]
)
_IMPORTS_SQL = " UNION ALL ".join(
    f"SELECT path, {_sql_text(name)} AS source, {line} AS line, {_sql_text(imported)} AS imported, {_sql_text(local)} AS local FROM {source}"
    for source, name, line, imported, local in [
        ("code", "../g{s}/m{t}", 1, "f{t}", "up{k}"),
        ("code", "@/g{s}/m{t}", 2, "base{k}", "base{k}"),
        ("code", "node:fs", 3, "fs", "fs"),
        ("tests", "./m{k}", 1, "*", "m"),
    ]
)
_DIRS_SQL = "SELECT DISTINCT 'src/g' || (k % 7) AS path, 'g' || (k % 7) AS name, 'src' AS parent FROM code UNION ALL SELECT 'src', 'src', '.'"
_ROUTE = "path || '::route::GET /c/' || k"

BASE = f"""WITH code AS (
        SELECT c_custkey AS id, c_custkey AS k, greatest(1, c_custkey // 2) AS t, 'src/g' || (c_custkey % 7) || '/m' || c_custkey || '.ts' AS path,
               'src/g' || (greatest(1, c_custkey // 2) % 7) || '/m' || greatest(1, c_custkey // 2) || '.ts' AS target FROM customer),
    tests AS (SELECT {TEST_FILE} + k AS id, k, t, 'src/g' || (k % 7) || '/m' || k || '.test.ts' AS path, code.path AS target FROM code WHERE k % 5 = 0),
    symbols AS ({_SYMBOLS_SQL}), imports AS ({_IMPORTS_SQL}), dirs AS ({_DIRS_SQL}),
    calls AS (
        SELECT path, 0 AS call, 'h' || k AS name, NULL AS qualifier, 7 AS line, 'f' || k AS caller FROM code
        UNION ALL SELECT path, 1, 'up' || k, NULL, 7, 'f' || k FROM code
        UNION ALL SELECT path, 2, 'f' || k, NULL, 16, 'run' FROM code
        UNION ALL SELECT path, 3, 'get', 'app', 20, NULL FROM code
        UNION ALL SELECT path, 0, 'f' || k, 'm', 4, 'testF' || k FROM tests),
    raw AS (
        SELECT '.' AS source, 'src' AS target, 'CONTAINS' AS kind
        UNION ALL SELECT parent, path, 'CONTAINS' FROM dirs WHERE parent <> '.'
        UNION ALL SELECT 'src/g' || (k % 7), path, 'CONTAINS' FROM (SELECT k, path FROM code UNION ALL SELECT k, path FROM tests)
        UNION ALL SELECT path, qualified_name, 'DEFINES' FROM symbols
        UNION ALL SELECT path, {_ROUTE}, 'DEFINES' FROM code
        UNION ALL SELECT path || '::f' || k, path || '::h' || k, 'CALLS' FROM code
        UNION ALL SELECT path || '::run', path || '::f' || k, 'CALLS' FROM code
        UNION ALL SELECT {_ROUTE}, path || '::f' || k, 'REFERENCES' FROM code
        UNION ALL SELECT path, 'import:' || source, 'IMPORTS' FROM imports),
    derived AS (
        SELECT path AS source, target, 'IMPORTS' AS kind FROM code WHERE path <> target
        UNION ALL SELECT path, target, 'IMPORTS' FROM tests
        UNION ALL SELECT path || '::f' || k, target || '::f' || t, 'CALLS' FROM code WHERE path <> target
        UNION ALL SELECT path || '::testF' || k, target || '::f' || k, unnest(['CALLS', 'TESTS']) FROM tests)
"""

QUERIES = {}
ORACLES = {}


def _register(name: str, sql: str):  # noqa: ANN202
    def add(query):  # noqa: ANN001, ANN202
        QUERIES[name], ORACLES[name] = query, f"{BASE} {sql}"
        return query

    return add


@_register("parsed_symbols", "SELECT path, CAST(seq AS BIGINT) AS seq, kind, name, qualified_name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, signature, summary, snippet FROM symbols")
def parsed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """parse_file: kinds, names, lines, signatures, comments above and snippets."""
    return code_graph.symbols_of(_facts(spark, sf)).withColumn("seq", F.col("seq").cast("bigint")).drop("id")


@_register("parsed_calls", "SELECT path, CAST(call AS BIGINT) AS call, name, qualifier, CAST(line AS BIGINT) AS line, coalesce(qualifier || '.', '') || name AS callee FROM calls")
def parsed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with qualifier, in order."""
    return code_graph.calls_of(_facts(spark, sf)).withColumn("call", F.col("call").cast("bigint"))


@_register("parsed_imports", "SELECT path, source, CAST(line AS BIGINT) AS line, imported, local FROM imports")
def parsed_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Import sources and their bindings."""
    rows = code_graph.imports_of(_facts(spark, sf))
    return rows.select("path", "source", "line", F.explode("bindings").alias("b")).select("path", "source", "line", "b.imported", "b.local")


@_register("parsed_routes", f"SELECT path, 'GET' AS method, '/c/' || k AS route, 'f' || k AS handler, CAST(20 AS BIGINT) AS line, {_ROUTE} AS qualified_name FROM code")
def parsed_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes with method, path and handler."""
    return code_graph.routes_of(_facts(spark, sf)).select("path", "method", "route", "handler", "line", "qualified_name")


@_register("code_symbol_calls", "SELECT s.qualified_name, coalesce(string_agg(CASE WHEN c.qualifier IS NULL THEN c.name ELSE c.name || ',' || c.qualifier || '.' || c.name END, ',' ORDER BY call), '') AS called FROM symbols AS s LEFT JOIN calls AS c ON c.path = s.path AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL")
def code_symbol_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls between each symbol's lines: name, then qualified name."""
    return code_graph.symbol_calls(_parsed(code_files(spark, sf))).select("qualified_name", F.array_join("calls", ",").alias("called"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    files = code_files(spark, sf)
    return code_graph.nodes_of_files(files, _parsed(files), REPOSITORY)


@_register(
    "code_nodes",
    f"""SELECT 'Repository' AS kind, '{REPOSITORY}' AS name, '.' AS qualified_name, '' AS path, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line, CAST(NULL AS VARCHAR) AS summary
    UNION ALL SELECT 'Directory', name, path, path, NULL, NULL, NULL FROM dirs
    UNION ALL SELECT 'File', string_split(path, '/')[-1], path, path, NULL, NULL, 'Source file' FROM (SELECT path FROM code UNION ALL SELECT path FROM tests)
    UNION ALL SELECT kind, name, qualified_name, path, start_line, end_line, coalesce(summary, signature) FROM symbols
    UNION ALL SELECT 'Endpoint', 'GET /c/' || k, {_ROUTE}, path, 20, 20, 'GET /c/' || k FROM code
    UNION ALL SELECT DISTINCT 'Symbol', source, 'import:' || source, NULL, NULL, NULL, 'Imported dependency' FROM imports""",
)
def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Repository, directories, files, symbols, endpoints and imported sources."""
    return _nodes(spark, sf).select("kind", "name", "qualified_name", "path", "start_line", "end_line", "summary")


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and all edges by the qualified names of their ends."""
    files = code_files(spark, sf)
    facts = _parsed(files)
    nodes = code_graph.nodes_of_files(files, facts, REPOSITORY)
    edges = code_graph.all_edges(code_graph.raw_edges(files, facts), code_graph.derived_edges(files, facts, ALIASES, None))
    return nodes, edges


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = nodes.select(F.col("id"), F.col("qualified_name"))
    return (
        edges.join(ends.toDF("source_id", "source"), "source_id")
        .join(ends.toDF("target_id", "target"), "target_id")
        .select("source", "target", "kind", "is_derived")
    )


@_register("code_edges_raw", "SELECT source, target, kind FROM raw")
def code_edges_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Containment, definitions, calls and handlers inside files, and imports by source."""
    return _named(*_edges(spark, sf)).where("not is_derived").drop("is_derived")


@_register("code_edges_derived", "SELECT source, target, kind FROM derived")
def code_edges_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Imports resolved to files, by relative path and alias, and calls and tests across files."""
    return _named(*_edges(spark, sf)).where("is_derived").drop("is_derived")


@_register(
    "code_chunks",
    f"""SELECT id AS file_id, 'file' AS kind, CAST(1 AS BIGINT) AS start_line, CAST(20 AS BIGINT) AS end_line, {_sql_text(MODULE.rstrip(chr(10)))} AS text, path || ':1-20' AS summary FROM code
    UNION ALL SELECT id, 'file', 1, 5, {_sql_text(TEST.rstrip(chr(10)))}, path || ':1-5' FROM tests
    UNION ALL SELECT id, kind, start_line, end_line, snippet, coalesce(summary, signature) FROM symbols""",
)
def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of files and one for each symbol."""
    files = code_files(spark, sf)
    return code_graph.chunks_of(files, parse_files(files).hint("merge")).select("file_id", "kind", "start_line", "end_line", "text", "summary")


@_register(
    "product_flow_frames",
    f"""SELECT 'node' AS frame, {_ROUTE} AS source, CAST(NULL AS VARCHAR) AS target, 'Endpoint' AS kind FROM code
    UNION ALL SELECT 'edge', source, target, kind FROM (SELECT * FROM raw UNION ALL SELECT * FROM derived) WHERE kind IN ('REFERENCES', 'CALLS')""",
)
def product_flow_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Both frames of the product-flow graph: endpoints, and references and calls."""
    return _frames(spark, sf, "Endpoint", ["REFERENCES", "CALLS"])


@_register(
    "test_frames",
    """SELECT 'node' AS frame, qualified_name AS source, CAST(NULL AS VARCHAR) AS target, 'Test' AS kind FROM symbols WHERE kind = 'Test'
    UNION ALL SELECT 'edge', source, target, kind FROM derived WHERE kind = 'TESTS'""",
)
def test_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Both frames of the test graph: tests, and what they test."""
    return _frames(spark, sf, "Test", ["TESTS"])


def _frames(spark: SparkSession, sf: str, kind: str, edge_kinds: list[str]) -> DataFrame:
    nodes, edges = _edges(spark, sf)
    leading = nodes.where(F.col("kind") == kind).select(F.lit("node").alias("frame"), F.col("qualified_name").alias("source"), F.lit(None).cast("string").alias("target"), "kind")
    chosen = _named(nodes, edges.where(F.col("kind").isin(edge_kinds)))
    return leading.unionByName(chosen.select(F.lit("edge").alias("frame"), "source", "target", "kind"))


@_register("code_lookup_by_id", "SELECT id, path FROM code WHERE id % 10 = 3")
def code_lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Files by a set of ids."""
    files = code_files(spark, sf)
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).where("id % 10 = 3")
    return files.join(wanted, "id", "left_semi").select("id", "path")


@_register(
    "code_incremental",
    """SELECT path, CASE WHEN k % 10 = 1 THEN 'modified' WHEN k % 10 = 2 THEN 'new' ELSE 'unchanged' END AS change, CAST(4 AS BIGINT) AS symbols FROM code WHERE k % 10 <> 3
    UNION ALL SELECT path, 'unchanged', 1 FROM tests
    UNION ALL SELECT path, 'deleted', 0 FROM code WHERE k % 10 = 3""",
)
def code_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Changes by content hash; facts of unchanged files are kept, of others parsed again."""
    files = code_files(spark, sf)
    key = F.col("id") % 10
    old = files.where(key != 2).withColumn("hash", F.when(key == 1, "other").otherwise(F.col("hash")))
    new = files.where(key != 3)
    changes = maintain.status(old.select("path", "hash"), new.select("path", "hash"))
    kept = parse_files(old).join(changes.where("change = 'unchanged'"), "path", "left_semi")
    fresh = parse_files(new.join(changes.where("change in ('new', 'modified')"), "path", "left_semi"))
    sizes = kept.unionByName(fresh).select("path", F.size("symbols").cast("bigint").alias("symbols"))
    return changes.join(sizes, "path", "left").select("path", "change", F.coalesce("symbols", F.lit(0).cast("bigint")).alias("symbols"))


@_register("code_clear_file", "SELECT source, target, kind FROM (SELECT * FROM raw UNION ALL SELECT * FROM derived) AS e WHERE source NOT LIKE '%.test.ts%' AND target NOT LIKE '%.test.ts%'")
def code_clear_file(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left when the test files are cleared."""
    nodes, edges = _edges(spark, sf)
    gone = code_files(spark, sf).where(F.endswith(F.col("path"), F.lit(".test.ts"))).select(F.col("id").alias("file_id"))
    left, kept, _ = maintain.clear_files(nodes, edges, None, gone)
    return _named(left, kept).drop("is_derived")


@_register("code_definition_at", "SELECT path, CAST(16 AS BIGINT) AS line, path || '::run' AS qualified_name FROM code")
def code_definition_at(spark: SparkSession, sf: str) -> DataFrame:
    """The tightest symbol around a line of every module: the method, not its class."""
    symbols = _nodes(spark, sf).where(F.col("kind").isin("Function", "Method", "Class", "Type", "Test"))
    around = symbols.where("start_line <= 16 and 16 <= end_line")
    best = around.groupBy("path").agg(F.min_by("qualified_name", F.struct(F.expr("end_line - start_line"), "id")).alias("qualified_name"))
    return best.where("not path like '%.test.ts'").select("path", F.lit(16).cast("bigint").alias("line"), "qualified_name")


@_register(
    "code_edge_labels",
    "SELECT string_split(source, '::')[-1] || ' -' || kind || '-> ' || string_split(target, '::')[-1] AS edge FROM derived WHERE kind = 'TESTS'",
)
def code_edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as short labels."""
    nodes, edges = _edges(spark, sf)
    return ctx.edge_labels(nodes, edges.where("kind = 'TESTS'"))


@_register("code_integrity", "SELECT unnest(['node_ids', 'edge_keys', 'edge_sources', 'edge_targets']) AS \"check\", CAST(0 AS BIGINT) AS problems")
def code_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """A graph built from files has unique nodes and edges, and all ends."""
    return maintain.integrity(*_edges(spark, sf))


@_register("code_imports_of", "SELECT qualified_name FROM (SELECT 'import:' || source AS qualified_name FROM imports WHERE path = 'src/g5/m5.ts' UNION ALL SELECT target FROM derived WHERE source = 'src/g5/m5.ts' AND kind = 'IMPORTS' UNION ALL SELECT 'src/g5/m5.ts')")
def code_imports_of(spark: SparkSession, sf: str) -> DataFrame:
    """What one file imports, as a subgraph's nodes."""
    nodes, edges = _edges(spark, sf)
    own = nodes.where("kind = 'File' and path = 'src/g5/m5.ts'").select(F.col("id").alias("source_id"))
    chosen = edges.where("kind = 'IMPORTS'").join(F.broadcast(own), "source_id", "left_semi")
    return graph.nodes_of(nodes, chosen).select("qualified_name")


@_register("scanned_table", "SELECT path, 'ts' AS extension, 'typescript' AS language, false AS is_binary FROM (SELECT path FROM code UNION ALL SELECT path FROM tests)")
def scanned_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of contents as the scan describes it."""
    corpus = code_files(spark, sf).select("path", F.col("text").alias("content"), F.lit(0).alias("modified_at"))
    return src.from_table(corpus).select("path", "extension", "language", "is_binary")
