"""Every core operator bound to the driver's tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.operators import build, graph, maintain, search
from codeloom.operators import context as ctx
from codeloom.plans import bindings as b
from codeloom.plans import code_catalogue as code
from codeloom.session import checkpoint, shares, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EDGE = ["source_id", "target_id", "kind"]
NODE = ["id", "kind", "name", "path", "start_line"]
#: Ids that exist at every scale.
PART_NODE, ORDER_NODE, CUSTOMER_NODE, SUPPLIER_NODE, NATION_NODE = b.PART + 1, b.ORDER + 1, b.CUSTOMER + 1, b.SUPPLIER + 1, b.NATION + 1
ALIASES = [("@/*", ["src/*"]), ("~lib/*", ["lib/*", "vendor/*"]), ("config", ["src/config"])]

_ACCENTS = f"'{T._ACCENTED}', '{T._PLAIN}'"
_TOKENS = "list_filter(regexp_split_to_array(translate(lower({}), " + _ACCENTS + r"), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_LINES = "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(regexp_replace({0}, '\\n\\z', ''), chr(10)), lambda x: regexp_replace(x, '\\r\\z', '')) END"


def _register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def _graph(sql: str) -> str:
    return f"WITH {b.NODES_SQL}, {b.EDGES_SQL} {sql}"


def _files(sql: str) -> str:
    return f"WITH {b.FILES_SQL} {sql}"


@_register("list_files", _files("SELECT id, path, language, hash, size FROM files"))
def list_files(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select("id", "path", "language", "hash", "size").orderBy("path")


@_register("find_file_by_path", _files("SELECT id, path, hash FROM files WHERE path = (SELECT min(path) FROM files WHERE id < 10)"))
def find_file_by_path(spark: SparkSession, sf: str) -> DataFrame:
    found = b.files(spark, sf)
    wanted = found.where("id < 10").agg(F.min("path").alias("path"))
    return found.join(F.broadcast(wanted), "path").select("id", "path", "hash")


_URL_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '')"


@_register(
    "language_map",
    rf"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages),
    e AS (SELECT *, lower(regexp_extract(path, '[^/]\.([^./]*)$', 1)) AS x FROM p)
    SELECT page_id, path, CASE WHEN x <> '' THEN x END AS extension, CASE
        WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN x IN ('ts', 'tsx') THEN 'typescript' WHEN x = 'rs' THEN 'rust'
        WHEN x IN ('md', 'mdx') THEN 'markdown' WHEN x = 'json' THEN 'json' WHEN x = 'toml' THEN 'toml' WHEN x IN ('yaml', 'yml') THEN 'yaml' END AS language
    FROM e""",
)
def language_map(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.expr(_URL_PATH).alias("path"))
    ext = P.extension(F.col("path"))
    return pages.select("page_id", "path", ext.alias("extension"), P.language(ext).alias("language"))


@_register(
    "skip_filter",
    rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'dist/' ELSE 'src/' END || {_URL_PATH} AS path FROM pages)
    SELECT page_id, path FROM p WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.codeloom', 'node_modules', 'dist', 'build', 'target'])""",
)
def skip_filter(spark: SparkSession, sf: str) -> DataFrame:
    top = F.when(F.col("page_id") % 3 == 0, "dist/").otherwise("src/")
    pages = table(spark, sf, "pages").select("page_id", F.concat(top, F.expr(_URL_PATH)).alias("path"))
    return pages.where(~P.is_pruned(F.col("path")))


_RANGE = """, l AS (SELECT path, {lines} AS ls FROM files WHERE path LIKE '%/d7.md')
    SELECT path, CAST({start} AS BIGINT) AS start_line, CAST(least({start} + {n} - 1, len(ls)) AS BIGINT) AS end_line,
           CAST(len(ls) AS BIGINT) AS total_lines, array_to_string({shown}, chr(10)) AS content FROM l"""


def _document_7(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    rows = b.files(spark, sf).where(F.endswith(F.col("path"), F.lit("/d7.md")))
    return rows, rows.select("path").first()[0]


@_register("read_range", _files(_RANGE.format(lines=_LINES.format("text"), start=2, n=5, shown="ls[2:6]")))
def read_range(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = _document_7(spark, sf)
    return search.read_range(rows, path, 2, 5, False)


@_register(
    "read_numbered",
    _files(_RANGE.format(lines=_LINES.format("text"), start=1, n=3, shown="list_transform(ls[1:3], lambda x, i: lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || x)")),
)
def read_numbered(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = _document_7(spark, sf)
    return search.read_range(rows, path, 0, 3, True)


@_register(
    "file_chunks",
    _files(
        f""", l AS (SELECT id, {_LINES.format("text")} AS ls FROM files),
    c AS (SELECT id, ls, unnest(range(0, CAST(ceil(len(ls) / 80) AS BIGINT))) AS seq FROM l),
    t AS (SELECT id, seq, seq * 80 + 1 AS start_line, least(seq * 80 + 80, len(ls)) AS end_line, array_to_string(ls[seq * 80 + 1:seq * 80 + 80], chr(10)) AS text FROM c)
    SELECT id AS file_id, seq, start_line, end_line, text FROM t WHERE strlen(text) <= 6000
    UNION ALL SELECT id, seq, start_line, end_line, string_agg(ch, '' ORDER BY i) FROM (
        SELECT id, seq, start_line, end_line, ch, i, sum(strlen(ch)) OVER (PARTITION BY id, seq ORDER BY i) AS upto
        FROM (SELECT id, seq, start_line, end_line, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM t WHERE strlen(text) > 6000))
    WHERE upto <= 6000 GROUP BY ALL"""
    ),
)
def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return build.file_chunks(b.files(spark, sf))


_PREVIEWS_SQL = f""", k AS (SELECT id, text, coalesce(strlen(text) > {len(T.PREVIEW_MARK.encode()) + T.PREVIEW_BYTES}, false) AS cut FROM files),
    c AS (SELECT id, unnest(string_split(left(text, {T.PREVIEW_BYTES}), '')) AS ch, generate_subscripts(string_split(left(text, {T.PREVIEW_BYTES}), ''), 1) AS i FROM k WHERE cut),
    u AS (SELECT id, ch, i, sum(strlen(ch)) OVER (PARTITION BY id ORDER BY i) AS upto FROM c),
    s AS (SELECT id, string_agg(ch, '' ORDER BY i) AS head FROM u WHERE upto <= {T.PREVIEW_BYTES} GROUP BY id),
    previews AS (SELECT id, CASE WHEN cut THEN regexp_replace(head, '\\s+$', '') || chr(10) || '{T.PREVIEW_MARK[1:]}' ELSE text END AS preview FROM k LEFT JOIN s USING (id))"""


@_register("chunk_preview", _files(f"{_PREVIEWS_SQL} SELECT id, preview FROM previews"))
def chunk_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Previews cut at bytes, never inside a character."""
    return b.files(spark, sf).select("id", T.preview(F.col("text")).alias("preview"))


@_register(
    "directory_chain",
    _files(
        """, p AS (SELECT DISTINCT string_split(path, '/') AS parts FROM files), n AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path, array_to_string(parts[1:k - 1], '/') AS parent, parts[k] AS name
    FROM p, unnest(range(1, len(parts))) AS u(k)) SELECT path, parent, name FROM n"""
    ),
)
def directory_chain(spark: SparkSession, sf: str) -> DataFrame:
    return build.directory_chain(b.files(spark, sf))


@_register("doc_tokens", _files(f", t AS (SELECT unnest({_TOKENS.format('text')}) AS term FROM files) SELECT term, count(*) AS n FROM t GROUP BY term"))
def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_register("doc_lengths", _files(f"SELECT id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS terms FROM files"))
def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select("id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("terms"))


_ROWS_SQL = """, rows AS (
    SELECT 'file' AS kind, id AS ref_id, id AS file_id, path, path AS name, language AS text FROM files
    UNION ALL SELECT 'chunk', id, id, '', 'file', text FROM files)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as index rows: the file, and its text as one chunk."""
    files = b.files(spark, sf)
    none = F.lit(None).cast("bigint")
    of_files = files.select(F.lit("file").alias("kind"), F.col("id").alias("ref_id"), F.col("id").alias("file_id"), none.alias("node_id"), "path", F.col("path").alias("name"), F.col("language").alias("text"))
    of_chunks = files.select(F.lit("chunk").alias("kind"), F.col("id").alias("ref_id"), F.col("id").alias("file_id"), none.alias("node_id"), F.lit("").alias("path"), F.lit("file").alias("name"), "text")
    return of_files.unionByName(of_chunks)


@_register(
    "postings",
    _files(
        _ROWS_SQL
        + ", c AS ("
        + " UNION ALL ".join(f"SELECT kind, ref_id, {i} AS col, unnest({_TOKENS.format(c)}) AS term FROM rows" for i, c in enumerate(("kind", "path", "name", "text")))
        + ") SELECT term, kind, ref_id, CAST(col AS INTEGER) AS col, count(*) AS tf FROM c GROUP BY ALL"
    ),
)
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(_rows(spark, sf))


def _bm25_sql(query: str, terms: list[str], limit: int) -> str:
    every = " + ".join(f"len({_TOKENS.format(c)})" for c in ("kind", "path", "name", "text"))
    tf = [" + ".join(f"len(list_filter({_TOKENS.format(c)}, lambda t: starts_with(t, '{p}')))" for c in ("kind", "path", "name", "text")) for p in terms]
    counted = ", ".join([f"{every} AS len", *(f"{x} AS tf{i}" for i, x in enumerate(tf))])
    stats = ", ".join(["count(*) AS n", "sum(len) / count(*) AS average", *(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))])
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * len / average))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    like = "%" + query.lower() + "%"
    return _files(
        f"""{_ROWS_SQL}, k AS (SELECT *, {counted} FROM rows), s AS (SELECT {stats} FROM k),
    r AS (SELECT kind, ref_id, file_id, path, name, round({score}, 6) AS score FROM k, s WHERE {hit})
    SELECT * FROM r ORDER BY CASE WHEN path = '{query}' OR name = '{query}' THEN -1000.0
        WHEN lower(path) LIKE '{like}' OR lower(name) LIKE '{like}' THEN -100.0 ELSE -score END, kind, ref_id LIMIT {limit}"""
    )


@_register("search_ranked", _bm25_sql("license apache the", ["license", "apache", "the"], 20))
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_rows(spark, sf), "license apache the", 20, rounded=6).drop("node_id", "text")


@_register("search_by_path", _bm25_sql("src7", ["src7"], 20))
def search_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(_rows(spark, sf), "src7", 20, rounded=6).drop("node_id", "text")


_LIKE = "lower({}) LIKE '%{}%'"


def _like_sql(query: str, limit: int) -> str:
    return f"""WITH {b.FILES_SQL}, {b.NODES_SQL} {_PREVIEWS_SQL}, lf AS (
        SELECT 'file' AS kind, id AS ref_id, id AS file_id, CAST(NULL AS BIGINT) AS node_id, path, path AS name, language AS snippet,
               CASE WHEN path = '{query}' THEN 100.0 WHEN {_LIKE.format("path", query)} THEN 50.0 ELSE 1.0 END AS score, 0 AS branch, path AS ord
        FROM files WHERE {_LIKE.format("path", query)} OR {_LIKE.format("language", query)} ORDER BY score DESC, path, ref_id LIMIT {limit}),
    ln AS (
        SELECT 'node', id, file_id, id, path, name, summary,
               CASE WHEN name = '{query}' THEN 100.0 WHEN {_LIKE.format("qualified_name", query)} THEN 60.0 ELSE 10.0 END AS score, 1, name
        FROM nodes WHERE {" OR ".join(_LIKE.format(c, query) for c in ("name", "qualified_name", "summary", "path"))} ORDER BY score DESC, name, id LIMIT {limit}),
    lc AS (
        SELECT 'chunk', id, id, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'file', left(preview, 240), 5.0 AS score, 2, ''
        FROM previews WHERE {_LIKE.format("preview", query)} ORDER BY id LIMIT {limit})
    SELECT kind, ref_id, file_id, node_id, path, name, snippet, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM lf UNION ALL SELECT * FROM ln UNION ALL SELECT * FROM lc) AS u
    ORDER BY score DESC, branch, ord, ref_id LIMIT {limit}"""


def _search_like(spark: SparkSession, sf: str, query: str, limit: int) -> DataFrame:
    files, nodes = b.files(spark, sf), b.nodes(spark, sf)
    chunks = files.select("id", F.col("id").alias("file_id"), F.lit(None).cast("bigint").alias("node_id"), F.lit("file").alias("kind"), "text", F.lit(None).cast("string").alias("summary"))
    return search.search_like(files, nodes, chunks, query, limit)


@_register("search_like", _like_sql("building", 25))
def search_like(spark: SparkSession, sf: str) -> DataFrame:
    """Files and nodes fill the result."""
    return _search_like(spark, sf, "building", 25)


@_register("search_like_chunks", _like_sql("license", 25))
def search_like_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What only texts hold."""
    return _search_like(spark, sf, "license", 25)


def _match_sql(query: str, kinds: list[str], limit: int) -> str:
    q, like = query, f"%{query.lower()}%"
    has = " OR ".join(f"lower({c}) LIKE '{like}'" for c in ("name", "qualified_name", "path", "summary"))
    names = ", ".join(f"'{k}'" for k in kinds)
    return _graph(
        f"""SELECT id, kind, name, path, start_line, CASE WHEN name = '{q}' THEN 0 WHEN qualified_name = '{q}' THEN 1 WHEN lower(name) LIKE '{like}' THEN 2 ELSE 3 END AS rank
    FROM nodes WHERE kind IN ({names}) AND ({has}) ORDER BY rank, coalesce(path, ''), coalesce(start_line, 0), id LIMIT {limit}"""
    )


@_register("symbol_match", _match_sql("order_1", graph.SYMBOL_KINDS, 50))
def symbol_match(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symbols_matching(b.nodes(spark, sf), "order_1", limit=50).select(*NODE, "rank")


@_register("definition", _match_sql("PROMO", graph.SYMBOL_KINDS, 20))
def definition(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symbols_matching(b.nodes(spark, sf), "PROMO", limit=20).select(*NODE, "rank")


def _grep_sql(where: str, limit: int, more: str = "") -> str:
    return _files(
        f""", l AS (SELECT path, {_LINES.format("text")} AS ls FROM files {more}), e AS (SELECT path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM l)
    SELECT path, CAST(line AS BIGINT) AS line, text FROM e WHERE {where} ORDER BY path, line LIMIT {limit}"""
    )


@_register("grep_regex", _grep_sql("regexp_matches(text, '(?i)licen[sc]ed? under .*(gnu|mit)')", 100))
def grep_regex(spark: SparkSession, sf: str) -> DataFrame:
    return search.grep(b.files(spark, sf), "licen[sc]ed? under .*(gnu|mit)", None, False, True, 100)


@_register("grep_substring", _grep_sql("contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'apache license')", 100, "WHERE path LIKE 'src1%/en/%'"))
def grep_substring(spark: SparkSession, sf: str) -> DataFrame:
    return search.grep(b.files(spark, sf), "Apache License", "src1*/en/*", False, False, 100)


@_register("glob_files", _files(r"SELECT id, path FROM files WHERE regexp_matches(path, '^src[0-4]/.*d[^/]*[05]\.md$') ORDER BY path, id LIMIT 200"))
def glob_files(spark: SparkSession, sf: str) -> DataFrame:
    return search.glob_files(b.files(spark, sf), "src[0-4]/**/d*[05].md", 200).select("id", "path")


@_register(
    "suggested_tests",
    code.BASE
    + """, files AS (SELECT id, path FROM code UNION ALL SELECT id, path FROM tests), hits AS (SELECT id, path FROM files WHERE contains(path, '/m5') ORDER BY path, id LIMIT 60)
    SELECT id, path FROM hits WHERE contains(lower(path || path), 'test') OR contains(lower(path || path), 'spec') ORDER BY path, id LIMIT 8""",
)
def suggested_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Of the files that a search finds, those that speak of tests."""
    found = search.glob_files(code.code_files(spark, sf), "**/m5*", 60)
    return search.suggest_tests(found.withColumn("name", F.col("path"))).select("id", "path")


_PLACE = "coalesce(path, ''), coalesce(start_line, 0), id"


@_register("nodes_by_kind", _graph(f"SELECT id, kind, name, path, start_line FROM nodes WHERE kind IN ('Test', 'Endpoint') ORDER BY {_PLACE} LIMIT 300"))
def nodes_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes_by_kinds(b.nodes(spark, sf), ["Test", "Endpoint"], 300).select(*NODE)


@_register("semantic_summaries", _graph(f"SELECT id, kind, name, path, start_line, summary FROM nodes WHERE summary <> '' AND kind <> 'Directory' ORDER BY {_PLACE} LIMIT 200"))
def semantic_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return graph.semantic_summaries(b.nodes(spark, sf), 200).select(*NODE, "summary")


_PATH_OF = f"(SELECT path FROM nodes WHERE id = {CUSTOMER_NODE})"


@_register(
    "document_symbols",
    _graph(f"""SELECT id, kind, name, path, start_line, row_number() OVER (ORDER BY CASE WHEN kind = 'Endpoint' THEN 1 ELSE 0 END, start_line, id) AS position
    FROM nodes WHERE path = {_PATH_OF} AND kind IN ('Function', 'Method', 'Class', 'Type', 'Test', 'Endpoint')"""),
)
def document_symbols(spark: SparkSession, sf: str) -> DataFrame:
    nodes = b.nodes(spark, sf)
    path = nodes.where(F.col("id") == CUSTOMER_NODE).select("path").first()[0]
    return graph.document_symbols(nodes, path).select(*NODE, "position")


@_register(
    "top_symbols",
    _graph("""SELECT id, file_id, name, start_line, position FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS position
    FROM nodes WHERE file_id IS NOT NULL AND kind NOT IN ('File', 'Directory')) AS t WHERE position <= 3"""),
)
def top_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_symbols(b.nodes(spark, sf), 3).select("id", "file_id", "name", "start_line", "position")


def _edge_graph(name: str, kinds: list[str], limit: int) -> None:
    """A graph query of some edge kinds: the edges, and the nodes at their ends."""
    names = ", ".join(f"'{k}'" for k in kinds)
    chosen = f"SELECT source_id, target_id, kind FROM edges WHERE kind IN ({names}) ORDER BY source_id, target_id, kind LIMIT {limit}"
    _register(f"{name}_edges", _graph(chosen))(lambda spark, sf: graph.edges_of_kinds(b.edges(spark, sf), kinds, limit))
    nodes_sql = f", c AS ({chosen}) SELECT id, kind, name, path, start_line FROM nodes WHERE id IN (SELECT source_id FROM c UNION SELECT target_id FROM c)"
    _register(f"{name}_nodes", _graph(nodes_sql))(lambda spark, sf: graph.subgraph(b.nodes(spark, sf), b.edges(spark, sf), kinds, limit)[0].select(*NODE))


_edge_graph("dependency_graph", ["IMPORTS"], 200)
_edge_graph("call_graph", ["CALLS"], 200)
_edge_graph("product_flow_graph", ["REFERENCES", "CALLS"], 200)
_edge_graph("test_graph", ["TESTS"], 200)


@_register(
    "ast_graph",
    _graph(
        "SELECT * FROM (SELECT source_id, target_id, kind FROM edges WHERE kind = 'DEFINES' ORDER BY source_id, target_id LIMIT 150) AS d"
        " UNION ALL SELECT * FROM (SELECT source_id, target_id, kind FROM edges WHERE kind = 'CONTAINS' ORDER BY source_id, target_id LIMIT 150) AS c"
    ),
)
def ast_graph(spark: SparkSession, sf: str) -> DataFrame:
    edges = b.edges(spark, sf)
    return graph.edges_of_kinds(edges, ["DEFINES"], 150).unionByName(graph.edges_of_kinds(edges, ["CONTAINS"], 150))


def _at(name: str, where: str, run: Callable[[DataFrame], DataFrame], limit: int = 200) -> None:
    sql = f"SELECT source_id, target_id, kind FROM edges WHERE {where} ORDER BY source_id, target_id, kind LIMIT {limit}"
    _register(name, _graph(sql))(lambda spark, sf: run(b.edges(spark, sf)))


_at("references", f"target_id = {PART_NODE} AND kind IN ('CALLS', 'REFERENCES', 'TESTS', 'IMPORTS')", lambda e: graph.references(e, PART_NODE, 200))
_at("call_hierarchy_in", f"target_id = {PART_NODE} AND kind = 'CALLS'", lambda e: graph.call_hierarchy(e, PART_NODE, "incoming", 200))
_at("call_hierarchy_out", f"source_id = {ORDER_NODE} AND kind = 'CALLS'", lambda e: graph.call_hierarchy(e, ORDER_NODE, "outgoing", 200))
_at("call_hierarchy_both", f"(source_id = {PART_NODE} OR target_id = {PART_NODE}) AND kind = 'CALLS'", lambda e: graph.call_hierarchy(e, PART_NODE, "both", 200))
_at("imports", f"source_id = {CUSTOMER_NODE} AND kind = 'IMPORTS'", lambda e: graph.imports(e, CUSTOMER_NODE, 200))
_at("dependents", f"target_id = {SUPPLIER_NODE} AND kind = 'IMPORTS'", lambda e: graph.dependents(e, SUPPLIER_NODE, 200))
_at("edges_touching", f"source_id = {CUSTOMER_NODE} OR target_id = {CUSTOMER_NODE}", lambda e: graph.edges_for_node(e, CUSTOMER_NODE, [], "both", 1000), 1000)

_BOTH_WAYS = ", b AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges)"


def _reach_sql(seeds: list[int], hops: int) -> str:
    rounds = [f"r0 AS (SELECT unnest([{', '.join(map(str, seeds))}]) AS id)"]
    rounds += [f"r{i} AS (SELECT id FROM r{i - 1} UNION SELECT y FROM b JOIN r{i - 1} ON x = id)" for i in range(1, hops + 1)]
    return f"{_BOTH_WAYS}, {', '.join(rounds)}"


def _seeds(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def _neighbourhood(name: str, seeds: list[int], hops: int) -> None:
    _register(f"{name}_nodes", _graph(_reach_sql(seeds, hops) + f" SELECT id, kind, name, path, start_line FROM nodes WHERE id IN (SELECT id FROM r{hops})"))(
        lambda spark, sf: graph.neighborhood(b.nodes(spark, sf), checkpoint(b.edges(spark, sf)), _seeds(spark, seeds), hops)[0].select(*NODE)
    )
    _register(
        f"{name}_edges",
        _graph(_reach_sql(seeds, hops) + f" SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM r{hops - 1}) OR target_id IN (SELECT id FROM r{hops - 1})"),
    )(lambda spark, sf: graph.neighborhood(b.nodes(spark, sf), checkpoint(b.edges(spark, sf)), _seeds(spark, seeds), hops)[1])


_neighbourhood("neighborhood_1", [ORDER_NODE], 1)
_neighbourhood("neighborhood_2", [ORDER_NODE], 2)
_neighbourhood("multi_seed", [ORDER_NODE, ORDER_NODE + 3, CUSTOMER_NODE, SUPPLIER_NODE, NATION_NODE, 5], 1)


@_register("neighborhood_0_nodes", _graph(f"SELECT id, kind, name, path, start_line FROM nodes WHERE id = {ORDER_NODE}"))
def neighborhood_0(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighborhood(b.nodes(spark, sf), b.edges(spark, sf), _seeds(spark, [ORDER_NODE]), 0)[0].select(*NODE)


@_register(
    "definition_at",
    f"""WITH {b.INTERVALS_SQL}, h AS (
        SELECT s.file_id, line, id, start_line, end_line, row_number() OVER (PARTITION BY s.file_id, line ORDER BY end_line - start_line, id DESC) AS k
        FROM spots AS s JOIN symbols AS y ON s.file_id = y.file_id AND line BETWEEN start_line AND end_line)
    SELECT file_id, line, id, start_line, end_line FROM h WHERE k = 1""",
)
def definition_at(spark: SparkSession, sf: str) -> DataFrame:
    return graph.enclosing(b.intervals(spark, sf), b.places(spark, sf)).drop("place_id")


@_register(
    "calls_in_symbol",
    f"""WITH {b.INTERVALS_SQL} SELECT id, s.file_id, count(*) AS calls, min(line) AS first_call FROM symbols AS s JOIN spots AS p
    ON s.file_id = p.file_id AND line BETWEEN start_line AND end_line GROUP BY ALL""",
)
def calls_in_symbol(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.calls_in_symbols(b.intervals(spark, sf), b.places(spark, sf))
    return found.groupBy("id", "file_id").agg(F.count(F.lit(1)).alias("calls"), F.min("line").alias("first_call"))


@_register(
    "first_wins_symbol",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS k FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM r WHERE k = 1""",
)
def first_wins_symbol(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    return build.first_by(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], order, ["l_suppkey", "l_linenumber"])


@_register(
    "last_wins_edge",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE k = 1""",
)
def last_wins_edge(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return build.last_by(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order, ["l_partkey", "l_suppkey"])


_NORMAL_SQL = "list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(string_split({}, '/'), lambda p: [p])), lambda k, p: CASE WHEN p[1] IN ('', '.') THEN k WHEN p[1] = '..' THEN k[1:greatest(len(k) - 1, 0)] ELSE list_append(k, p[1]) END)"
_HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    m AS (SELECT DISTINCT page_id, href, CASE page_id % 4 WHEN 0 THEN 'a/./b/../' || href WHEN 1 THEN '../x//' || href || '/..' WHEN 2 THEN href || '/' ELSE 'p/../../q/' || href END AS raw FROM h)"""


def _hrefs(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN concat('a/./b/../', href) WHEN 1 THEN concat('../x//', href, '/..') WHEN 2 THEN concat(href, '/') ELSE concat('p/../../q/', href) END")
    return links.withColumn("raw", raw)


@_register("extract_links", "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) AS h GROUP BY ALL")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@_register("normalize_path", f"WITH {_HREFS} SELECT page_id, raw, array_to_string({_NORMAL_SQL.format('raw')}, '/') AS path FROM m")
def normalize_path(spark: SparkSession, sf: str) -> DataFrame:
    return _hrefs(spark, sf).select("page_id", "raw", P.normalize(F.col("raw")).alias("path"))


@_register(
    "import_candidates",
    f"""WITH {_HREFS}, n AS (SELECT page_id, raw, array_to_string({_NORMAL_SQL.format("'src/' || raw")}, '/') AS base FROM m),
    c AS (SELECT page_id, raw, CASE WHEN regexp_matches(base, '[^/]+\\.[^/.]*$') THEN [base] ELSE [base || s FOR s IN
        ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.rs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/mod.rs']] END AS cs FROM n)
    SELECT page_id, raw, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS rank, unnest(cs) AS candidate FROM c""",
)
def import_candidates(spark: SparkSession, sf: str) -> DataFrame:
    bases = build.import_bases(F.lit("src/main.ts"), F.concat(F.lit("./"), F.col("raw")), [], None)
    return _hrefs(spark, sf).select("page_id", "raw", F.posexplode(build.import_candidates(bases)).alias("rank", "candidate"))


_ALIAS_CASES = ["@/upload", "@/", "~lib/a/b", "config", "config/x", "react", "@", "~lib"]


@_register(
    "alias_match",
    f"""WITH s AS (SELECT unnest({_ALIAS_CASES!r}) AS source), p AS (SELECT unnest(['@/*', '~lib/*', 'config']) AS pattern)
    SELECT pattern, source, CASE WHEN contains(pattern, '*') THEN substring(source, length(pattern)) ELSE '' END AS capture
    FROM s, p WHERE (contains(pattern, '*') AND starts_with(source, replace(pattern, '*', ''))) OR source = pattern""",
)
def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    patterns = F.array(*[F.lit(p) for p, _ in ALIASES])
    cases = spark.createDataFrame([(s,) for s in _ALIAS_CASES], "source string").withColumn("pattern", F.explode(patterns))
    return cases.withColumn("capture", P.match_alias(F.col("pattern"), F.col("source"))).where("capture is not null").select("pattern", "source", "capture")


_CALLEES = ["foo", "a.foo", "a.b.foo", "std::fs::read", "x.0", "42", "this.#y", "(f)", "a?.b", "Self::new", ""]


@_register(
    "callee_parts",
    f"""WITH c AS (SELECT unnest({_CALLEES!r}) AS callee), p AS (SELECT callee, list_filter(list_transform(regexp_split_to_array(callee, '[.:]'),
        lambda x: regexp_replace(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+', ''), '[^\\p{{L}}\\p{{N}}_]+$', '')), lambda x: x <> '') AS ps FROM c)
    SELECT callee, CASE WHEN NOT regexp_matches(ps[-1], '^[0-9]+$') THEN ps[-1] END AS name, CASE WHEN NOT regexp_matches(ps[-1], '^[0-9]+$') THEN ps[-2] END AS qualifier FROM p""",
)
def callee_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in _CALLEES], "callee string")
    return rows.select("callee", T.callee_parts(F.col("callee")).alias("p")).select("callee", "p.name", "p.qualifier")


_CHANGE = "CASE WHEN o.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN o.hash = f.hash THEN 'unchanged' ELSE 'modified' END"
_DIFF = f"d AS (SELECT coalesce(o.path, f.path) AS path, {_CHANGE} AS change FROM old AS o FULL JOIN fresh AS f ON o.path = f.path)"


@_register("status_diff", f"WITH {b.MANIFESTS_SQL}, {_DIFF} SELECT path, change FROM d")
def status_diff(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.status(*b.manifests(spark, sf))


@_register("changed_files", f"WITH {b.MANIFESTS_SQL}, {_DIFF} SELECT path FROM d WHERE change IN ('new', 'modified')")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.status(*b.manifests(spark, sf)).where("change in ('new', 'modified')").select("path")


@_register("remove_missing", f"WITH {b.MANIFESTS_SQL} SELECT path, hash FROM old WHERE path IN (SELECT path FROM fresh)")
def remove_missing(spark: SparkSession, sf: str) -> DataFrame:
    old, new = b.manifests(spark, sf)
    return maintain.remove_missing(old, new)


@_register("upsert_files", f"WITH {b.MANIFESTS_SQL} SELECT path, hash FROM fresh UNION ALL SELECT path, hash FROM old WHERE path NOT IN (SELECT path FROM fresh)")
def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    old, new = b.manifests(spark, sf)
    return maintain.upsert(old.withColumn("seq", F.lit(0)), new.withColumn("seq", F.lit(0)), ["path"]).select("path", "hash")


@_register(
    "clear_cascade",
    _graph(f""", gone AS (SELECT id FROM nodes WHERE file_id BETWEEN {b.CUSTOMER} AND {b.CUSTOMER + 20})
    SELECT source_id, target_id, kind FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) AND kind <> 'REFERENCES'"""),
)
def clear_cascade(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.range(b.CUSTOMER, b.CUSTOMER + 21).withColumnRenamed("id", "file_id")
    kept = maintain.clear_files(b.nodes(spark, sf), b.edges(spark, sf), None, wanted)[1]
    return maintain.clear_derived(kept.withColumn("is_derived", F.col("kind") == "REFERENCES")).drop("is_derived")


@_register(
    "integrity_report",
    _graph("""SELECT 'node_ids' AS check, (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1) AS a) AS problems
    UNION ALL SELECT 'edge_keys', (SELECT count(*) FROM (SELECT 1 FROM edges GROUP BY source_id, target_id, kind HAVING count(*) > 1) AS a)
    UNION ALL SELECT 'edge_sources', (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM nodes))
    UNION ALL SELECT 'edge_targets', (SELECT count(*) FROM edges WHERE target_id NOT IN (SELECT id FROM nodes))""").replace(" AS check,", ' AS "check",'),
)
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.integrity(b.nodes(spark, sf), b.edges(spark, sf), shares(spark, sf, "orders", "lineitem"))


@_register(
    "context_pack_prefix",
    _files(""", s AS (SELECT id, path, sum(coalesce(strlen(text), 0)) OVER (ORDER BY path, id) AS used FROM files)
    SELECT id, path, CAST(used AS BIGINT) AS used FROM s WHERE used <= 100000"""),
)
def context_pack_prefix(spark: SparkSession, sf: str) -> DataFrame:
    pieces = b.files(spark, sf).select("id", "path", "text")
    return ctx.budget_prefix(pieces, "text", ["path", "id"], 100_000).select("id", "path", "used")


@_register("trim_text", _files("SELECT id, CASE WHEN length(text) > 160 THEN left(text, 157) || '...' ELSE text END AS shown FROM files"))
def trim_text(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select("id", T.shorten(F.col("text"), 160).alias("shown"))


@_register(
    "sample_edges",
    _graph(""", c AS (SELECT * FROM edges WHERE kind = 'IMPORTS' ORDER BY source_id, target_id LIMIT 20)
    SELECT s.name || ' -' || c.kind || '-> ' || t.name AS edge FROM c JOIN nodes AS s ON s.id = source_id JOIN nodes AS t ON t.id = target_id"""),
)
def sample_edges(spark: SparkSession, sf: str) -> DataFrame:
    chosen = graph.edges_of_kinds(b.edges(spark, sf), ["IMPORTS"], 20)
    return ctx.edge_labels(b.nodes(spark, sf), chosen)


@_register("brief_counts", _graph("SELECT kind, count(*) AS n, count(DISTINCT source_id) AS sources FROM edges GROUP BY kind"))
def brief_counts(spark: SparkSession, sf: str) -> DataFrame:
    return b.edges(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


@_register(
    "hydrate_hits",
    _graph("SELECT id AS ref_id, path FROM nodes WHERE kind = 'File'"),
)
def hydrate_hits(spark: SparkSession, sf: str) -> DataFrame:
    nodes = b.nodes(spark, sf).where("kind = 'File'")
    hits = nodes.select(F.col("id").alias("ref_id"), "file_id", F.lit("").alias("path"))
    return search.hydrate(hits, nodes.select("id", "path")).select("ref_id", "path")


# queries over generated sources
QUERIES |= code.QUERIES
ORACLES |= code.ORACLES
