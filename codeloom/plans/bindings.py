"""The driver's tables as files, graph, intervals and change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import shares, table

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = 1_000, 2_000, 10_000_000, 20_000_000, 30_000_000, 100_000_000


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown files with their text."""
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.lit("markdown").alias("language"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("bigint").alias("size"), "text")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and nations as directories, customers as files, suppliers, parts and orders as symbols."""

    def t(name: str) -> DataFrame:
        return table(spark, sf, name)

    columns = ["id", "file_id", "kind", "name", "qualified_name", "path", "start_line", "end_line", "summary"]

    def row(df: DataFrame, *values: str) -> DataFrame:
        types = ["bigint", "bigint", "string", "string", "string", "string", "bigint", "bigint", "string"]
        return df.selectExpr(*[f"CAST({v} AS {k}) AS {c}" for v, k, c in zip(values, types, columns, strict=True)])

    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat_ws("/", "r_name", "n_name", "c_name"))
    orders = t("orders").join(people.select("c_custkey", "file"), F.col("o_custkey") == F.col("c_custkey"))
    name = "concat('order_', CAST(o_orderkey AS string))"
    line = "datediff(o_orderdate, DATE'1990-01-01')"
    parts = [
        row(t("region"), f"{REGION} + r_regionkey", "NULL", "'Directory'", "r_name", "r_name", "r_name", "NULL", "NULL", "NULL"),
        row(places, f"{NATION} + n_nationkey", "NULL", "'Directory'", "n_name", "concat(r_name, '/', n_name)", "concat(r_name, '/', n_name)", "NULL", "NULL", "NULL"),
        row(people, f"{CUSTOMER} + c_custkey", f"{CUSTOMER} + c_custkey", "'File'", "c_name", "file", "file", "NULL", "NULL", "c_mktsegment"),
        row(t("supplier"), f"{SUPPLIER} + s_suppkey", "NULL", "'Endpoint'", "s_name", "concat('supplier::', s_name)", "concat('supplier/', s_name)", "1", "1", "NULL"),
        row(t("part"), f"{PART} + p_partkey", "NULL", "'Class'", "p_name", "concat(p_brand, '::', p_name)", "concat('part/', p_brand)", "p_size", "p_size + 10", "p_type"),
        row(orders, f"{ORDER} + o_orderkey", f"{CUSTOMER} + o_custkey", "IF(o_orderstatus = 'P', 'Test', 'Function')", name, f"concat(file, '::', {name})", "file", line, f"{line} + o_orderkey % 50", "o_orderpriority"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Containment, definitions, calls, tests, references and imports, once each, dealt by source."""

    def t(name: str) -> DataFrame:
        return table(spark, sf, name)

    def row(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
        return df.selectExpr(f"CAST({source} AS bigint) AS source_id", f"CAST({target} AS bigint) AS target_id", f"'{kind}' AS kind")

    orders, lines = t("orders"), t("lineitem")
    tasks = shares(spark, sf, "orders", "lineitem")
    with_order = lines.repartition(tasks, "l_orderkey").join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [
        row(t("nation"), f"{REGION} + n_regionkey", f"{NATION} + n_nationkey", "CONTAINS"),
        row(t("customer"), f"{NATION} + c_nationkey", f"{CUSTOMER} + c_custkey", "CONTAINS"),
        row(orders, f"{CUSTOMER} + o_custkey", f"{ORDER} + o_orderkey", "DEFINES"),
        row(lines, f"{ORDER} + l_orderkey", f"{PART} + l_partkey", "CALLS"),
        row(with_order.where("o_orderstatus = 'P'"), f"{ORDER} + l_orderkey", f"{PART} + l_partkey", "TESTS"),
        row(lines, f"{SUPPLIER} + l_suppkey", f"{PART} + l_partkey", "REFERENCES"),
        row(with_order, f"{CUSTOMER} + o_custkey", f"{SUPPLIER} + l_suppkey", "IMPORTS"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition(tasks, "source_id").distinct()


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as symbols, dealt by file: the days between order and last shipment, whichever way round."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    tasks = shares(spark, sf, "orders", "lineitem")
    last = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    both = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"))

    def day(c: Column) -> Column:
        return F.datediff(c, F.lit("1990-01-01").cast("date")).cast("bigint")

    return both.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("file_id"),
        day(F.least("o_orderdate", "shipped")).alias("start_line"),
        day(F.greatest("o_orderdate", "shipped")).alias("end_line"),
    ).repartition(tasks, "file_id")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as places: the day of shipment in the customer's file, once each, dealt by file."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    tasks = shares(spark, sf, "orders", "lineitem")
    both = lines.repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("bigint")
    return both.select(F.col("o_custkey").alias("file_id"), line.alias("line")).repartition(tasks, "file_id").distinct().withColumn("place_id", F.col("file_id") * 100_000 + F.col("line"))


def manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Users as paths before and after the middle of the feed: the last event of each half is the hash."""
    events = table(spark, sf, "events")
    half = F.pmod("event_id", F.lit(2))

    def last(df: DataFrame) -> DataFrame:
        best = F.max_by(F.concat_ws(":", "event_type", F.pmod("event_id", F.lit(5)).cast("string")), F.struct("ts", "event_id"))
        return df.groupBy(F.col("user_id").cast("string").alias("path")).agg(best.alias("hash"))

    return last(events.where(half == 0)), last(events.where(half == 1))


# DuckDB views of the same, as WITH clauses of the oracles.
FILES_SQL = """files AS (
    SELECT doc_id AS id, source || '/' || lang || '/d' || doc_id || '.md' AS path, 'markdown' AS language,
           sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"""

NODES_SQL = f"""places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (SELECT *, r_name || '/' || n_name || '/' || c_name AS file FROM customer JOIN places ON c_nationkey = n_nationkey),
o AS (SELECT *, 'order_' || o_orderkey AS name, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS line
      FROM orders JOIN people ON o_custkey = c_custkey),
nodes AS (
    SELECT CAST({REGION} + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS file_id, 'Directory' AS kind, r_name AS name,
           r_name AS qualified_name, r_name AS path, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line,
           CAST(NULL AS VARCHAR) AS summary FROM region
    UNION ALL SELECT {NATION} + n_nationkey, NULL, 'Directory', n_name, r_name || '/' || n_name, r_name || '/' || n_name, NULL, NULL, NULL FROM places
    UNION ALL SELECT {CUSTOMER} + c_custkey, {CUSTOMER} + c_custkey, 'File', c_name, file, file, NULL, NULL, c_mktsegment FROM people
    UNION ALL SELECT {SUPPLIER} + s_suppkey, NULL, 'Endpoint', s_name, 'supplier::' || s_name, 'supplier/' || s_name, 1, 1, NULL FROM supplier
    UNION ALL SELECT {PART} + p_partkey, NULL, 'Class', p_name, p_brand || '::' || p_name, 'part/' || p_brand, p_size, p_size + 10, p_type FROM part
    UNION ALL SELECT {ORDER} + o_orderkey, {CUSTOMER} + o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'Test' ELSE 'Function' END, name,
           file || '::' || name, file, line, line + o_orderkey % 50, o_orderpriority FROM o)"""

EDGES_SQL = f"""edges AS (
    SELECT DISTINCT CAST(source_id AS BIGINT) AS source_id, CAST(target_id AS BIGINT) AS target_id, kind FROM (
    SELECT {REGION} + n_regionkey AS source_id, {NATION} + n_nationkey AS target_id, 'CONTAINS' AS kind FROM nation
    UNION ALL SELECT {NATION} + c_nationkey, {CUSTOMER} + c_custkey, 'CONTAINS' FROM customer
    UNION ALL SELECT {CUSTOMER} + o_custkey, {ORDER} + o_orderkey, 'DEFINES' FROM orders
    UNION ALL SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'CALLS' FROM lineitem
    UNION ALL SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'TESTS' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
    UNION ALL SELECT {SUPPLIER} + l_suppkey, {PART} + l_partkey, 'REFERENCES' FROM lineitem
    UNION ALL SELECT {CUSTOMER} + o_custkey, {SUPPLIER} + l_suppkey, 'IMPORTS' FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS e)"""

INTERVALS_SQL = """shipped AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
symbols AS (
    SELECT o_orderkey AS id, o_custkey AS file_id,
           date_diff('day', DATE '1990-01-01', CAST(least(o_orderdate, shipped) AS DATE)) AS start_line,
           date_diff('day', DATE '1990-01-01', CAST(greatest(o_orderdate, shipped) AS DATE)) AS end_line
    FROM orders JOIN shipped ON l_orderkey = o_orderkey),
spots AS (
    SELECT DISTINCT o_custkey AS file_id, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MANIFESTS_SQL = """old AS (
    SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type || ':' || event_id % 5, (ts, event_id)) AS hash
    FROM events WHERE event_id % 2 = 0 GROUP BY 1),
fresh AS (
    SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type || ':' || event_id % 5, (ts, event_id)) AS hash
    FROM events WHERE event_id % 2 = 1 GROUP BY 1)"""
