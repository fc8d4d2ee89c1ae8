"""Ranked full-text search, its LIKE fallback, and searches over files and lines.

A row of the text index has kind, path, name and text, all of which are searched. A query is an OR of
prefixes; a part with ``_`` inside is a phrase whose last term is a prefix. Ranks are BM25 with
frequencies and lengths over all columns. Rows are scored where they lie; only counts and the top
rows travel.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import ascii_lower, check_regex, fold_terms, glob_regex, like_ignoring_ascii_case, like_literal, lines, preview, tokens
from codeloom.schemas import INDEXED_KINDS
from codeloom.session import checkpoint

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Terms of a snippet.
SNIPPET_TERMS = 16


class NotSearchable(ValueError):
    """The query is no valid text-index expression, so the LIKE search answers it."""


def query_parts(query: str) -> list[list[str]]:
    """The phrases of a query, OR-ed; the last term of each is a prefix.

    Raises NotSearchable for what the index's grammar rejects: a ``/`` or a bare upper-case operator.
    """
    raw = [p for p in re.split(r"[^\w/]+", query) if p]
    if any("/" in p or p in ("AND", "OR", "NOT") for p in raw):
        raise NotSearchable(query)
    return [terms for terms in map(fold_terms, raw) if terms]


def index_rows(files: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind, ref_id, file_id, node_id, path, name, text: files, nodes of the indexed kinds, file chunks."""
    none = F.lit(None).cast("bigint")
    of_files = files.select(F.lit("file").alias("kind"), F.col("id").alias("ref_id"), F.col("id").alias("file_id"), none.alias("node_id"), "path", F.col("path").alias("name"), F.coalesce("language", F.lit("")).alias("text"))
    told = F.coalesce("summary", "qualified_name")
    of_nodes = nodes.where(F.col("kind").isin(INDEXED_KINDS)).select(F.lit("node").alias("kind"), F.col("id").alias("ref_id"), "file_id", F.col("id").alias("node_id"), F.coalesce("path", F.lit("")).alias("path"), "name", told.alias("text"))
    of_chunks = chunks.where("kind = 'file'").select(F.lit("chunk").alias("kind"), F.col("id").alias("ref_id"), "file_id", "node_id", F.lit("").alias("path"), F.lit("file").alias("name"), "text")
    return of_files.unionByName(of_nodes).unionByName(of_chunks)


def with_terms(rows: DataFrame) -> DataFrame:
    """Index rows with ``terms``, an array for each column, in the index's order of columns."""
    return rows.withColumn("terms", F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("kind", "path", "name", "text")]))


def postings(rows: DataFrame) -> DataFrame:
    """term, ref kind and id, column, occurrences: the inverted index as a table."""
    by_column = rows.select("kind", "ref_id", F.posexplode(F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("kind", "path", "name", "text")])).alias("col", "own"))
    return by_column.select("kind", "ref_id", "col", F.explode("own").alias("term")).groupBy("term", "kind", "ref_id", "col").agg(F.count(F.lit(1)).alias("tf"))


def _frequency(phrase: list[str]) -> Column:
    """How often a phrase stands in a row: over its columns, never across two."""

    def starts(own: Column) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter(own, lambda t: F.startswith(t, F.lit(phrase[0]))))

        def fits(i: Column) -> Column:
            whole = F.lit(True)
            for k, term in enumerate(phrase):
                at = F.try_element_at(own, i + F.lit(k))
                whole = whole & F.coalesce(F.startswith(at, F.lit(term)) if k == len(phrase) - 1 else at == term, F.lit(False))
            return whole

        places = F.when(F.size(own) >= len(phrase), F.sequence(F.lit(1), F.size(own) - (len(phrase) - 1))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, fits))

    return F.aggregate("terms", F.lit(0), lambda n, own: n + starts(own))


def search(rows: DataFrame, query: str, limit: int, rounded: int | None = None) -> DataFrame:
    """The best index rows with ``score``: exact path or name first, then names and paths that hold the query.

    An empty query finds nothing. Ties go by kind and ref_id.
    """
    parts = query_parts(query)
    if not parts:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    unique = [list(p) for p in dict.fromkeys(map(tuple, parts))]
    counted = with_terms(rows).withColumns({f"tf{i}": _frequency(p) for i, p in enumerate(unique)})
    counted = counted.withColumn("len", F.aggregate("terms", F.lit(0), lambda n, own: n + F.size(own)))
    # texts are tokenised once; what is read again has numbers and names only
    counted = checkpoint(counted.select("kind", "ref_id", "path", "name", "len", *[f"tf{i}" for i in range(len(unique))]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(unique))]).first()
    average = (stats["len"] or 0) / max(stats["n"], 1)
    score = F.lit(0.0)
    for p in parts:
        i = unique.index(p)
        df = stats[f"df{i}"]
        idf = max(math.log((stats["n"] - df + 0.5) / (df + 0.5)), LEAST_IDF)
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / max(average, 1e-9)))
    hit = F.lit(False)
    for i in range(len(unique)):
        hit = hit | (F.col(f"tf{i}") > 0)
    like = like_literal(query)
    near = like_ignoring_ascii_case(F.col("path"), like) | like_ignoring_ascii_case(F.col("name"), like)
    score = score if rounded is None else F.round(score, rounded)
    place = F.when((F.col("path") == query) | (F.col("name") == query), -1000.0).when(near, -100.0).otherwise(-F.col("score"))
    best = counted.where(hit).withColumn("score", score).withColumn("__place", place).orderBy("__place", "kind", "ref_id").limit(limit)
    # ``limit`` rows at most
    found = rows.join(F.broadcast(best.select("kind", "ref_id", "score", "__place")), ["kind", "ref_id"])
    return found.orderBy("__place", "kind", "ref_id").select(*rows.columns, "score")


def snippet(text: Column, parts: list[list[str]]) -> Column:
    """About sixteen words around the first match, matches in brackets."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    firsts = F.array(*[F.lit(p[0]) for p in parts]) if parts else F.array().cast("array<string>")

    def hit(word: Column) -> Column:
        return F.exists(firsts, lambda p: F.exists(tokens(word), lambda t: F.startswith(t, p)))

    marks = F.transform(words, hit)
    first = F.greatest(F.array_position(marks, True), F.lit(1)).cast("int")
    begin = F.greatest(F.least(first - 3, F.size(words) - SNIPPET_TERMS + 1), F.lit(1))
    shown = F.transform(F.slice(words, begin, F.lit(SNIPPET_TERMS)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    body = F.array_join(shown, " ")
    left = F.when(begin > 1, F.lit(" ... ")).otherwise(F.lit(""))
    right = F.when(begin + SNIPPET_TERMS <= F.size(words), F.lit(" ... ")).otherwise(F.lit(""))
    return F.concat(left, body, right)


def search_like(files: DataFrame, nodes: DataFrame, chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """kind, ref_id, file_id, node_id, path, name, snippet, score from three branches, each limited."""
    like = like_literal(query)

    def has(c: Column) -> Column:
        return F.coalesce(like_ignoring_ascii_case(c, like), F.lit(False))

    none, blank = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    path, name = F.col("path"), F.col("name")
    file_score = F.when(path == query, 100.0).when(has(path), 50.0).otherwise(1.0)
    of_files = files.where(has(path) | has(F.col("language"))).select(F.lit("file").alias("kind"), F.col("id").alias("ref_id"), F.col("id").alias("file_id"), none.alias("node_id"), "path", path.alias("name"), F.col("language").alias("snippet"), file_score.alias("score"))
    node_score = F.when(name == query, 100.0).when(has(F.col("qualified_name")), 60.0).otherwise(10.0)
    of_nodes = nodes.where(has(name) | has(F.col("qualified_name")) | has(F.col("summary")) | has(path)).select(F.lit("node").alias("kind"), F.col("id").alias("ref_id"), "file_id", F.col("id").alias("node_id"), "path", "name", F.col("summary").alias("snippet"), node_score.alias("score"))
    stored = preview(F.col("text"))
    of_chunks = chunks.where(has(stored) | has(F.col("summary"))).select(F.lit("chunk").alias("kind"), F.col("id").alias("ref_id"), "file_id", "node_id", blank.alias("path"), F.col("kind").alias("name"), F.left(stored, F.lit(240)).alias("snippet"), F.lit(5.0).alias("score"))
    first = of_files.orderBy(F.desc("score"), "path", "ref_id").limit(limit)
    second = of_nodes.orderBy(F.desc("score"), "name", "ref_id").limit(limit)
    third = of_chunks.orderBy("ref_id").limit(limit)
    branches = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1))).unionByName(third.withColumn("branch", F.lit(2)))
    by = F.when(F.col("branch") == 0, path).when(F.col("branch") == 1, name).otherwise("")
    return branches.orderBy(F.desc("score"), "branch", by, "ref_id").limit(limit).drop("branch")


def hydrate(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with a blank path get their file's."""
    own = files.select(F.col("id").alias("file_id"), F.col("path").alias("__path"))
    return hits.join(own, "file_id", "left").withColumn("path", F.coalesce(F.nullif("path", F.lit("")), "__path")).drop("__path").select(*hits.columns)


def glob_files(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    """The first files by path that a glob matches."""
    return files.where(F.col("path").rlike(glob_regex(pattern))).orderBy("path", "id").limit(limit)


def grep(sources: DataFrame, query: str, glob: str | None, case_sensitive: bool, regex: bool, limit: int) -> DataFrame:
    """path, line, text of the first lines, by path and number, that hold a query."""
    rows = sources.where(F.col("path").rlike(glob_regex(glob))) if glob else sources
    each = rows.select("path", F.posexplode(lines(F.col("text"))).alias("n", "text"))
    if regex:
        hit = F.col("text").rlike(("" if case_sensitive else "(?i)") + check_regex(query))
    elif case_sensitive:
        hit = F.contains(F.col("text"), F.lit(query))
    else:
        hit = F.contains(ascii_lower(F.col("text")), ascii_lower(F.lit(query)))
    return each.where(hit).select("path", (F.col("n") + 1).cast("bigint").alias("line"), "text").orderBy("path", "line").limit(limit)


def read_range(sources: DataFrame, path: str, offset: int | None, limit: int | None, line_numbers: bool) -> DataFrame:
    """path, start_line, end_line, total_lines, content of part of a file; past its end the content is empty."""
    own = lines(F.col("text"))
    total = F.size(own)
    start = max(offset or 1, 1)
    end = F.least(F.lit(start + max(limit, 1) - 1), total) if limit is not None else total
    shown = F.slice(own, F.lit(start), F.greatest(end - start + 1, F.lit(0)))
    if line_numbers:
        # numbers are padded, never cut
        number = F.transform(shown, lambda x, i: F.concat(F.lpad((i + start).cast("string"), F.greatest(F.lit(6), F.length((i + start).cast("string"))), " "), F.lit("\t"), x))
        shown = number
    return sources.where(F.col("path") == path).select("path", F.lit(start).cast("bigint").alias("start_line"), F.greatest(end, F.lit(0)).cast("bigint").alias("end_line"), total.cast("bigint").alias("total_lines"), F.array_join(shown, "\n").alias("content"))


def suggest_tests(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Of ranked hits, those whose path and name speak of tests."""
    both = F.lower(F.concat(F.coalesce("path", F.lit("")), F.coalesce("name", F.lit(""))))
    return hits.where(F.contains(both, F.lit("test")) | F.contains(both, F.lit("spec"))).limit(limit)
