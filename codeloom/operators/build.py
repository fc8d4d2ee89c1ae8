"""Graph construction: chunks, directories, first- and last-wins bindings, import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import cut_bytes, lines

CHUNK_LINES, CHUNK_BYTES = 80, 6000


def file_chunks(files: DataFrame) -> DataFrame:
    """file_id, seq, start_line, end_line, text: groups of 80 lines, each cut to 6000 bytes."""
    own = lines(F.col("text"))
    count = F.ceil(F.size(own) / CHUNK_LINES).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    split = files.select(F.col("id").alias("file_id"), own.alias("lines"), F.explode(numbers).alias("seq"))
    first = F.col("seq") * CHUNK_LINES
    text = F.array_join(F.slice("lines", first + 1, F.lit(CHUNK_LINES)), "\n")
    last = F.least(first + CHUNK_LINES, F.size("lines"))
    return split.select("file_id", F.col("seq").cast("bigint").alias("seq"), (first + 1).cast("bigint").alias("start_line"), last.cast("bigint").alias("end_line"), cut_bytes(text, CHUNK_BYTES).alias("text"))


def directory_chain(files: DataFrame) -> DataFrame:
    """path, parent, name of every directory above a file."""
    dirs = files.select(F.explode(P.prefixes(F.col("path"))).alias("path")).distinct()
    return dirs.select("path", P.parent(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"))


def first_by(rows: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Of each key the row that comes first; ``order`` must decide all ties that matter."""
    best = F.min_by(F.struct(*take), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def last_by(rows: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Of each key the row that comes last: an upsert."""
    best = F.max_by(F.struct(*take), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def import_bases(source_path: Column, imported: Column, aliases: list[tuple[str, list[str]]], base_url: str | None) -> Column:
    """Normalised paths without extension that an import may start from, best first.

    Relative imports join the importer's directory. Others try every matching alias in order, then
    ``base_url`` if no alias matched.
    """
    relative = P.normalize(F.concat_ws("/", F.nullif(P.parent(source_path), F.lit("")), imported))
    found = F.array().cast("array<string>")
    for pattern, targets in aliases:
        star = P.match_alias(F.lit(pattern), imported)
        own = F.array(*[P.normalize(F.concat_ws("/", F.lit(base_url or ""), F.replace(F.lit(t), F.lit("*"), star))) for t in targets]) if targets else found
        found = F.concat(found, F.when(star.isNotNull(), own).otherwise(F.array().cast("array<string>")))
    if base_url is not None:
        found = F.when(F.size(found) > 0, found).otherwise(F.array(P.normalize(F.concat_ws("/", F.lit(base_url), imported))))
    return F.when(F.startswith(imported, F.lit(".")), F.array(relative)).otherwise(found)


def import_candidates(bases: Column) -> Column:
    """All candidate paths of some bases, best first."""
    return F.flatten(F.transform(bases, P.file_candidates))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]], base_url: str | None) -> DataFrame:
    """imports (source_path, imported, ...) with ``target_path``: the first candidate that is a file."""
    keyed = imports.withColumn("__import", F.xxhash64("source_path", "imported"))
    distinct = keyed.select("__import", "source_path", "imported").distinct()
    tried = distinct.select("__import", F.posexplode(import_candidates(import_bases(F.col("source_path"), F.col("imported"), aliases, base_url))).alias("rank", "path"))
    hits = tried.join(files.select("path"), "path").groupBy("__import").agg(F.min_by("path", "rank").alias("target_path"))
    return keyed.join(hits, "__import").drop("__import")
