"""Column expressions on paths: languages, pruning, prefixes, normalisation, import candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, pruned directories, and what an import may leave out.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "rs": "rust", "md": "markdown", "mdx": "markdown",
    "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml",
}
PRUNED = [".git", ".codeloom", "node_modules", "dist", "build", "target"]
EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "rs"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx", "mod.rs"]


def extension(path: Column) -> Column:
    """The lower-cased extension of the base name; null without one."""
    found = F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
    return F.when(found != "", F.lower(found))


def language(ext: Column) -> Column:
    """The language of an extension; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def is_pruned(path: Column) -> Column:
    """Whether a component is a directory that is never indexed."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in PRUNED]))


def prefixes(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    upto = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normalize(path: Column) -> Column:
    """Without ``.`` and empty components; ``..`` drops the component before it, if any."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == "..", popped).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def file_candidates(base: Column) -> Column:
    """Paths that an import of ``base`` may mean, best first; a dotted base name is taken as it is."""
    has_extension = F.regexp_extract(base, r"[^/]+\.[^/.]*$", 0) != ""
    guesses = [F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS] + [F.concat(base, F.lit(f"/{i}")) for i in INDEX_FILES]
    return F.when(has_extension, F.array(base)).otherwise(F.array(*guesses))


def match_alias(pattern: Column, source: Column) -> Column:
    """What ``*`` of an alias pattern stands for in an import; empty for an equal one without ``*``."""
    before, after = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    starred = F.contains(pattern, F.lit("*"))
    fits = F.startswith(source, before) & F.endswith(source, after) & (F.length(source) >= F.length(before) + F.length(after))
    middle = F.substring(source, F.length(before) + 1, F.length(source) - F.length(before) - F.length(after))
    return F.when(starred & fits, middle).when(~starred & (pattern == source), F.lit(""))
