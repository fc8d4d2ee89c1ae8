"""File sources: local trees, tables of files, path aliases, and git's list of changes."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P

PROBE_BYTES = 8192


def safe_path(root: str | Path, relative: str) -> Path | None:
    """A path inside the root; None if it is absolute, climbs out or leads out by a link."""
    if os.path.isabs(relative) or ".." in Path(relative).parts:
        return None
    base = Path(root).resolve()
    full = (base / relative).resolve()
    return full if full.is_relative_to(base) else None


def is_binary(head: bytes) -> bool:
    """NUL bytes or invalid UTF-8 in the first bytes; a character cut at their end is fine."""
    if b"\0" in head:
        return True
    try:
        head.decode()
    except UnicodeDecodeError as error:
        return not (len(head) >= PROBE_BYTES and error.start >= len(head) - 3 and "unexpected end" in error.reason)
    return False


def list_paths(root: str | Path) -> list[str]:
    """Relative paths of a tree's files, sorted: hidden ones too, without ignored and pruned ones."""
    base = Path(root)
    asked = ["git", "-C", str(base), "ls-files", "-z", "--cached", "--others", "--exclude-standard"]
    listed = subprocess.run(asked, capture_output=True, check=False) if (base / ".git").exists() else None
    if listed is not None and listed.returncode == 0:
        found = {p for p in listed.stdout.decode(errors="replace").split("\0") if p}
    else:
        found = set()
        for folder, dirs, names in os.walk(base):
            dirs[:] = [d for d in dirs if d not in P.PRUNED]
            found |= {os.path.relpath(os.path.join(folder, n), base).replace(os.sep, "/") for n in names}
    regular = (p for p in found if not set(p.split("/")) & set(P.PRUNED))
    return sorted(p for p in regular if (base / p).is_file() and not (base / p).is_symlink())


_SCHEMA = "path string, abs_path string, modified_at bigint, content binary"


def scan(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """A local tree as files: FILES columns with ``text``; binary files are left out.

    The tree belongs to the driver's machine, so the driver reads it. Corpora on shared storage come
    in through ``from_table``.
    """
    base = Path(root).resolve()
    rows = []
    for p in list_paths(base) if paths is None else paths:
        full = safe_path(base, p)
        if full is None or not full.is_file() or set(p.split("/")) & set(P.PRUNED):
            continue
        with full.open("rb") as f:
            head = f.read(PROBE_BYTES)
            if not is_binary(head):
                rows.append((p, str(full), int(full.stat().st_mtime), bytearray(head + f.read())))
    return describe(spark.createDataFrame(rows, _SCHEMA))


def changes(root: str | Path, known: Mapping[str, tuple[int, int, str]], since: int) -> dict[str, list[str]]:
    """new, modified, deleted and unchanged paths of a local tree against path -> size, modified_at, hash.

    A file of the same size and time is unchanged without being read, unless it was last modified at
    ``since`` or later, when the index was made: its time can't tell a later change apart. Others are
    compared by hash. Binary files are left out.
    """
    base = Path(root).resolve()
    out: dict[str, list[str]] = {"new": [], "modified": [], "deleted": [], "unchanged": []}
    for p in list_paths(base):
        full = base / p
        about = full.stat()
        was = known.get(p)
        if was is not None and was[:2] == (about.st_size, int(about.st_mtime)) and was[1] < since:
            out["unchanged"].append(p)
            continue
        raw = full.read_bytes()
        if is_binary(raw[:PROBE_BYTES]) or is_binary(raw):
            continue
        change = "new" if was is None else "unchanged" if was[2] == hashlib.sha256(raw).hexdigest() else "modified"
        out[change].append(p)
    present = {p for own in out.values() for p in own}
    out["deleted"] = sorted(set(known) - present)
    return out


def describe(raw: DataFrame) -> DataFrame:
    """path, abs_path, modified_at, content -> FILES columns with ``text``; invalid UTF-8 is binary and left out."""
    ext = P.extension(F.col("path"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.where(~P.is_pruned(F.col("path"))).select(
        F.xxhash64("path").alias("id"), "path", "abs_path", ext.alias("extension"), P.language(ext).alias("language"),
        F.sha2("content", 256).alias("hash"), F.length("content").cast("bigint").alias("size"), "modified_at", F.lit(False).alias("is_binary"), text.alias("text"),
    ).where("text is not null and not contains(text, chr(0))")


def from_table(files: DataFrame) -> DataFrame:
    """A table of files (path, content as text or binary, modified_at) as FILES columns with ``text``."""
    return describe(files.select("path", F.col("path").alias("abs_path"), F.col("modified_at").cast("bigint").alias("modified_at"), F.col("content").cast("binary").alias("content")))


def load_aliases(root: str | Path) -> tuple[list[tuple[str, list[str]]], str | None]:
    """Path aliases, sorted by pattern, and base URL of a tsconfig.json; nothing if it is no strict JSON."""
    try:
        options = json.loads((Path(root) / "tsconfig.json").read_text())["compilerOptions"]
    except (OSError, ValueError, KeyError, TypeError):
        return [], None
    if not isinstance(options, dict):
        return [], None
    raw = options.get("paths")
    aliases = [(k, [t for t in v if isinstance(t, str)]) for k, v in sorted(raw.items()) if isinstance(v, list)] if isinstance(raw, dict) else []
    base = options.get("baseUrl")
    return aliases, base if isinstance(base, str) else None


def parse_git_status(status: bytes) -> tuple[list[str], list[str]]:
    """Changed and deleted paths of ``git status --porcelain=v1 -z``.

    A renamed file's old path is deleted; a copied file's source stays.
    """
    changed, deleted = set(), set()
    entries = iter(status.decode(errors="replace").split("\0"))
    for entry in entries:
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        if "R" in code or "C" in code:
            old = next(entries, "")
            changed.add(path)
            if "R" in code and old:
                deleted.add(old)
        elif "D" in code:
            deleted.add(path)
        else:
            changed.add(path)
    return sorted(changed), sorted(deleted)


def dirty_paths(root: str | Path) -> list[str]:
    """Changed files that git has not committed; none outside a repository."""
    if not (Path(root) / ".git").exists():
        return []
    run = subprocess.run(["git", "-C", str(root), "status", "--porcelain=v1", "-z", "-uall"], capture_output=True, check=False)
    return parse_git_status(run.stdout)[0] if run.returncode == 0 else []


def test_command(root: str | Path) -> str | None:
    """How the tree's tests are run, by its lock and manifest files."""
    markers = {"pnpm-lock.yaml": "pnpm test", "yarn.lock": "yarn test", "package.json": "npm test", "Cargo.toml": "cargo test"}
    return next((command for marker, command in markers.items() if (Path(root) / marker).exists()), None)
