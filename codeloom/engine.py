"""Indexing and queries over a store: what the command line, HTTP and JSON-RPC offer."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import shorten_text
from codeloom.operators import code_graph, graph, maintain, search
from codeloom.operators import context as ctx
from codeloom.operators.store import Store
from codeloom.sources import files as src
from codeloom.sources.parse import parse_files

Json = dict[str, Any]
CONTEXT_HITS, CONTEXT_FILES, CONTEXT_SYMBOLS, CONTEXT_TESTS = 30, 8, 12, 8
FILE_SYMBOLS, FILE_CHUNKS = 20, 3
GRAPHS = {"dependency_graph": ["IMPORTS"], "call_graph": ["CALLS"], "product_flow_graph": ["REFERENCES", "CALLS"], "test_graph": ["TESTS"]}
LEADING_KINDS = {"product_flow_graph": "Endpoint", "test_graph": "Test"}


@dataclass
class Report:
    """What an index run did."""

    scanned: int
    indexed: int
    skipped_unchanged: int
    deleted: int


def _rows(df: DataFrame) -> list[Json]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _size(value: Any) -> int:
    return len(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode())


class Engine:
    """A source tree, or a table of files, and its index."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None) -> None:
        self.spark, self.root = spark, str(Path(root).resolve())
        self.store = Store(spark, store or f"file://{self.root}/.codeloom/store")
        self._cached: tuple[int, dict[str, DataFrame]] | None = None
        self._known: tuple[int | None, dict[str, tuple[int, int, str]]] | None = None

    # writing

    def _manifest(self) -> dict[str, tuple[int, int, str]]:
        """path -> size, modified_at, hash of the current version; a local tree's files, which the driver lists anyway."""
        version = self.store.version()
        if self._known is None or self._known[0] != version:
            rows = self.store.read("files").select("path", "size", "modified_at", "hash").collect() if version is not None else []
            self._known = (version, {r["path"]: (r["size"], r["modified_at"], r["hash"]) for r in rows})
        return self._known[1]

    def _local_changes(self) -> dict[str, list[str]]:
        """Changes of the tree since the last run, by size and time first, then by hash."""
        return src.changes(self.root, self._manifest(), self.store.made_at(self.store.version()) - 1)

    def index(self, full: bool = False, corpus: DataFrame | None = None) -> Report:
        """Bring the index up to date; files of equal hash are never parsed again, full or not.

        ``corpus`` (path, content, modified_at) takes the place of the local tree. Of a tree only
        changed files are read, unless ``full``.
        """
        if corpus is None and not full and self.store.version() is not None:
            found = self._local_changes()
            read = found["new"] + found["modified"]
            report = Report(len(read) + len(found["unchanged"]), len(read), len(found["unchanged"]), len(found["deleted"]))
            if not read and not found["deleted"]:
                return report
            fresh = src.scan(self.spark, self.root, read).persist()
            gone = self.spark.createDataFrame([(p,) for p in [*found["modified"], *found["deleted"]]], "path string")
            return self._update(report, fresh, gone)
        current = (src.scan(self.spark, self.root) if corpus is None else src.from_table(corpus)).persist()
        try:
            return self._index(current)
        finally:
            current.unpersist()

    def _index(self, current: DataFrame) -> Report:
        scanned = current.count()
        known = self.store.version() is not None
        old = self.store.read("files") if known else current.limit(0)
        changes = maintain.status(old.select("path", "hash"), current.select("path", "hash"))
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        changed, gone = counts.get("new", 0) + counts.get("modified", 0), counts.get("deleted", 0)
        report = Report(scanned, changed, counts.get("unchanged", 0), gone)
        if known and not changed and not gone:
            return report
        if known:
            fresh = current.join(changes.where("change in ('new', 'modified')").select("path"), "path", "left_semi")
            return self._update(report, fresh, changes.where("change in ('modified', 'deleted')").select("path"))
        facts = parse_files(current).persist()
        self._write(current, facts, code_graph.chunks_of(current, facts))
        facts.unpersist()
        return report

    def _update(self, report: Report, fresh: DataFrame, gone: DataFrame) -> Report:
        """A version with the rows of ``fresh`` files in place of those at the paths ``gone``.

        Files, facts and chunks of other files are taken over; nodes and edges depend on all files.
        """
        new_facts = parse_files(fresh).persist()
        old = self.store.read("files")
        files = old.join(gone, "path", "left_anti").select(*fresh.columns).unionByName(fresh).persist()
        facts = self.store.read("facts").join(gone, "path", "left_anti").unionByName(new_facts).persist()
        cleared = old.join(gone, "path", "left_semi").select(F.col("id").alias("file_id"))
        kept = self.store.read("chunks")
        chunks = kept.join(cleared, "file_id", "left_anti").select(*kept.columns).unionByName(code_graph.chunks_of(fresh, new_facts))
        self._write(files, facts, chunks)
        for df in (files, facts, new_facts, fresh):
            df.unpersist()
        return report

    def _write(self, files: DataFrame, facts: DataFrame, chunks: DataFrame) -> None:
        aliases, base = src.load_aliases(self.root)
        raw = code_graph.raw_edges(files, facts)
        derived = code_graph.derived_edges(files, facts, aliases, base)
        self.store.write(
            {
                "files": files,
                "facts": facts,
                "nodes": code_graph.nodes_of_files(files, facts, Path(self.root).name),
                "edges": code_graph.all_edges(raw, derived),
                "chunks": chunks,
            }
        )

    def status(self) -> Json:
        """Changes since the last index run; only files of another size or time are read."""
        if self.store.version() is None:
            return {"mode": "empty_index", "needs_index": True, "new": [], "modified": [], "deleted": [], "changed": []}
        found = self._local_changes()
        changed = sorted(found["new"] + found["modified"])
        return {"mode": "manifest", "new": sorted(found["new"]), "modified": sorted(found["modified"]), "deleted": found["deleted"], "changed": changed, "needs_index": bool(changed or found["deleted"])}

    def doctor(self) -> Json:
        """Integrity and size of the store."""
        checks = {r["check"]: r["problems"] for r in maintain.integrity(self.table("nodes"), self.table("edges")).collect()}
        return {"integrity": "ok" if not any(checks.values()) else "damaged", "checks": checks, "indexed_files": self.table("files").count(), "bytes": self.store.size()}

    # reading

    def table(self, name: str) -> DataFrame:
        """A table of the current version, cached while that version lasts."""
        version = self.store.version() or 0
        if self._cached is None or self._cached[0] != version:
            for df in self._cached[1].values() if self._cached else ():
                df.unpersist()
            self._cached = (version, {})
        if name not in self._cached[1]:
            self._cached[1][name] = self.store.read(name).persist()
        return self._cached[1][name]

    def index_rows(self) -> DataFrame:
        return search.index_rows(self.table("files"), self.table("nodes"), self.table("chunks"))

    def search(self, query: str, limit: int = 20) -> list[Json]:
        """Ranked hits; what the text index cannot parse is searched by LIKE."""
        try:
            parts = search.query_parts(query)
            found = search.search(self.index_rows(), query, limit)
            hits = found.withColumn("snippet", search.snippet(F.col("text"), parts)).drop("text")
        except search.NotSearchable:
            hits = search.search_like(self.table("files"), self.table("nodes"), self.table("chunks"), query, limit)
        ranked = hits.withColumn("__n", F.monotonically_increasing_id())
        return [{k: v for k, v in r.items() if k != "__n"} for r in sorted(_rows(search.hydrate(ranked, self.table("files"))), key=lambda r: r["__n"])]

    def read(self, path: str, offset: int | None = None, limit: int | None = None, line_numbers: bool = False) -> Json | None:
        """Lines of a file: indexed ones from the store, others from the tree if they lie inside it."""
        own = self.table("files").where(F.col("path") == path) if self.store.version() else None
        found = _rows(search.read_range(own, path, offset, limit, line_numbers)) if own is not None else []
        if found:
            about = own.select("language", "size", "hash").first()
            out = found[0] | {"indexed": True} | about.asDict()
        else:
            full = src.safe_path(self.root, path)
            if full is None or not full.is_file():
                return None
            loose = self.spark.createDataFrame([(path, full.read_text(errors="replace"))], "path string, text string")
            out = _rows(search.read_range(loose, path, offset, limit, line_numbers))[0] | {"indexed": False}
        if limit is not None and out["end_line"] < out["total_lines"]:
            out |= {"truncated": True, "next_offset": max(offset or 1, 1) + max(limit, 1)}
        return out

    def glob(self, pattern: str, limit: int = 200) -> list[Json]:
        return _rows(search.glob_files(self.table("files"), pattern, limit).select("path", "language", "size"))

    def grep(self, query: str, glob: str | None = None, case_sensitive: bool = False, regex: bool = False, limit: int = 100) -> list[Json]:
        return _rows(search.grep(self.table("files"), query, glob, case_sensitive, regex, limit))

    def symbols(self, query: str, limit: int = 100) -> list[Json]:
        return _rows(graph.symbols_matching(self.table("nodes"), query, limit=limit).drop("rank"))

    def document_symbols(self, path: str) -> list[Json]:
        return _rows(graph.document_symbols(self.table("nodes"), path).orderBy("position"))

    def at(self, path: str, line: int) -> Json | None:
        """The tightest symbol around a line."""
        own = self.table("nodes").where((F.col("path") == path) & F.col("kind").isin("Function", "Method", "Class", "Type", "Test", "Endpoint"))
        around = own.where((F.col("start_line") <= line) & (F.col("end_line") >= line))
        found = _rows(around.orderBy(F.expr("end_line - start_line"), F.desc("id")).limit(1))
        return found[0] if found else None

    def _subgraph(self, edges: DataFrame) -> Json:
        return {"nodes": _rows(graph.nodes_of(self.table("nodes"), edges).orderBy("path", "start_line", "id")), "edges": _rows(edges.orderBy(*graph.EDGE_ORDER))}

    def references(self, node_id: int, limit: int = 200) -> Json:
        return self._subgraph(graph.references(self.table("edges"), node_id, limit))

    def call_hierarchy(self, node_id: int, direction: str = "both", limit: int = 200) -> Json:
        return self._subgraph(graph.call_hierarchy(self.table("edges"), node_id, direction, limit))

    def imports(self, node_id: int, limit: int = 200) -> Json:
        return self._subgraph(graph.imports(self.table("edges"), node_id, limit))

    def dependents(self, node_id: int, limit: int = 200) -> Json:
        return self._subgraph(graph.dependents(self.table("edges"), node_id, limit))

    def neighborhood(self, node_id: int, hops: int = 1) -> Json:
        seeds = self.spark.createDataFrame([(node_id,)], "id bigint")
        nodes, edges = graph.neighborhood(self.table("nodes"), self.table("edges"), seeds, hops)
        return {"nodes": _rows(nodes.orderBy("depth", "id")), "edges": _rows(edges.orderBy(*graph.EDGE_ORDER))}

    def graph(self, name: str, limit: int = 500) -> Json:
        """ast_graph, dependency_graph, call_graph, product_flow_graph or test_graph."""
        nodes, edges = self.table("nodes"), self.table("edges")
        if name == "ast_graph":
            parts = [self._subgraph(graph.edges_of_kinds(edges, [k], limit)) for k in ("DEFINES", "CONTAINS")]
            return {"nodes": parts[0]["nodes"] + parts[1]["nodes"], "edges": parts[0]["edges"] + parts[1]["edges"]}
        out = self._subgraph(graph.edges_of_kinds(edges, GRAPHS[name], limit))
        if name in LEADING_KINDS:
            out |= {"leading": _rows(graph.nodes_by_kinds(nodes, [LEADING_KINDS[name]], limit))}
        return out

    def summaries(self, limit: int = 200) -> list[Json]:
        return _rows(graph.semantic_summaries(self.table("nodes"), limit))

    def suggest_tests(self, task: str, limit: int = CONTEXT_TESTS) -> list[Json]:
        """Test-like hits for a task, with the command that runs them."""
        command = src.test_command(self.root)
        about = [h for h in self.search(f"test {task}", 20) if any(w in f"{h['path'] or ''}{h['name'] or ''}".lower() for w in ("test", "spec"))]
        return [h | {"reason": "name or path speaks of tests", "command": command} for h in about[:limit]]

    # task context

    def task_context(self, task: str, max_tokens: int = 12_000, hops: int = 2, dirty: bool = True) -> Json:
        """Files, symbols, graph, tests and source for a task, within a budget."""
        hits = self.search(task, CONTEXT_HITS)
        files: dict[int, Json] = {}
        for path in src.dirty_paths(self.root) if dirty else []:
            row = self.table("files").where(F.col("path") == path).select("id").first()
            if row:
                files.setdefault(row["id"], {"kind": "dirty_file", "ref_id": row["id"], "file_id": row["id"], "node_id": None, "path": path, "name": path, "snippet": "uncommitted change", "score": 120.0})
        for h in hits:
            if h["file_id"] is not None:
                files.setdefault(h["file_id"], h)
        chosen = dict(list(files.items())[:CONTEXT_FILES])
        symbols = [h for h in hits if h["node_id"] is not None][:CONTEXT_SYMBOLS]
        out = {
            "query": task, "relevant_files": list(chosen.values()), "relevant_symbols": symbols, "subgraph": self._around(hits, hops),
            "suggested_tests": self.suggest_tests(task), "context_pack": self.context_pack(list(chosen), max(max_tokens // 2, 400)),
        }
        return fit_budget(out, max_tokens)

    def _around(self, hits: list[Json], hops: int) -> Json:
        seeds: list[int] = []
        nodes = self.table("nodes")
        wanted = hits[: graph.MAX_SEEDS]
        ids = [h["file_id"] for h in wanted if h["node_id"] is None and h["file_id"] is not None]
        of_files = {r["file_id"]: r["id"] for r in nodes.where(F.col("kind").isin("File") & F.col("file_id").isin(ids)).select("file_id", "id").collect()} if ids else {}
        for h in wanted:
            seed = h["node_id"] if h["node_id"] is not None else of_files.get(h["file_id"])
            if seed is not None and seed not in seeds:
                seeds.append(seed)
        if not seeds:
            return {"nodes": [], "edges": []}
        start = self.spark.createDataFrame([(s,) for s in seeds], "id bigint")
        found, edges = graph.neighborhood(nodes, self.table("edges"), start, hops)
        # more than the budget can ever show is cut before it reaches the driver
        return {"nodes": _rows(found.orderBy("depth", "id").limit(400)), "edges": _rows(edges.orderBy(*graph.EDGE_ORDER).limit(400))}

    def context_pack(self, file_ids: list[int], tokens: int) -> str:
        """Source of files in order, up to the first piece that does not fit."""
        budget, out = max(4 * tokens, 2000), ""
        if not file_ids:
            return out
        files = {r["id"]: r for r in self.table("files").where(F.col("id").isin(file_ids)).select("id", "path", "language").collect()}
        top = graph.top_symbols(self.table("nodes").where(F.col("file_id").isin(file_ids)), FILE_SYMBOLS)
        symbols: dict[int, list[Any]] = {}
        for r in top.orderBy("file_id", "position").collect():
            symbols.setdefault(r["file_id"], []).append(r)
        chunks: dict[int, list[Any]] = {}
        parts = self.table("chunks").where((F.col("kind") == "file") & F.col("file_id").isin(file_ids) & (F.col("seq") < FILE_CHUNKS))
        for r in parts.orderBy("file_id", "start_line").collect():
            chunks.setdefault(r["file_id"], []).append(r)
        for file_id in file_ids:
            if file_id not in files:
                continue
            head = f"\n## {files[file_id]['path']} ({files[file_id]['language'] or 'text'})\n"
            listed = "".join(f"- {s['kind']} {s['name']} [{s['start_line']}-{s['end_line']}]\n" for s in symbols.get(file_id, []))
            for piece in (head, listed):
                if len((out + piece).encode()) > budget:
                    return out.strip()
                out += piece
            for c in chunks.get(file_id, []):
                piece = f"\nLines {c['start_line']}-{c['end_line']}:\n{c['text']}\n"
                if len((out + piece).encode()) > budget:
                    return out
                out += piece
        return out.strip()


#: Tokens for each item, least and most items of a budgeted answer.
_LIMITS = {"relevant_files": (250, 2, 8), "relevant_symbols": (200, 3, 12), "suggested_tests": (500, 1, 8), "nodes": (120, 6, 80), "edges": (160, 4, 80)}
_SHRINK_FLOORS = {"edges": 2, "nodes": 4, "relevant_symbols": 2, "relevant_files": 1, "suggested_tests": 1}
_KEPT_METADATA = ("source", "imported", "callee", "handler", "route", "method")


def _compact_edge(edge: Json) -> Json:
    about = json.loads(edge.get("metadata") or "{}")
    kept = {k: shorten_text(v, 160) if isinstance(v, str) else v for k, v in about.items() if k in _KEPT_METADATA}
    return {k: edge[k] for k in ("source_id", "target_id", "kind")} | {"metadata": kept}


def _compact_node(node: Json) -> Json:
    out = {k: node[k] for k in ("id", "kind", "name", "path", "start_line", "end_line", "summary")}
    return {k: shorten_text(v, 160) if isinstance(v, str) else v for k, v in out.items()}


def _cut_graph(out: Json, nodes: int, edges: int) -> None:
    """Cut the edges, then keep the nodes that they name, or the first ones if there are no edges."""
    g = out["subgraph"]
    g["edges"] = g["edges"][:edges]
    ends = {e[k] for e in g["edges"] for k in ("source_id", "target_id")}
    g["nodes"] = [n for n in g["nodes"] if not ends or n["id"] in ends][:nodes]


def fit_budget(answer: Json, max_tokens: int) -> Json:
    """Shrink a task context until its JSON fits: edges, nodes, symbols, files, tests, then the source."""
    tokens = max(max_tokens, 200)
    room = max(4 * tokens, 2500)
    limits = {k: ctx.scaled_limit(tokens, *v) for k, v in _LIMITS.items()}
    out = dict(answer)
    for k in ("relevant_files", "relevant_symbols", "suggested_tests"):
        out[k] = [{f: shorten_text(v, 240) if isinstance(v, str) else v for f, v in h.items()} for h in answer[k][: limits[k]]]
    out["subgraph"] = {"nodes": [_compact_node(n) for n in answer["subgraph"]["nodes"]], "edges": [_compact_edge(e) for e in answer["subgraph"]["edges"]]}
    _cut_graph(out, limits["nodes"], limits["edges"])
    out["context_pack"] = shorten_text(answer["context_pack"], max(room // 2, 800))
    for _ in range(10):
        if _size(out) <= room:
            break
        for k, floor in _SHRINK_FLOORS.items():
            holder = out["subgraph"] if k in ("edges", "nodes") else out
            if len(holder[k]) > floor:
                holder[k] = holder[k][: max(floor, len(holder[k]) // 2)]
        _cut_graph(out, len(out["subgraph"]["nodes"]), len(out["subgraph"]["edges"]))
        if len(out["context_pack"]) > 400:
            out["context_pack"] = shorten_text(out["context_pack"], len(out["context_pack"]) * 3 // 4)
    return out


def brief_graph(value: Json, limit: int) -> Json:
    """Counts, some edges by name and some paths of a graph."""
    names = {n["id"]: n["name"] or n["path"] or str(n["id"]) for n in value["nodes"]}
    shown = [f"{names.get(e['source_id'], e['source_id'])} -{e['kind']}-> {names.get(e['target_id'], e['target_id'])}" for e in value["edges"][: min(limit, 20)]]
    paths = list(dict.fromkeys(n["path"] for n in value["nodes"] if n["path"]))[:10]
    return {"node_count": len(value["nodes"]), "edge_count": len(value["edges"]), "edges": shown, "paths": paths, "truncated": len(value["edges"]) > len(shown)}


def brief_context(value: Json, max_tokens: int) -> Json:
    """A task context in a few lines: files, symbols, where to read on, tests and sample edges."""
    files = [h["path"] for h in value["relevant_files"][:3]]
    symbols = value["relevant_symbols"][:4]
    by_id = {n["id"]: n for n in value["subgraph"]["nodes"]}
    reads = [{"path": n["path"], "offset": max(1, (n["start_line"] or 1) - 20), "limit": 80} for s in symbols if (n := by_id.get(s["node_id"])) and n["path"]]
    reads += [{"path": p, "offset": 1, "limit": 120} for p in files if p not in {r["path"] for r in reads}]
    most = max(600, min(2400, 2 * max_tokens))
    return {
        "query": value["query"], "files": files, "symbols": [{"name": s["name"], "path": s["path"]} for s in symbols], "read": reads[:4],
        "tests": [h["path"] for h in value["suggested_tests"][:2]], "edges": brief_graph(value["subgraph"], 3)["edges"][:3], "context": shorten_text(value["context_pack"], most),
    }


def fit_bytes(value: Any, most: int) -> Any:
    """Halve long lists and strings until an answer's JSON fits; an error object if it never does."""
    for _ in range(8):
        if _size(value) <= most:
            return value
        value = _halve(value)
    return value if _size(value) <= most else {"error": "the answer is too large", "max_bytes": most}


def _halve(value: Any) -> Any:
    if isinstance(value, list):
        return [_halve(v) for v in (value[: len(value) // 2] if len(value) > 4 else value)]
    if isinstance(value, dict):
        return {k: _halve(v) for k, v in value.items()}
    if isinstance(value, str) and len(value.encode()) > 1200:
        return shorten_text(value, len(value) // 2)
    return value
