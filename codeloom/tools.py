"""The engine's queries as named tools with typed arguments, shared by JSON-RPC and HTTP."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from codeloom.engine import GRAPHS, Engine, Json, brief_context, brief_graph, fit_bytes

COMPACT_BYTES = 12_000
STATUS_SAMPLE = 20


@dataclass(frozen=True)
class Tool:
    """A query: what it does, its arguments, and its default limit (compact, normal)."""

    about: str
    run: Callable[[Engine, Json, Tools], Any]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    limits: tuple[int, int] | None = None


_TYPES = {"limit": "integer", "node_id": "integer", "line": "integer", "character": "integer", "offset": "integer", "hops": "integer", "max_tokens": "integer", "max_bytes": "integer", "full": "boolean", "regex": "boolean", "case_sensitive": "boolean", "line_numbers": "boolean", "brief": "boolean", "auto_index": "boolean"}
_COMMON = ("max_bytes", "auto_index")


class ToolError(ValueError):
    """The call cannot be answered as asked."""


def _at(engine: Engine, args: Json) -> Json:
    found = engine.at(args["path"], args["line"])
    if found is None:
        raise ToolError(f"no symbol at {args['path']}:{args['line']}")
    return found


def _read(engine: Engine, args: Json, tools: Tools) -> Json:
    limit = args.get("limit", 120 if tools.compact else None)
    found = engine.read(args["path"], args.get("offset"), limit, bool(args.get("line_numbers")))
    if found is None:
        raise ToolError(f"no such file: {args['path']}")
    return found


def _graph(name: str) -> Callable[[Engine, Json, Tools], Any]:
    def run(engine: Engine, args: Json, tools: Tools) -> Any:
        value = engine.graph(name, args["limit"])
        return brief_graph(value, args["limit"]) if args.get("brief", tools.compact) else value

    return run


def _context(engine: Engine, args: Json, tools: Tools) -> Any:
    tokens = args.get("max_tokens", 1000 if tools.compact else 12_000)
    value = engine.task_context(args["task"], tokens, args.get("hops", 1 if tools.compact else 2))
    return brief_context(value, tokens) if args.get("brief", tools.compact) else value


def _status(engine: Engine, args: Json, tools: Tools) -> Json:
    value = engine.status()
    if not args.get("brief", tools.compact):
        return value
    lists = {k: v for k, v in value.items() if isinstance(v, list)}
    return {**{k: v for k, v in value.items() if k not in lists}, **{f"{k}_count": len(v) for k, v in lists.items()}, **{k: v[:STATUS_SAMPLE] for k, v in lists.items()}}


TOOLS: dict[str, Tool] = {
    "index": Tool("Bring the index up to date", lambda e, a, t: asdict(e.index(bool(a.get("full")))), (), ("full",)),
    "status": Tool("Changes since the last index run", _status, (), ("brief",)),
    "search": Tool("Ranked full-text search", lambda e, a, t: {"hits": e.search(a["query"], a["limit"])}, ("query",), ("limit",), (20, 20)),
    "task_context": Tool("Files, symbols, graph, tests and source for a task", _context, ("task",), ("max_tokens", "hops", "brief")),
    "read_file": Tool("Lines of a file", _read, ("path",), ("offset", "limit", "line_numbers")),
    "grep": Tool("Lines that hold a text or match a pattern", lambda e, a, t: {"matches": e.grep(a["query"], a.get("glob"), bool(a.get("case_sensitive")), bool(a.get("regex")), a["limit"])}, ("query",), ("glob", "case_sensitive", "regex", "limit"), (20, 100)),
    "glob": Tool("Files by path pattern", lambda e, a, t: {"files": e.glob(a["pattern"], a["limit"])}, ("pattern",), ("limit",), (50, 200)),
    "workspace_symbols": Tool("Symbols by name", lambda e, a, t: {"symbols": e.symbols(a["query"], a["limit"])}, ("query",), ("limit",), (20, 100)),
    "document_symbols": Tool("Outline of a file", lambda e, a, t: {"symbols": e.document_symbols(a["path"])}, ("path",)),
    "definition": Tool("Definitions by name", lambda e, a, t: {"definitions": e.symbols(a["query"], a["limit"])}, ("query",), ("limit",), (20, 20)),
    "definition_at": Tool("The symbol around a position", lambda e, a, t: {"definition": _at(e, a), "character": a.get("character")}, ("path", "line"), ("character",)),
    "references": Tool("What refers to a node", lambda e, a, t: e.references(a["node_id"], a["limit"]), ("node_id",), ("limit",), (20, 200)),
    "references_at": Tool("What refers to the symbol at a position", lambda e, a, t: e.references(_at(e, a)["id"], a["limit"]), ("path", "line"), ("character", "limit"), (20, 200)),
    "call_hierarchy": Tool("Callers and callees of a node", lambda e, a, t: e.call_hierarchy(a["node_id"], a.get("direction", "both"), a["limit"]), ("node_id",), ("direction", "limit"), (20, 200)),
    "call_hierarchy_at": Tool("Callers and callees of the symbol at a position", lambda e, a, t: e.call_hierarchy(_at(e, a)["id"], a.get("direction", "both"), a["limit"]), ("path", "line"), ("character", "direction", "limit"), (20, 200)),
    "imports": Tool("What a node imports", lambda e, a, t: e.imports(a["node_id"], a["limit"]), ("node_id",), ("limit",), (20, 200)),
    "dependents": Tool("What imports a node", lambda e, a, t: e.dependents(a["node_id"], a["limit"]), ("node_id",), ("limit",), (20, 200)),
    "suggested_tests": Tool("Tests for a task", lambda e, a, t: {"tests": e.suggest_tests(a["task"], a["limit"])}, ("task",), ("limit",), (8, 8)),
    "neighborhood": Tool("The graph around a node", lambda e, a, t: e.neighborhood(a["node_id"], a.get("hops", 1)), ("node_id",), ("hops",)),
    "semantic_summaries": Tool("Nodes with a summary", lambda e, a, t: {"nodes": e.summaries(a["limit"])}, (), ("limit",), (20, 200)),
    **{name: Tool(f"{name.replace('_', ' ').capitalize()}", _graph(name), (), ("limit", "brief"), (20, 500)) for name in ("ast_graph", *GRAPHS)},
}
ALIASES = {"read": "read_file", "symbols": "workspace_symbols", "find_references": "references", "summaries": "semantic_summaries", "tests": "suggested_tests", "context": "task_context", "find_files": "glob"}


class Tools:
    """Calls tools on one engine; ``compact`` means smaller defaults and answers of bounded size."""

    def __init__(self, engine: Engine, compact: bool = False) -> None:
        self.engine, self.compact = engine, compact

    def listed(self) -> list[Json]:
        """Names and input schemas; aliases are listed too unless compact."""
        names = dict.fromkeys(TOOLS) if self.compact else dict.fromkeys([*TOOLS, *ALIASES])
        return [{"name": n, "description": TOOLS[ALIASES.get(n, n)].about, "inputSchema": self.schema(ALIASES.get(n, n))} for n in names]

    def schema(self, name: str) -> Json:
        tool = TOOLS[name]
        fields = {f: {"type": _TYPES.get(f, "string")} for f in (*tool.required, *tool.optional, *_COMMON)}
        if tool.limits:
            fields["limit"]["default"] = tool.limits[not self.compact]
        return {"type": "object", "properties": fields, "required": list(tool.required)}

    def call(self, name: str, args: Json | None = None) -> Any:
        """The answer of a tool; ToolError for unknown tools and bad arguments."""
        name, args = ALIASES.get(name, name), dict(args or {})
        tool = TOOLS.get(name)
        if tool is None:
            raise ToolError(f"unknown tool: {name}")
        for field in tool.required:
            if field not in args:
                raise ToolError(f"missing argument: {field}")
        for field, value in args.items():
            kind = {"integer": int, "boolean": bool, "string": str}[_TYPES.get(field, "string")]
            if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
                raise ToolError(f"{field} must be a {_TYPES.get(field, 'string')}")
        if tool.limits:
            args["limit"] = max(1, args.get("limit", tool.limits[not self.compact]))
        if name not in ("index", "status") and args.get("auto_index", not self.compact):
            self.engine.index()
        value = tool.run(self.engine, args, self)
        most = args.get("max_bytes", COMPACT_BYTES if self.compact else None)
        return fit_bytes(value, most) if most else value

    # resources

    def resources(self) -> list[Json]:
        """Static resources, and the files of the index."""
        static = ["status", "summaries", *("ast_graph", *GRAPHS)]
        files = self.engine.glob("**", 50 if self.compact else 200)
        return [{"uri": f"codeloom://{n}", "name": n} for n in static] + [{"uri": f"codeloom://files/{f['path']}", "name": f["path"]} for f in files]

    def resource(self, uri: str) -> str:
        """The text of a resource."""
        kind, _, rest = uri.removeprefix("codeloom://").partition("/")
        if kind == "files":
            found = self.engine.read(rest)
            if found is None:
                raise ToolError(f"no such file: {rest}")
            return found["content"]
        if kind == "nodes" and rest.lstrip("-").isdigit():
            return json.dumps(self.engine.neighborhood(int(rest), 1), ensure_ascii=False)
        limit = 20 if self.compact else 1000
        if kind == "status":
            return json.dumps(self.engine.status())
        if kind == "summaries":
            return json.dumps(self.engine.summaries(limit), ensure_ascii=False)
        if kind in TOOLS and kind.endswith("_graph"):
            return json.dumps(self.engine.graph(kind, limit), ensure_ascii=False)
        raise ToolError(f"no such resource: {uri}")
