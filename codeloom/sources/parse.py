"""Facts of source files: symbols, calls, imports and routes of JavaScript, TypeScript and Rust.

No grammar library is used. Comments, strings, templates and regular expressions are blanked out
first, so that brackets match; declarations and calls are then found by shape. Imports, routes and
the comments above a symbol are read line by line. Broken sources yield what can be recognised.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SNIPPET_BYTES, SIGNATURE_BYTES, SUMMARY_CHARS = 4000, 240, 240
_NAME = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "new", "typeof", "await", "super"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "typeof", "new", "await", "fn", "match", "in", "of", "async", "else", "loop", "let", "mut", "pub", "impl", "where", "as", "yield", "throw", "case", "delete", "void"}
_ROUTE = re.compile(r"\.(get|post|put|patch|delete)\(")
_PATH_ARGUMENT = re.compile(r"[^\"']*(?:\"[^\"]*\"|'[^']*')\s*,\s*([^,)]*)")
_IMPORT, _USE = re.compile(r"import |export .* from "), re.compile(r"(?:use|mod) (.*)")
#: What stands between the characters that ``blank`` must look at, in scripts and in Rust.
_PLAIN = (re.compile(r"[^/\"'`{}]+"), re.compile(r"[^/\"'{}r]+"))
#: Routes are looked for in this order of verbs.
VERBS = ["get", "post", "put", "patch", "delete"]


@dataclass
class Symbol:
    kind: str
    name: str
    qualified_name: str
    start_line: int
    end_line: int
    signature: str
    summary: str | None
    snippet: str


@dataclass
class Call:
    name: str
    qualifier: str | None
    line: int


@dataclass
class Import:
    source: str
    line: int
    bindings: list[dict[str, str]]


@dataclass
class Route:
    method: str
    path: str
    handler: str | None
    line: int


@dataclass
class Facts:
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    routes: list[Route] = field(default_factory=list)


SCHEMA = (
    "path string, symbols array<struct<kind: string, name: string, qualified_name: string, start_line: bigint, end_line: bigint, signature: string, summary: string, snippet: string>>,"
    " calls array<struct<name: string, qualifier: string, line: bigint>>,"
    " imports array<struct<source: string, line: bigint, bindings: array<struct<imported: string, local: string>>>>,"
    " routes array<struct<method: string, path: string, handler: string, line: bigint>>"
)


def cut_bytes(text: str, most: int, mark: str = "...") -> str:
    """At most so many UTF-8 bytes and a mark, never part of a character."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore") + mark


def blank(source: str, rust: bool) -> str:
    """The source with comments and literals as spaces; code inside templates stays."""
    out = list(source)
    n, i = len(source), 0
    templates: list[int] = []  # depths of braces at which a template goes on
    depth, before, plain = 0, "", _PLAIN[rust]

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def end_of(quote: str, at: int) -> int:
        while at < n and source[at] != quote:
            if source[at] == "\\":
                at += 1
            elif source[at] == "\n" and quote != "`" and not rust:
                return at
            at += 1
        return at + 1

    def template(at: int) -> int:
        """From inside a template to its end or to code in it."""
        start = at
        while at < n:
            if source[at] == "\\":
                at += 2
            elif source[at] == "`":
                wipe(start, at)
                return at + 1
            elif source.startswith("${", at):
                wipe(start, at + 1)
                templates.append(depth)
                return at + 1
            else:
                at += 1
        wipe(start, at)
        return at

    while i < n:
        run = plain.match(source, i)
        if run:
            i, before = run.end(), run[0].rstrip()[-1:] or before
            continue
        c = source[i]
        two = source[i : i + 2]
        if two == "//":
            end = source.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif two == "/*":
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            wipe(i, end)
            i = end
        elif rust and c == "r" and (m := re.compile(r'r(#*)"').match(source, i)) and not (i and (source[i - 1].isalnum() or source[i - 1] == "_")):
            end = source.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
            wipe(i, end)
            i = end
        elif rust and c == "'":
            m = re.compile(r"'(?:\\.[^']*|[^'\\])'").match(source, i)
            if m:
                wipe(i + 1, m.end() - 1)
            i = m.end() if m else i + 1
        elif c == '"' or (c == "'" and not rust):
            end = end_of(c, i + 1)
            wipe(i + 1, end - 1)
            i, before = end, c
        elif c == "`" and not rust:
            i, before = template(i + 1), "`"
        elif c == "/" and not rust and (before in "" or before in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(?:return|typeof|case|in|of|do|else|void)\s*$", source[max(0, i - 12) : i])):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/").match(source, i)
            if m:
                wipe(i + 1, m.end() - 1)
            i, before = (m.end(), "/") if m else (i + 1, "/")
        else:
            if c == "{":
                depth += 1
            elif c == "}":
                if templates and templates[-1] + 1 == depth + 1 and depth == templates[-1]:
                    templates.pop()
                    out[i] = " "
                    i = template(i + 1)
                    continue
                depth -= 1
            if not c.isspace():
                before = c
            i += 1
    return "".join(out)


class _Code:
    """A blanked source with its brackets matched."""

    def __init__(self, source: str, rust: bool) -> None:
        self.source, self.rust, self.text = source, rust, blank(source, rust)
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.text):
            if m[0] in "({[":
                stack.append(m.start())
            else:
                while stack and self.text[stack[-1]] != {")": "(", "}": "{", "]": "["}[m[0]]:
                    stack.pop()
                if stack:
                    a = stack.pop()
                    self.close[a], self.open[m.start()] = m.start(), a

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def back(self, at: int) -> int:
        """The end of what stands before a place and the white space before it."""
        while at and self.text[at - 1].isspace():
            at -= 1
        return at

    def skip(self, at: int) -> int:
        """The next place that is no white space."""
        m = re.compile(r"\s*").match(self.text, at)
        return m.end()

    def body_end(self, at: int, stops: str = ";") -> int | None:
        """The end of the block that opens after a place, or of the statement if it has none."""
        i, n = at, len(self.text)
        while i < n:
            c = self.text[i]
            if c == "{":
                return self.close.get(i, n - 1) + 1
            if c in "([":
                i = self.close.get(i, n - 1)
            elif c in stops:
                return i + 1
            elif c in ")]}":
                return i
            i += 1
        return n

    def expression_end(self, at: int) -> int:
        """The end of an expression that starts at a place."""
        i, n = at, len(self.text)
        while i < n:
            c = self.text[i]
            if c in "([{":
                i = self.close.get(i, n - 1)
                following = self.skip(i + 1)
                if c == "{" and self.text[following : following + 1] not in (".", "(", "[", "=", "?", ":", "&", "|"):
                    return i + 1
            elif c in ";,)]}":
                return i
            elif c == "\n" and re.match(r"\s*(?:export|const|let|var|function|class|import|interface|type|enum|async)\b", self.text[i:]):
                return i
            i += 1
        return n


def callee(text: str) -> tuple[str, str | None] | None:
    """Name and qualifier of a callee: its last and second-last part between dots and colons."""
    parts = [p for p in (re.sub(r"^[^\w]+|[^\w]+$", "", q) for q in re.split(r"[.:]", text.strip())) if p]
    if not parts or re.fullmatch(r"[0-9]+", parts[-1]):
        return None
    return parts[-1], parts[-2] if len(parts) > 1 else None


def _callee_start(code: _Code, at: int) -> int:
    """Where the callee that ends before a place starts: names, dots, and brackets that close."""
    i = at
    while True:
        j = code.back(i)
        if j and (code.text[j - 1].isalnum() or code.text[j - 1] in "_$#"):
            while j and (code.text[j - 1].isalnum() or code.text[j - 1] in "_$#"):
                j -= 1
            i = j
        elif j and code.text[j - 1] in ")]" and j - 1 in code.open:
            i = code.open[j - 1]
            k = code.back(i)
            if k and (code.text[k - 1].isalnum() or code.text[k - 1] in "_$)]"):
                continue
        elif j and code.text[j - 1] in "'\"`":
            k = code.source.rfind(code.text[j - 1], 0, j - 1)
            i = k if k >= 0 else j - 1
        else:
            return i
        k = code.back(i)
        if code.text[max(0, k - 2) : k] in ("?.", "::"):
            i = k - 2
        elif k and code.text[k - 1] == ".":
            i = k - 1
        else:
            return i


def _calls(code: _Code, names: set[int]) -> list[Call]:
    found = []
    for m in re.finditer(r"\(", code.text):
        at = code.back(m.start())
        if at and code.text[at - 1] == ">" and (g := re.search(r"(?:::)?<[^()<>;{}]*>$", code.text[max(0, at - 120) : at])):
            at -= len(g[0])
        if not at or not (code.text[at - 1].isalnum() or code.text[at - 1] in "_$)]"):
            continue
        word = re.search(rf"{_NAME}$", code.text[max(0, at - 200) : at])
        first = at - len(word[0]) if word else at
        if word and (first in names or (word[0] in _NOT_CALLS and code.text[first - 1 : first] not in (".", ":"))):
            continue
        if not word and code.text[at - 1] in ")]" and not re.match(r"\s*\(", code.text[at:]):
            continue
        start = _callee_start(code, at)
        head = code.text[max(0, start - 20) : code.back(start)]
        if re.search(r"\b(?:new|function|fn)$", head[-12:]) or (code.rust and code.text[at - 1 : at] == "!") or (not word and re.search(r"\b(?:if|for|while|switch|catch)$", head[-8:])):
            continue
        parts = callee(code.source[start:at])
        if parts:
            found.append((start, -code.close.get(m.start(), m.start()), Call(*parts, code.line(start))))
    return [c for *_, c in sorted(found, key=lambda f: f[:2])]


def summary_above(lines: list[str], start_line: int) -> str | None:
    """The line comments right above a line, joined; blank lines may follow the last of them."""
    said: list[str] = []
    for line in reversed(lines[: start_line - 1]):
        line = line.strip()
        if not line and not said:
            continue
        mark = next((m for m in ("///", "//", "*") if line.startswith(m)), None)
        told = line[len(mark) :].strip().lstrip("/").strip() if mark else ""
        if not told or told == "*/":
            break
        said.append(told)
    return " ".join(reversed(said))[:SUMMARY_CHARS] or None


def is_test(name: str, path: str) -> bool:
    """Names and paths that speak of tests; any path that holds the word counts."""
    n, p = name.lower(), path.lower()
    return n.startswith("test_") or n.endswith("_test") or "should" in n or "test" in p or ".spec." in p


def _script_symbols(code: _Code) -> Iterator[tuple[int, int, str, str, int]]:
    """start, end, kind, name and place of the name of JavaScript and TypeScript symbols."""
    text = code.text
    for m in re.finditer(rf"\b(?:async\s+)?function\s*\*?\s*({_NAME})", text):
        before = text[max(0, m.start() - 60) : m.start()]
        if re.search(r"(?:^|[;{}]|\b(?:export|default|declare)|\n)\s*$", before) and not re.search(r"[=(,:?&|+!]\s*$", before):
            end = code.body_end(m.end())
            if text[end - 1 : end] == "}":
                yield m.start(), end, "Function", m[1], m.start(1)
    for m in re.finditer(rf"\b(?:abstract\s+)?class\s+({_NAME})", text):
        if not re.search(r"[=(,:?]\s*$", text[max(0, m.start() - 60) : m.start()]):
            yield m.start(), code.body_end(m.end()), "Class", m[1], m.start(1)
    for m in re.finditer(rf"\b(?:interface\s+({_NAME})|(?:const\s+)?enum\s+({_NAME})|type\s+({_NAME})\s*(?:<[^=;]*>)?\s*=)", text):
        k = next(k for k in (1, 2, 3) if m[k])
        end = code.expression_end(code.skip(m.end())) if k == 3 else code.body_end(m.end())
        yield m.start(), end + (text[end : end + 1] == ";" and k == 3), "Type", m[k], m.start(k)
    for m in re.finditer(rf"(?:\b(?:const|let|var)\s+|,\s*)({_NAME})\s*(?::[^=;\n]+?(?:=>[^=;\n]+?)?)?=(?![=>])\s*", text):
        value = m.end()
        v = re.compile(r"(?:async\b\s*)?").match(text, value).end()
        if re.compile(r"function\b").match(text, v):
            yield m.start(1), code.body_end(v), "Function", m[1], m.start(1)
            continue
        generic = re.compile(r"<[^()=]*>\s*").match(text, v)
        v = generic.end() if generic else v
        single = re.compile(rf"{_NAME}\s*=>").match(text, v)
        arrow = single.end() if single else None
        if text[v : v + 1] == "(" and v in code.close:
            after = re.compile(r"\s*(?::[^=;]*?)?=>").match(text, code.close[v] + 1)
            arrow = after.end() if after else None
        if arrow is not None:
            if m[0].startswith(",") and not re.search(r"\b(?:const|let|var)\b[^;{}]*$", text[max(0, m.start() - 2000) : m.start()]):
                continue
            yield m.start(1), code.expression_end(code.skip(arrow)), "Function", m[1], m.start(1)
    modifiers = r"(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|get|set)\s+)*(?:\*\s*)?"
    for m in re.finditer(rf"(?<=[{{}};,\n])[ \t]*((?:{modifiers})(#?{_NAME})\s*\??\s*(?:<[^()]*>\s*)?)\(", text):
        name, opening = m[2], m.end() - 1
        if name in _NOT_METHODS or opening not in code.close:
            continue
        after = code.skip(code.close[opening] + 1)
        if text[after : after + 1] == ":":
            found = re.compile(r":[^{};=]*(?:\{[^{};]*\}[^{};=]*(?=\{))?").match(text, after)
            after = code.skip(found.end())
        start = m.start(1)
        if text[after : after + 1] == "{":
            yield start, code.close.get(after, len(text) - 1) + 1, "Method", name, m.start(2)
        elif text[after : after + 1] in (";", "", "}") or "\n" in text[code.close[opening] : after]:
            inside = _innermost(code, m.start(1))
            head = text[max(0, inside - 200) : inside] if inside is not None else ""
            if re.search(r"\babstract\b", m[1]) or re.search(rf"\binterface\s+{_NAME}[^{{}};]*$", head) or re.search(rf"\btype\s+{_NAME}[^{{}};]*=\s*$", head):
                yield start, after, "Method", name, m.start(2)


def _innermost(code: _Code, at: int) -> int | None:
    """The brace that a place lies in."""
    best = None
    for a, b in code.close.items():
        if a < at <= b and code.text[a] == "{" and (best is None or a > best):
            best = a
    return best


def _rust_symbols(code: _Code) -> Iterator[tuple[int, int, str, str, int]]:
    text = code.text
    impls = [(a, code.close.get(a, len(text))) for m in re.finditer(r"\bimpl\b[^{};]*(\{)", text) for a in (m.start(1),)]
    lead = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
    for m in re.finditer(rf"{lead}(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*\bfn\s+({_NAME})", text):
        end = code.body_end(m.end())
        if text[end - 1 : end] == "}":
            inside = any(a < m.start() < b for a, b in impls)
            yield m.start(), end, "Method" if inside else "Function", m[1], m.start(1)
    for m in re.finditer(rf"{lead}(?:unsafe\s+)?\b(?:struct|enum|trait|type)\s+({_NAME})", text):
        end = code.body_end(m.end())
        tail = re.compile(r"\s*;").match(text, end)
        yield m.start(), tail.end() if tail and text[end - 1] == ")" else end, "Type", m[1], m.start(1)


def _quoted(text: str) -> str | None:
    m = re.search(r"\"([^\"]*)\"|'([^']*)'", text)
    first = re.search(r"[\"']", text)
    return (m[1] if m[1] is not None else m[2]) if m and first and m.start() == first.start() else None


def _clean(name: str) -> str:
    return re.sub(r"^[^\w]+|[^\w]+$", "", name.strip())


def bindings(clause: str) -> list[dict[str, str]]:
    """What an import clause binds: named items, else a namespace, else a default."""
    if "{" in clause and "}" in clause:
        out = []
        for item in clause[clause.find("{") + 1 : clause.rfind("}")].split(","):
            words = re.sub(r"^(?:type )+", "", item.strip()).split()
            if words:
                local = words[2] if len(words) == 3 and words[1] == "as" else words[0]
                out.append({"imported": _clean(words[0]), "local": _clean(local)})
        return out
    if not clause.startswith("import "):
        return []
    rest = re.sub(r"^(?:import )+", "", clause)
    if rest.startswith("* as "):
        local = _clean(rest[5:])
        return [{"imported": "*", "local": local}] if local else []
    default = rest.split(",")[0].strip()
    if not default or default.startswith("*"):
        return []
    return [{"imported": _clean(default), "local": _clean(default)}]


def import_of(line: str, language: str) -> Import | None:
    """The import on a trimmed line."""
    if language == "rust":
        m = _USE.match(line)
        words = m[1].rstrip(";").split() if m else []
        return Import(words[0], 0, []) if words else None
    if not _IMPORT.match(line):
        return None
    before, found, after = line.partition(" from ")
    source = _quoted(after if found else line)
    return Import(source, 0, bindings(before)) if source is not None else None


def route_of(line: str) -> Route | None:
    """The route on a trimmed line: the first verb in order that occurs; it needs a quoted path."""
    at = {}
    for m in _ROUTE.finditer(line):
        at.setdefault(m[1], m.end())
    verb = next((v for v in VERBS if v in at), None)
    if verb is None:
        return None
    args = line[at[verb] :]
    path = _quoted(args)
    if path is None:
        return None
    m = _PATH_ARGUMENT.match(args)
    handler = callee(m[1]) if m else None
    return Route(verb.upper(), path, handler[0] if handler else None, 0)


def parse(language: str | None, path: str, source: str) -> Facts:
    """All facts of one file; none for languages that are not parsed."""
    facts = Facts()
    if language not in ("javascript", "typescript", "rust"):
        return facts
    code = _Code(source, language == "rust")
    lines = source.split("\n")
    found = sorted(set((_rust_symbols if code.rust else _script_symbols)(code)), key=lambda s: (s[0], -s[1]))
    for start, end, kind, name, _ in found:
        snippet = source[start:end]
        first = snippet.split("\n", 1)[0].strip()
        line = code.line(start)
        facts.symbols.append(
            Symbol(
                "Test" if is_test(name, path) else kind, name, f"{path}::{name}", line, code.line(max(start, end - 1)),
                cut_bytes(first, SIGNATURE_BYTES), summary_above(lines, line), cut_bytes(snippet, SNIPPET_BYTES),
            )
        )
    facts.calls = _calls(code, {s[4] for s in found})
    for n, line in enumerate(lines, 1):
        own = import_of(line.strip(), language)
        if own:
            own.line = n
            facts.imports.append(own)
        route = None if code.rust else route_of(line.strip())
        if route:
            route.line = n
            facts.routes.append(route)
    return facts


def parse_files(files: DataFrame) -> DataFrame:
    """path, language, text -> path and the facts as arrays of structs."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            rows = [parse(lang, path, text or "") for lang, path, text in zip(batch["language"], batch["path"], batch["text"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], **{k: [[vars(x) for x in getattr(r, k)] for r in rows] for k in ("symbols", "calls", "imports", "routes")}})

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)
