"""Expressions on texts and paths, and the parser."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.operators import build, search
from codeloom.sources import files as src
from codeloom.sources.parse import blank, bindings, callee, import_of, parse, route_of, summary_above


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("\n\n", ["", ""]), ("a\n\nb", ["a", "", "b"])])
def test_lines(spark, text, want):
    assert value(spark, T.lines(F.lit(text))) == want


@pytest.mark.parametrize("most", range(1, 12))
def test_cut_bytes(spark, most):
    text = "ab\U0001f600cdé"
    want = text.encode()[:most].decode(errors="ignore")
    assert value(spark, T.cut_bytes(F.lit(text), most)) == want


def test_chunks_of_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(170)) + "\n"
    rows = build.file_chunks(spark.createDataFrame([(1, text), (2, ""), (3, "é" * 5000)], "id bigint, text string")).orderBy("file_id", "seq").collect()
    assert [(r.file_id, r.start_line, r.end_line) for r in rows] == [(1, 1, 80), (1, 81, 160), (1, 161, 170), (3, 1, 1)]
    assert rows[3].text == "é" * 3000


def test_preview_and_shorten(spark):
    long = "word " * 400
    shown = value(spark, T.preview(F.lit(long)))
    assert shown.endswith(T.PREVIEW_MARK) and len(shown.encode()) <= T.PREVIEW_BYTES + len(T.PREVIEW_MARK)
    assert value(spark, T.preview(F.lit("x" * 1262))) == "x" * 1262
    assert value(spark, T.shorten(F.lit("abcdef"), 5)) == "ab..." == T.shorten_text("abcdef", 5)


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("src/*.ts", "src/a/b.ts", True), ("*.ts", "a.tsx", False), ("**/x.ts", "x.ts", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("{a,b}.rs", "b.rs", True), ("a.b", "axb", False)],
)
def test_glob(spark, glob, path, hit):
    assert value(spark, F.lit(path).rlike(T.glob_regex(glob))) is hit


def test_regex_check():
    for bad in (r"a(?=b)", r"(a)\1", r"(?<!x)y"):
        with pytest.raises(ValueError):
            T.check_regex(bad)
    assert T.check_regex(r"a(?:b)\d") == r"a(?:b)\d"


@given(st.lists(st.sampled_from(["a", "b", "..", ".", "", "c.ts"]), max_size=7))
@settings(max_examples=25, deadline=None)
def test_normalize(spark, parts):
    kept = []
    for p in parts:
        if p == "..":
            kept = kept[:-1]
        elif p not in ("", "."):
            kept.append(p)
    assert value(spark, P.normalize(F.lit("/".join(parts)))) == "/".join(kept)


def test_aliases(spark):
    bases = build.import_bases(F.lit("src/app/main.ts"), F.lit("@/upload"), [("@/*", ["src/*"])], ".")
    assert value(spark, bases) == ["src/upload"]
    assert value(spark, build.import_bases(F.lit("src/app/main.ts"), F.lit("../lib/x"), [], None)) == ["src/lib/x"]
    assert value(spark, build.import_bases(F.lit("a.ts"), F.lit("lib/x"), [("@/*", ["src/*"])], "base")) == ["base/lib/x"]
    assert value(spark, P.file_candidates(F.lit("src/foo.service"))) == ["src/foo.service"]


def test_query_parts():
    assert search.query_parts("Hello snake_case héllo") == [["hello"], ["snake", "case"], ["hello"]]
    assert search.query_parts("  !! ") == []
    for bad in ("a/b", "a AND b", "NOT"):
        with pytest.raises(search.NotSearchable):
            search.query_parts(bad)


def test_phrases_and_prefixes(spark):
    rows = spark.createDataFrame([("node", 1, 1, 1, "a.ts", "x", "snake casework"), ("node", 2, 2, 2, "b.ts", "y", "case snake"), ("node", 3, 3, 3, "c.ts", "uploadAvatar", "z")], "kind string, ref_id bigint, file_id bigint, node_id bigint, path string, name string, text string")
    assert [r.ref_id for r in search.search(rows, "snake_case", 10).collect()] == [1]
    assert [r.ref_id for r in search.search(rows, "avatar", 10).collect()] == []
    assert {r.ref_id for r in search.search(rows, "node", 10).collect()} == {1, 2, 3}
    assert search.search(rows, "x", 10).first().ref_id == 1
    assert search.search(rows, "", 10).count() == 0


def test_like_search_takes_backslashes(spark):
    rows = spark.createDataFrame([("a\\b",), ("A\\B",), ("ab",)], "x string")
    assert rows.where(T.like_ignoring_ascii_case(F.col("x"), T.like_literal("a\\b"))).count() == 2


SERVICE = """import { upload } from './upload';
// Uploads the avatar image.
export class Service {
  saveAvatar(file) { return upload(file); }
}
export const load = (x) => upload(x);
"""


def test_symbols_calls_imports():
    f = parse("typescript", "src/service.ts", SERVICE)
    assert [(s.kind, s.name, s.start_line, s.end_line) for s in f.symbols] == [("Class", "Service", 3, 5), ("Method", "saveAvatar", 4, 4), ("Function", "load", 6, 6)]
    assert f.symbols[0].summary == "Uploads the avatar image."
    assert [(c.name, c.line) for c in f.calls] == [("upload", 4), ("upload", 6)]
    assert f.imports[0].source == "./upload" and f.imports[0].bindings == [{"imported": "upload", "local": "upload"}]


def test_routes():
    r = route_of("router.post('/avatar', saveAvatar);")
    assert (r.method, r.path, r.handler) == ("POST", "/avatar", "saveAvatar")
    assert route_of("map.get(key); app.post('/x', y)") is not None and route_of("map.get(key)") is None
    assert route_of("x.get(k); y.delete('/z', h)").path == "/z"


def test_namespace_import_and_call():
    f = parse("typescript", "a.ts", "import * as uploads from './u';\nfunction go() { uploads.upload(); }\n")
    assert f.imports[0].bindings == [{"imported": "*", "local": "uploads"}]
    assert (f.calls[0].qualifier, f.calls[0].name) == ("uploads", "upload")


def test_exported_string_is_no_import():
    assert parse("typescript", "a.ts", "export function f() { return 'x'; }").imports == []


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        ("import { a, b as c, type T }", [("a", "a"), ("b", "c"), ("T", "T")]),
        ("import React, { x }", [("x", "x")]),
        ("import React", [("React", "React")]),
        ("import type Foo", [("type Foo", "type Foo")]),
        ("export { a }", [("a", "a")]),
        ("export *", []),
    ],
)
def test_bindings(clause, want):
    assert [(x["imported"], x["local"]) for x in bindings(clause)] == want


def test_rust():
    source = '/// Makes.\npub struct Thing { a: i32 }\nimpl Thing {\n    pub fn new() -> Self { let s = "}"; helper(1) }\n}\nfn helper(x: i32) { println!("{}", x); }\nuse std::fs;\nmod parser;\n'
    f = parse("rust", "src/lib.rs", source)
    assert [(s.kind, s.name) for s in f.symbols] == [("Type", "Thing"), ("Method", "new"), ("Function", "helper")]
    assert [c.name for c in f.calls] == ["helper"] and [i.source for i in f.imports] == ["std::fs", "parser"]


def test_tests_by_name_and_path():
    assert parse("rust", "src/a.rs", "fn it_should_work() {}").symbols[0].kind == "Test"
    assert parse("typescript", "src/latest.ts", "function f() {}").symbols[0].kind == "Test"


def test_summary_stops_at_other_lines():
    lines = ["// far", "", "// one", "/// two", "", "fn x() {}"]
    assert summary_above(lines, 6) == "one two"
    assert summary_above(["/** doc", " * text", " */", "function f() {}"], 4) is None


@pytest.mark.parametrize("source", ["`a${b}c}`", "'it''s", "/* {", '"\\"{"', "a / b / c; {", "x = /[/}]{/;", "`${`${x}`}`{}"])
def test_blanking_keeps_length(source):
    for rust in (False, True):
        assert len(blank(source, rust)) == len(source)
        parse("rust" if rust else "typescript", "a.ts", source)


def test_callees():
    assert callee("a.b.foo") == ("foo", "b") and callee("std::fs::read") == ("read", "fs")
    assert callee("x.0") is None and callee("") is None and callee("this.#y") == ("y", "this")
    assert import_of("import './side'", "typescript").source == "./side"


def test_git_status():
    status = b" M src/a.ts\0?? new.ts\0 D gone.ts\0R  to.ts\0from.ts\0C  copy.ts\0kept.ts\0"
    assert src.parse_git_status(status) == (["copy.ts", "new.ts", "src/a.ts", "to.ts"], ["from.ts", "gone.ts"])


def test_binary_probe():
    assert src.is_binary(b"a\0b") and src.is_binary(b"\xff\xfe") and not src.is_binary("é".encode())
    assert not src.is_binary((b"a" * 8191 + "é".encode())[:8192])
