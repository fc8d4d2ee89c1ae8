"""The engine, its tools and its transports on small trees."""

from __future__ import annotations

import io
import json
import subprocess
import threading
import urllib.request

import pytest

from codeloom.engine import Engine, brief_context, brief_graph, fit_bytes
from codeloom.serve import http_server, serve_lines
from codeloom.tools import ALIASES, TOOLS, ToolError, Tools

TREE = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~tide/*": ["lib/tide/*"]}}}',
    "lib/tide/height.ts": """// Height of the water over the zero of the chart.
export function heightAt(hour) {
  return mean() + swing(hour);
}

function mean() { return 3; }
function swing(hour) { return Math.cos(hour); }
""",
    "lib/tide/station.ts": """import { heightAt as level } from './height';

export class Station {
  forecast(hours) {
    return hours.map(level(1));
  }
}

export function lowest(hours) {
  return level(hours);
}
""",
    "lib/port.ts": """import * as tide from '~tide/height';

export function canEnter(draught) {
  return tide.heightAt(6) > draught;
}
""",
    "web/pages.ts": """import { canEnter } from '../lib/port';
import { lowest } from '../lib/tide/station';

site.get('/port/entry', canEnter);
site.get('/tide/lowest', lowest);
""",
    "checks/port.spec.ts": """import { canEnter } from '../lib/port';

export function shallowShipsEnter() {
  return canEnter(2);
}
""",
    "native/moon.rs": """use std::f64;

/// Phase of the moon on a day.
pub fn phase(day: u32) -> f64 {
    cycle(day)
}

fn cycle(day: u32) -> f64 {
    day as f64
}
""",
    "docs/GUIDE.md": "# Tides\n\nWhy water moves.\n",
    "dist/bundle.js": "function built() {}\n",
}


def grow(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    grow(root, TREE)
    (root / "logo.bin").write_bytes(b"\0\1")
    (root / "dangling").symlink_to(root / "nowhere")
    out = Engine(spark, str(root))
    report = out.index()
    assert (report.scanned, report.indexed) == (8, 8)
    return out


def test_resolution(engine):
    names = engine.table("nodes").select("id", "qualified_name")
    edges = engine.table("edges").join(names.toDF("source_id", "source"), "source_id").join(names.toDF("target_id", "target"), "target_id")
    found = {}
    for r in edges.collect():
        found.setdefault((r.kind, r.is_derived), set()).add((r.source, r.target))
    height, port, station = "lib/tide/height.ts", "lib/port.ts", "lib/tide/station.ts"
    assert found["IMPORTS", True] == {(station, height), (port, height), ("web/pages.ts", port), ("web/pages.ts", station), ("checks/port.spec.ts", port)}
    assert found["CALLS", False] == {(f"{height}::heightAt", f"{height}::mean"), (f"{height}::heightAt", f"{height}::swing"), ("native/moon.rs::phase", "native/moon.rs::cycle")}
    assert found["CALLS", True] >= {(f"{port}::canEnter", f"{height}::heightAt"), (f"{station}::forecast", f"{height}::heightAt"), (f"{station}::lowest", f"{height}::heightAt")}
    assert found["TESTS", True] == {("checks/port.spec.ts::shallowShipsEnter", f"{port}::canEnter")}
    assert {t for _, t in found["REFERENCES", True]} == {f"{port}::canEnter", f"{station}::lowest"}


def test_search_and_positions(engine):
    hits = engine.search("water", 10)
    assert {h["path"] for h in hits} >= {"lib/tide/height.ts", "docs/GUIDE.md"} and any("[water]" in (h["snippet"] or "") for h in hits)
    assert engine.search("lib/port.ts", 5)[0]["path"] == "lib/port.ts"
    assert engine.search("", 5) == []
    assert engine.at("lib/tide/station.ts", 5)["name"] == "forecast" and engine.at("lib/port.ts", 99) is None
    node = engine.at("lib/tide/height.ts", 2)
    assert {e["kind"] for e in engine.references(node["id"])["edges"]} == {"CALLS"}
    called = {n["name"] for n in engine.call_hierarchy(node["id"], "outgoing")["nodes"]}
    assert called == {"heightAt", "mean", "swing"}


def test_grep_glob_read(engine):
    assert [g["path"] for g in engine.glob("lib/**/s*.ts")] == ["lib/tide/station.ts"]
    assert len(engine.grep("ENTER", "web/*.ts")) == 2
    assert [g["line"] for g in engine.grep("can[A-Z]", "lib/port.ts", case_sensitive=True, regex=True)] == [3]
    with pytest.raises(ValueError):
        engine.grep("(?=x)", regex=True)
    read = engine.read("lib/port.ts", 3, 1)
    assert (read["content"], read["truncated"], read["next_offset"], read["indexed"]) == ("export function canEnter(draught) {", True, 4, True)
    assert engine.read("lib/port.ts", 99)["content"] == ""
    assert engine.read("dist/bundle.js")["indexed"] is False
    assert engine.read("../outside") is None and engine.read("/etc/passwd") is None and engine.read("dangling") is None


def test_graphs_and_neighbourhood(engine):
    for name in ("ast_graph", "dependency_graph", "call_graph", "product_flow_graph", "test_graph"):
        assert engine.graph(name)["edges"], name
    node = engine.at("lib/tide/height.ts", 6)
    near, none = engine.neighborhood(node["id"], 1), engine.neighborhood(node["id"], 0)
    assert {n["name"] for n in near["nodes"]} == {"mean", "heightAt", "height.ts"}
    assert len(none["nodes"]) == 1 and not none["edges"]
    assert engine.neighborhood(5, 2) == {"nodes": [], "edges": []}


def test_context_budget(engine):
    context = engine.task_context("may ships enter the port", 800)
    assert len(json.dumps(context)) < 10_000 and len(context["context_pack"]) <= 1700 and len(context["subgraph"]["edges"]) <= 5
    brief = brief_context(context, 800)
    assert brief["files"] and len(brief["read"]) <= 4
    assert {t["path"] for t in engine.suggest_tests("enter port")} == {"checks/port.spec.ts"}


def test_brief_views():
    value = {"nodes": [{"id": i, "name": f"n{i}", "path": f"p{i}"} for i in range(30)], "edges": [{"source_id": i, "target_id": i + 1, "kind": "CALLS"} for i in range(29)]}
    brief = brief_graph(value, 50)
    assert brief["edges"][0] == "n0 -CALLS-> n1" and len(brief["edges"]) == 20 and len(brief["paths"]) == 10 and brief["truncated"]
    assert len(json.dumps(fit_bytes({"a": ["x" * 50] * 4000}, 2000))) <= 2000
    assert "error" in fit_bytes({f"k{i}": 1 for i in range(4000)}, 100)


def test_tools(engine):
    tools = Tools(engine, compact=True)
    assert len(TOOLS) == 25 and len(tools.listed()) == 25 and len(Tools(engine).listed()) == 25 + len(ALIASES)
    assert tools.call("read", {"path": "lib/port.ts"})["total_lines"] == 5
    assert len(json.dumps(tools.call("call_graph"))) < 12_000
    for name, args in (("nope", {}), ("search", {}), ("search", {"query": 3}), ("definition_at", {"path": "x", "line": 1}), ("grep", {"query": "x", "limit": True})):
        with pytest.raises(ToolError):
            tools.call(name, args)


def test_json_rpc(engine):
    lines = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "glob", "arguments": {"pattern": "lib/*"}}}, {"id": 4, "method": "what"}, {"id": 5, "method": "tools/call", "params": {"name": "nope"}}, {"method": "note"}, {"id": 6, "method": "resources/read", "params": {"uri": "codeloom://files/lib/port.ts"}}, {"id": 7, "method": "resources/list"}]
    sink = io.StringIO()
    serve_lines(Tools(engine, True), io.StringIO("{bad\n" + "".join(json.dumps(x) + "\n" for x in lines)), sink)
    answers = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [None, 1, 2, 3, 4, 5, 6, 7]
    assert answers[0]["error"]["code"] == -32700 and answers[5]["error"]["code"] == -32000 and answers[4]["result"] == {}
    assert "canEnter" in answers[6]["result"]["contents"][0]["text"]


def test_http(engine):
    server = http_server(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        request = urllib.request.Request(base + path, data=None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert ask("/health") == (200, {"status": "ok"})
    assert ask("/search", {"query": "water", "limit": 3})[1]["hits"]
    assert ask("/search", {"query": "x", "repo_path": "/elsewhere"})[0] == 400
    assert ask("/files/lib/port.ts")[1]["total_lines"] == 5
    assert ask("/files/none")[0] == 404 and ask("/search", {})[0] == 500
    server.shutdown()


def test_incremental(spark, tmp_path):
    grow(tmp_path, {"a.ts": "export class First { go() { return 1; } }\n", "b.ts": "export function second() {}\n", "c.ts": "export function third() {}\n"})
    engine = Engine(spark, str(tmp_path))
    assert engine.status()["mode"] == "empty_index" and engine.status()["needs_index"]
    engine.index()
    assert engine.doctor()["integrity"] == "ok" and not engine.status()["needs_index"]
    again = engine.index(full=True)
    assert (again.indexed, again.skipped_unchanged) == (0, 3)
    before = engine.read("a.ts")["content"]
    (tmp_path / "a.ts").write_text("export class Changed {}\n")
    (tmp_path / "b.ts").unlink()
    (tmp_path / "d.ts").write_text("export const fourth = () => 4;\n")
    (tmp_path / "e.png").write_bytes(b"\x89PNG\0")
    status = engine.status()
    assert (status["new"], status["modified"], status["deleted"]) == (["d.ts"], ["a.ts"], ["b.ts"])
    report = engine.index()
    assert (report.indexed, report.deleted, report.skipped_unchanged) == (2, 1, 1)
    assert engine.search("changed", 5) and not engine.search("first", 5) and not engine.search("second", 5)
    (tmp_path / "a.ts").write_text(before + "\n")
    engine.index()
    assert engine.search("first", 5) and not engine.search("changed", 5)


def test_git_dirty_files_come_first(spark, tmp_path):
    grow(tmp_path, {"a.ts": "export function alpha() {}\n", "b.ts": "export function beta() {}\n"})
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    (tmp_path / "b.ts").write_text("export function beta2() {}\n")
    engine = Engine(spark, str(tmp_path))
    engine.index()
    assert engine.task_context("alpha", 2000, 1)["relevant_files"][0]["kind"] == "dirty_file"


def test_table_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([("src/x.ts", "export function fromTable() {}\n", 1), ("dist/y.ts", "function no() {}", 1)], "path string, content string, modified_at bigint")
    engine = Engine(spark, str(tmp_path), f"file://{tmp_path}/store")
    assert engine.index(corpus=corpus).scanned == 1
    assert engine.symbols("fromTable")[0]["path"] == "src/x.ts"


def test_status_reads_only_what_may_have_changed(spark, tmp_path):
    """Size and time first: an equal pair is believed, unless the file is as young as the index."""
    import os

    root = tmp_path / "tree"
    root.mkdir()
    for name in ("same.ts", "edit.ts", "touched.ts", "gone.ts"):
        (root / name).write_text(f"export function {name[:-3]}() {{}}\n")
        os.utime(root / name, (1_000_000_000, 1_000_000_000))
    engine = Engine(spark, str(root), f"file://{tmp_path}/store")
    assert engine.index().indexed == 4
    (root / "edit.ts").write_text("export function other() {}\n")
    os.utime(root / "touched.ts", (1_000_000_500, 1_000_000_500))
    (root / "gone.ts").unlink()
    (root / "more.ts").write_text("export function more() {}\n")
    found = engine.status()
    assert (found["new"], found["modified"], found["deleted"], found["needs_index"]) == (["more.ts"], ["edit.ts"], ["gone.ts"], True)
    report = engine.index()
    assert (report.scanned, report.indexed, report.skipped_unchanged, report.deleted) == (4, 2, 2, 1)
    assert {r.name for r in engine.table("nodes").where("kind = 'Function'").collect()} == {"same", "other", "touched", "more"}
    assert engine.table("chunks").where("kind = 'file'").count() == 4
    assert not engine.status()["needs_index"]
    # changed at once, with the size and the second it had: told by its hash
    (root / "more.ts").write_text("export function mare() {}\n")
    assert engine.status()["modified"] == ["more.ts"]
