"""JSON-RPC over standard input and output, and HTTP on the loopback address."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any, TextIO
from urllib.parse import parse_qs, unquote, urlsplit

from codeloom.engine import Engine, Json
from codeloom.tools import Tools

PARSE_ERROR, TOOL_ERROR = -32700, -32000
PROTOCOL = "2024-11-05"


def handle(tools: Tools, request: Json) -> Any:
    """The result of one request; unknown methods get an empty object."""
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "serverInfo": {"name": "codeloom", "version": "0.1.0"}, "capabilities": {"tools": {}, "resources": {}}}
    if method == "tools/list":
        return {"tools": tools.listed()}
    if method == "tools/call":
        value = tools.call(params.get("name", ""), params.get("arguments"))
        return {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}]}
    if method == "resources/list":
        return {"resources": tools.resources()}
    if method == "resources/templates/list":
        return {"resourceTemplates": [{"uriTemplate": "codeloom://files/{path}", "name": "file"}, {"uriTemplate": "codeloom://nodes/{id}", "name": "node"}]}
    if method == "resources/read":
        uri = params.get("uri", "")
        return {"contents": [{"uri": uri, "text": tools.resource(uri)}]}
    return {}


def serve_lines(tools: Tools, source: TextIO, sink: TextIO) -> None:
    """Answer one JSON request a line; notifications (without id) get no answer."""
    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as error:
            _write(sink, {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(error)}})
            continue
        try:
            answer: Json = {"result": handle(tools, request)}
        except Exception as error:  # noqa: BLE001  whatever a tool raises is the caller's to see
            answer = {"error": {"code": TOOL_ERROR, "message": str(error)}}
        if "id" in request:
            _write(sink, {"jsonrpc": "2.0", "id": request["id"], **answer})


def _write(sink: TextIO, value: Json) -> None:
    sink.write(json.dumps(value, ensure_ascii=False, default=str) + "\n")
    sink.flush()


def http_server(engine: Engine, port: int) -> HTTPServer:
    """GET /health, /nodes/ID/neighborhood?hops=N and /files/PATH; POST /index, /search and /task-context."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: Any) -> None:
            body = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, run: Any) -> None:
            try:
                status, value = run()
            except Exception as error:  # noqa: BLE001  reported to the client
                status, value = 500, {"error": str(error)}
            self._send(status, value)

        def do_GET(self) -> None:
            self._answer(self._get)

        def do_POST(self) -> None:
            self._answer(self._post)

        def _get(self) -> tuple[int, Any]:
            url = urlsplit(self.path)
            parts = unquote(url.path).strip("/").split("/")
            if parts == ["health"]:
                return 200, {"status": "ok"}
            if len(parts) == 3 and parts[0] == "nodes" and parts[2] == "neighborhood":
                return 200, engine.neighborhood(int(parts[1]), int(parse_qs(url.query).get("hops", ["1"])[0]))
            if parts[0] == "files" and len(parts) > 1:
                found = engine.read("/".join(parts[1:]))
                return (200, found) if found else (404, {"error": "no such file"})
            return 404, {"error": "no such path"}

        def _post(self) -> tuple[int, Any]:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if body.get("repo_path") not in (None, engine.root):
                return 400, {"error": "the server answers for one tree only"}
            if self.path == "/index":
                return 200, asdict(engine.index(bool(body.get("full"))))
            if self.path == "/search":
                return 200, {"hits": engine.search(body["query"], int(body.get("limit", 20)))}
            if self.path == "/task-context":
                return 200, engine.task_context(body["task"], int(body.get("max_tokens", 12_000)), int(body.get("hops", 2)))
            return 404, {"error": "no such path"}

        def log_message(self, *_: Any) -> None:
            return

    return HTTPServer(("127.0.0.1", port), Handler)
