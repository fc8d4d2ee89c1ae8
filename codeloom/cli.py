"""Command line: init, index, search, task-context, doctor, rpc and serve."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from typing import Any

from codeloom.engine import Engine
from codeloom.serve import http_server, serve_lines
from codeloom.session import local_session
from codeloom.tools import Tools


def parser() -> argparse.ArgumentParser:
    """The arguments of all commands."""
    out = argparse.ArgumentParser(prog="codeloom")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=about)

    command("init", "create an empty store").add_argument("path")
    index = command("index", "bring the index of a tree up to date")
    index.add_argument("path")
    index.add_argument("--full", action="store_true")
    search = command("search", "ranked search")
    search.add_argument("query")
    search.add_argument("--repo-path", default=".")
    search.add_argument("--limit", type=int, default=20)
    search.add_argument("--json", action="store_true")
    context = command("task-context", "what matters for a task")
    context.add_argument("path")
    context.add_argument("task")
    context.add_argument("--max-tokens", type=int, default=12_000)
    context.add_argument("--hops", type=int, default=2)
    context.add_argument("--json", action="store_true")
    doctor = command("doctor", "integrity and size of the store")
    doctor.add_argument("path")
    doctor.add_argument("--maintenance", action="store_true")
    doctor.add_argument("--json", action="store_true")
    rpc = command("rpc", "JSON-RPC on standard input and output")
    rpc.add_argument("path")
    rpc.add_argument("--compact", action="store_true")
    serve = command("serve", "HTTP on the loopback address")
    serve.add_argument("path")
    serve.add_argument("--port", type=int, default=8765)
    return out


def main(argv: list[str] | None = None) -> int:
    """Run one command."""
    args = parser().parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, args.repo_path if args.command == "search" else args.path)
    as_json = getattr(args, "json", True)

    def show(value: Any, text: str | None = None) -> None:
        print(json.dumps(value, ensure_ascii=False, default=str) if as_json or text is None else text)

    if args.command in ("init", "index"):
        show(asdict(engine.index(getattr(args, "full", False))) if args.command == "index" else {"store": engine.store.root})
    elif args.command == "search":
        hits = engine.search(args.query, args.limit)
        show(hits, "\n".join(f"{h['score']:.3f} {h['kind']} {h['path'] or ''} {h['name'] or ''}" for h in hits))
    elif args.command == "task-context":
        value = engine.task_context(args.task, args.max_tokens, args.hops)
        show(value, value["context_pack"])
    elif args.command == "doctor":
        if args.maintenance:
            engine.store.write({n: engine.store.read(n).coalesce(8) for n in ("files", "facts", "nodes", "edges", "chunks")})
        value = engine.doctor()
        show(value, "\n".join(f"{k}: {v}" for k, v in value.items()))
    elif args.command == "rpc":
        serve_lines(Tools(engine, args.compact), sys.stdin, sys.stdout)
    else:
        http_server(engine, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
