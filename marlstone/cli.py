"""Command line and stdio server over bundles: ``python -m marlstone.cli COMMAND ..``."""

from __future__ import annotations

import argparse
import json
import sys
from inspect import signature
from pathlib import Path
from typing import Any, TextIO

from marlstone import __version__
from marlstone.explorer import Explorer, Refused
from marlstone.operators.ask import BUDGET
from marlstone.session import get_session

TOOLS = ("overview", "list", "search", "peek", "read", "links", "history")


def schema(tool: str) -> dict[str, Any]:
    """JSON schema of a tool's arguments, from the view's own signature."""
    kinds = {"str": "string", "int": "integer", "bool": "boolean"}
    fields = {k: p for k, p in signature(getattr(Explorer, tool)).parameters.items() if k != "self"}
    types = {k: {"type": kinds[str(p.annotation).removesuffix(" | None")]} | ({} if p.default in (p.empty, None) else {"default": p.default}) for k, p in fields.items()}
    return {"type": "object", "properties": types, "required": [k for k, p in fields.items() if p.default is p.empty], "additionalProperties": False}


def call(explorer: Explorer, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """One read-only tool call; only refusals tell what was wrong."""
    if name not in TOOLS:
        return {"error": f"unknown tool: {name}"}
    try:
        return getattr(explorer, name)(**arguments)
    except Refused as e:
        return {"error": str(e)}
    except TypeError:
        return {"error": "invalid arguments"}
    except Exception:  # noqa: BLE001  what went wrong inside is not for the client
        return {"error": "internal error"}


def serve(explorer: Explorer, source: TextIO, sink: TextIO) -> None:
    """The tools over JSON-RPC lines until the input ends."""
    for line in source:
        try:
            ask = json.loads(line)
        except ValueError:
            continue
        method, params = ask.get("method"), ask.get("params") or {}
        if method == "initialize":
            result: Any = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "marlstone", "version": __version__}}
        elif method == "tools/list":
            result = {"tools": [{"name": t, "description": (getattr(Explorer, t).__doc__ or t), "inputSchema": schema(t)} for t in TOOLS]}
        elif method == "tools/call":
            got = call(explorer, params.get("name", ""), params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(got, default=str, ensure_ascii=False)}], "isError": "error" in got}
        elif "id" not in ask:
            continue
        else:
            print(json.dumps({"jsonrpc": "2.0", "id": ask["id"], "error": {"code": -32601, "message": "method not found"}}), file=sink, flush=True)
            continue
        print(json.dumps({"jsonrpc": "2.0", "id": ask.get("id"), "result": result}, default=str), file=sink, flush=True)


PROJECT = "marlstone.toml"


def build(spark, sources: str, target: str, name: str) -> str:
    """Compiles a folder of documents into a bundle folder; returns its revision id."""
    from marlstone.build import BuildError
    from marlstone.build import build as run

    out = run(spark, [sources], target, name)
    if not out.passed:
        raise BuildError("lint found errors; nothing was published")
    return out.revision


def init(folder: str, name: str) -> dict[str, Any]:
    """Starts a project: its file, without sources; an existing one is an error."""
    path = Path(folder) / PROJECT
    if path.exists():
        return {"error": f"{path} is there already"}
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"[project]\nname = {json.dumps(name, ensure_ascii=False)}\n", encoding="utf-8")
    return {"project": str(path)}


def add(folder: str, uri: str, connector: str = "files") -> dict[str, Any]:
    """Adds a source to a project's file; the same one twice is an error, and so is an unknown connector."""
    from marlstone.sources.connectors import REGISTRY
    from marlstone.sources.records import project

    path = Path(folder) / PROJECT
    if not path.exists():
        return {"error": f"no project in {folder}"}
    if connector not in REGISTRY:
        return {"error": f"unknown connector {connector!r}; known: {', '.join(sorted(REGISTRY))}"}
    if any(s.get("uri") == uri for s in project(str(path))["sources"]):
        return {"error": f"{uri} is a source already"}
    with path.open("a", encoding="utf-8") as f:
        f.write(f"\n[[sources]]\nconnector = {json.dumps(connector)}\nuri = {json.dumps(uri, ensure_ascii=False)}\n")
    return {"added": uri, "sources": len(project(str(path))["sources"])}


def project_sources(folder: str) -> tuple[str, list[Any]]:
    """Name and sources of a project for ``build``: folders, those relative to it resolved, and connectors with their addresses."""
    from marlstone.sources.records import project

    p = project(str(Path(folder) / PROJECT))
    path = lambda u: u if "://" in u else str((Path(folder) / u).resolve())
    return p["name"], [path(s["uri"]) if s.get("connector", "files") == "files" else (s["connector"], s["uri"]) for s in p["sources"]]


def built(out: Any) -> dict[str, Any]:
    """What a build or import says, with its errors if it was stopped."""
    said = dict(out.report) | {"passes": out.passed}
    if not out.passed:
        said["findings"] = [r.asDict() for r in out.findings.where("severity = 'error'").orderBy("path", "code", "message").limit(50).collect()]
    return said


def evaluate_spec(spark, path: str, today: str | None, out: str | None = None) -> dict[str, Any]:
    """Runs a benchmark spec over its bundles; one summary row a bundle and condition, and all rows as Parquet if asked."""
    from pyspark.sql import functions as F

    from marlstone.operators import evaluate
    from marlstone.session import materialize
    from marlstone.sources.records import benchmark

    name, bundles, questions = benchmark(spark, path)
    rows = [evaluate.run(Explorer(spark, root, today), questions.where(F.col("bundle") == b)).withColumn("bundle", F.lit(b)) for b, root in sorted(bundles.items())]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = materialize(every, "evaluation")
    if out:
        every.write.mode("overwrite").parquet(out)
    return {"benchmark": name, "summary": [r.asDict() for r in evaluate.summary(every).orderBy("condition").collect()]}


def chat(explorer: Explorer, log: str, source: TextIO, sink: TextIO, mode: str = "pd") -> int:
    """Answers a line at a time and keeps the conversation as a log; returns the number of turns.

    Each question begins with what the last answer cites; a log that is there already is gone on with.
    """
    from marlstone.operators.conversation import TURNS
    from marlstone.sources.records import append_turn, conversations

    carried: list[str] = []
    before = 0
    if Path(log).exists():
        said = conversations(explorer.spark, log).where("role = 'assistant'").orderBy("turn").collect()
        before, carried = len(said), list(said[-1]["citations"] or []) if said else []
    n = 0
    for line in source:
        if not (question := line.strip()):
            continue
        got = explorer.ask(question, mode=mode, carried=carried if mode == "pd" else (), turns=min(before + n, TURNS))
        carried = list(got["citations"] or [])
        append_turn(log, Path(log).stem, "user", question)
        append_turn(log, Path(log).stem, "assistant", got["answer"], carried)
        print(got["answer"], file=sink, flush=True)
        n += 1
    return n


def doctor(spark, folder: str) -> dict[str, Any]:
    """Versions, optional libraries, the shared folder, and the state of the bundle."""
    from importlib.util import find_spec

    from marlstone.session import shared_dir
    from marlstone.store import Store

    store = Store(spark, folder)
    return {"version": __version__, "spark": spark.version, "python": sys.version.split()[0], "libraries": {n: bool(find_spec(n)) for n in ("yaml", "pyarrow", "pandas", "pypdf")},
            "shared_dir": shared_dir(spark), "revision": store.current(), "revisions": len(store.revisions())}


COMMANDS = (
    ("overview",), ("list",), ("search", "query"), ("peek", "path"), ("read", "path"), ("links", "path"), ("history",), ("ask", "question"), ("chat", "log"), ("lint",), ("diff", "other"), ("pack", "out"), ("graph",), ("viz", "out"),
    ("init", "name"), ("add", "uri"), ("build",), ("import", "source"), ("check",), ("eval", "spec"), ("config",), ("plugin",), ("serve",), ("doctor",), ("login",), ("keys",),
)
#: Options of single commands.
OPTIONS = {"init": ("--from",), "lint": ("--strict",), "list": ("--directory", "--type", "--tag", "--status"), "add": ("--connector",), "ask": ("--trace", "--mode", "--budget"), "chat": ("--mode",), "eval": ("--out",), "pack": ("--profile",)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("--bundle", default=".")
    p.add_argument("--today")
    p.add_argument("--model")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in COMMANDS:
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        for o in OPTIONS.get(name, ()):
            q.add_argument(o, **({"action": "store_true"} if o == "--strict" else {"dest": "source"} if o == "--from" else {}))
    a = p.parse_args(argv)
    out = run(a)
    if out is None:
        return 0
    print(json.dumps(out, indent=1, default=str, ensure_ascii=False))
    return int(isinstance(out, dict) and (bool(out.get("error")) or out.get("passes") is False or bool(out.get("drift"))))


def run(a: argparse.Namespace) -> Any:
    """What a command gives; None if it has written its own output."""
    from marlstone.providers import machine_settings, setting

    # commands that need no session
    if a.command in ("login", "keys"):
        return {"error": f"{a.command} is not implemented"}
    if a.command == "init":
        made = init(a.bundle, a.name)
        if a.source is None or made.get("error"):
            return made
        from marlstone.build import import_bundle

        return made | built(import_bundle(get_session(), a.source, a.bundle))
    if a.command == "add":
        return add(a.bundle, a.uri, a.connector or "files")
    if a.command == "plugin":
        from marlstone.sources.connectors import REGISTRY

        return {"connectors": {k: {"version": v.version, "capabilities": sorted(v.capabilities)} for k, v in sorted(REGISTRY.items())}}
    if a.command == "config":
        from marlstone.sources.records import project

        path = Path(a.bundle) / PROJECT
        known = project(str(path)) if path.exists() else {}
        machine = machine_settings()
        return {"project": known.get("name"), "sources": known.get("sources", []), "model": setting(a.model, known.get("model"), machine.get("model")), "embedder": setting(known.get("embedder"), machine.get("embedder"))}
    spark = get_session()
    e = Explorer(spark, a.bundle, a.today)
    if a.command == "serve":
        return serve(e, sys.stdin, sys.stdout)
    if a.command == "chat":
        chat(e, a.log, sys.stdin, sys.stdout, a.mode or "pd")
        return None
    if a.command in TOOLS:
        given = {k: v for k, v in vars(a).items() if k in ("query", "path", "directory", "type", "tag", "status") and v}
        return call(e, a.command, given)
    if a.command == "ask":
        return e.ask(a.question, trace=a.trace, mode=a.mode or "pd", budget=int(a.budget or BUDGET))
    if a.command == "lint":
        from marlstone.operators.lint import verdict

        found = e.lint().cache()
        return {"findings": [r.asDict() for r in found.orderBy("path", "code", "message").collect()]} | verdict(found, a.strict).first().asDict()
    if a.command == "diff":
        other = Explorer(spark, a.other)
        return {"files": e.diff(other), "links": e.link_diff(other)}
    if a.command == "pack":
        from marlstone.sources.files import pack, plain_tree

        return {"sha256": pack(plain_tree(e.files) if a.profile == "plain" else e.files, a.out)}
    if a.command == "graph":
        return e.graph()
    if a.command == "viz":
        Path(a.out).write_text(e.graph_page(), encoding="utf-8")
        return {"written": a.out}
    if a.command == "import":
        from marlstone.build import import_bundle

        return built(import_bundle(spark, a.source, a.bundle))
    if a.command in ("build", "check"):
        from marlstone.build import build as make
        from marlstone.build import drift

        name, sources = project_sources(a.bundle)
        if a.command == "build":
            return built(make(spark, sources, a.bundle, name, setting(a.model)))
        return {"drift": drift(spark, sources, a.bundle, name, provider=setting(a.model))}
    if a.command == "eval":
        return evaluate_spec(spark, a.spec, a.today, a.out)
    return doctor(spark, a.bundle)


if __name__ == "__main__":
    sys.exit(main())
