"""Command line: make, fill, search, report and maintain a workspace."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quillspark.functions.storage import Files
from quillspark.operators import ocr, reports, sinks
from quillspark.operators.filters import Filters
from quillspark.plans import jobs
from quillspark.plans.query import QuerySyntaxError
from quillspark.plans.workspace import Workspace
from quillspark.sources import demo
from quillspark.sources.files import Crawl


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("workspace")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    c = commands.add_parser("sources")
    c.add_argument("action", choices=["list", "add-local", "test", "remove"])
    c.add_argument("--id")
    c.add_argument("--root")
    c.add_argument("--disabled", action="store_true")
    c = commands.add_parser("demo")
    c.add_argument("target")
    c = commands.add_parser("index")
    c.add_argument("root", nargs="?")
    c.add_argument("--source", action="append", default=[])
    c.add_argument("--full", action="store_true")
    c = commands.add_parser("search")
    c.add_argument("query")
    c.add_argument("--mode", choices=["exact", "semantic", "hybrid"], default="exact")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--ext", action="append", default=[])
    c.add_argument("--source", action="append", default=[])
    c.add_argument("--text", action="store_true", help="lines instead of JSON")
    c = commands.add_parser("report")
    c.add_argument("--json-out")
    c.add_argument("--csv-out")
    c.add_argument("--fast", action="store_true", help="counts by status only")
    c = commands.add_parser("doctor")
    c.add_argument("--bundle", help="a ZIP of everything that helps to find a fault")
    c = commands.add_parser("maintenance")
    c.add_argument("action", choices=["check", "reindex", "reindex-vectors", "compact", "snapshot", "errors"])
    c.add_argument("--to")
    commands.add_parser("model")
    commands.add_parser("ocr")
    return p


def _sources(files: Files) -> list[dict]:
    return files.read("sources") if files.exists("sources") else []


def _crawl(source: dict) -> Crawl:
    return Crawl(source["root"], source["source_id"])


def _change_sources(a, files: Files) -> object:
    known = _sources(files)
    if a.action == "add-local":
        if not a.root:
            raise SystemExit("--root is missing")
        own = {"source_id": a.id or Path(a.root).name, "kind": "local", "root": str(Path(a.root).absolute()), "enabled": not a.disabled}
        files.write("sources", [s for s in known if s["source_id"] != own["source_id"]] + [own])
        return own
    if a.action == "remove":
        files.write("sources", [s for s in known if s["source_id"] != a.id])
        return {"removed": a.id}
    if a.action == "test":
        return {s["source_id"]: Path(s["root"]).is_dir() for s in known if a.id in (None, s["source_id"])}
    return known


def _show(response, hits: list, as_text: bool) -> str:
    if as_text:
        lines = [f"{response.total} documents" + ("" if response.total_is_exact else " or more"), *response.notes]
        return "\n".join(lines + [f"{h['place']:>4}  {h['score']:8.3f}  {h['name']}  ({h['external_id']})" for h in hits])
    return json.dumps({"total": response.total, "exact": response.total_is_exact, "notes": response.notes, "hits": hits}, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Workspace(spark, a.workspace)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, sort_keys=True, default=str))
    match a.command:
        case "init":
            w.manifest.publish(schema=w.migrate())
            say({"workspace": a.workspace, "schema": w.migrate()})
        case "sources":
            say(_change_sources(a, w.files))
        case "demo":
            demo.write(a.target)
            say({"files": len(demo.files()), "expected": demo.EXPECTED})
        case "index" if a.root:
            say(w.index(Crawl(a.root, a.source[0] if a.source else "local"), a.full))
        case "index":
            sources = [{**s, "make": lambda s=s: _crawl(s)} for s in _sources(w.files)]
            job = jobs.Job("now", "index")
            say(jobs.indexing(w, sources, a.source or None, a.full)(job, jobs.Control()))
        case "search":
            try:
                found = w.search(a.query, a.mode, filters=Filters(sources=a.source, extensions=a.ext), limit=a.limit, offset=a.offset)
            except QuerySyntaxError as e:
                say({"error": e.code, "message": str(e)})
                return 2
            rows = w.hits(found).select("place", "score", "name", "external_id").collect() if found.hits is not None else []
            print(_show(found, [r.asDict() for r in rows], a.text))
        case "report" if a.fast:
            say({r.status: r.n for r in reports.counts(w.documents(), "status").collect()})
        case "report":
            report = w.report()
            text = sinks.report_json(report)
            if a.json_out:
                Path(a.json_out).write_text(text, encoding="utf-8")
            if a.csv_out:
                Path(a.csv_out).write_bytes(sinks.coverage_csv(report, reports.non_searchable(w.documents())))
            print(text)
        case "doctor":
            facts = {"environment": jobs.environment(spark), "statistics": w.statistics(), "findings": {r.finding: r.n for r in w.check().collect()}}
            if a.bundle:
                Path(a.bundle).write_bytes(sinks.diagnostics(w.report(), reports.non_searchable(w.documents()), w.errors(), facts))
            say(facts)
        case "model":
            say({"provider": None, "onnxruntime": importlib.util.find_spec("onnxruntime") is not None, "vectors": w.files.exists("vectors")})
        case "ocr":
            engines = [ocr.Program(), *(ocr.Library(n, n, lambda _: []) for n in ("easyocr", "rapidocr"))]
            have = {e.name for e in engines if e.available()}
            say({"available": sorted(have), "auto": ocr.pick_engine(have)})
        case "maintenance":
            match a.action:
                case "check":
                    say({r.finding: r.n for r in w.check().collect()})
                case "reindex" | "reindex-vectors":
                    w.reindex_all(only_vectors=a.action.endswith("vectors"))
                case "compact":
                    w.ensure_space()
                    w.compact()
                case "snapshot":
                    sinks.snapshot(spark, {"documents": w.documents(), "chunks": w.chunks(), "errors": w.errors()}, a.to)
                case "errors":
                    sys.stdout.buffer.write(sinks.errors_csv(w.errors()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
