"""python -m corvane.cli: scan, index, plan, query, report, db, schema, status, types."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import threading
import time

from .plans.registry import TYPES

FIELDS = ("rule_id", "severity", "confidence", "evidence", "status", "file", "line", "function", "properties", "summary", "reasoning", "fix_strategy", "exception_check")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--version", action="version", version="corvane 0.2.0")
    p.add_argument("--store", default="corvane-store", help="folder of the verdict store")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("path")
    scan.add_argument("--exclude", action="append")
    scan.add_argument("--output-dir")
    scan.add_argument("--baseline")
    scan.add_argument("--scan-id")
    scan.add_argument("--fail-on", choices=("confirmed", "suspected"))
    scan.add_argument("--target", help="only results below this path")
    scan.add_argument("--context-lines", type=int, default=15)
    scan.add_argument("--timeout", type=float, help="seconds after which the scan's jobs are cancelled")
    index = sub.add_parser("index")
    index.add_argument("path")
    index.add_argument("--exclude", action="append")
    for name in ("plan", "query"):
        plan = sub.add_parser(name)
        plan.add_argument("type", choices=sorted(TYPES))
        plan.add_argument("--scan-id", help="a stored scan; the latest without it")
        plan.add_argument("--output-dir", help="plan: where plan-<type>-<time>.json is written", default=".")
    rep = sub.add_parser("report")
    rep.add_argument("--write", action="store_true", help="one verdict, by the fields below")
    for name in FIELDS:
        rep.add_argument(f"--{name.replace('_', '-')}", type={"line": int, "confidence": float}.get(name, str))
    rep.add_argument("--write-json", help="a file of verdicts, or - for standard input")
    rep.add_argument("--scan-id")
    rep.add_argument("--review", type=int, metavar="ID")
    rep.add_argument("--review-status")
    rep.add_argument("--review-reasoning", default="")
    rep.add_argument("--audit", action="store_true")
    rep.add_argument("--sarif", action="store_true", help="confirmed and suspected findings as SARIF")
    rep.add_argument("--source", help="with --sarif, the tree whose lines are shown")
    rep.add_argument("--output-dir", help="where findings are kept as files")
    sub.add_parser("db").add_argument("sql")
    sub.add_parser("schema").add_argument("table", nargs="?")
    sub.add_parser("status")
    sub.add_parser("types")
    return p


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out)


def logger(folder: str | None) -> logging.Logger:
    """Log lines as JSON to standard error and, with a folder, to its scan.log."""
    log = logging.getLogger("corvane")
    log.setLevel(logging.INFO)
    log.propagate = False
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, "scan.log"), encoding="utf-8"))
    for h in handlers:
        h.setFormatter(JsonLines())
        log.addHandler(h)
    return log


def within(spark, seconds: float | None, work):
    """work()'s result; after so many seconds all of the session's jobs are cancelled, and it fails."""
    if not seconds:
        return work()
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"the scan took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()


def one_finding(a: argparse.Namespace) -> dict:
    """The verdict of --write; what --properties holds stands in for fields that aren't given."""
    given = json.loads(a.properties) if a.properties else {}
    out = {k: given[k] for k in ("summary", "reasoning", "fix_strategy", "exception_check") if given.get(k)}
    return out | {k: getattr(a, k) for k in FIELDS if k != "properties" and getattr(a, k) is not None}


def run(argv: list[str] | None = None, spark=None) -> int:
    from .functions.knowledge import EXCLUDED_DIRS

    a = parser().parse_args(argv)
    if a.command == "types":
        print(json.dumps({t.name: f"CWE-{t.cwe}" for t in TYPES.values()}, indent=1))
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .operators import report
    from .operators.store import checked_scan_id

    engine = Engine(spark or SparkSession.builder.appName("corvane").getOrCreate(), a.store)
    if a.command == "scan":
        try:
            scan_id = checked_scan_id(a.scan_id)
        except ValueError as e:
            print(json.dumps({"error": str(e)}))
            return 1
        log = logger(os.path.join(a.output_dir, scan_id) if a.output_dir else None)
        log.info("scan %s of %s", scan_id, a.path)
        try:
            out = within(engine.spark, a.timeout, lambda: engine.scan(a.path, a.exclude or EXCLUDED_DIRS, a.output_dir, a.baseline, scan_id, a.target, a.context_lines))
        except TimeoutError as e:
            log.error("%s", e)
            print(json.dumps({"error": str(e)}))
            return 1
        log.info("results %s, errors %s", json.dumps(out["types"]), json.dumps(out["errors"]))
        print(report.summary(engine.store.read("scan_stats").filter(f"scan_id = '{scan_id}'")), file=sys.stderr)
        print(json.dumps(out))
        return engine.gate(out["scan_id"], a.fail_on) if a.fail_on else 0
    if a.command == "index":
        print(json.dumps(engine.index(a.path, a.exclude or EXCLUDED_DIRS)))
        return 0
    if a.command in ("plan", "query"):
        rows = engine.plan(a.type, a.scan_id).orderBy("rank")
        if a.command == "query":
            for line in rows.toJSON().toLocalIterator():
                print(line)
            return 0
        name, n = os.path.join(a.output_dir, f"plan-{a.type}-{time.strftime('%Y%m%d%H%M%S')}.json"), 0
        with open(name, "w", encoding="utf-8") as f:
            f.write(f'{{"vulnerability_type": {json.dumps(a.type)}, "candidates": [')
            for line in rows.toJSON().toLocalIterator():
                f.write((", " if n else "") + line)
                n += 1
            f.write("]}\n")
        print(json.dumps({"vulnerability_type": a.type, "candidates": n, "file": name}))
        return 0
    if a.command == "report":
        scan_id = a.scan_id or engine.store.latest_scan() or ""
        if a.write or a.write_json:
            if a.write:
                items = [one_finding(a)]
            else:
                with sys.stdin if a.write_json == "-" else open(a.write_json, encoding="utf-8") as f:
                    items = json.load(f)
            reply = engine.store.write_findings(items, scan_id)
            if a.output_dir:
                reply["files"] = report.reconcile(a.output_dir, engine.store.effective())
            print(json.dumps(reply))
            return 0 if reply["written"] else 1
        if a.review is not None:
            engine.store.review(a.review, a.review_status or "", a.review_reasoning)
            if a.output_dir:
                for r in report.latest_verdicts(engine.store.effective().filter(f"id = {a.review}")).collect():
                    print(json.dumps(report.sync_finding(a.output_dir, r)))
        elif a.audit:
            print(report.audit_markdown(engine.store.audit(scan_id)))
            if a.output_dir:
                print(json.dumps(report.reconcile(a.output_dir, engine.store.effective())))
        elif a.sarif:
            from .sources.tree import read_tree

            files = read_tree(engine.spark, a.source).select("path", "source") if a.source else None
            print(json.dumps(report.verdict_sarif(engine.store.effective(), files), indent=1))
        else:
            rows = engine.store.effective()
            for line in (rows.filter(rows["effective"] == a.status) if a.status else rows).toJSON().toLocalIterator():
                print(line)
        return 0
    if a.command == "db":
        engine.sql_to(a.sql, sys.stdout)
        return 0
    try:
        print(json.dumps(engine.schema(a.table) if a.command == "schema" else engine.status()))
    except ValueError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run())
