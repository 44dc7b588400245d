"""The engine's face: scans, plans, verdicts, reports and read-only SQL over one store."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.knowledge import EXCLUDED_DIRS
from .operators import closure, converge, report, sqlguard
from .operators.store import TABLES, Store, checked_scan_id
from .plans import engine as plans
from .plans.kernel import facts as extract_facts
from .plans.kernel import refreshed
from .plans.registry import TYPES
from .sources.tree import read_tree


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # ---- scans

    def facts(self, files: DataFrame) -> DataFrame:
        """The files' facts. A file that the store has with this checksum, and that could be read, isn't parsed again."""
        old, stored = self.store.read("facts"), self.store.read("files")
        if stored.isEmpty():
            return closure.cut(extract_facts(files))
        failed = old.filter("record = 'error'").select("path").distinct()
        return closure.cut(refreshed(old, stored.join(failed, "path", "left_anti"), files))

    def tables(self, found: plans.Scan) -> dict[str, DataFrame]:
        """What the store keeps of a program."""
        f = found.facts.filter("record = 'function'")
        functions = f.select("path", F.col("function").alias("name"), F.col("props")["signature"].alias("signature"), F.col("kind").alias("return_type"), (F.col("note") == "static").alias("is_static"), F.col("line").alias("start_line"), "end_line")
        return {"files": found.files.select("path", "checksum", "loc"), "facts": found.facts, "functions": functions, "security_events": found.events, "graph_edges": found.edges, "graph_nodes": found.nodes, "function_summary": found.summaries()}

    def scan(self, path: str, exclude: Sequence[str] = EXCLUDED_DIRS, output: str | None = None, baseline: str | None = None, scan_id: str | None = None, target: str | None = None, context: int = report.LINES) -> dict:
        """Scans the tree, drops what was dismissed, is in the baseline or isn't below target, stores all of it at once and writes reports.

        errors counts files that couldn't be read and filters that couldn't decide.
        """
        scan_id = checked_scan_id(scan_id)
        files = closure.cut(read_tree(self.spark, path, exclude))
        found = plans.scan_files(files, facts=self.facts(files))
        rows = self.store.suppressed(found.ranked, baseline)
        if target:
            rows = converge.below(rows, target)
        rows = closure.cut(rows)
        made = self.tables(found) | {"results": rows.withColumn("scan_id", F.lit(scan_id)), "scan_stats": self.store.stats_rows(found.stats(), scan_id)}
        self.store.change(lambda _: made, ["results", "scan_stats"])
        errors = found.errors()
        out = {"scan_id": scan_id, "types": {r["vuln_type"]: r["n"] for r in rows.groupBy("vuln_type").agg(F.count("*").alias("n")).collect()}, "errors": {r["stage"]: r["count"] for r in errors.groupBy("stage").count().collect()}}
        if output:
            out |= report.write_scan(output, scan_id, rows, found.stats(), found.dropped(), found.files, errors, context)
        return out

    def index(self, path: str, exclude: Sequence[str] = EXCLUDED_DIRS) -> dict:
        """Reads and parses the tree, and stores files, functions, events, graph and summaries: how many there are."""
        files = closure.cut(read_tree(self.spark, path, exclude))
        found = plans.scan_files(files, facts=self.facts(files))
        self.store.change(lambda _: self.tables(found))
        return {"files": files.count(), "records": {r[0]: r[1] for r in found.facts.groupBy("record").count().collect()}, "edges": {r[0]: r[1] for r in found.edges.groupBy("edge_type").count().collect()}, "nodes": found.nodes.count()}

    def plan(self, kind: str, scan_id: str | None = None) -> DataFrame:
        """One type's results of a stored scan, the latest without an id, with their evidence."""
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind}")
        scan_id = scan_id or self.store.latest_scan()
        if scan_id is None:
            raise RuntimeError("nothing is scanned yet")
        return plans.evidence(self.store.read("results").filter((F.col("vuln_type") == kind) & (F.col("scan_id") == scan_id)))

    # ---- questions

    def gate(self, scan_id: str, level: str) -> int:
        """2 if the scan has a confirmed finding and level is confirmed, 3 if it has a suspected one and level is suspected, else 0."""
        n = {r[0]: r[1] for r in self.store.effective().filter(F.col("scan_id") == scan_id).groupBy("effective").count().collect()}
        if level == "confirmed" and n.get("confirmed"):
            return 2
        return 3 if level == "suspected" and (n.get("suspected") or n.get("confirmed")) else 0

    def query(self, statement: str) -> DataFrame:
        """The rows of one read-only statement over the store's tables. They are views of a session of their own, so the caller's stay as they are."""
        text = sqlguard.checked(statement)
        session = self.spark.newSession()
        own = Store(session, self.store.root)
        for name in TABLES:
            if name != "security_events":
                own.read(name).createOrReplaceTempView(name)
        return session.sql(text)

    def sql_to(self, statement: str, out: TextIO) -> None:
        """Writes {columns, rows, count} as JSON, row by row."""
        df = self.query(statement)
        out.write(f'{{"columns": {json.dumps(df.columns)}, "rows": [')
        n = 0
        for line in df.toJSON().toLocalIterator():
            out.write((", " if n else "") + line)
            n += 1
        out.write(f'], "count": {n}}}\n')

    def status(self) -> dict:
        return {"findings": {r[0]: r[1] for r in self.store.effective().groupBy("effective").count().collect()}, "files": self.store.read("files").count(), "latest_scan": self.store.latest_scan()}

    def schema(self, table: str | None = None) -> dict:
        """Columns and types of a table, or of all. security_events is shown, but can't be queried."""
        if table is not None and table not in TABLES:
            raise ValueError(f"unknown table {table}; there are {', '.join(sorted(TABLES))}")
        return {name: [f"{f.name} {f.dataType.simpleString()}" for f in s.fields] for name, s in TABLES.items() if table in (None, name)}
