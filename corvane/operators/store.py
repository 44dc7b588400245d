"""The store: tables as Parquet folders, and a catalog that names each table's folders.

A change writes new folders first and then a new version of the catalog, as a folder that is
renamed into place. The rename is atomic and fails if another writer has made that version,
so a change of several tables is seen whole or not at all, a lost writer leaves no trace but
unnamed folders, and of two writers at once the second does its change anew. The catalog's
last versions, with their folders, are kept for readers that have begun.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import confidence, effective_status
from ..plans.registry import TYPES, known_cwes
from .merging import upsert

KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "map": T.MapType(T.StringType(), T.StringType())}


def struct(columns: str) -> T.StructType:
    """A schema of "name type, .." without a session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


FINDINGS = struct("id long, rule_id string, severity string, confidence double, evidence string, status string, file_path string, line_number int, function_name string, properties string, summary string, reasoning string, fix_strategy string, exception_check string, review_status string, review_reasoning string, scan_id string, created_at long")
STATS = struct("id long, scan_id string, vuln_type string, seed_count long, final_count long, filter_chain string, created_at long")
FILES = struct("path string, checksum string, loc int")
FACTS = struct("path string, record string, function string, kind string, line int, end_line int, col int, src string, dst string, note string, props map, detector string")
FUNCTIONS = struct("path string, name string, signature string, return_type string, is_static boolean, start_line int, end_line int")
EVENTS = struct("path string, function string, event_type string, line int, col int, props map, detector string")
EDGES = struct("path string, function string, edge_type string, line int, src_kind string, src_owner string, src string, dst_kind string, dst_owner string, dst string, note string, src_id long, dst_id long")
NODES = struct("id long, entity_type string, owner string, name string")
SUMMARIES = struct("function string, return_nullable boolean, return_tainted boolean, tainted_params string")
RESULTS = struct("scan_id string, vuln_type string, path string, function string, line int, col int, variable string, api string, category string, suspicion string, source_line int, definite boolean, props map, cwe string, score double, rank long")
TABLES = {"findings": FINDINGS, "scan_stats": STATS, "files": FILES, "facts": FACTS, "functions": FUNCTIONS, "security_events": EVENTS, "graph_edges": EDGES, "graph_nodes": NODES, "function_summary": SUMMARIES, "results": RESULTS}
#: The order that lists of a table come in.
ORDER = {"findings": ["id"], "scan_stats": ["scan_id", "vuln_type"], "files": ["path"], "facts": ["path", "record", "line", "col"], "functions": ["path", "start_line"], "security_events": ["path", "line", "col", "event_type"], "graph_edges": ["edge_type", "path", "line", "src", "dst"], "graph_nodes": ["id"], "function_summary": ["function"], "results": ["scan_id", "vuln_type", "rank"]}
VERSIONS_KEPT, TRIES, PARTS_KEPT = 3, 20, 16
KEY = ["scan_id", "rule_id", "file_path", "line_number", "function_name"]
REVIEWS = ("confirmed", "dismissed", "suspected-kept")
STATUSES = ("open", "confirmed", "suspected", "dismissed")
SPELLINGS = {"fp": "dismissed", "false-positive": "dismissed", "false_positive": "dismissed", "tp": "confirmed", "true-positive": "confirmed", "suspected-kept": "suspected", "likely": "suspected"}


def verdict(word: str) -> str:
    word = (word or "open").strip().lower()
    return SPELLINGS.get(word, word)


class Conflict(RuntimeError):
    """Other writers were always first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- catalog

    def _hadoop(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop().makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names])))

    def _versions(self) -> list[int]:
        fs, p = self._hadoop(), self._path("catalog")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{12}", n))

    def _tables(self, version: int) -> dict[str, list[str]]:
        stream = self._hadoop().open(self._path("catalog", f"v{version:012d}", "tables.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, tables: dict[str, list[str]]) -> bool:
        """Whether this catalog has become the version; not if another one has."""
        fs, jvm = self._hadoop(), self.spark._jvm
        staged = f"staged-{uuid.uuid4().hex}"
        out = fs.create(self._path("catalog", staged, "tables.json"), True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        place = self._path("catalog", f"v{version:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path("catalog", staged), place, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()) and not fs.exists(place):
                raise
            fs.delete(self._path("catalog", staged), True)
            return False

    def _forget(self) -> None:
        """Deletes the catalog's old versions, and the folders that only they name."""
        versions = self._versions()
        old, kept = versions[:-VERSIONS_KEPT], versions[-VERSIONS_KEPT:]
        if not old:
            return
        named = {f for v in kept for fs in self._tables(v).values() for f in fs}
        for v in old:
            try:
                folders = {f for fs in self._tables(v).values() for f in fs}
            except Py4JJavaError:  # another writer is deleting it too
                continue
            for f in folders - named:
                self._hadoop().delete(self._path(*f.split("/")), True)
            self._hadoop().delete(self._path("catalog", f"v{v:012d}"), True)

    # ---- tables

    def _read(self, tables: dict[str, list[str]], table: str) -> DataFrame:
        folders = tables.get(table)
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, table: str) -> DataFrame:
        versions = self._versions()
        return self._read(self._tables(versions[-1]) if versions else {}, table)

    def change(self, make: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]], append: Iterable[str] = ()) -> None:
        """One transaction: make(read) gives tables' new rows, all seen at once or, if anything fails, none.

        read gives the tables as they were when the transaction began. Rows of a table in
        `append` are added to it, the others replace theirs.
        """
        for _ in range(TRIES):
            versions = self._versions()
            tables = self._tables(versions[-1]) if versions else {}
            new = dict(tables)
            for table, rows in make(lambda name, t=tables: self._read(t, name)).items():
                names = [f.name for f in TABLES[table].fields]
                rows = rows.select(*(F.col(n).cast(TABLES[table][n].dataType).alias(n) for n in names))
                before = tables.get(table, []) if table in append else []
                if len(before) >= PARTS_KEPT:
                    rows, before = self._read(tables, table).unionByName(rows), []
                folder = f"{table}/{uuid.uuid4().hex}"
                rows.write.parquet(f"{self.root}/{folder}")
                new[table] = [*before, folder]
            if self._commit((versions[-1] if versions else 0) + 1, new):
                self._forget()
                return
        raise Conflict(f"other writers were first {TRIES} times")

    def replace(self, table: str, rows: DataFrame) -> None:
        self.change(lambda _: {table: rows})

    def append(self, table: str, rows: DataFrame) -> None:
        self.change(lambda _: {table: rows}, [table])

    def clear(self, table: str) -> None:
        self.change(lambda read: {table: read(table).limit(0)})

    def delete_files(self, table: str, paths: DataFrame) -> None:
        """Deletes the rows of the files in paths (path)."""
        self.change(lambda read: {table: read(table).join(paths.select("path").distinct(), "path", "left_anti")})

    def find(self, table: str, **wanted) -> DataFrame:
        """The rows whose columns have the wanted values, in the table's order."""
        rows = self.read(table)
        for column, value in wanted.items():
            rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
        return rows.orderBy(*ORDER[table])

    def count(self, table: str, **wanted) -> int:
        return self.find(table, **wanted).count()

    def merge_summaries(self, new: DataFrame) -> None:
        """Upserts by function: a column that new leaves null keeps its value."""

        def make(read):
            old = read("function_summary")
            columns = [c for c in old.columns if c != "function"]
            given = new.select("function", *(F.col(c) if c in new.columns else F.lit(None).cast(SUMMARIES[c].dataType).alias(c) for c in columns))
            both = old.withColumn("turn", F.lit(0)).unionByName(given.withColumn("turn", F.lit(1)))
            return {"function_summary": both.groupBy("function").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c) for c in columns))}

        self.change(make)

    # ---- findings

    def write_findings(self, items: Iterable[dict], scan_id: str) -> dict:
        """Upserts verdicts by (scan, rule, file, line, function). Returns how many were taken, and the errors of the others."""
        good, errors = [], []
        known = known_cwes()
        for i, x in enumerate(items):
            rule, status = str(x.get("rule_id", "")).upper(), verdict(x.get("status", "open"))
            if rule not in known:
                errors.append({"index": i, "error": f"unknown rule {rule}"})
            elif status not in STATUSES:
                errors.append({"index": i, "error": f"unknown status {status}"})
            else:
                good.append((rule, str(x.get("severity", "medium")).lower(), float(x.get("confidence", 0.5)), x.get("evidence", ""), status, x.get("file", ""), int(x.get("line", 0)), x.get("function", ""), json.dumps(x.get("properties", {})), x.get("summary", ""), x.get("reasoning", ""), x.get("fix_strategy", ""), x.get("exception_check", "")))
        if good:
            names = "rule_id string, severity string, confidence double, evidence string, status string, file_path string, line_number int, function_name string, properties string, summary string, reasoning string, fix_strategy string, exception_check string"
            self.merge_findings(self.spark.createDataFrame(good, names), scan_id)
        return {"written": len(good), "errors": errors, "status": "partial" if errors and good else "error" if errors else "ok"}

    def merge_findings(self, rows: DataFrame, scan_id: str) -> None:
        """Upserts verdicts of a known rule and status by (scan, rule, file, line, function); columns that rows hasn't are empty. What was reviewed stays reviewed."""
        given = [c for c in rows.columns if c in FINDINGS.names]
        new = rows.filter(F.upper("rule_id").isin(*sorted(known_cwes())) & F.col("status").isin(*STATUSES)).select(*given, *(F.lit("").alias(f.name) for f in FINDINGS.fields if f.name not in given and f.dataType == T.StringType() and not f.name.startswith("review")))
        new = new.withColumns({"rule_id": F.upper("rule_id"), "confidence": confidence(F.col("confidence")), "scan_id": F.lit(scan_id), "created_at": F.lit(int(time.time())).cast("long")})
        new = new.dropDuplicates(KEY).withColumn("id", F.xxhash64(*KEY))
        self.change(lambda read: {"findings": upsert(read("findings"), new, KEY, ["id", "review_status", "review_reasoning", "created_at"])})

    def review(self, finding_id: int, status: str, reasoning: str = "") -> None:
        if status not in REVIEWS:
            raise ValueError(f"unknown review {status}")
        self.review_all(self.spark.createDataFrame([(finding_id, status, reasoning)], "id long, review_status string, review_reasoning string"))

    def review_all(self, reviews: DataFrame) -> None:
        """Sets the reviews (id, review_status, review_reasoning) of findings; one for each id, with a known word."""
        said = reviews.filter(F.col("review_status").isin(*REVIEWS)).dropDuplicates(["id"]).select("id", F.col("review_status").alias("new_status"), F.col("review_reasoning").alias("new_reasoning"))

        def make(read):
            rows = read("findings").join(said, "id", "left")
            return {"findings": rows.withColumns({"review_status": F.coalesce("new_status", "review_status"), "review_reasoning": F.coalesce("new_reasoning", "review_reasoning")})}

        self.change(make)

    def effective(self) -> DataFrame:
        return self.read("findings").withColumn("effective", effective_status(F.col("status"), F.col("review_status")))

    def latest_scan(self) -> str | None:
        """The scan whose counts were stored last; of equal times that of the larger row id."""
        row = self.read("scan_stats").agg(F.max_by("scan_id", F.struct("created_at", "id"))).first()
        return row[0] if row else None

    def stats_rows(self, stats: DataFrame, scan_id: str) -> DataFrame:
        """A row of scan_stats for each type."""
        chains = self.spark.createDataFrame([(t.name, json.dumps(list(t.filters))) for t in TYPES.values()], "vuln_type string, filter_chain string")
        return stats.join(F.broadcast(chains), "vuln_type").select(F.xxhash64(F.lit(scan_id), "vuln_type").alias("id"), F.lit(scan_id).alias("scan_id"), "vuln_type", "seed_count", "final_count", "filter_chain", F.lit(int(time.time())).cast("long").alias("created_at"))

    # ---- against results

    def suppressed(self, rows: DataFrame, baseline: str | None = None) -> DataFrame:
        """rows (path, line, cwe, ..) less what was dismissed, and what the baseline scan already had."""
        found = self.effective()
        key = lambda f: f.select(F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.upper("rule_id").alias("cwe")).distinct()
        rows = rows.join(key(found.filter("effective = 'dismissed'")), ["path", "line", "cwe"], "left_anti")
        if baseline:
            rows = rows.join(key(found.filter(F.col("scan_id") == baseline)), ["path", "line", "cwe"], "left_anti")
        return rows

    def audit(self, scan_id: str) -> DataFrame:
        """Per type, and in all: seeds, results, verdicts, and the share of seeds that the chain has dropped."""
        cwe = self.spark.createDataFrame([(f"CWE-{n}", t.name) for t in TYPES.values() for n in (t.cwe, *t.legacy)], "rule_id string, vuln_type string")
        found = self.effective().filter(F.col("scan_id") == scan_id).join(F.broadcast(cwe), "rule_id")
        counts = found.groupBy("vuln_type").agg(*(F.count(F.when(F.col("effective") == s, 1)).alias(s) for s in ("confirmed", "suspected", "dismissed", "open")))
        stats = self.read("scan_stats").filter(F.col("scan_id") == scan_id).select("vuln_type", "seed_count", "final_count")
        rows = stats.join(counts, "vuln_type", "left").na.fill(0)
        sums = rows.rollup("vuln_type").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "vuln_type"))
        return sums.select(F.coalesce("vuln_type", F.lit("TOTAL")).alias("vuln_type"), "seed_count", "final_count", "confirmed", "suspected", "dismissed", "open", F.round(F.when(F.col("seed_count") > 0, 100 * (1 - F.col("final_count") / F.col("seed_count"))).otherwise(0.0), 1).alias("efficiency"), F.greatest(F.col("final_count") - F.col("confirmed") - F.col("suspected") - F.col("dismissed"), F.lit(0)).alias("unclassified"))


SCAN_ID = re.compile(r"sc_\d{4}-\d{2}-\d{2}_\d{6}_[0-9a-f]{6}")


def new_scan_id() -> str:
    return time.strftime("sc_%Y-%m-%d_%H%M%S_") + uuid.uuid4().hex[:6]


def checked_scan_id(given: str | None) -> str:
    """The given id if it has the form of one, a new one for none."""
    if given is not None and not SCAN_ID.fullmatch(given):
        raise ValueError(f"{given} isn't a scan id like {new_scan_id()}")
    return given or new_scan_id()
