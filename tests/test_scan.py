"""Whole scans: source tree to candidates, store, reports, command line, stream."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.engine import Engine
from corvane.operators import closure, ordered, report, sqlguard
from corvane.operators.store import Store
from corvane.plans import engine as plans
from corvane.plans import kernel
from corvane.plans.registry import TYPES, type_of_cwe
from corvane.sources.tree import changed, read_tree
from corvane.streaming import watch

A = """#include <stdlib.h>
struct s { int x; };
static int helper(struct s *p) {
  return p->x;
}
struct s *make(int n) {
  if (n < 0)
    return NULL;
  return malloc(sizeof(struct s));
}
int use(int n) {
  struct s *p = make(n);
  return p->x;
}
int guarded(int n) {
  struct s *p = make(n);
  if (!p)
    return 0;
  return p->x;
}
void after(void) {
  char *b = malloc(10);
  if (!b)
    return;
  free(b);
  b[0] = 1;
}
void fresh(void) {
  char *b = malloc(10);
  if (!b)
    return;
  free(b);
  b = malloc(3);
  b[0] = 1;
}
static void run(char *cmd) {
  system(cmd);
}
static void unused(char *cmd) {
  system(cmd);
}
static void calm(char *cmd) {
  system(cmd);
}
void caller(void) {
  calm("ls");
}
int divide(int a) {
  int b = 4;
  return a / b;
}
int main(void) {
  char *e = getenv("X");
  run(e);
  return helper(0);
}
"""
B = """static pthread_mutex_t m1, m2;
void one(void) {
  pthread_mutex_lock(&m1);
  pthread_mutex_lock(&m2);
  pthread_mutex_unlock(&m2);
  pthread_mutex_unlock(&m1);
}
void two(void) {
  pthread_mutex_lock(&m2);
  pthread_mutex_lock(&m1);
  pthread_mutex_unlock(&m1);
  pthread_mutex_unlock(&m2);
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in (("a.c", A), ("sub/b.C", B), ("vendor/c.c", A), ("x.txt", "no")):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def scan(spark, tree):
    return plans.scan(spark, tree)


def test_tree_and_change_detection(spark, tree):
    files = read_tree(spark, tree)
    assert sorted(os.path.basename(r.path) for r in files.collect()) == ["a.c", "b.C"]
    assert read_tree(spark, tree, exclude=()).count() == 3
    assert files.filter("path like '%a.c'").first()["loc"] == A.count("\n") + 1
    old = files.select("path", F.when(F.col("path").endswith("a.c"), "old").otherwise(F.col("checksum")).alias("checksum"))
    assert [os.path.basename(r.path) for r in changed(files, old).collect()] == ["a.c"]


def test_unchanged_files_keep_their_facts(spark, scan):
    files = scan.files
    stored = files.select("path", F.when(F.col("path").endswith("a.c"), "old").otherwise(F.col("checksum")).alias("checksum"))
    old = scan.facts.withColumn("note", F.lit("kept"))
    now = kernel.refreshed(old, stored, files)
    assert now.count() == scan.facts.count()
    kept = {r[0]: r[1] for r in now.groupBy(F.element_at(F.split("path", "/"), -1), ).agg(F.max((F.col("note") == "kept").cast("int"))).collect()}
    assert kept == {"a.c": 0, "b.C": 1}


def test_results(scan):
    rows = scan.ranked.collect()
    got = {(r.vuln_type, r.function, r.line) for r in rows}
    assert {("null-deref", "use", 13), ("use-after-free", "after", 26), ("injection", "run", 37)} <= got
    assert not {f for t, f, _ in got} & {"guarded", "fresh", "calm", "unused", "divide"} - {"fresh"}
    assert ("use-after-free", "fresh", 34) not in got
    by = {(r.vuln_type, r.function): r for r in rows}
    assert by["injection", "run"].suspicion == "confirmed" and by["use-after-free", "after"].suspicion == "confirmed"
    assert by["null-deref", "use"].source_line == 12 and by["injection", "run"].cwe == "CWE-78"
    assert any(t == "deadlock" for t, _, _ in got)
    assert not scan.facts.filter("record = 'error'").count() and not scan.candidates.filter("error is not null").count()


def test_every_seed_is_kept_or_in_the_ledger(scan):
    stats = {r.vuln_type: r for r in scan.stats().collect()}
    assert set(stats) == set(TYPES)
    dropped = {r[0]: r[1] for r in scan.dropped().groupBy("vuln_type").count().collect()}
    for t, r in stats.items():
        assert r.seed_count == r.passed + dropped.get(t, 0) and r.final_count <= r.passed
    assert {(r.vuln_type, r["filter"]): r.dropped for r in scan.ledger().collect()} == {(r.vuln_type, r["filter"]): r["count"] for r in scan.dropped().groupBy("vuln_type", "filter").count().collect()}
    ledger = {(r.vuln_type, r["filter"]) for r in scan.ledger().collect()}
    assert {("injection", "call_reach"), ("injection", "taint_source"), ("divide-by-zero", "range")} <= ledger


def test_scan_doesn_t_depend_on_how_files_are_dealt(spark, scan, tree):
    again = plans.scan_files(read_tree(spark, tree).repartition(5))
    cols = ["vuln_type", "path", "function", "line", "variable", "suspicion", "score", "rank"]
    assert sorted(map(tuple, again.ranked.select(cols).collect())) == sorted(map(tuple, scan.ranked.select(cols).collect()))


def test_graph(scan):
    e = {(r.edge_type, r.src, r.dst) for r in scan.edges.collect()}
    assert {("CALL", "main", "run"), ("RELEASE", "b", "free"), ("LOCK_ORDER", "m1", "m2"), ("RETURN", "make", "p"), ("PARAM_BINDING", "e", "run#0")} <= e
    assert scan.nodes.count() == scan.nodes.select("id").distinct().count()


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    start = spark.createDataFrame([("r", "a")], "root string, node string")
    assert sorted(r.node for r in closure.reach(edges, start).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.node for r in closure.reach(edges, start, small=0).collect()) == ["a", "b", "c", "d"]
    for small in (0, 100):
        assert {(r.node, r.component) for r in closure.strong_components(edges, small=small).collect()} == {(x, "a") for x in "abc"}
        assert closure.strong_components(edges.filter("src = 'c'"), small=small).count() == 0
    pairs = spark.createDataFrame([("a", "c"), ("a", "d"), ("e", "e")], "a string, b string")
    assert [tuple(r) for r in closure.mutual(pairs, edges).collect()] == [("a", "c")]


def test_both_ways_through_a_graph_agree(spark):
    import random

    rng = random.Random(3)
    for n, m in ((30, 40), (40, 70), (12, 60)):
        rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges = spark.createDataFrame(rows, "src long, dst long")
        after = {i: {b for a, b in rows if a == i} for i in range(n)}
        reached = {}
        for i in range(n):
            seen, stack = {i}, [i]
            while stack:
                for b in after[stack.pop()] - seen:
                    seen.add(b)
                    stack.append(b)
            reached[i] = seen
        want = {(i, min(j for j in reached[i] if i in reached[j])) for i in range(n) if any(i in reached[j] for j in reached[i] - {i})}
        for small in (0, 1000):
            assert {tuple(r) for r in closure.strong_components(edges, small=small).collect()} == want
        start = spark.createDataFrame([(r, r) for r in (0, 1, n + 5)], "root long, node long")
        for small in (0, 1000):
            assert {tuple(r) for r in closure.reach(edges, start, small=small).collect()} == {(r, x) for r in (0, 1) for x in reached[r]} | {(n + 5, n + 5)}


def test_numbers_and_neighbours_over_ranges(spark):
    rows = [(k, i * 7 % 50, i) for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(3)
    got = {(r.k, r.n): r.at for r in ordered.numbered(df, ["k"], [F.col("at").desc(), F.col("v")], "n").collect()}
    assert got == {(k, i + 1): 49 - i for k in ("a", "b", None) for i in range(50)}
    near = {(r.k, r.at): r.after for r in ordered.following(df, ["k"], ["at", "v"], {"after": "at"}).collect()}
    assert near == {(k, i): i + 1 if i < 49 else None for k in ("a", "b", None) for i in range(50)}


def test_store_verdicts_and_audit(spark, tree, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    out = engine.scan(tree, output=str(tmp_path / "out"), scan_id="sc_2026-01-01_000000_abcdef")
    sid = out["scan_id"]
    assert out["errors"] == {} and out["failed"] == 0
    path = f"{tree}/a.c"
    item = {"rule_id": "CWE-476", "severity": "HIGH", "confidence": 80, "status": "fp", "file": path, "line": 13, "function": "use"}
    reply = engine.store.write_findings([item, {"rule_id": "CWE-1"}, {**item, "rule_id": "CWE-78", "line": 37, "function": "run", "status": "confirmed"}], sid)
    assert reply["written"] == 2 and reply["status"] == "partial"
    first = engine.store.effective().filter("line_number = 13").first()
    assert first.effective == "dismissed" and first.confidence == 0.8 and first.severity == "high"
    engine.store.review(first.id, "suspected-kept", "look again")
    engine.store.write_findings([{**item, "summary": "s"}], sid)
    again = engine.store.effective().filter("line_number = 13").first()
    assert (again.id, again.review_status, again.summary, again.effective) == (first.id, "suspected-kept", "s", "suspected")
    audit = {r.vuln_type: r for r in engine.store.audit(sid).collect()}
    assert audit["injection"].confirmed == 1 and audit["TOTAL"].suspected == 1 and audit["TOTAL"].seed_count > 0
    folder = str(tmp_path / "out" / sid)
    assert report.reconcile(folder, engine.store.effective()) == {"findings": 2, "changed": 2}
    assert report.reconcile(folder, engine.store.effective()) == {"findings": 2, "changed": 0}
    assert engine.gate(sid, "confirmed") == 2 and engine.store.latest_scan() == sid

    engine.store.review(first.id, "dismissed")
    said = report.latest_verdicts(engine.store.effective().filter(F.col("id") == first.id)).first()
    assert report.sync_finding(folder, said) == {"written": 0, "removed": 1, "marked": 1}
    assert report.sync_finding(folder, said) == {"written": 0, "removed": 0, "marked": 0}
    engine.store.review(first.id, "confirmed")
    said = report.latest_verdicts(engine.store.effective().filter(F.col("id") == first.id)).first()
    assert report.sync_finding(folder, said) == {"written": 1, "removed": 0, "marked": 1}
    engine.store.review(first.id, "dismissed")
    assert report.reconcile(folder, engine.store.effective())["findings"] == 1

    ranked = engine.store.read("results")
    assert engine.store.suppressed(ranked).filter("vuln_type = 'null-deref' and line = 13").count() == 0
    assert engine.store.suppressed(ranked, baseline=sid).filter("function = 'run'").count() == 0
    sarif = json.loads((tmp_path / "out" / sid / "candidates.sarif").read_text())
    assert sarif["version"] == "2.1.0" and all(r["level"] == "note" for r in sarif["runs"][0]["results"])
    assert any("codeFlows" in r for r in sarif["runs"][0]["results"])
    [verdict] = report.verdict_sarif(engine.store.effective(), read_tree(spark, tree), 1)["runs"][0]["results"]
    region = verdict["locations"][0]["physicalLocation"]
    assert verdict["level"] == "error" and region["region"]["snippet"]["text"] == "  system(cmd);"
    assert region["contextRegion"] == {"startLine": 36, "endLine": 38, "snippet": {"text": "static void run(char *cmd) {\n  system(cmd);\n}"}}
    assert (tmp_path / "out" / "latest" / "report.md").exists() and list((tmp_path / "out" / sid / "candidates").iterdir())
    dropped = json.loads((tmp_path / "out" / sid / "dismissed.json").read_text())
    assert all(len(f["rows"]) == f["dropped"] for t in dropped.values() for f in t.values()) and "taint_source" in dropped["injection"]
    spark.range(3).createOrReplaceTempView("findings")
    text = io.StringIO()
    engine.sql_to("SELECT count(*) AS n FROM findings", text)
    assert json.loads(text.getvalue()) == {"columns": ["n"], "rows": [{"n": 2}], "count": 1}
    assert spark.sql("SELECT count(*) FROM findings").first()[0] == 3
    assert [f.type for f in engine.plan("injection").first()["evidence"]] == ["unsafe_call", "call_path", "taint_source"]
    assert engine.schema("findings")["findings"][0] == "id bigint"
    with pytest.raises(ValueError):
        engine.schema("nothing")


def test_scans_again_parse_only_what_has_changed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.c").write_text(A)
    (src / "b.c").write_text(B)
    engine = Engine(spark, f"file://{tmp_path}/store")
    one = engine.scan(str(src))
    engine.store.change(lambda read: {"facts": read("facts").withColumn("note", F.when(F.col("record") == "function", "").otherwise(F.col("note"))).withColumn("end_line", F.lit(999))})
    (src / "b.c").write_text(B + "int extra(int a, int b) {\n  return a / b;\n}\n")
    two = engine.scan(str(src))
    rows = engine.store.read("facts").groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.min("end_line").alias("least")).collect()
    assert {r.f: r.least == 999 for r in rows} == {"a.c": True, "b.c": False}
    assert two["types"]["divide-by-zero"] == one["types"].get("divide-by-zero", 0) + 1
    assert engine.index(str(src))["files"] == 2 and engine.store.read("function_summary").filter("function = 'make' and return_nullable").count() == 1


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = lambda n: spark.createDataFrame([(f"f{i}", "c", 1) for i in range(n)], "path string, checksum string, loc int")
    store.replace("files", files(2))
    before = store.read("files")
    with pytest.raises(ZeroDivisionError):
        store.change(lambda read: {"files": files(5).limit(1 // 0)})
    assert store.count("files") == 2
    other = Store(spark, f"file://{tmp_path}/store")
    turns = []

    def make(read):
        turns.append(read("files").count())
        if len(turns) == 1:  # another writer comes first
            other.append("files", files(3))
        return {"files": read("files").unionByName(files(1))}

    store.change(make)
    assert turns == [2, 5] and store.count("files") == 6 and before.count() == 2
    assert [r.path for r in store.find("files", path="f0").collect()] == ["f0"] * 3
    for _ in range(20):
        store.append("files", files(1))
    assert store.count("files") == 26 and len(store._versions()) == 3
    store.delete_files("files", spark.createDataFrame([("f0",)], "path string"))
    assert store.count("files") == 3
    store.clear("files")
    assert store.count("files") == 0


def test_sql_guard():
    assert sqlguard.checked(" with a as (select 1) select * from a; ") == "with a as (select 1) select * from a"
    for bad in ("DROP TABLE x", "select * from Security_Events", "select 1; select 2", "selection"):
        with pytest.raises(sqlguard.Refused):
            sqlguard.checked(bad)


def test_registry_and_context():
    assert len(TYPES) == 20 and type_of_cwe("CWE-89") == "injection" and type_of_cwe("338") == "crypto-misuse" and type_of_cwe("1") is None
    text = report.context("\n".join(f"l{i}" for i in range(1, 50)) + "\n" + "x" * 500, 50, 2)
    assert text.splitlines()[0].endswith("| l48") and text.splitlines()[2].startswith(">") and text.endswith("...")


def test_command_line(spark, tree, tmp_path, capsys):
    store = ["--store", f"file://{tmp_path}/cli"]
    assert cli.run([*store, "types"]) == 0
    assert json.loads(capsys.readouterr().out)["null-deref"] == "CWE-476"
    assert cli.run([*store, "scan", tree, "--scan-id", "mine"], spark) == 1
    assert "scan id" in json.loads(capsys.readouterr().out)["error"]
    assert cli.run([*store, "scan", tree, "--output-dir", str(tmp_path / "out")], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["types"]["injection"] == 1
    log = [json.loads(x) for x in (tmp_path / "out" / out["scan_id"] / "scan.log").read_text().splitlines()]
    assert log[0]["level"] == "INFO" and out["scan_id"] in log[0]["message"]
    assert cli.run([*store, "report", "--audit"], spark) == 0
    assert "| TOTAL |" in capsys.readouterr().out
    assert cli.run([*store, "report", "--write", "--rule-id", "cwe-78", "--status", "tp", "--file", f"{tree}/a.c", "--line", "37", "--function", "run", "--properties", '{"reasoning": "r"}'], spark) == 0
    assert json.loads(capsys.readouterr().out)["written"] == 1
    assert cli.run([*store, "report", "--status", "confirmed"], spark) == 0
    assert json.loads(capsys.readouterr().out)["reasoning"] == "r"
    assert cli.run([*store, "report", "--write", "--rule-id", "CWE-1"], spark) == 1
    capsys.readouterr()
    assert cli.run([*store, "plan", "injection", "--output-dir", str(tmp_path)], spark) == 0
    plan = json.loads(capsys.readouterr().out)
    assert plan["candidates"] == 1 and json.loads(open(plan["file"]).read())["candidates"][0]["function"] == "run"
    assert cli.run([*store, "query", "injection"], spark) == 0
    assert json.loads(capsys.readouterr().out)["function"] == "run"
    assert cli.run([*store, "db", "SELECT count(*) AS n FROM functions"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"n": 14}]
    assert cli.run([*store, "schema", "files"], spark) == 0
    assert list(json.loads(capsys.readouterr().out)) == ["files"]
    assert cli.run([*store, "schema", "none"], spark) == 1
    capsys.readouterr()
    assert cli.run([*store, "status"], spark) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 2
    with pytest.raises(TimeoutError):
        cli.within(spark, 0.2, lambda: spark.range(1 << 40).selectExpr("sum(sqrt(id))").collect())


def test_stream_extracts_each_file_once(spark, tree, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.c").write_text(A)
    args = (spark, str(src), str(tmp_path / "facts"), str(tmp_path / "ck"))
    watch.watch(*args).awaitTermination()
    (src / "b.c").write_text(B)
    watch.watch(*args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "facts")).filter("record = 'function'").groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).count().collect()
    assert {r.f: r["count"] for r in rows} == {"a.c": 12, "b.c": 2}
