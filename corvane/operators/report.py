"""Reports of a scan: SARIF, Markdown, JSON, for people and their tools.

What each says is a table first; the driver writes it row by row and holds one row at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import TYPES

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
LINES, MOST_LINES, MOST_WIDTH = 15, 200, 400
#: What to do about a type.
FIXES = {
    "null-deref": "Test the pointer before it is followed, and leave the function if it is null.",
    "buffer-overflow": "Give the copy the capacity of its target, and hold the length against it first.",
    "memory-leak": "Free the memory on every way out, or hand it to an owner.",
    "injection": "Pass arguments as a list or as bound parameters, not as text that a shell or database reads.",
    "resource-leak": "Close what was opened on every way out.",
    "uninit": "Give the variable a value where it is declared.",
    "use-after-free": "Set the pointer to null once it is freed, and don't use it after.",
    "double-free": "Set the pointer to null once it is freed, and let one owner free it.",
    "format-string": "Use a literal format, and pass the text as an argument.",
    "integer-overflow": "Hold the operands against a bound before they become a size.",
    "race-condition": "Hold one lock around every access, or act on an open file instead of its name.",
    "hardcoded-secret": "Read the secret from the environment or a vault.",
    "deadlock": "Take the locks in one order everywhere.",
    "crypto-misuse": "Use a current algorithm with a key of full length, and a secure random source.",
    "out-of-bounds": "Hold the index against the size first.",
    "divide-by-zero": "Test the divisor first.",
    "unchecked-return": "Test what the call returns before it is used.",
    "path-traversal": "Resolve the path and hold it against the folder that it must stay in.",
    "sizeof-misuse": "Take the size of what the pointer points to.",
    "signed-compare": "Compare values of one signedness.",
}


def context(source: str, line: int, around: int = LINES) -> str:
    """The lines around one, numbered, that one marked; long lines cut."""
    lines = source.split("\n")
    around = max(0, min(around, MOST_LINES))
    out = []
    for i in range(max(1, line - around), min(len(lines), line + around) + 1):
        text = lines[i - 1]
        out.append(f"{'>' if i == line else ' '} {i:5d} | {text if len(text) <= MOST_WIDTH else text[:MOST_WIDTH] + '...'}")
    return "\n".join(out)


def sarif(runs_results: list[dict], rules: dict[str, str]) -> dict:
    return {"$schema": SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "corvane", "rules": [{"id": k, "name": v, "shortDescription": {"text": v}} for k, v in sorted(rules.items())]}}, "results": runs_results}]}


def place(path: str, line: int) -> dict:
    return {"physicalLocation": {"artifactLocation": {"uri": path}, "region": {"startLine": max(int(line), 1)}}}


def candidate_results(rows: DataFrame) -> DataFrame:
    """(vuln_type, rank, rule_id, result): each candidate as a SARIF result at level note, in JSON; with a source elsewhere the way from it."""
    at = lambda line: F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(line, F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    step = lambda line: F.struct(at(line).alias("location"))
    flow = F.array(F.struct(F.array(F.struct(F.array(step(F.col("source_line")), step(F.col("line"))).alias("locations"))).alias("threadFlows")))
    mark = F.concat_ws(":", "cwe", "function", F.col("line").cast("string"))
    result = F.struct(
        F.col("cwe").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.concat("vuln_type", F.lit(": "), "variable", F.lit(" in "), "function").alias("text")).alias("message"),
        F.array(at(F.col("line"))).alias("locations"), F.struct(mark.alias("place")).alias("partialFingerprints"), F.struct(F.lit("candidate").alias("stage"), F.col("suspicion").alias("suspicion_level"), "score").alias("properties"),
        F.when((F.col("source_line") > 0) & (F.col("source_line") != F.col("line")), flow).alias("codeFlows"),
    )
    return rows.select("vuln_type", "rank", F.col("cwe").alias("rule_id"), F.to_json(result).alias("result"))


def candidate_sarif(rows: DataFrame) -> dict:
    """All results; the first type of a rule names it."""
    results, rules = [], {}
    for r in candidate_results(rows).orderBy("vuln_type", "rank").toLocalIterator():
        rules.setdefault(r["rule_id"], r["vuln_type"])
        results.append(json.loads(r["result"]))
    return sarif(results, rules)


def verdict_rows(findings: DataFrame, files: DataFrame | None = None, around: int = LINES) -> DataFrame:
    """Findings that are effectively confirmed (errors) or suspected (warnings): their message, and from files (path, source) the line and the lines around it."""
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    rows = findings.filter(F.col("effective").isin("confirmed", "suspected")).select("rule_id", "file_path", "line_number", "function_name", "confidence", "reasoning", "exception_check", "fix_strategy", F.when(F.col("effective") == "confirmed", "error").otherwise("warning").alias("level"), some("summary", "reasoning", "evidence", "function_name").alias("message"))
    if files is None:
        return rows.withColumns({"snippet": F.lit(None).cast("string"), "first_line": F.lit(None).cast("int"), "context": F.lit(None).cast("array<string>")})
    around = max(0, min(around, MOST_LINES))
    lines = F.split("source", "\n")
    start = F.greatest(F.col("line_number") - around, F.lit(1))
    shown = lambda x: F.when(F.length(x) > MOST_WIDTH, F.concat(F.substring(x, 1, MOST_WIDTH), F.lit("..."))).otherwise(x)
    texts = files.select(F.col("path").alias("file_path"), lines.alias("all_lines"))
    out = rows.join(texts, "file_path", "left")
    inside = F.col("line_number").between(1, F.size("all_lines"))
    out = out.withColumns({"snippet": F.when(inside, F.get("all_lines", F.col("line_number") - 1)), "first_line": F.when(inside, start), "context": F.when(inside, F.transform(F.slice("all_lines", start, F.col("line_number") + around - start + 1), shown))})
    return out.drop("all_lines")


def verdict_sarif(findings: DataFrame, files: DataFrame | None = None, around: int = LINES) -> dict:
    """Confirmed findings as errors, suspected ones as warnings, with the code where files are given."""
    results, rules = [], {}
    names = {f"CWE-{n}": t.name for t in TYPES.values() for n in (t.cwe, *t.legacy)}
    for r in verdict_rows(findings, files, around).orderBy("file_path", "line_number", "rule_id").toLocalIterator():
        kind = rules.setdefault(r["rule_id"], names.get(r["rule_id"], r["rule_id"]))
        where = place(r["file_path"], r["line_number"])
        if r["snippet"] is not None:
            where["physicalLocation"]["region"]["snippet"] = {"text": r["snippet"]}
            where["physicalLocation"]["contextRegion"] = {"startLine": r["first_line"], "endLine": r["first_line"] + len(r["context"]) - 1, "snippet": {"text": "\n".join(r["context"])}}
        x = {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": f"{kind} in {r['function_name']}: {r['message']}"}, "locations": [where], "fingerprints": {"place": f"{r['rule_id']}:{r['function_name']}:{r['line_number']}"}, "properties": {"confidence": r["confidence"]} | {k: r[k] for k in ("reasoning", "exception_check") if r[k]}}
        if r["fix_strategy"]:
            x["fixes"] = [{"description": {"text": r["fix_strategy"]}}]
        results.append(x)
    return sarif(results, rules)


def markdown(rows: DataFrame, stats: DataFrame, scan_id: str) -> str:
    by = defaultdict(list)
    for r in rows.orderBy("vuln_type", "rank").toLocalIterator():
        by[r["vuln_type"]].append(r)
    out = [f"# Scan {scan_id}", "", "| type | seeds | results |", "|-|-|-|"]
    out += [f"| {r['vuln_type']} | {r['seed_count']} | {r['final_count']} |" for r in stats.orderBy("vuln_type").collect()]
    for kind, found in by.items():
        out += ["", f"## {kind}", "", FIXES.get(kind, ""), "", "| rank | file | line | function | variable | suspicion | score |", "|-|-|-|-|-|-|-|"]
        out += [f"| {r['rank']} | {r['path']} | {r['line']} | {r['function']} | {r['variable']} | {r['suspicion']} | {r['score']:.1f} |" for r in found]
    return "\n".join(out) + "\n"


def audit_markdown(audit: DataFrame) -> str:
    rows = audit.orderBy(F.col("vuln_type") == "TOTAL", "vuln_type").collect()
    head = ["vuln_type", "seed_count", "final_count", "confirmed", "suspected", "dismissed", "open", "efficiency", "unclassified"]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)]) + "\n"


def summary(stats: DataFrame) -> str:
    """One line a type, and the sum."""
    rows = [r for r in stats.orderBy("vuln_type").collect() if r["seed_count"]]
    out = [f"{r['vuln_type']}: {r['seed_count']} seeds, {r['final_count']} results" for r in rows]
    return "\n".join([*out, f"total: {sum(r['seed_count'] for r in rows)} seeds, {sum(r['final_count'] for r in rows)} results"])


NAMES = {f"CWE-{n}": t.name for t in TYPES.values() for n in (t.cwe, *t.legacy)}
VERDICTS = ("confirmed", "suspected")


def latest_verdicts(findings: DataFrame) -> DataFrame:
    """Of each place (type, file, line, function) the row with the latest time; number counts the confirmed and suspected ones by place."""
    key = ["rule_id", "file_path", "line_number", "function_name"]
    said = F.struct("effective", "severity", "confidence", "summary", "reasoning", "evidence", "fix_strategy")
    latest = findings.groupBy(*key).agg(F.max_by(said, F.struct("created_at", "id")).alias("said"))
    return latest.select(*key, "said.*")


def short_name(path: str, line: int) -> str:
    return f"{os.path.basename(path).replace('.', '_')}_{line}"


def finding_text(r) -> str:
    kind = NAMES.get(r["rule_id"], r["rule_id"])
    return f"# {kind}: {r['function_name']}\n\n{r['file_path']}:{r['line_number']}, {r['effective']}, {r['severity']}, {r['rule_id']}\n\n{r['summary'] or r['reasoning'] or r['evidence'] or ''}\n\n{r['fix_strategy'] or FIXES.get(kind, '')}\n"


def put(path: str, text: str) -> bool:
    """Writes a file whole, and only if it says something else. Whether it did."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)
    return True


def reconcile(folder: str, findings: DataFrame) -> dict:
    """Makes folder/findings hold one file for each place's latest confirmed or suspected verdict, and no other.

    Run again, it changes nothing.
    """
    own = os.path.join(folder, "findings")
    os.makedirs(own, exist_ok=True)
    rows = latest_verdicts(findings).filter(F.col("effective").isin(*VERDICTS)).orderBy("rule_id", "file_path", "line_number", "function_name")
    wanted, changed = set(), 0
    for i, r in enumerate(rows.toLocalIterator(), 1):
        name = f"{i:03d}_{short_name(r['file_path'], r['line_number'])}_{r['effective']}.md"
        wanted.add(name)
        changed += put(os.path.join(own, name), finding_text(r))
    for name in set(os.listdir(own)) - wanted:
        os.remove(os.path.join(own, name))
        changed += 1
    return {"findings": len(wanted), "changed": changed}


def sync_finding(folder: str, finding) -> dict:
    """Brings folder in line with one verdict, a row of latest_verdicts().

    open: nothing. confirmed, suspected: its file is written under its number, files of the
    place's other verdicts go, and its candidate file is marked. dismissed: its files go, and
    the candidate is marked. Run again, it changes nothing.
    """
    effective = finding["effective"]
    if effective not in (*VERDICTS, "dismissed"):
        return {"written": 0, "removed": 0, "marked": 0}
    own, short = os.path.join(folder, "findings"), short_name(finding["file_path"], finding["line_number"])
    os.makedirs(own, exist_ok=True)
    old = sorted(n for n in os.listdir(own) if re.fullmatch(rf"\d+_{re.escape(short)}_[a-z]+\.md", n) and finding["function_name"] in open(os.path.join(own, n), encoding="utf-8").readline())
    written, keep = 0, None
    if effective in VERDICTS:
        number = int(old[0].split("_")[0]) if old else max((int(n.split("_")[0]) for n in os.listdir(own) if re.match(r"\d+_", n)), default=0) + 1
        keep = f"{number:03d}_{short}_{effective}.md"
        written = int(put(os.path.join(own, keep), finding_text(finding)))
    gone = [n for n in old if n != keep]
    for n in gone:
        os.remove(os.path.join(own, n))
    marked = 0
    kind = NAMES.get(finding["rule_id"], finding["rule_id"])
    there = os.path.join(folder, "candidates", kind)
    for n in sorted(os.listdir(there)) if os.path.isdir(there) else ():
        if re.fullmatch(rf"\d+_{re.escape(short)}\.md", n):
            with open(os.path.join(there, n), encoding="utf-8") as f:
                text = re.sub(r"^Verdict: .*\n\n", "", f.read())
            marked += put(os.path.join(there, n), f"Verdict: {effective}\n\n{text}")
    return {"written": written, "removed": len(gone), "marked": marked}


def point_to(folder: str, scan_id: str) -> None:
    """folder/latest leads to the scan, by one rename; without links latest.txt names it."""
    new = os.path.join(folder, f".latest-{os.getpid()}")
    try:
        if os.path.lexists(new):
            os.remove(new)
        os.symlink(scan_id, new)
        os.replace(new, os.path.join(folder, "latest"))
    except OSError:
        with open(f"{new}.txt", "w", encoding="utf-8") as f:
            f.write(scan_id)
        os.replace(f"{new}.txt", os.path.join(folder, "latest.txt"))


def write_scan(folder: str, scan_id: str, rows: DataFrame, stats: DataFrame, dropped: DataFrame, files: DataFrame, errors: DataFrame, around: int = LINES) -> dict:
    """All of a scan's files into folder/scan_id on the driver's machine, and a pointer to the latest."""
    own = os.path.join(folder, scan_id)
    os.makedirs(own, exist_ok=True)
    put(os.path.join(own, "candidates.sarif"), json.dumps(candidate_sarif(rows), indent=1))
    put(os.path.join(own, "report.md"), markdown(rows, stats, scan_id))
    with open(os.path.join(own, "dismissed.json"), "w", encoding="utf-8") as f:
        write_ledger(f, dropped)
    failed = 0
    with open(os.path.join(own, "errors.ndjson"), "w", encoding="utf-8") as f:
        for line in errors.orderBy("stage", "path").toJSON().toLocalIterator():
            f.write(line + "\n")
            failed += 1
    n = 0
    for r in rows.join(files.select("path", "source"), "path").orderBy("vuln_type", "rank").toLocalIterator():
        n += 1
        name = f"{r['rank']:03d}_{short_name(r['path'], r['line'])}.md"
        put(os.path.join(own, "candidates", r["vuln_type"], name), f"# {r['vuln_type']}: {r['variable']} in {r['function']}\n\n{r['path']}:{r['line']}, {r['suspicion']}, {r['cwe']}\n\n```c\n{context(r['source'], r['line'], around)}\n```\n\n{FIXES.get(r['vuln_type'], '')}\n")
    point_to(folder, scan_id)
    return {"scan_id": scan_id, "folder": own, "results": n, "failed": failed}


def write_ledger(out: TextIO, dropped: DataFrame) -> None:
    """{type: {filter: {rows, dropped}}} as JSON, a dropped candidate at a time."""
    now, n = (None, None), 0
    out.write("{")
    for r in dropped.orderBy("vuln_type", "filter", "path", "line", "function", "variable").toLocalIterator():
        at = (r["vuln_type"], r["filter"])
        if at != now:
            if now[1] is not None:
                out.write(f'], "dropped": {n}}}')
            if at[0] != now[0]:
                out.write(("" if now[0] is None else "}, ") + f"{json.dumps(at[0])}: {{")
            else:
                out.write(", ")
            out.write(f'{json.dumps(at[1])}: {{"rows": [')
            now, n = at, 0
        out.write((", " if n else "") + json.dumps({k: r[k] for k in ("path", "line", "function", "variable")}))
        n += 1
    if now[1] is not None:
        out.write(f'], "dropped": {n}}}}}')
    out.write("}\n")
