"""Scans of generated C: every detector, builder and filter over the programs of ccases, with SQL that foretells its rows.

A row of the table `part` becomes the program of one case: by its key the case, by its size
the folder. Each query finds what it asks for in all of them, and no more; parts once found
serve the session's later queries over the same folder of tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ccases import CASES
from .functions import scalars as S
from .operators import graph, report
from .plans import engine as plans
from .plans import probes
from .plans.registry import FRAGMENTS, TYPES
from .plans.summaries import EDGES
from .plans.verdicts import FLOW_FILTERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTS: dict[tuple[str, str], plans.Parts] = {}
SCANS: dict[tuple[str, str], plans.Scan] = {}


def programs(part: DataFrame) -> DataFrame:
    """path, checksum, loc and source of each part's program."""
    rows = [(i, f"{c.name}_", f"_{n}.c", text) for i, c in enumerate(CASES) for n, text in enumerate(c.files, 1)]
    texts = part.sparkSession.createDataFrame(rows, "case_no int, before string, after string, text string")
    k = F.col("p_partkey").cast("string")
    own = part.select("p_partkey", "p_size", (F.col("p_partkey") % len(CASES)).cast("int").alias("case_no")).join(F.broadcast(texts), "case_no")
    source = F.replace("text", F.lit("{k}"), k)
    path = F.concat(F.lit("src/d"), F.col("p_size").cast("string"), F.lit("/"), F.col("before"), k, F.col("after"))
    return own.select(path.alias("path"), F.sha2(source, 256).alias("checksum"), S.line_count(source).alias("loc"), source.alias("source"))


def parts(spark: SparkSession, sf_dir: str) -> plans.Parts:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in PARTS:
        PARTS[key] = plans.Parts(programs(spread(spark.read.parquet(f"{sf_dir}/part.parquet"))))
    return PARTS[key]


def scan(spark: SparkSession, sf_dir: str) -> plans.Scan:
    """The whole scan, with everything that the parts have."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in SCANS:
        SCANS[key] = parts(spark, sf_dir).whole()
    return SCANS[key]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few bytes that make many, dealt to all tasks."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))


# ---- what the cases must give, as SQL


def values(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def facts_of(kind: str) -> Iterator[tuple]:
    """(case number, words) of each line of a case's events, edges or results."""
    for i, c in enumerate(CASES):
        for line in getattr(c, kind).strip().splitlines():
            yield i, ["" if w == "-" else w for w in line.split("|")]


def foretold(rows: list[tuple], columns: str, select: str) -> str:
    """SQL of `select` over each part's rows among those of its case: (case_no, file_no, columns..), with path, and {k} filled in by own()."""
    return f"""
WITH told(case_no, file_no, {columns}) AS (VALUES {values(rows)}),
names(case_no, case_name) AS (VALUES {values([(i, c.name) for i, c in enumerate(CASES)])}),
rows AS (
  SELECT told.*, CAST(p_partkey AS VARCHAR) AS k, 'src/d' || CAST(p_size AS VARCHAR) || '/' || case_name || '_' || CAST(p_partkey AS VARCHAR) || '_' || CAST(file_no AS VARCHAR) || '.c' AS path
  FROM part JOIN told ON p_partkey % {len(CASES)} = told.case_no JOIN names USING (case_no)
)
{select}
"""


def own(column: str) -> str:
    return f"replace({column}, '{{k}}', k) AS {column}"


def register(name: str, build: Callable[[plans.Scan], DataFrame], sql: str) -> None:
    """A query of the whole scan."""
    QUERIES[name] = lambda spark, sf_dir: build(scan(spark, sf_dir))
    ORACLE_SQL[name] = sql


def register_part(name: str, build: Callable[[plans.Parts], DataFrame], sql: str) -> None:
    """A query of a part."""
    QUERIES[name] = lambda spark, sf_dir: build(parts(spark, sf_dir))
    ORACLE_SQL[name] = sql


# ---- events of each detector, over all files


def detected(types: tuple[str, ...]) -> Callable[[plans.Parts], DataFrame]:
    def of(s: plans.Parts) -> DataFrame:
        p = F.col("props")
        what = F.coalesce(p["category"], p["origin"], p["reason"], F.lit(""))
        variable = F.coalesce(p["variable"], p["mutex_a"], F.lit(""))
        return s.events(*types).select("path", "function", "event_type", F.col("line").cast("int").alias("line"), variable.alias("variable"), what.alias("category"))

    return of


#: The query of each detector, and the events it gives.
DETECTED = {
    "detect_null_source": ("NULL_VALUE",), "detect_dereference": ("DEREFERENCE",), "detect_null_guard": ("NULL_GUARD",), "detect_buffer_overflow": ("BUFFER_ACCESS",), "detect_memory_leak": ("MEMORY_ALLOC", "MEMORY_RELEASE"),
    "detect_injection": ("INJECTION",), "detect_resource_leak": ("RESOURCE_ACQUIRE", "RESOURCE_RELEASE"), "detect_uninit_variable": ("VALUE_USE",), "detect_use_after_free": ("USE_AFTER_FREE",), "detect_double_free": ("DOUBLE_FREE",),
    "detect_format_string": ("FORMAT_STRING",), "detect_integer_overflow": ("INTEGER_OVERFLOW",), "detect_race_condition": ("RACE_CONDITION",), "detect_hardcoded_secret": ("HARDCODED_SECRET",), "detect_deadlock": ("DEADLOCK",),
    "detect_crypto_misuse": ("CRYPTO_MISUSE",), "detect_divide_by_zero": ("DIVIDE_BY_ZERO",), "detect_unchecked_return": ("UNCHECKED_RETURN",), "detect_path_traversal": ("PATH_TRAVERSAL",), "detect_sizeof_misuse": ("SIZEOF_MISUSE",),
    "detect_signed_compare": ("SIGNED_COMPARE",), "detect_lock_order": ("LOCK_ORDER",),
}
EVENT_COLUMNS = "event_type, function, line, variable, category"
EVENT_SQL = f"SELECT path, {own('function')}, event_type, CAST(line AS INTEGER) AS line, {own('variable')}, category FROM rows"


def event_rows(types: tuple[str, ...], only: Callable[[list[str]], bool] = lambda w: True) -> list[tuple]:
    return [(i, int(w[1]), w[0], w[2], int(w[3]), w[4], w[5]) for i, w in facts_of("events") if w[0] in types and only(w)]


for name, kinds in DETECTED.items():
    register_part(name, detected(kinds), foretold(event_rows(kinds), EVENT_COLUMNS, EVENT_SQL))
register_part("detect_interprocedural", lambda s: detected(("DEREFERENCE",))(s).filter("category = 'interprocedural'"), foretold(event_rows(("DEREFERENCE",), lambda w: w[5] == "interprocedural"), EVENT_COLUMNS, EVENT_SQL))


# ---- functions, variables, deeds and edges


def lists(kind: str) -> list[tuple]:
    return [(i, int(w[1]), *w[2:]) for i, w in facts_of("edges") if w[0] == kind]


def edges_of(kind: str) -> Callable[[plans.Parts], DataFrame]:
    return lambda s: s.edges(kind).select("path", "function", F.col("line").cast("int").alias("line"), "src", "dst", "note")


for kind in EDGES:
    rows = [(i, n, f, int(line), src, dst, note) for i, n, f, line, src, dst, note in lists(kind)]
    sql = foretold(rows, "function, line, src, dst, note", f"SELECT path, {own('function')}, CAST(line AS INTEGER) AS line, {own('src')}, {own('dst')}, note FROM rows")
    register_part(f"edges_{kind.lower()}", edges_of(kind), sql)

register_part(
    "function_facts",
    lambda s: s.facts("function").filter("record = 'function'").select("path", "function", F.col("kind").alias("return_type"), (F.col("note") == "static").alias("is_static"), F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"), F.col("props")["params"].alias("params")),
    foretold([(i, n, f, kind, static, int(a), int(b), params) for i, n, f, kind, static, a, b, params in lists("FUNCTION")], "function, return_type, static, line, end_line, params", f"SELECT path, {own('function')}, return_type, static = 'static' AS is_static, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, params FROM rows"),
)
register_part(
    "pointer_variables",
    lambda s: s.facts("variable").filter("record = 'variable'").select("path", "function", F.col("line").cast("int").alias("line"), F.col("src").alias("variable"), F.col("kind").alias("type"), F.col("note").alias("source")),
    foretold([(i, n, f, int(line), v, kind.replace("_", " "), source) for i, n, f, line, v, kind, source in lists("VARIABLE")], "function, line, variable, type, source", f"SELECT path, {own('function')}, CAST(line AS INTEGER) AS line, variable, type, source FROM rows"),
)
register_part(
    "function_deeds",
    lambda s: s.facts("deed").filter("record = 'deed'").select("path", "function", F.col("kind").alias("deed"), F.col("col").cast("int").alias("parameter"), F.col("src").alias("place"), F.col("note").alias("ways")),
    foretold([(i, n, f, deed, int(at), place, ways) for i, n, f, deed, at, place, ways in lists("DEED")], "function, deed, parameter, place, ways", f"SELECT path, {own('function')}, deed, CAST(parameter AS INTEGER) AS parameter, {own('place')}, ways FROM rows"),
)


def summary_of(column: str) -> Callable[[plans.Parts], DataFrame]:
    return lambda s: s.summaries().filter(column).select("function", *([] if column.startswith("return") else ["tainted_params"]))


for name, column, word in (("summary_return_null", "return_nullable", "NULLABLE"), ("summary_return_taint", "return_tainted", "TAINTED")):
    register_part(name, summary_of(column), foretold([(i, n, f) for i, n, f in lists(word)], "function", f"SELECT {own('function')} FROM rows"))
register_part("summary_param_taint", lambda s: s.summaries().filter("tainted_params <> ''").select("function", "tainted_params"), foretold([(i, n, f, at) for i, n, f, at in lists("PARAMS")], "function, tainted_params", f"SELECT {own('function')}, tainted_params FROM rows"))
#: The kinds of an edge's ends; a call's end is a function only if its case has it.
ENDS = {"CALL": ("function", "function"), "DATA_FLOW": ("variable_ref", "variable_ref"), "ALIAS": ("variable_ref", "variable_ref"), "OWNERSHIP_TRANSFER": ("variable_ref", "global_var"), "RELEASE": ("variable_ref", "external_function"), "PARAM_BINDING": ("variable_ref", "parameter"), "RETURN": ("return_slot", "variable_ref"), "LOCK_ORDER": ("mutex", "mutex"), "GLOBAL_ACCESS": ("function", "global_var")}


def ends() -> list[tuple]:
    known = {(i, f) for i, _, f, *_ in lists("FUNCTION")}
    out = []
    for edge, (a, b) in ENDS.items():
        for i, n, f, _, src, dst, note in lists(edge):
            if edge == "CALL" and (i, dst) not in known:
                b = "external_function"
            elif edge in ("DATA_FLOW", "OWNERSHIP_TRANSFER") and note == "return":
                b = "return_slot"
            else:
                b = ENDS[edge][1]
            out += [(i, n, kind, f if kind == "variable_ref" else "", name) for kind, name in ((a, src), (b, dst))]
    return sorted(set(out))


register_part(
    "graph_nodes_distinct",
    lambda s: graph.nodes(s.edges(*EDGES)).groupBy("entity_type").agg(F.count("*").alias("nodes"), F.countDistinct("owner", "name").alias("names")),
    foretold(ends(), "entity_type, owner, name", "SELECT entity_type, count(*) AS nodes, count(*) AS names FROM (SELECT DISTINCT entity_type, CASE WHEN owner <> '' THEN path || owner END, replace(name, '{k}', k) FROM rows) GROUP BY entity_type"),
)


# ---- statement graphs and flows, by line


register_part("flow_next_statement", lambda s: probes.rows(s.given, probes.next_lines, "path string, function string, line int, next_line int"), foretold([(i, n, f, int(step.split(">")[0]), int(b)) for i, n, f, steps in lists("NEXT") for step in steps.split(";") for b in step.split(">")[1].split(",")], "function, line, next_line", f"SELECT path, {own('function')}, CAST(line AS INTEGER) AS line, CAST(next_line AS INTEGER) AS next_line FROM rows"))
register_part("flow_on_every_way", lambda s: probes.rows(s.given, probes.passes, "path string, function string, line int"), foretold([(i, n, f, int(a)) for i, n, f, lines in lists("EVERY") for a in lines.split(",")], "function, line", f"SELECT path, {own('function')}, CAST(line AS INTEGER) AS line FROM rows"))
register_part("flow_ranges", lambda s: probes.rows(s.given, probes.ranges, "path string, function string, line int, variable string, least string, greatest string"), foretold([(i, n, f, int(a), v, lo, hi) for i, n, f, a, v, lo, hi in lists("RANGE")], "function, line, variable, least, greatest", f"SELECT path, {own('function')}, CAST(line AS INTEGER) AS line, variable, nullif(least, 'open') AS least, nullif(greatest, 'open') AS greatest FROM rows"))


# ---- candidates: filters, results, ranks, counts

RESULT_COLUMNS = "vuln_type, function, line, variable, outcome, source_line, definite"
OUTCOMES = ("confirmed", "suspected", "possible")


def result_rows(only: Callable[[str, str], bool]) -> list[tuple]:
    """only: by type and outcome."""
    return [(i, int(w[1]), w[0], w[2], int(w[3]), w[4], w[5], int(w[6]), w[7]) for i, w in facts_of("results") if only(w[0], w[5])]


def place_of(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("vuln_type", "path", "function", F.col("line").cast("int").alias("line"), "variable", *more)


PLACE_SQL = f"vuln_type, path, {own('function')}, CAST(line AS INTEGER) AS line, {own('variable')}"
for t in TYPES:
    register_part(
        f"scan_{t.replace('-', '_')}",
        lambda s, t=t: place_of(s.results([TYPES[t]]), "suspicion", "cwe"),
        foretold(result_rows(lambda kind, outcome, t=t: kind == t and outcome in OUTCOMES), RESULT_COLUMNS, f"SELECT {PLACE_SQL}, outcome AS suspicion, 'CWE-{TYPES[t].cwe}' AS cwe FROM rows"),
    )
for f in ("call_reach", "safe_function_exclude", "memory_release", "resource_release", "ownership_transfer", "sizeof_pseudo_deref", "non_nullable_array_suppress", "guard", *FLOW_FILTERS):
    register_part(f"filter_{f}", lambda s, f=f: place_of(s.dropped([t for t in TYPES.values() if f in t.filters], f)), foretold(result_rows(lambda kind, outcome, f=f: outcome == f), RESULT_COLUMNS, f"SELECT {PLACE_SQL} FROM rows"))
for f, t in (("lock_order", "deadlock"), ("shared_access", "race-condition")):
    register_part(f"filter_{f}", lambda s, t=t: place_of(s.candidates([TYPES[t]]).filter("drop_filter is null"), "suspicion"), foretold(result_rows(lambda kind, outcome, t=t: kind == t and outcome in OUTCOMES), RESULT_COLUMNS, f"SELECT {PLACE_SQL}, outcome AS suspicion FROM rows"))

register(
    "flow_sources",
    lambda s: place_of(s.candidates.filter(F.col("drop_filter").isNull() & (F.col("source_line") > 0)), F.col("source_line").cast("int").alias("source_line"), "definite"),
    foretold([r for r in result_rows(lambda kind, outcome: outcome in OUTCOMES) if r[7] > 0], RESULT_COLUMNS, f"SELECT {PLACE_SQL}, CAST(source_line AS INTEGER) AS source_line, definite = 'sure' AS definite FROM rows"),
)
ALL_RESULTS = result_rows(lambda kind, outcome: True)
register(
    "scan_counts",
    lambda s: s.stats().select("vuln_type", "seed_count", "final_count"),
    foretold(ALL_RESULTS, RESULT_COLUMNS, f"SELECT vuln_type, count(k) AS seed_count, count(k) FILTER (outcome IN {OUTCOMES}) AS final_count FROM (SELECT unnest({sorted(TYPES)}) AS vuln_type) LEFT JOIN rows USING (vuln_type) GROUP BY vuln_type"),
)
register(
    "scan_ledger",
    lambda s: s.ledger(),
    foretold(ALL_RESULTS, RESULT_COLUMNS, f"SELECT vuln_type, outcome AS filter, count(*) AS dropped FROM rows WHERE outcome NOT IN {OUTCOMES} GROUP BY ALL"),
)
CHECKED = {(i, int(w[1]), w[3]) for i, w in facts_of("events") if w[0] == "RACE_CONDITION" and w[5] == "toctou"}
register(
    "scan_evidence",
    lambda s: plans.evidence(s.ranked).select("vuln_type", F.explode("evidence").alias("e")).groupBy("vuln_type", F.col("e.type").alias("fragment"), F.col("e.role").alias("role")).agg(F.count("*").alias("n")),
    foretold(
        [(*r, "toctou" if r[2] == "race-condition" and (r[0], r[1], str(r[4])) in CHECKED else "") for r in result_rows(lambda kind, outcome: outcome in OUTCOMES)],
        f"{RESULT_COLUMNS}, how",
        f"""
, own(vuln_type, fragment, role) AS (VALUES {values([(t, a, b) for t, (a, b, _) in FRAGMENTS.items()])}),
parts AS (
  SELECT vuln_type, CASE WHEN vuln_type = 'null-deref' AND definite = 'sure' THEN 'definite_null' WHEN vuln_type = 'null-deref' AND source_line > 0 THEN 'nullable_source' WHEN how = 'toctou' THEN how ELSE fragment END AS fragment,
    CASE WHEN vuln_type = 'null-deref' AND definite = 'sure' THEN 'condition' WHEN vuln_type = 'null-deref' AND source_line > 0 THEN 'source' ELSE role END AS role FROM rows JOIN own USING (vuln_type)
  UNION ALL SELECT vuln_type, 'call_path', 'path' FROM rows WHERE vuln_type NOT IN ('hardcoded-secret', 'deadlock')
  UNION ALL SELECT vuln_type, 'taint_source', 'source' FROM rows WHERE vuln_type IN ('injection', 'format-string', 'path-traversal') AND source_line > 0
)
SELECT vuln_type, fragment, role, count(*) AS n FROM parts GROUP BY ALL
""",
    ),
)
register(
    "scan_sarif",
    lambda s: report.candidate_results(s.ranked).select("rule_id", F.from_json("result", "ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>, partialFingerprints struct<place: string>, codeFlows array<struct<threadFlows: array<struct<locations: array<struct<location: struct<physicalLocation: struct<region: struct<startLine: int>>>>>>>>>").alias("x")).select("rule_id", "x.level", F.col("x.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("x.locations")[0]["physicalLocation"]["region"]["startLine"].alias("line"), F.col("x.partialFingerprints.place").alias("fingerprint"), F.get(F.col("x.codeFlows")[0]["threadFlows"][0]["locations"], F.lit(0))["location"]["physicalLocation"]["region"]["startLine"].alias("flow_from")),
    foretold(
        result_rows(lambda kind, outcome: outcome in OUTCOMES),
        RESULT_COLUMNS,
        f", cwe(vuln_type, rule_id) AS (VALUES {values([(t.name, f'CWE-{t.cwe}') for t in TYPES.values()])}) SELECT rule_id, 'note' AS level, path AS uri, CAST(line AS INTEGER) AS line, rule_id || ':' || replace(function, '{{k}}', k) || ':' || line AS fingerprint, CAST(CASE WHEN source_line > 0 AND source_line <> line THEN source_line END AS INTEGER) AS flow_from FROM rows JOIN cwe USING (vuln_type)",
    ),
)
