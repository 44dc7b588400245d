"""The store and the reports over the driver's tables, with SQL for what they must hold.

Each query makes a store of its own in the shared folder, changes it as an engine would, and
returns what it reads back. A labelled document stands for a finding: its source for a file,
its id for a line, its text for the code.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csuite import programs, spread
from .operators import closure, report
from .operators.store import Store
from .plans import kernel
from .relational import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(build: Callable[[Tables, Store], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir), Store(spark, f"{closure.shared_folder(spark)}/store-{uuid.uuid4().hex}"))

        QUERIES[build.__name__] = run
        ORACLE_SQL[build.__name__] = sql
        return build

    return register


def found(t: Tables) -> DataFrame:
    """A first verdict for each labelled document."""
    rows = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.select(
        "lang", "quality", "toxic", F.when(F.col("toxic") == 1, "CWE-78").otherwise("CWE-476").alias("rule_id"), F.lit("high").alias("severity"), F.when(F.col("quality") == 1, 80.0).otherwise(0.25).alias("confidence"),
        F.when(F.col("quality") == 1, "suspected").otherwise("open").alias("status"), F.concat(F.lit("src/"), "source", F.lit(".c")).alias("file_path"), (F.col("doc_id") + 1).cast("int").alias("line_number"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("function_name"),
    )


FOUND = """
found AS (
  SELECT lang, quality, toxic, CASE WHEN toxic = 1 THEN 'CWE-78' ELSE 'CWE-476' END AS rule_id, CASE WHEN quality = 1 THEN 0.8 ELSE 0.25 END AS confidence, CASE WHEN quality = 1 THEN 'suspected' ELSE 'open' END AS status,
    'src/' || source || '.c' AS file_path, CAST(doc_id + 1 AS INTEGER) AS line_number, 'f' || doc_id AS function_name
  FROM labels JOIN documents USING (doc_id)
)
"""
PLACE = ("rule_id", "file_path", "line_number", "function_name")


@query(f"""
WITH {FOUND} SELECT rule_id, file_path, line_number, function_name, CASE WHEN lang = 'de' THEN 'confirmed' ELSE status END AS status, CAST(CASE WHEN lang = 'de' THEN 1 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN lang = 'de' THEN 'seen again' ELSE '' END AS summary FROM found
""")
def store_upsert(t, store):
    """Verdicts, and those of German files once more."""
    store.merge_findings(found(t), "sc_a")
    again = found(t).filter("lang = 'de'").withColumns({"status": F.lit("confirmed"), "confidence": F.lit(100.0), "summary": F.lit("seen again")})
    store.merge_findings(again, "sc_a")
    return store.read("findings").select(*PLACE, "status", "confidence", "summary")


def reviewed(t: Tables, store: Store) -> None:
    store.merge_findings(found(t), "sc_a")
    word = F.when(F.col("lang") == "de", "dismissed").when(F.col("lang") == "fr", "confirmed").when(F.col("lang") == "es", "suspected-kept")
    own = found(t).join(store.read("findings").select("id", *PLACE), list(PLACE))
    store.review_all(own.select("id", word.alias("review_status"), F.lit("read").alias("review_reasoning")))


EFFECTIVE = "CASE lang WHEN 'de' THEN 'dismissed' WHEN 'fr' THEN 'confirmed' WHEN 'es' THEN 'suspected' ELSE status END"


@query(f"WITH {FOUND} SELECT rule_id, file_path, line_number, function_name, {EFFECTIVE} AS effective, CASE WHEN lang IN ('de', 'fr', 'es') THEN 'read' END AS review_reasoning FROM found")
def store_review(t, store):
    """Reviews outlive the next upsert."""
    reviewed(t, store)
    store.merge_findings(found(t), "sc_a")
    return store.effective().select(*PLACE, "effective", "review_reasoning")


@query(f"""
WITH {FOUND}, e AS (SELECT *, {EFFECTIVE} AS effective FROM found)
SELECT file_path AS path, line_number AS line, rule_id AS cwe FROM e WHERE effective <> 'dismissed' AND lang <> 'fr'
""")
def store_suppressed(t, store):
    """Results less what was dismissed and what the baseline scan had, here the French files."""
    reviewed(t, store)
    store.merge_findings(found(t).filter("lang = 'fr'"), "sc_b")
    rows = found(t).select(F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.col("rule_id").alias("cwe"))
    return store.suppressed(rows, baseline="sc_b")


@query(f"""
WITH {FOUND}, e AS (SELECT *, {EFFECTIVE} AS effective, CASE toxic WHEN 1 THEN 'injection' ELSE 'null-deref' END AS vuln_type FROM found),
c AS (
  SELECT coalesce(vuln_type, 'TOTAL') AS vuln_type, count(*) + 10 * count(DISTINCT vuln_type) AS seed_count, count(*) AS final_count, count(*) FILTER (effective = 'confirmed') AS confirmed, count(*) FILTER (effective = 'suspected') AS suspected,
    count(*) FILTER (effective = 'dismissed') AS dismissed, count(*) FILTER (effective = 'open') AS open
  FROM e GROUP BY ROLLUP (vuln_type)
)
SELECT *, CAST(round(100.0 * (1 - CAST(final_count AS DOUBLE) / seed_count), 1) AS DOUBLE) AS efficiency, greatest(final_count - confirmed - suspected - dismissed, 0) AS unclassified FROM c
""")
def store_audit(t, store):
    reviewed(t, store)
    kind = F.when(F.col("toxic") == 1, "injection").otherwise("null-deref")
    stats = found(t).groupBy(kind.alias("vuln_type")).agg((F.count("*") + 10).alias("seed_count"), F.count("*").alias("final_count"))
    store.append("scan_stats", store.stats_rows(stats, "sc_a"))
    store.append("scan_stats", store.stats_rows(stats, "sc_other"))
    return store.audit("sc_a")


@query("SELECT event_type AS scan_id, CAST(n AS BIGINT) AS seeds FROM (SELECT event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY event_type) ORDER BY last DESC, event_type LIMIT 1")
def store_latest_scan(t, store):
    """An event type is a scan, its last event the time its counts were stored."""
    stats = t("events").groupBy("event_type").agg(F.max("ts").alias("ts"), F.count("*").alias("seed_count"))
    rows = stats.select(F.xxhash64("event_type").alias("id"), F.col("event_type").alias("scan_id"), F.lit("injection").alias("vuln_type"), "seed_count", F.lit(0).alias("final_count"), F.lit("[]").alias("filter_chain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
    store.append("scan_stats", rows)
    return store.find("scan_stats", scan_id=store.latest_scan()).select("scan_id", F.col("seed_count").alias("seeds"))


@query("SELECT 'src/' || n_name || '.c' AS path, n_name AS checksum, CAST(n_nationkey AS INTEGER) AS loc FROM nation WHERE n_regionkey = 1 ORDER BY path")
def store_find(t, store):
    """Rows by a column's value, in the table's order."""
    store.replace("functions", t("nation").select(F.concat(F.lit("src/"), "n_name", F.lit(".c")).alias("path"), F.col("n_name").alias("name"), F.lit("").alias("signature"), F.lit("int").alias("return_type"), (F.col("n_regionkey") == 1).alias("is_static"), F.col("n_nationkey").alias("start_line"), F.col("n_nationkey").alias("end_line")))
    return store.find("functions", is_static=True).select("path", F.col("name").alias("checksum"), F.col("start_line").alias("loc"))


@query("SELECT 'src/' || source || '.c' AS path, CAST(doc_id AS INTEGER) AS line FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id = 0)")
def store_delete_files(t, store):
    """Facts of all files but the first document's."""
    path = F.concat(F.lit("src/"), "source", F.lit(".c"))
    empty = {c: F.lit(None).cast("string") for c in ("function", "kind", "src", "dst", "note", "detector")}
    facts = t("documents").select(path.alias("path"), F.lit("event").alias("record"), F.col("doc_id").cast("int").alias("line")).withColumns(empty | {"end_line": F.lit(0), "col": F.lit(0), "props": F.lit(None).cast("map<string,string>")})
    store.append("facts", facts)
    store.delete_files("facts", t("documents").filter("doc_id = 0").select(path.alias("path")))
    return store.read("facts").select("path", "line")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)
SELECT 'f' || s_suppkey AS function, EXISTS (SELECT 1 FROM a WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS return_nullable, s_acctbal < 0 AS return_tainted FROM supplier
""")
def store_summaries(t, store):
    """A later upsert of one column leaves the others as they were."""
    function = F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("function")
    store.merge_summaries(t("supplier").select(function, F.lit(False).alias("return_nullable"), (F.col("s_acctbal") < 0).alias("return_tainted")))
    nullable = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    store.merge_summaries(nullable.select(function, F.lit(True).alias("return_nullable")))
    return store.read("function_summary").select("function", "return_nullable", "return_tainted")


@query("SELECT 'files' AS name, count(*) AS n FROM nation UNION ALL SELECT 'scan_stats', count(*) FROM region UNION ALL SELECT 'security_events', 0")
def store_transaction(t, store):
    """Two tables change together; a transaction that fails changes neither; events are cleared."""
    files = t("nation").select(F.col("n_name").alias("path"), F.md5("n_name").alias("checksum"), F.lit(1).alias("loc"))
    stats = t("region").select(F.col("r_regionkey").alias("id"), F.lit("sc_a").alias("scan_id"), F.col("r_name").alias("vuln_type"), F.lit(1).alias("seed_count"), F.lit(1).alias("final_count"), F.lit("").alias("filter_chain"), F.lit(0).alias("created_at"))
    events = t("region").select(F.col("r_name").alias("path"), F.lit("f").alias("function"), F.lit("X").alias("event_type"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(None).cast("map<string,string>").alias("props"), F.lit("d").alias("detector"))
    store.change(lambda read: {"files": files, "scan_stats": stats, "security_events": events})
    with contextlib.suppress(ZeroDivisionError):
        store.change(lambda read: {"files": read("files").limit(0), "scan_stats": stats.limit(1 // 0)})
    store.clear("security_events")
    counts = [store.read(n).select(F.lit(n).alias("name")).groupBy().agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("files", "scan_stats", "security_events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, 'Licensed')),
m AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: contains(x, 'Licensed')), true) AS p FROM l)
SELECT doc_id, l[p] AS snippet, CAST(greatest(p - 2, 1) AS INTEGER) AS first_line, array_to_string(list_transform(l[greatest(p - 2, 1):p + 2], lambda x: CASE WHEN length(x) > 400 THEN x[1:400] || '...' ELSE x END), chr(10)) AS context FROM m
""")
def report_context(t, store):
    """The line of a confirmed finding and two lines either side, long ones cut for show."""
    texts = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"))
    lines = F.split("source", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains("Licensed")), True).cast("int")
    marks = texts.filter(F.col("source").contains("Licensed")).select("path", at.alias("line"))
    verdicts = marks.select(F.lit("CWE-78").alias("rule_id"), F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.lit("f").alias("function_name"), F.lit(1.0).alias("confidence"), *(F.lit("").alias(c) for c in ("reasoning", "exception_check", "fix_strategy", "summary", "evidence")), F.lit("confirmed").alias("effective"))
    rows = report.verdict_rows(verdicts, texts, 2)
    return rows.select(F.col("file_path").cast("long").alias("doc_id"), "snippet", "first_line", F.array_join("context", "\n").alias("context"))


@query(f"""
WITH {FOUND}, e AS (SELECT *, {EFFECTIVE} AS effective FROM found)
SELECT rule_id, file_path AS uri, line_number AS line, CASE effective WHEN 'confirmed' THEN 'error' ELSE 'warning' END AS level, function_name AS message FROM e WHERE effective IN ('confirmed', 'suspected')
""")
def report_verdicts(t, store):
    """Confirmed findings are errors, suspected ones warnings, others aren't reported."""
    reviewed(t, store)
    return report.verdict_rows(store.effective()).select("rule_id", F.col("file_path").alias("uri"), F.col("line_number").alias("line"), "level", "message")


@query("""
WITH e AS (SELECT 'CWE-78' AS rule_id, event_type AS file_path, CAST(user_id AS INTEGER) AS line_number, 'f' AS function_name, event_id, ts, CASE WHEN value > 50 THEN 'confirmed' ELSE 'suspected' END AS effective FROM events)
SELECT rule_id, file_path, line_number, function_name, arg_max(effective, struct_pack(ts := ts, id := event_id)) AS effective FROM e GROUP BY ALL
""")
def report_latest_verdicts(t, store):
    """Of each place the last verdict counts."""
    said = {c: F.lit("") for c in ("severity", "summary", "reasoning", "evidence", "fix_strategy")}
    rows = t("events").select(F.lit("CWE-78").alias("rule_id"), F.col("event_type").alias("file_path"), F.col("user_id").cast("int").alias("line_number"), F.lit("f").alias("function_name"), F.when(F.col("value") > 50, "confirmed").otherwise("suspected").alias("effective"), F.lit(1.0).alias("confidence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), F.col("event_id").alias("id"))
    return report.latest_verdicts(rows.withColumns(said)).select(*PLACE, "effective")


@query("""
SELECT p_size > 25 AS parsed_again, count(DISTINCT p_partkey) AS programs FROM part WHERE p_size <> 1 GROUP BY 1
""")
def incremental_facts(t, store):
    """Programs of size 1 are gone, those over 25 have another checksum: only these are parsed again, the others keep the facts that were stored."""
    files = closure.cut(programs(spread(t("part"))))
    size = F.regexp_extract("path", "^src/d([0-9]+)/", 1).cast("int")
    store.change(lambda _: {"facts": kernel.facts(files).withColumn("note", F.lit("stored")), "files": files.withColumn("checksum", F.when(size > 25, "old").otherwise(F.col("checksum")))})
    now = kernel.refreshed(store.read("facts"), store.read("files"), files.filter(size != 1))
    program = F.regexp_extract("path", "_([0-9]+)_[12][.]c$", 1)
    return now.groupBy((F.coalesce("note", F.lit("")) != "stored").alias("parsed_again")).agg(F.countDistinct(program).alias("programs"))
