"""The operators' relational cores over the driver's tables, each with the SQL that says the same.

A user (or an order, a supplier) stands for a function, the order of time for lines, an
event type for what a detector reports, a document or page for a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scalars as S
from .operators import closure, converge, joins, merging, ordered
from .sources import tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables, and its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


# ---- sources


@query("SELECT doc_id, sha256(text) AS checksum, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS loc FROM documents")
def content_hash_facts(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("checksum"), S.line_count(F.col("text")).alias("loc"))


EXCLUDED = ("de", "es", "blog", "tests", "vendor")


@query("""
WITH p AS (SELECT page_id, url, string_split(split_part(url, '?', 1), '/') AS s FROM pages)
SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS first_segment
FROM p WHERE NOT list_has_any(list_transform(s[1:len(s) - 1], lambda x: lower(x)), ['de', 'es', 'blog', 'tests', 'vendor'])
""")
def source_exclude_filter(t):
    url = F.col("url")
    rest = F.split_part(url, F.lit("://"), F.lit(2))
    part = lambda n: F.split_part(rest, F.lit("/"), F.lit(n))
    return t("pages").filter(~tree.excluded(F.split_part(url, F.lit("?"), F.lit(1)), EXCLUDED)).select("page_id", part(1).alias("host"), part(2).alias("first_segment"))


@query("""
WITH o AS (SELECT doc_id, md5(text) AS c FROM documents WHERE lang <> 'de'),
n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN md5(text || '!') ELSE md5(text) END AS c FROM documents WHERE lang <> 'es')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.c = n.c THEN 'unchanged' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def incremental_diff(t):
    """German documents are new, Spanish ones gone, French ones changed."""
    docs = t("documents")
    old = docs.filter("lang <> 'de'").select("doc_id", F.md5("text").alias("c"))
    new = docs.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "fr", F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("c"))
    return merging.changes(old, new, "doc_id", "c")


@query("""
WITH s AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_orderkey, c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS line
FROM orders JOIN s ON o_custkey = k AND o_orderdate BETWEEN a AND b JOIN customer ON c_custkey = k
""")
def function_scope_join(t):
    orders = t("orders")
    scopes = orders.groupBy(F.col("o_custkey")).agg(F.min("o_orderdate").alias("scope_start"), F.max("o_orderdate").alias("scope_end"))
    inside = joins.in_scope(orders, scopes, ["o_custkey"], "o_orderdate", "scope_start", "scope_end")
    inside = inside.join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return inside.select("o_orderkey", "c_custkey", F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("line"))


@query("""
SELECT CAST(file AS BIGINT) AS user_id, CAST(n AS BIGINT) AS n, event_type FROM (SELECT user_id AS file, event_type, count(*) AS n FROM events GROUP BY ALL) ORDER BY user_id, event_type
""")
def list_by_type(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).orderBy("user_id", "event_type")


# ---- graph


@query("""
SELECT DISTINCT 'customer' AS entity_type, CAST(c_nationkey AS BIGINT) AS entity_id, c_mktsegment AS name FROM customer
UNION SELECT DISTINCT 'supplier', CAST(s_nationkey AS BIGINT), '' FROM supplier
UNION SELECT DISTINCT 'part', CAST(p_size AS BIGINT), p_brand FROM part
""")
def insert_distinct_nodes(t):
    rows = t("customer").select(F.lit("customer").alias("entity_type"), F.col("c_nationkey").cast("long").alias("entity_id"), F.col("c_mktsegment").alias("name"))
    rows = rows.unionByName(t("supplier").select(F.lit("supplier").alias("entity_type"), F.col("s_nationkey").cast("long").alias("entity_id"), F.lit("").alias("name")))
    return rows.unionByName(t("part").select(F.lit("part").alias("entity_type"), F.col("p_size").cast("long").alias("entity_id"), F.col("p_brand").alias("name"))).dropDuplicates()


@query("""
WITH f AS (SELECT p_name, max(p_partkey) AS k FROM part WHERE p_size > 10 GROUP BY p_name)
SELECT l_orderkey, l_linenumber, coalesce(k, 0) AS callee, k IS NULL AS is_external
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN f ON part.p_name = f.p_name
""")
def call_edges_external(t):
    parts = t("part").select("p_partkey", "p_name", "p_size")
    # the last of equal names wins
    functions = parts.filter("p_size > 10").groupBy("p_name").agg(F.max("p_partkey").alias("k"))
    calls = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return calls.join(functions, "p_name", "left").select("l_orderkey", "l_linenumber", F.coalesce("k", F.lit(0)).alias("callee"), F.col("k").isNull().alias("is_external"))


def typed_edges(t) -> DataFrame:
    """A type's user leads to the next user with an event of that type within 150 seconds, by time; the types' graphs are separate."""
    e = t("events").select("event_type", "ts", "event_id", "user_id")
    e = ordered.following(e, ["event_type"], ["ts", "event_id"], {"next_user": "user_id", "next_ts": "ts"})
    near = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) < 150_000_000
    node = lambda user: F.struct("event_type", F.col(user).alias("user_id"))
    return e.filter(near & (F.col("user_id") != F.col("next_user"))).select(node("user_id").alias("src"), node("next_user").alias("dst")).distinct()


TYPED_EDGES = """
edges AS (
  SELECT DISTINCT event_type, user_id AS src, dst FROM (
    SELECT event_type, ts, user_id, lead(user_id) OVER w AS dst, lead(ts) OVER w AS to_ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
  ) WHERE epoch_us(to_ts) - epoch_us(ts) < 150000000 AND user_id <> dst
)
"""


@query(f"""
WITH RECURSIVE {TYPED_EDGES},
r AS (SELECT DISTINCT event_type, src AS node FROM edges JOIN customer ON src = c_custkey WHERE c_mktsegment = 'BUILDING' UNION SELECT r.event_type, dst FROM r JOIN edges ON r.event_type = edges.event_type AND node = src)
SELECT event_type, node FROM r
""")
def graph_reach_multi(t):
    """In each type's graph what the users of a market segment lead to: one reachability of all types, from all of its entries."""
    edges = closure.cut(typed_edges(t))
    segment = t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    entries = edges.join(segment, F.col("src.user_id") == F.col("c_custkey"), "left_semi").select(F.col("src.event_type").alias("root"), F.col("src").alias("node"))
    return closure.reach(edges, entries).select(F.col("root").alias("event_type"), F.col("node.user_id").alias("node"))


@query(f"""
WITH RECURSIVE {TYPED_EDGES},
r AS (SELECT DISTINCT event_type, src AS root, src AS node FROM edges UNION SELECT r.event_type, root, dst FROM r JOIN edges ON r.event_type = edges.event_type AND node = src),
pairs AS (SELECT a.event_type, a.root AS x, a.node AS y FROM r a JOIN r b ON a.event_type = b.event_type AND a.root = b.node AND a.node = b.root AND a.root <> a.node)
SELECT event_type, x AS node, least(x, min(y)) AS component FROM pairs GROUP BY event_type, x
""")
def graph_scc_cycles(t):
    """The cycles of each type's graph."""
    found = closure.strong_components(typed_edges(t))
    return found.select("node.event_type", F.col("node.user_id").alias("node"), F.col("component.user_id").alias("component"))


@query("""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
a AS (SELECT conv_id, turn, unnest(w) AS arg, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT a.conv_id, a.turn, CAST(a.pos AS INTEGER) AS pos, a.arg, b.arg AS param FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.pos = b.pos
""")
def param_binding_positional(t):
    """Every word of a turn and the next turn's word of the same position."""
    words = t("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "arg"))
    params = words.select("conv_id", (F.col("turn") - 1).alias("turn"), "pos", F.col("arg").alias("param"))
    return words.join(params, ["conv_id", "turn", "pos"]).select("conv_id", "turn", "pos", "arg", "param")


@query("""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, CAST(floor(value) AS BIGINT) % 5 AS lock FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT a.user_id, h.lock AS held, a.lock AS acquired, count(*) AS n
FROM e a JOIN e h ON a.user_id = h.user_id AND h.line < a.line AND h.event_type = 'signup' AND a.event_type = 'signup' AND h.lock <> a.lock
WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.user_id = a.user_id AND r.event_type = 'purchase' AND r.lock = h.lock AND r.line > h.line AND r.line < a.line)
  AND NOT EXISTS (SELECT 1 FROM e g WHERE g.user_id = a.user_id AND g.event_type = 'signup' AND g.lock = h.lock AND g.line > h.line AND g.line < a.line)
GROUP BY ALL
""")
def lock_order_pairs(t):
    """Locks held at each acquisition: the last event of each other lock before it was its acquisition."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lock = F.pmod(F.floor("value"), F.lit(5)).alias("lock")
    e = t("events").filter(F.col("event_type").isin("signup", "purchase")).select("user_id", "event_type", lock, F.row_number().over(window).alias("line"))
    window_before = Window.partitionBy("user_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("lock") == k, F.struct("line", F.col("event_type") == "signup"))).over(window_before).alias(f"l{k}") for k in range(5)]
    at = e.select("user_id", "event_type", "lock", *last).filter("event_type = 'signup'")
    held = F.filter(F.array(*(F.when(F.col(f"l{k}.col2"), F.lit(k).cast("long")) for k in range(5))), lambda x: x.isNotNull())
    rows = at.select("user_id", F.explode(held).alias("held"), F.col("lock").alias("acquired")).filter("held <> acquired")
    return rows.groupBy("user_id", "held", "acquired").agg(F.count("*").alias("n"))


@query("""
SELECT l_suppkey, l_partkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') THEN 'read_write' WHEN bool_or(l_returnflag = 'R') THEN 'write' ELSE 'read' END AS access
FROM lineitem GROUP BY ALL
""")
def global_access_kind(t):
    writes, reads = F.max(F.col("l_returnflag") == "R"), F.max(F.col("l_returnflag") != "R")
    return t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.when(writes & reads, "read_write").when(writes, "write").otherwise("read").alias("access"))


@query("""
WITH a AS (SELECT l_partkey, l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS w, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY ALL)
SELECT l_partkey, CAST(sum(w) AS BIGINT) AS writers, CAST(sum(r) AS BIGINT) AS readers, sum(w) >= 1 AND sum(w) + sum(r) >= 2 AS confirmed FROM a GROUP BY l_partkey
""")
def shared_access_confirm(t):
    by = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("w"), F.max((F.col("l_returnflag") != "R").cast("int")).alias("r"))
    out = by.groupBy("l_partkey").agg(F.sum("w").alias("writers"), F.sum("r").alias("readers"))
    return out.withColumn("confirmed", (F.col("writers") >= 1) & (F.col("writers") + F.col("readers") >= 2))


# ---- dataflow


@query("""
SELECT c.event_id, max(e.ts) AS source_ts FROM events c LEFT JOIN events e ON e.user_id = c.user_id AND e.event_type = 'error' AND e.ts <= c.ts
WHERE c.event_type = 'click' GROUP BY c.event_id
""")
def null_source_asof(t):
    e = t("events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    errors = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("source_ts"))
    return joins.latest_before(clicks, errors, ["user_id"], "ts", "source_ts").select("event_id", "source_ts")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events)
SELECT p.event_id FROM e p WHERE p.event_type = 'purchase'
  AND EXISTS (SELECT 1 FROM e g WHERE g.user_id = p.user_id AND g.event_type = 'error' AND g.line < p.line
    AND NOT EXISTS (SELECT 1 FROM e k WHERE k.user_id = p.user_id AND k.event_type = 'signup' AND k.line > g.line AND k.line < p.line))
""")
def may_reach_straightline(t):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("line"))).over(Window.partitionBy("user_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    e = t("events").select("user_id", "event_type", "event_id", F.row_number().over(window).alias("line"))
    e = e.withColumn("gen", last("error")).withColumn("kill", last("signup"))
    return e.filter((F.col("event_type") == "purchase") & (F.col("gen") > F.coalesce("kill", F.lit(0)))).select("event_id")


@query("""
WITH RECURSIVE seed AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 400000),
steps AS (SELECT 'c' AS kind, c AS id FROM seed
  UNION SELECT * FROM (
    SELECT 'o' AS kind, o_orderkey AS id FROM steps JOIN orders ON steps.kind = 'c' AND o_custkey = steps.id AND o_orderstatus = 'P'
    UNION ALL SELECT 'p', l_partkey FROM steps JOIN lineitem ON steps.kind = 'o' AND l_orderkey = steps.id
    UNION ALL SELECT 's', l_suppkey FROM steps JOIN lineitem ON steps.kind = 'o' AND l_orderkey = steps.id))
SELECT kind, count(*) AS n FROM steps GROUP BY kind
""")
def taint_fixpoint(t):
    """From customers with a large order over their open orders to parts and suppliers. A node is a kind and a key."""
    orders, lines = t("orders"), t("lineitem")
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    edges = orders.filter("o_orderstatus = 'P'").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
    items = lines.select(node("o", "l_orderkey").alias("src"), F.explode(F.array(node("p", "l_partkey"), node("s", "l_suppkey"))).alias("dst"))
    entries = orders.filter("o_totalprice > 400000").select(F.lit("taint").alias("root"), node("c", "o_custkey").alias("node")).distinct()
    found = closure.reach(edges.unionByName(items), entries)
    return found.groupBy("node.kind").agg(F.count("*").alias("n"))


# ---- filters


@query("""
WITH e AS (SELECT * FROM events), g AS (SELECT user_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'view')
SELECT p.event_id FROM e p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND p.ts BETWEEN a AND b)
""")
def guard_interval_anti(t):
    e = t("events")
    guards = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("scope_start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("scope_end"))
    return joins.in_scope(e.filter("event_type = 'purchase'"), guards, ["user_id"], "ts", "scope_start", "scope_end", "left_anti").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def release_anti(t):
    released = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.absent(t("orders").select("o_orderkey"), released, ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def ownership_anti(t):
    moved = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.absent(t("customer").select("c_custkey"), moved, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40)")
def reachable_semi(t):
    large = t("part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return joins.present(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), large, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey FROM part WHERE NOT ((p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') OR p_type LIKE 'PROMO%') AND p_size NOT IN (1, 2, 3))
""")
def safe_set_exclude(t):
    safe = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") | F.col("p_type").startswith("PROMO")
    return t("part").filter(~(safe & ~F.col("p_size").isin(1, 2, 3))).select("p_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity < 30)")
def size_bound_guard(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("m")).filter("m < 30").select("l_orderkey")


@query("""
SELECT u.l_orderkey AS use_order, u.l_linenumber AS use_line, u.l_partkey AS part, count(*) AS releases, min(f.l_shipdate) AS first_release FROM lineitem f JOIN lineitem u
ON f.l_partkey = u.l_partkey AND f.l_suppkey = u.l_suppkey AND f.l_returnflag = 'R' AND u.l_shipdate > f.l_shipdate GROUP BY ALL
""")
def use_after_release(t):
    """Each line that is shipped after a release of the same part and supplier: how many releases, and the first. One pass in key order; no pairs."""
    moment = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    before = Window.partitionBy("l_partkey", "l_suppkey").orderBy("moment").rangeBetween(Window.unboundedPreceding, -1)
    released = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", moment.alias("moment"))
    lines = lines.withColumns({"releases": F.count(released).over(before), "first_release": F.min(released).over(before)})
    return lines.filter("releases > 0").select(F.col("l_orderkey").alias("use_order"), F.col("l_linenumber").alias("use_line"), F.col("l_partkey").alias("part"), "releases", "first_release")


@query("""
WITH r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER w AS n, first_value(l_orderkey) OVER w AS first_order
FROM lineitem WHERE l_returnflag = 'R' WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT l_partkey, l_suppkey, first_order, l_orderkey AS second_order, n FROM r WHERE n > 1
""")
def double_release_pairs(t):
    window = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    r = t("lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.first("l_orderkey").over(window).alias("first_order"), F.col("l_orderkey").alias("second_order"), F.row_number().over(window).cast("long").alias("n"))
    return r.filter("n > 1")


@query("""
WITH a AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS flags FROM a GROUP BY 1)
SELECT l_partkey, count(*) AS common FROM (SELECT a.l_partkey, l_suppkey FROM a JOIN n USING (l_partkey) GROUP BY a.l_partkey, l_suppkey, flags HAVING count(*) = flags) GROUP BY 1
""")
def lockset_intersection(t):
    """Suppliers that every return flag of a part has: the intersection of its sets."""
    sets = t("lineitem").groupBy("l_partkey", "l_returnflag").agg(F.collect_set("l_suppkey").alias("s"))
    common = sets.groupBy("l_partkey").agg(F.collect_list("s").alias("all")).select("l_partkey", F.size(F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda acc, s: F.array_intersect(acc, s))).cast("long").alias("common"))
    return common.filter("common > 0")


# ---- detectors over text

SECRET = r'(?i)\b(password|passwd|secret|token|api_key)\s*=\s*"([^"]+)"'


@query(r"""
WITH d AS (
  SELECT doc_id, string_split_regex(text, '(?i)\b(password|passwd|secret|token|api_key)\s*=\s*"([^"]+)"') AS rest, regexp_extract_all(text, '(?i)\b(password|passwd|secret|token|api_key)\s*=\s*"([^"]+)"', 0) AS hit,
    regexp_extract_all(text, '(?i)\b(password|passwd|secret|token|api_key)\s*=\s*"([^"]+)"', 1) AS name, regexp_extract_all(text, '(?i)\b(password|passwd|secret|token|api_key)\s*=\s*"([^"]+)"', 2) AS value
  FROM documents
), h AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM d)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(length(array_to_string(rest[1:i], '')) + coalesce(length(array_to_string(hit[1:i - 1], '')), 0) AS INTEGER) AS start,
  lower(name[i]) AS name, CAST(length(value[i]) AS INTEGER) AS size
FROM h
""")
def hardcoded_secret_scan(t):
    """A row for each secret: which of its document's it is, and the characters before it."""
    all_of = lambda group: F.regexp_extract_all("text", F.lit(SECRET), F.lit(group))
    sizes = lambda texts: F.transform(texts, F.length)
    docs = t("documents").filter(F.col("text").rlike(SECRET))
    docs = docs.select("doc_id", sizes(F.split("text", SECRET)).alias("rest"), sizes(all_of(0)).alias("hit"), F.transform(all_of(1), F.lower).alias("name"), sizes(all_of(2)).alias("size"))
    docs = docs.select("doc_id", "rest", "hit", F.posexplode(F.arrays_zip("name", "size")).alias("pos", "found"))
    total = lambda texts, n: F.aggregate(F.slice(texts, 1, n), F.lit(0), lambda a, x: a + x)
    start = total("rest", F.col("pos") + 1) + total("hit", F.col("pos"))
    return docs.select("doc_id", "pos", start.alias("start"), "found.name", "found.size")


# ---- convergence

LEVELS = {"error": "confirmed", "purchase": "suspected", "click": "possible"}


def seeded(t) -> DataFrame:
    events = t("events").filter(F.col("event_type").isin("error", "purchase", "click"))
    people = t("customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey", "c_mktsegment")
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = events.join(people, "user_id", "left").join(nations, "c_nationkey", "left")
    level = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in LEVELS.items()))
    return rows.select("event_id", "user_id", "ts", "event_type", "value", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("external")).alias("function"), F.coalesce("n_name", F.lit("?")).alias("file"), F.coalesce("c_mktsegment", F.lit("none")).alias("api"), level.alias("suspicion"))


SEEDED = """
seeded AS (
  SELECT event_id, user_id, ts, event_type, value, coalesce(nullif(c_name, ''), 'external') AS function, coalesce(n_name, '?') AS file, coalesce(c_mktsegment, 'none') AS api,
    CASE event_type WHEN 'error' THEN 'confirmed' WHEN 'purchase' THEN 'suspected' ELSE 'possible' END AS suspicion
  FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE event_type IN ('error', 'purchase', 'click')
)
"""


@query(f"WITH {SEEDED} SELECT event_id, function, file, api, suspicion FROM seeded")
def seed_candidates(t):
    return seeded(t).select("event_id", "function", "file", "api", "suspicion")


@query("""
WITH d AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, min(event_id) OVER (PARTITION BY user_id, event_type) AS seq FROM events)
SELECT event_id, user_id, event_type, seq FROM d WHERE n = 1
""")
def converge_dedup(t):
    rows = t("events").select("event_id", "user_id", "event_type", "ts", F.col("event_id").alias("seq"))
    return converge.deduplicated(rows, ["user_id", "event_type"], "ts", "seq").select("event_id", "user_id", "event_type", "seq")


def severity():
    return F.when(F.col("api") == "MACHINERY", "critical").when(F.col("api") == "BUILDING", "high").when(F.col("api") == "AUTOMOBILE", "medium").when(F.col("api") == "none", "").otherwise("low")


SCORE = """
0.6 * (CASE api WHEN 'MACHINERY' THEN 100 WHEN 'BUILDING' THEN 80 WHEN 'AUTOMOBILE' THEN 60 WHEN 'none' THEN 20 ELSE 40 END)
+ 25.0 * (CASE suspicion WHEN 'confirmed' THEN 1.0 WHEN 'suspected' THEN 0.7 ELSE 0.5 END) + (CASE WHEN api IN ('MACHINERY', 'BUILDING') THEN 3.0 ELSE 0.0 END)
"""


@query(f"""
WITH {SEEDED}, s AS (SELECT event_id, file, event_type, ts, CAST(round({SCORE}, 6) AS DOUBLE) AS score FROM seeded)
SELECT event_id, score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, file, ts, event_id) AS rank FROM s
""")
def rank_candidates(t):
    score = F.round(S.rank_score(severity(), F.col("suspicion")), 6)
    return converge.ranked(seeded(t), score, "file", "ts", "event_id", ["event_type"]).select("event_id", "score", F.col("rank").cast("long").alias("rank"))


CHAIN = ("low_value", "external", "household")


def chained(t) -> DataFrame:
    chain = (("low_value", F.col("value") < 20), ("external", F.col("function") == "external"), ("household", F.col("api") == "HOUSEHOLD"))
    return converge.tagged(seeded(t), chain)


TAGGED = f"""
{SEEDED}, tagged AS (SELECT *, CASE WHEN value < 20 THEN 'low_value' WHEN function = 'external' THEN 'external' WHEN api = 'HOUSEHOLD' THEN 'household' END AS drop_filter FROM seeded)
"""


@query(f"""
WITH {TAGGED}, c AS (SELECT event_type, count(*) AS n, count(*) FILTER (drop_filter = 'low_value') AS a, count(*) FILTER (drop_filter = 'external') AS b, count(*) FILTER (drop_filter = 'household') AS d FROM tagged GROUP BY 1)
SELECT event_type, 0 AS step, 'low_value' AS filter, n AS rows_in, n - a AS rows_out FROM c
UNION ALL SELECT event_type, 1, 'external', n - a, n - a - b FROM c UNION ALL SELECT event_type, 2, 'household', n - a - b, n - a - b - d FROM c
""")
def filter_chain_stats(t):
    return converge.chain_stats(chained(t), CHAIN, ["event_type"])


@query(f"""
WITH {TAGGED}, n AS (SELECT event_type, drop_filter, count(*) AS dropped FROM tagged WHERE drop_filter IS NOT NULL GROUP BY ALL)
SELECT event_type, drop_filter, event_id, dropped FROM tagged JOIN n USING (event_type, drop_filter)
""")
def dismissed_ledger(t):
    """Every dropped candidate, a row each, with how many its filter has dropped of its type."""
    return converge.ledger(chained(t), ["event_type"]).select("event_type", "drop_filter", "event_id", "dropped")


@query(f"""
WITH {TAGGED}, kept AS (SELECT * FROM tagged WHERE drop_filter IS NULL AND NOT EXISTS (
    SELECT 1 FROM events g WHERE g.event_type = 'view' AND g.user_id = tagged.user_id AND tagged.ts BETWEEN g.ts AND g.ts + INTERVAL 1 HOUR)),
d AS (SELECT *, row_number() OVER (PARTITION BY file, function, event_type ORDER BY ts, event_id) AS n FROM kept),
s AS (SELECT *, CAST(round({SCORE}, 6) AS DOUBLE) AS score FROM d WHERE n = 1)
SELECT event_id, event_type, file, function, suspicion, score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, file, ts, event_id) AS rank FROM s
""")
def candidate_convergence(t):
    """Seed, filter chain, interval anti-join, dedup and rank in one plan."""
    kept = chained(t).filter("drop_filter is null").drop("drop_filter")
    guards = t("events").filter("event_type = 'view'").select("user_id", F.col("ts").alias("scope_start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("scope_end"))
    kept = joins.in_scope(kept, guards, ["user_id"], "ts", "scope_start", "scope_end", "left_anti").withColumn("seq", F.col("event_id"))
    one = converge.deduplicated(kept, ["file", "function", "event_type"], "ts", "seq")
    score = F.round(S.rank_score(severity(), F.col("suspicion")), 6)
    return converge.ranked(one, score, "file", "ts", "event_id", ["event_type"]).select("event_id", "event_type", "file", "function", "suspicion", "score", F.col("rank").cast("long").alias("rank"))


@query("""
WITH p AS (SELECT page_id, split_part(url, '://', 2) AS path FROM pages), h AS (SELECT split_part(path, '/', 1) AS host FROM p ORDER BY page_id LIMIT 1)
SELECT page_id, path FROM p, h WHERE path = host OR starts_with(path, host || '/') OR path = ''
""")
def scope_to_target(t):
    """The pages of the first page's host."""
    pages = t("pages").select("page_id", F.split_part("url", F.lit("://"), F.lit(2)).alias("path"))
    host = pages.agg(F.min_by(F.split_part("path", F.lit("/"), F.lit(1)), "page_id")).first()[0]
    return converge.below(pages, host or "/")


# ---- verdicts and reports


@query("""
WITH l AS (SELECT labels.*, lang FROM labels JOIN documents USING (doc_id)),
o AS (SELECT doc_id, quality AS status, 'review' || toxic AS review FROM l WHERE lang <> 'de'), n AS (SELECT doc_id, 1 - quality AS status FROM l WHERE lang <> 'es')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(o.review, 'none') AS review FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def finding_upsert(t):
    """German documents' verdicts are new, Spanish ones' stay, the others' change and keep their review."""
    labels = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    old = labels.filter("lang <> 'de'").select("doc_id", F.col("quality").alias("status"), F.concat(F.lit("review"), F.col("toxic").cast("string")).alias("review"))
    new = labels.filter("lang <> 'es'").select("doc_id", (1 - F.col("quality")).alias("status"))
    return merging.upsert(old, new, ["doc_id"], ["review"], {"review": "none"})


@query("""
SELECT doc_id, CASE WHEN review = 'confirmed' THEN 'confirmed' WHEN review = 'dismissed' THEN 'dismissed' WHEN review = 'suspected-kept' THEN 'suspected' ELSE status END AS effective
FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'suspected' ELSE 'open' END AS status, CASE WHEN toxic = 1 THEN 'confirmed' WHEN lang = 'de' THEN 'dismissed' WHEN lang = 'fr' THEN 'suspected-kept' ELSE '' END AS review FROM labels JOIN documents USING (doc_id))
""")
def effective_status(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    rows = rows.select("doc_id", F.when(F.col("quality") == 1, "suspected").otherwise("open").alias("status"), F.when(F.col("toxic") == 1, "confirmed").when(F.col("lang") == "de", "dismissed").when(F.col("lang") == "fr", "suspected-kept").otherwise("").alias("review"))
    return rows.select("doc_id", S.effective_status(F.col("status"), F.col("review")).alias("effective"))


@query("""
SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) AS seeds, count(*) FILTER (value > 50) AS finals, CAST(round(100.0 * count(*) FILTER (value <= 50) / count(*), 6) AS DOUBLE) AS efficiency FROM events GROUP BY ROLLUP (event_type)
""")
def audit_rollup(t):
    finals = F.count(F.when(F.col("value") > 50, 1))
    gone = F.count(F.when(F.col("value") <= 50, 1))
    out = t("events").rollup("event_type").agg(F.count("*").alias("seeds"), finals.alias("finals"), F.round(100.0 * gone / F.count("*"), 6).alias("efficiency"))
    return out.withColumn("event_type", F.coalesce("event_type", F.lit("TOTAL")))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def props_from_json(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name
""")
def readonly_sql_guard(t):
    """In a session of its own, so that the caller's views stay as they are."""
    from .operators.sqlguard import checked

    session = t.spark.newSession()
    for name in ("orders", "customer", "nation"):
        session.read.parquet(f"{t.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return session.sql(checked("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name"))


# ---- C from tables: a scan whose results the tables foretell

TEMPLATES = (
    "int f{k}(int a, int b) {\n  return a / b;\n}\n\n\n",
    "int f{k}(int a, int b) {\n  if (b == 0)\n    return 0;\n  return a / b;\n}\n",
    "void f{k}(char *c) {\n  system(c);\n}\n\n\n",
    "void f{k}(char *c) {\n  free(c);\n  free(c);\n}\n\n",
    "void f{k}(char *s) {\n  char b[8];\n  strcpy(b, s);\n}\n\n",
    "static void f{k}(char *c) {\n  system(c);\n}\n\n\n",
)


@query("""
WITH f AS (SELECT p_partkey AS k, p_partkey % 6 AS kind, 'src/size_' || CAST(p_size AS VARCHAR) || '.c' AS path, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) * 6 + 1 AS start FROM part)
SELECT 'divide-by-zero' AS vuln_type, path, 'f' || k AS function, CAST(start + 1 AS INTEGER) AS line, 'suspected' AS suspicion, 'CWE-369' AS cwe FROM f WHERE kind = 0
UNION ALL SELECT 'injection', path, 'f' || k, CAST(start + 1 AS INTEGER), 'suspected', 'CWE-78' FROM f WHERE kind = 2
UNION ALL SELECT 'double-free', path, 'f' || k, CAST(start + 2 AS INTEGER), 'confirmed', 'CWE-415' FROM f WHERE kind = 3
UNION ALL SELECT 'buffer-overflow', path, 'f' || k, CAST(start + 2 AS INTEGER), 'suspected', 'CWE-787' FROM f WHERE kind = 4
""")
def c_scan_generated(t):
    """A C function for each part, a file for each size, and a whole scan over them."""
    from .plans import engine as plans

    text = F.coalesce(*(F.when(F.col("p_partkey") % len(TEMPLATES) == i, F.replace(F.lit(x + "\n"), F.lit("{k}"), F.col("p_partkey").cast("string"))) for i, x in enumerate(TEMPLATES)))
    rows = t("part").select(F.concat(F.lit("src/size_"), F.col("p_size").cast("string"), F.lit(".c")).alias("path"), F.struct("p_partkey", text.alias("text")).alias("f"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["text"]), "").alias("source"))
    found = plans.scan_files(closure.cut(files.select("path", F.sha2("source", 256).alias("checksum"), S.line_count(F.col("source")).alias("loc"), "source")))
    return found.ranked.select("vuln_type", "path", "function", "line", "suspicion", "cwe")
