"""A scan: facts, program fixpoints, events, candidates of all types through their chains in one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import knowledge as kb
from ..functions import scalars as S
from ..operators import closure, converge, graph, joins
from ..sources.tree import read_tree
from . import summaries
from .kernel import ACROSS, TEXT_OF, dealt, edges_again, facts_again, mentioning, possible
from .kernel import facts as extract_facts
from .registry import DEFINITE_NULL, FRAGMENTS, NO_WAY, NULLABLE, SOURCES, TAINTED, TOCTOU, TYPES, VulnType
from .verdicts import FLOW_FILTERS, RESULT, judge


def links_of(facts: DataFrame, kind: str) -> DataFrame:
    """(path, src, dst) of all files' summary edges of a kind."""
    return facts.filter((F.col("record") == "summary") & (F.col("kind") == kind)).select("path", "src", "dst")


def fixpoint(links: DataFrame, *sources: str) -> DataFrame:
    """(root, node) for abstract nodes that each of the sources leads to."""
    start = links.sparkSession.createDataFrame([(s, s) for s in sources], "root string, node string")
    return closure.reach(links.select("src", "dst"), start)


def far_passing(links: DataFrame, passing: DataFrame) -> DataFrame:
    """(path, far): for each file the functions it calls that return a parameter as it is and that it doesn't know of itself, as JSON of name:parameter."""
    known = F.split(F.substring("src", len("calls:") + 1, 1 << 20), ",")
    calls = links.filter(F.col("src").startswith("calls:")).select("path", F.col("dst").alias("name"), known.alias("known"))
    own = passing.filter(F.col("node").startswith("pass:")).select(F.split_part("node", F.lit(":"), F.lit(2)).alias("name"), F.split_part("node", F.lit(":"), F.lit(3)).alias("at"))
    far = calls.join(own, "name").filter(~F.array_contains("known", F.col("at")))
    return far.groupBy("path").agg(F.to_json(F.sort_array(F.collect_set(F.concat_ws(":", "name", "at")))).alias("far"))


@dataclass
class Scan:
    """What a scan has found; every table is written to the shared folder or derived from such."""

    files: DataFrame
    facts: DataFrame
    edges: DataFrame
    nodes: DataFrame
    events: DataFrame
    candidates: DataFrame  # all seeds with drop_filter, suspicion and source_line
    ranked: DataFrame
    null_nodes: DataFrame
    taint_nodes: DataFrame

    def summaries(self) -> DataFrame:
        return function_summaries(self.facts, self.null_nodes, self.taint_nodes)

    def kept(self) -> DataFrame:
        return self.ranked

    def dropped(self) -> DataFrame:
        return self.candidates.filter("drop_filter is not null").select("vuln_type", "path", "function", "variable", "line", F.col("drop_filter").alias("filter"))

    def ledger(self) -> DataFrame:
        """How many candidates each filter has dropped of each type; dropped() has them, a row each."""
        return self.dropped().groupBy("vuln_type", "filter").agg(F.count("*").alias("dropped"))

    def errors(self) -> DataFrame:
        """(stage, path, error) of files that couldn't be read and filters that couldn't decide."""
        read = self.facts.filter("record = 'error'").select(F.lit("parse").alias("stage"), "path", F.col("note").alias("error"))
        return read.unionByName(self.candidates.filter("error is not null").select(F.lit("filter").alias("stage"), "path", "error"))

    def stats(self) -> DataFrame:
        """Seeds, rows that pass the chain, and results for every type."""
        seeds = self.candidates.groupBy("vuln_type").agg(F.count("*").alias("seed_count"), F.count(F.when(F.col("drop_filter").isNull(), 1)).alias("passed"))
        final = self.ranked.groupBy("vuln_type").agg(F.count("*").alias("final_count"))
        types = self.files.sparkSession.createDataFrame([(t,) for t in sorted(TYPES)], "vuln_type string")
        return types.join(seeds, "vuln_type", "left").join(final, "vuln_type", "left").na.fill(0, ["seed_count", "passed", "final_count"])


def function_summaries(facts: DataFrame, null_nodes: DataFrame, taint_nodes: DataFrame) -> DataFrame:
    """For each function of the program: whether it may return null or taint, and which parameters are tainted."""
    names = facts.filter("record = 'function'").select("function").distinct()
    flag = lambda nodes, name: nodes.filter(F.col("node").startswith("ret:")).select(F.substring("node", 5, 1 << 20).alias("function"), F.lit(True).alias(name))
    params = taint_nodes.filter(F.col("node").startswith("par:")).select(F.split_part("node", F.lit(":"), F.lit(2)).alias("function"), F.split_part("node", F.lit(":"), F.lit(3)).cast("int").alias("at"))
    params = params.groupBy("function").agg(F.array_join(F.sort_array(F.collect_set("at")), ",").alias("tainted_params"))
    out = names.join(flag(null_nodes, "return_nullable"), "function", "left").join(flag(taint_nodes, "return_tainted"), "function", "left").join(params, "function", "left")
    return out.na.fill(False, ["return_nullable", "return_tainted"]).na.fill("", ["tainted_params"])


def outside(facts: DataFrame) -> DataFrame:
    """(path, outside): for each file what it must know of others, as JSON. Deeds of functions it calls and doesn't have, and how often other files start its functions as threads."""
    functions = facts.filter("record = 'function'").select("path", "function").distinct()
    deeds = facts.filter("record = 'deed'").groupBy("function").agg(F.sort_array(F.collect_set(F.struct("kind", "col", "src", "note"))).alias("deeds"))
    calls = facts.filter("record = 'edge' and kind = 'CALL'").select("path", F.col("dst").alias("function")).distinct()
    far = calls.join(functions, ["path", "function"], "left_anti").join(deeds, "function")
    far = far.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("function", "deeds"))).alias("deeds"))
    starts = facts.filter("record = 'thread'").select(F.col("path").alias("starter"), F.col("src").alias("function"), "col")
    started = starts.join(functions, "function").filter("starter <> path").groupBy("path", "function").agg(F.sum("col").alias("n"))
    started = started.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("function", "n"))).alias("threads"))
    return far.join(started, "path", "full").select("path", F.to_json(F.struct("deeds", "threads")).alias("outside"))


def reached(facts: DataFrame, entries: Sequence[str]) -> DataFrame:
    """Names of functions that other files see, of entries, and of what these lead to over calls. Only calls of functions that no file else could call need following: the rest is reached already."""
    functions = facts.filter("record = 'function'")
    start = functions.filter((F.col("note") != "static") | F.col("function").isin(*entries)).select("function").distinct()
    hidden = closure.cut(functions.filter("note = 'static'").select("function").distinct().join(start, "function", "left_anti"))
    calls = facts.filter("record = 'edge' and kind = 'CALL'").select(F.col("function").alias("src"), F.col("dst").alias("function")).join(hidden, "function", "left_semi")
    links = closure.cut(calls.select("src", F.col("function").alias("dst")).distinct())
    first = links.select(F.col("src").alias("function")).distinct().join(start, "function", "left_semi")
    return start.unionByName(closure.reach(links, first.select(F.lit("entry").alias("root"), F.col("function").alias("node"))).select(F.col("node").alias("function"))).distinct()


def program_events(facts: DataFrame, null_nodes: DataFrame | None, again: DataFrame | None, known: DataFrame | None, types: frozenset[str] = frozenset(SOURCES)) -> DataFrame:
    """The files' events, less results of functions known not to be null, plus those that need the whole program.

    again has the events of ACROSS anew for the files in known, which replace their first ones. Events of
    other types than those asked for may be missing; what only others need may be None.
    """
    first = facts.filter("record = 'event'")
    if again is not None:
        first = first.join(known.select("path", F.explode(F.array(*map(F.lit, ACROSS))).alias("detector")), ["path", "detector"], "left_anti").unionByName(again.filter("record = 'event'"))
    e = first.select("path", "function", F.col("kind").alias("event_type"), "line", "col", "props", "detector")
    if not types.isdisjoint(OF_NULLS):
        e = with_nulls(e, facts, null_nodes)
    return e.unionByName(deadlocks(e)) if "DEADLOCK" in types else e


#: Of taint's edges those that only say which functions return a parameter as it is.
PASSING = r"^pass(:|$)"
#: Types of events that depend on which functions may return null.
OF_NULLS = ("NULL_VALUE", "DEREFERENCE")


def with_nulls(e: DataFrame, facts: DataFrame, null_nodes: DataFrame) -> DataFrame:
    """The events less results of functions known not to be null, plus nulls that go to where they are followed."""
    functions = facts.filter("record = 'function'").select(F.col("function").alias("callee"), F.col("kind").alias("return_type"), (F.col("props")["pointer"] == "true").alias("pointer"))
    nullable = null_nodes.filter(F.col("node").startswith("ret:")).select(F.substring("node", 5, 1 << 20).alias("callee"), F.lit(True).alias("nullable"))
    known = functions.groupBy("callee").agg(F.bool_and(F.col("return_type").isin(*sorted(kb.NEVER_NULL_TYPES)) & ~F.col("pointer")).alias("never")).join(nullable, "callee", "left").select("callee", F.coalesce("nullable", F.lit(False)).alias("nullable"), "never")
    results = e.filter((F.col("event_type") == "NULL_VALUE") & (F.col("props")["origin"] == "call_result")).withColumn("callee", F.col("props")["callee"])
    results = results.join(known, "callee", "left").filter(F.col("never").isNull() | (F.col("nullable") & ~F.col("never"))).drop("callee", "nullable", "never")
    rest = e.filter(~((F.col("event_type") == "NULL_VALUE") & F.coalesce(F.col("props")["origin"] == "call_result", F.lit(False))))
    e = rest.unionByName(results)

    # a null goes to a parameter that its function follows unguarded
    values = e.filter("event_type = 'NULL_VALUE'").select("path", "function", F.col("props")["variable"].alias("variable"), F.col("line").alias("null_line"))
    sent = e.filter("event_type = 'ARGUMENT'").select("path", "function", "line", "col", F.col("props")["variable"].alias("variable"), F.col("props")["callee"].alias("callee"), F.col("props")["index"].alias("index"))
    follows = e.filter("event_type = 'PARAM_DEREF'").select(F.col("function").alias("callee"), F.col("props")["index"].alias("index")).distinct()
    over = sent.join(values, ["path", "function", "variable"]).filter("null_line <= line").join(follows, ["callee", "index"])
    over = over.select("path", "function", F.lit("DEREFERENCE").alias("event_type"), "line", "col", F.map_from_arrays(F.array(F.lit("variable"), F.lit("callee"), F.lit("origin")), F.array("variable", "callee", F.lit("interprocedural"))).alias("props"), F.lit("interprocedural").alias("detector")).dropDuplicates(["path", "function", "line", "col"])
    return e.unionByName(over)


def deadlocks(e: DataFrame) -> DataFrame:
    """Locks that can be taken in a circle."""
    order = e.filter("event_type = 'LOCK_ORDER'").select("path", "function", "line", "col", F.col("props")["mutex_a"].alias("src"), F.col("props")["mutex_b"].alias("dst"))
    rings = closure.strong_components(order.select("src", "dst"))
    names = rings.groupBy("component").agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias("cycle"))
    inside = order.join(rings.select(F.col("node").alias("src"), "component"), "src").join(rings.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").filter("component = c2")
    first = joins.first_of(inside, ["component"], [F.col("path"), F.col("line"), F.col("col")]).join(names, "component")
    return first.select("path", "function", F.lit("DEADLOCK").alias("event_type"), "line", "col", F.map_from_arrays(F.array(F.lit("variable"), F.lit("mutex_a"), F.lit("mutex_b")), F.array("cycle", "src", "dst")).alias("props"), F.lit("deadlock").alias("detector"))


def seeds(events: DataFrame, types: Sequence[VulnType]) -> DataFrame:
    """Candidates of all types: an event is one of each type that takes its kind and category."""
    spark = events.sparkSession
    table = spark.createDataFrame([(t.seed, t.name, t.suspicion, list(t.categories), dict(t.tiers)) for t in types], "event_type string, vuln_type string, suspicion string, categories array<string>, tiers map<string,string>")
    p = F.col("props")
    rows = events.join(F.broadcast(table), "event_type").withColumn("category", p["category"])
    rows = rows.filter((F.size("categories") == 0) | F.array_contains("categories", F.col("category")))
    variable = F.coalesce(F.nullif(p["variable"], F.lit("")), p["expression"], F.lit(""))
    api = F.coalesce(F.nullif(p["function"], F.lit("")), p["api"], F.lit(""))
    rows = rows.select("vuln_type", "path", "function", "line", "col", variable.alias("variable"), api.alias("api"), "category", F.coalesce(F.try_element_at("tiers", F.col("category")), "suspicion").alias("suspicion"), "props")
    # a row's place is what it says, so that no type's rows need one task to be numbered
    place = F.struct("path", "line", "col", "variable", F.coalesce("category", F.lit("")).alias("category"), F.xxhash64(F.to_json("props")).alias("props"))
    return rows.withColumn("seq", place).dropDuplicates(["vuln_type", "seq"])


def flow_verdicts(rows: DataFrame, files: DataFrame, nodes: Callable[[str], DataFrame], known: DataFrame | None, asked: Sequence[tuple[str, str]]) -> DataFrame:
    """(vuln_type, seq, filter, keep, confirmed, source_line, error) of the filters that follow a function's flow, for the (type, filter) asked. known may be None if none of these asks for other files' deeds."""
    spark = rows.sparkSession
    filters = {f for _, f in asked}
    wanted = spark.createDataFrame(list(asked), "vuln_type string, filter string")
    text = F.to_json(F.struct(F.xxhash64("vuln_type", "seq").alias("seq"), "filter", "function", "line", "variable", "props"))
    by_file = rows.join(F.broadcast(wanted), "vuln_type").groupBy("path").agg(F.collect_list(text).alias("candidates"))
    program = by_file.join(files.select("path", "source"), "path")
    if not filters.isdisjoint(("nullable_source", "taint_source")):
        program = closure.cut(program)
    # a file needs the facts on the functions that it calls or has
    named = program.select("path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name"))

    def of(kind: str, prefix: str, column: str) -> DataFrame:
        own = nodes(kind).filter(F.col("node").startswith(prefix)).select(F.substring("node", len(prefix) + 1, 1 << 20).alias("value"))
        own = own.withColumn("name", F.substring_index("value", ":", 1))
        return named.join(own, "name").groupBy("path").agg(F.collect_set("value").alias(column))

    for f, kind, prefix, column in (("nullable_source", "null", "ret:", "nullable"), ("taint_source", "taint", "ret:", "tainted"), ("taint_source", "open", "par:", "params"), ("taint_source", "pass", "pass:", "passing")):
        program = program.join(of(kind, prefix, column), "path", "left") if f in filters else program.withColumn(column, F.lit(None).cast("array<string>"))
    program = program.join(known, "path", "left") if known is not None else program.withColumn("outside", F.lit(None).cast("string"))
    got = dealt(program.select("path", "source", "candidates", "nullable", "tainted", "params", "passing", "outside")).mapInPandas(judge, RESULT)
    keys = rows.select("vuln_type", "seq", F.xxhash64("vuln_type", "seq").alias("k"))
    return keys.join(got.withColumnRenamed("seq", "k"), "k").drop("k")


#: What a filter asks of the facts, beside the candidate and its function's flow. Flow filters of DEEDS follow other files' deeds too.
EVENTS_OF = {"array_oob_precedence": "BUFFER_ACCESS", "guard": "NULL_GUARD", "memory_release": "MEMORY_RELEASE", "resource_release": "RESOURCE_RELEASE"}
EDGES_OF = {"call_reach": "CALL", "ownership_transfer": "OWNERSHIP_TRANSFER", "shared_access": "GLOBAL_ACCESS", "lock_order": "LOCK_ORDER"}
NODES_OF = {"nullable_source": "null", "taint_source": "taint"}
DEEDS = ("lifetime", "double_free_flow", "definite_init")
OUTSIDE = ("function", "deed", "thread", "edge:CALL")
#: Of it what leaks ask: all of files that may free something, and of those that allocate.
OF_LEAKS = ("frees", "deed?", "thread?", "function?", "edge:CALL?")
#: Filters that a candidate's own properties decide, which no event that is made over files has, and what must be in a file for them to drop one.
OWN_FILTERS = {"sizeof_pseudo_deref": "sized", "non_nullable_array_suppress": "array"}
#: What call_reach asks: all of files that may hide a function, and of those with candidates.
REACH = ("static", "function?", "edge:CALL?")
#: Facts of all files that have those of some files.
IMPLIED = {"static": "function", "frees": "deed", "sized": "event:dereference", "array": "event:dereference"}
EVERYTHING = frozenset(("function", "variable", "deed", "thread", "event", "edge", "summary", *(f"event:{d}" for own in SOURCES.values() for d in own), *(f"edge:{k}" for k in summaries.EDGES), "summary:null", "summary:taint"))


class Parts:
    """A scan of which only what is asked for is found, over all files, and each part once.

    A question names all facts that it needs first, so that one parse gives them.
    """

    def __init__(self, files: DataFrame, entries: Sequence[str] = ("main",), facts: DataFrame | None = None):
        self.given, self.entries = files, entries
        self.found: dict[frozenset[str], DataFrame] = {} if facts is None else {EVERYTHING: facts}
        #: As what they were asked for, which may be of some files only.
        self.asked: dict[frozenset[str], frozenset[str]] = {}
        self.kept: dict[tuple, DataFrame] = {}

    def once(self, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = closure.cut(make())
        return self.kept[name]

    def more(self, kind: str, wanted: Sequence) -> DataFrame | None:
        """A table with more than is wanted that is there already."""
        return next((rows for name, rows in self.kept.items() if name[0] == kind and set(wanted) <= set(name[1:])), None)

    @property
    def files(self) -> DataFrame:
        """The files, written once: who reads them more than once asks for them before the facts."""
        return self.once(("files",), lambda: self.given)

    def facts(self, *wanted: str) -> DataFrame:
        """Rows with at least the facts wanted."""
        need = frozenset(wanted)
        have = self.having(need)
        if have is None:
            files = self.kept.get(("files",), self.given)
            have = frozenset(w.removesuffix("?") for w in need).difference(IMPLIED)
            self.asked[have] = need if possible(need) else have
            self.found[have] = closure.cut(extract_facts(files) if need == EVERYTHING else extract_facts(files, sorted(need)))
        return self.found[have]

    def having(self, need: Sequence[str]) -> frozenset[str] | None:
        """The facts found already that have those needed."""
        return next((own for own in self.found if all({w, w.removesuffix("?"), IMPLIED.get(w)} & self.asked.get(own, own) for w in need)), None)

    def reached(self, needs: Sequence[str], rows: DataFrame) -> DataFrame:
        """reached() as far as the rows ask. Where only some files were parsed, the others hide no function, so that their calls count only if they name a hidden one that nothing else leads to: such files are parsed too."""
        facts = self.facts(*needs)
        found = reached(facts, self.entries)
        have = self.having(needs)
        if not possible(self.asked.get(have, have)):
            return found
        found = closure.cut(found)
        if rows.filter("function <> ''").join(found, "function", "left_anti").isEmpty():
            return found
        hidden = facts.filter("record = 'function' and note = 'static'").select("function").join(found, "function", "left_anti").select(F.col("function").alias("name"))
        others = self.kept.get(("files",), self.given).filter(~F.col("source").rlike(TEXT_OF["static"]))
        more = extract_facts(mentioning(others, closure.cut(hidden.distinct())), ("function", "edge:CALL"))
        return reached(facts.unionByName(closure.cut(more)), self.entries)

    def nodes(self, kind: str) -> DataFrame:
        """What null or taint lead to; open: what taint or unknown callers do; pass: which functions return a parameter as it is."""
        if kind in ("taint", "open"):
            found = self.once(("nodes", "taint", "open"), lambda: fixpoint(self.taint_links(), "taint", "open"))
            return found.filter("root = 'taint'").select("node") if kind == "taint" else found.select("node").distinct()
        links = lambda: self.own_links().filter(F.col("src").rlike(PASSING)) if kind == "pass" else links_of(self.facts(f"summary:{kind}"), kind)
        return self.once(("nodes", kind), lambda: fixpoint(links(), kind).select("node"))

    def own_links(self) -> DataFrame:
        return links_of(self.facts("summary:taint"), "taint")

    def taint_links(self) -> DataFrame:
        """Taint's edges. Files that call a function of another that returns a parameter as it is give theirs anew, knowing it."""
        own = self.own_links()
        links = own.filter(~F.col("src").rlike(PASSING) & ~F.col("src").startswith("calls:"))
        far = closure.cut(far_passing(own, self.nodes("pass")))
        if far.isEmpty():
            return links
        again = closure.cut(edges_again(self.kept.get(("files",), self.given), far))
        return links.join(far, "path", "left_anti").unionByName(links_of(again, "taint"))

    @staticmethod
    def edge_needs(kinds: Sequence[str]) -> set[str]:
        return {f"edge:{k}" for k in kinds} | ({"function"} if set(kinds) & set(graph.CALLED) else set())

    def edges(self, *kinds: str) -> DataFrame:
        if (more := self.more("edges", kinds)) is not None:
            return more.filter(F.col("edge_type").isin(*kinds))
        return self.once(("edges", *sorted(kinds)), lambda: graph.edges(self.facts(*self.edge_needs(kinds)), kinds))

    def known(self, needs: Sequence[str] = OUTSIDE) -> DataFrame:
        return self.once(("known", *sorted(needs)), lambda: outside(self.facts(*needs)))

    @staticmethod
    def event_needs(types: Sequence[str]) -> set[str]:
        detectors = {d for t in types for d in SOURCES[t]}
        return {f"event:{d}" for d in detectors} | set(OF_LEAKS if detectors & set(ACROSS) == {"memory_leak"} else OUTSIDE if detectors & set(ACROSS) else ()) | ({"function", "summary:null"} if set(types) & set(OF_NULLS) else set())

    def events(self, *types: str) -> DataFrame:
        if (more := self.more("events", types)) is not None:
            return more.filter(F.col("event_type").isin(*types))

        def make() -> DataFrame:
            across = [d for d in ACROSS if any(d in SOURCES[t] for t in types)]
            files = self.files if across else None
            facts = self.facts(*self.event_needs(types))
            nulls = self.nodes("null") if set(types) & set(OF_NULLS) else None
            known = self.known(self.event_needs(types)) if across else None
            again = closure.cut(facts_again(files, known, across)) if across else None
            return program_events(facts, nulls, again, known, frozenset(types)).filter(F.col("event_type").isin(*types))

        return self.once(("events", *sorted(types)), make)

    def candidates(self, types: Sequence[VulnType], last: str | None = None) -> DataFrame:
        """Candidates of the types with drop_filter, suspicion and source_line; last: each chain only up to this filter, where no other is asked for."""
        if (more := self.more("candidates", [None, *(t.name for t in types)])) is not None:
            return more.filter(F.col("vuln_type").isin(*(t.name for t in types)))
        return self.once(("candidates", last, *sorted(t.name for t in types)), lambda: self.decided(types, {t.name: t.filters[: t.filters.index(last) + 1] if last else t.filters for t in types}))

    def dropped(self, types: Sequence[VulnType], by: str) -> DataFrame:
        """The candidates that a filter drops."""
        chains = {t.name: t.filters[: t.filters.index(by) + 1] for t in types}
        if by in OWN_FILTERS and all(set(chain) <= OWN_FILTERS.keys() for chain in chains.values()) and self.more("candidates", [None, *chains]) is None:
            rows = self.once(("dropped", by, *sorted(chains)), lambda: self.decided(types, chains, (OWN_FILTERS[by], "event:dereference?")))
        else:
            rows = self.candidates(types, by)
        return rows.filter(F.col("drop_filter") == by)

    def decided(self, types: Sequence[VulnType], chains: dict[str, Sequence[str]], followed: Sequence[str] = ("event:dereference",)) -> DataFrame:
        filters = {f for chain in chains.values() for f in chain}
        asked = [(t, f) for t, chain in chains.items() for f in chain if f in FLOW_FILTERS]
        kinds = {t.seed for t in types} | {EVENTS_OF[f] for f in filters & set(EVENTS_OF)}
        needs = self.event_needs(kinds) | self.edge_needs([EDGES_OF[f] for f in filters & {"shared_access", "lock_order"}]) | {f"summary:{NODES_OF[f]}" for f in filters & set(NODES_OF)}
        needs |= set(OUTSIDE) if filters & set(DEEDS) else set()
        needs |= (set(REACH) if "call_reach" in filters else set()) | ({"edge:OWNERSHIP_TRANSFER?"} if "ownership_transfer" in filters else set())
        own = filters <= OWN_FILTERS.keys() and kinds == {"DEREFERENCE"}
        files = self.files if asked or any(f"event:{d}" in needs for d in ACROSS) else None
        self.facts(*(followed if own else needs))
        if own:
            events = program_events(self.facts(*followed), None, None, None, frozenset()).filter("event_type = 'DEREFERENCE'")
        else:
            events = self.events(*kinds)
        rows = closure.cut(seeds(events, types))

        # what the relational filters ask, each joined once for all types
        place = ["path", "function", "variable"]
        yes = lambda x: F.coalesce(x, F.lit(False))
        flag = lambda name: yes(F.col(name))
        c = rows.withColumns({"mutex_a": F.col("props")["mutex_a"], "mutex_b": F.col("props")["mutex_b"]})
        sure = F.lit(False)
        if "call_reach" in filters:
            c = c.join(self.reached(needs, rows).select("function", F.lit(True).alias("reached")), "function", "left")
        released = lambda kind, name: events.filter(F.col("event_type") == kind).select("path", "function", F.col("props")["variable"].alias("variable"), F.lit(True).alias(name)).distinct()
        for f, name in (("memory_release", "memory_released"), ("resource_release", "resource_released")):
            if f in filters:
                c = c.join(released(EVENTS_OF[f], name), place, "left")
        if "ownership_transfer" in filters:
            c = c.join(graph.edges(self.facts(*needs), ["OWNERSHIP_TRANSFER"]).select("path", "function", F.col("src").alias("variable"), F.lit(True).alias("moved")).distinct(), place, "left")
        if "array_oob_precedence" in filters:
            c = c.join(events.filter("event_type = 'BUFFER_ACCESS'").select("path", "line", F.lit(True).alias("oob")).distinct(), ["path", "line"], "left")
        if "guard" in filters:
            guards = events.filter("event_type = 'NULL_GUARD'").select("path", "function", F.col("props")["variable"].alias("variable"), F.col("props")["scope_start"].cast("int").alias("scope_start"), F.col("props")["scope_end"].cast("int").alias("scope_end"))
            c = c.join(joins.in_scope(rows.filter("vuln_type = 'null-deref'"), guards, place, "line", "scope_start", "scope_end", "left_semi").select("vuln_type", "seq", F.lit(True).alias("guarded")), ["vuln_type", "seq"], "left")
        if "shared_access" in filters:
            access = self.edges("GLOBAL_ACCESS").select(F.col("function").alias("thread"), F.col("dst").alias("variable"), "note").distinct()
            threads = rows.filter("vuln_type = 'race-condition'").select("vuln_type", "seq", "variable", F.explode(F.split(F.coalesce(F.col("props")["thread_functions"], F.lit("")), ",")).alias("thread"))
            writes, reads = F.sum(F.col("note").contains("write").cast("int")), F.count("*")
            c = c.join(threads.join(access, ["thread", "variable"]).groupBy("vuln_type", "seq").agg(((writes >= 1) & (reads >= 2)).alias("shared")), ["vuln_type", "seq"], "left")
            sure |= flag("shared")
        if "lock_order" in filters:
            order = self.edges("LOCK_ORDER").select("src", "dst")
            pairs = rows.filter("vuln_type = 'deadlock'").select(F.col("props")["mutex_a"].alias("a"), F.col("props")["mutex_b"].alias("b")).distinct()
            c = c.join(closure.mutual(pairs, order).select(F.col("a").alias("mutex_a"), F.col("b").alias("mutex_b"), F.lit(True).alias("mutual")), ["mutex_a", "mutex_b"], "left")
            sure |= flag("mutual")
        if asked:
            flow = flow_verdicts(rows, files, self.nodes, self.known() if filters & set(DEEDS) else None, asked)
            c = c.join(flow.groupBy("vuln_type", "seq").agg(F.map_from_entries(F.collect_list(F.struct("filter", "keep"))).alias("keeps"), F.max("confirmed").alias("sure"), F.max("source_line").alias("source_line"), F.max("error").alias("error")), ["vuln_type", "seq"], "left")
            sure |= flag("sure")
        else:
            c = c.withColumns({"sure": F.lit(False), "source_line": F.lit(0), "error": F.lit(None).cast("string")})

        p = F.col("props")
        safe = yes(F.col("function").isin(*sorted(kb.SAFE_WRAPPERS)) | F.col("api").isin(*sorted(kb.SAFE_FUNCTIONS | kb.SAFE_WRAPPERS)) | F.col("variable").isin(*sorted(kb.SAFE_FUNCTIONS))) & ~yes(F.col("category").isin(*kb.BOUNDED_CATEGORIES))
        array = yes(p["non_nullable"] == "true")
        drops: dict[str, Callable[[], Column]] = {
            "sizeof_pseudo_deref": lambda: yes(p["is_type_expr"] == "true"),
            "non_nullable_array_suppress": lambda: array,
            "array_oob_precedence": lambda: array & flag("oob"),
            "call_reach": lambda: ~flag("reached") & (F.col("function") != ""),
            "guard": lambda: flag("guarded"),
            "safe_function_exclude": lambda: safe,
            "memory_release": lambda: flag("memory_released"),
            "resource_release": lambda: flag("resource_released"),
            "ownership_transfer": lambda: flag("moved"),
            "lock_order": lambda: F.lit(False),
            "shared_access": lambda: F.lit(False),
        } | {f: lambda f=f: ~F.coalesce(F.try_element_at("keeps", F.lit(f)), F.lit(True)) for f in FLOW_FILTERS}
        first = F.coalesce(*(F.when(F.col("vuln_type") == t, F.coalesce(*(F.when(drops[f](), F.lit(f)) for f in chain))) for t, chain in chains.items()))
        suspicion = F.when(sure & (F.col("suspicion") == "suspected"), "confirmed").otherwise(F.col("suspicion"))
        return c.select("vuln_type", "path", "function", "line", "col", "variable", "api", "category", suspicion.alias("suspicion"), F.coalesce("source_line", F.lit(0)).alias("source_line"), flag("sure").alias("definite"), "props", "seq", first.alias("drop_filter"), "error")

    def summaries(self) -> DataFrame:
        facts = self.facts("function", "summary:null", "summary:taint")
        return function_summaries(facts, self.nodes("null"), self.nodes("taint"))

    def results(self, types: Sequence[VulnType]) -> DataFrame:
        """What passes the chains, one row for each key of its type; not ranked."""
        return with_cwe(converged(self.candidates(types).filter("drop_filter is null")))

    def whole(self) -> Scan:
        """All parts."""
        files, facts, types = self.files, self.facts(*EVERYTHING), list(TYPES.values())
        nulls, taints, edges, events = self.nodes("null"), self.nodes("taint"), self.edges(*summaries.EDGES), self.events(*SOURCES)
        candidates = self.candidates(types)
        return Scan(files, facts, edges, graph.nodes(edges), events, candidates, closure.cut(rank(converged(candidates.filter("drop_filter is null")))), nulls, taints)


def scan(spark: SparkSession, root: str, exclude: Sequence[str] = kb.EXCLUDED_DIRS, entries: Sequence[str] = ("main",)) -> Scan:
    """All stages over the tree below root."""
    return scan_files(closure.cut(read_tree(spark, root, exclude)), entries)


def scan_files(files: DataFrame, entries: Sequence[str] = ("main",), facts: DataFrame | None = None) -> Scan:
    """All stages over files (path, source). facts: those of the files, where they are known already."""
    parts = Parts(files, entries, facts)
    parts.kept[("files",)] = files
    return parts.whole()


def converged(rows: DataFrame) -> DataFrame:
    """One row for each key of its type, that of the least line, at the place of the first."""
    parts = F.coalesce(*(F.when(F.col("vuln_type") == t.name, F.concat_ws("\x01", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in t.key))) for t in TYPES.values()))
    return converge.deduplicated(rows.withColumn("converge_key", parts), ["vuln_type", "converge_key"], "line", "seq").drop("converge_key")


def with_cwe(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cwe", F.coalesce(*(F.when(F.col("vuln_type") == t.name, F.lit(f"CWE-{t.cwe}")) for t in TYPES.values())))


def rank(rows: DataFrame) -> DataFrame:
    name = F.when(F.col("api") != "", F.col("api")).otherwise(F.col("variable"))
    tier = F.when(name.isin(*sorted(kb.CRITICAL_APIS)), "critical").when(name.isin(*sorted(kb.HIGH_APIS)), "high").when(name.isin(*sorted(kb.MEDIUM_APIS)), "medium").when(name != "", "low").otherwise("")
    return converge.ranked(with_cwe(rows), S.rank_score(tier, F.col("suspicion")), "path", "line", "seq", ["vuln_type"])


def evidence(rows: DataFrame) -> DataFrame:
    """Each result's fragments (type, role, detail): what its type says of the sink, the way, and the source where one is known.

    A result that isn't reachable from an entry has been dropped, so the way holds for all.
    """
    fragment = lambda kind, role, detail: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), detail.alias("detail"))
    names = {"function": F.col("function"), "line": F.col("line").cast("string"), "variable": F.col("variable"), "api": F.col("api")}

    def told(text: str) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*(names[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x))

    def own(kind: str) -> Column:
        what, role, text = FRAGMENTS[kind]
        out = fragment(what, role, told(text))
        if kind == "race-condition":
            return F.when(F.col("category") == "toctou", fragment("toctou", "sink", told(TOCTOU))).otherwise(out)
        if kind == "null-deref":
            source = F.when(F.col("definite"), fragment("definite_null", "condition", told(DEFINITE_NULL)))
            return F.coalesce(source, F.when(F.col("source_line") > 0, fragment("nullable_source", "source", told(NULLABLE))), out)
        return out

    of = lambda kinds, x: F.when(F.col("vuln_type").isin(*kinds), x)
    parts = F.array(
        F.coalesce(*(F.when(F.col("vuln_type") == k, own(k)) for k in FRAGMENTS)),
        F.when(~F.col("vuln_type").isin(*NO_WAY), fragment("call_path", "path", told("function {function} can be reached from an entry"))),
        of(TAINTED, F.when(F.col("source_line") > 0, fragment("taint_source", "source", told("a value from outside reaches the call at line {line}")))),
    )
    return rows.withColumn("evidence", F.filter(parts, lambda x: x.isNotNull()))
