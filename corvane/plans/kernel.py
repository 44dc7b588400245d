"""The one pass that parses: each file's functions, events, graph edges and summaries as rows."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import knowledge as kb
from ..sources.tree import changed

FACTS = "path string, record string, function string, kind string, line int, end_line int, col int, src string, dst string, note string, props map<string,string>, detector string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
ARROW = pa.schema([(c, pa.int32() if kind == "int" else pa.map_(pa.string(), pa.string()) if kind.startswith("map") else pa.string()) for c, kind in (x.split() for x in FACTS.split(", "))])
#: Rows of so many facts go to Spark at once, and the trees, which are cycles, of so many files or characters are freed at once.
ROWS_AT_ONCE, FILES_AT_ONCE, CHARS_AT_ONCE = 10_000, 1000, 500_000


def words(names: frozenset[str]) -> str:
    """One of the names at the end of a word: a name can follow a hexadecimal number without a space."""
    return rf"(?:{'|'.join(sorted(names))})\b"


NAME = r"[A-Za-z_]\w*"
#: Behind a name: what makes more of it than a name, and more than a field or element too.
MORE = r"[+%<>|^?]|-(?![->])|!=|=="
#: An assignment or initialiser by "=", but of a number, an address, a call or a sum.
ASSIGNED = rf"(?:(?<![=!<>])=(?!=)|[-+*/%&|^=!<>]==)(?!\s*(?:[0-9]\w*|&\s*{NAME}|{NAME}\s*\([\w\s,&*]*\))\s*[;,)]|\s*{NAME}\s*(?:{MORE}))"
#: A return, but of nothing, of a number, text or unary expression, or of what starts with a name and is more than that.
RETURNED = rf"return\b(?!\s*(?:[;0-9\"'!&~*+-]|{NAME}\s*(?:[(\[]|{MORE}|->)))"
#: Without this text a file has no facts of the kind, so that it needn't be parsed for them. A name or sign stands in a file as it is.
TEXT_OF = {
    "edge:LOCK_ORDER": words(kb.LOCKS), "edge:RELEASE": words(kb.RELEASES), "edge:ALIAS": rf"{ASSIGNED}(?!\s*(?:NULL|nullptr)\s*[;,)])", "edge:DATA_FLOW": f"{ASSIGNED}|{RETURNED}",
    "edge:OWNERSHIP_TRANSFER": f"g_|{RETURNED}", "event:dereference": r"->|\*|\[",
    "event:integer_overflow": words(kb.SIZE_FUNCTIONS | {"calloc"}),
    "event:divide_by_zero": r"(?<!/)/(?![/*])|\*//|%",
    "event:resource_leak": f"(?i:open|socket|accept|createfile|mmap|_acquire)|{words(kb.LOCKS)}",
    "event:memory_leak": words(kb.ALLOCATORS), "frees": r"free\b|\A(?s:(?=.*=)(?=.*\[)(?=.*return))",
    "static": r"static\b", "sized": r"(?:sizeof|alignof|_Alignof)\b", "array": r"\[",
}
#: Marks a kind of fact that is wanted only of files that are parsed for another. "static", "frees", "sized" and "array" are none: they have files parsed that may hide functions, free something or keep it in a global's element, or follow in a size or an array.
ALONG = "?"


@cache
def possible(wanted: frozenset[str] | None) -> re.Pattern | None:
    """What a file with any of the wanted facts has in its text, where that is known of all of them."""
    asked = {w for w in wanted or () if not w.endswith(ALONG)}
    return re.compile("|".join(sorted(TEXT_OF[w] for w in asked)), re.ASCII) if asked and asked <= TEXT_OF.keys() else None


@cache
def chosen(wanted: frozenset[str] | None) -> tuple[set[str], list[str], list[str], list[str]]:
    """Records wanted as a whole, detectors, edges and summaries."""
    from .detect import DETECTORS
    from .summaries import EDGES

    kinds = {"event": list(DETECTORS), "edge": list(EDGES), "summary": ["null", "taint"]}
    own = {"function", "variable", "deed", "thread", *kinds} if wanted is None else {w.removesuffix(ALONG) for w in wanted}
    return {x for x in own if ":" not in x}, *([n for n in names if record in own or f"{record}:{n}" in own] for record, names in kinds.items())


def rows_of(path: str, source: str, wanted: frozenset[str] | None = None) -> Iterator[dict]:
    """A file's facts: all, or those wanted, each a record ("function") or one of its kinds ("edge:CALL", "event:dereference", "summary:null")."""
    from . import summaries
    from .detect import File, declared_name, is_pointer

    text = possible(wanted)
    if text is not None and not text.search(source):
        return
    own, detectors, edges, sums = chosen(wanted)
    file = File.read(path, source)
    for f in file.functions if "function" in own or "variable" in own else ():
        if "function" in own:
            yield {"record": "function", "function": f.name, "kind": f.return_type, "line": f.line, "end_line": f.end_line, "note": "static" if f.static else "", "props": {"signature": f.signature, "params": ",".join(f.params), "pointer": str(f.pointer_result).lower()}}
        for d in f.nodes["declaration"] if "variable" in own else ():
            for c in d.children:
                if c.field == "declarator" and is_pointer(c if c.kind != "init_declarator" else c.child("declarator")):
                    heap = any(a in d.text for a in ("malloc", "calloc", "realloc"))
                    base = next((x.text for x in d.children if x.field == "type"), "")
                    yield {"record": "variable", "function": f.name, "kind": f"{base}*", "line": d.line, "src": declared_name(c), "note": "heap" if heap else "stack"}
    if detectors:
        yield from event_rows(file, detectors)
    if "deed" in own:
        for name, done in file.deeds.items():
            for kind, at, below, how in sorted(done):
                yield {"record": "deed", "function": name, "kind": kind, "col": at, "src": below, "note": how}
    if "thread" in own:
        for target, n in file.threads.items():
            yield {"record": "thread", "src": target, "col": n}
    for kind, f, src_kind, src, dst_kind, dst, line, note in summaries.graph_edges(file, edges) if edges else ():
        yield {"record": "edge", "function": f.name, "kind": kind, "line": line, "src": src, "dst": dst, "note": note, "props": {"src_kind": src_kind, "dst_kind": dst_kind}}
    for kind in sums:
        for src, dst in sorted({*summaries.null_edges(file)} if kind == "null" else {*summaries.taint_edges(file), *summaries.pass_edges(file)}):
            yield {"record": "summary", "kind": kind, "src": src, "dst": dst}
    file.close()


def event_rows(file, names) -> Iterator[dict]:
    for name, kind, f, line, col, props in file.events(names):
        yield {"record": "event", "function": f.name, "kind": kind, "line": line, "col": col, "props": props, "detector": name}


#: Detectors whose events depend on functions of other files.
ACROSS = ("memory_leak", "uninit_variable", "use_after_free", "double_free", "race_condition")


def tell(file, outside: str | None) -> None:
    """Gives a file what is known of others, as JSON: {"deeds": [{function, deeds: [..]}], "threads": [{function, n}]}."""
    known = json.loads(outside) if outside else {}
    file.outside = {x["function"]: {(d["kind"], int(d["col"]), d.get("src", ""), d.get("note", "")) for d in x["deeds"]} for x in known.get("deeds") or ()}
    file.outside_threads = {x["function"]: int(x["n"]) for x in known.get("threads") or ()}


def rows_again(path: str, source: str, outside: str, detectors: Sequence[str] = ACROSS) -> Iterator[dict]:
    from .detect import File

    file = File.read(path, source)
    tell(file, outside)
    yield from event_rows(file, detectors)
    file.close()


def passing_of(nodes: Iterator[str]) -> dict[str, set[int]]:
    """f:i of functions and the parameters they return as they are, by function."""
    out: dict[str, set[int]] = {}
    for x in nodes:
        name, _, at = x.partition(":")
        out.setdefault(name, set()).add(int(at))
    return out


def taint_again(path: str, source: str, far: str) -> Iterator[dict]:
    """A file's taint edges, where other files' functions return parameters as they are: far, as JSON."""
    from . import summaries
    from .detect import File

    file = File.read(path, source)
    for src, dst in sorted(set(summaries.taint_edges(file, passing_of(json.loads(far))))):
        yield {"record": "summary", "kind": "taint", "src": src, "dst": dst}
    file.close()


def table(rows: list[dict]) -> pa.RecordBatch:
    columns = [[r.get(c) for r in rows] for c in COLUMNS]
    columns[COLUMNS.index("props")] = [None if p is None else list(p.items()) for p in columns[COLUMNS.index("props")]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def freed(files: Iterator) -> Iterator:
    """The files, with Python's search for cycles only once in so many: it costs more than the parse of a small file."""
    on = gc.isenabled()
    gc.disable()
    gc.freeze()  # what is there already isn't searched
    try:
        chars = 0
        for n, given in enumerate(files, 1):
            yield given
            chars += len(given[1] or "")
            if n % FILES_AT_ONCE == 0 or chars > CHARS_AT_ONCE:
                gc.collect()
                chars = 0
    finally:
        gc.unfreeze()
        if on:
            gc.enable()


def extractor(rows_of_file, *columns: str):
    """A pass over batches of files; rows_of_file takes a path and the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        files = (given for batch in batches for given in zip(*(batch.column(c).to_pylist() for c in ("path", *columns)), strict=True))
        for path, *given in freed(files):
            try:
                rows = [{"path": path, **r} for r in rows_of_file(path, *(x or "" for x in given))]
            except Exception as e:  # one file that can't be read doesn't end the scan: it is reported
                rows = [{"path": path, "record": "error", "note": f"{type(e).__name__}: {e}"[:500]}]
            held += rows
            if len(held) >= ROWS_AT_ONCE:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return run


def dealt(files: DataFrame) -> DataFrame:
    """A large file is one task's work, and files are dealt evenly: to a number of tasks that Spark doesn't lessen for few bytes, as these cost more than their bytes."""
    return files.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "path")


def facts(files: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Rows of all files, all or those wanted."""
    chosen = None if wanted is None else frozenset(wanted)
    return dealt(files.select("path", "source")).mapInArrow(extractor(lambda path, source: rows_of(path, source, chosen), "source"), FACTS)


def mentioning(files: DataFrame, names: DataFrame) -> DataFrame:
    """path and source of the files that have one of the names (name) as a word, in whatever place."""
    found = F.regexp_extract_all("source", F.lit("0[xX][0-9A-Fa-f]+[uUlLfF]*|[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    said = files.select("path", F.explode(F.array_distinct(found)).alias("name")).join(names.select("name").distinct(), "name", "left_semi")
    return files.select("path", "source").join(said.select("path").distinct(), "path", "left_semi")


def facts_again(files: DataFrame, outside: DataFrame, detectors: Sequence[str] = ACROSS) -> DataFrame:
    """Events of detectors in ACROSS, for the files that outside (path, outside) has something for."""
    rows = dealt(files.select("path", "source").join(outside, "path"))
    return rows.mapInArrow(extractor(lambda path, source, outside: rows_again(path, source, outside, detectors), "source", "outside"), FACTS)


def edges_again(files: DataFrame, far: DataFrame) -> DataFrame:
    """Taint edges of the files that far (path, far) has something for."""
    rows = dealt(files.select("path", "source").join(far, "path"))
    return rows.mapInArrow(extractor(taint_again, "source", "far"), FACTS)


def refreshed(old: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of files, where old are those of the stored ones: a file with the stored checksum isn't parsed again, a file that is gone has no rows."""
    same = files.select("path", "checksum").join(stored.select("path", "checksum"), ["path", "checksum"]).select("path")
    return old.join(same, "path", "left_semi").unionByName(facts(changed(files, stored)))
