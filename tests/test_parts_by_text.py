"""Filters that need only files with certain words: the others aren't parsed, and the candidates are those of a whole scan."""

import pytest

from corvane.functions import knowledge as kb
from corvane.plans import engine, kernel
from corvane.plans.registry import TYPES

#: Of each type: a function's body with a candidate.
BODIES = {
    "integer-overflow": "char *p = malloc(n * sizeof(n)); use(p); return 0;",
    "divide-by-zero": "return 7 / n;",
    "resource-leak": "int h = Db_Acquire(n); keep = h; return 0;",
}
CALLERS = {"seen.c": "int go(void) { return called(1); }", "over.c": "int far(void) { return between(1); }", "names.c": "int shown(int n) { return n; }", "away.c": "int away(void) { return other(2) + 1; }"}


def program(body):
    """Hidden functions with a candidate: one is called by another file, one over a hidden function, one has a name that another file shows, one is lost."""
    made = {f"{name}_in.c": f"static int {name}(int n) {{ {body} }}" for name in ("called", "beneath", "shown", "lost")}
    return made | {"open.c": f"int open_one(int n) {{ {body} }}", "between.c": "static int between(int n) { return beneath(n); }", "ring.c": "static int ring(int n) { return lost(n) + ring(n); }"} | CALLERS


def decided(parts, kind):
    return sorted((r.path, r.function, r.line, r.variable, r.drop_filter) for r in parts.candidates([TYPES[kind]]).collect())


@pytest.mark.parametrize("kind", sorted(BODIES))
def test_candidates_are_those_of_a_whole_scan_without_parsing_all(spark, kind):
    files = spark.createDataFrame(sorted(program(BODIES[kind]).items()), "path string, source string")
    whole = engine.Parts(files)
    whole.facts(*engine.EVERYTHING)
    parts = engine.Parts(files)
    rows = decided(parts, kind)
    assert rows == decided(whole, kind)
    assert [r[1] for r in rows if r[4] == "call_reach"] == ["lost"]
    assert {r.path for facts in parts.found.values() for r in facts.collect()}.isdisjoint(CALLERS)


def test_a_word_after_a_hexadecimal_number_is_one(spark):
    source = "int f(int n) { use(0x1Fmalloc(n * sizeof(n))); }"
    names = [r["function"] for r in kernel.rows_of("p", source, frozenset(("event:integer_overflow",)))]
    assert names == ["f"] and kernel.possible(frozenset(("edge:RELEASE",))).search("0x1Ffree(p);") and kernel.possible(frozenset(("edge:RELEASE",))).search("\u00e9free(p);")
    assert [r.path for r in kernel.mentioning(spark.createDataFrame([("a", "0x1Fhid(2)"), ("b", "hid2()"), ("c", "(hid)()")], "path string, source string"), spark.createDataFrame([("hid",)], "name string")).orderBy("path").collect()] == ["a", "c"]


def test_text_rules_out_no_candidate():
    for wanted, source in (
        *(("event:resource_leak", f"void f(void) {{ int h = {name}(); }}") for name in ("fopen", "OpenDir", "fdopen", "popen", "socket", "open", "DB_OPEN", "accept", "CreateFileW", "dlopen", "mmap", "x_acquire")),
        *(("event:resource_leak", f"void f(void) {{ {name}(&a); }}") for name in sorted(kb.LOCKS)),
        ("event:memory_leak", "void f(int n) { char *p = realloc(0, n); }"),
        ("event:divide_by_zero", "int f(int a) { return 1/a; }"),
        ("event:divide_by_zero", "int f(int a) { return 1/* / *//a; }"),
        ("event:divide_by_zero", "int f(int a) { a /= a; }"),
        ("event:divide_by_zero", "int f(int a) { return 1%a; }"),
    ):
        assert list(kernel.rows_of("p", source, frozenset([wanted]))), source


@pytest.mark.parametrize(("by", "path"), [("sizeof_pseudo_deref", "size.c"), ("non_nullable_array_suppress", "array.c")])
def test_files_where_a_filter_drops_nothing_are_not_parsed(spark, by, path):
    files = spark.createDataFrame([("size.c", "int f(int *p) { return _Alignof(*p) + sizeof(p->a); }"), ("array.c", "int a[3]; int f(void) { return *a; }"), ("other.c", "int f(int *p) { return *p; }")], "path string, source string")
    parts = engine.Parts(files)
    assert {r.path for r in parts.dropped([TYPES["null-deref"]], by).collect()} == {path}
    assert {r.path for facts in parts.found.values() for r in facts.collect()} == {path}
    assert {r.path for r in parts.candidates([TYPES["null-deref"]], by).collect()} == {"size.c", "array.c", "other.c"}


def test_leaks_know_what_other_files_free_without_parsing_all(spark):
    texts = {
        "make.c": "void f(void) { char *p = malloc(3); let_go(p); }", "keep.c": "void g(void) { char *p = malloc(3); look(p); }", "free.c": "void let_go(char *p) { free(p); }", "look.c": "int look(char *p) { return 1; }",
        "slot.c": "char *slots[9]; char *slot(int i, char *p) { slots[i] = p; return p; }", "clear.c": "char *slots[9]; void clear(void) { free(slots); }", "use.c": "void h(void) { char *p = malloc(3); p = slot(1, p); clear(); }",
    }
    # flows go by lines
    files = spark.createDataFrame([(path, text.replace("; ", ";\n").replace("{ ", "{\n")) for path, text in sorted(texts.items())], "path string, source string")
    whole, parts = engine.Parts(files), engine.Parts(files)
    whole.facts(*engine.EVERYTHING)
    rows = [sorted((r.path, r.event_type, r.line, str(r.props)) for r in p.events("MEMORY_ALLOC", "MEMORY_RELEASE").collect()) for p in (whole, parts)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0] if r[1] == "MEMORY_RELEASE"} >= {"make.c"}
    assert {r.path for facts in parts.found.values() for r in facts.collect()} == texts.keys() - {"look.c"}


def test_what_is_assigned_or_returned_decides_on_the_parse():
    for wanted, said, body in (
        ("edge:ALIAS", True, "p = q;"), ("edge:ALIAS", True, "p = (char *)q;"), ("edge:ALIAS", True, "p = q->next;"), ("edge:ALIAS", True, "p = q [0];"), ("edge:ALIAS", True, "p = f(a)->b->c;"), ("edge:ALIAS", True, "n = 0, p = q;"),
        ("edge:ALIAS", False, "p = 0; p = NULL; p = &q; p = f(q); p = q + 1;"), ("edge:DATA_FLOW", True, "p = NULL;"), ("edge:DATA_FLOW", True, "return q /* - */;"), ("edge:DATA_FLOW", True, "return (q);"),
        ("edge:DATA_FLOW", False, "p = 0; p = f(q); return q - 1;"), ("edge:OWNERSHIP_TRANSFER", True, "g_p = q;"), ("edge:OWNERSHIP_TRANSFER", True, "return q ! 2;"), ("edge:OWNERSHIP_TRANSFER", False, "return f(q) + *q; return -1; return q->a;"),
    ):
        source, asked = f"int *f(int *q) {{ int *p; {body} }}", frozenset([wanted])
        assert bool(kernel.possible(asked).search(source)) == said == bool(list(kernel.rows_of("p", source, asked))), (wanted, body)
