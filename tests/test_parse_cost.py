"""What a file costs: no parse where its text rules the facts out, no circles left behind, no calls followed to what is reached anyway."""

import gc

import pytest

from corvane import ccases
from corvane.cparse import Node, parsed
from corvane.operators import closure
from corvane.plans import detect, engine, kernel, probes

TEXTS = [text.replace("{k}", "7") for c in ccases.CASES for text in c.files]


@pytest.mark.parametrize("wanted", sorted(kernel.TEXT_OF))
def test_a_file_whose_text_rules_the_facts_out_is_not_parsed(wanted, monkeypatch):
    read, seen = detect.File.read, []
    monkeypatch.setattr(detect.File, "read", classmethod(lambda cls, path, source: seen.append(source) or read(path, source)))
    rows = [list(kernel.rows_of("p", text, frozenset([wanted]))) for text in TEXTS]
    without = [text for text in TEXTS if text not in seen]
    assert without
    monkeypatch.setattr(kernel, "possible", lambda wanted: None)
    assert rows == [list(kernel.rows_of("p", text, frozenset([wanted]))) for text in TEXTS]


def test_text_rules_out_nothing_that_is_there():
    for wanted, source in (
        ("edge:ALIAS", "int f(int *q) { int *p\n=\nq; p === q; return 0; }"),
        ("edge:DATA_FLOW", "int f(int a) { return/* 0; */a; }"),
        ("edge:OWNERSHIP_TRANSFER", "int f(int a) { return(a); }"),
        ("edge:RELEASE", "void f(char *p) { free\\\n(p); }"),
        ("edge:LOCK_ORDER", "void f(void) { EnterCriticalSection(&a); EnterCriticalSection(&b); }"),
        ("event:dereference", "int f(int a[]) { return a [0]; }"),
    ):
        assert list(kernel.rows_of("p", source, frozenset([wanted]))), wanted


@pytest.mark.parametrize("of", [lambda path, source: kernel.rows_of(path, source, frozenset(("function", "edge:CALL", "edge:ALIAS"))), probes.next_lines, probes.passes])
def test_a_file_leaves_no_tree_behind(of):
    gc.collect()
    gc.disable()
    try:
        for text in TEXTS:
            list(of("p", text))
        assert sum(type(x) is Node for x in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_definitions_and_fields_are_known_when_the_parse_ends():
    for text in [*TEXTS, "#if A\nint f(void) { struct s { int a[3]; } x; }\n#else\nint f(struct t { int b; } *y) { }\n#endif\nint g(", ""]:
        tree, functions, fields = parsed(text)
        assert functions == tree.all("function_definition")
        assert fields == tree.all("field_declaration")


def test_only_calls_of_hidden_functions_are_followed(spark, monkeypatch):
    rows = [("function", f, static, None, None) for f, static in (("open1", ""), ("open2", ""), ("main", "static"), ("a", "static"), ("b", "static"), ("c", "static"), ("d", "static"), ("both", "static"), ("both", ""))]
    rows += [("edge", f, None, "CALL", g) for f, g in (("open1", "open2"), ("open1", "a"), ("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "printf"), ("c", "open1"), ("c", "both"))]
    facts = spark.createDataFrame(rows, "record string, function string, note string, kind string, dst string")
    followed, reach = [], closure.reach
    monkeypatch.setattr(closure, "reach", lambda links, entries: followed.extend((r.src, r.dst) for r in links.collect()) or reach(links, entries))
    assert sorted(r.function for r in engine.reached(facts, ("main",)).collect()) == ["a", "b", "both", "main", "open1", "open2"]
    assert sorted(followed) == [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("open1", "a")]
