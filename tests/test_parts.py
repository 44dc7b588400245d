"""A query over generated programs parses each file once, for what it asks only, and gives the rows of its SQL."""

import compare
import pyarrow as pa
import pytest

from corvane import csuite
from corvane.cparse.lexer import tokens
from corvane.plans import engine, kernel

SF = "/root/testdata/sf0.001"
#: What each query finds in the files, in one pass.
ASKED = {
    "detect_buffer_overflow": {"event:buffer_overflow"},
    "scan_crypto_misuse": {"event:crypto_misuse", "function", "edge:CALL"},
    "edges_alias": {"edge:ALIAS"},
    "edges_call": {"edge:CALL", "function"},
    "edges_data_flow": {"edge:DATA_FLOW"},
    "edges_global_access": {"edge:GLOBAL_ACCESS"},
    "edges_lock_order": {"edge:LOCK_ORDER"},
    "edges_ownership_transfer": {"edge:OWNERSHIP_TRANSFER"},
    "edges_param_binding": {"edge:PARAM_BINDING", "function"},
    "edges_release": {"edge:RELEASE"},
    "edges_return": {"edge:RETURN", "function"},
    "filter_definite_init": {"event:uninit_variable", "function", "deed", "thread", "edge:CALL"},
    "filter_int_overflow_guard": {"event:integer_overflow", "function", "edge:CALL"},
    "filter_non_nullable_array_suppress": {"event:dereference"},
    "filter_memory_release": {"event:memory_leak", "function", "deed", "thread", "edge:CALL"},
    "filter_nullable_source": {"event:dereference", "event:null_source", "event:param_deref", "event:buffer_overflow", "function", "summary:null"},
    "filter_range": {"event:divide_by_zero", "function", "edge:CALL"},
    "filter_shared_access": {"event:race_condition", "function", "deed", "thread", "edge:CALL", "edge:GLOBAL_ACCESS"},
    "filter_sizeof_pseudo_deref": {"event:dereference"},
    "filter_taint_source": {"event:injection", "event:path_traversal", "event:format_string", "function", "edge:CALL", "summary:taint"},
    "filter_resource_release": {"event:resource_leak", "function", "edge:CALL"},
    "flow_next_statement": set(),
    "flow_on_every_way": set(),
}


@pytest.mark.parametrize("name", sorted(ASKED))
def test_a_query_finds_only_what_it_asks_for(spark, name, monkeypatch):
    monkeypatch.setattr(csuite, "PARTS", {})
    monkeypatch.setattr(csuite, "SCANS", {})
    assert not compare.differences(csuite.QUERIES[name](spark, SF), csuite.ORACLE_SQL[name], SF)
    (parts,) = csuite.PARTS.values()
    assert [set(x) for x in parts.found] == ([ASKED[name]] if ASKED[name] else [])
    assert not csuite.SCANS


def test_wanted_facts_are_those_of_all_that_are_of_their_kind():
    for c in csuite.CASES:
        for text in c.files:
            source = text.replace("{k}", "7")
            rows = list(kernel.rows_of("p", source))
            for w in sorted(engine.EVERYTHING):
                record, _, kind = w.partition(":")
                own = [r for r in rows if r["record"] == record and (not kind or kind == r.get("detector" if record == "event" else "kind"))]
                assert sorted(map(str, kernel.rows_of("p", source, frozenset([w])))) == sorted(map(str, own)), w


def test_facts_come_in_batches_and_a_file_that_fails_is_a_row(monkeypatch):
    monkeypatch.setattr(kernel, "ROWS_AT_ONCE", 3)

    def of(path, source):
        if path == "bad":
            raise ValueError("odd")
        yield {"record": "event", "line": 1, "props": {"a": source}}
        yield {"record": "thread", "src": "f", "col": 2}

    files = pa.RecordBatch.from_pydict({"path": ["a", "bad", "c"], "source": ["x", "y", None]})
    batches = list(kernel.extractor(of, "source")(iter([files])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert [b.num_rows for b in batches] == [3, 2]
    assert [(r["path"], r["record"], r["line"], r["col"], r["props"], r["note"]) for r in rows] == [
        ("a", "event", 1, None, [("a", "x")], None), ("a", "thread", None, 2, None, None), ("bad", "error", None, None, None, "ValueError: odd"),
        ("c", "event", 1, None, [("a", "")], None), ("c", "thread", None, 2, None, None),
    ]


def test_directives_after_any_blanks():
    assert [(t.kind, t.text, t.start) for t in tokens("\f#define A 1\n /* c */ \t# if B\n x #y")] == [("directive", "define", 1), ("directive", "if", 23), ("word", "x", 31), ("sign", "#", 33), ("word", "y", 34)]
