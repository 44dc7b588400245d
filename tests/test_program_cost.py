"""What a query over many programs makes: rows a batch at a time, and flows only where something asks for them."""

import pyarrow as pa

from corvane.plans import kernel, probes, summaries
from corvane.plans.detect import File


def test_probes_give_rows_before_all_files_are_read(monkeypatch):
    monkeypatch.setattr(kernel, "ROWS_AT_ONCE", 3)
    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c", "d"], "source": ["x", "yy", "", "zzz"]})
    run = probes.pass_of(lambda path, source: ((c, i if i else None) for i, c in enumerate(source)), "path string, name string, line int")
    batches = list(run(iter([files.slice(0, 1), files.slice(1)])))
    assert [b.num_rows for b in batches] == [3, 3]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [("a", "x", None), ("b", "y", None), ("b", "y", 1), ("d", "z", None), ("d", "z", 1), ("d", "z", 2)]
    assert batches[0].schema == pa.schema([("path", pa.string()), ("name", pa.string()), ("line", pa.int32())])
    assert not list(run(iter([files.slice(2, 1)])))


def test_no_flow_is_made_that_nothing_asks_for():
    for edges, source, asked in (
        (summaries.null_edges, "int f(int a) { char *p = NULL; return 1; }", False),
        (summaries.null_edges, "char *f(int a) { char *p = q; return p; }", False),
        (summaries.null_edges, "char *f(int a) {\nchar *p = NULL;\nreturn p;\n}", True),
        (summaries.taint_edges, "int f(int a) { a = 2; return 1; }", False),
        (summaries.taint_edges, "int f(void) { int a = 2; g(a); return a; }", False),
        (summaries.taint_edges, "int f(int a) {\nreturn a + g(a);\n}", True),
    ):
        file = File.read("p", source)
        found = list(edges(file))
        assert bool(found) == asked == ("cfg" in vars(file.functions[0])), source
