"""Questions to a file's statement graphs and flows, as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .detect import File, declared_name
from .flow import HIGH, LOW, Ranges
from . import kernel
from .kernel import dealt, freed


def rows(files: DataFrame, build: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of build(path, source) for each file, behind its path."""
    return dealt(files.select("path", "source")).mapInArrow(pass_of(build, schema), schema)


def pass_of(build: Callable[[str, str], Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over batches of files, which gives rows as soon as there are ROWS_AT_ONCE."""
    arrow = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in map(str.split, schema.split(", "))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for path, source in freed(given for batch in batches for given in zip(*(batch.column(c).to_pylist() for c in ("path", "source")), strict=True)):
            held += [(path, *r) for r in build(path, source)]
            if len(held) >= kernel.ROWS_AT_ONCE:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return run


def next_lines(path: str, source: str) -> Iterator[tuple]:
    """(function, line, line that may follow): statements' first lines, 0 for the entry and -1 for the end; joins are passed through."""
    file = File.read(path, source)
    for f in file.functions:
        cfg = f.cfg
        name = lambda i, c=cfg: 0 if i == 0 else -1 if i == 1 else c.stmts[i].line
        follows: dict[int, set[int]] = {}
        for i, kind in enumerate(cfg.kinds):
            if kind == "join":
                continue
            seen, stack, out = set(), list(cfg.next[i]), follows.setdefault(name(i), set())
            while stack:
                n = stack.pop()
                if n in seen:
                    continue
                seen.add(n)
                if cfg.kinds[n] == "join":
                    stack.extend(cfg.next[n])
                else:
                    out.add(name(n))
        for a, out in follows.items():
            for b in sorted(out):
                yield f.name, a, b
    file.close()


def passes(path: str, source: str) -> Iterator[tuple]:
    """(function, line): statements that every way to the end passes."""
    file = File.read(path, source)
    for f in file.functions:
        for i, s in enumerate(f.cfg.stmts):
            if s is not None and f.cfg.at(s.line) == i and f.cfg.reaches(0, i) and not f.cfg.reaches(0, 1, {i}):
                yield f.name, s.line
    file.close()


def ranges(path: str, source: str) -> Iterator[tuple]:
    """(function, line, variable, least, greatest) of integer variables where a return or division stands; an open end is null."""
    file = File.read(path, source)
    for f in file.functions:
        known = Ranges(f.cfg)
        names = sorted({declared_name(c) for d in f.nodes["declaration"] for c in d.children if c.field == "declarator" and c.kind == "init_declarator" and c.child("declarator").kind == "identifier"} - {None})
        for s in f.nodes["return_statement"]:
            for v in names:
                lo, hi = known.at(v, s.line)
                if lo != LOW or hi != HIGH:
                    yield f.name, s.line, v, None if lo == LOW else str(lo), None if hi == HIGH else str(hi)
    file.close()
