"""Flow-sensitive filters: for each candidate of a file whether a source reaches it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd

from ..functions import knowledge as kb
from . import summaries
from .detect import File, Function
from .kernel import freed, passing_of, tell
from .flow import Effects, Flow, Ranges, bare, integer, key, root_of


class Judge:
    """One function under the program's facts: names of functions that may return null or taint, tainted parameters, and functions that return parameters as they are."""

    def __init__(self, file: File, f: Function, nullable: set[str], tainted: set[str], params: set[str], passing: set[str] = frozenset()):
        self.file, self.f = file, f
        self.nullable, self.tainted, self.params, self.passing = nullable, tainted, params, passing
        self.kept: dict[str, object] = {}

    def once(self, name: str, make):
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def null_flow(self, sure: bool) -> Flow:
        def make():
            gens, definite = summaries.null_gens(self.file, self.f)
            own = summaries.copy_effects(self.f, kill=True)
            if not sure:
                definite = gens + [(p, c.line) for p, c in summaries.call_results(self.f) if from_null(c, self.file, self.nullable)]
            return Flow(self.f.cfg, summaries.with_gens(self.f, own, definite))

        return self.once(f"null{sure}", make)

    def freed_flow(self, lines: frozenset[int] | None) -> Flow:
        """Where freed places reach; lines: only what is freed there."""

        def make():
            from .detect import freed_at

            own = summaries.copy_effects(self.f, kill=False)
            for p, _, r in self.f.assigned:
                i, v = self.f.cfg.at(r.line), bare(r)
                if i is not None and v is not None and v.kind != "identifier":
                    own[i].kills.add(p)
            aliases = {(p, key(r)) for p, _, r in self.f.assigned if key(r)}
            gens = []
            for p, n, _ in freed_at(self.file, self.f):
                if lines is None or n.line in lines:
                    gens += [(x, n.line) for x in {p} | {a for a, b in aliases if b == p} | {b for a, b in aliases if a == p}]
            return Flow(self.f.cfg, summaries.with_gens(self.f, own, gens))

        return self.once(f"freed{lines}", make)

    def uninit_flow(self) -> Flow:
        def make():
            own = summaries.copy_effects(self.f, kill=True)
            for p, left, _ in self.f.assigned:
                i = self.f.cfg.at(left.line)
                if i is not None and root_of(p) != p:
                    own[i].kills.add(root_of(p))
            gens = []
            for d in self.f.nodes["declaration"]:
                if any(c.kind == "init_declarator" for c in d.children) or any(c.text == "static" for c in d.children):
                    continue
                from .detect import declared_name

                gens += [(declared_name(c), d.line) for c in d.children if c.field == "declarator" and declared_name(c)]
            return Flow(self.f.cfg, summaries.with_gens(self.f, own, gens))

        return self.once("uninit", make)

    def taint_flow(self) -> Flow:
        def make():
            through = summaries.passthroughs(self.file, passing_of(self.passing))
            own = summaries.taint_effects(self.file, self.f, through)
            gens = summaries.taint_gens(self.f, through)
            from .detect import call_name

            gens += [(p, c.line) for p, c in summaries.call_results(self.f) if call_name(c) in self.tainted]
            entry = {p for i, p in enumerate(self.f.params) if p and (not self.f.static or f"{self.f.name}:{i}" in self.params)}
            return Flow(self.f.cfg, summaries.with_gens(self.f, own, gens), entry)

        return self.once("taint", make)

    def ranges(self) -> Ranges:
        return self.once("ranges", lambda: Ranges(self.f.cfg))

    # ---- filters: (keep, confirmed, note)

    def nullable_source(self, c: dict) -> tuple[bool, bool, int]:
        place, line = c["variable"], c["line"]
        flow = self.null_flow(sure=False)
        if not flow.reaching(place, line):
            return False, False, 0
        return True, self.null_flow(sure=True).always(place, line), flow.source_line(place, line)

    def lifetime(self, c: dict) -> tuple[bool, bool, int]:
        flow = self.freed_flow(None)
        if not flow.reaching(c["variable"], c["line"]):
            return False, False, 0
        return True, flow.always(c["variable"], c["line"]), flow.source_line(c["variable"], c["line"])

    def double_free_flow(self, c: dict) -> tuple[bool, bool, int]:
        first = int(c["props"].get("free_line", 0))
        flow, at = self.freed_flow(frozenset({first})), self.f.cfg.at(c["line"])
        if at is None or not flow.may_in[at].get(c["variable"]):
            return at is None, False, first
        return True, flow.always(c["variable"], c["line"]), first

    def definite_init(self, c: dict) -> tuple[bool, bool, int]:
        if c["props"].get("origin") != "stack_uninit":
            return True, False, 0
        flow = self.uninit_flow()
        if not flow.reaching(c["variable"], c["line"]) or self.covered(c["variable"], c["line"]):
            return False, False, 0
        return True, flow.always(c["variable"], c["line"]), flow.source_line(c["variable"], c["line"])

    def covered(self, place: str, line: int) -> bool:
        """Whether an earlier assignment is compiled and run whenever the line is: it stands under some of the same conditions, and under no other. Only where the preprocessor decides; the statement graph has the rest."""
        compiled, run = conditions(self.f, line)
        if not compiled:
            return False
        for p, left, _ in self.f.assigned:
            if root_of(p) == place and left.line < line:
                own_compiled, own_run = conditions(self.f, left.line)
                if own_compiled and own_compiled <= compiled and own_run <= run:
                    return True
        return False

    def taint_source(self, c: dict) -> tuple[bool, bool, int]:
        text = c["props"].get("path") or c["props"].get("format_arg") or c["variable"] or ""
        if not re.fullmatch(r"[A-Za-z_]\w*(?:(?:->|\.)\w+|\[[^\]]*\])*", re.sub(r"\s+", "", text)):
            return True, False, 0
        place = re.sub(r"\s+", "", text)
        if place in self.f.params:
            i = self.f.params.index(place)
            if f"{self.f.name}:{i}" in self.params:
                return True, True, self.f.line
            return not self.f.static, False, 0
        flow = self.taint_flow()
        hit = flow.reaching(place, c["line"]) or flow.reaching(root_of(place), c["line"])
        return hit, hit, flow.source_line(place, c["line"]) if hit else 0

    def int_overflow_guard(self, c: dict) -> tuple[bool, bool, int]:
        names = [n for n in (c["variable"] or "").split(",") if re.fullmatch(r"[A-Za-z_]\w*", n)]
        bounded = []
        for n in names:
            upper = self.f.upper_at(n, c["line"])
            lo, hi = self.ranges().at(n, c["line"])
            bounded.append(upper is not None and upper < kb.GUARD_BOUND or 0 <= lo and hi < kb.GUARD_BOUND)
        return not (names and all(bounded)), False, 0

    def range(self, c: dict) -> tuple[bool, bool, int]:
        d = c["props"].get("divisor", "")
        return not (re.fullmatch(r"[A-Za-z_]\w*", d) and integer(d) is None and self.ranges().nonzero(d, c["line"])), False, 0


def conditions(f: Function, line: int) -> tuple[set[str], set[str]]:
    """What must hold for a line of the function to be compiled, and the control statements that it stands in. In an alternative the contrary holds."""
    out: tuple[set[str], set[str]] = set(), set()
    for which, kinds in enumerate((("preproc_if", "preproc_ifdef", "preproc_elif"), ("if_statement", "while_statement", "for_statement", "do_statement", "switch_statement"))):
        for kind in kinds:
            for n in f.nodes[kind]:
                if n.line <= line <= n.end_line:
                    other = n.child("alternative")
                    name = f"{kind}@{n.line}" if which else " ".join(n.text.split("\n")[0].split())
                    out[which].add(f"not {name}" if other is not None and other.line <= line <= other.end_line else name)
    return out


def from_null(call, file: File, nullable: set[str]) -> bool:
    from .detect import call_name

    return call_name(call) in nullable


FLOW_FILTERS = ("nullable_source", "lifetime", "double_free_flow", "definite_init", "taint_source", "int_overflow_guard", "range")
RESULT = "seq long, filter string, keep boolean, confirmed boolean, source_line int, error string"


def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (path, source, candidates as JSON, nullable, tainted, params, passing, outside as JSON) to verdicts. A filter that fails keeps, and says why."""
    for batch in batches:
        out = []
        for r in freed(batch.itertuples(index=False)):
            file = File.read(r.path, r.source)
            tell(file, r.outside)
            by = {f.name: f for f in file.functions}
            judges: dict[str, Judge] = {}
            sets = [set(x if x is not None else ()) for x in (r.nullable, r.tainted, r.params, r.passing)]
            for text in r.candidates:
                c = json.loads(text)
                f = by.get(c["function"])
                if f is None:
                    out.append((c["seq"], c["filter"], True, False, 0, None))
                    continue
                j = judges.setdefault(f.name, Judge(file, f, *sets))
                try:
                    keep, sure, line = getattr(j, c["filter"])(c)
                    out.append((c["seq"], c["filter"], keep, sure, line, None))
                except Exception as e:  # an undecided candidate stays
                    out.append((c["seq"], c["filter"], True, False, 0, f"{type(e).__name__}: {e}"[:300]))
            file.close()
        yield pd.DataFrame(out, columns=["seq", "filter", "keep", "confirmed", "source_line", "error"])


__all__ = ["FLOW_FILTERS", "RESULT", "Effects", "judge"]
