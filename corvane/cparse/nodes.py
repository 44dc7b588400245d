"""Syntax trees."""

from __future__ import annotations

from collections.abc import Iterator

from .lexer import Lines


class Node:
    """A named node, or an anonymous token whose kind is its text. Lines count from one."""

    __slots__ = ("_end_line", "_line", "children", "end", "field", "kind", "lines", "named", "parent", "source", "start")

    def __init__(self, kind: str, source: str, start: int, end: int, lines: Lines, named: bool = True):
        self.kind, self.source, self.start, self.end, self.lines, self.named = kind, source, start, end, lines, named
        self.children: list[Node] | tuple[()] = ()
        self.parent: Node | None = None
        self.field: str | None = None
        self._line = self._end_line = 0  # looked up once asked for, when the parse is over

    @property
    def line(self) -> int:
        if not self._line:
            self._line = self.lines.at(self.start)[0]
        return self._line

    @property
    def end_line(self) -> int:
        if not self._end_line:
            self._end_line = self.lines.at(max(self.start, self.end - 1))[0]
        return self._end_line

    @property
    def col(self) -> int:
        return self.lines.at(self.start)[1]

    def add(self, child: Node | None, field: str | None = None) -> Node | None:
        if child is not None:
            child.parent, child.field = self, field
            if self.children:
                self.children.append(child)
            else:
                self.children = [child]
        return child

    def close(self) -> Node:
        """Takes the span of the children where that is wider."""
        for c in self.children:
            if c.start < self.start:
                self.start, self._line = c.start, 0
            if c.end > self.end:
                self.end, self._end_line = c.end, c._end_line or c.start == c.end and c.end_line
        return self

    @property
    def text(self) -> str:
        return self.source[self.start : self.end]

    @property
    def named_children(self) -> list[Node]:
        return [c for c in self.children if c.named]

    def child(self, field: str) -> Node | None:
        return next((c for c in self.children if c.field == field), None)

    def first(self, *kinds: str) -> Node | None:
        return next((c for c in self.children if c.kind in kinds), None)

    def walk(self) -> Iterator[Node]:
        """Named nodes in the order of the text."""
        stack = [self]
        while stack:
            n = stack.pop()
            if n.named:
                yield n
            if n.children:
                stack.extend(reversed(n.children))

    def all(self, *kinds: str) -> list[Node]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.kind in kinds and n.named:
                out.append(n)
            if n.children:
                stack.extend(reversed(n.children))
        return out

    def above(self, *kinds: str) -> Node | None:
        n = self.parent
        while n is not None and n.kind not in kinds:
            n = n.parent
        return n

    def operator(self) -> str:
        return next((c.kind for c in self.children if not c.named), "")
