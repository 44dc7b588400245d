"""Tokens of C, and preprocessor lines as tokens of their own."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

TOKEN = re.compile(
    r"""[ \t]*(?:
    (?P<space>[ \t\r\f\v\n]+|\\\r?\n)
  | (?P<comment>/\*.*?(?:\*/|\Z)|//(?:\\\r?\n|[^\n])*)
  | (?P<string>(?:u8|u|U|L)?"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))
  | (?P<char>(?:u|U|L)?'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))
  | (?P<number>(?:0[xX][0-9A-Fa-f]+|\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)[uUlLfF]*)
  | (?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
  | (?P<sign>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]\#@\\`])
  | (?P<other>.)
    )""",
    re.X | re.S,
)
#: The same, for texts without directives.
PLAIN = re.compile(TOKEN.pattern.replace(r"[ \t]*(?:", r"[ \t\r\f\v\n]*(?:", 1), re.X | re.S)
DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)(?:\\\r?\n|/\*.*?\*/|[^\n])*", re.S)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Lines:
    """Line and column of offsets."""

    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def at(self, offset: int) -> tuple[int, int]:
        i = bisect_right(self.starts, offset)
        return i, offset - self.starts[i - 1] + 1


def columns(source: str) -> tuple[list[str], list[str], list[int], list[int]]:
    """Kinds, texts, starts and ends of the tokens."""
    kinds: list[str] = []
    texts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    if "#" not in source:  # no directive, so that a line's start is as good as any other place
        for m in PLAIN.finditer(source):
            kind = m.lastgroup
            if kind != "space" and kind != "comment":
                kinds.append(kind)
                texts.append(m[kind])
                starts.append(m.start(kind))
                ends.append(m.end())
        return kinds, texts, starts, ends
    at, fresh, n, match = 0, True, len(source), TOKEN.match
    while at < n:
        if fresh:
            m = DIRECTIVE.match(source, at)
            if m:
                kinds.append("directive")
                texts.append(m[1])
                starts.append(m.start() + len(m[0]) - len(m[0].lstrip()))
                ends.append(m.end())
                at, fresh = m.end(), False
                continue
        m = match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "space":
            fresh = fresh or "\n" in m[kind] and not m[kind].startswith("\\")
        elif kind != "comment":
            fresh = False
            kinds.append(kind)
            texts.append(m[kind])
            starts.append(m.start(kind))
            ends.append(end)
        at = end
    return kinds, texts, starts, ends


def tokens(source: str) -> list[Token]:
    return [Token(*t) for t in zip(*columns(source), strict=True)]
