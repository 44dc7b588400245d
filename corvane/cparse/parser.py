"""From tokens to trees: declarations, statements, expressions, preprocessor branches.

What doesn't parse becomes an ERROR node up to the next place to go on from, so that a file
always gives a tree.
"""

from __future__ import annotations

import re

from .lexer import Lines, columns
from .nodes import Node

PRIMITIVE = frozenset("void char int float double bool _Bool size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
SIZED = frozenset("signed unsigned long short".split())
STORAGE = frozenset("static extern register auto typedef inline _Thread_local".split())
QUALIFIER = frozenset("const volatile restrict _Atomic __restrict __const".split())
TAGGED = frozenset("struct union enum".split())
STATEMENT = frozenset("if else while do for switch case default return break continue goto sizeof".split())
BINARY = {op: level for level, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %"), 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
PREFIX = frozenset("! ~ + -".split())
POSTFIX = frozenset("( [ -> . ++ --".split())
ALIGNOF = frozenset("_Alignof alignof".split())
#: Tokens that end an expression: a name or number before one of them is all of it.
ENDS = frozenset(") ; , ] }".split())
LEAVES = {"word": "identifier", "number": "number_literal", "char": "char_literal"}
ARGUMENT_TYPES = PRIMITIVE | SIZED | TAGGED
TYPE_WORDS = PRIMITIVE | SIZED | STORAGE | QUALIFIER | TAGGED
#: Words that start no expression of one name.
NO_NAMES = STATEMENT | ALIGNOF
#: So many end tokens stand behind the last token, for whoever looks ahead.
BEYOND = 16


class Parser:
    """The tokens are columns, as looking at one is what costs most: its kind, text, start, end, and its mark, the text
    by which signs and words are told, which strings and directives don't have."""

    def __init__(self, source: str):
        self.source, self.lines = source, Lines(source)
        self.kinds, self.texts, self.starts, self.ends = columns(source)
        self.n, self.i = len(self.kinds), 0
        self.kinds += ["end"] * BEYOND
        self.texts += [""] * BEYOND
        self.starts += [len(source)] * BEYOND
        self.ends += [len(source)] * BEYOND
        self.marks = ["" if kind == "string" or kind == "directive" else text for kind, text in zip(self.kinds, self.texts, strict=True)]
        self.typedefs: set[str] = set()
        #: Definitions and fields of structures, in the order of the text.
        self.functions: list[Node] = []
        self.fields: list[Node] = []

    # ---- tokens and nodes

    def at(self, *texts: str) -> bool:
        """Whether the token is one of these; the end of the text is none."""
        return self.marks[self.i] in texts

    def node(self, kind: str, start: int, end: int, named: bool = True) -> Node:
        return Node(kind, self.source, start, end, self.lines, named)

    def open(self, kind: str) -> Node:
        start = self.starts[self.i]
        return Node(kind, self.source, start, start, self.lines)

    def wrap(self, kind: str, first: Node, field: str | None = None) -> Node:
        n = Node(kind, self.source, first.start, first.end, self.lines)
        first.parent, first.field = n, field
        n.children = [first]
        return n

    def take(self, into: Node) -> None:
        """One token as an anonymous child."""
        i = self.i
        self.i = i + 1
        start, end = self.starts[i], self.ends[i]
        n = Node(self.texts[i] or self.kinds[i], self.source, start, end, self.lines, False)
        n.parent = into
        if into.children:
            into.children.append(n)
        else:
            into.children = [n]
        if end > into.end:
            into.end, into._end_line = end, 0
        if start == end:  # the end of the text may be a line after its last character
            into._end_line = self.lines.at(start)[0]

    def leaf(self, kind: str) -> Node:
        i = self.i
        self.i = i + 1
        return Node(kind, self.source, self.starts[i], self.ends[i], self.lines)

    def expect(self, into: Node, text: str) -> bool:
        if self.marks[self.i] == text:
            self.take(into)
            return True
        return False

    # ---- files and preprocessor

    def file(self) -> Node:
        root = self.node("translation_unit", 0, len(self.source))
        while self.i < self.n:
            before = self.i
            root.add(self.item(top=True))
            if self.i == before:
                root.add(self.leaf("ERROR"))
        return root

    def item(self, top: bool) -> Node | None:
        if self.kinds[self.i] == "directive":
            return self.directive(top)
        if self.marks[self.i] == ";":
            n = self.open("expression_statement")
            self.take(n)
            return n
        return self.declaration(top=True) if top else self.statement()

    def directive(self, top: bool) -> Node | None:
        word, start, end = self.texts[self.i], self.starts[self.i], self.ends[self.i]
        text = self.source[start:end]
        if word in ("if", "ifdef", "ifndef"):
            return self.conditional(top)
        self.i += 1
        m = re.match(r"#\s*define\s+(\w+)(\(([^)]*)\))?[ \t]*(.*)", text, re.S)
        if not m:
            return self.node("preproc_include" if word == "include" else "preproc_call", start, end)
        n = self.node("preproc_function_def" if m[2] else "preproc_def", start, end)
        n.add(self.node("identifier", start + m.start(1), start + m.end(1)), "name")
        if m[2]:
            n.add(self.node("preproc_params", start + m.start(2), start + m.end(2)), "parameters")
        if m[4]:
            n.add(self.node("preproc_arg", start + m.start(4), start + m.end(4)), "value")
        return n

    def conditional(self, top: bool) -> Node:
        word = self.texts[self.i]
        n = self.open({"ifndef": "preproc_ifdef"}.get(word, f"preproc_{word}"))
        self.branch(n, top)
        if self.kinds[self.i] == "directive" and self.texts[self.i] == "endif":
            self.take(n)
        return n.close()

    def branch(self, n: Node, top: bool) -> None:
        """The directive, its items, and the alternative after them."""
        word, start, end = self.texts[self.i], self.starts[self.i], self.ends[self.i]
        self.take(n)
        rest = re.match(r"#\s*\w+\s*(.*)", self.source[start:end], re.S)
        if rest and rest[1] and word != "else":
            start += rest.start(1)
            n.add(self.node("identifier", start, start + len(rest[1].rstrip())), "name" if word in ("ifdef", "ifndef") else "condition")
        while self.i < self.n:
            if self.kinds[self.i] == "directive" and self.texts[self.i] in ("endif", "else", "elif", "elifdef", "elifndef"):
                break
            if not top and self.at("}"):
                break
            before = self.i
            n.add(self.item(top))
            if self.i == before:
                n.add(self.leaf("ERROR"))
        word = self.texts[self.i]
        if self.kinds[self.i] == "directive" and word in ("else", "elif", "elifdef", "elifndef"):
            alternative = self.open("preproc_else" if word == "else" else "preproc_elif")
            self.branch(alternative, top)
            n.add(alternative.close(), "alternative")

    # ---- declarations

    def type_ahead(self, k: int = 0) -> bool:
        """Whether a declaration starts k tokens on."""
        kinds, texts, j = self.kinds, self.texts, self.i + k
        if kinds[j] != "word":
            return False
        word, following = texts[j], texts[j + 1]
        if word in TYPE_WORDS:
            return True
        if word in STATEMENT:
            return False
        if kinds[j + 1] == "word" and following not in STATEMENT:
            return True
        if following == "*":
            j += 1
            while texts[j] in ("*", "const", "volatile", "restrict"):
                j += 1
            return kinds[j] == "word" and texts[j + 1] in ("=", ";", ",", "[", ")", "(") and (texts[j + 1] not in ("(", ")") or word in self.typedefs)
        return word in self.typedefs and following not in ("(", "=", "[", ".", "->", ";", ",", "++", "--", ")")

    def specifiers(self, into: Node) -> bool:
        """Storage, qualifiers and a type; whether there was a type."""
        typed = False
        while self.kinds[self.i] == "word":
            word = self.texts[self.i]
            if word in STORAGE:
                into.add(self.leaf("storage_class_specifier"))
            elif word in QUALIFIER:
                into.add(self.leaf("type_qualifier"))
            elif word in SIZED:
                n = self.open("sized_type_specifier")
                while self.kinds[self.i] == "word" and ((word := self.texts[self.i]) in SIZED or word in ("int", "char", "double")):
                    if word in SIZED:
                        self.take(n)
                    else:
                        n.add(self.leaf("primitive_type"), "type")
                into.add(n.close(), "type")
                typed = True
            elif word in TAGGED:
                into.add(self.tagged(), "type")
                typed = True
            elif word in ("__attribute__", "__declspec", "__extension__"):
                self.i += 1
                if self.at("("):
                    self.skip_group()
            elif typed or word in STATEMENT:
                break
            elif word in PRIMITIVE:
                into.add(self.leaf("primitive_type"), "type")
                typed = True
            else:
                into.add(self.leaf("type_identifier"), "type")
                typed = True
        return typed

    def skip_group(self) -> None:
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        while self.i < self.n:
            text = self.texts[self.i]
            self.i += 1
            depth += (text in pairs) - (text in pairs.values())
            if depth <= 0:
                return

    def tagged(self) -> Node:
        n = self.open(f"{self.texts[self.i]}_specifier")
        self.take(n)
        if self.kinds[self.i] == "word":
            n.add(self.leaf("type_identifier"), "name")
        if self.at("{"):
            enum = n.kind == "enum_specifier"
            body = self.open("enumerator_list" if enum else "field_declaration_list")
            self.take(body)
            while self.i < self.n and not self.at("}"):
                before = self.i
                if self.kinds[self.i] == "directive":
                    self.i += 1
                elif enum:
                    e = self.open("enumerator")
                    if self.kinds[self.i] == "word":
                        e.add(self.leaf("identifier"), "name")
                    if self.expect(e, "="):
                        e.add(self.conditional_expression(), "value")
                    body.add(e.close())
                    self.expect(body, ",")
                else:
                    f = self.open("field_declaration")
                    self.fields.append(f)
                    self.specifiers(f)
                    while not self.at(";", "}") and self.i < self.n:
                        mark = self.i
                        f.add(self.declarator(field=True), "declarator")
                        if self.expect(f, ":"):
                            f.add(self.conditional_expression())
                        self.expect(f, ",")
                        if self.i == mark:
                            self.i += 1
                    self.expect(f, ";")
                    body.add(f.close())
                if self.i == before:
                    self.i += 1
            self.expect(body, "}")
            n.add(body.close(), "body")
        return n.close()

    def declarator(self, field: bool = False, abstract: bool = False) -> Node | None:
        mark = self.marks[self.i]
        if mark == "*":
            n = self.open("pointer_declarator")
            self.take(n)
            while self.texts[self.i] in QUALIFIER:
                n.add(self.leaf("type_qualifier"))
            n.add(self.declarator(field, abstract), "declarator")
            return n.close()
        if mark == "(":
            n = self.open("parenthesized_declarator")
            self.take(n)
            n.add(self.declarator(field, abstract))
            self.expect(n, ")")
            inner: Node | None = n.close()
        elif self.kinds[self.i] == "word" and mark not in STATEMENT:
            inner = self.leaf("field_identifier" if field else "identifier")
        else:
            inner = None
        while (mark := self.marks[self.i]) == "[" or mark == "(":
            if mark == "[":
                n = self.wrap("array_declarator", inner, "declarator") if inner else self.open("array_declarator")
                self.take(n)
                if not self.at("]"):
                    n.add(self.expression(), "size")
                self.expect(n, "]")
            else:
                n = self.wrap("function_declarator", inner, "declarator") if inner else self.open("function_declarator")
                n.add(self.parameters(), "parameters")
            inner = n.close()
        return inner

    def parameters(self) -> Node:
        n = self.open("parameter_list")
        self.take(n)
        while self.i < self.n and not self.at(")", "{", ";"):
            before = self.i
            if self.at("..."):
                n.add(self.leaf("variadic_parameter"))
            elif self.at(","):
                self.take(n)
            else:
                p = self.open("parameter_declaration")
                self.specifiers(p)
                p.add(self.declarator(), "declarator")
                n.add(p.close())
            if self.i == before:
                self.i += 1
        self.expect(n, ")")
        return n.close()

    def declaration(self, top: bool = False) -> Node:
        n, start = self.open("declaration"), self.i
        self.specifiers(n)
        typedef = any(c.kind == "storage_class_specifier" and c.text == "typedef" for c in n.children)
        while self.i < self.n and not self.at(";"):
            before = self.i
            d = self.declarator()
            if d is not None and self.at("{") and top and (d.kind == "function_declarator" or d.all("function_declarator")):
                n.kind = "function_definition"
                self.functions.append(n)
                n.add(d, "declarator")
                n.add(self.block(), "body")
                return n.close()
            if self.at("="):
                d = self.wrap("init_declarator", d, "declarator") if d else self.open("init_declarator")
                self.take(d)
                d.add(self.initializer(), "value")
                d.close()
            if typedef and d is not None:
                names = [x.text for x in d.all("identifier")]
                self.typedefs.update(names[:1])
            n.add(d, "declarator")
            while self.kinds[self.i] == "word" and self.texts[self.i] in ("__attribute__", "asm", "__asm__"):
                self.i += 1
                if self.at("("):
                    self.skip_group()
            if not self.expect(n, ",") and not self.at(";"):
                if self.at("}", "{") or self.kinds[self.i] == "directive" or self.i == before:
                    break
                if not self.at("*", "(") and self.kinds[self.i] != "word":
                    break
        if not self.expect(n, ";") and self.i == start:
            n.kind = "ERROR"
            if self.at("{"):
                n.add(self.block())
            else:
                self.take(n)
        if typedef:
            n.kind = "type_definition"
        return n.close()

    def initializer(self) -> Node:
        if not self.at("{"):
            return self.assignment()
        n = self.open("initializer_list")
        self.take(n)
        while self.i < self.n and not self.at("}"):
            before = self.i
            if self.at(",", ".", "[", "]", "="):
                self.take(n)
                continue
            n.add(self.initializer())
            if self.i == before:
                self.i += 1
        self.expect(n, "}")
        return n.close()

    # ---- statements

    def block(self) -> Node:
        n = self.open("compound_statement")
        self.take(n)
        while self.i < self.n and not self.at("}"):
            before = self.i
            n.add(self.item(top=False))
            if self.i == before:
                n.add(self.leaf("ERROR"))
        self.expect(n, "}")
        return n.close()

    def condition(self, n: Node) -> None:
        if not self.at("("):
            return
        c = self.open("parenthesized_expression")
        self.take(c)
        if not self.at(")"):
            c.add(self.expression())
        self.expect(c, ")")
        n.add(c.close(), "condition")

    def statement(self) -> Node:
        i = self.i
        kind, mark = self.kinds[i], self.marks[i]
        if kind == "directive":
            return self.directive(top=False)
        if mark == "{":
            return self.block()
        if kind == "word":
            handler = getattr(self, f"{mark}_statement", None) if mark in STATEMENT else None
            if handler:
                return handler().close()
            if self.texts[i + 1] == ":" and mark not in STATEMENT and self.texts[i + 2] != ":":
                n = self.open("labeled_statement")
                n.add(self.leaf("statement_identifier"), "label")
                self.take(n)
                if not self.at("}"):
                    n.add(self.statement())
                return n.close()
            if self.type_ahead():
                return self.declaration()
        n = self.open("expression_statement")
        if mark != ";":
            n.add(self.expression())
        if not self.expect(n, ";"):
            while self.i < self.n and not self.at(";", "}", "{") and self.kinds[self.i] != "directive":
                self.i += 1
            self.expect(n, ";")
        return n.close()

    def if_statement(self) -> Node:
        n = self.open("if_statement")
        self.take(n)
        self.condition(n)
        n.add(self.statement(), "consequence")
        if self.at("else"):
            e = self.open("else_clause")
            self.take(e)
            e.add(self.statement())
            n.add(e.close(), "alternative")
        return n

    def else_statement(self) -> Node:
        n = self.open("else_clause")
        self.take(n)
        n.add(self.statement())
        return n

    def while_statement(self) -> Node:
        n = self.open("while_statement")
        self.take(n)
        self.condition(n)
        n.add(self.statement(), "body")
        return n

    def do_statement(self) -> Node:
        n = self.open("do_statement")
        self.take(n)
        n.add(self.statement(), "body")
        if self.expect(n, "while"):
            self.condition(n)
        self.expect(n, ";")
        return n

    def for_statement(self) -> Node:
        n = self.open("for_statement")
        self.take(n)
        if self.expect(n, "("):
            if self.at(";"):
                self.take(n)
            elif self.type_ahead():
                n.add(self.declaration(), "initializer")
            else:
                n.add(self.expression(), "initializer")
                self.expect(n, ";")
            if not self.at(";"):
                n.add(self.expression(), "condition")
            self.expect(n, ";")
            if not self.at(")"):
                n.add(self.expression(), "update")
            self.expect(n, ")")
        n.add(self.statement(), "body")
        return n

    def switch_statement(self) -> Node:
        n = self.open("switch_statement")
        self.take(n)
        self.condition(n)
        n.add(self.statement(), "body")
        return n

    def case_statement(self) -> Node:
        n = self.open("case_statement")
        word = self.texts[self.i]
        self.take(n)
        if word == "case":
            n.add(self.conditional_expression(), "value")
            if self.expect(n, "..."):
                n.add(self.conditional_expression())
        self.expect(n, ":")
        while self.i < self.n and not self.at("case", "default", "}"):
            before = self.i
            n.add(self.item(top=False))
            if self.i == before:
                n.add(self.leaf("ERROR"))
        return n

    default_statement = case_statement

    def simple(self, kind: str) -> Node:
        n = self.open(kind)
        self.take(n)
        if not self.at(";", "}"):
            n.add(self.leaf("statement_identifier") if kind == "goto_statement" else self.expression())
        self.expect(n, ";")
        return n

    def return_statement(self) -> Node:
        return self.simple("return_statement")

    def break_statement(self) -> Node:
        return self.simple("break_statement")

    def continue_statement(self) -> Node:
        return self.simple("continue_statement")

    def goto_statement(self) -> Node:
        return self.simple("goto_statement")

    # ---- expressions

    def expression(self) -> Node:
        left = self.assignment()
        if self.marks[self.i] == ",":
            n = self.wrap("comma_expression", left, "left")
            self.take(n)
            n.add(self.expression(), "right")
            return n.close()
        return left

    def assignment(self) -> Node:
        i = self.i
        if self.marks[i + 1] in ENDS and (kind := LEAVES.get(self.kinds[i])) and self.texts[i] not in NO_NAMES:
            return self.leaf(kind)
        left = self.conditional_expression()
        if self.texts[self.i] in ASSIGN:
            n = self.wrap("assignment_expression", left, "left")
            self.take(n)
            n.add(self.assignment(), "right")
            return n.close()
        return left

    def conditional_expression(self) -> Node:
        test = self.binary(1)
        if self.marks[self.i] != "?":
            return test
        n = self.wrap("conditional_expression", test, "condition")
        self.take(n)
        if not self.at(":"):
            n.add(self.expression(), "consequence")
        self.expect(n, ":")
        n.add(self.conditional_expression(), "alternative")
        return n.close()

    def binary(self, level: int) -> Node:
        left = self.unary()
        while (own := BINARY.get(self.texts[self.i], 0)) >= level:
            n = self.wrap("binary_expression", left, "left")
            self.take(n)
            n.add(self.binary(own + 1), "right")
            left = n.close()
        return left

    def cast_ahead(self) -> bool:
        j, words, stars, known = self.i + 1, 0, 0, False
        while True:
            kind, text = self.kinds[j], self.texts[j]
            if kind == "word" and text not in STATEMENT and stars == 0:
                known |= text in PRIMITIVE or text in SIZED or text in TAGGED or text in QUALIFIER or text in self.typedefs or text.endswith("_t")
                words += 1
            elif text == "*" and words:
                stars += 1
            elif text in QUALIFIER and stars:
                pass
            elif text == ")" and kind == "sign":
                break
            else:
                return False
            j += 1
        if not words:
            return False
        kind, text = self.kinds[j + 1], self.texts[j + 1]
        starts = kind in ("word", "number", "string", "char") and text not in STATEMENT or text in ("(", "sizeof")
        return (known or stars > 0) and (starts or text in ("&", "*", "!", "~", "-", "+", "{")) or words == 1 and not stars and kind in ("word", "number", "string", "char") and text not in STATEMENT

    def type_descriptor(self) -> Node:
        n = self.open("type_descriptor")
        self.specifiers(n)
        n.add(self.declarator(abstract=True), "declarator")
        return n.close()

    def unary(self) -> Node:
        i = self.i
        kind, mark = self.kinds[i], self.marks[i]
        if (leaf := LEAVES.get(kind)) and mark not in NO_NAMES:
            n = self.leaf(leaf)
            return self.postfix(n) if self.marks[i + 1] in POSTFIX else n
        if kind == "word" and (mark == "sizeof" or mark in ALIGNOF):
            n = self.open("sizeof_expression" if mark == "sizeof" else "alignof_expression")
            self.take(n)
            i += 1
            kinds, texts = self.kinds, self.texts
            if self.at("(") and (self.type_ahead(1) or texts[i + 1] in self.typedefs or texts[i + 1].endswith("_t") or kinds[i + 1] == "word" and texts[i + 2] == "*" and texts[i + 3] in (")", "*")):
                self.take(n)
                n.add(self.type_descriptor(), "type")
                self.expect(n, ")")
            else:
                n.add(self.unary(), "value")
            return n.close()
        if mark == "(" and self.cast_ahead():
            n = self.open("cast_expression")
            self.take(n)
            n.add(self.type_descriptor(), "type")
            self.expect(n, ")")
            if self.at("{"):
                n.kind = "compound_literal_expression"
                n.add(self.initializer(), "value")
            else:
                n.add(self.unary(), "value")
            return n.close()
        of = "pointer_expression" if mark in ("*", "&") else "unary_expression" if mark in PREFIX else "update_expression" if mark in ("++", "--") else None
        if of:
            n = self.open(of)
            self.take(n)
            n.add(self.unary(), "argument")
            return n.close()
        return self.postfix(self.primary())

    def primary(self) -> Node:
        """What is no name, number or character."""
        kind = self.kinds[self.i]
        if kind == "string":
            first = self.leaf("string_literal")
            if self.kinds[self.i] != "string":
                return first
            n = self.wrap("concatenated_string", first)
            while self.kinds[self.i] == "string":
                n.add(self.leaf("string_literal"))
            return n.close()
        if self.at("("):
            n = self.open("parenthesized_expression")
            self.take(n)
            if self.at("{"):
                n.add(self.block())
            elif not self.at(")"):
                n.add(self.expression())
            self.expect(n, ")")
            return n.close()
        n = self.open("ERROR")
        if kind not in ("end", "directive") and not self.at(";", "}", ")", "]", "{", ","):
            self.take(n)
        return n

    def postfix(self, left: Node) -> Node:
        while (mark := self.marks[self.i]) in POSTFIX:
            if mark == "(":
                n = self.wrap("call_expression", left, "function")
                args = self.open("argument_list")
                self.take(args)
                while self.i < self.n and (mark := self.marks[self.i]) not in (")", ";", "}"):
                    before = self.i
                    if mark == ",":
                        self.take(args)
                    else:
                        args.add(self.type_descriptor() if self.texts[before] in ARGUMENT_TYPES and self.type_ahead() else self.assignment())
                    if self.i == before:
                        self.i += 1
                self.expect(args, ")")
                n.add(args.close(), "arguments")
            elif mark == "[":
                n = self.wrap("subscript_expression", left, "argument")
                self.take(n)
                if not self.at("]"):
                    n.add(self.expression(), "index")
                self.expect(n, "]")
            elif mark == "->" or mark == ".":
                n = self.wrap("field_expression", left, "argument")
                self.take(n)
                if self.kinds[self.i] == "word":
                    n.add(self.leaf("field_identifier"), "field")
            else:
                n = self.wrap("update_expression", left, "argument")
                self.take(n)
            left = n.close()
        return left


def parsed(source: str) -> tuple[Node, list[Node], list[Node]]:
    """The tree, and the function definitions and structures' fields in it."""
    import sys

    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    p = Parser(source)
    return p.file(), p.functions, p.fields


def parse(source: str) -> Node:
    return parsed(source)[0]
