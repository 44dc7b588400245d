"""Taint goes through functions that return a parameter as it is, wherever in the program they are."""

import pytest

from corvane.plans import engine
from corvane.plans.registry import TYPES

SINK = "static int run(char *c) { return system(c); }\n"
#: Of each program the functions with a candidate that taint reaches, and those that it doesn't.
PROGRAMS = {
    "over_files": (
        {
            "id.c": "char *id(char *s) { return s; }",
            "wrap.c": "char *wrap(int n, char *s) { return id(s); }",
            "use.c": 'int go(void) {\n char *u = getenv("X");\n char *c = wrap(1, u);\n return system(c);\n}\nint calm(void) {\n char *c = wrap(1, "ls");\n return system(c);\n}\n',
            "sent.c": SINK + 'int sent(void) {\n char *u = getenv("X");\n char *c = wrap(1, u);\n return run(c);\n}\n',
            "source.c": 'int straight(void) {\n char *c = wrap(1, getenv("X"));\n return system(c);\n}\n',
            "back.c": 'char *ask(void) {\n char *u = getenv("X");\n char *c = wrap(1, u);\n return c;\n}\nint back(void) {\n char *c = ask();\n return system(c);\n}\n',
        },
        {"go", "run", "straight", "back"},
        {"calm"},
    ),
    "returned": ({"id.c": "char *id(char *s) { return s; }", "a.c": 'char *ask(void) {\n char *u = getenv("X");\n return id(u);\n}\nchar *straight(void) {\n return id(getenv("X"));\n}\nchar *calm(void) {\n return id("ls");\n}\n' + "".join(f"int of_{x}(void) {{\n char *c = {x}();\n return system(c);\n}}\n" for x in ("ask", "straight", "calm"))}, {"of_ask", "of_straight"}, {"of_calm"}),
    "library": ({"a.c": 'int copied(void) {\n char *c = strdup(getenv("X"));\n return system(c);\n}\nint calm(void) {\n char *c = strdup("ls");\n return system(c);\n}\n'}, {"copied"}, {"calm"}),
    "copy_of_a_source": ({"a.c": 'int copied(void) {\n char b[9];\n strcpy(b, getenv("X"));\n return system(b);\n}\n'}, {"copied"}, set()),
    "argument_of_main": ({"a.c": SINK + "int main(int argc, char **argv) {\n return run(argv[1]);\n}\n"}, {"run"}, set()),
    "passes_and_asks": ({"a.c": 'char *either(char *s) {\n char *e = getenv("X");\n if (!s) return e;\n return s;\n}\n', "b.c": 'int go(void) {\n char *c = either("ls");\n return system(c);\n}\n'}, {"go"}, set()),
    "unknown_caller": ({"a.c": SINK + "int open_one(char *s) {\n return run(s);\n}\n"}, {"run"}, set()),
    "known_caller": ({"a.c": SINK + "static int shut(char *s) {\n return run(s);\n}\nint main(void) {\n return shut(\"ls\");\n}\n"}, set(), {"run"}),
}


@pytest.mark.parametrize("name", sorted(PROGRAMS))
def test_taint_through_passing_functions(spark, name):
    files, reached, calm = PROGRAMS[name]
    parts = engine.Parts(spark.createDataFrame(sorted(files.items()), "path string, source string"))
    rows = parts.candidates([TYPES["injection"]], "taint_source").collect()
    assert {r.function for r in rows if r.drop_filter is None and r.suspicion == "confirmed"} == reached
    assert {r.function for r in rows if r.drop_filter == "taint_source"} == calm
    assert len(rows) == len(reached | calm) and not any(r.error for r in rows)
