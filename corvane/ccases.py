"""C programs by pattern: what the scan queries run over, and what each must give.

A case is a small program in one file or two. {k} stands for the key of a table's row, so a
table of n rows becomes n programs. What a case must give stands beside it: every line was
held against the rules of the detectors, builders and filters. The queries' SQL derives the
expected rows from these lines and the table, and never from the engine.

Fields are parted by |, and - is an empty one. Files count from 1, lines too.
events:   TYPE|file|function|line|variable|category
edges:    TYPE|file|function|line|source|target|note for the edges of the graph, and
          FUNCTION|file|name|return type|static|line|end line|parameters
          VARIABLE|file|function|line|name|type|source, a pointer variable
          DEED|file|function|deed|parameter|place|ways, what a function does to what it is given
          NULLABLE, TAINTED|file|function, what it may return; PARAMS|file|function|tainted parameters
          NEXT|file|function|line>lines that may follow;.., 0 the entry and -1 the end
          EVERY|file|function|lines that every way to the end passes
          RANGE|file|function|line|variable|least|greatest, at a return
results:  vulnerability type|file|function|line|variable|suspicion or the filter that drops|source line|sure
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Case:
    name: str
    files: tuple[str, ...]
    events: str = ""
    edges: str = ""
    results: str = ""


def case(name: str, *files: str, events: str = "", edges: str = "", results: str = "") -> Case:
    return Case(name, tuple(x.strip("\n") + "\n" for x in files), events, edges, results)


CASES: tuple[Case, ...] = (
    # ---- null pointers
    case("null_alloc", """
int a{k}(int n) {
  char *p = malloc(n);
  p[0] = 1;
  return 0;
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
UNCHECKED_RETURN|1|a{k}|2|p|unchecked_return
DEREFERENCE|1|a{k}|3|p|-
NULL_VALUE|1|a{k}|4|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
FUNCTION|1|a{k}|int|-|1|5|n
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|a{k}|2,3,4
""", results="""
memory-leak|1|a{k}|2|p|suspected|0|-
null-deref|1|a{k}|3|p|confirmed|2|-
unchecked-return|1|a{k}|2|p|suspected|0|-
"""),
    case("null_guarded", """
int a{k}(int n) {
  char *p = malloc(n);
  if (p != NULL) {
    p[0] = 1;
  }
  return 0;
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
NULL_GUARD|1|a{k}|3|p|scope
NULL_VALUE|1|a{k}|6|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
FUNCTION|1|a{k}|int|-|1|7|n
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,6;4>6;6>-1
EVERY|1|a{k}|2,3,6
""", results="""
memory-leak|1|a{k}|2|p|suspected|0|-
"""),
    case("null_definite", """
struct s { int x; };
int a{k}(void) {
  struct s *p = NULL;
  return p->x;
}
""", events="""
NULL_VALUE|1|a{k}|3|p|-
DEREFERENCE|1|a{k}|4|p|-
""", edges="""
FUNCTION|1|a{k}|int|-|2|5|-
VARIABLE|1|a{k}|3|p|struct s*|stack
NEXT|1|a{k}|0>3;3>4;4>-1
EVERY|1|a{k}|3,4
""", results="""
null-deref|1|a{k}|4|p|confirmed|3|sure
"""),
    case("null_early_return", """
struct s { int x; };
int a{k}(struct s *q) {
  struct s *p = find{k}(q);
  if (!p)
    return 0;
  return p->x;
}
""", events="""
NULL_VALUE|1|a{k}|3|p|call_result
NULL_GUARD|1|a{k}|4|p|scope
NULL_GUARD|1|a{k}|5|p|early_return
NULL_VALUE|1|a{k}|5|<return>|-
""", edges="""
CALL|1|a{k}|3|a{k}|find{k}|-
FUNCTION|1|a{k}|int|-|2|7|q
VARIABLE|1|a{k}|3|p|struct s*|stack
NULLABLE|1|a{k}
NEXT|1|a{k}|0>3;3>4;4>5,6;5>-1;6>-1
EVERY|1|a{k}|3,4
"""),
    case("null_result", """
struct s { int x; };
struct s *make{k}(int n) {
  if (n < 0)
    return NULL;
  return malloc(sizeof(struct s));
}
int a{k}(int n) {
  struct s *p = make{k}(n);
  return p->x;
}
""", events="""
NULL_VALUE|1|make{k}|4|<return>|-
NULL_VALUE|1|a{k}|8|p|call_result
DEREFERENCE|1|a{k}|9|p|-
""", edges="""
CALL|1|make{k}|5|make{k}|malloc|-
CALL|1|a{k}|8|a{k}|make{k}|-
PARAM_BINDING|1|a{k}|8|n|make{k}#0|0
RETURN|1|a{k}|8|make{k}|p|-
FUNCTION|1|make{k}|-|-|2|6|n
FUNCTION|1|a{k}|int|-|7|10|n
VARIABLE|1|a{k}|8|p|struct s*|stack
NULLABLE|1|make{k}
NEXT|1|a{k}|0>8;8>9;9>-1
NEXT|1|make{k}|0>3;3>4,5;4>-1;5>-1
EVERY|1|a{k}|8,9
EVERY|1|make{k}|3
""", results="""
null-deref|1|a{k}|9|p|confirmed|8|-
"""),
    case("null_not_nullable", """
struct s { int x; };
struct s *own{k}(struct s *q) {
  static struct s one;
  return &one;
}
int a{k}(struct s *q) {
  struct s *p = own{k}(q);
  return p->x;
}
""", events="""
DEREFERENCE|1|a{k}|8|p|-
""", edges="""
CALL|1|a{k}|7|a{k}|own{k}|-
PARAM_BINDING|1|a{k}|7|q|own{k}#0|0
RETURN|1|a{k}|7|own{k}|p|-
FUNCTION|1|own{k}|-|-|2|5|q
FUNCTION|1|a{k}|int|-|6|9|q
VARIABLE|1|a{k}|7|p|struct s*|stack
NEXT|1|a{k}|0>7;7>8;8>-1
NEXT|1|own{k}|0>3;3>4;4>-1
EVERY|1|a{k}|7,8
EVERY|1|own{k}|3,4
""", results="""
null-deref|1|a{k}|8|p|nullable_source|0|-
"""),
    case("null_array", """
int a{k}(void) {
  int v[4];
  v[0] = 3;
  return v[0];
}
""", events="""
DEREFERENCE|1|a{k}|3|v|-
DEREFERENCE|1|a{k}|4|v|-
""", edges="""
FUNCTION|1|a{k}|int|-|1|5|-
NEXT|1|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|a{k}|2,3,4
""", results="""
null-deref|1|a{k}|3|v|non_nullable_array_suppress|0|-
null-deref|1|a{k}|4|v|non_nullable_array_suppress|0|-
"""),
    case("null_sizeof", """
struct s { int x; };
unsigned long a{k}(void) {
  struct s *p = NULL;
  return sizeof(*p);
}
""", events="""
NULL_VALUE|1|a{k}|3|p|-
DEREFERENCE|1|a{k}|4|p|-
""", edges="""
FUNCTION|1|a{k}|unsigned long|-|2|5|-
VARIABLE|1|a{k}|3|p|struct s*|stack
NEXT|1|a{k}|0>3;3>4;4>-1
EVERY|1|a{k}|3,4
""", results="""
null-deref|1|a{k}|4|p|sizeof_pseudo_deref|3|sure
"""),
    case("null_across_files", """
struct s { int x; };
struct s *look{k}(int n) {
  if (n > 3)
    return NULL;
  return real{k}(n);
}
""", """
struct s { int x; };
int a{k}(int n) {
  struct s *p = look{k}(n);
  return p->x;
}
""", events="""
NULL_VALUE|1|look{k}|4|<return>|-
NULL_VALUE|2|a{k}|3|p|call_result
DEREFERENCE|2|a{k}|4|p|-
""", edges="""
CALL|1|look{k}|5|look{k}|real{k}|-
CALL|2|a{k}|3|a{k}|look{k}|-
PARAM_BINDING|2|a{k}|3|n|look{k}#0|0
RETURN|2|a{k}|3|look{k}|p|-
FUNCTION|1|look{k}|-|-|2|6|n
FUNCTION|2|a{k}|int|-|2|5|n
VARIABLE|2|a{k}|3|p|struct s*|stack
NULLABLE|1|look{k}
NEXT|1|look{k}|0>3;3>4,5;4>-1;5>-1
NEXT|2|a{k}|0>3;3>4;4>-1
EVERY|1|look{k}|3
EVERY|2|a{k}|3,4
""", results="""
null-deref|2|a{k}|4|p|confirmed|3|-
"""),
    case("null_to_callee", """
struct s { int x; };
int follow{k}(struct s *p) {
  return p->x;
}
int a{k}(void) {
  struct s *p = NULL;
  return follow{k}(p);
}
""", events="""
DEREFERENCE|1|follow{k}|3|p|-
NULL_VALUE|1|a{k}|6|p|-
DEREFERENCE|1|a{k}|7|p|interprocedural
""", edges="""
CALL|1|a{k}|7|a{k}|follow{k}|-
PARAM_BINDING|1|a{k}|7|p|follow{k}#0|0
FUNCTION|1|follow{k}|int|-|2|4|p
FUNCTION|1|a{k}|int|-|5|8|-
VARIABLE|1|a{k}|6|p|struct s*|stack
NEXT|1|a{k}|0>6;6>7;7>-1
NEXT|1|follow{k}|0>3;3>-1
EVERY|1|a{k}|6,7
EVERY|1|follow{k}|3
""", results="""
null-deref|1|follow{k}|3|p|nullable_source|0|-
null-deref|1|a{k}|7|p|confirmed|6|sure
"""),
    # ---- buffers
    case("buffer_strcpy", """
void a{k}(char *s) {
  char b[8];
  strcpy(b, s);
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|b|buffer_overflow
""", edges="""
CALL|1|a{k}|3|a{k}|strcpy|-
FUNCTION|1|a{k}|void|-|1|4|s
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
buffer-overflow|1|a{k}|3|b|suspected|0|-
"""),
    case("buffer_literal_fits", """
void a{k}(void) {
  char b[8];
  strcpy(b, "short");
}
""", edges="""
CALL|1|a{k}|3|a{k}|strcpy|-
FUNCTION|1|a{k}|void|-|1|4|-
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
"""),
    case("buffer_bounded", """
void a{k}(char *s, int n) {
  char b[8];
  memcpy(b, s, 16);
  strncpy(b, s, sizeof(b));
  memcpy(b, s, n);
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|b|bounded_copy_overflow
BUFFER_ACCESS|1|a{k}|5|b|bounded_copy_var_size
""", edges="""
CALL|1|a{k}|3|a{k}|memcpy|-
CALL|1|a{k}|4|a{k}|strncpy|-
CALL|1|a{k}|5|a{k}|memcpy|-
FUNCTION|1|a{k}|void|-|1|6|s,n
NEXT|1|a{k}|0>2;2>3;3>4;4>5;5>-1
EVERY|1|a{k}|2,3,4,5
""", results="""
buffer-overflow|1|a{k}|3|b|confirmed|0|-
buffer-overflow|1|a{k}|5|b|possible|0|-
"""),
    case("buffer_secure", """
void a{k}(char *s, int n) {
  char b[8];
  memcpy_s(b, 32, s, 4);
  memcpy_s(b, 8, s, 12);
  memcpy_s(b, 8, s, 4);
  memcpy_s(b, n, s, 4);
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|b|secure_copy_overflow
BUFFER_ACCESS|1|a{k}|4|b|secure_constraint_violation
BUFFER_ACCESS|1|a{k}|6|b|secure_copy_var_size
""", edges="""
CALL|1|a{k}|3|a{k}|memcpy_s|-
CALL|1|a{k}|4|a{k}|memcpy_s|-
CALL|1|a{k}|5|a{k}|memcpy_s|-
CALL|1|a{k}|6|a{k}|memcpy_s|-
FUNCTION|1|a{k}|void|-|1|7|s,n
NEXT|1|a{k}|0>2;2>3;3>4;4>5;5>6;6>-1
EVERY|1|a{k}|2,3,4,5,6
""", results="""
buffer-overflow|1|a{k}|3|b|confirmed|0|-
buffer-overflow|1|a{k}|4|b|suspected|0|-
buffer-overflow|1|a{k}|6|b|possible|0|-
"""),
    case("buffer_sprintf", """
void a{k}(char *s) {
  char b[8];
  sprintf(b, "%s", s);
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|b|sprintf_overflow
""", edges="""
CALL|1|a{k}|3|a{k}|sprintf|-
FUNCTION|1|a{k}|void|-|1|4|s
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
buffer-overflow|1|a{k}|3|b|suspected|0|-
"""),
    case("buffer_scanf_s", """
void a{k}(int n) {
  char b[8];
  scanf_s("%s", b, 20);
  scanf_s("%s", b, 8);
  scanf_s("%s", b, n);
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|-|secure_scanf_overflow
BUFFER_ACCESS|1|a{k}|5|-|secure_scanf_var_size
""", edges="""
CALL|1|a{k}|3|a{k}|scanf_s|-
CALL|1|a{k}|4|a{k}|scanf_s|-
CALL|1|a{k}|5|a{k}|scanf_s|-
FUNCTION|1|a{k}|void|-|1|6|n
NEXT|1|a{k}|0>2;2>3;3>4;4>5;5>-1
EVERY|1|a{k}|2,3,4,5
""", results="""
buffer-overflow|1|a{k}|3|scanf_s("%s", b, 20)|confirmed|0|-
buffer-overflow|1|a{k}|5|scanf_s("%s", b, n)|possible|0|-
"""),
    case("bounds_array", """
int a{k}(void) {
  int v[4];
  v[4] = 1;
  return v[6];
}
""", events="""
BUFFER_ACCESS|1|a{k}|3|v|array_oob_write
DEREFERENCE|1|a{k}|3|v|-
BUFFER_ACCESS|1|a{k}|4|v|array_oob_read
DEREFERENCE|1|a{k}|4|v|-
""", edges="""
FUNCTION|1|a{k}|int|-|1|5|-
NEXT|1|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|a{k}|2,3,4
""", results="""
buffer-overflow|1|a{k}|3|v|confirmed|0|-
null-deref|1|a{k}|3|v|non_nullable_array_suppress|0|-
null-deref|1|a{k}|4|v|non_nullable_array_suppress|0|-
out-of-bounds|1|a{k}|4|v|confirmed|0|-
"""),
    case("bounds_heap", """
char a{k}(void) {
  char *p = malloc(4);
  if (!p)
    return 0;
  p[9] = 1;
  return p[5];
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
NULL_GUARD|1|a{k}|3|p|scope
NULL_GUARD|1|a{k}|4|p|early_return
NULL_VALUE|1|a{k}|4|<return>|-
BUFFER_ACCESS|1|a{k}|5|p|heap_oob_write
BUFFER_ACCESS|1|a{k}|6|p|heap_oob_read
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
FUNCTION|1|a{k}|char|-|1|7|-
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>6;6>-1
EVERY|1|a{k}|2,3
""", results="""
buffer-overflow|1|a{k}|5|p|confirmed|0|-
memory-leak|1|a{k}|2|p|suspected|0|-
out-of-bounds|1|a{k}|6|p|confirmed|0|-
"""),
    case("bounds_loop", """
int a{k}(void) {
  int v[4];
  for (int i = 0; i <= 4; i++)
    v[i] = 0;
  return 0;
}
""", events="""
BUFFER_ACCESS|1|a{k}|4|v|array_oob_write
DEREFERENCE|1|a{k}|4|v|-
NULL_VALUE|1|a{k}|5|<return>|-
""", edges="""
FUNCTION|1|a{k}|int|-|1|6|-
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>3,4,5;4>3;5>-1
EVERY|1|a{k}|2,3,5
RANGE|1|a{k}|5|i|0|open
""", results="""
buffer-overflow|1|a{k}|4|v|confirmed|0|-
null-deref|1|a{k}|4|v|non_nullable_array_suppress|0|-
"""),
    # ---- memory and resources
    case("leak", """
int a{k}(int n) {
  char *p = malloc(n);
  if (!p)
    return 1;
  if (n > 9)
    return 2;
  free(p);
  return 0;
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
NULL_GUARD|1|a{k}|3|p|scope
NULL_GUARD|1|a{k}|4|p|early_return
NULL_VALUE|1|a{k}|8|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
CALL|1|a{k}|7|a{k}|free|-
RELEASE|1|a{k}|7|p|free|free
FUNCTION|1|a{k}|int|-|1|9|n
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>6,7;6>-1;7>8;8>-1
EVERY|1|a{k}|2,3
""", results="""
memory-leak|1|a{k}|2|p|suspected|0|-
"""),
    case("leak_freed", """
int a{k}(int n) {
  char *p = malloc(n);
  if (!p)
    return 1;
  free(p);
  return 0;
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
MEMORY_RELEASE|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
NULL_GUARD|1|a{k}|3|p|scope
NULL_GUARD|1|a{k}|4|p|early_return
NULL_VALUE|1|a{k}|6|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
CALL|1|a{k}|5|a{k}|free|-
RELEASE|1|a{k}|5|p|free|free
FUNCTION|1|a{k}|int|-|1|7|n
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>6;6>-1
EVERY|1|a{k}|2,3
""", results="""
memory-leak|1|a{k}|2|p|memory_release|0|-
"""),
    case("leak_returned", """
char *a{k}(int n) {
  char *p = malloc(n);
  return p;
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
MEMORY_RELEASE|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
UNCHECKED_RETURN|1|a{k}|2|p|unchecked_return
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
DATA_FLOW|1|a{k}|3|p|a{k}|return
OWNERSHIP_TRANSFER|1|a{k}|3|p|a{k}|return
FUNCTION|1|a{k}|char|-|1|4|n
VARIABLE|1|a{k}|2|p|char*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
memory-leak|1|a{k}|2|p|memory_release|0|-
unchecked-return|1|a{k}|2|p|suspected|0|-
"""),
    case("leak_stored", """
char *g_slot{k};
void a{k}(int n) {
  char *p = malloc(n);
  g_slot{k} = p;
}
""", events="""
MEMORY_ALLOC|1|a{k}|3|p|-
NULL_VALUE|1|a{k}|3|p|-
UNCHECKED_RETURN|1|a{k}|3|p|unchecked_return
""", edges="""
CALL|1|a{k}|3|a{k}|malloc|-
DATA_FLOW|1|a{k}|4|p|g_slot{k}|copy
ALIAS|1|a{k}|4|g_slot{k}|p|-
OWNERSHIP_TRANSFER|1|a{k}|4|p|g_slot{k}|store
GLOBAL_ACCESS|1|a{k}|2|a{k}|g_slot{k}|write
FUNCTION|1|a{k}|void|-|2|5|n
VARIABLE|1|a{k}|3|p|char*|heap
NEXT|1|a{k}|0>3;3>4;4>-1
EVERY|1|a{k}|3,4
""", results="""
memory-leak|1|a{k}|3|p|ownership_transfer|0|-
unchecked-return|1|a{k}|3|p|suspected|0|-
"""),
    case("resource", """
int a{k}(const char *s) {
  FILE *f = fopen("x", "r");
  if (!f)
    return 1;
  if (s == NULL)
    return 2;
  fclose(f);
  return 0;
}
""", events="""
NULL_VALUE|1|a{k}|2|f|call_result
RESOURCE_ACQUIRE|1|a{k}|2|f|-
NULL_GUARD|1|a{k}|3|f|scope
NULL_GUARD|1|a{k}|4|f|early_return
NULL_GUARD|1|a{k}|5|s|scope
NULL_GUARD|1|a{k}|6|s|early_return
NULL_VALUE|1|a{k}|8|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|fopen|-
CALL|1|a{k}|7|a{k}|fclose|-
RELEASE|1|a{k}|7|f|fclose|fclose
FUNCTION|1|a{k}|int|-|1|9|s
VARIABLE|1|a{k}|2|f|FILE*|stack
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>6,7;6>-1;7>8;8>-1
EVERY|1|a{k}|2,3
""", results="""
resource-leak|1|a{k}|2|f|suspected|0|-
"""),
    case("resource_closed", """
int a{k}(void) {
  FILE *f = fopen("x", "r");
  if (!f)
    return 1;
  fclose(f);
  return 0;
}
""", events="""
NULL_VALUE|1|a{k}|2|f|call_result
RESOURCE_ACQUIRE|1|a{k}|2|f|-
RESOURCE_RELEASE|1|a{k}|2|f|-
NULL_GUARD|1|a{k}|3|f|scope
NULL_GUARD|1|a{k}|4|f|early_return
NULL_VALUE|1|a{k}|6|<return>|-
""", edges="""
CALL|1|a{k}|2|a{k}|fopen|-
CALL|1|a{k}|5|a{k}|fclose|-
RELEASE|1|a{k}|5|f|fclose|fclose
FUNCTION|1|a{k}|int|-|1|7|-
VARIABLE|1|a{k}|2|f|FILE*|stack
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>6;6>-1
EVERY|1|a{k}|2,3
""", results="""
resource-leak|1|a{k}|2|f|resource_release|0|-
"""),
    case("lock_kept", """
pthread_mutex_t m{k};
int a{k}(int n) {
  pthread_mutex_lock(&m{k});
  if (n)
    return 1;
  pthread_mutex_unlock(&m{k});
  return 0;
}
""", events="""
RESOURCE_ACQUIRE|1|a{k}|3|&m{k}|-
NULL_GUARD|1|a{k}|4|n|scope
NULL_VALUE|1|a{k}|7|<return>|-
""", edges="""
CALL|1|a{k}|3|a{k}|pthread_mutex_lock|-
CALL|1|a{k}|6|a{k}|pthread_mutex_unlock|-
GLOBAL_ACCESS|1|a{k}|2|a{k}|m{k}|read
FUNCTION|1|a{k}|int|-|2|8|n
NULLABLE|1|a{k}
NEXT|1|a{k}|0>3;3>4;4>5,6;5>-1;6>7;7>-1
EVERY|1|a{k}|3,4
""", results="""
resource-leak|1|a{k}|3|&m{k}|suspected|0|-
"""),
    case("uninit", """
int a{k}(int n) {
  int x;
  if (n)
    x = 1;
  return x;
}
""", events="""
NULL_GUARD|1|a{k}|3|n|scope
VALUE_USE|1|a{k}|5|x|stack_uninit
""", edges="""
DATA_FLOW|1|a{k}|5|x|a{k}|return
OWNERSHIP_TRANSFER|1|a{k}|5|x|a{k}|return
FUNCTION|1|a{k}|int|-|1|6|n
NEXT|1|a{k}|0>2;2>3;3>4,5;4>5;5>-1
EVERY|1|a{k}|2,3,5
""", results="""
uninit|1|a{k}|5|x|suspected|2|-
"""),
    case("uninit_set", """
int a{k}(int n) {
  int x;
  if (n)
    x = 1;
  else
    x = 2;
  return x;
}
""", events="""
NULL_GUARD|1|a{k}|3|n|scope
""", edges="""
DATA_FLOW|1|a{k}|7|x|a{k}|return
OWNERSHIP_TRANSFER|1|a{k}|7|x|a{k}|return
FUNCTION|1|a{k}|int|-|1|8|n
NEXT|1|a{k}|0>2;2>3;3>4,6;4>7;6>7;7>-1
EVERY|1|a{k}|2,3,7
"""),
    case("uninit_heap", """
int a{k}(void) {
  int *p = malloc(8);
  if (!p)
    return 0;
  return p[1];
}
""", events="""
MEMORY_ALLOC|1|a{k}|2|p|-
NULL_VALUE|1|a{k}|2|p|-
NULL_GUARD|1|a{k}|3|p|scope
NULL_GUARD|1|a{k}|4|p|early_return
NULL_VALUE|1|a{k}|4|<return>|-
VALUE_USE|1|a{k}|5|p|heap_uninit
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
FUNCTION|1|a{k}|int|-|1|6|-
VARIABLE|1|a{k}|2|p|int*|heap
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3;3>4,5;4>-1;5>-1
EVERY|1|a{k}|2,3
""", results="""
memory-leak|1|a{k}|2|p|suspected|0|-
uninit|1|a{k}|5|p|suspected|0|-
"""),
    case("use_after_free", """
char a{k}(char *p) {
  free(p);
  return p[0];
}
""", events="""
DEREFERENCE|1|a{k}|3|p|-
USE_AFTER_FREE|1|a{k}|3|p|free
""", edges="""
CALL|1|a{k}|2|a{k}|free|-
RELEASE|1|a{k}|2|p|free|free
DEED|1|a{k}|frees|0|-|every
FUNCTION|1|a{k}|char|-|1|4|p
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
null-deref|1|a{k}|3|p|nullable_source|0|-
use-after-free|1|a{k}|3|p|confirmed|2|sure
"""),
    case("use_after_renewal", """
char a{k}(char *p, int n) {
  free(p);
  p = next{k}(n);
  return p[0];
}
""", events="""
NULL_VALUE|1|a{k}|3|p|call_result
DEREFERENCE|1|a{k}|4|p|-
USE_AFTER_FREE|1|a{k}|4|p|free
""", edges="""
CALL|1|a{k}|2|a{k}|free|-
CALL|1|a{k}|3|a{k}|next{k}|-
RELEASE|1|a{k}|2|p|free|free
FUNCTION|1|a{k}|char|-|1|5|p,n
NEXT|1|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|a{k}|2,3,4
""", results="""
null-deref|1|a{k}|4|p|nullable_source|0|-
use-after-free|1|a{k}|4|p|lifetime|0|-
"""),
    case("use_after_free_of_callee", """
void drop{k}(char *c) {
  free(c);
}
char a{k}(char *p) {
  drop{k}(p);
  return p[0];
}
""", events="""
DEREFERENCE|1|a{k}|6|p|-
USE_AFTER_FREE|1|a{k}|6|p|callee
""", edges="""
CALL|1|drop{k}|2|drop{k}|free|-
CALL|1|a{k}|5|a{k}|drop{k}|-
RELEASE|1|drop{k}|2|c|free|free
PARAM_BINDING|1|a{k}|5|p|drop{k}#0|0
DEED|1|drop{k}|frees|0|-|every
FUNCTION|1|drop{k}|void|-|1|3|c
FUNCTION|1|a{k}|char|-|4|7|p
NEXT|1|a{k}|0>5;5>6;6>-1
NEXT|1|drop{k}|0>2;2>-1
EVERY|1|a{k}|5,6
EVERY|1|drop{k}|2
""", results="""
null-deref|1|a{k}|6|p|nullable_source|0|-
use-after-free|1|a{k}|6|p|confirmed|5|sure
"""),
    case("use_after_free_across_files", """
void let{k}(char *c) {
  free(c);
}
""", """
char a{k}(char *p) {
  let{k}(p);
  return p[0];
}
""", events="""
DEREFERENCE|2|a{k}|3|p|-
USE_AFTER_FREE|2|a{k}|3|p|callee
""", edges="""
CALL|1|let{k}|2|let{k}|free|-
CALL|2|a{k}|2|a{k}|let{k}|-
RELEASE|1|let{k}|2|c|free|free
PARAM_BINDING|2|a{k}|2|p|let{k}#0|0
DEED|1|let{k}|frees|0|-|every
FUNCTION|1|let{k}|void|-|1|3|c
FUNCTION|2|a{k}|char|-|1|4|p
NEXT|1|let{k}|0>2;2>-1
NEXT|2|a{k}|0>2;2>3;3>-1
EVERY|1|let{k}|2
EVERY|2|a{k}|2,3
""", results="""
null-deref|2|a{k}|3|p|nullable_source|0|-
use-after-free|2|a{k}|3|p|confirmed|2|sure
"""),
    case("use_after_free_macro", """
#define FREE(p) free(p)
char a{k}(char *p) {
  FREE(p);
  return p[0];
}
""", events="""
DEREFERENCE|1|a{k}|4|p|-
USE_AFTER_FREE|1|a{k}|4|p|macro
""", edges="""
CALL|1|a{k}|3|a{k}|FREE|-
FUNCTION|1|a{k}|char|-|2|5|p
NEXT|1|a{k}|0>3;3>4;4>-1
EVERY|1|a{k}|3,4
""", results="""
null-deref|1|a{k}|4|p|nullable_source|0|-
use-after-free|1|a{k}|4|p|confirmed|3|sure
"""),
    case("double_free", """
void a{k}(char *p) {
  free(p);
  free(p);
}
""", events="""
DOUBLE_FREE|1|a{k}|3|p|-
""", edges="""
CALL|1|a{k}|2|a{k}|free|-
CALL|1|a{k}|3|a{k}|free|-
RELEASE|1|a{k}|2|p|free|free
RELEASE|1|a{k}|3|p|free|free
DEED|1|a{k}|frees|0|-|every
FUNCTION|1|a{k}|void|-|1|4|p
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
double-free|1|a{k}|3|p|confirmed|2|sure
"""),
    case("double_free_apart", """
void a{k}(char *p, int n) {
  if (n) {
    free(p);
    return;
  }
  free(p);
}
""", events="""
NULL_GUARD|1|a{k}|2|n|scope
DOUBLE_FREE|1|a{k}|6|p|-
""", edges="""
CALL|1|a{k}|3|a{k}|free|-
CALL|1|a{k}|6|a{k}|free|-
RELEASE|1|a{k}|3|p|free|free
RELEASE|1|a{k}|6|p|free|free
DEED|1|a{k}|frees|0|-|every
FUNCTION|1|a{k}|void|-|1|7|p,n
NEXT|1|a{k}|0>2;2>3,6;3>4;4>-1;6>-1
EVERY|1|a{k}|2
""", results="""
double-free|1|a{k}|6|p|double_free_flow|3|-
"""),
    case("double_free_across_files", """
void gone{k}(char *c) {
  free(c);
}
""", """
void a{k}(char *p) {
  gone{k}(p);
  free(p);
}
""", events="""
DOUBLE_FREE|2|a{k}|3|p|-
""", edges="""
CALL|1|gone{k}|2|gone{k}|free|-
CALL|2|a{k}|2|a{k}|gone{k}|-
CALL|2|a{k}|3|a{k}|free|-
RELEASE|1|gone{k}|2|c|free|free
RELEASE|2|a{k}|3|p|free|free
PARAM_BINDING|2|a{k}|2|p|gone{k}#0|0
DEED|1|gone{k}|frees|0|-|every
FUNCTION|1|gone{k}|void|-|1|3|c
DEED|2|a{k}|frees|0|-|every
FUNCTION|2|a{k}|void|-|1|4|p
NEXT|1|gone{k}|0>2;2>-1
NEXT|2|a{k}|0>2;2>3;3>-1
EVERY|1|gone{k}|2
EVERY|2|a{k}|2,3
""", results="""
double-free|2|a{k}|3|p|confirmed|2|sure
"""),
    # ---- input
    case("injection_parameter", """
void a{k}(char *c) {
  system(c);
}
""", events="""
INJECTION|1|a{k}|2|c|command_injection
""", edges="""
CALL|1|a{k}|2|a{k}|system|-
FUNCTION|1|a{k}|void|-|1|3|c
NEXT|1|a{k}|0>2;2>-1
EVERY|1|a{k}|2
""", results="""
injection|1|a{k}|2|c|suspected|0|-
"""),
    case("injection_environment", """
int a{k}(void) {
  char *c = getenv("C");
  return system(c);
}
""", events="""
NULL_VALUE|1|a{k}|2|c|call_result
INJECTION|1|a{k}|3|c|command_injection
""", edges="""
CALL|1|a{k}|2|a{k}|getenv|-
CALL|1|a{k}|3|a{k}|system|-
FUNCTION|1|a{k}|int|-|1|4|-
VARIABLE|1|a{k}|2|c|char*|stack
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
injection|1|a{k}|3|c|confirmed|2|sure
"""),
    case("injection_constant", """
int a{k}(void) {
  char *c = "ls";
  return system(c);
}
""", events="""
INJECTION|1|a{k}|3|c|command_injection
""", edges="""
CALL|1|a{k}|3|a{k}|system|-
FUNCTION|1|a{k}|int|-|1|4|-
VARIABLE|1|a{k}|2|c|char*|stack
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
injection|1|a{k}|3|c|taint_source|0|-
"""),
    case("injection_static_tainted", """
static int run{k}(char *c) {
  return system(c);
}
int a{k}(void) {
  return run{k}(getenv("C"));
}
""", events="""
INJECTION|1|run{k}|2|c|command_injection
""", edges="""
CALL|1|run{k}|2|run{k}|system|-
CALL|1|a{k}|5|a{k}|getenv|-
CALL|1|a{k}|5|a{k}|run{k}|-
FUNCTION|1|run{k}|int|static|1|3|c
FUNCTION|1|a{k}|int|-|4|6|-
PARAMS|1|run{k}|0
NEXT|1|a{k}|0>5;5>-1
NEXT|1|run{k}|0>2;2>-1
EVERY|1|a{k}|5
EVERY|1|run{k}|2
""", results="""
injection|1|run{k}|2|c|confirmed|1|sure
"""),
    case("injection_static_calm", """
static int run{k}(char *c) {
  return system(c);
}
int a{k}(void) {
  return run{k}("ls");
}
""", events="""
INJECTION|1|run{k}|2|c|command_injection
""", edges="""
CALL|1|run{k}|2|run{k}|system|-
CALL|1|a{k}|5|a{k}|run{k}|-
FUNCTION|1|run{k}|int|static|1|3|c
FUNCTION|1|a{k}|int|-|4|6|-
NEXT|1|a{k}|0>5;5>-1
NEXT|1|run{k}|0>2;2>-1
EVERY|1|a{k}|5
EVERY|1|run{k}|2
""", results="""
injection|1|run{k}|2|c|taint_source|0|-
"""),
    case("injection_unreached", """
static int run{k}(char *c) {
  return system(c);
}
""", events="""
INJECTION|1|run{k}|2|c|command_injection
""", edges="""
CALL|1|run{k}|2|run{k}|system|-
FUNCTION|1|run{k}|int|static|1|3|c
NEXT|1|run{k}|0>2;2>-1
EVERY|1|run{k}|2
""", results="""
injection|1|run{k}|2|c|call_reach|0|-
"""),
    case("injection_sql", """
void a{k}(char *s) {
  char q[99];
  snprintf(q, sizeof(q), "SELECT * FROM t WHERE x = '%s'", s);
}
""", events="""
INJECTION|1|a{k}|3|s|sql_injection
""", edges="""
CALL|1|a{k}|3|a{k}|snprintf|-
FUNCTION|1|a{k}|void|-|1|4|s
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
injection|1|a{k}|3|s|safe_function_exclude|0|-
"""),
    case("injection_returned_taint", """
char *ask{k}(void) {
  char *c = getenv("C");
  return c;
}
int a{k}(void) {
  char *c = ask{k}();
  return system(c);
}
""", events="""
NULL_VALUE|1|ask{k}|2|c|call_result
INJECTION|1|a{k}|7|c|command_injection
""", edges="""
CALL|1|ask{k}|2|ask{k}|getenv|-
CALL|1|a{k}|6|a{k}|ask{k}|-
CALL|1|a{k}|7|a{k}|system|-
DATA_FLOW|1|ask{k}|3|c|ask{k}|return
OWNERSHIP_TRANSFER|1|ask{k}|3|c|ask{k}|return
RETURN|1|a{k}|6|ask{k}|c|-
FUNCTION|1|ask{k}|char|-|1|4|-
VARIABLE|1|ask{k}|2|c|char*|stack
FUNCTION|1|a{k}|int|-|5|8|-
VARIABLE|1|a{k}|6|c|char*|stack
TAINTED|1|ask{k}
NEXT|1|ask{k}|0>2;2>3;3>-1
NEXT|1|a{k}|0>6;6>7;7>-1
EVERY|1|ask{k}|2,3
EVERY|1|a{k}|6,7
""", results="""
injection|1|a{k}|7|c|confirmed|6|sure
"""),
    case("injection_copied", """
int a{k}(void) {
  char b[64];
  char d[64];
  fgets(b, 64, stdin);
  strncpy(d, b, 63);
  return system(d);
}
""", events="""
INJECTION|1|a{k}|6|d|command_injection
""", edges="""
CALL|1|a{k}|4|a{k}|fgets|-
CALL|1|a{k}|5|a{k}|strncpy|-
CALL|1|a{k}|6|a{k}|system|-
FUNCTION|1|a{k}|int|-|1|7|-
NEXT|1|a{k}|0>2;2>3;3>4;4>5;5>6;6>-1
EVERY|1|a{k}|2,3,4,5,6
""", results="""
injection|1|a{k}|6|d|confirmed|4|sure
"""),
    case("format_parameter", """
void a{k}(char *s) {
  printf(s);
  printf("%s", s);
}
""", events="""
FORMAT_STRING|1|a{k}|2|s|format_string
""", edges="""
CALL|1|a{k}|2|a{k}|printf|-
CALL|1|a{k}|3|a{k}|printf|-
FUNCTION|1|a{k}|void|-|1|4|s
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
format-string|1|a{k}|2|s|suspected|0|-
"""),
    case("format_constant", """
void a{k}(void) {
  char *s = "x";
  printf(s);
}
""", events="""
FORMAT_STRING|1|a{k}|3|s|format_string
""", edges="""
CALL|1|a{k}|3|a{k}|printf|-
FUNCTION|1|a{k}|void|-|1|4|-
VARIABLE|1|a{k}|2|s|char*|stack
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
format-string|1|a{k}|3|s|taint_source|0|-
"""),
    case("path", """
void a{k}(char *s) {
  unlink(s);
  unlink("fixed");
}
""", events="""
PATH_TRAVERSAL|1|a{k}|2|s|path_traversal
""", edges="""
CALL|1|a{k}|2|a{k}|unlink|-
CALL|1|a{k}|3|a{k}|unlink|-
FUNCTION|1|a{k}|void|-|1|4|s
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
path-traversal|1|a{k}|2|s|suspected|0|-
"""),
    case("path_passed_on", """
char *same{k}(char *s) {
  return s;
}
void a{k}(void) {
  char *e = getenv("P");
  char *p = same{k}(e);
  unlink(p);
}
""", events="""
NULL_VALUE|1|a{k}|5|e|call_result
NULL_VALUE|1|a{k}|6|p|call_result
PATH_TRAVERSAL|1|a{k}|7|p|path_traversal
""", edges="""
CALL|1|a{k}|5|a{k}|getenv|-
CALL|1|a{k}|6|a{k}|same{k}|-
CALL|1|a{k}|7|a{k}|unlink|-
DATA_FLOW|1|same{k}|2|s|same{k}|return
OWNERSHIP_TRANSFER|1|same{k}|2|s|same{k}|return
PARAM_BINDING|1|a{k}|6|e|same{k}#0|0
RETURN|1|a{k}|6|same{k}|p|-
FUNCTION|1|same{k}|char|-|1|3|s
FUNCTION|1|a{k}|void|-|4|8|-
VARIABLE|1|a{k}|5|e|char*|stack
VARIABLE|1|a{k}|6|p|char*|stack
NULLABLE|1|same{k}
PARAMS|1|same{k}|0
NEXT|1|a{k}|0>5;5>6;6>7;7>-1
NEXT|1|same{k}|0>2;2>-1
EVERY|1|a{k}|5,6,7
EVERY|1|same{k}|2
""", results="""
path-traversal|1|a{k}|7|p|confirmed|5|sure
"""),
    case("unchecked", """
void a{k}(int s, char *b) {
  recv(s, b, 9, 0);
  if (send(s, b, 9, 0) < 0)
    stop{k}();
}
""", events="""
BUFFER_ACCESS|1|a{k}|2|s|buffer_overflow
UNCHECKED_RETURN|1|a{k}|2|-|unchecked_return
""", edges="""
CALL|1|a{k}|2|a{k}|recv|-
CALL|1|a{k}|3|a{k}|send|-
CALL|1|a{k}|4|a{k}|stop{k}|-
FUNCTION|1|a{k}|void|-|1|5|s,b
NEXT|1|a{k}|0>2;2>3;3>-1,4;4>-1
EVERY|1|a{k}|2,3
""", results="""
buffer-overflow|1|a{k}|2|s|suspected|0|-
unchecked-return|1|a{k}|2|recv(s, b, 9, 0)|suspected|0|-
"""),
    case("secret", """
void a{k}(void) {
  const char *password = "hunter22";
  const char *api_key = "0123456789";
  char *token = getenv("T");
  start{k}(password, api_key, token);
}
""", events="""
HARDCODED_SECRET|1|a{k}|2|password|hardcoded_password
HARDCODED_SECRET|1|a{k}|3|api_key|hardcoded_key
NULL_VALUE|1|a{k}|4|token|call_result
""", edges="""
CALL|1|a{k}|4|a{k}|getenv|-
CALL|1|a{k}|5|a{k}|start{k}|-
FUNCTION|1|a{k}|void|-|1|6|-
VARIABLE|1|a{k}|2|password|char*|stack
VARIABLE|1|a{k}|3|api_key|char*|stack
VARIABLE|1|a{k}|4|token|char*|stack
NEXT|1|a{k}|0>2;2>3;3>4;4>5;5>-1
EVERY|1|a{k}|2,3,4,5
""", results="""
hardcoded-secret|1|a{k}|2|password|confirmed|0|-
hardcoded-secret|1|a{k}|3|api_key|confirmed|0|-
"""),
    # ---- arithmetic
    case("overflow", """
void *a{k}(int n, int m) {
  return malloc(n * m);
}
""", events="""
INTEGER_OVERFLOW|1|a{k}|2|n,m|size_calc
""", edges="""
CALL|1|a{k}|2|a{k}|malloc|-
FUNCTION|1|a{k}|void|-|1|3|n,m
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>-1
EVERY|1|a{k}|2
""", results="""
integer-overflow|1|a{k}|2|n,m|suspected|0|-
"""),
    case("overflow_bounded", """
void *a{k}(int n, int m) {
  if (n < 100 && m < 100)
    return malloc(n * m);
  return NULL;
}
""", events="""
INTEGER_OVERFLOW|1|a{k}|3|n,m|size_calc
NULL_VALUE|1|a{k}|4|<return>|-
""", edges="""
CALL|1|a{k}|3|a{k}|malloc|-
FUNCTION|1|a{k}|void|-|1|5|n,m
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3,4;3>-1;4>-1
EVERY|1|a{k}|2
""", results="""
integer-overflow|1|a{k}|3|n,m|int_overflow_guard|0|-
"""),
    case("overflow_guard_before", """
void *a{k}(int n) {
  if (n >= 100)
    return NULL;
  return malloc(n * sizeof(int));
}
""", events="""
NULL_VALUE|1|a{k}|3|<return>|-
INTEGER_OVERFLOW|1|a{k}|4|n|size_calc
""", edges="""
CALL|1|a{k}|4|a{k}|malloc|-
FUNCTION|1|a{k}|void|-|1|5|n
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3,4;3>-1;4>-1
EVERY|1|a{k}|2
""", results="""
integer-overflow|1|a{k}|4|n|int_overflow_guard|0|-
"""),
    case("divide", """
int a{k}(int n, int d) {
  return n / d;
}
""", events="""
DIVIDE_BY_ZERO|1|a{k}|2|d|divide_by_zero
""", edges="""
FUNCTION|1|a{k}|int|-|1|3|n,d
NEXT|1|a{k}|0>2;2>-1
EVERY|1|a{k}|2
""", results="""
divide-by-zero|1|a{k}|2|d|suspected|0|-
"""),
    case("divide_checked", """
int a{k}(int n, int d) {
  if (d == 0)
    return 0;
  return n / d;
}
""", events="""
NULL_GUARD|1|a{k}|2|d|scope
NULL_GUARD|1|a{k}|3|d|early_return
NULL_VALUE|1|a{k}|3|<return>|-
""", edges="""
FUNCTION|1|a{k}|int|-|1|5|n,d
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3,4;3>-1;4>-1
EVERY|1|a{k}|2
"""),
    case("divide_constant", """
int a{k}(int n) {
  int d = 4;
  return n / d;
}
""", events="""
DIVIDE_BY_ZERO|1|a{k}|3|d|divide_by_zero
""", edges="""
FUNCTION|1|a{k}|int|-|1|4|n
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
RANGE|1|a{k}|3|d|4|4
""", results="""
divide-by-zero|1|a{k}|3|d|range|0|-
"""),
    case("sizeof_pointer", """
void a{k}(char *p, char *q) {
  memset(p, 0, sizeof(p));
  memset(q, 0, 4);
}
""", events="""
SIZEOF_MISUSE|1|a{k}|2|p|sizeof_pointer
""", edges="""
CALL|1|a{k}|2|a{k}|memset|-
CALL|1|a{k}|3|a{k}|memset|-
FUNCTION|1|a{k}|void|-|1|4|p,q
NEXT|1|a{k}|0>2;2>3;3>-1
EVERY|1|a{k}|2,3
""", results="""
sizeof-misuse|1|a{k}|2|p|suspected|0|-
"""),
    case("signed", """
int a{k}(unsigned int n) {
  if (n < 0)
    return 1;
  if (n > 5)
    return 2;
  return 0;
}
""", events="""
SIGNED_COMPARE|1|a{k}|2|n|signed_compare
NULL_VALUE|1|a{k}|6|<return>|-
""", edges="""
FUNCTION|1|a{k}|int|-|1|7|n
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>3,4;3>-1;4>5,6;5>-1;6>-1
EVERY|1|a{k}|2
""", results="""
signed-compare|1|a{k}|2|n|suspected|0|-
"""),
    case("crypto", """
int a{k}(char *d) {
  char key[8];
  MD5(d, 4, key);
  return rand();
}
""", events="""
CRYPTO_MISUSE|1|a{k}|2|key|undersized_key
CRYPTO_MISUSE|1|a{k}|3|MD5|weak_algorithm
CRYPTO_MISUSE|1|a{k}|4|rand|weak_random
""", edges="""
CALL|1|a{k}|3|a{k}|MD5|-
CALL|1|a{k}|4|a{k}|rand|-
FUNCTION|1|a{k}|int|-|1|5|d
NEXT|1|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|a{k}|2,3,4
""", results="""
crypto-misuse|1|a{k}|2|key|confirmed|0|-
crypto-misuse|1|a{k}|3|MD5|confirmed|0|-
crypto-misuse|1|a{k}|4|rand|suspected|0|-
"""),
    # ---- threads
    case("race_toctou", """
void a{k}(char *p) {
  if (access(p, 0) == 0)
    open(p, 0);
}
""", events="""
RACE_CONDITION|1|a{k}|2|p|toctou
PATH_TRAVERSAL|1|a{k}|3|p|path_traversal
""", edges="""
CALL|1|a{k}|2|a{k}|access|-
CALL|1|a{k}|3|a{k}|open|-
FUNCTION|1|a{k}|void|-|1|4|p
NEXT|1|a{k}|0>2;2>-1,3;3>-1
EVERY|1|a{k}|2
""", results="""
path-traversal|1|a{k}|3|p|suspected|0|-
race-condition|1|a{k}|2|p|suspected|0|-
"""),
    case("race_shared", """
int count{k};
void *work{k}(void *x) {
  count{k} = count{k} + 1;
  return x;
}
void a{k}(void) {
  pthread_t t, u;
  pthread_create(&t, NULL, work{k}, NULL);
  pthread_create(&u, NULL, work{k}, NULL);
}
""", events="""
RACE_CONDITION|1|work{k}|3|count{k}|shared_data_race
""", edges="""
CALL|1|a{k}|8|a{k}|pthread_create|-
CALL|1|a{k}|9|a{k}|pthread_create|-
DATA_FLOW|1|work{k}|4|x|work{k}|return
OWNERSHIP_TRANSFER|1|work{k}|4|x|work{k}|return
GLOBAL_ACCESS|1|work{k}|2|work{k}|count{k}|read_write
FUNCTION|1|work{k}|void|-|2|5|x
FUNCTION|1|a{k}|void|-|6|10|-
NULLABLE|1|work{k}
NEXT|1|a{k}|0>7;7>8;8>9;9>-1
NEXT|1|work{k}|0>3;3>4;4>-1
EVERY|1|a{k}|7,8,9
EVERY|1|work{k}|3,4
""", results="""
race-condition|1|work{k}|3|count{k}|suspected|0|-
"""),
    case("race_locked", """
int count{k};
pthread_mutex_t m{k};
void *work{k}(void *x) {
  pthread_mutex_lock(&m{k});
  count{k} = count{k} + 1;
  pthread_mutex_unlock(&m{k});
  return x;
}
void a{k}(void) {
  pthread_t t, u;
  pthread_create(&t, NULL, work{k}, NULL);
  pthread_create(&u, NULL, work{k}, NULL);
}
""", events="""
RESOURCE_ACQUIRE|1|work{k}|4|&m{k}|-
RESOURCE_RELEASE|1|work{k}|4|&m{k}|-
""", edges="""
CALL|1|work{k}|4|work{k}|pthread_mutex_lock|-
CALL|1|work{k}|6|work{k}|pthread_mutex_unlock|-
CALL|1|a{k}|11|a{k}|pthread_create|-
CALL|1|a{k}|12|a{k}|pthread_create|-
DATA_FLOW|1|work{k}|7|x|work{k}|return
OWNERSHIP_TRANSFER|1|work{k}|7|x|work{k}|return
GLOBAL_ACCESS|1|work{k}|3|work{k}|count{k}|read_write
GLOBAL_ACCESS|1|work{k}|3|work{k}|m{k}|read
FUNCTION|1|work{k}|void|-|3|8|x
FUNCTION|1|a{k}|void|-|9|13|-
NULLABLE|1|work{k}
NEXT|1|a{k}|0>10;10>11;11>12;12>-1
NEXT|1|work{k}|0>4;4>5;5>6;6>7;7>-1
EVERY|1|a{k}|10,11,12
EVERY|1|work{k}|4,5,6,7
""", results="""
resource-leak|1|work{k}|4|&m{k}|resource_release|0|-
"""),
    case("race_across_files", """
int total{k};
void *task{k}(void *x) {
  total{k} = total{k} + 1;
  return x;
}
""", """
void a{k}(void) {
  pthread_t t, u;
  pthread_create(&t, NULL, task{k}, NULL);
  pthread_create(&u, NULL, task{k}, NULL);
}
""", events="""
RACE_CONDITION|1|task{k}|3|total{k}|shared_data_race
""", edges="""
CALL|2|a{k}|3|a{k}|pthread_create|-
CALL|2|a{k}|4|a{k}|pthread_create|-
DATA_FLOW|1|task{k}|4|x|task{k}|return
OWNERSHIP_TRANSFER|1|task{k}|4|x|task{k}|return
GLOBAL_ACCESS|1|task{k}|2|task{k}|total{k}|read_write
FUNCTION|1|task{k}|void|-|2|5|x
FUNCTION|2|a{k}|void|-|1|5|-
NULLABLE|1|task{k}
NEXT|1|task{k}|0>3;3>4;4>-1
NEXT|2|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|task{k}|3,4
EVERY|2|a{k}|2,3,4
""", results="""
race-condition|1|task{k}|3|total{k}|suspected|0|-
"""),
    case("deadlock", """
pthread_mutex_t m{k};
pthread_mutex_t n{k};
void a{k}(void) {
  pthread_mutex_lock(&m{k});
  pthread_mutex_lock(&n{k});
  pthread_mutex_unlock(&n{k});
  pthread_mutex_unlock(&m{k});
}
void b{k}(void) {
  pthread_mutex_lock(&n{k});
  pthread_mutex_lock(&m{k});
  pthread_mutex_unlock(&m{k});
  pthread_mutex_unlock(&n{k});
}
""", events="""
RESOURCE_ACQUIRE|1|a{k}|4|&m{k}|-
RESOURCE_RELEASE|1|a{k}|4|&m{k}|-
DEADLOCK|1|a{k}|5|m{k},n{k}|-
LOCK_ORDER|1|a{k}|5|m{k}|-
RESOURCE_ACQUIRE|1|a{k}|5|&n{k}|-
RESOURCE_RELEASE|1|a{k}|5|&n{k}|-
RESOURCE_ACQUIRE|1|b{k}|10|&n{k}|-
RESOURCE_RELEASE|1|b{k}|10|&n{k}|-
LOCK_ORDER|1|b{k}|11|n{k}|-
RESOURCE_ACQUIRE|1|b{k}|11|&m{k}|-
RESOURCE_RELEASE|1|b{k}|11|&m{k}|-
""", edges="""
CALL|1|a{k}|4|a{k}|pthread_mutex_lock|-
CALL|1|a{k}|5|a{k}|pthread_mutex_lock|-
CALL|1|a{k}|6|a{k}|pthread_mutex_unlock|-
CALL|1|a{k}|7|a{k}|pthread_mutex_unlock|-
CALL|1|b{k}|10|b{k}|pthread_mutex_lock|-
CALL|1|b{k}|11|b{k}|pthread_mutex_lock|-
CALL|1|b{k}|12|b{k}|pthread_mutex_unlock|-
CALL|1|b{k}|13|b{k}|pthread_mutex_unlock|-
LOCK_ORDER|1|a{k}|5|m{k}|n{k}|-
LOCK_ORDER|1|b{k}|11|n{k}|m{k}|-
GLOBAL_ACCESS|1|a{k}|3|a{k}|m{k}|read
GLOBAL_ACCESS|1|a{k}|3|a{k}|n{k}|read
GLOBAL_ACCESS|1|b{k}|9|b{k}|m{k}|read
GLOBAL_ACCESS|1|b{k}|9|b{k}|n{k}|read
FUNCTION|1|a{k}|void|-|3|8|-
FUNCTION|1|b{k}|void|-|9|14|-
NEXT|1|a{k}|0>4;4>5;5>6;6>7;7>-1
NEXT|1|b{k}|0>10;10>11;11>12;12>13;13>-1
EVERY|1|a{k}|4,5,6,7
EVERY|1|b{k}|10,11,12,13
""", results="""
deadlock|1|a{k}|5|m{k},n{k}|confirmed|0|-
resource-leak|1|a{k}|4|&m{k}|resource_release|0|-
resource-leak|1|a{k}|5|&n{k}|resource_release|0|-
resource-leak|1|b{k}|10|&n{k}|resource_release|0|-
resource-leak|1|b{k}|11|&m{k}|resource_release|0|-
"""),
    case("locks_in_order", """
pthread_mutex_t m{k};
pthread_mutex_t n{k};
void a{k}(void) {
  pthread_mutex_lock(&m{k});
  pthread_mutex_lock(&n{k});
  pthread_mutex_unlock(&n{k});
  pthread_mutex_unlock(&m{k});
}
""", events="""
RESOURCE_ACQUIRE|1|a{k}|4|&m{k}|-
RESOURCE_RELEASE|1|a{k}|4|&m{k}|-
LOCK_ORDER|1|a{k}|5|m{k}|-
RESOURCE_ACQUIRE|1|a{k}|5|&n{k}|-
RESOURCE_RELEASE|1|a{k}|5|&n{k}|-
""", edges="""
CALL|1|a{k}|4|a{k}|pthread_mutex_lock|-
CALL|1|a{k}|5|a{k}|pthread_mutex_lock|-
CALL|1|a{k}|6|a{k}|pthread_mutex_unlock|-
CALL|1|a{k}|7|a{k}|pthread_mutex_unlock|-
LOCK_ORDER|1|a{k}|5|m{k}|n{k}|-
GLOBAL_ACCESS|1|a{k}|3|a{k}|m{k}|read
GLOBAL_ACCESS|1|a{k}|3|a{k}|n{k}|read
FUNCTION|1|a{k}|void|-|3|8|-
NEXT|1|a{k}|0>4;4>5;5>6;6>7;7>-1
EVERY|1|a{k}|4,5,6,7
""", results="""
resource-leak|1|a{k}|4|&m{k}|resource_release|0|-
resource-leak|1|a{k}|5|&n{k}|resource_release|0|-
"""),
    # ---- more of memory, over files too
    case("freed_by_callee_across_files", """
void let{k}(char *c) {
  free(c);
}
""", """
int a{k}(int n) {
  char *p = malloc(n);
  if (!p)
    return 1;
  let{k}(p);
  return 0;
}
""", events="""
MEMORY_ALLOC|2|a{k}|2|p|-
MEMORY_RELEASE|2|a{k}|2|p|-
NULL_VALUE|2|a{k}|2|p|-
NULL_GUARD|2|a{k}|3|p|scope
NULL_GUARD|2|a{k}|4|p|early_return
NULL_VALUE|2|a{k}|6|<return>|-
""", edges="""
CALL|1|let{k}|2|let{k}|free|-
CALL|2|a{k}|2|a{k}|malloc|-
CALL|2|a{k}|5|a{k}|let{k}|-
RELEASE|1|let{k}|2|c|free|free
PARAM_BINDING|2|a{k}|5|p|let{k}#0|0
DEED|1|let{k}|frees|0|-|every
FUNCTION|1|let{k}|void|-|1|3|c
FUNCTION|2|a{k}|int|-|1|7|n
VARIABLE|2|a{k}|2|p|char*|heap
NULLABLE|2|a{k}
NEXT|1|let{k}|0>2;2>-1
NEXT|2|a{k}|0>2;2>3;3>4,5;4>-1;5>6;6>-1
EVERY|1|let{k}|2
EVERY|2|a{k}|2,3
""", results="""
memory-leak|2|a{k}|2|p|memory_release|0|-
"""),
    case("field_freed_across_files", """
struct s { char *name; };
void wipe{k}(struct s *p) {
  free(p->name);
}
""", """
struct s { char *name; };
char a{k}(struct s *p) {
  wipe{k}(p);
  return p->name[0];
}
""", events="""
DEREFERENCE|1|wipe{k}|3|p|-
DEREFERENCE|2|a{k}|4|p|-
DEREFERENCE|2|a{k}|4|p->name|-
USE_AFTER_FREE|2|a{k}|4|p->name|callee
""", edges="""
CALL|1|wipe{k}|3|wipe{k}|free|-
CALL|2|a{k}|3|a{k}|wipe{k}|-
PARAM_BINDING|2|a{k}|3|p|wipe{k}#0|0
DEED|1|wipe{k}|frees|0|->name|every
FUNCTION|1|wipe{k}|void|-|2|4|p
FUNCTION|2|a{k}|char|-|2|5|p
NEXT|1|wipe{k}|0>3;3>-1
NEXT|2|a{k}|0>3;3>4;4>-1
EVERY|1|wipe{k}|3
EVERY|2|a{k}|3,4
""", results="""
null-deref|1|wipe{k}|3|p|nullable_source|0|-
null-deref|2|a{k}|4|p|nullable_source|0|-
null-deref|2|a{k}|4|p->name|nullable_source|0|-
use-after-free|2|a{k}|4|p->name|confirmed|3|sure
"""),
    case("global_freed_by_callee", """
char *g_text{k};
void clear{k}(void) {
  free(g_text{k});
}
char a{k}(void) {
  clear{k}();
  return g_text{k}[0];
}
""", events="""
DEREFERENCE|1|a{k}|7|g_text{k}|-
USE_AFTER_FREE|1|a{k}|7|g_text{k}|callee
""", edges="""
CALL|1|clear{k}|3|clear{k}|free|-
CALL|1|a{k}|6|a{k}|clear{k}|-
RELEASE|1|clear{k}|3|g_text{k}|free|free
GLOBAL_ACCESS|1|clear{k}|2|clear{k}|g_text{k}|read
GLOBAL_ACCESS|1|a{k}|5|a{k}|g_text{k}|read
DEED|1|clear{k}|frees|-1|g_text{k}|every
FUNCTION|1|clear{k}|void|-|2|4|-
FUNCTION|1|a{k}|char|-|5|8|-
NEXT|1|a{k}|0>6;6>7;7>-1
NEXT|1|clear{k}|0>3;3>-1
EVERY|1|a{k}|6,7
EVERY|1|clear{k}|3
""", results="""
null-deref|1|a{k}|7|g_text{k}|nullable_source|0|-
use-after-free|1|a{k}|7|g_text{k}|confirmed|6|sure
"""),
    case("kept_and_freed_twice", """
char *g_all{k}[4];
char *keep{k}(int i) {
  char *p = malloc(4);
  g_all{k}[i] = p;
  return p;
}
void clear{k}(void) {
  free(g_all{k}[0]);
}
void a{k}(void) {
  char *p = keep{k}(1);
  clear{k}();
  free(p);
}
""", events="""
MEMORY_ALLOC|1|keep{k}|3|p|-
MEMORY_RELEASE|1|keep{k}|3|p|-
NULL_VALUE|1|keep{k}|3|p|-
UNCHECKED_RETURN|1|keep{k}|3|p|unchecked_return
DEREFERENCE|1|keep{k}|4|g_all{k}|-
DEREFERENCE|1|clear{k}|8|g_all{k}|-
NULL_VALUE|1|a{k}|11|p|call_result
DOUBLE_FREE|1|a{k}|13|p|-
""", edges="""
CALL|1|keep{k}|3|keep{k}|malloc|-
CALL|1|clear{k}|8|clear{k}|free|-
CALL|1|a{k}|11|a{k}|keep{k}|-
CALL|1|a{k}|12|a{k}|clear{k}|-
CALL|1|a{k}|13|a{k}|free|-
DATA_FLOW|1|keep{k}|5|p|keep{k}|return
OWNERSHIP_TRANSFER|1|keep{k}|4|p|g_all{k}|store
OWNERSHIP_TRANSFER|1|keep{k}|5|p|keep{k}|return
RELEASE|1|a{k}|13|p|free|free
RETURN|1|a{k}|11|keep{k}|p|-
GLOBAL_ACCESS|1|keep{k}|2|keep{k}|g_all{k}|write
GLOBAL_ACCESS|1|clear{k}|7|clear{k}|g_all{k}|read
DEED|1|keep{k}|stores|-1|g_all{k}|-
DEED|1|clear{k}|frees|-1|g_all{k}|every
FUNCTION|1|keep{k}|char|-|2|6|i
VARIABLE|1|keep{k}|3|p|char*|heap
FUNCTION|1|clear{k}|void|-|7|9|-
FUNCTION|1|a{k}|void|-|10|14|-
VARIABLE|1|a{k}|11|p|char*|stack
NULLABLE|1|keep{k}
NEXT|1|a{k}|0>11;11>12;12>13;13>-1
NEXT|1|clear{k}|0>8;8>-1
NEXT|1|keep{k}|0>3;3>4;4>5;5>-1
EVERY|1|a{k}|11,12,13
EVERY|1|clear{k}|8
EVERY|1|keep{k}|3,4,5
""", results="""
double-free|1|a{k}|13|p|confirmed|12|sure
memory-leak|1|keep{k}|3|p|memory_release|0|-
null-deref|1|keep{k}|4|g_all{k}|non_nullable_array_suppress|0|-
null-deref|1|clear{k}|8|g_all{k}|non_nullable_array_suppress|0|-
unchecked-return|1|keep{k}|3|p|suspected|0|-
"""),
    case("struct_partly_set", """
struct s { int x; int y; };
int a{k}(void) {
  struct s v;
  v.x = 1;
  return v.x + v.y;
}
""", events="""
VALUE_USE|1|a{k}|5|v|struct_partial_uninit
""", edges="""
FUNCTION|1|a{k}|int|-|2|6|-
NEXT|1|a{k}|0>3;3>4;4>5;5>-1
EVERY|1|a{k}|3,4,5
""", results="""
uninit|1|a{k}|5|v|suspected|0|-
"""),
    case("struct_filled", """
struct s { int x; int y; };
void set{k}(struct s *p) {
  p->x = 1;
  p->y = 2;
}
int a{k}(void) {
  struct s v;
  set{k}(&v);
  return v.x + v.y;
}
""", events="""
DEREFERENCE|1|set{k}|3|p|-
DEREFERENCE|1|set{k}|4|p|-
""", edges="""
CALL|1|a{k}|8|a{k}|set{k}|-
DEED|1|set{k}|writes|0|-|every
FUNCTION|1|set{k}|void|-|2|5|p
FUNCTION|1|a{k}|int|-|6|10|-
NEXT|1|a{k}|0>7;7>8;8>9;9>-1
NEXT|1|set{k}|0>3;3>4;4>-1
EVERY|1|a{k}|7,8,9
EVERY|1|set{k}|3,4
""", results="""
null-deref|1|set{k}|3|p|nullable_source|0|-
null-deref|1|set{k}|4|p|nullable_source|0|-
"""),
    case("output_on_some_ways", """
int fill{k}(int *p, int n) {
  if (n)
    return 1;
  *p = 3;
  return 0;
}
""", """
int a{k}(int n) {
  int x;
  fill{k}(&x, n);
  return x;
}
int b{k}(int n) {
  int x;
  if (fill{k}(&x, n))
    return 1;
  return x;
}
""", events="""
NULL_GUARD|1|fill{k}|2|n|scope
DEREFERENCE|1|fill{k}|4|p|-
NULL_VALUE|1|fill{k}|5|<return>|-
VALUE_USE|2|a{k}|4|x|stack_uninit
""", edges="""
CALL|2|a{k}|3|a{k}|fill{k}|-
CALL|2|b{k}|8|b{k}|fill{k}|-
DATA_FLOW|2|a{k}|4|x|a{k}|return
DATA_FLOW|2|b{k}|10|x|b{k}|return
OWNERSHIP_TRANSFER|2|a{k}|4|x|a{k}|return
OWNERSHIP_TRANSFER|2|b{k}|10|x|b{k}|return
PARAM_BINDING|2|a{k}|3|n|fill{k}#1|1
PARAM_BINDING|2|b{k}|8|n|fill{k}#1|1
DEED|1|fill{k}|writes|0|-|some
FUNCTION|1|fill{k}|int|-|1|6|p,n
FUNCTION|2|a{k}|int|-|1|5|n
FUNCTION|2|b{k}|int|-|6|11|n
NULLABLE|1|fill{k}
NEXT|1|fill{k}|0>2;2>3,4;3>-1;4>5;5>-1
NEXT|2|a{k}|0>2;2>3;3>4;4>-1
NEXT|2|b{k}|0>7;7>8;8>9,10;9>-1;10>-1
EVERY|1|fill{k}|2
EVERY|2|a{k}|2,3,4
EVERY|2|b{k}|7,8
""", results="""
null-deref|1|fill{k}|4|p|nullable_source|0|-
uninit|2|a{k}|4|x|confirmed|2|sure
"""),
    case("output_on_every_way", """
void set{k}(int *p) {
  *p = 3;
}
""", """
int a{k}(void) {
  int x;
  set{k}(&x);
  return x;
}
""", events="""
DEREFERENCE|1|set{k}|2|p|-
""", edges="""
CALL|2|a{k}|3|a{k}|set{k}|-
DATA_FLOW|2|a{k}|4|x|a{k}|return
OWNERSHIP_TRANSFER|2|a{k}|4|x|a{k}|return
DEED|1|set{k}|writes|0|-|every
FUNCTION|1|set{k}|void|-|1|3|p
FUNCTION|2|a{k}|int|-|1|5|-
NEXT|1|set{k}|0>2;2>-1
NEXT|2|a{k}|0>2;2>3;3>4;4>-1
EVERY|1|set{k}|2
EVERY|2|a{k}|2,3,4
""", results="""
null-deref|1|set{k}|2|p|nullable_source|0|-
"""),
    case("safe_function", """
void a{k}(char *p) {
  execv(p, NULL);
}
""", events="""
INJECTION|1|a{k}|2|p|command_injection
""", edges="""
CALL|1|a{k}|2|a{k}|execv|-
FUNCTION|1|a{k}|void|-|1|3|p
NEXT|1|a{k}|0>2;2>-1
EVERY|1|a{k}|2
""", results="""
injection|1|a{k}|2|p|safe_function_exclude|0|-
"""),
    # ---- flow
    case("range_grows", """
int a{k}(int n) {
  int d = 1;
  while (n > 0) {
    d = d + 1;
    n = n - 1;
  }
  return 8 / d;
}
""", events="""
DIVIDE_BY_ZERO|1|a{k}|7|d|divide_by_zero
""", edges="""
FUNCTION|1|a{k}|int|-|1|8|n
NEXT|1|a{k}|0>2;2>3;3>4,7;4>5;5>3;7>-1
EVERY|1|a{k}|2,3,7
RANGE|1|a{k}|7|d|1|open
""", results="""
divide-by-zero|1|a{k}|7|d|range|0|-
"""),
    case("range_falls", """
int a{k}(int n) {
  int d = 9;
  while (n > 0) {
    d = d - 1;
    n = n - 1;
  }
  return 8 / d;
}
""", events="""
DIVIDE_BY_ZERO|1|a{k}|7|d|divide_by_zero
""", edges="""
FUNCTION|1|a{k}|int|-|1|8|n
NEXT|1|a{k}|0>2;2>3;3>4,7;4>5;5>3;7>-1
EVERY|1|a{k}|2,3,7
RANGE|1|a{k}|7|d|open|9
""", results="""
divide-by-zero|1|a{k}|7|d|suspected|0|-
"""),
    case("aliases", """
struct s { char *name; struct s *next; };
char *g_last{k};
char *a{k}(struct s *p, char **v, char *q) {
  char *r;
  char *f = p->name;
  char *e = v[2];
  r = q;
  g_last{k} = r;
  return r;
}
""", events="""
DEREFERENCE|1|a{k}|5|p|-
DEREFERENCE|1|a{k}|6|v|-
""", edges="""
DATA_FLOW|1|a{k}|7|q|r|copy
DATA_FLOW|1|a{k}|8|r|g_last{k}|copy
DATA_FLOW|1|a{k}|9|r|a{k}|return
ALIAS|1|a{k}|5|f|p|name
ALIAS|1|a{k}|6|e|v|[]
ALIAS|1|a{k}|7|r|q|-
ALIAS|1|a{k}|8|g_last{k}|r|-
OWNERSHIP_TRANSFER|1|a{k}|8|r|g_last{k}|store
OWNERSHIP_TRANSFER|1|a{k}|9|r|a{k}|return
GLOBAL_ACCESS|1|a{k}|3|a{k}|g_last{k}|write
FUNCTION|1|a{k}|char|-|3|10|p,v,q
VARIABLE|1|a{k}|4|r|char*|stack
VARIABLE|1|a{k}|5|f|char*|stack
VARIABLE|1|a{k}|6|e|char*|stack
NEXT|1|a{k}|0>4;4>5;5>6;6>7;7>8;8>9;9>-1
EVERY|1|a{k}|4,5,6,7,8,9
""", results="""
null-deref|1|a{k}|5|p|nullable_source|0|-
null-deref|1|a{k}|6|v|nullable_source|0|-
"""),
    case("statements", """
int a{k}(int n) {
  int s = 0;
  for (int i = 0; i < n; i++) {
    if (i == 3)
      continue;
    s = s + i;
  }
  switch (n) {
    case 1:
      s = 1;
    case 2:
      s = 2;
      break;
    default:
      s = 3;
  }
  do {
    s = s - 1;
  } while (s > 0);
#ifdef LONG
  s = 7;
#else
  s = 8;
#endif
  return s;
}
""", edges="""
DATA_FLOW|1|a{k}|25|s|a{k}|return
OWNERSHIP_TRANSFER|1|a{k}|25|s|a{k}|return
FUNCTION|1|a{k}|int|-|1|26|n
NEXT|1|a{k}|0>2;2>3;3>3,4,10,12,15;4>5,6;5>3;6>3;10>12;12>13;13>18;15>18;17>18,21,23;18>17;21>25;23>25;25>-1
EVERY|1|a{k}|2,3,17,18,25
RANGE|1|a{k}|25|i|0|open
RANGE|1|a{k}|25|s|7|8
"""),
    case("uninit_same_condition", """
int a{k}(int n) {
  int x;
#ifdef WIDE
  x = n;
#endif
#ifdef WIDE
  return x;
#endif
  return 0;
}
""", events="""
VALUE_USE|1|a{k}|7|x|stack_uninit
NULL_VALUE|1|a{k}|9|<return>|-
""", edges="""
DATA_FLOW|1|a{k}|4|n|x|copy
DATA_FLOW|1|a{k}|7|x|a{k}|return
ALIAS|1|a{k}|4|x|n|-
OWNERSHIP_TRANSFER|1|a{k}|7|x|a{k}|return
FUNCTION|1|a{k}|int|-|1|10|n
NULLABLE|1|a{k}
NEXT|1|a{k}|0>2;2>4,7,9;4>7,9;7>-1;9>-1
EVERY|1|a{k}|2
""", results="""
uninit|1|a{k}|7|x|definite_init|0|-
"""),
    case("null_while", """
struct s { int x; struct s *next; };
int a{k}(int n) {
  struct s *p = malloc(sizeof(struct s));
  while (p) {
    n = n + p->x;
    p = p->next;
  }
  return n;
}
""", events="""
MEMORY_ALLOC|1|a{k}|3|p|-
NULL_VALUE|1|a{k}|3|p|-
NULL_GUARD|1|a{k}|4|p|scope
DEREFERENCE|1|a{k}|5|p|-
DEREFERENCE|1|a{k}|6|p|-
""", edges="""
CALL|1|a{k}|3|a{k}|malloc|-
DATA_FLOW|1|a{k}|8|n|a{k}|return
ALIAS|1|a{k}|6|p|p|next
OWNERSHIP_TRANSFER|1|a{k}|8|n|a{k}|return
FUNCTION|1|a{k}|int|-|2|9|n
VARIABLE|1|a{k}|3|p|struct s*|heap
NEXT|1|a{k}|0>3;3>4;4>5,8;5>6;6>4;8>-1
EVERY|1|a{k}|3,4,8
""", results="""
memory-leak|1|a{k}|3|p|suspected|0|-
null-deref|1|a{k}|5|p|guard|3|-
null-deref|1|a{k}|6|p|guard|3|-
"""),
    case("race_two_threads", """
int sum{k};
void *up{k}(void *x) {
  sum{k} = sum{k} + 1;
  return x;
}
void *down{k}(void *x) {
  sum{k} = sum{k} - 1;
  return x;
}
void a{k}(void) {
  pthread_t t, u;
  pthread_create(&t, NULL, up{k}, NULL);
  pthread_create(&u, NULL, down{k}, NULL);
}
""", events="""
RACE_CONDITION|1|up{k}|3|sum{k}|shared_data_race
""", edges="""
CALL|1|a{k}|12|a{k}|pthread_create|-
CALL|1|a{k}|13|a{k}|pthread_create|-
DATA_FLOW|1|up{k}|4|x|up{k}|return
DATA_FLOW|1|down{k}|8|x|down{k}|return
OWNERSHIP_TRANSFER|1|up{k}|4|x|up{k}|return
OWNERSHIP_TRANSFER|1|down{k}|8|x|down{k}|return
GLOBAL_ACCESS|1|up{k}|2|up{k}|sum{k}|read_write
GLOBAL_ACCESS|1|down{k}|6|down{k}|sum{k}|read_write
FUNCTION|1|up{k}|void|-|2|5|x
FUNCTION|1|down{k}|void|-|6|9|x
FUNCTION|1|a{k}|void|-|10|14|-
NULLABLE|1|down{k}
NULLABLE|1|up{k}
NEXT|1|a{k}|0>11;11>12;12>13;13>-1
NEXT|1|down{k}|0>7;7>8;8>-1
NEXT|1|up{k}|0>3;3>4;4>-1
EVERY|1|a{k}|11,12,13
EVERY|1|down{k}|7,8
EVERY|1|up{k}|3,4
""", results="""
race-condition|1|up{k}|3|sum{k}|confirmed|0|-
"""),
)
