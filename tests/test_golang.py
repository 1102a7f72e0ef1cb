"""Declarations of Go sources against results written by hand."""

from __future__ import annotations

import pytest

from tesserae.operators import readq, retrieve

CASES = {
    "a raw string holds no declaration": ("package p\n\nvar s = `\nfunc no() {\n}\ntype X struct {\n`\n\nfunc yes() {\n}\n", [(3, 7, "var", "s"), (9, 10, "function", "yes")]),
    "brackets in strings, runes and comments don't count": ("package p\nfunc a() {\n\tx := \"}\" + '}' // }\n\t/* } ` \" */\n\ty := '\\''\n}\nfunc b() {}\n", [(2, 6, "function", "a"), (7, 7, "function", "b")]),
    "comment signs in strings": ('package p\nconst u = "http://x" // c\nvar v = "/*"\nfunc f() { _ = "*/" }\n', [(2, 2, "const", "u"), (3, 3, "var", "v"), (4, 4, "function", "f")]),
    "methods and generics": ("package p\nfunc (r *Recv[K, V]) Do(a int,\n\tb string,\n) (int, error) {\n\treturn 0, nil\n}\nfunc G[T any](x T) T { return x }\n", [(2, 6, "method", "Do"), (7, 7, "function", "G")]),
    "groups": ("package p\nconst (\n\tA = iota\n\tB\n\n\t// C isn't one\n\tD, E = 1, 2\n)\ntype (\n\tT struct {\n\t\tinner int\n\t}\n\tU = map[string]func(a int) error\n)\nvar x, y int\n", [(2, 8, "const", "A, B, D, E"), (9, 14, "type", "T, U"), (15, 15, "var", "x, y")]),
    "a statement goes on after an operator": ("package p\nvar sum = 1 +\n\n\t2\nvar t = f(\n\t1,\n)\n", [(2, 4, "var", "sum"), (5, 7, "var", "t")]),
    "without a body, indented, imports aside": ('package p\nimport (\n\t"a"\n)\nfunc asm(x int) int\n  func moved() {\n  }\n', [(5, 5, "function", "asm"), (6, 7, "function", "moved")]),
    "multi-line comment before": ("/* func no() {\n*/\npackage p\n/* a\n b */ func f() {\n}\n", [(5, 6, "function", "f")]),
    "a group's values over lines": ("package p\nvar (\n\ta = []int{\n\t\t1,\n\t}\n\tb = `x\ny = 1\n`\n\tc = 1 +\n\t\td\n)\n", [(2, 11, "var", "a, b, c")]),
    "something stays open": ("package p\nfunc a() {\n\tx(\n}\nfunc b() {}\n", []),
    "names of other letters": ("package p\nfunc Größe() {}\ntype Ünit struct{}\n", [(2, 2, "function", "Größe"), (3, 3, "type", "Ünit")]),
    "nothing": ("", []),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [("null", None)], "path string, text string")
    out = {k: [] for k in CASES}
    for r in retrieve.go_declarations(docs).collect():
        out[r.path].append((r.start, r.end, r.symbol_type, r.symbol))
    return out


@pytest.mark.parametrize("case", CASES)
def test_declarations(found, case):
    assert sorted(found[case]) == CASES[case][1]


def test_outline(spark):
    text = "package p\ntype (\n\tA int\n\tB struct {\n\t\tc int\n\t}\n)\nfunc (x *B) M() {\n}\nfunc (A) N() {}\nfunc (r R[T]) O() {}\ntype S[T any] []T\nvar v = `\nfunc no()`\nfunc open(\n"
    got = sorted((r.line, r.kind, r.name) for r in readq.go_outline(spark.createDataFrame([("x.go", text)], "path string, text string")).collect())
    assert got == [(3, "type", "A"), (4, "type", "B"), (8, "method", "B.M"), (10, "method", "A.N"), (11, "method", "R.O"), (12, "type", "S"), (15, "function", "open")]


def test_long_source(spark):
    """A file of 20,000 lines, and a string of 100,000 characters."""
    text = "package p\n" + "".join(f"func F{i}() {{\n\treturn\n}}\n\n" for i in range(5_000)) + 'var s = "' + "a\\n" * 33_000 + '"\n'
    got = retrieve.go_declarations(spark.createDataFrame([("x.go", text)], "path string, text string")).collect()
    assert len(got) == 5_001 and got[-1].symbol == "s" and got[4_999].symbol == "F4999" and got[4_999].start == 2 + 4 * 4_999
