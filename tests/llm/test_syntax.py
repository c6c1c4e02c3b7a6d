import ast
import functools
import sys

import pytest
from hypothesis import given, settings, strategies as st

from heddle import syntax
from heddle.llm import docpairs, parsing
from heddle.syntax import Broken, python, states

GOOD = {
    "javascript": ["const a = /x[/]y/g.test(b) ? `t${c + `n${d}`}` : {...e, f() { return 1 }, get g() { return 2 }};\nexport default class extends B { #p = 1; static { this.q = 2 } async *m() { yield* z() } }\nfor await (const [x, {y = 1}] of z) label: for (;;) break label\nlet q = async ({a, b}) => await a?.[0]?.(b) ?? 1", "x = a / b / c\nif (a) b\nelse c\nthrow new E"],
    "typescript": ["abstract class A<T extends object = {}> implements I, J<T> { constructor(private readonly x: number, public y?: string) { super() } abstract m(): void; [k: string]: unknown; get z(): T { return this.t! } }\ntype M = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never };\nfunction f(this: A, ...r: string[]): asserts r is string[] {}\nconst g = <T,>(x: T): x is T => true as const;\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nlet h = a<b>(c), i = x as unknown as Map<string, Array<number>>;"],
    "go": ["package p\nimport (\n\tf \"fmt\"\n)\ntype S[T any] struct {\n\tA, b int `json:\"a\"`\n\t*E\n}\nfunc (s *S[T]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && (v == T{}) {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tfor i := range 10 {\n\t}\n\tselect {\n\tcase v := <-c:\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}[k][0], nil\n}\n"],
    "rust": ["use a::{b::*, c as d};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a = u8, const N: usize = 3>(pub &'a [T; N]);\nimpl<'a, T> Tr for S<'a, T> where T: Fn(i32) -> Option<Vec<Vec<u8>>> {\n    type X = dyn Iterator<Item = u8> + Send;\n    async fn m(&mut self, (a, b): (u8, u8)) -> impl Sized {\n        let Some(x) = y else { return };\n        let c = |z: u8| -> u8 { z as u8 };\n        match v { 1..=3 | 5 if a < b => { 1 } Foo { x, .. } => 2, _ => loop { break 'l 3 }, }\n        vec![1, 2; 3]; S { a, ..b }; r#\"x\"y\"#; 'a'; x?.await.0.1\n    }\n}\nmacro_rules! m { ($x:expr) => { $x } }\n/* a /* b */ c */"],
    "python": ["match x:\n    case {'a': [1, *r]}:\n        pass\ntype A[T] = list[T]\n"],
    "json": ['{"a": [1, 2.5e3, null, "\\u00e9"]}'],
    "toml": ["[a]\nb = 1979-05-27T07:32:00Z\r\nc = [1, 2]\n"],
    "yaml": ["a: &x\n  - b\n  - {c: d}\n", '{"a": 1}'],
}
BAD = {
    "javascript": ["const a = ;", "function f( {", "let x: number = 1", "return 1", "a => {", "<<<<<<< HEAD", "'abc", "x = `a${b`", "class A { constructor( }", '{"a": 1, "b": 2}'],
    "typescript": ["interface A { x: }", "let x: = 1", "type = 3 4", "class A { m( }", "enum { A }"],
    "go": ["package p\nfunc f() {", "func f() {}\n", "package p\nx := 1\n", "package p\nfunc f() { a b }\n", 'package p\nvar s = "abc\n', "package p\nfunc f(a int, string) {}\n"],
    "rust": ["fn f() { let x = ; }", "fn f( {}", "struct S { a u8 }", "fn f() -> { }", "let x = 1;", "fn f() { a < b < c }", 'fn f() { "abc }'],
    "python": ["def f(:", "x = (1", "if a:\npass", "class A[T = int]: pass"],
    "json": ["{'a': 1}", '{"a": 1,}', "NaN", ""],
    "toml": ["a = ", "[a\nb = 1", "a = 1\na = 2"],
    "yaml": ["a: [1, 2", "a: b: c", "\tx: 1"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid(language):
    assert [syntax.problem(t, language) for t in GOOD[language]] == [None] * len(GOOD[language])


@pytest.mark.parametrize("language", BAD)
def test_broken(language):
    assert [t for t in BAD[language] if syntax.problem(t, language) is None] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(['"""', "'''", '"', "'", "(", ")", "[", "]", "{", "}", "a", "\n", "# c", "\\", "x = 1\n"]), max_size=40), st.integers(1, 9))
def test_summaries_compose(parts, size):
    text = "".join(parts)
    whole = states.summarize("python", text)
    pieces = [states.summarize("python", c) for c in states.chunks(text, size)]
    left = functools.reduce(states.combine, pieces)
    right = functools.reduce(lambda b, a: states.combine(a, b), reversed(pieces))
    assert states.balanced(left) == states.balanced(right) == states.balanced(whole)


def test_files_and_rates(spark):
    long_ok = "\n".join(f"x{k} = [{k}]" for k in range(3000))
    rows = [("r", "a.py", "python", "x = 1", 1), ("r", "a.py", "python", "x = 1", 2), ("r", "b.py", "python", "def f(:", 1), ("r", "c.py", "python", None, 1), ("s", "d.json", "json", "", 1), ("s", "e.txt", None, "((", 1), ("s", "f.py", "python", long_ok, 1), ("s", "g.py", "python", long_ok + "\n(", 1), (None, None, None, None, None)]
    rec = spark.createDataFrame(rows, "repo string, source_file string, language string, content string, broken int")
    got = {r.source_file: r.broken for r in parsing.broken_files(rec, chunk=1000).collect()}
    assert got == {"a.py": False, "b.py": True, "c.py": False, "d.json": True, "e.txt": False, "f.py": False, "g.py": True}
    total = [r for r in parsing.rates(parsing.broken_files(rec)).collect() if r.repo is None and r.language is None]
    assert any((r.n_files, r.n_broken) == (7, 3) for r in total)
    assert parsing.broken_files(rec.limit(0)).count() == 0


def test_documentation_pairs(spark):
    py = 'class A(B):\n    def kept(self):\n        """Reads the next block from disk."""\n    def named(self):\n        """Named."""\n    def over(self):\n        pass\n\n# Returns all open files of a user.\n@deco\ndef above():\n    pass\n\n# x = foo(1)\n# return x\ndef code():\n    pass\n\n# Far away comment about nothing here.\n\ndef far():\n    pass\n'
    base = 'class B:\n    def over(self):\n        """Writes the whole buffer to disk."""\n'
    js = "/** @param {string} a the file name to open */\nconst f = (a) => 1;\n/** TODO: document */\nfunction g() {}\nclass C {\n  // Counts the rows that are still open.\n  m() {}\n}\n"
    rows = [("r", "a.py", "python", py), ("r", "b.py", "python", base), ("r", "c.js", "javascript", js.replace("\n", "\r\n")), ("r", "d.py", "python", "def ("), ("r", "e.py", "python", None), ("r", "f.xyz", None, "text")]
    got = {(r.source_file, r.qualified_name): r for r in docpairs.documented(spark.createDataFrame(rows, "repo string, source_file string, language string, content string")).collect()}
    assert {k for k, r in got.items() if r.own} == {("a.py", "A.kept"), ("a.py", "above"), ("b.py", "B.over"), ("c.js", "f"), ("c.js", "C.m")}
    assert [(k, r.doc_from) for k, r in got.items() if not r.own] == [(("a.py", "A.over"), "B.over")]
    assert docpairs.documented(spark.createDataFrame([], "repo string, source_file string, language string, content string")).count() == 0


def test_inherited_documentation(spark):
    """Gaps, several bases, equal names in other files, cycles and chains of any length."""
    doc = '        """Runs all steps that are still open."""\n'
    method = lambda name, said="": f"    def {name}(self):\n" + (said or "        pass\n")
    files = {
        "a.py": "class A:\n" + method("run", doc) + "class B(A): pass\nclass C(B):\n" + method("run") + method("stop"),
        "m.py": "class X:\n" + method("run") + "class Y:\n" + method("run", doc) + "class Z(X, Y):\n" + method("run"),
        "o.py": "class A:\n" + method("run") + "class D(A):\n" + method("run"),  # its own A has no documentation
        "p.py": "class E(A):\n" + method("run"),  # A of the smallest file
        "q.py": "class P(Q):\n" + method("run") + "class Q(P):\n" + method("run"),
        "l.py": "class L0:\n" + method("run", doc) + "".join(f"class L{k}(L{k - 1}): pass\n" for k in range(1, 12)) + "class Last(L11[int]):\n" + method("run"),
        "j.js": "class A {\n  /** Reads every row of the table. */\n  get() {}\n}\nclass B extends A {}\nclass C extends B {\n  /** {@inheritDoc} */\n  get() {}\n}",
    }
    rows = [("r", f, "javascript" if f.endswith("js") else "python", t) for f, t in files.items()]
    got = {(r.source_file, r.qualified_name): r for r in docpairs.documented(spark.createDataFrame(rows, "repo string, source_file string, language string, content string")).collect()}
    assert {k: r.doc_from for k, r in got.items() if not r.own} == {("a.py", "C.run"): "A.run", ("m.py", "Z.run"): "Y.run", ("p.py", "E.run"): "A.run", ("l.py", "Last.run"): "L0.run", ("j.js", "C.get"): "A.get"}
    assert [k for k, r in got.items() if r.points] == [("j.js", "C.get")]


FORMATTED = ['d = {"(": 1}\nx = f"{d["("]}"\n', "y = f'{a!r:>{width}} {{literal}} {f\"{b['k)']}\"}'\n", 'z = f"""{\n    call("]")\n} text ( {v:%H:%M}"""\n', "w = rf'\\d{{{n}}}' + F\"{x:{y}}\"\n", 't = f"{x = }" + f"{(lambda q: q)(1)}"\n']


def test_formatted_strings():
    for text in FORMATTED:
        assert states.balanced(states.summarize("python", text)), text
        assert syntax.problem(text, "python") is None, text
    for text in ('x = f"{d["("]"\n', 'x = f"{a"\n', 'x = f"{(}"\n'):
        assert not states.balanced(states.summarize("python", text)) or syntax.problem(text, "python"), text


LONG = {
    "python": "\n".join(["def f(x):", '    """Text (with an open bracket.', '    """', "    return [x, {'a': (1,", "        2)}]", *FORMATTED]),
    "go": "package p\n\nvar a = `raw ( \n text`\n/* block ( \n */\nfunc f() {\n\tg('(', \"\\\"(\")\n}\n",
    "json": '{"a": [1,\n {"b": "(["},\n 2]\n}\n',
    "rust": "/* a /* ( */\n [ */\nfn f<'a>(x: &'a str) {\n    g('(', '\\u{28}', \"\\\"(\n{\", r#\"\"(\n\"#);\n}\n",
    "toml": 'a = [1,\n 2]\nb = """text [\n more"""\nc = \'[\'\n',
}


@pytest.mark.parametrize("language", LONG)
def test_every_chunk_size_gives_the_same(language):
    text = LONG[language] * 2
    whole = states.balanced(states.summarize(language, text))
    assert whole
    for broken in (text, text + "\n(" if language in ("python", "go", "rust") else text + "\n["):
        want = states.balanced(states.summarize(language, broken))
        for size in range(1, 65):
            total = functools.reduce(states.combine, [states.summarize(language, c) for c in states.chunks(broken, size)])
            assert states.balanced(total) == want


def test_depth_is_no_error():
    deep = "x = " + "1 + " * 20_000 + "1\n"
    assert syntax.problem(deep, "python") is None
    assert syntax.problem(deep + "y = = 2\n", "python") is not None
    assert syntax.problem("[" * 50_000 + "]" * 50_000, "json") is None
    assert syntax.statements("@a\ndef f():\n    x\nif a:\n    b\nelse:\n    c\nd = [\n1]\n") == ["@a\ndef f():\n    x\n", "if a:\n    b\nelse:\n    c\n", "d = [\n1]\n"]


DEEP = {
    "javascript": [("x = ", "(", "1", ")", ";"), ("x = ", "f(", "1", ")", ";"), ("", "if (a) {", "b", "}", ""), ("x = ", "`${", "1", "}`", ";"), ("x = ", "() => ", "1", "", ";")],
    "typescript": [("let x: ", "Array<", "number", ">", ";"), ("let x: ", "(", "number", ")", ";"), ("x = ", "[", "1", "]", ";")],
    "go": [("package p\nvar x = ", "f(", "1", ")", "\n"), ("package p\nfunc f() { ", "if a {", "", "}", " }\n"), ("package p\nvar x ", "[]", "int", "", "\n")],
    "rust": [("fn f() { x = ", "(", "1", ")", "; }"), ("fn f(x: ", "Vec<", "u8", ">", ") {}"), ("fn f() { ", "{", "1", "}", " }")],
    "python": [("x = ", "(", "1", ")", "\n"), ("x = ", "not ", "1", "", "\n"), ("x = ", "f(a, *", "b", ")", "\n"), ("", "[", "a", "]", " = 1\n"), ("x = ", "1 ** ", "1", "", "\n"), ("x = ", 'f"{', "1", '}"', "\n")],
    "json": [("", '{"a": [', "1", "]}", ""), ("", "[", "", "]", "")],
    "toml": [("x = ", "[", "1", "]", "\n"), ("x = ", "{a = ", "1", "}", "\n")],
    "yaml": [("a: ", "[", "1", "]", "\n"), ("", "- ", "1", "", "\n")],
}


@pytest.mark.parametrize("language", DEEP)
def test_depth_hides_no_error(language):
    for before, opener, inner, closer, after in DEEP[language]:
        for depth in (2, 3_000):
            text = lambda middle: before + opener * depth + middle + closer * depth + after
            assert syntax.problem(text(inner), language) is None, (opener, depth)
            assert syntax.problem(text("'1\"\n" if language == "yaml" else inner + " ? }"), language) is not None, (opener, depth)


def test_deep_definitions():
    text = "x = " + "(" * 3_000 + ")" * 3_000 + "\nclass A(b.B[int]):\n    @c\n    def f(self): \n        'Says ' 'it.'\n        return 1;\n"
    flat = text.replace("(" * 3_000 + ")" * 3_000, " " * 5_998 + "()")
    assert syntax.definitions(text, "python") == syntax.definitions(flat, "python")
    assert syntax.definitions("function f() { return " + "[" * 3_000 + "]" * 3_000 + " }", "javascript")[0].name == "f"


def test_no_library_is_no_result(monkeypatch):
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(ImportError):
        syntax.problem("a: [", "yaml")


def test_grammar_without_depth():
    """The parser for deep texts agrees with the interpreter's."""

    def valid(text, parse):
        try:
            parse(text)
            return True
        except (SyntaxError, Broken):
            return False

    texts = GOOD["python"] + FORMATTED + [LONG["python"]] + [x for x in BAD["python"] if "int]" not in x]
    texts += ["a, *b = c = yield d\n", "(a, b): int = 1\n", "(a.b): int\n", "f() = 1\n", "f(a=1, b)\n", "f(**a, *b)\n", "f(x for x in y, z)\n", "def f(a, /, b=1, *, c, **d): pass\n", "def f(a=1, b): pass\n", "def f(*, **k): pass\n", "lambda *a, b=1: (yield)\n"]
    texts += ["with (a as b, c as d,): pass\n", "with (a), b as (c, d): pass\n", "try: pass\nexcept* A as e: pass\n", "try: pass\nexcept* A: pass\nexcept B: pass\n", "match(x)\n", "match x, y:\n  case [A(1, b=_), *r] | {'k': -1+2j, **z} if q: pass\n", "match x:\n  case A(b=1, 2): pass\n", "x = {1: 2, 3}\n", "x = {**a, 'b': 1}\n", "x = [*a for a in b]\n", "x = 1if a else 2\n", "x = 1_\n", "b'a' 'b'\n", "if a:\n\tb\n        c\n", "if a:\n    b\n  c\n", "del (a, [b.c]), d\n", "del *a\n", "x: int = *a, b\n", "type = 1\n", "from . import (a as b,)\n", "from a import b,\n", "a = b := 1\n", "x = not a == b\n", "x = a == not b\n", "x = '\\x1'\n", "async def f():\n    await a ** -b\n    async for c in d: pass\n"]
    assert [t for t in texts if valid(t, ast.parse) != valid(t, python.parse)] == []
