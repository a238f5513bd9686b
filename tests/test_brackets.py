"""Symbols by brackets: nesting, strings, comments, literals, and broken texts."""

import random

import pytest

from quarrymill.operators.brackets import symbol_rows, symbols

JAVA = """package a;
@Service("x{")
public class Outer extends Base<Map<String, Integer>> implements I {
  private final String s = "class No { }"; // class Neither {
  @GetMapping(value = "/a/{id}")
  public ResponseEntity<String> get(@PathVariable("id") long id) throws E {
    if (id > 0) { for (int i = 0; i < 3; i++) { call(() -> { return 1; }); } }
    return '{' + null;
  }
  Outer() { super(); }
  static class Inner { int f(int a) { return a; } }
  interface Api { default void go() { } void stop(); }
}
record P(int a) { }
"""
SCRIPT = """export default class V extends C<{a: string}> implements OnInit {
  private re = /[{}"']+/g; t = `a ${ x ? `b{` : "}" } {`
  constructor(private a: Svc, readonly b = { k: 1 }) { super(); }
  async load(): Promise<void> { const f = () => { return {a: 1}; }; function inner() { } }
  get name(): string { return 'class X {'; }
  @Input({ required: true })
  set v(x: number) { this.x = x / 2 / 3; }
  shape(): { a: number } { return { a: 1 } }
}
interface Shape { area(): number; }
export async function* gen(a = {}) { yield 1 }
const o = { m() { return 2 }, k: class { } };
"""
GO = """package main
import "x"
type S struct { a int; b map[string]struct{} }
type I interface { M(a int) error }
func (s *S) M(a int) (int, error) { if a > 0 { return 1, nil }; f := func(x int) int { return x }; return `}` , nil }
func main() { go func() { }() }
func Any() interface{} { return nil }
func Gen[T any](a T) T { return a }
"""


def named(text, language):
    return [(s.kind[0], ".".join([*s.around, s.name]), text[: s.start].count("\n") + 1, text[: s.end - 1].count("\n") + 1) for s in symbols(text, language)]


def test_java():
    assert named(JAVA, "java") == [
        ("c", "Outer", 3, 13), ("f", "Outer.get", 6, 9), ("f", "Outer.Outer", 10, 10), ("c", "Outer.Inner", 11, 11), ("f", "Outer.Inner.f", 11, 11),
        ("i", "Outer.Api", 12, 12), ("f", "Outer.Api.go", 12, 12), ("c", "P", 14, 14),
    ]


def test_scripts():
    assert named(SCRIPT, "typescript") == [
        ("c", "V", 1, 9), ("f", "V.constructor", 3, 3), ("f", "V.load", 4, 4), ("f", "V.load.inner", 4, 4), ("f", "V.name", 5, 5), ("f", "V.v", 7, 7), ("f", "V.shape", 8, 8),
        ("i", "Shape", 10, 10), ("f", "gen", 11, 11),
    ]


def test_go():
    assert named(GO, "go") == [("c", "S", 3, 3), ("i", "I", 4, 4), ("f", "M", 5, 5), ("f", "main", 6, 6), ("f", "Any", 7, 7), ("f", "Gen", 8, 8)]


def test_broken_and_empty_texts():
    assert [(s.name, s.end) for s in symbols("class A { void f() {", "java")] == [("A", 20), ("f", 20)]
    assert [s.name for s in symbols("}}} class B { }", "java")] == ["B"]
    assert symbols("", "java") == symbols(None, "go") == symbols("class A: pass", "python") == []
    for text in ("`${`${", '"', "'\\", "/*", "class", "class A", "func (", "`", "/", "((({"):
        for language in ("java", "typescript", "go"):
            symbols(text, language)


@pytest.mark.parametrize("seed", range(20))
def test_random_nesting_as_written(seed):
    """Classes and methods nested at random come back with the names around them."""
    rng, want = random.Random(seed), []
    filler = ['String s = "} {";', "// } class No {\n", "/* { */", "if (a) { b(); }", "x = y / 2;", "run(() -> { go(); });"]

    def block(around, deep):
        out = []
        for _ in range(rng.randint(0, 3)):
            name = f"N{len(want)}"
            if deep < 4 and rng.random() < 0.5:
                want.append(("class", (*around, name)))
                out.append(f"class {name} {{ {block((*around, name), deep + 1)} }}")
            elif around:
                want.append(("function", (*around, name)))
                out.append(f"int {name}(int a, @B({{1}}) int b) {{ {rng.choice(filler)} return a; }}")
            out.append(rng.choice(filler[:3]))
        return "\n".join(out)

    text = block((), 0)
    assert [(s.kind, (*s.around, s.name)) for s in symbols(text, "java")] == want


def test_rows_of_files(spark):
    files = spark.createDataFrame([("r", "A.java", "java", JAVA), ("r", "b.py", "python", "class X: pass"), ("r", "n.go", "go", None)], "repo string, path string, language string, text string")
    found = symbol_rows(files).orderBy("symbol_idx").collect()
    assert [(r["name"], r["line_start"], r["line_end"]) for r in found[:2]] == [("Outer", 3, 13), ("get", 6, 9)] and len(found) == 8
    assert found[1]["hierarchy"] == ["Outer", "get"] and found[1]["content"].startswith("public ResponseEntity") and found[1]["content"].endswith("}")
