"""Broken and valid texts of every language, and texts that make a lexer or a chart slow."""

import time

import pytest

from arborine.functions.languages import EXTENSIONS
from arborine.llm.syntax import checked, repair

# fmt: off
BROKEN = {'python':['x = = 1\n','if x > = 1:\n    pass\n'],'javascript':['x = = 1;\n','const a = ;\nconst b = <br/>;\n','const a = <b><i>x</b></i>;\n','x = `${a + }`;\n'],'tsx':['const b = <A x={1 + }/>;\n'],
'rust':['fn f() { let x = ; }\n','fn f() { let = ; }\n'],'kotlin':['val = = }','fun f() { val x = = 1 }'],'ruby':['def f(\n','def f\n  if x\n    1\nend\n','x = = 1\n'],'bash':['if [ x ; then ; fi fi done (\n','for i in a b; do\necho $i\n','case x in a) echo;; \n'],
'cpp':['int main() { int x = = 1; }','int f( { }'],'csharp':['class A { int X => ; }','class A {'],'php':['<?php $x = = 1;','<?php if ($a { }'],'swift':['let x = = 1\n','func f( {}\n'],'scala':['val x = \n}\n','def f(x = 1\n'],'lua':['if x then y = 1\n','x = = 1\n','for i=1,2 do end end\n'],'r':['x <- <- 1\n','f <- function(x { }\n'],
'java':['class A { int f() { return 1 1; } }','class A { int x = = 1; }'],'go':['package a\nfunc f() { x = = 1 }\n'],'c':['int f() { x = = 1; }\n']}
VALID = {'javascript':['const a = `x${b ? `y${c}` : ""}z`;\nfunction F() { if (!new.target) return new F(); }\n','const b = <br/>;\nconst c = a ? <A x="1" y={z => z + 1} {...p}>t {q.map(i => <B key={i}/>)} </A> : null;\nconst e = <><b>it\'s</b></>;\nif (a < b && c > d) { f(); }\n'],
'tsx':['const F = <T,>(x: T) => <div className={`a ${x}`}>{x}</div>;\n'],'typescript':['type A<T> = T extends (infer U)[] ? U : never;\ndeclare global { interface W { a: number } }\ndeclare const z: A<string>;\nexport default function f(x: number): void;\n'],
'java':['class A { String f(Object o) { return switch (o) { case Integer i when i > 1 -> "a"; case Point(int x, int y) -> "b"; default -> "c"; }; } }'],
'rust':['async fn f() -> Result<(), Box<dyn Error>> { Ok(()) }\n','macro_rules! m { ($x:expr) => { $x + 1 }; }\nfn g() { m! { a b c } }\n',"struct S<T>(T) where T: 'static;\nfn h<T>(t: T) where T: 'static + Send { }\n"],
'kotlin':['fun f(x: Int?): Int {\n    val y = x ?: return 0\n    when (y) {\n        in 1..5 -> println("a ${y + 1} b")\n        is Int -> {}\n        else -> {}\n    }\n    return y\n        .plus(1)\n}\n'],'ruby':['class A < B\n  attr_reader :x\n  def f(a, b = 1, *c, &d)\n    return if a.nil?\n    x = if a then 1 else 2 end\n    a.each do |y|\n      puts "#{y["k"]} %"\n    end\n    while x < 3 do x += 1 end\n    s = <<~EOS\n      if ( unless\n    EOS\n    { a: 1, :b => %w[x y], "c": /[(]/ }\n  end\n  def g = 1\nend\n'],
'bash':['#!/bin/bash\nset -e\nif [ "$1" = "a b" ] && [[ -f $x ]]; then\n  echo "$(ls "$d" | wc -l) x"\nelif true; then :; else exit 1; fi\nfor f in *.c; do cc "$f" || exit; done\nwhile read -r l; do echo $l; done < in.txt\ncase "$1" in\n  a|b) echo 1;;\n  (*) echo 2 ;;\nesac\nf() { local x=$((1+2)); arr=(a b); echo "${arr[@]}" >&2; }\ncat <<EOF\nif ( then\nEOF\n'],
'cpp':['#include <map>\ntemplate <typename T, class... A>\nclass X : public Y<T> {\n public:\n  X() = default;\n  bool operator==(const X& o) const { return a_ == o.a_; }\n  auto f(int&& x) -> std::vector<std::map<int, T>> { auto l = [&, this](int a) { return a * *p; }; for (auto& [k, v] : m) ++v; return {}; }\n};\n'],
'csharp':['using System;\nnamespace A {\n  [Attr(1)]\n  public class B<T> : C where T : new() {\n    public int X { get; set; } = 1;\n    public string Y => $"a {X:0.0} {(X > 1 ? "b" : "c")}";\n    int? F(params int[] a) { var x = a?[0] ?? -1; foreach (var y in a) { if (y is int z && z >= 1) return z; } return @"c:\\".Length; }\n  }\n}\n'],
'php':['<html><?php foreach ($a as $k => $v): ?><b><?= $v["x"] ?></b><?php endforeach; ?>\n<?php\nnamespace A\\B;\n#[Attr]\nclass C extends D { private ?int $x = null; function f(array &$a, ...$b): static { return $this->g(fn($y) => $y . "z")[0] ?? -1; } }\n'],
'swift':['struct A: B {\n  var x: Int? { didSet { f() } }\n  func f(_ a: Int..., b: (Int) -> Void = { _ in }) throws -> [String: Int] {\n    guard let y = x, y > 1 else { return [:] }\n    switch y { case 1...3: break\n    case .some: fallthrough\n    default: print("a \\(y + g("z")) b") }\n    return a.map { $0 + 1 }\n      .filter { !$0.isEmpty }\n  }\n}\n'],
'scala':['package a\nobject A extends B with C {\n  def f[T <: X](x: Int = 1)(implicit y: Y): Option[T] = x match {\n    case 1 | 2 if y > 1 => Some(s"a $x")\n    case _ =>\n  }\n  val g: Int => Int = _ + 1\n}\n'],
'lua':['local M = {}\nfunction M.f(a, ...)\n  if a == nil then return end\n  for i = 1, #a do local x <const> = a[i] .. "s" end\n  repeat a = not a until a\n  while true do break end\n  return function() return -1, M:g{1; 2} end\nend\n-- [[ c ]]\nreturn M\n'],
'r':['f <- function(x, ...) {\n  y <- x[, 1] %in% c("a", \'b\')\n  if (y) -x else x$z@w\n  lm(y ~ x + 0, data = d) |> summary()\n}\n']}
# fmt: on


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert checked(text, language)[0] > 0, text


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert checked(text, language) == (0, "", True), text


def test_every_language_is_parsed():
    assert set(EXTENSIONS.values()) == set(BROKEN) | {"typescript"}


def test_kinds_of_damage():
    assert repair("class A { int f() { return 1 1; } }", "java") == (1, "syntax", True)
    assert repair("class A { int f() { return 1; }", "java")[1] == "truncation" and repair('x = """a', "python")[1] == "truncation"
    assert not repair("class A { } } ) ] } } ) ) ] }", "java")[2]


@pytest.mark.parametrize(("language", "unit"), [("java", "/* "), ("javascript", "`${"), ("python", '("'), ("typescript", "<A "), ("c", "{"), ("java", "["), ("bash", '"$('), ("tsx", "(<a>{")])
def test_long_texts_take_one_pass(language, unit):
    began = time.process_time()
    assert repair(unit * (100_000 // len(unit)), language)[0] > 0
    assert time.process_time() - began < 10


def test_struct_patterns_of_rust():
    assert repair("fn f() { let A { x, .. } = y; if let B(..) = c {} }\n", "rust")[0] == 0
    assert repair("class A extends B<{ a: number }> {\n  x = 1;\n}\n", "typescript")[0] == 0
