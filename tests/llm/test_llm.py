"""Operators for training data on small inputs, against brute force, public libraries and in the odd cases."""

import ast
import base64
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborine.llm.chart import Automaton, pairing_cost
from arborine.llm.docpairs import code_description_pairs, documented, documented_symbols, trivial
from arborine.llm.handwritten import evidence, file_labels, label_shares
from arborine.llm.mixing import mixed
from arborine.llm.pagespam import STATES, SYMBOLS, line_symbol, page_labels, page_symbols, spam_pages, tables, viterbi
from arborine.llm.syntax import repair, syntax_rates, syntax_repairs
from arborine.llm.tokenizer import DEFAULT_VOCABULARY, Encoder, encoded, merge_long, merge_short, token_counts

DOCS = "doc_id long, text string, source string, repo string, path string, words int, symbols string, language string, dir string"


def docs(spark, rows):
    """Rows of (doc_id, text, source, repo, path) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)


# tokenizer


@pytest.fixture(scope="module")
def encoder():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def reference(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abcXYZ 019'.,\n\t\r\x1c\x85éß日本語🚧　{}=")), max_size=200))
def test_ids_of_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert encoder.count(text) == len(encoder.encode(text))


def test_long_words(encoder, reference):
    for text in ("ab" * 4000, "the" * 300 + "日" * 500, "=" * 3000, " " * 2000 + "x"):
        assert encoder.encode(text) == reference.encode_ordinary(text)
    word = ("lower" * 40).encode()
    assert merge_short(word, encoder.ranks) == merge_long(word, encoder.ranks)
    assert base64.b64decode("IQ==") in encoder.ranks


def test_encoded_rows(spark, encoder):
    rows = [(1, "def f(): pass", None, None, None), (2, "", None, None, None), (3, None, None, None, None), (4, " \n", None, None, None), (4, " \n", None, None, None), (None, "x", None, None, None)]
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], encoder.encode(r[1])) for r in rows), key=str)
    assert encoded(docs(spark, rows).limit(0)).count() == 0
    assert {(r.doc_id, r.tokens) for r in token_counts(docs(spark, rows), ["doc_id"]).collect()} == {(r[0], len(encoder.encode(r[1]))) for r in rows}


# mixing


def test_mix_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 60), "big" if i % 10 else "small", None, None) for i in range(900)]
    rows += [(2000, None, "big", None, None), (2001, "", "small", None, None), (2002, "x y", None, None, None), (2003, "x", "other", None, None)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 1.0, 1), ("other", None, 2), ("other", -1.0, 2), ("big", 0.6, None)], "source string, weight double, max_repeats int")
    chosen, report = mixed(docs(spark, rows), targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"].tokens == 0
    assert abs(got["big"].share - 2 / 3) < 0.01 and abs(got["small"].share - 1 / 3) < 0.01
    copies = chosen.collect()
    assert all(0 <= r.copies <= (1 if r.source == "big" else 3) for r in copies) and len(copies) == 902
    assert all(r.copies == 0 for r in copies if r.doc_id in (2000, 2001))
    full = [r.rate for r in copies if r.source == "small" and r.tokens]
    assert max(full) == min(full) == 3.0


def test_mix_to_a_total(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(1, 60), "big" if i % 10 else "small", None, None) for i in range(400)] + [(900 + i, "w " * (7 + i), "tiny", None, None) for i in range(9)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 5)], "source string, weight double, max_repeats int")
    chosen, report = mixed(docs(spark, rows), targets, total=1000.0)
    got = {r.source: r for r in report.collect()}
    assert all(abs(r.tokens - r.goal) <= 2 and abs(r.gap) < 1e-3 for r in got.values()) and abs(sum(r.goal for r in got.values()) - 1000) < 1e-6
    assert all(0 <= r.copies <= {"big": 1, "small": 3, "tiny": 5}[r.source] for r in chosen.collect())
    most = {r.source: r.tokens for r in mixed(docs(spark, rows), targets, total=1e12)[1].collect()}
    assert sum(most.values()) > 1000 and abs(most["tiny"] / sum(most.values()) - 0.1) < 0.005


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    chosen, report = mixed(docs(spark, []), targets)
    assert chosen.count() == 0 and [tuple(r) for r in report.collect()] == [("a", 1.0, 0.0, 0, 0.0, 0.0, 0, 0, 0)]
    chosen, report = mixed(docs(spark, [(1, "x", "a", None, None)]), targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0


# pages

PROSE = "The parser was read before the schedule starts. It took us an afternoon to find.\nYou can do it by hand, but the tool will do so anyway.\n"


def test_line_symbols():
    assert [line_symbol(s)[0] for s in ("", "The old format is read before it starts.", "https://a.example/b https://c.example/d", "[buy it](https://a.example/x)", "- It was fixed. (https://a.example/x)", "2025-01-01 10:00:00 WARN retry failed")] == list("esukxl")
    assert line_symbol("buy x online, cheap y linter, x crack, y key, best x 2025, buy y now")[0] == "t"
    assert line_symbol("#one #two #three #four")[0] == "t" and line_symbol("Home » Shop » Tools")[0] == "m"
    assert line_symbol("変更のあと、もう一度調べてください。")[0] == "s"
    assert page_symbols("```\nx = 1\n```\n")[0] == "ccc"


def test_viterbi_is_the_best_path():
    model = tables()
    start, move, emit = model
    for symbols in ("sskkk", "ttrps", "emuks"):
        where = [SYMBOLS.index(k) for k in symbols]
        score = lambda p: start[p[0]] + sum(emit[s][k] for s, k in zip(p, where)) + sum(move[a][b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(len(STATES)), repeat=len(symbols)), key=score)
        assert abs(score(viterbi(symbols, model)) - score(best)) < 1e-9


def test_spam_pages(spark):
    keywords = "buy plugin online, plugin license key, cheap plugin linter, plugin serial crack, best plugin formatter 2025, "
    rows = [
        (1, PROSE * 6, None, None, None), (2, keywords * 20, None, None, None), (3, "\n".join(f"[tool {i} discount](https://x{i}.example/a)" for i in range(30)), None, None, None),
        (4, "\n".join(f"- The old format of part {i} was read before it starts. (https://x.example/{i})" for i in range(20)), None, None, None), (5, None, None, None, None), (6, "", None, None, None), (7, " \n\t", None, None, None),
        (8, "\n".join(f"2025-01-01 10:00:{i} WARN retry {i} failed" for i in range(50)), None, None, None), (9, keywords * 20, None, "r", "r/a.py"), (2, keywords * 20, None, None, None), (10, PROSE * 6 + keywords, None, None, None),
    ]
    assert sorted(r.doc_id for r in spam_pages(docs(spark, rows)).collect()) == [2, 2, 3]
    labels = {r.doc_id: r for r in page_labels(docs(spark, rows), rounds=0).collect()}
    assert 9 not in labels and labels[5].words == labels[7].words == 0 and labels[1].prose == labels[1].words
    assert spam_pages(docs(spark, [])).count() == 0


def test_stuffed_sentences_are_repetitions(spark):
    said = "Segment license key is the segment license key you need. Get segment license key now! Our segment license key beats any other segment license key. Looking for segment license key? Segment license key here. "
    log = "\n".join(f"2025-01-01 10:00:{i} WARN segment license key failed" for i in range(50))
    rows = [(1, said * 8, None, None, None), (2, said.replace(". ", ".\n") * 4, None, None, None), (3, PROSE * 6 + said, None, None, None), (4, log, None, None, None), (5, PROSE * 2 + said * 4, None, None, None), (6, said.replace("! ", "! (https://x.example/a) ") * 8, None, None, None)]
    assert line_symbol("Segment license key is the segment license key you need.")[0] == "s"
    assert set(page_symbols((said * 8).strip())[0]) == {"r"} and "r" not in page_symbols(PROSE * 6 + said)[0][:12]
    template = "".join(f"Nous avons déplacé le {a} après deux échecs du {b}. " for a, b in itertools.permutations(("ticket", "funnel", "quota", "glyph"), 2))
    assert "r" not in page_symbols(template)[0]
    assert sorted(r.doc_id for r in spam_pages(docs(spark, rows)).collect()) == [1, 2, 5, 6]


# documentation


def test_trivial():
    for doc in (None, "", " ", "...", "TODO: document this", "############", "{@inheritDoc}", "@return", "@param left", "noqa", "type: ignore", "This method is load_item.", "Load items.", "N/A", "[summary]", ":param left:\n:return:", "Load item left and right."):
        assert trivial(doc, "load_item", "load_item(left, right)"), doc
    for doc in ("Drops stale rows.", "Load each item and drop the ones that are stale.", "Größe prüfen", "Last one wins. TODO: bound it."):
        assert not trivial(doc, "load_item", "load_item(left, right)"), doc


def test_islands_of_each_language():
    py = 'class A:\n    def f(self,\n            x=(1, 2)) -> int:\n        # note\n        """Counts stale rows."""\n        return 1\n\n\ndef g():\n    """TODO"""\n\n\ndef h():\n    x = "no doc"\n'
    assert [(f[0], f[1], f[2], f[3]) for f in documented(py, "python")] == [(2, "f", "f(self,\n            x=(1, 2))", "Counts stale rows.")]
    assert documented(py, "python")[0][4].endswith("return 1")
    js = '/** Counts stale rows. */\nexport const count = (a) => {\n  return "}";\n};\n\n/** Far away words. */\n\nfunction far() {}\n/* plain words here */\nfunction plain() {}\n'
    got = documented(js, "javascript")
    assert [(f[0], f[1], f[3]) for f in got] == [(2, "count", "Counts stale rows.")] and got[0][4].endswith('return "}";\n}')
    java = "class A {\n  /**\n   * Counts stale rows.\n   * @param a x\n   */\n  @Override\n  public int count(int a) { return a; }\n}\n"
    assert [(f[0], f[1]) for f in documented(java, "java")] == [(7, "count")]
    assert [(f[0], f[1], f[3]) for f in documented("// Count counts stale rows.\n// Twice.\nfunc (s *T) Count(a int) int {\n}\n", "go")] == [(3, "Count", "Count counts stale rows.\nTwice.")]
    assert [(f[0], f[1]) for f in documented("/// Counts stale rows.\n#[inline]\npub fn count<T>(a: T) -> i64 { 1 }\n// Not documentation here.\nfn other() {}\n", "rust")] == [(3, "count")]
    assert [(f[0], f[1]) for f in documented("/** Counts stale rows. */\r\nstatic int count(int a)\r\n{\r\n}\r\n", "c")] == [(2, "count")]
    names = lambda text, language: [(f[0], f[1]) for f in documented(text, language)]
    assert names('x = """\ndef g():\n    "Counts stale rows."\n"""\n', "python") == [] and names("s = `\n/** Counts stale rows. */\nfunction f() {}\n`;\n", "javascript") == []
    assert names('def f(a=10//2):\n    """Counts stale rows."""\n', "python") == [(1, "f")]
    hashed = 'def f(a,  # the first (and only\n      b="("):\n    """Counts stale rows."""\n    return """\nx\n"""\n\n\ny = 1\n'
    assert names(hashed, "python") == [(1, "f")] and documented(hashed, "python")[0][4].endswith('x\n"""')
    assert names('class A {\n  /** Counts stale rows. */\n  @Foo(\n    x = ")",\n    y = 1)\n  @Bar public\n  int count(int a) { return "}".length(); }\n}\n', "java") == [(6, "count")]
    assert documented("/** Counts stale rows. */\nstatic int\ncount(int a)\n{\n  return '}';\n}\nint y;\n", "c")[0][1::3] == ("count", "static int\ncount(int a)\n{\n  return '}';\n}")
    assert documented("# Counts stale rows.\ndef count(a)\n  if a\n    1\n  end\nend\nx = 1\n", "ruby")[0][4].endswith("end\nend") and names("-- Counts stale rows.\nlocal function count(a)\n  if a then return 1 end\nend\n", "lua") == [(2, "count")]
    assert names("/// <summary>Counts stale rows.</summary>\n[Pure]\npublic int Count(int a) => a;\n", "csharp") == [(3, "Count")]
    assert documented(None, "python") == [] and documented("def f(", "python") == [] and documented("/** open", "java") == []


def test_documented_symbols(spark):
    text = '"""m"""\ndef f(a):\n    """Counts stale rows."""\n\n\ndef g(b):\n    pass\n'
    schema = "id string, kind string, name string, path string, language string, signature string, docstring string, start_line long, line long, doc string"
    rows = [("p::f", "function", "f", "r/p.py", "python", "f(a)", None, 2), ("p::f", "function", "f", "r/p.py", "python", "f(a)", None, 2), ("p::g", "function", "g", "r/p.py", "python", "g(b)", "", 6), ("q::h", "method", "h", "r/q.py", "python", None, "Keeps the last one.", 1), ("q::k", "method", "k", "r/q.py", "python", "k(x)", "K x.", 3)]
    rows += [("c", "class", "C", "r/p.py", "python", "", "Keeps things.", 2), (None, "function", "f", "r/p.py", "python", "f(a)", "Keeps the last one.", 2), ("bare", None, None, None, None, None, None, None)]
    symbols = spark.createDataFrame([(*r, 1, "z") for r in rows], schema)
    documents = docs(spark, [(1, text, None, "r", "r/p.py"), (2, text, None, "r", "r/p.py"), (3, None, None, "r", "r/q.py"), (4, text, None, None, None)])
    assert sorted(r.id for r in documented_symbols(symbols, documents).collect()) == ["p::f", "q::h"]
    pairs = {r.id: r for r in code_description_pairs(symbols, documents).collect()}
    assert set(pairs) == {"p::f", "q::h"} and pairs["p::f"].code == 'def f(a):\n    """Counts stale rows."""' and pairs["q::h"].code is None
    assert documented_symbols(symbols.limit(0), documents).count() == 0 and documented_symbols(symbols, documents.limit(0)).count() == 1


# syntax

VALID = {
    "python": 'import os\n\n@d(1)\nasync def f(a, *, b: int = 2, **k) -> int:\n    """<<<<<<< ours"""\n    x = [i for i in a if i] or {"k": 1, **k}\n    if (y := f(a)) and not x[1:2, ::3]:\n        return lambda z=1, *w: z\n    elif a is not None:\n        pass\n    else:\n        x += 1; del y\n    with open("a") as g, open("b"):\n        await g\n    try:\n        raise E from None\n    except (A, B) as e:\n        yield\n    finally:\n        print(f"{x}", end="")  # }\n',
    "javascript": 'import * as m from "x";\nexport class A extends B {\n  #p = 1;\n  static async *g(a, { b }, ...c) { for (const x of a) yield x; }\n  get v() { return this.#p; }\n}\nconst f = async (a = 1) => { if (a) return; else b(); };\nvar e = { a, b: 1, "c": [1, , 2], d() { return /[/]}/.test(x); }, ...r };\n// {\ndo { x++ } while (x < 3)\nswitch (x) { case 1: y(); break; default: z() }\ntry { a() } catch { b() } finally { c() }\n!function(e,t){var n=e?t:(e,t);return n}(1)\n',
    "typescript": "import { A } from 'x';\ninterface P<T> { a: number; b?(x: string): void; [k: string]: unknown }\ntype U = A | { b: string[] };\nexport abstract class C<T> implements P<T> {\n  constructor(private readonly a: number, b?: string) { super(); }\n  f(x: Row | null, y: number[] = []): Map<string, T> { return <any>x as T; }\n}\nenum E { A, B = 2 }\nconst g = async (a: number): Promise<void> => { let z: any = a!; };\n",
    "java": "package a.b;\nimport java.util.*;\npublic class A<T extends B> extends C implements D, E {\n  private static final int[] X = {1, 2};\n  @Override public <R> List<R> f(final int a, String... b) throws IOException {\n    for (var it : x) { if (a != 1) continue; }\n    int y = a > 1 ? (int) z : -1, w;\n    switch (y) { case 1: g(); break; default: return null; }\n    try (var r = h()) { x.forEach(i -> i.go()); } catch (A | B e) { throw new E(\"}\"); } finally { }\n    return new ArrayList<>() { };\n  }\n  enum Q { A, B(1) { }; int v; }\n}\n",
    "go": 'package a\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype T struct {\n\ta, b int\n\tF func(int) error `j:"x"`\n}\n\nvar m = map[string]int{"a": 1}\n\nfunc (t *T) F(a []int, b ...string) (int, error) {\n\tfor i, v := range a {\n\t\tif x := f(i); x > v {\n\t\t\tcontinue\n\t\t} else if !ok {\n\t\t\ti++\n\t\t}\n\t}\n\tswitch a := b.(type) {\n\tcase int, string:\n\t\tgo func() { c <- 1 }()\n\tdefault:\n\t}\n\treturn 1, nil\n}\n',
    "rust": "use std::{fmt, io};\n#[derive(Debug)]\npub struct S<'a> { pub x: &'a str, y: Vec<(i64, u8)> }\nenum E { A, B(i64), C { x: i32 } }\nimpl<'a> S<'a> {\n    pub fn f(&self, mut a: &[i64]) -> Option<i64> {\n        let x = if a.len() > 1 { a[0] } else { 2 };\n        for (i, v) in a.iter().enumerate() { println!(\"{}\", i); }\n        match x { 1 | 2 => return None, n if n > 3 => {} _ => (), }\n        let c = |z: i64| z + 1;\n        Some(c(x)?)\n    }\n}\n",
    "c": '#include <stdio.h>\n#define X(a) { a\nstruct N { int limit; struct N *next; };\ntypedef unsigned long u;\nstatic const char *names[] = { "a", "b" };\nint f(const int *a, char b[], ...) {\n  for (int i = 0; i < 3; i++) { if (a[i]) break; else g(&b, (u)i); }\n  do { x->y = ~1; } while (0);\n  switch (b[0]) { case 1: return sizeof(int); default: ; }\n  goto end;\nend:\n  return a ? *a : -1;\n}\n',
}


@pytest.mark.parametrize("language", VALID)
def test_valid_and_damaged_files(language):
    text = VALID[language]
    assert repair(text, language) == (0, "", True)
    assert repair(text.replace("\n", "\r\n"), language)[0] == 0
    if language == "python":
        ast.parse(text)
    conflict = text.split("\n")
    at = len(conflict) // 2
    assert repair("\n".join([*conflict[:at], "<<<<<<< ours", *conflict[at:], "=======", ">>>>>>> theirs"]), language)[1] == "conflict"
    for bad in (text[: len(text) * 2 // 3] + "(", text + "\n}\n)", "pointer version 2\noid 26e634cdb\nsize 62014\n", "<!DOCTYPE html>\n<html><body>Sign in</body></html>\n", "".join(text.rsplit("(", 1))):
        assert repair(bad, language)[0] > 0, bad
    for other, wrong in VALID.items():
        if other != language and (language, other) not in {("typescript", "javascript")}:
            assert repair(wrong, language)[0] > 0, other


def test_blank_texts_and_other_languages():
    for text in (None, "", " \n\t"):
        assert repair(text, "go") == (0, "", True)
    assert repair("fun f() { (", "kotlin")[0] > 0 and repair("fun f() { }", "kotlin")[0] == 0
    assert repair("echo hi\n<<<<<<< a\n", "bash")[0] > 0 and repair("x = (1\n", "lua")[0] > 0
    assert repair("x = 1\n" * 20_000, "python")[0] == 0 and repair("{" * 5000, "java")[0] > 0


def distance_to_language(s, accept, alphabet, most):
    """Brute force: fewest edits to an accepted string."""
    level, seen = {s}, {s}
    for k in range(most + 1):
        if any(accept(x) for x in level):
            return k
        level = {y for x in level for i in range(len(x) + 1) for y in [*(x[:i] + c + x[i:] for c in alphabet), *([x[:i] + x[i + 1 :]] if i < len(x) else []), *(x[:i] + c + x[i + 1 :] for c in alphabet if i < len(x))]} - seen
        seen |= level
    return most + 1


@settings(max_examples=40, deadline=None)
@given(s=st.text(alphabet="ab,", max_size=5))
def test_repair_is_least(s):
    import re

    for pattern, plain in (("a(?:,a)*b?", "a(?:,a)*b?"), ("(a(?=,))b", "a(?:,a)*b"), ("(?:ab)+,?", "(?:ab)+,?")):
        machine = Automaton(pattern)
        accept = lambda x, p=plain: bool(re.fullmatch(p, x))
        assert machine.accepts(s) == accept(s)
        assert machine.repair(s, 2)[0] == distance_to_language(s, accept, "ab,", 2)


@settings(max_examples=40, deadline=None)
@given(s=st.text(alphabet="([)]", max_size=5))
def test_pairing_is_least(s):
    def balanced(x):
        while True:
            y = x.replace("()", "").replace("[]", "")
            if y == x:
                return not x
            x = y

    assert pairing_cost(s, 2) == distance_to_language(s, balanced, "([)]", 2)


def test_syntax_rows(spark):
    rows = [(1, "x = (", None, "r", "r/a.py"), (2, "x = 1", None, "r", "r/b.py"), (3, None, None, "r", "r/c.py"), (4, "{", None, "r", "r/d.md"), (5, "x = (", None, "r", None), (6, "class A {", None, None, "r/A.java"), (1, "x = (", None, "r", "r/a.py")]
    got = syntax_repairs(docs(spark, rows))
    assert sorted((r.doc_id, r.language, r.cost > 0) for r in got.collect()) == [(1, "python", True), (1, "python", True), (2, "python", False), (3, "python", False), (6, "java", True)]
    assert {tuple(r) for r in syntax_rates(got).collect()} == {("r", "python", 4, 2, 0.5), (None, "java", 1, 1, 1.0)}
    assert syntax_repairs(docs(spark, [])).count() == 0


# files not written by hand

HAND = '"""Helpers."""\nimport os\n\n\ndef load_items(path, limit):\n    """Load what is there."""\n    total = limit + 1\n    for row in path:\n        total = total * row\n    return total\n\n\ndef drop_stale(rows):\n    return [row for row in rows if row]\n\n\ndef merge(left, right):\n    return left - right\n'


def test_evidence():
    kinds = lambda text, path: dict(zip(("hand", "gen", "mini", "vend", "blob"), evidence(text, path, "r")[0]))
    assert kinds("// Code generated by x. DO NOT EDIT.\n" + HAND, "r/a.py")["gen"] > 3
    assert kinds("# Writes the generated files; the DO NOT EDIT line of each is put there by x.\n" + HAND, "r/a.py")["gen"] < 0
    assert kinds("".join(f"def get_a{i}(x):\n    return x\n\n\ndef set_a{i}(x):\n    return x\n\n\n" for i in range(4)), "r/a.py")["gen"] > 3
    assert kinds("A = [\n" + "  37, 13, 0, 76, 132,\n" * 40 + "]\n", "r/a.py")["blob"] > 3
    assert kinds("!function(e,t){" + "var n=e?t:(e,t);" * 40 + "}()", "r/a.js")["mini"] > 3
    assert evidence("# SPDX-FileCopyrightText: the oakum authors\n" + HAND, "r/a.py", "r")[3:] == ("oakum authors", 3.5)
    assert kinds("# (c) the r team, see LICENSE for the terms\n" + HAND, "r/a.py")["hand"] > 0
    for head in ("GENERATED CODE - DO NOT MODIFY BY HAND", "A Bison parser, made by GNU Bison 3.8.2.", "Form implementation generated from reading ui file 'a.ui'", "Generated by the protocol buffer compiler.  DO NOT EDIT!", "This file is automatically generated.", "Ce fichier est utile.\n# Fichier généré automatiquement", "Code generated from x.y by a tool; DO NOT EDIT."):
        assert kinds(f"# {head}\n" + HAND, "r/a.py")["gen"] > 3, head
        assert kinds(HAND + "\n\n" * 40 + f"# {head}\n", "r/a.py")["gen"] > 3, head
    for head in ("Holds what was generated by the loader.", "Auto-generated method stub", "Do not edit rows while they are locked.", "Made by hand."):
        assert kinds(f"# {head}\n" + HAND, "r/a.py")["gen"] < 0, head
    assert kinds("int f(void) {\n  // generated by x, do not edit\n  return 1;\n}\n" * 3, "r/a.c")["gen"] < 3
    assert kinds("# Copied from oakum release 1.2.3\n" + HAND, "r/a.py")["vend"] > 6 and kinds("A = [1, 2]\n", "r/a.py")["blob"] < 2
    assert evidence(HAND, "r/a.py", None)[1] == evidence("# another head\n" + HAND.replace("    ", "  "), "q/b.py", None)[1]


def test_labels(spark):
    other = HAND.replace("total", "amount").replace("drop_stale", "keep_new")
    rows = [(i, HAND.replace("limit", f"limit_{i}"), None, "r", f"r/src/m{i}.py") for i in range(6)]
    rows += [(10, other, None, "r", "r/node_modules/lib/deep/a.py"), (11, other.replace("amount", "sum_"), None, "r", "r/node_modules/lib/deep/b.py"), (12, "# Code generated by x. DO NOT EDIT.\n" + HAND, None, "r", "r/src/gen_a.py")]
    shared = HAND.replace("total", "weight").replace("merge", "unite")
    rows += [(20, shared, None, "r", "r/util/a.py"), (21, "# head\n" + shared, None, "q", "q/util/b.py"), (30, None, None, "r", "r/node_modules/n.py"), (31, " ", None, "r", "r/node_modules/o.py"), (32, HAND, None, None, None), (33, HAND, None, "r", "r/docs/a.md"), (34, HAND.replace("limit", "z"), None, None, "top.py"), (0, rows[0][1], None, "r", "r/src/m0.py")]
    labels = file_labels(docs(spark, rows))
    got = sorted((r.doc_id, r.label) for r in labels.collect())
    assert got == sorted([(0, "hand"), *((i, "hand") for i in range(6)), (10, "vend"), (11, "vend"), (12, "gen"), (20, "vend"), (21, "hand"), (34, "hand")])
    assert ("r", "gen", 1) in {tuple(r) for r in label_shares(labels).collect()}
    assert file_labels(docs(spark, [])).count() == 0


def test_siblings_and_owners_decide(spark):
    other = lambda k: "".join(f"def f{k}_{c}(rows, limit):\n    total = limit + {i}\n    return [r * total for r in rows if r != {k}]\n\n\n" for i, c in enumerate("abcd"))
    taken = lambda k: f"# Copied from oakum release 1.2.{k}\n" + other(k)
    rows = [(i, taken(i), None, "r", f"r/lib/oakum/m{i}.py") for i in range(5)] + [(5, other(5), None, "r", "r/lib/oakum/m5.py")]
    rows += [(10 + i, other(10 + i), None, "r", f"r/src/m{i}.py") for i in range(12)] + [(30, taken(30), None, "r", "r/src/x.py")]
    rows += [(40 + i, "# Copyright (c) 2024 Acme Corp\n# Licensed under the Apache License\n" + other(40 + i), None, "q", f"q/src/m{i}.py") for i in range(12)]
    rows += [(60, "# Copyright (c) 2019 Someone Else\n# Licensed under the MIT License\n" + other(60), None, "q", "q/src/y.py")]
    got = {r.doc_id: r.label for r in file_labels(docs(spark, rows), {}).collect()}
    assert {i for i, label in got.items() if label == "vend"} == {0, 1, 2, 3, 4, 5, 30, 60}
