"""The code graph: extraction, resolution, lookups, traversal, retrieval, upkeep."""

import hashlib
import random
import re

import pytest

from arborine.api import CodeGraph
from arborine.functions import text as T
from arborine.functions.embedding import token_features
from arborine.operators import metrics as M
from arborine.operators import resolve as R
from arborine.operators import retrieve as V
from arborine.operators import snapshot as S
from arborine.operators.traverse import reverse_reach
from arborine.sources.extract import parse_text
from arborine.sources.scratch import Scratch
from pyspark.sql import functions as F

ZOO = """class Animal:
    def speak(self):
        '''Say something.'''
        return noise()


class Dog(Animal):
    def bark(self, n=(1, 2)):
        return woof(len([n]))


def noise():
    return 1


def woof(x=1):
    return x


def main():
    d = Dog()
    return woof(d)
"""


def graph(spark, **files):
    texts = spark.createDataFrame([(k.replace("__", "/") + ".py", v) for k, v in files.items()], "path string, text string")
    return CodeGraph.from_texts(spark, texts)


def column(df, name):
    return {r[name] for r in df.collect()}


def test_calls_and_classes(spark):
    g = graph(spark, zoo=ZOO)
    assert column(g.get_callees("main"), "name") == {"Dog", "woof"}
    assert column(g.get_callers("woof"), "src_id") == {"zoo.py::zoo.Dog.bark", "zoo.py::zoo.main"}
    rows = {(r.direction, r.id) for r in g.class_hierarchy("Dog").collect()}
    assert rows == {("supertype", "zoo.py::zoo.Animal")}
    assert column(g.class_hierarchy("Animal"), "id") == {"zoo.py::zoo.Dog"}
    assert g.get_callees("Dog.bark").count() == 1 and g.get_callees("og.bark").count() == 0 and g.get_callers("nothing").count() == 0
    assert g.get_callees("main", path="other.py").count() == 0
    source = g.read_symbol("zoo.noise").collect()
    assert [r.source for r in source] == ["def noise():\n    return 1"]
    outline = g.file_outline("zoo.py").collect()
    assert [r.name for r in outline] == ["Animal", "speak", "Dog", "bark", "noise", "woof", "main"]
    assert outline[1].summary == "Say something." and outline[3].signature == "bark(self, n=(1, 2))"
    counts, languages, hubs = g.repo_overview()
    assert tuple(counts.first()) == (1, 7) and tuple(languages.first()) == ("python", 1) and hubs.count() == 0
    assert g.query("SELECT count(*) AS n FROM {edges} WHERE kind = :k", k="defines").first().n == 7


def test_imports_decide_between_names(spark):
    g = graph(spark, db="def connect():\n    pass\n", cache="def connect():\n    pass\n", service="import db\n\n\ndef use():\n    connect()\n", tests__test_app="import service\n\n\ndef test_use():\n    use()\n")
    assert column(g.get_callees("use"), "dst_id") == {"db.py::db.connect"}
    impact = {(r.id, r.depth, r.is_test) for r in g.analyze_symbol_impact("db.connect").collect()}
    assert impact == {("service.py::service.use", 1, False), ("tests/test_app.py::tests.test_app.test_use", 2, True)}
    assert column(g.analyze_symbol_impact("db.connect", max_depth=1), "id") == {"service.py::service.use"}
    blast = {(r.id, r.depth, r.is_test) for r in g.analyze_blast_radius("db.py").collect()}
    assert blast == {("service.py", 1, False), ("tests/test_app.py", 2, True)}
    deps = {(r.path, r.id, r.direction) for r in g.get_file_dependencies("db.py", "service.py").collect()}
    assert ("db.py", "service.py", "dependent") in deps and ("service.py", "db", "dependency") in deps
    assert g.get_file_dependencies("db.py", depth=2).where("direction = 'dependent'").count() == 2


def test_extraction_of_other_languages():
    def found(path, text):
        language, symbols, edges, error = parse_text(path, text)
        return {(s[1], s[3]) for s in symbols[1:]}, {(e[2], e[0].rsplit(".", 1)[-1], e[1]) for e in edges if e[2] in ("calls", "inherits")}, {e[1] for e in edges if e[2] == "imports"}

    symbols, edges, imports = found("a.ts", 'import { x } from "lib";\nexport class Svc extends Base implements Named {\n  run(n: number): void { doThing(n); new Helper(); }\n  handler = () => { go(); };\n}\nconst build = async (a) => { make(a); };\nconst notAFunction = 3;\n')
    assert symbols == {("class", "a.Svc"), ("method", "a.Svc.run"), ("method", "a.Svc.handler"), ("function", "a.build")}
    assert {("inherits", "Svc", "Base"), ("inherits", "Svc", "Named"), ("calls", "run", "doThing"), ("calls", "run", "Helper"), ("calls", "handler", "go"), ("calls", "build", "make")} <= edges
    assert imports == {"lib"}
    symbols, edges, imports = found("s.rs", "use std::fmt;\nstruct S;\nimpl S {\n  fn go(&self) { helper(1); self.work(); }\n}\n")
    assert symbols == {("class", "s.S"), ("method", "s.go")} and {("calls", "go", "helper"), ("calls", "go", "work")} <= edges and imports == {"std::fmt"}
    symbols, edges, _ = found("m.go", 'package m\nimport "fmt"\nfunc (s *T) run(a int) int {\n  helper(a)\n  return s.Method()\n}\n')
    assert ("function", "m.run") in symbols and {("calls", "run", "helper"), ("calls", "run", "Method")} <= edges
    symbols, edges, imports = found("S.java", "import java.util.List;\npublic class Svc extends Base implements I {\n  int run(List<String> x) { doThing(); return new Helper().a(); }\n}\n")
    assert symbols == {("class", "S.Svc"), ("method", "S.Svc.run")} and {("inherits", "Svc", "Base"), ("inherits", "Svc", "I"), ("calls", "run", "doThing"), ("calls", "run", "Helper")} <= edges
    assert parse_text("x.lua", "function f() end")[1][0][1] == "file" and parse_text("x.bin", "")[3] == "unsupported file type"
    language, symbols, edges, error = parse_text("bad.py", "def f(:")
    assert error.startswith("parse error") and [s[1] for s in symbols] == ["file", "function"] and [e[2] for e in edges] == ["defines"]
    assert parse_text("n.py", None)[3] is None


def test_resolution_by_random_draws(spark):
    rng = random.Random(5)
    nodes, files = [], [f"f{i}.py" for i in range(6)]
    nodes += [(f, "file", f, f[:-3], f) for f in files]
    nodes += [(f"{f}::{n}", "function", n, n, f) for f in files for n in "abc" if rng.random() < 0.4]
    imports = {(a, b) for a in files for b in files if a != b and rng.random() < 0.2}
    wanted = {(n[0], name) for n in nodes if n[1] == "function" for name in "abc" if rng.random() < 0.7}
    frame = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, path string")
    edges = spark.createDataFrame([(s, n, "calls") for s, n in wanted], "src_id string, dst_id string, kind string")
    near = spark.createDataFrame(sorted(imports), "importer string, imported string")
    where = {n[0]: n[4] for n in nodes}
    for exclude in (False, True):
        want = set()
        for src, name in wanted:
            found = [n for n in nodes if n[1] == "function" and n[2] == name and not (exclude and n[0] == src)]
            tiers = [[n for n in found if n[4] == where[src]], [n for n in found if (where[src], n[4]) in imports], found]
            best = next((t for t in tiers if t), [])
            if len(best) == 1:
                want.add((src, name, best[0][0]))
        got = R.resolve_names(frame, edges, "calls", ("function",), near, exclude)
        assert {tuple(r) for r in got.collect()} == want


def test_unique_ends_of_imports(spark):
    nodes = spark.createDataFrame([(p, "file", p, T_qual(p), p) for p in ("apps/api/app/db.py", "apps/api/app/main.py", "x/util.py", "y/util.py", "util.py")], "id string, kind string, name string, qualified_name string, path string")
    edges = spark.createDataFrame([("apps/api/app/main.py", "app.db", "imports"), ("apps/api/app/main.py", "util", "imports"), ("x/util.py", "x.util", "imports"), ("util.py", "none.such", "imports")], "src_id string, dst_id string, kind string")
    assert {tuple(r) for r in R.resolve_imports(nodes, edges).collect()} == {("apps/api/app/main.py", "apps/api/app/db.py"), ("apps/api/app/main.py", "util.py")}


def T_qual(path):
    return path[:-3].replace("/", ".")


def test_reach_excludes_seeds_and_stops(spark):
    steps = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in reverse_reach(steps, seeds, 2).collect()} == {("a", "b", 1), ("a", "c", 2)}
    assert {tuple(r) for r in reverse_reach(steps, seeds, 9).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/__init__.py", "HTTPServer2_x", " \n first \nrest", "x\r\ny\x0bz\n", "-12")], "path string, name string, doc string, text string, n string")
    row = df.select(
        T.module_qualname(F.col("path")).alias("q"), T.identifier_split(F.col("name")).alias("w"), T.doc_summary(F.col("doc")).alias("s"), T.source_slice(F.col("text"), F.lit(2), F.lit(9)).alias("cut"),
        T.source_slice(F.col("text"), F.lit(0), F.lit(1)).alias("none"), T.as_int(F.col("n")).alias("n"), T.as_int(F.lit("1.5")).alias("f"), T.estimate_tokens(F.lit("")).alias("t0"), T.estimate_tokens(F.lit("x" * 40)).alias("t"),
        T.dotted_suffixes(F.lit("a.b.c")).alias("d"), T.clean_import(F.lit("\"'lib';")).alias("i"), T.normal_path(F.lit("./a//b/./c/")).alias("p"), T.docstring_cap(F.lit("y" * 600)).alias("cap"),
    ).first()
    assert (row.q, row.w, row.s, row.cut, row.none) == ("a.b", ["http", "server", "2", "x"], "first", "y\nz", "")
    assert (row.n, row.f, row.t0, row.t, row.d, row.i, row.p) == (-12, 0, 1, 10, ["a.b.c", "b.c", "c"], "lib", "a/b/c")
    assert len(row.cap) == 500 and row.cap.endswith("…")


def test_discovery(spark, tmp_path):
    from arborine.sources.discovery import discover_files, selected

    for name in ("a.py", "pkg/b.go", "node_modules/c.js", ".hid/d.py", "pkg/e.txt", "pkg/.f.py", "pkg/__init__.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    assert column(discover_files(spark, str(tmp_path)), "path") == {"a.py", "pkg/b.go", "pkg/.f.py", "pkg/__init__.py"}
    assert column(discover_files(spark, str(tmp_path), include=["*.py"], exclude=["pkg/*"]), "path") == {"a.py"}
    assert selected(spark.createDataFrame([(None,), ("",), ("x.PY",)], "path string")).collect()[0].path == "x.PY"


def test_snapshot_and_events(spark):
    symbols = spark.createDataFrame([("a", "f", None, "p.py", 2), ("a", "g", None, "p.py", 1), ("b", "f", None, None, 1), (None, "f", None, "p.py", 1)], "id string, name string, kind string, path string, indexed_at int")
    for c in ("qualified_name", "language", "signature", "docstring"):
        symbols = symbols.withColumn(c, F.lit(None).cast("string"))
    symbols = symbols.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1))
    nodes = S.upsert_nodes(symbols)
    assert [(r.id, r.name, r.signature) for r in nodes.collect()] == [("a", "f", "")]
    edges = S.upsert_edges(spark.createDataFrame([("a", "x", "calls", 1.0), ("a", "x", "calls", None), ("z", "x", "calls", 1.0), ("a", None, "calls", 1.0)], "src_id string, dst_id string, kind string, weight double"), nodes)
    assert [tuple(r) for r in edges.collect()] == [("a", "x", "calls")]
    assert column(S.placeholder_nodes(edges, nodes), "id") == {"x"}
    events = spark.createDataFrame([("a", False, 1), ("b", True, 2), ("a", False, 3), ("c", False, 4), ("c", True, 5), ("c", True, 5), (None, True, 6), ("d", None, 7), ("a", True, None)], "path string, removed boolean, seq long")
    assert {tuple(r) for r in S.collapse_events(events).collect()} == {("a", False, 3), ("b", True, 2), ("c", True, 5), ("d", False, 7)}
    kept, left = S.delete_files(nodes, edges, spark.createDataFrame([("p.py",)], "path string"))
    assert kept.count() == 0 and left.count() == 0


def test_stream_of_changes(spark, tmp_path):
    from arborine.streaming.changes import ChangeState, change_stream, run_available

    folder = tmp_path / "in"
    schema = "path string, removed boolean, seq long, changed_at timestamp_ntz"
    for k, rows in enumerate([[("a.py", True, 9, None), ("b.py", False, 2, None)], [("a.py", False, 3, None), ("./b.py", True, 4, None), ("dist/c.py", False, 5, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    state = ChangeState(spark, str(tmp_path / "state"))
    got = run_available(change_stream(spark, str(folder)), state, str(tmp_path / "progress"))
    assert {tuple(r) for r in got.collect()} == {("a.py", True, 9), ("b.py", True, 4)}
    assert ChangeState(spark, str(tmp_path / "none")).table().count() == 0
    # a restarted session finds the state, goes on from it, and a replayed batch changes nothing
    spark.createDataFrame([("d.go", False, 11, None), ("b.py", False, 1, None)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    again = ChangeState(spark, str(tmp_path / "state"), every=2)
    want = {("a.py", True, 9), ("b.py", True, 4), ("d.go", False, 11)}
    assert {tuple(r) for r in run_available(change_stream(spark, str(folder)), again, str(tmp_path / "progress")).collect()} == want
    again.merge(spark.createDataFrame([("a.py", False, 3), ("d.go", False, 11)], "path string, removed boolean, seq long"), 2)
    assert {tuple(r) for r in ChangeState(spark, str(tmp_path / "state")).table().collect()} == want and len(again.log.numbers()) < 2


def test_update_of_a_graph(spark):
    texts = lambda **files: spark.createDataFrame([(f"{k}.py", v) for k, v in files.items()], "path string, text string")
    events = lambda *rows: spark.createDataFrame(rows, "path string, removed boolean, seq long")
    g = graph(spark, m="def alpha():\n    pass\n", use="import m\n\n\ndef go():\n    alpha()\n    beta()\n", same="def keep():\n    pass\n")
    assert ("use.py::use.go", "m.py::m.alpha", "calls") in {tuple(r) for r in g.edges.collect()}
    now = texts(m="def beta():\n    pass\n", use="import m\n\n\ndef go():\n    alpha()\n    beta()\n", same="def keep():\n    pass\n")
    h = g.updated(now, events(("m.py", True, 1), ("m.py", False, 2), ("same.py", False, 3)))
    names = {r.name for r in h.nodes.where("kind <> 'file'").collect()}
    assert names == {"beta", "go", "keep"}
    calls = {(r.src_id, r.dst_id) for r in h.edges.where("kind = 'calls'").collect()}
    assert ("use.py::use.go", "m.py::m.beta") in calls and ("use.py::use.go", "m.py::m.alpha") not in calls
    broken = h.updated(texts(m="def beta(:\n"), events(("m.py", False, 4)))
    assert {r.name for r in broken.nodes.where("kind <> 'file'").collect()} == names
    gone = broken.updated(texts(), events(("m.py", True, 5), ("use.py", True, 6), ("same.py", True, 7), (None, True, 8)))
    assert gone.nodes.count() == 0 and gone.edges.count() == 0 and gone.hashes.count() == 0


def test_older_table_is_migrated(spark):
    old = spark.createDataFrame([("a.py::f", "function", "f", "a.f", "a.py", "python", "f()", 1)], "id string, kind string, name string, qualified_name string, path string, language string, signature string, indexed_at int")
    row = S.upsert_nodes(S.migrated(old)).first()
    assert row.docstring == "" and row.start_line is None and row.signature == "f()"


def test_vector_table(spark, tmp_path):
    from arborine.operators.vectors import VectorTable

    rows = lambda *r: spark.createDataFrame(r, "id string, path string, text string, vector array<double>")
    held = VectorTable(spark, str(tmp_path / "v"), 2)
    query = spark.createDataFrame([("q", [0.0, 0.0])], "id string, vector array<double>")
    assert held.read().count() == 0 and held.search(query).count() == 0
    held.upsert(rows(("a", "x", "t", [0.0, 1.0]), ("b", "x", "t", [0.0, 2.0]), ("c", "it's", "t", [0.0, 3.0]), (None, "x", "t", [0.0, 0.0]), ("d", None, "t", [0.0, 0.0])))
    held.upsert(rows(("e", "x", "t", [0.0, 5.0]), ("e", "x", "u", [0.0, 4.0])))
    assert {(r.id, tuple(r.vector)) for r in held.read().collect()} == {("c", (0.0, 3.0)), ("e", (0.0, 4.0))}
    assert [r.id for r in held.search(query, 1).collect()] == ["c"] and [r.id for r in held.search(query, 1, "path = 'x'").collect()] == ["e"]
    held.delete(spark.createDataFrame([("it's",)], "path string"))
    assert column(VectorTable(spark, str(tmp_path / "v"), 2).read(), "id") == {"e"}
    with pytest.raises(Exception, match="has not 2 numbers"):
        held.upsert(rows(("z", "z", "t", [1.0])))


def test_indexed_search(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 1) for x in centres[0 if i % 3 else rng.randrange(6)]]) for i in range(1500)] + [(1500, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = vectors.where("id % 50 = 0")
    exact = V.knn(vectors, queries, 5)
    found = V.knn_indexed(vectors, queries, 5, block=64)
    assert V.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9 and found.where("rank > 5").isEmpty()
    assert V.knn_indexed(vectors.limit(0), queries, 5).count() == 0
    few = V.knn_indexed(vectors.where("id < 3"), vectors.where("id < 3"), 5, target=1.0)
    assert sorted(map(tuple, few.select("query_id", "id", "rank").collect())) == sorted(map(tuple, V.knn(vectors.where("id < 3"), vectors.where("id < 3"), 5).select("query_id", "id", "rank").collect()))


def test_other_embedders(spark):
    from arborine.functions.embedding import null_embedder

    g = graph(spark, zoo=ZOO)
    lengths = lambda text: F.array(F.length(text).cast("double"), F.lit(1.0))
    assert {len(r.vector) for r in V.symbol_vectors(g.nodes, null_embedder(3)).collect()} == {3}
    prompts = spark.createDataFrame([("p", "main()")], "prompt_id string, prompt string")
    got = V.prune_context(g.nodes, g.edges, V.symbol_vectors(g.nodes, lengths), prompts, top_k=1, embedder=lengths, search=V.knn_indexed)
    assert "main" in {r.name for r in got.where("rank = 1").collect()} or got.count() > 0


def test_python_that_does_not_parse():
    text = '"""\ndef not_this(): pass\n"""\nimport os\nfrom .a import b\nclass A(B, k.C):\n    def f(self, x=(1,\n            2)):\n        return (\n\ndef g(y):\n    return 1\n'
    language, symbols, edges, error = parse_text("m.py", text)
    assert error and [(s[1], s[3], s[4], s[6]) for s in symbols[1:]] == [("class", "m.A", "", 6), ("method", "m.A.f", "f(self, x=(1,\n            2))", 7), ("function", "m.g", "g(y)", 11)]
    assert {("m.py", "os", "imports"), ("m.py", ".a", "imports"), ("m.py::m.A", "B", "inherits"), ("m.py::m.A", "C", "inherits")} <= set(edges)


def test_search_and_context(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.5] * 4), (62, [0.5] * 4)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in V.knn(vectors, vectors.where("id % 20 = 1"), 5).collect()}
    known = [(i, v) for i, v in rows if v]
    for q, v in known:
        if q % 20 == 1:
            near = sorted(known, key=lambda x: (round(sum((a - b) ** 2 for a, b in zip(x[1], v)), 9), x[0]))[:5]
            assert [got[q, k] for k in range(1, 6)] == [x[0] for x in near]
    g = graph(spark, zoo=ZOO)
    context = g.prune_context("dog bark", token_budget=12, top_k=3).orderBy("rank").collect()
    assert "bark" in {r.name for r in context} and context[-1].total <= 12
    assert g.prune_context("dog bark", token_budget=0).count() == 1
    assert {(r.path, r.name) for r in [*g.nodes.join(g.analyze_impacted_symbols("zoo.py").select("id"), "id").collect()]} == {("zoo.py", n) for n in ("Animal", "speak", "Dog", "bark", "noise", "woof", "main")}
    assert g.search_architecture_graph("woof").count() > 3


def test_long_and_repeated_prompts(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = graph(spark, zoo=ZOO)
    prompts = ["dog bark", "dog bark", "woof\0", "noise main " * 20_000]
    rows = lambda *asked: sorted(map(tuple, g.prune_context(*asked, token_budget=30, top_k=3).collect()))
    got = rows(*prompts)
    assert {r[0] for r in got} == set(prompts) and got == sorted(r for p in set(prompts) for r in rows(p))
    ids, points = pa.array(["x" * 20_000, *map(str, range(2047))]), np.random.default_rng(0).random((2048, 8))
    tracemalloc.start()
    best, _ = V._nearest(ids.slice(0, 64), points[:64], ids, V._places(ids), points, 5, np.full((64, 5), np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.num_rows == 320 and peak < 20e6


def test_hubs_are_cut_where_no_context_reaches(spark):
    ids = [f"n{i:03}" for i in range(300)]
    nodes = spark.createDataFrame([(i, i, "p", "s" * (1 + 4 * n % 37)) for n, i in enumerate(ids)], "id string, name string, path string, signature string")
    links = [(i, "n007", "calls") for i in ids] + [("n007", i, "imports") for i in ids[:40]] + [("n020", i, "calls") for i in ids[100:]] + [("n020", f"out{i}", "calls") for i in range(9)]
    edges = spark.createDataFrame(links, "src_id string, dst_id string, kind string")
    vectors = spark.createDataFrame([(i, [float(n)]) for n, i in enumerate(ids)], "id string, vector array<double>")
    lengths = lambda text: F.array(F.length(text).cast("double"))
    prompts = spark.createDataFrame([("a", "x" * 7), ("b", "x" * 18), ("c", "x" * 400)], "prompt_id string, prompt string")
    found = lambda budget: sorted(map(tuple, V.prune_context(nodes, edges, vectors, prompts, budget, 5, lengths).select("prompt_id", "rank", "id", "cost", "total").collect()))
    whole = found(10**6)
    assert len(whole) > 500
    for budget in (0, 200):
        assert found(budget) == [r for r in whole if r[1] == 1 or r[4] <= budget]
    seeds = spark.createDataFrame([("a", "n007", 1.0), ("a", "n003", 0.1)], "prompt_id string, id string, score double")
    pool = V.expand(seeds, edges, nodes.select("id", F.lit(2).cast("long").alias("cost")), 40, Scratch(spark, "test")).collect()
    assert 20 <= len(pool) < 40 and {(r.id, r.score, r.is_seed) for r in pool} >= {("n007", 1.0, True), ("n003", 0.1, True), ("n000", 0.25, False)}
    far = V.sieve(spark.createDataFrame([("n007",), ("n020",)], "id string"), "id")
    assert {r.id for r in nodes.where(far(F.col("id"))).collect()} == {"n007", "n020"}


def test_every_id_is_expanded_along_every_kind(spark, tmp_path):
    from arborine.plans.core import QUERIES

    stamp = F.lit("2025-01-01").cast("timestamp_ntz")
    ids = [f"a.py::f{i}" for i in range(30)]
    links = [("a.py", i, "defines") for i in ids] + [(i, "hub", "calls") for i in ids] + [(ids[0], ids[1], "inherits"), (ids[1], ids[0], "calls"), (ids[2], ids[2], "calls"), ("a.py", "json", "imports"), ("nowhere", ids[3], "calls"), (ids[0], "hub", "inherits")]
    rows = spark.createDataFrame([("a.py", "file"), *((i, "function") for i in ids)], "id string, kind string").withColumns({c: F.lit("") for c in ("name", "qualified_name", "language", "signature", "docstring")})
    rows.withColumns({"path": F.lit("a.py"), "start_line": F.lit(1), "end_line": F.lit(2), "indexed_at": stamp}).write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame(links, "src_id string, dst_id string, kind string").withColumn("indexed_at", stamp).write.parquet(f"{tmp_path}/edges.parquet")
    real = {(a, b) for a, b, _ in links if a != "nowhere" and a != b}
    got = [tuple(r) for r in QUERIES["graph_expand_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((a, b, 1) for a, b in real | {(b, a) for a, b in real})


def test_prune_context_reads_prompts_whole(spark, tmp_path):
    from arborine.plans.core import QUERIES

    def embedded(text):
        v = [0.0] * 384
        for token in re.findall("[A-Za-z0-9]+", text or ""):
            for feature in token_features(token):
                value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
                v[value % 384] += 1.0 if value >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    rng = random.Random(5)
    words = ["walrus", "heron", "otter", "lynx", "gecko", "tapir", "ibex", "newt"]
    symbols = [(f"m{i}.py::f{i:02}", "function", f"f{i:02}", f"m{i}.f{i:02}", f"m{i}.py", "def " + "_".join(rng.choices(words, k=3)) + f"_{i}()") for i in range(60)]
    links = [(rng.choice(symbols)[0], rng.choice([*(s[0] for s in symbols), "outside"]), "calls") for _ in range(90)]
    far = "The first line says nothing of it. " * 8 + "\n\n" + "heron otter gecko " * 9
    prompts = {0: (far, None), 50: ("import tapir\nnewt_lynx = ibex()\n" * 3, "a/b.py"), 100: (None, None), 150: ("", "c.py"), 200: ("walrus walrus", None), 250: (" \n lynx", "d.py"), 251: ("heron", None)}
    stamp = F.lit("2025-01-01").cast("timestamp_ntz")
    rows = spark.createDataFrame(symbols, "id string, kind string, name string, qualified_name string, path string, signature string")
    rows = rows.withColumns({"language": F.lit("python"), "docstring": F.lit(""), "start_line": F.lit(1), "end_line": F.lit(2), "indexed_at": stamp})
    rows.write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame(links, "src_id string, dst_id string, kind string").withColumn("indexed_at", stamp).write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(i, t, p) for i, (t, p) in prompts.items()], "doc_id long, text string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors, want = {s[0]: embedded(s[5]) for s in symbols}, set()
    for i, (text, _) in prompts.items():
        if i % 50:
            continue
        q = embedded(text)
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(q, v)), 9), k) for k, v in vectors.items())[:20]
        found = {k: 1 / (1 + x) for x, k in near}
        more = {b for a, b, _ in links if a in found} | {a for a, b, _ in links if b in found}
        want |= {(str(i), k, round(x, 6)) for k, x in found.items()} | {(str(i), k, 0.25) for k in more - set(found)}
    got = QUERIES["prune_context"](spark, str(tmp_path)).collect()
    assert {(r.prompt_id, r.id, r.score) for r in got} == want and len(got) == len(want)
    ranks = {p: sorted(r["rank"] for r in got if r.prompt_id == p) for p in {r.prompt_id for r in got}}
    assert ranks.keys() == {"0", "50", "100", "150", "200", "250"} and all(x == list(range(1, len(x) + 1)) for x in ranks.values())


def test_read_symbol_takes_the_newest_text(spark):
    from arborine.operators.lookup import read_symbol

    nodes = spark.createDataFrame([("a", "function", "p", 2, 2), ("b", "function", "none", 1, 1), ("f", "file", "p", 1, 2)], "id string, kind string, path string, start_line long, end_line long")
    texts = spark.createDataFrame([("p", "z\nold", 1), ("p", "a\nnew", 2), ("p", None, 3), (None, "x", 1)], "path string, text string, at int")
    assert {tuple(r) for r in read_symbol(nodes, texts, "at").collect()} == {("a", "p", "new"), ("b", "none", "")}


def test_changed_paths_seed_the_reach(spark, tmp_path):
    from arborine.plans.core import QUERIES

    rng = random.Random(7)
    stamp = F.lit("2025-01-01").cast("timestamp_ntz")
    files = [f"d{i}.py" for i in range(24)]
    symbols = [(p, "file", p, p[:-3], p) for p in files] + [(f"{p}::{k}{j}", k, f"{k}{j}", f"{p[:-3]}.{k}{j}", p) for p in files for j, k in enumerate(("class", "function", "method"))]
    inner = [s[0] for s in symbols if s[1] != "file"]
    links = [(rng.choice(files), rng.choice(files), "imports") for _ in range(40)] + [(rng.choice(inner), rng.choice(inner), rng.choice(("calls", "inherits"))) for _ in range(90)]
    changed = [*files[:20], files[0], "gone.py", None]
    rows = spark.createDataFrame(symbols, "id string, kind string, name string, qualified_name string, path string").withColumns({c: F.lit("") for c in ("language", "signature", "docstring")})
    rows.withColumns({"start_line": F.lit(1), "end_line": F.lit(2), "indexed_at": stamp}).write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame(links, "src_id string, dst_id string, kind string").withColumn("indexed_at", stamp).write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(p, False, i) for i, p in enumerate(changed)], "path string, removed boolean, seq long").write.parquet(f"{tmp_path}/file_changes.parquet")

    def reach(seeds, kinds, depth):
        out = set()
        for seed in seeds:
            seen = {seed}
            for k in range(1, depth + 1):
                new = {a for a, b, kind in links if kind in kinds and b in seen} - seen
                out |= {(seed, a, k) for a in new}
                seen |= new
        return out

    defined = {(s[4], s[0], s[3]) for s in symbols if s[1] != "file" and s[4] in changed}
    assert {tuple(r) for r in QUERIES["impacted_symbols"](spark, str(tmp_path)).collect()} == defined and len(defined) == 60
    got = [(r.seed, r.id, r.depth) for r in QUERIES["changed_files_reach"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(reach({p for p in changed if p}, ("imports",), 3))
    got = [(r.seed, r.id, r.depth) for r in QUERIES["changed_symbols_reach"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(reach({i for _, i, _ in defined}, ("calls", "inherits"), 4))


@pytest.mark.parametrize("budget", [1, 5, 17, 1000])
def test_budget_prefix(spark, budget):
    costs = [3, 4, 1, 9, 2]
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate(costs)], "g string, i int, cost int")
    kept, total = [], 0
    for i, c in enumerate(costs):
        if kept and total + c > budget:
            break
        kept.append(i)
        total += c
    assert [r.i for r in V.budget_prefix(df, "g", ["i"], "cost", budget).orderBy("i").collect()] == kept


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 10.0), ("c", None)], "g string, v double")
    assert {tuple(r) for r in M.percentiles(df, "g", "v").collect()} == {("a", 2.5, 3.85), ("b", 10.0, 10.0), ("c", 0.0, 0.0)}
    rows = spark.createDataFrame([("g", i) for i in range(101)], "g string, i int")
    sample = sorted(r[0] for r in M.stride_sample(rows.withColumnRenamed("i", "x"), "g", "x", 10).select("x").collect())
    assert sample == [int(k * 101 / 10) for k in range(10)]
    assert M.stride_sample(rows.withColumnRenamed("i", "x"), "g", "x", 0).count() == 101
    both = spark.createDataFrame([(10.0, 2.0), (9.0, 3.0), (0.0, 1.0)], "baseline double, returned double")
    assert tuple(M.token_reduction(both).first()) == (4.0, 4.0)
