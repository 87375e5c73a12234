"""Hierarchies, orphan references and skewed counts against brute force and in the odd cases."""

import datetime as dt
import random

import pytest

from arborine.operators import skew
from arborine.operators.hierarchy import ancestors, full_paths, hierarchy, links
from arborine.operators.orphans import orphan_references, orphan_report
from arborine.operators.skew import dependents, join_skewed, refreshed_hubs

T0 = dt.datetime(2025, 1, 1)
EDGES = "edge_id long, src_id string, dst_id string, kind string, weight double, indexed_at timestamp_ntz, parent string, h string"
SYMBOLS = "id string, path string, kind string, indexed_at timestamp_ntz, born string, key string"
CHANGES = "path string, removed boolean, seq long, gone string"


def brute(pairs):
    """Root and depth by walking every node up."""
    parent = {}
    for k, c, p in pairs:
        if None not in (k, c, p):
            parent[k, c] = min(p, parent.get((k, c), p))
    ids = {(k, c) for k, c in parent} | {(k, p) for (k, _), p in parent.items()} | {(k, p) for k, c, p in pairs if None not in (k, c, p)}
    out = set()
    for k, n in ids:
        seen, at = [], n
        while (k, at) in parent and at not in seen:
            seen.append(at)
            at = parent[k, at]
        if (k, at) in parent:
            out.add((k, n, min(seen[seen.index(at) :]), -1))
        else:
            out.add((k, n, at, len(seen)))
    return out


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed,every", [(1, 4), (2, 3)])
def test_hierarchy_of_random_graphs(spark, seed, every):
    rng = random.Random(seed)
    pairs = [("defines", f"n{i}", f"n{rng.randrange(160)}") for i in rng.sample(range(160), 130)]
    pairs += [("inherits", f"c{i}", f"c{i + 1}") for i in range(60)]
    pairs += [("loop", "a", "a"), ("loop", "b", "c"), ("loop", "c", "b"), ("loop", "t", "b"), ("loop", "u", "t"), *[("loop", f"r{i}", f"r{(i + 1) % 8}") for i in range(8)]]
    rows = spark.createDataFrame(pairs, "kind string, child string, parent string")
    assert as_set(hierarchy(rows, every)) == brute(pairs)


def test_hierarchy_odd_rows(spark):
    long = "p/" + "x" * 50_000
    pairs = [("k", "a", "b"), ("k", "a", "b"), ("k", "a", "c"), ("k", None, "b"), ("k", "d", None), (None, "e", "f"), ("k", "", "b"), ("k", long, "")]
    rows = spark.createDataFrame([(*p, "x", 1) for p in pairs], "kind string, child string, parent string, h string, depth int")
    assert as_set(hierarchy(rows)) == brute(pairs)
    assert hierarchy(rows.limit(0)).count() == 0
    assert ancestors(rows.limit(0)).count() == 0


def test_links_ancestors_and_paths(spark):
    edges = spark.createDataFrame(
        [(1, "f/a", "f/a::C", "defines", 1.0, T0, "", ""), (2, "f/a::C", "f/a::C.m", "defines", 1.0, T0, "", ""), (3, "f/a::C", "f/b::B", "inherits", 1.0, T0, "", ""), (4, "f/a::C", "Bare", "inherits", 1.0, T0, "", ""), (5, "x", None, "defines", None, None, "", ""), (6, "f/a", "f/z", "imports", 1.0, T0, "", "")],
        EDGES,
    )
    rows = links(edges)
    assert as_set(rows) == {("defines", "f/a::C", "f/a"), ("defines", "f/a::C.m", "f/a::C"), ("inherits", "f/a::C", "f/b::B")}
    assert as_set(ancestors(rows)) == {("defines", "f/a", "f/a::C", 1), ("defines", "f/a::C", "f/a::C.m", 1), ("defines", "f/a", "f/a::C.m", 2), ("inherits", "f/b::B", "f/a::C", 1)}
    assert ("defines", "f/a::C.m", 2, "f/a > f/a::C > f/a::C.m") in as_set(full_paths(rows))
    ring = spark.createDataFrame([("k", "a", "b"), ("k", "b", "a"), ("k", "c", "a")], "kind string, child string, parent string")
    assert as_set(full_paths(ring)) == {("k", n, -1, None) for n in "abc"}
    assert ancestors(ring).count() == 0


def test_skewed_paths_agree(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 0)  # heavy keys are looked for in any table
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.2)
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(50)] + [(None, -1)], "k string, v int")
    dim = spark.createDataFrame([("hot", 1), ("k2", 2), ("zz", 3)], "k string, w int")
    for how in ("left", "inner"):
        assert sorted(map(str, join_skewed(rows, dim, "k", 51, how).collect())) == sorted(map(str, rows.join(dim, "k", how).collect()))


def _orphans(spark, edges, symbols, changes):
    return orphan_references(spark.createDataFrame(edges, EDGES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(changes, CHANGES))


def test_orphans(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    e = lambda i, dst, n: (i, "s/x", dst, "calls", None, None if n is None else day(n), "", "")
    symbols = [("a/b::f", "a/b", "function", day(5), "", ""), ("a/b::f", "a/b", "function", day(2), "", ""), ("a/b::f", None, None, day(0), "", ""), ("a/c::g", "a/c", "function", day(0), "", ""), ("p/q::ph", None, None, day(0), "", ""), (None, "a/b", None, None, None, None)]
    changes = [("a/c", False, 9, ""), ("a/c", True, 10, ""), ("a/c", True, 10, ""), ("a/b", True, 1, ""), ("a/b", False, 2, ""), ("a/b", True, None, ""), (None, True, 99, "")]
    edges = [e(1, "a/b::f", 3), e(2, "a/b::f", 1), e(3, "a/b::f", None), e(4, "a/c::g", 3), e(5, "p/q::ph", 3), e(6, "no/where", 3), e(7, "bare", 3), e(8, None, 3), e(6, "no/where", 3)]
    got = sorted((r.edge_id, r.reason) for r in _orphans(spark, edges, symbols, changes).collect())
    assert got == [(2, "late"), (4, "deleted"), (5, "missing"), (6, "missing"), (6, "missing")]
    report = orphan_report(spark.createDataFrame(edges, EDGES), _orphans(spark, edges, symbols, changes))
    assert {tuple(r) for r in report.collect()} == {("calls", "2025-01", "late", 1, 6), ("calls", "2025-01", "deleted", 1, 6), ("calls", "2025-01", "missing", 3, 6)}


def test_orphans_of_empty_tables(spark):
    e = [(1, "s/x", "a/b", None, None, None, None, None)]
    assert [(r.edge_id, r.kind, r.reason) for r in _orphans(spark, e, [], []).collect()] == [(1, None, "missing")]
    assert _orphans(spark, [], [], []).count() == 0


def test_dependents(spark):
    rows = [(i, f"s{i % 7}", "hot", "calls", None, T0, "", "") for i in range(200)] + [(900 + i, f"s{i}", f"d{i % 3}", "calls", None, T0, "", "") for i in range(30)]
    rows += [(999, None, "nobody", "calls", None, T0, "", ""), (1000, "s1", None, "calls", None, T0, "", ""), (1001, "s1", "", "calls", None, T0, "", "")]
    df = spark.createDataFrame(rows, EDGES).withColumnRenamed("h", "_salt")
    want = {}
    for r in rows:
        if r[2] is not None:
            want.setdefault(r[2], set()).update({r[1]} - {None})
    assert dict(map(tuple, dependents(df).collect())) == {k: len(v) for k, v in want.items()}
    assert dict(map(tuple, dependents(df, share=0.02).collect())) == {k: len(want[k]) for k in ("hot", "d0", "d1", "d2")}
    assert dependents(df.limit(0)).count() == 0 and dependents(df.limit(0), share=0.01).count() == 0


def test_refreshed_hubs(spark):
    edges = spark.createDataFrame([(1, "a", "x.py", "imports", 1.0, T0, "", ""), (2, "b", "x.py", "imports", 1.0, T0, "", "")], EDGES)
    hubs = spark.createDataFrame([("x.py", 9), ("x.py", None), ("gone.py", None), (None, 3)], "path string, dependents long")
    symbols = spark.createDataFrame([("x.py", "x.py", "file", T0, "", "")], SYMBOLS)
    assert as_set(refreshed_hubs(edges, hubs, symbols)) == {("x.py", 2, 9, True), ("gone.py", 0, -1, False)}


def test_a_big_tree_on_one_cycle(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 0)
    ring = [("defines", f"r{(i + 1) % 3}", f"r{i}") for i in range(3)]
    tree = [("defines", f"n{i}", f"n{(i - 1) // 2}" if i else "r0") for i in range(300)] + [("defines", f"leaf{i}", "n0") for i in range(300)]
    rows = spark.createDataFrame(ring + tree, "kind string, child string, parent string")
    got = hierarchy(rows).collect()
    assert len(got) == 603 and {(r.root_id, r.depth) for r in got} == {("r0", -1)}


def test_both_sides_of_a_join_repeat_a_heavy_key(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), (None, 1)], "k string, x int")
    many = spark.createDataFrame([("a", f"v{i}") for i in range(200)] + [("b", "w"), (None, "z")], "k string, v string")
    got = skew.meet_spread(rows, skew.spread(many, "k", "v", ["a"]), "k", ["a"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(many, "k").collect())) and got.count() == 1001
