"""Parent-child rows to full hierarchies: root, depth, path and descendants, with cycles told apart.

Method. Every node has at most one parent, so the rows form a pointer graph. A fixed hash
picks about one node in ``every`` as a splitter. Each node is walked to its next splitter (or
its root); the walk doubles its stride each round but never passes a splitter, so it takes
about log2(every * ln n) rounds however deep the trees are. The splitters alone form a
reduced pointer graph, which is solved the same way; then every node's steps are the steps to
its splitter plus those of the splitter. A walk also carries the least node of its last
stride: if that of a node equals that of the node it stands on, it was met twice, so the walk is
in a cycle. That ends cycles without a splitter during the first walk and all others in the
reduced graph. Nodes travel as 64-bit hashes; a check for collisions picks another seed if
one occurs, and the names join at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborine.operators.skew import join_skewed
from arborine.sources.scratch import Scratch

ACTIVE, DONE, CYCLE = 0, 1, 2


def links(edges: DataFrame, defines: str = "defines", inherits: str = "inherits") -> DataFrame:
    """(kind, child, parent) of the edges that make hierarchies.

    Counted are edges of the two kinds whose ``dst_id`` contains ``/``; in ``defines`` the parent
    is ``src_id``, in ``inherits`` it is ``dst_id``. Null ends and null kinds make no link.
    """
    down = F.col("kind") == defines
    return edges.where(F.col("kind").isin(defines, inherits) & F.col("dst_id").contains("/") & F.col("src_id").isNotNull()).select(
        "kind", F.when(down, F.col("dst_id")).otherwise(F.col("src_id")).alias("child"), F.when(down, F.col("src_id")).otherwise(F.col("dst_id")).alias("parent")
    )


def _hash(kind: Column, node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), kind, node)


def _nodes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, id, h, ph): every id at either end of a link once; ph is null at a root.

    A child with several parents keeps the smallest by bytes.
    """
    ends = rows.select("kind", F.col("child").alias("id"), "parent").unionByName(rows.select("kind", F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))
    ids = ends.groupBy("kind", "id").agg(F.min("parent").alias("parent"))
    for seed in range(8):
        hashed = ids.select("kind", "id", _hash(F.col("kind"), F.col("id"), seed).alias("h"), F.when(F.col("parent").isNotNull(), _hash(F.col("kind"), F.col("parent"), seed)).alias("ph"))
        saved = scratch.save(hashed, "nodes")
        if saved.groupBy("h").count().where("count > 1").isEmpty():
            return saved
        scratch.drop(saved)
    raise RuntimeError("the ids collide under every seed")


def _double(ptr: DataFrame, scratch: Scratch, stop: Column, paths: bool) -> DataFrame:
    """Follow the pointers of ``ptr`` (h, at, d, m, state[, p]) until none is active.

    ``at`` is where the walk of ``h`` stands after ``d`` steps, ``m`` the least node of its last
    stride, or in a cycle the cycle's least node. A walk ends where ``stop``, a condition on
    ``at``, holds, at a root (whose ``d`` is 0) and in a cycle.
    """
    while True:
        n_active = ptr.where(F.col("state") == ACTIVE).count()
        if not n_active:
            return ptr
        active = ptr.where(F.col("state") == ACTIVE).withColumnRenamed("at", "via")
        ahead = ptr.select(F.col("h").alias("via"), F.col("at").alias("at2"), F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("state").alias("s2"), *([F.col("p").alias("p2")] if paths else []))
        met = join_skewed(active, ahead, "via", n_active, "inner")
        root = F.col("d2") == 0
        at = F.when(root, F.col("via")).otherwise(F.col("at2"))
        circle = (F.col("s2") == CYCLE) | (~root & (F.col("m") == F.col("m2")))
        moved = met.select(
            "h", at.alias("at"),
            F.when(root, F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"),
            F.when(F.col("s2") == CYCLE, F.col("m2")).when(root, F.col("m")).otherwise(F.least("m", "m2")).alias("m"),
            F.when(circle, CYCLE).when(root | (F.col("s2") == DONE) | stop, DONE).otherwise(ACTIVE).alias("state"),
            *([F.when(circle, F.array().cast("array<bigint>")).when(root, F.col("p")).otherwise(F.concat("p", "p2")).alias("p")] if paths else []),
        )
        after = scratch.save(ptr.where(F.col("state") != ACTIVE).unionByName(moved), "walk")
        scratch.drop(ptr)
        ptr = after


def _cycle_roots(nodes: DataFrame, circular: DataFrame, scratch: Scratch) -> DataFrame:
    """(m, root_id): the smallest id by bytes on each cycle, by the cycle's least hash ``m``.

    ``circular`` has (h, m) of nodes on a cycle or leading into one. Squaring their pointers until
    the set of targets stays equal leaves exactly the nodes on cycles as targets. A big tree that hangs on one cycle
    puts its rows on few targets, so the joins are those for heavy keys.
    """
    jump = scratch.save(circular.join(nodes.select("h", F.col("ph").alias("at")), "h").select("h", "at", "m"), "cycle")
    n_rows, size = jump.count(), jump.select("at").distinct().count()
    while True:
        twice = join_skewed(jump.select("h", "m", F.col("at").alias("via")), jump.select(F.col("h").alias("via"), "at"), "via", n_rows, "inner").select("h", "at", "m")
        twice = scratch.save(twice, "cycle")
        scratch.drop(jump)
        jump, before = twice, size
        size = jump.select("at").distinct().count()
        if size == before:
            break
    on = jump.groupBy(F.col("at").alias("h")).agg(F.min("m").alias("m"))
    return on.join(nodes.select("h", "id"), "h").groupBy("m").agg(F.min("id").alias("root_id"))


def solve(rows: DataFrame, every: int = 4, paths: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """Solve the hierarchies of ``rows`` (kind, child, parent).

    Returns the nodes (kind, id, h, ph) and (h, root, m, depth[, p]): in a tree ``root`` is the
    root's hash and ``p`` the ancestors from the parent up; in or behind a cycle ``depth`` is -1 and
    ``m`` names the cycle.
    """
    scratch = Scratch(rows.sparkSession, "hierarchy")
    nodes = _nodes(rows.where("kind is not null and child is not null and parent is not null"), scratch)
    splitter = lambda c: F.pmod(F.col(c), F.lit(every)) == 0
    start = nodes.select(
        "h", F.coalesce("ph", "h").alias("at"), F.when(F.col("ph").isNull(), 0).otherwise(1).cast("long").alias("d"), F.coalesce("ph", "h").alias("m"),
        F.when(F.col("ph").isNull() | splitter("ph"), DONE).otherwise(ACTIVE).alias("state"),
        *([F.when(F.col("ph").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("ph")).alias("p")] if paths else []),
    )
    walked = _double(scratch.save(start, "walk"), scratch, splitter("at2"), paths)
    root = F.col("d") == 0
    reduced = walked.where(splitter("h") | root).withColumn("state", F.when(root, DONE).when(F.col("state") == CYCLE, CYCLE).otherwise(ACTIVE))
    solved = _double(scratch.save(reduced, "reduced"), scratch, F.lit(False), paths)
    over = solved.select(F.col("h").alias("at"), F.col("at").alias("root"), F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("state").alias("s2"), *([F.col("p").alias("p2")] if paths else []))
    ended = walked.where(F.col("state") == DONE)
    met = join_skewed(ended, over, "at", ended.count(), "left").select(
        "h", F.coalesce("root", "at").alias("root"), F.when(F.col("s2") == CYCLE, F.col("m2")).alias("m"),
        F.when(F.col("s2") == CYCLE, -1).otherwise(F.col("d") + F.coalesce("d2", F.lit(0))).cast("long").alias("depth"),
        *([F.concat("p", F.coalesce("p2", F.array().cast("array<bigint>"))).alias("p")] if paths else []),
    )
    caught = walked.where(F.col("state") == CYCLE).select("h", F.col("at").alias("root"), "m", F.lit(-1).cast("long").alias("depth"), *(["p"] if paths else []))
    result = scratch.save(met.unionByName(caught), "solved")
    scratch.drop(walked, solved)
    return nodes, result, scratch


def hierarchy(rows: DataFrame, every: int = 4) -> DataFrame:
    """(kind, node_id, root_id, depth) of every id in ``rows`` (kind, child, parent).

    A root is its own root at depth 0. On a cycle, or where the ancestors lead into one,
    ``depth`` is -1 and ``root_id`` the smallest id by bytes on the cycle. Repeated links count once, a
    child with several parents keeps the smallest by bytes, links with a null are left out, an empty
    table gives no rows; ids are compared as written, so empty and very long ids are ids.
    Further columns are ignored.
    """
    nodes, solved, scratch = solve(rows, every)
    names = nodes.where(F.col("ph").isNull()).select(F.col("h").alias("root"), F.col("id").alias("root_id"))
    tree = solved.where(F.col("depth") >= 0).select("h", "root", "depth")
    named = join_skewed(tree, names, "root", tree.count(), "inner").select("h", "root_id", "depth")
    circular = solved.where(F.col("depth") < 0).select("h", "m")
    if not circular.isEmpty():
        roots = _cycle_roots(nodes, circular, scratch)
        named = named.unionByName(join_skewed(circular, roots, "m", circular.count(), "inner").select("h", "root_id", F.lit(-1).cast("long").alias("depth")))
    return nodes.select("kind", F.col("id").alias("node_id"), "h").join(named, "h").select("kind", "node_id", "root_id", "depth")


def ancestors(rows: DataFrame, every: int = 4) -> DataFrame:
    """(kind, ancestor_id, node_id, distance): each node of a tree with each of its ancestors.

    Read by ``ancestor_id`` it lists all descendants. The rows are as many as the depths add up to;
    nodes on or behind a cycle have none. Nulls, repeats and ties as in ``hierarchy``.
    """
    nodes, solved, _ = solve(rows, every, paths=True)
    up = solved.where(F.col("depth") > 0).select("h", F.posexplode("p").alias("i", "a"))
    names = nodes.select(F.col("h").alias("a"), F.col("id").alias("ancestor_id"))
    named = join_skewed(up, names, "a", up.count(), "inner")
    return named.join(nodes.select("kind", F.col("id").alias("node_id"), "h"), "h").select("kind", "ancestor_id", "node_id", (F.col("i") + 1).cast("long").alias("distance"))


def full_paths(rows: DataFrame, every: int = 4, sep: str = " > ") -> DataFrame:
    """(kind, node_id, depth, path): the ids from the root to the node, joined by ``sep``.

    Roots have their own id as path; nodes on or behind a cycle have depth -1 and a null path.
    """
    nodes, solved, _ = solve(rows, every, paths=True)
    up = solved.where(F.col("depth") > 0).select("h", F.posexplode("p").alias("i", "a"))
    names = nodes.select(F.col("h").alias("a"), F.col("id").alias("name"))
    above = join_skewed(up, names, "a", up.count(), "inner").groupBy("h").agg(F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("k"), "name"))).alias("up"))
    shown = nodes.join(solved.select("h", "depth"), "h").join(above, "h", "left")
    parts = F.concat(F.coalesce(F.col("up.name"), F.array().cast("array<string>")), F.array("id"))
    return shown.select("kind", F.col("id").alias("node_id"), "depth", F.when(F.col("depth") >= 0, F.array_join(parts, sep)).alias("path"))
