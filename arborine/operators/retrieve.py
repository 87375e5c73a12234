"""Vector search and context retrieval for many prompts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arborine.functions.embedding import DIM, hashing_embedder, score
from arborine.functions.text import estimate_tokens
from arborine.operators.skew import ranked
from arborine.sources.scratch import Scratch

BLOCK = 2048
#: Queries that meet a block of vectors at once: all pairs may tie, so this bounds what a task holds.
ASKED = 512
#: Distances that a task of the exact search remembers, ``k`` a query; 8 bytes each.
LIMITS = 1_000_000
#: Vectors on which the cells of an index are fitted, and the greatest number of cells.
SAMPLE, CELLS = 32_768, 4_096
EXPANSION_SCORE = 0.25
#: Bits of a sieve, 8 MB, and of one row in which its parts reach the driver.
SIEVE, SIEVE_ROW = 1 << 26, 1 << 15


def _query_blocks(folder: str, kind: pa.DataType) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(place, ids, matrix) of each block of the query table in ``folder``, always in one order."""
    files = ds.dataset(folder, format="parquet")
    place = 0
    for path in sorted(files.files):
        with files.filesystem.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(ASKED, columns=["id", "vector"]):
                if len(batch):
                    yield place, batch.column(0).cast(kind), _matrix(batch.column(1))
                    place += len(batch)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order. Ids stay in Arrow: NumPy pads texts to the longest, at four bytes a character."""
    places = np.empty(len(ids), np.int64)
    places[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return places


def knn(vectors: DataFrame, queries: DataFrame, k: int = 20, where: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` vectors of least squared distance for every query, ties by id.

    Both sides are (id, vector) with vectors of one length; rows with a null vector are left out, and with ``where``, a condition on
    the columns of ``vectors``, all rows that do not satisfy it, before the search. The search is exact: the queries are
    written once and read block by block in every task, so vectors are neither packed nor copied; a block of queries meets a block of
    vectors as a matrix product and hands on only its best ``k`` of each query, less what earlier blocks of the task have beaten
    (which is remembered for the first ``LIMITS / k`` queries; the others hand on a little more). Cost grows with queries times vectors:
    ``knn_indexed`` is for query sets that grow with the table.
    """
    if where:
        vectors = vectors.where(where)
    vectors, queries = (x.where(F.col("vector").isNotNull()).select("id", "vector") for x in (vectors, queries))
    scratch = Scratch(vectors.sparkSession, "knn")
    folder = scratch.save(queries, "queries")._scratch_path
    kind = to_arrow_type(queries.schema["id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            ids, v = batch.column(0), _matrix(batch.column(1))
            places = _places(ids)
            for place, qids, q in _query_blocks(folder, kind):
                held = known.get(place)
                if held is None:
                    held = np.full((len(qids), k), np.inf)
                for at in range(0, len(ids), BLOCK):
                    best, held = _nearest(qids, q, ids.slice(at, BLOCK), places[at : at + BLOCK], v[at : at + BLOCK], k, held)
                    yield best
                if (place + len(qids)) * k <= LIMITS:
                    known[place] = held

    return _best(vectors.mapInArrow(search, _hit_schema(vectors, queries)), k)


def _hit_schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _nearest(qids: pa.Array, q: np.ndarray, ids: pa.Array, places: np.ndarray, v: np.ndarray, k: int, held: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The best ``k`` of one block for each query that are no worse than those ``held``, ties by ``places``, and the distances to hold then."""
    d, error = _rough_distances(q, v)
    error = error + 1e-8  # equal where distances are rounded
    limit = held.max(1, initial=0)
    if len(ids) > k and not np.isfinite(limit).all():
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + error)
    qi, vi = np.divmod(np.flatnonzero(d <= np.nextafter((limit + error).astype(d.dtype), d.dtype.type(np.inf))[:, None]), max(1, len(ids)))
    exact = np.concatenate([((v[vi[i : i + BLOCK]] - q[qi[i : i + BLOCK]]) ** 2).sum(1) for i in range(0, len(qi), BLOCK)] or [np.zeros(0)])
    order = np.lexsort((places[vi], exact.round(9), qi))
    qi, vi, exact = qi[order], vi[order], exact[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    best = rank < k
    found = np.full_like(held, np.inf)
    found[qi[best], rank[best]] = exact[best]
    held = np.sort(np.concatenate([held, found], axis=1), axis=1)[:, :k]
    return pa.RecordBatch.from_arrays([qids.take(pa.array(qi[best])), ids.take(pa.array(vi[best])), pa.array(exact[best])], ["query_id", "id", "distance"]), held


def _rough_distances(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances in single precision, or in double where that may overflow, and for each query more than their error."""
    qq, vv = (q * q).sum(1), (v * v).sum(1)
    most = vv.max(initial=0)
    kind = np.float32 if max(most, qq.max(initial=0)) < 1e30 else np.float64
    d = (-2 * q).astype(kind) @ v.astype(kind).T
    d += qq.astype(kind)[:, None]
    d += vv.astype(kind)[None, :]
    return d, 4 * (q.shape[1] + 8) * np.finfo(kind).eps * (qq + most)


def sampled(vectors: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """About ``sample`` vectors by a hash of the id, at most twice as many: the driver holds no more, however large the table."""
    taken = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0).select("vector").limit(2 * sample).toPandas()["vector"]
    return np.stack(taken.to_list()).astype(np.float64) if len(taken) else np.zeros((0, 1))


def fit_cells(points: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``cells`` cells by k-means on ``points``."""
    rng = np.random.default_rng(0)
    centres = points[rng.permutation(len(points))[: min(cells, len(points))]].copy()
    for _ in range(rounds if len(points) > len(centres) else 0):
        near = np.concatenate([_distances(points[i : i + BLOCK], centres).argmin(1) for i in range(0, len(points), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        held = np.bincount(near, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def needed_probes(points: np.ndarray, centres: np.ndarray, k: int, target: float, asked: int = 256) -> int:
    """Cells that a query must meet so that ``target`` of its ``k`` nearest are in them, measured on the sample.

    A sample's neighbours are farther than those of the whole table, so the number is rather too large.
    """
    near = np.concatenate([_distances(points[i : i + BLOCK], centres).argmin(1) for i in range(0, len(points), BLOCK)])
    q = points[np.random.default_rng(1).permutation(len(points))[:asked]]
    found = np.argsort(_distances(q, points), axis=1)[:, :k]
    order = np.argsort(np.argsort(_distances(q, centres), axis=1), axis=1)
    places = np.take_along_axis(order, near[found], axis=1)
    return int(np.quantile(places, target, method="higher")) + 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _cells(rows: DataFrame, centres: np.ndarray, nearest: int) -> DataFrame:
    """``rows`` (id, vector), each once for every one of its ``nearest`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                d = _distances(_matrix(part.column(1)), centres)
                near = np.argpartition(d, nearest - 1, axis=1)[:, :nearest] if nearest < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
                rows_at = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_at), part.column(1).take(rows_at), pa.array(near.ravel().astype(np.int32))], ["id", "vector", "cell"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, cell int")


def knn_indexed(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int | None = None, target: float = 0.95, sample: int = SAMPLE, block: int = 4 * BLOCK) -> DataFrame:
    """``knn`` through an inverted index: every vector stands in the cell of its nearest centre, and a query meets its nearest cells only.

    The centres (about the root of the number of rows, at most ``CELLS``) are fitted on a bounded sample, every row is
    indexed. A query meets as many cells as the sample needs for a recall of ``target``: few where vectors lie in clusters, most where
    they lie anyhow. ``recall`` measures the result against ``knn``. A cell is cut into
    blocks of about ``block`` rows by a hash of the id, and each block is one unit of work, so a cell that holds a third of the rows is met
    in many tasks; within a task the queries of a block pass by in batches. A query with no more rows than ``k`` in its cells gets fewer.
    """
    vectors, queries = (x.where(F.col("vector").isNotNull()).select("id", "vector") for x in (vectors, queries))
    scratch = Scratch(vectors.sparkSession, "index")
    n = vectors.count()
    kinds = [to_arrow_type(x.schema["id"].dataType) for x in (vectors, queries)]
    if not n:
        return _best(vectors.mapInArrow(lambda batches: iter(()), _hit_schema(vectors, queries)), k)
    points = sampled(vectors, n, sample)
    if not len(points):
        return knn(vectors, queries, k)
    centres = fit_cells(points, cells or max(1, min(CELLS, int(n**0.5))))
    probes = needed_probes(points, centres, k, target)
    held = scratch.save(_cells(vectors, centres, 1), "cells")
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    blocks = F.broadcast(scratch.save(sizes, "sizes"))
    asked = _cells(queries, centres, probes).join(blocks, "cell")
    left = held.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "vector")
    right = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "vector")
    met = left.unionByName(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)] if len(marks) else [0]
            for a, b in zip(cuts, cuts[1:]):
                place, side = tuple(marks[a, :2]), marks[a, 2]
                rows = batch.slice(a, b - a)
                if side == 0:
                    part = rows.column(3).cast(kinds[0]), _matrix(rows.column(4))
                    at, parts, places = place, [*parts, part] if at == place else [part], None
                elif at == place:
                    if places is None:
                        ids, v = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                        parts, places = [(ids, v)], _places(ids)
                    for i in range(0, len(rows), ASKED):
                        few = rows.slice(i, ASKED)
                        yield _nearest(few.column(3).cast(kinds[1]), _matrix(few.column(4)), ids, places, v, k, np.full((len(few), k), np.inf))[0]

    return _best(met.mapInArrow(search, _hit_schema(vectors, queries)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's ``exact`` hits that ``found`` has too."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))


def symbol_vectors(nodes: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, path, text, vector) of each node; the text is its signature or else its qualified name.

    ``embedder`` makes a column of vectors of one length from a column of texts; without one, texts are hashed to ``DIM`` numbers.
    """
    text = F.coalesce(F.nullif("signature", F.lit("")), F.col("qualified_name"))
    return nodes.select("id", "path", text.alias("text")).withColumn("vector", (embedder or hashing_embedder())(F.col("text")))


def seed_scores(hits: DataFrame) -> DataFrame:
    """(prompt_id, id, score): the best score of every hit (prompt_id, id, distance)."""
    return hits.groupBy("prompt_id", "id").agg(F.max(score(F.col("distance"))).alias("score"))


def sieve(rows: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test on columns that every ``key`` of ``rows`` passes and few other values do; it takes 8 MB, whatever the number of keys.

    For a filter ahead of an exact join: Catalyst moves it below the shuffles that come before.
    """
    place = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    parts = rows.groupBy(F.floor(place / SIEVE_ROW).alias("row")).agg(F.bitmap_construct_agg(place % SIEVE_ROW).alias("bits")).collect()
    bits = np.zeros(SIEVE // 8, np.uint8)
    for r in parts:
        bits[r.row * SIEVE_ROW // 8 : (r.row + 1) * SIEVE_ROW // 8] = np.frombuffer(r.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda value: passes(F.pmod(F.xxhash64(value), F.lit(SIEVE)))


def expand(seeds: DataFrame, edges: DataFrame, costs: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """(prompt_id, id, score, is_seed, cost): the seeds and, at a fixed score, the ids one edge away in either direction.

    ``costs`` is (id, cost) of the nodes; an id without a node costs what its own text does. All neighbours of a seed
    have one score, so they enter a context by id: a prompt's running cost at one of them is at least that of the seed's neighbours
    up to it, less what the prompt's own seeds cost, as those may come later. Neighbours that this puts beyond ``budget`` are in no
    context, whatever the prompt, and are not copied to the prompts; the first ones stay, as the very first row of a context always does.
    """
    ends = F.array(F.struct(F.col("src_id").alias("a"), F.col("dst_id").alias("id")), F.struct(F.col("dst_id").alias("a"), F.col("src_id").alias("id")))
    seeded = sieve(seeds, "id")
    both = edges.where(seeded("src_id") | seeded("dst_id")).select(F.explode(ends).alias("e")).select("e.a", "e.id")
    cost = F.coalesce("cost", estimate_tokens(F.col("id"))).alias("cost")
    near = both.join(seeds.select(F.col("id").alias("a")).distinct(), "a", "left_semi").join(costs, "id", "left").select("a", "id", cost).distinct()
    near = scratch.save(near, "near")
    seeds = scratch.save(seeds.join(costs, "id", "left").select("prompt_id", "id", "score", cost), "costs")
    sums = scratch.save(near.groupBy("a").agg(F.sum("cost").alias("all")).where(F.col("all") > budget).select("a"), "sums")
    if not sums.isEmpty():
        most, n = seeds.groupBy("prompt_id").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n")).agg(F.max("c"), F.max("n")).first()
        first = ranked(near.join(sums, "a", "left_semi"), "a", ["id"], scratch, "cost").where((F.col("total") <= budget + most) | (F.col("rank") <= n + 1))
        near = near.join(sums, "a", "left_anti").unionByName(first.select(*near.columns))
    met = seeds.select("prompt_id", F.col("id").alias("a")).join(near, "a").select("prompt_id", "id", F.lit(None).cast("double").alias("score"), "cost")
    pool = seeds.select(*met.columns).unionByName(met).groupBy("prompt_id", "id").agg(F.max("score").alias("score"), F.max("cost").alias("cost"))
    return pool.select("prompt_id", "id", F.coalesce("score", F.lit(EXPANSION_SCORE)).alias("score"), F.col("score").isNotNull().alias("is_seed"), "cost")


def budget_prefix(rows: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """The first rows of each group whose running cost stays within ``budget``; the very first row always stays.

    Costs are at least 1, so the running cost only grows and the cut is where it first passes the budget.
    """
    running = ranked(rows, group, order, Scratch(rows.sparkSession, "budget"), cost)
    return running.where((F.col("total") <= budget) | (F.col("rank") == 1))


def context_files(selected: DataFrame) -> DataFrame:
    """(prompt_id, path, rank): each file of a selection at its first place."""
    return selected.where("path <> ''").groupBy("prompt_id", "path").agg(F.min("rank").alias("rank"))


def prune_context(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, prompts: DataFrame, token_budget: int = 8000, top_k: int = 20, embedder: Callable[[Column], Column] | None = None, search: Callable[..., DataFrame] = knn
) -> DataFrame:
    """(prompt_id, id, name, path, score, cost, total, rank): the context of each prompt (prompt_id, prompt) within a budget of tokens.

    A prompt is read whole. A null one, or one without tokens, is as far from every symbol that has tokens, so ids decide.
    Nearest symbols, their neighbours at a fixed score, ranked by score (seeds first, then by id) and cut by running cost. ``embedder``
    must be that of ``vectors``; ``search`` is ``knn`` or, where prompts grow with the graph, ``knn_indexed``.
    """
    scratch = Scratch(nodes.sparkSession, "context")
    asked = scratch.save(prompts.select(F.col("prompt_id").cast("string").alias("id"), (embedder or hashing_embedder())(F.col("prompt")).alias("vector")), "prompts")
    named = scratch.save(vectors.select("id", "vector"), "vectors")
    hits = search(named, asked, top_k).select(F.col("query_id").alias("prompt_id"), "id", "distance")
    seeds = scratch.save(seed_scores(hits), "seeds")
    scratch.drop(asked, named)
    name = F.coalesce(F.nullif("name", F.lit("")), "id")
    cost = estimate_tokens(F.coalesce(F.nullif("signature", F.lit("")), name))
    known = scratch.save(nodes.select("id", name.alias("name"), F.coalesce("path", F.lit("")).alias("path"), cost.alias("cost")), "known")
    pool = expand(seeds, edges, known.select("id", "cost"), token_budget, scratch)
    order = [F.desc(F.round("score", 9)), F.desc("is_seed"), "id"]
    rows = budget_prefix(pool, "prompt_id", order, "cost", token_budget).join(known.drop("cost"), "id", "left")
    return rows.select("prompt_id", "id", F.coalesce("name", "id").alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.round("score", 6).alias("score"), "cost", "total", "rank")
