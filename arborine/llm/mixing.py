"""Mixing sources to target shares of tokens by entropy balancing.

Every document starts at a rate of one copy. The rates that differ least from that in relative
entropy, stay within 0 and the source's cap of repeats and give each source its tokens are
exponentially tilted in the document's size: min(cap, exp(lambda * tokens / mean)), one lambda per
source. The lambdas solve the convex dual by Newton steps; each step is one Spark
aggregate over (source, size) counts, which hold every document and have at most as many rows as
there are sizes, at a ladder of lambdas around each source's Newton point at once. The total is the largest for which no source needs
more than its cap, or a smaller one that is asked for.
Rates become copies by a deterministic random place per document; one shift of
all places per source, found in a histogram of the whole source, brings the tokens near the target, and
single documents that fit what is left bring them nearer. What each source needs travels as a small table with a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborine.llm.tokenizer import DEFAULT_VOCABULARY, token_counts
from arborine.operators.skew import join_skewed
from arborine.sources.scratch import Scratch

#: Jobs of the search, lambdas that each tries per source, and the gap in tokens, relative to the goal, at which it ends.
STEPS, RUNGS = 40, 12
TOLERANCE = 1e-9
PLACES = 4096
#: Rates are tilted within exp(-LIMIT) and exp(LIMIT); a goal beyond is reported as not solved.
LIMIT = 60.0
#: Jobs that adjust single documents after rounding.
TOUCHES = 6
#: Up to so many sources their table is broadcast (under 100 bytes a row).
BROADCAST = 50_000


def _with_sources(rows: DataFrame, table: dict[str, tuple], names: list[str]) -> DataFrame:
    """``rows`` of the sources in ``table`` with that source's numbers as columns ``names``."""
    small = rows.sparkSession.createDataFrame([(s, *map(float, v)) for s, v in table.items()], "source string, " + ", ".join(f"{n} double" for n in names))
    return rows.join(F.broadcast(small), "source") if len(table) <= BROADCAST else join_skewed(rows, small, "source", rows.count(), "inner")


def _tilt() -> Column:
    power = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("_lambda") * F.col("tokens") / F.col("_mean")))
    return F.least(F.exp(power), F.col("_cap"))


def _ladder(low: float, high: float, newton: float | None) -> list[float]:
    """Lambdas to try between two that are too small and too large: even steps, and close about the Newton point."""
    width = (high - low) / (RUNGS + 1)
    tries = [low + width * (i + 1) for i in range(RUNGS)]
    if newton is not None and low < newton < high:
        near = [newton + (high - low) * d for d in (-1e-2, -1e-4, -1e-6, 0.0, 1e-6, 1e-4, 1e-2)]
        tries += [x for x in near if low < x < high]
    return sorted(set(tries))


def solve_rates(sizes: DataFrame, goals: dict[str, float], caps: dict[str, float], means: dict[str, float]) -> dict[str, tuple[float, float]]:
    """The lambda of every source in ``goals`` from ``sizes`` (source, tokens, docs), and the tokens that its rates miss.

    Every job narrows the bracket of each open source to two rungs of its ladder; the ladder of the next job stands about
    the Newton point of the nearer rung, so few jobs end the search. A gap that remains after ``STEPS`` jobs is returned, not hidden.
    """
    bracket = {s: (-LIMIT, LIMIT) for s in goals}
    ladders = {s: sorted({0.0, *_ladder(-LIMIT, LIMIT, None), *(x for k in range(-3, 4) for x in (-(2.0**k), 2.0**k))}) for s in goals}
    best = dict.fromkeys(goals, (0.0, float("inf")))
    for _ in range(STEPS):
        if not ladders:
            break
        rungs = sizes.sparkSession.createDataFrame([(s, i, x, caps[s], means[s]) for s, xs in ladders.items() for i, x in enumerate(xs)], "source string, rung int, _lambda double, _cap double, _mean double")
        met = sizes.join(F.broadcast(rungs) if len(ladders) * RUNGS <= BROADCAST else rungs, "source")
        mass = F.col("docs") * F.col("tokens")
        rate = _tilt()
        slope = F.when(rate < F.col("_cap"), rate).otherwise(0.0) * mass * F.col("tokens") / F.col("_mean")
        sums = met.groupBy("source", "rung").agg(F.sum(rate * mass).alias("g"), F.sum(slope).alias("h")).collect()
        seen: dict[str, dict[int, tuple[float, float]]] = {}
        for r in sums:
            seen.setdefault(r["source"], {})[r["rung"]] = (r["g"], r["h"])
        open_ = {}
        for s, xs in ladders.items():
            low, high = bracket[s]
            newton, nearest = None, float("inf")
            for i, x in enumerate(xs):
                g, h = seen[s][i]
                gap = g - goals[s]
                low, high = (low, min(high, x)) if gap > 0 else (max(low, x), high)
                if abs(gap) < abs(best[s][1]):
                    best[s] = (x, gap)
                if abs(gap) < nearest:
                    nearest, newton = abs(gap), x - gap / h if h else None
            bracket[s] = (low, high)
            if nearest > TOLERANCE * max(goals[s], 1.0) and high - low > 1e-13 * max(1.0, abs(low)):
                open_[s] = _ladder(low, high, newton)
        ladders = {s: xs for s, xs in open_.items() if xs}
    return best


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies per document and the shares reached.

    First frame: (doc_id, source, tokens, rate, copies) of every document of a target source; copies may be
    0 and are at most the source's ``max_repeats``. Second frame: (source, target_share, share, tokens, goal, gap, available_tokens,
    docs, copies), one row per target source; ``gap`` is what the rates miss of the goal before they are rounded. ``total`` asks for that
    many tokens in all; without it, or where the caps forbid so many, the total is the largest that they allow. Targets with a null source, a weight that
    is null or not above 0, or a cap that is null or below 1 ask for nothing; of repeated sources the largest weight and
    cap count. Shares are relative to all remaining weights; a source without tokens
    reaches 0 and the others keep their proportions. Documents of other or null sources
    are left out; null and empty texts have 0 tokens and 0 copies. Empty tables give empty results. The targets
    are the one table that is collected (a row per source).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = targets.where("source is not null and weight > 0 and max_repeats >= 1").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("cap"))
    asked = {r["source"]: (float(r["weight"]), float(r["cap"])) for r in wanted.collect()}
    total_weight = sum(w for w, _ in asked.values())
    kept = _with_sources(documents.select("doc_id", "source", "text"), {s: (1.0,) for s in asked}, ["_asked"])
    counted = scratch.save(token_counts(kept, ["doc_id", "source"], vocabulary), "tokens")
    sizes = scratch.save(counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")), "sizes")
    have = {r["source"]: (int(r["n"]), int(r["full"])) for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("n"), F.sum(F.when(F.col("tokens") > 0, F.col("docs")).otherwise(0)).alias("full")).collect()}
    usable = {s: wc for s, wc in asked.items() if have.get(s, (0, 0))[0] > 0}
    weights = sum(w for w, _ in usable.values())
    most = min((cap * have[s][0] / w for s, (w, cap) in usable.items()), default=0.0)
    scale = most if total is None or not weights else min(most, max(total, 0.0) / weights)
    goals = {s: w * scale for s, (w, _) in usable.items()}
    caps = {s: cap for s, (_, cap) in usable.items()}
    means = {s: have[s][0] / have[s][1] for s in usable}
    solved = solve_rates(sizes, goals, caps, means)
    every = {s: (solved[s][0], caps[s], means[s]) if s in usable else (0.0, 1.0, 1.0) for s in asked}
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.lit(1 << 20)).cast("double") / F.lit(float(1 << 20))
    tilted = _with_sources(counted, every, ["_lambda", "_cap", "_mean"]).withColumn("rate", F.when(F.col("tokens") > 0, _tilt()).otherwise(0.0))
    rated = scratch.save(tilted.select("doc_id", "source", "tokens", "rate", "_cap", (F.col("rate") + place).alias("_place")), "rated")
    shift = _shifts(rated, goals)
    moved = _with_sources(rated, {s: (shift.get(s, 0.0),) for s in asked}, ["_shift"])
    copies = F.when(F.col("rate") <= 0, 0).otherwise(F.greatest(F.lit(0.0), F.least("_cap", F.floor(F.col("_place") + F.col("_shift"))))).cast("int")
    rounded = scratch.save(moved.select("doc_id", "source", "tokens", "rate", "_cap", copies.alias("copies")), "rounded")
    touched = _touched(rounded, goals, scratch)
    chosen = touched.select("doc_id", "source", "tokens", F.round("rate", 9).alias("rate"), "copies")
    reached = touched.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"))
    names = spark.createDataFrame([(s, w / total_weight, goals.get(s, 0.0), float(solved[s][1]) if s in solved else 0.0) for s, (w, _) in asked.items()], "source string, target_share double, goal double, gap double")
    grand = reached.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = names.join(reached, "source", "left").select(
        "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.lit(float(max(grand, 1))), 9).alias("share"), zero("tokens"), F.round("goal", 3).alias("goal"), F.round("gap", 3).alias("gap"), zero("available_tokens"), zero("docs"), zero("copies")
    )
    return chosen, report


def _shifts(rated: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """Per source the shift in [-1, 1] of all places that brings its tokens nearest to the goal.

    A document gains a copy when the shift passes 1 minus the fraction of its place and loses one when it falls
    below minus that fraction: a histogram of those places, weighted by tokens, tells the tokens at each shift.
    """
    if not goals:
        return {}
    base = F.floor("_place")
    fraction = F.col("_place") - base
    live = rated.where(F.col("rate") > 0)
    gain = live.where(base < F.col("_cap")).select("source", "tokens", F.floor((F.lit(1.0) - fraction) * PLACES).alias("bin"), F.lit(1).alias("sign"))
    lose = live.where((base > 0) & (base <= F.col("_cap"))).select("source", "tokens", F.floor(fraction * PLACES).alias("bin"), F.lit(-1).alias("sign"))
    bins: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in gain.unionByName(lose).groupBy("source", "sign", "bin").agg(F.sum("tokens").alias("tokens")).collect():
        bins.setdefault((r["source"], r["sign"]), []).append((r["bin"], r["tokens"]))
    now = {r["source"]: r["n"] for r in live.groupBy("source").agg(F.sum(F.least("_cap", base) * F.col("tokens")).alias("n")).collect()}
    out = {}
    for s, goal in goals.items():
        gap = goal - (now.get(s) or 0)
        sign = 1 if gap > 0 else -1
        moved, best = 0.0, (abs(gap), 0.0)
        for k, n in sorted(bins.get((s, sign), [])):
            moved += n
            best = min(best, (abs(abs(gap) - moved), (k + 1) / PLACES))
            if moved >= abs(gap):
                break
        out[s] = sign * best[1]
    return out


def _touched(rounded: DataFrame, goals: dict[str, float], scratch: Scratch) -> DataFrame:
    """``rounded`` with one copy more or less of single documents whose size is nearest to what their source still misses or has too much.

    Each job finds one document per source, of equals the least ``doc_id``; it ends where none brings a source nearer to its goal.
    """
    changes: list[tuple] = []
    kind = rounded.schema["doc_id"].dataType.simpleString()
    now = {r["source"]: float(r["n"]) for r in rounded.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    gaps = {s: goal - now.get(s, 0.0) for s, goal in goals.items()}
    for _ in range(TOUCHES):
        gaps = {s: g for s, g in gaps.items() if abs(g) >= 1}
        if not gaps:
            break
        rows = _with_sources(rounded.where("rate > 0 and doc_id is not null"), {s: (g,) for s, g in gaps.items()}, ["_gap"])
        done = [c[0] for c in changes]
        free = rows.where(~F.col("doc_id").isin(done)) if done else rows
        free = free.where(((F.col("_gap") > 0) & (F.col("copies") < F.col("_cap"))) | ((F.col("_gap") < 0) & (F.col("copies") > 0)))
        off = F.abs(F.col("tokens") - F.abs("_gap"))
        picks = free.where(off < F.abs("_gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id", "tokens")).alias("p")).collect()
        gaps_after = {}
        for r in picks:
            s, sign = r["source"], 1 if gaps[r["source"]] > 0 else -1
            changes.append((r["p"]["doc_id"], s, sign))
            gaps_after[s] = gaps[s] - sign * r["p"]["tokens"]
        gaps = gaps_after
    if not changes:
        return rounded
    small = rounded.sparkSession.createDataFrame(changes, f"doc_id {kind}, source string, _more int")
    one = F.broadcast(small) if len(changes) <= BROADCAST else small
    return rounded.join(one, ["doc_id", "source"], "left").withColumn("copies", (F.col("copies") + F.coalesce("_more", F.lit(0))).cast("int")).drop("_more")
