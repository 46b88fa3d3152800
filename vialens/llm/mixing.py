"""Mixing sources to target weights by entropy balancing: Newton rounds on the dual, tilted rates, rounded copies."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import discard, ordered_prefix, row_key, small, whole_row, word_count, written

#: No document is taken more often than this, and no source gets more than this times its words.
MOST = 3
#: Newton's step is tried whole, then halved so many times at most, all in one pass.
HALVINGS = 6


def _tilted(lam: Column, size: Column, mean: Column) -> Column:
    """The rate of a document: the exponential of its source's multiplier times its relative size, up to MOST."""
    return F.exp(F.least(lam * size / mean, F.lit(math.log(MOST))))


def source_targets(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``target`` to ``source, words``: all words shared by the weights, in turn over the sources by code point (null last),
    at most MOST times a source's words, the excess shared by weight among the others until none is above."""
    ranked = sources.withColumn("ix", F.lit(1).cast("long")).withColumn("last", F.col("source").isNull().cast("int"))
    ranked = ordered_prefix(ranked, ["last", "source"], ["ix"], "ranks").withColumn("rank", F.col("ix_before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "words", "docs", weight.cast("double").alias("weight")), "weights")
    total = ranked.agg(F.sum("words")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:  # words a unit of weight; each round caps at least one more source
        full = F.col("words") * MOST < F.col("weight") * F.lit(level)
        s = ranked.agg(F.sum(F.when(full, F.col("words") * MOST).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        before, level = level, (total - (s[0] or 0)) / s[1] if s[1] else level
    return ranked.withColumn("target", F.least(F.col("words") * float(MOST), F.col("weight") * level))


def dual_at(lam: Column, z: Column, n: Column) -> tuple[Column, Column, Column]:
    """Sums of the dual, without its linear term, over documents of relative size ``z``, with its first and second derivative by
    ``lam``: where the rate exp(lam z) is under MOST, n rate, n z rate and n z z rate; beyond, the tangent there."""
    u, top = lam * z, math.log(MOST)
    rate = F.exp(F.least(u, F.lit(top)))
    return F.sum(n * rate * (1 + F.greatest(u - top, F.lit(0.0)))), F.sum(n * z * rate), F.sum(F.when(u < top, n * z * z * rate).otherwise(0.0))


def balance(cells: DataFrame, sources: DataFrame, rounds: int = 60, close: float = 1e-6) -> DataFrame:
    """``source, target, mean, lam``: the multiplier under which a source's tilted rates take its target of words.

    Of all rates between 0 and MOST that take a source's target, those nearest to 1 in relative entropy are exp(lam z), up to
    MOST, with z the document's size over its source's mean; lam is the least point of the convex dual, sum of phi(lam z) - lam
    target / mean, where phi' is the rate. Each round sums the dual, its gradient and its Hessian over all ``cells`` (source,
    size, n) at Newton's step and at HALVINGS halves of it, takes the longest that lowers the dual enough (or halves the
    gradient), and sets the next step. A source whose target is MOST times its words has all rates at MOST; RuntimeError if
    others are not within ``close`` of their targets after ``rounds``.
    """
    mean = F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9))
    full = F.col("target") >= F.col("words") * (MOST - 1e-6)
    every = written(sources.select("source", "target", mean.alias("mean"), full.alias("full")), "sources")
    nothing = F.lit(None).cast("double")
    free = every.where(~F.col("full")).select("source", (F.col("target") / F.col("mean")).alias("goal"), "mean", F.lit(0.0).alias("lam"), F.lit(0.0).alias("step"), nothing.alias("f"), nothing.alias("g"))
    state = written(free, "dual")
    few = state.limit(200_001).count()
    shared = F.broadcast if few <= 200_000 else lambda x: x  # a row a source
    trials = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("lam") + F.col("step") * 0.5**k).alias("at")) for k in range(HALVINGS + 1)))).alias("x")
    settled = not few
    for _ in range(rounds):
        if settled:
            break
        tried = shared(state.select(F.col("source").alias("s"), "mean", trials).select("s", "mean", "x.*"))
        held = cells.join(tried, F.col("source").eqNullSafe(F.col("s"))).select("s", "k", "at", (F.col("size") / F.col("mean")).alias("z"), "n")
        f, g, h = dual_at(F.col("at"), F.col("z"), F.col("n"))
        sums = held.groupBy("s", "k", "at").agg(f.alias("fs"), g.alias("gs"), h.alias("hs"))
        met = shared(state).join(sums, F.col("source").eqNullSafe(F.col("s")))
        met = met.withColumn("fs", F.col("fs") - F.col("at") * F.col("goal")).withColumn("gs", F.col("gs") - F.col("goal"))
        fits = F.col("f").isNull() | (F.col("fs") <= F.col("f") + 1e-4 * (F.col("at") - F.col("lam")) * F.col("g")) | (F.abs("gs") <= F.abs("g") / 2)
        one = met.groupBy("source", "goal", "mean").agg(F.min(F.when(fits, F.struct("k", "at", "fs", "gs", "hs"))).alias("x"), F.first("lam").alias("lam"), F.first("step").alias("step"), F.first("f").alias("f"), F.first("g").alias("g"))
        newton = F.when(F.col("x.hs") > 0, -F.col("x.gs") / F.col("x.hs")).otherwise(-4.0 * F.signum("x.gs"))
        newton = F.when(F.col("x").isNull(), F.col("step") * 0.5**HALVINGS).otherwise(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), newton)))
        moved = one.select("source", "goal", "mean", F.coalesce("x.at", "lam").alias("lam"), newton.alias("step"), F.coalesce("x.fs", "f").alias("f"), F.coalesce("x.gs", "g").alias("g"))
        before, state = state, written(moved, "dual")
        discard(before)
        settled = (state.agg(F.max(F.abs("g") / F.col("goal"))).first()[0] or 0.0) < close
    if not settled:
        raise RuntimeError("the dual did not settle")
    found = small(state.select(F.col("source").alias("s"), F.round("lam", 9).alias("lam")))
    return every.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "target", "mean", F.when(F.col("full"), F.lit(1e6)).otherwise(F.col("lam")).alias("lam"))


def _copies(shift: Column) -> Column:
    """How often a row is taken: its rate and its uniform number ``u``, moved by ``shift``, rounded down, 0 to MOST. Over all
    rows the mean is the rate; the more the shift, the more copies of any row."""
    rate = F.when(F.col("lam").isNull(), 1.0).otherwise(_tilted(F.col("lam"), F.col("size"), F.col("mean")))
    return F.when(F.col("size") == 0, 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(MOST), F.floor(rate + F.col("u") + F.when(F.col("size") > F.col("pin_size"), F.col("pin_shift")).otherwise(shift))))).cast("int")


def _uniform(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(3), key), 11) / float(1 << 53)


def _with_sources(rows: DataFrame, sources: DataFrame, *names: str, mark: Callable[[DataFrame], DataFrame] = small) -> DataFrame:
    """``rows`` and the columns ``names`` of their source."""
    own = mark(sources).select(F.col("source").alias("__s"), *names)
    return rows.join(own, rows["source"].eqNullSafe(F.col("__s"))).drop("__s")


def shifts(rows: DataFrame, sources: DataFrame, ways: int = 16, rounds: int = 4, close: float = 0.0002) -> DataFrame:
    """``sources`` with ``shift``, that of all shifts whose copies take the words nearest to the target.

    The words taken grow with the shift, and the target lies between those at -1 and at 1. Each round sums them at ``ways`` - 1
    shifts between the ends that are left, all sources in one pass, and goes on between the two around the target, until the
    nearer end is ``close`` or the ends are 2^-15 apart: of a source's rows, one in 30,000 is left between them. Where that
    leaves a source far off, because a long document lies between the ends, the documents longer than what is missed stay as
    they are at the lower end (``pin_size, pin_shift``), and the search goes on with the others, up to MOST copies of each.
    """
    names = [*sources.columns, "pin_size", "pin_shift"]
    mark = F.broadcast if sources.limit(200_001).count() <= 200_000 else lambda x: x  # a row a source
    ends = F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"), F.lit(None).cast("long").alias("at_low"), F.lit(None).cast("long").alias("at_high")
    state = written(sources.select("*", F.lit(float("inf")).alias("pin_size"), F.lit(0.0).alias("pin_shift"), *ends), "shifts")
    pick = lambda xs, k: F.element_at(F.array(*xs), (k + 1).cast("int"))
    off = F.least(F.abs(F.col("target") - F.col("at_low")), F.abs(F.col("at_high") - F.col("target"))) / F.col("target")
    worst = 1.0
    for k in range(2 * rounds):
        at = [F.col("low") + (F.col("high") - F.col("low")) * (k / ways) for k in range(ways + 1)]
        met = _with_sources(rows, state.where("words > 0"), "lam", "mean", "low", "high", "pin_size", "pin_shift", mark=mark)
        sums = met.groupBy(F.col("source").alias("__m")).agg(*(F.sum(F.col("size") * _copies(x)).alias(f"t{k}") for k, x in enumerate(at)))
        both = state.join(mark(sums), F.col("source").eqNullSafe(F.col("__m")), "left")
        below = F.greatest(*(F.when((F.col(f"t{k}") <= F.col("target")) | F.lit(k == 0), k) for k in range(ways)))
        taken = [F.col(f"t{k}") for k in range(ways + 1)]
        moved = both.withColumn("k", below).select(*names, pick(at, F.col("k")).alias("low"), pick(at, F.col("k") + 1).alias("high"), pick(taken, F.col("k")).alias("at_low"), pick(taken, F.col("k") + 1).alias("at_high"))
        if k == rounds - 1:
            far = off > 5 * close
            pinned = {"pin_size": F.when(far, F.col("target") - F.col("at_low")).otherwise(F.col("pin_size")), "pin_shift": F.when(far, F.col("low")).otherwise(F.col("pin_shift")), "high": F.when(far, F.lit(float(MOST))).otherwise(F.col("high"))}
            moved = moved.select(*(pinned.get(c, F.col(c)).alias(c) for c in moved.columns), F.when(F.col("target") > 0, off).alias("off"))
        else:
            moved = moved.withColumn("off", F.when(F.col("target") > 0, off))
        before, state = state, written(moved, "shifts")
        discard(before)
        worst = state.agg(F.max("off")).first()[0] or 0.0
        if worst <= close or (k == rounds - 1 and worst <= 5 * close):
            break
    nearer = F.when(F.abs(F.col("at_high") - F.col("target")) < F.abs(F.col("target") - F.col("at_low")), F.col("high")).otherwise(F.col("low"))
    return state.select(*names, nearer.alias("shift"))


def _moves(rows: DataFrame, sources: DataFrame, rounds: int = 16, close: float = 0.001) -> DataFrame:
    """``moved_key, move``: rows taken once more or less, a row a source and round at most, where a long document's rounding has
    left a source off its target: the one whose words come closest to what is missed. Rows of one key move together. The rounds end
    when all sources are close, or no move brings one closer; only sources of few documents need more than one or two."""
    spark = rows.sparkSession
    placed = _with_sources(rows, sources, "lam", "mean", "shift", "target", "pin_size", "pin_shift").withColumn("copies", _copies(F.col("shift")))
    moves = written(spark.createDataFrame([], "moved_key binary, move int"), "moves")
    for _ in range(rounds):
        now = placed.join(small(moves), F.col("row_key") == F.col("moved_key"), "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0)))
        over = now.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
        miss = written(over.select(F.col("source").alias("__m"), (F.col("target") - F.col("got")).alias("miss"), "target"), "misses")
        off = miss.where((F.col("target") > 0) & (F.abs("miss") > F.col("target") * close)).select("__m", "miss")
        if off.isEmpty():
            break
        off = small(off)
        free = F.when(F.col("miss") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        tried = now.join(off, F.col("source").eqNullSafe(F.col("__m"))).where(free & (F.col("size") > 0) & (F.abs(F.abs("miss") - F.col("size")) < F.abs("miss")))
        tried = tried.groupBy("source", "row_key", "miss").agg(F.sum("size").alias("size"))
        left = F.abs(F.abs("miss") - F.col("size"))
        best = tried.where(left < F.abs("miss")).groupBy("source").agg(F.min(F.struct(left.alias("left"), "row_key", F.signum("miss").cast("int").alias("move"))).alias("b"))
        best = written(best, "best")
        if best.isEmpty():
            discard(best, miss)
            break
        added = moves.union(best.select(F.col("b.row_key").alias("moved_key"), F.col("b.move").alias("move"))).groupBy("moved_key").agg(F.sum("move").cast("int").alias("move"))
        before, moves = moves, written(added, "moves")
        discard(before, miss, best)
    return moves


def _plan(docs: DataFrame, weights: tuple[int, ...], key: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow rows, the sources with their multipliers and shifts, and the moves of single rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("row_key"))
    rows = written(rows.withColumn("u", _uniform(F.col("row_key"))), "sizes")
    cells = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("words"), F.sum("n").alias("docs"))
    targets = written(source_targets(sources, weights), "targets")
    dual = written(balance(cells.where("size > 0"), targets.where("words > 0")), "dual").select(F.col("source").alias("__d"), "mean", "lam")
    found = shifts(rows, targets.select("source", "words", "target").join(small(dual), F.col("source").eqNullSafe(F.col("__d")), "left").drop("__d"))
    found = written(found, "mixed")
    discard(cells, targets)
    return rows, found, _moves(rows, found)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), key: Column | None = None) -> DataFrame:
    """How often the mix takes each row of ``docs`` (``doc_id``, ``text``, ``source``; other columns are ignored).

    ``key``: what tells rows apart (``common.row_key``), of these three columns if not given.
    Returns ``doc_id, row_key, source, size`` (words), ``source_size, target, copies`` (0 to MOST), ``taken``.
    A row's rate is rounded by a uniform number hashed from its key, moved by a shift of its source that brings the words taken
    nearest to the target; then up to 16 rows a source are moved by a copy where that comes closer. Each is found row by row
    from a few numbers of its source, so texts are never shuffled. Reruns agree.
    Null sources are one source, sorted last; null texts have size 0; rows of size 0 take no words (one copy); repeated rows
    get the same number; an empty table gives none.
    """
    rows, sources, moves = _plan(docs, weights, row_key(["doc_id", "source", "text"]) if key is None else key)
    placed = _placed(rows, sources, moves)
    return placed.select("doc_id", "row_key", "source", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _placed(rows: DataFrame, sources: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with the numbers of their source and ``copies``."""
    met = _with_sources(rows, sources, "words", "target", "lam", "mean", "shift", "pin_size", "pin_shift")
    met = met.join(small(moves), F.col("row_key") == F.col("moved_key"), "left")
    return met.withColumn("copies", (_copies(F.coalesce("shift", F.lit(0.0))) + F.coalesce("move", F.lit(0))).cast("int"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` as the mix takes it: each row as often as ``mix`` says, with all its columns."""
    names = docs.columns
    _, sources, moves = _plan(docs, weights, row_key(names))
    # the columns of docs go along in a struct, so that none of their names clashes
    rows = docs.select(whole_row(names).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key(names).alias("row_key"))
    placed = _placed(rows.withColumn("u", _uniform(F.col("row_key"))), sources, moves).where("copies > 0")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
