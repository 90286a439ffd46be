"""Scaling, weighting and thresholding of signals, as set-oriented plans.

Tables of pairs carry an optional *slice* (a fold, a configuration, a candidate weight): everything below works on all
slices at once, so a search over weights and folds is one plan and not a loop of jobs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsift.sources.scratch import materialise

#: Penalty on the sum of squared weights; it only breaks ties, towards balanced weights.
BALANCE = 1e-3


def fit_minmax(table: DataFrame, signals: list[str], by: list[str] | None = None) -> DataFrame:
    """Per slice one row with ``lo_<s>`` and ``hi_<s>`` of every signal."""
    return table.groupBy(*(by or [])).agg(*(f(s).alias(f"{n}_{s}") for s in signals for n, f in (("lo", F.min), ("hi", F.max))))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling, clipped to 0..1; a constant signal has span 1."""
    span = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / span))


def apply_minmax(table: DataFrame, ranges: DataFrame, signals: list[str], by: list[str] | None = None) -> DataFrame:
    """``table`` with its signals scaled by the ranges of its slice (a row per slice: broadcast)."""
    joined = table.join(F.broadcast(ranges), by) if by else table.crossJoin(F.broadcast(ranges))
    out = joined.withColumns({s: scaled(F.col(s), F.col(f"lo_{s}"), F.col(f"hi_{s}")) for s in signals})
    return out.drop(*(f"{n}_{s}" for s in signals for n in ("lo", "hi")))


def simplex_grid(spark: SparkSession, n: int, step: float) -> DataFrame:
    """(ord, w1 .. wn): all weights that are multiples of ``step`` and add up to 1, in lexicographic order."""
    k = round(1 / step)
    grid = spark.range(1).select(F.lit(k).alias("left"))
    for i in range(1, n):
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("left"))).alias(f"i{i}")).withColumn("left", F.col("left") - F.col(f"i{i}"))
    grid = grid.withColumnRenamed("left", f"i{n}")
    # a grid has a few hundred rows whatever the data
    order = F.row_number().over(Window.orderBy(*(f"i{i}" for i in range(1, n + 1))))
    return grid.select(order.alias("ord"), *((F.col(f"i{i}") / F.lit(float(k))).alias(f"w{i}") for i in range(1, n + 1)))


def weighted_sum(signals: list[str], weights: list[Column]) -> Column:
    """Terms added from the left."""
    return reduce(lambda a, b: a + b, (F.col(s) * w for s, w in zip(signals, weights)))


def mean_of(signals: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(s) for s in signals)) / F.lit(float(len(signals)))


def _by_score(table: DataFrame, score: str, label: str | None, by: list[str]) -> DataFrame:
    """Per slice and distinct score: ``p``, ``q`` (positives, negatives), ``p_under``, ``q_under`` (of lower scores),
    ``lower`` (the next lower score), ``positives`` and ``negatives`` (of the slice).

    Running sums are taken inside stretches of a slice's scores, and the stretches are summed up in a second, small table,
    so the scores of a slice never meet in one task.  Without ``label`` the table has ``p`` and ``q`` (:func:`condensed`).
    """
    count = lambda y: F.sum(F.when(F.col(label) == y, 1).otherwise(0)) if label else F.sum("pq"[1 - y])
    at = table.groupBy(*by, score).agg(count(1).alias("p"), count(0).alias("q")).withColumn("_stretch", F.floor(F.col(score) * 1024))
    if not by:
        at = materialise(at, "scores")  # read twice below; with slices Spark reads one shuffle twice
    own = Window.partitionBy(*by, "_stretch").orderBy(score)
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    run = at.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in "pq"), F.lag(score).over(own).alias("_lag"))
    sums = at.groupBy(*by, "_stretch").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.max(score).alias("_top"))
    order = Window.partitionBy(*by).orderBy("_stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = (F.sum(f"_{c}").over(Window.partitionBy(*by)).alias(n) for c, n in (("p", "positives"), ("q", "negatives")))
    sums = sums.select(*by, "_stretch", *totals, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in "pq"), F.lag("_top").over(order).alias("_last"))
    out = run.join(sums, [*by, "_stretch"])
    return out.select(*by, score, "p", "q", *((F.col(f"{c}_in") + F.col(f"{c}_before")).alias(f"{c}_under") for c in "pq"), F.coalesce("_lag", "_last").alias("lower"), "positives", "negatives")


def auc(table: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Per slice ``auc``: the share of (positive, negative) pairs in order, ties half; null with one class only."""
    by = by or []
    won = F.sum(F.col("p") * (F.col("q_under") + F.col("q") / 2))
    pairs = F.sum("p") * F.sum("q")
    return _by_score(table, score, label, by).groupBy(*by).agg((won / F.when(pairs == 0, None).otherwise(pairs)).alias("auc"))


def search_weights(table: DataFrame, grid: DataFrame, signals: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """Per slice the weights with the best AUC less the balance penalty; the first of equals in grid order."""
    by = by or []
    names = [f"w{i + 1}" for i in range(len(signals))]
    tried = table.select(*by, label, *signals).join(F.broadcast(grid)).withColumn("score", weighted_sum(signals, [F.col(w) for w in names]))
    found = auc(tried.select(*by, "ord", "score", label), "score", label, [*by, "ord"]).join(F.broadcast(grid), "ord")
    squares = reduce(lambda a, b: a + b, (F.col(w) * F.col(w) for w in names))
    found = found.withColumn("objective", F.col("auc") - BALANCE * squares)
    kept = [c for c in found.columns if c not in (*by, "ord", "objective")]
    best = F.min(F.struct((-F.coalesce("objective", F.lit(-1e9))).alias("rank"), "ord", "objective", *kept)).alias("t")
    return found.groupBy(*by).agg(best).filter("t IS NOT NULL").select(*by, "t.ord", "t.objective", *(f"t.{c}" for c in kept))


def threshold_curve(table: DataFrame, score: str, label: str | None, by: list[str] | None = None) -> DataFrame:
    """Per slice and distinct score: ``tp``, ``fp``, ``fn`` and ``f1`` of flagging that score and above; ``lower``."""
    by = by or []
    at = _by_score(table, score, label, by)
    out = at.select(*by, score, "lower", (F.col("positives") - F.col("p_under")).alias("tp"), (F.col("negatives") - F.col("q_under")).alias("fp"), F.col("p_under").alias("fn"))
    worth = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumn("f1", F.when(worth == 0, 0.0).otherwise(2 * F.col("tp") / worth))


def best_threshold(table: DataFrame, score: str, label: str | None, by: list[str] | None = None) -> DataFrame:
    """Per slice ``threshold`` and ``f1``: the lowest score with the best F1, moved half-way to the next lower score."""
    by = by or []
    curve = threshold_curve(table, score, label, by)
    # F1 values are ratios of whole numbers: those that agree in 11 digits are equal
    top = F.min(F.struct((-F.round("f1", 11)).alias("rank"), F.col(score).alias("s"), F.coalesce("lower", score).alias("l"), "f1")).alias("t")
    best = curve.groupBy(*by).agg(top).filter("t IS NOT NULL")
    return best.select(*by, ((F.col("t.s") + F.col("t.l")) / 2).alias("threshold"), F.col("t.f1").alias("f1"))


#: Bins of scores in which thresholds are looked for.
BINS = 1 << 13


def condensed(table: DataFrame, score: str, label: str, group: str | None = None) -> DataFrame:
    """(group, score, p, q): few rows with the best threshold of ``table``, and of it without any one group.

    A first reading counts both labels by group and bin of scores.  A bin whose F1 cannot reach what whole bins reach,
    with all rows or without any one group, is one row at its group's highest score there: that is the next lower score of
    the bin above.  A second reading gives the other bins' scores as they are.
    """
    key = F.col(group) if group else F.lit("all")
    known = F.col(score).isNotNull() & ~F.isnan(score)
    count = lambda y: F.sum(F.when(F.col(label) == y, 1).otherwise(0)).alias("pq"[1 - y])
    rows = table.select(key.alias("group"), F.col(score).alias("score"), label, F.when(known, F.floor(F.col(score) * BINS)).alias("bin"))
    bins = materialise(rows.filter("bin IS NOT NULL").groupBy("group", "bin").agg(F.max("score").alias("score"), count(1), count(0)), "score-bins")
    found = bins.select("group", "bin", "p", "q").toPandas()  # a bounded number of rows for each group
    open_bins: set[int] = set()
    if len(found):
        places, at = np.unique(found["bin"].to_numpy(), return_inverse=True)
        totals = [np.bincount(at, found[c].to_numpy(float), len(places)) for c in "pq"]
        for g in [None, *found["group"].unique()] if group else [None]:
            own = (found["group"] == g).to_numpy() if g is not None else np.zeros(len(found), bool)
            p, q = (t - np.bincount(at[own], found[c].to_numpy(float)[own], len(places)) for c, t in zip("pq", totals))
            tp, fp = (np.cumsum(x[::-1])[::-1] for x in (p, q))
            f1 = lambda tp, fp, all_=p.sum(): 2 * tp / np.maximum(tp + fp + all_, 1)
            open_bins.update(places[f1(tp, fp - q) >= f1(tp, fp).max() - 1e-10].tolist())
    chosen = F.col("bin").isin(sorted(open_bins)) if open_bins else F.lit(False)
    exact = rows.filter(F.col("bin").isNull() | chosen).groupBy("group", "score").agg(count(1), count(0))
    return materialise(exact.select("group", "score", "p", "q").union(bins.filter(~chosen).select("group", "score", "p", "q")), "scores-condensed")


def fit(table: DataFrame, signals: list[str], label: str, step: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Per slice one model row: ``lo_*``, ``hi_*``, ``w1..``, ``threshold``, ``auc`` and ``f1`` on the rows it was fitted on."""
    by = by or []
    grid = simplex_grid(table.sparkSession, len(signals), step)
    ranges = fit_minmax(table, signals, by)
    flat = apply_minmax(table.select(*by, label, *signals), ranges, signals, by)
    names = [f"w{i + 1}" for i in range(len(signals))]
    # one row for each slice, read twice below: the search runs once
    weights = materialise(search_weights(flat, grid, signals, label, by).select(*by, *names, "auc"), "weights")
    joined = flat.join(F.broadcast(weights), by) if by else flat.crossJoin(F.broadcast(weights))
    limit = best_threshold(joined.withColumn("score", weighted_sum(signals, [F.col(w) for w in names])), "score", label, by)
    parts = [weights, limit]
    return reduce(lambda a, b: a.join(b, by) if by else a.crossJoin(b), parts, ranges)


def score(table: DataFrame, model: DataFrame, signals: list[str], by: list[str] | None = None) -> DataFrame:
    """``table`` with ``score`` and ``flagged`` by the model row of its slice."""
    names = [f"w{i + 1}" for i in range(len(signals))]
    kept = model.select(*(by or []), *(f"{n}_{s}" for s in signals for n in ("lo", "hi")), *names, "threshold")
    joined = table.join(F.broadcast(kept), by) if by else table.crossJoin(F.broadcast(kept))
    value = reduce(lambda a, b: a + b, (scaled(F.col(s), F.col(f"lo_{s}"), F.col(f"hi_{s}")) * F.col(w) for s, w in zip(signals, names)))
    out = joined.withColumn("score", value)
    return out.withColumn("flagged", F.col("score") >= F.col("threshold")).drop(*(f"{n}_{s}" for s in signals for n in ("lo", "hi")), *names)


def composite_score(signals: list[str], lo: Column, hi: Column, weights: Column, threshold: Column, fallback: Column) -> tuple[Column, Column]:
    """Score and flag of a row by a model of arrays: all signals, or the plain mean of the first three without an embedding.

    The flag is taken before any rounding.  A missing embedding and a missing fallback threshold raise.
    """
    full = reduce(lambda a, b: a + b, (scaled(F.col(s), F.get(lo, F.lit(i)), F.get(hi, F.lit(i))) * F.get(weights, F.lit(i)) for i, s in enumerate(signals)))
    there = F.col(signals[-1]).isNotNull()
    limit = F.when(there, threshold).otherwise(F.coalesce(fallback, F.raise_error(F.lit("no embedding and no fallback threshold")).cast("double")))
    value = F.when(there, full).otherwise(mean_of(signals[:3]))
    return value, value >= limit


def verdict(flagged: Column) -> Column:
    return F.when(flagged, "PLAGIARIZED").otherwise("NOT PLAGIARIZED")


def model_struct(model: DataFrame, signals: list[str], labels: str, lopo: DataFrame, fallback: DataFrame | None = None, fallback_lopo: DataFrame | None = None) -> DataFrame:
    """A fitted model and its held-out metrics in the schema of model files."""
    array = lambda names: F.array(*(F.col(n).cast("double") for n in names))
    metrics = lambda p: F.struct(*(F.col(f"{p}{m}").alias(m) for m in ("precision", "recall", "f1", "accuracy", "auc")))
    prefixed = lambda df, p: df.select(*(F.col(m).alias(f"{p}{m}") for m in ("precision", "recall", "f1", "accuracy", "auc")))
    out = model.crossJoin(prefixed(lopo, "c_"))
    columns = [F.array(*(F.lit(s) for s in signals)).alias("signals"), array([f"lo_{s}" for s in signals]).alias("lo"), array([f"hi_{s}" for s in signals]).alias("hi"), array([f"w{i + 1}" for i in range(len(signals))]).alias("weights"), "threshold", F.lit(labels).alias("labels"), metrics("c_").alias("lopo_composite")]
    if fallback is not None and fallback_lopo is not None:
        out = out.crossJoin(fallback.select(F.col("threshold").alias("f_threshold"))).crossJoin(prefixed(fallback_lopo, "f_"))
        columns.append(F.struct(F.array(*(F.lit(s) for s in signals[:3])).alias("signals"), F.col("f_threshold").alias("threshold"), metrics("f_").alias("lopo_metrics")).alias("no_embedding"))
    return out.select(*columns)
