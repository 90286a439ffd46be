"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most`` copies.  Of all rates that give every source its target of tokens,
the balanced ones lie closest, in (bounded) entropy, to one copy each; they are exponential tilts

    rate(d) / (most - rate(d))  =  exp(a_s * size(d) / scale_s) / (most - 1)

with one dual variable ``a_s`` per source.  The dual is convex; Newton iterations solve it, each a distributed
aggregation of gradient and curvature.  Since a rate depends only on source and size, the iterations run over the
table of (source, size, documents), which is pre-aggregated once.

Rates become whole copies by cumulative rounding along the sizes of a source, so a source misses its target by a
document or so, not by the square root of many.  Inside one (source, size) cell the documents that get the extra copy
are those with the smallest hash of their id; large cells are cut into parts first, so no part is unbounded.

Defined results: null texts have size 0 and are taken 0 times over; null sources are a source of their own, after all
others; repeated rows are documents of their own, told apart only by their place; an empty table gives an empty
result; reruns agree.  The driver holds one line of figures per source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinsift.llm.common import join_groups, release
from kinsift.sources.scratch import materialise

#: Documents of one part of a cell.
PART_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Runs of bytes outside 0x20 and 0x09-0x0D; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by repeating weights (sources by code point, null last).

    A target above ``most`` times its source's size stops there, and the excess is shared anew by weight among the
    others, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _rate(tilt: Column, most: float) -> Column:
    """The tilted rate: 1 at tilt 0, towards 0 and ``most`` at the ends; safe from overflow."""
    bounded = F.greatest(F.lit(-600.0), F.least(F.lit(600.0), tilt))
    return F.lit(most) / (F.lit(1.0) + F.lit(most - 1.0) * F.exp(-bounded))


def solve(cells: DataFrame, wanted: dict, sizes: dict, scales: dict, most: float = 2.0, tolerance: float = 1e-6, rounds: int = 60) -> dict:
    """Dual variable of each source (``inf`` where every document is needed ``most`` times).

    ``cells``: (key, size, docs).  Newton steps are kept inside a bracket that shrinks with every round.
    """
    dual = {s: math.inf if wanted[s] >= most * sizes[s] * (1 - 1e-12) else 0.0 for s in wanted if sizes[s] > 0}
    low, high = {}, {}
    active = {s for s, a in dual.items() if a == 0.0}
    spark = cells.sparkSession
    kind = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("scale", T.DoubleType())])
    for _ in range(rounds):
        if not active:
            break
        point = spark.createDataFrame([(s, dual[s], scales[s]) for s in sorted(active)], kind)
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("a") * x, most)
        at = cells.join(F.broadcast(point), "key").groupBy("key").agg(
            F.sum(F.col("docs") * F.col("size") * rate).alias("made"),
            F.sum(F.col("docs") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
        )
        for r in at.collect():
            gap = wanted[r.key] - r.made
            if abs(gap) <= tolerance * max(1.0, wanted[r.key]):
                active.discard(r.key)
                continue
            a = dual[r.key]
            (low if gap > 0 else high)[r.key] = a
            new = a + gap / r.slope if r.slope > 0 else math.nan
            lo, hi = low.get(r.key, -math.inf), high.get(r.key, math.inf)
            if not lo < new < hi or abs(new - a) > 50:
                new = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (max(1.0, 2 * lo) if math.isfinite(lo) else min(-1.0, 2 * hi))
            dual[r.key] = new
    return dual


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per document.

    Needs doc_id, text and source.  ``taken`` is size times copies.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    names = sorted(r.source for r in per if r.source is not None) + [None for r in per if r.source is None]
    key = {s: i for i, s in enumerate(names)}
    sizes = {r.source: r.size for r in per}
    wanted = targets(sizes, weights, share, most)
    scales = {key[r.source]: max(1.0, r.size / r.docs) for r in per}
    by_key, want = {key[s]: n for s, n in sizes.items()}, {key[s]: t for s, t in wanted.items()}

    line = T.StructType([T.StructField("source", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    lines = spark.createDataFrame([(s, key[s], int(sizes[s]), float(wanted[s])) for s in names], line)
    keyed = sized.join(F.broadcast(lines.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cells = materialise(keyed.groupBy("key", "size").agg(F.count("*").alias("docs")), "mix-cells")
    dual = solve(cells, want, by_key, scales, most)

    kind = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("scale", T.DoubleType())])
    found = spark.createDataFrame([(s, dual.get(s, 0.0), scales[s]) for s in sorted(scales)], kind)
    rated = cells.join(F.broadcast(found), "key").withColumn("rate", F.when(F.col("size") == 0, 0.0).when(F.col("a") == math.inf, float(most)).otherwise(_rate(F.col("a") * F.col("size") / F.col("scale"), float(most)))).drop("a", "scale")
    rated = materialise(rated.withColumn("parts", F.ceil(F.col("docs") / PART_ROWS).cast("int")), "mix-rates")

    # documents of a part, with their place in it
    total = sized.count()
    placed = join_groups(keyed, rated, ["key", "size"], "docs", total)
    placed = placed.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("part", F.pmod(F.col("h"), F.col("parts")).cast("int"))
    parts = materialise(placed.groupBy("key", "size", "part").agg(F.count("*").alias("n"), F.first("rate").alias("rate")), "mix-parts")

    # copies of a part; the parts of a source are as many as its sizes, and one for every PART_ROWS equal sizes
    run = parts.filter("size > 0").groupBy("key").applyInArrow(_round_parts(most), "key int, size long, part int, copies long")
    given = parts.join(run, ["key", "size", "part"], "left").select("key", "size", "part", "n", F.coalesce("copies", F.lit(0)).alias("part_copies"))
    ranked = join_groups(placed, given, ["key", "size", "part"], "n", total)
    # everyone gets the whole quotient; the rest goes to the smallest hashes
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id"))
    quotient = F.floor(F.col("part_copies") / F.col("n"))
    copies = quotient + F.when(place <= F.col("part_copies") - quotient * F.col("n"), 1).otherwise(0)
    return ranked.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _round_parts(most: int):
    """Whole copies of each part of one source: error feedback, in tokens, from the largest size to the smallest."""

    def run(table: pa.Table) -> pa.Table:
        release()
        size, part, n, rate = (table.column(c).to_numpy() for c in ("size", "part", "n", "rate"))
        # descending sizes: what a large document leaves over, smaller ones make up for
        order = np.lexsort((part, -size))
        copies = np.zeros(len(size), np.int64)
        debt = 0.0
        for i in order:
            exact = n[i] * rate[i] + debt / size[i]
            copies[i] = min(max(round(exact), 0), most * int(n[i]))
            debt += (n[i] * rate[i] - copies[i]) * size[i]
        return pa.table({"key": table.column("key"), "size": table.column("size"), "part": table.column("part"), "copies": pa.array(copies)})

    return run
