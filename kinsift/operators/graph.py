"""Connected components and graph tables over edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.sources.scratch import materialise


def spanning_roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node reachable from each, by numpy label propagation."""
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars around the smallest node of each local component."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        nodes, root = spanning_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates large-star and small-star steps until the edge set is a fixed point; each round is a few
    equi-joins and map-side-combined minimums, and is written to the scratch area, so no part of the graph
    ever meets on one machine.  Ids are longs.  Self loops make a node of its own; nulls are ignored.
    """
    given = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    given = materialise(given, "cc-given")
    loops = given.filter("u = v").select(F.col("u").alias("node")).distinct()
    now = materialise(given.filter("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), "m").filter("a <> m")
        now = materialise(small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (new.n, new.s) == mark:
            break
        mark = (new.n, new.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = now.select(F.col("v").alias("node")).union(loops).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.union(alone.select("node", F.col("node").alias("component")))


#: Edges that a task holds before it replaces them by a forest.
HELD = 1 << 21


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v, w) of a task to (u, v, n, w): each node, the smallest of its component here, its edges as side u and their sum."""
    forest, ids, n, w, held = (np.empty(0, np.int64),) * 2, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), []

    def flush():
        nonlocal forest, ids, n, w, held
        u, v, x = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        nodes, root = spanning_roots(np.concatenate([forest[0], u]), np.concatenate([forest[1], v]))
        where = np.searchsorted(nodes, np.concatenate([ids, u]))
        n = np.bincount(where, np.concatenate([n, np.ones(len(u))]), len(nodes)).astype(np.int64)
        w = np.bincount(where, np.concatenate([w, x]), len(nodes))
        forest, ids, held = (nodes, root), nodes, []

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) > HELD:
            flush()
    if held:
        flush()
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*forest, n, w)], names=["u", "v", "n", "w"])


def groups(pairs: DataFrame, block: str, a: str, b: str, weight: str, flag: str = "flagged", separator: str = ";", prefix: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Connected groups of flagged pairs per block: (block, group_id, size, files, num_flagged_edges, avg_composite).

    Nodes are names within a block; groups have two members at least.  Ids are the block's name, or ``prefix``, and a
    number by smallest member.  ``nodes``: (block, name) of all that may occur; without it ``pairs`` is read for them.
    Each task replaces its edges by a forest, so the edges themselves are not written.
    """
    from pyspark.sql.window import Window

    flagged = pairs.filter(F.col(flag).cast("int") == 1)
    node = lambda c: F.xxhash64(F.col(block).cast("string"), F.col(c).cast("string"))
    forest = materialise(flagged.select(node(a).alias("u"), node(b).alias("v"), F.col(weight).cast("double").alias("w")).mapInArrow(_forest, "u long, v long, n long, w double"), "group-forest")
    parts = connected_components(forest, "u", "v").withColumnRenamed("node", "i")
    if nodes is None:
        nodes = flagged.select(block, F.col(a).alias("file")).union(flagged.select(block, F.col(b).alias("file")))
    named = nodes.toDF(block, "file").select(block, F.col("file").cast("string").alias("file")).distinct()
    members = named.withColumn("i", node("file")).join(parts, "i")
    listed = members.groupBy(block, "component").agg(F.count("*").cast("int").alias("size"), F.sort_array(F.collect_set("file")).alias("names"))
    total = F.sum("n")
    weights = forest.filter("n > 0").join(parts.withColumnRenamed("i", "u"), "u").groupBy("component").agg(total.cast("int").alias("num_flagged_edges"), F.bround(F.sum("w") / total, 4).alias("avg_composite"))
    number = F.dense_rank().over(Window.partitionBy(block).orderBy(F.array_min("names")))
    out = listed.join(weights, "component").filter("size >= 2")
    return out.select(block, F.concat_ws("_", F.col(block).cast("string") if prefix is None else F.lit(prefix), number.cast("string")).alias("group_id"), "size", F.array_join("names", separator).alias("files"), "num_flagged_edges", "avg_composite")


def degrees(pairs: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """(block, node, degree) over an undirected edge table."""
    ends = pairs.select(block, F.col(a).alias("node")).union(pairs.select(block, F.col(b).alias("node")))
    return ends.groupBy(block, "node").agg(F.count("*").alias("degree"))


def matrix_long(pairs: DataFrame, block: str, a: str, b: str, value: str) -> DataFrame:
    """(block, i, j, value): both directions of every pair, and 1 on the diagonal."""
    there = pairs.select(block, F.col(a).alias("i"), F.col(b).alias("j"), F.col(value).alias("value"))
    back = there.select(block, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    nodes = there.select(block, "i").union(back.select(block, "i")).distinct()
    return there.union(back).union(nodes.select(block, "i", F.col("i").alias("j"), F.lit(1.0).alias("value")))


def heatmap(pairs: DataFrame, block: str, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """The matrix with a column for each of ``names`` (for display: as many columns as names)."""
    return matrix_long(pairs, block, a, b, value).groupBy(block, "i").pivot("j", names).agg(F.first("value"))
