"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

*Index.*  Spherical k-means on a bounded sample makes lists; every vector is put in the list of its nearest centre.
Lists are dealt in parts of bounded size, so a list may hold any share of the vectors.

*Probe.*  A query scans the lists whose centres are nearest.  How many is calibrated on the sample: as few as hold the
wanted share of the sample's true neighbours (data without clusters need many).  A bounded set of *seed* vectors gives
each query a first bound on the distance of its k-th neighbour.

*Scan.*  Vectors are rotated by a fixed random orthogonal matrix and compared in blocks of columns.  After t of d
columns the partial distance, scaled by d/t, is tested against the current bound: candidates that exceed it by
``1 + epsilon / sqrt(t)`` (squared) are abandoned.  Survivors of all blocks are scored exactly, in double precision, on
the original vectors, and tighten the bound.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither as queries nor as candidates; ties go to the smaller id; repeated ids count once, with their best
score; with fewer than k candidates all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinsift.sources.scratch import materialise

#: Vectors of a list in one part, and queries of a part compared at a time.
PART_ROWS = 4096
PART_QUERIES = 1024
CHUNK = 512


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    seed_ids: np.ndarray
    seeds: np.ndarray


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of little-endian doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, doubles as bytes) of vectors that can be searched."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        flat = column.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.concatenate(([0], np.cumsum(size)))
        keep, raw = [], []
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            v = values[stop[i] : stop[i + 1]]
            norm = float((v * v).sum()) if len(v) else 0.0
            if known[i] and np.isfinite(norm) and norm > 0:
                keep.append(i)
                raw.append(v.astype("<f8").tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(size[keep] if keep else [], pa.int32()), pa.array(raw, pa.binary())], names=["id", "d", "v"])


def build(vectors: DataFrame, count: int, d: int, k: int, per_list: int, most_lists: int, sample_rows: int, target: float, seed: int = 7) -> Index:
    """Centres, rotation, number of probes and seeds from a sample of at most about ``sample_rows`` vectors."""
    rows = max(256, min(sample_rows, (16 << 20) // (8 * d)))
    bound = int(min(1.0, rows / count) * (1 << 40))
    sample = vectors.filter(F.shiftrightunsigned(F.xxhash64("id"), 24) <= bound).select("id", "v").toArrow()
    order = np.argsort(sample.column("id").to_numpy(), kind="stable")
    ids, x = sample.column("id").to_numpy()[order], _unit(_matrix(sample.column("v"))[order])
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    lists = int(np.clip(count // per_list, 1, min(most_lists, max(1, len(x)))))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    own = (x @ centres.T).argmax(axis=1)
    some = rng.choice(len(x), min(400, len(x)), replace=False)
    near = x[some] @ x.T
    near[np.arange(len(some)), some] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.empty((len(some), lists), np.int64)
    np.put_along_axis(place, np.argsort(-(x[some] @ centres.T), axis=1), np.arange(lists)[None, :].repeat(len(some), 0), axis=1)
    need = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1 if len(need) else lists
    seeds = rng.choice(len(x), min(len(x), 1024), replace=False)
    seeds.sort()
    raw = _matrix(sample.column("v"))[order][seeds]
    return Index(centres, rotation, probes, ids[seeds], raw)


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if batch.num_rows:
                own = (_unit(_matrix(batch.column("v"))) @ index.centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32())], names=["id", "v", "list"])

    return run


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows, in double precision; equal rows get equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: by score, then smaller id."""
    order = np.lexsort((ids, -score, q))
    first = np.concatenate(([True], q[order][1:] != q[order][:-1])) if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


_FOUND = "query_id long, vec_id long, score double"


def _ask(sent, sizes: np.ndarray, k: int):
    """For each query the lists to scan, the bound that seeds give, and the seeds that gave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            ids = batch.column("id").to_numpy()
            order = np.argsort(-(_unit(v) @ index.centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            # enough lists, and enough vectors in them
            wanted = np.maximum(index.probes, 1 + (held < k + 1).sum(axis=1))
            lists = [o[:w][sizes[o[:w]] > 0].astype(np.int32) for o, w in zip(order, wanted)]
            bound, seen_ids, seen_scores = [], [], []
            seeds = index.seeds
            for i in range(len(ids)):
                s = _scores(np.broadcast_to(v[i], seeds.shape), seeds)
                other = index.seed_ids != ids[i]
                top = np.lexsort((index.seed_ids[other], -s[other]))[:k]
                seen_ids.append(index.seed_ids[other][top])
                seen_scores.append(s[other][top])
                bound.append(2 - 2 * seen_scores[-1][-1] if len(top) == k else 4.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(bound, pa.float64()), pa.array(lists, pa.list_(pa.int32())), pa.array(seen_ids, pa.list_(pa.int64())), pa.array(seen_scores, pa.list_(pa.float64()))], names=["query_id", "q", "bound", "lists", "seen", "seen_scores"])

    return run


def _scan(sent, k: int, epsilon: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return none
        index = sent.value
        vid, qid = vectors.column("id").to_numpy(), queries.column("query_id").to_numpy()
        v, q = _matrix(vectors.column("v")), _matrix(queries.column("q"))
        bound = queries.column("bound").to_numpy().copy()
        rv, rq = ((_unit(x) @ index.rotation).astype(np.float32) for x in (v, q))
        d = v.shape[1]
        step = max(8, -(-d // 4))
        cuts = list(range(0, d, step)) + [d]
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at in range(0, len(vid), CHUNK):
            c = rv[at : at + CHUNK]
            x, y = rq[:, : cuts[1]], c[:, : cuts[1]]
            part = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            qi, ci = np.nonzero((part <= _limit(bound, cuts[1], d, epsilon)[:, None]) & (qid[:, None] != vid[at : at + CHUNK][None, :]))
            dist = part[qi, ci]
            for lo, hi in zip(cuts[1:-1], cuts[2:]):
                dist = dist + ((rq[qi, lo:hi] - c[ci, lo:hi]) ** 2).sum(axis=1)
                keep = dist <= _limit(bound, hi, d, epsilon)[qi]
                qi, ci, dist = qi[keep], ci[keep], dist[keep]
            if not len(qi):
                continue
            score = _scores(q[qi], v[at + ci])
            every = [np.concatenate(z) for z in zip(got, (qi, vid[at + ci], score))]
            best = _best(*every, k)
            got = [z[best] for z in every]
            owner, count = np.unique(got[0], return_counts=True)
            full = owner[count == k]
            worst = np.full(len(qid), 2.0)
            np.minimum.at(worst, got[0], got[2])
            bound[full] = np.minimum(bound[full], 2 - 2 * worst[full])
        return pa.table({"query_id": pa.array(qid[got[0]]), "vec_id": pa.array(got[1]), "score": pa.array(got[2])})

    return run


def _limit(bound: np.ndarray, t: int, d: int, epsilon: float) -> np.ndarray:
    """Largest partial distance after t of d columns that is not abandoned; all columns allow for rounding only."""
    return bound + 1e-4 if t == d else (bound + 1e-4) * (t / d) * (1 + epsilon / np.sqrt(t)) ** 2


def search(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", per_list: int = 400, most_lists: int = 4096, sample_rows: int = 20_000, target: float = 0.97, epsilon: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine of each row for which ``queries`` holds.

    ``queries``: a condition on the id column.  The index is fitted on a sample of at most about ``sample_rows``
    vectors (16 MB); all vectors are indexed.  ``target``: share of the sample's true neighbours that probed lists must
    hold.  ``epsilon``: caution of the test that abandons candidates.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    raw = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(T.ArrayType(T.DoubleType())).alias("x"))
    clean = materialise(raw.mapInArrow(_usable, "id long, d int, v binary"), "ann-clean")
    lengths = clean.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    d, count = lengths["d"], lengths["count"]
    usable = clean.filter(F.col("d") == d).select("id", "v")
    sent = spark.sparkContext.broadcast(build(usable, count, d, k, per_list, most_lists, sample_rows, target))
    listed = materialise(usable.mapInArrow(_assign(sent), "id long, v binary, list int"), "ann-lists")
    held = {r.list: r.n for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most most_lists
    sizes = np.array([held.get(i, 0) for i in range(len(sent.value.centres))], dtype=np.int64)
    chosen = usable.withColumnRenamed("id", id_column).filter(queries).withColumnRenamed(id_column, "id")
    asked = materialise(chosen.mapInArrow(_ask(sent, sizes, k), "query_id long, q binary, bound double, lists array<int>, seen array<long>, seen_scores array<double>"), "ann-asked")
    want = {r.list: r.n for r in asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most most_lists

    # a list is scanned in cells: a part of its vectors against a group of the queries that probe it
    cells = [(i, max(1, -(-n // PART_ROWS)), -(-want[i] // PART_QUERIES)) for i, n in enumerate(sizes.tolist()) if i in want]
    lines = F.broadcast(spark.createDataFrame(cells, "list int, parts int, groups int"))
    left = listed.join(lines, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("list", "part", "group", "id", "v")
    right = asked.select("query_id", "q", "bound", F.explode("lists").alias("list")).join(lines, "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "group", "query_id", "q", "bound")
    keys = ("list", "part", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(sent, k, epsilon), _FOUND)
    seeds = asked.select("query_id", F.explode(F.arrays_zip("seen", "seen_scores")).alias("s")).select("query_id", F.col("s.seen").alias("vec_id"), F.col("s.seen_scores").alias("score"))
    best = found.unionByName(seeds).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
