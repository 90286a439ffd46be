"""Near-duplicates by bottom-k sketches of one hash function.

1. *Sketch.*  One 64-bit hash per word shingle; a document keeps its ``k`` smallest distinct values.  Documents with
   the same shingle set (same 128-bit digest of the sorted set) are one *class* and go on as one representative.
2. *Inverted lists.*  A linked pair shares at least ``least`` of its retained values (deterministically for small
   sets, else but for about 5e-9 at similarity 0.8 with k=40, least=15), so of the values that any other class
   retains it shares one among the ``m - least + 1`` rarest of its ``m``.  Only those enter the lists, which keeps
   common lines and passages out of nearly all of them.
3. *Stars.*  In each list every class is compared with the smallest one; what links becomes one component, and pairs
   inside a component need no further comparison.
4. *Rest.*  Short lists that still hold several components are compared in full.  Classes of long ones are *crowded*:
   for them the lists are built anew from their full sets, where a class must share 80 % (the similarity) of its
   shingles with other crowded classes to take part at all, and only the rarest fifth of its values are keys.  What
   these lists still leave open is compared in cells of two blocks.  A component of more than a block has blocks of its
   own, and cells inside it are left out; so the cells of a list grow with what is not joined yet, no list meets in one
   task and no pair is given up.
   A pair counts if set sizes allow the similarity and the union sketch shows enough matches; then the exact
   Jaccard of the full shingle sets decides, in integers.
5. *Components* of the links by large-star/small-star rounds.

Defined results: null or empty texts have no shingles, link with nothing and stay; a text shorter than a shingle has
its whole word sequence as the only one; equal sets always link; repeated ids are one document; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import TEXT_ROWS, join_groups, release, slices, trim
from kinsift.llm.shingles import Words, shingle_hashes, text_buffer
from kinsift.operators.graph import connected_components, spanning_roots
from kinsift.sources.scratch import discard, keep_ids, materialise

#: Classes of one list that a block comparison holds on either side.
BLOCK = 512
#: Lists up to so many classes are compared in full by their sketches.
SHORT = 32
#: Pairs of one class that are joined with its sketch or set under one key.
FAN = 2048


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    data, offsets = text_buffer(batch.column("text"))
    values, cuts = shingle_hashes(Words(data, offsets), words)
    values = values >> np.uint64(1)  # positive as int64, so every side orders them alike
    for i in range(batch.num_rows):
        own = np.sort(values[cuts[i] : cuts[i + 1]])
        yield i, own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def _sketch(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, digests, kept = [], [], []
                for _, own in _sets(part, words):
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    kept.append(own[:k].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sketch"])

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [own.astype(np.int64) for _, own in _sets(part, words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [flat[cuts[i] : cuts[i + 1]] for i in range(len(column))]


def _union_sketch(x: np.ndarray, y: np.ndarray, k: int, least: int) -> bool:
    """Whether enough of the k smallest values of the union are in both."""
    both = np.sort(np.concatenate((x, y)))
    match = np.flatnonzero(both[1:] == both[:-1])
    # the place of a match in the union is its index less the matches before it
    inside = np.count_nonzero(match - np.arange(len(match)) < k)
    return bool(inside * k >= least * min(k, len(both) - len(match)))


def _promising(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([_union_sketch(x, y, k, least) for x, y in zip(_rows(batch.column("sa")), _rows(batch.column("sb")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _matches(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right`` (indices), by products of incidence columns."""
    value, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(flat, minlength=len(value)) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[flat]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, (lo, lo + width))
        sides = []
        for k, n in ((0, len(left)), (1, len(right))):
            at = place[k, owner[a:z]]
            x = np.zeros((n, width), np.float32)
            x[at[at >= 0], column[a:z][at >= 0] - lo] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _short_pairs(k: int, least: int, percent: int):
    """Pairs of different components in one short list that sketches and sizes do not rule out."""

    def run(members: pa.Table) -> pa.Table:
        release()
        ids, comp, n = (members.column(c).to_numpy() for c in ("id", "component", "n"))
        sketches = [row for chunk in members.column("sketch").chunks for row in _rows(chunk)]
        every = np.arange(len(ids))
        match = _matches(every, every, sketches)
        low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        some = (ids[:, None] < ids[None, :]) & (comp[:, None] != comp[None, :]) & (100 * low >= percent * high)
        i, j = np.nonzero(some & (match * k >= least * np.minimum(k, high)))
        ok = [_union_sketch(sketches[x], sketches[y], k, least) for x, y in zip(i, j)]
        i, j = i[ok], j[ok]
        return pa.table({"a": ids[i].astype(np.int64), "b": ids[j].astype(np.int64)})

    return run


def _block_links(percent: int):
    """Components that links between classes in one block cell of one list join, by full sets: (root, component)."""

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        ids, comp = (cell.column(c).to_numpy() for c in ("id", "component"))
        sets = [row for chunk in cell.column("shingles").chunks for row in _rows(chunk)]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = _matches(left, right, sets).astype(np.int64)
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        i, j = np.nonzero(linked & (comp[left][:, None] != comp[right][None, :]))
        # components are what counts: a tree over those that the cell joins says it all
        edges = np.unique(np.stack((comp[left[i]], comp[right[j]]), axis=1), axis=0)
        node, root = (x.astype(np.int64) for x in spanning_roots(edges[:, 0], edges[:, 1]))
        trim()
        return pa.table({"a": root[node != root], "b": node[node != root]})

    return run


def _beside(pairs: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """Join of ``total`` pairs with the table of one of their ends; the line of an end with many pairs stands under several keys."""
    if total <= FAN:
        return pairs.join(side, key)
    hot = materialise(pairs.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > FAN).select(key, F.ceil(F.col("n") / FAN).cast("int").alias("salts")), "near-hot")
    many = hot.count()
    if not many:
        return pairs.join(side, key)
    hot = F.broadcast(hot) if many <= 500_000 else hot
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("salts")
    right = side.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, k: int, least: int, percent: int) -> DataFrame:
    """Of distinct class pairs (a < b), those whose full sets reach the similarity."""
    pairs = materialise(pairs, "near-candidates")
    total = pairs.count()
    if not total:
        return pairs.select("a", "b")
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = _beside(_beside(pairs, left, "a", total), right, "b", total).filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = materialise(near.select("a", "b", "sa", "sb").mapInArrow(_promising(k, least), "a long, b long"), "near-pairs")
    ids = materialise(near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct(), "near-ids")
    full = keep_ids(docs, ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_full(words), "doc_id long, shingles array<long>")
    full = materialise(full, "near-sets", TEXT_ROWS)
    total = near.count()
    both = _beside(near, full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a", total)
    both = _beside(both, full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b", total)
    inter = F.size(F.array_intersect("xa", "xb")).cast("long")
    out = materialise(both.filter(100 * inter >= percent * (F.size("xa") + F.size("xb") - inter)).select("a", "b"), "near-links")
    discard(pairs, near, ids, full)
    return out


def _rarest(entries: DataFrame, need) -> DataFrame:
    """(id, v): of each class's values that another class has, all but its ``need - 1`` most frequent.

    ``entries``: (id, v, len), values distinct in a class.  Classes with fewer than ``need`` such values link with
    nothing.
    """
    df = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    own = entries.join(df, "v").groupBy("id").agg(F.first("len").alias("len"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = own.select("id", F.size("vs").alias("m"), need.cast("int").alias("need"), "vs").filter("m >= need")
    return own.select("id", F.explode(F.slice("vs", F.lit(1), F.col("m") - F.col("need") + 1)).alias("e")).select("id", F.col("e.v").alias("v"))


def _open_lists(lists: DataFrame, parts: DataFrame, least_members: int) -> tuple[DataFrame, DataFrame]:
    """(v, id, component) of all lists, and (v, members) of those with several components and enough members.

    Lists of the same members need one comparison; they are told apart by two 64-bit sums over the members.
    """
    label = lists.join(parts.withColumnRenamed("node", "id"), "id", "left").select("v", "id", F.coalesce("component", "id").alias("component"))
    label = materialise(label, "near-label")
    per = label.groupBy("v").agg(F.count("*").alias("members"), (F.min("component") < F.max("component")).alias("several"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("component", "id").cast("decimal(20,0)")).alias("t"))
    return label, per.filter(F.col("several") & (F.col("members") >= least_members)).groupBy("members", "s", "t").agg(F.min("v").alias("v"))


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _crowd_links(lists: DataFrame, parts: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): components to join, from all pairs of different components that share a list, in cells of two blocks."""
    label, open_ = _open_lists(lists, parts, 2)
    member = materialise(label.join(open_.select("v"), "v"), "near-member")
    if not member.limit(1).count():  # nothing is left open
        return member.select(F.col("id").alias("a"), F.col("component").alias("b"))
    # blocks (v, c, b): of a large component c for itself, of all small ones (c = -1) together
    per = materialise(member.groupBy("v", "component").agg(F.count("*").alias("n")), "near-per")
    large = per.filter(F.col("n") > BLOCK).select("v", F.col("component").alias("c"), "n")
    small = per.filter(F.col("n") <= BLOCK).groupBy("v").agg(F.sum("n").alias("n")).select("v", F.lit(-1).cast("long").alias("c"), "n")
    kinds = materialise(large.unionByName(small).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "near-kinds")
    own = member.join(kinds.filter("c >= 0").select("v", F.col("c").alias("component"), F.lit(True).alias("large")), ["v", "component"], "left")
    own = own.withColumn("c", F.when(F.col("large"), F.col("component")).otherwise(F.lit(-1)).cast("long")).join(kinds.select("v", "c", "blocks"), ["v", "c"])
    own = own.select("v", "c", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"), "id", "component")
    blocks = kinds.select("v", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select("v", F.struct("c", "b").alias("x"))
    cells = blocks.join(blocks.withColumnRenamed("x", "y"), "v").filter("x <= y AND (x.c <> y.c OR x.c = -1)")
    cells = cells.withColumn("cell", F.struct("x", "y"))
    ends = cells.filter("x < y").select("v", "cell", "y.c", "y.b", F.lit(1).alias("side")).union(cells.select("v", "cell", "x.c", "x.b", F.expr("IF(x = y, 2, 0)").alias("side")))
    placed = own.join(ends, ["v", "c", "b"]).select("v", "cell", "side", "id", "component")
    out = materialise(placed.join(full, "id").groupBy("v", "cell").applyInArrow(_block_links(percent), "a long, b long").distinct(), "near-crowd-links")
    discard(label, member, per, kinds)
    return out


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 40, least: int = 15) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document of ``docs`` (needs doc_id and text).

    ``words`` per shingle; ``percent``: similarity from which two documents link.  ``k`` and ``least`` set the
    chance of missing a link (see the module); ``component_id`` is the smallest doc_id that links reach.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialise(docs.mapInArrow(_sketch(words, k), "doc_id long, n long, digest binary, sketch array<long>"), "near-sketch", TEXT_ROWS)
    some = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-class")

    # inverted lists of each class's rarest shared values
    entries = classes.select("id", F.explode("sketch").alias("v"), F.size("sketch").alias("len"))
    lists = materialise(_rarest(entries, F.ceil(F.col("len") * least / k)), "near-lists")

    # stars: every member of a list against its smallest
    heads = lists.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("members")).filter("members > 1")
    stars = materialise(lists.join(heads, "v").filter("id > a").select("a", F.col("id").alias("b")).distinct(), "near-stars")
    links = _links(stars, classes, docs, words, k, least, percent)
    parts = materialise(connected_components(links, "a", "b"), "near-parts")

    # lists that still hold several components
    label, open_ = _open_lists(lists, parts, 3)  # stars have compared lists of two
    open_ = materialise(open_, "near-open")
    short = label.join(open_.filter(F.col("members") <= SHORT).select("v"), "v").join(classes.select("id", "n", "sketch"), "id")
    rest = short.groupBy("v").applyInArrow(_short_pairs(k, least, percent), "a long, b long").distinct()
    more = _links(rest.join(stars, ["a", "b"], "left_anti"), classes, docs, words, k, least, percent)

    # classes of long ones, by their full sets
    crowd = materialise(label.join(open_.filter(F.col("members") > SHORT).select("v"), "v").select(F.col("id").alias("doc_id")).distinct(), "near-crowd")
    discard(lists, stars, label, open_)
    dense = _edges(parts)
    if crowd.limit(1).count():
        full = materialise(keep_ids(docs, crowd, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_full(words), "doc_id long, shingles array<long>").withColumnRenamed("doc_id", "id"), "near-crowd-sets", TEXT_ROWS)
        entries = full.select("id", F.explode("shingles").alias("v"), F.size("shingles").alias("len"))
        lists = materialise(_rarest(entries, F.ceil(F.col("len") * percent / 100)), "near-crowd-lists")
        # first each class in its longest list only: near copies share most lists, and joined there need no other
        longest = lists.join(lists.groupBy("v").agg(F.count("*").alias("members")), "v").groupBy("id").agg(F.max(F.struct("members", "v")).alias("top")).select("id", F.col("top.v").alias("v"))
        first = _crowd_links(longest, parts, full, percent)
        parts = materialise(connected_components(_edges(parts).union(first), "a", "b"), "near-parts")
        dense = _edges(parts).union(_crowd_links(lists, parts, full, percent))
        discard(crowd, full, lists)

    reach = connected_components(dense.union(more), "a", "b")
    done = classes.join(reach.withColumnRenamed("node", "id"), "id", "left").select("digest", "members", F.coalesce("component", "id").alias("component_id"))
    done = materialise(done, "near-done")
    discard(classes)
    total = some.count()
    linked = join_groups(some.select("doc_id", "n", "digest"), done, ["digest"], "members", total).select("doc_id", "n", "component_id")
    bare = sketched.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: For DuckDB, at 4-word shingles and 80 %.
SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT r.node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, r.node = min(r.seen) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
