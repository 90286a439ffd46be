"""Removal of long repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts at least twice in the corpus.  Each such string is
judged once, at its *anchor*: the 40-byte gram with the smallest hash in it.  Equal strings have equal anchors, so all
starts of a string meet under the same key, and runs of neighbouring strings that share an anchor travel as one
*segment* of at most two string lengths.

1. *Anchors.*  One pass over whole texts finds the segments and for each a key (hash of the anchor and the text on the
   side where its strings reach further) and a digest of its bytes.  Only these numbers are shuffled.  Equal rows
   (same id and text) are one row with a weight.  A key that occurs once holds nothing repeated.
2. *Bytes.*  The segments of all other keys are read from their texts and counted by their bytes, pre-aggregated on
   the map side; segments of one key and digest but different bytes would end the run.
3. *Shards.*  Each distinct segment is sent once, with its multiplicity, to the shard of its key.  A shard sorts the
   suffixes of its text by Larsson-Sadakane refinement (only unsorted groups are refined, with ranks at doubled
   distance), gets common prefixes by Kasai's rule with all segments in parallel, and reads off which strings start
   twice.
4. *Merging across shards.*  Keys with very many segments are dealt to several shards; these send one line for each of
   their strings, by digest, to owners of digest ranges, which find strings of other shards by binary search.  What
   they find is compared by its bytes.
5. *Removal.*  Repeated runs go back to their documents, where they are united and cut out.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are documents of
their own and so repeat each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import CHUNK_BYTES, TEXT_ROWS, join_groups, release, slices, trim
from kinsift.llm.shingles import _BASE, _INV, _powers, mix64, text_buffer
from kinsift.sources.scratch import discard, keep_ids, materialise

#: Bytes of the gram that is the anchor.
GRAM = 40
#: Bytes of text that a shard gets on average, and segments of one key in one shard.
SHARD_BYTES = 1 << 20
KEY_SEGMENTS = 2048

_U64 = np.uint64
_BASE2, _INV2 = 0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)


class _Prefix:
    """Hashes of any substring of a buffer from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, name: str = "base", base: int = _BASE, inverse: int = _INV):
        n = len(data)
        self.sum = np.zeros(n + 1, dtype=_U64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(_U64) + _U64(1)) * _powers(name, base, n), out=self.sum[1:])
        self.inverse = _powers("i" + name, inverse, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sum[end] - self.sum[start]) * self.inverse[start])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, key, digest, first, last): runs of string starts, relative to their text, that share an anchor and a side."""
    n = len(data)
    none = np.zeros(0, np.int64)
    width = length - GRAM + 1
    if n < length:
        return none, none, none, none, none
    prefix = _Prefix(data)
    place = np.arange(n - GRAM + 1)
    with np.errstate(over="ignore"):
        low = (1 << 32) - 1  # bits for the place: equal hashes are told apart by it, the first wins
        value = (prefix(place, place + GRAM) & ~_U64(low)) | (place.astype(_U64) & _U64(low))
    best, reach = value, 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    # starts whose string ends inside their text
    text = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(text):
        return none, none, none, none, none
    begin = np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0)) - np.maximum(np.diff(offsets) - length + 1, 0)
    start = np.arange(len(text)) - begin[text] + offsets[text]
    anchor = (best[start] & _U64(low)).astype(np.int64)
    side = (anchor - start) > (length - GRAM) // 2  # the anchor lies in the right half: more text on its left
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (side[1:] != side[:-1]))))
    last = np.concatenate((new[1:], [len(start)])) - 1
    a, left = anchor[new], side[new]
    half = (length - GRAM) // 2
    # right side: strings reach at least to anchor + length - half; left side: from anchor - half - 1
    lo = np.where(left, a - half - 1, a)
    hi = np.where(left, a + GRAM, a + length - half)
    with np.errstate(over="ignore"):
        key = mix64(prefix(lo, hi) + left.astype(_U64))
    digest = prefix(start[new], start[last] + length)
    base = offsets[text[new]]
    return text[new], key.view(np.int64), digest.view(np.int64), start[new] - base, start[last] - base


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                text, key, digest, first, last = segments(data, offsets, length)
                count = np.bincount(text, minlength=part.num_rows)
                cuts = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (key, digest, (first << 8) | (last - first))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("u"), pa.array(serial + np.arange(part.num_rows)), *lists], names=["k", "u", "ref", "keys", "digests", "places"])
                serial += part.num_rows

    return run


def suffix_array(text: np.ndarray, wide: bool = False, enough: int | None = None) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Each round sorts only the groups that are not yet single, by the ranks at a distance that doubles; it ends when
    all are, since Kasai's rule needs the whole order.  ``wide``: the text holds whole numbers instead of bytes.
    ``enough``: end when suffixes are in the order of so many first places.
    """
    n = len(text)
    if wide:
        word, reach = text.astype(np.int64) + 1, 1
    else:
        reach = 8
        padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(_U64)
        word = np.zeros(n, dtype=_U64)
        for k in range(8):
            word = (word << _U64(8)) | padded[k : k + n]
    order = np.argsort(word, kind="stable")
    head = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    rank = np.empty(n, np.int64)
    at = np.flatnonzero(head)
    rank[order] = np.repeat(at, np.diff(np.append(at, n))) + 1  # 0 is beyond the end
    size = np.diff(np.append(at, n))
    spot = np.flatnonzero(np.repeat(size > 1, size))  # places in the order whose groups are not single
    while len(spot) and not (enough and reach >= enough):
        p = order[spot]
        beyond = p + reach
        # a suffix that ends before the distance comes before all that go on, the shorter first
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + reach, n - p)
        key = rank[p] * (n + reach + 2) + second
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[spot] = p
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(fresh) - 1
        rank[p] = spot[fresh][group] + 1
        spot = spot[np.bincount(group)[group] > 1]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cuts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in the order with the one before it.

    Kasai's rule: going one byte right loses at most one byte of the prefix.  Every stretch between ``cuts`` is walked
    at the same time, one comparison of each per step.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int32)
    at, end = cuts[:-1].copy(), cuts[1:]
    alive = np.flatnonzero(at < end)
    at, end = at[alive], end[alive]
    h = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        x, y = at + h, other + h
        same = (other >= 0) & (h < most) & (x < n) & (y < n)
        same &= text[np.minimum(x, n - 1)] == text[np.clip(y, 0, n - 1)]
        stop = ~same
        found[at[stop]] = h[stop]
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        at = at + stop
        if (at >= end).any():
            go = at < end
            at, end, h = at[go], end[go], h[go]
    return found[order]


def _runs(flags: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """First and last places of the runs of ``flags`` in each stretch, relative to the stretch."""
    begins = np.zeros(len(flags) + 1, bool)
    begins[cuts] = True
    first = np.flatnonzero(flags & (begins[:-1] | np.concatenate(([True], ~flags[:-1]))))
    last = np.flatnonzero(flags & (begins[1:] | np.concatenate((~flags[1:], [True]))))
    stretch = np.searchsorted(cuts, first, side="right") - 1
    stops = pa.array(np.searchsorted(first, cuts).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(stops, pa.array(x - cuts[stretch])) for x in (first, last))


def _shard(length: int):
    """Repeated string starts of each segment of a shard; of split keys also what merging needs."""

    def run(table: pa.Table) -> pa.Table:
        release()
        raw = table.column("raw").to_pylist()
        many = table.column("many").to_numpy()
        split = table.column("split").to_numpy()
        size = np.array([len(x) for x in raw], dtype=np.int64)
        cuts = np.concatenate(([0], np.cumsum(size)))
        text = np.frombuffer(b"".join(raw), np.uint8)
        order = suffix_array(text)
        shared = common_prefixes(text, order, cuts, length)
        run_of = np.empty(len(text), np.int64)
        run_of[order] = np.cumsum(shared < length)
        owner = np.repeat(np.arange(len(raw)), size)
        valid = np.arange(len(text)) - cuts[owner] <= size[owner] - length
        weight = np.bincount(run_of[valid], weights=many[owner[valid]], minlength=int(run_of.max()) + 1)
        twice = valid & (weight[run_of] > 1)
        inside = np.concatenate(([0], np.cumsum(size - length + 1)))
        flags = twice[valid]
        first, last = _runs(flags, inside)
        w1, w2, at = ([None] * len(raw) for _ in range(3))
        if split.any():
            one, two = _Prefix(text), _Prefix(text, "second", _BASE2, _INV2)
            start = np.flatnonzero(valid)
            # one line for each string: of one that stands here more than once all starts are found already
            start = np.sort(start[np.unique(run_of[start], return_index=True)[1]])
            start = start[split[owner[start]]]
            a, b = one(start, start + length).view(np.int64), two(start, start + length).view(np.int64)
            per = np.searchsorted(start, cuts)
            for i in np.flatnonzero(split):
                own = slice(per[i], per[i + 1])
                w1[i], w2[i], at[i] = a[own], b[own], start[own] - cuts[i]
        longs = pa.list_(pa.int64())
        trim()
        return pa.table({"key": table.column("key"), "digest": table.column("digest"), "shard": table.column("shard"), "first": first, "last": last, "w1": pa.array(w1, longs), "w2": pa.array(w2, longs), "at": pa.array(at, longs)})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Of the strings that shards sent to one owner, those that more than one shard has."""
    triple = np.stack([table.column(c).to_numpy() for c in ("w1", "w2", "shard")], axis=1)
    both, seen = np.unique(triple, axis=0, return_inverse=True)  # sorted: one entry for each string and shard
    fresh = np.concatenate(([True], (both[1:, :2] != both[:-1, :2]).any(axis=1))) if len(both) else np.zeros(0, bool)
    code = np.cumsum(fresh)
    # each shard's own sorted list, searched in the merged list of all
    hit = np.zeros(len(both), bool)
    for s in np.unique(both[:, 2]):
        own = np.flatnonzero(both[:, 2] == s)
        hit[own] = np.searchsorted(code, code[own], side="right") - np.searchsorted(code, code[own], side="left") > 1
    keep = pa.array(hit[seen.ravel()])
    return table.select(["w1", "w2", "key", "digest", "at"]).filter(keep)


def _bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                wanted = part.column("wanted")
                items = wanted.flatten()
                place = items.field("place").to_numpy()
                start = np.repeat(offsets[:-1], wanted.value_lengths().to_numpy()) + (place >> 8)
                size = (place & 255) + length
                stop = np.cumsum(size)
                at = 0
                while at < len(size):  # a long text has more bytes of segments than one array should hold
                    to = max(at + 1, int(np.searchsorted(stop, stop[at] + CHUNK_BYTES)))
                    n, ends = size[at:to], np.cumsum(size[at:to])
                    raw = data[np.repeat(start[at:to] - ends + n, n) + np.arange(ends[-1])]
                    cuts = np.concatenate(([0], ends)).astype(np.int32)
                    segment = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([items.field("key")[at:to], items.field("digest")[at:to], segment], names=["key", "digest", "raw"])
                    at = to

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, spans_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                column = part.column("spans") if "spans" in part.schema.names else pa.array([[]] * part.num_rows, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))
                flat = column.flatten()
                a, z = (flat.field(k).to_numpy() for k in (0, 1))
                stop = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
                removed, runs, sha, made = [], [], [], []
                for i in range(part.num_rows):
                    text = data[offsets[i] : offsets[i + 1]]
                    gone = np.zeros(len(text) + 1, np.int64)
                    np.add.at(gone, a[stop[i] : stop[i + 1]], 1)
                    np.add.at(gone, z[stop[i] : stop[i + 1]], -1)
                    cut = np.cumsum(gone)[:-1] > 0
                    removed.append(int(cut.sum()))
                    edge = np.diff(cut.astype(np.int8), prepend=0, append=0)
                    starts = np.flatnonzero(edge == 1)
                    runs.append(len(starts))
                    made.append([{"start": int(x), "end": int(y)} for x, y in zip(starts, np.flatnonzero(edge == -1))])
                    sha.append(hashlib.sha256(text[~cut].tobytes() if removed[-1] else text.tobytes()).hexdigest())
                columns = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if spans_out:
                    columns.append(pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, spans_out: bool = False, key_segments: int = KEY_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans]), one row per row of ``docs`` (doc_id, text).

    ``length``: bytes of a string that counts as repeated (over 40, at most 296).  ``spans_out``: also the removed
    byte ranges.  ``key_segments``: distinct segments of a key beyond which it is dealt to several shards.
    """
    if not GRAM < length <= GRAM + 256:
        raise ValueError("length must be over 40 and at most 296")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # equal rows have equal (k, u); a null id is as good as any other number here
    docs = docs.withColumns({"k": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "u": F.xxhash64("text")})
    scanned = materialise(docs.select("k", "u", "text").mapInArrow(_scan(length), "k long, u long, ref long, keys array<long>, digests array<long>, places array<long>"), "suffix-scan", TEXT_ROWS)
    spare = materialise(scanned.groupBy("k", "u").agg(F.min("ref").alias("first"), F.count("*").alias("n")).filter("n > 1"), "suffix-spare")
    extra = materialise(join_groups(scanned.select("k", "u", "ref"), spare, ["k", "u"], "n", scanned.count()).filter("ref <> first").select("ref"), "suffix-extra")
    sole = keep_ids(scanned, extra, "ref", "left_anti")
    sole = sole.join(_sized(spare.select(F.col("first").alias("ref"), F.col("n").alias("weight"))), "ref", "left")
    rows = sole.select("ref", F.coalesce("weight", F.lit(1)).alias("weight"), F.posexplode("keys").alias("i", "key"), "digests", "places").select("ref", "weight", "key", F.get("digests", F.col("i")).alias("digest"), F.get("places", F.col("i")).alias("place"))
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).filter("weight > 1").select("key", "n"), "suffix-keys")
    total = scanned.agg(F.sum(F.size("keys")).alias("n")).first().n or 0
    suspects = materialise(join_groups(rows.drop("weight"), keys, ["key"], "n", total).drop("n"), "suffix-suspects")

    refs = materialise(keep_ids(scanned.select("ref", "k", "u"), extra, "ref", "left_anti"), "suffix-refs")
    discard(scanned, extra, spare, keys)

    # distinct segments by their bytes
    wanted = suspects.groupBy("ref").agg(F.collect_list(F.struct("key", "digest", "place")).alias("wanted"))
    wanted = materialise(wanted.join(refs, "ref").select("k", "u", "wanted"), "suffix-wanted")
    raw = _with_rows(docs.drop("doc_id"), wanted).select("text", "wanted").mapInArrow(_bytes(length), "key long, digest long, raw binary")
    distinct = materialise(raw.groupBy("key", "digest", "raw").agg(F.count("*").alias("many")), "suffix-distinct", TEXT_ROWS)
    discard(wanted)
    if distinct.groupBy("key", "digest").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two segments share a key and a digest")
    dealt = distinct.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > key_segments).select("key", F.ceil(F.col("c") / key_segments).cast("int").alias("salts"))
    dealt = materialise(dealt, "suffix-dealt")
    told = distinct.agg(F.sum(F.length("raw")).alias("size"), F.sum("many").alias("many")).first()
    shards = max(1, -(-int(told.size or 0) // SHARD_BYTES))
    sharded = distinct.join(_sized(dealt), "key", "left").withColumn("split", F.col("salts").isNotNull()).withColumn("shard", F.when(F.col("split"), -1 - F.pmod(F.xxhash64("key", F.pmod("digest", "salts")), F.lit(1 << 40))).otherwise(F.pmod("key", F.lit(shards))).cast("long"))
    found = sharded.select("shard", "key", "digest", "many", "split", "raw").groupBy("shard").applyInArrow(_shard(length), "key long, digest long, shard long, first array<long>, last array<long>, w1 array<long>, w2 array<long>, at array<long>")
    found = materialise(found, "suffix-found")
    repeated = found.select("key", "digest", F.explode(F.arrays_zip("first", "last")).alias("r")).select("key", "digest", F.col("r.first").alias("first"), F.col("r.last").alias("last"))

    # strings of split keys, merged across shards
    sent = found.filter("w1 IS NOT NULL").select("key", "digest", "shard", F.explode(F.arrays_zip("w1", "w2", "at")).alias("w")).select("key", "digest", "shard", F.col("w.at").alias("at"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    strings = found.agg(F.sum(F.size("w1")).alias("n")).first().n or 0
    merged = sent.withColumn("owner", F.pmod("w1", F.lit(max(16, strings // 500_000)))).groupBy("owner").applyInArrow(_merge, "w1 long, w2 long, key long, digest long, at long")
    said = merged.join(distinct.select("key", "digest", "raw"), ["key", "digest"]).withColumn("said", F.expr(f"substring(raw, CAST(at + 1 AS INT), {length})"))
    differ = F.when(F.min("said") != F.max("said"), F.raise_error(F.lit("two strings share a digest"))).otherwise(F.collect_list(F.struct("key", "digest", "at")))  # one of each shard
    merged = said.groupBy("w1", "w2").agg(differ.cast("array<struct<key:long,digest:long,at:long>>").alias("x")).select(F.explode("x").alias("x")).select("x.key", "x.digest", F.col("x.at").alias("first"), F.col("x.at").alias("last"))

    ranges = repeated.unionByName(merged).groupBy("key", "digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = materialise(ranges.join(distinct.select("key", "digest", "many"), ["key", "digest"]), "suffix-ranges")
    discard(distinct, dealt, found)
    some = join_groups(suspects, ranges, ["key", "digest"], "many", told.many or 0).select("ref", "place", F.explode("ranges").alias("r"))
    some = some.select("ref", (F.shiftright("place", 8) + F.col("r.first")).alias("a"), (F.shiftright("place", 8) + F.col("r.last") + length).alias("z"))
    spans = materialise(some.groupBy("ref").agg(F.collect_list(F.struct("a", "z")).alias("spans")).join(refs, "ref").select("k", "u", "spans"), "suffix-spans")
    discard(suspects, ranges, refs)

    out = _RESULT + (", spans array<struct<start:long,end:long>>" if spans_out else "")
    touched = _with_rows(docs, spans).select("doc_id", "text", "spans").mapInArrow(_cut(length, spans_out), out)
    clean = keep_ids(docs.withColumn("ku", F.struct("k", "u")), spans.select(F.struct("k", "u").alias("ku")), "ku", "left_anti").select("doc_id", "text").mapInArrow(_cut(length, spans_out), out)
    return touched.unionByName(clean)


def _sized(df: DataFrame, small: int = 500_000) -> DataFrame:
    """A materialised table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= small else df


def _with_rows(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents that have a line in ``lists`` (materialised; k, u and a list), with that list."""
    some = keep_ids(docs.withColumn("ku", F.struct("k", "u")), lists.select(F.struct("k", "u").alias("ku")), "ku", "left_semi").drop("ku")
    return some.join(lists, ["k", "u"])


#: For DuckDB, at 200 bytes: windows are cut from hexadecimal digits, two for a byte.
SQL = """
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- pieces of 400 digits that start at every 200th, so windows are cut from short strings
p AS MATERIALIZED (SELECT doc_id, k * 200 AS base, substr(h, CAST(k * 400 + 1 AS BIGINT), 800) AS x FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 400)) AS k FROM b)),
w AS MATERIALIZED (SELECT doc_id, base + j AS i, substr(x, CAST(2 * j + 1 AS BIGINT), 400) AS s FROM (SELECT doc_id, base, x, unnest(generate_series(0, 199)) AS j FROM p) WHERE length(x) >= 2 * j + 400),
r AS MATERIALIZED (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT doc_id, i FROM w SEMI JOIN r USING (s)),
head AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM head) GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM run),
k AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS last,
  string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""
