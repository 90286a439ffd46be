"""Pairs that share items, found without a shuffle of pairs or of items with their documents' names.

Items travel packed (sorted differences and small document numbers).  Items with the same documents are one *posting* with a
weight, so a passage costs as much as a word, and each document's pairs arise in one task from the postings it is in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.sources.scratch import materialise

#: Documents whose pairs arise in one task, and meetings that are held at once there.
OWN, MEETINGS = 1 << 14, 1 << 21


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers in as few bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(width: int, data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.reshape(-1).view("<u8")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the list, value) of every value."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _packer(bits: int) -> Callable:
    """(doc, items, marked) to (bucket, base, wh, h, wd, d, sizes): the items of a batch by their first ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            base = int(ids.min())
            (wi, items), (wm, marked) = (_lists(batch.column(c)) for c in (1, 2))
            sizes = np.stack([ids, np.bincount(wi, minlength=len(ids)), np.bincount(wm, minlength=len(ids))], axis=1).astype("<i8")
            code = (ids - base).astype(np.uint64) * np.uint64(2)
            h = np.concatenate([items, marked]).astype(np.int64).view(np.uint64)
            code = np.concatenate([code[wi], code[wm] | np.uint64(1)])
            turn = np.lexsort((code, h))
            h, code = h[turn], code[turn]
            chosen = np.zeros(len(h), bool)
            chosen[:-1] = (h[1:] == h[:-1]) & (code[1:] == code[:-1] + np.uint64(1))
            own = code % np.uint64(2) == 0
            h, code = h[own], code[own] | chosen[own].astype(np.uint64)
            ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), "right")
            rows, start = [], 0
            for bucket, end in enumerate(ends.tolist()):
                if end > start:
                    low = h[start:end] & np.uint64((1 << (64 - bits)) - 1)
                    rows.append((bucket, base, *_narrow(np.diff(low, prepend=np.uint64(0))), *_narrow(code[start:end]), None))
                start = end
            rows.append((base % (1 << bits), base, 1, b"", 1, b"", sizes.tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "base", "wh", "h", "wd", "d", "sizes"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(kind: int, key: np.ndarray, weight: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> pa.Table:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    columns = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(weight.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(docs.astype(np.int64)))]
    return pa.table(columns, names=["kind", "key", "weight", "docs"])


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _collapse(table: pa.Table) -> pa.Table:
    """Postings of a bucket: kind 0 of items, 1 of marked items, 2 the sizes (key: document, docs: the number marked)."""
    hs, docs, marks, sizes = [], [], [], []
    for r in table.to_pylist():
        if r["sizes"] is not None:
            sizes.append(np.frombuffer(r["sizes"], "<i8").reshape(-1, 3))
            continue
        code = _wide(r["wd"], r["d"])
        hs.append(np.cumsum(_wide(r["wh"], r["h"]), dtype=np.uint64))
        docs.append((code >> np.uint64(1)).astype(np.int64) + r["base"])
        marks.append(code & np.uint64(1))
    none = np.empty(0, np.int64)
    out = [_table(0, none, none, none, none)]
    if sizes:
        s = np.concatenate(sizes)
        out.append(_table(2, np.ascontiguousarray(s[:, 0]), s[:, 1], np.ones(len(s), np.int64), s[:, 2]))
    if hs:
        h, doc, mark = np.concatenate(hs), np.concatenate(docs), np.concatenate(marks)
        turn = np.lexsort((doc, h))
        h, doc, mark = h[turn], doc[turn], mark[turn]
        for kind in (0, 1):
            if kind:
                h, doc = h[mark == 1], doc[mark == 1]
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            length = np.diff(np.append(start, len(h)))
            start, length = start[length > 1], length[length > 1]
            if not len(start):
                continue
            where = _spread(start, length)
            key = np.add.reduceat(_mixed(doc[where].view(np.uint64)), np.cumsum(length) - length)
            key, first, which = np.unique(key, return_index=True, return_inverse=True)
            start, length = start[first], length[first]
            out.append(_table(kind, key, np.bincount(which), length, doc[_spread(start, length)]))
    return pa.concat_tables(out)


def postings(docs: DataFrame, made: Callable | None = None) -> DataFrame:
    """(kind, key, weight, docs) of (doc, items, marked): sets of longs, ``marked`` a part of ``items``, ids not repeated.

    ``made`` turns batches of ``docs`` into batches of these columns inside the task that packs them.
    """
    count = docs.select("doc").count()
    bits = max(5, math.ceil(math.log2(max(1, count) / 1000)))
    pack = _packer(bits)
    run = (lambda batches: pack(made(batches))) if made else pack
    packed = (docs if made else docs.select("doc", "items", "marked")).mapInArrow(run, "bucket int, base long, wh int, h binary, wd int, d binary, sizes binary")
    found = packed.groupBy("bucket").applyInArrow(_collapse, "kind int, key long, weight long, docs array<long>")
    return materialise(found.groupBy("kind", "key").agg(F.sum("weight").alias("weight"), F.first("docs").alias("docs")), "postings", 2048)


def shared_pairs(found: DataFrame, about: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list], added: str, then: tuple[Callable, str] | None = None) -> DataFrame:
    """``added`` columns of each pair a < b that shares an item, of :func:`postings` ``found``.

    ``about``: (doc, ...), a row for each document; ``compare`` gets these rows as a table with ``n`` and ``m``, the sizes of
    both sets, the places of both sides in it and the numbers of shared items and of shared marked items, and gives arrays.
    ``then``: what each task makes of its batches of pairs, where they arise, and the columns of that.
    """
    about = about.select("doc", *(c for c in about.columns if c != "doc"))
    sets = found.filter("kind < 2")
    there = sets.filter("kind = 0").select(F.explode("docs").alias("doc")).distinct()
    sizes = found.filter("kind = 2").select(F.col("key").alias("doc"), F.col("weight").alias("n"), F.get("docs", F.lit(0)).alias("m"))
    known = materialise(about.join(sizes, "doc").join(there, "doc", "left_semi"), "posted-docs")
    parts = max(2 * found.sparkSession.sparkContext.defaultParallelism, math.ceil(known.count() / OWN))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    kept = F.struct(*known.columns)
    rows = known.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("kind"), part("doc").alias("own"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("docs"), kept.alias("about"))
    homes = F.explode(F.array_distinct(F.transform("docs", part)))
    none = F.lit(None).cast(rows.schema["about"].dataType)
    rows = rows.union(sets.select(homes.alias("part"), "kind", F.lit(None).cast("int").alias("own"), "weight", "docs", none))
    # parts are dealt by hash: each gets a number of its own that hashes to a partition of its own
    spark = found.sparkSession
    tried = spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("home")).agg(F.min("id").alias("id")).toPandas()
    number = dict(zip(tried["home"].tolist(), tried["id"].tolist()))
    numbers = F.array(*(F.lit(number.get(p, 32 * parts + p)) for p in range(parts)))
    dealt = rows.withColumn("_home", F.get(numbers, F.col("part"))).repartition(parts, "_home").drop("_home").sortWithinPartitions("part", "kind")

    def pairs_of(at: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        kind = whole.column("kind").to_numpy()
        lo, mid = np.searchsorted(kind, [0, 1])
        table = pa.Table.from_struct_array(whole.column("about").slice(0, lo).combine_chunks())
        ids = table.column("doc").to_numpy()
        turn = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(turn)), ids[turn]
        own = whole.column("own").slice(0, lo).to_numpy()[turn] == at
        sides = []
        for a, z in ((lo, mid), (mid, len(kind))):
            of, docs = _lists(whole.column("docs").slice(a, z - a).combine_chunks()) if z > a else (np.empty(0, int),) * 2
            docs = np.searchsorted(ids, docs.astype(np.int64))
            turn = np.lexsort((docs, of))
            of, docs = of[turn], docs[turn]
            last = np.searchsorted(of, of, "right")
            entry = np.flatnonzero(own[docs]) if len(docs) else np.empty(0, int)
            entry = entry[np.argsort(docs[entry], kind="stable")]
            sides.append((docs, entry, last[entry] - entry - 1, docs[entry], whole.column("weight").slice(a, z - a).to_numpy().astype(np.int64)[of[entry]]))
        heads, per = np.unique(sides[0][3], return_index=True)
        met = np.cumsum(np.add.reduceat(sides[0][2], per)) if len(per) else np.empty(0, int)
        start = 0
        while start < len(heads):
            end = max(start + 1, int(np.searchsorted(met, (met[start - 1] if start else 0) + MEETINGS, "right")))
            sums = []
            for docs, entry, length, a, weight in sides:
                x, y = np.searchsorted(a, [heads[start], heads[end - 1] + 1])
                key = np.repeat(a[x:y] * len(ids), length[x:y]) + docs[_spread(entry[x:y] + 1, length[x:y])]
                turn = np.argsort(key, kind="stable")
                key, w = key[turn], np.repeat(weight[x:y], length[x:y])[turn]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
                sums.append((key[first], np.add.reduceat(w, first) if len(first) else np.empty(0, np.int64)))
            start = end
            (key, shared), (other, also) = sums
            if len(key):
                marked = np.zeros(len(key), np.int64)
                marked[np.searchsorted(key, other)] = also
                for i in range(0, len(key), 1 << 17):
                    k = key[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(compare(table, k // len(ids), k % len(ids), shared[i : i + len(k)], marked[i : i + len(k)]), schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column(0).to_numpy()
            for k in np.unique(part).tolist():
                if held and k != now:
                    yield from pairs_of(now, held)
                    held = []
                now = k
                lo, hi = np.searchsorted(part, [k, k + 1])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs_of(now, held)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(added)
    kinds = to_arrow_schema(schema)
    if then is None:
        return dealt.mapInArrow(run, schema)
    return dealt.mapInArrow(lambda batches: then[0](run(batches)), then[1])
