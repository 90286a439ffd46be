"""Exact dedup by a Golomb-coded fingerprint exchange.

1. *Send.*  Each partition hashes its texts (``A-Z`` folded) to short fingerprints, in chunks of bounded size (a
   chunk is a *sender*).  The sorted distinct fingerprints of a sender are cut by owner (an owner holds a range of
   the fingerprint space, as many owners as the number of rows asks for) and their gaps are Golomb-coded with a
   power-of-two parameter.
2. *Own.*  An owner decodes what it was sent and answers each sender with a bitmap: which of its fingerprints some
   other sender also has.  Senders without any get no answer.
3. *Receive.*  The senders that were answered, and those with copies of their own, name the ids of the suspects;
   everything else is unique.
4. *Verify.*  Only the texts of suspects are shuffled, by their bytes (pre-aggregated on the map side), so a false
   suspect costs a few bytes and never a wrong answer.

Beside codes and bitmaps only ids move.  SHA-256 is taken where the text is read.  Groups that hold over a thousandth of all suspects are broadcast when results go back to rows, so one group of
copies may hold any share of the table.  The table of senders is written to the scratch area; lost executors
recompute from there.

Defined results: a null text counts as empty; rows with equal texts form one group whatever their other columns;
``keep_id`` is the largest ``doc_id`` (null only if all are null); repeated rows with the same id are reported once
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import TEXT_ROWS, join_groups, slices
from kinsift.llm.shingles import _FOLD, text_buffer
from kinsift.sources.scratch import keep_ids, materialise

#: Rows that a sender holds at most, and rows of the table for each owner.
SENDER_ROWS = 1 << 16
OWNER_ROWS = 1 << 18


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative int64 values as header, unary quotients and binary remainders of their gaps."""
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values, prepend=0)
    mean = max(1.0, float(values[-1]) / n)
    b = max(0, int(np.log2(mean * 0.69))) if mean * 0.69 >= 1 else 0
    q, r = gaps >> b, gaps & ((1 << b) - 1)
    stops = np.cumsum(q + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 1
    bits = ((r[:, None] >> np.arange(b)) & 1).astype(np.uint8) if b else np.zeros((n, 0), np.uint8)
    head = np.array([n, b, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    n, b, length = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    split = 12 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[12:split], np.uint8), count=length)
    stops = np.flatnonzero(unary)
    q = np.diff(stops, prepend=-1) - 1
    if b:
        bits = np.unpackbits(np.frombuffer(blob[split:], np.uint8), count=n * b).reshape(n, b)
        r = (bits.astype(np.int64) << np.arange(b)).sum(axis=1)
    else:
        r = np.zeros(n, np.int64)
    return np.cumsum((q.astype(np.int64) << b) + r)


_SENT = "sender long, owner int, blob binary, ids array<long>, times array<int>"


def _sender(owners: int, bits: int):
    """For each sender and owner: the code, and the ids in the order of their fingerprints, ``times`` of them each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[pa.Array] = []
        prints: list[int] = []
        serial = 0

        def flush():
            nonlocal serial
            sender = (part << 32) | serial
            serial += 1
            fp = np.array(prints, dtype=np.int64)
            order = np.argsort(fp, kind="stable")
            every = pa.concat_arrays(ids).take(pa.array(order))
            value, times = np.unique(fp, return_counts=True)
            coarse = max(0, bits - 28)  # keeps the product below 2**63
            owner = ((value >> coarse) * owners) >> (bits - coarse)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=owners + 1))
            rows = np.concatenate(([0], np.cumsum(times)))[cuts]
            spans = list(zip(cuts[:-1], cuts[1:]))
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), every)
            counts = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(times.astype(np.int32)))
            blobs = pa.array([golomb_encode(value[a:z]) for a, z in spans], pa.binary())
            ids.clear(), prints.clear()
            return pa.RecordBatch.from_arrays([pa.array([sender] * len(spans), pa.int64()), pa.array(owner[cuts[:-1]].astype(np.int32)), blobs, lists, counts], names=["sender", "owner", "blob", "ids", "times"])

        for batch in batches:
            for part_of in slices(batch, "text"):
                data, offsets = text_buffer(part_of.column("text"))
                folded = memoryview(_FOLD[data]) if len(data) else memoryview(b"")
                # a copy: a slice would keep its whole batch, texts included, until the sender is full
                ids.append(part_of.column("doc_id").take(pa.array(np.arange(part_of.num_rows))))
                prints += [xxhash.xxh3_64_intdigest(folded[offsets[i] : offsets[i + 1]]) >> (64 - bits) for i in range(part_of.num_rows)]
                if len(prints) >= SENDER_ROWS:
                    yield flush()
        if prints:
            yield flush()

    return run


def _owner(table: pa.Table) -> pa.Table:
    """Bitmaps for the senders: fingerprints that more than one sender has."""
    lists = [golomb_decode(b) for b in table.column("blob").to_pylist()]
    every = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    hits = [np.isin(x, shared, assume_unique=True) for x in lists]
    some = pa.array([bool(h.any()) for h in hits], pa.bool_())
    out = pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "shared": pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())})
    return out.filter(some)


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            times = batch.column("times")[row].values.to_numpy()
            suspect = times > 1
            answer = batch.column("shared")[row].as_py()
            if answer is not None:
                suspect |= np.unpackbits(np.frombuffer(answer, np.uint8), count=len(times)).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values.filter(pa.array(np.repeat(suspect, times)))], names=["doc_id"])


def _hashed(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_of in slices(batch, "text"):
                data, offsets = text_buffer(part_of.column("text"))
                folded = memoryview(_FOLD[data].tobytes())
                raw = [folded[offsets[i] : offsets[i + 1]] for i in range(part_of.num_rows)]
                columns = {"doc_id": part_of.column("doc_id"), "sha": pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())}
                if with_bytes:
                    columns["raw"] = pa.array([bytes(x) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def exact_dedup(docs: DataFrame, owners: int | None = None, bits: int = 48) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs`` (needs doc_id and text).

    ``owners``: ranges of the fingerprint space, by default one for every ``OWNER_ROWS`` rows.  ``bits``: length of a
    fingerprint; fewer bits send less and verify more, the result is the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    owners = owners or max(1, -(-docs.count() // OWNER_ROWS))
    sent = materialise(docs.mapInArrow(_sender(owners, bits), _SENT), "exact-sent", TEXT_ROWS)
    answers = materialise(sent.select("owner", "sender", "blob").groupBy("owner").applyInArrow(_owner, "sender long, owner int, shared binary"), "exact-answers")
    answered = sent.drop("blob").join(answers, ["sender", "owner"], "left").filter(F.col("shared").isNotNull() | F.exists("times", lambda n: n > 1))
    # rows that share an id with a suspect are verified with it
    suspects = materialise(answered.select("ids", "times", "shared").mapInArrow(_receive, "doc_id long").distinct(), "exact-suspects")
    texts = keep_ids(docs, suspects, "doc_id", "left_semi")
    rows = materialise(texts.mapInArrow(_hashed(False), "doc_id long, sha binary"), "exact-rows", TEXT_ROWS)
    verified = texts.mapInArrow(_hashed(True), "doc_id long, sha binary, raw binary").groupBy("sha", "raw").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clash = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.first("keep_id"))
    groups = materialise(verified.groupBy("sha").agg(clash.cast("long").alias("keep_id"), F.sum("group_size").alias("group_size")), "exact-groups", TEXT_ROWS)
    copies = join_groups(rows, groups, ["sha"], "group_size", rows.count())
    alone = keep_ids(docs, suspects, "doc_id", "left_anti").mapInArrow(_hashed(False), "doc_id long, sha binary").select("sha", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(copies).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


#: For DuckDB.  Its lower() folds all of Unicode, so A-Z are folded by name.
SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
