"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

*Pieces.*  A document's ids (plus a closing id) are cut into pieces of the sequence length; only its last piece may
be shorter.  Full pieces are sequences of their own.  Short pieces are items of a bin packing instance, of which only
the histogram of lengths matters, so the solver's input has a line per length, whatever the corpus.

*Reduce.*  Going down the lengths, an item j is fixed together with a set of at most one partner when that provably
dominates every other set with j: nothing else fits; the largest partner k fills the sequence; only one partner fits
and k is the largest; or no two partners that fit together exceed k.  Fixed sets leave the instance; passes repeat
until none applies.

*Best fit.*  What is left is packed by best-fit decreasing on groups of equal sequences.

Both produce *patterns* (lengths in one sequence) with multiplicities, a few thousand lines at most.  Pieces get their
place in a pattern by their rank among the pieces of their length; ranks come from counts per (length, salt) and a
window per (length, salt), so no length meets in one task.

Defined results: null and empty texts are one piece that holds the closing id alone; repeated rows are documents of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsift.llm.common import TEXT_ROWS, remember, slices
from kinsift.llm.shingles import Words, text_buffer
from kinsift.sources.scratch import materialise

#: Parts of a length class for ranking.
SALTS = 64
#: Words a worker remembers.
REMEMBER = 1 << 20
_SEPARATOR = "\x01"


class WordTokenizer:
    """Ids of whole texts for tokenizers that never join across white space, from remembered ids of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the separator must be one token")
        self.mark = mark[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        odd = [i for i, w in enumerate(words) if _SEPARATOR in w]
        plain = [w for w in words if _SEPARATOR not in w] if odd else words
        flat, counts = [], []
        for at in range(0, len(plain), 4096):
            ids = np.array(self.tokenizer.encode(f" {_SEPARATOR} ".join(plain[at : at + 4096]) + f" {_SEPARATOR}", add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(ids == self.mark)
            counts.append(np.diff(stops, prepend=-1) - 1)
            flat.append(np.delete(ids, stops))
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if not odd:
            return ids, count
        pieces = np.split(ids, np.cumsum(count)[:-1]) if len(count) else []
        for i in odd:
            pieces.insert(i, np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32))
        return np.concatenate(pieces), np.array([len(p) for p in pieces])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer one after another, and the n+1 offsets of the texts."""
        words = Words(data, offsets, lower=False)
        key, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == key[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBER and len(self.keys):
                self.forget()
                return self.encode(data, offsets)
            raw = data.tobytes()
            ids, count = self._encode([raw[words.start[i] : words.end[i]].decode() for i in at[new]])
            begin = np.cumsum(count) - count + len(self.ids)
            self.ids = np.concatenate((self.ids, ids))
            put = np.searchsorted(self.keys, key[new])
            self.keys = np.insert(self.keys, put, key[new])
            self.begin = np.insert(self.begin, put, begin)
            self.count = np.insert(self.count, put, count.astype(np.int32))
            spot = np.searchsorted(self.keys, key)
        count = self.count[spot][back].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        index = np.repeat(self.begin[spot][back] - total[:-1], count) + np.arange(total[-1])
        return self.ids[index], total[words.first]


_KEPT: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    remember("packing", _KEPT.clear)
    return _KEPT[path]


_PIECE = "piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        end = np.array([closing], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text", owner="packing"):
                ids, offsets = tokenizer.encode(*text_buffer(part.column("text")))
                length = np.diff(offsets) + 1
                pieces = -(-length // capacity)
                row = np.repeat(np.arange(part.num_rows), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                size = np.minimum(length[row] - start, capacity)
                # the closing id goes in after each text
                every = np.insert(ids, offsets[1:], end[0]).astype("<u4")
                first = offsets[:-1] + np.arange(part.num_rows)
                crc = np.empty(len(row), np.int64)
                view = memoryview(every).cast("B")
                for i, (a, n) in enumerate(zip((first[row] + start).tolist(), size.tolist())):
                    crc[i] = zlib.crc32(view[4 * a : 4 * (a + n)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that belong to an optimal packing of items with these counts by size, and the counts that remain."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        left[s] = n
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j]:
                room = capacity - j
                left[j] -= 1  # the partner is sought among the others
                fit = np.flatnonzero(left[1 : room + 1]) + 1 if room else np.zeros(0, np.int64)
                left[j] += 1
                if not len(fit):
                    pattern, times = (j,), int(left[j]) if 2 * j > capacity else 1
                else:
                    k = int(fit[-1])
                    if not (k == room or _covers(left, fit, j, k, room)):
                        break
                    pattern = (j, k)
                    times = int(left[j]) // 2 if j == k else int(min(left[j], left[k]))
                    # fewer items never end dominance by the largest partner, so it holds for all of them
                for s in pattern:
                    left[s] -= times
                fixed.append((pattern, times))
                changed = True
    return fixed, {int(s): int(left[s]) for s in np.flatnonzero(left)}


def _covers(left: np.ndarray, fit: np.ndarray, j: int, k: int, room: int) -> bool:
    """No set of two or more other items that fits beside j is larger than k."""
    own = left[fit] - (fit == j)
    smallest = np.repeat(fit[:3], np.minimum(own[:3], 3))[:3]
    if smallest[:2].sum() > room or len(smallest) < 2:
        return True  # only one partner fits
    if len(smallest) == 3 and smallest.sum() <= room:
        return False
    # largest pair that fits: for each item its largest possible companion
    partner = np.searchsorted(fit, room - fit, side="right") - 1
    ok = partner >= 0
    same = ok & (partner == np.arange(len(fit))) & (own < 2)
    partner = np.where(same, partner - 1, partner)
    ok &= partner >= 0
    pairs = fit[ok] + fit[partner[ok]]
    return not len(pairs) or int(pairs.max()) <= k


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on groups of equal sequences: patterns with multiplicities."""
    groups: dict[int, list[list]] = {}  # room -> [pattern, times]
    open_rooms = np.zeros(capacity + 1, dtype=bool)

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        groups.setdefault(room, []).append([pattern, times])
        open_rooms[room] = True

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            found = np.flatnonzero(open_rooms[size:])
            if not len(found):
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each)
                if n % each:
                    put((size,) * (n % each), 1)
                break
            room = int(found[0]) + size
            pattern, times = groups[room].pop()
            if not groups[room]:
                open_rooms[room] = False
            used = min(n, times)
            if times > used:
                put(pattern, times - used)
            put((*pattern, size), used)
            n -= used
    return [(tuple(p), t) for members in groups.values() for p, t in members]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities that hold every item exactly once."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (length, first rank, ranks, each, first sequence, first offset): where the pieces of a length go.

    Rank r of a line goes to sequence ``first + (r - first rank) // each`` at offset
    ``first offset + length * ((r - first rank) % each)``.
    """
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((size, used[size], times * each, each, sequence, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    return out


def _place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                table = lines[int(size)]
                line = np.searchsorted(table[:, 0], rank[at], side="right") - 1
                step = rank[at] - table[line, 0]
                sequence[at] = table[line, 2] + step // table[line, 1]
                offset[at] = table[line, 3] + size * (step % table[line, 1])
            keep = [c for c in batch.schema.names if c not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``tokenizer``: path of a tokenizers file whose tokens never span white space, readable on every executor.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_cut(tokenizer, capacity, closing), f"doc_id long, {_PIECE}")
    salted = pieces.withColumn("serial", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    pieces = materialise(salted, "pack-pieces", TEXT_ROWS)
    short = pieces.filter(F.col("length") < capacity)
    cells = short.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most capacity x SALTS lines
    counts: Counter = Counter()
    begin = []
    for r in sorted(cells, key=lambda r: (r.length, r.salt)):
        begin.append((r.length, r.salt, counts[r.length]))
        counts[r.length] += r.n
    lines: dict[int, list] = {size: [] for size in counts}
    for size, rank, _, each, sequence, offset in slots(plan(dict(counts), capacity)):
        lines[size].append((rank, each, sequence, offset))
    lines = {size: np.array(sorted(x), dtype=np.int64) for size, x in lines.items()}
    sent = spark.sparkContext.broadcast(lines)
    offsets = spark.createDataFrame(begin, "length long, salt int, before long")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "serial")) - 1
    ranked = short.withColumn("within", within).join(F.broadcast(offsets), ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(_place(sent), f"doc_id long, {_PIECE}, sequence_id long, offset long")
    # full pieces: numbers below zero, one each
    full = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("serial")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
