"""N-grams, hashes, fingerprints and small string functions as column expressions.

Each takes the token column at least twice in its expression, so that the optimizer keeps it as a column of its own
instead of computing it anew for every element of a lambda.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def resplit(tokens_: Column) -> Column:
    """Tokens as they come back from a space-joined file: tokens with spaces in them fall apart."""
    return tokens(F.array_join(tokens_, " "))


def _none() -> Column:
    return F.array().cast("array<string>")


def ngrams(tokens_: Column, n: int) -> Column:
    """Runs of ``n`` tokens in order, joined by spaces; fewer tokens make one gram, none make none."""
    size = F.size(tokens_)
    runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens_, i, n), " "))
    return F.when(size <= 0, _none()).when(size < n, F.array(F.array_join(tokens_, " "))).otherwise(runs)


def ngram_set(tokens_: Column, n: int) -> Column:
    return F.array_distinct(ngrams(tokens_, n))


def gram_hash(gram: Column) -> Column:
    """MD5 as 32 lower-case hexadecimal digits: their order is the order of the numbers."""
    return F.md5(gram)


def winnow(hashes: Column, window: int = 4) -> Column:
    """Distinct minima of all windows; up to ``window`` hashes are all kept."""
    size = F.size(hashes)
    lows = F.transform(F.sequence(F.lit(1), size - (window - 1)), lambda i: F.array_min(F.slice(hashes, i, window)))
    return F.array_distinct(F.when(size <= window, hashes).otherwise(lows))


def fingerprints(docs: DataFrame, n: int = 5, window: int = 4, column: str = "tokens", hashes: bool = False) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (and ``hashes`` of all grams, if asked for): hashes are a column of their own
    before windows look at them."""
    hashed = docs.withColumn("_hashes", F.transform(ngrams(F.col(column), n), gram_hash))
    out = hashed.withColumn("fingerprint", winnow(F.col("_hashes"), window))
    return out.withColumnRenamed("_hashes", "hashes") if hashes else out.drop("_hashes")


def fingerprint_sets(batches: Iterator[pa.RecordBatch], n: int = 5, window: int = 4) -> Iterator[pa.RecordBatch]:
    """(doc, items, marked) of (doc, block, text as bytes): the sets of :func:`fingerprints` ``hashes`` and of the minima.

    Items are the first 64 bits of the hashes, which have their order, each block's with other bits turned.
    """
    none = np.empty(0, np.uint64)
    for batch in batches:
        sets: tuple[list, list] = ([], [])
        for block, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            words = (text.as_py() or b"").split()  # of bytes: the white space of \s
            line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[: -min(n, len(words))]]).tolist() if words else []
            h = np.frombuffer(b"".join([md5(line[a : z - 1]).digest() for a, z in zip(starts, ends[min(n, len(words)) - 1 :].tolist())]), ">u8")[::2].astype(np.uint64) if words else none
            low = h if len(h) <= window else np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
            turned = np.uint64(int.from_bytes(md5(block.encode()).digest()[:8], "big"))
            for out, x in zip(sets, (h, low)):
                out.append(np.unique(x) ^ turned)
        columns = [batch.column(0)]
        for out in sets:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *out]).view(np.int64))))
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "items", "marked"])


def normalize_whitespace(source: Column) -> Column:
    """Lines without trailing white space, blank ones dropped; leading white space stays."""
    lines = F.split(source, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return F.array_join(kept, "\n")


def leading_number(name: Column) -> Column:
    """The number that a name begins with, or null."""
    return F.nullif(F.regexp_extract(name, r"^([0-9]+)", 1), F.lit("")).cast("int")


def strict_number(name: Column) -> Column:
    return F.coalesce(leading_number(name), F.raise_error(F.concat(F.lit("no leading number: "), name)).cast("int"))


def code_terms(text: Column) -> Column:
    """Identifiers, numbers and single symbols, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[A-Za-z_]\w*|\d+|[^\sA-Za-z_\d]"), F.lit(0))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
