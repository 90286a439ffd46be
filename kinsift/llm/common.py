"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time; one longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Rows with whole texts that go to Python at a time.
TEXT_ROWS = 1000


#: What a worker process remembers between tasks, by its owner: functions that drop it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(owner: str, drop: Callable[[], None]) -> None:
    _REMEMBERED[owner] = drop


def release(but: str = "") -> None:
    """Drop what other operators remember in this worker process: workers outlive the stages they served."""
    for owner in [x for x in _REMEMBERED if x != but]:
        _REMEMBERED.pop(owner)()


def trim() -> None:
    """Give freed memory back to the system: the allocator of a long-lived worker keeps large blocks otherwise."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds at most ``most`` bytes together (one row at least).

    Releases what other operators than ``owner`` remember in this worker.
    """
    release(owner)
    col = batch.column(column)
    n = batch.num_rows
    if n == 0:
        return
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
    trim()


def fixed_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list<int64> array of ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner equi-join of ``rows`` with ``groups`` (one row per key, with the number of rows it holds in ``size``).

    Groups that hold more than a thousandth of ``total`` rows are at most ``share`` many, so they are broadcast;
    the rest is shuffled, and no key of it holds more than a thousandth of the rows.
    """
    bound = max(1, total // share)
    hot = groups.filter(F.col(size) > bound)
    cold = groups.filter(F.col(size) <= bound)
    hit = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return hit.unionByName(rest)


def left_join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], values: list[str], size: str, total: int, only: Column, share: int = 1000) -> DataFrame:
    """``rows`` with the columns ``values`` of their group, null where there is none or ``only`` does not hold.

    Like :func:`join_groups`, but ``rows`` are computed once: what broadcast groups have settled, and rows that
    need no group, are spread over the shuffle by their place instead of their key.
    """
    bound = max(1, total // share)
    hot = groups.filter(F.col(size) > bound).select(*keys, *(F.col(v).alias(f"_hot_{v}") for v in values), F.lit(True).alias("_hot"))
    cold = groups.filter(F.col(size) <= bound).select(*keys, *values, F.lit(0).cast("long").alias("_spread"))
    away = F.coalesce(~only, F.lit(True)) | F.coalesce(F.col("_hot"), F.lit(False))
    both = rows.join(F.broadcast(hot), keys, "left").withColumn("_spread", F.when(away, F.monotonically_increasing_id() + 1).otherwise(0).cast("long"))
    both = both.join(cold, [*keys, "_spread"], "left").drop("_spread", "_hot")
    for v in values:
        both = both.withColumn(v, F.when(only, F.coalesce(F.col(f"_hot_{v}"), F.col(v)))).drop(f"_hot_{v}")
    return both
