"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset a local session gets a temporary
one; a cluster session gets an error, because a machine-local folder is not visible elsewhere.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and sc.getCheckpointDir():
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.get(sc.applicationId)
        if base is None:
            base = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinsift-")
    root = f"{base.rstrip('/')}/kinsift-{sc.applicationId}"
    if root not in _OWN.values():
        _OWN[root] = root
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    """Drop the application's scratch tables; at exit the JVM may already be gone."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        return


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While it lasts, Arrow batches hold at most ``rows`` rows: bounds memory where rows carry whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is not None:
        spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, tag: str, rows: int | None = None, per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the scratch area and read it back: cuts lineage, survives lost executors.

    ``rows``: bound of Arrow batches on the way.  ``per_file``: bound of the rows of a file, so that uneven tasks leave
    even files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    with arrow_rows(spark, rows):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads again; Spark drops the shuffles of steps that are done."""
    for df in tables:
        _remove(df.sparkSession, df._scratch_path)
    tables[0].sparkSession._jvm.System.gc()  # its cleaner follows the collector


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str, small: int = 500_000) -> DataFrame:
    """Rows of ``df`` whose ``column`` is (``left_semi``) or is not (``left_anti``) in ``ids``.

    ``ids`` should be a materialised table: its rows are counted first, and it is broadcast only up to
    ``small`` rows; beyond that both sides are shuffled by the key.  Nulls match nulls.
    """
    ids = ids.select(F.col(column).alias("_id"))
    if ids.count() <= small:
        ids = F.broadcast(ids)
    return df.join(ids, df[column].eqNullSafe(ids["_id"]), how)
