"""New submissions against a stored table of fingerprints.

Each micro-batch is fingerprinted, compared within itself and with what the store holds for its blocks, and then added
to the store; a replayed batch overwrites its own partition, so the store sees each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions import text


def fingerprint_rows(docs: DataFrame, n: int = 5, window: int = 4) -> DataFrame:
    """(block, doc, fp) from (block, doc, text)."""
    tokenised = docs.select("block", "doc", text.tokens(F.col("text")).alias("tokens"))
    return text.fingerprints(tokenised, n, window).select("block", "doc", F.explode_outer("fingerprint").alias("fp")).filter("fp IS NOT NULL")


def matches(new: DataFrame, stored: DataFrame, floor: float) -> DataFrame:
    """Pairs with a new side whose fingerprint Jaccard reaches ``floor``."""
    every = stored.select("block", "doc", "fp").unionByName(new).distinct()
    size = every.groupBy("block", "doc").agg(F.count("*").alias("n"))
    met = new.withColumnRenamed("doc", "a").join(every.withColumnRenamed("doc", "b"), ["block", "fp"]).filter("a <> b")
    shared = met.groupBy("block", "a", "b").agg(F.count("*").alias("shared"))
    for s in ("a", "b"):
        shared = shared.join(size.withColumnsRenamed({"doc": s, "n": f"n_{s}"}), ["block", s])
    return shared.withColumn("winnow", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).filter(F.col("winnow") >= floor)


def watch(stream: DataFrame, store: str, out: str, checkpoint: str, floor: float = 0.5):
    """Start a query over a stream of (block, doc, text); matches go to ``out``, fingerprints to ``store``, by batch."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = fingerprint_rows(batch).persist()
        try:
            kind = "block string, doc string, fp string, batch int"
            exists = spark._jvm.org.apache.hadoop.fs.Path(store)
            fs = exists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(exists):
                stored = spark.read.schema(kind).parquet(store).filter(F.col("batch") < number)
            else:
                stored = spark.createDataFrame([], kind)
            known = stored.join(new.select("block").distinct(), "block", "left_semi")
            matches(new, known, floor).write.mode("overwrite").parquet(f"{out}/batch={number}")
            new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
