"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes what a stage returns as Parquet and gives the next stage
what it reads back.

A document is a row: stages decide about rows by a number of their own (:func:`numbered`), so rows that share a
doc_id, or have none, are told apart.  Extra columns pass through whatever their names; an empty table gives an empty
result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm import exact_dedup, langid, minhash, mixing, packing
from kinsift.llm.common import TEXT_ROWS
from kinsift.llm.queries import language_model, tokenizer_path
from kinsift.sources.scratch import keep_ids, materialise

#: Share of its words that a document's main language must explain.
LEAST_SHARE = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of unique numbers in the order of doc_id (null first), and its name.

    Where every row has a doc_id of its own these are the doc_ids; else rows are sorted and numbered, those that
    share a doc_id by a hash of their text and then by their place.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    # the place, last in the order, spreads equal rows over the ranges of the sort
    place = docs.withColumns({name: F.monotonically_increasing_id(), name + "h": F.xxhash64("text")})
    return materialise(place.orderBy("doc_id", name + "h", name).drop(name + "h").withColumn(name, F.monotonically_increasing_id()), "stage-rows", TEXT_ROWS), name


def _as_documents(rows: DataFrame, name: str) -> DataFrame:
    """What operators read, with the rows' numbers for ids."""
    return rows.select(F.col(name).alias("doc_id"), *(c for c in ("text", "source") if c in rows.columns))


def _keep(rows: DataFrame, name: str, ids: DataFrame, how: str) -> DataFrame:
    return keep_ids(rows, ids.select(F.col("doc_id").alias(name)), name, how).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a language that explains half of their words.

    Null and empty texts have no letters; ties between languages leave the document where its share reaches half;
    repeated rows get one decision each; with no labelled rows there is no language and nothing stays.
    """
    rows, name = numbered(docs)
    found = langid.identify(_as_documents(rows, name), language_model(docs))
    rejected = materialise(found.filter((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SHARE)).select("doc_id"), "stage-language", TEXT_ROWS)
    return _keep(rows, name, rejected, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded), keep the row with the largest doc_id; of equal ids with equal texts, one row.

    Null and empty texts are equal.
    """
    rows, name = numbered(docs)
    found = exact_dedup.exact_dedup(_as_documents(rows, name))
    gone = materialise(found.filter("NOT kept").select("doc_id"), "stage-exact", TEXT_ROWS)
    return _keep(rows, name, gone, "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: shingles of five words, similarity 0.8.

    It is the one with the smallest doc_id; of several rows with that id, one.  Null and empty texts link with nothing
    and all stay.
    """
    rows, name = numbered(docs)
    found = minhash.near_dedup(_as_documents(rows, name), words=5, percent=80)
    gone = materialise(found.filter("NOT kept").select("doc_id"), "stage-near")
    return _keep(rows, name, gone, "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2 rows.

    Rows that share an id get copies of their own; documents without words are taken 0 times; null sources are one
    source.
    """
    rows, name = numbered(docs)
    mixed = materialise(mixing.mix(_as_documents(rows, name)).select("doc_id", "copies"), "stage-mix")
    once = _keep(rows, name, mixed.filter("copies >= 1"), "left_semi")
    again = _keep(rows, name, mixed.filter("copies >= 2"), "left_semi")
    return once.unionByName(again)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens.

    Every row is a document, so a document taken twice is packed twice; null and empty texts are their closing token.
    """
    return packing.pack(docs, tokenizer_path(), capacity=2048, closing=0)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packed)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
