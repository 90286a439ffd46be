"""Queries over the driver's tables and their SQL; __spark_entry__.py adds them to its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm import ann, exact_dedup, html_extract, langid, minhash, mixing, packing, pii, quality, suffix_dedup
from kinsift.llm.common import table


def remainder(column: str, n: int):
    """crc32 of the decimal digits of an id, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.filter(remainder("doc_id", 3) != 1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "mixture")


#: Key of the query's pseudonyms; a real run passes a secret of its own.
PII_KEY = "kinsift demonstration key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise(docs, PII_KEY)
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_sort(F.col("pii.kind")).alias("kinds"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def tokenizer_path() -> str:
    """The packing tokenizer; KINSIFT_TOKENIZER names another file."""
    import os

    if own := os.environ.get("KINSIFT_TOKENIZER"):
        return own
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, closing=0)


def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measured_table(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model = quality.fit(measured.filter(remainder("doc_id", 4) != 2), labels)
    scored = quality.score(measured, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=200)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_pii_pseudonyms": op2_pii_pseudonyms,
        "op3_entropy_mix": op3_entropy_mix,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_adaptive_ann": op5_adaptive_ann,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_quality_discriminant": op7_quality_discriminant,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_minhash_near_dedup": minhash.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op9_suffix_dedup": suffix_dedup.SQL,
    }
