"""Pairs of documents, their labels, and joins of pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.text import leading_number
from kinsift.sources.files import basename

KEY = ["problem_id", "file_a", "file_b"]


def within_blocks(docs: DataFrame, block: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of one block, ``order`` ascending: an equi-join with an ordering residue.

    Columns: the block, ``<order>_a``, ``<order>_b`` and both sides of ``keep``.  The number of pairs is the square of
    a block's size by definition; candidate joins in ``signals`` avoid it where a floor is known, and
    ``cells`` compares pairs in bounded groups.
    """
    side = lambda s: docs.select(block, *(F.col(c).alias(f"{c}_{s}") for c in (order, *keep)))
    return side("a").join(side("b"), block).filter(F.col(f"{order}_a") < F.col(f"{order}_b"))


def one_bag(docs: DataFrame, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a small set, such as an upload."""
    return within_blocks(docs.withColumn("_bag", F.lit(0)), "_bag", order, keep).drop("_bag")


def is_copy(number: Column, first_copy: Column) -> Column:
    """Whether a file is a copy by its number; null if either is unknown."""
    return number >= first_copy


def label_pair(a: Column, b: Column) -> Column:
    """1 if either side is a copy, else 0; null if either side is unknown (unlike SQL's OR)."""
    return F.when(a.isNull() | b.isNull(), None).otherwise((a | b).cast("int"))


def build_pairs(files: DataFrame, first_copy: DataFrame) -> DataFrame:
    """(problem_id, file_a, file_b, is_plagiarized) from (problem_id, file) and (problem_id, first_copy)."""
    marked = files.join(first_copy, "problem_id", "left").withColumn("copy", is_copy(leading_number(F.col("file")), F.col("first_copy")))
    pairs = within_blocks(marked, "problem_id", "file", ("copy",))
    return pairs.select("problem_id", "file_a", "file_b", label_pair(F.col("copy_a"), F.col("copy_b")).alias("is_plagiarized"))


def split_unresolved(pairs: DataFrame, label: str = "is_plagiarized") -> tuple[DataFrame, DataFrame]:
    """Labelled pairs and pairs without a label."""
    return pairs.filter(F.col(label).isNotNull()), pairs.filter(F.col(label).isNull())


def with_key(pairs: DataFrame) -> DataFrame:
    """Paths reduced to names, so that tables written from different folders join."""
    return pairs.withColumns({c: basename(F.col(c)) for c in ("file_a", "file_b")})


def merge_signals(base: DataFrame, *others: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Inner join of signal tables on the pair."""
    return reduce(lambda a, b: a.join(b, key or KEY), others, base)


def lost_rows(base: DataFrame, merged: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pairs of ``base`` that a merge has lost."""
    return base.join(merged, key or KEY, "left_anti")


def checked_merge(base: DataFrame, *others: DataFrame, key: list[str] | None = None) -> DataFrame:
    """:func:`merge_signals`; raises if pairs are lost."""
    merged = merge_signals(base, *others, key=key)
    if lost := lost_rows(base, merged, key).count():
        raise ValueError(f"{lost} pairs have no row in every signal table")
    return merged


def with_families(pairs: DataFrame, lineage: DataFrame, block: str, member: str, family: str, strict: bool = True) -> DataFrame:
    """``family_a``, ``family_b`` and ``same_family`` (1 or 0) by looking both sides up in ``lineage``.

    An unknown member raises if ``strict``, else its label is null.
    """
    table = lineage.select(block, member, family)
    out = pairs
    for s in ("a", "b"):
        out = out.join(table.withColumnsRenamed({member: f"{member}_{s}", family: f"family_{s}"}), [block, f"{member}_{s}"], "left")
    label = (F.col("family_a") == F.col("family_b")).cast("int")
    if strict:
        label = F.when(F.col("family_a").isNull() | F.col("family_b").isNull(), F.raise_error(F.lit("a member is missing from the lineage")).cast("int")).otherwise(label)
    return out.withColumn("same_family", label)
