"""Source and sink operators over files: program trees, token files, CSV tables, models, HTML."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsift.sources import schemas


def basename(path: Column) -> Column:
    """Last segment of a path with either kind of slash."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def folder(path: Column) -> Column:
    """Second to last segment: the problem that a file belongs to."""
    return F.try_element_at(F.split(F.translate(path, "\\", "/"), "/"), F.lit(-2))


@F.pandas_udf(T.StringType())
def _lossy(content):
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def read_tree(spark: SparkSession, root: str, glob: str = "*.py", strict: bool = False) -> DataFrame:
    """(problem_id, file, path, text) of every matching file below ``root``.

    Bytes that are not UTF-8 are dropped, or raise an error if ``strict``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    text = F.validate_utf8(F.col("content").cast("string")) if strict else _lossy("content")
    return raw.select(folder(F.col("path")).alias("problem_id"), basename(F.col("path")).alias("file"), "path", text.alias("text"))


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """(problem_id, file, tokens): white-space separated token files below ``root``, keyed by their source's name."""
    files = read_tree(spark, root, "*.tokens")
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return files.select("problem_id", F.regexp_replace("file", r"\.tokens$", ".py").alias("file"), tokens.alias("tokens"))


def with_tokens(docs: DataFrame, tokens: DataFrame, tolerant: bool = False) -> DataFrame:
    """Documents with their tokens; a document without a token file raises, or gets none if ``tolerant``."""
    joined = docs.join(tokens.select("problem_id", "file", "tokens"), ["problem_id", "file"], "left")
    none = F.array().cast("array<string>") if tolerant else F.raise_error(F.concat(F.lit("no tokens for "), F.col("file"))).cast("array<string>")
    return joined.withColumn("tokens", F.coalesce("tokens", none))


def token_path(path: Column, source_root: str = "dataset", token_root: str = "preprocessed_output") -> Column:
    """Where the tokens of a source file lie: the same tree below another root."""
    flat = F.translate(path, "\\", "/")
    return F.regexp_replace(F.regexp_replace(flat, rf"(^|/){source_root}/", f"$1{token_root}/"), r"\.py$", ".tokens")


def from_uploads(spark: SparkSession, files: dict[str, str], problem_id: str = "upload") -> DataFrame:
    """In-memory files in upload order; two at least."""
    if len(files) < 2:
        raise ValueError("a scan needs two files at least")
    rows = [(problem_id, name, text, i) for i, (name, text) in enumerate(files.items())]
    return spark.createDataFrame(rows, "problem_id string, file string, text string, pos int")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("escape", '"').csv(path, header=True)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``one_file`` is for results of a few rows: it sends all of them to one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_normalised(df: DataFrame, path: str) -> None:
    """Normalised documents by problem, as Parquet; rows with an error are left out."""
    df.filter("error IS NULL").select("problem_id", "file", "normalized", "tokens").write.mode("overwrite").partitionBy("problem_id").parquet(path)


def read_normalised(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, normalized string, tokens array<string>, problem_id string").parquet(path)


def write_model(model: DataFrame, path: str, labels: str = "family") -> str:
    """One-row model as JSON; models of other labels than the default get a suffix and a warning.  Returns the path."""
    if labels != "family":
        path += "_original_labels"
        warnings.warn(f"a model of {labels} labels does not replace that of family labels; it goes to {path}", stacklevel=2)
    model.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a model file, on one line or indented; the fallback may be missing, the rest must be there."""
    model = spark.read.schema(schemas.MODEL).json(path, multiLine=True)
    whole = model.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("signals", "lo", "hi", "weights", "threshold"))).count()
    if whole != 1 or model.count() != 1:
        raise ValueError(f"{path} does not hold one model")
    return model


def page_file(name: Column) -> Column:
    """File name of a page."""
    return F.concat(F.translate(name, "/\\", "__"), F.lit(".html"))


def page_link(name: Column) -> Column:
    """Relative link to a page's file."""
    return F.replace(F.url_encode(page_file(name)), F.lit("+"), F.lit("%20"))


def write_pages(pages: DataFrame, path: str) -> None:
    """(name, html) as files ``<name>.html`` in the folder ``path``, written by the executors.

    A repeated attempt writes the same file again.
    """
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    where.create_dir(root, recursive=True)

    def write(rows) -> None:
        own, _ = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
        for row in rows:
            with own.open_output_stream(f"{root}/{row.file}") as out:
                out.write(row.html.encode())

    pages.select(page_file(F.col("name")).alias("file"), "html").foreachPartition(write)
