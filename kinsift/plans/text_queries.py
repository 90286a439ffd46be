"""Queries over single documents, vectors and pairs of one kind of signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions import text
from kinsift.operators import cells, evaluation, graph, signals
from kinsift.sources.files import basename

#: Common table expressions that the SQL of several queries begins with.
TOKENS = r"t AS MATERIALIZED (SELECT doc_id, source, lang, n_chars, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents)"


def grams_sql(n: int, name: str = "o") -> str:
    """Ordered grams (doc_id, source, i, g) of every document with a token."""
    return f"{name} AS MATERIALIZED (SELECT doc_id, source, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT doc_id, source, ws, unnest(generate_series(1, greatest(len(ws) - {n - 1}, 1))) AS i FROM t WHERE len(ws) > 0))"


FINGERPRINTS = """
h AS MATERIALIZED (SELECT doc_id, source, i, md5(g) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM o),
f AS MATERIALIZED (
  SELECT DISTINCT doc_id, source, fp FROM (
    SELECT doc_id, source, i, n, CASE WHEN n <= 4 THEN h ELSE min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS fp FROM h)
  WHERE n <= 4 OR i <= n - 3)"""


def overlap_sql(items: str, item: str, name: str) -> str:
    """Pairs of one source that share an item of the distinct table ``items``."""
    return f"""
{name}_n AS MATERIALIZED (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM {items} GROUP BY doc_id),
{name} AS MATERIALIZED (
  SELECT p.source, p.a, p.b, p.shared, x.n AS size_a, y.n AS size_b, p.shared / (x.n + y.n - p.shared) AS jaccard
  FROM (SELECT x.source, x.doc_id AS a, y.doc_id AS b, CAST(count(*) AS INTEGER) AS shared FROM {items} x JOIN {items} y ON x.source = y.source AND x.{item} = y.{item} AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN {name}_n x ON x.doc_id = p.a JOIN {name}_n y ON y.doc_id = p.b)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def gram_rows(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(source, doc_id, g): all grams; g is a 64-bit hash, which joins faster than text."""
    grams = tokenised(spark, sf_dir).select("source", "doc_id", F.explode_outer(text.ngrams(F.col("tokens"), n)).alias("gram"))
    return grams.filter("gram IS NOT NULL").select("source", "doc_id", F.xxhash64("gram").alias("g"))


def fingerprinted(spark: SparkSession, sf_dir: str, hashes: bool = False) -> DataFrame:
    return text.fingerprints(tokenised(spark, sf_dir).select("source", "doc_id", "tokens"), hashes=hashes)


def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark, sf_dir).select("source", "doc_id", F.explode_outer("fingerprint").alias("fp")).filter("fp IS NOT NULL")


def tokens_per_doc(spark, sf_dir):
    return tokenised(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def ngram_counts(spark, sf_dir):
    grams = tokenised(spark, sf_dir).withColumn("grams", text.ngrams(F.col("tokens"), 5))
    return grams.select("doc_id", F.size("grams").cast("long").alias("n_grams"), F.size(F.array_distinct("grams")).cast("long").alias("n_distinct"))


def ngram_counts_short_docs(spark, sf_dir):
    short = tokenised(spark, sf_dir).filter(F.size("tokens") < 5)
    return short.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(text.ngrams(F.col("tokens"), 5), "|").alias("grams"))


def winnow_fingerprints(spark, sf_dir):
    docs = fingerprinted(spark, sf_dir)
    return docs.select("doc_id", F.size("fingerprint").cast("long").alias("n_fingerprints"), F.array_min("fingerprint").alias("low"), F.array_max("fingerprint").alias("high"))


def fingerprint_compression(spark, sf_dir):
    docs = fingerprinted(spark, sf_dir).select("source", F.size(text.ngrams(F.col("tokens"), 5)).alias("g"), F.size("fingerprint").alias("f"))
    return docs.groupBy("source").agg(F.sum("g").alias("grams"), F.sum("f").alias("fingerprints"), (F.sum("f") / F.sum("g")).alias("share"))


def ngram_jaccard_pairs(spark, sf_dir):
    found = signals.overlap_pairs(gram_rows(spark, sf_dir, 5), "source", "doc_id", "g")
    return found.select("source", "a", "b", "shared", "jaccard")


def trigram_jaccard_pairs(spark, sf_dir):
    found = signals.overlap_pairs(gram_rows(spark, sf_dir, 3), "source", "doc_id", "g")
    return found.select("source", "a", "b", "shared", "jaccard")


def winnow_similarity_pairs(spark, sf_dir):
    found = signals.overlap_pairs(fingerprint_rows(spark, sf_dir), "source", "doc_id", "fp")
    return found.select("source", "a", "b", "shared", F.col("jaccard").alias("winnow"))


def shared_fingerprint_candidates(spark, sf_dir):
    return winnow_similarity_pairs(spark, sf_dir).filter("shared >= 3").groupBy("source").agg(F.count("*").alias("candidates"), F.sum("shared").alias("shared"))


def normalize_whitespace_docs(spark, sf_dir):
    tidy = documents(spark, sf_dir).select("doc_id", text.normalize_whitespace(F.col("text")).alias("x"))
    return tidy.select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n_chars"))


def path_basename(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", basename(F.col("url")).alias("name"))


def leading_number(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.coalesce(text.leading_number(basename(F.col("url"))), F.lit(-1)).alias("number"))


def problem_folders(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _weights(spark, sf_dir):
    return signals.tfidf(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", text.tokens(F.col("text")))


def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("length"))


def tfidf_cosine_pairs(spark, sf_dir):
    found = signals.sparse_cosine(_weights(spark, sf_dir), documents(spark, sf_dir), "source", "doc_id")
    return found.select("source", "a", "b", F.round("cosine", 6).alias("cosine"))


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("block", F.col("vec_id") % 8)


def _cosines(spark, sf_dir):
    unit = _vectors(spark, sf_dir).select("vec_id", "label", signals.l2_normalise(F.col("embedding")).alias("v"))
    return cells.in_cells(unit, [], "vec_id", ["label"], lambda a, b: {"cosine": cells.cosines(a["v"], b["v"])}, "cosine double")


def embedding_cosine_pairs(spark, sf_dir):
    return _cosines(spark, sf_dir).select(F.col("vec_id_a").alias("a"), F.col("vec_id_b").alias("b"), F.round("cosine", 6).alias("cosine"))


def embedding_l2_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(signals.norm(F.col("embedding")), 6).alias("norm"), F.round(signals.norm(signals.l2_normalise(F.col("embedding"))), 6).alias("unit"))


def embedding_summary_by_label(spark, sf_dir):
    rated = _cosines(spark, sf_dir).withColumn("same", (F.col("label_a") == F.col("label_b")).cast("int"))
    found = evaluation.summary(rated, "cosine", ["same"])
    return found.select("same", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean")))


def masked_mean_vectors(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("block", "embedding", (F.col("label") % 2 == 0).alias("mask"))
    found = signals.masked_mean(vectors, "block", "embedding", "mask")
    return found.select("block", F.posexplode("embedding").alias("dim", "x")).select("block", "dim", F.round("x", 6).alias("x"))


def unique_files(spark, sf_dir):
    found = ngram_jaccard_pairs(spark, sf_dir)
    return found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()


def similarity_matrix_long(spark, sf_dir):
    return graph.matrix_long(ngram_jaccard_pairs(spark, sf_dir), "source", "a", "b", "jaccard").select("source", F.col("i").alias("doc_i"), F.col("j").alias("doc_j"), "value")


def node_degrees(spark, sf_dir):
    found = graph.degrees(ngram_jaccard_pairs(spark, sf_dir).filter("jaccard >= 0.2"), "source", "a", "b")
    return found.select("source", F.col("node").alias("doc_id"), "degree")


_NAME = "split_part(replace(url, '\\', '/'), '/', -1)"
_COS = "c AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
_TFIDF = f"""{TOKENS},
w AS MATERIALIZED (SELECT doc_id, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM t WHERE len(ws) > 0),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS MATERIALIZED (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term)),
k AS MATERIALIZED (SELECT r.doc_id, r.term, raw / l AS weight FROM r JOIN (SELECT doc_id, sqrt(sum(raw * raw)) AS l FROM r GROUP BY doc_id) USING (doc_id))"""
_J5 = f"{TOKENS}, {grams_sql(5)}, g AS MATERIALIZED (SELECT DISTINCT source, doc_id, g FROM o), {overlap_sql('g', 'g', 'j')}"
_W = f"{TOKENS}, {grams_sql(5)}, {FINGERPRINTS}, {overlap_sql('f', 'fp', 'j')}"

QUERIES = {
    "tokens_per_doc": (tokens_per_doc, f"WITH {TOKENS} SELECT doc_id, len(ws) AS n_tokens FROM t"),
    "ngram_counts": (ngram_counts, f"WITH {TOKENS}, {grams_sql(5)} SELECT t.doc_id, count(g) AS n_grams, count(DISTINCT g) AS n_distinct FROM t LEFT JOIN o USING (doc_id) GROUP BY t.doc_id"),
    "ngram_counts_short_docs": (ngram_counts_short_docs, f"WITH {TOKENS} SELECT doc_id, len(ws) AS n_tokens, array_to_string(ws, ' ') AS grams FROM t WHERE len(ws) < 5"),
    "winnow_fingerprints": (winnow_fingerprints, f"WITH {TOKENS}, {grams_sql(5)}, {FINGERPRINTS} SELECT t.doc_id, count(fp) AS n_fingerprints, min(fp) AS low, max(fp) AS high FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id"),
    "fingerprint_compression": (fingerprint_compression, f"WITH {TOKENS}, {grams_sql(5)}, {FINGERPRINTS} SELECT source, CAST(g AS BIGINT) AS grams, CAST(n AS BIGINT) AS fingerprints, n / g AS share FROM (SELECT source, count(*) AS g FROM o GROUP BY source) JOIN (SELECT source, count(*) AS n FROM f GROUP BY source) USING (source)"),
    "ngram_jaccard_pairs": (ngram_jaccard_pairs, f"WITH {_J5} SELECT source, a, b, shared, jaccard FROM j"),
    "trigram_jaccard_pairs": (trigram_jaccard_pairs, f"WITH {TOKENS}, {grams_sql(3)}, g AS MATERIALIZED (SELECT DISTINCT source, doc_id, g FROM o), {overlap_sql('g', 'g', 'j')} SELECT source, a, b, shared, jaccard FROM j"),
    "winnow_similarity_pairs": (winnow_similarity_pairs, f"WITH {_W} SELECT source, a, b, shared, jaccard AS winnow FROM j"),
    "shared_fingerprint_candidates": (shared_fingerprint_candidates, f"WITH {_W} SELECT source, count(*) AS candidates, CAST(sum(shared) AS BIGINT) AS shared FROM j WHERE shared >= 3 GROUP BY source"),
    "normalize_whitespace_docs": (normalize_whitespace_docs, r"SELECT doc_id, md5(x) AS digest, length(x) AS n_chars FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\f]'), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10)) AS x FROM documents)"),
    "path_basename": (path_basename, f"SELECT page_id, {_NAME} AS name FROM pages"),
    "leading_number": (leading_number, f"SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract({_NAME}, '^([0-9]+)', 1), '') AS INTEGER), -1) AS number FROM pages"),
    "problem_folders": (problem_folders, "SELECT source, count(*) AS files, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY source"),
    "tfidf_weights": (tfidf_weights, f"WITH {_TFIDF} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight * weight), 6) AS length FROM k GROUP BY doc_id"),
    "tfidf_cosine_pairs": (tfidf_cosine_pairs, f"WITH {_TFIDF}, p AS MATERIALIZED (SELECT k.doc_id, d.source, k.term, k.weight FROM k JOIN documents d USING (doc_id)) SELECT source, a, b, round(cosine, 6) AS cosine FROM (SELECT x.source, x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS cosine FROM p x JOIN p y ON x.source = y.source AND x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL)"),
    "embedding_cosine_pairs": (embedding_cosine_pairs, f"WITH {_COS} SELECT a, b, round(cosine, 6) AS cosine FROM c"),
    "embedding_l2_norms": (embedding_l2_norms, "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings"),
    "embedding_summary_by_label": (embedding_summary_by_label, f"WITH {_COS} SELECT CAST(la = lb AS INTEGER) AS same, count(*) AS n, round(min(cosine), 6) AS low, round(max(cosine), 6) AS high, round(avg(cosine), 6) AS mean FROM c GROUP BY 1"),
    "masked_mean_vectors": (masked_mean_vectors, "SELECT block, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS x FROM (SELECT vec_id % 8 AS block, unnest(generate_series(1, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x, label FROM embeddings) WHERE label % 2 = 0 GROUP BY ALL"),
    "unique_files": (unique_files, f"WITH {_J5} SELECT a AS doc_id FROM j UNION SELECT b FROM j"),
    "similarity_matrix_long": (similarity_matrix_long, f"WITH {_J5}, e AS (SELECT source, a AS doc_i, b AS doc_j, jaccard AS value FROM j), s AS (SELECT * FROM e UNION ALL SELECT source, doc_j, doc_i, value FROM e) SELECT * FROM s UNION ALL SELECT DISTINCT source, doc_i, doc_i, 1.0::DOUBLE FROM s"),
    "node_degrees": (node_degrees, f"WITH {_J5} SELECT source, doc_id, count(*) AS degree FROM (SELECT source, a AS doc_id FROM j WHERE jaccard >= 0.2 UNION ALL SELECT source, b FROM j WHERE jaccard >= 0.2) GROUP BY ALL"),
}
