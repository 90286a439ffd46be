"""Similarity signals of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsift.sources.scratch import materialise

from kinsift.functions.text import code_terms


def set_jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard of two arrays as sets; ``empty`` where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either <= 0, F.lit(empty)).otherwise(both / either)


def overlap_pairs(items: DataFrame, block: str, doc: str, item: str, floor: float = 0.0) -> DataFrame:
    """(block, a, b, shared, size_a, size_b, jaccard) of pairs that share an item, over distinct (block, doc, item).

    An inverted index: pairs arise where documents of a block share an item, so pairs without one (Jaccard 0) cost
    nothing.  With ``floor`` only pairs that reach it come out, and only the items that such a pair must share in part
    (the rarest of each document) are joined; the full overlap is then counted for the candidates alone.
    """
    items = items.select(block, doc, item).distinct()
    size = items.groupBy(block, doc).agg(F.count("*").cast("int").alias("size"))
    index = items
    if floor > 0:
        common = items.groupBy(block, item).agg(F.count("*").alias("df"))
        place = F.row_number().over(Window.partitionBy(block, doc).orderBy("df", item))
        ranked = items.join(common, [block, item]).join(size, [block, doc]).withColumn("place", place)
        # a pair with Jaccard f shares at least f of either side's items
        index = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * floor - 1e-9) + 1).filter("df > 1").select(block, doc, item)
    left, right = (index.select(block, F.col(doc).alias(s), item) for s in ("a", "b"))
    met = left.join(right, [block, item]).filter("a < b")
    if floor > 0:
        near = met.select(block, "a", "b").distinct()
        la, lb = (items.select(block, F.col(doc).alias(s), item) for s in ("a", "b"))
        met = near.join(la, [block, "a"]).join(lb, [block, "b", item])
    counted = met.groupBy(block, "a", "b").agg(F.count("*").cast("int").alias("shared"))
    for s in ("a", "b"):
        counted = counted.join(size.select(block, F.col(doc).alias(s), F.col("size").alias(f"size_{s}")), [block, s])
    out = counted.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return out.filter(F.col("jaccard") >= floor) if floor > 0 else out


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, terms added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.transform(v, lambda x: x.cast("double") / length)


def tfidf(docs: DataFrame, doc: str, text: str, terms: Column | None = None) -> DataFrame:
    """(doc, term, weight): raw counts times ln((1 + N) / (1 + df)) + 1, rows of unit length.

    Terms are by default code terms and pairs of neighbouring ones.  N counts documents, those without a term included.
    """
    words = docs.select(doc, (code_terms(F.col(text)) if terms is None else terms).alias("w"))
    grams = words.select(doc, F.concat("w", F.when(F.size("w") > 1, F.zip_with(F.slice(F.col("w"), 1, F.size("w") - 1), F.slice(F.col("w"), 2, F.size("w")), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))).alias("g"))
    counts = grams.select(doc, F.explode_outer("g").alias("term")).filter("term IS NOT NULL").groupBy(doc, "term").agg(F.count("*").alias("tf"))
    return tfidf_of_counts(counts, docs.agg(F.count("*").alias("n")), doc)


def tfidf_of_counts(counts: DataFrame, total: DataFrame, doc: str) -> DataFrame:
    """TF-IDF of (doc, term, tf); ``total``: one row with the number of documents in ``n``."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    # document frequencies grow with the rows, however small they are once packed: never a broadcast
    raw = counts.join(df.hint("merge"), "term").join(F.broadcast(total)).filter(F.col(doc).isNotNull())
    raw = raw.select(doc, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))  # one document's terms at a time
    return raw.select(doc, "term", (F.col("raw") / length).alias("weight"))


def sparse_cosine(weights: DataFrame, blocks: DataFrame, block: str, doc: str) -> DataFrame:
    """(block, a, b, cosine) of pairs of one block that share a term; ``blocks``: (block, doc)."""
    placed = weights.join(blocks.select(block, doc), doc)
    left, right = (placed.select(block, "term", F.col(doc).alias(s), F.col("weight").alias(f"w{s}")) for s in ("a", "b"))
    return left.join(right, [block, "term"]).filter("a < b").groupBy(block, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def masked_mean(vectors: DataFrame, doc: str, vector: str, mask: str) -> DataFrame:
    """Mean of the masked vectors of each document, by dimension; documents without any get zeros."""
    long = vectors.select(doc, mask, F.posexplode(vector).alias("dim", "x"))
    kept = F.sum(F.when(F.col(mask), 1.0).otherwise(0.0))
    mean = F.sum(F.when(F.col(mask), F.col("x").cast("double")).otherwise(0.0)) / F.greatest(kept, F.lit(1e-9))
    return long.groupBy(doc, "dim").agg(mean.alias("x")).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("embedding"))


EMBEDDERS: dict[str, object] = {}


def register_embedder(name: str, embed) -> None:
    """``embed``: DataFrame (doc, text) to DataFrame (doc, embedding)."""
    EMBEDDERS[name] = embed


def make_embedder(name: str):
    """A registered embedder, DataFrame (doc, text) to DataFrame (doc, embedding); ``tfidf`` is built in."""
    if name == "tfidf":
        return tfidf_embedder
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted([*EMBEDDERS, 'tfidf'])}")
    return EMBEDDERS[name]


def tfidf_embedder(docs: DataFrame) -> DataFrame:
    """(doc, embedding): TF-IDF vectors with a place for every term of all documents, terms in order.

    As long as the vocabulary, so for sets of sources; large collections take the sparse weights of :func:`tfidf`.
    """
    weights = materialise(tfidf(docs, "doc", "text"), "tfidf-weights")
    terms = weights.select("term").distinct().agg(F.array_sort(F.collect_list("term")).alias("terms"))
    own = weights.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w"))
    every = docs.select("doc").join(own, "doc", "left").crossJoin(F.broadcast(terms))  # one row
    return every.select("doc", F.transform("terms", lambda t: F.coalesce(F.try_element_at("w", t), F.lit(0.0))).alias("embedding"))


def model_embedder(load, batch: int = 8):
    """Embedder of a model: ``load()`` runs once per worker and gives a function from texts to vectors."""

    def embed(docs: DataFrame) -> DataFrame:
        kind = docs.schema["doc"].dataType.simpleString()

        def run(frames):
            model = load()
            for pdf in frames:
                for at in range(0, len(pdf), batch):
                    part = pdf.iloc[at : at + batch]
                    yield part[["doc"]].assign(embedding=[list(map(float, v)) for v in model(list(part["text"]))])

        return docs.select("doc", "text").mapInPandas(run, f"doc {kind}, embedding array<double>")

    return embed
