"""Pairs by postings against the plan of joins; thresholds by bins and groups by forests against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_threshold

from kinsift.operators import evaluation, fusion, graph, overlap
from kinsift.plans import catalogue, fusion_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, shared passages, nulls and far ids; vectors of some, with nulls and other lengths."""
    rng, at = random.Random(11), tmp_path_factory.mktemp("overlap")
    passages = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 12))) for _ in range(6)]
    docs = []
    for i in range(90):
        text = " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"x{rng.randrange(900)}" for _ in range(9)) for _ in range(rng.randrange(1, 6)))
        docs.append((i * 10**14 if i % 9 == 1 else i, None if i == 7 else text, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(text)))
    docs += [(1000 + i, docs[3][1], "en", docs[3][3], 50 + i) for i in range(8)]
    vectors = [(d[0], [rng.gauss(0, 1) for _ in range(3 if k % 5 else 2)] if k % 7 else [None, 1.0, 2.0], k % 2) for k, d in enumerate(docs) if k % 3] + [(5, [0.0, 0.0, 0.0], 0)] * (5 not in {d[0] for k, d in enumerate(docs) if k % 3})
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("own, meetings", [(1 << 14, 1 << 21), (7, 5)])
def test_pairs_by_postings_are_those_of_joins(spark, tables, monkeypatch, own, meetings):
    monkeypatch.setattr(overlap, "OWN", own)
    monkeypatch.setattr(overlap, "MEETINGS", meetings)
    whole = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:3])
    got = fusion_queries.signal_table(spark, tables)
    want = whole(fusion_queries._joined_table(spark, tables).select(*got.columns))
    assert whole(got) == want and len(want) > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0].replace("AdaptiveSparkPlan", "")
    families = {(r.a, r.b): r.same_family for r in catalogue.queries()["family_labels"](spark, tables).collect()}
    assert families == {(r[1], r[2]): r[7] for r in want} and None in families.values()


def test_repeated_ids_take_the_joins(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.union(docs.filter("doc_id < 4")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, want = fusion_queries.signal_table(spark, str(tmp_path)), fusion_queries._joined_table(spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bins", [4, 1 << 13])
def test_thresholds_by_bins(spark, monkeypatch, bins):
    monkeypatch.setattr(fusion, "BINS", bins)
    rng = random.Random(bins)
    rows = [(f"p{rng.randrange(4)}", rng.randrange(60) / 59, int(rng.random() < 0.4)) for _ in range(300)] + [("p9", 0.1, 1), ("p8", 0.95, 0)]
    df = spark.createDataFrame(rows, "problem_id string, x double, y int")
    some = fusion.condensed(df, "x", "y")
    assert some.count() < len({r[1] for r in rows}) or bins > 60
    assert abs(fusion.best_threshold(some, "score", None).first().threshold - brute_threshold([r[1:] for r in rows])) < 1e-12
    held = {r.problem_id: r.threshold for r in evaluation.lopo_average(df, ["x"], "y").select("problem_id", "threshold").distinct().collect()}
    assert held.keys() == {r[0] for r in rows}
    for fold, limit in held.items():
        assert abs(limit - brute_threshold([r[1:] for r in rows if r[0] != fold])) < 1e-12


def test_groups_by_forests(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 3)
    rng = random.Random(2)
    rows = list({(f"s{rng.randrange(2)}", *sorted(rng.sample(range(60), 2))) for _ in range(50)})
    df = spark.createDataFrame([(*r, i / 50, i % 4 > 0) for i, r in enumerate(rows)], "s string, a long, b long, w double, flagged boolean")
    names = spark.range(60).select(F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("s"), "id")
    got = sorted(map(tuple, graph.groups(df, "s", "a", "b", "w", nodes=names).collect()))
    assert got == sorted(map(tuple, graph.groups(df, "s", "a", "b", "w").collect()))
    parts = []
    for i, (s, a, b) in enumerate(rows):
        if i % 4:
            hit = [p for p in parts if (s, a) in p or (s, b) in p]
            parts = [p for p in parts if p not in hit] + [set().union({(s, a), (s, b)}, *hit)]
    want = sorted((s, ";".join(sorted(str(x) for _, x in p)), sum(i % 4 > 0 and (r[0], r[1]) in p for i, r in enumerate(rows))) for p in parts for s in {x for x, _ in p})
    assert sorted((r[0], r[3], r[4]) for r in got) == want


def test_signals_in_tasks_are_those_of_the_table(spark, tables):
    table = fusion_queries.signal_table(spark, tables).fillna(0.0, ["embedding"])
    seen = fusion_queries.signal_table(spark, tables, then=(lambda batches: batches, "x0 double, x1 double, x2 double, x3 double, y int, g int"))
    got = sorted((tuple(r)[:4], r.y) for r in seen.collect())
    assert got == sorted((tuple(r[s] for s in fusion_queries.SIGNALS), 2 if r.same is None else r.same) for r in table.collect())
    found = {r.signal: r.auc for r in catalogue.queries()["signal_auc"](spark, tables).collect()}
    assert found == {r.signal: r.auc for r in evaluation.signal_auc(table, fusion_queries.SIGNALS, ["same"]).collect()} and len(found) == 4
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) for _ in range(500)] + [(2 * k + 1) / 2e6 for k in range(-400, 400)] + [0.0, -0.0, 1.0, -1.0, 1.0000000000000002]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 6).alias("r")).toPandas()
    assert (fusion_queries._rounded(df["x"].to_numpy()) == df["r"].to_numpy()).all()


def test_average_metrics_write_no_signals(spark, tables, monkeypatch):
    table, written, write = fusion_queries.signal_table(spark, tables), [], fusion_queries.materialise
    want = evaluation.metrics(evaluation.lopo_average(table, fusion_queries.THREE, "same"), "flagged", "score", "same").first()
    monkeypatch.setattr(fusion_queries, "materialise", lambda df, *a, **b: written.append(df.columns) or write(df, *a, **b))
    assert catalogue.queries()["lopo_average_metrics"](spark, tables).first() == want and want.auc is not None
    assert written == [["problem_id", "mean", "same"]]
