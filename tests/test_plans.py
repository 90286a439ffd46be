"""Files, whole runs, evidence, streaming and the catalogue."""

import json
import os
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from kinsift.operators import fusion, signals
from kinsift.plans import api, catalogue, code_queries
from kinsift.sources import files, schemas
from kinsift.sources.scratch import keep_ids, materialise

A = "def area(w, h):\n    total = 0\n    for i in range(h):\n        total += w\n    return total\n\nprint(area(3, 4))\n"
B = "# my own\ndef f(x, y):\n    s = 0\n    for k in range(y):\n        s += x\n    return s\n\nprint(f(3, 4))\n"
C = "class Node:\n    def __init__(self, v):\n        self.v = v\n        self.next = None\n\nn = Node(5)\nwhile n:\n    n = n.next\n"


@pytest.fixture
def tree(tmp_path):
    for problem, name, text in (("area", "1_a.py", A), ("area", "2_a.py", B), ("area", "3_a.py", C), ("list", "1_l.py", C), ("list", "2_l.py", "x = (\n")):
        (tmp_path / "dataset" / problem).mkdir(parents=True, exist_ok=True)
        (tmp_path / "dataset" / problem / name).write_text(text)
    (tmp_path / "dataset" / "area" / "9_bad.py").write_bytes(b"x = '\xff'\n")
    return tmp_path


def test_reading_trees(spark, tree):
    df = files.read_tree(spark, str(tree / "dataset"))
    got = {(r.problem_id, r.file): r.text for r in df.collect()}
    assert len(got) == 6 and got[("area", "1_a.py")] == A and got[("area", "9_bad.py")] == "x = ''\n"
    with pytest.raises(Exception, match="UTF8|utf-8"):
        files.read_tree(spark, str(tree / "dataset"), strict=True).collect()


def test_normalised_round_trip(spark, tree):
    docs, rejects = api.normalise(files.read_tree(spark, str(tree / "dataset")))
    assert [r.file for r in rejects.collect()] == ["2_l.py"]
    files.write_normalised(docs.withColumn("error", F.lit(None).cast("string")), str(tree / "out"))
    back = files.read_normalised(spark, str(tree / "out"))
    assert back.count() == 5
    same = {r.file: r.normalized for r in back.filter("problem_id = 'area'").collect()}
    assert same["1_a.py"] == same["2_a.py"] != same["3_a.py"]


def test_token_files(spark, tmp_path):
    os.makedirs(tmp_path / "p")
    (tmp_path / "p" / "1_a.tokens").write_text("a 'b c'\n")
    tokens = files.read_tokens(spark, str(tmp_path))
    docs = spark.createDataFrame([("p", "1_a.py"), ("p", "2_a.py")], "problem_id string, file string")
    got = {r.file: r.tokens for r in files.with_tokens(docs, tokens, tolerant=True).collect()}
    assert got == {"1_a.py": ["a", "'b", "c'"], "2_a.py": []}
    with pytest.raises(Exception, match="no tokens for 2_a.py"):
        files.with_tokens(docs, tokens).collect()


def test_tables_and_models(spark, tmp_path):
    rows = [("a.py", 'b "q", x.py', "p", None), ("a.py", "c.py", "p", 1)]
    files.write_csv(spark.createDataFrame(rows, schemas.PAIRS), str(tmp_path / "pairs"), one_file=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "pairs"), schemas.PAIRS).collect()), key=str) == sorted(rows, key=str)
    assert files.read_csv(spark, str(tmp_path / "pairs"), schemas.PAIRS_UNTYPED).filter("is_plagiarized = '1'").count() == 1
    path = files.write_model(code_queries.model(spark), str(tmp_path / "model"))
    assert files.read_model(spark, path).first().threshold == 0.5
    assert files.write_model(code_queries.model(spark), str(tmp_path / "model"), "original").endswith("_original_labels")


def test_fitted_model_in_file_schema(spark):
    df = spark.createDataFrame([(f"p{i % 3}", i / 10, (i * 7 % 10) / 10, (i * 3 % 10) / 10, (i * 9 % 10) / 10, int(i > 4)) for i in range(10)], "problem_id string, jaccard double, winnow double, structural double, embedding double, y int")
    from kinsift.operators import evaluation

    held = evaluation.metrics(evaluation.lopo(df, api.SIGNALS, "y", step=0.5), "flagged", "score", "y")
    average = df.withColumn("score", fusion.mean_of(api.SIGNALS[:3]))
    fallback_held = evaluation.metrics(evaluation.lopo_average(df, api.SIGNALS[:3], "y"), "flagged", "score", "y")
    out = fusion.model_struct(fusion.fit(df, api.SIGNALS, "y", 0.5), api.SIGNALS, "family", held, fusion.best_threshold(average, "score", "y"), fallback_held)
    row = out.first()
    assert row.signals == api.SIGNALS and len(row.weights) == 4 and abs(sum(row.weights) - 1) < 1e-9 and row.no_embedding.threshold is not None


def test_scan(spark):
    sources = files.from_uploads(spark, {"1.py": A, "2.py": B, "3.py": C, "4.py": "x = ("})
    out = api.scan(sources, code_queries.model(spark))
    best = out["pairs"].first()
    assert (best.file_a, best.file_b, best.score, best.flagged) == ("1.py", "2.py", 1.0, True) and best.verdict == "PLAGIARIZED"
    assert out["pairs"].count() == 3 and out["rejects"].first().file == "4.py"
    assert out["groups"].first().files == "1.py, 2.py" and out["matrix"].count() == 9
    assert out["degrees"].count() == 2
    assert api.scan(sources, code_queries.model(spark), threshold=1.1)["pairs"].filter("flagged").count() == 0
    with pytest.raises(ValueError):
        files.from_uploads(spark, {"1.py": A})


def test_scan_with_vectors(spark):
    sources = files.from_uploads(spark, {"1.py": A, "2.py": B})
    vectors = spark.createDataFrame([("upload", "1.py", [1.0, 0.0]), ("upload", "2.py", [1.0, 0.0])], "problem_id string, file string, embedding array<double>")
    assert api.scan(sources, code_queries.model(spark), vectors=vectors)["pairs"].first().embedding == 1.0


def test_raw_and_resplit_variants(spark):
    docs, _ = api.normalise(files.from_uploads(spark, {"1.py": '"""d"""\nx = "a b"\n', "2.py": "y = 'a b'\n"}))
    normal = api.pair_signals(api.features(docs)).first()
    raw = api.pair_signals(api.features(docs, "raw")).first()
    assert normal.structural == 1.0 > raw.structural and normal.jaccard == 1.0
    assert api.features(docs).first().grams == ["VAR1 = 'a b'"]
    split = api.features(docs, resplit=True).first()
    assert split.tokens == ["VAR1", "=", "'a", "b'"]
    with pytest.raises(ValueError):
        api.features(docs, "other")


def test_empty_sources_differ_by_variant(spark):
    docs = spark.createDataFrame([("p", "a", "", "", []), ("p", "b", "", "", [])], "problem_id string, file string, text string, normalized string, tokens array<string>")
    row = api.pair_signals(api.features(docs)).first()
    assert (row.jaccard, row.jaccard3, row.winnow) == (0.0, 1.0, 0.0)


def test_browse_and_report(spark):
    rows = [("d\\p\\1.py", "d\\p\\2.py", "p", 1, 0.9, 0.8, 0.9, None, 1, 0.87, 1, None), ("d/p/1.py", "d/p/3.py", "p", 0, 0.1, 0.0, 0.4, None, 0, 0.2, 0, None)]
    saved = spark.createDataFrame(rows, schemas.COMPOSITE)
    out = api.browse(saved, "p")
    first = out["pairs"].first()
    assert first.file_a == "1.py" and first.verdict == "PLAGIARIZED" and out["verdicts"].count() == 2
    assert api.browse(saved, "none")["pairs"].count() == 0
    assert api.pick(out["pairs"], 1, [F.desc("score")]).first().file_b == "3.py"
    sources = spark.createDataFrame([("p", "1.py", "a\nb<"), ("p", "2.py", "a\nc")], "problem_id string, file string, text string")
    pages = {r.name: r.html for r in api.report(out["pairs"].filter("flagged = 1"), sources, ["jaccard", "winnow"]).collect()}
    assert set(pages) == {"p", "index"} and "<dt>Score<dd>0.870<dt>" in pages["p"] and "b&lt;" in pages["p"] and "<p>1 pairs" in pages["index"]


def test_pages_are_files_with_working_links(spark, tmp_path):
    rows = [("a b/c", "1.py", "2.py", 0.9, 1, 1), ("plain", "1.py", "2.py", 0.8, 1, None)]
    flagged = spark.createDataFrame(rows, "problem_id string, file_a string, file_b string, score double, flagged int, label_used int")
    sources = spark.createDataFrame([(p, f, "x") for p in ("a b/c", "plain") for f in ("1.py", "2.py")], "problem_id string, file string, text string")
    for _ in range(2):
        files.write_pages(api.report(flagged, sources, []), str(tmp_path / "pages"))
    assert {x.name for x in (tmp_path / "pages").iterdir()} == {"index.html", "a b_c.html", "plain.html"}
    links = re.findall("href='([^']*)'", (tmp_path / "pages" / "index.html").read_text())
    assert all((tmp_path / "pages" / urllib.parse.unquote(x)).exists() for x in links) and len(links) == 2
    assert "index.html" in (tmp_path / "pages" / "plain.html").read_text()


def test_models_are_whole(spark, tmp_path):
    model = json.loads(code_queries.model(spark).toJSON().first())
    (tmp_path / "m.json").write_text(json.dumps(model, indent=2))
    assert files.read_model(spark, str(tmp_path / "m.json")).first().threshold == 0.5
    (tmp_path / "bad.json").write_text(json.dumps({"lo": [1]}, indent=2))
    with pytest.raises(ValueError):
        files.read_model(spark, str(tmp_path / "bad.json"))
    with pytest.warns(UserWarning, match="original"):
        files.write_model(code_queries.model(spark), str(tmp_path / "w"), "original")


def test_scan_flags_rounded_and_groups_unrounded_scores(spark):
    sources = files.from_uploads(spark, {"2.py": A, "1.py": C})
    whole = api.scan(sources, code_queries.model(spark))["matrix"].filter("i <> j").first().value
    first = api.scan(sources, code_queries.model(spark))["pairs"].first()
    assert (first.file_a, first.file_b) == ("2.py", "1.py")  # order of upload
    assert first.score == round(whole, 4) != whole
    for limit in (whole, first.score):  # one side of each other
        out = api.scan(sources, code_queries.model(spark).withColumn("no_embedding", F.col("no_embedding").withField("threshold", F.lit(limit))))
        assert out["pairs"].first().flagged == (first.score >= limit)
        assert out["groups"].count() == out["degrees"].count() / 2 == int(whole >= limit)
    with pytest.raises(ValueError):
        api.scan(files.from_uploads(spark, {"1.py": A, "2.py": "x = ("}), code_queries.model(spark))


def test_embed_run(spark):
    pairs = spark.createDataFrame([("p", "1", "2", 1), ("p", "1", "3", 0), ("q", "1", "2", 0)], "problem_id string, file_a string, file_b string, is_plagiarized int")
    sources = spark.createDataFrame([("p", "1", "a b c"), ("p", "2", "a b c"), ("p", "3", "x y"), ("q", "1", "a"), ("q", "2", "")], "problem_id string, file string, text string")
    out = api.embed_run(pairs, sources, signals.make_embedder("tfidf"))
    assert {(r.problem_id, r.file_b): r.embedding for r in out["pairs"].collect()} == {("p", "2"): 1.0, ("p", "3"): 0.0, ("q", "2"): 0.0}
    assert tuple(out["summary"].first()) == (0.0, 1.0, 0.0, 1.0)
    with pytest.raises(Exception, match="no source"):
        api.embed_run(pairs, sources.filter("file <> '3'"), signals.make_embedder("tfidf"))


def test_streaming(spark, tmp_path):
    from kinsift.streaming.submissions import watch

    kind = "block string, doc string, text string"
    words = " ".join(f"w{i}" for i in range(40))
    for i, rows in enumerate(([("p", "a", words), ("p", "b", "other " * 9)], [("p", "c", words + " end")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = watch(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check"), 0.5).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.a, r.b) for r in found] == [("c", "a")] and found[0].winnow > 0.7


def test_scratch(spark):
    df = materialise(spark.createDataFrame([(1, "a"), (None, "b")], "i long, s string"), "test")
    ids = materialise(df.select("i").filter("i IS NULL"), "test")
    assert keep_ids(df, ids, "i", "left_anti").first().s == "a" and keep_ids(df, ids, "i", "left_semi", small=0).first().s == "b"
    assert materialise(df.filter("false"), "test").count() == 0


def test_catalogue_is_consistent():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 60


def test_programs_are_dealt_out_and_parsed_once(spark, tmp_path):
    rows = [(i, f"Brand#{i}", "KIND", i % 3, 900.5 + i) for i in range(1, 40)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert code_queries.programs(spark, str(tmp_path)).rdd.getNumPartitions() >= 16  # 4 cores
    docs, rejects = api.normalise(code_queries.programs(spark, str(tmp_path)))
    assert docs.count() == 39 and rejects.count() == 0
    for df in (docs, rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [normalise_udf") == 1
