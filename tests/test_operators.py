"""Pairs, signals, fusion, evaluation and graphs on hand-made rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinsift.operators import evaluation, fusion, graph, pairs, signals
from kinsift.sources.files import basename, token_path


def test_pairs_stay_in_their_block(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "c"), ("q", "a")], "problem_id string, file string")
    got = {(r.problem_id, r.file_a, r.file_b) for r in pairs.within_blocks(df, "problem_id", "file").collect()}
    assert got == {("p", "a", "b"), ("p", "a", "c"), ("p", "b", "c")}
    assert pairs.one_bag(df.withColumn("pos", F.monotonically_increasing_id()), "pos", ("file",)).count() == 6


def test_labels_are_null_if_either_side_is(spark):
    files = spark.createDataFrame([("p", "1_a.py"), ("p", "5_a.py"), ("p", "x.py"), ("p", "2_a.py")], "problem_id string, file string")
    first = spark.createDataFrame([("p", 4)], "problem_id string, first_copy int")
    got = {(r.file_a, r.file_b): r.is_plagiarized for r in pairs.build_pairs(files, first).collect()}
    assert got[("1_a.py", "5_a.py")] == 1 and got[("1_a.py", "2_a.py")] == 0
    assert got[("5_a.py", "x.py")] is None and got[("1_a.py", "x.py")] is None
    done, unresolved = pairs.split_unresolved(pairs.build_pairs(files, first))
    assert done.count() == 3 and unresolved.count() == 3


def test_merges_and_lineage(spark):
    kind = "problem_id string, file_a string, file_b string, {} double"
    a = spark.createDataFrame([("p", "a", "b", 0.1), ("p", "a", "c", 0.2)], kind.format("x"))
    b = spark.createDataFrame([("p", "a", "b", 0.3)], kind.format("y"))
    assert pairs.merge_signals(a, b).count() == 1 and pairs.lost_rows(a, pairs.merge_signals(a, b)).first().file_b == "c"
    with pytest.raises(ValueError):
        pairs.checked_merge(a, b)
    lineage = spark.createDataFrame([("p", 1, 7), ("p", 2, 7), ("p", 3, 8)], "problem_id string, num int, family int")
    rows = spark.createDataFrame([("p", 1, 2), ("p", 1, 3), ("p", 1, 9)], "problem_id string, num_a int, num_b int")
    got = [r.same_family for r in pairs.with_families(rows, lineage, "problem_id", "num", "family", strict=False).orderBy("num_b").collect()]
    assert got == [1, 0, None]
    with pytest.raises(Exception, match="missing from the lineage"):
        pairs.with_families(rows, lineage, "problem_id", "num", "family").collect()


def test_paths(spark):
    df = spark.createDataFrame([("dataset\\p\\1_x.py",), ("/a/dataset/p/1_x.py",)], "x string")
    assert [r.y for r in df.select(basename(F.col("x")).alias("y")).collect()] == ["1_x.py"] * 2
    assert [r.y for r in df.select(token_path(F.col("x")).alias("y")).collect()] == ["preprocessed_output/p/1_x.tokens", "/a/preprocessed_output/p/1_x.tokens"]


def test_jaccard_of_arrays(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b", "b"], ["b", "c"]), (["a"], ["a"])], "a array<string>, b array<string>")
    got = df.select(signals.set_jaccard(F.col("a"), F.col("b")).alias("x"), signals.set_jaccard(F.col("a"), F.col("b"), 1.0).alias("y")).collect()
    assert [r.x for r in got] == [0.0, 0.0, 1 / 3, 1.0] and [r.y for r in got][0] == 1.0


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.8, 1.0])
def test_overlap_pairs_against_brute_force(spark, floor):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 8))} for i in range(40)}
    rows = [(i % 2, i, x) for i, s in sets.items() for x in s]
    df = spark.createDataFrame(rows + rows[:5], "k int, d int, x int")
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in signals.overlap_pairs(df, "k", "d", "x", floor).collect()}
    wanted = {}
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if i % 2 == j % 2 and both and both / len(sets[i] | sets[j]) >= floor:
            wanted[(i, j)] = (both, both / len(sets[i] | sets[j]))
    assert got == wanted


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(signals.norm(F.col("a")).alias("n"), signals.dot(signals.l2_normalise(F.col("a")), signals.l2_normalise(F.col("b"))).alias("c")).collect()
    assert [r.n for r in got] == [5.0, 0.0, 1.0] and [round(r.c, 12) for r in got] == [0.96, 0.0, -1.0]
    tokens = spark.createDataFrame([("d", [1.0, 2.0], True), ("d", [3.0, 4.0], True), ("d", [9.0, 9.0], False), ("e", [1.0, 1.0], False)], "doc string, v array<double>, m boolean")
    assert {r.doc: r.embedding for r in signals.masked_mean(tokens, "doc", "v", "m").collect()} == {"d": [2.0, 3.0], "e": [0.0, 0.0]}


def test_tfidf_weights(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "")], "doc string, text string")
    got = {(r.doc, r.term): r.weight for r in signals.tfidf(df, "doc", "text").collect()}
    rare, common = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    length = math.sqrt(common**2 + 2 * rare**2)
    assert got[("b", "x")] == 1.0 and abs(got[("a", "x y")] - rare / length) < 1e-12 and abs(got[("a", "x")] - common / length) < 1e-12


def test_tfidf_joins_are_no_broadcasts(spark):
    df = spark.createDataFrame([(str(i), f"x y{i % 7}") for i in range(50)] + [(None, "x")], "doc string, text string")
    out = signals.tfidf(df, "doc", "text")
    assert {r.doc for r in out.collect()} == {str(i) for i in range(50)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_embedders(spark):
    signals.register_embedder("lengths", signals.model_embedder(lambda: lambda texts: [[len(t)] for t in texts], batch=2))
    docs = spark.createDataFrame([(i, "x" * i) for i in range(5)], "doc long, text string")
    assert {r.doc: r.embedding for r in signals.make_embedder("lengths")(docs).collect()} == {i: [float(i)] for i in range(5)}
    got = {r.doc: r.embedding for r in signals.make_embedder("tfidf")(docs).collect()}
    assert len(got) == 5 and {len(v) for v in got.values()} == {4} and got[0] == [0.0] * 4 and sorted(got[2]) == [0.0, 0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        signals.make_embedder("none")


@pytest.mark.parametrize(("n", "size"), [(1, 1), (2, 11), (3, 66), (4, 286)])
def test_simplex(spark, n, size):
    rows = [tuple(r)[1:] for r in fusion.simplex_grid(spark, n, 0.1).orderBy("ord").collect()]
    assert len(rows) == size and rows == sorted(rows) and all(abs(sum(r) - 1) < 1e-9 for r in rows)


def brute_auc(rows):
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else None


def brute_threshold(rows):
    best, at, scores = -1.0, 0, sorted({s for s, _ in rows})
    for i, t in enumerate(scores):
        tp = sum(s >= t and y for s, y in rows)
        fp = sum(s >= t and not y for s, y in rows)
        fn = sum(s < t and y for s, y in rows)
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        if f1 > best + 1e-12:
            best, at = f1, i
    return (scores[at] + scores[max(at - 1, 0)]) / 2


@pytest.mark.parametrize("seed", range(4))
def test_auc_and_threshold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(30)]
    rows = [(s, int(y)) for s, y in rows]
    df = spark.createDataFrame(rows, "s double, y int")
    assert abs(fusion.auc(df, "s", "y").first().auc - brute_auc(rows)) < 1e-12
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert abs(fusion.auc(flipped, "s", "y").first().auc - (1 - brute_auc(rows))) < 1e-12
    assert abs(fusion.best_threshold(df, "s", "y").first().threshold - brute_threshold(rows)) < 1e-12


def test_threshold_edges(spark):
    kind = "s double, y int"
    assert fusion.best_threshold(spark.createDataFrame([(0.2, 1), (0.6, 1)], kind), "s", "y").first().threshold == 0.2  # the lowest score itself
    assert fusion.best_threshold(spark.createDataFrame([(0.2, 0), (0.6, 0)], kind), "s", "y").first().threshold == 0.2
    assert fusion.best_threshold(spark.createDataFrame([(0.2, 0), (0.6, 1)], kind), "s", "y").first().threshold == 0.4
    assert fusion.auc(spark.createDataFrame([(0.2, 1)], kind), "s", "y").first().auc is None


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    ranges = fusion.fit_minmax(df, ["x", "c"])
    more = df.union(spark.createDataFrame([(9.0, 4.0)], df.schema))
    assert [tuple(r) for r in fusion.apply_minmax(more, ranges, ["x", "c"]).collect()] == [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)]


def signal_rows(seed=1, n=48):
    rng = random.Random(seed)
    return [(f"p{i % 3}", *(round(min(1.0, max(0.0, rng.gauss(0.3 + 0.3 * y, 0.2))), 4) for _ in range(3)), y) for i in range(n) for y in [int(rng.random() < 0.5)]]


def brute_fit(rows, step=0.5):
    lo, hi = ([f(r[k] for r in rows) for k in (1, 2, 3)] for f in (min, max))
    flat = [[(r[k + 1] - lo[k]) / (hi[k] - lo[k] or 1.0) for k in range(3)] for r in rows]
    n = round(1 / step)
    best, weights = -math.inf, None
    for i in range(n + 1):
        for j in range(n + 1 - i):
            w = [i / n, j / n, (n - i - j) / n]
            got = brute_auc([(x[0] * w[0] + x[1] * w[1] + x[2] * w[2], r[4]) for x, r in zip(flat, rows)]) - 1e-3 * sum(v * v for v in w)
            if got > best:
                best, weights = got, w
    rated = [(sum(a * b for a, b in zip(x, weights)), r[4]) for x, r in zip(flat, rows)]
    return lo, hi, weights, brute_threshold(rated)


def test_fit_and_held_out_scores(spark):
    rows = signal_rows()
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, problem_id string, a double, b double, c double, y int")
    model = fusion.fit(df, names, "y", 0.5).first()
    lo, hi, w, t = brute_fit(rows)
    assert [model.w1, model.w2, model.w3] == w and abs(model.threshold - t) < 1e-9 and model.lo_a == lo[0] and model.hi_c == hi[2]
    got = {r.i: (r.score, r.flagged) for r in evaluation.lopo(df, names, "y", step=0.5).collect()}
    for i, r in enumerate(rows):
        lo, hi, w, t = brute_fit([x for x in rows if x[0] != r[0]])
        s = sum(min(1, max(0, (r[k + 1] - lo[k]) / (hi[k] - lo[k] or 1.0))) * w[k] for k in range(3))
        assert abs(got[i][0] - s) < 1e-9 and got[i][1] == (s >= t - 1e-12)
    mean = {r.i: (r.score, r.threshold) for r in evaluation.lopo_average(df, names, "y").collect()}
    for i, r in enumerate(rows):
        t = brute_threshold([(sum(x[1:4]) / 3, x[4]) for x in rows if x[0] != r[0]])
        assert abs(mean[i][0] - sum(r[1:4]) / 3) < 1e-12 and abs(mean[i][1] - t) < 1e-9


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, True, 1), (0.8, True, 0), (0.3, False, 1), (0.1, False, 0)], "s double, f boolean, y int")
    m = evaluation.metrics(df, "f", "s", "y").first()
    assert (m.precision, m.recall, m.f1, m.accuracy, m.auc) == (0.5, 0.5, 0.5, 0.5, 0.75)
    none = evaluation.metrics(df.withColumn("f", F.lit(False)), "f", "s", "y").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    assert [r.s for r in evaluation.errors(df.withColumn("t", F.lit(0.5)), "s", "t", "f", "y", ["s"]).collect()] == [0.8, 0.3]
    assert evaluation.by_group(df.withColumn("problem_id", F.lit("p")), "f", "y").first().wrong == 2
    assert {(r.signal, r.label): r.auc for r in evaluation.signal_auc(df, ["s"], ["y"]).collect()} == {("s", "y"): 0.75}


def test_composite_score(spark):
    names = ["jaccard", "winnow", "structural", "embedding"]
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 1.0), (0.2, 0.4, 0.6, None), (0.0, 0.0, 0.3, None)], ", ".join(f"{n} double" for n in names))
    arrays = [F.array(*(F.lit(float(x)) for x in row)) for row in ((0, 0, 0, 0), (1, 1, 1, 1), (0.25,) * 4)]
    score, flag = fusion.composite_score(names, *arrays, F.lit(0.6), F.lit(0.4))
    got = df.select(score.alias("s"), flag.alias("f"), fusion.verdict(flag).alias("v")).collect()
    assert [r.f for r in got] == [True, True, False] and got[0].s == 0.625 and got[2].v == "NOT PLAGIARIZED"
    score, flag = fusion.composite_score(names, *arrays, F.lit(0.6), F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no fallback"):
        df.select(flag).collect()


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100), (7, None)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups(spark):
    rows = [("p", "a", "b", 0.9, 1), ("p", "b", "c", 0.8, 1), ("p", "d", "e", 0.7, 1), ("p", "a", "f", 0.1, 0), ("q", "a", "b", 0.6, 1)]
    df = spark.createDataFrame(rows, "problem_id string, a string, b string, w double, flagged int")
    got = {(r.problem_id, r.group_id): (r["size"], r.files, r.num_flagged_edges, r.avg_composite) for r in graph.groups(df, "problem_id", "a", "b", "w").collect()}
    assert got == {("p", "p_1"): (3, "a;b;c", 2, 0.85), ("p", "p_2"): (2, "d;e", 1, 0.7), ("q", "q_1"): (2, "a;b", 1, 0.6)}
    assert graph.groups(df.filter("flagged = 0"), "problem_id", "a", "b", "w").count() == 0
    assert {(r.node, r.degree) for r in graph.degrees(df.filter("problem_id = 'p' AND flagged = 1"), "problem_id", "a", "b").collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 1), ("e", 1)}
    matrix = graph.matrix_long(df.filter("problem_id = 'q'"), "problem_id", "a", "b", "w").collect()
    assert {(r.i, r.j, r.value) for r in matrix} == {("a", "b", 0.6), ("b", "a", 0.6), ("a", "a", 1.0), ("b", "b", 1.0)}
    assert graph.heatmap(df.filter("problem_id = 'q'"), "problem_id", "a", "b", "w", ["a", "b"]).orderBy("i").first().b == 0.6
