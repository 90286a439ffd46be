"""Queries over small tables against brute force: the whole grid and every pair."""

import difflib
import math
import random
from itertools import combinations, product

import pytest
from test_operators import brute_auc, brute_threshold

from kinsift.operators import evidence
from kinsift.plans import catalogue, code_queries, fusion_queries


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: 36 documents of three sources that share passages, and their vectors."""
    rng, at = random.Random(7), tmp_path_factory.mktemp("small")
    passages = [" ".join(f"w{rng.randrange(40)}" for _ in range(9)) for _ in range(5)]
    docs, vectors = [], []
    for i in range(36):
        text = " ".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(f"x{rng.randrange(400)}" for _ in range(rng.randrange(4, 12))) for _ in range(4))
        docs.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text)))
        vectors.append((i, [rng.gauss(0.3, 1) for _ in range(4)], i % 5))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def brute_lopo(rows, names, k):
    """(a, b) to (score, threshold, flagged, label): per held-out problem the best of all weights in steps of 1 / k."""
    grid = [w for head in product(range(k + 1), repeat=len(names) - 1) if sum(head) <= k for w in [[x / k for x in (*head, k - sum(head))]]]
    out = {}
    for fold in sorted({r.problem_id for r in rows}):
        rest = [r for r in rows if r.problem_id != fold]
        lo, hi = ([f(r[s] for r in rest) for s in names] for f in (min, max))
        flat = lambda r: [max(0.0, min(1.0, (r[s] - a) / ((z - a) or 1.0))) for s, a, z in zip(names, lo, hi)]  # noqa: B023, E731
        rate = lambda x, w: sum((a * b for a, b in zip(x, w)), 0.0)
        training = [(flat(r), r.same) for r in rest]
        best = max(grid, key=lambda w: brute_auc([(rate(x, w), y) for x, y in training]) - 1e-3 * sum(v * v for v in w))
        limit = brute_threshold([(rate(x, best), y) for x, y in training])
        for r in rows:
            if r.problem_id == fold:
                s = rate(flat(r), best)
                out[r.a, r.b] = (s, limit, s >= limit, r.same)
    return out


def test_held_out_queries_search_the_whole_grid(spark, small):
    rows = fusion_queries._filled(spark, small).collect()
    assert len({r.problem_id for r in rows}) == 3 and {r.same for r in rows} == {0, 1}
    queries, brute = catalogue.queries(), {}
    for name, names in (("lopo_scores", fusion_queries.THREE), ("lopo_scores_four", fusion_queries.SIGNALS)):
        brute[name] = brute_lopo(rows, names, 10)
        assert any(abs(brute[name][k][0] - v[0]) > 1e-6 for k, v in brute_lopo(rows, names, 5).items())  # a coarse grid gives other scores
        got = {(r.a, r.b): r for r in queries[name](spark, small).collect()}
        assert got.keys() == brute[name].keys()
        for k, (s, limit, flag, _) in brute[name].items():
            assert abs(got[k].score - s) < 1e-9 and abs(got[k].threshold - limit) < 1e-9 and got[k].flagged == int(flag)
    compared = {r.configuration: r for r in queries["configuration_comparison"](spark, small).collect()}
    assert len(compared) == 7
    for name, configuration in (("lopo_scores", "3 signals"), ("lopo_scores_four", "4 signals")):
        area = brute_auc([(s, y) for s, _, _, y in brute[name].values()])
        right = sum(flag == (y == 1) for _, _, flag, y in brute[name].values()) / len(rows)
        for r in (compared[configuration], queries[name.replace("scores", "metrics")](spark, small).first()):
            assert abs(r.auc - area) < 1e-9 and abs(r.accuracy - right) < 1e-9


def test_cosines_of_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 4) for i in range(30)] + [(30, [1.0, 0.0, 0.0], 0), (31, [0.0, 0.0, 0.0], None)]
    rows[13] = (13, rows[6][1], rows[6][2])  # equal vectors whose ids differ modulo 8
    kind = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").collect()  # as floats
    length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    brute = {(x.vec_id, y.vec_id): (sum(p * q for p, q in zip(x.embedding, y.embedding)) / length(x.embedding) / length(y.embedding), None if x.label is None or y.label is None else int(x.label == y.label)) for x, y in combinations(rows, 2)}
    found = catalogue.queries()["embedding_cosine_pairs"](spark, str(tmp_path)).collect()
    got = {(r.a, r.b): r.cosine for r in found}
    assert len(found) == len(got) == 32 * 31 // 2 and got.keys() == brute.keys() and got[6, 13] == 1.0
    assert all(abs(got[k] - v[0]) < 1e-6 for k, v in brute.items())
    summary = {r.same: r for r in catalogue.queries()["embedding_summary_by_label"](spark, str(tmp_path)).collect()}
    assert summary.keys() == {0, 1, None}
    for same, r in summary.items():
        some = [v for v, s in brute.values() if s == same]
        assert r.n == len(some) and all(abs(x - y) < 2e-6 for x, y in ((r.low, min(some)), (r.high, max(some)), (r.mean, sum(some) / len(some))))


def test_programs_of_one_size_are_one_problem(spark, tmp_path):
    rows = [(k, "n", "b", "t", 1 + k % 2, 9.5) for k in range(1, 70, 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    count = {size: sum(r[4] == size for r in rows) for size in (1, 2)}
    assert {(r.problem_id, r["count"]) for r in code_queries.programs(spark, str(tmp_path)).groupBy("problem_id").count().collect()} == {(f"size{s}", n) for s, n in count.items() if n}
    assert catalogue.queries()["structural_pairs"](spark, str(tmp_path)).count() == sum(n * (n - 1) // 2 for n in count.values())


def test_diffs_agree_between_runs(spark, tmp_path):
    rows = [(k, "n", "b", "t", 1, 9.5) for k in range(1, 40, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    runs = [{tuple(r) for r in catalogue.queries()["pair_diff_html"](spark, str(tmp_path)).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len({r[-1] for r in runs[0]}) == len(runs[0]) > 1


def test_diff_tables_are_those_of_htmldiff_without_its_search(monkeypatch):
    rnd = random.Random(5)
    words = ["a", "ab", " ", "  ", "\t", "<", "&", "x = 1", "price_", "(", "?", "+", "-", "^", "\u00e9", "12"]
    line = lambda most: "".join(rnd.choice(words) for _ in range(rnd.randrange(most)))
    cases = [("", ""), ("", "a"), ("a\n\n\nb", "b"), ("x = Part17()\ny = x.scaled(17)", "x = Part942()\ny = x.scaled(942)"), ("a" * 130, "a" * 70 + "b" * 60)]
    for _ in range(300):
        before = [line(rnd.choice((4, 30))) for _ in range(rnd.randrange(9))]
        after = [x if rnd.random() < 0.5 else x[: len(x) // 2] + line(4) + x[len(x) // 2 + 1 :] for x in before if rnd.random() < 0.9]
        after.insert(rnd.randrange(len(after) + 1), line(9))
        cases.append(("\n".join(before), "\n".join(after)))
    differ = evidence._Diff(wrapcolumn=60)
    differ.pair = "p"
    wanted = [differ.make_table(a.splitlines(), b.splitlines(), fromdesc="n", todesc="m") for a, b in cases]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert [differ.table(a, b, "n", "m") for a, b in cases] == wanted
    monkeypatch.undo()
    for a, b in (("a\0b", "a"), ("\n".join("ab" * 110), "b"), ("xy" * 120, "xz" * 120)):  # not taken here
        assert differ.table(a, b, "n", "m") == differ.make_table(a.splitlines(), b.splitlines(), fromdesc="n", todesc="m")
