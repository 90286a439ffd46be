"""Nearest neighbours, mixing, packing and the pipeline."""

import bisect
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinsift.llm import ann, exact_dedup, minhash, mixing, packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def exact_neighbours(ids, x, k):
    ids, x = np.array(ids), np.array(x)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[q], 12)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    monkeypatch.setattr(ann, "PART_QUERIES", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2500, 24)) * 0.3 + (rng.standard_normal((20, 24))[rng.integers(0, 20, 2500)] if clustered else 0)
    x[600:1400] = x[600]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int, list int")
    got = ann.search(df, F.col("vec_id") % 50 == 0, per_list=100).collect()
    wanted = exact_neighbours(range(2500), x, 5)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(wanted) and all(len(v) == 5 for v in by.values())
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    assert [i for i, _ in by[650]] == [600, 601, 602, 603, 604]  # ties go to the smaller id
    for q, found in by.items():
        assert found == sorted(found, key=lambda e: (-e[1], e[0]))
        for i, s in found:
            assert abs(s - x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i]))) < 1e-12


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.inf, 1.0]), (6, [math.nan, 1.0]), (7, []), (8, [1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1, 1, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0)}
    assert ann.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_targets():
    got = mixing.targets({"b": 100, "a": 100, None: 100})
    # a: 450*5/8 > 200 stops there; the rest, 250, goes 2:1 to b and None
    assert got["a"] == 200 and abs(got["b"] - 500 / 3) < 1e-9 and abs(got[None] - 250 / 3) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    rng = random.Random(0)
    for _ in range(50):
        sizes = {f"s{i}": rng.randrange(1, 1000) for i in range(rng.randrange(1, 9))}
        t = mixing.targets(sizes)
        assert all(t[s] <= 2 * n + 1e-6 for s, n in sizes.items()) and abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1e-6


def mix_rows(seed):
    rng = random.Random(seed)
    sources = ["a"] * 300 + [f"s{i}" for i in range(6) for _ in range(60)] + [None] * 50
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 80))), s, 1) for i, s in enumerate(sources)]
    rows += [(5000 + i, "same five words every time", "a", 1) for i in range(400)]
    return rows + [(9000, None, "a", 1), (9001, "", None, 1), (9002, "w " * 3_000, "s1", 1), (9003, "x y\x1fz a", "s2", 1)]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 64)
    rows = mix_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {i: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]) for i, t, _, _ in rows}
    made, target = {}, {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        made[r.source] = made.get(r.source, 0) + r.taken
        target[r.source] = r.target
    sums = {}
    for i, _, s, _ in rows:
        sums[s] = sums.get(s, 0) + size[i]
    wanted = mixing.targets(sums)
    for s, t in wanted.items():
        assert abs(target[s] - t) < 1e-6 and abs(made[s] - t) <= max(0.01 * t, 6), (s, made[s], t)
    again = mixing.mix(df.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_mix_against_the_definition(spark):
    """Rates from a bisection of the dual, copies from the rounding of cells by size."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 13, 40, rng.randrange(1, 200)]), rng.choice(["a", "b", "c", None])) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        scale, target = max(1.0, sum(r.size for r in own) / len(own)), own[0].target
        rate = lambda a, size: 0.0 if not size else 2 / (1 + math.exp(-max(-600, min(600, a * size / scale))))
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(r.size * rate(mid, r.size) for r in own) < target else (low, mid)
        if target < 2 * sum(r.size for r in own) * (1 - 1e-9):
            assert all(abs(r.rate - rate(low, r.size)) < 1e-3 for r in own)
        cells = {}
        for r in own:
            cells.setdefault(r.size, []).append(r)
        debt = 0.0
        for size in sorted(cells, reverse=True):
            cell = cells[size]
            made = sum(r.copies for r in cell)
            assert max(r.copies for r in cell) - min(r.copies for r in cell) <= 1
            if size:
                wanted = min(max(round(len(cell) * cell[0].rate + debt / size), 0), 2 * len(cell))
                assert made == wanted
                debt += (len(cell) * cell[0].rate - made) * size
            else:
                assert made == 0


def test_mix_edges(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a")], kind)).collect()
    assert [r.taken for r in got] == [0, 0, 0]


def optimum(sizes, capacity):
    """Fewest bins by trying all assignments of a few items."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
    counts = {s: sizes.count(s) for s in set(sizes)}
    fixed, rest = packing.reduce_by_dominance(counts, capacity)
    used = [s for p, t in fixed for s in p for _ in range(t)]
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sorted(used + left) == sorted(sizes) and all(sum(p) <= capacity for p, _ in fixed)
    assert sum(t for _, t in fixed) + optimum(left, capacity) == optimum(sizes, capacity)


@pytest.mark.parametrize("seed", range(5))
def test_plan_and_slots(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 2048): rng.randrange(1, 40) for _ in range(300)}
    made = packing.plan(counts, 2048)
    rooms: list[int] = []  # plain best-fit decreasing, item by item
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 2048) - s)
    assert sum(t for _, t in made) <= len(rooms)
    assert sum(t for _, t in made) >= sum(s * n for s, n in counts.items()) / 2048
    places = {}
    for size, first, ranks, each, sequence, offset in packing.slots(made):
        for r in range(ranks):
            places.setdefault(sequence + r // each, []).append((offset + size * (r % each), size))
        assert ranks >= 0 and first >= 0
    for items in places.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= 2048
    assert sorted(s for items in places.values() for _, s in items) == sorted(s for s, n in counts.items() for _ in range(n))


TEXTS = ["", None, "Hello, World! it's 2024", "ÀÉ naïve x  y", "a\x01b \x01 c", "<|endoftext|> x<|startoftext|>y", "é combining", "word " * 5000, "longword" * 4000, "日本語 text", "ΣΑΣ İ", "a\tb\r\nc\x0bd", "tail"]


def brute_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            yield i, k, at, len(part), zlib.crc32(part.tobytes())


@pytest.mark.parametrize("capacity", [7, 2048])
def test_pack(spark, capacity):
    rows = [*enumerate(TEXTS), (3, "repeated id"), (50, "same"), (50, "same")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int")
    got = packing.pack(df, PATH, capacity).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(brute_pieces(rows, capacity))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert packing.pack(df.filter("false"), PATH).count() == 0


def test_remembered_words_are_dropped(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 50)
    tokenizer, whole = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    import pyarrow as pa

    from kinsift.llm.shingles import text_buffer

    for a in range(0, 300, 30):
        text = " ".join(f"word{i}" for i in range(a, a + 40))
        ids, cuts = tokenizer.encode(*text_buffer(pa.array([text, ""])))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and cuts.tolist() == [0, len(ids), len(ids)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    en, de = "the and that with from this there which would about".split(), "der und die nicht mit auch eine werden schon über".split()
    texts = [" ".join(rng.choice(v) + rng.choice("aeiou") * rng.randrange(3) for _ in range(rng.randrange(15, 120))) for v in [en] * 60 + [de] * 60]
    texts += [texts[3]] * 4 + [texts[5].upper()] + [" ".join([*texts[7].split()[:-1], "changed"])] + [None, "", "12 34"]
    rows = [(i, t, "en" if i < 60 else "de" if i < 120 else None, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept[name] = now.collect()
        now = spark.createDataFrame(kept[name], docs.schema)
    ids = {name: {r.doc_id for r in found} for name, found in kept.items()}
    assert not ids["language"] & {126, 127, 128} and ids["language"] >= set(range(126))
    # of equal texts the largest id stays
    assert ids["language"] - ids["exact"] == {3, 120, 121, 122, 5}
    assert ids["exact"] - ids["near"] == {125}
    copies = {}
    for r in kept["mixture"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= ids["near"] and max(copies.values()) <= 2
    sums = {}
    for r in kept["near"]:
        sums[r.source] = sums.get(r.source, 0) + len(r.text.split())
    for s, t in mixing.targets(sums).items():
        assert abs(sum(len(r.text.split()) for r in kept["mixture"] if r.source == s) - t) <= 0.03 * t
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(brute_pieces([(r.doc_id, r.text) for r in kept["mixture"]], 2048))


def test_operators_agree_with_each_other(spark):
    rows = [(i, t) for i, t in enumerate(itertools.chain.from_iterable([[f"text number {k} with words {k * k}"] * (k % 4 + 1) for k in range(20)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()}
    parts = {r.doc_id: r.component_id for r in minhash.near_dedup(df, 4).collect()}
    assert all((groups[a] == groups[b]) <= (parts[a] == parts[b]) for a, b in itertools.combinations(groups, 2))


EN = "the and that with from this there which would about".split()


def odd_documents(spark):
    """Rows that share ids, equal rows, nulls everywhere, a long text, and columns with names that stages use."""
    rng = random.Random(4)
    plain = [" ".join(rng.choice(EN) + rng.choice("aeiou") for _ in range(30)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(plain)]
    rows += [(10, plain[3], "en", "s1", 1), (10, "12 34", "en", "s1", 2)]  # a copy and a document without letters, by the id of a good one
    rows += [(50, plain[5].upper(), "en", None, 3)] * 3  # equal rows
    rows += [(None, plain[7] + " extra", None, None, None), (None, None, None, None, None), (51, "", "en", "s0", 0)]
    rows += [(52, " ".join(rng.choice(EN) + rng.choice("aeiou") for _ in range(60_000)), "en", "s0", 9)]
    odd = [(*r, "x", 1, 2, {"k": "v"}) for r in rows]
    return spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, sha string, _row long, _id int, m map<string,string>")


def test_stages_decide_about_rows(spark):
    import corpus_pipeline as pipeline

    docs = odd_documents(spark)
    plain = {r.doc_id: r.text for r in docs.filter("doc_id < 40 AND n_chars > 2").collect()}
    first = pipeline.language(spark, docs, "")
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    assert first.columns == docs.columns and first.count() == docs.count() - 3
    assert rows - {(r.doc_id, r.text) for r in first.collect()} == {(10, "12 34"), (None, None), (51, "")}
    second = pipeline.exact(spark, first, "")
    left = sorted(((r.doc_id, r.text) for r in second.collect()), key=str)
    # (10, plain[3]) beats (3, plain[3]); one of three equal rows stays and beats (5, plain[5])
    assert second.columns == docs.columns
    assert left == sorted(({(r.doc_id, r.text) for r in first.collect()} - {(3, plain[3]), (5, plain[5])}), key=str)
    third = pipeline.near(spark, second, "")
    # no id at all is less than id 7
    assert set(left) - {(r.doc_id, r.text) for r in third.collect()} == {(7, plain[7])}
    assert third.count() == len(left) - 1
    fourth = pipeline.mixture(spark, third, "")
    copies = {}
    for r in fourth.collect():
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    assert fourth.columns == docs.columns and max(copies.values()) <= 2 and set(copies) <= {(r.doc_id, r.text) for r in third.collect()}
    wanted = {}
    for r in mixing.mix(pipeline._as_documents(*pipeline.numbered(third))).collect():
        wanted[r.size, r.source] = wanted.get((r.size, r.source), 0) + r.copies
    got = {}
    for r in fourth.collect():
        got[len(r.text.split()), r.source] = got.get((len(r.text.split()), r.source), 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}
    pieces = pipeline.packed(spark, fourth, "").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces), key=str) == sorted(brute_pieces([(r.doc_id, r.text) for r in fourth.collect()], 2048), key=str)


def test_stages_of_nothing(spark):
    import corpus_pipeline as pipeline

    docs = odd_documents(spark).filter("false")
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)
