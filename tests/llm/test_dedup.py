"""Exact, near and long-string dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import exact_dedup, minhash, suffix_dedup

KIND = "doc_id long, text string, raw int, sha string, n long, v int, a int, b int, key int"


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5, 6) for i, t in rows], KIND)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 1, 2, 3], [7, 1 << 47, (1 << 48) - 1], sorted(random.Random(1).sample(range(1 << 40), 3000))])
def test_golomb_round_trip(values):
    x = np.array(values, dtype=np.int64)
    assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(x)), x)
    if len(x) == 3000:
        assert len(exact_dedup.golomb_encode(x)) < 3000 * 4.2  # 40-bit values at 11.6 bits less each


ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "SAME TEXT"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "alone"), (10, "Alone"), (None, "none"), (None, "none")]


@pytest.mark.parametrize("bits", [4, 48])
@pytest.mark.parametrize("owners", [1, 7])
def test_exact(spark, bits, owners):
    got = exact_dedup.exact_dedup(docs(spark, ROWS), owners, bits).collect()
    assert len(got) == len(ROWS)
    groups = {}
    fold = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    for i, t in ROWS:
        groups.setdefault(fold(t), []).append(i)
    wanted = []
    for i, t in ROWS:
        own = groups[fold(t)]
        keep = max((x for x in own if x is not None), default=None)
        wanted.append((i, keep, len(own), i == keep, hashlib.sha256(fold(t)).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def brute_near(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {(i, len(s), find(i), i == find(i)) for i, s in sets.items()}


def near_rows(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "a b c d"), (5, "a b c d"), (6, " \t "), (7, "long " + words(rng, 5000))]
    passage = words(rng, 60)
    base = words(rng, 90)
    at = 10
    for _ in range(45):  # near copies of one text
        w = base.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((at, " ".join(w)))
        at += 1
    for _ in range(50):  # one passage with own words around it, in any proportion
        rows.append((at, words(rng, rng.randrange(1, 30), 10**6) + " " + passage))
        at += 1
    for _ in range(30):
        rows.append((at, words(rng, 50, 10**6)))
        at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 80), (2, 5, 80), (3, 3, 90)])
def test_near(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(minhash, "SHORT", 8)  # crowded lists and several blocks
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_rows(seed)
    got = {tuple(r) for r in minhash.near_dedup(docs(spark, rows), n, percent).collect()}
    assert got == brute_near(rows, n, percent)


def test_near_repeated_rows_and_nothing(spark):
    got = minhash.near_dedup(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}
    assert minhash.near_dedup(docs(spark, [])).count() == 0


def brute_strings(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        cut = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cut[s : s + length] = True
        runs = int((np.diff(cut.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(cut.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cut) if not c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [2, 2048])
@pytest.mark.parametrize("length", [51, 200])
def test_strings(spark, split, length):
    rng = random.Random(length)
    passage = words(rng, 80)
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 400), (4, "z" * 300), (5, passage), (5, passage), (6, "ü" * 150 + passage[:150])]
    for i in range(10, 40):
        body = words(rng, 60, 10**6)
        if i % 2:
            a, z = sorted(rng.sample(range(len(passage)), 2))
            body = words(rng, 10, 10**6) + " " + passage[a:z] + " " + body
        if i % 5 == 0:
            body += " " + body
        rows.append((i, body))
    rows += [(40, rows[-1][1]), (41, words(rng, 9000, 10**6))]
    got = suffix_dedup.suffix_dedup(docs(spark, rows), length, key_segments=split).collect()
    assert sorted(map(tuple, got), key=str) == brute_strings(rows, length)


def test_strings_of_many_equal_rows(spark):
    text = words(random.Random(2), 70, 10**6)
    rows = [(1, text)] * 1000 + [(None, text)] * 3 + [(2, text + " " + words(random.Random(3), 400, 10**6))]
    got = suffix_dedup.suffix_dedup(docs(spark, rows), 200, spans_out=True)
    assert sorted(map(tuple, got.drop("spans").collect()), key=str) == brute_strings(rows, 200)
    assert got.filter("size(spans) <> 1").count() == 0


def test_string_spans(spark):
    text = "abcdefghij" * 30
    rows = suffix_dedup.suffix_dedup(docs(spark, [(1, "0" + text), (2, text + "1"), (3, "x" * 50)]), 120, spans_out=True).orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in r.spans] for r in rows] == [[(1, 301)], [(0, 300)], []]
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs(spark, []), 400)


@pytest.mark.parametrize("text", [b"banana", b"aaaaaaaa", b"a\0a\0\0", bytes(random.Random(3).choices(b"ab", k=500)), b"x"])
def test_suffix_array_and_common_prefixes(text):
    x = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(x)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert np.array_equal(suffix_dedup.suffix_array(x.astype(np.int64), wide=True), order)
    got = suffix_dedup.common_prefixes(x, order, np.array([0, len(x) // 3, len(x)]), 7)
    for k in range(1, len(order)):
        a, b, n = text[order[k - 1] :], text[order[k] :], 0
        while n < min(len(a), len(b), 7) and a[n] == b[n]:
            n += 1
        assert got[k] == n
    assert got[0] == 0


def test_extra_columns_do_not_matter(spark):
    plain = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    rich = plain.select("doc_id", "text", F.lit(9).alias("component"), F.lit(1).alias("id"), F.lit("s").alias("sketch"), F.lit(2).alias("u"))
    for run in (exact_dedup.exact_dedup, minhash.near_dedup, suffix_dedup.suffix_dedup):
        assert sorted(map(tuple, run(plain).collect())) == sorted(map(tuple, run(rich).collect()))
