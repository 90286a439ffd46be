"""N-grams, fingerprints and string functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinsift.functions import text


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("tokens", "n", "wanted"),
    [([], 3, []), (["a"], 3, ["a"]), (["a", "b"], 3, ["a b"]), (["a", "b", "c"], 3, ["a b c"]), (list("abcd"), 3, ["a b c", "b c d"]), (["a", "a", "a"], 2, ["a a", "a a"])],
)
def test_ngrams(spark, tokens, n, wanted):
    assert one(spark, "array<string>", tokens, lambda x: text.ngrams(x, n)) == wanted
    assert sorted(one(spark, "array<string>", tokens, lambda x: text.ngram_set(x, n))) == sorted(set(wanted))


@pytest.mark.parametrize(
    ("hashes", "wanted"), [([], []), (["b"], ["b"]), (list("dcba"), list("abcd")), (list("dcbae"), ["a"]), (list("abcde"), ["a", "b"]), (["a"] * 6, ["a"])]
)
def test_winnow(spark, hashes, wanted):
    assert sorted(one(spark, "array<string>", hashes, text.winnow)) == wanted


def test_fingerprints_are_hashes(spark):
    df = spark.createDataFrame([(list("abcdefghijkl"),)], "tokens array<string>")
    got = text.fingerprints(df).first().fingerprint
    every = [hashlib.md5(" ".join("abcdefghijkl"[i : i + 5]).encode()).hexdigest() for i in range(8)]
    assert set(got) == {min(every[i : i + 4]) for i in range(5)}


def test_strings(spark):
    assert one(spark, "string", "  a\tb \n", text.tokens) == ["a", "b"]
    assert one(spark, "string", "", text.tokens) == []
    assert one(spark, "array<string>", ["'a b'", "c"], text.resplit) == ["'a", "b'", "c"]
    assert one(spark, "string", "a  \n\n \t\n  b x\r\nc", text.normalize_whitespace) == "a\n  b x\nc"
    assert one(spark, "string", "12_x.py", text.leading_number) == 12
    assert one(spark, "string", "x12.py", text.leading_number) is None
    assert one(spark, "string", "<a b=\"c\">'&", text.escape_html) == "&lt;a b=&quot;c&quot;&gt;&#x27;&amp;"
    assert one(spark, "string", "naïve_1 += 23.x", text.code_terms) == ["naïve_1", "+", "=", "23", ".", "x"]
    with pytest.raises(Exception, match="no leading number"):
        one(spark, "string", "x.py", text.strict_number)


def test_fingerprint_sets_are_those_of_columns(spark):
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(["a b c d e f g h i j k l", "a b c d e f g h i j k l", " a\tb\x0bc\r\nd ", "é e f g h i\x1cj k l m n o", "", None, "a a a a a a a a a a a", "a b c d e"])]
    df = spark.createDataFrame(rows, "doc long, source string, text string")
    made = df.select("doc", "source", F.col("text").cast("binary")).mapInArrow(text.fingerprint_sets, "doc long, items array<long>, marked array<long>")
    want = text.fingerprints(df.withColumn("tokens", text.tokens(F.coalesce("text", F.lit("")))), hashes=True)
    pair = lambda df, *c: {r.doc: [set(x or []) for x in (r[c[0]], r[c[1]])] for r in df.collect()}
    got, want = pair(made, "items", "marked"), pair(want, "hashes", "fingerprint")
    for doc, sets in want.items():
        turned = int(hashlib.md5(f"s{doc % 2}".encode()).hexdigest()[:16], 16)
        assert [{int(h[:16], 16) ^ turned for h in x} for x in sets] == [{g % 2**64 for g in x} for x in got[doc]]
    assert len(got[0][0]) == 8 and not (got[0][0] & got[1][0]) and not got[4][0] and len(got[7][0]) == 1
