"""Language ID, personal data, quality and HTML."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsift.llm import html_extract, langid, pii, quality

EN, DE = "the and that with from this there which would about", "der und die nicht mit auch eine werden schon über"


def sentence(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary.split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, (EN, DE)[i % 2], 40), ("en", "de")[i % 2], 7, 8) for i in range(60)] + [(90, None, "en", 1, 2), (91, "x y", None, 1, 2)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, mixture int"))


def test_languages(spark, model):
    rng = random.Random(2)
    half = sentence(rng, EN, 60) + ". " + sentence(rng, DE, 20)
    rows = [(1, sentence(rng, EN, 9).upper()), (2, sentence(rng, DE, 9)), (3, None), (4, ""), (5, "12 34 !!"), (6, half), (7, " ".join([sentence(rng, EN, 1000)] * 60)), (7, "die")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lang_pred int")
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(df, model).collect()}
    assert set(got) == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "en"), (7, "de")}
    mixed = got[(6, "en")]
    assert abs(mixed.score - 0.75) < 0.06 and {m.lang for m in mixed.mixture} == {"en", "de"}
    assert got[(1, "en")].score == 1.0 and got[(3, "und")].score == 0.0 and got[(3, "und")].mixture == []
    assert len(got[(2, "de")].mixture) == 1  # one language pays, a second does not


def brute_em(like, share):
    for _ in range(200):
        joint = like * share
        share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, np.log((like * share).sum(axis=1)).sum()


def brute_mixture(text, model, most=4):
    """Proportions of one text from the definition: word by word, n-gram by n-gram, set by set."""
    k, like = len(model.languages), []
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()):
        log = np.zeros(k)
        for i, c in enumerate(w):
            three = ((w[i - 2] if i > 1 else 0) << 16) | ((w[i - 1] if i else 0) << 8) | c
            log += model.table[(three * 0x9E3779B1 & 0xFFFFFFFF) >> 16]
        like.append(np.exp(np.maximum(log - log.max(), -60)))
    like = np.array(like)
    share, _ = brute_em(like, np.full(k, 1 / k))
    order = sorted(range(k), key=lambda j: (-share[j], j))
    best, score = None, np.inf
    for m in range(1, min(most, k) + 1):
        if m > 1 and share[order[m - 1]] * len(like) <= 0.5:
            break
        start = np.zeros(k)
        start[order[:m]] = np.maximum(share[order[:m]], 1e-6)
        fitted, level = brute_em(like, start / start.sum())
        if -2 * level + (m - 1) * np.log(len(like)) >= score - 1e-9:
            break
        best, score = fitted, -2 * level + (m - 1) * np.log(len(like))
    return best


def test_mixtures_against_the_definition(spark, model):
    rng = random.Random(5)
    texts = [sentence(rng, EN, a) + " " + sentence(rng, DE, b) for a, b in ((30, 0), (0, 30), (20, 20), (40, 10), (5, 60), (1, 0), (0, 2), (300, 200))]
    texts = [t.strip() for t in texts] + ["Über 12 the-und!", "x" * 3000]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        wanted = brute_mixture(texts[r.doc_id], model)
        shares = {x.lang: x.share for x in r.mixture}
        assert np.allclose([shares.get(x, 0) for x in model.languages], wanted, atol=0.02), texts[r.doc_id][:40]
        assert r.lang_pred == model.languages[int(np.argmax(wanted))] and abs(r.score - wanted.max()) < 0.02


def test_language_ties_and_nothing(spark, model):
    same = spark.createDataFrame([(i, "the same words here", ("bb", "aa")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    tied = langid.fit(same)
    docs = spark.createDataFrame([(1, "the same"), (1, "the same")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(docs, tied).collect()] == ["aa", "aa"]
    assert langid.identify(docs.filter("false"), model).count() == 0


def test_em_follows_the_likelihood():
    rng = np.random.default_rng(0)
    like = rng.random((200, 3)) + 0.01
    first = np.array([0, 120, 200])
    share, level = langid._em(like, first, np.full((2, 3), 1 / 3), 500, 1e-9)
    for k in range(2):
        own = like[first[k] : first[k + 1]]
        for _ in range(300):  # no other proportions do better
            other = rng.dirichlet(np.ones(3))
            assert np.log(own @ other).sum() <= level[k] + 1e-6
    assert np.allclose(share.sum(axis=1), 1)


def test_language_without_labels(spark):
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), empty).first().lang_pred == "und"


PII = [
    ("card 4041894974608795.", "card"), ("4041-8949-7460-8795", "card"), ("4041894974608796", None), ("+1 (988) 555-2485", "phone"), ("988-555-2485", "phone"), ("+49 30 1234567", "phone"),
    ("123-45-6789", "ssn"), ("666-12-3456", None), ("000-12-3456", None), ("2024-02-29", "date"), ("2023-02-29", None), ("29.02.2024", "date"), ("02/29/2024", "date"), ("31/12/1999", "date"), ("1700-01-01", None),
    ("44.161.181.40", "ip"), ("300.1.1.1", None), ("1.2.3.4.5", None), ("a.b+c@mail.example.com", "email"), ("DE89370400440532013000", "iban"), ("DE88370400440532013000", None), ("version 3.0 of 2024", None), ("x4041894974608795", None),
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def test_formats(spark):
    df = spark.createDataFrame([(i, f"see {t} now", 1, 2) for i, (t, _) in enumerate(PII)], "doc_id long, text string, _f int, kinds int")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    for i, (t, kind) in enumerate(PII):
        kinds = [x.kind for x in rows[i].pii]
        assert kinds == ([kind] if kind else []), t
        if not kind:
            assert rows[i].text == f"see {t} now"
            continue
        new = rows[i].pii[0].pseudonym
        assert rows[i].text == "see " + (t.replace(re.search(r"[\d+].*\d|\S+@\S+", t)[0], new) if kind == "card" else new) + " now"
        if kind not in ("email", "iban"):
            assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", t if kind != "card" else new) or kind == "ip"
        if kind == "card":
            assert luhn(new) and new[0] == "4"
        if kind == "iban":
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        if kind == "ip":
            assert all(int(x) < 256 for x in new.split("."))


def test_links_and_keys(spark):
    df = spark.createDataFrame([(1, "4041894974608795 and 4041 8949 7460 8795"), (2, "x 4041894974608795"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    a = {r.doc_id: r for r in pii.pseudonymise(df, "one").collect()}
    b = {r.doc_id: r for r in pii.pseudonymise(df, "two").collect()}
    first, second = (x.pseudonym for x in a[1].pii)
    assert first == second.replace(" ", "") == a[2].pii[0].pseudonym != b[2].pii[0].pseudonym
    assert a[3].text is None and a[3].pii == [] and a[4].text == ""
    assert pii.pseudonymise(df.filter("false"), "one").count() == 0


@pytest.mark.parametrize(("a", "b"), [(7, 11), (1, 5), (10, 10), (189, 3)])
def test_feistel_is_a_permutation(spark, a, b):
    grid = spark.range(a * b).select(F.floor(F.col("id") / b).alias("l"), (F.col("id") % b).alias("r"))
    out = grid.select(pii.feistel("k", "t", F.col("l"), F.col("r"), F.lit(a), F.lit(b), F.lit("")).alias("x")).select("x.l", "x.r").collect()
    assert {tuple(r) for r in out} == {(i, j) for i in range(a) for j in range(b)}


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice(["", "s", "d", "ing"]) for _ in range(rng.randrange(20, 200))) + "." for _ in range(150)]
    bad = ["SPAM!! " * rng.randrange(5, 60) if rng.random() < 0.5 else "ab$$$ x### " * rng.randrange(5, 60) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate([None, "", *good, *bad, "w " * 90_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(i, int(i < 152)) for i in range(2, 212) if i % 3] + [(5, None), (6, 7), (7, 1)], "doc_id long, y int")
    measured = quality.measured_table(docs)
    model = quality.fit(measured, labels)
    got = {r.doc_id: r.score for r in quality.score(measured, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == (i < 152) for i in range(2, 212) if i % 3 == 0]
    assert np.mean(right) > 0.95
    one_class = quality.fit(measured, labels.filter("y = 1"))
    assert one_class.constant == 1.0 and quality.fit(measured, labels.filter("false")).constant == 0.5


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(3)
    means, covs = rng.random((2, 4)), [np.diag(rng.random(4) + 0.5) + 0.1 for _ in range(2)]
    inverse = np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in covs])
    m = quality.Discriminant(means, inverse, np.array([np.linalg.slogdet(c)[1] for c in covs]), 0.3)
    x = rng.random((20, 4))
    dens = [-0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu) - 0.5 * np.linalg.slogdet(c)[1] for mu, c in zip(means, covs)]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(dens[1] - dens[0] + 0.3))))


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array(["", "a", "\n\n", "a a a a\na a a a", "ÄÖ 12", "!" * 50]))
    assert x.shape == (6, len(quality.STATISTICS)) and np.isfinite(x).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>m</ul></nav>
<div class="cookie-notice">C</div><article><h1>Big  &amp; small</h1><p><b>One<br>two<p>Three &lt;x&gt; <i>f</i>our</p><script>if (a<b) "</p>"</script>
<aside>S</aside><form>F</form><section id="readerComments"><p>no</p></section><ul><li>a<li>b</ul><!-- <p>c</p> --></article><footer>&copy;</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (PAGE, "Big & small\nOne two\nThree <x> four\na\nb"), (None, ""), ("", ""), ("<article></article>", ""), ("plain <3 text", "plain <3 text"), ("<main><p title='a>b'>x</main>y", "x"),
        ("<article>a</p>b<div>c<span>d</article>", "ab\ncd"), ("<p>a<table><tr><td>b<td>c</table>", "a\nb\nc"), ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
        ("<article>a &amp;amp; b&nbsp;c&#33;</article>", "a &amp; b\xa0c!"), ("<p hidden>a</p><p style='display: none'>b</p><p role=navigation>c</p><p>d</p>", "d"), ("<article>a<!-- open", "a"), ("<article>x<script>y", "x"),
    ],
)
def test_pages(spark, page, wanted):
    df = spark.createDataFrame([(1, "http://a.com/x", page, "t", 3)], "page_id long, url string, html string, text string, ref int")
    row = html_extract.extract(df).first()
    assert row.text == wanted and row.n_chars == len(wanted)


@pytest.mark.parametrize(
    ("inner", "wanted"),
    [
        ("<p title='a hidden gem'>x</p>", "x"), ("<p data-id='comment-1'>x</p>", "x"), ("<p data-class='ad'>x</p>", "x"), ("<h2 id='discussion'>x</h2>", "x"), ("<section id='social'><p>x</p></section>", "x"),
        ("<p class='related-work'>x</p>", "x"), ("<div class='ad-free'>x</div>", "x"), ("<p title='class=ad hidden'>x</p>", "x"), ("<h3 id='comments'>x</h3>", "x"), ("<p data-x=\"role='search'\">x</p>", "x"),
        ("<p>x<span class='ad'>y</span>z</p>", "xz"), ("x<div class='ad'>y</div>", "x"), ("x<div id='comment-1'>y</div>", "x"), ("x<div class='card sidebar-left'>y</div>", "x"), ("x<p class=ad>y</p>", "x"), ("x<div hidden>y</div>", "x"),
        ("x<div ARIA-HIDDEN=true>y</div>", "x"), ("x<p role='Navigation'>y</p>", "x"),
    ],
)
def test_attributes(inner, wanted):
    found = html_extract.blocks(f"<body><article>{inner}</article></body>")
    assert "".join(t for zone, t in found if zone in (html_extract.CORE, html_extract.HINTED)) == wanted


def test_open_text_beside_a_teaser(spark):
    page = "<div><h1>A title</h1><p>the long text of this page</p></div><article>one teaser</article><div class='ad'>buy</div>"
    rows = [(1, "http://a.com/1", page), (2, "http://a.com/2", "<div>menu of the site</div><article>an article that is longer</article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A title\nthe long text of this page\none teaser", 2: "an article that is longer"}


def random_pages(rng, n):
    """Pages of three hosts from few words, with shared lines, copies, and blocks of every zone."""
    lines = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12)))
            parts.append(rng.choice(["<p>{}</p>", "<nav>{}</nav>", "<div class=related>{}</div>", "<article><p>{}</p></article>", "<article><div class=related>{}</div>{}</article>"]).format(line, rng.choice(lines)))
        out.append((i, rng.choice(["http://a.com/1", "http://www.b.org", None]), "".join(parts)))
    return out + out[: n // 5] + [(n, "http://a.com/2", None), (n + 1, "http://a.com/2", "")]


def brute_pages(rows, least):
    """Texts and covered tokens straight from the rule: strings on two distinct pages of a host."""
    streams = []
    for _, url, page in rows:
        found = html_extract.blocks(page or "")
        words, cut = [], []
        for k, (zone, t) in enumerate(found):
            if zone != "c":
                fresh = not words or found[k - 1][0] == "c"
                for w in t.split(" "):
                    cut.append(fresh)
                    words.append((k, w))
                    fresh = False
        streams.append((html_extract.host(url), tuple(t for zone, t in found if zone != "m"), found, words, cut))
    seen = {}
    for h, page, _, words, cut in streams:
        for s in range(len(words) - least + 1):
            if not any(cut[s + 1 : s + least]):
                seen.setdefault((h, tuple(w for _, w in words[s : s + least])), set()).add(page)
    out = []
    for h, _, found, words, cut in streams:
        gone = set()
        for s in range(len(words) - least + 1):
            if not any(cut[s + 1 : s + least]) and len(seen[(h, tuple(w for _, w in words[s : s + least]))]) > 1:
                gone.update(range(s, s + least))
        left = {}
        for i, (k, w) in enumerate(words):
            if i not in gone:
                left.setdefault(k, []).append(w)
        inside = sum(len(t.split(" ")) if z == "c" else len(left.get(k, ())) * (z == "h") for k, (z, t) in enumerate(found))
        open_ = sum(len(left.get(k, ())) for k, (z, _) in enumerate(found) if z == "o")
        lines = [t if z == "c" else " ".join(left.get(k, ())) if z == "h" or z == "o" and open_ > inside else "" for k, (z, t) in enumerate(found)]
        out.append(("\n".join(x for x in lines if x), len(gone)))
    return out


@pytest.mark.parametrize("shard_tokens", [40, 1_000_000])
def test_repeated_strings_against_brute_force(spark, shard_tokens):
    rows = random_pages(random.Random(3), 120)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars, r.n_repeated) for r in html_extract.extract(df, least=5, shard_tokens=shard_tokens).collect())
    wanted = sorted((i, t, len(t), k) for (i, _, _), (t, k) in zip(rows, brute_pages(rows, 5)))
    assert got == wanted and sum(x[3] for x in got) > 100


@pytest.mark.parametrize("shard_tokens", [20, 1_000_000])
def test_repeated_text_of_a_host_goes(spark, shard_tokens):
    line = "<div>welcome to the site where every page has this same long line of text at its top</div>"
    rows = [(i, f"http://www.a.com/{i}", f"{line}<p>own {i} a{i} b{i}</p>") for i in range(7)] + [(20, "http://b.com/", line), (21, None, line), (22, None, line), (23, "http://a.com/", f"<article>{line}</article>")]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, least=8, shard_tokens=shard_tokens).collect()}
    assert all(got[i].endswith(f"{i} a{i} b{i}") and "site" not in got[i] for i in range(7))
    assert "site" in got[20] and "site" in got[23]
    assert "site" in got[21] and "site" in got[22]  # the same text twice is one page
    assert html_extract.extract(df.filter("false")).count() == 0
