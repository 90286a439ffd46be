"""Main text of web pages from host suffix arrays and structure.

*Blocks.*  Markup gives the blocks of rendered text and the zone of each: *marked* (inside menus, headers, footers,
sidebars, forms, dialogs, or elements whose role or whole class or id names such a thing, an advert or reader comments),
*core* (inside an ``article`` or ``main`` element), *hinted* (core, inside a section with a doubtful name such as
``related`` or ``social``), or *open* (all else).  A name never makes the element around a page's outermost core marked.

*Repetition.*  For each host the token streams of all its pages, marked, hinted and open text, are concatenated; a
suffix array over them (Larsson-Sadakane refinement) brings equal strings together.  A string of ``least`` tokens that
stands on two distinct pages of the host is boilerplate; pages with the same unmarked text are not distinct, since one
article under several addresses is no boilerplate.  Streams do not run across core text.  Hosts with more than
``shard_tokens`` tokens are dealt to several shards, which send one line for each string to its owner, so results do
not depend on the dealing and no host meets in one task.

*Text.*  Covered tokens go; unique runs of hinted blocks stay.  Unique runs of open blocks stay on pages without core
text and on pages where they are more than the core text (a teaser in an ``article`` beside the real text).  Marked
text goes even where it is unique: menus and adverts differ from page to page.  Core text stays even where it is
repeated: articles, their passages and license lines stand on several pages and are content on each of them.  With
``structure=False`` repetition alone decides about all rendered text; the README has figures of both.

Character references are decoded once, runs of white space (0x20, 0x09-0x0D) become one space, blocks are trimmed and
joined by newlines; line breaks and inline elements do not end a block.

Defined results: null and empty html give an empty text; broken markup is read as far as it goes (an unclosed element
reaches to the end of its parent, a stray end tag is ignored); repeated rows are one page to repetition and a row each
in the result; null urls share one host; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import TEXT_ROWS, left_join_groups, release, slices, trim
from kinsift.llm.suffix_dedup import suffix_array
from kinsift.sources.scratch import keep_ids, materialise

#: Tokens that one shard of a host gets on average.
SHARD_TOKENS = 1_000_000

CORE, HINTED, OPEN, MARKED = "chom"

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("audio canvas datalist head map noscript object script style svg template title video".split())
AROUND = frozenset("aside button dialog footer form header menu nav search select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
#: Words that make a class or id a name of something other than content, and words that may stand beside them.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot advertorial breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr masthead nav navbar navigation newsletter paywall replies sidebar sponsor sponsored subscribe".split())
BESIDE = frozenset("area aside banner bar bottom box button container content dialog fixed footer form global header inner item left list main menu message mobile modal notice outer overlay page popup primary reader right secondary section site slot sticky thread top user widget wrap wrapper".split())
#: Words of names that only repetition confirms.
DOUBTFUL = frozenset("banner discussion header menu modal notice notices notification overlay pager pagination popup promo promotion promoted recommended related reply share sharing social subscription toolbar widget widgets".split())
#: Elements whose names count; paragraphs and headings get theirs from what they say.
SECTIONS = frozenset("center dd details dir div dl fieldset li ol section table td ul".split())
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 html body article main".split())
P_ENDERS = BLOCK - {"body", "html", "head"}

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*>)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
# a whole attribute at a time, so nothing is read inside another's name or value
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[\x20\x09-\x0d]+")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(value: str) -> tuple[bool, bool]:
    """Whether some name in a class or id stands for boilerplate, and whether some is doubtful."""
    sure = doubt = False
    for one in value.split():
        words = _NAME.findall(_CAMEL.sub(" ", one).lower())
        sure |= not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words)
        doubt |= not DOUBTFUL.isdisjoint(words)
    return sure, doubt


def _meaning(tag: str, attributes: str) -> str:
    """What an element does to the text in it: ``unseen``, ``marked``, ``named`` (marked by name), ``hinted`` or nothing."""
    if tag in UNSEEN:
        return "unseen"
    found = "marked" if tag in AROUND else ""
    if not attributes or attributes == "/":
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "unseen"
        if name == "role" and value.lower() in ROLES and tag not in TEXTS:
            found = "marked"
        elif name in ("class", "id") and found != "marked" and tag not in TEXTS:
            sure, doubt = _named(value)
            if sure and (name == "class" or tag in SECTIONS):
                found = "named"
            elif doubt and tag in SECTIONS and not found:
                found = "hinted"
    return found


def blocks(page: str, structure: bool = True) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of rendered text, in page order; without ``structure`` all are open."""
    found, wrappers = _blocks(page, frozenset())
    if wrappers:
        found, _ = _blocks(page, wrappers)
    return found if structure else [(OPEN, t) for _, t in found]


def _blocks(page: str, spared: frozenset[int] | set[int]) -> tuple[list[tuple[str, str]], set[int]]:
    """See :func:`blocks`; also the places of elements that are marked by name and hold an outermost core element.

    Names of elements at the places ``spared`` do not count.
    """
    out: list[tuple[str, str]] = []
    text: list[str] = []
    aside: list[str] = []  # marked text of inline elements
    # open elements: (tag, unseen, marked, hinted and core levels after it, its place if it is marked by name or -1)
    stack: list[tuple[str, int, int, int, int, int]] = []
    wrappers: set[int] = set()
    unseen = marked = hinted = core = 0
    at, n = 0, len(page)

    def put(pieces: list[str], zone: str) -> None:
        joined = "".join(pieces)
        pieces.clear()
        joined = _SPACE.sub(" ", html.unescape(joined) if "&" in joined else joined).strip(" ")
        if joined:
            out.append((zone, joined))

    def end_block() -> None:
        if text:
            put(text, MARKED if marked else (HINTED if hinted else CORE) if core else OPEN)
        if aside:
            put(aside, MARKED)

    def close(k: int) -> None:
        nonlocal unseen, marked, hinted, core
        del stack[k:]
        unseen, marked, hinted, core = stack[-1][1:5] if stack else (0, 0, 0, 0)

    def say(piece: str) -> None:
        if not unseen:
            (aside if marked and stack[-1][0] not in BLOCK and text else text).append(piece)

    while at < n:
        here = page.find("<", at)
        if here < 0:
            here = n
        if here > at:
            say(page[at:here])
        if here == n:
            break
        m = _TAG.match(page, here) or _LOOSE.match(page, here)
        if m is None:  # not a tag
            say("<")
            at = here + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK:
                        end_block()
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:  # an inline end tag does not reach out of its block
                    break
            continue
        if tag in P_ENDERS:
            end_block()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        elif tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "li" or tag in ("dd", "dt", "td", "th", "tr", "option"):  # a sibling ends its open predecessor
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "menu", "dl", "table", "select", "article", "main", "nav", "div"):
                    break
        if not m[3].endswith("/") or tag in BLOCK:
            meaning = _meaning(tag, m[3])
            by_name = meaning == "named" and here not in spared
            unseen += meaning == "unseen"
            marked += meaning == "marked" or by_name
            hinted += meaning == "hinted"
            if tag == "article" or tag == "main":
                if marked and all(x[0] not in ("article", "main") for x in stack):
                    wrappers.update(x[5] for x in stack if x[5] >= 0)
                core += not marked and not unseen
                if core == 1:
                    hinted = 0  # names around the core say nothing about it
            stack.append((tag, unseen, marked, hinted, core, here if by_name else -1))
    end_block()
    return out, wrappers


def host(url: str | None) -> str:
    """Host of a url without ``www.``; empty where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


_PARSED = "host string, page binary, stream binary, tokens long, zones string, core binary, rest string"


def _pack(text: str) -> bytes:
    """Core text compressed, after its size: it is only carried along."""
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes) -> str:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode() if packed else ""


def _parse(structure: bool):
    """Blocks of each page: ``zones`` has a letter for each, ``core`` (compressed) and ``rest`` hold their texts, a line for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out: list[list] = [[] for _ in range(7)]
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    found = blocks(page, structure) if page else []
                    zones = "".join(z for z, _ in found)
                    core, rest = "\n".join(t for z, t in found if z == CORE), "\n".join(t for z, t in found if z != CORE)
                    own = "\n".join(t for z, t in found if z != MARKED)
                    row = (host(url), xxhash.xxh3_128_digest(own), xxhash.xxh3_128_digest(zones + "\n" + rest), len(rest.split(" ")) + rest.count("\n") if rest else 0, zones, _pack(core), rest)
                    for column, x in zip(out, row):
                        column.append(x)
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["page_id", "url", "host", "page", "stream", "tokens", "zones", "core", "rest"])

    return run


def segments(zones: str, rest: str) -> list[list[str]]:
    """Words of a stream, cut where core text stands between."""
    lines = iter(rest.split("\n"))
    return [[w for _ in run for w in next(lines).split(" ")] for is_core, run in groupby(zones, CORE.__eq__) if not is_core]


def _streams(table: pa.Table) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Segments of all streams, and for each its stream and its page."""
    _, page = np.unique(np.array(table.column("page").to_pylist(), dtype=object), return_inverse=True)
    out: list[list[str]] = []
    owner: list[int] = []
    for i, (zones, rest) in enumerate(zip(table.column("zones").to_pylist(), table.column("rest").to_pylist())):
        found = segments(zones, rest)
        out += found
        owner += [i] * len(found)
    at = np.array(owner, dtype=np.int64)
    return out, at, page[at]


def _window_starts(size: np.ndarray, least: int) -> np.ndarray:
    """Places of the tokens that begin a string of ``least`` tokens inside their segment."""
    stop = np.cumsum(size)
    place = np.arange(int(stop[-1]) if len(stop) else 0)
    return place[place + least <= np.repeat(stop, size)]


def repeated(found: list[list[str]], page: np.ndarray, least: int) -> np.ndarray:
    """Starts of the strings that stand on two pages: neighbours in the suffix array with a common prefix of ``least``."""
    number: dict[str, int] = {}
    text = np.array([number.setdefault(w, len(number)) for s in found for w in s], dtype=np.int64)
    size = np.array([len(s) for s in found], dtype=np.int64)
    start = _window_starts(size, least)
    if not len(start):
        return start
    n = len(text)
    order = suffix_array(text, wide=True, enough=least)
    same = np.ones(n - 1, bool)
    for k in range(least):
        a, b = order[1:] + k, order[:-1] + k
        same &= (a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
    group = np.empty(n, np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~same)))
    own = np.repeat(page, size)[start]
    low, high = np.full(n, len(page) + 1), np.full(n, -1)
    np.minimum.at(low, group[start], own)
    np.maximum.at(high, group[start], own)
    return start[low[group[start]] < high[group[start]]]


def _lists(table: pa.Table, found: list[list[str]], owner: np.ndarray, start: np.ndarray) -> pa.Table:
    """Starts by stream, as places among its own tokens."""
    token = np.repeat(owner, [len(s) for s in found])
    base = np.searchsorted(token, np.arange(table.num_rows))
    per = np.bincount(token[start], minlength=table.num_rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array((start - base[token[start]]).astype(np.int32)))
    return pa.table({**{c: table.column(c) for c in ("host", "page", "stream", "copies")}, "starts": lists})


_FOUND = "host string, page binary, stream binary, copies long, starts array<int>"


def _shard(least: int):
    """Repeated strings of a host that is one shard."""

    def run(table: pa.Table) -> pa.Table:
        release()
        found, owner, page = _streams(table)
        out = _lists(table, found, owner, repeated(found, page, least))
        trim()
        return out

    return run


def _digests(found: list[list[str]], start: np.ndarray, least: int) -> np.ndarray:
    """128-bit digests of strings, as pairs of long."""
    words = [w for s in found for w in s]
    raw = b"".join(xxhash.xxh3_128_digest(" ".join(words[s : s + least])) for s in start.tolist())
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _strings(least: int):
    """One line for each string of a shard: (host, shard, a, b, low, high), the last its least and greatest page."""

    def run(table: pa.Table) -> pa.Table:
        release()
        found, _, page = _streams(table)
        size = np.array([len(s) for s in found], dtype=np.int64)
        start = _window_starts(size, least)
        digest, back = np.unique(_digests(found, start, least), axis=0, return_inverse=True)
        names = np.array(sorted(set(table.column("page").to_pylist())), dtype=object)
        own = np.repeat(page, size)[start]
        low, high = np.full(len(digest), len(names)), np.full(len(digest), -1)
        np.minimum.at(low, back.ravel(), own)
        np.maximum.at(high, back.ravel(), own)
        n = len(digest)
        columns = {"host": pa.array([table.column("host")[0].as_py()] * n, pa.string()), "shard": pa.array(np.full(n, table.column("shard")[0].as_py()), pa.int32()), "a": pa.array(digest[:, 0]), "b": pa.array(digest[:, 1]), "low": pa.array(names[low].tolist(), pa.binary()), "high": pa.array(names[high].tolist(), pa.binary())}
        trim()
        return pa.table(columns)

    return run


def _apply(least: int):
    """Starts of a shard's strings that owners have found on two pages of the host."""

    def run(table: pa.Table, hits: pa.Table) -> pa.Table:
        release()
        if not table.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("host", pa.string()), ("page", pa.binary()), ("stream", pa.binary()), ("copies", pa.int64()), ("starts", pa.list_(pa.int32())))})
        found, owner, _ = _streams(table)
        start = _window_starts(np.array([len(s) for s in found], dtype=np.int64), least)
        digest = _digests(found, start, least)
        pair = np.dtype([("a", "<i8"), ("b", "<i8")])
        known = np.empty(hits.num_rows, pair)
        known["a"], known["b"] = hits.column("a").to_numpy(), hits.column("b").to_numpy()
        out = _lists(table, found, owner, start[np.isin(np.ascontiguousarray(digest).view(pair).ravel(), known)])
        trim()
        return out

    return run


def assemble(zones: str, core: str, rest: str, starts: list[int] | None, least: int) -> tuple[str, int]:
    """Text of a page and its covered tokens, from its blocks and the starts of repeated strings in its stream."""
    lines = rest.split("\n") if rest else []
    words = [x.split(" ") for x in lines]
    cover = np.zeros(sum(map(len, words)) + 1, np.int64)
    if starts:
        at = np.asarray(starts)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + least, -1)
    gone = np.cumsum(cover)[:-1] > 0
    free, inside = [], core.count(" ") + core.count("\n") + bool(core)
    at = open_ = 0
    others = [z for z in zones if z != CORE]
    for zone, line, w in zip(others, lines, words):
        mask = gone[at : at + len(w)]
        at += len(w)
        left = "" if zone == MARKED else line if not mask.any() else " ".join(x for x, g in zip(w, mask) if not g)
        free.append(left)
        size = len(left.split(" ")) if left else 0
        if zone == OPEN:
            open_ += size
        else:
            inside += size
    with_open = open_ > inside
    first, second = iter(core.split("\n")), zip(others, free)
    kept = []
    for zone in zones:
        if zone == CORE:
            kept.append(next(first))
            continue
        zone, left = next(second)
        if left and (zone == HINTED or with_open):
            kept.append(left)
    return "\n".join(kept), int(gone.sum())


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("zones", "core", "rest", "starts")]
            done = [assemble(z, _unpack(c), r, s, least) for z, c, r, s in zip(*columns)]
            texts, counts = pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts, counts], names=["page_id", "url", "text", "n_repeated"])

    return run


def extract(pages: DataFrame, least: int = 12, shard_tokens: int = SHARD_TOKENS, structure: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated), one row per row of ``pages`` (page_id, url, html).

    ``least``: tokens of a string that counts as repeated.  ``n_repeated``: tokens outside core text that repeated
    strings cover.  ``structure``: see the module.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    key = ["host", "page", "stream"]
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = pages.mapInArrow(_parse(structure), f"page_id {kinds['page_id']}, url string, {_PARSED}")

    # each stream once, however many rows have it; core text is not written, pages are parsed again for it
    seen = materialise(parsed.select(*key, "tokens", "zones", "rest"), "html-streams", TEXT_ROWS)
    streams = seen.filter("tokens > 0").groupBy(*key, "zones", "rest").agg(F.count("*").alias("copies"))
    large = seen.groupBy("host").agg(F.sum("tokens").alias("n")).filter(F.col("n") > shard_tokens)
    large = materialise(large.select("host", F.ceil(F.col("n") / shard_tokens).cast("int").alias("shards")), "html-large")
    whole = keep_ids(streams, large, "host", "left_anti").groupBy("host").applyInArrow(_shard(least), _FOUND)
    dealt = keep_ids(streams, large, "host", "left_semi").join(large, "host").withColumn("shard", F.pmod(F.xxhash64("page", "stream"), F.col("shards")).cast("int")).drop("shards")
    if large.count():
        dealt = materialise(dealt, "html-dealt", TEXT_ROWS)
        lines = materialise(dealt.groupBy("host", "shard").applyInArrow(_strings(least), "host string, shard int, a long, b long, low binary, high binary"), "html-strings")
        twice = lines.groupBy("host", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("host", "a", "b")
        hits = lines.join(twice, ["host", "a", "b"], "left_semi").select("host", "shard", "a", "b")
        whole = whole.unionByName(dealt.groupBy("host", "shard").cogroup(hits.groupBy("host", "shard")).applyInArrow(_apply(least), _FOUND))
    found = materialise(whole, "html-found", TEXT_ROWS)

    rows = left_join_groups(parsed, found, key, ["starts"], "copies", seen.count(), F.col("tokens") > 0).select("page_id", "url", "zones", "core", "rest", "starts")
    done = rows.mapInArrow(_texts(least), f"page_id {kinds['page_id']}, url string, text string, n_repeated long")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
