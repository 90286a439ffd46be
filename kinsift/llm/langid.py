"""Language identification as inference of a mixture.

*Fit.*  Byte 1- to 3-grams of lower-cased words, hashed to a fixed number of buckets, are counted per language over
labelled documents; smoothed logarithms make a table of buckets by languages.

*Infer.*  The units of a text are its words; the likelihood of a word in a language is the product over its n-grams.
Expectation-maximisation gives each document its proportions of the languages.  Nested sets of languages (the most
probable one, the two most probable, ...) are refitted, and the set with the best penalised likelihood
(BIC, words as observations) is the document's; its largest share is the prediction.

All texts are read whole, in batches of bounded size.

Defined results: a null text, or one without letters, gets ``und``, score 0 and an empty mixture; ties go to the
language that sorts first; with no labelled rows every text is ``und``; repeated ids are predicted once per row;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import slices
from kinsift.llm.shingles import text_buffer

BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in sorted order; ``table``: log probabilities, one row per bucket, one column per language."""

    languages: tuple[str, ...]
    table: np.ndarray


# bytes of a word: ASCII letters and everything beyond ASCII
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


class _Grams:
    """N-gram buckets of a batch: rows of ``bucket`` belong to words, words to texts."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(pc.utf8_lower(column.fill_null("")))
        n = len(data)
        letter = _LETTER[data]
        head = letter.copy()
        if n:
            head[1:] &= ~letter[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            head[inner] = letter[inner]
        start = np.flatnonzero(head)
        at = np.flatnonzero(letter)
        word = np.cumsum(head)[at] - 1
        self.words = len(start)
        self.first = np.searchsorted(start, offsets)
        c = data[at].astype(np.uint32)
        one_back = np.zeros_like(c)
        two_back = np.zeros_like(c)
        if len(c):
            same = word[1:] == word[:-1]
            one_back[1:] = np.where(same, c[:-1], 0)
            two_back[2:] = np.where(word[2:] == word[:-2], c[:-2], 0)
        three = ((two_back << 16) | (one_back << 8) | c) * np.uint32(0x9E3779B1)
        self.bucket = (three >> np.uint32(16)).astype(np.int64)
        self.word = word
        # where the n-grams of each word begin
        self.cuts = np.searchsorted(word, np.arange(self.words))


def _counts(languages: list[str]):
    where = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None  # partitions without a sampled row send nothing
        for batch in batches:
            for part in slices(batch, "text"):
                if total is None:
                    total = np.zeros(len(languages) * BUCKETS, np.int64)
                g = _Grams(part.column("text"))
                lang = np.array([where[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
                own = np.repeat(lang, np.diff(g.first))
                if len(g.word):
                    total += np.bincount(own[g.word] * BUCKETS + g.bucket, minlength=total.size)
        if total is not None:
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return run


def fit(docs: DataFrame, most_rows: int = 20_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows with a text and a language (columns text, lang, doc_id).

    About ``most_rows`` of them are used at most, chosen by a hash of doc_id: the documented bound of the sample.
    The table has one column per language and a fixed number of rows, whatever the corpus.
    """
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    per = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32))
    share = min(1.0, most_rows / sum(per.values()))
    bound = int(share * (1 << 40))
    sample = labelled.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language sample")), 24) <= bound).select("text", "lang")
    counted = sample.mapInArrow(_counts(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)  # one line for each cell of the table at most
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    counts += smoothing
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    return LanguageModel(tuple(languages), np.ascontiguousarray(table.T, dtype=np.float32))


def _em(like: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text and its log-likelihood (less the words' common factors).

    ``like``: words by languages, scaled likelihoods; ``first``: first word of each text (no text is empty).
    """
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    for _ in range(rounds):
        joint = like * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, first[:-1], axis=0) / count[:, None]
        moved = np.abs(new - share).max() if len(new) else 0
        share = new
        if moved < tolerance:
            break
    level = np.log((like * share[owner]).sum(axis=1) + 1e-300)
    return share, np.add.reduceat(level, first[:-1])


def mixture(column: pa.Array, model: LanguageModel, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts by languages) of the chosen language sets, and which texts have any word.

    ``most``: languages in a set at most.
    """
    size = len(column)
    out = np.zeros((size, len(model.languages)))
    g = _Grams(column)
    has = np.diff(g.first) > 0
    if not has.any() or not model.languages:
        return out, has
    first = np.concatenate((g.first[:-1][has], g.first[-1:]))
    log = np.add.reduceat(model.table[g.bucket], g.cuts, axis=0)
    top = log.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log - top, -60)).astype(np.float64)
    n = np.diff(first)
    k = like.shape[1]
    share, _ = _em(like, first, np.full((len(n), k), 1 / k))
    order = np.argsort(-share, axis=1, kind="stable")
    owner = np.repeat(np.arange(len(n)), n)
    best_score = np.full(len(n), np.inf)
    best = np.zeros_like(share)
    todo = np.arange(len(n))
    for m in range(1, min(most, k) + 1):
        if m > 1:
            todo = todo[share[todo, order[todo, m - 1]] * n[todo] > 0.5]  # another language must explain some word
        if not len(todo):
            break
        allowed = np.zeros((len(n), k))
        np.put_along_axis(allowed, order[:, :m], 1, axis=1)
        pick = np.isin(owner, todo) if len(todo) < len(n) else slice(None)
        cut = np.concatenate(([0], np.cumsum(n[todo])))
        start = np.maximum(share[todo], 1e-6) * allowed[todo]
        start /= start.sum(axis=1, keepdims=True)
        fitted, level = _em(like[pick], cut, start)
        score = -2 * level + (m - 1) * np.log(n[todo])
        better = score < best_score[todo] - 1e-9
        rows = todo[better]
        best_score[rows], best[rows] = score[better], fitted[better]
        todo = rows  # a set that does not pay is not enlarged further
    out[has] = best
    return out, has


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                share, has = mixture(text, model)
                letters = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                ok = has & letters & bool(model.languages)
                at = np.where(ok, share.argmax(axis=1) if model.languages else -1, -1)
                score = np.where(ok, share.max(axis=1) if model.languages else 0.0, 0.0)
                mixed = [[{"lang": names[j], "share": float(p[j])} for j in np.flatnonzero(p > 0.005)] if o else [] for p, o in zip(share, ok)]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[at], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixed, kind)], names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of every row; only doc_id and text are read."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of rows, a column per language
    return docs.mapInArrow(_predict(sent), f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
