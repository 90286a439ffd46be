"""Quality scores by regularised quadratic discriminant analysis of document statistics.

*Statistics.*  A fixed vector of transformed figures per text (length, word shapes, repetition of words and lines,
character classes), from one pass over whole texts in batches of bounded size.

*Fit.*  Class means and covariances come from moments that partitions add up over all labelled rows.  Covariances are
shrunk twice: towards the pooled covariance and towards its scaled diagonal, which keeps every class's matrix well
conditioned however few rows it has.  Cholesky factors are computed once and sent to the workers.

*Score.*  The difference of the two Mahalanobis log densities plus the log prior, through a logistic function.

Defined results: a null or empty text is scored from its (zero) statistics; labels that are null or neither 0 nor 1 are
ignored; a document labelled on several rows counts once per row; with one class only, or no labels, every score is the
share of label 1 (0.5 without labels); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import TEXT_ROWS, slices
from kinsift.llm.shingles import Words, mix64, text_buffer
from kinsift.sources.scratch import materialise

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "stop_marks", "symbols", "beyond_ascii",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "words_per_line", "marked_words", "capital_words",
    "no_vowel_words", "entropy",
)

_CLASS = np.zeros(256, np.int64)  # 0: lower-case letters and the rest
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() and _i < 128 else 3 if _c in " \t\n\v\f\r" else 4 if _c in ".,;:?'\"()-" else 6 if _i >= 128 else 5 if 32 < _i < 127 and not _c.isalpha() else 0
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_VOWEL[128:] = True


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the cuts; empty stretches give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _repetition(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each text, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(codes):
        order = np.lexsort((codes, owner))
        o, c = owner[order], codes[order]
        at = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1]))))
        count = np.diff(np.append(at, len(o)))
        np.add.at(distinct, o[at], 1)
        np.maximum.at(top, o[at], count)
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(text * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8) / size[:, None]
    words = Words(data, offsets, lower=True)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(np.float64)
    mean = _per_text(length, words.first) / some
    spread = np.sqrt(np.maximum(_per_text(length**2, words.first) / some - mean**2, 0))
    owner = np.repeat(np.arange(n), count)
    distinct, top = _repetition(words.hash, owner, n)
    with np.errstate(over="ignore"):
        pairs = mix64(words.hash[:-1] * np.uint64(3) + words.hash[1:]) if len(words.hash) else words.hash
    together = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    distinct_pairs, _ = _repetition(pairs[together], owner[:-1][together] if len(owner) else owner, n)
    # lines: order-dependent sums of word hashes between newlines
    newline = np.concatenate(([0], np.cumsum(data == 10)))
    line = newline[words.start] if len(words.start) else words.start
    fresh = np.concatenate(([True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))) if len(line) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    with np.errstate(over="ignore"):
        step = np.arange(len(owner)) - begin[np.cumsum(fresh) - 1] if len(begin) else np.zeros(0, np.int64)
        line_hash = np.add.reduceat(words.hash * (mix64(step.astype(np.uint64)) | np.uint64(1)), begin) if len(begin) else np.zeros(0, np.uint64)
    line_owner = owner[begin]
    lines = np.bincount(line_owner, minlength=n)
    distinct_lines, _ = _repetition(line_hash, line_owner, n)
    mark = np.concatenate(([0], np.cumsum((_CLASS[data] == 5) | (data == 33))))
    vowel = np.concatenate(([0], np.cumsum(_VOWEL[data])))
    capital = np.concatenate(([0], np.cumsum(_CLASS[data] == 1)))
    marked = _per_text((mark[words.end] - mark[words.start]) > 0, words.first) / some
    dry = _per_text((vowel[words.end] - vowel[words.start]) == 0, words.first) / some
    shout = _per_text((capital[words.end] - capital[words.start]) > 1, words.first) / some
    # entropy of bytes
    rows = max(1, (1 << 22) // 256)
    entropy = np.zeros(n)
    for a in range(0, n, rows):
        z = min(n, a + rows)
        lo, hi = offsets[a], offsets[z]
        p = np.bincount((text[lo:hi] - a) * 256 + data[lo:hi], minlength=256 * (z - a)).reshape(-1, 256) / size[a:z, None]
        entropy[a:z] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    root = np.sqrt
    return np.stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(spread), root(classes[:, 1]), root(classes[:, 2]), root(classes[:, 3]), root(classes[:, 4]), root(classes[:, 5]), root(classes[:, 6]),
            np.log(distinct / some + 0.01), root(top / some), np.log(distinct_pairs / np.maximum(count - 1, 1) + 0.01), root(1 - distinct_lines / np.maximum(lines, 1)), np.log1p(count / np.maximum(lines, 1)), root(marked), root(shout), root(dry), entropy,
        ],
        axis=1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(part.column("text").fill_null(""))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measure, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes, and the logarithm of their prior ratio."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * ld for m, inv, ld in zip(self.mean, self.inverse, self.log_det)]
        margin = np.clip(density[1] - density[0] + self.log_prior, -700, 700)
        return 1 / (1 + np.exp(-margin))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        y = batch.column("y").to_numpy()
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["y", "m"])


def fit(measured: DataFrame, labels: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Learn from (doc_id, x) and (doc_id, y).  ``pooled`` and ``ridge``: weights of the two shrinkage targets."""
    d = len(STATISTICS)
    joined = measured.join(labels.filter("y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y")), "doc_id").select("x", "y")
    parts = joined.mapInArrow(_moments, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in parts:
        total[r.y, r.i] = r.v
    n = total[:, 0]
    if n.min() < 2:
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, share)
    mean = total[:, 1 : 1 + d] / n[:, None]
    cov = total[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    both = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    diagonal = np.diag(np.maximum(np.diag(both), 1e-6))
    inverse, log_det = [], []
    for c in (0, 1):
        s = (1 - pooled - ridge) * cov[c] + pooled * both + ridge * diagonal
        lower = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(mean, np.array(inverse), np.array(log_det), float(np.log(n[1] / n[0])))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS)
        for batch in batches:
            p = sent.value.score(batch.column("x").flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return run


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row of ``measured``."""
    kind = measured.schema["doc_id"].dataType.simpleString()
    sent = measured.sparkSession.sparkContext.broadcast(model)  # two matrices of fixed size
    return measured.mapInArrow(_score(sent), f"doc_id {kind}, score double")


def measured_table(docs: DataFrame) -> DataFrame:
    """The statistics as a written table, so texts are read once for fitting and scoring."""
    return materialise(measure(docs), "quality-statistics", TEXT_ROWS)
