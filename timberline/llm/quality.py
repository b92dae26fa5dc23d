"""Quality scores by a regularised quadratic discriminant over transformed statistics of whole documents.

Shares of signs, words and lines are transformed by arcsine of the square root, lengths by the logarithm. For each class
the means and the covariance are sums over all labelled rows that may be learned from, gathered by one aggregation; each
covariance is shrunk towards the pooled variances. The score is the posterior from the Mahalanobis distances and the
determinants, by Cholesky factors that are computed once.

Defined results: null and blank texts are scored like any other, by their zero statistics. Labels of documents that
don't exist are ignored, repeated documents count as often as they occur. Where the labels have fewer than two classes,
every score is the share of label 1 (0.5 without labels); a class of few rows has mostly the pooled variances. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_bytes, carrying, cut, grams, hashed_words, keyed_rows, mix
from .labels import held_out, training_labels

STATISTICS = ("upper", "exclaim", "bar", "symbol", "digit", "stop", "other", "wide", "word_length", "words", "lines", "distinct_words", "same_as_before", "distinct_trigrams", "lone")
#: Bytes of documents whose statistics are computed at once.
_PIECE = 8 << 20
_CLASS = np.zeros(256, np.uint8)
for _i, _signs in enumerate((range(65, 91), range(97, 123), b"!", b"|", b"#$%&*+=@^_~<>{}[]\\/", range(48, 58), b".,;:?", b"\"'()-`", b" \t\v\f\r", b"\n", range(128, 256)), 1):
    _CLASS[list(_signs)] = _i


def _share(a, b):
    return np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different values each document has."""
    keys = mix(values ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount(doc[order][first], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = []
    d = 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + _PIECE, side="right")) - 1)
        m, own = e - d, offsets[d : e + 1] - offsets[d]
        kind = _CLASS[data[offsets[d] : offsets[e]]]
        counts = np.zeros((12, m))
        for k in range(1, 12):
            total = np.zeros(len(kind) + 1, np.int32)
            np.cumsum(kind == k, out=total[1:])
            counts[k] = total[own[1:]] - total[own[:-1]]
        size = np.diff(own).astype(float)
        words, bounds = hashed_words(texts[d:e])
        n_words = np.diff(bounds)
        doc = np.repeat(np.arange(m), n_words)
        same = np.zeros(m)
        if len(words) > 1:
            twin = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
            same = np.bincount(doc[1:][twin], minlength=m).astype(float)
        three = grams(words, 3)
        whole = doc[: len(three)] == doc[2:] if len(three) else np.zeros(0, bool)
        tri = _distinct(three[whole], doc[: len(three)][whole], m) if whole.any() else np.zeros(m)
        one = _distinct(words, doc, m) if len(words) else np.zeros(m)
        letters = counts[1] + counts[2] + counts[11]
        blank = counts[9] + counts[10]
        ink = size - blank
        out.append(np.column_stack([
            _share(counts[1], counts[1] + counts[2]), _share(counts[3], ink), _share(counts[4], n_words), _share(counts[5], ink), _share(counts[6], ink), _share(counts[7], ink), _share(counts[8], ink), _share(counts[11], letters),
            np.log((ink + 1) / (n_words + 1)), np.log1p(n_words), np.log((counts[10] + 1) / (n_words + 1) + 0.01), _share(one, n_words), _share(same, n_words), _share(tri, np.maximum(n_words - 2, 1)), _share(blank - n_words + 1, n_words),
        ]))
        d = e
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def document_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, x (array of STATISTICS) and the longs ``more`` of each row of ``docs`` (doc_id, text, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(as_bytes(b.column(1)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, *b.columns[2:]], names=["doc_id", "x", *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), *more).mapInArrow(run, ", ".join(["doc_id long, x array<double>", *(f"{c} long" for c in more)]))


@dataclass
class Discriminant:
    """prior: share of label 1. Of class 0 and 1: means, inverse Cholesky factors, log determinants (None: prior only)."""

    prior: float
    means: list[np.ndarray] | None = None
    whiten: list[np.ndarray] | None = None
    logdet: list[float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        p = np.clip(self.prior, 1e-6, 1 - 1e-6)
        odds = np.full(len(x), np.log(p / (1 - p)))
        for k, sign in ((0, -1), (1, 1)):
            z = (x - self.means[k]) @ self.whiten[k].T
            odds -= sign * 0.5 * ((z * z).sum(axis=1) + self.logdet[k])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_discriminant(labelled: DataFrame, shrinkage: float = 0.1, floor: float = 1e-4) -> Discriminant:
    """A discriminant of ``labelled`` (x array, y 0 or 1). Two rows of sums come to the driver."""
    d = len(STATISTICS)
    item = lambda i: F.col("x")[i]
    sums = [F.sum(item(i)).alias(f"s{i}") for i in range(d)] + [F.sum(item(i) * item(j)).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r["y"]: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    n = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    prior = n[1] / sum(n) if sum(n) else 0.5
    if not min(n):
        return Discriminant(prior)
    means, covs = [], []
    for k in (0, 1):
        r = rows[k]
        mu = np.array([r[f"s{i}"] for i in range(d)]) / n[k]
        s = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                s[i, j] = s[j, i] = r[f"q{i}_{j}"] / n[k] - mu[i] * mu[j]
        means.append(mu)
        covs.append(s)
    pooled = np.diag(np.diag((n[0] * covs[0] + n[1] * covs[1]) / sum(n))) + floor * np.eye(d)
    whiten, logdet = [], []
    for s in covs:
        factor = np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(prior, means, whiten, logdet)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.1, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the longs ``more`` of each row of ``docs`` (doc_id, text, more), learned from
    ``labels`` (doc_id, quality)."""
    x = cut(document_statistics(docs, *more))
    model = fit_discriminant(x.join(training_labels(labels, "quality"), "doc_id").select("x", "y"), shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(flat)), *b.columns[2:]], names=["doc_id", "score", *more])

    scored = x.mapInArrow(run, ", ".join(["doc_id long, score double", *(f"{c} long" for c in more)]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op6``: doc_id, held_out, score, predicted."""
    return quality_scores(docs, labels)


@carrying
def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, each judged by its own text."""
    rows = keyed_rows(docs)
    good = quality_scores(rows, labels, more=(ROW,)).filter("predicted = 1").select(ROW)
    return rows.join(good, ROW, "left_semi").select(*docs.columns)
