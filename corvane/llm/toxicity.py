"""Toxicity by cumulative-link ordinal regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


#: Bytes of the beginnings of words that are features beside the whole words: they stand for stems.
STEMS = (3, 4, 5, 6, 7)
_FLUSH = 200_000


def _words(text: bytes) -> list[bytes]:
    return [w for w in _BREAK.split(text.lower()) if w]


def _features(words: Iterable[bytes]) -> Iterator[bytes]:
    """Whole words, and beginnings of longer ones with a star."""
    for w in words:
        yield w
        for n in STEMS:
            if len(w) > n:
                yield w[:n] + b"*"


@dataclass
class OrdinalModel:
    """Severity grades 0 to len(thresholds): P(grade > k) is the logistic of weights . features - thresholds[k], with the same weights for every threshold. A feature is log(1 + how many words of the text are that word, or begin with that stem)."""

    weights: dict[bytes, float]
    thresholds: list[float]
    least: float = 0.5  # chance of any grade above 0 from which a text counts as toxic
    seen: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, repr=False, compare=False)  # the features of words met before, at most _FLUSH

    def _of(self, word: bytes) -> tuple[bytes, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= _FLUSH:
                self.seen.clear()
            found = self.seen[word] = tuple(f for f in _features((word,)) if f in self.weights)
        return found

    def severity(self, text: bytes | None) -> tuple[float, float]:
        """The chance of any grade above 0 and the expected grade; both 0 for a text without words."""
        words = _words(text) if text else []
        if not words:
            return 0.0, 0.0
        counts = Counter(f for w in words for f in self._of(w))
        score = sum(self.weights[w] * math.log1p(n) for w, n in counts.items())
        above = [1.0 / (1.0 + math.exp(min(700.0, t - score))) for t in self.thresholds]
        return above[0], sum(above)


@dataclass
class SparseRows:
    """A matrix of n rows and d columns by its values and where they stand."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    n: int
    d: int

    @classmethod
    def of(cls, dense: np.ndarray) -> SparseRows:
        rows, cols = np.nonzero(dense)
        return cls(rows, cols, dense[rows, cols], *dense.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.cols], minlength=self.n)

    def dot_left(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=self.values * v[self.rows], minlength=self.d)


def fit_cumulative_link(x: SparseRows, grades: np.ndarray, levels: int, *, l2: float = 1e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the cumulative-link likelihood, by Adam on weights, first threshold and logs of the gaps."""
    n, d = x.n, x.d
    theta = np.zeros(d + levels - 1)
    theta[d] = 2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    bounds = np.arange(levels - 1)
    for t in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = 1.0 / (1.0 + np.exp(-np.clip(cuts[None, :] - x.dot(w)[:, None], -30, 30)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-9)
        slope = s * (1 - s)
        up, down = (bounds[None, :] == grades[:, None]) * slope / p[:, None], (bounds[None, :] == grades[:, None] - 1) * slope / p[:, None]
        by_cut = (up - down).sum(0) / n
        g = np.concatenate([-x.dot_left((up - down).sum(1)) / n - l2 * w, [by_cut.sum()], gaps * by_cut[::-1].cumsum()[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])


def _graded(x: SparseRows, toxic: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Grades of documents labelled 0 or 1: toxic ones are 1, 2 or 3 by the thirds of how much in them speaks for toxicity.

    Each half of the documents is read by the odds that the other half gives the features, so that no document's own
    label has a part in how its text is read.
    """
    odds = np.zeros((2, x.d))
    for h in (0, 1):
        own = half[x.rows] == h
        bad, good = (toxic & (half == h)).sum() + 1, (~toxic & (half == h)).sum() + 1
        of_bad = np.bincount(x.cols[own], weights=toxic[x.rows[own]], minlength=x.d)
        of_good = np.bincount(x.cols[own], weights=~toxic[x.rows[own]], minlength=x.d)
        odds[h] = np.log((of_bad + 0.5) / bad) - np.log((of_good + 0.5) / good)
    speaks = odds[1 - half[x.rows], x.cols] > 2
    amount = np.bincount(x.rows[speaks], weights=x.values[speaks], minlength=x.n)
    low, high = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (amount > low) + (amount > high), 0)


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents: int = 16000, least_docs: int = 8, least_ratio: float = 15.0) -> OrdinalModel:
    """Fit the model on about ``documents`` labelled documents, chosen by the id's hash.

    Labels are grades from 0 up. Where there are only 0 and 1, the toxic documents are split into grades 1, 2 and 3 by how
    much in the text speaks for toxicity, as told by other documents (``_graded``). Words and stems of ``least_docs``
    documents or more are features if a likelihood-ratio test tells toxic documents by them from others (``least_ratio``);
    all that pass are. Without rows of both classes nothing is toxic.
    """
    n = labels.where(F.col(label_col).isNotNull()).count()
    many = 1_000_003
    picked = labels.where(F.col(label_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(many)) < math.ceil(many * min(1.0, documents / max(1, n)))))
    picked = picked.select(F.col(id_col).alias("_cv_id"), F.col(label_col).cast("int").alias("_cv_y"), F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.lit(2)).cast("int").alias("_cv_half")).distinct()
    sample = df.select(F.col(id_col).alias("_cv_id"), F.col(text_col).cast("binary").alias("_cv_t")).where(F.col("_cv_t").isNotNull()).join(F.broadcast(picked), "_cv_id")  # the sample is bounded

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for y, text in zip(batch.column(0), batch.column(1), strict=True):
                y = y.as_py()
                tally.update((f, y) for f in set(_features(set(_words(text.as_py())))))
                if len(tally) > _FLUSH:
                    yield sent_on(tally)
                    tally = Counter()
            yield sent_on(tally)

    def sent_on(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in tally], pa.binary()), pa.array([y for _, y in tally], pa.int32()), pa.array(tally.values(), pa.int64())], ["w", "y", "n"])

    totals = {r[0]: r[1] for r in sample.groupBy("_cv_y").count().collect()}
    levels = max(totals, default=0) + 1
    bad, good = sum(c for y, c in totals.items() if y > 0), totals.get(0, 0)
    if not bad or not good:
        return OrdinalModel({}, [30.0, 31.0, 32.0])
    words = sample.select("_cv_y", "_cv_t").mapInArrow(told, "w binary, y int, n long").groupBy("w").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    share = (F.col("a") + F.col("b")) / float(bad + good)
    ratio = 2 * (part(F.col("a"), share * bad) + part(F.col("b"), share * good) + part(bad - F.col("a"), (1 - share) * bad) + part(good - F.col("b"), (1 - share) * good))
    chosen = words.where(F.col("a") + F.col("b") >= least_docs).withColumn("g", ratio).where(F.col("g") > least_ratio).select("w").collect()
    vocabulary = {w: i for i, w in enumerate(sorted(bytes(r["w"]) for r in chosen))}
    if not vocabulary:
        return OrdinalModel({}, [30.0, 31.0, 32.0])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(vocabulary[x] for x in _features(_words(text)) if x in vocabulary) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["y", "half", "i", "c"])

    got = sample.select("_cv_y", "_cv_half", "_cv_t").mapInArrow(counted, "y int, half int, i array<int>, c array<int>").toArrow().to_pylist()
    got = sorted(((r["y"], r["half"], *map(tuple, zip(*sorted(zip(r["i"], r["c"], strict=True)), strict=True))) if r["i"] else (r["y"], r["half"], (), ())) for r in got)  # the same sums whatever the order of arrival
    cols = [r[2] for r in got]
    x = SparseRows(np.repeat(np.arange(len(got)), [len(c) for c in cols]), np.array([k for c in cols for k in c], dtype=np.int64), np.log1p([float(k) for r in got for k in r[3]]), len(got), len(vocabulary))
    y = np.array([r[0] for r in got])
    grades, levels = (_graded(x, y > 0, np.array([r[1] for r in got])), 4) if levels < 3 else (np.maximum(y, 0), levels)
    weights, cuts = fit_cumulative_link(x, grades, levels)
    chance = 1.0 / (1.0 + np.exp(np.clip(cuts[0] - x.dot(weights), -30, 30)))
    return OrdinalModel({w: float(weights[i]) for w, i in vocabulary.items()}, [float(c) for c in cuts], _best_cut(chance, y > 0))


def _best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The chance that parts the labelled documents with the best F1, halfway between the two nearest."""
    order = np.argsort(-chance, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    apart = np.append(chance[order][:-1] > chance[order][1:], True)
    at = int(np.argmax(np.where(apart, f1, -1)))
    below = chance[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((chance[order[at]] + below) / 2)


def grade_toxicity(df: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", model: OrdinalModel | None = None, least: float | None = None, **how: object) -> DataFrame:
    """Expected severity of every whole text.

    Returns one row per document: ``id_col``, toxic_probability (of any grade above 0), severity (the expected grade, from 0 to
    the highest) and toxic (the probability is ``least`` or more; where that is None, what parted the labelled sample best). A null text or one without words has severity 0; null or repeated ids are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    model = model or train(df, labels, id_col=id_col, text_col=text_col, **how)
    least = model.least if least is None else least
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample
    slim = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_cv_t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.severity(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] >= least for f in found], pa.bool_())], [id_col, "toxic_probability", "severity", "toxic"])

    return slim.mapInArrow(of, slim.select(id_col).schema.add("toxic_probability", "double").add("severity", "double").add("toxic", "boolean"))
