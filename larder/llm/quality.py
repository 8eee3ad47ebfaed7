"""Naive Bayes support vectors: n-gram indicators scaled by log-count ratios, a linear hinge loss fitted by dual coordinate descent."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import share_of, shuffle_key
from .words import _SPACE, mix64, text_buffer

#: log2 of the number of hashed features.
BITS = 16
#: Bound of the sample that the support vectors are fitted on; counts cover all labelled rows.
FIT_ROWS = 4096
#: Documents that score lower are low quality.
THRESHOLD = 0.3
ALPHA, COST, EPOCHS = 1.0, 0.1, 12
SCHEMA = "doc_id long, score double"
#: Kinds of bytes. 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 sentence mark, 5 other mark.
_KIND = np.full(256, 5, np.uint64)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:!?'"]] = 4


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def features(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-gram indicators of one text given as UTF-8 bytes.

    N-grams are of three bytes, and of one to three words; for the latter a word is its
    shape: the runs of its kinds of bytes, and whether it equals the word before. A shape
    carries, by steps, its share of the words, so repetition shows as an indicator.
    """
    out = []
    if len(data) >= 3:
        d = data.astype(np.uint64)
        out.append(d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16) | np.uint64(1 << 40))
    space = _SPACE[data]
    inside = ~space
    if inside.any():
        edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        kinds = np.where(space, np.uint64(0), _KIND[data])
        head = _runs(kinds)
        head = head[kinds[head] > 0]
        word = np.searchsorted(starts, head, side="right") - 1
        place = np.arange(len(head)) - np.searchsorted(word, np.arange(len(starts)))[word]
        shape = np.bincount(word, (kinds[head] * (7 ** np.minimum(place, 6)).astype(np.uint64)).astype(float), len(starts)).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(data.astype(np.uint64) + np.uint64(257) * (np.arange(len(data)) - starts[np.searchsorted(starts, np.arange(len(data)), side="right") - 1] + 1).astype(np.uint64)), dtype=np.uint64)])
        whole = sums[ends] - sums[starts]
        shape[1:] += np.uint64(1 << 22) * (whole[1:] == whole[:-1])
        seen, n = np.unique(shape, return_counts=True)
        steps = np.floor(np.log2(n / len(shape)) * -1).astype(np.uint64)
        out.append(seen | steps << np.uint64(32) | np.uint64(2 << 40))
        distinct = math.floor(8 * len(np.unique(whole)) / len(whole))
        out.append(np.array([distinct | 6 << 40], np.uint64))
        for k, order in ((1, 3), (2, 4), (3, 5)):
            if len(shape) >= k:
                gram = np.zeros(len(shape) - k + 1, np.uint64)
                for j in range(k):
                    gram = gram * np.uint64(0x100000001B3) + shape[j : j + len(gram)]
                out.append(gram & np.uint64((1 << 40) - 1) | np.uint64(order << 40))
    else:
        out.append(np.array([7 << 40], np.uint64))
    codes = (mix64(np.concatenate(out)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(codes)


def batch_features(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    data, at = text_buffer(texts)
    return [features(data[a:b], bits) for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass
class QualityModel:
    """A weight per feature (log-count ratio times support-vector weight), bias, and the sigmoid of the margin."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weight[found].sum()) + self.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * margin + self.shift))))


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised squared hinge loss over indicators times ``scale``; the classes weigh alike."""
    w, b = np.zeros(len(scale)), 0.0
    share = {y: max(1, int((labels == y).sum())) for y in (-1, 1)}
    ridge = np.array([share[int(y)] * 2 / (2 * cost * len(labels)) for y in labels])
    diagonal = np.array([float((scale[r] ** 2).sum()) + 1 for r in rows]) + ridge
    dual = np.zeros(len(rows))
    dealt = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in dealt.permutation(len(rows)):
            r, y = rows[i], labels[i]
            slope = y * (float((w[r] * scale[r]).sum()) + b) - 1 + ridge[i] * dual[i]
            new = max(0.0, dual[i] - slope / diagonal[i])
            if new != dual[i]:
                step = (new - dual[i]) * y
                w[r] += step * scale[r]
                b += step
                dual[i] = new
    return w, b


def fit_sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton's steps with smoothed targets."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g, v = p - target, np.maximum(p * (1 - p), 1e-6)
        ga, gc = (g * margins).sum() + 1e-3 * a, g.sum()
        haa, hac, hcc = (v * margins**2).sum() + 1e-3, (v * margins).sum(), v.sum() + 1e-9
        det = haa * hcc - hac**2
        if det <= 1e-12:
            break
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - da, c - dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return max(a, 1e-3), c


def train_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """The model from ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks; None without both classes.

    Log-count ratios count every labelled document; the support vectors are fitted on the
    ``fit_rows`` documents of least hashed doc_id. A doc_id with several labels is good if
    most are. Null labels and doc_ids without a label teach nothing.
    """
    size = 1 << bits
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # labels grow with the documents, so this join is by shuffle at every size
    marked = texts.join(known.hint("merge"), "doc_id").select("doc_id", "text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        of = np.zeros(2, np.int64)
        for batch in batches:
            for found, good in zip(batch_features(batch.column(0), bits), batch.column(1).to_pylist(), strict=True):
                seen[int(good), found] += 1
                of[int(good)] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, size)), pa.array(np.append(seen[0, at], of[0])), pa.array(np.append(seen[1, at], of[1]))], ["feature", "bad", "good"])

    counts = marked.select("text", "good").mapInArrow(count, "feature long, bad long, good long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    if not counts.num_rows:
        return None
    table = np.zeros((2, size + 1))
    table[:, counts["feature"].to_numpy()] = counts["bad"].to_numpy(), counts["good"].to_numpy()
    if not table[:, size].all():
        return None
    share = [(table[k, :size] + ALPHA) / (table[k, size] + 2 * ALPHA) for k in (0, 1)]
    ratio = np.log(share[1] / share[0])

    # twice the share that is wanted first, so that what is sorted at once does not grow with the labels
    few = 2 * fit_rows / max(1.0, float(table[:, size].sum()))
    picked = known.withColumn("key", shuffle_key(11, F.col("doc_id"))).where(share_of(F.col("key")) < few).orderBy("key").limit(fit_rows).select("doc_id", "good", "key")
    sample = texts.join(F.broadcast(picked), "doc_id").select("text", "good", "key")  # fit_rows rows at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32) for f in batch_features(batch.column(0), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["key", "good", "found"])

    fit = sample.mapInArrow(encode, "key string, good boolean, found array<int>").toArrow().sort_by([("key", "ascending")])
    rows, good = [f.values.to_numpy() for f in fit["found"]], np.array(fit["good"].to_pylist(), dtype=bool)
    signs = np.where(good, 1, -1)
    part = np.arange(len(rows)) % 4 == 3  # the curve is drawn through margins of rows that were not fitted
    if len(set(signs[~part])) == 2 and len(set(signs[part])) == 2:
        w, b = fit_hinge([r for r, p in zip(rows, part, strict=True) if not p], signs[~part], ratio)
        margins = np.array([float((w[r] * ratio[r]).sum()) + b for r, p in zip(rows, part, strict=True) if p])
        slope, shift = fit_sigmoid(margins, good[part])
    else:
        slope, shift = 2.0, 0.0
    w, b = fit_hinge(rows, signs, ratio)
    return QualityModel((w * ratio).astype(np.float32), b, slope, shift)


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score, 0 to 1, of every whole text; without a model 0.5.

    Null and empty texts have the one indicator of a text without words and get its score.
    Repeated rows get equal scores; other columns are not read. The model has 2**BITS weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(f) if model else 0.5 for f in batch_features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
