"""Quality of whole texts by Naive Bayes support vectors.

Features are indicators of byte trigrams (hashed to 2 ** bits buckets) of the text with a blank on either side, and one of
how many of its trigrams are distinct for a text of its length (texts of repeated words stand out). Every
indicator is scaled by its class log-count ratio r, rows get unit length, and a linear model is fitted with hinge loss by
dual coordinate descent; its weights are interpolated with their mean magnitude. A sigmoid fitted on rows that the descent
has not seen turns margins into scores.

The fit uses a sample of at most `sample` labelled rows (by hash of the id) without the held-out fold; only their
features reach the driver. Scoring is one narrow pass over all whole texts; the model is two vectors of fixed length.

Defined results: a null text is empty (its two blanks make no trigram: the score is the sigmoid of the bias); of several
labels of one id the smallest counts, null labels count not at all; with labels of one class only, or none, every score is
the smoothed share of label 1 (0.5 without labels); a null id is never held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sigweave.llm.textbytes import text_bytes

CHUNK = 1 << 20
#: indicators of (length, share of distinct trigrams)
VARIETY = 256


@dataclass
class Model:
    """margin = sum of weight / sqrt(sum of square) + bias over a text's features; score = sigmoid(slope * margin + shift)."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def features(text: np.ndarray, mark: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the distinct trigrams of one text; `mark` is a zeroed scratch array of 2 ** bits flags."""
    for at in range(0, len(text) + 1, CHUNK):
        part = text[max(0, at - 2) : at + CHUNK]
        lead, tail = at == 0, at + CHUNK > len(text)
        b = np.empty(len(part) + lead + tail, np.uint32)
        b[0], b[-1] = 32, 32
        b[lead : lead + len(part)] = part
        if len(b) >= 3:
            gram = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            mark[gram * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    share = len(found) / (len(text) + 2)
    return np.append(found, (1 << bits) + min(15, len(text).bit_length()) * 16 + min(15, int(16 * share)))


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int, cost: float = 1.0, mix: float = 0.25, epochs: int = 15, seed: int = 5) -> Model:
    """The model from feature lists and labels (1 good, 0 bad)."""
    size = (1 << bits) + VARIETY
    n1 = int(good.sum())
    if n1 == 0 or n1 == len(good):
        share = (n1 + 1) / (len(good) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    seen = rng.permutation(len(rows))
    check, train = seen[: len(rows) // 5], seen[len(rows) // 5 :]
    if len(np.unique(good[train])) < 2 or len(np.unique(good[check])) < 2:
        check = train = seen
    count = np.ones((2, size))
    for i in train:
        count[int(good[i])][rows[i]] += 1
    r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    square = r * r
    norm = np.array([np.sqrt(square[x].sum()) or 1.0 for x in rows])
    y = np.where(good == 1, 1.0, -1.0)
    share = np.array([len(train) / (2 * max(1, (y[train] == s).sum())) for s in (-1, 1)])  # both classes weigh the same
    top = cost * share[(y > 0).astype(int)]
    scaled = [r[x] / m for x, m in zip(rows, norm, strict=True)]
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for v in scaled])
    for _ in range(epochs):
        for i in rng.permutation(train):
            x, v = rows[i], scaled[i]
            g = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    w = (1 - mix) * np.abs(w).mean() + mix * w
    weight = w * r
    margin = np.array([weight[x].sum() / m for x, m in zip(rows, norm, strict=True)]) + mix * bias
    slope, shift = sigmoid_fit(margin[check], good[check])
    return Model(weight, square, mix * bias, slope, shift, bits)


def sigmoid_fit(margin: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a sigmoid over margins, by damped Newton steps with smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margin.std() or 1.0
    x = np.stack([(margin - margin.mean()) / scale, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, z).sum() - target @ z)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        rate, old = 1.0, loss(w)
        while loss(w - rate * step) > old and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * margin.mean() / scale)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, bits: int = 16) -> Model:
    """Fits on labelled rows outside the held-out fold: docs(doc_id, text), labels(doc_id, quality)."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("good"))
    marks = marks.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        mark = np.zeros(1 << bits, bool)
        for b in batches:
            found = [features(t, mark, bits).astype(np.int32) for t in text_bytes(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["good"], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "good", "found"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # `sample` ids
    rows = rows.select(F.col("doc_id").cast("long"), F.col("good").cast("int"), "text")
    got = rows.mapInArrow(run, "doc_id long, good int, found array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    found = got["found"].combine_chunks()
    lists = [found[i].values.to_numpy() if found[i].values is not None else np.empty(0, np.int32) for i in range(len(found))]
    return fit(lists, np.array(got["good"].to_pylist(), int), bits)


def score_rows(model: Model, texts) -> np.ndarray:
    mark, out = np.zeros(1 << model.bits, bool), []
    for t in texts:
        x = features(t, mark, model.bits)
        norm = np.sqrt(model.square[x].sum())
        out.append(model.weight[x].sum() / (norm or 1.0) + model.bias)
    return 1 / (1 + np.exp(-np.clip(model.slope * np.array(out, float) + model.shift, -500, 500)))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs(text, ...) and the score of every whole text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    text_at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in batches:
            s = score_rows(model, text_bytes(b.column(text_at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def op1_nb_svm(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    from sigweave.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score_rows(model, text_bytes(b["text"])))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
