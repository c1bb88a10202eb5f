"""Quality classifier: naive Bayes support vectors.

Indicators of words, word pairs, and pairs and triples of shapes (a shape tells what kind of token it is, and whether it repeats
the one before) are scaled by class log-count ratios; a linear hinge-loss model is then fitted by dual coordinate
descent (L2-regularised, L1 hinge), and its margin is calibrated by a logistic curve on rows that the fit has not seen.

Edge cases: null and empty texts have no n-grams and get the score of the bias alone; rows with a null id or null label
don't train; rows that repeat an id train once for each label row; an empty label table gives score 0.5; extra columns
don't take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import doc_columns, fold_remainder, mix64, ship, sorted_unique, table

BITS = 20
#: At most so many labelled rows of each class are used for the fit: those with the smallest hash of their id.
SAMPLE = 3000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n")


def normal(w: str) -> tuple[str, str]:
    """A token's own name (words by letters and case, numbers by length, runs of punctuation as they are), and its shape."""
    if w.isalpha():
        return ("^" + w.lower(), "UP") if w.isupper() and len(w) > 1 else (w.lower(), "w")
    if w.isdigit():
        return f"#{len(w)}", "NUM"
    return w, w


class Hashes(dict):
    """Token to hashes of its name (upper half) and shape; emptied when full, so that its memory is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 60_000:
            self.clear()
        name, shape = normal(w)
        self[w] = out = zlib.crc32(name.encode()) << 32 | zlib.crc32(shape.encode(), 1)
        return out


HASHES = Hashes()
REPEATED = np.uint64(0x5EED)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed indicators: words, word pairs, shape pairs and triples."""
    found = TOKEN.findall(text or "")
    if not found:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:][word[1:] == word[:-1]] = REPEATED
    with np.errstate(over="ignore"):
        step = lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + b
        pair = step(shape[:-1], shape[1:])
        grams = [mix64(word, 1), mix64(step(word[:-1], word[1:]), 2), mix64(sorted_unique(pair), 3), mix64(sorted_unique(step(pair[:-1], shape[2:])), 4)]
    return sorted_unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Weights already multiplied by the log-count ratios, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        return self.bias + (float(self.weights[found].sum()) / max(1.0, len(found) ** 0.5))

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7, still: float = 1e-3) -> tuple[np.ndarray, float]:
    """w and bias of min |w|^2/2 + sum of cost * hinge, one dual variable at a time, in a shuffled order that is always the same."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / max(1.0, len(r) ** 0.5) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < still:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ margin + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> Model:
    """rows: feature indices; y: 1 or -1. With a single class the score is constant, near that class."""
    size = 1 << BITS
    if not len(y):
        return Model(np.zeros(size), 0.0, 1.0, 0.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(len(y) + 1.0) * y[0]))

    def ratio(chosen: np.ndarray) -> np.ndarray:
        p, q = np.full(size, smoothing), np.full(size, smoothing)
        for i in chosen:
            (p if y[i] > 0 else q)[rows[i]] += 1
        return np.log((p / p.sum()) / (q / q.sum()))

    def train(chosen: np.ndarray) -> Model:
        r = ratio(chosen)
        share = np.where(y[chosen] > 0, (y[chosen] > 0).mean(), (y[chosen] <= 0).mean())
        w, bias = dual_descent([rows[i] for i in chosen], y[chosen], r, 0.5 / np.maximum(share, 0.05))
        return Model(w * r, bias, 1.0, 0.0)

    each, fold = np.arange(len(y)), np.arange(len(y)) % 4
    held = np.zeros(len(y))
    if len(y) >= 40:  # margins of rows that the model did not see, for the calibration
        for k in (0, 1):
            part = train(each[fold != k])
            for i in each[fold == k]:
                held[i] = part.margin(rows[i])
        seen = fold < 2
        if len(set(y[seen].tolist())) < 2:
            seen = fold < 0
    else:
        seen = fold < 0
    model = train(each)
    if seen.any():
        model.slope, model.shift = logistic(held[seen], y[seen])
    else:
        model.slope, model.shift = logistic(np.array([model.margin(r) for r in rows]), y)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample: int) -> list[tuple[np.ndarray, int]]:
    """(features, label) of at most sample rows of each class, outside the held-out fold.

    The ids are chosen first, so that only their texts are read, on the executors; only feature numbers reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    clean = clean.filter(fold_remainder("doc_id", modulus) != held).withColumn("h", F.xxhash64("doc_id"))
    chosen = [x for y in (0, 1) for x in clean.filter(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    if not chosen:
        return []
    want = F.broadcast(spark.createDataFrame([(x.doc_id, x.y, x.h) for x in chosen], "doc_id long, y int, h long"))  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), b.column(3)], ["h", "doc_id", "x", "y"])

    rows = doc_columns(docs).join(want, "doc_id").select("h", "doc_id", "text", "y").mapInArrow(run, "h long, doc_id long, x binary, y int").collect()
    return [(np.frombuffer(r.x, np.int32).astype(np.int64), r.y) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.y, bytes(r.x)))]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """A model fitted on a bounded sample of labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, label, modulus, held, sample)
    return fit([x for x, _ in rows], np.array([1 if y else -1 for _, y in rows], dtype=np.int64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, modulus: int = 5, held: int = 0, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs with held_out, score and predicted of each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights
    extra = [c for c in columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    kept = [c for c in rows.columns if c in columns]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(features(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(s, pa.float64())], [*kept, "score"])

    out = rows.mapInArrow(run, ", ".join([*fields, "score double"]))
    return out.select(*columns, (fold_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
