"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors.

Tokens of toxic and of clean labelled rows are counted, whole words and their stems (first letters). The share of a word's tokens
that are toxic has a Dirichlet prior of PRIOR tokens with the share of its longest stem, that one has the next shorter
stem's, and the shortest the share of all tokens; so a word never met has what is known of its stem. A token scores the log-odds
of its share against that of all tokens, less DRIFT, which makes the mean of clean text negative. A linear-time scan then finds every
maximal-scoring segment of a text. A segment of score S in n tokens has an expected number of equals by chance of
K n exp(-lambda S) (extreme-value law); lambda and K are fitted to the segments of clean rows that were not counted. What the segments
have beyond chance is added up, in the logs of these expectations, a word's gain halved for each time that it
was met before in the text, and calibrated to a probability on rows that were not counted.

Edge cases: null and empty texts have no segment and get the score of a text without any; labels that are null, or rows
with null ids, don't train; no labels at all: score is the same for all, near 0. Ties between segments don't arise, as
maximal segments are disjoint. Extra columns don't take part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, doc_columns, fold_remainder, ship, table

#: Labelled rows of each class, at most, chosen by the hash of the id.
SAMPLE = 6000
WORD = re.compile(r"[^\W\d_]+")
#: Tokens that a prior weighs, and what a token loses.
PRIOR = 50.0
DRIFT = 0.4
#: Lengths of the stems, which stand in for rare words; a stem is written with a sign no word has.
STEMS = (4, 5, 6)


def segments(at: list[int], left: list[float], right: list[float], last: list[int] | None = None) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment as (first token, last token, score), in linear time.

    at holds the tokens with positive scores in order, left and right the sums of all scores before and up to each of them; or the first tokens
    of runs of such tokens, with their last tokens beside them, as the tokens of a run always belong together.
    Segments on a stack are kept with the running total before and after them; a new one joins the nearest earlier
    one that starts lower and ends no higher.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    for i, low, high, end in zip(at, left, right, at if last is None else last, strict=True):
        first = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, end, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def names(word: str) -> list[str]:
    """A word and its stems, the longest first."""
    return [word, *[f"{word[:n]}~" for n in reversed(STEMS) if len(word) > n]]


def hash_of(name: str) -> int:
    raw = name.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5EED)


class Scores(dict):
    """The score of each word met so far, as it is written; emptied when full, so that its memory is bounded."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        super().__init__()
        self.keys_, self.values_ = keys, values

    def __missing__(self, word: str) -> float:
        self.learn({word})
        return self[word]

    def learn(self, words: set[str]) -> None:
        """Looks up those of the words that aren't known, all at once: a word has the score of its longest name that the model has."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > 60_000:
            self.clear()
            new = list(words)
        if not new:
            return
        hashes = [[hash_of(name) for name in names(w.lower())] for w in new]
        flat = np.fromiter(chain.from_iterable(hashes), np.uint64)
        word = np.repeat(np.arange(len(new)), list(map(len, hashes)))
        at = np.minimum(np.searchsorted(self.keys_, flat), len(self.keys_) - 1)
        hit = np.flatnonzero(self.keys_[at] == flat)
        of, first = np.unique(word[hit], return_index=True)
        score = np.zeros(len(new))
        score[of] = self.values_[at[hit[first]]]
        self.update(zip(new, (score - DRIFT).tolist(), strict=True))


class Model:
    """Log-odds by sorted hash of the name, the extreme-value law, and the calibration."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, scale: float = 1.0, size: float = 0.1):
        self.keys, self.values, self.scale, self.size = keys, values.astype(np.float32), scale, size
        self.slope, self.shift = 1.0, -30.0
        self.met = Scores(self.keys, self.values)

    @classmethod
    def of(cls, gain: dict[str, float]) -> Model:
        """From log-odds of names."""
        keys = np.array([hash_of(w) for w in gain], np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], np.array(list(gain.values()))[order] if gain else np.zeros(0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "met"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.met = Scores(self.keys, self.values)

    def found(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Segments as (first token, last token, score, score with repetition damped)."""
        if not len(self.keys) or not words:
            return []
        self.met.learn(set(words))
        x = np.fromiter(map(self.met.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(x > 0)
        if not len(at):
            return []
        total = np.concatenate(([0.0], np.cumsum(x)))
        begins = np.concatenate(([True], np.diff(at) > 1))
        first, last = at[begins], at[np.concatenate((begins[1:], [True]))]
        found = segments(first.tolist(), total[first].tolist(), total[last + 1].tolist(), last.tolist())
        # every positive token lies in a segment; each earlier one of the same word halves what it counts
        known: dict[str, int] = {}
        word = np.array([known.setdefault(words[i].lower(), len(known)) for i in at.tolist()])
        order = np.argsort(word, kind="stable")
        start = np.concatenate(([True], np.diff(word[order]) > 0))
        earlier = np.empty(len(at), np.int64)
        earlier[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        lost = np.concatenate(([0.0], np.cumsum(x[at] * (1 - 0.5 ** np.minimum(60, earlier)))))
        low, high = np.searchsorted(at, [f[0] for f in found]), np.searchsorted(at, [f[1] for f in found], "right")
        return [(a, b, s, s - d) for (a, b, s), d in zip(found, (lost[high] - lost[low]).tolist(), strict=True)]

    def chance(self, score: float, tokens: int) -> float:
        """Log of the expected number of segments of at least this score in so many clean tokens."""
        return math.log(self.size * max(1, tokens)) - self.scale * score

    def evidence(self, damped: list[float], tokens: int) -> float:
        """Sum of what the segments have beyond chance, in nats."""
        return sum(max(0.0, -self.chance(s, tokens)) for s in damped)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * math.log1p(evidence) + self.shift))))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each name from its (toxic, clean) tokens; stems have a ~ at their end."""
    whole = [(t, c) for w, (t, c) in counts.items() if not w.endswith("~")]
    toxic, clean = sum(t for t, _ in whole), sum(c for _, c in whole)
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    share: dict[str, float] = {}
    for name in sorted(counts, key=lambda w: (not w.endswith("~"), len(w))):  # stems by length, then words
        word = name.removesuffix("~")
        rest = next((share[x] for x in names(word)[1:] if x != name and x in share), base)
        t, c = counts[name]
        share[name] = (t + PRIOR * rest) / (t + c + PRIOR)
    return {w: math.log(p / (1 - p)) - math.log(base / (1 - base)) for w, p in share.items()}


def law(scores: np.ndarray, tokens: int) -> tuple[float, float]:
    """lambda and K of the extreme-value law from the scores of all segments of clean text: of the upper tenth, by its median,
    so that a few rows with a wrong label don't matter; with hardly any segments, 1 and 0.1."""
    if len(scores) < 100 or not tokens:
        return 1.0, 0.1
    least = float(np.quantile(scores, 0.9))
    beyond = scores[scores > least] - least
    if len(beyond) < 10 or np.median(beyond) <= 0:
        return 1.0, 0.1
    scale = math.log(2) / float(np.median(beyond))
    return scale, len(beyond) * math.exp(min(50.0, scale * least)) / tokens


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold; tokens are counted on the executors."""
    spark = docs.sparkSession
    ship(spark)
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    clean = clean.filter(fold_remainder("doc_id", modulus) != held).withColumn("h", F.xxhash64("doc_id"))
    want = [x for y in (0, 1) for x in clean.filter(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    if not want:
        return Model.of({})
    ids = F.broadcast(spark.createDataFrame([(x.doc_id, x.y, x.h) for x in want], "doc_id long, y int, h long"))  # at most 2 * sample rows
    scratch = Scratch(spark, "toxicity")
    rows, path = scratch.keep(doc_columns(docs).join(ids, "doc_id").select("text", "y", (F.pmod("h", F.lit(4)) == 0).alias("aside")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(words_of(text)).items():
                    for name in names(w.lower()):
                        n[y][name] += k
        every = sorted(n[0].keys() | n[1].keys())
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[1][w] for w in part], pa.int64()), pa.array([n[0][w] for w in part], pa.int64())], ["word", "toxic", "clean"])

    counts = rows.filter("not aside").select("text", "y").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    model = Model.of(log_odds(dict(zip(counts["word"].to_pylist(), zip(counts["toxic"].to_pylist(), counts["clean"].to_pylist(), strict=True), strict=True))))
    shared = spark.sparkContext.broadcast(model)  # 12 bytes for each distinct word and stem of the sample

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            found = [shared.value.found(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64())), pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64())), pa.array([len(w) for w in words], pa.int64()), b.column(1)], ["s", "d", "n", "y"])

    seen = rows.filter("aside").select("text", "y").mapInArrow(stats, "s array<double>, d array<double>, n long, y int").collect()
    model.scale, model.size = law(np.array([x for r in seen if r.y == 0 for x in r.s]), sum(r.n for r in seen if r.y == 0))
    calibrate(model, np.array([model.evidence(r.d, r.n) for r in seen]), np.array([r.y for r in seen]))
    shared.unpersist()
    scratch.drop(path)
    return model


def calibrate(model: Model, e: np.ndarray, y: np.ndarray) -> None:
    """A logistic curve of log(1 + evidence); without rows of both classes a steep default."""
    if len(y) == 0 or y.min() == y.max():
        model.slope, model.shift = 4.0, -3.0 if len(model.keys) else -30.0
        return
    x = np.log1p(e)
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, w = p - goal, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, np.array([d @ x + 0.1 * a, d.sum()])), -3, 3)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(a, 0.0), b


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and every significant toxic passage: code point offsets, text, score in nats and log of the expected number by chance."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 12 bytes for each distinct word and stem of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("log_expected", pa.float64())]))
        for b in batches:
            scores, spans = [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                found = m.found(words)
                scores.append(m.score(m.evidence([x[3] for x in found], len(words))))
                sure = [(p, q, s, e) for p, q, s, _ in found if (e := m.chance(s, len(words))) < 0]
                at = [x.span() for x in WORD.finditer(text)] if sure else []
                spans.append([{"start": at[p][0], "end": at[q][1], "text": text[at[p][0] : at[q][1]], "score": s, "log_expected": e} for p, q, s, e in sure])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,text:string,score:double,log_expected:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str, modulus: int = 4, held: int = 2) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = passages(docs, train(docs, table(spark, sf_dir, "labels"), "toxic", modulus, held))
    return found.select("doc_id", (fold_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
