"""Language identification: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased, anything but letters becomes one space, and 4-grams of 16-bit symbols are counted over all
training rows, document by document on the executors. Lower orders use continuation counts. Every 4-gram stays in the
model, the rarest too, as discounts and continuation counts are taken from them. A language's model is built in one task from its
distinct 4-grams, so it grows with these, not with the number of rows; each language has arrays of its own, so the whole grows with
their sum. The lowest length-normalised cross-entropy wins.

Models of up to GROUP_BYTES are broadcast at once; languages beyond that are taken in further passes over the documents.

Rejection: the margin between the best two languages is calibrated on a bounded number of training rows, the only ones kept out of the counts; ``rejected``
tells that the calibrated score is under one half, or that the text fits its best language worse than nearly all of them.

Edge cases: null texts and texts without a letter give ``und`` and score 0; rows with a null language don't train;
repeated rows count as often as they occur; ties go to the language first in order; with no training rows all is ``und``.
Languages of fewer than RARE training rows give none to the calibration.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, fold_remainder, mix64, ship, table

ORDER = 4
#: Rows for the calibration, at most; they are kept out of the counts.
CALIBRATION = 1500
RARE = 64
GROUP_BYTES = 256 << 20
UNIFORM = 1.0 / 4096
CHUNK = 1_500_000
PAD = 0
SPACE = 32


def letter_table() -> np.ndarray:
    """Whether each symbol under 2 ** 16 is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


_LETTERS: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as 16-bit symbols, each after ORDER - 1 pads and a space; and the document of each symbol.

    Symbols beyond 16 bits are folded into the private use area.
    """
    if not _LETTERS:
        _LETTERS.append(letter_table())
    lower = [(t or "").lower() for t in texts]
    raw = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    doc = np.repeat(np.arange(len(lower)), lengths + 1)[: len(raw)]
    starts = (np.cumsum(lengths + 1) - lengths - 1)
    wide = raw > 0xFFFF
    if wide.any():
        far = np.unique(raw[wide])
        alpha = np.array([chr(x).isalpha() for x in far])
        at = np.searchsorted(far, raw[wide])
        raw = raw.copy()
        raw[wide] = np.where(alpha[at], 0xE000 + raw[wide] % 0x1000, SPACE)
        letter = _LETTERS[0][raw]
        letter[wide] = alpha[at]
    else:
        letter = _LETTERS[0][raw]
    s = np.where(letter, raw, SPACE).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    sep = starts[1:] - 1
    keep[sep] = False
    s, d = s[keep], doc[keep]
    n = np.bincount(d, minlength=len(lower))
    lead = ORDER
    out = np.zeros(len(s) + lead * len(lower), np.uint64)
    out_doc = np.repeat(np.arange(len(lower)), n + lead)
    at = np.cumsum(n + lead) - n - lead
    fill = np.ones(len(out), bool)
    for i in range(lead):
        fill[at + i] = False
    out[at + lead - 1] = SPACE
    out[fill] = s
    return out, out_doc


def grams(out: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each symbol, and its document; the leading pads and spaces end none."""
    if len(out) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = out[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        key |= out[ORDER - 1 - back : len(out) - back] << np.uint64(16 * back)
    d = doc[ORDER - 1 :]
    first = np.ones(len(out), bool)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    for i in range(ORDER):
        first[starts + i] = False
    ok = first[ORDER - 1 :]
    return key[ok], d[ok]


def tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.diff(np.append(at, len(key)))


class HashArray:
    """Values by sorted 64-bit hash of their key, with the first place of each value of the leading bits: a lookup touches a few neighbours."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix64(keys)
        order = np.argsort(h)
        self.hash, self.values = h[order], values[order].astype(np.float32)
        self.index()

    def index(self) -> None:
        self.bits = max(1, int(len(self.hash)).bit_length() - 1)
        top = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.first).max()) if len(self.hash) else 0

    def __getstate__(self) -> tuple:
        return self.hash, self.values

    def __setstate__(self, state: tuple) -> None:
        self.hash, self.values = state
        self.index()

    @property
    def nbytes(self) -> int:
        return self.hash.nbytes + self.values.nbytes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0 for none), and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        h = mix64(keys)
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last = len(self.hash) - 1
        at = np.minimum(at, last)
        less = np.flatnonzero(self.hash[at] < h)
        for _ in range(self.steps):
            if not len(less):
                break
            at[less] = np.minimum(at[less] + 1, last)
            less = less[self.hash[at[less]] < h[less]]
        hit = self.hash[at] == h
        return np.where(hit, self.values[at], 0.0).astype(np.float64), hit


class KneserNey:
    """One language: log p of the n-grams of each order, and log of the weight that a history leaves to the next lower order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.logp: dict[int, HashArray] = {}
        self.left: dict[int, HashArray] = {}
        levels = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
            k, c = tally(levels[n + 1][0] & np.uint64((1 << (16 * n)) - 1))
            levels[n] = (k, c.astype(np.float64))
        below = None
        for n in range(1, ORDER + 1):
            k, c = levels[n]
            one, two = (c == 1).sum(), (c == 2).sum()
            d = one / (one + 2 * two) if one and two else 0.5
            hist = k >> np.uint64(16)
            start = np.flatnonzero(np.concatenate(([True], hist[1:] != hist[:-1]))) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(k)))
            total = np.add.reduceat(c, start) if len(k) else c
            # the next lower order has every n-gram's end, so nothing needs to be looked up twice
            lower = UNIFORM if below is None else below[1][place(below[0], k & np.uint64((1 << (16 * (n - 1))) - 1))]
            rest = d * size / total if len(k) else total
            p = np.maximum(c - d, 0) / np.repeat(total, size) + np.repeat(rest, size) * lower
            self.logp[n], self.left[n] = HashArray(k, np.log(p)), HashArray(hist[start], np.log(rest))
            below = (k, p)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for each in (self.logp, self.left) for a in each.values())

    def look(self, key: np.ndarray, n: int) -> np.ndarray:
        """log p of the last symbol of each key given the n - 1 before it."""
        if n == 0:
            return np.full(len(key), np.log(UNIFORM))
        key = key & np.uint64((1 << (16 * n)) - 1)
        out, hit = self.logp[n].find(key)
        miss = ~hit
        if miss.any():
            rest = key[miss]
            out[miss] = self.look(rest, n - 1) + self.left[n].find(rest >> np.uint64(16))[0]
        return out


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is in the sorted keys, all of which are there."""
    return np.searchsorted(keys, wanted)


class Model:
    """All languages in order, and the calibration."""

    def __init__(self, names: list[str], each: list[KneserNey]):
        self.names, self.each = names, each
        self.slope, self.shift, self.worst = 20.0, 0.0, np.inf

    def groups(self) -> list[list[int]]:
        """The languages in groups of up to GROUP_BYTES; one that is larger is a group of its own."""
        out, size = [[]], 0
        for j, m in enumerate(self.each):
            if out[-1] and size + m.nbytes > GROUP_BYTES:
                out.append([])
                size = 0
            out[-1].append(j)
            size += m.nbytes
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol under each language (rows: texts), and the number of symbols; texts without letters have none."""
        return entropies(self.each, texts)

    def decide(self, best: np.ndarray, low: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of texts from their best language, the best two cross-entropies and the number of symbols."""
        none = n == 0
        score = self.calibrated(low, second, n)
        score[none] = 0.0
        low = np.where(none, 0.0, low)
        return ["und" if x else self.names[b] for x, b in zip(none, best, strict=True)], score, low, none | (score < 0.5) | (low > self.worst)

    def calibrated(self, low: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        gap = np.where(np.isinf(second), 1.0, second - low)
        return 1 / (1 + np.exp(-np.clip(self.slope * gap * np.sqrt(np.maximum(n, 1) / 100.0) + self.shift, -30, 30)))

    def calibrate(self, best: np.ndarray, low: np.ndarray, second: np.ndarray, n: np.ndarray, truth: list[str]) -> None:
        """Fits the score of the margin to how often the prediction is right, on rows not counted; few rows leave the prior."""
        ok = n > 0
        if ok.sum() < 20:
            return
        low, second, n = low[ok], second[ok], n[ok]
        right = np.array(self.names, object)[best[ok]] == np.array(truth, object)[ok]
        gap = np.where(np.isinf(second), 1.0, second - low) * np.sqrt(n / 100.0)
        goal = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
        prior, hold = self.slope, 0.05
        a, b = prior, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * gap + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(p - goal) @ gap + hold * (a - prior), (p - goal).sum() + hold * b])
            hess = np.array([[(w * gap * gap).sum() + hold, (w * gap).sum()], [(w * gap).sum(), w.sum() + hold]])
            step = np.clip(np.linalg.solve(hess, grad), -5, 5)
            a, b = max(a - float(step[0]), 0.1), b - float(step[1])
            if np.abs(step).max() < 1e-5:
                break
        self.slope, self.shift = a, b
        self.worst = float(np.quantile(low, 0.995)) * 1.1


def entropies(each: list[KneserNey], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct 4-gram of the texts is looked up once a language."""
    out, doc = symbols(texts)
    key, d = grams(out, doc)
    n = np.bincount(d, minlength=len(texts))
    total = np.zeros((len(texts), len(each)))
    if len(key):
        distinct = tally(key)[0]
        back = np.searchsorted(distinct, key)
        for j, model in enumerate(each):
            total[:, j] = -np.bincount(d, model.look(distinct, ORDER)[back], minlength=len(texts))
    return total / np.maximum(n, 1)[:, None], n


def training_rows(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """doc_id, text, lang of the rows that train, and whether they are kept aside for the calibration."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null").filter(fold_remainder("doc_id", modulus) != held)
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    want = min(CALIBRATION, sum(sizes.values()) // 32)
    common = [k for k, n in sizes.items() if n >= RARE]
    some = rows.filter(F.col("lang").isin(common)) if common else rows.limit(0)
    ids = [r.doc_id for r in some.select("doc_id", F.xxhash64("doc_id", F.lit("aside")).alias("h")).orderBy("h", "doc_id").limit(want).collect()]
    chosen = docs.sparkSession.createDataFrame([(x, True) for x in sorted(set(ids))], "doc_id long, aside boolean")
    return rows.filter("text is not null").join(F.broadcast(chosen), "doc_id", "left").withColumn("aside", F.coalesce("aside", F.lit(False)))  # at most CALIBRATION ids


def train(docs: DataFrame, modulus: int = 4, held: int = 2) -> Model:
    """Counts 4-grams of every training row, and builds each language's model, on the executors; only the models reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    rows = training_rows(docs, modulus, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                chosen = [i for i, x in enumerate(langs) if x == lang]
                found, size, part = [], 0, []
                for i in [*chosen, None]:
                    if i is not None:
                        part.append(texts[i].as_py())
                        size += len(part[-1])
                    if part and (i is None or size > CHUNK):
                        found.append(tally(grams(*symbols(part))[0]))
                        part, size = [], 0
                keys = np.concatenate([k for k, _ in found])
                counts = np.concatenate([c for _, c in found])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                if len(keys):
                    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(keys[at].view(np.int64)), pa.array(np.add.reduceat(counts, at))], ["lang", "gram", "n"])

    each = rows.filter("not aside").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    summed = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        k, c = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(k)
        return pa.table({"lang": [key[0].as_py()], "model": pa.array([pickle.dumps(KneserNey(k[order], c[order]))], pa.binary())})

    built = sorted(summed.groupBy("lang").applyInArrow(build, "lang string, model binary").collect(), key=lambda r: r.lang)
    model = Model([r.lang for r in built], [pickle.loads(bytes(r.model)) for r in built])
    if built:
        calibrate(model, rows.filter("aside"))
    return model


def calibrate(model: Model, aside: DataFrame) -> None:
    """Cross-entropies of a bounded sample of whole texts are taken on the executors; only these numbers reach the driver."""
    numbered = passed(aside.select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang").limit(2 * CALIBRATION), model)
    found = numbered.select("lang", "best", "low", "second", "n").collect()
    if found:
        model.calibrate(*(np.array([r[k] for r in found]) for k in ("best", "low", "second", "n")), [r.lang for r in found])


STATE = "best int, low double, second double, n long"


def passed(rows: DataFrame, model: Model) -> DataFrame:
    """rows, which have a text, with best language, the best two cross-entropies and the number of symbols. One pass for each group of languages;
    where there are several, what the passes before found is written between them, so that a worker holds one group."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "langid")
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.selectExpr(*[f"`{c}`" for c in names], "0 best", "double('infinity') low", "double('infinity') second", "0L n")
    groups = model.groups()
    for i, group in enumerate(groups):
        shared = spark.sparkContext.broadcast([model.each[j] for j in group])  # up to GROUP_BYTES, or one language

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared, group: list[int] = group) -> Iterator[pa.RecordBatch]:
            each, at = shared.value, np.array([*group, 0])
            for b in batches:
                texts = b.column(names.index("text")).to_pylist()
                begin, size = 0, 0
                for i, t in enumerate(texts):
                    size += len(t or "")
                    if size > CHUNK or i + 1 == len(texts):
                        part = b.slice(begin, i + 1 - begin)
                        best, low, second = (part.column(len(names) + k).to_numpy() for k in range(3))
                        h, n = entropies(each, texts[begin : i + 1])
                        every = np.sort(np.column_stack([low, second, h]), axis=1)
                        own = h.min(1, initial=np.inf)
                        best = np.where(own < low, at[h.argmin(1) if len(group) else np.zeros(len(h), int)], best)
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(best, pa.int32()), pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(n, pa.int64())], b.schema.names)
                        begin, size = i + 1, 0

        out = out.mapInArrow(run, f"{fields}, {STATE}")
        if i + 1 < len(groups):
            out, _ = scratch.keep(out)
    return out


def identify(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    fitted = Model(model.names, [])
    fitted.slope, fitted.shift, fitted.worst = model.slope, model.shift, model.worst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, low, second, n = (b.column(k).to_numpy() for k in range(1, 5))
            lang, score, h, out = fitted.decide(best, low, second, n) if fitted.names else (["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = passed(rows, model).select("doc_id", "best", "low", "second", "n")
    out = found.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select("doc_id", (fold_remainder("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the languages outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
