"""Packing along a space-filling curve.

Each document is a vector of hashed words, projected by random signs to DIMS numbers; these are cut to BITS bits each and
give a place on a Hilbert curve. Documents are range-sorted by that key (and by a hash of id and text, so that very many equal keys still
spread over partitions), tokenised, and packed one after another: neighbours on the curve share sequences. A document
that crosses the end of a sequence is cut and goes on in the next one. What is left at the end of a partition is
cut at powers of two, so nothing is padded there either.

Edge cases: null text counts as empty; an empty document is the end id alone; repeated rows are packed each; an empty table
gives no rows; documents of any length are taken whole. Extra columns don't take part.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import doc_columns, mix64, ship, table

DIMS, BITS = 4, 8
LENGTH = 2048
END = 1
TOKENIZER = "byte_bpe_50k"
#: The tokenizer's special mark (fixed value).
MARK = "<|endoftext|>"
#: Bytes of text in one partition of the sorted documents, and partitions at most (beyond, they hold more; nothing grows in memory with them).
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
#: Texts of these characters only, without very long words or runs of white space, go to the faster of two libraries with the same result.
OTHER = re.compile("[^\x00-ɏ]")
LONG = 400


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates under 2 ** bits (Skilling's transform)."""
    x = coords.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - one
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        t ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


#: An odd number and its inverse modulo 2 ** 64: hashes of words are differences of running sums, brought back to one place.
ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers_of_odd(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ODD and of its inverse; those that a usual chunk needs are kept."""
    if not _POWERS:
        _POWERS.extend(np.cumprod(np.full(1 << 18, x, np.uint64)) for x in (ODD, BACK))
    if n <= len(_POWERS[0]):
        return _POWERS[0][:n], _POWERS[1][:n]
    return np.cumprod(np.full(n, ODD, np.uint64)), np.cumprod(np.full(n, BACK, np.uint64))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of some UTF-8 text that ends in a space.

    A word reaches to the next white space. Characters of three or four bytes, but for general punctuation, stand for
    themselves, as most scripts without spaces are written with them; they also end a word before them.
    """
    n = len(buf)
    space = buf <= 32
    lone = (buf >= 0xE0) & (buf != 0xE2)
    begins = ~space
    begins[1:] &= space[:-1] | lone[1:]
    ends = space | lone
    at = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(ends), n)
    before = np.cumsum(ends)  # stops up to and with each byte
    end = stops[before[at]]
    power, back = powers_of_odd(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf + np.uint64(1)) * power, out=total[1:])
        h = (total[end] - total[at]) * back[at]
    return at, mix64(h, 5)


def vectors(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """Random-sign projections of the hashed words of each text: means, so that length doesn't matter."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    at, h = word_hashes(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    doc = np.searchsorted(np.cumsum(lengths + 1), at, "right")
    n = np.bincount(doc, minlength=len(raw)).astype(np.float64)
    out = np.zeros((len(raw), dims))
    for i in range(dims):
        sign = ((h >> np.uint64(i)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out[:, i] = np.bincount(doc, sign, minlength=len(raw)) / np.maximum(n, 1)
    return out


def curve_keys(texts: list[str | None], chunk: int = 100_000) -> np.ndarray:
    """Hilbert keys of the texts, taken some at a time so that memory doesn't grow with the batch."""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > chunk or i + 1 == len(texts):
            parts.append(vectors(texts[begin : i + 1]))
            begin, size = i + 1, 0
    v = np.concatenate(parts) if parts else np.zeros((0, DIMS))
    squeezed = 0.5 + 0.5 * np.tanh(v * 5.0)  # a language's common words shift the mean by about 0.2
    return hilbert(np.minimum((squeezed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Encoder:
    """Ids of whole texts by the named public tokenizer. The slower library is loaded only once a text needs it."""

    def __init__(self, name: str = TOKENIZER):
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # as in the named tokenizer, the mark for the end of a text is one id wherever a text spells it out
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={MARK: len(ranks)})
        self.name, self.full = name, None

    def plain(self, text: str) -> bool:
        """Whether both libraries are known to agree, and the faster one to take linear time."""
        lengths = list(map(len, text.split()))
        if max(lengths, default=0) > LONG or len(text) - sum(lengths) > len(lengths) + LONG:
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not OTHER.search(text)

    def __call__(self, text: str) -> np.ndarray:
        if self.plain(text):
            ids = self.fast.encode(text, allowed_special={MARK}) if MARK in text else self.fast.encode_ordinary(text)
            return np.array([*ids, END], "<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array([*self.full.encode(text, add_special_tokens=False).ids, END], "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Pieces of documents that come in order. The last sequence is held back, as only the end decides how it is cut."""

    def __init__(self, part: int, length: int = LENGTH):
        self.sequence, self.length, self.fill = part << 40, length, 0
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(self.length - self.fill, len(ids) - start)
            self.open.append((doc_id, start, ids[start : start + take], len(ids)))
            self.fill += take
            start += take
            if self.fill == self.length:
                yield from self.close([self.length])

    def close(self, sizes: list[int]) -> Iterator[tuple]:
        """The open pieces, cut into sequences of these sizes."""
        offset, sizes = 0, list(sizes)
        for doc_id, start, ids, total in self.open:
            while len(ids):
                take = min(sizes[0] - offset, len(ids))
                yield doc_id, start, take, zlib.crc32(ids[:take].tobytes()), total, self.sequence, offset
                start, ids, offset = start + take, ids[take:], offset + take
                if offset == sizes[0]:
                    sizes.pop(0)
                    offset, self.sequence = 0, self.sequence + 1
        self.open, self.fill = [], 0

    def end(self) -> Iterator[tuple]:
        yield from self.close(powers(self.fill))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def along_curve(docs: DataFrame) -> DataFrame:
    """doc_id and text, range-sorted by the Hilbert key into partitions of about PART_BYTES, at most MOST_PARTS of them. The key is cheap, as sorting by range takes it twice.

    Equal keys are split by a hash of id and text.
    """
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series(curve_keys([t if isinstance(t, str) else None for t in text]))

    plain = doc_columns(docs)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    keyed = plain.withColumn("hilbert", key("text"))
    return keyed.repartitionByRange(parts, "hilbert", F.xxhash64("doc_id", "text")).sortWithinPartitions("hilbert", "doc_id")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    kinds = [pa.int64()] * len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId(), length), encoder(tokenizer)
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(packer.add(doc_id, encode(text.as_py() or "")))
                if len(rows) > 20_000:
                    yield flush()
                    rows = []
        rows.extend(packer.end())
        if rows:
            yield flush()

    return along_curve(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
