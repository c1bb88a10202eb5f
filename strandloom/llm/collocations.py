"""Phrases whose words occur together more often than chance, found by counting passes over hashed buckets.

One pass over the texts for each phrase length. A pass counts exactly, as strings, only phrases that can still be frequent: both
phrases of one word fewer in them are frequent, and the bucket that they fall into holds enough phrases. While it does so it counts
the buckets of the next length, of phrases that can be made of what is left. What the next pass needs to know of this one
are two bitmaps of fixed size: the buckets that are full enough, and the hashes of the phrases that are frequent. Both only rule phrases out, so a
collision costs a count and changes no result; with more phrases than bits they rule out less.

Words of a chunk of text are numbered, their hashes combined along each phrase, and phrases counted by sorting those; where one hash stands
for two phrases, they are told apart by the words' numbers. Spark adds the counts of all chunks up by language and phrase.

Edge cases: null text counts as empty, a null lang as OTHER; repeated rows count each; phrases never cross documents or pieces; empty tables give no
rows; texts of any length are read whole, in parts. Extra columns don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, mix64, ship, sorted_unique, table

#: Occurrences of a frequent phrase, words of the longest, and phrases that are reported for a language.
OFTEN, LONGEST, TOP = 100, 5, 2000
OTHER = "und"
#: A bitmap has 2 ** BITS bits: half a megabyte, whatever the input. Bits of it that one task collects.
BITS = 22
SEGMENT = 1 << 15
#: Bytes of text that are counted at once.
CHUNK = 6 << 20
#: Languages are dealt to so many parts each before the first TOP of all are taken.
SALTS = 64
#: What ends a piece, and what stands for it: a byte that UTF-8 doesn't have.
ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
SPLIT = bytes.maketrans(ENDS + b"\t", BREAK * len(ENDS) + b" ")
#: Kinds of counts.
PHRASE, BUCKET, WORDS = 0, 1, 2
COUNTS = "kind int, lang string, phrase string, slot int, n long"
NAMES = ["kind", "lang", "phrase", "slot", "n"]


class Numbers(dict):
    """Numbers of words in the order met; the break is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.words = [BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def bit_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(h, 6) >> np.uint64(64 - bits)).astype(np.int64)


class Bitmap:
    """A set of slots, as bits."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return ((self.data[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


class Chunk:
    """Some text of one language as numbered words, with the hashes of the phrases that begin at each."""

    def __init__(self, lang: str, texts: list[bytes], bits: int = BITS):
        numbers, self.lang, self.bits = Numbers(), lang, bits
        cut = (b" " + BREAK + b" ").join(texts).lower().translate(SPLIT).replace(BREAK, b" " + BREAK + b" ")
        tokens = cut.split()
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        self.words = numbers.words
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.word = self.hashes[self.ids]
        self.inside = self.ids > 0
        self.h, self.ok = self.word, self.inside

    def longer(self) -> None:
        """Goes from phrases of some length to those of one word more."""
        n, m = len(self.h) - 1, len(self.ids) - len(self.h) + 1
        with np.errstate(over="ignore"):
            self.h = mix64(self.h[:n], 8) + self.word[m : m + n]
        self.ok = self.ok[:n] & self.inside[m : m + n]

    def made_of(self, kept: np.ndarray) -> np.ndarray:
        """Which of the longer phrases hold kept ones at both ends."""
        return kept[:-1] & kept[1:]

    def counts(self, at: np.ndarray, m: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct phrases of m words that begin there, their slots, and how often each does."""
        order = at[np.argsort(self.h[at], kind="stable")]
        h = self.h[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = h[1:] != h[:-1]
        for j in range(m):  # one hash may stand for two phrases: then words decide
            if ((self.ids[order[1:] + j] != self.ids[order[:-1] + j]) & ~fresh[1:]).any():
                rows = self.ids[at[:, None] + np.arange(m)]
                order = at[np.lexsort(rows.T[::-1])]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (np.diff(self.ids[order[:, None] + np.arange(m)], axis=0) != 0).any(1)
                break
        first = np.flatnonzero(fresh)
        words, begin = self.words, order[first]
        columns = [self.ids[begin + j].tolist() for j in range(m)]
        phrases = [b" ".join([words[i] for i in row]) for row in zip(*columns, strict=True)] if m > 1 else [words[i] for i in columns[0]]
        return phrases, bit_of(self.h[begin], self.bits), np.diff(np.append(first, len(order)))

    def buckets(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the phrases that begin there, and how many fall into each."""
        slots = np.sort(bit_of(self.h[at], self.bits))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(slots)), bool), slots[1:] != slots[:-1])))
        return slots[first], np.diff(np.append(first, len(slots)))


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about this size, cut at the end of pieces."""
    begin = 0
    while len(text) - begin > size:
        found = re.compile(b"[" + re.escape(ENDS) + b"]").search(text, begin + size)
        if not found:
            break
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


def chunks_of(batches: Iterator[pa.RecordBatch], size: int = CHUNK, bits: int = BITS) -> Iterator[Chunk]:
    """All texts, collected by language until there is enough of one."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_buffer()
            for part in parts_of(raw.to_pybytes(), size) if raw is not None and raw.size else ():
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] > size or sum(sizes.values()) > 2 * size:
                    most = max(sizes, key=sizes.__getitem__)
                    sizes.pop(most)
                    yield Chunk(most, held.pop(most), bits)
    for lang, texts in held.items():
        yield Chunk(lang, texts, bits)


def one_pass(docs: DataFrame, m: int, often: int, frequent: bytes | None, full: bytes | None, last: int, chunk: int, bits: int) -> DataFrame:
    """Counts of phrases of m words and of the buckets of one word more. From the pass before: the hashes of frequent phrases, and the buckets of m words that are full enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches, chunk, bits):
            for _ in range(m - 2):
                c.longer()
            may = c.ok
            if frequent is not None:
                hit = among(c, may, Bitmap(frequent))
                c.longer()
                may = among(c, c.made_of(hit) & c.ok, Bitmap(full))
            phrases, slots, n = c.counts(np.flatnonzero(may), m)
            k = len(phrases)
            yield _rows([PHRASE] * k, [c.lang] * k, pa.array(phrases, pa.binary()).view(pa.string()), slots, n)
            if m == 1:
                yield _rows([WORDS], [c.lang], pa.nulls(1, pa.string()), [-1], [int(c.inside.sum())])
            if m < last:
                may = c.made_of(may)
                c.longer()
                slots, n = c.buckets(np.flatnonzero(may & c.ok))
                yield _rows([BUCKET] * len(slots), pa.nulls(len(slots), pa.string()), pa.nulls(len(slots), pa.string()), slots, n)

    counted = docs.mapInArrow(run, COUNTS).groupBy(*NAMES[:-1]).agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= often) | (F.col("kind") == WORDS))


def among(c: Chunk, may: np.ndarray, slots: Bitmap) -> np.ndarray:
    """Those of the phrases whose slot is in a bitmap."""
    at = np.flatnonzero(may)
    hit = np.zeros(len(may), bool)
    hit[at] = slots[bit_of(c.h[at], c.bits)]
    return hit


def _rows(kind, lang, phrase, slot, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(lang, pa.string()), phrase, pa.array(slot, pa.int32()), pa.array(n, pa.int64())], NAMES)


def bitmap(slots: DataFrame, bits: int = BITS) -> bytes:
    """The bitmap of slots in a table (slot): its segments are made on executors; 2 ** bits bits in all come here."""

    def segment(rows: pa.Table) -> pa.Table:
        at = sorted_unique(rows["slot"].to_numpy().astype(np.int64))
        full = np.zeros(SEGMENT, bool)
        full[at % SEGMENT] = True
        return pa.table({"segment": pa.array([int(at[0]) // SEGMENT], pa.int32()), "bits": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(max(1 << bits, SEGMENT) // 8)
    by_segment = slots.distinct().groupBy(F.floor(F.col("slot") / SEGMENT).alias("s")).applyInArrow(segment, "segment int, bits binary")
    for row in by_segment.collect():
        out[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = row.bits
    return bytes(out)


def frequent_phrases(docs: DataFrame, often: int = OFTEN, longest: int = LONGEST, scratch: Scratch | None = None, chunk: int = CHUNK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to so many words that occur often enough, and (lang, n) of all words. docs: lang, text."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    ship(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(OTHER)).alias("lang"), F.col("text").cast("string").alias("text"))
    found, frequent, full = [], None, None
    for m in range(1, longest + 1):
        counted, _ = scratch.keep(one_pass(plain, m, often, frequent, full, longest, chunk, bits))
        phrases = counted.filter(F.col("kind") == PHRASE)
        found.append(phrases.select("lang", "phrase", F.lit(m).alias("m"), F.col("n").alias("f")))
        if m == 1:
            words = counted.filter(F.col("kind") == WORDS).select("lang", "n")
        if m < longest:
            frequent, full = bitmap(phrases.select("slot"), bits), bitmap(counted.filter(F.col("kind") == BUCKET).select("slot"), bits)
    return reduce(DataFrame.unionByName, found), words


def collocations(docs: DataFrame, often: int = OFTEN, longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """The first phrases of each language by score: the least, over all cuts in two, of how much more often the parts meet than they would by chance (in thousandths)."""
    scratch = Scratch(docs.sparkSession, "collocations")
    found, words = frequent_phrases(docs, often, longest, scratch, chunk, bits)
    phrases = found.filter("m > 1")
    # a phrase goes if one of one word more holds it and is as frequent; still longer ones hold such a one
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)")))
    held = phrases.filter("m > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = phrases.join(held, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * f").select("lang", "phrase", "m", F.col("f").alias("a"))
    # every part of a phrase is at least as frequent as the phrase, so its count is known
    cut = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    parts = alone.select("lang", "phrase", "m", "a", cut).withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - m)"))
    known = found.select("lang", F.col("phrase").alias("part"), "f")
    parts = parts.join(known.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    wide = "cast(1000 as decimal(4, 0)) * (cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    scored = parts.join(words, "lang").withColumn("score", F.expr(wide).cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0), (SELECT unnest([1, 2, 3, 4, 5]) AS m)
  WHERE i + m - 1 <= len(w)
), found AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') AS lp, array_to_string(string_split(c.phrase, ' ')[k + 1 : c.m], ' ') AS rp
  FROM found c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE c.m > 1 AND k < c.m
    AND NOT EXISTS (SELECT 1 FROM found d WHERE d.lang = c.lang AND d.m > c.m AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.f >= 100 * c.f)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN found x ON x.lang = cuts.lang AND x.phrase = lp JOIN found y ON y.lang = cuts.lang AND y.phrase = rp JOIN total ON total.lang = cuts.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
