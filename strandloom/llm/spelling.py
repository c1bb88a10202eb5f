"""Groups of spelling variants, found by rolling hashes of deletions.

Words are counted where the texts are, and only distinct words with their counts are shuffled. Every word gives the
integer hash of itself and of each string that remains when one code point goes: a prefix hash plus a suffix hash moved
by one place, for all words of a batch at once in NumPy. The hashes are dealt by their leading bits into buckets of bounded size
and sorted there. Words that share the hash of a deletion at one place differ there alone; a word that has the hash of
another's deletion is that word with one code point fewer. What shares a hash is then compared as strings, so a
collision changes nothing. Groups are met by windows and joins on those strings: members get the best other member of a group, pairs are not
listed.

Edge cases: null text has no words; a null doc_id is written as the empty string in the hashed key; empty tables and tables without words of
LEAST code points give no rows; repeated rows count each; words of any length are taken whole (their hashes move, not
copies of them). Extra columns don't take part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, doc_columns, mix64, ranges, ship, table

#: Code points of the shortest word, occurrences of the rarest, and how many times as frequent a form must be.
LEAST, OFTEN, TIMES = 7, 2, 10
#: One occurrence of so many is written with a code point less.
EVERY = 31
#: Letters are A-Z, a-z and U+00C0 to U+00FF (fixed range). Shorter runs can't become words, so they aren't matched.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
LOWER = {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task holds before it hands them on; code points hashed at once; hashes in one bucket.
HELD, CHUNK, BUCKET_ROWS = 200_000, 1 << 19, 400_000
#: Base of the polynomial and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def written(doc_id: int | None, run: str) -> str:
    """The run in lower case, as this document writes it: some lose a code point, by a hash of id and run."""
    low = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    if h % EVERY:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1 :]


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about this size, cut between runs."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and (text[end].isalpha() or text[end] in "×÷"):
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def runs_of(text: str) -> Counter:
    """How often each run of letters occurs."""
    if len(text) <= 1 << 20:
        return Counter(RUN.findall(text))
    found: Counter = Counter()
    for part in slices(text):
        found.update(RUN.findall(part))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for run, n in runs_of(text.as_py() or "").items():
                word = written(doc_id, run)
                if len(word) >= LEAST:
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    ship(docs.sparkSession)
    found = doc_columns(docs).mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


def deletion_keys(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of some words, given as all their code points in a row, and of what remains when each code point goes.

    Returns the words' own hashes, the deletions' (in the order of the code points), the place of each deletion in its word, and whether it is
    the last of a run of equal code points (others of the run give the same string).
    """
    place = ranges(lengths)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max(initial=1)) - 1, BASE, np.uint64))))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64), 3) * power[place], out=total[1:])
        prefix = total[:-1] - total[begins][word]
        suffix = total[ends][word] - total[1:]
        shorter = prefix + suffix * np.uint64(BACK)
        whole = total[ends] - total[begins]
        own = mix64(whole + lengths.astype(np.uint64), 4)
        keys = mix64(shorter + (lengths[word] - 1).astype(np.uint64), 4)
    last = np.ones(len(codes), bool)
    last[:-1] = (codes[:-1] != codes[1:]) | (word[:-1] != word[1:])
    return own.view(np.int64), keys.view(np.int64), place, last


KEYS = "key long, id long, pos int, last boolean"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        own, keys, place, last = deletion_keys(codes, lengths)
        ids = np.array(ids, np.int64)
        key, owner = np.concatenate((own, keys)), np.concatenate((ids, np.repeat(ids, lengths)))
        pos, end = np.concatenate((np.full(len(own), -1), place)).astype(np.int32), np.concatenate((np.zeros(len(own), bool), last))
        for i in range(0, len(key), 1 << 17):
            part = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (key, owner, pos, end)], ["key", "id", "pos", "last"])

    for b in batches:
        ids, texts, size = [], [], 0
        for i, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(word)
            size += len(word)
            if size > CHUNK:
                yield from rows(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield from rows(ids, texts)


def _shared(rows: pa.Table) -> pa.Table:
    """Of one bucket, the rows whose hash says that they have a near word."""
    key, pos, last = rows["key"].to_numpy(), rows["pos"].to_numpy(), rows["last"].to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, key))
    key, pos, last = key[order], pos[order], last[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    # one place: rows of a hash and place, more than one
    spot = fresh.copy()
    spot[1:] |= pos[1:] != pos[:-1]
    spots = np.cumsum(spot) - 1
    same = (np.bincount(spots)[spots] > 1) & (pos >= 0)
    # one code point fewer: a hash that both a whole word and a deletion have
    wholes, cut = np.bincount(group, pos < 0)[group] > 0, np.bincount(group, last)[group] > 0
    fewer = wholes & cut & ((pos < 0) | last)
    kept = same | fewer
    back = pa.array(order[kept])
    return pa.table({"id": rows["id"].combine_chunks().take(back), "pos": pa.array(pos[kept]), "same": pa.array(same[kept]), "fewer": pa.array(fewer[kept])})


def near_words(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_near, best): of each word of known (id, word, n) that has near words, how many, and the most frequent as (less: -n, word)."""
    hashes = int(known.agg(F.sum(F.length("word") + 1)).first()[0] or 0)
    bits = max(1, math.ceil(math.log2(1 + hashes / BUCKET_ROWS)))
    keys = known.select("id", "word").mapInArrow(_keys, KEYS)
    shared = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("bucket")).applyInArrow(_shared, "id long, pos int, same boolean, fewer boolean")
    # from here on strings decide
    left = F.when(F.col("pos") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, pos)"), F.expr("substring(word, pos + 2)")))
    rows, _ = scratch.keep(shared.join(known, "id").withColumn("rest", left))
    order = Window.partitionBy("rest", "pos").orderBy(F.col("n").desc(), "word")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("less"), "word")
    replaced = (
        rows.filter("same")
        .select("id", F.row_number().over(order).alias("rank"), F.count("*").over(every).alias("size"), F.first(one).over(every).alias("first"), F.nth_value(one, 2).over(every).alias("second"))
        .filter("size > 1")
        .select("id", (F.col("size") - 1).alias("n"), F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))
    )
    shorter = rows.filter("fewer and pos < 0").select("rest", F.col("id").alias("b"), one.alias("short"))
    longer = rows.filter("fewer and pos >= 0").select("rest", F.col("id").alias("a"), one.alias("long"))
    linked = longer.join(shorter, "rest")
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("short").alias("best")), F.struct(F.col("b").alias("id"), F.col("long").alias("best")))).alias("x")
    inserted = linked.select(both).select("x.id", F.lit(1).cast("long").alias("n"), "x.best")
    return replaced.unionByName(inserted).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """(word, root): the last of the words reached from each word over forms (word, form), in chains of at most so many steps."""
    now, path = scratch.keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far, later = scratch.keep(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        scratch.drop(path)
        now, path = far, later
    return now


def variants(docs: DataFrame) -> DataFrame:
    """One row a word: its form, the root of its chain of forms, its count, how many near words it has, and the form's count."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    known, _ = scratch.keep(words(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    found = known.join(near_words(known, scratch), "id", "left")
    common = -F.col("best.less") >= TIMES * F.col("n")
    found, _ = scratch.keep(
        found.select("word", F.when(common, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"))
    )
    # each form is TIMES as frequent as its word at least, which bounds the chains
    most = found.agg(F.max("n")).first()[0] or 1
    last = roots(found.filter("form is not null"), 1 + math.ceil(math.log(most, TIMES)), scratch)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and root."""
    return variants(table(spark, sf_dir, "documents"))
