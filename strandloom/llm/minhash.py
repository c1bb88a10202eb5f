"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

A text is its set of shingles of WORDS words (lower case, punctuation aside), each with a weight; similarity is the sum of
the smaller weights over the sum of the larger ones, which for the default weight of one is the Jaccard index. Darts are
thrown at the region of each shingle (its weight by time) by a Poisson process seeded with the shingle's hash, so that
the same darts hit the same region in every document. A dart falls on one of K coordinates; the earliest dart of
each coordinate is the signature. Only about K log K darts are needed, however many shingles a text has.

Signatures are cut into bands. Exact copies are reduced to one representative first, by a digest of the whole text. In each
bucket of a band every member is compared with the bucket's centre, and links that hold join components. Only buckets whose
members are still in several components go on: their members meet with their sets, in blocks, and a block returns a
spanning forest of its links. So every pair of a bucket is compared or joined already, no component is missed, and no
pairs are listed, however large a group is. Comparisons are exact, on the shingle sets.

Edge cases: null texts and texts without a word are like nothing and form classes of their own; texts of fewer than WORDS
words are one shingle; a doc_id may come with several texts, each of which is compared and has a class of its own; every row gives one row, and of the
rows of a class those with its smallest doc_id, and there its smallest digest, are kept; extra columns don't take part; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import BROADCAST_IDS, Scratch, components, doc_columns, mix64, ranges, ship, table, unit_floats

WORDS = 5
SIMILAR = 0.8
K, BANDS = 100, 25
TOKEN = re.compile(r"\w+")
BATCH_SHINGLES = 200_000


class Hashes(dict):
    """crc32 of each word met; emptied when full, so that its memory is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 60_000:
            self.clear()
        self[w] = h = zlib.crc32(w.encode()) | zlib.adler32(w.encode()) << 32
        return h


HASHES = Hashes()


def shingle_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes in order, and how often each occurs."""
    words = TOKEN.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = mix64(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)))
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(WORDS, len(w))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h = np.sort(mix64(h, 1))
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h)))


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], k: int = K) -> np.ndarray:
    """DartMinHash of each non-empty weighted set: rows of k 64-bit values.

    The region of an element of weight w is cut into cells of weight 1, each hit by darts at exponential times from the
    cell's own hash stream; a dart beyond w in the last cell misses. Times go on until every coordinate has a dart.
    """
    docs = len(sets)
    cells = [np.ceil(w).astype(np.int64) for w in weights]
    element = np.concatenate([np.repeat(s, c) for s, c in zip(sets, cells, strict=True)])
    full = np.concatenate([np.repeat(w, c) for w, c in zip(weights, cells, strict=True)])
    cell = ranges(np.concatenate(cells))
    doc = np.repeat(np.arange(docs), [int(c.sum()) for c in cells])
    state = mix64(element + cell.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 2)
    room = np.minimum(full - cell, 1.0)
    cut = bool((room < 1).any())
    total = np.array([w.sum() for w in weights])
    limit = k * (np.log(k) + 2) / total
    time = np.zeros(len(state))
    best = np.full((docs, k), np.inf)
    value = np.zeros((docs, k), np.uint64)
    live = np.arange(len(state))
    while len(live):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        later = []
        while len(live):
            stream = mix64(state[live], 3)
            arrival = time[live] - np.log(unit_floats(stream))
            hit = arrival < limit[doc[live]]
            later.append(live[~hit])  # its next dart comes after the limit, and is drawn again if the limit grows
            live, stream = live[hit], stream[hit]
            time[live] = arrival[hit]
            state[live] = stream
            where = mix64(stream, 4)
            i = live
            if cut:
                inside = unit_floats(mix64(stream, 5)) < room[live]
                i, where = live[inside], where[inside]
            found.append((doc[i] * k + (where % np.uint64(k)).astype(np.int64), time[i], where))
        slot = np.concatenate([f[0] for f in found])
        when = np.concatenate([f[1] for f in found])
        what = np.concatenate([f[2] for f in found])
        np.minimum.at(best.ravel(), slot, when)
        earliest = when == best.ravel()[slot]
        value.ravel()[slot[earliest]] = what[earliest]
        short = np.isinf(best).any(1)
        limit = np.where(short, limit * 2, -1.0)
        live = np.concatenate(later) if later else live
        live = np.sort(live[short[doc[live]]])
    return value


def band_keys(value: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = value.shape[1] // bands
    out = np.zeros((len(value), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(value), b + 1, np.uint64)
            for r in range(rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + value[:, b * rows + r])
            out[:, b] = h
    return out


def weigh(counts: np.ndarray, weighting: str) -> np.ndarray:
    """one: each distinct shingle alike; count: by how often it occurs; log: 1 + ln of that."""
    if weighting == "count":
        return counts.astype(np.float64)
    return 1 + np.log(counts) if weighting == "log" else np.ones(len(counts))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two sorted sets with weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


SIGNED = "doc_id long, digest string, n int, bands array<long>"

def signed(docs: DataFrame, weighting: str) -> DataFrame:
    """doc_id, digest, number of shingles and band keys of each text with a word. Only these leave the executors, no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            part: list[tuple[int, str, np.ndarray, np.ndarray]] = []
            size = 0
            for k, doc_id in enumerate(ids):
                h, c = shingle_hashes(texts[k].as_py())
                if len(h):
                    part.append((doc_id, digests[k], h, weigh(c, weighting)))
                    size += len(h)
                if part and (size > BATCH_SHINGLES or k + 1 == len(ids)):
                    keys = band_keys(signatures([p[2] for p in part], [p[3] for p in part])).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.string()), pa.array([len(p[2]) for p in part], pa.int32()), lists], ["doc_id", "digest", "n", "bands"])
                    part, size = [], 0

    return docs.filter("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(run, SIGNED)


def texts_of(docs: DataFrame, wanted: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """node and text of the nodes in wanted (node). reps: node, rep (the doc_id it is read from), digest, rows (so many rows hold it).

    What a join then meets is a shuffle of rows as they were read, which can be split at a hot node: only texts of repeated rows are aggregated.
    """
    ids, _ = scratch.keep(wanted.distinct().join(reps, "node"))
    small = (lambda x: F.broadcast(x)) if ids.count() <= BROADCAST_IDS else (lambda x: x)

    def read(ids: DataFrame) -> DataFrame:
        # three numbers a node are sent; the texts of one id are told apart by a hash of their digests
        found = docs.join(small(ids.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.xxhash64(F.sha2("text", 256)).alias("h"), "text")
        return found.join(small(ids.select("rep", F.xxhash64("digest").alias("h"), "node")), ["rep", "h"]).select("node", "text")

    texts, twice = read(ids.filter("rows = 1")), ids.filter("rows > 1")
    return texts if twice.isEmpty() else texts.unionByName(read(twice).dropDuplicates(["node"]))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similar: float, weighting: str, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose exact similarity reaches the bound."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")), reps, scratch)
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("s"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def get(rep: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            if rep not in seen:
                if len(seen) > 2000:
                    seen.clear()
                h, c = shingle_hashes(text.as_py())
                seen[rep] = (h, weigh(c, weighting))
            return seen[rep]

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            sims = np.array([similarity(get(x, b.column(2)[k]), get(y, b.column(3)[k])) for k, (x, y) in enumerate(zip(u, v, strict=True))])
            ok = np.flatnonzero(sims >= similar - 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in ok], pa.int64()), pa.array([v[k] for k in ok], pa.int64()), pa.array(sims[ok], pa.float64())], ["u", "v", "similarity"])

    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "s", "t")
    return joined.mapInArrow(run, "u long, v long, similarity double")


#: Members of a block and bytes of their sets, and bytes of the blocks that meet in one group.
BLOCK, BLOCK_BYTES, GROUP_BYTES = 1024, 24_000_000, 6_000_000


def blob(h: np.ndarray) -> bytes:
    """Six bytes of each hash of a set."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unblob(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of the incidence of shared elements, some columns at a time."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1
    rank = np.cumsum(several) - 1
    keep = several[column]
    column, owner = rank[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [begin, begin + 4096])
        inc = np.zeros((len(sets), min(4096, width - begin)), np.float32)
        inc[owner[lo:hi], column[lo:hi] - begin] = 1
        out += inc @ inc.T
    return out


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of the rows whose component, under the symmetric link matrix, starts at an earlier row."""
    n = len(links)
    label = np.arange(n)
    while True:
        low = np.where(links, label[None, :], n).min(1) if n else label
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def alike(sets: list[np.ndarray], weights: list[np.ndarray] | None, similar: float) -> np.ndarray:
    """Which pairs reach the bound."""
    if weights is not None:
        return np.array([[i != j and similarity((a, v), (b, w)) >= similar - 1e-12 for j, (b, w) in enumerate(zip(sets, weights, strict=True))] for i, (a, v) in enumerate(zip(sets, weights, strict=True))])
    n = np.array([len(x) for x in sets], np.float64)
    both = overlaps(sets)  # whole numbers, exact in single precision
    # both >= similar * (n + m - both), solved for both
    out = both >= (similar / (1 + similar)) * (n[:, None] + n[None, :]) - 1e-7
    np.fill_diagonal(out, False)
    return out


def compared(members: DataFrame, docs: DataFrame, reps: DataFrame, similar: float, weighting: str, scratch: Scratch) -> DataFrame:
    """Links (u, v) that join what is alike among the members (band, node, own) of open buckets.

    Each member takes its set along; a bucket of more than BLOCK members, or of more than BLOCK_BYTES, becomes pairs of blocks. All pairs of a block are
    compared where they are, by matrix products, and only a spanning forest of the links is returned, never the pairs.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([blob(h) for h, _ in found], pa.binary()), pa.array([b"" if weighting == "one" else c.astype(np.int32).tobytes() for _, c in found], pa.binary())], ["node", "shingles", "counts"])

    texts = texts_of(docs, members.select("node"), reps, scratch)
    known, _ = scratch.keep(texts.mapInArrow(sets, "node long, shingles binary, counts binary"))
    sizes = known.select("node", (F.length("shingles") + F.length("counts")).alias("bytes"))
    sized, _ = scratch.keep(members.join(sizes, "node"))
    buckets, _ = scratch.keep(sized.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK // 2), F.sum("bytes") / F.lit(BLOCK_BYTES // 2))).cast("int").alias("blocks")))
    blocks = sized.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "own", "band", "bytes", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = dealt.join(known, "node")
    total = dealt.agg(F.sum("bytes")).first()[0] or 0
    groups = max(1, int(total) // GROUP_BYTES)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, own, band, i, j = (t.column(c).to_numpy() for c in ("node", "own", "band", "i", "j"))
        data, counts = t.column("shingles").to_pylist(), t.column("counts").to_pylist()
        order = np.lexsort((node, j, i, band))
        parts = np.flatnonzero(np.concatenate(([True], (np.diff(band[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))) if len(order) else []
        u, v = [], []
        for part in np.split(order, parts[1:]) if len(order) else []:
            if len(part) < 2 or (own[part] == own[part[0]]).all():
                continue
            hashes = [unblob(data[k]) for k in part]
            w = None if weighting == "one" else [weigh(np.frombuffer(counts[k], np.int32).astype(np.int64), weighting) for k in part]
            if w is not None:
                hashes, w = zip(*[(h[o], x[o]) for h, x in zip(hashes, w, strict=True) for o in [np.argsort(h)]], strict=True)
            moved, root = forest(alike(list(hashes), w if w is None else list(w), similar))
            u += node[part[moved]].tolist()
            v += node[part[root]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.withColumn("g", F.pmod(F.xxhash64("band", "i", "j"), F.lit(groups))).groupBy("g").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, weighting: str = "one") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), copy_of (smallest doc_id with the very same text), kept, digest of the text: one row for each of docs.

    What is compared is texts, each a node with a number of its own; ids only name them.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    plain = doc_columns(docs)
    every, _ = scratch.keep(signed(plain, weighting))
    # written, so that joins by a hot digest can be split
    rows = every.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    reps, _ = scratch.keep(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "rows")).alias("x")).select(F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("rep"), "digest", F.col("x.rows").alias("rows")))
    own = every.join(reps.select("node", "digest", F.col("rep").alias("doc_id"), "rows"), ["digest", "doc_id"])
    keys = own.filter("rows = 1").select("node", "bands").unionByName(own.filter("rows > 1").select("node", "bands").dropDuplicates(["node"]))
    keys, _ = scratch.keep(keys.select("node", F.explode("bands").alias("band")))
    # the same order everywhere, so that the buckets of a large group mostly have the same centre
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))).alias("c")
    # the aggregates of bands are written before they are joined: a join that doesn't share its shuffle with them can be split at hot bands
    centres, _ = scratch.keep(keys.groupBy("band").agg(lead, F.count("*").alias("size")).filter("size > 1").select("band", F.col("c.node").alias("centre")))
    full, _ = scratch.keep(keys.join(centres, "band").select("band", "node", "centre"))
    pairs, _ = scratch.keep(full.filter("node <> centre").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct())
    links = verified(pairs, plain, reps, similar, weighting, scratch).select("u", "v")
    edges, _ = scratch.keep(components(links, scratch).filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = full.select("band", "node").join(edges.select(F.col("u").alias("node"), F.col("v").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    states, _ = scratch.keep(roots.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("band"))
    still, _ = scratch.keep(roots.join(states, "band"))
    more, _ = scratch.keep(compared(still, plain, reps, similar, weighting, scratch))
    joined, _ = scratch.keep(components(edges.unionByName(more), scratch))
    # a class is named by the smallest doc_id in it, and stands for itself by that one's text
    grouped, _ = scratch.keep(reps.join(joined, "node"))
    heads, _ = scratch.keep(grouped.groupBy("root").agg(F.min(F.struct(F.col("rep").alias("class_id"), F.col("digest").alias("head"))).alias("x")).select("root", "x.*"))
    several = grouped.join(heads, "root").select("node", "class_id", (F.col("digest") == F.col("head")).alias("first"))
    classes, _ = scratch.keep(reps.join(several, "node", "left").select("digest", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first", F.lit(True)).alias("first")))
    out = plain.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.sha2("text", 256)).alias("digest")).join(classes, "digest", "left")
    kept = F.coalesce(F.col("first") & (F.col("doc_id") == F.col("copy_of")), F.lit(True))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), kept.alias("kept"), "digest")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest")
