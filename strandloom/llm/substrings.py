"""Exact repeated substrings: difference-cover suffix sorting, one bucket of suffixes at a time.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id. All strings of SPAN bytes are
dealt into buckets by an anchor: the leftmost of their GRAM-byte grams with the smallest hash. Equal strings have equal
anchors at equal offsets, so they meet in one bucket, and neighbouring strings mostly share an anchor, so that only about one
position in (SPAN - GRAM + 2) / 2 is moved.

1. Documents are dealt into batches by a hash of the id. Each batch sends the hashes of its anchors, once each, with
   a mark for those of several documents.
2. Each bucket of hashes returns to every batch those that some other document has too. Most text ends here.
3. For the rest a batch sends contexts: the bytes that the strings of an anchor span, once for each distinct context, with the
   smallest id that has it. Long ties, such as copies, so come once a batch.
4. Each bucket of contexts is a suffix bucket, sorted at a time. Equal contexts are taken once. The suffixes at all their offsets are sorted together:
   by their first PERIOD bytes, and those that tie there by ranks computed before. These are ranks of the suffixes at offsets in a difference cover:
   any two suffixes have a shift under PERIOD that brings both into it, so the order of two that tie is that of their ranks at this shift, however long
   the tie. Neighbours in order that share SPAN bytes are equal strings; the smallest id of each is returned as a bit.
5. Batches mark bytes, and give digests.

Memory is bounded by the sizes of a batch and of a bucket. A batch stays the same as the corpus grows, and so does a bucket but for
contexts that very many batches share: these come to their bucket once a batch.

Edge cases: null text counts as empty; rows with a null id lose nothing and are no source; rows that repeat an id
are one document, so they don't take from each other; texts of any length are taken whole; ties (equal ids) never
remove; extra columns don't take part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import doc_columns, mix64, ship, table

SPAN, GRAM = 50, 16
GRAMS = SPAN - GRAM + 1
WIDTH = SPAN + GRAMS - 1
BATCH_BYTES = 1_500_000
BUCKET_ANCHORS = 150_000
#: Suffixes that are sorted at a time.
BLOCK_SUFFIXES = 200_000
PERIOD = 16
DEPTH = 4
#: Rows of contexts with room behind them for words and names that begin near their end.
WIDE = -(-(WIDTH + PERIOD) // 8) * 8 + 8
POSITION_BITS = 32
NONE = np.iinfo(np.int64).max


def difference_cover(period: int) -> list[int]:
    """Residues such that each difference modulo period occurs between two of them, found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda x: (len(missing & ({(x - c) % period for c in cover} | {(c - x) % period for c in cover})), -x))
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)


class Batch:
    """The documents of a batch as one run of bytes, and their anchors."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.raw = [(t or "").encode() for t in texts]
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.array([NONE if i is None else i for i in ids], np.int64)
        data = b"".join(self.raw)
        self.buf = np.frombuffer(bytes(WIDTH) + data + bytes(WIDTH + 8), np.uint8)
        n = len(data)
        self.anchor = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        strings = np.maximum(self.size - SPAN + 1, 0)
        if not strings.sum():
            return
        words = np.ndarray((n + WIDTH,), "<u8", self.buf.data, WIDTH, (1,))
        with np.errstate(over="ignore"):
            h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += words[GRAM - 8 : GRAM - 8 + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        low_bits = np.uint64((1 << POSITION_BITS) - 1)
        low = (h & ~low_bits) | np.arange(n, dtype=np.uint64)  # the smallest hash, and of equal ones the leftmost
        reach = 1
        while 2 * reach <= GRAMS:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if GRAMS > reach:
            low = np.minimum(low[: len(low) - (GRAMS - reach)], low[GRAMS - reach :])
        owner = np.repeat(np.arange(len(self.raw)), strings)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings) + self.start[owner]
        chosen = (low[at] & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]))))
        last = np.append(first[1:], len(at)) - 1
        self.anchor, self.doc = chosen[first], owner[first]
        self.low = at[first] - self.anchor + GRAMS - 1  # offsets of the strings in the context, which starts GRAMS - 1 before the anchor
        self.high = at[last] - self.anchor + GRAMS - 1
        self.hash = mix64(h[self.anchor], 7)  # chosen for being small, so mixed again before it deals out buckets
        known = self.ids[self.doc] != NONE
        if not known.all():
            self.anchor, self.doc, self.low, self.high, self.hash = (x[known] for x in (self.anchor, self.doc, self.low, self.high, self.hash))

    def distinct(self) -> np.ndarray:
        """Hashes of the anchors, once each; the lowest bit tells whether several documents of the batch have it."""
        key = short(self.hash)
        order = np.lexsort((self.ids[self.doc], key))
        k, d = key[order], self.ids[self.doc[order]]
        if not len(k):
            return k
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        end = np.append(at[1:], len(k)) - 1
        return (k[at] << np.uint64(1)) | (d[at] != d[end]).astype(np.uint64)

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the anchors among shared hashes: order of the anchors, group of each, and for each group its bytes, offsets, smallest id and hash."""
        pick = np.flatnonzero(member(short(self.hash), shared))
        rows = self.buf[(self.anchor[pick] - (GRAMS - 1) + WIDTH)[:, None] + np.arange(WIDTH)[None, :]]
        column = np.arange(WIDTH)[None, :]
        rows = np.where((column >= self.low[pick][:, None]) & (column < self.high[pick][:, None] + SPAN), rows, 0).astype(np.uint8)
        wide = np.zeros((len(pick), (WIDTH + 9) // 8 * 8), np.uint8)
        wide[:, :WIDTH] = rows
        wide[:, WIDTH] = self.low[pick]
        wide[:, WIDTH + 1] = self.high[pick]
        h = np.zeros(len(pick), np.uint64)
        with np.errstate(over="ignore"):
            for w in wide.view("<u8").T:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
        order = np.lexsort((self.anchor[pick], self.ids[self.doc[pick]], h))
        pick, wide, h = pick[order], wide[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (wide[1:] != wide[:-1]).any(1))) if len(pick) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return pick, np.cumsum(new) - 1, wide[at, : WIDTH + 2], self.ids[self.doc[pick[at]]], self.hash[pick[at]]


def short(h: np.ndarray) -> np.ndarray:
    """47 bits of each hash: with a mark, six bytes."""
    return h >> np.uint64(17)


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among sorted known ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def shared_hashes(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Of the marked hashes of each batch, those that several documents have."""
    every = np.concatenate(parts)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")
    key = every[order] >> np.uint64(1)
    same = np.concatenate(([False], key[1:] == key[:-1]))
    twice = same.copy()
    twice[:-1] |= same[1:]
    twice |= (every[order] & np.uint64(1)) == 1
    kept, owner = key[twice], part[order[twice]]
    order = np.argsort(owner, kind="stable")
    kept, counts = kept[order], np.bincount(owner, minlength=len(parts))
    return np.split(kept, np.cumsum(counts)[:-1])


def shifts(cover: list[int], period: int = PERIOD) -> np.ndarray:
    """For each pair of residues the least shift that brings both into the cover; a set that isn't a difference cover has none for some pair."""
    inside = np.isin(np.arange(2 * period) % period, cover)
    out = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            both = np.flatnonzero(inside[a : a + period] & inside[b : b + period])
            if not len(both):
                raise ValueError(f"no shift brings {a} and {b} into {cover}")
            out[a, b] = both[0]
    return out


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks by keys, the first of which counts most; equal ones share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Suffixes:
    """Contexts as rows of bytes, all suffixes of which can be compared: by big-endian words, and by the ranks of cover suffixes."""

    def __init__(self, rows: np.ndarray):
        self.bytes = np.zeros((len(rows), WIDE), np.uint8)
        self.bytes[:, :WIDTH] = rows
        self.flat = np.ndarray((max(0, self.bytes.size - 7),), ">u8", self.bytes.data, 0, (1,))
        self.of: np.ndarray = np.zeros(0, np.int64)
        self.rank = np.zeros((0, 0), np.int64)

    def word(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Eight bytes of each of the rows, in the order of texts."""
        return self.flat[row * WIDE + at].astype(np.uint64)

    def rank_cover(self, some: np.ndarray, cover: list[int]) -> None:
        """Ranks of the suffixes of some rows that begin at an offset in the cover, cut at DEPTH names: names of PERIOD bytes, each followed by the one PERIOD bytes on, which is in the cover too.

        DEPTH names are more than SPAN bytes, so what the cut leaves undecided shares a whole string.
        """
        at = np.array([o for o in range(WIDTH) if o % PERIOD in cover])
        row = np.repeat(some, len(at))
        col = np.tile(at, len(some))
        names = np.zeros((len(some), WIDTH + DEPTH * PERIOD), np.int64)
        names[:, at] = dense([self.word(row, col), self.word(row, col + 8)]).reshape(len(some), -1) + 1
        at = at[at < GRAMS + PERIOD]  # no offset is further than GRAMS - 1, no shift reaches PERIOD
        self.rank = np.zeros((len(some), GRAMS + PERIOD), np.int64)
        self.rank[:, at] = dense([names[:, at + k * PERIOD].ravel() for k in range(DEPTH)]).reshape(len(some), -1)
        self.of = np.full(len(self.bytes), -1, np.int64)
        self.of[some] = np.arange(len(some))

    def order(self, row: np.ndarray, at: np.ndarray, group: np.ndarray, cover: list[int]) -> np.ndarray:
        """Order of suffixes within groups (numbers from 0) of which all share PERIOD bytes.

        A suffix comes after as many of each residue as are smaller than it: both are compared by their ranks at the shift that brings the two
        residues into the cover. Suffixes of one residue so are in order at once, and are met by binary search.
        """
        shift, most = shifts(cover), int(self.rank.max()) + 2
        kind, line = at % PERIOD, self.of[row]
        members = [np.flatnonzero(kind == r) for r in range(PERIOD)]
        key = lambda x, d: group[x] * most + self.rank[line[x], at[x] + d]
        place = np.zeros(len(row), np.int64)
        for b, y in enumerate(members):
            if not len(y):
                continue
            before = np.concatenate(([0], np.cumsum(np.bincount(group[y], minlength=int(group.max()) + 1))))
            known: dict[int, np.ndarray] = {}
            for a, x in enumerate(members):
                if len(x):
                    d = int(shift[a, b])
                    if d not in known:
                        known[d] = np.sort(key(y, d))
                    place[x] += np.searchsorted(known[d], key(x, d)) - before[group[x]]
        return np.lexsort([place, group])


def earlier(rows: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, cover: list[int] | None = None, block: int = 0) -> np.ndarray:
    """For each context a bit mask of the offsets whose string also starts in a context with a smaller id.

    The suffixes at all offsets are sorted together, a block of them (by their first bytes) at a time: by their first PERIOD bytes, and those that
    tie by cover ranks. Neighbours in order that share SPAN bytes are equal strings.
    """
    cover, block = COVER if cover is None else cover, block or BLOCK_SUFFIXES
    bits = np.zeros(len(rows), np.uint64)
    s = Suffixes(rows)
    size = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]
    first = s.word(row, at)
    parts = max(1, -(-len(row) // block))
    cuts = np.unique(np.quantile(first[:: max(1, len(first) // 10_000)], np.arange(1, parts) / parts, method="lower")) if parts > 1 else np.zeros(0, np.uint64)
    of = np.searchsorted(cuts, first, "right")
    blocks = []
    for k in range(len(cuts) + 1):
        x = np.flatnonzero(of == k) if len(cuts) else np.arange(len(row))
        if len(x) < 2:
            continue
        a, b = first[x], s.word(row[x], at[x] + 8)
        order = np.lexsort([b, a])
        group = np.cumsum(np.concatenate(([False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))))
        tied = np.bincount(group)[group] > 1
        if tied.any():
            group = group[tied]
            blocks.append((x[order[tied]], np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))))
    if not blocks:
        return bits
    s.rank_cover(np.flatnonzero(np.bincount(row[np.concatenate([x for x, _ in blocks])], minlength=len(rows))), cover)
    for x, group in blocks:
        x = x[s.order(row[x], at[x], group, cover)]
        same = np.ones(len(x) - 1, bool)
        begin = row[x] * WIDE + at[x]
        for i in range(0, SPAN, 8):  # the last word overlaps the one before
            w = s.flat[begin + min(i, SPAN - 8)]
            same &= w[1:] == w[:-1]
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.repeat(np.minimum.reduceat(owner[row[x]], head), np.diff(np.append(head, len(x))))
        hit = x[least < owner[row[x]]]
        np.bitwise_or.at(bits, row[hit], np.uint64(1) << at[hit].astype(np.uint64))
    return bits


def judged(ctx: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """earlier() of contexts with their offsets in the last two columns. Equal ones of several batches are taken once, and
    every offset of those that aren't the first counts."""
    wide = np.zeros((len(ctx), (WIDTH + 9) // 8 * 8), np.uint8)
    wide[:, : WIDTH + 2] = ctx
    words = wide.view("<u8")
    h = np.zeros(len(ctx), np.uint64)
    with np.errstate(over="ignore"):
        for w in words.T:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.lexsort((owner, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (words[order][1:] != words[order][:-1]).any(1)))
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    first = order[at]
    low, high = ctx[first, WIDTH].astype(np.int64), ctx[first, WIDTH + 1].astype(np.int64)
    # equal strings have equal anchors, so a context whose anchor no other has is done
    anchor = np.ascontiguousarray(ctx[first, GRAMS - 1 : GRAMS - 1 + GRAM]).view(np.uint64)
    name = dense([anchor[:, 0], anchor[:, 1]])
    rest = np.flatnonzero(np.bincount(name)[name] > 1)
    bits = np.zeros(len(first), np.uint64)
    if len(rest):
        bits[rest] = earlier(ctx[first[rest], :WIDTH], low[rest], high[rest], owner[first[rest]])
    full = ((np.uint64(1) << (high - low + 1).astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64)
    out = np.empty(len(ctx), np.uint64)
    out[order] = np.where(owner[order] > owner[first][group], full[group], bits[group])
    return out


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def packed(marked: np.ndarray) -> bytes:
    """Marked hashes by their low six bytes. They only tell which anchors go on to be compared, so a chance meeting does no harm."""
    return np.ascontiguousarray(marked.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def by_bucket(hashes: np.ndarray, bits: int, of: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and the bucket (the leading bits, of so many) of each in that order."""
    order = np.argsort(hashes, kind="stable")
    return order, (hashes[order] >> np.uint64(of - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the bytes that stay, as text (cut characters become a replacement sign)."""
    spark = docs.sparkSession
    ship(spark)
    plain = doc_columns(docs)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    bits = max(0, int(np.ceil(np.log2(max(1.0, size * 2 / (GRAMS + 1) / BUCKET_ANCHORS)))))
    # by id and text, so that rows that repeat an id, or have none, don't all come into one batch
    dealt = plain.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    batch_of = lambda t: Batch(t.column("doc_id").to_pylist(), t.column("text").to_pylist())

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        h = batch_of(rows).distinct()
        order, b = by_bucket(h, bits, 48)
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
        parts = np.split(h[order], at[1:]) if len(b) else []
        return pa.table({"bucket": pa.array(b[at], pa.int64()), "g": pa.array([key[0].as_py()] * len(parts), pa.int64()), "data": pa.array([packed(p) for p in parts], pa.binary())})

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        g = rows.column("g").to_pylist()
        found = shared_hashes([unpacked(d) for d in rows.column("data").to_pylist()])
        kept = [(x, packed(f)) for x, f in zip(g, found, strict=True) if len(f)]
        return pa.table({"g": pa.array([x for x, _ in kept], pa.int64()), "data": pa.array([f for _, f in kept], pa.binary())})

    def shared_of(t: pa.Table) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpacked(d) for d in t.column("data").to_pylist()]]))

    context = "bucket long, g long, rows binary, owners binary, numbers binary"

    def give(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "g", "rows", "owners", "numbers"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not len(found) or not len(rows):
            return pa.table([pa.array([], k) for k in kinds], names)
        _, _, ctx, owner, h = batch_of(rows).contexts(shared_of(found))
        order, b = by_bucket(h, bits)
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
        parts = np.split(order, at[1:]) if len(b) else []
        return pa.table([pa.array(b[at], pa.int64()), pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array([zlib.compress(blob(ctx[p]), 1) for p in parts], pa.binary()), pa.array([blob(owner[p]) for p in parts], pa.binary()), pa.array([blob(p.astype(np.int32)) for p in parts], pa.binary())], names)

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        owners = [np.frombuffer(x, np.int64) for x in rows.column("owners").to_pylist()]
        ctx = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in rows.column("rows").to_pylist()]).reshape(-1, WIDTH + 2)
        bitmask = judged(ctx, np.concatenate(owners))
        parts = np.split(bitmask, np.cumsum([len(o) for o in owners])[:-1])
        kept = [(g, x, p) for g, x, p in zip(rows.column("g").to_pylist(), rows.column("numbers").to_pylist(), parts, strict=True) if p.any()]
        return pa.table({"g": pa.array([g for g, _, _ in kept], pa.int64()), "numbers": pa.array([x for _, x, _ in kept], pa.binary()), "masks": pa.array([blob(p) for _, _, p in kept], pa.binary())})

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def finish(key: tuple, rows: pa.Table, found: pa.Table, masks: pa.Table) -> pa.Table:
        b = batch_of(rows)
        mark = np.zeros(len(b.buf) + 1, np.int32)
        if len(found):
            pick, group, ctx, owner, _ = b.contexts(shared_of(found))
            bitmask = np.zeros(len(owner), np.uint64)
            for x, m in zip(masks.column("numbers").to_pylist(), masks.column("masks").to_pylist(), strict=True):
                bitmask[np.frombuffer(x, np.int32)] = np.frombuffer(m, np.uint64)
            later = b.ids[b.doc[pick]] > owner[group]  # a smaller id of the batch has the very same context
            for offset in range(GRAMS):
                ok = (b.low[pick] <= offset) & (offset <= b.high[pick])
                hit = ok & (later | ((bitmask[group] >> np.uint64(offset)) & np.uint64(1)).astype(bool))
                p = b.anchor[pick[hit]] - (GRAMS - 1) + offset
                np.add.at(mark, p, 1)
                np.add.at(mark, p + SPAN, -1)
        gone = np.cumsum(mark) > 0
        out: list[list] = [[] for _ in names]
        ids = rows.column("doc_id").to_pylist()
        for i, raw in enumerate(b.raw):
            s = b.start[i]
            g = gone[s : s + len(raw)]
            n = int(g.sum())
            kept = raw if not n else np.frombuffer(raw, np.uint8)[~g].tobytes()
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            for c, v in zip(out, (ids[i], len(raw), n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    hashes = dealt.groupBy("g").applyInArrow(send, "bucket long, g long, data binary")
    shared = hashes.groupBy("bucket").applyInArrow(meet, "g long, data binary")
    contexts = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(give, context)
    masks = contexts.groupBy("bucket").applyInArrow(judge, "g long, numbers binary, masks binary")
    both = shared.select("g", "data", F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("masks")).unionByName(masks.select("g", F.lit(None).cast("binary").alias("data"), "numbers", "masks"))

    def close(key: tuple, rows: pa.Table, facts: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        if not len(rows):
            return pa.table([pa.array([], k) for k in [pa.int64()] * 4 + [pa.string()] * 2], names)
        known = pc.is_valid(facts.column("data"))
        return finish(key, rows, facts.filter(known), facts.filter(pc.invert(known)))

    out = dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(close, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that an earlier one has."""
    return remove_repeats(table(spark, sf_dir, "documents"))
