"""Alignments as CIGAR strings, which run along the reference whatever the strand."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Which operations use up the query, and which the reference (fixed values of the SAM specification).
QUERY = "MIS=X"
REFERENCE = "MDN=X"
BOTH = "M=X"
PART = re.compile(r"([0-9]+)([MIDNSHP=X])")


def parse(cigar: Column | str) -> Column:
    """array<struct<n,op>>"""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    parts = F.regexp_extract_all(c, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("bigint").alias("n"), F.right(p, F.lit(1)).alias("op")))


def spans(cigar: Column | str, start: Column | str) -> Column:
    """array<struct<op,n,q,r>>: for each part its 1-based start on the query and on the reference."""
    s = F.col(start) if isinstance(start, str) else start
    kind = "array<struct<op:string,n:bigint,q:bigint,r:bigint>>"
    begin = F.struct(F.lit(1).cast("bigint").alias("q"), s.cast("bigint").alias("r"), F.array().cast(kind).alias("out"))
    step = lambda acc, p: F.struct(
        (acc["q"] + F.when(p["op"].isin(*QUERY), p["n"]).otherwise(0)).alias("q"),
        (acc["r"] + F.when(p["op"].isin(*REFERENCE), p["n"]).otherwise(0)).alias("r"),
        F.concat(acc["out"], F.array(F.struct(p["op"].alias("op"), p["n"].alias("n"), acc["q"].alias("q"), acc["r"].alias("r")))).alias("out"),
    )
    return F.aggregate(parse(cigar), begin, step, lambda acc: acc["out"])


def aligned_bases(sequence: Column | str, cigar: Column | str) -> Column:
    """The bases that are aligned to a base of the reference, one after another."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    kept = F.filter(spans(cigar, F.lit(1)), lambda p: p["op"].isin(*BOTH))
    return F.array_join(F.transform(kept, lambda p: F.substring(s, p["q"].cast("int"), p["n"].cast("int"))), "")


def positions(length: int, start: int, cigar: str, strand: str) -> np.ndarray:
    """The reference position of each base of the query, in the query's own direction; 0 if it has none."""
    out, q, r = np.zeros(length, np.int64), 0, start
    for n, op in ((int(n), op) for n, op in PART.findall(cigar)):
        if op in BOTH:
            m = max(0, min(n, length - q))
            out[q : q + m] = np.arange(r, r + m)
        q += n if op in QUERY else 0
        r += n if op in REFERENCE else 0
    return out[::-1] if strand == "-" else out


def written(pos: np.ndarray, skips: list[tuple[int, int]] = ()) -> tuple[int, str]:
    """(start, cigar) of positions in the reference's direction; a gap that holds a skipped stretch is N, another one D."""
    at = np.flatnonzero(pos)
    if not len(at):
        return 0, f"{len(pos)}S" if len(pos) else ""
    parts: list[list] = []

    def add(n: int, op: str) -> None:
        if n:
            if parts and parts[-1][1] == op:
                parts[-1][0] += n
            else:
                parts.append([n, op])

    add(int(at[0]), "S")
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(pos[at]) != 1))
    begin = 0
    for b in [*breaks.tolist(), len(at) - 1]:
        add(int(at[b] - at[begin] + 1), "M")
        if b < len(at) - 1:
            add(int(at[b + 1] - at[b] - 1), "I")
            gap = int(pos[at[b + 1]] - pos[at[b]] - 1)
            add(gap, "N" if any(s > pos[at[b]] and s < pos[at[b + 1]] for s, _ in skips) else "D")
        begin = b + 1
    add(int(len(pos) - at[-1] - 1), "S")
    return int(pos[at[0]]), "".join(f"{n}{op}" for n, op in parts)


def skipped(start: int, cigar: str) -> list[tuple[int, int]]:
    out, r = [], start
    for n, op in ((int(n), op) for n, op in PART.findall(cigar)):
        if op == "N":
            out.append((r, n))
        r += n if op in REFERENCE else 0
    return out


def query_length(cigar: str) -> int:
    return sum(int(n) for n, op in PART.findall(cigar) if op in QUERY)


def compose(s1: int, c1: str, d1: str, s2: int, c2: str, d2: str) -> tuple[int, str, str]:
    """The alignment of a query to a reference, from those of the query to something between and of that to the reference.

    If nothing is aligned, the start is that of the nearest aligned base at or after the query's place, else the last one.
    """
    first = positions(query_length(c1), s1, c1, d1)
    between = positions(query_length(c2), s2, c2, d2)
    ok = (first > 0) & (first <= len(between))
    pos = np.where(ok, between[np.where(ok, first - 1, 0)] if len(between) else 0, 0)
    strand = "+" if d1 == d2 else "-"
    start, cigar = written(pos[::-1] if strand == "-" else pos, skipped(s2, c2))
    if not pos.any():
        known = np.sort(between[between > 0])
        near = between[max(0, int(first[ok].min()) - 1) :] if ok.any() else between
        near = near[near > 0]
        start = int(near.min()) if len(near) else int(known[-1]) if len(known) else s2
    return start, cigar, strand


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is read: an expression that is read as a lambda's argument isn't copied."""
    return F.transform(F.array(value), use)[0]


def stretches(cigar: Column, start: Column) -> Column:
    """array<struct<q,r,n>>: stretches of aligned bases, their first places (from 1) on the query, along the reference, and on the reference."""
    kept = F.filter(spans(cigar, start), lambda p: p["op"].isin(*BOTH) & (p["n"] > 0))
    return F.transform(kept, lambda p: F.struct(p["q"].alias("q"), p["r"].alias("r"), p["n"].alias("n")))


def used(cigar: Column) -> Column:
    """The length of the query."""
    return F.aggregate(parse(cigar), F.lit(0).cast("bigint"), lambda n, p: n + F.when(p["op"].isin(*QUERY), p["n"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """The length on the reference."""
    return F.aggregate(parse(cigar), F.lit(0).cast("bigint"), lambda n, p: n + F.when(p["op"].isin(*REFERENCE), p["n"]).otherwise(0))


def skips(cigar: Column, start: Column) -> Column:
    """First reference places of skipped stretches."""
    return F.transform(F.filter(spans(cigar, start), lambda p: p["op"] == "N"), lambda p: p["r"])


def from_stretches(joined: Column, skip: Column, size: Column) -> tuple[Column, Column]:
    """(start, cigar) of aligned stretches (q, r, n), in order on both sides; of a gap on both, the inserted bases come first. Without any: null, all clipped."""
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")

    def text(x: Column) -> Column:
        begins, ends = x["begins"], x["ends"]

        def part(b: Column, i: Column) -> Column:
            before, end = F.get(ends, i - 1), F.get(ends, i)
            more, gap = b["q"] - before["q"], b["r"] - before["r"]
            skipped_here = F.exists(skip, lambda s: (s >= before["r"]) & (s < b["r"]))
            inner = F.concat(F.when(more > 0, F.concat(more.cast("string"), F.lit("I"))).otherwise(""), F.when(gap > 0, F.concat(gap.cast("string"), F.when(skipped_here, "N").otherwise("D"))).otherwise(""))
            return F.concat(F.when(i > 0, inner).otherwise(""), (end["q"] - b["q"]).cast("string"), F.lit("M"))

        whole = F.concat(clip(begins[0]["q"] - 1), F.array_join(F.transform(begins, part), ""), clip(size - F.element_at(ends, -1)["q"] + 1))
        return F.when(F.size(begins) == 0, clip(size)).otherwise(whole)

    def apart(x: Column) -> Column:
        """Where runs of stretches that follow each other on both sides begin and (one place on) end."""
        follows = lambda a, b: (a["q"] + a["n"] == b["q"]) & (a["r"] + a["n"] == b["r"])
        first = F.filter(x, lambda s, i: (i == 0) | ~F.coalesce(follows(F.get(x, i - 1), s), F.lit(False)))
        last = F.filter(x, lambda s, i: ~F.coalesce(follows(s, F.get(x, i + 1)), F.lit(False)))
        return F.struct(first.alias("begins"), F.transform(last, lambda s: F.struct((s["q"] + s["n"]).alias("q"), (s["r"] + s["n"]).alias("r"))).alias("ends"))

    return F.get(joined, F.lit(0))["r"], held(apart(joined), text)


def chain(s1: Column, c1: Column, d1: Column, s2: Column, c2: Column, d2: Column) -> Column:
    """compose() for columns, as expressions: struct<start,cigar,strand>.

    Both alignments are short sorted lists of stretches. Those of the query are turned to run along the reference, and each
    is cut by the other alignment's: stretches by stretches, whatever their lengths.
    """
    given = F.struct(*[c.alias(n) for c, n in ((s1.cast("bigint"), "s1"), (c1, "c1"), (d1, "d1"), (s2.cast("bigint"), "s2"), (c2, "c2"), (d2, "d2"))])

    def lists(g: Column) -> Column:
        return F.struct(
            stretches(g["c1"], g["s1"]).alias("own"), used(g["c1"]).alias("size"), stretches(g["c2"], g["s2"]).alias("other"), used(g["c2"]).alias("between"),
            skips(g["c2"], g["s2"]).alias("skip"), (g["d2"] == "-").alias("turned"), (g["d1"] == g["d2"]).alias("same"), g["s2"].alias("s2"), (g["c1"].isNull() | g["c2"].isNull()).alias("none"),
        )

    def turned(x: Column) -> Column:
        """The query's stretches along the reference."""
        flip = lambda s: F.struct((x["size"] - s["q"] - s["n"] + 2).alias("q"), (x["between"] - s["r"] - s["n"] + 2).alias("r"), s["n"].alias("n"))
        return F.when(x["turned"], F.reverse(F.transform(x["own"], flip))).otherwise(x["own"])

    def cut(x: Column) -> Column:
        def by(a: Column) -> Column:
            def one(b: Column) -> Column:
                low, high = F.greatest(a["r"], b["q"]), F.least(a["r"] + a["n"], b["q"] + b["n"])
                return F.struct((a["q"] + low - a["r"]).alias("q"), (b["r"] + low - b["q"]).alias("r"), (high - low).alias("n"))

            return F.transform(x["other"], one)

        return F.filter(F.flatten(F.transform(turned(x), by)), lambda s: s["n"] > 0)

    def nearest(x: Column) -> Column:
        """Where nothing is aligned: the smallest place of what is aligned at or after the query on the other sequence, in its own direction."""
        inside = F.filter(x["own"], lambda s: (s["r"] + s["n"] > 1) & (s["r"] <= x["between"]))
        first = F.coalesce(F.array_min(F.transform(inside, lambda s: F.greatest(s["r"], F.lit(1).cast("bigint")))), F.lit(1).cast("bigint"))
        after = lambda b: F.when(x["turned"], b["q"] <= x["between"] + 1 - first).otherwise(b["q"] + b["n"] > first)
        place = lambda b: F.when(x["turned"], b["r"]).otherwise(b["r"] + F.greatest(F.lit(0).cast("bigint"), first - b["q"]))
        last = F.transform(x["other"], lambda b: b["r"] + b["n"] - 1)
        return F.coalesce(F.array_min(F.transform(F.filter(x["other"], after), place)), F.array_max(last), x["s2"])

    def result(y: Column) -> Column:
        x = y["x"]
        start, cigar = from_stretches(y["joined"], x["skip"], x["size"])
        out = F.struct(F.coalesce(start, nearest(x)).alias("start"), cigar.alias("cigar"), F.when(x["same"], "+").otherwise("-").alias("strand"))
        return F.when(~x["none"], out)

    return held(held(held(given, lists), lambda x: F.struct(x.alias("x"), cut(x).alias("joined"))), result)


def chain_matched(s1: Column, n: Column, d1: Column, s2: Column, matched: Column, length: Column, d2: Column) -> Column:
    """Without Python, for a query of n bases that all match, on something that has its first or last ``matched`` bases aligned
    (first along the reference) and the rest clipped: struct<start,cigar,strand>."""
    clip = length - matched
    low = F.when(d2 == "-", length - (s1 + n - 1) + 1).otherwise(s1)  # place along the reference
    aligned = F.greatest(F.lit(0), F.least(n, matched - low + 1))
    start = s2 + F.when(aligned > 0, low - 1).otherwise(F.greatest(F.lit(0), matched - 1))
    cigar = F.concat(F.when(aligned > 0, F.concat(aligned.cast("string"), F.lit("M"))).otherwise(""), F.when(n - aligned > 0, F.concat((n - aligned).cast("string"), F.lit("S"))).otherwise(""))
    return F.struct(start.cast("bigint").alias("start"), F.when(clip >= 0, cigar).alias("cigar"), F.when(d1 == d2, "+").otherwise("-").alias("strand"))


def chain_run(s1: Column, n: Column, d1: Column, s2: Column, c2: Column, d2: Column) -> Column:
    """compose() for a query of n bases that all match. Where the other alignment is bases that match and then at most one clip, and some
    of the query is aligned, it is arithmetic (chain_matched); only other rows compute stretches."""
    matched = F.regexp_extract(c2, "^([0-9]+)M([0-9]+S)?$", 1).try_cast("bigint")
    clip = F.coalesce(F.regexp_extract(c2, "^[0-9]+M([0-9]+)S$", 1).try_cast("bigint"), F.lit(0))
    given = F.struct(*[c.alias(k) for c, k in ((s1.cast("bigint"), "s1"), (n.cast("bigint"), "n"), (d1, "d1"), (s2.cast("bigint"), "s2"), (c2, "c2"), (d2, "d2"), (matched, "matched"), (clip, "clip"))])

    def either(g: Column) -> Column:
        m = g["matched"]
        low = F.when(g["d2"] == "-", m + g["clip"] - (g["s1"] + g["n"] - 1) + 1).otherwise(g["s1"])
        plain = F.coalesce(m.isNotNull() & (m - low + 1 > 0) & (g["n"] > 0) & (low > 0), F.lit(False))
        fast = chain_matched(g["s1"], g["n"], g["d1"], g["s2"], m, m + g["clip"], g["d2"])
        return F.when(plain, fast).otherwise(chain(g["s1"], F.concat(g["n"].cast("string"), F.lit("M")), g["d1"], g["s2"], g["c2"], g["d2"]))

    return held(given, either)
