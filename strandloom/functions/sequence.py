"""Functions of nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(s: Column | str) -> Column:
    return F.col(s) if isinstance(s, str) else s


def reverse_complement(s: Column | str) -> Column:
    """Letters other than ACGT stay as they are."""
    return F.reverse(F.translate(_c(s), "ACGT", "TGCA"))


def polya_tail_length(s: Column | str) -> Column:
    """Length of the run of A at the end."""
    return F.length(_c(s)) - F.length(F.rtrim(_c(s), F.lit("A")))


def count_base(s: Column | str, base: str) -> Column:
    return F.length(_c(s)) - F.length(F.replace(_c(s), F.lit(base), F.lit("")))


def gc_content(s: Column | str) -> Column:
    """Share of C and G, an N as one half; NaN for an empty sequence."""
    n = F.length(_c(s))
    return F.when(n == 0, F.lit(float("nan"))).otherwise((count_base(s, "C") + count_base(s, "G") + count_base(s, "N") / 2) / F.greatest(n, F.lit(1)))


def bases_of(s: Column | str) -> Column:
    """One-letter strings; an empty array for an empty sequence."""
    return F.when(F.length(_c(s)) == 0, F.array().cast("array<string>")).otherwise(F.split(_c(s), ""))


def base_matrix(s: Column | str) -> Column:
    """Four arrays of 0 and 1, in the order ACGT."""

    def row(base: str) -> Column:
        return F.transform(bases_of(s), lambda x: (x == base).cast("bigint"))

    return F.array(*[row(b) for b in BASES])


def windows(s: Column | str, k: int) -> Column:
    """All substrings of length k, in order; an empty array if there are none."""
    n = F.length(_c(s))
    return F.when(n < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(_c(s), i, F.lit(k))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ; null if the lengths do."""
    a, b = _c(a), _c(b)
    each = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(None).cast("int")).when(F.length(a) == 0, F.lit(0)).otherwise(each)


def ppm_weights(s: Column | str, ppm: dict[str, list[float]]) -> Column:
    """For each window as long as the matrix, the product of its bases' probabilities. Bases outside the matrix weigh 0."""
    k = len(next(iter(ppm.values())))
    table = F.create_map(*[x for b, p in ppm.items() for j, v in enumerate(p) for x in (F.lit(f"{b}{j}"), F.lit(float(v)))])
    each = lambda w: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda acc, j: acc * F.coalesce(table[F.concat(F.substring(w, j, F.lit(1)), (j - 1).cast("string"))], F.lit(0.0)))
    return F.transform(windows(s, k), each)


def phred_char(score: Column, cap: int = 41) -> Column:
    """Quality letter: 33 and the score, which is clipped before it is narrowed."""
    return F.char(F.lit(33) + F.greatest(F.lit(0), F.least(F.lit(cap), score)).cast("int"))


def phred_scores(quality: Column | str) -> Column:
    return F.transform(bases_of(quality), lambda c: F.ascii(c) - 33)


def sam_flag(direction: Column, read_strand: Column) -> Column:
    """1 paired, 2 proper, 64 or 128 first or second of the pair, 16 or 32 this or the other one reversed."""
    return F.lit(3) + F.when(direction == 1, F.lit(64)).otherwise(F.lit(128)) + F.when(read_strand == "-", F.lit(16)).otherwise(F.lit(32))
