"""PCR amplification, as sampling of the leaves of each molecule's copying tree.

After N cycles a molecule has 2 ** N descendants: a leaf's bit i tells whether its lineage took the new copy in cycle i. Each leaf
is kept on its own with the same chance. A copy is an event, named by the bits up to it; it fails with a chance by
GC content, and all leaves behind it go; its errors are shared by all leaves behind it. Nothing exponential is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import cigar as cg
from strandloom.functions import rng
from strandloom.functions.sequence import gc_content
from strandloom.runtime import ship

def success_rate(gc: Column, constant: float = 1.0, linear: float = 0.0, quadratic: float = -100.0) -> Column:
    """A parabola of the GC content around one half, within 0 and 1; an empty molecule (NaN) has 0."""
    d = F.nanvl(gc, F.lit(1e9)) - 0.5
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(constant) + F.lit(linear) * d + F.lit(quadratic) * d * d))


def kept_leaves(seed: int, cycles: int, percentage: float) -> Column:
    """The leaves that are kept, in order. Gaps between them are geometric, each from one uniform number of the row's key and the gap's
    place, so the work grows with the leaves that are kept and not with all, and SQL gives the same at any number of cycles."""
    p, n = percentage / 100.0, 1 << cycles
    ship()
    none = math.log1p(-p) if p < 1 else -math.inf

    @F.pandas_udf("array<int>")
    def draw(key: pd.Series) -> pd.Series:
        out = []
        for k in key:
            at, found = -1, []
            while p > 0 and (at := at + 1 + int(math.log1p(-rng.uniform_py(seed, "pcr_gap", k, len(found))) / none)) < n:
                found.append(at)
            out.append(np.array(found, np.int32))
        return pd.Series(out)

    return draw(F.col("row_key"))


def events(leaf: Column, cycles: int) -> Column:
    """The copy events of a leaf, as cycle and bits up to it: array<struct<i,prefix>>."""
    each = F.transform(F.sequence(F.lit(0), F.lit(max(0, cycles - 1))), lambda i: F.struct(i.alias("i"), leaf.bitwiseAND(F.expr("1") * F.pow(F.lit(2.0), i + 1).cast("int") - 1).alias("prefix")))
    return F.filter(each, lambda e: e["prefix"] >= F.pow(F.lit(2.0), e["i"]).cast("int"))


def amplify(df: DataFrame, seed: int, cycles: int, percentage: float, constant: float = 1.0, linear: float = 0.0, quadratic: float = -100.0, substitution: float = 0.0, insertion: float = 0.0, deletion: float = 0.0) -> DataFrame:
    """Copies of molecules that are kept, with leaf (0 is the molecule itself, which keeps its id) and pcr_parent_id. No cycles: nothing changes."""
    if not cycles:
        return df
    rate = success_rate(gc_content("sequence"), constant, linear, quadratic)
    out = df.withColumns({"_rate": rate, "leaf": F.explode(kept_leaves(seed, cycles, percentage))}).withColumn("_events", events(F.col("leaf"), cycles))
    ok = F.forall("_events", lambda e: rng.uniform(seed, "pcr_copy", F.col("row_key"), e["i"], e["prefix"]) < F.col("_rate"))
    out = out.filter(ok)
    if substitution or insertion or deletion:
        out = with_errors(out, seed, substitution, insertion, deletion)
    suffix = F.when(F.col("leaf") == 0, "").otherwise(F.concat(F.lit("."), F.col("leaf").cast("string")))
    out = out.withColumns({"pcr_parent_id": F.col("molecule_id"), "molecule_id": F.concat("molecule_id", suffix), "row_key": F.concat("row_key", F.lit(".p"), F.col("leaf").cast("string"))})
    return out.drop("_rate", "_events")


def mutate(sequence: str, origin: np.ndarray, g: np.random.Generator, substitution: float, insertion: float, deletion: float) -> tuple[str, np.ndarray]:
    """One copying: bases replaced, lost, and inserted before others. origin is the place each base came from, 0 for inserted ones."""
    n = len(sequence)
    codes = np.frombuffer(sequence.encode(), np.uint8).copy()
    hit = np.flatnonzero(g.random(n) < substitution)
    bases = np.frombuffer(b"ACGT", np.uint8)
    if len(hit):
        now = np.searchsorted(bases, codes[hit])
        codes[hit] = bases[(np.minimum(now, 3) + g.integers(1, 4, len(hit))) % 4]
    gone, put = g.random(n) < deletion, np.flatnonzero(g.random(n) < insertion)
    new = bases[g.integers(0, 4, len(put))]
    codes, origin, kept = np.insert(codes, put, new), np.insert(origin, put, 0), np.insert(~gone, put, True)
    return codes[kept].tobytes().decode(), origin[kept]


def with_errors(df: DataFrame, seed: int, substitution: float, insertion: float, deletion: float) -> DataFrame:
    """Errors of all copy events of each leaf, in the order of the cycles; alignments follow. Runs in Arrow batches."""

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            rows = []
            for key, s, ev, ss, sc, sd in zip(pdf["row_key"], pdf["sequence"], pdf["_events"], pdf["source_start"], pdf["source_cigar"], pdf["source_strand"], strict=True):
                n, origin = len(s), np.arange(1, len(s) + 1)
                for e in ev:
                    s, origin = mutate(s, origin, rng.generator(seed, "pcr_errors", key, e["i"], e["prefix"]), substitution, insertion, deletion)
                if len(s) == n and (origin == np.arange(1, n + 1)).all():
                    rows.append((s, 1, f"{n}M", "+", ss, sc, sd))
                else:
                    start, cigar = cg.written(origin)
                    rows.append((s, start, cigar, "+", *cg.compose(start, cigar, "+", ss, sc, sd)))
            pdf[["sequence", "start", "cigar", "strand", "source_start", "source_cigar", "source_strand"]] = pd.DataFrame(rows, index=pdf.index, columns=range(7))
            yield pdf

    return df.mapInPandas(run, T.StructType(df.schema.fields))
