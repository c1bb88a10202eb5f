"""Ribosomal depletion: where oligos align, molecules may be degraded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import rng
from strandloom.operators.molecules import piece
from strandloom.runtime import ship


def alignment_scores(sequence: Column, oligos: list[str]) -> Column:
    """For each place of the molecule the most bases that match the reverse complement of an oligo, without gaps.

    Shorter oligos are taken as long as the longest, with places at their end that every base of ACGT matches. Other letters of a
    molecule match nothing; molecules shorter than the longest oligo have no places. The windows of a molecule times all oligos at
    once is one matrix product, in Arrow batches.
    """
    ship()
    size = max(map(len, oligos), default=1)
    turned = [o[::-1].translate(str.maketrans("ACGT", "TGCA")) for o in oligos]
    hot = np.array([[[c in (b, "*") for b in "ACGT"] for c in o.ljust(size, "*")] for o in turned], np.float32).reshape(len(oligos), -1).T

    @F.pandas_udf("array<int>")
    def scores(column: pd.Series) -> pd.Series:
        out = []
        for s in column:
            codes = np.frombuffer((s or "").encode(), np.uint8)
            if len(codes) < size or not len(oligos):
                out.append(np.zeros(0, np.int32))
                continue
            one = (codes[:, None] == np.frombuffer(b"ACGT", np.uint8)[None, :]).astype(np.float32)
            w = np.lib.stride_tricks.sliding_window_view(one, (size, 4)).reshape(len(codes) - size + 1, -1)
            out.append((w @ hot).max(1).astype(np.int32))
        return pd.Series(out)

    return scores(sequence)


def fired_sites(seed: int, scores: Column, size: int, max_chance: float, exponent: float, skip_first: bool = False) -> Column:
    """Places (from 0) where the molecule is degraded. skip_first leaves out the first place, which other programs never cut."""
    each = F.transform(scores, lambda s, i: F.struct(i.alias("i"), (F.lit(max_chance) * F.pow(s / F.lit(float(size)), F.lit(float(exponent)))).alias("p")))
    hit = F.filter(each, lambda x: rng.uniform(seed, "ribozero", F.col("row_key"), x["i"]) < x["p"])
    return F.transform(F.filter(hit, lambda x: x["i"] >= 1) if skip_first else hit, lambda x: x["i"])


def deplete(df: DataFrame, seed: int, oligos: list[str], max_chance: float = 0.99, exponent: float = 8, entire: bool = False, skip_first: bool = False) -> DataFrame:
    """Drops molecules with a degraded place (entire), or cuts the oligos' stretches out and keeps the pieces between."""
    size = max(map(len, oligos))
    df = df.withColumn("_scores", alignment_scores(F.col("sequence"), oligos))
    df = df.withColumn("_sites", fired_sites(seed, F.col("_scores"), size, max_chance, exponent, skip_first)).drop("_scores")
    if entire:
        return df.filter(F.size("_sites") == 0).drop("_sites")
    kind = "array<struct<a:int,b:int>>"
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    part = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    step = lambda acc, s: F.when(s < acc["end"], acc).otherwise(F.struct((s + size).cast("int").alias("end"), F.concat(acc["out"], part(acc["end"], s)).alias("out")))
    pieces = F.aggregate("_sites", begin, step, lambda acc: F.concat(acc["out"], part(acc["end"], F.length("sequence"))))
    df = df.withColumn("_p", F.explode(F.filter(F.transform(pieces, lambda x, k: F.struct(x["a"].alias("a"), x["b"].alias("b"), k.alias("k"))), lambda x: x["b"] > x["a"])))
    return piece(df, F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a"), F.concat(F.lit(".r"), F.col("_p.k").cast("string"))).drop("_p", "_sites")
