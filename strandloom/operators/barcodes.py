"""Called barcodes against the barcodes of all samples, by sorted joins.

Two codes of one length differ in at most m places exactly if they agree once some m places are left out of both. Each
code gives one key for every choice of m places, and keys are joined as they are: no code is compared with
all others, and neither side is broadcast. Both sides are reduced to distinct codes first: a
code that very many reads or samples share is one row until its answer goes back to them. So the search is bounded by the alphabet,
and under one key there are as many codes as it allows. A pair that meets under several keys counts under one of them, told from its places alone.

Edge cases: codes of different lengths don't match; null codes match nothing; codes shorter than m match all others of their length; two samples
with one code, or with codes near one called code, are reported as ambiguous; empty tables give no matches; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a place that is left out; barcodes don't hold it.
MARK = "*"


def left_out(code: Column, places: int) -> Column:
    """array<struct<at:array<int>,key:string>>: the code with every choice of so many places marked, and the places, in order."""

    def choose(marked: Column, at: list[Column], more: int) -> Column:
        if more == 0:
            return F.array(F.struct(F.array(*at).cast("array<int>").alias("at"), marked.alias("key")))
        first = at[-1] + 1 if at else F.lit(1)
        rest = F.when(first <= F.length(marked), F.sequence(first, F.length(marked))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(rest, lambda i: choose(F.overlay(marked, F.lit(MARK), i, F.lit(1)), [*at, i], more - 1)))

    every = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code))).otherwise(F.array().cast("array<int>"))
    short = F.array(F.struct(every.alias("at"), F.repeat(F.lit(MARK), F.length(code)).alias("key")))
    return F.when(F.length(code) < places, short).otherwise(choose(code, [], places))


def near(called: DataFrame, codes: DataFrame, most: int) -> DataFrame:
    """called_barcode, code, mismatches: every pair of at most so many mismatches, once, from distinct codes on both sides. Other columns of codes stay."""
    ours = codes.withColumn("_k", F.explode(left_out(F.col("code"), most)))
    theirs = called.withColumn("_k", F.explode(left_out(F.col("called_barcode"), most)))
    met = theirs.join(ours.hint("merge"), "_k")
    # only places left out can differ; of all keys of a pair one has its mismatches and, of the places that agree, the first
    places = [F.get("_k.at", F.lit(i)) for i in range(most)]
    differs = [F.coalesce(F.substring("called_barcode", p, F.lit(1)) != F.substring("code", p, F.lit(1)), F.lit(False)) for p in places]
    for i, (p, other) in enumerate(zip(places, differs, strict=True)):
        met = met.filter(other | F.coalesce(p == i + 1, F.lit(True)))
    return met.withColumn("mismatches", sum((other.cast("int") for other in differs), F.lit(0))).drop("_k")


def matches(called: DataFrame, codes: DataFrame, most: int = 1) -> DataFrame:
    """called_barcode, sample_id, mismatches: every pair of at most so many mismatches. called: called_barcode; codes: sample_id, code."""
    if most < 0:
        raise ValueError("mismatches can't be fewer than none")
    ours = codes.filter("code is not null").select("sample_id", "code").distinct()
    theirs = called.filter("called_barcode is not null").select("called_barcode").distinct()
    found = near(theirs, ours.select("code").distinct(), most)
    return ours.join(found.hint("merge"), "code").select("called_barcode", "sample_id", "mismatches")  # a code's samples pass by its few neighbours


def identify(reads: DataFrame, samples: DataFrame, most: int = 1) -> DataFrame:
    """Adds found_sample, n_matches and status to reads (called_barcode): identified if one sample's barcode is within so many
    mismatches, ambiguous if several are (found_sample is null), else unidentified. samples: sample_id, i5, i7."""
    if most < 0:
        raise ValueError("mismatches can't be fewer than none")
    codes = samples.select("sample_id", F.concat("i5", "i7").alias("code")).filter("code is not null").distinct()
    codes = codes.groupBy("code").agg(F.count("*").alias("n_matches"), F.min("sample_id").alias("_one"))
    called = reads.filter("called_barcode is not null").select("called_barcode").distinct()
    each = near(called, codes, most).groupBy("called_barcode").agg(F.sum("n_matches").alias("n_matches"), F.min("_one").alias("_one"))
    out = reads.join(each, "called_barcode", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("bigint")))
    status = F.when(F.col("n_matches") == 1, "identified").when(F.col("n_matches") > 1, "ambiguous").otherwise("unidentified")
    return out.withColumns({"found_sample": F.when(F.col("n_matches") == 1, F.col("_one")), "status": status}).drop("_one").select(*reads.columns, "found_sample", "n_matches", "status")
