"""Quantification, GC histograms, coverage, duplicate rates, summaries, demultiplexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequence import gc_content, hamming
from strandloom.operators.adapters import small

GC_BINS = 40
#: Positions of one tile: running sums go within tiles, and over the few tiles of a contig.
TILE = 1 << 20


def quantify(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id", "packet_id", "transcript_id").agg(F.count("*").alias("counts"))


def quant_rollup(quant: DataFrame) -> DataFrame:
    """Sums over packets, by transcript and for a sample as a whole (transcript_id null)."""
    return quant.rollup("sample_id", "transcript_id").agg(F.sum("counts").alias("counts")).filter("sample_id is not null")


def compare_quant(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of each transcript before and after, 0 where there are none."""
    a = before.groupBy("sample_id", "transcript_id").agg(F.sum("counts").alias("input_counts"))
    b = after.groupBy("sample_id", "transcript_id").agg(F.sum("counts").alias("output_counts"))
    return a.join(b, ["sample_id", "transcript_id"], "full").na.fill(0, ["input_counts", "output_counts"])


def gc_histogram(df: DataFrame, by: list[str], aligned_only: bool = False) -> DataFrame:
    """Shares of all rows in each of 40 bins, the last one closed; rows without bases are in none but count."""
    s = cg.aligned_bases("sequence", "source_cigar") if aligned_only else F.col("sequence")
    gc = gc_content(s)
    bins = F.when(~F.isnan(gc), F.least(F.lit(GC_BINS - 1), F.floor(gc * GC_BINS))).cast("int")
    n = df.select(*by, bins.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(GC_BINS - 1))))
    out = every.join(n, [*by, "bin"], "left").na.fill(0, ["n"])
    return out.select(*by, "bin", "n", F.round(F.col("n") / F.col("total"), 9).alias("fraction"))


def mean_gc_histogram(histograms: DataFrame, by: list[str]) -> DataFrame:
    """The mean over packets of each bin's share."""
    return histograms.groupBy(*by, "bin").agg(F.round(F.avg(F.when(~F.isnan("fraction"), F.col("fraction"))), 9).alias("fraction"))


def duplicate_histogram(df: DataFrame, parent: Column) -> DataFrame:
    """How many molecules have how many copies."""
    return df.groupBy(parent.alias("parent")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("molecules"))


def parent_id(molecule_id: Column) -> Column:
    """The id without what follows its last dot; empty if it has none."""
    return F.when(F.instr(molecule_id, ".") == 0, "").otherwise(F.regexp_replace(molecule_id, r"\.[^.]*$", ""))


def root_id(molecule_id: Column) -> Column:
    return F.split_part(molecule_id, F.lit("."), F.lit(1))


def coverage(df: DataFrame, chrom: str = "source_chrom", start: str = "source_start", cigar: str = "source_cigar", strand: str = "source_strand") -> DataFrame:
    """source_chrom, source_strand, pos, depth: the depth from each position where it changes to the next.

    Aligned stretches are two events each, which are summed by position before any order is needed. Running sums go within
    tiles of the contig and over the tiles' totals, so no task holds a whole contig.
    """
    stretch = F.filter(cg.spans(cigar, start), lambda p: p["op"].isin(*cg.BOTH) & (p["n"] > 0))
    both = F.flatten(F.transform(stretch, lambda p: F.array(F.struct(p["r"].alias("pos"), F.lit(1).alias("d")), F.struct((p["r"] + p["n"]).alias("pos"), F.lit(-1).alias("d")))))
    keys = [F.col(chrom).alias("source_chrom"), F.col(strand).alias("source_strand")]
    events = df.select(*keys, F.explode(both).alias("e")).groupBy("source_chrom", "source_strand", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    events = events.withColumn("tile", F.floor(F.col("pos") / TILE))
    contig, tile = ["source_chrom", "source_strand"], ["source_chrom", "source_strand", "tile"]
    totals = events.groupBy(*tile).agg(F.sum("d").alias("d"))
    totals = totals.select(*tile, F.coalesce(F.sum("d").over(Window.partitionBy(*contig).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum("d").over(Window.partitionBy(*tile).orderBy("pos"))
    return events.join(totals, tile).select(*contig, "pos", (inner + F.col("base")).alias("depth"))


def step_summary(df: DataFrame, original: DataFrame) -> DataFrame:
    """One row a sample: molecules, share of the original ids still there, and counts in four bands of size."""
    n = F.length("sequence")
    band = lambda a, b: F.count_if((n >= a) & (n < b))
    now = df.groupBy("sample_id").agg(F.count("*").alias("molecules"), band(0, 100).alias("under_100"), band(100, 500).alias("under_500"), band(500, 1000).alias("under_1000"), F.count_if(n >= 1000).alias("longer"))
    ids = original.select("sample_id", root_id(F.col("molecule_id")).alias("id")).distinct()
    seen = ids.join(df.select("sample_id", root_id(F.col("molecule_id")).alias("id")).distinct(), ["sample_id", "id"], "left_semi").groupBy("sample_id").agg(F.count("*").alias("seen"))
    total = ids.groupBy("sample_id").agg(F.count("*").alias("total"))
    out = now.join(total, "sample_id", "left").join(seen, "sample_id", "left")
    return out.select("sample_id", "molecules", F.round(F.coalesce("seen", F.lit(0)) / F.col("total"), 9).alias("represented"), "under_100", "under_500", "under_1000", "longer")


def demultiplex(reads: DataFrame, samples: DataFrame, most: int = 1) -> DataFrame:
    """status: identified if the called barcode is within so many mismatches of the own sample's (sample_id, i5, i7), else unidentified."""
    codes = samples.select("sample_id", F.concat("i5", "i7").alias("_code"))
    out = reads.join(small(codes), "sample_id", "left")
    near = F.coalesce(hamming("called_barcode", "_code") <= most, F.lit(False))
    return out.withColumn("status", F.when(near, "identified").otherwise("unidentified")).drop("_code")
