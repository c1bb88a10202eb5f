"""Adapter ligation, and choosing adapters from a kit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg

#: Samples are a small table; beyond so many rows the join is left to the optimiser.
BROADCAST_SAMPLES = 100_000


def small(df: DataFrame, limit: int = BROADCAST_SAMPLES) -> DataFrame:
    """Broadcast only if the table is as small as it should be."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ligate(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds each sample's adapters; samples has sample_id, pre_i5, i5, post_i5, pre_i7, i7, post_i7.

    5': pre_i5, i5, post_i5; 3': an A, pre_i7, i7, post_i7. The adapters are clipped in the alignments.
    """
    ends = samples.select("sample_id", F.concat("pre_i5", "i5", "post_i5").alias("_five"), F.concat(F.lit("A"), "pre_i7", "i7", "post_i7").alias("_three"))
    out = df.join(small(ends), "sample_id").withColumn("_n", F.length("sequence"))
    clip = lambda c: F.when(F.length(c) > 0, F.concat(F.length(c).cast("string"), F.lit("S"))).otherwise("")
    own = F.concat(clip("_five"), F.col("_n").cast("string"), F.lit("M"), clip("_three"))
    out = out.withColumn("_chained", cg.chain(F.lit(1), own, F.lit("+"), F.col("source_start"), F.col("source_cigar"), F.col("source_strand")))
    out = out.withColumns({
        "sequence": F.concat("_five", "sequence", "_three"), "start": F.lit(1).cast("bigint"), "cigar": own, "strand": F.lit("+"),
        "source_start": F.col("_chained.start"), "source_cigar": F.col("_chained.cigar"), "source_strand": F.col("_chained.strand"),
    })
    return out.select(*df.columns)


def adapter_pairs(kit: DataFrame) -> DataFrame:
    """Every 5' label with every 3' label, numbered: kit has label, end (5 or 3), sequence. A kit is a few hundred rows."""
    five = kit.filter("end = 5").select(F.col("label").alias("label5"), F.col("sequence").alias("adapter5"))
    three = kit.filter("end = 3").select(F.col("label").alias("label3"), F.col("sequence").alias("adapter3"))
    pairs = five.crossJoin(F.broadcast(three))
    return pairs.withColumn("pair", F.row_number().over(Window.orderBy("label5", "label3")).cast("bigint"))


def assign_pairs(samples: DataFrame, kit: DataFrame) -> DataFrame:
    """The next unused pair for each sample, in the order of the ids; samples beyond the pairs are an error."""
    n = samples.count()
    pairs = adapter_pairs(kit)
    if n > pairs.count():
        raise ValueError("there are more samples than adapter pairs")
    numbered = samples.withColumn("pair", F.row_number().over(Window.orderBy("sample_id")).cast("bigint"))
    return numbered.join(pairs, "pair").drop("pair")
