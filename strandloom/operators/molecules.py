"""The molecule table, and what all steps share: pieces of molecules with their alignments.

Columns: sample_id, packet_id, ordinal, row_key (the key of random draws and of lineage), molecule_id (need not be unique),
transcript_id, sequence, start, cigar, strand (place on the parent molecule), source_chrom, source_start, source_cigar,
source_strand (place on the genome).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg

COLUMNS = ["sample_id", "packet_id", "ordinal", "row_key", "molecule_id", "transcript_id", "sequence", "start", "cigar", "strand", "source_chrom", "source_start", "source_cigar", "source_strand"]


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules derived from the documents table: pseudo-random bases from a digest, and a tail of A."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    key = F.col("doc_id").cast("string")
    digest = F.concat(*[F.md5(F.concat(key, F.lit(f"|{i}"))) for i in range(8)])
    n, tail = (F.col("n_chars") % 217 + 40), F.col("doc_id") % 120
    seq = F.concat(F.substring(F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), n.cast("int")), F.repeat(F.lit("A"), tail.cast("int")))
    return derived(d, key, F.col("doc_id"), "source", "lang", seq, n, tail)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the lineitem table, for measurements."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in d.columns])
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    digest = F.concat(*[F.md5(F.concat(key, F.lit(f"|{i}"))) for i in range(8)])
    n, tail = (F.col("l_partkey") % 217 + 40), F.col("l_orderkey") % 120
    seq = F.concat(F.substring(F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), n.cast("int")), F.repeat(F.lit("A"), tail.cast("int")))
    d = d.withColumn("t", F.concat(F.lit("T"), (F.col("l_suppkey") % 50).cast("string"))).withColumn("c", F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")))
    return derived(d, key, number, "t", "c", seq, n, tail)


def derived(d: DataFrame, key: Column, number: Column, transcript: str, chrom: str, seq: Column, n: Column, tail: Column) -> DataFrame:
    cigar = F.concat(n.cast("string"), F.lit("M"), F.when(tail > 0, F.concat(tail.cast("string"), F.lit("S"))).otherwise(""))
    return d.select(
        (number % 2 + 1).cast("string").alias("sample_id"), (number % 4).cast("int").alias("packet_id"), number.cast("bigint").alias("ordinal"), key.alias("row_key"),
        F.concat(F.lit("m"), key).alias("molecule_id"), F.col(transcript).alias("transcript_id"), seq.alias("sequence"),
        F.lit(1).cast("bigint").alias("start"), F.concat((n + tail).cast("string"), F.lit("M")).alias("cigar"), F.lit("+").alias("strand"),
        F.col(chrom).alias("source_chrom"), (number * 1000 + 1).cast("bigint").alias("source_start"), cigar.alias("source_cigar"),
        F.when(number % 3 == 0, "-").otherwise("+").alias("source_strand"),
    )


def piece(df: DataFrame, first: Column, size: Column, suffix: Column | None = None, reverse: bool = False) -> DataFrame:
    """Each molecule becomes ``size`` of its bases from ``first`` (1-based), as its reverse complement if asked for.

    start, cigar and strand place it on the molecule it came from; the source alignment is chained, in expressions, and not at all if
    later steps don't read it.
    """
    from strandloom.functions.sequence import reverse_complement

    strand = F.lit("-" if reverse else "+")
    df = df.withColumns({"_first": first.cast("bigint"), "_size": size.cast("bigint")})
    part = F.substring(F.col("sequence"), F.col("_first").cast("int"), F.col("_size").cast("int"))
    own = F.concat(F.col("_size").cast("string"), F.lit("M"))
    df = df.withColumn("_chained", cg.chain_run(F.col("_first"), F.col("_size"), strand, F.col("source_start"), F.col("source_cigar"), F.col("source_strand")))
    out = df.withColumns({
        "sequence": reverse_complement(part) if reverse else part, "start": F.col("_first"), "cigar": own, "strand": strand,
        "source_start": F.col("_chained.start"), "source_cigar": F.col("_chained.cigar"), "source_strand": F.col("_chained.strand"),
    })
    if suffix is not None:
        out = out.withColumns({"molecule_id": F.concat("molecule_id", suffix), "row_key": F.concat("row_key", suffix)})
    return out.drop("_first", "_size", "_chained")
