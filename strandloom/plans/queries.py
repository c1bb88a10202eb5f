"""The registered queries of the simulator, with the same results in SQL where SQL can say them.

Molecules are derived from the documents table, the same in both engines. Random steps draw from a hash of the row's key,
so their results can be compared too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import rng
from strandloom.functions import sequence as sq
from strandloom.operators import adapters, analytics, barcodes, flowcell, fragmentation, genomes, idmaps, oligos, pcr, ribozero, selection, sequencing, synthesis
from strandloom.operators.molecules import from_documents, from_lineitem
from strandloom.sources import bam, formats
from strandloom.sources.scratch import folder

Query = Callable[[SparkSession, str], DataFrame]
SEED = 100
#: Oligos of several lengths, and the least score of a site by the index of their pieces.
MIXED, LEAST = ["ACGTTGCAACGT", "GGATCCTTAA", "TTTTACGGCAT", "CCCAAATTTGGG"], 9
OLIGOS = ["ACGTTGCAAC", "GGATCCTTAA", "TTTTACGGCA"]
PPM = {"A": [0.4, 0.3, 0.2, 0.25, 0.25, 0.1], "C": [0.2, 0.3, 0.3, 0.25, 0.25, 0.3], "G": [0.2, 0.2, 0.3, 0.25, 0.25, 0.4], "T": [0.2, 0.2, 0.2, 0.25, 0.25, 0.2]}
SAMPLES = [("1", "AATG", "ACGTACGT", "ACAC", "GATC", "TTGCAAGC", "ATCT"), ("2", "AATG", "TGCATGCA", "ACAC", "GATC", "CCGATTAG", "ATCT")]
SAMPLE_COLUMNS = "sample_id string, pre_i5 string, i5 string, post_i5 string, pre_i7 string, i7 string, post_i7 string"
CELL = flowcell.Geometry(tile=(1101, 1112), x=(1000, 1999), y=(2000, 2999), lanes=(1, 2))
CHEMISTRY = sequencing.Chemistry(read_length=40)
FRAGMENT = (0.02, 1.0, 20)
PCR_CYCLES, PCR_PERCENT, PCR_BIAS = 4, 20.0, (1.0, 0.0, -4.0)


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, SAMPLE_COLUMNS)


def kit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", 5, "ACGTAC"), ("b", 5, "TTGGCC"), ("c", 3, "GATTAC"), ("d", 3, "CCGGAA")], "label string, end int, sequence string")


def called(df: DataFrame) -> DataFrame:
    """Molecules with called barcodes of 0, 1, 2 or more errors, some cut short."""
    code = F.when(F.col("sample_id") == "1", F.lit("ACGTACGTTTGCAAGC")).otherwise(F.lit("TGCATGCACCGATTAG"))
    errors = F.col("ordinal") % 4
    wrong = F.concat(F.when(errors >= 1, "N").otherwise(F.substring(code, 1, 1)), F.substring(code, 2, 8), F.when(errors >= 2, "N").otherwise(F.substring(code, 10, 1)), F.substring(code, 11, 6))
    return df.withColumn("called_barcode", F.when(F.col("ordinal") % 17 == 0, F.substring(wrong, 1, 9)).otherwise(wrong))


def loaded(spark: SparkSession, d: str) -> DataFrame:
    return flowcell.load(called(from_documents(spark, d)), SEED, CELL)


def plain_reads(df: DataFrame) -> DataFrame:
    """Reads without errors: the first and last 40 bases of clusters, for the writers."""
    n = F.length("sequence")
    one = F.struct(F.lit(1).alias("direction"), F.substring("sequence", 1, 40).alias("called_sequence"), F.repeat(sq.phred_char(F.col("ordinal") % 50), 40).alias("quality"), F.col("source_start").alias("start"), F.lit("40M").alias("cigar"), F.col("source_strand").alias("strand"))
    two = F.struct(F.lit(2).alias("direction"), sq.reverse_complement(F.substring(F.col("sequence"), (n - 39).cast("int"), F.lit(40))).alias("called_sequence"), F.repeat(sq.phred_char(F.lit(41)), 40).alias("quality"), (F.col("source_start") + n - 40).alias("start"), F.lit("40M").alias("cigar"), F.when(F.col("source_strand") == "-", "+").otherwise("-").alias("strand"))
    return df.withColumn("reads", F.array(one, two))


def identified(spark: SparkSession, d: str) -> DataFrame:
    return analytics.demultiplex(plain_reads(loaded(spark, d)), samples(spark))


def size_selected(m: DataFrame) -> DataFrame:
    return selection.size_select(m, SEED, 60, 320, 120, 260)


def fragments(m: DataFrame) -> DataFrame:
    return fragmentation.fragment_uniform(m, SEED, *FRAGMENT)


def amplified(m: DataFrame) -> DataFrame:
    return pcr.amplify(m, SEED, PCR_CYCLES, PCR_PERCENT, *PCR_BIAS)


def library_prep(m: DataFrame, spark: SparkSession) -> DataFrame:
    """All steps of the preparation, one after another; one stage without a shuffle but for the samples' join."""
    m = selection.polya_select(m, SEED)
    m = fragments(m)
    m = synthesis.first_strand(m, SEED, PPM)
    m = synthesis.second_strand(m, SEED, PPM)
    m = selection.size_select(m, SEED, 20, 400, 30, 300)
    m = adapters.ligate(m, samples(spark))
    return pcr.amplify(m, SEED, 10, 0.2, *PCR_BIAS, substitution=0.001, insertion=0.0001, deletion=0.0001)


M = from_documents


def exact_prep(m: DataFrame, spark: SparkSession) -> DataFrame:
    """The preparation without errors and with perfect priming, whose draws SQL can follow from end to end."""
    m = synthesis.first_strand(fragments(selection.polya_select(m, SEED)), SEED, PPM, perfect=True)
    m = synthesis.second_strand(m, SEED, PPM, perfect=True)
    m = selection.size_select(m, SEED, 20, 400, 30, 300)
    return amplified(adapters.ligate(m, samples(spark)))


def places_whole(counts: Column, total: Column) -> Column:
    """How many places have four counts that add up to the total."""
    each = F.arrays_zip(*[counts[i].alias(b) for i, b in enumerate("acgt")])
    return F.size(F.filter(each, lambda x: x["a"] + x["c"] + x["g"] + x["t"] == total))


def spliced(m: DataFrame) -> DataFrame:
    """Molecules whose source alignment holds a skipped stretch, an insertion and a deletion, and a read of them (own_cigar, from place 3 on) with the same."""
    n = F.regexp_extract("source_cigar", "^([0-9]+)M", 1).cast("bigint")
    part, tail, read = F.floor(n / 4), F.regexp_extract("source_cigar", "([0-9]+S)$", 1), F.floor(n / 5)
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") if y is not tail else y for y in x])
    source = text(part, "M30N", part, "M3I", part, "M5D", n - part * 3 - 3, "M", tail)
    own = text("4S", read, "M2I", read, "M3D", read, "M")
    return m.withColumns({"source_cigar": source, "own_cigar": own, "own_strand": F.when(F.col("ordinal") % 2 == 0, "+").otherwise("-")})


def _molecule_files(spark: SparkSession, d: str) -> DataFrame:
    """Packets of molecule files: written once, found by name, numbered in the order of their paths."""
    base = folder(spark, "molecule_files")
    m = M(spark, d).withColumn("file", F.concat(F.lit("molecule_"), (F.col("ordinal") % 3).cast("string")))
    formats.write_molecules(m, base, "file")
    got = formats.read_molecules(spark, base, "1")
    return got.groupBy("packet_id").agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("bases"), F.countDistinct("transcript_id").alias("transcripts"))


def customer_codes(spark: SparkSession, d: str) -> DataFrame:
    """A sample for each customer, with a barcode of eight bases; with so many some are near each other, and a few the same."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    code = F.translate(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT")
    return c.select(F.col("c_custkey").alias("sample_id"), F.substring(code, 1, 4).alias("i5"), F.substring(code, 5, 4).alias("i7"))


def order_reads(spark: SparkSession, d: str) -> DataFrame:
    """A read for each order with its customer's barcode as called: no, one or two wrong bases, some an N, some cut short."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    code = F.translate(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT")
    at, kind = (F.col("o_orderkey") % 8).cast("int"), F.floor(F.col("o_orderkey") / 8) % 5
    wrong = F.when(kind == 0, code).otherwise(F.overlay(code, F.when(kind == 4, "N").otherwise(F.translate(F.substring(code, at + 1, F.lit(1)), "ACGT", "CGTA")), at + 1, F.lit(1)))
    wrong = F.when(kind == 3, F.overlay(wrong, F.lit("A"), (at + 3) % 8 + 1, F.lit(1))).otherwise(wrong)
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 31 == 0, F.substring(wrong, 1, 7)).otherwise(wrong).alias("called_barcode"))


def line_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval for each line item."""
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 1_000_000 + 1
    found = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("start", start)
    return found.select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("chrom"), "start", (F.col("start") + 20 + F.col("l_partkey") % 180).alias("end"))


def part_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval for each part."""
    found = spark.read.parquet(f"{d}/part.parquet").withColumn("start", F.col("p_partkey") * 7919 % 1_000_000 + 1)
    return found.select("p_partkey", F.concat(F.lit("c"), F.col("p_partkey") % 5).alias("chrom"), "start", (F.col("start") + 50 + F.col("p_size") * 20).alias("end"))


def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a genome that has a change for each order."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    chrom, kind = F.concat(F.lit("c"), F.col("o_custkey") % 5), F.col("o_orderkey") % 3
    indels = o.select(chrom.alias("chrom"), (F.col("o_orderkey") * 60).alias("pos"), F.when(kind != 0, F.col("o_custkey") % 4 + 1).otherwise(0).alias("inserted"), F.when(kind != 1, F.col("o_custkey") % 7 + 1).otherwise(0).alias("deleted"))
    ends = indels.select(F.col("chrom").alias("name")).distinct().crossJoin(F.broadcast(o.agg((F.max("o_orderkey") * 60 + 100).alias("length"))))  # five contigs, one length
    return genomes.genome_blocks(indels, ends)


def line_exons(spark: SparkSession, d: str) -> DataFrame:
    """A transcript for each order, an exon for each of its lines."""
    found = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    found = found.withColumn("start", F.col("l_orderkey") * 55 + F.col("l_linenumber") * 400)
    return found.select(F.col("l_orderkey").alias("transcript_id"), F.concat(F.lit("c"), F.col("l_orderkey") % 5).alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), "start", (F.col("start") + 20 + F.col("p") % 300).alias("end"))


def contigs(m: DataFrame) -> DataFrame:
    """A reference with a contig for each chromosome that occurs."""
    names = m.select(F.col("source_chrom").alias("name")).distinct().withColumn("length", F.lit(1 << 30))
    return names.withColumn("ordinal", F.row_number().over(Window.orderBy("name")) - 1)


def _bam(spark: SparkSession, d: str) -> str:
    """BAM files of all reads, in the order of places."""
    base = folder(spark, "bam")
    bam.write_bam(identified(spark, d), contigs(M(spark, d)), base, order=True)
    return base


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    """Records of FASTQ files in the order of places, numbered as they stand in the files."""
    base = folder(spark, "fastq")
    formats.write_fastq(identified(spark, d), base, order=True)
    return formats.read_fastq(spark, base)


def transcripts(m: DataFrame) -> DataFrame:
    """The first molecule of each transcript as its sequence."""
    one = F.min_by(F.struct("sequence", F.col("source_chrom").alias("chrom"), F.col("source_start").alias("ref_start"), F.concat(F.length("sequence").cast("string"), F.lit("M")).alias("ref_cigar"), F.col("source_strand").alias("strand")), "ordinal")
    return m.groupBy("transcript_id").agg(one.alias("t")).select("transcript_id", "t.*")


def _distribution(spark: SparkSession, d: str) -> DataFrame:
    m = M(spark, d)
    weights = m.groupBy("transcript_id").agg(F.count("*").alias("weight"))
    return formats.molecules_from_distribution(spark, transcripts(m), weights, 2000, SEED, packet_size=500, first_packet=4).select("row_key", "packet_id", "transcript_id", "sequence", "source_start", "source_cigar")


QUERIES: dict[str, Query] = {
    "distribution_molecules": _distribution,
    "quant_by_transcript": lambda s, d: analytics.quantify(M(s, d)),
    "quant_rollup": lambda s, d: analytics.quant_rollup(analytics.quantify(M(s, d))),
    "input_vs_output_quant": lambda s, d: analytics.compare_quant(analytics.quantify(M(s, d)), analytics.quantify(size_selected(M(s, d)))),
    "gc_content": lambda s, d: M(s, d).select("row_key", F.round(sq.gc_content("sequence"), 9).alias("gc")),
    "gc_aligned_only": lambda s, d: M(s, d).select("row_key", F.round(sq.gc_content(cg.aligned_bases("sequence", "source_cigar")), 9).alias("gc")),
    "gc_histogram": lambda s, d: analytics.gc_histogram(M(s, d), ["packet_id"]),
    "gc_histogram_aligned": lambda s, d: analytics.gc_histogram(M(s, d), ["packet_id"], aligned_only=True),
    "mean_gc_histogram": lambda s, d: analytics.mean_gc_histogram(analytics.gc_histogram(M(s, d), ["packet_id"]), []),
    "reverse_complement": lambda s, d: M(s, d).select("row_key", sq.reverse_complement("sequence").alias("turned")),
    "polya_tail": lambda s, d: M(s, d).select("row_key", sq.polya_tail_length("sequence").alias("tail")),
    "base_counts": lambda s, d: M(s, d).select("row_key", *[sq.count_base("sequence", b).alias(f"n_{b.lower()}") for b in "ACGT"]),
    "base_matrix": lambda s, d: M(s, d).select("row_key", *[F.array_join(sq.base_matrix("sequence")[i], "").alias(f"row_{b.lower()}") for i, b in enumerate("ACGT")]),
    "kmer_windows": lambda s, d: M(s, d).select(F.explode(sq.windows("sequence", 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")),
    "kmer_ppm_weight": lambda s, d: M(s, d).select("row_key", F.transform(sq.ppm_weights("sequence", PPM), lambda x: x).alias("w")).select("row_key", F.size("w").alias("sites"), F.round(F.array_max("w"), 12).alias("best"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 9).alias("total")),
    "hamming_distance": lambda s, d: M(s, d).select("row_key", sq.hamming(F.substring("sequence", 1, 20), F.substring("sequence", 11, 20)).alias("mismatches")),
    "polya_select": lambda s, d: selection.polya_select(M(s, d), SEED).select("row_key", "sequence"),
    "polya_break": lambda s, d: selection.polya_break(M(s, d), SEED, 0.02).select("row_key", "sequence", "start"),
    "size_probability": lambda s, d: M(s, d).select("row_key", F.round(selection.size_probability(F.length("sequence"), 60, 320, 120, 260), 9).alias("p")),
    "size_select": lambda s, d: size_selected(M(s, d)).select("row_key", F.length("sequence").alias("size")),
    "fragment_uniform": lambda s, d: fragments(M(s, d)).select("row_key", "start", "sequence"),
    "fragment_min_size": lambda s, d: fragmentation.fragment_uniform(M(s, d), SEED, FRAGMENT[0], FRAGMENT[1], 60).groupBy("transcript_id").agg(F.count("*").alias("pieces"), F.sum(F.length("sequence")).alias("bases")),
    "fragment_beta": lambda s, d: fragmentation.fragment_beta(M(s, d), SEED, 0.005, 1.0, 20, 3, 3, 2).select("row_key", "start", "sequence"),
    "fragment_beta_all_bonds": lambda s, d: fragmentation.fragment_beta(M(s, d), SEED, 1e12, 1.0, 1, 3, 3, 1).select("row_key", "start", "sequence"),
    "first_strand": lambda s, d: synthesis.first_strand(M(s, d), SEED, PPM, expected=True).select("row_key", "molecule_id", "start", "sequence"),
    "second_strand": lambda s, d: synthesis.second_strand(synthesis.first_strand(M(s, d), SEED, PPM, expected=True), SEED, PPM, expected=True).select("row_key", "start", "sequence"),
    "first_strand_binomial": lambda s, d: synthesis.first_strand(M(s, d), SEED, PPM).select("row_key", "start", "sequence", "source_start", "source_cigar", "source_strand"),
    "first_strand_every_prime": lambda s, d: synthesis.first_strand(M(s, d), SEED, PPM, primes_per_kb=1000).select("row_key", "start", "sequence"),
    "perfect_priming": lambda s, d: synthesis.first_strand(M(s, d), SEED, PPM, perfect=True).select("row_key", "start", "strand", "sequence"),
    "ribozero_score": lambda s, d: M(s, d).select("row_key", F.posexplode(ribozero.alignment_scores(F.col("sequence"), OLIGOS)).alias("site", "score")),
    "ribozero_sites_above": lambda s, d: oligos.sites_above(M(s, d), MIXED, LEAST),
    "ribozero_drop": lambda s, d: ribozero.deplete(M(s, d), SEED, OLIGOS, 0.99, 8, entire=True).select("row_key"),
    "ribozero_split": lambda s, d: ribozero.deplete(M(s, d), SEED, OLIGOS, 0.99, 8).select("row_key", "start", "sequence"),
    "adapter_ligate": lambda s, d: adapters.ligate(M(s, d), samples(s)).select("row_key", "sequence", "cigar"),
    "adapter_pairs": lambda s, d: adapters.adapter_pairs(kit(s)),
    "cigar_parse": lambda s, d: M(s, d).select("row_key", F.posexplode(cg.spans("source_cigar", "source_start")).alias("part", "x")).select("row_key", "part", "x.op", "x.n", "x.q", "x.r"),
    "cigar_chain": lambda s, d: M(s, d).select("row_key", cg.chain(F.lit(11), F.lit("30M"), F.lit("+"), F.col("source_start"), F.col("source_cigar"), F.lit("+")).alias("c")).select("row_key", "c.*"),
    "cigar_chain_spliced": lambda s, d: spliced(M(s, d)).select("row_key", cg.chain(F.lit(3), F.col("own_cigar"), F.col("own_strand"), F.col("source_start"), F.col("source_cigar"), F.col("source_strand")).alias("c")).select("row_key", "c.*"),
    "cigar_chain_matched": lambda s, d: M(s, d).withColumn("matched", F.expr("cast(regexp_extract(source_cigar, '^([0-9]+)M', 1) as bigint)")).select("row_key", cg.chain_matched(F.lit(11), F.lit(30), F.lit("+"), F.col("source_start"), F.col("matched"), F.length("sequence"), F.lit("+")).alias("c")).select("row_key", "c.*"),
    "pcr_gc_success": lambda s, d: M(s, d).select("row_key", F.round(pcr.success_rate(sq.gc_content("sequence"), *PCR_BIAS), 9).alias("rate")),
    "pcr_amplify": lambda s, d: amplified(M(s, d)).select("row_key", "molecule_id", "leaf"),
    "pcr_duplicate_histogram": lambda s, d: analytics.duplicate_histogram(amplified(M(s, d)), F.col("pcr_parent_id")),
    "pcr_parent_by_name": lambda s, d: analytics.duplicate_histogram(amplified(M(s, d)).filter("leaf > 0"), analytics.parent_id(F.col("molecule_id"))),
    "pcr_errors": lambda s, d: pcr.amplify(M(s, d), SEED, PCR_CYCLES, PCR_PERCENT, *PCR_BIAS, substitution=0.01, insertion=0.002, deletion=0.002).select("row_key", "sequence", "cigar", "source_start", "source_cigar"),
    "pcr_substitutions": lambda s, d: pcr.amplify(M(s, d), SEED, PCR_CYCLES, PCR_PERCENT, *PCR_BIAS, substitution=0.01).select("row_key", F.length("sequence").alias("size"), "cigar"),
    "lane_assign": lambda s, d: flowcell.assign_lanes(M(s, d), (1, 3, 4)).select("row_key", "lane", "cluster_id"),
    "coords_random": lambda s, d: flowcell.random_coordinates(M(s, d), SEED, CELL).select("row_key", "coordinates.*"),
    "coords_distinct": lambda s, d: flowcell.distinct_coordinates(M(s, d), SEED, CELL).select("row_key", "coordinates.*"),
    "cluster_sort": lambda s, d: flowcell.sort_packets(loaded(s, d)).select("sample_id", "packet_id", "coordinates.*", "row_key"),
    "bridge_counts_exact": lambda s, d: sequencing.bridge(M(s, d), SEED, 10).select("row_key", "molecule_count", F.aggregate(F.col("base_counts")[0], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("a"), F.aggregate(F.col("base_counts")[1], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("c")),
    "bridge_substitutions": lambda s, d: sequencing.bridge(M(s, d), SEED, 10, 0.01).select("row_key", "molecule_count", "base_counts"),
    "bridge_substitution_totals": lambda s, d: sequencing.bridge(M(s, d), SEED, 10, 0.01).select("row_key", places_whole(F.col("base_counts"), F.col("molecule_count")).alias("places")),
    "sbs_clean": lambda s, d: sequencing.explode_reads(sequencing.sequence(sequencing.bridge(adapters.ligate(M(s, d), samples(s)), SEED, 10), SEED, replace(CHEMISTRY, skip_rate=0.0, drop_rate=0.0)), "row_key", "called_barcode").select("row_key", "direction", "called_barcode", "called_sequence"),
    "sbs_call": lambda s, d: sequencing.explode_reads(sequencing.sequence(sequencing.bridge(adapters.ligate(M(s, d), samples(s)), SEED, 10, 0.01), SEED, CHEMISTRY), "row_key", "called_barcode"),
    "demultiplex": lambda s, d: analytics.demultiplex(called(M(s, d)), samples(s)).select("row_key", "called_barcode", "status"),
    "unidentified_count": lambda s, d: analytics.demultiplex(called(M(s, d)), samples(s)).groupBy("sample_id", "status").agg(F.count("*").alias("n")),
    "demultiplex_all_samples": lambda s, d: barcodes.identify(order_reads(s, d), customer_codes(s, d)),
    "barcode_matches": lambda s, d: barcodes.matches(order_reads(s, d), customer_codes(s, d).select("sample_id", F.concat("i5", "i7").alias("code")), 2),
    "fastq_records": lambda s, d: formats.fastq_records(identified(s, d)),
    "sam_records": lambda s, d: formats.sam_records(identified(s, d)),
    "sam_mates": lambda s, d: formats.sam_records(identified(s, d), mates=True).select("qname", "flag", "pos", "rnext", "pnext", "tlen"),
    "fastq_in_order": _fastq,
    "bam_round_trip": lambda s, d: bam.read_records(s, _bam(s, d), "*.bam"),
    "bam_coverage": lambda s, d: analytics.coverage(bam.read_bam(s, _bam(s, d), "*.bam")),
    "pileup_coverage": lambda s, d: analytics.coverage(M(s, d)),
    "step_summary": lambda s, d: analytics.step_summary(size_selected(M(s, d)), M(s, d)),
    "occurring_ids": lambda s, d: M(s, d).select("row_key").join(fragments(size_selected(M(s, d))).select(F.split_part("row_key", F.lit("."), F.lit(1)).alias("row_key")).distinct(), "row_key", "left_semi"),
    "occurring_ids_bitmaps": lambda s, d: idmaps.occurring(M(s, d), idmaps.ordinals(fragments(size_selected(M(s, d))))).select("row_key"),
    "missing_ids_bitmaps": lambda s, d: idmaps.occurring(M(s, d), idmaps.ordinals(fragments(size_selected(M(s, d)))), there=False).select("row_key"),
    "step_summary_bitmaps": lambda s, d: idmaps.step_summary(size_selected(M(s, d)), M(s, d)),
    "interval_overlaps": lambda s, d: genomes.overlaps(line_intervals(s, d), part_intervals(s, d)).select("l_orderkey", "l_linenumber", "p_partkey", "chrom", "first", "last"),
    "genome_blocks": order_blocks,
    "transcript_alignments": lambda s, d: genomes.transcript_alignments(line_exons(s, d), order_blocks(s, d)),
    "packet_union": lambda s, d: M(s, d).filter("packet_id < 2").unionByName(M(s, d).filter("packet_id >= 2").withColumn("packet_id", F.col("packet_id") + 10)).groupBy("packet_id").agg(F.count("*").alias("n")),
    "missing_samples": lambda s, d: M(s, d).select("sample_id").distinct().exceptAll(samples(s).filter("sample_id = '1'").select("sample_id")),
    "phred_codes": lambda s, d: M(s, d).select("row_key", sq.phred_char(F.col("ordinal") % 60).alias("code"), sq.phred_scores(sq.phred_char(F.col("ordinal") % 60))[0].alias("score")),
    "molecule_file_packets": _molecule_files,
    "library_prep": lambda s, d: library_prep(M(s, d), s).select("row_key", "sequence", "source_start", "source_cigar", "source_strand"),
    "library_prep_exact": lambda s, d: exact_prep(M(s, d), s).select("row_key", "molecule_id", "sequence"),
    "molecules_from_distribution": lambda s, d: formats.draw_molecules(s, analytics.quantify(M(s, d)).groupBy("transcript_id").agg(F.sum("counts").alias("weight")), 5000, SEED).groupBy("transcript_id").agg(F.count("*").alias("n")),
    "lineitem_quant": lambda s, d: analytics.quantify(size_selected(from_lineitem(s, d))),
}
