"""Readers and writers: molecule tables, FASTA, FASTQ, SAM, adapter kits; FASTQ, SAM, counts, packets, step logs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import rng
from strandloom.functions.cigar import reference_length
from strandloom.functions.sequence import reverse_complement, sam_flag
from strandloom.operators.molecules import COLUMNS

#: Name of the instrument in read names.
INSTRUMENT = "LOOM"
MOLECULE_FIELDS = ["transcript_id", "chrom", "parental_start", "parental_cigar", "ref_start", "ref_cigar", "strand", "sequence"]
MOLECULE_SCHEMA = "transcript_id string, chrom string, parental_start bigint, parental_cigar string, ref_start bigint, ref_cigar string, strand string, sequence string"


def read_molecules(spark: SparkSession, path: str, sample_id: str, pattern: str = "*molecule_*.txt*") -> DataFrame:
    """Molecules of tab-separated files, whose order by path numbers the packets. Lines that start with # are comments.

    The ordinal is the place in the file, from Spark's own row numbers: files are split as usual, and no line moves but
    for the few counts by part.
    """
    raw = spark.read.schema(MOLECULE_SCHEMA).option("sep", "\t").option("comment", "#").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").csv(path)
    raw = raw.withColumns({"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    parts = raw.groupBy("_path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = parts.select("_path").distinct().withColumn("packet_id", (F.row_number().over(Window.orderBy("_path")) - 1).cast("int"))
    parts = parts.withColumn("_before", before).drop("_n").join(files, "_path")
    m = raw.join(parts, ["_path", "_block"]).withColumn("ordinal", F.col("_row") - F.col("_first") + F.col("_before"))
    key = F.concat_ws("-", F.lit(sample_id), "packet_id", "ordinal")
    return m.select(
        F.lit(sample_id).alias("sample_id"), "packet_id", "ordinal", key.alias("row_key"), F.concat(F.lit("m"), key).alias("molecule_id"), "transcript_id", F.upper("sequence").alias("sequence"),
        F.col("parental_start").alias("start"), F.col("parental_cigar").alias("cigar"), F.lit("+").alias("strand"), F.col("chrom").alias("source_chrom"), F.col("ref_start").alias("source_start"), F.col("ref_cigar").alias("source_cigar"), F.col("strand").alias("source_strand"),
    ).select(*COLUMNS)


def count_files(spark: SparkSession, path: str, pattern: str = "*molecule_*.txt*") -> int:
    """How many molecule files a folder holds; none if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path)):
        return 0
    return len(spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).inputFiles())


def read_distribution(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What molecules are drawn from, in a layout of our own: transcripts.tsv (transcript_id, chrom, ref_start, ref_cigar, strand,
    sequence) and weights.tsv (transcript_id, weight), both without a header."""
    tsv = lambda name, schema: spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(f"{path.rstrip('/')}/{name}.tsv")
    transcripts = tsv("transcripts", "transcript_id string, chrom string, ref_start bigint, ref_cigar string, strand string, sequence string")
    return transcripts.withColumn("sequence", F.upper("sequence")), tsv("weights", "transcript_id string, weight double")


def write_molecules(df: DataFrame, path: str, file: str = "packet_id") -> None:
    """Tab-separated files, one folder for each value of a column (molecule_... names keep the order when read again)."""
    cols = {"transcript_id": "transcript_id", "chrom": "source_chrom", "parental_start": "start", "parental_cigar": "cigar", "ref_start": "source_start", "ref_cigar": "source_cigar", "strand": "source_strand", "sequence": "sequence"}
    rows = df.repartition(F.col(file)).sortWithinPartitions(file, "ordinal").select(F.col(file).cast("string").alias("_file"), *[F.col(v).alias(k) for k, v in cols.items()])
    rows.write.mode("overwrite").option("sep", "\t").partitionBy("_file").csv(f"{path}/_written")  # one job; a file is one task's
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [x.getPath().getName() for x in fs.listStatus(hadoop(f"{path}/_written")) if x.isDirectory()]:
        move_single(spark, f"{path}/_written/{name}", f"{path}/{unquote(name.split('=', 1)[1])}.txt")
    fs.delete(hadoop(f"{path}/_written"), True)


def move_single(spark: SparkSession, folder: str, target: str) -> None:
    """Gives the one part file of a written folder a name of its own, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
    fs.delete(path(target), False)
    if parts:
        fs.rename(parts[0], path(target))
    fs.delete(path(folder), True)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the header), sequence, length, ordinal. Records are split by Spark's reader at each header."""
    text = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''").withColumn("_row", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"^>", "")
    lines = F.split(body, "\r?\n")
    part = F.shiftright("_row", 33)
    # the upper bits of a row's number are its partition, so counts of partitions give the ordinals, and no sequence moves
    counts = text.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    out = text.select(F.split_part(F.trim(lines[0]), F.lit(" "), F.lit(1)).alias("name"), F.upper(F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "")).alias("sequence"), part.alias("_part"), (F.col("_row") - F.shiftleft(part, 33)).alias("_at"))
    return out.join(F.broadcast(before), "_part").select("name", "sequence", F.length("sequence").alias("length"), (F.col("_before") + F.col("_at")).cast("int").alias("ordinal"))


def read_adapter_kit(spark: SparkSession, path: str) -> DataFrame:
    """label, end (3 or 5), sequence from two-line records with headers label-...3... or label-...5..."""
    text = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    head = F.trim(lines[0])
    rest = F.substring_index(head, "-", -1)
    return text.select(F.split_part(head, F.lit("-"), F.lit(1)).alias("label"), F.when(rest.contains("3"), 3).otherwise(5).alias("end"), F.upper(F.trim(lines[1])).alias("sequence"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a SAM file; strand is that of the molecule: reversed first reads and forward second ones are on the minus strand."""
    f = F.split("value", "\t")
    text = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.trim("value") != ""))
    flag = f[1].cast("int")
    turned, second = flag.bitwiseAND(16) != 0, flag.bitwiseAND(128) != 0
    return text.select(f[0].alias("molecule_id"), flag.alias("flag"), f[2].alias("source_chrom"), f[3].cast("bigint").alias("source_start"), f[5].alias("source_cigar"), F.when(turned == second, "+").otherwise("-").alias("source_strand"), f[9].alias("sequence"), f[10].alias("quality"))


def read_name() -> Column:
    c = F.col("coordinates")
    return F.concat_ws(":", F.lit(INSTRUMENT), F.lit("1"), F.col("lane").cast("string"), c["tile"].cast("string"), c["x"].cast("string"), c["y"].cast("string"), F.col("molecule_id"))


def each_read(df: DataFrame) -> DataFrame:
    return df.withColumn("_r", F.explode_outer("reads")).filter("_r is not null")


def fastq_records(df: DataFrame, *extra: str) -> DataFrame:
    """sample_id, lane, direction, status, record of four lines, and the columns asked for."""
    r = F.col("_r")
    head = F.concat(F.lit("@"), read_name(), F.lit("\t"), r["direction"].cast("string"), F.lit(":N:0:"), F.coalesce("called_barcode", F.lit("")))
    return each_read(df).select("sample_id", "lane", r["direction"].alias("direction"), "status", F.concat_ws("\n", head, r["called_sequence"], F.lit("+"), r["quality"]).alias("record"), *extra)


PLACE = ["coordinates.tile", "coordinates.x", "coordinates.y", "molecule_id"]


def in_order(df: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """Rows from key to key and from place to place over numbered partitions: ranges between sampled splitters, each sorted by one task.

    A range is a part of a key's rows or many keys', so no task holds a lane. Files that are written of it carry the number of their
    partition: those of a folder, read by name, are in order.
    """
    return df.repartitionByRange(*keys, *place).sortWithinPartitions(*keys, *place)


def write_fastq(df: DataFrame, path: str, order: bool = False) -> None:
    """Text files in folders by sample, lane, read and status. order: the files of a folder, one after another by name, go from the first
    place of the flowcell to the last."""
    keys = ["sample_id", "lane", "read", "status"]
    out = fastq_records(df, *PLACE) if order else fastq_records(df)
    out = out.withColumnRenamed("direction", "read")
    out = in_order(out, keys, *[c.split(".")[-1] for c in PLACE]) if order else out
    out.select(*keys, "record").write.mode("overwrite").partitionBy(*keys).text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of the FASTQ files that write_fastq left in a folder, their folders' columns, and number: the place (from 1) in the folder's files by name.

    Records are split at their headers by Spark's reader. Numbers are places within a split after the counts of the splits before, so no record moves.
    """
    head = f"@{INSTRUMENT}:"
    raw = spark.read.option("lineSep", f"\n{head}").text(path).filter("value <> ''")
    raw = raw.withColumns({"_file": F.col("_metadata.file_name"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    keys = ["sample_id", "lane", "read", "status"]
    parts = raw.groupBy(*keys, "_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).drop("_n")
    record = F.concat(F.lit(head), F.regexp_replace(F.regexp_replace("value", f"^{head}", ""), "\n$", ""))
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return raw.join(parts, [*keys, "_file", "_block"]).select(F.col("sample_id").cast("string").alias("sample_id"), "lane", "read", "status", number.alias("number"), record.alias("record"))


def sam_records(df: DataFrame, as_stored: bool = False, extra: tuple[str, ...] = (), mates: bool = False) -> DataFrame:
    """sample_id, lane, status and the eleven fields, and the columns asked for. Bases of reversed reads are turned, and so are their qualities, unless as_stored.

    mates: the fields of the mate are filled in, where both reads of a cluster have a place: its place, and the length from the first base of the
    two to the last, below zero for the read that begins later (for the second one if they begin together).
    """
    r = F.col("_r")
    turned = r["strand"] == "-"
    seq = F.when(turned, reverse_complement(r["called_sequence"])).otherwise(r["called_sequence"])
    qual = r["quality"] if as_stored else F.when(turned, F.reverse(r["quality"])).otherwise(r["quality"])
    rnext, pnext, tlen = F.lit("*"), F.lit(0), F.lit(0)
    if mates:
        end = lambda x: x["start"] + reference_length(x["cigar"])
        mate = F.get(F.filter("reads", lambda x: (x["direction"] != r["direction"]) & (x["start"] > 0)), F.lit(0))
        both = mate.isNotNull() & (r["start"] > 0)
        first = (r["start"] < mate["start"]) | ((r["start"] == mate["start"]) & (r["direction"] < mate["direction"]))
        size = F.greatest(end(r), end(mate)) - F.least(r["start"], mate["start"])
        rnext = F.when(both, "=").otherwise("*")
        pnext = F.when(both, mate["start"]).otherwise(0)
        tlen = F.when(both, F.when(first, size).otherwise(-size)).otherwise(0).cast("int")
    return each_read(df).select(
        "sample_id", "lane", "status", read_name().alias("qname"), sam_flag(r["direction"], r["strand"]).alias("flag"), F.col("source_chrom").alias("rname"), r["start"].alias("pos"),
        F.lit(255).alias("mapq"), r["cigar"].alias("cigar"), rnext.alias("rnext"), pnext.alias("pnext"), tlen.alias("tlen"), seq.alias("seq"), qual.alias("qual"), *extra,
    )


SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def sam_header(contigs: DataFrame) -> list[str]:
    """Header lines, for a reference of some thousands of contigs (name, length, ordinal)."""
    return ["@HD\tVN:1.0", *[f"@SQ\tSN:{r['name']}\tLN:{r['length']}" for r in contigs.orderBy("ordinal").select("name", "length").toLocalIterator()]]


def write_sam(df: DataFrame, contigs: DataFrame, path: str, order: bool = False, parts: int | None = None, mates: bool = False) -> None:
    """Text files by sample, lane and status, in so many parts each (as many as shuffles have, unless given), every one a whole SAM file
    with its header. mates: with the fields of the mate. order: the files of a folder, one after another by name, are one SAM file from the first place of the flowcell to the last."""
    spark = df.sparkSession
    parts = 1 if order else parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["sample_id", "lane", "status", "part"]
    place = [c.split(".")[-1] for c in PLACE]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM_FIELDS])
    body = sam_records(df, extra=tuple(PLACE), mates=mates).select(*keys[:3], F.pmod(F.hash("qname"), F.lit(parts)).alias("part"), F.lit(1).alias("_rank"), *place, line.alias("value"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in zip(place, ("int", "int", "int", "string"), strict=True)]
    head = body.select(*keys).distinct().select(*keys, F.lit(0).alias("_rank"), *blank, F.lit("\n".join(sam_header(contigs))).alias("value"))
    rows = body.unionByName(head)
    rows = in_order(rows, keys, "_rank", *place) if order else rows.repartition(*keys).sortWithinPartitions(*keys, "_rank")
    rows.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_quant(quant: DataFrame, path: str) -> None:
    """Tab-separated transcript_id and counts, in folders by sample and packet."""
    quant.select("sample_id", "packet_id", "transcript_id", "counts").write.mode("overwrite").partitionBy("sample_id", "packet_id").option("sep", "\t").csv(path)


def read_quant(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("transcript_id string, counts bigint, sample_id string, packet_id int").option("sep", "\t").csv(path)


def write_packets(df: DataFrame, path: str) -> None:
    """Molecules or clusters as Parquet; readers take only the columns they need, so base counts cost nothing unless read."""
    df.write.mode("overwrite").partitionBy("sample_id", "packet_id").parquet(path)


def read_packets(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).withColumns({"sample_id": F.col("sample_id").cast("string"), "packet_id": F.col("packet_id").cast("int")})
    return df.select(*columns) if columns else df


def write_log(df: DataFrame, path: str, note: str, full: bool = False) -> None:
    """The log of a step: its header always, and the molecules with a note if full logs are asked for."""
    rows = df.select("molecule_id", "transcript_id", "sequence", "start", "cigar", "strand", "source_chrom", "source_start", "source_cigar", "source_strand", F.lit(note).alias("note"))
    (rows if full else rows.limit(0)).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def draw_molecules(spark: SparkSession, weights: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows with ordinal and transcript_id, drawn in proportion to weight: a range join on cumulative shares.

    Both sides are cut at the same grid, so the join is on equal cells, whatever the number of transcripts.
    """
    cells = 4096
    total = Window.partitionBy()
    order = Window.orderBy("transcript_id").rowsBetween(Window.unboundedPreceding, 0)  # one row a transcript: a bounded table
    cum = weights.filter("weight > 0").select("transcript_id", "weight", F.sum("weight").over(order).alias("c"), F.sum("weight").over(total).alias("t"))
    cum = cum.select("transcript_id", ((F.col("c") - F.col("weight")) / F.col("t")).alias("low"), (F.col("c") / F.col("t")).alias("high"))
    cum = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)))))
    draws = spark.range(n).select(F.col("id").alias("ordinal"), rng.uniform(seed, "distribution", F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(cum, "cell").filter("u >= low and u < high").select("ordinal", "transcript_id")


def molecules_from_distribution(spark: SparkSession, transcripts: DataFrame, weights: DataFrame, n: int, seed: int, sample_id: str = "1", tails: tuple[int, int] = (50, 250), packet_size: int = 10_000, first_packet: int = 0) -> DataFrame:
    """n molecules drawn in proportion to the weights, as bases of their transcripts and a tail of A of a length drawn evenly.

    transcripts: transcript_id, sequence, chrom, ref_start, ref_cigar, strand. Tails are clipped in the alignment, on the side
    of the molecule's end. Packets are numbered from first_packet, after those of files.
    """
    drawn = draw_molecules(spark, weights, n, seed)
    t = transcripts.select("transcript_id", "sequence", "chrom", "ref_start", "ref_cigar", F.col("strand").alias("source_strand"))
    tail = rng.integer(rng.uniform(seed, "tail", F.col("ordinal")), *tails)
    m = drawn.join(t, "transcript_id").withColumn("_tail", tail)
    clip = F.when(F.col("_tail") > 0, F.concat(F.col("_tail").cast("string"), F.lit("S"))).otherwise("")
    key = F.concat_ws("-", F.lit(sample_id), F.lit("d"), F.col("ordinal").cast("string"))
    seq = F.concat("sequence", F.repeat(F.lit("A"), F.col("_tail").cast("int")))
    return m.select(
        F.lit(sample_id).alias("sample_id"), (F.floor(F.col("ordinal") / packet_size) + first_packet).cast("int").alias("packet_id"), "ordinal", key.alias("row_key"), F.concat(F.lit("m"), key).alias("molecule_id"), "transcript_id",
        seq.alias("sequence"), F.lit(1).cast("bigint").alias("start"), F.concat(F.length(seq).cast("string"), F.lit("M")).alias("cigar"), F.lit("+").alias("strand"), F.col("chrom").alias("source_chrom"),
        F.col("ref_start").alias("source_start"), F.when(F.col("source_strand") == "-", F.concat(clip, "ref_cigar")).otherwise(F.concat("ref_cigar", clip)).alias("source_cigar"), "source_strand",
    )
