import gzip
import struct

from pyspark.sql import functions as F

from strandloom.plans import queries as Q
from strandloom.sources import formats


def test_molecule_files(spark, sf, tmp_path):
    m = Q.from_documents(spark, sf).filter("ordinal < 40").withColumn("file", F.concat(F.lit("molecule_"), (F.col("ordinal") % 2).cast("string")))
    formats.write_molecules(m, tmp_path.as_uri(), "file")
    got = formats.read_molecules(spark, tmp_path.as_uri(), "1").orderBy("packet_id", "ordinal").collect()
    want = m.orderBy("file", "ordinal").collect()
    assert [r.sequence for r in got] == [r.sequence for r in want]
    assert [r.ordinal for r in got] == [*range(20), *range(20)]
    assert [(r.source_start, r.source_cigar, r.source_strand) for r in got] == [(r.source_start, r.source_cigar, r.source_strand) for r in want]


def test_fasta_and_kit(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one first contig\nACGT\nacg\n>two\nTTTT\n>three\n")
    got = [(r["name"], r.sequence, r.length, r.ordinal) for r in formats.read_fasta(spark, (tmp_path / "g.fa").as_uri()).orderBy("ordinal").collect()]
    assert got == [("one", "ACGTACG", 7, 0), ("two", "TTTT", 4, 1), ("three", "", 0, 2)]
    (tmp_path / "kit.fa").write_text(">A01-end5\nACGT\n>B02-end3\nggtt\n")
    assert [tuple(r) for r in formats.read_adapter_kit(spark, (tmp_path / "kit.fa").as_uri()).orderBy("label").collect()] == [("A01", 5, "ACGT"), ("B02", 3, "GGTT")]


def contigs(spark):
    return spark.createDataFrame([("en", 10**9, 0), ("de", 10**9, 1), ("es", 10**9, 2), ("fr", 10**9, 3)], "name string, length long, ordinal int")


def test_fastq_sam(spark, sf, tmp_path):
    reads = Q.identified(spark, sf)
    formats.write_fastq(reads, (tmp_path / "fq").as_uri())
    lines = [r.value for r in spark.read.text((tmp_path / "fq").as_uri()).collect()]
    assert len(lines) == 4 * 2 * reads.count()
    assert sum(x.startswith("@LOOM:1:") for x in lines) == 2 * reads.count()
    formats.write_sam(reads, contigs(spark), (tmp_path / "sam").as_uri())
    body = formats.read_sam(spark, (tmp_path / "sam").as_uri() + "/sample_id=1")
    want = formats.sam_records(reads).filter("sample_id = '1'")
    assert sorted(r.sequence for r in body.collect()) == sorted(r.seq for r in want.collect())
    source = {f"{r.molecule_id}": r.source_strand for r in reads.collect()}
    assert all(r.source_strand == source[r.molecule_id.split(":")[-1]] for r in body.collect())
    assert formats.sam_header(contigs(spark))[:2] == ["@HD\tVN:1.0", "@SQ\tSN:en\tLN:1000000000"]


def test_quant_and_packets(spark, sf, tmp_path):
    from strandloom.operators import analytics

    quant = analytics.quantify(Q.from_documents(spark, sf))
    formats.write_quant(quant, (tmp_path / "q").as_uri())
    back = formats.read_quant(spark, (tmp_path / "q").as_uri()).select("sample_id", "packet_id", "transcript_id", "counts")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, quant.collect()))
    m = Q.from_documents(spark, sf)
    formats.write_packets(m, (tmp_path / "p").as_uri())
    assert sorted(map(tuple, formats.read_packets(spark, (tmp_path / "p").as_uri(), m.columns).collect())) == sorted(map(tuple, m.collect()))
    formats.write_log(m, (tmp_path / "log").as_uri(), "kept", full=True)
    assert spark.read.option("sep", "\t").option("header", "true").csv((tmp_path / "log").as_uri()).count() == m.count()


def test_mates(spark):
    read = "struct<direction:int,called_sequence:string,quality:string,start:bigint,cigar:string,strand:string>"
    one = lambda d, start, cigar: (d, "ACGT", "IIII", start, cigar, "+")
    rows = [("a", [one(1, 100, "4M"), one(2, 90, "2M3N2M")]), ("b", [one(1, 50, "4M"), one(2, 50, "2S2M")]), ("c", [one(1, 10, "4M")]), ("d", [one(1, 0, "4S"), one(2, 7, "4M")])]
    df = spark.createDataFrame(rows, f"molecule_id string, reads array<{read}>")
    df = df.selectExpr("*", "'1' sample_id", "1 lane", "'identified' status", "'x' source_chrom", "named_struct('tile', 1, 'x', 2, 'y', 3) coordinates")
    got = {(r.qname[-1], r.flag & 64 > 0): (r.rnext, r.pnext, r.tlen) for r in formats.sam_records(df, mates=True).collect()}
    assert got == {("a", True): ("=", 90, -14), ("a", False): ("=", 100, 14), ("b", True): ("=", 50, 4), ("b", False): ("=", 50, -4), ("c", True): ("*", 0, 0), ("d", True): ("*", 0, 0), ("d", False): ("*", 0, 0)}


def test_ordered_files(spark, sf, tmp_path):
    """The files of each folder, read by name, are what a full sort gives; there are several, so no task had them all."""
    reads = Q.identified(spark, sf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        formats.write_fastq(reads, (tmp_path / "fq").as_uri(), order=True)
        formats.write_sam(reads, contigs(spark), (tmp_path / "sam").as_uri(), order=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    place = lambda name: (*map(int, name.split("\t")[0].split(":")[3:6]), name.split("\t")[0].split(":")[6])
    seen, files = 0, 0
    for pattern, folder in (("@LOOM", "fq"), ("LOOM", "sam")):
        folders = {f.parent for f in (tmp_path / folder).rglob("*.txt")}
        for d in folders:
            lines = [x for f in sorted(d.glob("*.txt")) for x in f.read_text().splitlines()]
            names = [place(x) for x in lines if x.startswith(pattern)]
            assert names == sorted(names)
            if folder == "sam":
                assert lines[0] == "@HD\tVN:1.0" and sum(x.startswith("@") for x in lines) == 5 == sum(x.startswith("@") for x in lines[:5])
            seen += len(names)
            files += len(list(d.glob("*.txt")))
        assert files > len(folders)
    assert seen == 4 * reads.count()


def test_fastq_is_read_back_in_order(spark, sf, tmp_path):
    reads = Q.identified(spark, sf)
    formats.write_fastq(reads, tmp_path.as_uri() + "/fq", order=True)
    want = {}
    for r in formats.fastq_records(reads, *formats.PLACE).orderBy("tile", "x", "y", "molecule_id").collect():
        want.setdefault((r.sample_id, r.lane, r.direction, r.status), []).append(r.record)
    for size in ("128m", "777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {}
            for r in formats.read_fastq(spark, tmp_path.as_uri() + "/fq").orderBy("number").collect():
                got.setdefault((r.sample_id, r.lane, r.read, r.status), []).append((r.number, r.record))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}
