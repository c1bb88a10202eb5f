import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics
from strandloom.plans import queries as Q
from strandloom.sources import bam, formats


def contigs(spark):
    return spark.createDataFrame([("en", 10**9, 0), ("de", 10**9, 1), ("es", 10**9, 2), ("fr", 10**9, 3)], "name string, length long, ordinal int")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*formats.SAM_FIELDS).collect())


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    """BAM files of all reads, and the reads."""
    path = tmp_path_factory.mktemp("with space") / "bam"
    reads = Q.identified(spark, sf)
    return reads, bam.write_bam(reads, contigs(spark), f"file:{path}"), path


def test_files_hold_what_was_written(spark, written):
    reads, files, path = written
    assert sorted(f.rsplit("/", 1)[1] for f in files) == sorted(p.name for p in path.iterdir() if not p.name.startswith("."))
    seen = []
    for p in path.glob("*.bam"):
        raw = p.read_bytes()
        assert raw.endswith(bam.END) and raw.startswith(bam.MAGIC)
        data = gzip.decompress(raw)
        names, at = bam.parsed_header(data)
        assert names == ["en", "de", "es", "fr"] and b"@SQ\tSN:en\tLN:1000000000" in data[:at]
        found, rest = bam.whole_records(data, at)
        assert rest == len(data)
        sample, lane, status = p.stem.split("_")
        seen += [(sample[1:], int(lane[1:]), status, *bam.fields(data, x, names)) for x in found]
    assert sorted(seen) == sorted(tuple(r) for r in formats.sam_records(reads).select("sample_id", "lane", "status", *formats.SAM_FIELDS).collect())


@pytest.mark.parametrize("size", ["128m", "20000", "3001", "517", "64"])
def test_any_split_gives_the_same_rows(spark, written, size):
    reads, _, path = written
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = bam.read_records(spark, f"file:{path}" if size != "64" else f"file:{next(iter(path.glob('*unidentified.bam')))}")
        if size != "128m":
            assert got.rdd.getNumPartitions() > 4 or size == "20000"
        if size == "64":  # every split is a part of a block
            assert got.count() == formats.sam_records(reads).filter("status = 'unidentified'").groupBy("sample_id", "lane").count().filter("count = %d" % got.count()).first()["count"]
        else:
            assert rows_of(got) == rows_of(formats.sam_records(reads))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_coverage_equals_that_of_sam(spark, written, tmp_path):
    reads, _, path = written
    formats.write_sam(reads, contigs(spark), (tmp_path / "sam").as_uri())
    one = analytics.coverage(bam.read_bam(spark, f"file:{path}", "*.bam"))
    two = analytics.coverage(formats.read_sam(spark, (tmp_path / "sam").as_uri()))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def made(n, contig_count, seed=1):
    """Data of a BAM file with records of all sizes, some far longer than a block."""
    r = random.Random(seed)
    names = [f"contig{i}" for i in range(contig_count)]
    rows = []
    for i in range(n):
        size = r.choice([0, 1, 7, 100, 101, 3000, 90_000 if i % 20 == 0 else 50])
        ref = r.randrange(-1, contig_count)
        rows.append((
            f"read{i}", r.randrange(4096), names[ref] if ref >= 0 else "*", r.randrange(0, 2**30), r.randrange(256), "*" if i % 5 == 0 else f"{size}M3N2I1D4S", r.choice(["*", "=" if ref >= 0 else "*", names[0] if ref > 0 else "*"]),
            r.randrange(0, 2**30), r.randrange(-1000, 1000), "".join(r.choice("ACGTN=MR") for _ in range(size)) or "*", "*" if not size or i % 7 == 0 else "".join(chr(33 + r.randrange(60)) for _ in range(size)),
        ))
    ids = {n: i for i, n in enumerate(names)}
    of = lambda name, own: own if name == "=" else ids.get(name, -1)
    data = bam.header([(n, 1000) for n in names], "@HD\tVN:1.0\n")
    data += b"".join(bam.record(q, f, ids.get(n, -1), p, m, c, of(x, ids.get(n, -1)), pn, t, s, ql) for q, f, n, p, m, c, x, pn, t, s, ql in rows)
    return rows, data


@pytest.mark.parametrize(("contig_count", "step", "size"), [(3, 60_000, "30000"), (3, 1009, "900"), (4000, 997, "5000"), (1, 65_000, "128m"), (4000, 60_000, "2000")])
def test_records_over_blocks_and_splits(spark, tmp_path, contig_count, step, size):
    """Blocks cut anywhere, records longer than blocks and splits, and a header that reaches over splits."""
    want = []
    for k in range(2):
        rows, data = made(50, contig_count, k)
        (tmp_path / f"{k}.bam").write_bytes(b"".join(bam.block(data[i : i + step]) for i in range(0, len(data), step)) + bam.END)
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows_of(bam.read_records(spark, tmp_path.as_uri())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_damaged_and_cut_files(spark, tmp_path):
    (tmp_path / "empty.bam").write_bytes(bam.blocks(bam.header([("a", 5)], "")) + bam.END)
    assert bam.read_records(spark, tmp_path.as_uri()).collect() == []
    _, data = made(30, 2)
    good = bam.blocks(data)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.bam").write_bytes(bam.blocks(data[:-5]) + bam.END)
    with pytest.raises(Exception, match="no whole records"):
        bam.read_records(spark, (tmp_path / "cut").as_uri()).count()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.bam").write_bytes(good[:2000] + bytes([good[2000] ^ 1]) + good[2001:] + bam.END)
    with pytest.raises(Exception, match="block|zlib|Error"):
        bam.read_records(spark, (tmp_path / "bad").as_uri()).count()
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "x.bam").write_bytes(gzip.compress(data))
    with pytest.raises(ValueError, match="another form"):
        bam.read_records(spark, (tmp_path / "gz").as_uri())


def test_a_failed_run_leaves_nothing(spark, sf, tmp_path):
    reads = Q.identified(spark, sf).filter("ordinal < 50")
    broken = reads.withColumn("reads", F.transform("reads", lambda r: r.withField("start", F.when(F.col("ordinal") == 33, F.lit(1 << 40)).otherwise(r["start"]))))
    with pytest.raises(Exception, match="struct|range|format"):
        bam.write_bam(broken, contigs(spark), tmp_path.as_uri() + "/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")]


def test_ordered_and_in_parts(spark, sf, tmp_path):
    reads = Q.identified(spark, sf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bam.write_bam(reads, contigs(spark), (tmp_path / "whole").as_uri(), order=True)
        bam.write_bam(reads, contigs(spark), (tmp_path / "parts").as_uri(), order=True, whole=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n = 0
    for p in (tmp_path / "whole").glob("*.bam"):
        data = gzip.decompress(p.read_bytes())
        names, at = bam.parsed_header(data)
        places = [(*map(int, q.split(":")[3:6]), q.split(":")[6]) for q in (bam.fields(data, x, names)[0] for x in bam.whole_records(data, at)[0])]
        assert places == sorted(places)
        n += len(places)
        parts = sorted((tmp_path / "parts" / p.name).glob("part-*"))
        assert gzip.decompress(b"".join(x.read_bytes() for x in parts)) == data
    assert n == 2 * reads.count()
    assert struct.unpack("<H", bam.END[16:18])[0] + 1 == len(bam.END)
