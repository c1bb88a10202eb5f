"""BAM files: written by tasks and joined by tasks, and read in splits of any size. No record comes to the driver.

A BAM file is a row of gzip members (blocks) of at most 64 KB, which all begin with the same bytes. Spark's text reader, told that
these bytes separate lines, hands out whole blocks whatever the splits. What a split can't know is where in its first block a record begins:
it looks for a place from which records follow one another, and hands on the bytes before it and those of the record that its last block
leaves open. Between two splits these must add up to whole records, which is checked.

Edge cases: a file without records gives no rows; records longer than a block or a split are put together; a damaged block, a
file that ends within a record, and blocks of another form are errors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cigar import PART, REFERENCE
from strandloom.runtime import ship
from strandloom.sources.formats import PLACE, SAM_FIELDS, move_single, sam_header, sam_records

#: Codes of bases and of alignment operations (fixed values of the SAM specification).
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
#: How every block begins: a gzip member with an extra field BC of two bytes (fixed values of the SAM specification).
MAGIC = bytes.fromhex("1f8b08040000000000ff060042430200")
#: The empty block that ends a file (fixed value of the SAM specification).
END = MAGIC + bytes.fromhex("1b0003000000000000000000")
#: Bytes of records in a block, and of blocks in a row of the table that they are written to first.
BLOCK, ROW = 60_000, 1 << 20
#: Records that must follow one another before a place is taken for the beginning of one.
ENOUGH = 16

_NIBBLES = bytes(BASES.find(chr(c).upper()) if chr(c).upper() in BASES else 15 for c in range(256))
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
_SCORES = bytes(max(0, c - 33) for c in range(256))
_PHRED = bytes(min(126, c + 33) for c in range(256))
KEYS = ["sample_id", "lane", "status"]


def block(data: bytes) -> bytes:
    """One block of at most 64 KB of data."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return MAGIC + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))


def unpacked(body: bytes) -> bytes:
    """The data of a block, given what follows MAGIC. Its size and checksum must be right."""
    if len(body) < 10 or struct.unpack_from("<H", body)[0] + 1 != len(body) + len(MAGIC):
        raise ValueError("a block of another size than it says, or of another form")
    data = zlib.decompress(body[2:-8], -15)
    if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a damaged block")
    return data


def region_bin(begin: int, end: int) -> int:
    """The smallest bin of the binning index that holds [begin, end); 0 beyond the index's 2 ** 29 places."""
    end -= 1
    if end >> 29:
        return 0
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def record(qname: str, flag: int, ref: int, pos: int, mapq: int, cigar: str, next_ref: int, pnext: int, tlen: int, seq: str, qual: str) -> bytes:
    """One alignment; pos and pnext count from 1, references from 0, -1 for none."""
    ops = [] if cigar == "*" else [(int(n), op) for n, op in PART.findall(cigar or "")]
    name = qname.encode() + b"\0"
    bases = b"" if seq == "*" else seq.encode().translate(_NIBBLES)
    codes = np.frombuffer(bases + b"\0" * (len(bases) % 2), np.uint8)
    scores = b"\xff" * len(bases) if qual == "*" else qual.encode().translate(_SCORES)
    end = pos - 1 + max(1, sum(n for n, op in ops if op in REFERENCE))
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name), mapq, region_bin(max(0, pos - 1), max(1, end)), len(ops), flag, len(bases), next_ref, pnext - 1, tlen)
    body += name + b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in ops) + (codes[::2] << 4 | codes[1::2]).tobytes() + scores
    return struct.pack("<i", len(body)) + body


def fields(data: bytes, at: int, names: list[str]) -> tuple:
    """The eleven fields of SAM of the record that begins there."""
    ref, pos, n_name, mapq, _, n_ops, flag, size, next_ref, pnext, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
    p = at + 36
    qname = data[p : p + n_name - 1].decode()
    p += n_name
    cigar = "".join([f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, p)])
    p += 4 * n_ops
    seq = "".join(map(_PAIRS.__getitem__, data[p : p + (size + 1) // 2]))[:size]
    p += (size + 1) // 2
    qual = data[p : p + size]
    named = lambda i: names[i] if i >= 0 else "*"
    return (
        qname, flag, named(ref), pos + 1, mapq, cigar or "*", "=" if next_ref == ref >= 0 else named(next_ref), pnext + 1, tlen, seq or "*",
        "*" if not size or qual[0] == 255 else qual.translate(_PHRED).decode(),
    )


def header(names: list[tuple[str, int]], text: str) -> bytes:
    out = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(names))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in names)


def parsed_header(data: bytes) -> tuple[list[str], int] | None:
    """Names of the references and the size of the header, or None if the data end within it."""
    try:
        if data[:4] != b"BAM\1"[: len(data)]:
            raise ValueError("no BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
        return (names, at) if at <= len(data) else None
    except struct.error:
        return None


# writing


def encoded(df: DataFrame, contigs: DataFrame, order: bool, mates: bool = False) -> DataFrame:
    """sample_id, lane, status, at, data: blocks of records. at keeps their order: from place to place of the flowcell if order is asked for."""
    ship(df.sparkSession)
    ids = {r["name"]: i for i, r in enumerate(contigs.orderBy("ordinal").select("name").collect())}  # contigs are a bounded table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, full, n = None, [], [], 0

        def close() -> None:
            nonlocal open_, n
            if open_:
                full.append(blocks(b"".join(open_)))
            open_, n = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip((*key, b"".join(full)), kinds, strict=True)], [*KEYS, "data"])

        kinds = (pa.string(), pa.int32(), pa.string(), pa.binary())
        for b in batches:
            for *at, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != key and key is not None:
                    close()
                    yield row()
                    full = []
                key = at
                ref = ids.get(rname, -1)
                r = record(qname, flag, ref, pos, mapq, cigar, ref if rnext == "=" else ids.get(rnext, -1), pnext, tlen, seq, qual)
                if n + len(r) > BLOCK:  # records begin blocks where they can
                    close()
                open_.append(r)
                n += len(r)
                if sum(map(len, full)) > ROW:
                    close()
                    yield row()
                    full = []
        if open_ or full:
            close()
            yield row()

    rows = sam_records(df, extra=tuple(PLACE) if order else (), mates=mates).withColumn("lane", F.col("lane").cast("int"))
    place = [c.split(".")[-1] for c in PLACE]
    rows = rows.repartitionByRange(*KEYS, *place).sortWithinPartitions(*KEYS, *place) if order else rows.sortWithinPartitions(*KEYS)
    rows = rows.select(*KEYS, *SAM_FIELDS).mapInArrow(run, "sample_id string, lane int, status string, data binary")
    return rows.withColumn("at", F.monotonically_increasing_id())


def write_bam(df: DataFrame, contigs: DataFrame, path: str, order: bool = False, whole: bool = True, mates: bool = False) -> list[str]:
    """One file for each sample, lane and status: S<sample>_L<lane>_<status>.bam, in the order of places if order is asked for.

    Tasks write blocks; then, for each file, one task copies its blocks, which are compressed by then, from a sorted shuffle that spills. Not whole: folders
    of that name hold parts in order instead, which read one after another are the file, and no task sees more than a part.
    A run that fails leaves no file.
    """
    spark = df.sparkSession
    names = [(r["name"], int(r["length"])) for r in contigs.orderBy("ordinal").select("name", "length").collect()]
    head = blocks(header(names, "".join(f"{x}\n" for x in sam_header(contigs))))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        encoded(df, contigs, order, mates).write.mode("overwrite").option("compression", "none").parquet(f"{path}/_blocks")
        found = spark.read.parquet(f"{path}/_blocks")
        ends = found.select(*KEYS).distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(at).cast("bigint").alias("at"), F.lit(bytes(d)).alias("data")) for at, d in ((-1, head), ((1 << 63) - 1, END))])))
        rows = found.select(*KEYS, "at", "data").unionByName(ends.select(*KEYS, "x.at", "x.data"))
        rows = (rows.repartition(*KEYS) if whole else rows.repartitionByRange(*KEYS, "at")).sortWithinPartitions(*KEYS, "at")
        # the text writer puts a byte after each row: blocks end in the high byte of a size under 2 ** 16, which is 0 and left to it
        rows = rows.select(*KEYS, F.expr("cast(substring(data, 1, length(data) - 1) as string)").alias("value"))
        rows.write.mode("overwrite").option("lineSep", "\0").partitionBy(*KEYS).text(f"{path}/_files")
        out = []
        for key in found.select(*KEYS).distinct().orderBy(*KEYS).collect():  # a row for each file
            target = f"{path}/S{key[0]}_L{key[1]}_{key[2]}.bam"
            folder = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
            source = f"{path}/_files/" + "/".join(f"{k}={folder.escapePathName(str(v))}" for k, v in zip(KEYS, key, strict=True))
            if whole:
                move_single(spark, source, target)
            else:
                fs.delete(hadoop(target), True)
                fs.rename(hadoop(source), hadoop(target))
            out.append(target)
        return out
    finally:
        for name in ("_blocks", "_files"):
            fs.delete(hadoop(f"{path}/{name}"), True)


# reading


def first_record(data: bytes, at: int, references: int, end: bool) -> tuple[int | None, int]:
    """Where records begin to follow one another, if that can be told, and the first place that isn't ruled out yet. end: there are no more data."""
    while at < len(data):
        p, n = at, 0
        while n < ENOUGH:
            if p + 36 > len(data):
                break
            size, ref, pos, n_name, _, _, n_ops, _, seq, next_ref, pnext, _ = struct.unpack_from("<iiiBBHHHiiii", data, p)
            if not (size >= 33 and -1 <= ref < references and -1 <= next_ref < references and pos >= -1 and pnext >= -1 and n_name and seq >= 0 and 32 + n_name + 4 * n_ops + (seq + 1) // 2 + seq <= size):
                n = -1
                break
            if p + 36 + n_name + 4 * n_ops > len(data):
                break
            name = data[p + 36 : p + 36 + n_name]
            if name[-1] or not all(33 <= c <= 126 for c in name[:-1]) or any(x & 15 > 8 for x in struct.unpack_from(f"<{n_ops}I", data, p + 36 + n_name)):
                n = -1
                break
            if p + 4 + size > len(data):
                break
            p, n = p + 4 + size, n + 1
        if n == ENOUGH or (end and n > 0):
            return at, at
        if n >= 0 and not end:
            return None, at
        at += 1
    return None, at


def whole_records(data: bytes, at: int) -> tuple[list[int], int]:
    """Places of the records that are all there, and where the next one begins."""
    found = []
    while at + 4 <= len(data):
        size = struct.unpack_from("<i", data, at)[0]
        if size < 33:
            raise ValueError("no record where one should begin")
        if at + 4 + size > len(data):
            break
        found.append(at)
        at += 4 + size
    return found, at


class Split:
    """The blocks of one split as they come: rows of whole records, and at the end what its neighbours need."""

    def __init__(self, begin: int, names: list[str], skip: int):
        self.names, self.data, self.head, self.tried = names, b"", b"", 0
        # the file's first split knows where records begin, once it has passed the header
        self.known, self.skip = begin == 0, skip if begin == 0 else 0

    def add(self, data: bytes, end: bool = False) -> tuple[bytes, list[int]]:
        self.data += data
        if self.skip:
            cut = min(self.skip, len(self.data))
            self.data, self.skip = self.data[cut:], self.skip - cut
        if not self.known:
            at, self.tried = first_record(self.data, self.tried, len(self.names), end)
            if at is None:
                return b"", []
            self.head, self.data, self.known = self.data[:at], self.data[at:], True
        found, rest = whole_records(self.data, 0)
        now, self.data = self.data, self.data[rest:]
        return now, found

    def edge(self) -> tuple[bytes, bytes, bool, int]:
        """Bytes before the first record and after the last whole one, whether a record begins here at all, and bytes of the header that are still to come."""
        return (self.head, self.data, True, self.skip) if self.known else (self.data, b"", False, 0)


RECORDS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
EDGES = "file string, begin long, head binary, tail binary, known boolean, skip long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], SAM_FIELDS)


def one_form(file: str) -> str:
    """A file's address; Spark writes file:/ or file:/// from place to place."""
    scheme, _, rest = file.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def read_header(spark: SparkSession, file: str) -> tuple[list[str], int]:
    """Names of the references of a file, and the size of its header. Only the blocks that hold it are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(file))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    data = b""
    try:
        while True:
            start = bytes(stream.readNBytes(len(MAGIC) + 2))
            if start[: len(MAGIC)] != MAGIC:
                raise ValueError(f"{file}: blocks of another form, or no BAM file")
            size = struct.unpack("<H", start[-2:])[0] + 1 - len(start)
            data += unpacked(start[-2:] + bytes(stream.readNBytes(size)))
            found = parsed_header(data)
            if found:
                return found
    finally:
        stream.close()


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The eleven fields of every record of BAM files, in any order. Splits follow spark.sql.files.maxPartitionBytes. Nothing is read before an action but headers."""
    ship(spark)
    separator = MAGIC.decode("latin-1")
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", separator).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    headers = {f: read_header(spark, f) for f in text.inputFiles()}
    contents = sorted({tuple(names) for names, _ in headers.values()})  # files of one run have the same
    of = {one_form(f): (contents.index(tuple(names)), size) for f, (names, size) in headers.items()}
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("value"))

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Split, bytes, list[int]]]:
        """Whole records as they are met; with the last of a split, all its blocks have been seen."""
        key, split = None, None
        for b in batches:
            for file, begin, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (file, begin) != key:
                    if split:
                        yield *key, split, *split.add(b"", True)
                    key, (i, size) = (file, begin), of[one_form(file)]
                    split = Split(begin, list(contents[i]), size)
                if value:
                    yield None, 0, split, *split.add(unpacked(value))
        if split:
            yield *key, split, *split.add(b"", True)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, _, split, data, found in splits(batches):
            rows.extend([fields(data, at, split.names) for at in found])
            if len(rows) > 5000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin, split, _, _ in splits(batches):
            if file is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, begin, *split.edge())], ["file", "begin", "head", "tail", "known", "skip"])

    def between(group: pa.Table) -> pa.Table:
        """Records that reach over the ends of splits, of one file: small pieces, two for each split."""
        rows = sorted(group.to_pylist(), key=lambda r: r["begin"])
        names = list(contents[of[one_form(rows[0]["file"])][0]])
        out, open_, skip = [], b"", 0

        def close(data: bytes) -> None:
            found, rest = whole_records(data, 0)
            if rest != len(data):
                raise ValueError(f"{rows[0]['file']}: bytes between two splits, or at the end, that make no whole records")
            out.extend(fields(data, at, names) for at in found)

        for r in rows:
            head = r["head"]
            if skip:
                cut = min(skip, len(head))
                head, skip = head[cut:], skip - cut
            open_ += head
            if r["known"]:
                close(open_)
                open_, skip = r["tail"], r["skip"]
        close(open_)
        return pa.Table.from_batches([_batch(out)]) if out else pa.table({n: pa.array([], k) for n, k in zip(SAM_FIELDS, _KINDS, strict=True)})

    crossing = raw.mapInArrow(edges, EDGES).groupBy("file").applyInArrow(between, RECORDS)
    return raw.mapInArrow(records, RECORDS).unionByName(crossing)


def read_bam(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Reads of BAM files, with the columns of read_sam."""
    turned, second = F.col("flag").bitwiseAND(16) != 0, F.col("flag").bitwiseAND(128) != 0
    return read_records(spark, path, pattern).select(
        F.col("qname").alias("molecule_id"), "flag", F.col("rname").alias("source_chrom"), F.col("pos").alias("source_start"), F.col("cigar").alias("source_cigar"),
        F.when(turned == second, "+").otherwise("-").alias("source_strand"), F.col("seq").alias("sequence"), F.col("qual").alias("quality"),
    )
