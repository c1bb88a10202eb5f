"""Invariants of each step on inputs where they could fail, and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import adapters, analytics, flowcell, fragmentation, pcr, ribozero, selection, sequencing, synthesis
from strandloom.operators.molecules import COLUMNS

SCHEMA = "sample_id string, packet_id int, ordinal long, row_key string, molecule_id string, transcript_id string, sequence string, start long, cigar string, strand string, source_chrom string, source_start long, source_cigar string, source_strand string"


def molecules(spark, seqs, source_start=5_000_000_000):
    rows = [(str(i % 2 + 1), i % 3, i, f"k{i}", "5", "T", s, 5, f"{len(s)}M", "+", "X", source_start, f"{len(s)}M", "-+"[i % 2]) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, SCHEMA)


def random_seqs(n, size, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("ACGT") for _ in range(size)) for _ in range(n)]


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_polya_keeps_the_tailed(spark):
    seqs = [s[:-1] + "C" + ("A" * 500 if i < 5 else "") for i, s in enumerate(random_seqs(10, 3000))]
    kept = selection.polya_select(molecules(spark, seqs), 0, 0.0, 1.0, 40, 0.05)
    assert {r.row_key for r in kept.collect()} == {f"k{i}" for i in range(5)}
    broken = selection.polya_break(kept, 0, 0.01).collect()
    assert len(broken) == 5
    for r in broken:
        s = seqs[int(r.row_key[1:])]
        assert s.endswith(r.sequence) and s[r.start - 1 :] == r.sequence and len(r.sequence) >= 500


def test_size_select(spark):
    m = molecules(spark, [s for n in (50, 250, 1000) for s in random_seqs(10, n, n)])
    assert {len(r.sequence) for r in selection.size_select(m, 0, 100, 400, 200, 300).collect()} == {250}
    assert selection.size_select(m, 0, 100, 400, 200, 300).count() == 10
    assert selection.size_select(m.limit(0), 0, 100, 400).count() == 0


def test_fragments_partition_the_parent(spark):
    seqs = [*random_seqs(10, 300), "", "A"]
    for out in (fragmentation.fragment_uniform(molecules(spark, seqs), 0, 0.05, 1, 1), fragmentation.fragment_beta(molecules(spark, seqs), 0, 0.05, 1, 1, 3, 3, 1)):
        parts = {}
        for r in out.collect():
            parts.setdefault(r.row_key.split(".")[0], []).append((r.start, r.sequence, r.source_start))
        for i, s in enumerate(seqs):
            got = sorted(parts.get(f"k{i}", []))
            assert "".join(x[1] for x in got) == s
            assert len(got) > 3 or len(s) < 2


def test_fragment_rate(spark):
    p = fragmentation.break_probability(0.02, 1)
    n = fragmentation.fragment_uniform(molecules(spark, random_seqs(200, 501)), 3, 0.02, 1, 1).count() - 200
    assert abs(n - 200 * 500 * p) < 5 * np.sqrt(200 * 500 * p)


def test_fragment_places_on_the_genome(spark):
    for r in fragmentation.fragment_uniform(molecules(spark, random_seqs(10, 200), 1000), 0, 0.05, 1, 1).collect():
        n = len(r.sequence)
        want = 1000 + r.start - 1 if r.source_strand == "+" else 1000 + 200 - (r.start - 1) - n
        assert (r.source_start, r.source_cigar) == (want, f"{n}M")


@pytest.mark.parametrize("expected", [True, False])
def test_strands(spark, expected):
    seqs = random_seqs(30, 300)
    ppm = {"A": [0.4, 0.1, 0.25], "C": [0.2, 0.3, 0.25], "G": [0.2, 0.3, 0.25], "T": [0.2, 0.3, 0.25]}
    out = synthesis.first_strand(molecules(spark, [*seqs, "AC", ""]), 0, ppm, primes_per_kb=20, expected=expected).collect()
    assert len(out) == 30
    for r in out:
        s = seqs[int(r.row_key[1:].split(".")[0])]
        assert r.sequence == turned(s[r.start - 1 :]) and r.molecule_id == "5.cdna" and r.strand == "-"
    back = synthesis.second_strand(synthesis.first_strand(molecules(spark, seqs), 0, ppm, perfect=True), 0, ppm, perfect=True).collect()
    assert sorted(r.sequence for r in back) == sorted(seqs)
    assert all(r.source_cigar == "300M" for r in back)


def test_earliest_prime_has_the_law_of_the_minimum():
    w = np.array([0.1, 0.4, 0.2, 0.3])
    g, c, k = np.random.default_rng(0), np.cumsum([0.1, 0.4, 0.2, 0.3]), 4
    many = np.searchsorted(c, g.random((50_000, k))).min(1)
    one = np.searchsorted(c, 1 - (1 - g.random(50_000)) ** (1 / k))
    assert np.abs(np.bincount(many, minlength=4) - np.bincount(one, minlength=4)).max() < 800 and len(w) == 4


def test_ribozero(spark):
    oligo = "ACGTTGCAACGGATCCTTAACCGGTTAACC"
    seqs = random_seqs(6, 400, 4)
    site = turned(oligo)
    planted = [site + s if i == 0 else s[:1] + site + s[1:] if i == 1 else s[:200] + site + s[200:] if i < 4 else s for i, s in enumerate(seqs)]
    m = molecules(spark, [*planted, "ACG", ""])
    kept = {r.row_key for r in ribozero.deplete(m, 0, [oligo], 1.0, 100, entire=True).collect()}
    assert kept == {"k4", "k5", "k6", "k7"}
    assert "k0" in {r.row_key for r in ribozero.deplete(m, 0, [oligo], 1.0, 100, entire=True, skip_first=True).collect()}
    parts = {}
    for r in ribozero.deplete(m, 0, [oligo], 1.0, 100).collect():
        parts.setdefault(r.row_key.split(".")[0], []).append((r.start, r.sequence))
    assert [s for _, s in sorted(parts["k2"])] == [seqs[2][:200], seqs[2][200:]]
    assert [s for _, s in sorted(parts["k0"])] == [seqs[0]]
    assert [s for _, s in sorted(parts["k4"])] == [seqs[4]]


def test_oligos_of_several_lengths(spark):
    oligos = ["ACGTTGCAAC", "GGATCC", "TTTTACGGCATT"]
    seqs = [*random_seqs(8, 60, 5), "ACGTNACGTNACGTN", "ACGTACGTACG", ""]
    for r in molecules(spark, seqs).select("sequence", ribozero.alignment_scores(F.col("sequence"), oligos).alias("s")).collect():
        want = [max(sum(i >= len(o) and c in "ACGT" or i < len(o) and c == turned(o)[i] for i, c in enumerate(r.sequence[j : j + 12])) for o in oligos) for j in range(len(r.sequence) - 11)]
        assert r.s == want


def samples(spark):
    return spark.createDataFrame([("1", "AA", "CCCC", "GG", "TT", "GGGG", "AC"), ("2", "AA", "CACA", "GG", "TT", "GTGT", "AC")], "sample_id string, pre_i5 string, i5 string, post_i5 string, pre_i7 string, i7 string, post_i7 string")


def test_ligate(spark):
    seqs = random_seqs(10, 30)
    for r in adapters.ligate(molecules(spark, seqs, 1000), samples(spark)).collect():
        s = seqs[r.ordinal]
        five, three = ("AACCCCGG", "ATTGGGGAC") if r.sample_id == "1" else ("AACACAGG", "ATTGTGTAC")
        assert r.sequence == five + s + three and r.cigar == "8S30M9S"
        assert (r.source_start, r.source_cigar) == (1000, "8S30M9S" if r.source_strand == "+" else "9S30M8S")


def test_adapter_pairs_run_out(spark):
    kit = spark.createDataFrame([("a", 5, "AC"), ("b", 3, "GT")], "label string, end int, sequence string")
    assert adapters.assign_pairs(spark.createDataFrame([("1",)], "sample_id string"), kit).count() == 1
    with pytest.raises(ValueError):
        adapters.assign_pairs(spark.createDataFrame([("1",), ("2",)], "sample_id string"), kit)


@pytest.mark.parametrize("cycles", [4, 12])
def test_pcr_retention(spark, cycles):
    m = molecules(spark, random_seqs(200, 50))
    pct = 100 * 5 / 2**cycles
    out = pcr.amplify(m, 0, cycles, pct, 1.0, 0.0, 0.0).collect()
    assert abs(len(out) - 1000) < 5 * np.sqrt(1000)
    assert len({(r.row_key) for r in out}) == len(out)
    assert all((r.molecule_id == r.pcr_parent_id) == (r.leaf == 0) for r in out)


def test_pcr_failures_take_whole_branches(spark):
    out = pcr.amplify(molecules(spark, random_seqs(50, 60)), 0, 3, 100.0, 0.5, 0.0, 0.0)
    for key in {r.row_key.split(".")[0] for r in out.collect()}:
        leaves = {r.leaf for r in out.filter(F.col("row_key").startswith(key + ".")).collect()} if key == "k0" else {0}
        assert 0 in leaves
    assert pcr.amplify(molecules(spark, ["ACGT"]), 0, 0, 1.0).count() == 1
    assert pcr.amplify(molecules(spark, random_seqs(20, 60)), 0, 3, 100.0, 0.0, 0.0, 0.0).count() == 20


def test_pcr_errors_follow_alignments(spark):
    seqs = random_seqs(20, 80)
    out = pcr.amplify(molecules(spark, seqs, 1000), 0, 3, 100.0, 1.0, 0.0, 0.0, substitution=0.05, insertion=0.02, deletion=0.02).collect()
    from strandloom.functions import cigar as cg

    assert any(r.sequence != seqs[r.ordinal] for r in out)
    for r in out:
        assert cg.query_length(r.cigar) == cg.query_length(r.source_cigar) == len(r.sequence)
        pos = cg.positions(len(r.sequence), r.start, r.cigar, "+")
        same = sum(seqs[r.ordinal][p - 1] == c for p, c in zip(pos, r.sequence, strict=True) if p)
        assert same > 0.6 * len(r.sequence)
        if r.leaf == 0:
            assert r.sequence == seqs[r.ordinal]


def test_lanes_in_blocks(spark):
    def counts(n, lanes):
        m = molecules(spark, ["A"] * n).withColumns({"packet_id": F.lit(0), "sample_id": F.lit("1")})
        got = {r.lane: r["count"] for r in flowcell.assign_lanes(m, lanes).groupBy("lane").count().collect()}
        return [got.get(x, 0) for x in lanes]

    assert counts(10, (1, 2)) == [4, 6]
    assert counts(3, (1, 2)) == [0, 3]
    assert sum(counts(2, (1, 2, 3))) == 2
    assert counts(0, (1, 2)) == [0, 0]


def test_distinct_coordinates(spark):
    g = flowcell.Geometry(tile=(1, 2), x=(0, 4), y=(0, 9), lanes=(1,))
    out = flowcell.distinct_coordinates(molecules(spark, ["A"] * 100), 0, g).select("coordinates.*")
    assert out.distinct().count() == 100
    with pytest.raises(ValueError):
        flowcell.distinct_coordinates(molecules(spark, ["A"] * 101), 0, g)


@pytest.mark.parametrize("rate", [0.0, 0.01])
def test_bridge(spark, rate):
    seqs = random_seqs(10, 100)
    for r in sequencing.bridge(molecules(spark, seqs), 0, 10, rate).collect():
        counts = np.array(r.base_counts)
        assert r.molecule_count == 1024 and (counts.sum(0) == 1024).all()
        right = counts[["ACGT".index(c) for c in seqs[r.ordinal]], range(100)]
        assert (right == 1024).all() if not rate else 0.9 < right.mean() / 1024 < 1


def test_counts_are_unpacked_in_blocks(spark):
    """Whole batches of counts, 10,000 rows or 64 MB, as objects of Python took gigabytes in an executor's workers."""
    batch = (pa.array(map(str, range(1000))), pa.array([[[i]] * 4 for i in range(1000)]))
    cut = list(sequencing.blocks(iter([batch, tuple(x.slice(0, 0) for x in batch), batch])))
    assert [len(k) for k, _ in cut] == [256, 256, 256, 232] * 2 == [len(c) for _, c in cut]
    assert {b.address for _, c in cut for b in c.buffers() if b} == {b.address for b in batch[1].buffers() if b}
    assert [k for few, _ in cut for k in few.to_pylist()] == batch[0].to_pylist() * 2
    seqs = random_seqs(600, 30)
    m = molecules(spark, seqs).coalesce(1)
    got = {r.row_key: r.base_counts for r in sequencing.bridge(m, 0, 10, 0.01).collect()}
    assert got == {r.row_key: r.base_counts for r in sequencing.bridge(m.repartition(5), 0, 10, 0.01).collect()} and len(got) == 600


def test_sequencing_reads_what_is_there(spark):
    seqs = random_seqs(10, 150)
    c = sequencing.Chemistry(read_length=50, pre_i5="AA", post_i5="GG", pre_i7="TT", post_i7="AC", i5_length=4, i7_length=4)
    m = adapters.ligate(molecules(spark, seqs, 1000), samples(spark))
    for r in sequencing.sequence(sequencing.bridge(m, 0, 10, 0.001), 0, c).collect():
        s = seqs[r.ordinal]
        assert r.called_barcode == ("CCCCGGGG" if r.sample_id == "1" else "CACAGTGT")
        one, two = r.reads
        assert sum(a == b for a, b in zip(one.called_sequence, s, strict=False)) >= 49
        assert sum(a == b for a, b in zip(two.called_sequence, turned(s), strict=False)) >= 49
        assert len(one.quality) == len(two.quality) == 50
        forward = r.source_strand == "+"
        assert (one.start, one.cigar, one.strand) == (1000 if forward else 1100, "50M", "+" if forward else "-")
        assert (two.start, two.cigar, two.strand) == (1100 if forward else 1000, "50M", "-" if forward else "+")


def test_skips_have_the_law_of_single_molecules():
    g = np.random.default_rng(0)
    out = np.mean([sequencing.counted_skips(g, 1024, 100, 0.01) for _ in range(50)], axis=0)
    from math import comb

    for k in range(3):
        assert abs(out[99, k] - comb(100, k) * 0.01**k * 0.99 ** (100 - k)) < 0.01
    assert (sequencing.counted_skips(g, 10, 5, 0)[:, 0] == 1).all()


def test_coverage_counts_each_base(spark):
    r = random.Random(1)
    rows = [(i, r.randint(1, 50) + (1 << 20) * (i % 2), r.choice(["10M", "3S5M2D4M", "2M3N2M1I3M", "7S"]), r.choice("+-")) for i in range(60)]
    df = spark.createDataFrame([("c", s, c, d) for _, s, c, d in rows], "source_chrom string, source_start long, source_cigar string, source_strand string")
    depth = {}
    for _, s, c, d in rows:
        from strandloom.functions import cigar as cg

        for p in cg.positions(cg.query_length(c), s, c, "+"):
            if p:
                depth[d, p] = depth.get((d, p), 0) + 1
    got = {}
    for strand in "+-":
        steps = sorted((x.pos, x.depth) for x in analytics.coverage(df).collect() if x.source_strand == strand)
        for (a, k), (b, _) in zip(steps, [*steps[1:], (steps[-1][0], 0)], strict=True):
            got.update({(strand, p): k for p in range(a, b) if k})
    assert got == depth


def test_demultiplex(spark):
    reads = spark.createDataFrame([("1", "CCCCGGGG"), ("1", "CCCCGGGA"), ("1", "CCCCGGAA"), ("1", "CCCC"), ("1", None), ("2", "CCCCGGGG"), ("9", "CCCCGGGG")], "sample_id string, called_barcode string")
    got = [r.status[0] for r in analytics.demultiplex(reads, samples(spark)).orderBy("sample_id", F.desc_nulls_last("called_barcode")).collect()]
    assert sorted(got) == sorted("iiuuuuu")


def test_empty_tables(spark):
    m = molecules(spark, ["A"]).limit(0)
    assert m.columns == COLUMNS
    assert analytics.step_summary(m, m).count() == 0
    assert analytics.coverage(m).count() == 0
    assert flowcell.load(m, 0, flowcell.Geometry(), "distinct").count() == 0
    assert analytics.gc_histogram(m, ["packet_id"]).count() == 0
