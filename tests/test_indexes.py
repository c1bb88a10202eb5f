"""Barcodes of all samples, oligos by pieces, and bitmaps of ids against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import barcodes, idmaps, oligos, ribozero
from strandloom.plans import queries as Q


def codes_of(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, code string")


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_barcodes_against_all_pairs(spark, most):
    r = random.Random(most)
    code = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    ours = [(i, code(r.choice((5, 6)))) for i in range(60)] + [(60, ""), (61, "AC"), (62, None), (63, "ACGTAC"), (64, "ACGTAC")]
    called = [code(r.choice((5, 6))).replace("T", r.choice("TN")) for _ in range(150)] + ["", "AC", "GT", None, "ACGTAC", "ACGTAC"]
    got = barcodes.matches(spark.createDataFrame([(c,) for c in called], "called_barcode string"), codes_of(spark, ours), most)
    want = {(c, i, sum(a != b for a, b in zip(c, k, strict=True))) for c in called if c is not None for i, k in ours if k is not None and len(c) == len(k) and sum(a != b for a, b in zip(c, k, strict=True)) <= most}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_very_many_barcodes(spark):
    """Random codes by the hundred thousand: neighbours of each called code, looked up one by one."""
    n = 200_000
    base = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 10), "0123456789abcdef", "ACGTACGTACGTACGT")
    ours = spark.range(n).select(F.col("id").alias("sample_id"), F.substring(base, 1, 5).alias("i5"), F.substring(base, 6, 5).alias("i7"))
    by = {}
    for r in ours.collect():
        by.setdefault(r.i5 + r.i7, []).append(r.sample_id)
    r = random.Random(1)
    reads = ["".join(r.choice("ACGTN" if i % 10 == 0 else "ACGT") for _ in range(10)) for i in range(800)] * 2
    got = barcodes.identify(spark.createDataFrame(list(enumerate(reads)), "read long, called_barcode string"), ours)
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    kinds = set()
    for row in got.collect():
        c = row.called_barcode
        near = {c} | {c[:i] + b + c[i + 1 :] for i in range(10) for b in "ACGT"}
        found = [s for k in near for s in by.get(k, [])]
        want = ("identified", found[0]) if len(found) == 1 else ("ambiguous" if found else "unidentified", None)
        assert (row.status, row.found_sample, row.n_matches) == (*want, len(found))
        kinds.add(row.status)
    assert kinds == {"identified", "ambiguous", "unidentified"}


def keyed_columns(df, *kinds):
    """What a row for each key of a code holds, and what rows of other named nodes do."""

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    return " ".join(n.output().mkString(" ") for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() in ("Generate", *kinds))


def test_barcodes_meet_without_broadcast(spark, sf):
    """Estimates don't see how many keys a code has, so a small file of codes must not tempt Spark into sending all keys."""
    q = Q.QUERIES["barcode_matches"](spark, sf)
    assert "Broadcast" not in q._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 2])
def test_barcode_that_many_samples_share(spark, most):
    """Keys are made of distinct codes: with one of a sample's own each, samples would be in every key."""
    ours = spark.range(3000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 2990, "ACGTACGT").otherwise("ACGTTTTT").alias("code"))
    got = barcodes.matches(spark.createDataFrame([("ACGTACGA",), ("ACGTACGA",), ("NCGTACGT",), ("GGGGGGGG",)], "called_barcode string"), ours, most)
    assert "sample_id" not in keyed_columns(got)
    assert sorted((r.called_barcode, r.mismatches, r["count"]) for r in got.groupBy("called_barcode", "mismatches").count().collect()) == [("ACGTACGA", 1, 2990), ("NCGTACGT", 1, 2990)]


def test_samples_are_counted_before_they_meet_reads(spark):
    """A row of pairs for each code, not for each sample, so that a task's memory doesn't grow with the samples."""
    ours = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit("ACGT").alias("i5"), F.when(F.col("id") < 2999, "ACGT").otherwise("TTTT").alias("i7"))
    reads = spark.createDataFrame([(1, "ACGTACGA"), (2, "ACGTTTTT"), (3, "GGGGGGGG"), (4, None), (5, "ACGTTATT")], "read long, called_barcode string")
    got = barcodes.identify(reads, ours)
    assert "sample_id" not in keyed_columns(got, "Join")
    assert sorted((r.read, r.found_sample, r.n_matches, r.status) for r in got.collect()) == [(1, None, 2999, "ambiguous"), (2, 2999, 1, "identified"), (3, None, 0, "unidentified"), (4, None, 0, "unidentified"), (5, 2999, 1, "identified")]


@pytest.mark.parametrize("library, least", [(["ACGTTGCAACGT", "GGATCCTTAA", "TTTTACGGCAT"], 8), (["ACGTACGT"], 8), (["ACGTACGT", "AAAACCCC"], 5), (["ACGTA", "ACGT", "GT"], 4)])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_sites_by_pieces(spark, monkeypatch, library, least, broadcast):
    """The same places as all windows against all oligos give, at that score and above."""
    monkeypatch.setattr(oligos, "BROADCAST_PIECES", broadcast)
    r = random.Random(least)
    rows = [(str(i), "".join(r.choice("ACGT" if i % 5 else "ACGTN") for _ in range(r.choice((0, 3, 11, 12, 40, 200))))) for i in range(60)]
    rows += [("p", library[0][::-1].translate(str.maketrans("ACGT", "TGCA")) * 3), ("n", None), ("r", "GGGGGGGGGGGGGGG"), ("low", "acgtacgtacgt")]
    df = spark.createDataFrame(rows, "row_key string, sequence string")
    got = sorted((x.row_key, x.site, x.score) for x in oligos.sites_above(df, library, least).collect())
    every = df.select("row_key", F.posexplode(ribozero.alignment_scores(F.col("sequence"), library)).alias("site", "score"))
    assert got == sorted((x.row_key, x.site, x.score) for x in every.collect() if x.score >= least)
    assert got
    plan = oligos.sites_above(df, library, least)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def test_bounds_and_empty_libraries(spark):
    df = spark.createDataFrame([("a", "ACGT" * 10)], "row_key string, sequence string")
    with pytest.raises(ValueError, match="empty"):
        oligos.sites_above(df, ["ACGTACGT", "ACG"], 4)
    assert oligos.sites_above(df, [], 5).collect() == []
    table = spark.createDataFrame([("ACGT",), (None,), ("ACGT",)], "oligo string")
    assert {x.site for x in oligos.sites_above(df, table, 4).collect()} == {x.site for x in oligos.sites_above(df, ["ACGT"], 4).collect()} == set(range(0, 37, 4))


def test_bitmaps_hold_ordinals(spark, monkeypatch):
    r = random.Random(3)
    rows = [(str(s), p, o, "A" * r.choice((0, 99, 100, 600, 1000))) for s, p in itertools.product((1, 2), (0, 7)) for o in [*range(0, 90), 32767, 32768, 32769, 5 * 10**9, 5 * 10**9 + 1]]
    original = spark.createDataFrame(rows, "sample_id string, packet_id int, ordinal long, sequence string")
    kept = [x for x in rows if x[2] % 3 and x[:2] != ("2", 7)]
    after = spark.createDataFrame(kept * 3 + [("1", 0, None, "A")], original.schema)
    maps = idmaps.ordinals(after)
    assert {(x.sample_id, x.n) for x in idmaps.counted(maps, "sample_id").collect()} == {(s, sum(k[0] == s for k in kept)) for s in "12"}
    for limit in (5000, 0):
        monkeypatch.setattr(idmaps, "BROADCAST_MAPS", limit)
        there = sorted(tuple(x) for x in idmaps.occurring(original, maps).collect())
        gone = sorted(tuple(x) for x in idmaps.occurring(original, maps, there=False).collect())
        assert there == sorted(kept) and gone == sorted(set(rows) - set(kept))
    halves = [idmaps.ordinals(after.filter(f"pmod(ordinal, 2) = {k}")) for k in (0, 1)]
    assert sorted(map(str, idmaps.merged(*halves).collect())) == sorted(map(str, maps.collect()))
    assert idmaps.ordinals(original.limit(0)).collect() == [] and idmaps.occurring(original, maps.limit(0)).collect() == []


def test_bitmaps_are_all_that_is_shuffled(spark, sf):
    plan = idmaps.ordinals(Q.fragments(Q.M(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_bitmap_construct_agg" in plan
