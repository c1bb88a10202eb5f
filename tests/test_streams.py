"""Packets in pieces, late and repeated, over restarts, against a batch over the same rows."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics, flowcell
from strandloom.plans import queries as Q
from strandloom.streaming import packets, steps

LANES = (1, 3, 4)


@pytest.mark.parametrize("kind", ["numbers", "counts"])
def test_late_and_repeated_packets_give_the_batch_result(spark, sf, tmp_path, kind):
    m = Q.M(spark, sf).filter("ordinal < 160").select("sample_id", "packet_id", "ordinal", "row_key", "transcript_id")
    at = lambda minutes: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.lit(minutes))
    part = lambda rows, minutes: rows.withColumn("arrived", at(minutes))
    folder, out, check = (f"{tmp_path.as_uri()}/{x}" for x in ("in", "out", "check"))
    schema = part(m, 0).schema
    make = (lambda s: packets.numbered(s, LANES, delay="10 minutes")) if kind == "numbers" else (lambda s: packets.quantified(s, delay="10 minutes"))

    def arrive(*parts):
        """Some rows arrive, and a query that starts anew goes on from the checkpoint."""
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(folder)
        query = packets.write(make(steps.read_packets(spark, folder, schema)), out, check)
        query.awaitTermination(180)
        assert query.exception() is None

    # packets 0 and 1 in two pieces, the later one first, some rows twice; packet 2 goes on for long
    arrive(part(m.filter("packet_id < 3 and ordinal >= 80"), 0), part(m.filter("packet_id < 3 and ordinal >= 120"), 3))
    assert not [x for x in (tmp_path / "out").glob("*.parquet")] or spark.read.parquet(out).count() == 0
    arrive(part(m.filter("packet_id < 3 and ordinal < 90"), 5))  # late, but in time
    arrive(part(m.filter("packet_id = 2"), 14), part(m.filter("packet_id = 3 and ordinal < 100"), 14))
    arrive(part(m.filter("packet_id = 3"), 21))  # the watermark is at 11 now: packets 0 and 1 are closed
    first = spark.read.parquet(out)
    assert {r.packet_id for r in first.select("packet_id").distinct().collect()} >= {0, 1}
    arrive(part(m.filter("packet_id in (0, 1)"), 22))  # sent again after they closed
    arrive(part(m.filter("packet_id = 2 and ordinal < 50"), 23), part(m.limit(1).withColumn("packet_id", F.lit(99)), 90))
    arrive(part(m.limit(1).withColumn("packet_id", F.lit(98)), 200))
    got = spark.read.parquet(out).filter("packet_id < 90")
    if kind == "numbers":
        want = flowcell.assign_lanes(m, LANES).select("sample_id", "packet_id", "row_key", "cluster_id", "lane")
    else:
        want = analytics.quantify(m).select("sample_id", "packet_id", "transcript_id", "counts")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_few_rows_go_round_the_lanes(spark, tmp_path):
    rows = [("1", 0, 5, "a", "t"), ("1", 0, 2, "b", None), ("2", 0, 1, "c", "t"), (None, 0, 1, "d", "t"), ("2", None, 1, "e", "t"), ("2", 0, None, "f", "t")]
    m = spark.createDataFrame(rows, "sample_id string, packet_id int, ordinal long, row_key string, transcript_id string")
    early, far = (m.withColumn("arrived", F.lit(t).cast("timestamp")) for t in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"))
    for k, make in enumerate((lambda s: packets.numbered(s, LANES), packets.quantified)):
        folder, out, check = (f"{tmp_path.as_uri()}/{k}{x}" for x in ("in", "out", "check"))
        for p in (early, far.filter("row_key = 'a'").withColumn("packet_id", F.lit(9))):
            p.coalesce(1).write.mode("append").parquet(folder)
            packets.write(make(steps.read_packets(spark, folder, early.schema)), out, check).awaitTermination(120)
        got = {tuple(r) for r in spark.read.parquet(out).drop("sample_id").collect()}
        good = m.filter("sample_id is not null and packet_id is not null and ordinal is not null")
        want = flowcell.assign_lanes(good, LANES).select("packet_id", "row_key", "cluster_id", "lane") if k == 0 else analytics.quantify(good).select("packet_id", "transcript_id", "counts")
        assert got == {tuple(r) for r in want.collect()}
