import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import rng
from strandloom.functions import sequence as sq

PART = st.tuples(st.integers(1, 9), st.sampled_from("MIDNS=X"))


def brute_positions(cigar, start, strand, length):
    out, r = [], start
    for n, op in cg.PART.findall(cigar):
        for _ in range(int(n)):
            if op in "M=X":
                out.append(r)
                r += 1
            elif op in "IS":
                out.append(0)
            elif op in "DN":
                r += 1
    out = (out + [0] * length)[:length]
    return out[::-1] if strand == "-" else out


@settings(max_examples=200, deadline=None)
@given(st.lists(PART, min_size=1, max_size=6), st.sampled_from("+-"), st.integers(1, 2**40))
def test_positions(parts, strand, start):
    c = "".join(f"{n}{op}" for n, op in parts)
    n = cg.query_length(c)
    assert cg.positions(n, start, c, strand).tolist() == brute_positions(c, start, strand, n)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 20), st.lists(PART, min_size=1, max_size=6), st.sampled_from("+-"), st.sampled_from("+-"), st.integers(1, 2**40))
def test_compose_maps_each_base(s1, n, parts, d1, d2, s2):
    c2 = "".join(f"{k}{op}" for k, op in parts)
    start, cigar, strand = cg.compose(s1, f"{n}M", d1, s2, c2, d2)
    assert strand == ("+" if d1 == d2 else "-")
    assert cg.query_length(cigar) == n
    first, between = brute_positions(f"{n}M", s1, d1, n), brute_positions(c2, s2, d2, cg.query_length(c2))
    want = [between[p - 1] if p <= len(between) else 0 for p in first]
    if any(want):
        got = brute_positions(cigar, start, strand, n)
        assert got == want


def test_compose_is_associative():
    a, b, c = (3, "10M", "-"), (5, "8M2I10M", "+"), (100, "12M3D8M", "-")
    left = cg.compose(*cg.compose(*a, *b), *c)
    right = cg.compose(*a, *cg.compose(*b, *c))
    assert left == right


def test_clipped_wholly_keeps_a_position():
    assert cg.compose(8, "5M", "+", 1000, "5M20S", "+") == (1004, "5S", "+")


def test_chain_matched_agrees(spark):
    rows = [(s1, n, m, m + t, d1, d2) for s1 in (1, 4, 20) for n in (1, 7) for m in (5, 12) for t in (0, 20) for d1 in "+-" for d2 in "+-" if s1 + n - 1 <= m + t]
    df = spark.createDataFrame(rows, "s1 long, n long, m long, len long, d1 string, d2 string")
    c = F.concat(F.col("m").cast("string"), F.lit("M"), F.when(F.col("len") > F.col("m"), F.concat((F.col("len") - F.col("m")).cast("string"), F.lit("S"))).otherwise(""))
    fast = cg.chain_matched(F.col("s1"), F.col("n"), F.col("d1"), F.lit(100), F.col("m"), F.col("len"), F.col("d2"))
    full = cg.chain(F.col("s1"), F.concat(F.col("n").cast("string"), F.lit("M")), F.col("d1"), F.lit(100), c, F.col("d2"))
    for r in df.select(fast.alias("a"), full.alias("b"), "*").collect():
        assert r.a.strand == r.b.strand
        if "M" in r.b.cigar:
            assert (r.a.start, r.a.cigar) == (r.b.start, r.b.cigar), r


def test_sequence_functions(spark):
    seqs = ["", "A", "ACGTN", "AAAA", "GATTACAAA", "ccgg"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in df.select("s", sq.reverse_complement("s").alias("t"), sq.polya_tail_length("s").alias("tail"), sq.gc_content("s").alias("gc"), sq.windows("s", 3).alias("w"), sq.base_matrix("s").alias("m")).collect():
        assert r.t == r.s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r.tail == len(r.s) - len(r.s.rstrip("A"))
        assert r.w == [r.s[i : i + 3] for i in range(len(r.s) - 2)]
        assert r.m == [[int(c == b) for c in r.s] for b in "ACGT"]
        assert np.isnan(r.gc) if not r.s else abs(r.gc - (r.s.count("C") + r.s.count("G") + r.s.count("N") / 2) / len(r.s)) < 1e-12
    twice = df.filter("s rlike '^[ACGT]*$'").select("s", sq.reverse_complement(sq.reverse_complement("s")).alias("t")).collect()
    assert all(r.s == r.t for r in twice)


def test_uniform_is_the_same_in_python(spark):
    df = spark.range(50).select("id", rng.uniform(7, "step", F.col("id"), "x").alias("u"))
    got = df.collect()
    assert all(r.u == rng.uniform_py(7, "step", r.id, "x") for r in got)
    assert 0.3 < np.mean([r.u for r in got]) < 0.7


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("A", "AC"), ("", ""), ("GG", "CC")], "a string, b string")
    assert [r[0] for r in df.select(sq.hamming("a", "b")).collect()] == [1, None, 0, 2]


def test_chain_run_equals_chain(spark):
    import random

    from pyspark.sql import functions as F

    from strandloom.functions import cigar as cg

    r, rows = random.Random(2), []
    for _ in range(400):
        c = r.choice(("20M", "15M5S", "1M19S", "5S15M", "10M3N10M", "8M2I10M", "20S", "9M2D11M"))
        s = r.randint(1, 20)
        rows.append((s, r.randint(1, 21 - s), r.choice("+-"), r.randint(1, 10**10), c, r.choice("+-")))
    df = spark.createDataFrame(rows, "s1 long, n long, d1 string, s2 long, c2 string, d2 string")
    col = F.col
    got = df.select(*df.columns, cg.chain_run(col("s1"), col("n"), col("d1"), col("s2"), col("c2"), col("d2")).alias("x")).collect()
    assert all(tuple(g.x) == cg.compose(g.s1, f"{g.n}M", g.d1, g.s2, g.c2, g.d2) for g in got)


def random_cigar(r, ops="MIDNS=X"):
    """Parts in any order; clips only at the ends."""
    inner = [f"{r.randint(1, 9)}{r.choice(ops.replace('S', ''))}" for _ in range(r.randint(0, 6))]
    return ("" if r.random() < 0.6 else f"{r.randint(1, 5)}S") + "".join(inner) + ("" if r.random() < 0.6 else f"{r.randint(1, 5)}S")


def test_chain_equals_compose_on_random_alignments(spark):
    import random

    r = random.Random(11)
    rows = [(r.randint(1, 20), random_cigar(r), r.choice("+-"), r.randint(1, 10**10), random_cigar(r, "MMMIDN=X"), r.choice("+-")) for _ in range(3000)]
    rows += [(1, "", "+", 5, "", "-"), (1, "4M", "-", 5, "", "+"), (3, "2S", "+", 9, "5M", "+"), (1, "20M", "+", 7, "5M3N2I4D6M", "-"), (2, "3M2D4M1I3M", "-", 2**31 + 5, "2S5M100000N9M1S", "+")]
    df = spark.createDataFrame(rows, "s1 long, c1 string, d1 string, s2 long, c2 string, d2 string").repartition(4)
    col = F.col
    got = df.select("*", cg.chain(*[col(c) for c in df.columns]).alias("x"), cg.used(col("c1")).alias("used")).collect()
    assert len(got) == len(rows)
    wrong = [(tuple(g)[:6], tuple(g.x), cg.compose(*tuple(g)[:6])) for g in got if tuple(g.x) != cg.compose(*tuple(g)[:6])]
    assert not wrong, (len(wrong), wrong[:3])
    assert all(g.used == cg.query_length(g.c1) for g in got)
    assert all(sum(op in g.x.cigar for g in got) > 50 for op in "MIDNS")  # the generator meets every kind


def test_chain_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "+", 5, "5M", "+"), (1, "5M", "+", 5, None, "+")], "s1 long, c1 string, d1 string, s2 long, c2 string, d2 string")
    assert [r.x for r in df.select(cg.chain(*[F.col(c) for c in df.columns]).alias("x")).collect()] == [None, None]


def test_chains_need_no_python(spark, sf):
    from strandloom.operators import adapters, molecules
    from strandloom.plans import queries as Q

    m = adapters.ligate(molecules.piece(molecules.piece(Q.M(spark, sf), F.lit(3), F.lit(30)), F.lit(2), F.lit(20), reverse=True), Q.samples(spark))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
