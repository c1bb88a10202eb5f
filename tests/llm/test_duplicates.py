import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import embeddings, minhash, substrings
from strandloom.llm.common import Scratch, components


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def brute_classes(rows, similar=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = set(minhash.shingle_hashes(t)[0].tolist())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= similar * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, docs_of):
    r = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = words(r, r.choice((3, 5, 8, 60, 200)))
        for _ in range(r.choice((1, 1, 2, 6))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            rows.append((n * 7 % 1009, " ".join(w)))
            n += 1
    base = words(r, 120)
    for _ in range(60):  # a group in which many pairs are just too different
        w = list(base)
        for k in r.sample(range(120), 2):
            w[k] = f"y{r.randrange(9999)}"
        rows.append((n * 7 % 1009, " ".join(w)))
        n += 1
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_edge_cases(spark, odd, docs_of):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    got = {x.doc_id: (x.class_id, x.copy_of, x.kept) for x in rows}
    assert got[1] == (1, 1, True) and got[2] == (2, 2, True) and got[3] == (3, 3, True)
    assert got[4] == (4, 4, True) and got[9] == (4, 4, False)
    assert got[None] == (None, None, True)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    two = minhash.near_duplicates(docs_of([(5, a), (5, b), (3, b + " more"), (9, a), (9, a)])).collect()
    assert sorted(x.doc_id for x in two) == [3, 5, 5, 9, 9] and not any(x.kept for x in two if x.doc_id == 9)
    assert minhash.near_duplicates(docs_of([(1, "a b c")])).collect()[0].kept


def test_texts_of_one_id_are_compared_each(spark, docs_of):
    """Ids only name texts: every text is compared, whichever rows come first, and has a class of its own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    got = minhash.near_duplicates(docs_of([(3, a), (5, a + " more"), (5, c), (7, c + " x"), (8, b), (9, b), (9, b), (2, c + " x y"), (2, "none of it")])).collect()
    by = {(r.doc_id, r.digest): (r.class_id, r.copy_of, r.kept) for r in got}
    one = lambda i, t: by[i, hashlib.sha256(t.encode()).hexdigest()]
    assert len(got) == 9
    assert one(3, a) == (3, 3, True) and one(5, a + " more") == (3, 5, False)
    assert one(2, c + " x y") == (2, 2, True) and one(5, c) == (2, 5, False) and one(7, c + " x") == (2, 7, False)
    assert one(2, "none of it") == (2, 2, True) and one(8, b) == (8, 8, True) and one(9, b) == (8, 8, False)
    # two texts of one id in one class: one stays
    two = minhash.near_duplicates(docs_of([(5, a), (5, a + " more"), (6, a)])).collect()
    assert [r.class_id for r in two] == [5, 5, 5] and sum(r.kept for r in two) == 1


def test_blocks_by_bytes(spark, docs_of, monkeypatch):
    r = random.Random(4)
    base, rows = words(r, 100), []
    for n in range(40):
        w = list(base)
        for k in r.sample(range(100), 2):
            w[k] = f"y{r.randrange(9999)}"
        rows.append((n, " ".join(w)))
    rows += [(100 + n, t) for n, t in rows[:5]] + [(3, rows[3][1])] * 2
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_classes(list(dict(rows).items()))


@pytest.mark.parametrize("weighting", ["count", "log"])
def test_weighted_near_duplicates(spark, docs_of, weighting):
    r = random.Random(5)
    base = words(r, 80)
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["zz"])), (3, " ".join(base + base)), (4, " ".join(words(r, 80)))]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs_of(rows), weighting=weighting).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_signatures_estimate_weighted_similarity():
    g = np.random.default_rng(0)
    a, b = np.array([2.5, 1.0, 0.3]), np.array([1.5, 1.0, 2.3])
    same = [np.equal(*minhash.signatures([e, e], [a, b])).mean() for e in (np.sort(g.integers(0, 2**63, 3).astype(np.uint64)) for _ in range(200))]
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    one = minhash.signatures([np.array([5], np.uint64)], [np.ones(1)])
    assert len(set(one[0].tolist())) == minhash.K


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=6))
def test_overlaps(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    assert minhash.overlaps(arrays).tolist() == [[len(a & b) if i != j else len({x for x in a if sum(x in s for s in sets) > 1}) for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def brute_links(rows):
    ids, good = [i for i, _ in rows], [k for k, (_, v) in enumerate(rows) if v and any(v) and all(x is not None and np.isfinite(x) for x in v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(good):
        for b in good[:p]:
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                n[a] += 1
                n[b] += 1
                u, v = sorted((find(a), find(b)), key=lambda k: ids[k])
                root[v] = u
    return sorted((ids[k], n[k], ids[find(k)]) for k in range(len(rows)))


VEC = "vec_id long, embedding array<float>, label int, bucket int"


@pytest.mark.parametrize("shape", [(None, None), (3, 25), (12, 60)])
def test_embeddings_against_brute_force(spark, monkeypatch, shape):
    for name, value in (("BLOCK_BYTES", 1024), ("UNIT", 16), ("GROUP_ROWS", 100), ("GROUP_BYTES", 4000)):  # large buckets are cut
        monkeypatch.setattr(embeddings, name, value)
    g, rows = np.random.default_rng(2), []
    for k in range(12):
        base = g.standard_normal(16)
        for _ in range([1, 2, 30][k % 3]):
            rows.append([float(x) for x in base + g.standard_normal(16) * (0.12 if k % 2 else 0.3)])
    rows += [rows[0], rows[0], [x * 2 for x in rows[0]], [1.0, 0.0], [1.0, 0.1], [0.0] * 16, None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows = [((i * 37) % 1009, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VEC)
    got = embeddings.links_of(df, bits=shape[0], tables=shape[1])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_embeddings_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (None, [1.0, 0.0], None, None)], VEC)
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.links_of(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert embeddings.links_of(df.limit(0)).count() == 0


def test_embeddings_of_one_id_and_in_double_precision(spark):
    rows = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (3, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 1e-9]), (5, [0.0, 1e300, 1.0])]
    got = embeddings.links_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(3, 1, 3), (5, 2, 5), (7, 1, 3), (7, 2, 5), (9, 2, 5)]


def test_signs_dont_depend_on_the_batch():
    x = np.random.default_rng(0).standard_normal((300, 48))
    assert (embeddings.signs(x, 200) == np.concatenate([embeddings.signs(x[i : i + 1], 200) for i in range(300)])).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200 + 2 * k, 201 + 2 * k) for k in range(5)] + [(7, 7), (None, 3), (50, 100)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {50} and got[50] == 50
    assert all(got[201 + 2 * k] == 200 + 2 * k for k in range(5))
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def brute_removed(rows):
    first, out = {}, {}
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows if i is not None)):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for k, (i, t) in enumerate(rows):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[k] = (i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("batch, bucket", [(4_000_000, 400_000), (3000, 50)])
def test_substrings_against_brute_force(spark, docs_of, monkeypatch, batch, bucket):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "BUCKET_ANCHORS", bucket)
    r = random.Random(4)
    passages = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 70, 300)] + ["ab" * 60, "a" * 90]
    rows = []
    for i in range(60):
        parts = [r.choice(passages)[r.randrange(5) :] if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(90))) for _ in range(r.randrange(6))]
        rows.append((i * 17 % 101, "".join(parts)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, rows[3][1]), (600, None), (601, ""), (-5, rows[7][1]), (700, "a" * 3000), (701, "a" * 49), (702, "a" * 50)]
    got = sorted((tuple(x) for x in substrings.remove_repeats(docs_of(rows)).collect()), key=str)
    assert got == brute_removed(rows)


def test_substrings_edge_cases(spark, odd):
    assert substrings.remove_repeats(odd).count() == 11
    assert substrings.remove_repeats(odd.limit(0)).count() == 0
    assert {r.kept_text for r in substrings.remove_repeats(odd.filter("doc_id = 4"), with_text=True).collect()} == {"one"}


@pytest.mark.parametrize("period", [4, 8, 16, 32, 50])
def test_difference_cover(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) < period


def brute_earlier(rows, low, high, owner):
    first = {}
    for r, (a, b) in enumerate(zip(low, high, strict=True)):
        for o in range(a, b + 1):
            k = bytes(rows[r, o : o + substrings.SPAN])
            first[k] = min(first.get(k, owner[r]), owner[r])
    return [sum(1 << o for o in range(a, b + 1) if first[bytes(rows[r, o : o + substrings.SPAN])] < owner[r]) for r, (a, b) in enumerate(zip(low, high, strict=True))]


def shifted_rows(n=120):
    """Contexts cut from few texts at any place, so that equal strings lie at different offsets."""
    g = np.random.default_rng(0)
    texts = [g.integers(97, 99, 150), np.full(150, 97), np.tile([97, 98, 98], 50), np.repeat([97, 98], 75)]
    rows = np.stack([texts[g.integers(4)][k : k + substrings.WIDTH] for k in g.integers(0, 60, n)]).astype(np.uint8)
    rows[::7, 60] = 99
    low = g.integers(0, 20, n)
    return rows, low, low + g.integers(0, 15, n), g.integers(0, 50, n)


@pytest.mark.parametrize("block", [10**6, 200, 3])
def test_strings_at_different_offsets_are_matched(block):
    rows, low, high, owner = shifted_rows()
    assert substrings.earlier(rows, low, high, owner, block=block).tolist() == brute_earlier(rows, low, high, owner)


def test_suffixes_are_in_order_by_a_cover_only():
    """Ties are broken at the shift that brings both suffixes into the cover; a set that isn't a cover has no such shift."""
    rows, low, high, owner = shifted_rows()
    s = substrings.Suffixes(rows)
    s.rank_cover(np.arange(len(rows)), substrings.COVER)
    row, at = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(substrings.GRAMS), indexing="ij"))
    text = [bytes(s.bytes[r, o : o + 16]) for r, o in zip(row, at, strict=True)]
    group = np.array([sorted(set(text)).index(x) for x in text])
    whole = [bytes(rows[r, o : o + substrings.SPAN]) for r, o in zip(row, at, strict=True)]
    order = s.order(row, at, group, substrings.COVER)
    assert [whole[k] for k in order] == sorted(whole)
    for bad in ([0], [5], [0, 8], [3, 7], substrings.COVER[:-1]):
        with pytest.raises(ValueError):
            substrings.earlier(rows, low, high, owner, cover=bad)


def test_rows_without_an_id_are_dealt_by_text(spark, docs_of):
    rows = [(None, f"text {i} " * 30) for i in range(40)] + [(5, f"text {i} " * 30) for i in range(40)]
    got = sorted((tuple(x) for x in substrings.remove_repeats(docs_of(rows)).collect()), key=str)
    assert got == brute_removed(rows)
