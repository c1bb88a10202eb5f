import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import langid, quality, toxicity
from strandloom.llm.common import table


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


SF = "/root/testdata/sf0.01"


def labelled(spark, name):
    return {r.doc_id: r[name] for r in table(spark, SF, "labels").collect() if r[name] is not None}


def test_quality_held_out(spark):
    rows = quality.op10_quality(spark, SF).collect()
    y = labelled(spark, "quality")
    assert len(rows) == 1000
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    s, t, p = map(np.array, zip(*held, strict=True))
    assert auc(s, t) > 0.97 and (p == t).mean() > 0.95


def test_dual_descent_finds_the_optimum():
    """Against projected gradient steps on the whole dual problem."""
    g = np.random.default_rng(3)
    rows = [np.sort(g.choice(12, g.integers(2, 7), replace=False)) for _ in range(30)]
    y, scale = np.where(g.random(30) < 0.4, 1, -1), g.standard_normal(12)
    cost = np.where(y > 0, 1.5, 0.7)
    x = np.zeros((30, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = scale[r] / len(r) ** 0.5, 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, rate = np.zeros(30), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(50_000):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, cost)
    w, bias = quality.dual_descent(rows, y, scale, cost, epochs=20_000, still=1e-9)
    assert np.allclose([*w, bias], (alpha * y) @ x, atol=1e-4)


def test_quality_features_are_words_and_pairs():
    one = lambda t: set(quality.features(t).tolist())
    assert one("red cat") > one("red") & one("cat") and one("red cat") != one("cat red")
    assert one("go go go") != one("go on go") and not one("") and not one(None)
    assert one("a !!!!!!!! b") != one("a !!!!!!!!! b")  # runs of marks aren't cut


def test_toxicity_held_out(spark):
    rows = toxicity.op4_toxicity(spark, SF).collect()
    y = labelled(spark, "toxic")
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    s, t = map(np.array, zip(*held, strict=True))
    assert auc(s, t) > 0.97 and ((s >= 0.3) == t).mean() > 0.95


def test_language_held_out(spark):
    rows = langid.op1_language_id(spark, SF).collect()
    want = {r.doc_id: (r.lang, r.text) for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(want)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == want[r.doc_id][0] for r in held) >= 0.99 * len(held)


def test_labels_of_the_held_out_fold_dont_matter(spark, docs_of):
    docs = docs_of([(i, "good plain words here" if i % 2 else "BAD!! ###") for i in range(60)])
    make = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and fold(i, 5) == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (quality.train(docs, make(f)) for f in (False, True))
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_edge_cases(spark, odd, docs_of, label):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for lab in (labels, none):
        if label == "quality":
            out = quality.score(odd, quality.train(odd, lab))
        else:
            out = toxicity.passages(odd, toxicity.train(odd, lab))
        rows = out.collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    empty = docs_of([]) if label == "quality" else odd.limit(0)
    assert (quality.score(empty, quality.train(empty, none)) if label == "quality" else toxicity.passages(empty, toxicity.train(empty, none))).count() == 0


def test_language_edge_cases(spark, odd):
    rows = langid.identify(odd, langid.train(odd)).collect()
    assert len(rows) == 11
    got = {r.doc_id: r.lang_pred for r in rows}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    assert langid.identify(odd.limit(0), langid.train(odd.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.Model([], [])).collect()} == {"und"}


class BruteKneserNey:
    """Interpolated Kneser-Ney by its definition, over dictionaries of tuples."""

    def __init__(self, texts):
        self.count, self.discount = [{} for _ in range(5)], [0] * 5
        for text in texts:
            out, _ = langid.symbols([text])
            s = out.tolist()
            for i in range(4, len(s)):
                g = tuple(s[i - 3 : i + 1])
                self.count[4][g] = self.count[4].get(g, 0) + 1
        for n in (3, 2, 1):
            for g in {g[-n - 1 :] for g in self.count[n + 1]}:
                self.count[n][g[1:]] = self.count[n].get(g[1:], 0) + 1
        for n in range(1, 5):
            one, two = (sum(c == k for c in self.count[n].values()) for k in (1, 2))
            self.discount[n] = one / (one + 2 * two) if one and two else 0.5

    def p(self, g):
        n = len(g)
        if not n:
            return langid.UNIFORM
        total = sum(c for x, c in self.count[n].items() if x[:-1] == g[:-1])
        if not total:
            return self.p(g[1:])
        kinds = sum(x[:-1] == g[:-1] for x in self.count[n])
        return max(self.count[n].get(g, 0) - self.discount[n], 0) / total + self.discount[n] * kinds / total * self.p(g[1:])

    def entropy(self, text):
        s = langid.symbols([text])[0].tolist()
        return -np.mean([np.log(self.p(tuple(s[i - 3 : i + 1]))) for i in range(4, len(s))])


def test_cross_entropies_against_brute_force(spark, docs_of):
    texts = {"aa": ["abracadabra alakazam zara", "bazar abra", "aab abc q"], "bb": ["hokus pokus fidibus", "pokus dreimal", "schwarzer kater x"], "cc": ["äöü été 日本語 日本"]}
    rows = [(i * 4, t, lang) for i, (lang, t) in enumerate((k, t) for k, each in texts.items() for t in each)]
    model = langid.train(docs_of(rows), modulus=1, held=5)
    assert model.names == ["aa", "bb", "cc"]
    ask = ["abra kadabra", "pokus", "日本 été", "zzz", "a"]
    h, n = model.entropies(ask)
    for j, name in enumerate(model.names):
        brute = BruteKneserNey(texts[name])
        assert np.allclose(h[:, j], [brute.entropy(t) for t in ask], atol=1e-5)


def test_languages_in_several_passes(spark, docs_of, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    cols = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    one = sorted(map(tuple, langid.identify(docs, model).select(cols).collect()))
    monkeypatch.setattr(langid, "GROUP_BYTES", 1)
    assert len(model.groups()) == len(model.names) > 2
    assert sorted(map(tuple, langid.identify(docs, model).select(cols).collect())) == one


def test_all_rows_count_but_those_for_the_calibration(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION", 3)
    docs = docs_of([(i, f"word{chr(97 + i % 26)} again", "en") for i in range(400)] + [(1000 + i, "seltene worte", "de") for i in range(5)] + [(2000, None, "en")])
    rows = langid.training_rows(docs, 4, 2).collect()
    assert sum(r.aside for r in rows) == 3 and all(r.lang == "en" for r in rows if r.aside)
    assert len(rows) == sum(fold(i, 4) != 2 for i in [*range(400), *range(1000, 1005)])
    assert langid.train(docs).names == ["de", "en"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é日1.\U0001f600\n", max_size=12), min_size=1, max_size=5))
def test_symbols_by_hand(texts):
    out, doc = langid.symbols(texts)
    for i, t in enumerate(texts):
        want, last = [0, 0, 0, 32], True
        for k, c in enumerate(t.lower()):
            if c.isalpha():
                want.append(ord(c) if ord(c) < 65536 else 0xE000 + ord(c) % 0x1000)
            elif k > 0 and t.lower()[k - 1].isalpha():
                want.append(32)
        assert out[doc == i].tolist() == want, last


def test_kneser_ney_sums_to_one():
    text = "abracadabra alakazam " * 3
    key, _ = langid.grams(*langid.symbols([text]))
    m = langid.KneserNey(*langid.tally(key))
    for history in ("abr", "zam", "xyz", "  a"):
        h = sum(ord(c) << (16 * (2 - i)) for i, c in enumerate(history))
        every = np.array([(h << 16) | s for s in range(1, 4097)], np.uint64)
        assert abs(np.exp(m.look(every, 4)).sum() - 1) < 0.02


def test_hash_array():
    import pickle

    g = np.random.default_rng(0)
    keys = np.unique(g.integers(0, 2**60, 5000).astype(np.uint64))
    for a in (langid.HashArray(keys, np.arange(len(keys))), pickle.loads(pickle.dumps(langid.HashArray(keys, np.arange(len(keys)))))):
        value, hit = a.find(keys)
        assert hit.all() and (value == np.arange(len(keys))).all()
        assert not a.find(keys + np.uint64(2**61))[1].any()
    assert not langid.HashArray(keys[:0], np.zeros(0)).find(keys)[1].any()


def brute_segments(x):
    """All maximal scoring segments by definition: the best one, then the same beside it."""
    def best(lo, hi):
        top = max(((sum(x[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 1e-12:
            return []
        i = -top[2]
        j = i - top[1]
        return [*best(lo, i), (i, j - 1, top[0]), *best(j, hi)]

    return best(0, len(x))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-0.23, -0.41, -0.07, 0.31, 0.57, 1.13]), max_size=14))
def test_segments_are_maximal(x):
    total = np.concatenate(([0.0], np.cumsum(x)))
    at = [i for i, g in enumerate(x) if g > 0]
    got = toxicity.segments(at, [total[i] for i in at], [total[i + 1] for i in at])
    want = brute_segments(x)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_log_odds_have_the_priors_of_stems():
    got = toxicity.log_odds({"vile": (40, 0), "calm": (10, 90), "wretched": (5, 0), "wretch~": (9, 1), "wretc~": (9, 1), "wret~": (9, 1)})
    base, p = 55 / 145, toxicity.PRIOR
    share = lambda t, c, rest: (t + p * rest) / (t + c + p)
    odds = lambda x: np.log(x / (1 - x)) - np.log(base / (1 - base))
    stem = share(9, 1, share(9, 1, share(9, 1, base)))
    assert np.allclose([got["vile"], got["calm"], got["wretch~"], got["wretched"]], [odds(share(40, 0, base)), odds(share(10, 90, base)), odds(stem), odds(share(5, 0, stem))])
    m = toxicity.Model.of(got)
    assert np.isclose(m.met["WRETCHEDNESS"], got["wretch~"] - toxicity.DRIFT, atol=1e-5) and m.met["unknown"] == -toxicity.DRIFT
    assert toxicity.log_odds({"vile": (40, 0)}) == {}


def test_extreme_value_law_is_found():
    """Steps of a normal law with mean -m and deviation 1 have lambda = 2 m."""
    g, scores, n = np.random.default_rng(5), [], 0
    for _ in range(40):
        x = g.standard_normal(20_000) - 0.4
        total = np.concatenate(([0.0], np.cumsum(x)))
        at = np.flatnonzero(x > 0)
        scores += [s for *_, s in toxicity.segments(at.tolist(), total[at].tolist(), total[at + 1].tolist())]
        n += len(x)
    scale, size = toxicity.law(np.array(scores), n)
    assert abs(scale - 0.8) < 0.25
    expected = size * n * np.exp(-scale * 6)
    assert 0.4 < sum(s >= 6 for s in scores) / expected < 2.5


def test_passages_have_offsets(spark, docs_of):
    model = toxicity.Model.of({"vile": 6.0})
    model.slope, model.shift = 4.0, -3.0
    r = toxicity.passages(docs_of([(1, "so nice. VILE vile things " + "calm " * 50 + "\u0130 vile")]), model).collect()[0]
    assert [(p.text, p.start, p.end) for p in r.passages] == [("VILE vile", 9, 18), ("vile", 278, 282)]


def test_whole_scores_against_plain_python(spark, docs_of):
    """Counts, priors, drift, segments, damping, the law and the calibration, each done the plain way for every document."""
    rng = np.random.default_rng(7)
    clean, bad = [f"plain{i}" for i in range(60)], [f"awful{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(clean, int(rng.integers(5, 60))))
        y = int(i % 3 == 0)
        if y:
            at = int(rng.integers(0, len(w)))
            w[at:at] = list(rng.choice(bad, int(rng.integers(3, 9)))) * int(rng.integers(1, 3))
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w) if i % 40 else None))
        labels.append((i, y))
    docs = docs_of(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    shown = {r.doc_id: (r.y, r.aside) for r in spark.createDataFrame(labels, "doc_id long, y int").selectExpr("doc_id", "y", "pmod(xxhash64(doc_id), 4) = 0 aside", "pmod(crc32(cast(doc_id as string)), 4) r").filter("r <> 2").collect()}
    tokens = {i: re.findall(toxicity.WORD.pattern, t or "") for i, t in rows}
    names = lambda w: [w] + [w[:n] + "~" for n in sorted(toxicity.STEMS, reverse=True) if len(w) > n]
    counts = {}
    for i, (y, aside) in shown.items():
        for w in [] if aside else tokens[i]:
            for n in names(w.lower()):
                counts.setdefault(n, [0, 0])[1 - y] += 1
    whole = [c for n, c in counts.items() if "~" not in n]
    base = sum(c[0] for c in whole) / sum(map(sum, whole))

    def share(n):
        """The share of toxic tokens, drawn to that of the next shorter stem."""
        shorter = [x for x in names(n.removesuffix("~"))[1:] if x != n and len(x) <= len(n) and x in counts]
        prior = share(shorter[0]) if shorter else base
        return (counts[n][0] + toxicity.PRIOR * prior) / (sum(counts[n]) + toxicity.PRIOR)

    odds = lambda p: np.log(p / (1 - p))
    gains = {n: np.float32(odds(share(n)) - odds(base)) for n in counts}
    gain = lambda w: next((float(gains[n]) for n in names(w.lower()) if n in gains), 0.0) - toxicity.DRIFT

    def segments(x):
        """Maximal segments by their definition: the best one, then those to its left and right."""
        best = max(((sum(x[a:b]), a - b, -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0,), key=lambda z: (round(z[0], 9), *z[1:]))
        if best[0] <= 1e-9:
            return []
        *_, a, b = best
        return [(p, q) for p, q in segments(x[:a])] + [(a, b)] + [(p + b, q + b) for p, q in segments(x[b:])]

    def evidence(words):
        x, seen, out = [gain(w) for w in words], {}, 0.0
        for a, b in segments(x):
            s = 0.0
            for k in range(a, b):
                if x[k] > 0:
                    s += x[k] * 0.5 ** min(60, seen.get(words[k].lower(), 0))
                    seen[words[k].lower()] = seen.get(words[k].lower(), 0) + 1
                else:
                    s += x[k]
            out += max(0.0, model.scale * s - np.log(model.size * max(1, len(words))))
        return out

    got = {r.doc_id: r.score for r in toxicity.passages(docs, model).collect()}
    for i in range(0, 400, 3):
        want = 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(evidence(tokens[i])) + model.shift, -30, 30)))
        assert abs(got[i] - want) < 1e-4, (i, got[i], want)
    scores = [sum(x[a:b]) for i, (y, aside) in shown.items() if aside and not y for x in [[gain(w) for w in tokens[i]]] for a, b in segments(x)]
    assert np.allclose(toxicity.law(np.array(scores), sum(len(tokens[i]) for i, (y, aside) in shown.items() if aside and not y)), (model.scale, model.size), rtol=1e-3)
