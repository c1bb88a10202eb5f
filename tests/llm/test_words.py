"""Spelling variants, collocations and mixing against plain versions of their contracts."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandloom.llm import collocations, mixing, spelling
from strandloom.llm.registry import queries

VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_variants(rows):
    """Words, counts and links by comparing every pair of words."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n)


def sorted_rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_spelling_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = plain_variants([(r.doc_id, r.text) for r in docs])
    got = queries()["op11_spelling_variants"](spark, sf)
    assert got.columns == VARIANTS
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert any(r[1] for r in want)


def test_spelling_of_made_words(spark, docs_of):
    rng = np.random.default_rng(5)
    rows, letters = [], "abÀé×"
    for i in range(300):
        base = "".join(rng.choice(list("ab"), 7)) if i % 3 else "chain" + "x" * int(rng.integers(3, 8))
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            at, what = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            if what == 0:
                w.insert(at, str(rng.choice(list(letters))))
            elif what == 1 and len(w) > 7:
                del w[at]
            else:
                w[at] = str(rng.choice(list(letters)))
        rows.append((i if i % 7 else None, " ".join(["".join(w)] * int(rng.choice([1, 2, 25, 400])))))
    rows += [(1, "a" * 20_001 + " " + "a" * 20_000 + "-" + "a" * 20_001 + "\n" + "a" * 20_000), (2, None), (3, ""), (4, "b" * 19_999 + "c1" + "b" * 19_999 + "d"), (4, "b" * 19_999 + "c1" + "b" * 19_999 + "d")]
    want = plain_variants(rows)
    assert sorted(tuple(r) for r in spelling.variants(docs_of(rows)).collect()) == sorted(want)
    assert any(r[2] != r[0] and r[1] != r[2] for r in want)  # a chain of forms


def test_spelling_collisions_change_nothing(spark, docs_of, monkeypatch):
    """With all hashes in a few values strings still decide."""
    rows = [(i, " ".join([w] * (3 if i % 2 else 40))) for i, w in enumerate(["abcdefgh", "abcdefgx", "abcdefg", "qbcdefgh", "abcdefghi", "zzzzzzzz", "zzzzzzz"])]
    known = spark.createDataFrame([(i, w, 3 + i) for i, (w, _) in enumerate(Counter(t.split()[0] for _, t in rows).items())], "id long, word string, n long")
    words = {r.id: r.word for r in known.collect()}
    exact = {words[r.id]: r.n_near for r in spelling.near_words(known, spelling.Scratch(spark, "t")).collect()}
    real = spelling._keys

    def coarse(batches):
        for b in real(batches):
            key = np.asarray(b.column(0)) % 2
            yield type(b).from_arrays([spelling.pa.array(key), *b.columns[1:]], b.schema.names)

    monkeypatch.setattr(spelling, "_keys", coarse)
    assert {words[r.id]: r.n_near for r in spelling.near_words(known, spelling.Scratch(spark, "t")).collect()} == exact
    assert exact["abcdefgh"] == 4


def plain_phrases(rows, often, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: c for p, c in counts.items() if len(p) > 1 and c >= often}
        held = defaultdict(int)
        for p, c in kept.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], c)
        rows = []
        for p, a in kept.items():
            if 100 * held[p] >= 100 * a:
                continue
            s, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], 100, 2000)
    got = queries()["op12_collocations"](spark, sf)
    assert got.columns == PHRASES
    assert sorted(tuple(r) for r in got.collect()) == want
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(duckdb.sql(collocations.OP12_SQL).fetchall()) == want


@pytest.mark.parametrize(("bits", "chunk"), [(22, 300), (3, 1 << 20), (15, 2000)])
def test_phrases_of_made_texts(spark, docs_of, bits, chunk):
    rng = np.random.default_rng(3)
    vocabulary = ["The", "the", "a", "cat", "SAT", "on mat", "É", "é", "x y", "日本"]
    rows = []
    for i in range(60):
        text = "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", " ", "  ", "\t", ". ", "\r\n", ";", "\x0b"])) for _ in range(int(rng.integers(0, 80))))
        rows.append((i, text * (3 if i % 9 == 0 else 1), [None, "en", "de"][i % 3]))
    rows += [(90, None, "en"), (91, "", None), (92, "la " * 3000, "fr"), (92, "la " * 3000, "fr"), (93, "only one", "xx")]
    want = plain_phrases([(t, lang) for _, t, lang in rows], 8, 5)
    got = collocations.collocations(docs_of(rows), often=8, top=5, chunk=chunk, bits=bits)  # with few bits nearly all are set, and nothing is ruled out
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrases_are_exact_when_hashes_collide():
    c = collocations.Chunk("en", [b"a b a c a b d b"])
    c.longer()
    c.h = c.h * 0
    phrases, _, n = c.counts(np.flatnonzero(c.ok), 2)
    assert dict(zip(phrases, n.tolist(), strict=True)) == {b"a b": 2, b"b a": 1, b"a c": 1, b"c a": 1, b"b d": 1, b"d b": 1}


def test_scores_pass_64_bits(spark):
    wide = spark.sql("SELECT cast(1000 as decimal(4, 0)) * (cast(9000000000000 as decimal(17, 0)) * cast(90000000000000 as decimal(17, 0))) div (cast(9000000000001 as decimal(19, 0)) * cast(9000000000000 as decimal(19, 0))) x").first().x
    assert wide == 1000 * 9000000000000 * 90000000000000 // (9000000000001 * 9000000000000)


def plain_targets(size_of):
    """Targets of sources by sharing the excess again and again."""
    sources = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        room = 1.5 * sum(size_of.values()) - sum(2 * size_of[s] for s in full)
        free = sum(weight[s] for s in sources if s not in full)
        target = {s: 2 * size_of[s] if s in full else room * weight[s] / free for s in sources}
        over = {s for s in sources if s not in full and target[s] > 2 * size_of[s]}
        if not over:
            return target
        full |= over


def held_to_contract(rows, got):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    of = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        of[s] += n
    target = plain_targets(of)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=key) == sorted(((i, n, of[s]) for (i, _, s), n in zip(rows, size, strict=True)), key=key)
    by_size = defaultdict(set)
    for s, n in of.items():
        by_size[n].add(s)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert any(abs(r.target - target[s]) <= 1e-9 * max(1, target[s]) for s in by_size[r.source_size])
        taken[r.source_size, round(r.target, 6)] += r.taken
    wanted = Counter()
    for s, n in of.items():
        wanted[n, round(target[s], 6)] += target[s]
    for k, n in wanted.items():
        assert abs(taken[k] - n) <= 1 * len(of)
    return size, of, target


def test_mixing_all_documents(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op13_mixing"](spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    first = got.collect()
    _, of, _ = held_to_contract(rows, first)
    # whole copies but for one document a source
    assert sum(r.taken % r.size != 0 for r in first if r.size) <= len(of)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = queries()["op13_mixing"](spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_mixing_odd_rows_and_trees(spark, monkeypatch):
    schema = "doc_id long, text string, source string, size string, target long"
    rng = np.random.default_rng(8)
    rows = [(None if i % 11 == 0 else i % 140, "w x " * int(rng.integers(0, 30)), [None, "", "big", "big", "é", "z"][i % 6]) for i in range(400)]
    rows += [(7, "same text here", "big")] * 70 + [(8, None, "empty"), (9, " \n", "empty"), (10, "a b c", "small")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    for group, fan, step in ((50_000, 32, 100_000), (3, 2, 16)):
        monkeypatch.setattr(mixing, "STEP", step)
        monkeypatch.setattr(mixing.rounded, "__defaults__", (group, fan))
        monkeypatch.setattr(mixing, "RANGE", 2 if group == 3 else 100_000)
        held_to_contract(rows, mixing.mix(frame).collect())
    assert mixing.mix(frame.limit(0)).collect() == []


def test_pivots_keep_words_and_chances():
    rng = np.random.default_rng(2)
    size, p = [3, 50, 7, 1, 20, 9], [0.5, 0.25, 0.9, 0.1, 0.6, 0.4]
    tries = [mixing.pivot(size, p, rng.random(len(p))) for _ in range(4000)]
    for out, left in tries:
        assert sum(0 < x < 1 for x in out) <= 1 and (left is None or 0 < out[left] < 1)
        assert abs(sum(s * x for s, x in zip(size, out, strict=True)) - sum(s * x for s, x in zip(size, p, strict=True))) < 1e-9
    mean = np.mean([out for out, _ in tries], 0)
    assert np.abs(mean - p).max() < 0.04


def test_words_of_empty_and_odd_tables(spark, docs_of, odd):
    empty = docs_of([])
    assert spelling.variants(empty).collect() == []
    assert collocations.collocations(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    rows = odd.collect()
    assert sorted(tuple(r) for r in spelling.variants(odd).collect()) == plain_variants([(r.doc_id, r.text) for r in rows])
    assert sorted(tuple(r) for r in collocations.collocations(odd).collect()) == plain_phrases([(r.text, r.lang) for r in rows], 100, 2000)
    held_to_contract([(r.doc_id, r.text, r.source) for r in rows], mixing.mix(odd).collect())
