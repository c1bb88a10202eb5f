import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from strandloom.llm import decontaminate, minhash, packing, quality, registry, secrets
from strandloom.llm.common import table

SF = "/root/testdata/sf0.001"


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, texts):
    """Each id in exactly one piece, sequences without gaps, hardly any padding."""
    t, by = reference(), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark):
    check_pieces(packing.op6_packing(spark, SF).collect(), {r.doc_id: r.text for r in table(spark, SF, "documents").collect()})


def test_packing_edge_cases(spark, odd):
    rows = packing.pack(odd.filter("doc_id is not null and doc_id <> 4")).collect()
    check_pieces(rows, {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 4)})
    assert len({(r.sequence_id, r.offset) for r in packing.pack(odd).collect()}) == packing.pack(odd).count()
    assert packing.pack(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab1 '’éñ\n\t.,<|>endoftxt\xa0\xad߷", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "a", " bc", "\n", "日本", "é", "<"]), max_size=12).map("".join))
def test_both_libraries_agree(text):
    want = [*reference_cached().encode(text, add_special_tokens=False).ids, 1]
    assert packing.encoder()(text).tolist() == want


_REF = []


def reference_cached():
    if not _REF:
        _REF.append(reference())
    return _REF[0]


def test_the_mark_is_one_id():
    assert packing.encoder()("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 1]
    assert packing.encoder()("日 <|endoftext|> b").tolist()[-3:] == [50256, 275, 1]


def test_whole_words_are_hashed():
    a, b = packing.vectors(["internationalisation of interviews", "interstate of interest"])
    assert (a != b).any()
    assert (packing.vectors(["one two three"]) == packing.vectors(["three  one\ntwo "])).all()
    far, near = packing.word_hashes(np.frombuffer("日本語 日x ".encode(), np.uint8))
    assert len(far) == 4 and near[0] != near[1]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_connected(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(grid, bits)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


ITEMS = [(1, "A train with 12 red cars leaves Boston at 40 miles per hour while Alice waits for 12 friends near the old river bridge today"), (2, "short one"), (3, None), (4, "In the quiet town a baker named Bruno sells 3 loaves to Carla and then 5 loaves to Dan before noon on every market day")]


def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, h string")


def test_templates_are_found(spark, docs_of):
    other = ITEMS[0][1].replace("12", "77").replace("Boston", "Paris").replace("40 miles", "90 km").replace("Alice", "Zoe")
    clash = ITEMS[0][1].replace("12 red", "77 red")
    docs = docs_of([(1, "some words before it. " + ITEMS[0][1] + " and after"), (2, "here: " + other), (3, "here: " + clash), (4, "nothing of this kind is in here, only plain words that go on and on for a while"), (5, None), (6, ""), (7, ITEMS[3][1]), (7, ITEMS[3][1]), (None, ITEMS[0][1])])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench(spark)).filter("contaminated").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 4)}
    assert decontaminate.matches(docs.limit(0), bench(spark)).count() == 0
    assert decontaminate.matches(docs, bench(spark).limit(0)).count() == 0


def test_slots_are_consistent_within_a_window_both_ways(spark, docs_of):
    item = spark.createDataFrame([(1, "so 3 red boxes and 3 blue balls with 5 lids go there")], "item_id long, text string")
    docs = docs_of([(1, "so 4 red boxes and 4 blue balls with 9 lids go there"), (2, "so 4 red boxes and 7 blue balls with 9 lids go there"), (3, "so 4 red boxes and 4 blue balls with 4 lids go there"), (4, "so 4 red boxes and 4 blue balls with 9 lids go there"), (4, "quite another text about nothing of this at all")])
    got = {r.doc_id: (r.n_windows, r.n_slots) for r in decontaminate.matches(docs, item).collect()}
    # 13 words, six windows: the first two hold the two equal numbers (places 1 and 5), the other four the second and the third (5 and 9)
    assert got == {1: (6, 3), 2: (4, 2), 3: (2, 2), 4: (6, 3)}


def test_items_in_other_case_are_found(spark, docs_of):
    docs = docs_of([(1, "HERE IT IS: " + ITEMS[0][1].upper() + " AND ON"), (2, ITEMS[0][1].lower()), (3, "so " + ITEMS[3][1].upper()), (4, "NOTHING OF THIS KIND IS IN HERE, ONLY PLAIN WORDS THAT GO ON AND ON")])
    got = {(r.doc_id, r.item_id): (r.n_matched, r.item_windows) for r in decontaminate.matches(docs, bench(spark)).filter("contaminated").collect()}
    assert got == {(1, 1): (18, 18), (2, 1): (18, 18), (3, 4): (18, 18)}


def test_decontamination_same_without_broadcast(spark, monkeypatch):
    a = sorted(map(tuple, decontaminate.op8_decontamination(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
    assert sorted(map(tuple, decontaminate.op8_decontamination(spark, SF).collect())) == a


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    cols = sorted(df.columns)
    want = c.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.select(*cols).fetchall())


def test_sql_of_decontamination_knows_plain_words(spark, docs_of, tmp_path):
    """Items in capitals, in lower case, with other numbers, in parts and twice, in both languages."""
    import duckdb

    texts = [ITEMS[0][1].upper(), ITEMS[0][1].lower(), ITEMS[3][1].upper() + " and on", ITEMS[0][1].replace("12", "9"), ITEMS[0][1].replace("12 red", "77 red"), "so " + " ".join(ITEMS[3][1].split()[3:15]).lower(), ITEMS[0][1] + ". " + ITEMS[3][1].upper(), "a quite other text that goes on for more than eight words", "", None]
    docs_of([*enumerate(texts), (3, ITEMS[3][1]), (None, ITEMS[0][1])]).drop("score").write.parquet((tmp_path / "documents.parquet").as_uri())
    bench(spark).write.parquet((tmp_path / "benchmark.parquet").as_uri())
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = decontaminate.op8_decontamination(spark, tmp_path.as_uri())
    want = c.sql(decontaminate.OP8_SQL).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[2] == 0 for r in want) and len(want) >= 7


def test_stages_against_plain_python(spark):
    SF = "/root/testdata/sf0.01"  # noqa: N806
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, table(spark, SF, "labels"))
    first = corpus_pipeline.good_quality(spark, docs, SF)
    assert first.columns == list(corpus_pipeline.COLUMNS) == docs.columns
    want = {i for i, r in rows.items() if model.score(quality.features(r.text)) >= 0.3}
    assert {r.doc_id for r in first.collect()} == want and 0.7 * len(rows) < len(want) < len(rows)

    second = corpus_pipeline.one_of_each_group(spark, first, SF)
    from test_duplicates import brute_classes

    classes = brute_classes([(i, rows[i].text) for i in want])
    assert {r.doc_id for r in second.collect()} == {i for i, c in classes.items() if i == c}

    third = corpus_pipeline.without_benchmark(spark, second, SF)
    found = {r.doc_id for r in decontaminate.matches(second, table(spark, SF, "benchmark")).filter("contaminated").collect()}
    kept = {r.doc_id for r in second.collect()}
    assert {r.doc_id for r in third.collect()} == kept - found

    fourth = corpus_pipeline.without_secrets(spark, third, SF)
    forest = secrets.train()
    for r in fourth.collect():
        text = rows[r.doc_id].text
        clean = secrets.redacted(text, [x for x in secrets.findings_of(text, forest) if x[2] >= 0.5])
        assert r.text == clean and (r.n_chars == rows[r.doc_id].n_chars if clean == text else r.n_chars == len(clean))
    check_pieces(corpus_pipeline.packed(spark, fourth, SF).collect(), {r.doc_id: r.text for r in fourth.collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_an_id_with_several_texts_loses_only_what_is_alike(spark, docs_of, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = docs_of([(3, a), (5, a + " more"), (5, c), (8, b), (9, c + " x"), (9, c + " x"), (9, "alone"), (9, "alone"), (None, a), (6, None), (6, None)]).drop("score")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    assert kept == sorted([(3, a), (5, c), (8, b), (9, "alone"), (None, a), (6, None), (6, None)], key=str)
    both = docs_of([(5, c), (5, b)]).drop("score")
    assert corpus_pipeline.one_of_each_group(spark, both, "").count() == 2
    bench(spark).write.parquet((tmp_path / "benchmark.parquet").as_uri())
    leaks = docs_of([(1, ITEMS[0][1]), (1, a), (2, b), (None, ITEMS[0][1]), (4, None)]).drop("score")
    clean = sorted(((r.doc_id, r.text) for r in corpus_pipeline.without_benchmark(spark, leaks, tmp_path.as_uri()).collect()), key=str)
    assert clean == sorted([(1, a), (2, b), (None, ITEMS[0][1]), (4, None)], key=str)


def test_pipeline_edge_cases(spark, odd, tmp_path):
    plain = odd.drop("score").union(odd.drop("score").filter("doc_id = 4"))
    plain.write.parquet((tmp_path / "documents.parquet").as_uri())
    table(spark, SF, "labels").limit(0).write.parquet((tmp_path / "labels.parquet").as_uri())
    bench(spark).write.parquet((tmp_path / "benchmark.parquet").as_uri())
    d = tmp_path.as_uri()
    docs = spark.read.parquet(d + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(4) == 1 and ids.count(None) == 1 and {1, 2, 3} <= set(ids) and 9 not in ids
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, plain.limit(0), d)
        assert empty.count() == 0
    assert json.dumps(ids, default=str) and minhash.K
