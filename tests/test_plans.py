import copy

import pytest

from strandloom.plans import config, queries, steps
from strandloom.streaming import steps as streaming

PPM = {b: [0.25] * 6 for b in "ACGT"}
GOOD = {
    "seed": 100,
    "output": {"output_fastq": True, "output_sam": True, "output_bam": False, "output_full_logs": True},
    "samples": {"1": {"barcodes": {"i5": "ACGTACGT", "i7": "TTGCAAGC"}}, "2": {"barcodes": {"i5": "TGCATGCA", "i7": "CCGATTAG"}}},
    "resources": {"pre_i5_adapter": "AATG", "post_i5_adapter": "ACAC", "pre_i7_adapter": "GATC", "post_i7_adapter": "ATCT"},
    "library_prep": [
        {"step_name": "PolyAStep", "parameters": {"min_polya_tail_length": 10, "length_retention_prob": 0.1}},
        {"step_name": "FragmentStep", "parameters": {"method": "uniform", "rate": 0.01, "runtime": 1, "min_frag_size": 20}},
        {"step_name": "FirstStrandSynthesisStep", "parameters": {"perfect_priming": False, "primes_per_kb": 50, "position_probability_matrix": PPM}},
        {"step_name": "SecondStrandSynthesisStep", "parameters": {"perfect_priming": False, "primes_per_kb": 50, "position_probability_matrix": PPM}},
        {"step_name": "SizingStep", "parameters": {"min_length": 20, "max_length": 400, "select_all_start_length": 40, "select_all_end_length": 300}},
        {"step_name": "AdapterLigationStep", "parameters": {"parameters": None}},
        {"step_name": "PCRAmplificationStep", "parameters": {"number_cycles": 4, "retention_percentage": 20, "gc_bias_constant": 1, "gc_bias_linear": 0, "gc_bias_quadratic": -4, "deletion_rate": 0.0001, "insertion_rate": 0.0001, "substitution_rate": 0.001}},
    ],
    "sequence": [
        {"step_name": "BridgeAmplificationStep", "parameters": {"cycles": 10, "substitution_rate": 0.01}},
        {"step_name": "SequenceBySynthesisStep", "parameters": {"read_length": 30, "skip_rate": 0.002, "drop_rate": 0.002}},
    ],
    "flowcell": {"coordinate_strategy": "distinct", "flowcell_geometry": {"min_lane": 1, "max_lane": 4, "min_tile": 1, "max_tile": 9, "min_x": 0, "max_x": 99, "min_y": 0, "max_y": 99}, "lanes_to_use": [1, 2]},
}


def put(path, value):
    c = copy.deepcopy(GOOD)
    d = c
    for k in path[:-1]:
        d = d[k]
    d[path[-1]] = value
    return c


def test_good_config():
    assert config.check(GOOD) == []


@pytest.mark.parametrize(
    "path, value",
    [
        (("seed",), "x"), (("samples", "1", "barcodes", "i5"), "ACGT5"), (("samples", "1", "barcodes", "i5"), "ACG"), (("samples",), {}), (("resources", "pre_i7_adapter"), ""),
        (("library_prep", 0, "parameters", "min_retention_prob"), 1.5), (("library_prep", 1, "parameters", "method"), "cut"), (("library_prep", 1, "parameters", "rate"), 0),
        (("library_prep", 2, "parameters", "primes_per_kb"), 2000), (("library_prep", 2, "parameters", "position_probability_matrix"), PPM | {"A": [0.25] * 5}),
        (("library_prep", 2, "parameters", "position_probability_matrix"), PPM | {"A": [0.3] * 6}), (("library_prep", 2, "parameters", "position_probability_matrix"), PPM | {"A": ["x"] * 6}),
        (("library_prep", 4, "parameters", "max_length"), 10), (("library_prep", 4, "parameters", "select_all_end_length"), 500), (("library_prep", 6, "parameters", "number_cycles"), 17),
        (("library_prep", 6, "parameters", "retention_percentage"), 0), (("sequence", 0, "parameters", "cycles"), 0), (("sequence", 1, "parameters", "paired_ends"), False), (("sequence", 1, "parameters", "read_length"), True),
        (("flowcell", "coordinate_strategy"), "grid"), (("flowcell", "lanes_to_use"), [9]), (("flowcell", "flowcell_geometry", "min_x"), 100), (("library_prep", 0, "step_name"), "NoStep"),
        (("colour",), 1), (("library_prep", 0, "parameters", "min_retention"), 0.5), (("output", "output_cram"), True), (("flowcell", "lanes"), [1]),
        (("input",), {"from_distribution_data": {"1": {"num_packets": 1, "sample_data_directory": "x"}}}), (("input",), {"from_distribution_data": {"1": {"num_packets": -1}}}), (("input",), {"directory_path": 3}),
        (("input",), {"from_distribution_data": {"7": {}}}), (("molecule_maker",), {"min_polyA_tail_length": 300}),
    ],
)
def test_bad_config(path, value):
    faults = config.check(put(path, value))
    assert len(faults) >= 1
    with pytest.raises(config.ConfigError):
        config.load(put(path, value))


def places(x, path=()):
    """Every place of a nested configuration."""
    yield path
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from places(v, (*path, k))


def test_any_value_anywhere_is_told():
    """Whatever stands where something else should: all faults come in one list, nothing is raised."""
    good = GOOD | {"input": {"directory_path": "x", "from_distribution_data": {"1": {"num_packets": 1, "num_molecules_per_packet": 5, "sample_data_directory": "d"}}}, "molecule_maker": {"min_polyA_tail_length": 1}}
    good = copy.deepcopy(good)
    good["library_prep"].append({"step_name": "RiboZeroStep", "parameters": {"oligos": ["ACGT"], "max_degrade_chance": 0.5, "degrade_exponent": 2}})
    assert config.check(good) == []
    told = 0
    for path in list(places(good))[1:]:
        for value in (None, 5, -1, "x", [], {}, [1], [None], {"a": 1}, True, float("nan"), float("inf"), [[]], [{}]):
            c = copy.deepcopy(good)
            d = c
            for k in path[:-1]:
                d = d[k]
            d[path[-1]] = value
            faults = config.check(c)
            assert all(isinstance(f, str) for f in faults)
            told += bool(faults)
    assert told > 1000
    for value in (None, 5, "x", [], [1]):
        assert config.check(value)
    for path, value in ((("samples",), {"1": None}), (("samples",), ["a"]), (("library_prep", 0), "PolyAStep"), (("library_prep", 7, "parameters", "oligos"), 5), (("flowcell", "lanes_to_use"), 3), (("library_prep",), {"a": 1})):
        c = copy.deepcopy(good)
        d = c
        for k in path[:-1]:
            d = d[k]
        d[path[-1]] = value
        assert config.check(c)
    both = copy.deepcopy(good)
    both["samples"], both["flowcell"], both["seed"] = ["a"], 4, None
    assert len(config.check(both)) >= 3


def test_whole_run(spark, sf, tmp_path):
    m = queries.from_documents(spark, sf)
    contigs = spark.createDataFrame([("en", 10**9, 0), ("de", 10**9, 1), ("es", 10**9, 2), ("fr", 10**9, 3)], "name string, length long, ordinal int")
    run = steps.execute(m, GOOD, contigs, tmp_path.as_uri())
    n = spark.read.parquet((tmp_path / "sequenced").as_uri()).count()
    assert n > 20
    assert spark.read.text((tmp_path / "fastq").as_uri()).count() == 8 * n
    assert run.sequenced.filter("status = 'identified'").count() > 0.9 * n
    assert {x.name for x in tmp_path.iterdir()} >= {"fastq", "sam", "input_quant", "output_quant", "logs", "summary"}
    assert sorted(x.name for x in (tmp_path / "logs").iterdir()) == [f"{i:02d}_{s['step_name']}" for i, s in enumerate(GOOD["library_prep"])]
    lazy = steps.plan(m, GOOD)
    assert sorted(r.row_key for r in lazy.prepared.collect()) == sorted(r.row_key for r in run.prepared.collect())


def nested(c):
    """The same configuration in the nested layout."""
    named = lambda steps: [{**s, "step_name": f"some_module.{s['step_name']}"} for s in steps]
    return {
        "seed": c["seed"], "output": {"output_fastq": True, "output_sam": True, "output_bam": False, "full_logs": False},
        "global_config": {"samples": c["samples"], "resources": c["resources"], "molecule_maker_parameters": {"min_polyA_tail_length": 5, "max_polyA_tail_length": 9}},
        "library_prep_pipeline": {"input": c["input"], "steps": named(c["library_prep"])}, "sequence_pipeline": {"steps": named(c["sequence"]), "flowcell": c["flowcell"]},
    }


def test_run_from_configuration(spark, sf, tmp_path):
    """Molecules of files and of a distribution, with the reference's contigs, in both layouts."""
    m = queries.from_documents(spark, sf).filter("ordinal < 60").withColumn("file", queries.F.lit("molecule_1"))
    queries.formats.write_molecules(m, (tmp_path / "in" / "sample1").as_uri(), "file")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "transcripts.tsv").write_text("a\tchr1\t11\t60M\t+\t" + "ACGTTGCAAC" * 6 + "\nb\tchr1\t101\t80M\t-\t" + "GGCATTACGT" * 8 + "\n")
    (tmp_path / "dist" / "weights.tsv").write_text("a\t1\nb\t3\n")
    (tmp_path / "g.fa").write_text(">chr1\n" + "ACGT" * 100 + "\n")
    given = {"directory_path": "in", "from_distribution_data": {"2": {"num_packets": 2, "num_molecules_per_packet": 30, "sample_data_directory": "dist"}}}
    plain = copy.deepcopy(GOOD) | {"input": given, "resources": GOOD["resources"] | {"reference_genome_fasta": "g.fa"}, "molecule_maker": {"min_polyA_tail_length": 5, "max_polyA_tail_length": 9}}
    assert config.arranged(nested(plain)) | {"output": 0} == plain | {"output": 0}
    got = steps.read_input(spark, config.load(nested(plain)), tmp_path.as_uri())
    assert sorted(map(tuple, got.groupBy("sample_id", "packet_id").count().collect())) == [("1", 0, 60), ("2", 0, 30), ("2", 1, 30)]
    steps.run(spark, nested(plain), (tmp_path / "out").as_uri(), tmp_path.as_uri())
    n = spark.read.parquet((tmp_path / "out" / "sequenced").as_uri()).count()
    assert n > 5
    files = list((tmp_path / "out" / "sam").rglob("*.txt"))
    assert files and all(f.read_text().startswith("@HD\tVN:1.0\n@SQ\tSN:chr1\tLN:400\n") for f in files)
    assert sum(not x.startswith("@") for f in files for x in f.read_text().splitlines()) == 2 * n
    with pytest.raises(config.ConfigError):
        steps.run(spark, plain | {"input": {}}, (tmp_path / "none").as_uri())


def test_own_step(spark, sf):
    @steps.register("HalfStep", "library_prep", lambda p, f, where: None)
    def half(df, p, c, i):
        return df.filter("ordinal % 2 = 0")

    c = copy.deepcopy(GOOD) | {"library_prep": [{"step_name": "HalfStep"}]}
    assert config.check(c) == []
    assert steps.run_steps(queries.from_documents(spark, sf), c, "library_prep").count() * 2 == queries.from_documents(spark, sf).count()
    del steps.REGISTRY["HalfStep"]


def test_stream_equals_batch(spark, sf, tmp_path):
    m = queries.from_documents(spark, sf)
    for i in range(2):
        m.filter(f"ordinal % 2 = {i}").write.mode("append").parquet((tmp_path / "in").as_uri())
        live = streaming.read_packets(spark, (tmp_path / "in").as_uri(), m.schema)
        streaming.process(live, queries.size_selected, (tmp_path / "out").as_uri(), (tmp_path / "ck").as_uri()).awaitTermination(120)
    got = spark.read.parquet((tmp_path / "out").as_uri())
    assert sorted(r.row_key for r in got.collect()) == sorted(r.row_key for r in queries.size_selected(m).collect())
    streaming.running_quant(streaming.read_packets(spark, (tmp_path / "in").as_uri(), m.schema), "live_quant", (tmp_path / "ck2").as_uri()).awaitTermination(120)
    assert spark.sql("select sum(counts) from live_quant").first()[0] == m.count()
