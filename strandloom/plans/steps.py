"""The registry of steps, and whole runs: a configuration becomes one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators import adapters, analytics, flowcell, fragmentation, pcr, ribozero, selection, sequencing, synthesis
from strandloom.plans import config as cf


@dataclass(frozen=True)
class Step:
    """A step by name: how its parameters are checked, and how it turns (df, parameters, whole configuration, number of the step)
    into a DataFrame. The number keeps the draws of a step that comes twice apart. parameters: their names, where others are faults."""

    stage: str
    check: Callable[[dict, cf.Faults, str], None]
    apply: Callable[[DataFrame, dict, dict, int], DataFrame]
    parameters: frozenset[str] | None = None


REGISTRY: dict[str, Step] = {}


def register(name: str, stage: str, check: Callable[[dict, cf.Faults, str], None], parameters: str | None = None):
    """Adds a step, also from outside the package."""

    def add(apply: Callable[[DataFrame, dict, dict, int], DataFrame]):
        REGISTRY[name] = Step(stage, check, apply, None if parameters is None else frozenset(parameters.split()))
        return apply

    return add


def seed_of(c: dict, i: int) -> int:
    return c["seed"] * 1000 + i


def sample_table(spark: SparkSession, c: dict) -> DataFrame:
    r = c["resources"]
    rows = [(str(k), r["pre_i5_adapter"], s["barcodes"]["i5"], r["post_i5_adapter"], r["pre_i7_adapter"], s["barcodes"]["i7"], r["post_i7_adapter"]) for k, s in c["samples"].items()]
    return spark.createDataFrame(rows, "sample_id string, pre_i5 string, i5 string, post_i5 string, pre_i7 string, i7 string, post_i7 string")


@register("PolyAStep", "library_prep", cf.check_polya, "breakpoint_prob_per_base min_retention_prob max_retention_prob min_polya_tail_length length_retention_prob")
def _polya(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    tail = p.get("min_polya_tail_length", 40)
    df = selection.polya_select(df, seed_of(c, i), p.get("min_retention_prob", 0), p.get("max_retention_prob", 1), tail, p.get("length_retention_prob", 1))
    return selection.polya_break(df, seed_of(c, i), p.get("breakpoint_prob_per_base", 0), tail)


@register("RiboZeroStep", "library_prep", cf.check_ribozero, "oligos max_degrade_chance degrade_exponent degrade_entire_molecule")
def _ribozero(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return ribozero.deplete(df, seed_of(c, i), p["oligos"], p["max_degrade_chance"], p["degrade_exponent"], p.get("degrade_entire_molecule", False))


@register("FragmentStep", "library_prep", cf.check_fragment, "method rate runtime min_frag_size beta_A beta_B beta_N")
def _fragment(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    own = (df, seed_of(c, i), p["rate"], p["runtime"], p["min_frag_size"])
    return fragmentation.fragment_beta(*own, p["beta_A"], p["beta_B"], p["beta_N"]) if p["method"] == "beta" else fragmentation.fragment_uniform(*own)


@register("FirstStrandSynthesisStep", "library_prep", cf.check_strand, "perfect_priming primes_per_kb position_probability_matrix")
def _first(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return synthesis.first_strand(df, seed_of(c, i), p["position_probability_matrix"], primes_per_kb=p["primes_per_kb"], perfect=p.get("perfect_priming", False))


@register("SecondStrandSynthesisStep", "library_prep", cf.check_strand, "perfect_priming primes_per_kb position_probability_matrix")
def _second(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return synthesis.second_strand(df, seed_of(c, i), p["position_probability_matrix"], primes_per_kb=p["primes_per_kb"], perfect=p.get("perfect_priming", False))


@register("SizingStep", "library_prep", cf.check_sizing, "min_length max_length select_all_start_length select_all_end_length")
def _sizing(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return selection.size_select(df, seed_of(c, i), p["min_length"], p["max_length"], p.get("select_all_start_length"), p.get("select_all_end_length"))


@register("AdapterLigationStep", "library_prep", cf.check_adapter, "parameters")
def _adapters(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return adapters.ligate(df, sample_table(df.sparkSession, c))


@register("PCRAmplificationStep", "library_prep", cf.check_pcr, "number_cycles retention_percentage gc_bias_constant gc_bias_linear gc_bias_quadratic deletion_rate insertion_rate substitution_rate")
def _pcr(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return pcr.amplify(
        df, seed_of(c, i), p["number_cycles"], p["retention_percentage"], p.get("gc_bias_constant", 1.0), p.get("gc_bias_linear", 0.0), p.get("gc_bias_quadratic", 0.0),
        p.get("substitution_rate", 0.0), p.get("insertion_rate", 0.0), p.get("deletion_rate", 0.0),
    )


@register("BridgeAmplificationStep", "sequence", cf.check_bridge, "cycles substitution_rate")
def _bridge(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    return sequencing.bridge(df, seed_of(c, 100 + i), p["cycles"], p.get("substitution_rate", 0.0))


@register("SequenceBySynthesisStep", "sequence", cf.check_synthesis, "read_length skip_rate drop_rate paired_ends forward_is_5_prime")
def _synthesis(df: DataFrame, p: dict, c: dict, i: int) -> DataFrame:
    r, one = c["resources"], next(iter(c["samples"].values()))["barcodes"]
    chemistry = sequencing.Chemistry(p["read_length"], p["skip_rate"], p["drop_rate"], r["pre_i5_adapter"], r["post_i5_adapter"], r["pre_i7_adapter"], r["post_i7_adapter"], len(one["i5"]), len(one["i7"]))
    return sequencing.sequence(df, seed_of(c, 100 + i), chemistry)


def run_steps(df: DataFrame, c: dict, stage: str) -> DataFrame:
    """The steps of a stage in the order of the list; any may come twice or not at all."""
    steps = list(enumerate(c.get(stage) or []))
    return reduce(lambda d, s: REGISTRY[s[1]["step_name"]].apply(d, s[1].get("parameters") or {}, c, s[0]), steps, df)


def geometry(c: dict) -> flowcell.Geometry:
    cell = c.get("flowcell") or {}
    g = cell.get("flowcell_geometry") or {}
    span = lambda axis: (g.get(f"min_{axis}", 0), g.get(f"max_{axis}", 10_000))
    lanes = tuple(cell.get("lanes_to_use") or range(span("lane")[0], span("lane")[1] + 1))
    return flowcell.Geometry(span("tile"), span("x"), span("y"), lanes)


@dataclass
class Run:
    """The lazy results of a run: nothing is computed until a sink asks for it, and only what it asks for."""

    prepared: DataFrame
    clusters: DataFrame
    sequenced: DataFrame
    input_quant: DataFrame
    output_quant: DataFrame


def plan(molecules: DataFrame, c: dict, prepared: DataFrame | None = None) -> Run:
    """Library preparation (unless it is done already), flowcell and sequencing of molecules, and both quantifications."""
    c = cf.load(c)
    prepared = run_steps(molecules, c, "library_prep") if prepared is None else prepared
    clusters = flowcell.load(prepared, seed_of(c, 99), geometry(c), (c.get("flowcell") or {}).get("coordinate_strategy", "random"))
    sequenced = analytics.demultiplex(run_steps(clusters, c, "sequence"), sample_table(molecules.sparkSession, c))
    return Run(prepared, clusters, sequenced, analytics.quantify(molecules), analytics.quantify(prepared))


def logged(molecules: DataFrame, c: dict, path: str) -> DataFrame:
    """The preparation step by step: each step's molecules are written once, and their log, their summary and the next step read them."""
    from strandloom.sources import formats

    df = molecules
    for i, step in enumerate(c.get("library_prep") or []):
        name = f"{i:02d}_{step['step_name']}"
        REGISTRY[step["step_name"]].apply(df, step.get("parameters") or {}, c, i).write.mode("overwrite").parquet(f"{path}/steps/{name}")
        df = molecules.sparkSession.read.parquet(f"{path}/steps/{name}")
        formats.write_log(df, f"{path}/logs/{name}", step["step_name"], full=True)
        analytics.step_summary(df, molecules).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{path}/summary/{name}")
    return df


def execute(molecules: DataFrame, c: dict, contigs: DataFrame, path: str) -> Run:
    """Writes the outputs that the configuration asks for under path. The sequenced clusters are written once as packets,
    which all sinks read again. Full logs hold each step of the preparation, with a summary."""
    from strandloom.sources import bam, formats

    c = cf.load(c)
    out = c.get("output") or {}
    run = plan(molecules, c, logged(molecules, c, path) if out.get("output_full_logs", False) else None)
    formats.write_quant(run.input_quant, f"{path}/input_quant")
    formats.write_quant(run.output_quant, f"{path}/output_quant")
    formats.write_packets(run.sequenced, f"{path}/sequenced")
    reads = formats.read_packets(molecules.sparkSession, f"{path}/sequenced", run.sequenced.drop("base_counts").columns)
    if out.get("output_fastq", True):
        formats.write_fastq(reads, f"{path}/fastq")
    if out.get("output_sam", True):
        formats.write_sam(reads, contigs, f"{path}/sam")
    if out.get("output_bam", False):
        bam.write_bam(reads, contigs, f"{path}/bam")
    return run


def under(root: str, path: str) -> str:
    """A path as it is, or within root if it is a relative one."""
    return path if not root or "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"


def read_input(spark: SparkSession, c: dict, root: str = "") -> DataFrame:
    """The molecules a configuration names: of each sample the files in sample<id> of its directory, and after their packets those
    drawn from the sample's distribution. Paths without a scheme or a leading slash are under root."""
    from strandloom.sources import formats

    given = c.get("input") or {}
    tails = c.get("molecule_maker") or {}
    found = []
    for i, k in enumerate(map(str, c["samples"])):
        folder = f"{under(root, given['directory_path']).rstrip('/')}/sample{k}" if given.get("directory_path") else None
        files = formats.count_files(spark, folder) if folder else 0
        if files:
            found.append(formats.read_molecules(spark, folder, k))
        d = {str(x): y for x, y in (given.get("from_distribution_data") or {}).items()}.get(k) or {}
        if d.get("num_packets"):
            size = d["num_molecules_per_packet"]
            transcripts, weights = formats.read_distribution(spark, under(root, d["sample_data_directory"]))
            span = (tails.get("min_polyA_tail_length", 40), tails.get("max_polyA_tail_length", 250))
            found.append(formats.molecules_from_distribution(spark, transcripts, weights, d["num_packets"] * size, seed_of(c, 200 + i), k, span, size, files))
    if not found:
        raise cf.ConfigError(["input: there are no molecules"])
    return reduce(DataFrame.unionByName, found)


def run(spark: SparkSession, config: dict, path: str, root: str = "") -> Run:
    """A whole run from a configuration alone: its molecules, its reference's contigs, and all outputs under path."""
    from strandloom.sources import formats

    c = cf.load(config)
    molecules, genome = read_input(spark, c, root), c["resources"].get("reference_genome_fasta")
    contigs = formats.read_fasta(spark, under(root, genome)).select("name", "length", "ordinal") if genome else spark.createDataFrame([], "name string, length int, ordinal int")
    return execute(molecules, c, contigs, path)
