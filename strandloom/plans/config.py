"""Configuration: a nested mapping (as from YAML), checked as a whole before anything runs.

check() returns every fault found as one list of messages; load() raises them together.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

OLIGO = re.compile(r"[ACGT]+")
BASES = ("A", "C", "G", "T")


class ConfigError(ValueError):
    """All faults of a configuration."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass
class Faults:
    found: list[str] = field(default_factory=list)

    def number(self, d: dict, key: str, where: str, low: float = -math.inf, high: float = math.inf, whole: bool = False, above: bool = False, default: Any = None) -> Any:
        """A number within bounds; above leaves the lower bound itself out."""
        x = d.get(key, default)
        ok = isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and not (whole and x != int(x)) and (x > low if above else x >= low) and x <= high
        if not ok:
            self.found.append(f"{where}.{key}: {x!r} isn't {'a whole number' if whole else 'a number'} {'above' if above else 'from'} {low} to {high}")
            return None
        return x

    def flag(self, d: dict, key: str, where: str, default: bool | None = None) -> None:
        if not isinstance(d.get(key, default), bool):
            self.found.append(f"{where}.{key}: {d.get(key)!r} isn't true or false")

    def oligo(self, x: Any, where: str) -> str:
        s = x.strip().upper() if isinstance(x, str) else ""
        if not OLIGO.fullmatch(s):
            self.found.append(f"{where}: {x!r} isn't a sequence of A, C, G, T")
        return s

    def table(self, x: Any, where: str) -> dict:
        """A mapping, empty where there is none or something else stands."""
        if x is not None and not isinstance(x, dict):
            self.found.append(f"{where}: {x!r} isn't a mapping")
        return x if isinstance(x, dict) else {}

    def items(self, x: Any, where: str) -> list:
        """A list, empty where there is none or something else stands."""
        if x is not None and not isinstance(x, list | tuple):
            self.found.append(f"{where}: {x!r} isn't a list")
        return [*x] if isinstance(x, list | tuple) else []

    def say(self, wrong: bool, message: str) -> None:
        if wrong:
            self.found.append(message)


def check_polya(p: dict, f: Faults, where: str) -> None:
    f.number(p, "breakpoint_prob_per_base", where, 0, 1, default=0)
    low = f.number(p, "min_retention_prob", where, 0, 1, default=0)
    high = f.number(p, "max_retention_prob", where, 0, 1, default=1)
    f.say(None not in (low, high) and low > high, f"{where}: min_retention_prob is above max_retention_prob")
    f.number(p, "min_polya_tail_length", where, 0, whole=True, default=40)
    f.number(p, "length_retention_prob", where, 0, 1, default=1)


def check_ribozero(p: dict, f: Faults, where: str) -> None:
    f.number(p, "max_degrade_chance", where, 0, 1)
    f.number(p, "degrade_exponent", where, 0, above=True)
    f.flag(p, "degrade_entire_molecule", where, False)
    oligos = f.items(p.get("oligos"), f"{where}.oligos")
    f.say(not oligos, f"{where}.oligos: none are given")
    for o in oligos:
        f.oligo(o, f"{where}.oligos")


def check_fragment(p: dict, f: Faults, where: str) -> None:
    method = p.get("method")
    f.say(method not in ("uniform", "beta"), f"{where}.method: {method!r} isn't uniform or beta")
    f.number(p, "rate", where, 0, above=True)
    f.number(p, "runtime", where, 0, above=True)
    f.number(p, "min_frag_size", where, 1, whole=True)
    if method == "beta":
        f.number(p, "beta_A", where, 0, above=True)
        f.number(p, "beta_B", where, 0, above=True)
        f.number(p, "beta_N", where, 0)


def check_strand(p: dict, f: Faults, where: str) -> None:
    f.flag(p, "perfect_priming", where, False)
    f.number(p, "primes_per_kb", where, 0, 1000, above=True)
    m = f.table(p.get("position_probability_matrix"), f"{where}.position_probability_matrix")
    if set(m) != set(BASES) or not all(isinstance(v, list) and v for v in m.values()) or len({len(v) for v in m.values()}) != 1:
        f.found.append(f"{where}.position_probability_matrix: it needs A, C, G and T with as many places each")
        return
    if any(not isinstance(x, int | float) or isinstance(x, bool) or not 0 < x < 1 for v in m.values() for x in v):
        f.found.append(f"{where}.position_probability_matrix: probabilities must lie between 0 and 1")
        return
    f.say(any(not math.isclose(sum(m[b][j] for b in BASES), 1) for j in range(len(m["A"]))), f"{where}.position_probability_matrix: a place doesn't add up to 1")


def check_sizing(p: dict, f: Faults, where: str) -> None:
    low, high = f.number(p, "min_length", where, 0, whole=True), f.number(p, "max_length", where, 1, whole=True)
    if None in (low, high):
        return
    f.say(low >= high, f"{where}: min_length isn't below max_length")
    a = f.number(p, "select_all_start_length", where, 0) if p.get("select_all_start_length") else low
    b = f.number(p, "select_all_end_length", where, 0) if p.get("select_all_end_length") else high
    f.say(None not in (a, b) and not low <= a <= b <= high, f"{where}: the plateau isn't within the limits")


def check_adapter(p: dict, f: Faults, where: str) -> None:
    """Adapters and barcodes are checked with the resources and samples; the step has no parameters of its own."""


def check_pcr(p: dict, f: Faults, where: str) -> None:
    f.number(p, "number_cycles", where, 0, 16, whole=True)
    f.number(p, "retention_percentage", where, 0, 100, above=True)
    for k in ("gc_bias_constant", "gc_bias_linear", "gc_bias_quadratic"):
        f.number(p, k, where, default={"gc_bias_constant": 1}.get(k, 0))
    for k in ("deletion_rate", "insertion_rate", "substitution_rate"):
        f.number(p, k, where, 0, 1, default=0)


def check_bridge(p: dict, f: Faults, where: str) -> None:
    f.number(p, "cycles", where, 1, 40, whole=True)
    f.number(p, "substitution_rate", where, 0, 1, default=0)


def check_synthesis(p: dict, f: Faults, where: str) -> None:
    f.number(p, "read_length", where, 1, whole=True)
    f.number(p, "skip_rate", where, 0, 1)
    f.number(p, "drop_rate", where, 0, 1)
    f.flag(p, "paired_ends", where, True)
    f.flag(p, "forward_is_5_prime", where, True)
    f.say(p.get("paired_ends") is False or p.get("forward_is_5_prime") is False, f"{where}: only paired ends with the 5' end first can be sequenced")


def check_samples(samples: dict, f: Faults) -> None:
    f.say(not samples, "samples: none are given")
    lengths = {"i5": set(), "i7": set()}
    for k, s in samples.items():
        f.say(not re.fullmatch("[0-9]+", str(k)), f"samples: {k!r} isn't a number")
        codes = f.table(f.table(s, f"samples.{k}").get("barcodes"), f"samples.{k}.barcodes")
        for end in lengths:
            lengths[end].add(len(f.oligo(codes.get(end), f"samples.{k}.barcodes.{end}")))
    for end, found in lengths.items():
        f.say(len(found) > 1, f"samples: barcodes {end} differ in length")


def check_flowcell(c: dict, f: Faults) -> None:
    f.say(c.get("coordinate_strategy", "random") not in ("random", "distinct"), f"flowcell.coordinate_strategy: {c.get('coordinate_strategy')!r} isn't random or distinct")
    g = f.table(c.get("flowcell_geometry"), "flowcell.flowcell_geometry")
    for axis in ("lane", "tile", "x", "y"):
        low = f.number(g, f"min_{axis}", "flowcell.geometry", 0, whole=True, default=0)
        high = f.number(g, f"max_{axis}", "flowcell.geometry", 0, whole=True, default=10_000)
        f.say(None not in (low, high) and low > high, f"flowcell.geometry: min_{axis} is above max_{axis}")
    lanes = f.items(c.get("lanes_to_use"), "flowcell.lanes_to_use")
    low, high = (x if isinstance(x, int) else d for x, d in ((g.get("min_lane"), 0), (g.get("max_lane"), 10_000)))
    f.say(any(not isinstance(x, int) or isinstance(x, bool) or not low <= x <= high for x in lanes), "flowcell.lanes_to_use: a lane isn't there")


#: The keys of a configuration in the plain layout.
KEYS = {"seed", "output", "samples", "resources", "molecule_maker", "library_prep", "sequence", "flowcell", "input"}
#: The keys of the nested layout: section, and under which plain key each of its entries goes.
NESTED = {
    "global_config": {"samples": "samples", "resources": "resources", "molecule_maker_parameters": "molecule_maker"},
    "library_prep_pipeline": {"input": "input", "steps": "library_prep"},
    "sequence_pipeline": {"steps": "sequence", "flowcell": "flowcell"},
}
SECTIONS = {
    "output": {"output_fastq", "output_sam", "output_bam", "output_full_logs", "full_logs"},
    "resources": {"pre_i5_adapter", "post_i5_adapter", "pre_i7_adapter", "post_i7_adapter", "reference_genome_fasta"},
    "molecule_maker": {"min_polyA_tail_length", "max_polyA_tail_length"},
    "flowcell": {"coordinate_strategy", "flowcell_geometry", "lanes_to_use"},
    "input": {"directory_path", "from_distribution_data"},
}


def arranged(config: dict, f: Faults | None = None) -> dict:
    """The configuration in the plain layout, whichever it came in; steps by the names of their classes without a module before them.
    Keys that nothing reads are faults."""
    f = f or Faults()
    config = f.table(config, "configuration")
    nested = any(k in config for k in NESTED)
    known = {"seed", "output", *NESTED} if nested else KEYS
    out = {k: v for k, v in config.items() if k in ({"seed", "output"} if nested else KEYS)}
    f.found += [f"{k}: there is no such key" for k in config if k not in known]
    for section, entries in NESTED.items() if nested else ():
        for k, v in f.table(config.get(section), section).items():
            f.say(k not in entries, f"{section}.{k}: there is no such key")
            out[entries.get(k, k)] = v
    for section in ("samples", *SECTIONS):
        if section in out:
            out[section] = f.table(out[section], section)
    for section, entries in SECTIONS.items():
        f.found += [f"{section}.{k}: there is no such key" for k in out.get(section) or {} if k not in entries]
    for stage in ("library_prep", "sequence"):
        steps = [f.table({} if step is None else step, f"{stage}[{i}]") for i, step in enumerate(f.items(out.get(stage), stage))]
        f.found += [f"{stage}[{i}].{k}: there is no such key" for i, step in enumerate(steps) for k in step if k not in ("step_name", "parameters")]
        out[stage] = [{**step, "step_name": str(step.get("step_name")).rsplit(".", 1)[-1], "parameters": f.table(step.get("parameters"), f"{stage}[{i}].parameters")} for i, step in enumerate(steps)]
    if "full_logs" in (out.get("output") or {}):
        out["output"] = {"output_full_logs": out["output"]["full_logs"], **{k: v for k, v in out["output"].items() if k != "full_logs"}}
    return out


def check_input(c: dict, f: Faults) -> None:
    f.say(not isinstance(c.get("directory_path") or "", str), "input.directory_path isn't a path")
    for k, d in f.table(c.get("from_distribution_data"), "input.from_distribution_data").items():
        where = f"input.from_distribution_data.{k}"
        d = f.table(d, where)
        f.found += [f"{where}.{x}: there is no such key" for x in d if x not in ("num_packets", "num_molecules_per_packet", "sample_data_directory")]
        if f.number(d, "num_packets", where, 0, whole=True, default=0):
            f.number(d, "num_molecules_per_packet", where, 1, whole=True)
            f.say(not isinstance(d.get("sample_data_directory"), str), f"{where}.sample_data_directory isn't a path")


def check(config: dict) -> list[str]:
    """Every fault of a whole configuration."""
    from strandloom.plans.steps import REGISTRY

    f = Faults()
    config = arranged(config, f)
    f.say(not isinstance(config.get("seed"), int) or isinstance(config.get("seed"), bool), f"seed: {config.get('seed')!r} isn't a whole number")
    samples = config.get("samples") or {}
    check_samples(samples, f)
    res = config.get("resources") or {}
    for k in ("pre_i5_adapter", "post_i5_adapter", "pre_i7_adapter", "post_i7_adapter"):
        f.oligo(res.get(k), f"resources.{k}")
    tails = config.get("molecule_maker") or {}
    low = f.number(tails, "min_polyA_tail_length", "molecule_maker", 0, whole=True, default=40)
    high = f.number(tails, "max_polyA_tail_length", "molecule_maker", 0, whole=True, default=250)
    f.say(None not in (low, high) and low > high, "molecule_maker: the least tail is longer than the longest")
    for k in ("fastq", "sam", "bam", "full_logs"):
        f.flag(config.get("output") or {}, f"output_{k}", "output", k in ("fastq", "sam"))
    for stage in ("library_prep", "sequence"):
        for i, step in enumerate(config.get(stage) or []):
            name = step.get("step_name")
            if name not in REGISTRY or REGISTRY[name].stage != stage:
                f.found.append(f"{stage}[{i}]: there is no step {name!r}")
            else:
                known = REGISTRY[name].parameters
                f.found += [f"{stage}[{i}] {name}.{k}: there is no such parameter" for k in step.get("parameters") or {} if known is not None and k not in known]
                REGISTRY[name].check(step.get("parameters") or {}, f, f"{stage}[{i}] {name}")
    check_flowcell(config.get("flowcell") or {}, f)
    check_input(config.get("input") or {}, f)
    given = (config.get("input") or {}).get("from_distribution_data")
    named = {str(k) for k in given} if isinstance(given, dict) else set()
    f.say(not named <= {str(k) for k in samples}, "input.from_distribution_data: a sample isn't among the samples")
    return f.found


def load(config: dict) -> dict:
    """The configuration in the plain layout, or a ConfigError with all its faults."""
    if faults := check(config):
        raise ConfigError(faults)
    return arranged(config)


def load_yaml(text: str) -> dict:
    import yaml

    return load(yaml.safe_load(text))
