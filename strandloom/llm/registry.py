"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import collocations, decontaminate, embeddings, langid, minhash, mixing, packing, pii, quality, secrets, spelling, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_near_duplicates": minhash.op2_near_duplicates,
        "op3_substrings": substrings.op3_substrings,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_embedding_near_duplicates": embeddings.op5_embedding_near_duplicates,
        "op6_packing": packing.op6_packing,
        "op7_pii": pii.op7_pii,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_secrets": secrets.op9_secrets,
        "op10_quality": quality.op10_quality,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_collocations": collocations.op12_collocations,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_decontamination": decontaminate.OP8_SQL,
        "op12_collocations": collocations.OP12_SQL,
    }
