"""A training-data pipeline over the documents table, in stages that call the operators of strandloom.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again.

Null texts count as empty throughout and are kept by stages that have nothing against them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, minhash, packing, quality, secrets
from strandloom.llm.common import Scratch, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of the documents at hand."""
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), columns=COLUMNS)
    return documents(scored.filter("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of rows with the same id and text, one. An id's other texts are judged for themselves."""
    scratch, digest = Scratch(spark, "near_duplicates"), F.sha2("text", 256)
    copies, _ = scratch.keep(minhash.near_duplicates(docs).filter("not kept").select("doc_id", "digest"))
    rows = docs.filter("doc_id is not null and text is not null").groupBy("doc_id", digest.alias("digest")).agg(F.count("*").alias("n"))
    repeated, _ = scratch.keep(rows.filter("n > 1").select("doc_id", "digest"))
    alone = without(docs, copies.unionByName(repeated), scratch, digest)
    again, _ = scratch.keep(repeated.join(copies, ["doc_id", "digest"], "left_anti"))
    if again.isEmpty():
        return documents(alone)
    same = docs.withColumn("digest", digest).join(again, ["doc_id", "digest"], "left_semi")
    others = [c for c in COLUMNS if c != "doc_id"]
    one = same.groupBy("doc_id", "digest").agg(F.min(F.struct(*[c for c in others if c != "text"], "text")).alias("x"))
    return documents(alone).unionByName(documents(one.select("doc_id", "x.*")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its numbers and names."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), apart=True).filter("contaminated")
    return documents(without(docs, found, Scratch(spark, "decontaminated"), F.xxhash64("text")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a placeholder; n_chars follows where a text changed."""
    return documents(secrets.redact(docs, secrets.train(secrets.labelled_findings(spark, sf_dir)), COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models, hashing and tokenising can't be said in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result but the last is written to the shared scratch folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
