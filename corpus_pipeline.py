"""The training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated
passages and benchmark passages are cut out, and the sources are mixed to target weights.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents; n_chars follows a changed text.

Defined results: null and empty texts pass toxicity and form one near-duplicate group, of which one row stays; of repeated
rows one stays; a null source is mixed as one of its own; extra columns pass through, and the columns that mixing adds take a longer
prefix where an input column has theirs; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.llm import decontaminate, mixing, simhash_dedup, suffix_dedup, toxicity
from therascape.llm.common import materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ("block", "release", "deadline", "slot", "position", "full_mix")
    prefix = "mix_"
    while {f"{prefix}{c}" for c in added} & {c.lower() for c in docs.columns}:
        prefix = f"mix_{prefix}"
    return mixing.mix(docs).select("row.*", *[F.col(c).alias(f"{prefix}{c}") for c in added])


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontamination", cut_benchmark), ("mixing", mix_sources)]
#: The trained model, the fingerprints and byte-wise cuts are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
