"""A corpus pipeline: five stages, each on all that the stage before it kept.

``run`` writes each stage's rows as Parquet in shared storage and reads them again, so a
lost executor repeats a stage's tasks at most.  The first and third stage cannot be
expressed in SQL (a trained classifier, hashed signatures), hence no ``ORACLE_SQL``; the
tests compare each operator with brute force, and ``run`` with its stages one by one.

Defined results: a null text counts as empty, and empty texts are copies of each other; a
null ``doc_id``, ``lang`` or ``source`` is a value like any other (a null source has no
target of its own); of equal rows one stays, ties going to the smaller ``doc_id``; texts
of any length are read whole; extra columns, whatever their names, pass through the
stages up to mixing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakguard.llm import dart_minhash, exact_dedup, mixing, packing, toxicity
from leakguard.llm.shared import materialize, table
from leakguard.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights; each copy is a row of its own."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the stages before left their own memory in use, so fewer pieces are remembered
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, memory=32 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to ``documents``: packed pieces of the kept documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
