"""A corpus in five stages: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes null, empty and very long texts, repeated rows, ties, extra columns and empty tables as its operator's docstring
says; all but the last return the columns they got. Documents without words go in the first stage, as they have no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import decontamination, language_id, mixing, sharding, simhash
from wayfarer.llm.common import delete, materialize, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; the table's labelled rows are what is known. Repeated rows go or stay together."""
    return language_id.drop_unknown(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id, of rows alike in id and text any one."""
    return simhash.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, counts at most one apart; repeated rows get a slot each."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language models, fingerprints and Feistel rounds can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's table is written, those it was made from are deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with written() as paths:
            docs = materialize(stage(spark, docs, sf_dir), name)
        delete(spark, before + paths[:-1])
        before = paths[-1:]
    return docs
