"""A training-corpus pipeline over ``documents``: five stages of the corpus operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, language_id, mixing, near_dedup, sharding
from sightline.llm.common import materialize
from sightline.sources import read_table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; profiles come from the labelled documents of the input that are not held out.

    Rows with a null or empty text, or one without letters, go; rows with a null doc_id or lang are judged by their text but teach nothing; repeated
    rows all stay; ties go to the first language; long texts are read whole; an empty table, or one without labels, keeps nothing.
    """
    return language_id.accept(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more.

    The document with the least doc_id stays (null ids come last; of equal ids the least hash of the text), and one of its repeated rows. Texts, not ids, are
    compared; rows without words all stay; long texts are compared whole; an empty table stays empty.
    """
    return near_dedup.one_of_each(docs, by_row=True, size=5, percent=80)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Every row is judged by its own whole text, whatever its doc_id is; null and empty texts stay; repeated rows share their fate; without documents or without
    benchmark items nothing goes.
    """
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), by_row=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source, ranked last; null doc_ids are documents like others; repeated rows share their count; rows without words are in no mix; a long
    document counts by its words; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with slot and shard, placed by doc_id and text, so that one id with many texts is spread and repeats stay together.

    Null ids and texts are values like others; columns named slot and shard are replaced; an empty table stays empty.
    """
    return sharding.place(docs, spread=True)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language profiles, chosen paths and slot hashes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back. Odd rows are treated as each stage says."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
