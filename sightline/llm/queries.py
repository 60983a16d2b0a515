"""The queries of the corpus operators over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm import chat, decontaminate, language_id, mixing, near_dedup, oracles, periodic_runs, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, token_files, vector_codes
from sightline.llm.common import materialize
from sightline.sources import read_table

CHAT_EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots, placed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixing.taken_words(slots, placed)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(CHAT_EXTRA, "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(turns.unionByName(extra)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents"), spread=True).select("doc_id", "slot", "shard")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, then again after two edits: one cuts up to 12 characters somewhere inside and puts a phrase
    there, one adds the document's source at the end."""
    docs = read_table(spark, sf_dir, "documents")
    place = F.pmod(F.xxhash64("doc_id"), F.length("text") + 1)
    edit = lambda start, stop, insert: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), insert.alias("insert"))
    end = F.length("text") + 100
    edits = F.array(edit(place, place + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(13)), F.lit(" a revised phrase,")), edit(end, end, F.concat(F.lit("\n"), F.coalesce("source", F.lit("")))))
    return token_counts.count_tokens(docs.withColumn("edits", edits))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality_rules.statistics(read_table(spark, sf_dir, "documents")), "quality-stats")
    judged = quality_rules.judge(stats, quality_rules.learn(stats, read_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    files = token_files.write_ids(docs)
    places = token_files.lookup(token_files.keys_of(docs), token_files.build_index(spark, files))
    found = token_files.fetch(places, files)
    return found.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), prepare=periodic_runs.repeated_tail))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_mixing": op2_mixing, "op3_chat": op3_chat, "op4_sharding": op4_sharding, "op5_suffix_dedup": op5_suffix_dedup, "op6_language_id": op6_language_id, "op7_token_counts": op7_token_counts, "op8_quality_rules": op8_quality_rules, "op9_substring_dedup": op9_substring_dedup, "op10_near_dedup": op10_near_dedup, "op11_token_ids": op11_token_ids, "op12_vector_codes": op12_vector_codes, "op13_periodic_runs": op13_periodic_runs, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": oracles.MIX, "op3_chat": oracles.CHAT, "op5_suffix_dedup": oracles.SUFFIX_DEDUP, "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op10_near_dedup": oracles.NEAR_DEDUP, "op12_vector_codes": oracles.vector_codes(),
    }
