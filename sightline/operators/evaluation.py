"""Metrics over attempts, labels and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def approach_metrics(attempts: DataFrame) -> DataFrame:
    """One row for each approach: recall and precision of the expected observables, success, provenance, block rate, means, relation support.

    ``attempts`` has approach, expected_observable (null where none is), observed (array), observable_found, task_success, actions, runtime_ms,
    unsafe_controls, unsafe_blocked, provenance_complete, candidate_relation_supported (null where it does not apply). Rates are rounded to four places.
    """
    share = lambda top, bottom: F.round(top / F.greatest(F.lit(1), bottom), 4)
    every = F.count("*")
    hit = F.count_if(F.coalesce(F.array_contains("observed", F.col("expected_observable")), F.lit(False)))
    return attempts.groupBy("approach").agg(
        every.alias("scenario_attempts"), share(F.count_if(F.col("expected_observable").isNotNull() & F.col("observable_found")), F.count("expected_observable")).alias("observable_recall"), share(hit, F.sum(F.size("observed"))).alias("observable_precision"),
        share(F.count_if("task_success"), every).alias("task_success_rate"), share(F.count_if("provenance_complete"), every).alias("provenance_completeness"), share(F.sum("unsafe_blocked"), F.sum("unsafe_controls")).alias("unsafe_action_block_rate"),
        F.round(F.avg("actions"), 4).alias("mean_actions"), F.round(F.avg("runtime_ms"), 4).alias("mean_runtime_ms"), share(F.count_if("candidate_relation_supported"), F.count("candidate_relation_supported")).alias("candidate_relation_support_rate"),
    )


def nondeterminism(attempts: DataFrame, *signature: str) -> DataFrame:
    """scenario_id, attempts, n_signatures, stable: how many distinct outcomes repeated attempts have; nulls count as values."""
    parts = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in signature]
    out = attempts.groupBy("scenario_id").agg(F.count("*").alias("attempts"), F.count_distinct(F.struct(*parts)).alias("n_signatures"))
    return out.withColumn("stable", F.col("n_signatures") == 1)


def failure_breakdown(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("approach", F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("n"))


def policy_safety(attempts: DataFrame) -> DataFrame:
    """unsafe_controls, unsafe_blocked, rate over first attempts."""
    out = attempts.filter("attempt = 1").agg(F.sum("unsafe_controls").alias("unsafe_controls"), F.sum("unsafe_blocked").alias("unsafe_blocked"))
    return out.withColumn("rate", F.round(F.col("unsafe_blocked") / F.greatest("unsafe_controls", F.lit(1)), 4))


def invariant_report(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of expected (name, operator, value) with the observed value and whether it holds; a missing one fails."""
    passed = F.when(F.col("operator") == "equals", F.col("observed") == F.col("value")).otherwise(F.col("observed") <= F.col("value"))
    return expected.join(observed, "name", "left").withColumn("passed", F.coalesce(passed, F.lit(False)))


def label_checks(labels: DataFrame, actual: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """key, result, mismatches: whether each labelled property is what was found."""
    rows = labels.join(actual.select(key, *[F.col(p).alias(f"got_{p}") for p in properties]), key, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"got_{p}")), F.lit(p)) for p in properties]))
    return rows.select(key, F.when(F.size(wrong) == 0, "PASS").otherwise("FAIL").alias("result"), F.array_join(wrong, ",").alias("mismatches"))


def claim_groups(rows: DataFrame, most: int = 4) -> DataFrame:
    """page_id, category, n_values, label: distinct values of each claim category, the label made of the first ones."""
    out = rows.groupBy("page_id", "category").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return out.select("page_id", "category", F.size("v").alias("n_values"), F.array_join(F.slice("v", 1, most), ", ").alias("label"))


def run_summary(assertions: DataFrame, leads: DataFrame) -> DataFrame:
    """run_id, n_assertions, n_verified, n_rejected, n_pending, status: assertions (run_id, status) of each run by status; a lead (run_id, status)
    that waits for approval comes before a pending review."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    out = assertions.groupBy("run_id").agg(F.count("*").alias("n_assertions"), count("verified").alias("n_verified"), count("rejected").alias("n_rejected"), count("proposed", "pending").alias("n_pending"))
    waits = leads.filter("status = 'approval_required'").select("run_id").distinct().withColumn("waits", F.lit(True))
    status = F.when(F.col("waits"), "approval_required").when(F.col("n_pending") > 0, "review_required").otherwise("completed")
    return out.join(waits, "run_id", "left").withColumn("status", status).drop("waits")


def image_information(pixels: DataFrame, tile: int = 64, span: int = 12) -> DataFrame:
    """id, entropy_bits, entropy (an eighth of it), informative_tile_ratio of pixel rows (id, x, y, value): entropy of the value histogram, and the
    share of square tiles whose values span ``span`` or more."""
    total = pixels.groupBy("id").agg(F.count("*").alias("n"))
    shares = pixels.groupBy("id", "value").agg(F.count("*").alias("k")).join(total, "id").withColumn("p", F.col("k") / F.col("n"))
    entropy = shares.groupBy("id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("e"))
    tiles = pixels.groupBy("id", F.floor(F.col("x") / tile).alias("i"), F.floor(F.col("y") / tile).alias("j")).agg((F.max("value") - F.min("value")).alias("span"))
    ratio = tiles.groupBy("id").agg(F.round(F.avg((F.col("span") >= span).cast("int")), 6).alias("informative_tile_ratio"))
    return entropy.join(ratio, "id").select("id", F.round("e", 6).alias("entropy_bits"), F.round(F.col("e") / 8, 6).alias("entropy"), "informative_tile_ratio")
