"""Window operators over checkpoints, reviews and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import labels, policy, urls
from sightline.sources.tables import written

# From which change on a checkpoint counts as changed, by what is measured.
MATERIAL = {"html_bytes": 32, "n_chars": 4, "n_elements": 1, "height": 8}


def _deltas(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_delta for each column and image_changed, against the checkpoint before on the page; the first one of a page is left out."""
    order = W.partitionBy("page_id").orderBy("elapsed", "event_id")
    new = {f"{c}_delta": F.col(c) - F.lag(c).over(order) for c in columns} | {"image_changed": F.col("image_hash") != F.lag("image_hash").over(order), "nth": F.row_number().over(order)}
    return rows.withColumns(new).filter("nth > 1").drop("nth")


def checkpoint_deltas(rows: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Difference of each checkpoint (page_id, elapsed, event_id, image_hash and the columns of ``thresholds``, MATERIAL by default) to the one before on
    its page; material where one reaches its threshold or the image changed."""
    thresholds = thresholds or MATERIAL
    rows, any_ = _deltas(rows, list(thresholds)), F.col("image_changed")
    for c, n in thresholds.items():
        any_ = any_ | (F.abs(F.col(f"{c}_delta")) >= n)
    return rows.withColumn("material", any_)


def diagnostic_deltas(rows: DataFrame, columns: tuple[str, ...] = tuple(MATERIAL)) -> DataFrame:
    """As ``checkpoint_deltas``, but any difference counts."""
    return checkpoint_deltas(rows, dict.fromkeys(columns, 1))


def render_status(deltas: DataFrame, low: DataFrame) -> DataFrame:
    """One status for each page: low_information if all rows are low, continued if the last delta changed, changed if any did, else stable."""
    moves = deltas.groupBy("page_id").agg(F.max_by("changed", F.struct("elapsed", "event_id")).alias("last"), F.bool_or("changed").alias("any"))
    rows = low.join(moves, "page_id", "left")
    status = F.when(F.col("all_low"), "low_information").when(F.coalesce("last", F.lit(False)), "continued").when(F.coalesce("any", F.lit(False)), "changed").otherwise("stable")
    return rows.select("page_id", status.alias("status"))


def canonical_checkpoint(rows: DataFrame) -> DataFrame:
    """The last checkpoint of each page, and whether its image differs from the first."""
    key = F.struct("elapsed", "event_id")
    out = rows.groupBy("page_id").agg(F.max_by(F.struct("event_id", "size", "image_hash"), key).alias("last"), F.min_by("image_hash", key).alias("first_hash"), F.count("*").alias("n_checkpoints"))
    return out.select("page_id", F.col("last.event_id").alias("event_id"), F.col("last.size").alias("size"), (F.col("last.image_hash") != F.col("first_hash")).alias("first_differs"), "n_checkpoints")


def sequence_gaps(log: DataFrame) -> DataFrame:
    """run_id, n_events, last_sequence, gaps: whether a run's sequence runs from 1 without holes."""
    out = log.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max("sequence").alias("last_sequence"))
    return out.withColumn("gaps", F.col("last_sequence") - F.col("n_events"))


def review_versions(reviews: DataFrame) -> DataFrame:
    """Version 1..n of each assertion's reviews, and the version before."""
    order = W.partitionBy("assertion_id").orderBy("decided_at", "review_id")
    out = reviews.withColumn("version", F.row_number().over(order))
    return out.withColumn("previous_version", F.col("version") - 1)


def current_status(assertions: DataFrame, reviews: DataFrame, initial: str = "proposed") -> DataFrame:
    """Latest review outcome of each assertion, else its initial status."""
    last = reviews.groupBy("assertion_id").agg(F.max_by("outcome", F.struct("decided_at", "review_id")).alias("outcome"))
    return assertions.join(last, "assertion_id", "left").select("assertion_id", F.coalesce("outcome", F.lit(initial)).alias("status"))


def duplicate_content(rows: DataFrame) -> DataFrame:
    """page_id, duplicate_of: later pages with the content hash of an earlier one."""
    first = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("page_id").alias("duplicate_of"), F.count("*").alias("n")).filter("n > 1")
    hashed = rows.select("page_id", F.sha2("text", 256).alias("sha"))
    return hashed.join(first, "sha").filter(F.col("page_id") > F.col("duplicate_of")).select("page_id", "duplicate_of")


# How many observations of each type a run takes up.
CAPS = {
    "claimed_brand_identity": 3, "public_outgoing_link": 18, "public_redirect_target": 6, "public_telegram_alias": 10, "public_telegram_contact": 10, "public_whatsapp_link": 10, "public_phone_number": 10, "public_email_address": 10,
    "public_payment_provider": 12, "public_payment_method": 6, "public_offer_claim": 6, "public_referral_code": 10, "public_tracking_identifier": 10, "public_download_destination": 10, "public_legal_or_license_claim": 6,
}


def per_type_caps(observations: DataFrame, captured: DataFrame, non_candidates: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """``observations`` (run_id, ord, observation_type, value) with place: the first of each value, up to the cap of their type. Links and redirects to captured
    URLs (``captured``: run_id, url) and to hosts that are no candidates are left out, as are types without a cap."""
    leads_on = F.col("observation_type").isin("public_outgoing_link", "public_redirect_target")
    known = captured.select("run_id", urls.folded(F.col("url")).alias("folded")).distinct()
    rows = observations.withColumn("folded", F.when(leads_on, urls.folded(F.col("value")))).join(known, ["run_id", "folded"], "left_anti")
    rows = rows.filter(~(leads_on & policy.host_in(urls.bare_host(F.col("value")), non_candidates))).drop("folded")
    first = F.row_number().over(W.partitionBy("run_id", "observation_type", "value").orderBy("ord"))
    rows = rows.withColumn("again", first).filter("again = 1").drop("again")
    cap = None
    for kind, n in (caps or CAPS).items():
        cap = F.when(F.col("observation_type") == kind, n) if cap is None else cap.when(F.col("observation_type") == kind, n)
    place = F.row_number().over(W.partitionBy("run_id", "observation_type").orderBy("ord"))
    return rows.withColumn("place", place).filter(F.col("place") <= cap.otherwise(0))


def budget_cutoff(log: DataFrame, max_requests: int, max_bytes: float) -> DataFrame:
    """The first request of each run beyond a budget, with the reason; request count is tested first."""
    order = W.partitionBy("run_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    over = F.when(F.col("sequence") > max_requests, "request_limit").when(F.col("used") > max_bytes, "byte_limit")
    rows = log.withColumn("used", F.sum(F.col("value").cast("decimal(18,2)")).over(order)).withColumn("reason", over).filter("reason is not null")
    return rows.groupBy("run_id").agg(F.min(F.struct("sequence", "reason")).alias("f")).select("run_id", "f.sequence", "f.reason")


def timeline_rows(log: DataFrame) -> DataFrame:
    """run_id, sequence, kind, label, detail: the replay timeline of a log (run_id, sequence, kind, preflight, executed, interaction). Discoveries, matches
    and requests that were never executed are left out; all observations make one row, all controls blocked before use another, at the first of them."""
    preflight = (F.col("kind") == "tool.blocked") & F.coalesce("preflight", F.lit(False))
    dropped = F.col("kind").isin("interactive_element.discovered", "entity.matched") | ((F.col("kind") == "tool.requested") & (F.coalesce("preflight", F.lit(False)) | ~F.coalesce("executed", F.lit(True))))
    kept = log.withColumn("group", F.when(preflight, "blocked").when(F.col("kind") == "observation.created", "observed")).filter(~dropped)
    of_group = W.partitionBy("run_id", "group")
    kept = kept.withColumns({"total": F.count("*").over(of_group).cast("string"), "nth": F.row_number().over(of_group.orderBy("sequence"))}).filter(F.col("group").isNull() | (F.col("nth") == 1))
    label = F.when(F.col("group") == "blocked", F.concat("total", F.lit(" unsafe controls blocked"))).when(F.col("group") == "observed", "Semantic evidence extracted").otherwise(labels.event_label(F.col("kind"), F.col("interaction")))
    detail = F.when(F.col("group") == "blocked", "Policy preflight only · never executed").when(F.col("group") == "observed", F.concat("total", F.lit(" evidence-backed observations")))
    return kept.select("run_id", "sequence", "kind", label.alias("label"), detail.alias("detail")).filter("label is not null")


def job_progress(log: DataFrame, stages: int = 48, previews: int = 8) -> DataFrame:
    """run_id, sequence, kind, place, what: the last stage changes of each run (rows whose kind differs from the one before), latest first, the first of them
    being its status; and its last previews (rows with ``preview``), latest first."""
    order = W.partitionBy("run_id").orderBy("sequence")
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("sequence")))
    moved = log.withColumn("before", F.lag("kind").over(order)).filter(F.col("before").isNull() | (F.col("before") != F.col("kind")))
    changes = moved.withColumn("place", place).filter(F.col("place") <= stages).withColumn("what", F.when(F.col("place") == 1, "status").otherwise("stage"))
    shown = log.filter("preview").withColumn("place", place).filter(F.col("place") <= previews).withColumn("what", F.lit("preview"))
    columns = ["run_id", "sequence", "kind", "place", "what"]
    return changes.select(columns).unionByName(shown.select(columns))


def recent_runs(log: DataFrame) -> DataFrame:
    """run_id, last_at, n_events of each run, newest first: a sort that Spark deals by range, without a rank over all rows."""
    runs = log.groupBy("run_id").agg(F.max("occurred_at").alias("last_at"), F.count("*").alias("n_events"))
    return runs.orderBy(F.desc("last_at"), "run_id")


def append_events(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(appended, conflicts): new events get the next sequence of their run; an event_id already there with the same content
    changes nothing, with other content it is a conflict. Repeats within ``new`` count once, the least content first."""
    content = F.struct("kind", "occurred_at", "value", "payload")
    known = log.select("event_id", content.alias("old"))
    first = new.withColumn("nth", F.row_number().over(W.partitionBy("event_id").orderBy("occurred_at", "kind", "payload"))).filter("nth = 1").drop("nth")
    conflicts = new.select("event_id", content.alias("new")).join(known, "event_id").filter(~F.col("new").eqNullSafe(F.col("old"))).select("event_id").distinct()
    last = log.groupBy("run_id").agg(F.max("sequence").alias("last"))
    fresh = first.join(known.select("event_id"), "event_id", "left_anti").join(last, "run_id", "left")
    place = F.row_number().over(W.partitionBy("run_id").orderBy("occurred_at", "event_id"))
    return fresh.withColumn("sequence", F.coalesce("last", F.lit(0)) + place).drop("last"), conflicts


def event_causes(log: DataFrame) -> DataFrame:
    """run_id, event_id, cause_event_id, root_event_id, depth: the recorded cause of each event (column causation_event_id), the event at the root of its chain and
    how far away that is. A cause that is not in the run's log is none. An event whose chain runs into a circle has neither root nor depth.

    Every round lets each event jump to where its ancestor points, so chains of n events take log2(n) rounds; the rounds end when all events have their root, or
    when a round brings none home, which leaves events of circles only. Each round's rows are written under ``spark.checkpoint.dir``.
    """
    known = log.select("run_id", F.col("event_id").alias("up_id")).distinct()
    here = log.select("run_id", "event_id", F.col("causation_event_id").alias("up_id")).distinct()
    rows = here.join(known.withColumn("there", F.lit(True)), ["run_id", "up_id"], "left")
    cause = F.when(F.col("there"), F.col("up_id"))
    rows = rows.select("run_id", "event_id", cause.alias("cause_event_id"), F.coalesce(cause, "event_id").alias("root"), cause.isNotNull().cast("long").alias("depth"), cause.isNull().alias("home"))
    rows, away, before = written(rows, "causes"), -1, -2
    while away != before and away != 0:
        step = rows.select("run_id", F.col("event_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("home").alias("next_home"))
        moved = rows.filter("not home").join(step, ["run_id", "root"]).select("run_id", "event_id", "cause_event_id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("next_home").alias("home"))
        rows = written(rows.filter("home").unionByName(moved), "causes")
        before, away = away, rows.filter("not home").count()
    return rows.select("run_id", "event_id", "cause_event_id", F.when(F.col("home"), F.col("root")).alias("root_event_id"), F.when(F.col("home"), F.col("depth")).alias("depth"))


def status_case(column: Column, table: dict[str, str], other: str) -> Column:
    """A constant map as a conditional expression."""
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)
