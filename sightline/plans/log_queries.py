"""Queries over event logs, checkpoints and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import leads, log_windows as lw
from sightline.plans import bindings as b
from sightline.plans.markup_queries import SEMANTIC, semantic
from sightline.plans.registry import register
from sightline.plans.url_queries import HOST

LOG = "log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id, event_type AS kind, ts AS occurred_at, value, props AS payload FROM events)"

_LAGS = ", ".join(f"{v} - lag({v}) OVER w AS {k}_delta" for k, v in b.MEASURES.items())
_IMG = "CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END"
DELTAS = f"cd AS (SELECT * FROM (SELECT user_id AS page_id, ts, event_id, {_LAGS}, {_IMG} <> lag({_IMG}) OVER w AS img, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nth > 1)"
_COLS = [f"{k}_delta" for k in b.MEASURES]
register("checkpoint_deltas", lambda s, d: lw.checkpoint_deltas(b.checkpoints(s, d)).select("page_id", "event_id", *_COLS, "material"), f"WITH {DELTAS} SELECT page_id, event_id, {', '.join(_COLS)}, abs(html_bytes_delta) >= 32 OR abs(n_chars_delta) >= 4 OR abs(n_elements_delta) >= 1 OR abs(height_delta) >= 8 OR img AS material FROM cd")
register("diagnostic_deltas", lambda s, d: lw.diagnostic_deltas(b.checkpoints(s, d)).select("page_id", "event_id", *_COLS, F.col("material").alias("changed")), f"WITH {DELTAS} SELECT page_id, event_id, {', '.join(_COLS)}, {' OR '.join(f'{c} <> 0' for c in _COLS)} OR img AS changed FROM cd")


def _render_status(s, d):
    rows = b.checkpoints(s, d)
    low = rows.groupBy("page_id").agg(F.bool_and(F.col("size") < 40).alias("all_low"))
    return lw.render_status(lw.checkpoint_deltas(rows).withColumnRenamed("material", "changed"), low)


register(
    "render_status",
    _render_status,
    f"""WITH {DELTAS}, x AS (SELECT page_id, ts, event_id, abs(html_bytes_delta) >= 32 OR abs(n_chars_delta) >= 4 OR abs(n_elements_delta) >= 1 OR abs(height_delta) >= 8 OR img AS moved FROM cd),
    m AS (SELECT page_id, arg_max(moved, (ts, event_id)) AS last, bool_or(moved) AS anyc FROM x GROUP BY page_id), l AS (SELECT user_id AS page_id, bool_and(value < 40) AS low FROM events GROUP BY user_id)
    SELECT l.page_id, CASE WHEN low THEN 'low_information' WHEN coalesce(last, false) THEN 'continued' WHEN coalesce(anyc, false) THEN 'changed' ELSE 'stable' END AS status FROM l LEFT JOIN m USING (page_id)""",
)
register(
    "canonical_checkpoint",
    lambda s, d: lw.canonical_checkpoint(b.checkpoints(s, d)),
    f"SELECT user_id AS page_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS size, arg_max({_IMG}, (ts, event_id)) <> arg_min({_IMG}, (ts, event_id)) AS first_differs, count(*) AS n_checkpoints FROM events GROUP BY user_id",
)


def _capped(s, d):
    """The observations of each host as those of a run; its pages are captured."""
    pages = b.pages(s, d).select("page_id", F.col("case_id").alias("run_id"), "url")
    rows = semantic(s, d).join(pages, "page_id").withColumn("ord", F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), "observation_id"))
    return lw.per_type_caps(rows.select("run_id", "ord", "observation_type", "value"), pages.select("run_id", "url"), leads.NON_CANDIDATES)


_CAP = "CASE observation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lw.CAPS.items()) + " ELSE 0 END"
register(
    "per_type_caps",
    lambda s, d: _capped(s, d).select("run_id", "observation_type", "value", "place"),
    f"""WITH {SEMANTIC}, o AS (SELECT {HOST} AS run_id, lpad(page_id::VARCHAR, 12, '0') || 'observation-' || printf('%04d', place) AS ord, observation_type, value FROM sem JOIN pages USING (page_id)),
    k AS (SELECT run_id, observation_type, value, min(ord) AS ord FROM o WHERE observation_type <> 'public_outgoing_link' OR NOT regexp_matches(value, '^https?://(www[.])?(t[.]me|wa[.]me|api[.]whatsapp[.]com)/') AND (run_id, lower(rtrim(value, '/'))) NOT IN (SELECT {HOST}, lower(rtrim(url, '/')) FROM pages) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, observation_type ORDER BY ord) AS place FROM k) SELECT run_id, observation_type, value, place FROM r WHERE place <= {_CAP}""",
)
KINDS = "CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'observation.created' WHEN 'error' THEN 'tool.blocked' WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'tool.requested' WHEN 1 THEN 'artifact.captured' ELSE 'entity.matched' END ELSE CASE event_id % 4 WHEN 0 THEN 'interactive_element.discovered' WHEN 1 THEN 'search.lead.discovered' WHEN 2 THEN 'agent.stopped' ELSE 'run.completed' END END"


def _kinds(s, d):
    """The event log with the kinds of an investigation and the flags of their payload."""
    log = b.event_log(s, d).withColumnRenamed("kind", "event_type")
    return log.select("run_id", "sequence", "event_id", F.expr(KINDS).alias("kind"), (F.col("value") > 30).alias("preflight"), F.when(F.col("event_id") % 5 != 0, F.col("value") > 60).alias("executed"), (F.col("value") > 70).alias("interaction"))


register(
    "timeline_rows",
    lambda s, d: lw.timeline_rows(_kinds(s, d)),
    f"""WITH {LOG}, t AS (SELECT run_id, sequence, k AS kind, value, event_id, CASE WHEN k = 'tool.blocked' AND value > 30 THEN 'blocked' WHEN k = 'observation.created' THEN 'observed' END AS grp FROM (SELECT *, {KINDS.replace("event_type", "kind")} AS k FROM log)
      WHERE k NOT IN ('interactive_element.discovered', 'entity.matched') AND NOT (k = 'tool.requested' AND (value > 30 OR event_id % 5 <> 0 AND value <= 60))),
    u AS (SELECT *, count(*) OVER (PARTITION BY run_id, grp) AS total, row_number() OVER (PARTITION BY run_id, grp ORDER BY sequence) AS nth FROM t),
    l AS (SELECT run_id, sequence, kind, CASE WHEN grp = 'blocked' THEN total || ' unsafe controls blocked' WHEN grp = 'observed' THEN 'Semantic evidence extracted' ELSE CASE kind WHEN 'run.started' THEN 'Investigation started' WHEN 'tool.requested' THEN 'Agent action selected' WHEN 'artifact.captured' THEN CASE WHEN value > 70 THEN 'Interaction evidence saved' ELSE 'Page evidence saved' END
      WHEN 'search.lead.discovered' THEN 'Candidate lead observed' WHEN 'run.completed' THEN 'Investigation completed' END END AS label, CASE grp WHEN 'blocked' THEN 'Policy preflight only · never executed' WHEN 'observed' THEN total || ' evidence-backed observations' END AS detail FROM u WHERE grp IS NULL OR nth = 1) SELECT * FROM l WHERE label IS NOT NULL""",
)
register(
    "job_progress",
    lambda s, d: lw.job_progress(b.event_log(s, d).withColumn("preview", F.col("value") > 70)),
    f"""WITH {LOG}, m AS (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY sequence) AS bf FROM log),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) AS place FROM m WHERE bf IS NULL OR bf <> kind), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) AS place FROM log WHERE value > 70)
    SELECT run_id, sequence, kind, place, CASE WHEN place = 1 THEN 'status' ELSE 'stage' END AS what FROM r WHERE place <= 48 UNION ALL SELECT run_id, sequence, kind, place, 'preview' FROM p WHERE place <= 8""",
)
register("recent_runs", lambda s, d: lw.recent_runs(b.event_log(s, d)), f"WITH {LOG} SELECT run_id, max(occurred_at) AS last_at, count(*) AS n_events FROM log GROUP BY run_id ORDER BY last_at DESC, run_id")


def _causes(s, d):
    """Every event was caused by the one before it, in every third run by the one half as far into it; some by events that are not there. In some runs the
    first one names one of the last, which makes circles."""
    log = b.event_log(s, d).select("run_id", "sequence", F.concat("run_id", F.lit("#"), "sequence").alias("event_id"))
    up = F.when(F.col("run_id") % 3 == 0, F.floor(F.col("sequence") / 2)).otherwise(F.col("sequence") - 1).cast("int")
    last = log.groupBy("run_id").agg(F.max("sequence").alias("last"))
    cause = F.when(F.col("sequence") % 59 == 0, "lost").when(up > 0, F.concat("run_id", F.lit("#"), up)).when(F.col("run_id") % 7 == 4, F.concat("run_id", F.lit("#"), F.least("last", F.lit(40))))
    return lw.event_causes(log.join(last, "run_id").withColumn("causation_event_id", cause))


register(
    "event_causes",
    _causes,
    f"""WITH RECURSIVE {LOG}, n AS (SELECT run_id, max(sequence) AS last FROM log GROUP BY run_id),
    c AS (SELECT run_id, last, sequence AS q, CASE WHEN sequence % 59 = 0 THEN NULL WHEN sequence > 1 THEN CASE WHEN run_id % 3 = 0 THEN sequence // 2 ELSE sequence - 1 END WHEN run_id % 7 = 4 THEN least(last, 40) END AS up FROM log JOIN n USING (run_id)),
    w AS (SELECT run_id, q, up AS cause, q AS root, 0 AS depth, last FROM c UNION ALL SELECT w.run_id, w.q, w.cause, c.up, depth + 1, w.last FROM w JOIN c ON w.run_id = c.run_id AND w.root = c.q WHERE c.up IS NOT NULL AND depth <= w.last)
    SELECT run_id, run_id || '#' || q AS event_id, CASE WHEN cause IS NOT NULL THEN run_id || '#' || cause END AS cause_event_id, CASE WHEN max(depth) <= any_value(last) THEN run_id || '#' || arg_max(root, depth) END AS root_event_id, CASE WHEN max(depth) <= any_value(last) THEN max(depth) END AS depth FROM w GROUP BY run_id, q, cause""",
)
register("event_sequence", lambda s, d: lw.sequence_gaps(b.event_log(s, d)), f"WITH {LOG} SELECT run_id, count(*) AS n_events, max(sequence) AS last_sequence, max(sequence) - count(*) AS gaps FROM log GROUP BY run_id")
register(
    "review_versions",
    lambda s, d: lw.review_versions(b.reviews(s, d)).select("assertion_id", "review_id", "version", "previous_version"),
    "SELECT o_custkey AS assertion_id, o_orderkey AS review_id, row_number() OVER w AS version, row_number() OVER w - 1 AS previous_version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
register(
    "current_status",
    lambda s, d: lw.current_status(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("assertion_id")), b.reviews(s, d)),
    """SELECT c_custkey AS assertion_id, coalesce(o, 'proposed') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
register(
    "duplicate_content",
    lambda s, d: lw.duplicate_content(b.texts(s, d)),
    "SELECT doc_id AS page_id, m AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE doc_id > m",
)
register(
    "budget_cutoff",
    lambda s, d: lw.budget_cutoff(b.event_log(s, d), 60, 2000.0),
    f"""WITH {LOG}, u AS (SELECT *, sum(value::DECIMAL(18,2)) OVER (PARTITION BY run_id ORDER BY sequence) AS used FROM log),
    o AS (SELECT run_id, sequence, CASE WHEN sequence > 60 THEN 'request_limit' WHEN used > 2000 THEN 'byte_limit' END AS reason FROM u)
    SELECT run_id, min(sequence) AS sequence, arg_min(reason, sequence) AS reason FROM o WHERE reason IS NOT NULL GROUP BY run_id""",
)
def _append(s, d):
    log = b.event_log(s, d)
    old = log.filter("sequence <= 40")
    # the rest arrives again together with a stretch of what is there, some of it changed
    again = log.filter("sequence > 30").withColumn("kind", F.when((F.col("sequence") <= 40) & (F.col("event_id") % 5 == 0), F.lit("changed")).otherwise(F.col("kind"))).drop("sequence")
    appended, conflicts = lw.append_events(old, again)
    return appended.select("run_id", "event_id", "sequence", F.lit(False).alias("conflict")).unionByName(conflicts.join(log.select("run_id", "event_id", "sequence"), "event_id").select("run_id", "event_id", "sequence", F.lit(True).alias("conflict")))


register(
    "append_events",
    _append,
    f"""WITH {LOG} SELECT run_id, event_id, sequence, false AS conflict FROM log WHERE sequence > 40
    UNION ALL SELECT run_id, event_id, sequence, true FROM log WHERE sequence BETWEEN 31 AND 40 AND event_id % 5 = 0""",
)
