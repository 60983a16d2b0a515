"""Queries of messaging links, assets, boxes and display rows; inputs that pages lack are derived from pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import details, markup, similarity as sim
from sightline.plans import bindings as b
from sightline.plans.case_queries import HOSTPAIRS, SIG, _host_pairs, _signals
from sightline.plans.markup_queries import OUTCOMES, SEMANTIC, outcomes as _outcomes
from sightline.plans.lead_queries import OUT, PG, _hops
from sightline.plans.registry import register
from sightline.plans.url_queries import ANCHORS


def _boxes(s, d):
    """Every second link as a snapshot; every third of these has lost its link and is known by its text."""
    anchors = b.anchors(s, d)
    k = F.col("elem_ord")
    snaps = anchors.filter("elem_ord % 2 = 0").select("page_id", F.when(k % 6 == 0, "").otherwise(F.col("href")).alias("href"), F.col("label").alias("text"), k.alias("snap"), (k * 150).alias("x"), (k * 20).alias("y"), (F.length("label") * 8).alias("w"), F.lit(16).alias("h"))
    return details.attach_boxes(anchors.select("page_id", k.alias("ord"), "href", "label"), snaps, 4, 900, 600)


_AP = "regexp_extract({0}, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
register(
    "attach_snapshot_boxes",
    _boxes,
    f"""WITH {ANCHORS}, sn AS (SELECT page_id, elem_ord AS k, CASE WHEN elem_ord % 6 = 0 THEN '' ELSE href END AS href, label, length(label) * 8 AS w FROM anchors WHERE elem_ord % 2 = 0),
    m AS (SELECT a.page_id, a.elem_ord AS ord, min(sn.k) AS k FROM anchors a JOIN sn ON a.page_id = sn.page_id AND (sn.href <> '' AND {_AP.format("a.href")} = {_AP.format("sn.href")} OR sn.label <> '' AND sn.label = a.label) GROUP BY ALL),
    bx AS (SELECT m.page_id, ord, m.k AS snap, greatest(m.k * 150 - 4, 0) AS x, greatest(m.k * 20 - 4, 0) AS y, least(m.k * 150 + sn.w + 4, 900) - greatest(m.k * 150 - 4, 0) AS w, least(m.k * 20 + 20, 600) - greatest(m.k * 20 - 4, 0) AS h FROM m JOIN sn ON sn.page_id = m.page_id AND sn.k = m.k)
    SELECT * FROM bx WHERE w > 0 AND h > 0""",
)
def _evidence(s, d):
    """The pages with their redirects, and every third link as a snapshot of its own; half of these have lost their link and are known by their text."""
    k = F.col("elem_ord")
    snaps = b.anchors(s, d).filter("elem_ord % 3 = 0").select("page_id", F.when(k % 6 == 0, "").otherwise(F.col("href")).alias("href"), F.col("label").alias("text"), k.alias("snap"), F.format_string("a:%d", k).alias("selector"), (k * 150).alias("x"), (k * 20).alias("y"), F.lit(90).alias("width"), F.lit(16).alias("height"))
    return markup.semantic_evidence(b.nodes(s, d), _hops(s, d), snaps)


_HOW = """CASE stage WHEN 0 THEN CASE sub WHEN 0 THEN 'meta_og_site_name' WHEN 1 THEN 'dom_h1' ELSE 'document_title' END WHEN 1 THEN CASE WHEN t = 'public_outgoing_link' THEN 'dom_anchor' WHEN t = 'public_download_destination' THEN 'dom_download_inspection' WHEN t = 'public_whatsapp_link' THEN 'dom_anchor_whatsapp' WHEN t LIKE 'public_telegram%' THEN 'dom_anchor_telegram' WHEN t = 'public_referral_code' THEN 'url_query:ref' ELSE 'url_tracking_parameter' END
  WHEN 2 THEN 'visible_text_channel_label' WHEN 3 THEN 'visible_text_channel_label' WHEN 4 THEN 'visible_text_regex' WHEN 5 THEN 'visible_text_regex' WHEN 6 THEN 'visible_text_regex' WHEN 11 THEN 'network_redirect' ELSE 'visible_text_dictionary' END"""
_SURE = "CASE WHEN stage = 0 THEN CASE sub WHEN 0 THEN 0.95 ELSE 0.85 END WHEN stage IN (2, 3, 6) THEN 0.9 WHEN stage BETWEEN 7 AND 10 THEN 0.75 ELSE 1.0 END::DOUBLE"
_STRONG = "CASE WHEN stage BETWEEN 7 AND 10 THEN 'weak' WHEN stage IN (0, 5, 6) OR t = 'public_tracking_identifier' THEN 'moderate' ELSE 'strong' END"
register(
    "semantic_observations",
    lambda s, d: _evidence(s, d).select("page_id", "observation_id", "observation_type", "value", "selector", "box.x", "confidence", "method", "strength"),
    f"""WITH {SEMANTIC.split(", se1 AS")[0]}, {PG}, ss AS (SELECT page_id, elem_ord AS k, CASE WHEN elem_ord % 6 = 0 THEN '' ELSE href END AS href, label FROM anchors WHERE elem_ord % 3 = 0),
    sm AS (SELECT a.page_id, a.elem_ord AS ord, min(ss.k) AS k FROM anchors a JOIN ss ON a.page_id = ss.page_id AND (ss.href <> '' AND a.href <> '' AND {_AP.format("a.href")} = {_AP.format("ss.href")} OR ss.label <> '' AND ss.label = left(a.label, 200)) GROUP BY ALL),
    ox AS (SELECT page_id, observation_type AS t, value, stage, ord, sub FROM se0 UNION ALL SELECT page_id, 'public_redirect_target', regexp_replace(target, '#.*$', ''), 11, 0, 0 FROM {OUT(2)}),
    oy AS (SELECT ox.*, sm.k, row_number() OVER (PARTITION BY ox.page_id, t, value, coalesce(sm.k, -1) ORDER BY stage, ox.ord, sub) AS nth FROM ox LEFT JOIN sm ON sm.page_id = ox.page_id AND sm.ord = ox.ord AND stage = 1 WHERE value <> ''),
    oz AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY stage, ord, sub) AS place FROM oy WHERE nth = 1)
    SELECT page_id, 'observation-' || printf('%04d', place) AS observation_id, t AS observation_type, value, 'a:' || k AS selector, k * 150 AS x, {_SURE} AS confidence, {_HOW} AS method, {_STRONG} AS strength FROM oz WHERE place <= 500""",
)
register(
    "nonexpanded_links",
    lambda s, d: details.nonexpanded_links(b.anchors(s, d).select("page_id", "elem_ord"), _outcomes(s, d).withColumn("depth", F.col("page_id") % 2)),
    f"WITH {OUTCOMES}, {ANCHORS} SELECT page_id, elem_ord, CASE WHEN outcome <> 'content' THEN 'parent_not_usable' ELSE 'depth_limit' END AS reason FROM anchors JOIN oc USING (page_id) WHERE outcome <> 'content' OR page_id % 2 = 1",
)


register(
    "asset_similarity",
    lambda s, d: sim.set_similarity(_host_pairs(s, d).select(F.col("left_case").alias("left"), F.col("right_case").alias("right")), _signals(s, d).filter("type = 'external_asset_url'").select(F.col("case_id").alias("id"), F.col("value").alias("item"))).select("left", "right", "shared", "united"),
    f"""WITH {SIG}, {HOSTPAIRS}, v AS (SELECT case_id, list(DISTINCT value) AS x FROM sig WHERE type = 'external_asset_url' GROUP BY case_id) SELECT left_case AS "left", right_case AS "right", len(list_intersect(coalesce(a.x, []), coalesce(b.x, []))) AS shared,
    len(coalesce(a.x, [])) + len(coalesce(b.x, [])) - len(list_intersect(coalesce(a.x, []), coalesce(b.x, []))) AS united FROM hp LEFT JOIN v a ON a.case_id = left_case LEFT JOIN v b ON b.case_id = right_case""",
)
