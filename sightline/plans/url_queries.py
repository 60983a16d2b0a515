"""Queries of URL, host and text expressions over pages, their anchors, and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import policy, urls
from sightline.operators.log_windows import status_case
from sightline.plans import bindings as b
from sightline.plans.registry import register
from sightline.plans.web import ANCHORS, ROOT

HOST = "regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
KEPT = f"list_sort(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT regexp_matches(lower(p), '^(fbclid|gclid)(=|$)')))"
CRAWL = f"lower({ROOT}) || CASE WHEN rtrim({PATH}, '/') = '' THEN '/' ELSE rtrim({PATH}, '/') END || CASE WHEN len({KEPT}) = 0 THEN '' ELSE '?' || array_to_string({KEPT}, '&') END"
LISTED = ["spam-farm.example.org", "example.net", "cheap-pills.example.com"]

register("resolve_url", lambda s, d: b.anchors(s, d).select("page_id", "elem_ord", urls.resolve(F.col("url"), F.col("href")).alias("resolved")), f"WITH {ANCHORS} SELECT page_id, elem_ord, resolved FROM anchors")
register(
    "normalize_http_url",
    lambda s, d: b.pages(s, d).select("page_id", urls.http_url(F.col("url"), F.col("url")).alias("normalized")),
    f"SELECT page_id, lower({ROOT}) || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END AS normalized FROM pages",
)
register("canonical_crawl_url", lambda s, d: b.pages(s, d).select("page_id", urls.crawl_url(F.col("url"), F.col("url")).alias("crawl_url")), f"SELECT page_id, {CRAWL} AS crawl_url FROM pages")
register(
    "canonical_asset_url",
    lambda s, d: b.pages(s, d).select("page_id", urls.asset_url(urls.http_url(F.col("url"), F.col("url"))).alias("asset_url")),
    f"SELECT page_id, lower({ROOT}) || {PATH} || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({QUERY}, '&')), '&') END AS asset_url FROM pages",
)
register(
    "hosts",
    lambda s, d: b.pages(s, d).select("page_id", F.lower(urls.raw_host(F.col("url"))).alias("raw_host"), urls.host(F.col("url")).alias("host"), urls.bare_host(F.col("url")).alias("bare_host")),
    f"SELECT page_id, {HOST} AS raw_host, rtrim({HOST}, '.') AS host, regexp_replace({HOST}, '^www\\.', '') AS bare_host FROM pages",
)
register(
    "host_suffix_filter",
    lambda s, d: b.pages(s, d).filter(policy.host_in(F.col("case_id"), LISTED)).select("page_id", "case_id"),
    f"SELECT page_id, {HOST} AS case_id FROM pages WHERE " + " OR ".join(f"{HOST} = '{x}' OR ends_with({HOST}, '.{x}')" for x in LISTED),
)
register(
    "generic_referral",
    lambda s, d: b.pages(s, d).select("page_id", F.explode(F.split(urls.query(F.col("url")), "&")).alias("pair")).select("page_id", "pair", policy.is_generic_referral(F.col("pair")).alias("generic")),
    f"""SELECT page_id, pair, NOT contains(pair, '=') OR length(v) < 4 OR v IN ('', '0', '1', 'code', 'default', 'none', 'null', 'ref', 'test', 'unknown') AS generic
    FROM (SELECT page_id, pair, lower(trim(regexp_extract(pair, '^[^=]*=(.*)$', 1))) AS v FROM (SELECT page_id, unnest(string_split({QUERY}, '&')) AS pair FROM pages))""",
)
register(
    "normalize_text",
    lambda s, d: b.texts(s, d).select("page_id", F.sha2(policy.normalize_text(F.col("text")), 256).alias("sha"), F.length(policy.digits(F.col("text"))).alias("n_digits"), policy.bounded(F.col("text"), 120).alias("head")),
    r"""SELECT doc_id AS page_id, sha256(replace(lower(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'))), 'ß', 'ss')) AS sha, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
    left(trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g')), 120) AS head FROM documents""",
)


def _priorities(s, d):
    p = policy.frontier_priority(F.col("label"), F.col("target"))
    return b.anchors(s, d).withColumn("target", urls.crawl_url(F.col("href"), F.col("url"))).select("page_id", "elem_ord", p["score"].alias("score"), p["reason"].alias("reason"))


_MATERIAL = "lower(label || ' ' || replace(regexp_extract(coalesce(crawl_url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', ' '))"
register(
    "frontier_priority",
    _priorities,
    f"WITH {ANCHORS} SELECT page_id, elem_ord, CASE "
    + " ".join(f"WHEN regexp_matches({_MATERIAL}, '{p}') THEN {k}" for p, k, _ in policy.FRONTIER_CLASSES)
    + " ELSE 4 END AS score, CASE "
    + " ".join(f"WHEN regexp_matches({_MATERIAL}, '{p}') THEN '{r}'" for p, _, r in policy.FRONTIER_CLASSES)
    + " ELSE 'generic' END AS reason FROM anchors",
)
register(
    "content_ids",
    lambda s, d: b.anchors(s, d).select("page_id", "elem_ord", policy.content_id("edge", 20, F.col("case_id"), F.col("href"), F.col("label")).alias("edge_id"), policy.content_id("observation", 16, F.col("href")).alias("observation_id")),
    f"WITH {ANCHORS} SELECT page_id, elem_ord, 'edge-' || left(sha256({HOST} || chr(31) || href || chr(31) || label), 20) AS edge_id, 'observation-' || left(sha256(href), 16) AS observation_id FROM anchors",
)
