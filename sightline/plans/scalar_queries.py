"""Queries of URL, redaction, status and label expressions over URLs, entities and observations that exercise every rule.

URL variants are derived from each page: the rule that a variant must meet is stated in the oracle beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.functions import labels, policy, urls
from sightline.operators import suffixes
from sightline.plans import bindings as b
from sightline.plans.lead_queries import LAST, _adequacy
from sightline.plans.markup_queries import ENTITIES, SEMANTIC, entities, outcomes, semantic
from sightline.plans.registry import register
from sightline.plans.url_queries import ANCHORS, HOST, PATH, QUERY, ROOT
from sightline.sources import suffix_rules
from sightline.sources.tables import shared_folder

#: (URL in SQL that Spark and DuckDB read, what the policy says, registrable domain, suffix type, reason of the suffix rules)
VARIANTS = [
    ("concat('https://a.b', CAST(page_id AS STRING), '.co.uk/p')", None, "'b' || page_id || '.co.uk'", "icann", None),
    ("concat('http://user-', CAST(page_id AS STRING), '.github.io/')", None, "'user-' || page_id || '.github.io'", "private", None),
    ("'https://co.uk/'", None, "NULL", None, "not_registrable_domain"),
    ("concat('https://x', CAST(page_id AS STRING), '.foo.ck/')", None, "'x' || page_id || '.foo.ck'", "icann", None),
    ("'https://www.ck/'", None, "'www.ck'", "icann", None),
    ("concat('http://10.0.', CAST(page_id % 250 AS STRING), '.1/')", "non_global_address", "NULL", None, "ip_literal_candidate"),
    ("concat('http://8.8.8.', CAST(page_id % 250 AS STRING), '/')", None, "NULL", None, "ip_literal_candidate"),
    ("concat('http://[fe80::', CAST(page_id % 90 + 10 AS STRING), ']/')", "non_global_address", "NULL", None, "ip_literal_candidate"),
    ("'http://169.254.169.254/latest'", "metadata_host", "NULL", None, "ip_literal_candidate"),
    ("concat('http://h', CAST(page_id AS STRING), '.localhost/')", "local_hostname", "NULL", None, "not_registrable_domain"),
    ("concat('ftp://files', CAST(page_id AS STRING), '.example.com/')", "unsupported_scheme", "NULL", None, "unsupported_url_scheme"),
    ("concat('https://me:pw@h', CAST(page_id AS STRING), '.example.com/')", "userinfo_not_allowed", "NULL", None, "userinfo_not_allowed"),
    ("concat('https://h', CAST(page_id AS STRING), '.example.com:8443/')", "non_default_port", "'example.com'", "icann", None),
    ("concat('https://H', CAST(page_id AS STRING), '.Example.COM:443/')", None, "'example.com'", "icann", None),
    ("'https:///p'", "missing_hostname", "NULL", None, "missing_hostname"),
]
PICKED = "CASE page_id % " + str(len(VARIANTS)) + " " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in enumerate(VARIANTS)) + " END"
_show = lambda v: "NULL" if v is None else f"'{v}'"
_pick = lambda i, raw=False: "CASE page_id % " + str(len(VARIANTS)) + " " + " ".join(f"WHEN {k} THEN {v[i] if raw else _show(v[i])}" for k, v in enumerate(VARIANTS)) + " END"


def _variants(s, d):
    return b.pages(s, d).select("page_id", F.expr(PICKED).alias("url"))


RULE_FILE = """// A rule list in the public format; lines before the first section are no rules.
net.invalid
// ===BEGIN ICANN DOMAINS===
// com : https://example.invalid
com
net
org  // what follows a blank is no part of a rule

CO.UK
*.ck
!www.ck
// ===END ICANN DOMAINS===
example.com
// ===BEGIN PRIVATE DOMAINS===
github.io
example.org
// ===END PRIVATE DOMAINS===
"""


def _rule_file(s):
    """The rule list as a file in the shared folder."""
    folder = f"{shared_folder(s)}/rules-{uuid.uuid4().hex}"
    s.createDataFrame([(RULE_FILE,)], "value string").write.text(folder)
    return folder


register("url_policy", lambda s, d: _variants(s, d).select("page_id", F.coalesce(policy.url_policy(F.col("url")), F.lit("allowed")).alias("decision")), f"SELECT page_id, coalesce({_pick(1)}, 'allowed') AS decision FROM pages")
register(
    "registrable_domain",
    lambda s, d: suffixes.registrable_domains(_variants(s, d).unionByName(b.pages(s, d).select((-F.col("page_id") - 1).alias("page_id"), "url")), suffix_rules.read_rules(s, _rule_file(s))).select("page_id", "registrable_domain", "suffix_type", "reason"),
    f"""SELECT page_id, {_pick(2, True)} AS registrable_domain, {_pick(3)} AS suffix_type, {_pick(4)} AS reason FROM pages
    UNION ALL SELECT -page_id - 1, CASE WHEN ends_with({HOST}, '.example.org') THEN array_to_string(string_split({HOST}, '.')[-3:], '.') ELSE array_to_string(string_split({HOST}, '.')[-2:], '.') END, CASE WHEN ends_with({HOST}, '.example.org') THEN 'private' ELSE 'icann' END, NULL FROM pages""",
)
register(
    "comparable_url",
    lambda s, d: b.pages(s, d).select("page_id", urls.comparable(F.col("url")).alias("same_page"), urls.folded(F.col("url")).alias("folded"), urls.evaluated(F.col("url")).alias("evaluated")),
    f"""SELECT page_id, regexp_extract(url, '^([a-z]+)', 1) || '|' || {HOST} || '|' || rtrim({PATH}, '/') || '|' || {QUERY} AS same_page, lower(rtrim(url, '/')) AS folded,
    lower({ROOT}) || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END AS evaluated FROM pages""",
)
_QUOTED = "replace(replace(replace(replace(url_encode(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '%2F', '/'), '%3A', ':'), '%40', '@'), '%25', '%')"
_SHOWN = "CASE WHEN {0} IS NULL THEN '[invalid URL]' ELSE regexp_extract({0}, '^([a-z]+://[^/?#]*)', 1) || " + _QUOTED + " || regexp_replace(replace(replace(replace(regexp_extract({0}, '^[^?#]*(.*)$', 1), '+', '%20'), 'a*b', 'a%2Ab'), 'a%2ab', 'a%2Ab'), 'token=[^&]*', 'token=[redacted]') END"
register("redact_url", lambda s, d: b.anchors(s, d).select("page_id", "elem_ord", policy.redact_url(urls.resolve(F.col("url"), F.col("href"))).alias("shown")), f"WITH {ANCHORS} SELECT page_id, elem_ord, {_SHOWN.format('target')} AS shown FROM anchors")
register(
    "redact_entity",
    lambda s, d: entities(s, d).filter("type not in ('seed_url', 'final_url', 'internal_link')").select("page_id", "entity_id", "type", policy.redact_entity(F.col("type"), F.col("value")).alias("shown")),
    f"""WITH {ENTITIES}, e AS (SELECT *, 'entity-' || printf('%03d', row_number() OVER (PARTITION BY page_id ORDER BY type, value)) AS entity_id FROM en)
    SELECT page_id, entity_id, type, CASE WHEN type IN ('external_link', 'external_asset_url') THEN {_SHOWN.format('value')} WHEN type = 'whatsapp_or_phone' THEN left(value, 2) || '••••' || right(value, 4) WHEN type = 'referral' THEN 'ref=[redacted]'
    WHEN length(value) > 256 THEN left(value, 256) || '…' ELSE value END AS shown FROM e WHERE type NOT IN ('seed_url', 'final_url', 'internal_link')""",
)
HOSTS = "concat(CASE page_id % 5 WHEN 0 THEN 'bet88casino.' WHEN 1 THEN 'bet88x.' WHEN 2 THEN 'go.bet88.' WHEN 3 THEN 'my.' ELSE 'bet88poker.' END, CASE page_id % 5 WHEN 2 THEN 'test' ELSE 'net' END)"
register(
    "brand_token",
    lambda s, d: b.pages(s, d).select("page_id", policy.brand_token(F.concat("case_id", urls.path(F.col("url")))).alias("token"), policy.target_class(F.expr(HOSTS), F.lit("bet88.test"), policy.brand_token(F.lit("bet88.test"))).alias("target_class")),
    f"SELECT page_id, regexp_extract({HOST} || lower({PATH}), '([a-z]+[0-9]+|[0-9]+[a-z]+|[0-9]{{3,}})', 1) AS token, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS target_class FROM pages",
)
FAILURE = "CASE page_id % 30 WHEN 3 THEN 'timeout' WHEN 4 THEN 'connection_error' WHEN 7 THEN 'external_host' WHEN 8 THEN 'request_budget' WHEN 10 THEN 'ReadTimeout: 30s' END"


def _statuses(s, d):
    """Navigation by the reason of its failure, access by the outcome, adequacy by the last checkpoint."""
    rows = outcomes(s, d).join(_adequacy(s, d).select("page_id", "adequacy"), "page_id").withColumn("nav", policy.navigation_status(F.expr(FAILURE)))
    return rows.select("page_id", F.col("nav").alias("navigation"), policy.public_status(F.col("nav"), F.coalesce("access_outcome", F.lit("")), F.col("adequacy")).alias("status"))


register(
    "public_status",
    _statuses,
    f"""WITH {LAST}, n AS (SELECT page_id, outcome, adequacy, CASE page_id % 30 WHEN 3 THEN 'timed_out' WHEN 4 THEN 'failed' WHEN 7 THEN 'blocked_by_policy' WHEN 8 THEN 'blocked_by_policy' WHEN 10 THEN 'timed_out' ELSE 'captured' END AS navigation FROM ti)
    SELECT page_id, navigation, CASE navigation WHEN 'blocked_by_policy' THEN 'blocked_by_policy' WHEN 'timed_out' THEN 'timeout' WHEN 'failed' THEN 'collection_failed' ELSE CASE WHEN outcome = 'bot_challenge' THEN 'access_challenge_observed' WHEN outcome = 'geo_restricted' THEN 'geo_restriction_observed'
    WHEN outcome = 'unavailable_page' THEN 'unavailable' WHEN adequacy = 'adequate' THEN 'captured' ELSE 'captured_with_limitations' END END AS status FROM n""",
)


def _headers(s, d):
    """Response headers made of each event: allowed and other ones, in any case, one null."""
    pairs = F.create_map(F.lit("Content-Type"), F.col("kind"), F.lit("X-Session"), F.lit("s"), F.lit("ETag"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")), F.lit("SERVER"), F.repeat(F.lit("n"), 1200), F.lit("set-cookie"), F.lit("c"))
    kept = F.map_entries(policy.allowed_headers(pairs))
    return b.event_log(s, d).select("event_id", F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, 20), F.lit("/"), F.length(e["value"]).cast("string")))), ";").alias("headers"))


register("header_allowlist", _headers, "SELECT event_id, 'content-type=' || event_type || '/' || length(event_type) || CASE WHEN event_id % 3 = 0 THEN ';etag=' || event_id || '/' || length(event_id::VARCHAR) ELSE '' END || ';server=' || repeat('n', 20) || '/1000' AS headers FROM events")


def _labels(s, d):
    t = F.col("observation_type")
    shown = labels.presentation(labels.node_kind(t), t, labels.claim_category(t))
    rows = semantic(s, d).select(t, labels.node_kind(t).alias("kind"), labels.relation(t).alias("relation"), labels.claim_category(t).alias("category"), shown["visual_kind"].alias("visual_kind"), shown["label"].alias("label"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


register(
    "label_maps",
    _labels,
    f"""WITH {SEMANTIC}, m(observation_type, kind, relation, category, visual_kind, label) AS (VALUES ('claimed_brand_identity', 'claimed_brand', 'claims_brand', 'public_claims', 'brand', 'Claimed brand'), ('public_outgoing_link', 'external_destination', 'publicly_links_to', 'public_claims', 'destination', 'Destination'),
    ('public_telegram_alias', 'public_contact', 'publishes_public_contact', 'public_claims', 'contact', 'Telegram'), ('public_telegram_contact', 'public_contact', 'publishes_public_contact', 'public_claims', 'contact', 'Telegram'), ('public_whatsapp_link', 'public_contact', 'publishes_public_contact', 'public_claims', 'contact', 'WhatsApp'),
    ('public_phone_number', 'public_contact', 'publishes_public_contact', 'public_claims', 'contact', 'Phone'), ('public_email_address', 'public_contact', 'publishes_public_contact', 'public_claims', 'contact', 'Email'), ('public_payment_method', 'public_claim', 'displays_public_claim', 'payment_indicators', 'transaction', 'Transaction'),
    ('public_payment_provider', 'public_claim', 'displays_public_claim', 'payment_indicators', 'transaction', 'Transaction'), ('public_offer_claim', 'public_claim', 'displays_public_claim', 'offer_claims', 'offer', 'Offer'), ('public_legal_or_license_claim', 'public_claim', 'displays_public_claim', 'legal_claims', 'other', 'Other evidence'),
    ('public_referral_code', 'public_claim', 'displays_public_claim', 'referral_markers', 'other', 'Other evidence'), ('public_tracking_identifier', 'public_claim', 'displays_public_claim', 'tracking_markers', 'other', 'Other evidence'), ('public_download_destination', 'public_claim', 'displays_public_claim', 'download_references', 'other', 'Other evidence'))
    SELECT m.*, count(*) AS n FROM sem JOIN m USING (observation_type) GROUP BY ALL""",
)
