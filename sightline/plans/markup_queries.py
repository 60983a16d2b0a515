"""Queries over the markup of pages (``web``): links, signals, entities, observations, controls. The oracles state what the derived markup
holds, or find it with patterns; they don't parse it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.operators import cases, html, markup, observations as ob
from sightline.plans import bindings as b
from sightline.plans.registry import register
from sightline.plans.sql import EMAIL_SQL, SEGMENTS
from sightline.plans.web import ANCHORS, ASSETS, CONTROLS, ROOT, THOST, WEB, facts

A = ANCHORS
TX = f"{WEB}, tx AS (SELECT page_id, trim(array_to_string({SEGMENTS}, ' ')) AS text FROM web)"
AF = facts([(a, r, kind, host, url) for a, r, _, kind, host, url in ASSETS if host], "kind, host, canonical", 3, "af")
CF = facts([(a, r, tag, label, owner, action) for a, r, _, tag, label, owner, action in CONTROLS], "tag, label, form_owner, form_action", 2, "cf")


def _links(s, d):
    return markup.anchors(b.nodes(s, d))


def _targets(s, d):
    return markup.anchor_links(_links(s, d))


register("anchor_links", lambda s, d: _targets(s, d).select("page_id", "target", "kind", "label", "rel", "region"), f"WITH {A} SELECT page_id, target, CASE WHEN {THOST} = case_id THEN 'internal_link' ELSE 'external_link' END AS kind, label, rel, region FROM anchors WHERE target IS NOT NULL")
register("discovered_links", lambda s, d: b.anchors(s, d).select("page_id", "elem_ord", "href", "label", urls.crawl_url(F.col("href"), F.col("url")).alias("crawl_url")), f"WITH {A} SELECT page_id, elem_ord, href, label, CASE WHEN href LIKE '%u:p@%' THEN NULL ELSE crawl_url END AS crawl_url FROM anchors")
ASSET_SQL = f"{AF}, asg AS (SELECT page_id, 'external_asset_domain' AS type, host AS value, kind FROM af UNION ALL SELECT page_id, 'external_asset_url', replace(canonical, '{{scheme}}', regexp_extract(url, '^([a-z]+)', 1)), kind FROM af)"
register("asset_signals", lambda s, d: markup.asset_signals(b.nodes(s, d)).select("page_id", "type", "value", "method"), f"WITH {ASSET_SQL} SELECT page_id, type, value, 'html_' || kind || CASE kind WHEN 'stylesheet' THEN '_href' ELSE '_src' END AS method FROM asg")
TG = rf"""tgs AS (SELECT page_id, '@' || lower(regexp_extract(href, '^(?:https://t[.]me/|tg://resolve[?]domain=)([A-Za-z]\w{{4,31}})$', 1)) AS value, 0 AS priority FROM anchors WHERE regexp_matches(href, '^(https://t[.]me/|tg://resolve[?]domain=)[A-Za-z]')
  UNION ALL SELECT page_id, '@' || lower(unnest(regexp_extract_all(text, '(?:^|[^\w@\pL])@([A-Za-z][A-Za-z0-9_]{{4,31}})\b', 1))), 1 FROM tx)"""
register("telegram_signals", lambda s, d: markup.telegram_signals(_links(s, d), html.text_of(b.nodes(s, d))).groupBy("page_id", "value").agg(F.min("priority").alias("priority")), f"WITH {A}, {TX}, {TG} SELECT page_id, value, min(priority) AS priority FROM tgs GROUP BY ALL")
WA = "was AS (SELECT page_id, '+' || regexp_replace(replace(regexp_extract(href, '(?:wa[.]me/|phone=)(.*)$', 1), '%2B', ''), '[^0-9]', '', 'g') AS value FROM anchors WHERE regexp_matches(href, '^https://(wa[.]me|api[.]whatsapp[.]com)/'))"
register("whatsapp_signals", lambda s, d: markup.whatsapp_signals(_links(s, d)).select("page_id", "value").distinct(), f"WITH {A}, {WA} SELECT DISTINCT page_id, value FROM was")
RF = "rfs AS (SELECT page_id, 'ref=' || unnest(regexp_extract_all(u, '[?&]ref=([^&#]+)', 1)) AS value FROM (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, target FROM anchors WHERE target IS NOT NULL))"
register("referral_signals", lambda s, d: markup.referral_signals(b.web(s, d), _targets(s, d)).select("page_id", "value").distinct(), f"WITH {A}, {RF} SELECT DISTINCT page_id, value FROM rfs")
_CLEAN = lambda x: f"trim(replace(replace({x}, '&quot;', chr(34)), '&amp;', '&'))"
TITLE = _CLEAN("regexp_extract(html, '<title>([^<]*)</title>', 1)")
ENTITIES = f"""{A}, {TX}, {TG}, {WA}, {RF}, {ASSET_SQL}, en AS (SELECT DISTINCT page_id, type, value FROM (SELECT page_id, 'seed_url' AS type, url AS value FROM pages UNION ALL SELECT page_id, 'final_url', url FROM pages
  UNION ALL SELECT page_id, 'page_title', replace(lower({TITLE}), 'ß', 'ss') FROM web UNION ALL SELECT page_id, CASE WHEN {THOST} = case_id THEN 'internal_link' ELSE 'external_link' END, target FROM anchors
  UNION ALL SELECT page_id, 'referenced_domain', {THOST} FROM anchors UNION ALL SELECT page_id, 'telegram', value FROM tgs UNION ALL SELECT page_id, 'whatsapp_or_phone', value FROM was UNION ALL SELECT page_id, 'referral', value FROM rfs
  UNION ALL SELECT page_id, type, value FROM asg) WHERE value <> '')"""
entities = lambda s, d: b.kept(s, d, "entities", lambda: markup.entities(b.web(s, d), b.nodes(s, d)))
register("extract_entities", lambda s, d: entities(s, d).select("page_id", "entity_id", "type", "value"), f"WITH {ENTITIES} SELECT page_id, 'entity-' || printf('%03d', row_number() OVER (PARTITION BY page_id ORDER BY type, value)) AS entity_id, type, value FROM en")
_CASE = "regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"
register("entity_type_counts", lambda s, d: entities(s, d).join(b.pages(s, d).select("page_id", "case_id"), "page_id").groupBy("case_id", "type").agg(F.count("*").alias("n")), f"WITH {ENTITIES} SELECT {_CASE} AS case_id, type, count(*) AS n FROM en JOIN pages USING (page_id) GROUP BY ALL")

# observations: (page_id, observation_type, value, stage, ord, sub)
_FOLDED = lambda x: f"replace(lower(trim(regexp_replace({_CLEAN(x)}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
BRAND = f"""brd AS (SELECT * FROM (SELECT page_id, 'meta_og_site_name' AS method, lower(regexp_extract(html, 'og:site_name" content="([^"]*)"', 1)) AS value, 0.95 AS confidence, 0 AS sub FROM web
  UNION ALL SELECT page_id, 'dom_h1', {_FOLDED("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, 0.85, 1 FROM web UNION ALL SELECT page_id, 'document_title', {_FOLDED("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, 0.85, 2 FROM web) WHERE value <> '')"""
register("obs_brand", lambda s, d: markup.brand_observations(b.nodes(s, d)).select("page_id", "method", "value", "confidence"), f"WITH {WEB}, {BRAND} SELECT page_id, method, value, confidence::DOUBLE AS confidence FROM brd")
_rows = lambda s, d: markup.link_rows(_links(s, d))
register(
    "obs_outgoing_link",
    lambda s, d: markup.outgoing_links(_rows(s, d)).groupBy("page_id", "value").agg(F.min_by(F.struct("label", "new_tab", "download"), "ord").alias("x")).select("page_id", F.col("value").alias("target"), "x.*"),
    f"WITH {A} SELECT page_id, target, arg_min(label, elem_ord) AS label, arg_min(target_attr = '_blank', elem_ord) AS new_tab, arg_min(download, elem_ord) AS download FROM anchors WHERE target IS NOT NULL GROUP BY page_id, target",
)
MSG = """msg AS (SELECT page_id, CASE WHEN length(regexp_replace(n, '[^0-9]', '', 'g')) >= 8 THEN 'public_telegram_contact' ELSE 'public_telegram_alias' END AS observation_type, CASE WHEN length(regexp_replace(n, '[^0-9]', '', 'g')) >= 8 THEN '+' || n ELSE '@' || n END AS value, elem_ord AS ord, 1 AS sub
  FROM (SELECT page_id, elem_ord, lower(regexp_extract(href, '^https://t[.]me/(.*)$', 1)) AS n FROM anchors WHERE starts_with(href, 'https://t.me/'))
  UNION ALL SELECT page_id, 'public_whatsapp_link', CASE WHEN href LIKE '%//wa.me/%' THEN href ELSE target END, elem_ord, 2 FROM anchors WHERE regexp_matches(href, '^https://(wa[.]me|api[.]whatsapp[.]com)/'))"""
register("obs_messaging_links", lambda s, d: markup.messaging_links(_rows(s, d)).select("page_id", "observation_type", "value").distinct(), f"WITH {A}, {MSG} SELECT DISTINCT page_id, observation_type, value FROM msg")
register("obs_downloads", lambda s, d: markup.downloads(_rows(s, d)).select("page_id", "value"), f"WITH {A} SELECT page_id, target AS value FROM anchors WHERE download OR regexp_matches(lower(target), '^[^?#]*[.](apk|bin|dmg|exe|iso|msi|pkg|zip)([?#]|$)')")
PRM = """prm AS (SELECT page_id, 'public_referral_code' AS observation_type, lower(regexp_extract(resolved, '[?&]ref=([^&#]*)', 1)) AS value, elem_ord AS ord, 4 AS sub FROM anchors WHERE regexp_matches(resolved, '[?&]ref=[^&#]')
  UNION ALL SELECT page_id, 'public_tracking_identifier', 'utm_source=' || regexp_extract(resolved, 'utm_source=([^&#]*)', 1), elem_ord, 5 FROM anchors WHERE regexp_matches(resolved, 'utm_source=[^&#]'))"""
register("obs_referral_tracking", lambda s, d: markup.parameter_observations(_rows(s, d)).select("page_id", "observation_type", "value").distinct(), f"WITH {A}, {PRM} SELECT DISTINCT page_id, observation_type, value FROM prm")


def _found(pattern: str, source: str = "text") -> str:
    return f"(SELECT page_id, k AS ord, l[k] AS m FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all({source}, '{pattern}', 1) AS l FROM tx)))"


_NUM = r"(\+?\d[\d\s().-]{7,}\d)"
_DIG = "regexp_replace(m, '[^0-9]', '', 'g')"
_REST = rf"regexp_replace(text, '(?i)(whats\s*app|telegram)\s*[:\-]?\s*{_NUM}', '\1 : ', 'g')"
_TERMS = ", ".join(f"({stage}, {k}, '{kind}', '{t}')" for stage, (kind, terms) in enumerate(ob.CLAIMS.items(), 7) for k, t in enumerate(sorted(terms)))
TOB = rf"""tob AS (SELECT page_id, 'public_whatsapp_link' AS observation_type, 'https://wa.me/' || {_DIG} AS value, 2 AS stage, ord FROM {_found(rf"(?i)whats\s*app\s*[:\-]?\s*{_NUM}")} WHERE length({_DIG}) >= 8
  UNION ALL SELECT page_id, 'public_telegram_contact', '+' || {_DIG}, 3, ord FROM {_found(rf"(?i)telegram\s*[:\-]?\s*{_NUM}")} WHERE length({_DIG}) >= 8
  UNION ALL SELECT page_id, 'public_email_address', lower(m), 4, ord FROM {_found(EMAIL_SQL)}
  UNION ALL SELECT page_id, 'public_phone_number', CASE WHEN starts_with(m, '+') THEN '+' ELSE '' END || {_DIG}, 5, ord FROM {_found(r"(?:^|[^\w+\pL])(\+?[0-9][0-9\s().-]{7,}[0-9])(?:\W|$)", _REST)} WHERE length({_DIG}) >= 8
  UNION ALL SELECT page_id, 'public_telegram_alias', '@' || lower(m), 6, ord FROM {_found(r"(?:^|[^\w\pL])@([A-Za-z][A-Za-z0-9_]{3,31})")}
  UNION ALL SELECT page_id, kind, t, stage, k FROM tx JOIN (VALUES {_TERMS}) v(stage, k, kind, t) ON contains(replace(lower(text), 'ß', 'ss'), t))"""
register("obs_channel_phones", lambda s, d: markup.text_observations(html.text_of(b.nodes(s, d))).filter("method = 'visible_text_channel_label'").select("page_id", "observation_type", "value", "ord"), f"WITH {TX}, {TOB} SELECT page_id, observation_type, value, (ord - 1)::INT AS ord FROM tob WHERE stage IN (2, 3)")
register("obs_text_aliases", lambda s, d: markup.text_observations(html.text_of(b.nodes(s, d))).filter("stage = 6").select("page_id", "value", "confidence"), f"WITH {TX}, {TOB} SELECT page_id, value, 0.9::DOUBLE AS confidence FROM tob WHERE stage = 6")
SEMANTIC = f"""{A}, {TX}, {BRAND}, {MSG}, {PRM}, {TOB}, se0 AS (SELECT page_id, 'claimed_brand_identity' AS observation_type, value, 0 AS stage, 0 AS ord, sub FROM brd UNION ALL SELECT page_id, 'public_outgoing_link', target, 1, elem_ord, 0 FROM anchors WHERE target IS NOT NULL
  UNION ALL SELECT page_id, observation_type, value, 1, ord, sub FROM msg UNION ALL SELECT page_id, 'public_download_destination', target, 1, elem_ord, 3 FROM anchors WHERE download UNION ALL SELECT page_id, observation_type, value, 1, ord, sub FROM prm UNION ALL SELECT page_id, observation_type, value, stage, ord, 0 FROM tob),
  se1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, observation_type, value ORDER BY stage, ord, sub) AS nth FROM se0 WHERE value <> ''),
  sem AS (SELECT * FROM (SELECT page_id, observation_type, value, row_number() OVER (PARTITION BY page_id ORDER BY stage, ord, sub) AS place FROM se1 WHERE nth = 1) WHERE place <= 500)"""
semantic = lambda s, d: b.kept(s, d, "observations", lambda: markup.semantic_observations(b.nodes(s, d)))
register("distinct_observations", lambda s, d: ob.distinct_observations(semantic(s, d), "page_id", "observation_id").select("page_id", "observation_id", "observation_type", "value"), f"WITH {SEMANTIC} SELECT page_id, 'observation-' || printf('%04d', place) AS observation_id, observation_type, value FROM (SELECT *, row_number() OVER (PARTITION BY observation_type, value ORDER BY page_id, place) AS k FROM sem) WHERE k = 1")
_IND = [(t, g) for g, v in ob.INDICATORS.items() for t in v]
_DIRECT = """CASE WHEN observation_type = 'claimed_brand_identity' THEN 'gambling_brand_claim' WHEN observation_type = 'public_offer_claim' THEN 'gambling_offer' WHEN observation_type IN ('public_payment_method', 'public_payment_provider') THEN 'transaction_enablement'
  WHEN list_has_any(terms, [{0}]) THEN 'game_mechanics' WHEN list_has_any(terms, [{1}]) THEN 'gambling_offer' ELSE 'wagering_language' END""".format(*(", ".join(f"'{t}'" for t in ob.INDICATORS[g]) for g in ("game_mechanics", "betting_promotion")))
_CONTEXT = "CASE observation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ob.CONTEXTUAL.items()) + " END"
INDICATORS = f"""{SEMANTIC}, o AS (SELECT page_id, place, observation_type, value, list_filter([{", ".join(f"CASE WHEN regexp_matches(value, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN '{t}' END" for t, _ in _IND)}], lambda x: x IS NOT NULL) AS terms FROM sem),
  pg AS (SELECT page_id, list_sort(list_distinct(flatten(list(terms)))) AS pt FROM o WHERE len(terms) > 0 GROUP BY page_id),
  ind AS (SELECT o.page_id, place, observation_type, value, CASE WHEN len(terms) > 0 THEN {_DIRECT} WHEN pt IS NOT NULL THEN {_CONTEXT} END AS category,
  CASE WHEN len(terms) > 0 THEN array_to_string(list_sort(terms), ',') WHEN pt IS NOT NULL AND {_CONTEXT} IS NOT NULL THEN array_to_string(pt, ',') ELSE '' END AS matched FROM o LEFT JOIN pg USING (page_id))"""
_indicators = lambda s, d: ob.indicator_rows(semantic(s, d).withColumn("text", F.col("value")))
register("indicator_rows", lambda s, d: _indicators(s, d).select("page_id", "observation_type", "value", "category", "matched"), f"WITH {INDICATORS} SELECT page_id, observation_type, value, category, matched FROM ind")
_GROUP = "CASE observation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ob.OSINT_GROUPS.items()) + " ELSE 'other_observations' END"
register(
    "indicator_summary",
    lambda s, d: ob.indicator_summary(_indicators(s, d), b.pages(s, d).select("page_id")),
    f"""WITH {INDICATORS}, c AS (SELECT page_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT page_id, category, count(*) AS n FROM ind WHERE category IS NOT NULL GROUP BY ALL) GROUP BY page_id),
    g AS (SELECT page_id, string_agg(grp || '=' || n, ',' ORDER BY grp) AS groups FROM (SELECT page_id, {_GROUP} AS grp, count(*) AS n FROM ind GROUP BY ALL) GROUP BY page_id), t AS (SELECT page_id, count(*) AS n_observations, count(category) AS n_indicators FROM ind GROUP BY page_id)
    SELECT page_id, coalesce(n_observations, 0) AS n_observations, coalesce(n_indicators, 0) AS n_indicators, coalesce(categories, '') AS categories, coalesce(groups, '') AS groups,
    CASE WHEN n_observations IS NULL THEN 'insufficient_evidence' WHEN n_indicators > 0 THEN 'indicators_observed' ELSE 'no_indicators_observed' END AS status FROM pages LEFT JOIN t USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN g USING (page_id)""",
)

# controls
CONTROL_SQL = f"""{A}, {CF}, co0 AS (SELECT page_id, elem_ord AS pos, 'a' AS tag, label, resolved AS href, NULL::VARCHAR AS form_owner, NULL::VARCHAR AS form_action, download, target_attr = '_blank' AS new_tab, label AS shown FROM anchors WHERE label <> ''
  UNION ALL SELECT page_id, 100000 + k, tag, label, NULL, form_owner, {ROOT} || form_action, false, false, CASE k WHEN 0 THEN 'Hi' ELSE label END FROM cf),
  co AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, replace(lower(label), 'ß', 'ss'), href ORDER BY pos) AS again FROM co0) WHERE again = 1),
  ct AS (SELECT *, 'live-' || printf('%03d', n) AS element_id, CASE WHEN href IS NOT NULL THEN 'open_public_link' WHEN regexp_matches(lower(label), '\\b(contact|hubungi|kontak|support|promo|promotion|about|information|menu|help|news|event)\\b') THEN 'reveal_tab' ELSE 'none' END AS behavior FROM co)"""
_controls = lambda s, d: markup.controls(b.nodes(s, d))
register(
    "interactive_elements",
    lambda s, d: _controls(s, d).select("page_id", "element_id", "tag", "role", "label", "href", "form_owner", "form_action", "download", "new_tab", "behavior"),
    f"WITH {CONTROL_SQL} SELECT page_id, element_id, tag, CASE WHEN tag = 'a' THEN 'link' ELSE 'button' END AS role, label, href, form_owner, form_action, download, new_tab, behavior FROM ct",
)
_FORBIDDEN_SQL = r"\b(login|log in|sign in|register|sign up|create account|submit|send|chat|payment|pay|deposit|withdraw|withdrawal|bet|wager|download|install|captcha)\b"
POLICY = f"""{CONTROL_SQL}, po AS (SELECT *, CASE WHEN download THEN 'download_attribute_blocked' WHEN form_owner IS NOT NULL OR form_action IS NOT NULL THEN 'form_or_input_action_blocked' WHEN regexp_matches(href, '^(mailto|tel|sms|tg|whatsapp|intent):') THEN 'external_application_launch_blocked'
  WHEN regexp_matches(lower(concat_ws(' ', label, shown, href, form_action)), '{_FORBIDDEN_SQL}') THEN 'forbidden_action_keyword' WHEN behavior = 'reveal_tab' THEN 'validated_public_reveal'
  WHEN behavior = 'open_public_link' THEN CASE WHEN NOT starts_with(href, 'http') THEN 'public_link_destination_invalid' WHEN regexp_matches(lower(href), '^[^?#]*[.](apk|bin|dmg|exe|msi|zip)([?#]|$)') THEN 'binary_destination_blocked' ELSE 'validated_public_link' END ELSE 'ambiguous_or_undeclared_action' END AS reason FROM ct)"""
register("interaction_policy", lambda s, d: cases.interaction_policy(_controls(s, d)).select("page_id", "element_id", "allowed", "reason"), f"WITH {POLICY} SELECT page_id, element_id, reason IN ('validated_public_reveal', 'validated_public_link') AS allowed, reason FROM po")
_RANK = "CASE " + " ".join(f"WHEN contains(lower(label || ' ' || shown), '{t}') THEN {k}" for t, k in cases.LABEL_RANKS) + " ELSE 10 END"
register("ranked_elements", lambda s, d: cases.first_allowed(_controls(s, d)), f"WITH {POLICY}, r AS (SELECT *, {_RANK} AS rank FROM po WHERE reason IN ('validated_public_reveal', 'validated_public_link')) SELECT page_id, arg_min(element_id, (rank, element_id)) AS element_id, min(rank) AS rank FROM r GROUP BY page_id")

# outcomes of captures; how navigation went is derived from page_id
NAVIGATION = "CASE WHEN page_id % 30 = 3 THEN 'timed_out' WHEN page_id % 30 = 4 THEN 'failed' ELSE 'captured' END"
ERROR = "CASE WHEN page_id % 30 = 4 THEN 'ConnectionError: reset' WHEN page_id % 30 = 6 THEN 'ReadTimeout' ELSE '' END"
FINAL = "CASE WHEN page_id % 30 = 5 THEN concat(url, '?__cf_chl_tk=1') ELSE url END"


def captures(s, d):
    """page_id, url, title, final_url, text, navigation_status, error_type of each page."""
    nodes = b.nodes(s, d)
    rows = b.web(s, d).select("page_id", "url", F.expr(FINAL).alias("final_url"), F.expr(NAVIGATION).alias("navigation_status"), F.expr(ERROR).alias("error_type"))
    return rows.join(html.text_of(nodes), "page_id", "left").join(html.first_text(nodes, "title").withColumnRenamed("text", "title"), "page_id", "left")


def outcomes(s, d):
    return b.kept(s, d, "outcomes", lambda: cases.capture_outcome(captures(s, d)))


_NORM = lambda x: f"replace(lower(trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g'))), 'ß', 'ss')"
_HITS = lambda terms, label: f"list_filter([{', '.join(f"CASE WHEN contains(both_, '{t}') THEN '{label}: {t}' END" for t in terms)}], lambda x: x IS NOT NULL)"
OUTCOMES = f"""{TX}, oc0 AS (SELECT page_id, url, {NAVIGATION} AS nav, lower({ERROR}) AS err, lower({FINAL}) AS fin, left({_NORM("coalesce(text, '')")}, 50000) AS t, {_NORM(TITLE)} AS ti FROM web LEFT JOIN tx USING (page_id)),
  oc1 AS (SELECT *, trim(ti || ' ' || t) AS both_ FROM (SELECT page_id, url, nav, err, fin, t, ti FROM oc0)),
  oc2 AS (SELECT *, {_HITS(cases.STRONG_CHALLENGE, "bot-challenge indicator")} AS strong, CASE WHEN contains(fin, '__cf_chl_') THEN ['bot-challenge URL marker: __cf_chl_'] ELSE [] END AS marks, {_HITS(cases.WEAK_CHALLENGE, "bot-challenge indicator")} AS weak,
    {_HITS(cases.GEO, "geo-restriction indicator")} AS geo, {_HITS(cases.UNAVAILABLE, "unavailable-page indicator")} AS gone, {_HITS(cases.CONSENT, "consent-wall indicator")} AS consent, {_HITS(cases.UNKNOWN, "restriction indicator")} AS unknown, len(regexp_extract_all(t, '\\S+')) AS words FROM oc1),
  oc AS (SELECT page_id, url, CASE WHEN nav = 'timed_out' OR contains(err, 'timeout') THEN 'timeout' WHEN nav <> 'captured' OR err <> '' THEN 'navigation_error' WHEN len(strong) + len(marks) > 0 OR len(weak) >= 2 THEN 'bot_challenge' WHEN len(geo) > 0 THEN 'geo_restricted' WHEN len(gone) > 0 THEN 'unavailable_page'
    WHEN len(consent) >= 2 AND words < 20 THEN 'consent_wall' WHEN len(unknown) > 0 OR length(t) < 24 OR words < 4 THEN 'unknown_restriction' ELSE 'content' END AS outcome,
    CASE WHEN nav = 'timed_out' OR contains(err, 'timeout') THEN ['navigation timed out'] WHEN err <> '' THEN ['navigation error type: ' || string_split(err, ':')[1]] WHEN len(strong) > 0 THEN strong WHEN len(marks) > 0 THEN marks WHEN len(weak) >= 2 THEN weak WHEN len(geo) > 0 THEN geo WHEN len(gone) > 0 THEN gone
    WHEN len(consent) >= 2 AND words < 20 THEN consent WHEN len(unknown) > 0 THEN unknown WHEN length(t) < 24 OR words < 4 THEN ['captured page had no meaningful visible text'] ELSE [] END AS reasons FROM oc2)"""
register("capture_outcome", lambda s, d: outcomes(s, d).select("page_id", "outcome", "access_outcome", "content_usable", F.array_join("reasons", "; ").alias("reasons")), f"""WITH {OUTCOMES} SELECT page_id, outcome, CASE outcome WHEN 'bot_challenge' THEN 'access_challenge' WHEN 'geo_restricted' THEN 'geo_restriction' WHEN 'unavailable_page' THEN 'unavailable'
  WHEN 'timeout' THEN NULL WHEN 'navigation_error' THEN NULL ELSE outcome END AS access_outcome, outcome = 'content' AS content_usable, array_to_string(reasons, '; ') AS reasons FROM oc""")
register("usable_entities", lambda s, d: cases.usable_entities(entities(s, d), outcomes(s, d)).select("page_id", "type", "value"), f"WITH {OUTCOMES}, {ENTITIES.replace(TX + ', ', '')} SELECT page_id, type, value FROM en WHERE page_id IN (SELECT page_id FROM oc WHERE outcome = 'content')")
