"""Queries over page markup and the observations in texts."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from sightline.operators import html, observations as ob
from sightline.plans import bindings as b
from sightline.plans.registry import register
from sightline.plans.sql import EMAIL_SQL, SEGMENTS, TEXTS

def _elements(s, d):
    """Elements by their place in the page, with region and all attributes."""
    place = F.row_number().over(W.partitionBy("page_id").orderBy("elem_ord")) - 1
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda x: F.concat(x["key"], F.lit('="'), x["value"], F.lit('"')))), " ")
    return html.elements(b.pages(s, d)).select("page_id", place.alias("place"), "tag", "region", shown.alias("attributes"))


register(
    "html_elements",
    _elements,
    r"""WITH h AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2></\1>', 'g') AS html FROM pages),
    l AS (SELECT page_id, regexp_extract_all(html, '</?[a-z][^>]*>') AS l FROM h), u AS (SELECT page_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS k FROM l),
    w AS (SELECT *, coalesce(sum(CASE WHEN starts_with(t, '<nav') THEN 1 WHEN starts_with(t, '</nav') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nav FROM u)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place, regexp_extract(t, '<([a-z0-9]+)', 1) AS tag, CASE WHEN nav > 0 THEN 'nav' ELSE 'document' END AS region,
    replace(replace(array_to_string(list_sort(regexp_extract_all(t, '([a-z-]+="[^"]*")', 1)), ' '), '&quot;', chr(34)), '&amp;', '&') AS attributes FROM w WHERE NOT starts_with(t, '</')""",
)
register(
    "visible_text",
    lambda s, d: html.visible_text(b.pages(s, d)).select("page_id", F.regexp_replace("text", r"\s+", " ").alias("text")),
    f"SELECT page_id, regexp_replace(array_to_string({SEGMENTS}, ' '), '\\s+', ' ', 'g') AS text FROM pages",
)


register("page_title", lambda s, d: html.first_text(html.nodes(b.pages(s, d)), "title"), "SELECT page_id, trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', chr(34)), '&amp;', '&')) AS text FROM pages")


register("obs_emails", lambda s, d: ob.emails(b.texts(s, d)), f"WITH {TEXTS} SELECT DISTINCT page_id, lower(m) AS value FROM (SELECT page_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}', 1)) AS m FROM texts)")
register(
    "obs_phones",
    lambda s, d: ob.phones(b.texts(s, d)),
    rf"""WITH {TEXTS}, m AS (SELECT page_id, unnest(regexp_extract_all(text, '(?:^|[^\w+\pL])(\+?[0-9][0-9\s().-]{{7,}}[0-9])(?:\W|$)', 1)) AS m FROM texts)
    SELECT DISTINCT page_id, CASE WHEN starts_with(m, '+') THEN '+' ELSE '' END || regexp_replace(m, '[^0-9]', '', 'g') AS value FROM m WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) >= 8""",
)
_TERMS = ", ".join(f"('{k}', '{t}')" for k, v in ob.CLAIMS.items() for t in v)
register(
    "obs_claim_terms",
    lambda s, d: ob.claim_terms(b.texts(s, d)),
    f"WITH {TEXTS}, terms(observation_type, value) AS (VALUES {_TERMS}) SELECT page_id, observation_type, value, strpos(lower(text), value)::INTEGER AS place FROM texts JOIN terms ON contains(lower(text), value)",
)
register("text_tokens", lambda s, d: ob.text_tokens(b.texts(s, d)), rf"WITH {TEXTS} SELECT page_id, token, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\pL\pM\pN_]{{2,}}')) AS token FROM texts) GROUP BY ALL")
register(
    "dom_features",
    lambda s, d: html.dom_features(b.pages(s, d)).groupBy("pair").agg(F.count("*").alias("n")),
    r"""WITH e AS (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '<[a-z][a-z0-9]*[^>]*>'), lambda t: true) AS l FROM pages),
    f AS (SELECT page_id, list_transform(l, lambda t: regexp_extract(t, '<([a-z0-9]+)', 1) || '[' || array_to_string(list_sort(regexp_extract_all(t, ' ([a-z-]+)=', 1)), ',') || ']') AS l FROM e),
    p AS (SELECT unnest(list_transform(range(1, len(l)), lambda k: l[k] || '>' || l[k + 1])) AS pair FROM f) SELECT pair, count(*) AS n FROM p GROUP BY pair""",
)
