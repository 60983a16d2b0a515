"""Queries that join cases, score candidates, compare pairs and check references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from sightline.functions import policy, urls
from sightline.operators import cases, html, leads, markup, observations as ob, similarity as sim
from sightline.plans import bindings as b
from sightline.plans.log_queries import LOG
from sightline.plans.markup_queries import ENTITIES, OUTCOMES, SEMANTIC, TX, entities, outcomes, semantic
from sightline.plans.registry import register
from sightline.plans.url_queries import ANCHORS, HOST, _MATERIAL, _priorities
from sightline.plans.web import THOST, WEB
from sightline.sources import read_table


def _entities(s, d):
    """Usable entities with case_id, domain (the host), url."""
    rows = cases.usable_entities(entities(s, d), outcomes(s, d))
    return rows.join(b.pages(s, d).select("page_id", "case_id", F.col("case_id").alias("domain"), "url"), "page_id")


def _signals(s, d):
    return cases.signal_exclusions(_entities(s, d), leads.ASSET_PROVIDERS).filter("excluded is null").drop("excluded")


USABLE = f"{OUTCOMES}, {ENTITIES.replace(TX + ', ', '')}, us AS (SELECT en.page_id, type, value, {HOST} AS case_id, url FROM en JOIN pages USING (page_id) WHERE page_id IN (SELECT page_id FROM oc WHERE outcome = 'content'))"
SIG = f"{USABLE}, sig AS (SELECT * FROM us WHERE type IN ('telegram', 'whatsapp_or_phone') OR type = 'external_asset_url' AND value NOT LIKE '%//cdnjs.cloudflare.com/%' OR type = 'referral' AND length(regexp_extract(value, '=(.*)$', 1)) >= 4)"
SHARED = f"""{SIG}, pr AS (SELECT a.case_id, a.type, a.value, o.case_id AS other_case, o.page_id FROM (SELECT DISTINCT case_id, type, value FROM sig) a JOIN sig o ON a.type = o.type AND a.value = o.value AND a.case_id <> o.case_id),
  mt AS (SELECT case_id, type, value, count(*) AS frequency, count(DISTINCT other_case) AS n_cases, count(DISTINCT other_case) AS n_domains FROM pr GROUP BY ALL),
  mq AS (SELECT *, CASE WHEN type = 'referral' THEN CASE WHEN frequency = 1 THEN 'medium' ELSE 'weak' END WHEN frequency = 1 THEN 'strong' ELSE 'medium' END AS quality FROM mt WHERE n_domains <= 3),
  sh AS (SELECT DISTINCT mq.*, other_case, CASE type || '/' || quality WHEN 'telegram/strong' THEN 35 WHEN 'telegram/medium' THEN 23 WHEN 'whatsapp_or_phone/strong' THEN 30 WHEN 'whatsapp_or_phone/medium' THEN 20 WHEN 'external_asset_url/strong' THEN 20 WHEN 'external_asset_url/medium' THEN 13 WHEN 'referral/medium' THEN 10 ELSE 5 END AS weight
    FROM mq JOIN pr USING (case_id, type, value))"""
_shared = lambda s, d: cases.shared_signals(_signals(s, d))
register("corpus_metrics", lambda s, d: cases.corpus_metrics(_signals(s, d)), f"WITH {SIG} SELECT type, value, count(*) AS frequency, count(DISTINCT case_id) AS n_cases, count(DISTINCT case_id) AS n_domains FROM sig GROUP BY type, value")


def _shared_and_excluded(s, d):
    """Shared signals, and the signals that are left out with the reason."""
    every = cases.signal_exclusions(_entities(s, d), leads.ASSET_PROVIDERS)
    good = every.filter("excluded is null")
    common = cases.signal_counts(good).filter(F.col("n_domains") > cases.MAX_DOMAINS)
    reasons = common.withColumn("excluded", F.concat(F.lit("common_signal_across_"), F.col("n_domains").cast("string"), F.lit("_corpus_domains"))).select("case_id", "type", "value", "excluded")
    out = reasons.unionByName(every.filter("excluded is not null").select("case_id", "type", "value", "excluded").distinct())
    return _shared(s, d).unionByName(out, allowMissingColumns=True)


register(
    "shared_signals",
    _shared_and_excluded,
    f"""WITH {SHARED} SELECT case_id, type, value, other_case, frequency, n_cases, n_domains, quality, weight, NULL::VARCHAR AS excluded FROM sh
    UNION ALL SELECT case_id, type, value, NULL, NULL, NULL, NULL, NULL, NULL, 'common_signal_across_' || n_domains || '_corpus_domains' FROM mt WHERE n_domains > 3
    UNION ALL SELECT DISTINCT case_id, type, value, NULL, NULL, NULL, NULL, NULL, NULL, 'common_asset_provider' FROM us WHERE type = 'external_asset_url' AND value LIKE '%//cdnjs.cloudflare.com/%'
    UNION ALL SELECT DISTINCT case_id, type, value, NULL, NULL, NULL, NULL, NULL, NULL, 'generic_referral_signal' FROM us WHERE type = 'referral' AND length(regexp_extract(value, '=(.*)$', 1)) < 4""",
)
REASONS = f"""{SHARED}, re AS (SELECT case_id, other_case AS host, CASE type WHEN 'external_asset_url' THEN 'shared_exact_asset_url' ELSE 'shared_' || type END AS reason, value, quality, weight,
  (SELECT string_agg(DISTINCT page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) FROM sig g WHERE g.type = sh.type AND g.value = sh.value AND g.case_id IN (sh.case_id, sh.other_case)) AS pages, (SELECT count(DISTINCT url) FROM sig g WHERE g.type = sh.type AND g.value = sh.value AND g.case_id IN (sh.case_id, sh.other_case)) AS n_urls FROM sh)"""
_reasons = lambda s, d: cases.candidate_reasons(_shared(s, d), _signals(s, d))
register(
    "candidate_reasons",
    lambda s, d: _reasons(s, d).withColumn("pages", F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), ",")).withColumn("n_urls", F.size("urls").cast("long")).drop("urls"),
    f"WITH {REASONS} SELECT * FROM re",
)


def _scores(s, d):
    """Scores over shared signals, outward links, redirects and search results of the same cases."""
    from sightline.plans import lead_queries as lq  # which imports this module

    link = leads.external_link_candidates(markup.anchor_links(markup.anchors(b.nodes(s, d))).select("page_id", "case_id", "target"), b.pages(s, d).select("case_id", F.col("case_id").alias("host")))
    found = {"external_link": link, "external_redirect": leads.redirect_candidates(lq._redirects(s, d), lq._sources(s, d)), "external_discovery": leads.search_candidates(leads.parse_search_results(lq._responses(s, d), 3), lq._sources(s, d))}
    every = [rows.filter("excluded is null").select("case_id", "host", F.lit(reason).alias("reason"), "weight").distinct() for reason, rows in found.items()]
    return cases.candidate_scores(reduce(DataFrame.unionByName, every, _reasons(s, d).select("case_id", "host", "reason", "weight")))


SCORES = f"""{REASONS}, lk AS (SELECT DISTINCT case_id, {THOST} AS host, 'external_link' AS reason, 10 AS weight FROM anchors WHERE target IS NOT NULL AND {THOST} <> case_id AND NOT regexp_matches({THOST}, '(^|[.])(t[.]me|wa[.]me|whatsapp[.]com)$')),
  spg AS (SELECT page_id, url, {HOST} AS h FROM pages), so AS (SELECT a.page_id, a.h AS case_id, x.h AS host, x.page_id - a.page_id AS step FROM spg a JOIN spg x ON x.page_id IN (a.page_id + 1, a.page_id + 2)),
  rd AS (SELECT DISTINCT case_id, host, 'external_redirect' AS reason, 30 AS weight FROM so WHERE step = 2 AND host <> case_id AND page_id % 5 <> 0 AND page_id % 7 <> 0),
  sk AS (SELECT case_id, host, row_number() OVER (PARTITION BY case_id ORDER BY page_id, obj) AS n, obj FROM (SELECT case_id, page_id, host, 1 AS obj FROM so WHERE step = 1 UNION ALL SELECT case_id, page_id, NULL, 0 FROM so WHERE step = 1 AND page_id % 3 = 1)), sd AS (SELECT DISTINCT case_id, host, 'external_discovery' AS reason, 5 AS weight FROM sk WHERE n <= 3 AND obj = 1 AND host <> case_id),
  sc AS (SELECT case_id, host, least(100, sum(w))::BIGINT AS score FROM (SELECT case_id, host, reason, max(weight) AS w FROM (SELECT case_id, host, reason, weight FROM re UNION ALL SELECT * FROM lk UNION ALL SELECT * FROM rd UNION ALL SELECT * FROM sd) GROUP BY ALL) GROUP BY case_id, host)"""
register("candidate_scores", _scores, f"WITH {SCORES} SELECT * FROM sc")
register("ranked_candidates", lambda s, d: cases.ranked_candidates(_scores(s, d)), f"WITH {SCORES} SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, host) AS place FROM sc")
_RELATION = "CASE observation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.RELATIONS.items()) + " END"
register(
    "exact_cross_case_matches",
    lambda s, d: cases.cross_case_matches(semantic(s, d).join(b.pages(s, d).select("page_id", "case_id"), "page_id")),
    f"""WITH {SEMANTIC}, ob AS (SELECT {HOST} AS case_id, {_RELATION} AS relation, observation_type AS t, value, page_id, 'observation-' || printf('%04d', place) AS o FROM sem JOIN pages USING (page_id)),
    m AS (SELECT a.case_id, x.case_id AS other_case, a.relation, a.value, max((a.page_id, a.o)) AS l FROM ob a JOIN (SELECT DISTINCT case_id, t, value FROM ob) x ON a.t = x.t AND a.value = x.value AND a.case_id <> x.case_id WHERE a.relation IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY other_case, relation, value) AS place FROM m) SELECT case_id, other_case, relation, value, l[1] AS page_id, l[2] AS observation_id, place FROM r WHERE place <= 12""",
)


def _known(s, d):
    pages = b.pages(s, d)
    known = pages.select(urls.bare_host(F.col("url")).alias("host"), "case_id", F.col("page_id").alias("seen"))
    return cases.known_host_match(pages.select("page_id", urls.bare_host(F.col("url")).alias("host")), known)


register("known_host_match", _known, f"WITH h AS (SELECT page_id, {HOST} AS case_id, regexp_replace({HOST}, '^www\\.', '') AS host FROM pages) SELECT page_id, host, arg_max(case_id, page_id) OVER (PARTITION BY host) AS known_case FROM h")


def _host_pairs(s, d):
    """Hosts whose pages follow each other: each pair of hosts of page n and page n + 1, once, in order of name."""
    pages = b.pages(s, d).select("page_id", F.col("case_id").alias("x"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("x").alias("y"))
    return pages.join(after, "page_id").filter("x <> y").select(F.least("x", "y").alias("left_case"), F.greatest("x", "y").alias("right_case")).distinct()


HOSTPAIRS = f"hp AS (SELECT DISTINCT least(x, y) AS left_case, greatest(x, y) AS right_case FROM (SELECT page_id, {HOST} AS x FROM pages) JOIN (SELECT page_id - 1 AS page_id, {HOST} AS y FROM pages) USING (page_id) WHERE x <> y)"
register(
    "page_pairs",
    lambda s, d: cases.page_pairs(b.pages(s, d), _host_pairs(s, d)),
    f"""WITH {HOSTPAIRS}, r AS (SELECT {HOST} AS case_id, page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS place FROM pages),
    l AS (SELECT left_case, right_case, place, page_id AS left_page FROM hp JOIN r ON left_case = case_id), q AS (SELECT left_case, right_case, place, page_id AS right_page FROM hp JOIN r ON right_case = case_id)
    SELECT * FROM l FULL JOIN q USING (left_case, right_case, place)""",
)
def _frontier(s, d):
    p = policy.frontier_priority(F.col("label"), F.col("crawl_url"))
    depth = (F.col("page_id") > F.min("page_id").over(W.partitionBy("case_id"))).cast("int")
    rows = b.anchors(s, d).join(b.pages(s, d).select("page_id", depth.alias("depth")), "page_id").withColumn("crawl_url", urls.crawl_url(F.col("href"), F.col("url"))).withColumn("host", urls.host(F.col("crawl_url")))
    return rows.withColumn("score", p["score"])


FRONTIER = (
    f"{ANCHORS}, f0 AS (SELECT case_id, page_id, elem_ord, href, label, CASE WHEN href LIKE '%u:p@%' THEN NULL ELSE crawl_url END AS crawl_url, CASE "
    + " ".join(f"WHEN regexp_matches({_MATERIAL}, '{p}') THEN {k}" for p, k, _ in policy.FRONTIER_CLASSES)
    + " ELSE 4 END AS score FROM anchors), f1 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, crawl_url ASC NULLS LAST, href, label, elem_ord) AS nth FROM f0)"
)
register(
    "frontier_admission",
    lambda s, d: cases.frontier_admission(_frontier(s, d)).select("case_id", "page_id", "elem_ord", "decision"),
    f"""WITH {FRONTIER}, dp AS (SELECT page_id, page_id > min(page_id) OVER (PARTITION BY {HOST}) AS deep FROM pages),
    f2 AS (SELECT f1.*, CASE WHEN nth > 200 THEN 'frontier_limit' WHEN crawl_url IS NULL THEN 'malformed_url' WHEN deep THEN 'depth_limit' WHEN regexp_extract(crawl_url, '^[a-z]+://([^/?#:]*)', 1) <> case_id THEN 'external_host' WHEN contains(crawl_url, ':8443') THEN 'unsafe_destination' END AS early FROM f1 JOIN dp USING (page_id)),
    f3 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY page_id, nth) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY case_id, crawl_url ORDER BY page_id, nth) AS k FROM f2 WHERE early IS NULL) WHERE k = 1)
    SELECT f2.case_id, f2.page_id, f2.elem_ord, coalesce(early, CASE WHEN rk > 5 THEN 'page_budget' WHEN f3.elem_ord = f2.elem_ord AND f3.page_id = f2.page_id THEN 'queued' ELSE 'duplicate_url' END) AS decision FROM f2 LEFT JOIN f3 USING (case_id, crawl_url)""".replace("SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY page_id, nth) AS rk", "SELECT case_id, crawl_url, page_id, elem_ord, row_number() OVER (PARTITION BY case_id ORDER BY page_id, nth) AS rk"),
)
register(
    "ranked_frontier",
    lambda s, d: cases.ranked_frontier(_frontier(s, d).withColumn("method", F.lit("html_anchor"))).select("page_id", "href", "label", "place"),
    f"WITH {FRONTIER} SELECT page_id, href, label, row_number() OVER (PARTITION BY page_id ORDER BY score, crawl_url, href, label) AS place FROM (SELECT DISTINCT page_id, href, crawl_url, label, score FROM f0)",
)
def _pairs(rows, key):
    return rows.filter(F.col(key) % 2 == 0).select(F.col(key).alias("left"), (F.col(key) + 1).alias("right"))


register(
    "text_similarity",
    lambda s, d: sim.text_similarity(_pairs(b.texts(s, d), "page_id"), ob.text_vectors(b.texts(s, d))).select("left", "right", F.round("similarity", 6).alias("similarity"), "low_information"),
    r"""WITH t AS (SELECT id, token, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\pL\pM\pN_]{2,}')) AS token FROM documents) GROUP BY ALL), q AS (SELECT id, sum(n * n) AS sq, sum(n) AS total FROM t GROUP BY id),
    p AS (SELECT doc_id AS l, doc_id + 1 AS r FROM documents WHERE doc_id % 2 = 0), dt AS (SELECT l, r, sum(a.n * b.n) AS dot FROM p JOIN t a ON a.id = l JOIN t b ON b.id = r AND a.token = b.token GROUP BY l, r)
    SELECT p.l AS "left", p.r AS "right", round(coalesce(dot / (sqrt(x.sq) * sqrt(y.sq)), 0), 6) AS similarity, coalesce(x.total, 0) < 6 OR coalesce(y.total, 0) < 6 AS low_information FROM p LEFT JOIN q x ON x.id = p.l LEFT JOIN q y ON y.id = p.r LEFT JOIN dt ON dt.l = p.l AND dt.r = p.r""",
)
_dom = lambda s, d: sim.dom_similarity(_pairs(b.pages(s, d), "page_id"), html.dom_features_of(b.nodes(s, d)).select(F.col("page_id").alias("id"), F.col("pair").alias("item")))
DOM = rf"""{WEB}, de AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[a-z][a-z0-9]*[^>]*>'), lambda t: regexp_extract(t, '<([a-z0-9]+)', 1) || '[' || array_to_string(list_sort(regexp_extract_all(t, ' ([a-z-]+)=', 1)), ',') || ']') AS l FROM web),
  df AS (SELECT page_id, len(l) AS n, list_distinct(list_transform(range(1, len(l)), lambda k: l[k] || '>' || l[k + 1])) AS x FROM de),
  dm AS (SELECT a.page_id AS l, a.page_id + 1 AS r, len(list_intersect(a.x, coalesce(b.x, []))) AS shared, len(a.x) + len(coalesce(b.x, [])) - len(list_intersect(a.x, coalesce(b.x, []))) AS united, CASE WHEN b.n IS NULL THEN 'not_applicable' WHEN least(a.n, b.n) < 3 THEN 'low_information' ELSE 'scored' END AS status FROM df a LEFT JOIN df b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0)"""
register("dom_similarity", lambda s, d: _dom(s, d).select("left", "right", "shared", "united", F.round("similarity", 6).alias("similarity"), "status"), f"WITH {DOM} SELECT l AS \"left\", r AS \"right\", shared, united, round(CASE WHEN status = 'scored' THEN shared / united ELSE 0 END, 6) AS similarity, status FROM dm")
register(
    "entity_similarity",
    lambda s, d: sim.entity_similarity(_host_pairs(s, d).select(F.col("left_case").alias("left"), F.col("right_case").alias("right")), _entities(s, d).filter(~((F.col("type") == "referral") & policy.is_generic_referral(F.col("value")))).select(F.col("case_id").alias("id"), "type", F.col("value").alias("item"))).select("left", "right", "n_types", F.round("similarity", 6).alias("similarity")),
    f"""WITH {USABLE}, {HOSTPAIRS}, v AS (SELECT DISTINCT case_id, type, value FROM us WHERE NOT (type = 'referral' AND length(regexp_extract(value, '=(.*)$', 1)) < 4)),
    l AS (SELECT left_case, right_case, type, value, 1 AS k FROM hp JOIN v ON left_case = case_id UNION ALL SELECT left_case, right_case, type, value, 2 FROM hp JOIN v ON right_case = case_id),
    j AS (SELECT left_case, right_case, type, count(*) FILTER (k = 3) / count(*) AS jaccard FROM (SELECT left_case, right_case, type, value, sum(k) AS k FROM l GROUP BY ALL) GROUP BY ALL)
    SELECT hp.left_case AS "left", hp.right_case AS "right", count(jaccard) AS n_types, round(coalesce(avg(jaccard), 0), 6) AS similarity FROM hp LEFT JOIN j USING (left_case, right_case) GROUP BY 1, 2""",
)


def _hashes(s, d):
    return sim.average_hash(read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


HASH = """hs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x::DOUBLE >= m)::INT) AS bits, list_reduce(list_prepend(0::DOUBLE, list_transform(embedding, lambda x: (x::DOUBLE - m) * (x::DOUBLE - m))), lambda a, x: a + x) / len(embedding) AS variance
  FROM (SELECT vec_id, embedding, list_reduce(list_prepend(0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE)), lambda a, x: a + x) / len(embedding) AS m FROM embeddings)),
  hv AS (SELECT a.id AS l, a.id + 1 AS r, CASE WHEN b.id IS NULL THEN 'not_applicable' WHEN least(a.variance, b.variance) < 0.0001 THEN 'low_information' ELSE 'scored' END AS status, CASE WHEN b.id IS NULL OR least(a.variance, b.variance) < 0.0001 THEN 0 ELSE 1 - list_sum(list_transform(range(1, len(a.bits) + 1), lambda k: (a.bits[k] <> b.bits[k])::INT)) / len(a.bits) END AS v
  FROM hs a LEFT JOIN hs b ON b.id = a.id + 1 WHERE a.id % 2 = 0)"""
_bits = lambda w, k: F.lpad(F.bin(w), F.least(F.lit(64), F.col("n_bits") - k * 64), F.lit("0"))
register("average_hash", lambda s, d: _hashes(s, d).select("id", F.array_join(F.transform("words", _bits), "").alias("bits"), "n_bits", F.round("variance", 6).alias("variance")), f"WITH {HASH} SELECT id, array_to_string(bits, '') AS bits, len(bits)::INT AS n_bits, round(variance, 6) AS variance FROM hs")
_visual = lambda s, d: sim.hash_similarity(_pairs(_hashes(s, d), "id"), _hashes(s, d))
register("hash_similarity", lambda s, d: _visual(s, d).select("left", "right", F.round("similarity", 6).alias("similarity"), "status"), f"""WITH {HASH} SELECT l AS "left", r AS "right", round(v, 6) AS similarity, status FROM hv""")


def _mirror(s, d):
    """Pairs of neighbouring pages over the entities, text, markup and assets of these pages and the vectors of the same number."""
    pairs, nodes = _pairs(b.pages(s, d), "page_id"), b.nodes(s, d)
    ids = entities(s, d).select(F.col("page_id").alias("id"), "type", F.col("value").alias("item"))
    entity = sim.entity_similarity(pairs, ids.filter(F.col("type").isin("telegram", "whatsapp_or_phone", "referral")))
    asset = sim.set_similarity(pairs, ids.filter("type = 'external_asset_url'"))
    text = sim.text_similarity(pairs, ob.text_vectors(html.text_of(nodes)))
    scored = lambda test: F.when(test, "scored").otherwise("not_applicable").alias("status")
    part = lambda rows, name, status: rows.select("left", "right", F.lit(name).alias("name"), "similarity", status)
    parts = [part(entity, "entity", scored(F.col("n_types") > 0)), part(asset, "asset", scored(F.col("united") > 0)), part(text, "text", F.when(F.col("low_information"), "low_information").otherwise("scored").alias("status")), part(_dom(s, d), "dom", F.col("status")), part(_visual(s, d), "visual", F.col("status"))]
    return sim.mirror_score(pairs, reduce(DataFrame.unionByName, parts))


register(
    "mirror_score",
    _mirror,
    rf"""WITH {ENTITIES}, {DOM.replace(WEB + ", ", "")}, {HASH}, pp AS (SELECT page_id AS l, page_id + 1 AS r FROM pages WHERE page_id % 2 = 0),
    ej AS (SELECT l, r, type, count(*) FILTER (k = 3) / count(*) AS j FROM (SELECT l, r, type, value, sum(k) AS k FROM (SELECT l, r, type, value, 1 AS k FROM pp JOIN en ON page_id = l UNION ALL SELECT l, r, type, value, 2 FROM pp JOIN en ON page_id = r) WHERE type IN ('telegram', 'whatsapp_or_phone', 'referral', 'external_asset_url') GROUP BY ALL) GROUP BY ALL),
    tk AS (SELECT page_id, token, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\pL\pM\pN_]{{2,}}')) AS token FROM tx) GROUP BY ALL), tq AS (SELECT page_id, sum(n * n) AS sq, sum(n) AS total FROM tk GROUP BY page_id),
    td AS (SELECT l, r, sum(a.n * b.n) AS dot FROM pp JOIN tk a ON a.page_id = l JOIN tk b ON b.page_id = r AND a.token = b.token GROUP BY l, r),
    cm AS (SELECT l, r, 0 AS k, 'entity' AS name, 0.30 AS w, avg(j) AS v, 'scored' AS status FROM ej WHERE type <> 'external_asset_url' GROUP BY l, r
      UNION ALL SELECT pp.l, pp.r, 1, 'text', 0.20, coalesce(dot / (sqrt(x.sq) * sqrt(y.sq)), 0), CASE WHEN coalesce(x.total, 0) < 6 OR coalesce(y.total, 0) < 6 THEN 'low_information' ELSE 'scored' END FROM pp LEFT JOIN tq x ON x.page_id = pp.l LEFT JOIN tq y ON y.page_id = pp.r LEFT JOIN td ON td.l = pp.l AND td.r = pp.r
      UNION ALL SELECT l, r, 2, 'dom', 0.20, CASE WHEN status = 'scored' THEN shared / united ELSE 0 END, status FROM dm UNION ALL SELECT l, r, 3, 'visual', 0.20, v, status FROM hv UNION ALL SELECT l, r, 4, 'asset', 0.10, j, 'scored' FROM ej WHERE type = 'external_asset_url'),
    nm AS (SELECT l, r, k, name FROM pp, (VALUES (0, 'entity'), (1, 'text'), (2, 'dom'), (3, 'visual'), (4, 'asset')) v(k, name))
    SELECT nm.l AS "left", nm.r AS "right", round(100 * sum(CASE WHEN status = 'scored' THEN v * w ELSE 0 END), 2) AS score, coalesce(string_agg(CASE WHEN status IS NULL OR status <> 'scored' THEN nm.name || ' ' || coalesce(status, 'not_applicable') END, '; ' ORDER BY nm.k), '') AS warnings FROM nm LEFT JOIN cm ON nm.l = cm.l AND nm.r = cm.r AND nm.name = cm.name GROUP BY nm.l, nm.r""",
)

register(
    "snapshot_diff",
    lambda s, d: cases.snapshot_diff(b.anchors(s, d).select(F.col("case_id").alias("host"), "page_id", F.col("href").alias("value"))).withColumns({c: F.array_join(c, " ") for c in ("first_added", "first_removed")}),
    f"""WITH {ANCHORS}, c AS (SELECT DISTINCT case_id AS host, page_id, href AS value FROM anchors), o AS (SELECT host, page_id, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS previous FROM (SELECT DISTINCT host, page_id FROM c)),
    n AS (SELECT o.host, o.page_id, previous, value, 1 AS nw FROM o JOIN c ON o.page_id = c.page_id WHERE previous IS NOT NULL), p AS (SELECT o.host, o.page_id, previous, value, 1 AS od FROM o JOIN c ON o.previous = c.page_id)
    SELECT host, page_id, previous, count(*) FILTER (od IS NULL) AS added, count(*) FILTER (nw IS NULL) AS removed, count(*) FILTER (od = 1 AND nw = 1) AS unchanged, array_to_string(list_sort(coalesce(list(value) FILTER (od IS NULL), []))[1:50], ' ') AS first_added,
    array_to_string(list_sort(coalesce(list(value) FILTER (nw IS NULL), []))[1:50], ' ') AS first_removed FROM n FULL JOIN p USING (host, page_id, previous, value) GROUP BY ALL""",
)


def _scopes(s, d):
    """Evaluations by label length of the hosts: the first pages of hosts are allowed, linked partner hosts are candidates, hosts of captured pages are done."""
    pages = b.pages(s, d).withColumn("evaluation", F.length("case_id") % 5)
    done = pages.select("evaluation", F.col("case_id").alias("host")).unionByName(pages.filter("page_id % 10 = 0").select("evaluation", F.lit("partner1.example.net").alias("host")))
    allowed = pages.groupBy("evaluation").agg(F.sort_array(F.collect_set("case_id")).alias("h")).select("evaluation", F.explode(F.slice("h", 1, 4)).alias("host"))
    linked = markup.anchor_links(markup.anchors(b.nodes(s, d))).join(pages.select("page_id", "evaluation"), "page_id").filter("kind = 'external_link'").select("evaluation", "host")
    return cases.scope_violations(done, allowed, linked)


register(
    "scope_violations",
    _scopes,
    f"""WITH {ANCHORS}, p AS (SELECT page_id, {HOST} AS host, length({HOST}) % 5 AS evaluation FROM pages), dn AS (SELECT evaluation, host FROM p UNION SELECT evaluation, 'partner1.example.net' FROM p WHERE page_id % 10 = 0), al AS (SELECT evaluation, unnest(list_sort(list(DISTINCT host))[1:4]) AS host FROM p GROUP BY evaluation),
    ln AS (SELECT DISTINCT evaluation, {THOST} AS host FROM anchors JOIN p USING (page_id) WHERE target IS NOT NULL AND {THOST} <> case_id)
    SELECT evaluation, 'host_out_of_scope' AS rule, host FROM (SELECT * FROM dn EXCEPT SELECT * FROM al) UNION ALL SELECT evaluation, 'candidate_was_completed', host FROM (SELECT * FROM dn INTERSECT SELECT * FROM ln)""",
)
#: Allowed values and bounds of the checked columns.
SCHEMA = {"kind": ["click", "view", "purchase", "signup"], "value": (0, 100), "sequence": (1, 60)}
register(
    "enum_violations",
    lambda s, d: cases.schema_violations(b.event_log(s, d), "event_id", SCHEMA),
    "WITH " + LOG + " SELECT event_id::VARCHAR AS id, 'kind' AS field, kind AS found FROM log WHERE kind NOT IN ('click', 'view', 'purchase', 'signup') UNION ALL SELECT event_id::VARCHAR, 'value', value::VARCHAR FROM log WHERE value NOT BETWEEN 0 AND 100 UNION ALL SELECT event_id::VARCHAR, 'sequence', sequence::VARCHAR FROM log WHERE sequence NOT BETWEEN 1 AND 60",
)
