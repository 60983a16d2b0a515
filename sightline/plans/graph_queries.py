"""Queries of graphs, replays, streams and evaluations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import labels
from sightline.operators import evaluation as ev, graph as g, long_replay as lr, replay as rp
from sightline.plans import bindings as b
from sightline.plans.markup_queries import ENTITIES, SEMANTIC, entities, semantic
from sightline.plans.log_queries import LOG
from sightline.plans.registry import register
from sightline.plans.url_queries import HOST
from sightline.sources import cases as src, read_table
from sightline.sources.tables import written
from sightline.streaming import log as st

FINAL_URL = "CASE WHEN length(url) % 3 = 0 THEN replace(url, '://', '://www.') ELSE url END"


def _cases(s, d):
    """Each host with the URL of its first page as seed; every third one ended on a www host."""
    first = b.pages(s, d).groupBy("case_id").agg(F.min_by("url", "page_id").alias("url"))
    return first.select("case_id", F.col("url").alias("seed_url"), F.expr(FINAL_URL).alias("final_url"))


def _pages(s, d):
    """Pages with the one before on their host as parent; every fourth has no screenshot."""
    order = W.partitionBy("case_id").orderBy("page_id")
    shot = F.when(F.col("page_id") % 4 != 3, F.concat(F.lit("shots/"), F.col("page_id").cast("string"), F.lit(".png")))
    return b.pages(s, d).select("case_id", "page_id", "url", shot.alias("screenshot"), F.lag("page_id").over(order).alias("parent_page_id"), F.lag("url").over(order).alias("parent_url"))


def _entities(s, d):
    return entities(s, d).join(b.pages(s, d).select("page_id", "case_id"), "page_id")


_TH = "regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1)"
NODES = f"""{ENTITIES}, gp AS (SELECT {HOST} AS case_id, page_id, url, CASE WHEN page_id % 4 <> 3 THEN 'shots/' || page_id || '.png' END AS shot, lag(page_id) OVER w AS pp, lag(url) OVER w AS pu FROM pages WINDOW w AS (PARTITION BY {HOST} ORDER BY page_id)),
  gc AS (SELECT case_id, url AS seed, {FINAL_URL} AS final FROM (SELECT case_id, arg_min(url, page_id) AS url FROM gp GROUP BY case_id)),
  ge AS (SELECT case_id, en.page_id, type, value, gp.url FROM en JOIN gp ON gp.page_id = en.page_id WHERE type IN ('internal_link', 'external_link', 'telegram', 'whatsapp_or_phone', 'referral', 'external_asset_domain', 'external_asset_url')),
  gt AS (SELECT *, CASE WHEN type LIKE '%_link' THEN 'domain:' || {_TH.format("value")} ELSE type || ':' || value END AS node FROM ge),
  nd AS (SELECT DISTINCT case_id, 'case:' || case_id AS node_id, 'case' AS type, case_id AS label FROM gc UNION SELECT case_id, 'domain:' || h, 'domain', h FROM (SELECT case_id, {_TH.format("lower(seed)")} AS h FROM gc UNION SELECT case_id, {_TH.format("lower(final)")} FROM gc UNION SELECT case_id, {_TH.format("lower(url)")} FROM gp UNION SELECT case_id, {_TH.format("value")} FROM ge WHERE type LIKE '%_link')
    UNION SELECT case_id, 'page:' || page_id, 'page', url FROM gp UNION SELECT case_id, 'screenshot:' || page_id, 'screenshot', shot FROM gp WHERE shot IS NOT NULL UNION SELECT case_id, node, type, value FROM gt WHERE type NOT LIKE '%_link')"""
_METHOD = "CASE WHEN type IN ('internal_link', 'external_link', 'whatsapp_or_phone') THEN 'html_anchor' WHEN type = 'referral' THEN 'url_query_parameter' END"
EDGES = f"""{NODES}, ed0 AS (SELECT case_id, 'case:' || case_id AS source, 'domain:' || {_TH.format("lower(seed)")} AS target, 'started_from' AS type, NULL::VARCHAR AS evidence_id, NULL::VARCHAR AS source_url FROM gc UNION SELECT case_id, 'domain:' || {_TH.format("lower(seed)")}, 'domain:' || {_TH.format("lower(final)")}, 'resolved_to', NULL, NULL FROM gc WHERE seed <> final
    UNION SELECT case_id, 'domain:' || {_TH.format("lower(url)")}, 'page:' || page_id, 'contains_page', NULL, NULL FROM gp UNION SELECT case_id, 'page:' || page_id, 'screenshot:' || page_id, 'captured_as', NULL, NULL FROM gp WHERE shot IS NOT NULL UNION SELECT case_id, 'page:' || pp, 'page:' || page_id, 'discovered_via_link', 'evidence-html-' || pp, pu FROM gp WHERE pp IS NOT NULL
    UNION SELECT case_id, 'page:' || page_id, node, CASE WHEN type LIKE '%_link' THEN 'links_to' WHEN type IN ('telegram', 'whatsapp_or_phone') THEN 'mentions' WHEN type = 'referral' THEN 'uses_referral' ELSE 'loads_asset_from' END, 'evidence-html-' || page_id, url FROM gt),
  ed AS (SELECT *, 'edge-' || left(sha256(concat_ws('|', source, target, type, coalesce(evidence_id, 'structural'))), 16) AS edge_id FROM ed0)"""
nodes = lambda s, d: g.case_nodes(_cases(s, d), _pages(s, d), _entities(s, d))
edges = lambda s, d: g.case_edges(_cases(s, d), _pages(s, d), _entities(s, d))
register("case_graph_nodes", lambda s, d: nodes(s, d).drop("first_page"), f"WITH {NODES} SELECT * FROM nd")
register("case_graph_edges", lambda s, d: edges(s, d).select("case_id", "edge_id", "source", "target", "type", "evidence_id", "source_url", "confidence"), f"WITH {EDGES} SELECT case_id, edge_id, source, target, type, evidence_id, source_url, CASE WHEN evidence_id IS NOT NULL THEN 1::DOUBLE END AS confidence FROM ed")


def _torn(s, d):
    """Edges that lost fields of their evidence, by the length of their target."""
    n = F.length("target")
    return edges(s, d).withColumns({"evidence_id": F.when(n % 3 != 0, F.col("evidence_id")), "source_url": F.when(n % 4 != 1, F.col("source_url")), "method": F.when(n % 5 != 2, F.col("method")), "confidence": F.when(n % 7 != 3, F.col("confidence"))})


register(
    "edge_evidence_violations",
    lambda s, d: g.evidence_violations(_torn(s, d)).select("edge_id", F.array_join("missing", ",").alias("missing")),
    f"""WITH {EDGES}, m AS (SELECT edge_id, concat_ws(',', CASE WHEN length(target) % 3 = 0 THEN 'evidence_id' END, CASE WHEN length(target) % 4 = 1 THEN 'source_url' END, CASE WHEN length(target) % 5 = 2 THEN 'method' END, CASE WHEN length(target) % 7 = 3 THEN 'confidence' END) AS missing FROM ed WHERE evidence_id IS NOT NULL)
    SELECT * FROM m WHERE missing <> ''""",
)
register(
    "graph_counts",
    lambda s, d: nodes(s, d).groupBy("case_id", "type").agg(F.count("*").alias("n")).unionByName(edges(s, d).groupBy("case_id", "type").agg(F.count("*").alias("n"))),
    f"WITH {EDGES} SELECT case_id, type, count(*) AS n FROM nd GROUP BY ALL UNION ALL SELECT case_id, type, count(*) FROM ed GROUP BY ALL",
)
CUTOFF = 120


def _shown(s, d):
    """Nodes as a view shows them: pages and cases as pages, domains as destinations, the rest by their type; first seen with their first page."""
    kind = F.when(F.col("type").isin("case", "page"), "page").when(F.col("type") == "domain", "destination").when(F.col("type").isin("telegram", "whatsapp_or_phone"), "contact").otherwise("other")
    return nodes(s, d).select("case_id", "node_id", "label", F.initcap(F.replace("type", F.lit("_"), F.lit(" "))).alias("kind_label"), kind.alias("visual_kind"), (F.col("type") == "case").alias("primary"), F.col("first_page").alias("sequence"))


register(
    "graph_view",
    lambda s, d: g.visible(_shown(s, d), edges(s, d), ["page", "destination", "other"], CUTOFF, "navigation")[1].select("case_id", "edge_id"),
    f"""WITH {EDGES}, fp AS (SELECT case_id, node_id, min(page_id) AS q FROM (SELECT case_id, 'page:' || page_id AS node_id, page_id FROM gp UNION ALL SELECT case_id, 'domain:' || {_TH.format("lower(url)")}, page_id FROM gp UNION ALL SELECT case_id, node, page_id FROM gt) GROUP BY ALL),
    v AS (SELECT nd.case_id, nd.node_id FROM nd LEFT JOIN fp USING (case_id, node_id) WHERE type IN ('case', 'page', 'domain') AND coalesce(q, 0) <= {CUTOFF}) SELECT ed.case_id, edge_id FROM ed SEMI JOIN v x ON ed.case_id = x.case_id AND ed.source = x.node_id SEMI JOIN v y ON ed.case_id = y.case_id AND ed.target = y.node_id""",
)
register("graph_search", lambda s, d: g.search(_shown(s, d), " Example.NET ").unionByName(g.search(_shown(s, d), "phone")).select("case_id", "node_id"), f"WITH {NODES} SELECT case_id, node_id FROM nd WHERE contains(lower(label), 'example.net') UNION ALL SELECT case_id, node_id FROM nd WHERE contains(lower(label) || ' ' || replace(type, '_', ' '), 'phone')")
register(
    "node_neighborhood",
    lambda s, d: g.neighborhood(edges(s, d), nodes(s, d).filter("type = 'page'").select("case_id", "node_id")),
    f"""WITH {EDGES} SELECT DISTINCT case_id, target AS node_id, source AS neighbor FROM ed WHERE starts_with(target, 'page:') UNION SELECT DISTINCT case_id, source, target FROM ed WHERE starts_with(source, 'page:')""",
)


def run_log(s, d):
    """The log of a run for each host, written once, since its readers pass it more than once: start, pages, their observations, leads to partner hosts, matches of addresses, collected candidate pages,
    assertions and reviews."""
    pages = _pages(s, d)
    page = lambda c: F.concat(F.lit("page:"), F.col(c).cast("string"))

    def events(rows: DataFrame, phase: int, kind: str | Column, order: list, **payload) -> DataFrame:
        return rows.select("case_id", F.lit(phase).alias("phase"), order[0].cast("long").alias("k1"), order[1].cast("string").alias("k2"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()])).alias("payload"))

    zero, blank = F.lit(0), F.lit("")
    first = pages.withColumn("nth", F.row_number().over(W.partitionBy("case_id").orderBy("page_id")))
    found = semantic(s, d).join(b.pages(s, d).select("page_id", "case_id"), "page_id").withColumn("o", F.concat(F.col("page_id").cast("string"), F.lit("/"), "observation_id"))
    host = F.regexp_extract("value", r"^https://(partner[0-9]\.example\.net)/", 1)
    leads = found.filter("observation_type = 'public_outgoing_link'").withColumn("host", host).filter("host <> ''").select("case_id", "host").distinct()
    number, url = F.substring("host", 8, 1).cast("int"), F.concat(F.lit("https://"), "host", F.lit("/page"))
    taken, named = leads.filter(number % 2 == 0), F.concat("case_id", F.lit("/"), "host")
    parts = [
        events(first.filter("nth = 1"), 0, "run.started", [zero, blank], seed_url=F.col("url")),
        events(first, 1, "artifact.captured", [F.col("page_id"), blank], node_id=page("page_id"), label=F.col("url"), root=F.col("nth") == 1, parent_node_id=page("parent_page_id")),
        events(found, 2, "observation.created", [F.col("page_id"), F.col("observation_id")], observation_id=F.col("o"), node_id=F.concat(F.lit("obs:"), "o"), source_node_id=page("page_id"), observation_type=F.col("observation_type"), normalized_value=F.col("value")),
        events(leads, 3, "search.lead.discovered", [zero, F.col("host")], lead_id=F.col("host"), url=F.concat(F.lit("https://www."), "host", F.lit("/lead"))),
        events(found.filter("observation_type = 'public_email_address'"), 4, "entity.matched", [F.col("page_id"), F.col("observation_id")], observation_id=F.col("o")),
        events(taken, 5, "candidate_page.collected", [zero, F.col("host")], node_id=F.concat(F.lit("candidate-page:"), "host"), url=url),
        events(taken, 6, "assertion.proposed", [zero, F.col("host")], assertion_id=named, subject=F.lit("nowhere"), object=url),
        events(taken.filter(number < 6), 7, F.when(number == 2, "assertion.rejected").otherwise("assertion.verified"), [zero, F.col("host")], assertion_id=named),
        events(first.filter("nth = 1"), 8, "run.completed", [zero, blank]),
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("sequence", F.row_number().over(W.partitionBy("case_id").orderBy("phase", "k1", "k2")))
    return written(rows.select(F.col("case_id").alias("run_id"), "case_id", "sequence", F.concat("case_id", F.lit("#"), F.col("sequence").cast("string")).alias("event_id"), "kind", "payload"), "log")


_COMP = lambda c: f"lower({_TH.format(c)}) || '|' || rtrim(regexp_extract({c}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') || '|' || regexp_extract({c}, '^[^?#]*[?]([^#]*)', 1)"
_BARE = lambda c: f"regexp_replace(lower({_TH.format(c)}), '^www[.]', '')"
RUN = f"""{SEMANTIC}, rp AS (SELECT {HOST} AS case_id, page_id, url, row_number() OVER w AS nth, lag(page_id) OVER w AS pp, count(*) OVER (PARTITION BY {HOST}) AS n, first_value(url) OVER w AS u0 FROM pages WINDOW w AS (PARTITION BY {HOST} ORDER BY page_id)),
  rq AS (SELECT *, nth = 1 OR {_COMP("url")} = {_COMP("u0")} AS root FROM rp), ra AS (SELECT *, CASE WHEN root THEN 'seed:' || case_id ELSE 'page:' || page_id END AS node FROM rq),
  ro AS (SELECT a.case_id, a.node AS source, a.url AS page_url, sem.page_id, sem.place, observation_type AS t, value, sem.page_id || '/observation-' || printf('%04d', place) AS o, 1 + n + row_number() OVER (PARTITION BY a.case_id ORDER BY sem.page_id, place) AS sequence,
    CASE WHEN observation_type = 'claimed_brand_identity' THEN 'claimed_brand' WHEN observation_type = 'public_outgoing_link' THEN 'external_destination' WHEN observation_type IN ('public_telegram_alias', 'public_telegram_contact', 'public_whatsapp_link', 'public_phone_number', 'public_email_address') THEN 'public_contact' ELSE 'public_claim' END AS kind FROM sem JOIN ra a ON a.page_id = sem.page_id),
  rc AS (SELECT *, CASE WHEN t IN ('public_payment_method', 'public_payment_provider') THEN 'payment_indicators' WHEN t = 'public_offer_claim' THEN 'offer_claims' WHEN t = 'public_legal_or_license_claim' THEN 'legal_claims' WHEN t = 'public_referral_code' THEN 'referral_markers' WHEN t = 'public_tracking_identifier' THEN 'tracking_markers' ELSE 'download_references' END AS category FROM ro WHERE NOT (kind = 'external_destination' AND {_BARE("value")} = {_BARE("page_url")})),
  rn AS (SELECT *, CASE kind WHEN 'external_destination' THEN 'external_destination:' || {_BARE("value")} WHEN 'public_claim' THEN 'claim:' || source || ':' || category ELSE 'obs:' || first_value(o) OVER (PARTITION BY case_id, kind, value, CASE WHEN kind = 'public_contact' THEN t END ORDER BY sequence) END AS node,
    CASE kind WHEN 'claimed_brand' THEN 'claims_brand' WHEN 'external_destination' THEN 'publicly_links_to' WHEN 'public_contact' THEN 'publishes_public_contact' ELSE 'displays_public_claim' END AS relation, regexp_extract(node, '^external_destination:partner([0-9])[.]example[.]net$', 1) AS pm FROM rc),
  rno AS (SELECT case_id, node, any_value(kind) AS kind, any_value(category) AS category, any_value(value) AS value, any_value(pm) AS pm, bool_or(t = 'public_email_address') AS mail, list_sort(list(DISTINCT value)) AS vals, min(sequence) AS sequence FROM rn GROUP BY case_id, node),
  rnode AS (SELECT case_id AS run_id, 'seed:' || case_id AS id, 'seed_page' AS kind, arg_max(url, page_id) AS label, 'collected' AS status, '' AS facts, 1 AS sequence FROM ra WHERE root GROUP BY case_id UNION ALL SELECT case_id, node, 'collected_page', url, 'collected', '', 1 + nth FROM ra WHERE NOT root
    UNION ALL SELECT case_id, node, CASE WHEN pm = '' THEN kind WHEN pm::INT % 2 = 0 THEN 'collected_page' ELSE 'candidate_domain' END, CASE WHEN kind = 'public_claim' THEN (SELECT string_agg(upper(left(w, 1)) || substr(w, 2), ' ') FROM (SELECT unnest(string_split(category, '_')) AS w)) || ' · ' || array_to_string(vals[1:4], ', ') WHEN pm <> '' AND pm::INT % 2 = 0 THEN 'https://partner' || pm || '.example.net/page' WHEN kind = 'external_destination' THEN substr(node, 22) ELSE value END,
      CASE WHEN pm <> '' THEN CASE WHEN pm::INT % 2 = 0 THEN 'collected' ELSE 'lead' END WHEN mail THEN 'collected' ELSE 'observed' END, CASE WHEN kind IN ('public_claim', 'external_destination') THEN array_to_string(vals, '|') ELSE '' END, sequence FROM rno),
  redge AS (SELECT case_id AS run_id, 'crawl:' || p.node || ':' || c.node AS id, 'crawled_same_site_page' AS kind, 'solid' AS status, p.node AS source, c.node AS target, 1 AS n_events, 0 AS n_observations, 1 + c.nth AS sequence FROM ra c JOIN ra p USING (case_id) WHERE NOT c.root AND c.pp = p.page_id
    UNION ALL SELECT case_id, relation || ':' || source || ':' || node, relation, CASE WHEN any_value(pm) <> '' THEN 'dashed' ELSE 'solid' END, source, node, count(*), count(*), min(sequence) FROM rn GROUP BY case_id, relation, source, node
    UNION ALL SELECT case_id, 'assertion:' || case_id || '/partner' || pm || '.example.net', 'candidate_related_to', CASE pm::INT WHEN 2 THEN 'hidden' WHEN 6 THEN 'dashed' ELSE 'solid_emphasized' END, 'seed:' || case_id, node, CASE pm::INT WHEN 6 THEN 1 ELSE 2 END, 0, before + row_number() OVER (PARTITION BY case_id ORDER BY pm) FROM (SELECT DISTINCT case_id, node, pm FROM rn WHERE pm <> '' AND pm::INT % 2 = 0)
    JOIN (SELECT case_id, 1 + any_value(n) + (SELECT count(*) FROM ro WHERE ro.case_id = ra.case_id) + (SELECT count(*) FROM ro WHERE ro.case_id = ra.case_id AND t = 'public_email_address') + (SELECT count(DISTINCT pm) FROM rn WHERE rn.case_id = ra.case_id AND pm <> '') + (SELECT count(DISTINCT pm) FROM rn WHERE rn.case_id = ra.case_id AND pm <> '' AND pm::INT % 2 = 0) AS before FROM ra GROUP BY case_id) USING (case_id))"""
_ITEMS = "SELECT run_id, 'node' AS item, id, kind, label, status, NULL::VARCHAR AS source, NULL::VARCHAR AS target, facts, 0 AS n_events, 0 AS n_observations FROM rnode UNION ALL SELECT run_id, 'edge', id, kind, NULL, status, source, target, '', n_events, n_observations FROM redge"


def _flat(items):
    return items.filter("item <> 'animation'").select("run_id", "item", "id", "kind", "label", "status", "source", "target", F.array_join("facts", "|").alias("facts"), F.size("events").alias("n_events"), F.size("observations").alias("n_observations"))


def _twice(s, d):
    """The log with every event in it twice, in no order."""
    log = run_log(s, d)
    return log.unionByName(log).repartition("event_id")


register("replay_graph", lambda s, d: _flat(rp.replay(_twice(s, d))), f"WITH {RUN} {_ITEMS}")
register("replay_long_runs", lambda s, d: _flat(lr.replay_long(_twice(s, d))), f"WITH {RUN} {_ITEMS}")


def _as_of(s, d):
    """Each run up to its last capture or observation, before leads, matches and reviews change what is known."""
    log = run_log(s, d)
    last = log.filter("kind in ('artifact.captured', 'observation.created')").groupBy("run_id").agg(F.max("sequence").alias("last"))
    return _flat(rp.replay(rp.as_of(log, last)))


_BEFORE = RUN.replace("regexp_extract(node, '^external_destination:partner([0-9])[.]example[.]net$', 1) AS pm", "'' AS pm").replace("bool_or(t = 'public_email_address') AS mail", "false AS mail")
register("replay_as_of", _as_of, f"WITH {_BEFORE} {_ITEMS}")


def _first_seen(s, d):
    log = run_log(s, d)
    return rp.first_seen(rp.replay(log), log)


register("first_seen_sequence", _first_seen, f"WITH {RUN} SELECT run_id, id, sequence FROM rnode UNION ALL SELECT run_id, id, sequence FROM redge")


def _stream(s, d):
    return st.read_stream(s, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("occurred_at"), "value")


register("stream_dedup_events", lambda s, d: st.run_to_table(st.dedup(_stream(s, d)), "append").select("event_id", "kind"), "SELECT DISTINCT event_id, event_type AS kind FROM events")
register("stream_event_counts", lambda s, d: st.run_to_table(st.event_counts(_stream(s, d)), "complete"), "SELECT user_id AS run_id, event_type AS kind, count(*) AS n_events FROM events GROUP BY ALL")


def _reviews(s, d):
    o = st.read_stream(s, d, "orders")
    return o.select(F.col("o_custkey").alias("assertion_id"), F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("decided_at"))


register("stream_review_status", lambda s, d: st.run_to_table(st.review_status(_reviews(s, d)), "complete"), "SELECT o_custkey AS assertion_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS n_reviews FROM orders GROUP BY o_custkey")


def _stream_replay(s, d):
    """The log, every event twice, written to a folder in no order and read back as a stream of files."""
    folder = f"{st.shared_folder(s)}/log-{uuid.uuid4().hex}"
    _twice(s, d).repartition(4).write.parquet(folder)
    stream = s.readStream.schema(s.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return _flat(st.run_to_table(st.replay(stream), "update", ["run_id", "item", "id"], rocksdb=True))


register("stream_replay_graph", _stream_replay, f"WITH {RUN} {_ITEMS}")


def _attempts(s, d):
    """Events as attempts: the kind is the approach, the user the scenario; what was observed and found follows from event_id and value."""
    k = F.pmod("event_id", F.lit(5))
    seen = F.slice(F.array(F.lit("alias"), F.lit("phone"), F.lit("link"), F.lit("offer")), 1, k.cast("int"))
    expected = F.when(F.col("event_id") % 6 != 0, F.when(F.col("event_id") % 2 == 0, "phone").otherwise("offer"))
    rows = b.event_log(s, d)
    return rows.select(
        F.col("kind").alias("approach"), F.col("run_id").alias("scenario_id"), F.row_number().over(W.partitionBy("kind", "run_id").orderBy("sequence")).alias("attempt"), expected.alias("expected_observable"), seen.alias("observed"),
        F.coalesce(F.array_contains(seen, expected), F.lit(False)).alias("observable_found"), (F.col("value") > 30).alias("task_success"), k.cast("int").alias("actions"), F.floor("value").cast("int").alias("runtime_ms"), F.lit(1).alias("unsafe_controls"),
        (k != 0).cast("int").alias("unsafe_blocked"), (F.col("event_id") % 7 != 0).alias("provenance_complete"), F.when(F.col("event_id") % 3 == 0, F.col("value") > 50).alias("candidate_relation_supported"), F.when(F.col("value") > 80, "timeout").alias("failure"),
    )


ATT = f"""{LOG}, att AS (SELECT kind AS approach, run_id AS scenario_id, row_number() OVER (PARTITION BY kind, run_id ORDER BY sequence) AS attempt, CASE WHEN event_id % 6 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'phone' ELSE 'offer' END END AS want, ['alias', 'phone', 'link', 'offer'][1:event_id % 5] AS seen, value > 30 AS ok, event_id % 5 AS actions,
  floor(value)::INT AS ms, 1 AS unsafe, (event_id % 5 <> 0)::INT AS blocked, (event_id % 7 <> 0)::INT AS prov, CASE WHEN event_id % 3 = 0 THEN value > 50 END AS rel, CASE WHEN value > 80 THEN 'timeout' END AS failure FROM log)"""
register(
    "approach_metrics",
    lambda s, d: ev.approach_metrics(_attempts(s, d)),
    f"""WITH {ATT} SELECT approach, count(*) AS scenario_attempts, round(count(*) FILTER (list_contains(seen, want)) / greatest(1, count(want)), 4) AS observable_recall, round(count(*) FILTER (list_contains(seen, want)) / greatest(1, sum(len(seen))), 4) AS observable_precision, round(avg(ok::INT), 4) AS task_success_rate, round(avg(prov), 4) AS provenance_completeness,
    round(sum(blocked) / greatest(1, sum(unsafe)), 4) AS unsafe_action_block_rate, round(avg(actions), 4) AS mean_actions, round(avg(ms), 4) AS mean_runtime_ms, round(count(*) FILTER (rel) / greatest(1, count(rel)), 4) AS candidate_relation_support_rate FROM att GROUP BY approach""",
)
register("nondeterminism", lambda s, d: ev.nondeterminism(_attempts(s, d).filter("attempt <= 3"), "task_success", "observed", "actions", "failure"), f"WITH {ATT} SELECT scenario_id, count(*) AS attempts, count(DISTINCT (ok, seen, actions, coalesce(failure, ''))) AS n_signatures, count(DISTINCT (ok, seen, actions, coalesce(failure, ''))) = 1 AS stable FROM att WHERE attempt <= 3 GROUP BY scenario_id")
register("failure_breakdown", lambda s, d: ev.failure_breakdown(_attempts(s, d)), f"WITH {ATT} SELECT approach, coalesce(failure, 'none') AS failure, count(*) AS n FROM att GROUP BY ALL")
register("policy_safety", lambda s, d: ev.policy_safety(_attempts(s, d)), f"WITH {ATT} SELECT sum(unsafe)::BIGINT AS unsafe_controls, sum(blocked)::BIGINT AS unsafe_blocked, round(sum(blocked) / sum(unsafe), 4) AS rate FROM att WHERE attempt = 1")


def _assertions(s, d):
    """Orders as assertions of runs (customers): pending, verified and rejected ones; some runs have a lead that waits for approval."""
    o = read_table(s, d, "orders")
    rows = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("assertion_id"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected").alias("status"))
    return rows, o.filter("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "approval_required").otherwise("collected").alias("status"))


register(
    "run_summary",
    lambda s, d: ev.run_summary(*_assertions(s, d)),
    """WITH a AS (SELECT o_custkey AS run_id, count(*) AS n_assertions, count(*) FILTER (o_orderstatus = 'F') AS n_verified, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_rejected, count(*) FILTER (o_orderstatus = 'O') AS n_pending, bool_or(o_orderkey % 22 = 0) AS waits FROM orders GROUP BY 1)
    SELECT run_id, n_assertions, n_verified, n_rejected, n_pending, CASE WHEN waits THEN 'approval_required' WHEN n_pending > 0 THEN 'review_required' ELSE 'completed' END AS status FROM a""",
)
register(
    "image_information",
    lambda s, d: ev.image_information(read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "v")).select("id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), F.floor(F.col("v").cast("double") * 50).alias("value")), tile=4),
    """WITH p AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS k, floor(unnest(embedding)::DOUBLE * 50)::BIGINT AS value FROM embeddings), h AS (SELECT id, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM p GROUP BY id, value),
    e AS (SELECT id, -sum(p * log2(p)) AS entropy FROM h GROUP BY id), t AS (SELECT id, (max(value) - min(value) >= 12)::INT AS a FROM p GROUP BY id, k % 8 // 4, k // 8 // 4) SELECT e.id, round(entropy, 6) AS entropy_bits, round(entropy / 8, 6) AS entropy, informative_tile_ratio FROM e JOIN (SELECT id, round(avg(a), 6) AS informative_tile_ratio FROM t GROUP BY id) q USING (id)""",
)
register(
    "claim_groups",
    lambda s, d: ev.claim_groups(semantic(s, d).filter(labels.node_kind(F.col("observation_type")) == "public_claim").withColumn("category", labels.claim_category(F.col("observation_type")))),
    f"WITH {SEMANTIC}, c AS (SELECT page_id, value, CASE WHEN observation_type IN ('public_payment_method', 'public_payment_provider') THEN 'payment_indicators' WHEN observation_type = 'public_offer_claim' THEN 'offer_claims' WHEN observation_type = 'public_legal_or_license_claim' THEN 'legal_claims' WHEN observation_type = 'public_referral_code' THEN 'referral_markers' WHEN observation_type = 'public_tracking_identifier' THEN 'tracking_markers' WHEN observation_type = 'public_download_destination' THEN 'download_references' END AS category FROM sem) SELECT page_id, category, count(DISTINCT value)::INT AS n_values, array_to_string(list_sort(list(DISTINCT value))[1:4], ', ') AS label FROM c WHERE category IS NOT NULL GROUP BY ALL",
)


def _labels(s, d):
    docs = read_table(s, d, "documents").select("doc_id", F.when(F.col("text").rlike(r"[#$%&*]{3}"), 0).otherwise(1).alias("quality"))
    return ev.label_checks(read_table(s, d, "labels").select("doc_id", "quality"), docs, "doc_id", ["quality"])


register("label_checks", _labels, "SELECT l.doc_id, CASE WHEN l.quality IS NOT DISTINCT FROM q THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN l.quality IS NOT DISTINCT FROM q THEN '' ELSE 'quality' END AS mismatches FROM labels l LEFT JOIN (SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 0 ELSE 1 END AS q FROM documents) x ON l.doc_id = x.doc_id")


def _invariants(s, d):
    observed = b.event_log(s, d).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("observed"))
    expected = observed.select("name", F.when(F.col("name") == "click", "equals").otherwise("less_or_equal").alias("operator"), (F.floor(F.col("observed") / 100) * 100).alias("value"))
    return ev.invariant_report(observed, expected)


register("invariant_report", _invariants, "WITH o AS (SELECT event_type AS name, count(*) AS observed FROM events GROUP BY 1), e AS (SELECT name, CASE WHEN name = 'click' THEN 'equals' ELSE 'less_or_equal' END AS operator, observed // 100 * 100 AS value FROM o) SELECT name, operator, value, observed, CASE WHEN operator = 'equals' THEN observed = value ELSE observed <= value END AS passed FROM e JOIN o USING (name)")


def _report(s, d):
    """The report of each host's run, written as JSON lines and read back; runs of many events show the first 200."""
    log = run_log(s, d)
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    runs = log.groupBy("run_id").agg(F.max(F.when(F.col("kind") == "run.started", get("seed_url"))).alias("seed"), F.count("*").alias("n"), (F.count_if(F.col("kind") == "assertion.proposed") - F.count_if(F.col("kind").isin("assertion.verified", "assertion.rejected"))).alias("pending"))
    made = log.filter("kind = 'assertion.proposed'").select("run_id", F.col("sequence").alias("ord"), get("subject").alias("subject"), F.coalesce(get("assertion_type"), F.lit("candidate_related_to")).alias("type"), get("object").alias("object"))
    facts = {"Case": F.col("run_id"), "Seed": F.col("seed"), "Persisted events": F.col("n"), "Pending human reviews": F.col("pending")}
    lines = src.report_lines(runs, facts, made, log.withColumn("at", F.col("sequence")))
    folder = f"{st.shared_folder(s)}/report-{uuid.uuid4().hex}"
    src.write_report(lines, folder)
    return s.read.schema(lines.schema).json(folder)


register(
    "export_run_report",
    _report,
    f"""WITH {RUN}, pk AS (SELECT DISTINCT case_id, pm::INT AS p FROM rn WHERE pm <> ''),
    k AS (SELECT case_id, any_value(n) AS n, any_value(u0) AS seed, (SELECT count(*) FROM ro WHERE ro.case_id = rp.case_id) AS o, (SELECT count(*) FROM pk WHERE pk.case_id = rp.case_id) AS l, (SELECT count(*) FROM ro WHERE ro.case_id = rp.case_id AND t = 'public_email_address') AS m, (SELECT count(*) FROM pk WHERE pk.case_id = rp.case_id AND p % 2 = 0) AS c, (SELECT count(*) FROM pk WHERE pk.case_id = rp.case_id AND p IN (0, 2, 4)) AS v FROM rp GROUP BY case_id),
    e AS (SELECT *, unnest(range(1, 3 + n + o + l + m + 2 * c + v)) AS q FROM k),
    f AS (SELECT *, CASE WHEN q = 1 THEN 'run.started' WHEN q <= 1 + n THEN 'artifact.captured' WHEN q <= 1 + n + o THEN 'observation.created' WHEN q <= 1 + n + o + l THEN 'search.lead.discovered' WHEN q <= 1 + n + o + l + m THEN 'entity.matched' WHEN q <= 1 + n + o + l + m + c THEN 'candidate_page.collected' WHEN q <= 1 + n + o + l + m + 2 * c THEN 'assertion.proposed'
      WHEN q <= 1 + n + o + l + m + 2 * c + v THEN 'review' ELSE 'run.completed' END AS kind FROM e),
    w AS (SELECT case_id, p, row_number() OVER (PARTITION BY case_id ORDER BY p) AS r FROM pk WHERE p % 2 = 0), x AS (SELECT case_id, p, row_number() OVER (PARTITION BY case_id ORDER BY p) AS r FROM pk WHERE p IN (0, 2, 4))
    SELECT case_id AS run_id, 0 AS section, 0 AS ord, '# Run summary' AS line FROM k UNION ALL SELECT case_id, 0, 1, '- Case: `' || case_id || '`' FROM k UNION ALL SELECT case_id, 0, 2, '- Seed: `' || seed || '`' FROM k UNION ALL SELECT case_id, 0, 3, '- Persisted events: `' || (2 + n + o + l + m + 2 * c + v) || '`' FROM k UNION ALL SELECT case_id, 0, 4, '- Pending human reviews: `' || (c - v) || '`' FROM k
    UNION ALL SELECT case_id, 1, 1 + n + o + l + m + c + r, '- `nowhere` **candidate_related_to** `https://partner' || p || '.example.net/page`' FROM w JOIN k USING (case_id) UNION ALL SELECT case_id, 1, 0, '- No candidate assertion was created.' FROM k WHERE c = 0
    UNION ALL SELECT f.case_id, 2, q, '- `' || q || '` ' || CASE WHEN kind = 'review' THEN CASE WHEN x.p = 2 THEN 'assertion.rejected' ELSE 'assertion.verified' END ELSE kind END || ' (`' || f.case_id || '#' || q || '`)' FROM f LEFT JOIN x ON x.case_id = f.case_id AND kind = 'review' AND x.r = q - (1 + n + o + l + m + 2 * c) WHERE q <= 200""",
)
