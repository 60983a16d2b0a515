"""The view of a case: what a reader sees of its package as nodes, edges and a timeline, numbered in one sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import labels, policy, urls

# How claim categories are called in a view, which types make them, and how many direct signals are shown.
CATEGORIES = {
    "public_payment_method": "Payment indicators", "public_payment_provider": "Payment indicators", "public_offer_claim": "Offer claims", "public_legal_or_license_claim": "Legal claims", "public_referral_code": "Referral markers", "public_tracking_identifier": "Tracking markers",
}
SIGNALS = ["claimed_brand_identity", *labels.CONTACTS]
MOST_SIGNALS = 18
COLUMNS = ["case_id", "item", "id", "kind", "label", "status", "source", "target", "sequence"]


def titled(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def _destinations(tables: dict[str, DataFrame], own: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, host, first (phase, id), page, redirect, known: hosts that frontier and link observations lead to, if a known case, a candidate or one with the case's brand token."""
    redirect = F.col("observation_type") == "public_redirect_target"
    found = tables["frontier"].select("case_id", F.struct(F.lit(0).alias("part"), F.col("id").alias("id")).alias("at"), F.col("normalized_url").alias("url"), "source_page_id", F.lit(False).alias("redirect"))
    seen = tables["observations"].filter(F.col("observation_type").isin("public_outgoing_link", "public_redirect_target")).select("case_id", F.struct(F.lit(1).alias("part"), F.col("id").alias("id")).alias("at"), F.col("normalized_value").alias("url"), "source_page_id", redirect.alias("redirect"))
    rows = found.unionByName(seen).withColumn("host", urls.bare_host(F.col("url"))).filter("host is not null").join(own, "case_id").filter(F.col("host") != F.col("own"))
    out = rows.groupBy("case_id", "own", "host").agg(F.min("at").alias("first"), F.min_by("source_page_id", "at").alias("page"), F.bool_or("redirect").alias("redirect"))
    mark = lambda frame, name, *keys: frame.select(*keys).distinct().withColumn(name, F.lit(True))
    out = out.join(mark(known, "known", "host"), "host", "left").join(mark(candidates, "candidate", "case_id", "host"), ["case_id", "host"], "left").na.fill(False, ["known", "candidate"])
    token = policy.brand_token(F.col("own"))
    return out.filter(F.col("known") | F.col("candidate") | ((token != "") & F.contains("host", token)))


def case_projection(tables: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """COLUMNS: nodes, edges and timeline rows of each case, from the tables of its package. ``known``: hosts of other captures.

    Pages come first, in order of their ids, the first one as seed; then destinations by their first source, then MOST_SIGNALS brand and contact observations, then claim groups of a page by their
    first observation, then screenshots; each takes the next number. An edge has its look as status. Every step is a row, and steps of a case are numbered by one window over
    a row a step, which is bounded by what a case may collect.
    """
    case = tables["case"].select("case_id", "final_url", "seed_url", "capture_adequacy")
    own = case.select("case_id", urls.bare_host(F.coalesce("final_url", "seed_url")).alias("own"))
    order = W.partitionBy("case_id").orderBy("id")
    pages = tables["pages"].select("case_id", F.col("id").alias("page"), "id", "final_url").withColumn("sequence", F.row_number().over(order).cast("long"))
    shape = pages.groupBy("case_id").agg(F.count("*").alias("n"), F.min("page").alias("root"))
    root = case.join(shape, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n"), F.concat(F.lit("page:"), F.coalesce("root", "case_id")).alias("root"), F.coalesce("final_url", "seed_url").alias("fallback"), "capture_adequacy")
    text, none = F.lit, F.lit(None).cast("string")
    known_pages = pages.select("case_id", "page", F.concat(F.lit("page:"), "page").alias("page_node"))

    # steps after the pages: (case_id, phase, at, node, kind, label, status, from page, relation, look, words of the timeline)
    def step(rows: DataFrame, phase: int, at: Column, node: Column, kind: Column, label: Column, status: Column, page: Column, relation: Column, look: Column, words: Column) -> DataFrame:
        names = {"node": node, "kind": kind, "label": label, "status": status, "from_page": page, "relation": relation, "look": look, "words": words}
        return rows.select("case_id", F.lit(phase).alias("phase"), at.alias("at"), *[v.alias(k) for k, v in names.items()])

    hosts = tables["candidates"].select("case_id", F.col("registrable_domain").alias("host"))
    to = _destinations(tables, own, known, hosts)
    kind = F.when(F.col("redirect"), "redirect_target").when(F.col("known"), "external_destination").otherwise("candidate_domain")
    links = step(to, 1, F.concat_ws("/", F.col("first.part").cast("string"), "first.id", "host"), F.concat(text("destination:"), "host"), kind, F.col("host"), F.when(F.col("known"), "collected").otherwise("lead"), F.col("page"), F.when(F.col("redirect"), "publicly redirects to").otherwise("publicly links to"), F.when(F.col("known"), "solid_emphasized").otherwise("dashed"), F.when(F.col("known"), "Saved destination matched").otherwise("Candidate lead observed"))
    seen = tables["observations"].select("case_id", "id", F.col("observation_type").alias("type"), policy.redact_entity(F.col("observation_type"), F.col("normalized_value")).alias("shown"), F.col("source_page_id").alias("page"))
    direct = seen.filter(F.col("type").isin(*SIGNALS)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= MOST_SIGNALS)
    brand = F.col("type") == "claimed_brand_identity"
    signals = step(direct, 2, F.col("id"), F.concat(text("observation:"), "id"), F.when(brand, "claimed_brand").otherwise("public_contact"), F.col("shown"), text("observed"), F.col("page"), F.when(brand, "claims brand").otherwise("publishes public contact"), text("solid"), titled(F.col("type")))
    category = labels.mapped(F.col("type"), CATEGORIES, None)
    claims = seen.withColumn("category", category).filter("category is not null").groupBy("case_id", "page", "category", "shown").agg(F.min("id").alias("id"))
    claims = claims.groupBy("case_id", "page", "category").agg(F.array_sort(F.collect_list(F.struct("id", "shown"))).alias("values"))
    claims = claims.join(root.select("case_id", "root"), "case_id").join(known_pages, ["case_id", "page"], "left").withColumn("at_page", F.coalesce("page_node", "root"))
    shown = F.array_join(F.transform(F.slice("values", 1, 4), lambda v: v["shown"]), ", ")
    groups = step(claims, 3, F.concat_ws("/", F.col("values")[0]["id"], "category"), F.concat(text("claim:"), "at_page", text(":"), F.replace(F.lower("category"), text(" "), text("-"))), text("public_claim"), F.concat("category", text(" · "), shown), text("observed"), F.col("page"), text("displays public claim"), text("solid"), F.col("category"))
    shots = step(tables["evidence"].filter(F.contains("type", text("screenshot"))), 4, F.col("id"), none, none, none, none, F.col("page_id"), none, none, titled(F.col("type")))
    steps = reduce(DataFrame.unionByName, [links, signals, groups, shots]).join(root, "case_id")
    number = F.row_number().over(W.partitionBy("case_id").orderBy("phase", "at", "node"))
    steps = steps.withColumn("sequence", (F.greatest(F.lit(2), F.col("n") + 1) + number).cast("long")).join(known_pages.withColumnRenamed("page", "from_page"), ["case_id", "from_page"], "left").withColumn("source", F.coalesce("page_node", "root"))

    def row(rows: DataFrame, item: str, **c: Column) -> DataFrame:
        return rows.select("case_id", text(item).alias("item"), *[c.get(name, none).cast("string").alias(name) for name in COLUMNS[2:8]], c["sequence"].cast("long").alias("sequence"))

    c, first = F.col, F.col("sequence") == 1
    node = F.concat(text("page:"), "page")
    pages = pages.join(root.select("case_id", "root"), "case_id")
    ends = root.join(steps.groupBy("case_id").agg(F.max("sequence").alias("last")), "case_id", "left")
    prefix = F.when(c("phase") == 1, "destination-edge:").when(c("phase") == 2, "observed:").otherwise("claim-edge:")
    out = [
        row(pages, "node", id=node, kind=F.when(first, "seed_page").otherwise("collected_page"), label=F.coalesce(policy.redact_url(c("final_url")), c("page")), status=text("collected"), sequence=c("sequence")),
        row(root.filter("n = 0"), "node", id=c("root"), kind=text("seed_page"), label=F.coalesce(policy.redact_url(c("fallback")), c("case_id")), status=text("collected"), sequence=text(1)),
        row(pages.filter(~first), "edge", id=F.concat(text("crawl:"), F.substring("root", 6, 1000), text(":"), "page"), kind=text("crawled same-site page"), status=text("solid"), source=c("root"), target=node, sequence=c("sequence")),
        row(steps.filter("phase < 4"), "node", id=c("node"), kind=c("kind"), label=c("label"), status=c("status"), sequence=c("sequence")),
        row(steps.filter("phase < 4"), "edge", id=F.concat(prefix, "source", text(":"), "node"), kind=c("relation"), status=c("look"), source=c("source"), target=c("node"), sequence=c("sequence")),
        row(root, "timeline", id=text("start"), label=text("Capture started"), target=c("root"), sequence=text(1)),
        row(pages, "timeline", id=node, label=F.when(first, "Seed page captured").otherwise("Same-site page captured"), target=node, sequence=c("sequence") + 1),
        row(steps, "timeline", id=F.concat(text("step:"), c("sequence").cast("string")), label=c("words"), target=F.when(c("phase") == 4, c("source")).otherwise(c("node")), sequence=c("sequence")),
        row(ends, "timeline", id=text("end"), label=F.when(c("capture_adequacy") == "adequate", "Capture adequate").otherwise("Capture limited"), target=c("root"), sequence=F.coalesce("last", F.greatest(F.lit(2), c("n") + 1).cast("long")) + 1),
    ]
    return reduce(DataFrame.unionByName, out)
