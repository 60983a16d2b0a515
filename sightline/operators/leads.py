"""Candidate hosts from links, redirects and search results, and what becomes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import policy, urls

# Hosts of services that everybody links to, and of shared asset providers.
COMMON_REFERENCES = ["facebook.com", "instagram.com", "linkedin.com", "t.me", "telegram.me", "twitter.com", "wa.me", "whatsapp.com", "x.com", "youtube.com"]
ASSET_PROVIDERS = [
    "ajax.googleapis.com", "bootstrapcdn.com", "cdnjs.cloudflare.com", "cloudflare.com", "cloudflareinsights.com", "cloudfront.net", "doubleclick.net", "fonts.googleapis.com",
    "fonts.gstatic.com", "google-analytics.com", "googletagmanager.com", "gstatic.com", "hotjar.com", "jsdelivr.net", "sentry.io", "unpkg.com",
]
LINK_WEIGHT, REDIRECT_WEIGHT, SEARCH_WEIGHT = 10, 30, 5


def _decision(host: Column) -> Column:
    """Why a target host is no candidate of its case; null if it is one."""
    return (
        F.when(host.isNull(), "missing_hostname")
        .when(policy.ipv4_number(host).isNotNull() | host.startswith("["), "ip_literal_candidate")
        .when(~host.contains("."), "not_registrable_domain")
        .when(F.col("own").isNotNull(), "same_observed_host_as_source")
        .when(policy.host_in(host, COMMON_REFERENCES), "common_external_reference")
    )


def _decided(rows: DataFrame, sources: DataFrame) -> DataFrame:
    rows = rows.withColumn("host", urls.host(F.col("target")))
    own = sources.select("case_id", "host").distinct().withColumn("own", F.lit(1))
    return rows.join(own, ["case_id", "host"], "left").withColumn("excluded", _decision(F.col("host"))).drop("own")


def external_link_candidates(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``links`` (case_id, target) with host, excluded (null for a candidate) and weight. ``sources`` has the hosts of each case."""
    return _decided(links, sources).withColumn("weight", F.when(F.col("excluded").isNull(), LINK_WEIGHT).otherwise(0))


def redirect_candidates(redirects: DataFrame, sources: DataFrame) -> DataFrame:
    """As for links; only redirects of top-level documents count."""
    rows = _decided(redirects, sources)
    top = F.col("is_top_level") & (F.col("resource_type") == "document")
    excluded = F.when(~top, "non_top_level_or_non_document_redirect").otherwise(F.col("excluded"))
    return rows.withColumn("excluded", excluded).withColumn("weight", F.when(F.col("excluded").isNull(), REDIRECT_WEIGHT).otherwise(0))


def orphan_redirects(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected redirects (page_id, target) that no observed redirect matches."""
    return expected.join(observed.select("page_id", "target").distinct(), ["page_id", "target"], "left_anti").withColumn("excluded", F.lit("redirect_without_evidence"))


def parse_search_results(responses: DataFrame, most: int) -> DataFrame:
    """case_id, result, place, target of JSON responses (case_id, json): of the first ``most`` results that are objects, the URL of the task and of the page."""
    rows = responses.select("case_id", F.posexplode(F.slice(F.from_json("json", "results array<string>")["results"], 1, most)).alias("k", "text")).filter(F.col("text").startswith("{"))
    rows = rows.withColumn("r", F.from_json("text", "task struct<uuid:string,url:string>, page struct<url:string>"))
    name = F.coalesce(F.nullif(F.trim("r.task.uuid"), F.lit("")), F.format_string("result-%04d", F.col("k") + 1))
    both = F.explode(F.array(F.struct(F.lit("task").alias("place"), F.col("r.task.url").alias("target")), F.struct(F.lit("page").alias("place"), F.col("r.page.url").alias("target"))))
    return rows.select("case_id", name.alias("result"), both.alias("x")).select("case_id", "result", "x.place", "x.target").filter("target is not null")


def search_warnings(responses: DataFrame, most: int) -> DataFrame:
    """case_id, warning of responses that hold more than ``most`` results, or rows among them that are no objects."""
    results = F.from_json("json", "results array<string>")["results"]
    rows = responses.select("case_id", F.size(results).alias("n"), F.size(F.filter(F.slice(results, 1, most), lambda r: ~r.startswith("{"))).alias("odd"))
    long = F.when(F.col("n") > most, F.concat(F.lit("truncated_to_"), F.lit(most), F.lit("_of_"), F.col("n")))
    odd = F.when(F.col("odd") > 0, F.concat(F.lit("ignored_rows_"), F.col("odd")))
    return rows.select("case_id", F.explode(F.array_compact(F.array(long, odd))).alias("warning"))


def search_candidates(results: DataFrame, sources: DataFrame) -> DataFrame:
    return _decided(results, sources).withColumn("weight", F.when(F.col("excluded").isNull(), SEARCH_WEIGHT).otherwise(0))


# Hosts that are never candidates.
NON_CANDIDATES = ["facebook.com", "google.com", "googleapis.com", "googletagmanager.com", "instagram.com", "livechatinc.com", "t.me", "telegram.me", "twitter.com", "wa.me", "whatsapp.com", "youtube.com"]


def lead_candidates(links: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """case_id, host, target, class, place: outgoing links (case_id, source_host, target, ord) to new hosts that hold the source's brand token, the
    first link of each host, ordered by ``policy.target_class`` and target, ``most`` at most. Known and non-candidate hosts are left out."""
    rows = links.withColumns({"host": urls.bare_host(F.col("target")), "source": F.regexp_replace("source_host", r"^www\.", "")})
    rows = rows.withColumn("token", policy.brand_token(F.col("source"))).filter((F.col("host") != F.col("source")) & (F.col("token") != "") & F.contains("host", F.col("token")))
    first = rows.groupBy("case_id", "host", "source", "token").agg(F.min_by("target", "ord").alias("target"))
    new = first.filter(~policy.host_in(F.col("host"), NON_CANDIDATES)).join(known.select("host").distinct(), "host", "left_anti")
    new = new.withColumn("class", policy.target_class(F.col("host"), F.col("source"), F.col("token")))
    place = F.row_number().over(W.partitionBy("case_id").orderBy("class", "target"))
    return new.withColumn("place", place).filter(F.col("place") <= most).select("case_id", "host", "target", "class", "place")


def frontier_promotion(links: DataFrame, known: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, host, target, known, confidence, strength, limitation of frontier links (case_id, page_id, target) to a known host, or to one with the brand
    token of their case, whose page (page_id, tier, screenshot) has a screenshot; own and non-candidate hosts are left out."""
    rows = links.withColumns({"host": urls.bare_host(F.col("target")), "own": F.regexp_replace("case_id", r"^www\.", "")})
    rows = rows.filter(F.col("host").isNotNull() & (F.col("host") != F.col("own")) & ~policy.host_in(F.col("host"), NON_CANDIDATES))
    rows = rows.join(known.select("host").distinct().withColumn("known", F.lit(True)), "host", "left").na.fill(False, ["known"])
    token = policy.brand_token(F.col("own"))
    rows = rows.filter(F.col("known") | ((token != "") & F.contains("host", token))).join(pages.filter("screenshot is not null").select("page_id", "tier"), "page_id")
    sure = F.col("tier") == "verified"
    limit = F.when(~sure, "direct_anchor_from_provisional_or_withheld_semantic_capture")
    return rows.select("page_id", "host", "target", "known", F.when(sure, 0.9).otherwise(0.75).alias("confidence"), F.when(sure, "strong").otherwise("moderate").alias("strength"), limit.alias("limitation"))


def destination_projection(sources: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, host, kind, status, url, urls, n_sources, redirect, known of the destinations of a case: its frontier and link observations (case_id, ord, target, redirect)
    by host. Own hosts, and those that are neither known, nor candidates (case_id, host), nor of the case's brand token, are left out. url is the first one."""
    rows = sources.withColumns({"host": urls.bare_host(F.col("target")), "own": F.regexp_replace("case_id", r"^www\.", "")}).filter("host is not null and host <> own")
    out = rows.groupBy("case_id", "own", "host").agg(F.min_by("target", "ord").alias("url"), F.array_sort(F.collect_set("target")).alias("urls"), F.count("*").alias("n_sources"), F.bool_or("redirect").alias("redirect"))
    out = out.join(known.select("host").distinct().withColumn("known", F.lit(True)), "host", "left").join(candidates.select("case_id", "host").distinct().withColumn("candidate", F.lit(True)), ["case_id", "host"], "left").na.fill(False, ["known", "candidate"])
    token = policy.brand_token(F.col("own"))
    kept = out.filter(F.col("known") | F.col("candidate") | ((token != "") & F.contains("host", token)))
    kind = F.when(F.col("redirect"), "redirect_target").when(F.col("known"), "external_destination").otherwise("candidate_domain")
    return kept.select("case_id", "host", kind.alias("kind"), F.when(F.col("known"), "collected").otherwise("lead").alias("status"), "url", "urls", "n_sources", "redirect", "known")


# Below these a capture says nothing, or its pixels do not show its text; and what makes a capture inadequate.
LOW_CHARS, LOW_TILES = 24, 0.01
MISMATCHES = [(80, 0.01), (1000, 0.10)]
MAX_HTML_BYTES, MAX_EXTRACTED_BYTES = 5_000_000, 2_000_000


def low_information() -> Column:
    """Of a checkpoint (n_chars, n_links, n_images, n_iframes, n_canvases, tile_ratio): next to nothing to see."""
    nothing = F.lit(True)
    for c in ("n_links", "n_images", "n_iframes", "n_canvases"):
        nothing = nothing & (F.col(c) == 0)
    return (F.col("n_chars") < LOW_CHARS) & nothing & (F.col("tile_ratio") < LOW_TILES)


def visual_dom_mismatch() -> Column:
    """Of a checkpoint: text that its pixels do not show."""
    return reduce(lambda x, y: x | y, [(F.col("n_chars") >= n) & (F.col("tile_ratio") < r) for n, r in MISMATCHES])


def capture_adequacy(last: DataFrame, max_html_bytes: int = MAX_HTML_BYTES) -> DataFrame:
    """``last`` with adequacy and limitations (array, in fixed order) of a page's last checkpoint: also html_bytes, changed (whether rendering
    still changed), navigation_status."""
    limits = F.array_compact(F.array(
        F.when(F.col("changed"), F.lit("rendering_changed_at_budget_end")), F.when(low_information(), F.lit("low_information_capture")),
        F.when(visual_dom_mismatch(), F.lit("visual_dom_mismatch")), F.when(F.col("html_bytes") > max_html_bytes, F.lit("canonical_html_exceeds_5_mb_persistence_limit")),
    ))
    rows = last.withColumn("limitations", limits)
    return rows.withColumn("adequacy", F.when(F.col("navigation_status") != "captured", "failed").when(F.size("limitations") > 0, "limited").otherwise("adequate"))


def extraction_tier(rows: DataFrame, max_html_bytes: int = MAX_HTML_BYTES, max_bytes: int = MAX_EXTRACTED_BYTES) -> DataFrame:
    """``rows`` (access_outcome, content_usable and the columns of ``capture_adequacy``, n_words) with tier (verified, provisional, none) and skip_reason."""
    content = F.coalesce(F.col("content_usable") & (F.col("access_outcome") == "content"), F.lit(False))
    kept, small = F.col("html_bytes") <= max_html_bytes, F.col("html_bytes") <= max_bytes
    barred = F.arrays_overlap("limitations", F.array(F.lit("visual_dom_mismatch"), F.lit("low_information_capture")))
    some = (F.col("adequacy") == "limited") & (F.col("n_chars") >= 80) & ((F.col("tile_ratio") >= 0.02) | (F.col("n_words") >= 15)) & ~barred
    tier = F.when(content & kept & small & (F.col("adequacy") == "adequate"), "verified").when(content & kept & small & some, "provisional").otherwise("none")
    reason = (
        F.when(F.coalesce(F.col("access_outcome"), F.lit("")) != "content", "access_outcome_is_not_content")
        .when(~kept, "canonical_html_not_persisted")
        .when(~small, "direct_extractor_input_exceeds_2_mb")
        .when(F.col("adequacy") != "adequate", "capture_adequacy_is_not_adequate")
    )
    return rows.withColumn("tier", tier).withColumn("skip_reason", F.when(F.col("tier") == "none", reason))


def tier_adjustment(rows: DataFrame) -> DataFrame:
    """``rows`` (tier, by_ocr, confidence, method, limitations of the observation, capture_limitations) with confidence capped (.85 provisional,
    .72 by OCR), the method marked, and the limitations that follow."""
    ocr, provisional = F.col("by_ocr"), (F.col("tier") == "provisional") & ~F.col("by_ocr")
    more = F.when(ocr, F.array(F.lit("provisional_observation_from_local_ocr"), F.lit("ocr_text_requires_human_visual_confirmation"))).when(provisional, F.concat(F.array(F.lit("provisional_observation_from_limited_capture")), "capture_limitations")).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "confidence": F.least("confidence", F.when(ocr, 0.72).when(provisional, 0.85).otherwise(1.0)), "method": F.when(ocr, F.concat(F.lit("ocr_"), "method")).otherwise(F.col("method")),
        "limitations": F.concat("limitations", more),
    })


def corpus_exclusions(cases: DataFrame) -> DataFrame:
    """case_id, reason: one reason, by precedence, for each case (case_id, url, completed, usable, intact) left out."""
    nth = F.row_number().over(W.partitionBy("case_id").orderBy("record"))
    host = urls.host(F.col("url"))
    reason = (
        F.when(F.col("url").isNull(), "malformed")
        .when(nth > 1, "duplicate_id")
        .when(~F.col("completed"), "not_completed")
        .when(host.isNull() | policy.ipv4_number(host).isNotNull(), "no_registrable_target")
        .when(~F.col("usable"), "no_usable_html")
        .when(~F.col("intact"), "modified_artifact")
    )
    return cases.withColumn("reason", reason).filter("reason is not null")


def verify_artifacts(evidence: DataFrame, artifacts: DataFrame, max_bytes: int = 5_000_000) -> DataFrame:
    """id, state: ok, missing, too_large or modified, from the recorded hash and the content (as read by ``sources.read_artifacts`` or
    ``read_stored_artifacts``). Contents are hashed where they are read, so only hashes and sizes are moved."""
    small = F.octet_length("content") <= max_bytes
    stored = artifacts.select("id", F.lit(True).alias("there"), small.alias("small"), F.when(small, F.sha2("content", 256)).alias("own"))
    rows = evidence.join(stored, "id", "left")
    state = F.when(F.col("there").isNull(), "missing").when(~F.col("small"), "too_large").when(F.col("own") != F.col("sha256"), "modified").otherwise("ok")
    return rows.select("id", state.alias("state"))


def ocr_line_regions(words: DataFrame, scale_x: float, scale_y: float, most: int = 500) -> DataFrame:
    """Line regions of OCR words (page_id, block, par, line, word, left, top, width, height, conf, text): blank text, low
    confidence and empty boxes are dropped; boxes are united and rescaled; the first lines of each page stay."""
    good = words.filter((F.trim("text") != "") & (F.col("conf") >= 20) & (F.col("width") > 0) & (F.col("height") > 0))
    lines = good.groupBy("page_id", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("left").alias("x"), F.min("top").alias("y"),
        F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), F.least(F.lit(0.99), F.avg("conf") / 100).alias("confidence"),
    )
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("block", "par", "line"))
    out = lines.withColumn("nth", nth).filter(F.col("nth") <= most)
    scaled = lambda c, k: F.round(F.col(c) * k).cast("int")
    return out.select("page_id", "block", "line", "text", scaled("x", scale_x).alias("x"), scaled("y", scale_y).alias("y"), (scaled("x1", scale_x) - scaled("x", scale_x)).alias("width"), (scaled("y1", scale_y) - scaled("y", scale_y)).alias("height"), F.round("confidence", 6).alias("confidence"))


def case_catalog(cases: DataFrame, runs: DataFrame, state: str | None = None, text: str | None = None, by_time: bool = False) -> DataFrame:
    """name, kind, state, at: runs (run_id, case_id, state, at) with their case (case_id, title, at), and the cases that no run stands for; those in ``state``
    and with ``text`` in their name, in order of name, or newest first."""
    with_case = runs.join(cases.select("case_id", "title"), "case_id", "left").select(F.coalesce("title", F.concat(F.lit("run "), "run_id")).alias("name"), F.lit("run").alias("kind"), "state", "at")
    alone = cases.join(runs.select("case_id").distinct(), "case_id", "left_anti").select(F.col("title").alias("name"), F.lit("case").alias("kind"), F.lit("stored").alias("state"), "at")
    rows = with_case.unionByName(alone)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    if text and text.strip():
        rows = rows.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    return rows.orderBy(F.desc("at"), "name") if by_time else rows.orderBy(F.lower("name"), F.desc("at"))


def observation_node_link(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """observation_id, node_id, rank: the node an observation (case_id, observation_id, value) belongs to in its case: one with that label (0), else one whose label holds
    the value, which has four characters at least (1), else one of the same host (2). Case and blanks at the ends don't count; the best one wins, then the least node.

    Labels are found by their 4-grams: each distinct value looks up the one of its grams that the fewest labels of its case have, and the labels with it are searched.
    So no value meets all labels, and a gram that every label has (the start of URLs) is used only for values that have no other.
    """
    observations = observations.withColumn("shown", F.lower(F.trim("value")))
    named = nodes.select("case_id", "node_id", "label", F.lower(F.trim("label")).alias("text"))
    same = observations.join(named.withColumnRenamed("text", "shown"), ["case_id", "shown"]).select("observation_id", "node_id", F.lit(0).alias("rank"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda k: F.substr(F.col(c), k, F.lit(4))))
    texts = named.filter(F.length("text") >= 4).select("case_id", "text").distinct()
    index = texts.select("case_id", "text", F.explode(grams("text")).alias("gram"))
    many = index.groupBy("case_id", "gram").agg(F.count("*").alias("n"))
    values = observations.filter(F.length("shown") >= 4).select("case_id", "shown").distinct()
    rarest = values.select("case_id", "shown", F.explode(grams("shown")).alias("gram")).join(many, ["case_id", "gram"], "left")
    rarest = rarest.groupBy("case_id", "shown").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("case_id", "shown", "g.gram")
    holds = rarest.join(index, ["case_id", "gram"]).filter(F.contains("text", F.col("shown"))).select("case_id", "shown", "text")
    part = observations.join(holds, ["case_id", "shown"]).join(named, ["case_id", "text"]).select("observation_id", "node_id", F.lit(1).alias("rank"))
    by_host = observations.withColumn("host", urls.host(F.col("value"))).filter("host is not null")
    hosts = nodes.withColumn("host", F.coalesce(urls.host(F.col("label")), F.lower("label"))).groupBy("case_id", "host").agg(F.min("node_id").alias("node_id"))
    near = by_host.join(hosts, ["case_id", "host"]).select("observation_id", "node_id", F.lit(2).alias("rank"))
    return same.unionByName(part).unionByName(near).groupBy("observation_id").agg(F.min(F.struct("rank", "node_id")).alias("m")).select("observation_id", "m.node_id", "m.rank")
