"""Joins of signals between cases, their scores, and the pages of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import policy, urls

# What a shared signal counts for, by type and quality, and the reason that it gives.
WEIGHTS = {
    ("telegram", "strong"): 35, ("telegram", "medium"): 23, ("whatsapp_or_phone", "strong"): 30, ("whatsapp_or_phone", "medium"): 20,
    ("external_asset_url", "strong"): 20, ("external_asset_url", "medium"): 13, ("referral", "medium"): 10, ("referral", "weak"): 5,
}
REASONS = {"telegram": "shared_telegram", "whatsapp_or_phone": "shared_whatsapp_or_phone", "referral": "shared_referral", "external_asset_url": "shared_exact_asset_url"}
# The relation between cases that publish the same value, by type of observation.
RELATIONS = {
    "public_telegram_alias": "shares_public_contact_with", "public_telegram_contact": "shares_public_contact_with", "public_whatsapp_link": "shares_public_contact_with", "public_phone_number": "shares_public_contact_with",
    "public_email_address": "shares_public_contact_with", "public_redirect_target": "shares_redirect_target_with", "public_download_destination": "shares_download_destination_with",
    "public_referral_code": "shares_referral_code_with", "public_tracking_identifier": "candidate_related_to",
}
MAX_DOMAINS = 3
# Outcome terms, in order of precedence.
STRONG_CHALLENGE = ["just a moment", "checking your browser", "verify you are human", "performing security verification", "attention required", "security verification"]
WEAK_CHALLENGE = ["cloudflare", "browser verification", "security check"]
CHALLENGE_MARKS = ["__cf_chl_", "challenge-platform"]
GEO = ["not available in your country", "not available in your region", "not available in this region", "not available in your jurisdiction", "does not accept bets from", "accessing this site from a country", "location restricted", "geo-restricted"]
UNAVAILABLE = ["page unavailable", "unavailable page", "website currently unavailable", "site is unavailable", "temporarily unavailable", "service unavailable in your region", "unavailable in your region", "unavailable in your location"]
CONSENT = ["manage consent", "cookie preferences", "accept all cookies", "reject non-essential", "privacy choices", "consent preferences"]
UNKNOWN = ["access denied", "request blocked", "unusual traffic", "restricted access", "automated requests are not allowed"]

# What an outcome says about access.
ACCESS = {"bot_challenge": "access_challenge", "geo_restricted": "geo_restriction", "consent_wall": "consent_wall", "unavailable_page": "unavailable", "unknown_restriction": "unknown_restriction", "content": "content"}


def corpus_metrics(entities: DataFrame) -> DataFrame:
    """type, value, frequency, n_cases, n_domains of each signal."""
    return entities.groupBy("type", "value").agg(F.count("*").alias("frequency"), F.count_distinct("case_id").alias("n_cases"), F.count_distinct("domain").alias("n_domains"))


def signal_exclusions(entities: DataFrame, asset_providers: list[str]) -> DataFrame:
    """``entities`` of the shared types with ``excluded``: assets of common providers, generic referrals; else null."""
    host = urls.host(F.col("value"))
    reason = F.when((F.col("type") == "external_asset_url") & policy.host_in(host, asset_providers), "common_asset_provider").when((F.col("type") == "referral") & policy.is_generic_referral(F.col("value")), "generic_referral_signal")
    return entities.filter(F.col("type").isin(list(REASONS))).withColumn("excluded", reason)


def signal_counts(entities: DataFrame) -> DataFrame:
    """case_id, type, value, frequency, n_cases, n_domains: how often a case's signal is found in the other cases.

    ``entities`` has a row for each entity: case_id, domain, type, value. All counts come from aggregates; nothing is joined pair by pair.
    """
    own = entities.groupBy("type", "value", "domain", "case_id").agg(F.count("*").alias("n"))
    by_domain = own.groupBy("type", "value", "domain").agg(F.count("*").alias("own_cases"), F.sum("n").alias("n"))
    by_value = by_domain.groupBy("type", "value").agg(F.sum("n").alias("all"), F.sum("own_cases").alias("cases"), F.count("*").alias("domains")).filter("cases > 1")
    rows = own.join(by_domain.drop("n"), ["type", "value", "domain"]).join(by_value, ["type", "value"])
    n_domains = F.col("domains") - F.when(F.col("own_cases") == 1, 1).otherwise(0)
    return rows.select("case_id", "type", "value", (F.col("all") - F.col("n")).alias("frequency"), (F.col("cases") - 1).alias("n_cases"), n_domains.alias("n_domains"))


def quality_of(kind: Column, frequency: Column, n_cases: Column, n_domains: Column) -> Column:
    """Quality of a signal that is found so often elsewhere: once is the best; a referral is one grade lower."""
    once = (frequency == 1) & (n_cases == 1) & (n_domains == 1)
    return F.when(kind == "referral", F.when(once, "medium").otherwise("weak")).otherwise(F.when(once, "strong").otherwise("medium"))


def weight_of(kind: Column, quality: Column) -> Column:
    points = None
    for (k, q), n in WEIGHTS.items():
        test = (kind == k) & (quality == q)
        points = F.when(test, n) if points is None else points.when(test, n)
    return points


def shared_signals(entities: DataFrame, max_domains: int = MAX_DOMAINS) -> DataFrame:
    """case_id, type, value, other_case, frequency, n_cases, n_domains, quality, weight: signals that other cases carry too.

    A signal on more than ``max_domains`` other domains says nothing and is dropped before the join, which also bounds the rows
    that one value can make.
    """
    counts = signal_counts(entities).filter(F.col("n_domains").between(1, max_domains))
    counts = counts.withColumn("quality", quality_of(F.col("type"), F.col("frequency"), F.col("n_cases"), F.col("n_domains")))
    counts = counts.withColumn("weight", weight_of(F.col("type"), F.col("quality")))
    rare = counts.select("type", "value").distinct()
    other = entities.select("type", "value", F.col("case_id").alias("other_case")).distinct().join(rare, ["type", "value"], "left_semi")
    return counts.join(other, ["type", "value"]).filter("case_id <> other_case").select("case_id", "type", "value", "other_case", "frequency", "n_cases", "n_domains", "quality", "weight")


def candidate_reasons(shared: DataFrame, entities: DataFrame) -> DataFrame:
    """case_id, host, reason, value, quality, weight, pages, urls: what links a case to a candidate host, with the sorted sets of the pages
    and URLs on both sides that carry it. ``entities`` also has page_id and url."""
    places = entities.groupBy("case_id", "type", "value").agg(F.collect_set("page_id").alias("p"), F.collect_set("url").alias("u"))
    there = places.select(F.col("case_id").alias("other_case"), "type", "value", F.col("p").alias("p2"), F.col("u").alias("u2"))
    rows = shared.join(places, ["case_id", "type", "value"]).join(there, ["other_case", "type", "value"])
    reason = None
    for kind, name in REASONS.items():
        reason = F.when(F.col("type") == kind, name) if reason is None else reason.when(F.col("type") == kind, name)
    both = lambda a, b: F.array_sort(F.array_union(a, b))
    return rows.select("case_id", F.col("other_case").alias("host"), reason.alias("reason"), "value", "quality", "weight", both("p", "p2").alias("pages"), both("u", "u2").alias("urls"))


def candidate_scores(reasons: DataFrame) -> DataFrame:
    """case_id, host, score: the largest weight of each reason, summed, 100 at most."""
    most = reasons.groupBy("case_id", "host", "reason").agg(F.max("weight").alias("w"))
    return most.groupBy("case_id", "host").agg(F.least(F.lit(100), F.sum("w")).cast("long").alias("score"))


def ranked_candidates(scores: DataFrame) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "host")))


def ranked_frontier(links: DataFrame) -> DataFrame:
    """page_id, href, crawl_url, label, method, score, place: the distinct links of a page, in order of score, crawl_url (nulls last), href, label and method."""
    own = ["page_id", "href", "crawl_url", "label", "method", "score"]
    order = W.partitionBy("page_id").orderBy("score", F.col("crawl_url").asc_nulls_last(), "href", "label", "method")
    return links.select(own).distinct().withColumn("place", F.row_number().over(order))


def cross_case_matches(observations: DataFrame, per_case: int = 12) -> DataFrame:
    """case_id, other_case, relation, value, page_id, observation_id, place: exact values that another case publishes too, one for each (other
    case, relation, value), in that order, ``per_case`` at most, with the case's last observation of the value.

    A value's cases are numbered, and only the first ``per_case`` + 1 of them can be among the first matches of any case, so a value
    that all cases share makes as many rows as cases times that, not their square.
    """
    relation = None
    for kind, name in RELATIONS.items():
        relation = F.when(F.col("observation_type") == kind, name) if relation is None else relation.when(F.col("observation_type") == kind, name)
    rows = observations.withColumn("relation", relation).filter("relation is not null")
    own = rows.groupBy("case_id", "observation_type", "relation", "value").agg(F.max(F.struct("page_id", "observation_id")).alias("last"))
    known = own.withColumn("nth", F.row_number().over(W.partitionBy("observation_type", "value").orderBy("case_id"))).filter(F.col("nth") <= per_case + 1)
    both = own.join(known.select("observation_type", "value", F.col("case_id").alias("other_case")), ["observation_type", "value"]).filter("case_id <> other_case")
    one = both.groupBy("case_id", "other_case", "relation", "value").agg(F.max("last").alias("last"))
    place = F.row_number().over(W.partitionBy("case_id").orderBy("other_case", "relation", "value"))
    return one.withColumn("place", place).filter(F.col("place") <= per_case).select("case_id", "other_case", "relation", "value", "last.page_id", "last.observation_id", "place")


def known_host_match(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` (with host) plus known_case: the last known case of that host."""
    last = known.groupBy("host").agg(F.max_by("case_id", "seen").alias("known_case"))
    return links.join(last, "host", "left")


def page_pairs(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """left_case, right_case, place, left_page, right_page: nth page with nth page; unmatched ones stay."""
    ranked = pages.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy("page_id")))
    left = pairs.join(ranked.select(F.col("case_id").alias("left_case"), "place", F.col("page_id").alias("left_page")), "left_case")
    right = pairs.join(ranked.select(F.col("case_id").alias("right_case"), "place", F.col("page_id").alias("right_page")), "right_case")
    return left.join(right, ["left_case", "right_case", "place"], "full_outer")


def snapshot_diff(captures: DataFrame, most: int = 50) -> DataFrame:
    """host, page_id, previous, added, removed, unchanged, first_added, first_removed: values of a capture against the one before of its host; of the added
    and removed ones the first ``most`` in order."""
    order = captures.select("host", "page_id").distinct().withColumn("previous", F.lag("page_id").over(W.partitionBy("host").orderBy("page_id"))).filter("previous is not null")
    one = captures.select("host", "page_id", "value").distinct()
    now = order.join(one, ["host", "page_id"]).select("host", "page_id", "previous", "value", F.lit(1).alias("now"))
    old = order.join(one.withColumnRenamed("page_id", "previous"), ["host", "previous"]).select("host", "page_id", "previous", "value", F.lit(1).alias("old"))
    both = now.join(old, ["host", "page_id", "previous", "value"], "full_outer")
    new, gone = F.col("old").isNull(), F.col("now").isNull()
    first = lambda test: F.slice(F.array_sort(F.collect_list(F.when(test, F.col("value")))), 1, most)
    return both.groupBy("host", "page_id", "previous").agg(F.count_if(new).alias("added"), F.count_if(gone).alias("removed"), F.count_if(~new & ~gone).alias("unchanged"), first(new).alias("first_added"), first(gone).alias("first_removed"))


def frontier_admission(links: DataFrame, page_budget: int = 5, per_page: int = 200, max_depth: int = 1) -> DataFrame:
    """``links`` (case_id, page_id, depth of the page, elem_ord, href, label, host, crawl_url, score) with decision: queued, or why not, in a
    fixed order of reasons. Pages come in order of page_id, links of a page by score, URL, text. A URL counts as known once it was queued."""
    in_page = F.row_number().over(W.partitionBy("page_id").orderBy("score", F.col("crawl_url").asc_nulls_last(), "href", "label", "elem_ord"))
    early = (
        F.when(F.col("nth") > per_page, "frontier_limit").when(F.col("crawl_url").isNull() | F.col("host").isNull(), "malformed_url")
        .when(F.col("depth") + 1 > max_depth, "depth_limit").when(F.col("host") != F.col("case_id"), "external_host")
        .when(policy.url_policy(F.col("crawl_url")).isNotNull(), "unsafe_destination")
    )
    rows = links.withColumn("nth", in_page).withColumn("early", early)
    by_url = W.partitionBy("case_id", "crawl_url").orderBy(F.col("early").isNotNull(), "page_id", "nth")
    rows = rows.withColumn("first", F.col("early").isNull() & (F.row_number().over(by_url) == 1))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(~F.col("first"), "page_id", "nth"))
    rows = rows.withColumn("rank", F.when(F.col("first"), rank))
    known = F.min("rank").over(W.partitionBy("case_id", "crawl_url")) <= page_budget
    decision = F.when(F.col("early").isNotNull(), F.col("early")).when(~known, "page_budget").when(F.col("first"), "queued").otherwise("duplicate_url")
    return rows.withColumn("decision", decision).drop("early", "first", "rank", "nth")


def capture_outcome(captures: DataFrame, limit: int = 50000) -> DataFrame:
    """page_id, outcome, access_outcome, content_usable, reasons of captures (page_id, text and, where present, title, final_url,
    navigation_status, error_type), by precedence: timeout, navigation error, challenge, region, unavailable, consent, restriction, content."""
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in captures.columns else F.lit(default)
    status, error = policy.normalize_text(given("navigation_status", "captured")), policy.normalize_text(given("error_type", ""))
    rows = captures.select(
        "page_id", status.alias("status"), error.alias("error"), policy.normalize_text(given("title", "")).alias("title"),
        F.substring(policy.normalize_text(given("text", "")), 1, limit).alias("text"), policy.normalize_text(given("final_url", "")).alias("final"),
    )
    rows = rows.withColumn("both", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("text", F.lit(""))))

    def hits(terms: list[str], label: str, where: str = "both") -> Column:
        return F.transform(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(where), t)), lambda t: F.concat(F.lit(label + ": "), t))

    challenge = "bot-challenge indicator"
    rows = rows.withColumns({
        "strong": hits(STRONG_CHALLENGE, challenge), "marks": hits(CHALLENGE_MARKS, "bot-challenge URL marker", "final"), "weak": hits(WEAK_CHALLENGE, challenge), "geo": hits(GEO, "geo-restriction indicator"),
        "gone": hits(UNAVAILABLE, "unavailable-page indicator"), "consent": hits(CONSENT, "consent-wall indicator"), "unknown": hits(UNKNOWN, "restriction indicator"),
    })
    rest: Column = F.col("text")
    for t in CONSENT:
        rest = F.replace(rest, F.lit(t), F.lit(" "))
    words = lambda x: F.regexp_count(x, F.lit(r"\S+"))
    much = (F.length(F.trim(rest)) >= 160) | (words(rest) >= 20)
    enough = (F.length("text") >= 24) & (words(F.col("text")) >= 4)
    some = lambda name: F.size(name) > 0
    failed = F.when(F.col("error") != "", F.concat(F.lit("navigation error type: "), F.substring_index("error", ":", 1))).otherwise("navigation did not complete")
    one = lambda text: F.array(F.lit(text) if isinstance(text, str) else text)
    chain = [
        (F.col("status").isin("timed_out", "timeout") | F.col("error").contains("timeout"), "timeout", one("navigation timed out")),
        (~F.col("status").isin("captured", "completed") | (F.col("error") != ""), "navigation_error", one(failed)),
        (some("strong") | some("marks") | (F.size("weak") >= 2), "bot_challenge", F.when(some("strong"), F.col("strong")).when(some("marks"), F.col("marks")).otherwise(F.col("weak"))),
        (some("geo"), "geo_restricted", F.col("geo")),
        (some("gone"), "unavailable_page", F.col("gone")),
        ((F.size("consent") >= 2) & ~much, "consent_wall", F.col("consent")),
        (some("unknown"), "unknown_restriction", F.col("unknown")),
        (~enough, "unknown_restriction", one("captured page had no meaningful visible text")),
    ]
    out = None
    for test, outcome, reasons in chain:
        value = F.struct(F.lit(outcome).alias("outcome"), reasons.alias("reasons"))
        out = F.when(test, value) if out is None else out.when(test, value)
    found = out.otherwise(F.struct(F.lit("content").alias("outcome"), F.array().cast("array<string>").alias("reasons")))
    access = F.create_map(*[F.lit(x) for pair in ACCESS.items() for x in pair])
    rows = rows.select("page_id", found.alias("f")).select("page_id", "f.outcome", "f.reasons")
    return rows.select("page_id", "outcome", F.element_at(access, F.col("outcome")).alias("access_outcome"), (F.col("outcome") == "content").alias("content_usable"), "reasons")


# Words that no control may hold, and what is safe to reveal.
FORBIDDEN = r"(?i)\b(login|log in|sign in|register|sign up|create account|submit|send|chat|payment|pay|deposit|withdraw|withdrawal|bet|wager|download|install|captcha)\b"
APPLICATION_SCHEMES = ["mailto", "tel", "sms", "tg", "whatsapp", "intent"]
SAFE_REVEALS = ["reveal_modal", "reveal_menu", "reveal_tab", "inspect_public_iframe"]
# How promising a label is, by the first of these terms that it holds.
LABEL_RANKS = [("contact us", 0), ("hubungi", 0), ("kontak", 0), ("contact", 0), ("support", 1), ("help", 1), ("about", 2), ("information", 2), ("public", 3), ("promotion", 4), ("promo", 4), ("menu", 5)]


def interaction_policy(controls: DataFrame) -> DataFrame:
    """``controls`` (tag, label, text, href, action, form_owner, form_action, download, behavior) with allowed and reason, in fixed precedence."""
    combined = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("label", "text", "href", "action", "form_action")])
    scheme = F.coalesce(urls.scheme(F.col("href")), F.lit(""))
    link = (
        F.when(~scheme.isin("http", "https") | F.coalesce(urls.raw_host(F.col("href")) == "", F.lit(True)), "public_link_destination_invalid")
        .when(F.lower(urls.path(F.col("href"))).rlike(r"\.(apk|bin|dmg|exe|msi|zip)$"), "binary_destination_blocked")
        .otherwise("validated_public_link")
    )
    reason = (
        F.when(F.col("download"), "download_attribute_blocked")
        .when(F.col("form_owner").isNotNull() | F.col("form_action").isNotNull() | F.lower("tag").isin("input", "select", "textarea"), "form_or_input_action_blocked")
        .when(scheme.isin(APPLICATION_SCHEMES), "external_application_launch_blocked")
        .when(combined.rlike(FORBIDDEN), "forbidden_action_keyword")
        .when(F.col("behavior").isin(SAFE_REVEALS), "validated_public_reveal")
        .when(F.col("behavior") == "open_public_link", link)
        .otherwise("ambiguous_or_undeclared_action")
    )
    return controls.withColumn("reason", reason).withColumn("allowed", F.col("reason").isin("validated_public_reveal", "validated_public_link"))


def first_allowed(controls: DataFrame) -> DataFrame:
    """page_id, element_id, rank: of the controls that the policy allows, the one with the most promising label, then the first."""
    words = policy.fold(F.concat_ws(" ", "label", "text"))
    rank = None
    for term, k in LABEL_RANKS:
        rank = F.when(words.contains(term), k) if rank is None else rank.when(words.contains(term), k)
    rows = interaction_policy(controls).filter("allowed").withColumn("rank", rank.otherwise(10))
    return rows.groupBy("page_id").agg(F.min(F.struct("rank", "element_id")).alias("m")).select("page_id", "m.element_id", "m.rank")


def usable_entities(entities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entities of the pages whose capture is usable."""
    return entities.join(outcomes.filter("content_usable"), "page_id", "left_semi")


def scope_violations(completed: DataFrame, allowed: DataFrame, candidates: DataFrame) -> DataFrame:
    """evaluation, rule, host: completed hosts (evaluation, host) that were not allowed, and those that are candidates."""
    pair = lambda df: df.select("evaluation", "host")
    outside = pair(completed).subtract(pair(allowed)).withColumn("rule", F.lit("host_out_of_scope"))
    return outside.unionByName(pair(completed).intersect(pair(candidates)).withColumn("rule", F.lit("candidate_was_completed")))


def schema_violations(rows: DataFrame, key: str, schema: dict[str, list | tuple]) -> DataFrame:
    """id, field, found: values outside the schema, which gives a column's allowed values (a list) or its bounds (a pair). Nulls are outside too."""
    checks = []
    for field, rule in schema.items():
        good = F.col(field).isin(rule) if isinstance(rule, list) else F.col(field).between(*rule)
        checks.append(F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("found"))))
    found = rows.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return found.select("id", "v.field", "v.found")
