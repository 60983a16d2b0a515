"""Public observations and signals in page text and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import policy, urls
from sightline.operators.log_windows import status_case

# What counts as an e-mail address, a phone number, an alias.
EMAIL = r"(?<![\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = r"(?<!\w)(\+?\d[\d\s().-]{7,}\d)(?!\w)"
ALIAS = r"(?<!\w)@([A-Za-z][A-Za-z0-9_]{3,31})"
HANDLE = r"(?<![\w@])@([A-Za-z][A-Za-z0-9_]{4,31})\b"
CHANNEL_PHONE = r"(?i)(whats\s*app|telegram)\s*[:\-]?\s*(\+?\d[\d\s().-]{7,}\d)"
WHATSAPP_PHONE = r"(?i)whats\s*app\s*[:\-]?\s*(\+?\d[\d\s().-]{7,}\d)"
TELEGRAM_PHONE = r"(?i)telegram\s*[:\-]?\s*(\+?\d[\d\s().-]{7,}\d)"
REFERRAL_KEYS = ["ref", "referral", "affiliate", "aff", "invite"]
OBSERVED_REFERRALS = ["ref", "referral", "affiliate", "aff", "invite", "promo", "refcode"]
TRACKING = ["gclid", "fbclid", "clickid", "campaign", "cid", "source"]
DOWNLOADS = r"\.(apk|bin|dmg|exe|iso|msi|pkg|zip)$"
CLAIMS = {
    "public_payment_method": ["deposit", "withdrawal", "payment", "e-wallet", "bank transfer"],
    "public_payment_provider": ["visa", "mastercard", "paypal", "gopay", "ovo", "dana", "qris", "shopeepay", "bank transfer"],
    "public_offer_claim": ["bonus", "promotion", "promo", "discount", "cashback", "special offer"],
    "public_legal_or_license_claim": ["licensed", "license", "licence", "regulated", "regulation"],
}
# The term groups that count as indicators.
INDICATORS = {
    "wagering_language": ["bet", "betting", "casino", "gambling", "judi", "judol", "poker", "sportsbook", "taruhan", "togel", "wager"],
    "game_mechanics": ["baccarat", "blackjack", "free spin", "gacor", "jackpot", "live casino", "maxwin", "roulette", "rtp", "slot", "slots"],
    "betting_promotion": ["bonus deposit", "bonus new member", "cashback", "parlay", "promo deposit", "turnover"],
}
# Types that count only beside direct terms on their page, and the evidence group of each type.
CONTEXTUAL = {"public_offer_claim": "gambling_offer", "public_payment_method": "transaction_enablement", "public_payment_provider": "transaction_enablement", "public_referral_code": "referral_or_tracking", "public_tracking_identifier": "referral_or_tracking"}
OSINT_GROUPS = {
    "public_telegram_alias": "public_contacts", "public_telegram_contact": "public_contacts", "public_whatsapp_link": "public_contacts", "public_phone_number": "public_contacts", "public_email_address": "public_contacts",
    "public_outgoing_link": "links_and_destinations", "public_redirect_target": "links_and_destinations", "public_download_destination": "links_and_destinations",
    "public_payment_method": "payments_and_offers", "public_payment_provider": "payments_and_offers", "public_offer_claim": "payments_and_offers",
    "public_referral_code": "referrals_and_tracking", "public_tracking_identifier": "referrals_and_tracking", "claimed_brand_identity": "public_claims", "public_legal_or_license_claim": "public_claims",
}


def _found(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


def emails(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", F.explode(F.array_distinct(F.transform(_found(EMAIL, 1), lambda x: F.lower(x)))).alias("value"))


def aliases(texts: DataFrame, pattern: str = ALIAS) -> DataFrame:
    return texts.select("page_id", F.explode(F.array_distinct(F.transform(_found(pattern, 1), lambda x: F.concat(F.lit("@"), F.lower(x))))).alias("value"))


def _number(raw: Column) -> Column:
    return F.concat(F.when(raw.startswith("+"), F.lit("+")).otherwise(F.lit("")), policy.digits(raw))


def phones(texts: DataFrame) -> DataFrame:
    """page_id, value: numbers of 8 digits or more that are not a labelled channel number (whose text is taken out first)."""
    rest = texts.withColumn("text", F.regexp_replace("text", CHANNEL_PHONE, "$1 : "))
    raw = rest.select("page_id", F.explode(_found(PHONE, 1)).alias("raw"))
    return raw.filter(F.length(policy.digits(F.col("raw"))) >= 8).select("page_id", _number(F.col("raw")).alias("value")).distinct()


def channel_phones(texts: DataFrame) -> DataFrame:
    """page_id, observation_type, value of numbers that follow a channel's name."""
    both = F.explode(F.arrays_zip(_found(CHANNEL_PHONE, 1).alias("label"), _found(CHANNEL_PHONE, 2).alias("raw")))
    rows = texts.select("page_id", both.alias("m")).select("page_id", F.lower("m.label").alias("label"), policy.digits(F.col("m.raw")).alias("number")).filter(F.length("number") >= 8)
    telegram = F.col("label") == "telegram"
    kind = F.when(telegram, "public_telegram_contact").otherwise("public_whatsapp_link")
    value = F.when(telegram, F.concat(F.lit("+"), "number")).otherwise(F.concat(F.lit("https://wa.me/"), "number"))
    return rows.select("page_id", kind.alias("observation_type"), value.alias("value")).distinct()


def claim_terms(texts: DataFrame) -> DataFrame:
    """page_id, observation_type, value, place: each listed term that a text holds, where it is first found."""
    terms = texts.sparkSession.createDataFrame([(k, t) for k, v in CLAIMS.items() for t in v], "observation_type string, value string")
    folded = texts.select("page_id", F.lower("text").alias("low"))
    listed = F.array(*[F.lit(t) for v in CLAIMS.values() for t in v])
    hit = folded.select("page_id", "low", F.explode(F.filter(F.array_distinct(listed), lambda t: F.instr(F.col("low"), t) > 0)).alias("value"))
    return hit.join(F.broadcast(terms), "value").select("page_id", "observation_type", "value", F.expr("instr(low, value)").alias("place"))


def referral_signals(rows: DataFrame) -> DataFrame:
    """page_id, value: recognized query pairs of the column url."""
    pair = rows.select("page_id", F.explode(urls.pairs(urls.query(F.col("url")), blanks=False)).alias("p"))
    pair = pair.withColumns({"key": F.lower("p.key"), "value": F.trim("p.value")}).filter(F.col("key").isin(REFERRAL_KEYS) & (F.col("value") != ""))
    return pair.select("page_id", F.concat_ws("=", "key", "value").alias("value")).distinct()


def tracking_observations(rows: DataFrame) -> DataFrame:
    """page_id, observation_type, value: referral codes and tracking identifiers in the query of the column url."""
    pair = rows.select("page_id", F.explode(urls.pairs(urls.query(F.col("url")), blanks=False)).alias("p")).withColumn("key", F.lower("p.key"))
    value = F.lower(F.trim("p.value"))
    codes = pair.filter(F.col("key").isin(OBSERVED_REFERRALS)).select("page_id", F.lit("public_referral_code").alias("observation_type"), value.alias("value"))
    marks = pair.filter(F.col("key").startswith("utm_") | F.col("key").isin(TRACKING))
    return codes.unionByName(marks.select("page_id", F.lit("public_tracking_identifier").alias("observation_type"), F.concat_ws("=", "key", value).alias("value"))).distinct()


def text_tokens(texts: DataFrame) -> DataFrame:
    """page_id, token, n: folded words of two characters or more."""
    rows = texts.select("page_id", F.explode(F.regexp_extract_all(policy.fold(F.col("text")), F.lit(r"(?U)\w{2,}"), F.lit(0))).alias("token"))
    return rows.groupBy("page_id", "token").agg(F.count("*").alias("n"))


def text_vectors(texts: DataFrame) -> DataFrame:
    """id, counts (array of (token, n), by token), sq (sum of n * n), total: the tokens of each text with a token, a row a text.

    A text's tokens are sorted and counted in its row, from each place where a new token begins to the next such place; so a task holds one text's tokens at a time.
    """
    tokens = F.transform(F.collect_list("text"), lambda t: F.regexp_extract_all(policy.fold(t), F.lit(r"(?U)\w{2,}"), F.lit(0)))
    rows = texts.groupBy("page_id").agg(F.sort_array(F.flatten(tokens)).alias("t")).filter(F.size("t") > 0)

    def counted(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return urls.let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(t, i).alias("token"), (F.coalesce(F.get(b, k + 1), F.size(t)) - i).cast("long").alias("n"))))

    rows = rows.select(F.col("page_id").alias("id"), urls.let(F.col("t"), counted).alias("counts"), F.size("t").cast("long").alias("total"))
    return rows.select("id", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["n"]).alias("sq"), "total")


def indicator_rows(observations: DataFrame) -> DataFrame:
    """page_id, observation_type, value, category, matched: rows (with text) whose text holds whole indicator terms; types that
    only count in context take the terms of their page."""
    flat = [(t, g) for g, v in INDICATORS.items() for t in v]
    low = F.lower("text")
    terms = F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])"), F.lit(t)) for t, _ in flat]))
    rows = observations.withColumn("terms", terms)
    page = rows.filter(F.size("terms") > 0).select("page_id", F.explode("terms").alias("t")).groupBy("page_id").agg(F.array_sort(F.collect_set("t")).alias("page_terms"))
    rows = rows.join(page, "page_id", "left")
    in_context = None
    for k, v in CONTEXTUAL.items():
        in_context = F.when(F.col("observation_type") == k, v) if in_context is None else in_context.when(F.col("observation_type") == k, v)
    has = lambda group: F.arrays_overlap("terms", F.array(*[F.lit(t) for t in INDICATORS[group]]))
    direct = (
        F.when(F.col("observation_type") == "claimed_brand_identity", "gambling_brand_claim")
        .when(F.col("observation_type") == "public_offer_claim", "gambling_offer")
        .when(F.col("observation_type").isin("public_payment_method", "public_payment_provider"), "transaction_enablement")
        .when(has("game_mechanics"), "game_mechanics")
        .when(has("betting_promotion"), "gambling_offer")
        .otherwise("wagering_language")
    )
    category = F.when(F.size("terms") > 0, direct).when(F.col("page_terms").isNotNull(), in_context)
    matched = F.when(F.size("terms") > 0, F.array_sort("terms")).when(category.isNotNull(), F.col("page_terms")).otherwise(F.array())
    return rows.select("page_id", "observation_type", "value", category.alias("category"), F.array_join(matched, ",").alias("matched"))


def indicator_summary(indicators: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, n_observations, n_indicators, categories and groups (name=count, by name), status of every page."""
    group = status_case(F.col("observation_type"), OSINT_GROUPS, "other_observations")
    rows = indicators.withColumn("group", group)

    def counts(key: str, name: str) -> DataFrame:
        each = rows.filter(F.col(key).isNotNull()).groupBy("page_id", key).agg(F.count("*").alias("n"))
        text = F.array_join(F.array_sort(F.collect_list(F.concat(F.col(key), F.lit("="), F.col("n").cast("string")))), ",")
        return each.groupBy("page_id").agg(text.alias(name))

    totals = rows.groupBy("page_id").agg(F.count("*").alias("n_observations"), F.count("category").alias("n_indicators"))
    out = pages.select("page_id").join(totals, "page_id", "left").join(counts("category", "categories"), "page_id", "left").join(counts("group", "groups"), "page_id", "left")
    status = F.when(F.col("n_observations").isNull(), "insufficient_evidence").when(F.col("n_indicators") > 0, "indicators_observed").otherwise("no_indicators_observed")
    zero, none = (lambda c: F.coalesce(c, F.lit(0)).alias(c)), (lambda c: F.coalesce(c, F.lit("")).alias(c))
    return out.select("page_id", zero("n_observations"), zero("n_indicators"), none("categories"), none("groups"), status.alias("status"))


def distinct_observations(rows: DataFrame, *order: str) -> DataFrame:
    """The first observation of each (type, value), by an aggregate, so that a value on very many pages is not one task's."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy("observation_type", "value").agg(first.alias("first")).select("first.*")
