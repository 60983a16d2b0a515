"""Text, redaction and policy expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.functions import urls

# The link classes in their order of precedence.
FRONTIER_CLASSES = [
    (r"\b(contact|contact us|hubungi|kontak|support|help)\b", 0, "contact"),
    (r"\b(about|information|company|profile)\b", 1, "about"),
    (r"\b(terms|policy|legal|license|responsible)\b", 2, "legal"),
    (r"\b(payment|bank|wallet|deposit method)\b", 3, "payment_info"),
    (r"\b(promo|promotion|bonus|offer|event|news)\b", 5, "promotion"),
]
# Referral values too common to mean anything.
GENERIC_REFERRALS = ["", "0", "1", "code", "default", "none", "null", "ref", "test", "unknown"]
# Query keys that must not be shown, local names and metadata hosts.
SENSITIVE_KEYS = r"(?i)(?:api[-_]?key|auth(?:orization)?|code|credential|pass(?:word)?|secret|session|sid|token)"
LOCAL_NAMES = r"(^|\.)(localhost|local|internal|localdomain)$"
METADATA_HOSTS = ["169.254.169.254", "metadata.google.internal", "metadata"]
#: Ranges of IPv4 addresses that are not global: (first address, prefix length).
PRIVATE_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_text(text: Column) -> Column:
    """Controls and runs of white space as one space, trimmed, folded."""
    return fold(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")))


def bounded(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")), 1, limit)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def frontier_priority(label: Column, url: Column) -> Column:
    """struct<score,reason> of a link: the first class whose words are in its text or path."""
    material = F.lower(F.concat_ws(" ", label, F.replace(urls.path(url), F.lit("/"), F.lit(" "))))
    out = None
    for pattern, score, reason in FRONTIER_CLASSES:
        value = F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        out = F.when(material.rlike(pattern), value) if out is None else out.when(material.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit(4).alias("score"), F.lit("generic").alias("reason")))


def is_generic_referral(signal: Column) -> Column:
    """Whether key=value is too common: no =, a value below 4 characters, or a listed one."""
    value = fold(F.trim(F.regexp_extract(signal, r"^[^=]*=(.*)$", 1)))
    return (F.instr(signal, "=") == 0) | (F.length(value) < 4) | value.isin(GENERIC_REFERRALS)


def host_in(host: Column, suffixes: list[str]) -> Column:
    """Whether a host is one of the suffixes or below one; the list is constant."""
    parts = F.split(F.lower(F.regexp_replace(host, r"\.+$", "")), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.coalesce(F.arrays_overlap(ends, F.array(*[F.lit(s) for s in suffixes])), F.lit(False))


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number; null if it is none."""
    p = F.split(host, r"\.")
    value = F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def _in_range(number: Column, first: str, bits: int) -> Column:
    a, b, c, d = map(int, first.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return (number >= low) & (number < low + (1 << (32 - bits)))


def url_policy(url: Column) -> Column:
    """Why a URL must not be fetched, as far as its text tells; null if nothing speaks against it."""
    h, number = urls.host(url), ipv4_number(urls.host(url))
    private = None
    for first, bits in PRIVATE_V4:
        private = _in_range(number, first, bits) if private is None else private | _in_range(number, first, bits)
    v6 = urls.raw_host(url).startswith("[")
    unsafe_v6 = v6 & F.lower(urls.raw_host(url)).rlike(r"^\[(::1?|fe[89ab].*|f[cd].*|ff.*|::ffff:.*)\]$")
    default = F.when(urls.scheme(url) == "https", F.lit("443")).otherwise(F.lit("80"))
    return (
        F.when(~urls.scheme(url).isin("http", "https"), "unsupported_scheme")
        .when(h.isNull(), "missing_hostname")
        .when(urls.userinfo(url).isNotNull(), "userinfo_not_allowed")
        .when(h.isin(METADATA_HOSTS), "metadata_host")
        .when(h.rlike(LOCAL_NAMES), "local_hostname")
        .when(private | unsafe_v6, "non_global_address")
        .when(urls.port(url).isNotNull() & (urls.port(url) != default), "non_default_port")
    )


def shortened(text: Column, limit: int) -> Column:
    """Without controls; what is beyond the limit becomes an ellipsis."""
    visible = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")
    return F.when(F.length(visible) > limit, F.concat(F.substring(visible, 1, limit), F.lit("…"))).otherwise(visible)


def _quoted(text: Column) -> Column:
    return F.replace(urls.encode(text), F.lit("+"), F.lit("%20"))


def _quoted_path(path: Column) -> Column:
    """A path with all but letters, digits and /%:@-._~ percent-encoded."""
    out = F.replace(_quoted(path), F.lit("*"), F.lit("%2A"))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def redact_url(url: Column) -> Column:
    """Display form: no userinfo, default port or fragment, values of sensitive keys and long values replaced, 30 pairs, 512 characters."""
    hide = lambda p: p["key"].rlike(SENSITIVE_KEYS) | (F.length(p["value"]) > 64)
    shown = lambda p: F.concat(_quoted(shortened(p["key"], 64)), F.lit("="), F.when(hide(p), F.lit("[redacted]")).otherwise(_quoted(shortened(p["value"], 96))))
    text = F.array_join(F.transform(F.slice(urls.pairs(urls.query(url)), 1, 30), shown), "&")
    host = F.lower(F.regexp_replace(urls.raw_host(url), r"\.+$", ""))
    default = F.when(urls.scheme(url) == "https", F.lit("443")).otherwise(F.lit("80"))
    port = F.when(urls.port(url).isNull() | (urls.port(url) == default), F.lit("")).otherwise(F.concat(F.lit(":"), urls.port(url)))
    path = _quoted_path(F.when(urls.path(url) == "", F.lit("/")).otherwise(urls.path(url)))
    front = F.concat(urls.scheme(url), F.lit("://"), host, port, path)
    whole = shortened(F.concat(front, F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))), 512)
    return F.when(url.isNotNull(), F.when(urls.scheme(url).isin("http", "https") & (host != ""), whole).otherwise("[invalid URL]"))


def redact_phone(text: Column) -> Column:
    """First two and last four characters of a number, dots between; short ones stay."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(compact) > 4, F.concat(F.substring(compact, 1, 2), F.lit("••••"), F.substring(compact, -4, 4))).otherwise(shortened(text, 256))


# Entity and observation types that are shown as URLs, as numbers, as key=[redacted].
URL_TYPES = ["external_link", "external_asset_url", "public_outgoing_link", "public_redirect_target", "public_download_destination", "public_whatsapp_link"]
PHONE_TYPES = ["whatsapp_or_phone", "public_phone_number"]
CODE_TYPES = ["referral", "public_referral_code", "public_tracking_identifier"]


def redact_entity(kind: Column, value: Column) -> Column:
    """Display form of an entity's or observation's value, by its type."""
    code = F.when(F.instr(value, "=") > 0, F.concat(shortened(F.substring_index(value, "=", 1), 64), F.lit("=[redacted]"))).otherwise("[redacted referral]")
    return F.when(kind.isin(URL_TYPES), redact_url(value)).when(kind.isin(PHONE_TYPES), redact_phone(value)).when(kind.isin(CODE_TYPES), code).otherwise(shortened(value, 256))


def redact_label(node_type: Column, label: Column) -> Column:
    """Display form of a graph node's label."""
    return F.when(node_type.isin("page", "external_asset_url"), redact_url(label)).when(node_type.isin("whatsapp_or_phone", "referral"), redact_entity(node_type, label)).otherwise(shortened(label, 256))


def target_class(target: Column, source: Column, token: Column) -> Column:
    """How near a target host is to a source host by the source's brand token: 0 product family, 1 same beginning, 2 other, 3 below the source."""
    own = token != ""
    family = own & target.startswith(token) & F.substr(target, F.length(token) + 1).rlike(r"^(?:casino|poker|sport)\.")
    return F.when(family, 0).when(own & target.startswith(token), 1).when(F.endswith(target, F.concat(F.lit("."), source)), 3).otherwise(2)


# Failures that a policy causes, and the response headers that are kept.
POLICY_FAILURES = ["unsafe_destination", "external_host", "unsupported_content_type", "redirect_limit", "request_budget", "response_budget"]
ALLOWED_HEADERS = ["cache-control", "content-language", "content-length", "content-type", "date", "etag", "last-modified", "location", "server", "x-robots-tag"]


def navigation_status(reason: Column) -> Column:
    """How a navigation that failed for ``reason`` is recorded; a null reason is a capture."""
    return F.when(reason.isNull(), "captured").when(F.lower(reason).contains("timeout"), "timed_out").when(reason.isin(POLICY_FAILURES), "blocked_by_policy").otherwise("failed")


def allowed_headers(headers: Column) -> Column:
    """Map of the allowed headers under lower-case keys, without nulls, values cut to 1000 characters."""
    named = F.transform_keys(F.map_filter(headers, lambda k, v: F.lower(k).isin(ALLOWED_HEADERS) & v.isNotNull()), lambda k, v: F.lower(k))
    return F.transform_values(named, lambda k, v: F.substring(v, 1, 1000))


def brand_token(host: Column) -> Column:
    """The first part of a host name that mixes letters and digits, or is a long number; empty if there is none."""
    return F.regexp_extract(F.lower(host), r"([a-z]+\d+|\d+[a-z]+|\d{3,})", 1)


def content_id(prefix: str, size: int, *fields: Column) -> Column:
    """prefix-<first hex digits of the SHA-256 of the fields>."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, size))


def public_status(navigation: Column, access: Column, adequacy: Column) -> Column:
    return (
        F.when(navigation == "blocked_by_policy", "blocked_by_policy")
        .when(navigation == "timed_out", "timeout")
        .when(navigation != "captured", "collection_failed")
        .when(access == "access_challenge", "access_challenge_observed")
        .when(access == "geo_restriction", "geo_restriction_observed")
        .when(access == "unavailable", "unavailable")
        .when(adequacy == "adequate", "captured")
        .otherwise("captured_with_limitations")
    )
