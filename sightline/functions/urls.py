"""URL expressions: splitting, resolving and the canonical forms, as Column builders without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The generic URI syntax of RFC 3986, appendix B.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME, _AUTHORITY, _PATH, _QUERY, _FRAGMENT = range(1, 6)
TRACKING_KEYS = ["fbclid", "gclid"]


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, _SCHEME))


def authority(url: Column) -> Column:
    return part(url, _AUTHORITY)


def path(url: Column) -> Column:
    return part(url, _PATH)


def query(url: Column) -> Column:
    """Without its question mark; empty if there is none."""
    return F.regexp_replace(part(url, _QUERY), r"^\?", "")


def userinfo(url: Column) -> Column:
    """Null if the authority has no @."""
    return F.when(F.instr(authority(url), "@") > 0, F.regexp_extract(authority(url), r"^(.*)@", 1))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^.*@", "")


def raw_host(url: Column) -> Column:
    return F.regexp_extract(_host_port(url), r"^(\[[^\]]*\]|[^:]*)", 1)


def port(url: Column) -> Column:
    """Null if none is written."""
    return F.nullif(F.regexp_extract(_host_port(url), r":([0-9]*)$", 1), F.lit(""))


def to_ascii(host: Column) -> Column:
    """IDNA form; only names beyond ASCII go through java.net.IDN, and null comes back for those it rejects."""
    return F.when(host.rlike(r"^[\x00-\x7F]*$"), host).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))


def host(url: Column) -> Column:
    """Lower case, without final dots, in ASCII; null where there is none."""
    return F.nullif(to_ascii(F.lower(F.regexp_replace(raw_host(url), r"\.+$", ""))), F.lit(""))


def bare_host(url: Column) -> Column:
    """``host`` without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _dots(joined: Column) -> Column:
    """Removes . and .. segments of an absolute path."""
    parts = F.split(joined, "/")
    last = F.element_at(parts, -1)

    def step(out: Column, s: Column) -> Column:
        up = F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
        return F.when(s == "..", up).when(s == ".", out).otherwise(F.concat(out, F.array(s)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    text = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), F.when(text == "", F.lit("/")).otherwise(text)).otherwise(joined)


def resolve(base: Column, raw: Column) -> Column:
    """The reference ``raw`` against ``base`` (RFC 3986, section 5.2)."""
    root = F.concat(part(base, _SCHEME), F.lit("://"), authority(base))
    base_path = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    tail = F.concat(part(raw, _QUERY), part(raw, _FRAGMENT))
    return (
        F.when(part(raw, _SCHEME) != "", raw)
        .when(raw.startswith("//"), F.concat(part(base, _SCHEME), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(root, _dots(path(raw)), tail))
        .when(path(raw) != "", F.concat(root, _dots(F.concat(folder, path(raw))), tail))
        .when(part(raw, _QUERY) != "", F.concat(root, path(base), tail))
        .when(part(raw, _FRAGMENT) != "", F.concat(root, path(base), part(base, _QUERY), part(raw, _FRAGMENT)))
        .otherwise(base)
    )


def _netloc(url: Column) -> Column:
    default = F.when(scheme(url) == "https", F.lit("443")).otherwise(F.lit("80"))
    return F.concat(host(url), F.when(port(url).isNull() | (port(url) == default), F.lit("")).otherwise(F.concat(F.lit(":"), port(url))))


def _is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & host(url).isNotNull()


def http_url(raw: Column, base: Column) -> Column:
    """Resolved http(s) URL: lower-case host, no default port, no fragment, / for an empty path; else null."""

    def form(url: Column) -> Column:
        shown = F.concat(scheme(url), F.lit("://"), _netloc(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url))))
        return F.when(_is_http(url), shown)

    return F.when(F.trim(raw) != "", let(let(F.trim(raw), lambda r: resolve(base, r)), form))


def decode(text: Column) -> Column:
    """Form decoding; text with broken escapes stays."""
    return F.coalesce(F.try_url_decode(text), F.regexp_replace(text, r"\+", " "))


def encode(text: Column) -> Column:
    """Form encoding that leaves letters, digits and _.-~ alone."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(text: Column, blanks: bool = True) -> Column:
    """array<struct<key,value>> of a query string, decoded; without pairs that have no value unless ``blanks``."""
    fields = F.filter(F.split(text, "&"), lambda f: f != "")
    key = lambda f: F.substring_index(f, "=", 1)
    value = lambda f: F.when(F.instr(f, "=") > 0, F.substr(f, F.length(key(f)) + 2)).otherwise(F.lit(""))
    out = F.transform(fields, lambda f: F.struct(decode(key(f)).alias("key"), decode(value(f)).alias("value")))
    return out if blanks else F.filter(out, lambda p: p["value"] != "")


def join_pairs(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"]))), "&")


def _with_query(front: Column, text: Column) -> Column:
    return F.concat(front, F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)))


def asset_url(observed: Column) -> Column:
    """An ``http_url`` with its query pairs in order and none dropped."""

    def form(url: Column) -> Column:
        front = F.concat(scheme(url), F.lit("://"), authority(url), path(url))
        return _with_query(front, join_pairs(F.array_sort(pairs(query(url)))))

    return let(observed, form)


def _is_tracking(key: Column) -> Column:
    return F.lower(key).startswith("utm_") | F.lower(key).isin(TRACKING_KEYS)


def crawl_url(raw: Column, base: Column) -> Column:
    """Crawl identity: an ``http_url`` without userinfo, tracking pairs or final slashes, with its query pairs in order."""

    def form(url: Column) -> Column:
        trimmed = F.regexp_replace(path(url), "/+$", "")
        front = F.concat(scheme(url), F.lit("://"), _netloc(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed))
        kept = F.array_sort(F.filter(pairs(query(url)), lambda p: ~_is_tracking(p["key"])))
        return F.when(_is_http(url) & userinfo(url).isNull(), _with_query(front, join_pairs(kept)))

    return F.when(F.trim(raw) != "", let(let(F.trim(raw), lambda r: resolve(base, r)), form))


def comparable(url: Column) -> Column:
    """Key under which two URLs are the same public page: scheme, authority, path without final slashes, query."""
    return F.concat_ws("|", scheme(url), F.lower(authority(url)), F.regexp_replace(path(url), "/+$", ""), query(url))


def folded(url: Column) -> Column:
    """Key of the plainest comparison: without final slashes, in lower case."""
    return F.lower(F.regexp_replace(url, "/+$", ""))


def evaluated(url: Column) -> Column:
    """Key under which an evaluation compares URLs: lower-case scheme and host without final dots or default port, / for an empty path, the
    query, no fragment."""
    name = F.lower(F.regexp_replace(raw_host(url), r"\.+$", ""))
    default = F.when(scheme(url) == "https", F.lit("443")).otherwise(F.lit("80"))
    shown = F.when(port(url).isNull() | (port(url) == default), name).otherwise(F.concat(name, F.lit(":"), port(url)))
    return _with_query(F.concat(scheme(url), F.lit("://"), shown, F.when(path(url) == "", F.lit("/")).otherwise(path(url))), query(url))
