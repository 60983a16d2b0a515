"""What page markup says: links, passive assets, messaging and referral signals, entities, observations, controls.

Every operator reads the node table of ``html.nodes``, with case_id and url, so that a page is parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions import policy, urls
from sightline.operators import observations as ob
from sightline.operators.html import first_text, text_of
from sightline.sources.tables import written

# Hosts of messaging links.
WHATSAPP_HOSTS = ["wa.me", "www.wa.me", "api.whatsapp.com", "web.whatsapp.com"]
TELEGRAM_HOSTS = ["t.me", "www.t.me", "telegram.me", "www.telegram.me"]
# The hosts that observations of links go by, and what a handle is.
OBSERVED_WHATSAPP = ["wa.me", "api.whatsapp.com", "web.whatsapp.com"]
OBSERVED_TELEGRAM = ["t.me", "telegram.me", "www.t.me"]
HANDLE = r"^[A-Za-z][A-Za-z0-9_]{4,31}$"
# Words of a label that opens something harmless.
SAFE_REVEAL = r"(?i)\b(contact(?: us)?|hubungi(?: kami)?|kontak|support|promo(?:tion)?|about|information|menu|help|news|event)\b"
MAX_OBSERVATIONS = 500
MAX_CONTROLS = 300


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _has(name: str) -> Column:
    return F.array_contains(F.map_keys("attrs"), name)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def anchors(nodes: DataFrame) -> DataFrame:
    """page_id, case_id, url, ord, href, label, rel (folded, sorted), region, target_attr, download of each link in a page."""
    rows = nodes.filter((F.col("kind") == "element") & (F.col("tag") == "a") & _attr("href").isNotNull())
    rel = F.array_join(F.array_sort(F.filter(F.split(F.lower(F.coalesce(_attr("rel"), F.lit(""))), r"\s+"), lambda r: r != "")), " ")
    return rows.select("page_id", "case_id", "url", "ord", _attr("href").alias("href"), collapsed(F.col("text")).alias("label"), rel.alias("rel"), "region", F.coalesce(_attr("target"), F.lit("")).alias("target_attr"), _has("download").alias("download"))


def numbered(rows: DataFrame, name: str = "elem_ord") -> DataFrame:
    """``rows`` with their place in their page, from 0."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy("page_id").orderBy("ord")) - 1)


def anchor_links(links: DataFrame) -> DataFrame:
    """``anchors`` that lead to http(s): with target (normalized), host and kind, internal_link or external_link by the page's host."""
    rows = links.withColumn("target", urls.http_url(F.col("href"), F.col("url"))).filter("target is not null").withColumn("host", urls.host(F.col("target")))
    return rows.withColumn("kind", F.when(F.col("host") == urls.host(F.col("url")), "internal_link").otherwise("external_link"))


def assets(nodes: DataFrame) -> DataFrame:
    """page_id, ord, asset_type, observed, canonical, host of passive resources on hosts other than the page's."""
    rel = F.split(F.lower(F.coalesce(_attr("rel"), F.lit(""))), r"\s+")
    kind = (
        F.when((F.col("tag") == "script") & _attr("src").isNotNull(), "script")
        .when((F.col("tag") == "img") & _attr("src").isNotNull(), "image")
        .when((F.col("tag") == "iframe") & _attr("src").isNotNull(), "iframe")
        .when((F.col("tag") == "link") & _attr("href").isNotNull() & F.array_contains(rel, "stylesheet"), "stylesheet")
    )
    rows = nodes.filter("kind = 'element'").filter(F.col("tag").isin("script", "img", "iframe", "link")).withColumn("asset_type", kind).filter("asset_type is not null")
    raw = F.when(F.col("asset_type") == "stylesheet", _attr("href")).otherwise(_attr("src"))
    rows = rows.withColumn("observed", urls.http_url(raw, F.col("url"))).filter("observed is not null")
    rows = rows.withColumns({"canonical": urls.asset_url(F.col("observed")), "host": urls.host(F.col("observed"))}).filter(F.col("host") != urls.host(F.col("url")))
    return rows.select("page_id", "ord", "asset_type", "observed", "canonical", "host")


SIGNAL = ["page_id", "type", "value", "method", "priority", "stage", "ord"]


def _signals(rows: DataFrame, kind: str | Column, value: Column, method: str | Column, stage: int, priority: int = 0) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("page_id", lit(kind).alias("type"), value.alias("value"), lit(method).alias("method"), F.lit(priority).alias("priority"), F.lit(stage).alias("stage"), F.col("ord").cast("int").alias("ord"))


def asset_signals(nodes: DataFrame) -> DataFrame:
    """SIGNAL rows: the host and the exact URL of each asset."""
    rows = written(assets(nodes), "assets")
    method = F.concat(F.lit("html_"), "asset_type", F.when(F.col("asset_type") == "stylesheet", "_href").otherwise("_src"))
    return _signals(rows, "external_asset_domain", F.col("host"), method, 7).unionByName(_signals(rows, "external_asset_url", F.col("canonical"), method, 7))


def _first_segment(url: Column) -> Column:
    return F.regexp_extract(urls.path(url), r"^/*([^/]*)", 1)


def _parameter(url: Column, name: str) -> Column:
    """The first non-blank value of a query parameter; empty if there is none."""
    return F.coalesce(F.get(F.filter(urls.pairs(urls.query(url), blanks=False), lambda p: p["key"] == name), F.lit(0))["value"], F.lit(""))


def telegram_signals(links: DataFrame, texts: DataFrame) -> DataFrame:
    """SIGNAL rows: handles of Telegram links (priority 0) and in visible text (priority 1)."""
    href = F.trim("href")
    by_host = F.when(urls.host(href).isin(TELEGRAM_HOSTS), _first_segment(href))
    handle = F.coalesce(by_host, F.when((urls.scheme(href) == "tg") & (F.lower(urls.authority(href)) == "resolve"), _parameter(href, "domain")))
    linked = links.withColumn("handle", handle).filter(F.col("handle").rlike(HANDLE))
    written = texts.select("page_id", F.posexplode(F.regexp_extract_all("text", F.lit(ob.HANDLE), F.lit(1))).alias("ord", "handle"))
    value = F.concat(F.lit("@"), F.lower("handle"))
    return _signals(linked, "telegram", value, "html_anchor", 4).unionByName(_signals(written, "telegram", value, "plain_text_regex", 4, priority=1))


def whatsapp_signals(links: DataFrame) -> DataFrame:
    """SIGNAL rows: +digits of WhatsApp links, or the link where it carries no number of 6 to 15 digits."""
    rows = links.withColumn("to", urls.resolve(F.col("url"), F.trim("href")))
    rows = rows.filter((urls.scheme(F.col("to")) == "whatsapp") | urls.host(F.col("to")).isin(WHATSAPP_HOSTS))
    phone = _parameter(F.col("to"), "phone")
    rows = rows.withColumn("number", policy.digits(F.when(phone != "", phone).otherwise(_first_segment(F.col("to")))))
    number = F.when(F.length("number").between(6, 15), F.concat(F.lit("+"), "number"))
    return _signals(rows, "whatsapp_or_phone", F.coalesce(number, F.lower(F.regexp_replace("to", "#.*$", ""))), "html_anchor", 5)


def referral_signals(pages: DataFrame, links: DataFrame) -> DataFrame:
    """SIGNAL rows: recognized query pairs of the pages' own URLs and of their http(s) links."""
    every = pages.select("page_id", F.lit(-1).alias("ord"), F.col("url").alias("u")).unionByName(links.select("page_id", "ord", F.col("target").alias("u")))
    pair = every.select("page_id", "ord", F.explode(urls.pairs(urls.query(F.col("u")), blanks=False)).alias("p"))
    pair = pair.withColumns({"k": F.lower("p.key"), "v": F.trim("p.value")}).filter(F.col("k").isin(ob.REFERRAL_KEYS) & (F.col("v") != ""))
    return _signals(pair, "referral", F.concat_ws("=", "k", "v"), "url_query_parameter", 6)


def entities(pages: DataFrame, nodes: DataFrame, start: int = 1) -> DataFrame:
    """page_id, entity_id, type, value, method: one entity for each (type, value) of a page, numbered in that order from ``start`` on.

    Of several signals with the same type and value the one of least priority counts, then of least method, then the first in the page.
    ``pages`` has page_id and url, which is seed and final URL.
    """
    # links, texts and assets are read several times below
    links = written(anchors(nodes), "anchors")
    targets = written(anchor_links(links), "targets")
    at_start = pages.withColumn("ord", F.lit(0))
    title = first_text(nodes, "title").withColumn("ord", F.lit(0))
    every = [
        _signals(at_start, "seed_url", F.col("url"), "collection_input", 0), _signals(at_start, "final_url", F.col("url"), "browser_final_url", 1),
        _signals(title, "page_title", policy.fold(F.col("text")), "html_title", 2), _signals(targets, F.col("kind"), F.col("target"), "html_anchor", 3),
        _signals(targets, "referenced_domain", F.col("host"), "html_anchor", 3), telegram_signals(links, text_of(nodes)), whatsapp_signals(links), referral_signals(pages, targets), asset_signals(nodes),
    ]
    best = W.partitionBy("page_id", "type", "value").orderBy("priority", "method", "stage", "ord")
    one = reduce(DataFrame.unionByName, every).withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("type", "value", "method"))
    return one.select("page_id", F.format_string("entity-%03d", rank + (start - 1)).alias("entity_id"), "type", "value", "method")


OBSERVATION = ["page_id", "observation_type", "value", "method", "confidence", "stage", "ord", "sub", "raw", "strength", "context", "attributes", "href", "label"]


def _observations(
    rows: DataFrame, kind: str | Column, value: Column, method: str | Column, stage: int, sub: int | Column = 0, confidence: float = 1.0, raw: Column | None = None, strength: str = "strong", context: Column | None = None,
    attributes: dict[str, Column] | None = None, element: tuple[str | None, str] | None = None,
) -> DataFrame:
    """``raw`` is the value as it stands in the page, ``context`` what is around it (of an element, its text), ``element`` the columns of its href and its text."""
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    blank = F.lit(None).cast("string")
    href, label = (F.col(c) if c else blank for c in element) if element else (blank, blank)
    pairs = [x for k, v in (attributes or {}).items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return rows.select(
        "page_id", lit(kind).alias("observation_type"), bounded(value, 2000).alias("value"), lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(stage).alias("stage"), F.col("ord").cast("int").alias("ord"), lit(sub).cast("int").alias("sub"),
        bounded(value if raw is None else raw, 2000).alias("raw"), F.lit(strength).alias("strength"), bounded(F.coalesce(context if context is not None else label, F.lit("")), 1000).alias("context"), F.create_map(*pairs).cast("map<string,string>").alias("attributes"), href.alias("href"), label.alias("label"),
    )


def bounded(text: Column, limit: int) -> Column:
    """Without controls but line ends and tabs, trimmed, cut at a length."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), r"^\s+|\s+$", ""), 1, limit)


def around(text: Column, found: Column) -> Column:
    """What stands 120 characters before and after the first place of ``found``."""
    at = F.instr(text, found)
    start = F.greatest(at - 120, F.lit(1))
    return bounded(F.substr(text, start, at + F.length(found) + 120 - start), 300)


def normalized_url(url: Column) -> Column:
    """A URL as observations name it: lower-case scheme and host, no userinfo, default port or fragment, / for an empty path."""
    host = F.lower(urls.raw_host(url))
    default = F.when(urls.scheme(url) == "https", F.lit("443")).when(urls.scheme(url) == "http", F.lit("80"))
    port = F.when(urls.port(url).isNull() | F.coalesce(urls.port(url) == default, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(":"), urls.port(url)))
    query = F.when(urls.query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), urls.query(url)))
    return F.concat(urls.scheme(url), F.lit("://"), host, port, F.when(urls.path(url) == "", F.lit("/")).otherwise(urls.path(url)), query)


def brand_observations(nodes: DataFrame) -> DataFrame:
    """OBSERVATION rows: the first site name, first heading and title of a page."""
    sites = nodes.filter((F.col("kind") == "element") & (F.col("tag") == "meta") & (_attr("property") == "og:site_name"))
    site = sites.groupBy("page_id").agg(F.min_by(_attr("content"), "ord").alias("text")).filter("text <> ''")
    out = []
    for sub, (rows, method, confidence) in enumerate([(site, "meta_og_site_name", 0.95), (first_text(nodes, "h1"), "dom_h1", 0.85), (first_text(nodes, "title"), "document_title", 0.85)]):
        claim = {"entity_class": F.lit("ClaimedBrandIdentity"), "verified_ownership": F.lit("false")}
        out.append(_observations(rows.withColumn("ord", F.lit(0)), "claimed_brand_identity", policy.fold(collapsed(F.col("text"))), method, 0, sub, confidence, F.col("text"), "moderate", attributes=claim, element=None if sub == 0 else (None, "text")))
    return reduce(DataFrame.unionByName, out)


def link_rows(links: DataFrame) -> DataFrame:
    """``anchors`` with the parts that observations are made of: to (resolved), host, first (path segment), norm, is_http."""
    rows = links.withColumn("to", urls.resolve(F.col("url"), F.trim("href")))
    return rows.withColumns({"is_http": urls.scheme(F.col("to")).isin("http", "https"), "host": F.lower(urls.raw_host(F.col("to"))), "first": _first_segment(F.col("to")), "norm": normalized_url(F.col("to"))})


def outgoing_links(rows: DataFrame) -> DataFrame:
    """OBSERVATION rows with label, new_tab and download: http(s) links of ``link_rows``."""
    out = _observations(rows.filter("is_http"), "public_outgoing_link", F.col("norm"), "dom_anchor", 1, raw=F.col("to"), attributes=_link_attributes(), element=("href", "label"))
    return out.withColumns({"new_tab": F.col("attributes")["new_tab"] == "true", "download": F.col("attributes")["download_attribute"] == "true"})


def _link_attributes() -> dict[str, Column]:
    return {
        "visible_label": bounded(F.col("label"), 500), "destination": F.col("to"), "normalized_destination": F.col("norm"), "relation_type": F.lit("public_anchor"), "target": F.col("target_attr"), "new_tab": F.lower("target_attr") == "_blank",
        "download_attribute": F.col("download"), "destination_permitted": F.coalesce(F.col("is_http"), F.lit(False)),
    }


def messaging_links(rows: DataFrame) -> DataFrame:
    """OBSERVATION rows of Telegram and WhatsApp links. A Telegram name with 8 digits or more is a contact, else an alias."""
    name = F.lower(F.regexp_replace("first", "^@+", ""))
    digits = policy.digits(name)
    telegram = rows.filter(F.col("host").isin(OBSERVED_TELEGRAM) & (F.col("first") != ""))
    contact = F.length(digits) >= 8
    kind = F.when(contact, "public_telegram_contact").otherwise("public_telegram_alias")
    value = F.when(contact, F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("@"), name))
    whatsapp = rows.filter(F.col("host").isin(OBSERVED_WHATSAPP))
    path = F.regexp_replace(urls.path(F.col("to")), "/", "")
    number = policy.digits(F.when(path != "", path).otherwise(_parameter(F.col("to"), "phone")))
    link = F.when(number != "", F.concat(F.lit("https://wa.me/"), number)).otherwise(F.col("norm"))
    own = {"raw": F.trim("href"), "element": ("href", "label")}
    return _observations(telegram, kind, value, "dom_anchor_telegram", 1, 1, **own).unionByName(_observations(whatsapp, "public_whatsapp_link", link, "dom_anchor_whatsapp", 1, 2, **own))


def downloads(rows: DataFrame) -> DataFrame:
    """OBSERVATION rows of links with a download attribute or a binary's extension."""
    return _observations(rows.filter(F.col("download") | F.lower(urls.path(F.col("to"))).rlike(ob.DOWNLOADS)), "public_download_destination", F.col("norm"), "dom_download_inspection", 1, 3, raw=F.col("to"), attributes=_link_attributes() | {"navigation_blocked": F.lit("true")}, element=("href", "label"))


def parameter_observations(rows: DataFrame) -> DataFrame:
    """OBSERVATION rows of referral codes and tracking identifiers in the queries of links."""
    pair = rows.select("page_id", "ord", "to", "href", "label", F.posexplode(urls.pairs(urls.query(F.col("to")), blanks=False)).alias("k", "p"))
    pair = pair.withColumns({"key": F.lower("p.key"), "v": policy.fold(F.trim("p.value"))})
    codes = pair.filter(F.col("key").isin(ob.OBSERVED_REFERRALS) & (F.col("v") != ""))
    marks = pair.filter(F.col("key").startswith("utm_") | F.col("key").isin(ob.TRACKING))
    own = {"attributes": {"parameter": F.col("key"), "destination": F.col("to")}, "element": ("href", "label")}
    out = _observations(codes, "public_referral_code", F.col("v"), F.concat(F.lit("url_query:"), "key"), 1, F.col("k") * 2 + 4, raw=F.col("p.value"), **own)
    return out.unionByName(_observations(marks, "public_tracking_identifier", F.concat_ws("=", "key", "v"), "url_tracking_parameter", 1, F.col("k") * 2 + 5, raw=F.concat_ws("=", "p.key", "p.value"), strength="moderate", **own))


def text_observations(texts: DataFrame) -> DataFrame:
    """OBSERVATION rows of visible text (page_id, text): labelled channel numbers, e-mail addresses, other phones, aliases, claim terms.

    Texts are written once with their variants, since each kind of find reads them."""

    def found(source: str, pattern: str, group: int = 1) -> DataFrame:
        return base.select("page_id", "text", F.posexplode(F.regexp_extract_all(source, F.lit(pattern), F.lit(group))).alias("ord", "m"))

    # a number that follows a channel's name is no phone number of its own
    base = written(texts.select("page_id", "text", F.regexp_replace("text", ob.CHANNEL_PHONE, "$1 : ").alias("rest"), policy.fold(F.col("text")).alias("folded")), "texts")
    long = F.length(policy.digits(F.col("m"))) >= 8
    digits, regex = policy.digits(F.col("m")), "visible_text_regex"
    whatsapp, telegram = found("text", ob.WHATSAPP_PHONE).filter(long), found("text", ob.TELEGRAM_PHONE).filter(long)
    phone = F.concat(F.when(F.trim("m").startswith("+"), F.lit("+")).otherwise(F.lit("")), digits)
    seen = {"raw": F.col("m"), "context": around(F.col("text"), F.col("m"))}
    out = [
        _observations(whatsapp, "public_whatsapp_link", F.concat(F.lit("https://wa.me/"), digits), "visible_text_channel_label", 2, confidence=0.9, **seen),
        _observations(telegram, "public_telegram_contact", F.concat(F.lit("+"), digits), "visible_text_channel_label", 3, confidence=0.9, **seen),
        _observations(found("text", ob.EMAIL), "public_email_address", policy.fold(F.col("m")), regex, 4, **seen),
        _observations(found("rest", ob.PHONE).filter(long), "public_phone_number", phone, regex, 5, strength="moderate", **seen),
        _observations(found("text", ob.ALIAS), "public_telegram_alias", F.concat(F.lit("@"), F.lower("m")), regex, 6, confidence=0.9, raw=F.concat(F.lit("@"), "m"), strength="moderate", context=seen["context"]),
    ]
    for stage, (kind, terms) in enumerate(ob.CLAIMS.items(), 7):
        listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(t).alias("m")) for k, t in enumerate(sorted(terms))])
        hits = base.select("page_id", "text", F.inline(F.filter(listed, lambda x: F.instr(F.col("folded"), x["m"]) > 0)))
        out.append(_observations(hits, kind, F.col("m"), "visible_text_dictionary", stage, confidence=0.75, strength="weak", context=around(F.lower("text"), F.col("m")), attributes={"public_claim_only": F.lit("true")}))
    return reduce(DataFrame.unionByName, out)


def redirect_observations(redirects: DataFrame) -> DataFrame:
    """OBSERVATION rows of redirects (page_id, hop, source, target, status_code, raw_location)."""
    facts = {"source_url": F.col("source"), "status_code": F.col("status_code"), "raw_location": F.col("raw_location")}
    return _observations(redirects.withColumn("ord", F.col("hop")), "public_redirect_target", normalized_url(F.col("target")), "network_redirect", 11, raw=F.col("target"), context=F.concat(F.lit("Redirect observed from "), "source"), attributes=facts)


def _snapshot_of(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rows`` with s (snap, selector, x, y, width, height): the first of their page's snapshots (these and href, text) whose link has the path of the row's href, or whose text
    is the start of the row's label. Two equi-joins over the distinct elements of a page."""
    s = F.struct("snap", "selector", "x", "y", "width", "height")
    by_path = snapshots.filter("href <> ''").groupBy("page_id", urls.path(F.col("href")).alias("path")).agg(F.min(s).alias("s"))
    by_text = snapshots.filter("text <> ''").groupBy("page_id", F.col("text").alias("shown")).agg(F.min(s).alias("s"))
    one = rows.filter("href is not null or label is not null").select("page_id", "href", "label").distinct().withColumns({"path": urls.path(F.col("href")), "shown": F.substring("label", 1, 200)})
    found = one.filter("href <> ''").join(by_path, ["page_id", "path"]).select("page_id", "href", "label", "s").unionByName(one.filter("shown <> ''").join(by_text, ["page_id", "shown"]).select("page_id", "href", "label", "s"))
    best = found.groupBy(F.col("page_id").alias("p"), F.col("href").alias("h"), F.col("label").alias("l")).agg(F.min("s").alias("s"))
    return rows.join(best, (F.col("page_id") == F.col("p")) & F.col("href").eqNullSafe(F.col("h")) & F.col("label").eqNullSafe(F.col("l")), "left").drop("p", "h", "l")


def semantic_evidence(nodes: DataFrame, redirects: DataFrame, snapshots: DataFrame, start: int = 1) -> DataFrame:
    """page_id, observation_id, observation_type, raw, value, selector, box, context, confidence, method, strength, attributes: all observations of a page, redirects included, in their
    order of emission, one for each (type, value, selector of the element's snapshot), MAX_OBSERVATIONS at most, numbered from ``start`` on.

    Context is the text around a find in visible text, and the element's own text for elements. Snapshots: page_id, snap, href, text, selector, x, y, width, height.
    """
    found = written(_every(nodes, redirects).filter("value <> '' and raw <> ''"), "evidence")  # read twice below
    every = _snapshot_of(found, snapshots).withColumn("selector", F.col("s.selector"))
    order = ["stage", "ord", "sub"]
    first = F.row_number().over(W.partitionBy("page_id", "observation_type", "value", "selector").orderBy(*order))
    one = every.withColumn("nth", first).filter("nth = 1").withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(*order, "selector"))).filter(F.col("place") <= MAX_OBSERVATIONS)
    box = F.when(F.col("s").isNotNull(), F.struct("s.x", "s.y", "s.width", "s.height"))
    return one.select("page_id", F.format_string("observation-%04d", F.col("place") + (start - 1)).alias("observation_id"), "observation_type", "raw", "value", "selector", box.alias("box"), "context", "confidence", "method", "strength", "attributes")


def _every(nodes: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    rows = written(link_rows(anchors(nodes)), "links")  # read by each kind of link
    parts = [brand_observations(nodes), outgoing_links(rows).select(OBSERVATION), messaging_links(rows), downloads(rows), parameter_observations(rows), text_observations(text_of(nodes))]
    return reduce(DataFrame.unionByName, parts if redirects is None else [*parts, redirect_observations(redirects)])


def semantic_observations(nodes: DataFrame) -> DataFrame:
    """page_id, observation_id, observation_type, value, method, confidence: the observations of a page without snapshots and redirects, one for each (type, value)."""
    every = _every(nodes).filter("value <> ''")
    order = ["stage", "ord", "sub"]
    first = F.row_number().over(W.partitionBy("page_id", "observation_type", "value").orderBy(*order))
    one = every.withColumn("nth", first).filter("nth = 1").withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy(*order))).filter(F.col("place") <= MAX_OBSERVATIONS)
    return one.select("page_id", F.format_string("observation-%04d", "place").alias("observation_id"), "observation_type", "value", "method", "confidence")


def controls(nodes: DataFrame) -> DataFrame:
    """page_id, element_id, ord, tag, role, label, text, href, action, form_owner, form_action, download, new_tab, behavior, path, fingerprint:
    the links, buttons and elements in the role of one, of the first MAX_CONTROLS of a page, one for each (label, href)."""
    rows = nodes.filter((F.col("kind") == "element") & (F.col("tag").isin("a", "button") | (_attr("role") == "button")))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("page_id").orderBy("ord"))).filter(F.col("nth") <= MAX_CONTROLS)
    text, raw = F.substring(collapsed(F.col("text")), 1, 200), F.trim(F.coalesce(_attr("href"), F.lit("")))
    aria = F.trim(F.coalesce(_attr("aria-label"), F.lit("")))
    rows = rows.withColumns({"shown": text, "label": F.when(aria != "", aria).otherwise(text), "href": F.when((F.col("tag") == "a") & ~raw.isin("", "#"), urls.resolve(F.col("url"), raw))}).filter("label <> ''")
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("page_id", policy.fold(F.col("label")), "href").orderBy("ord"))).filter("again = 1")
    forms = nodes.filter("kind = 'element' and tag = 'form'").select("page_id", F.col("ord").alias("form"), F.coalesce(_attr("id"), F.lit("form")).alias("form_owner"), F.when(_attr("action") != "", urls.resolve(F.col("url"), _attr("action"))).alias("form_action"))
    rows = rows.join(forms, ["page_id", "form"], "left")
    behavior = F.when(F.col("href").isNotNull(), "open_public_link").when(F.col("label").rlike(SAFE_REVEAL), "reveal_tab").otherwise("none")
    role = F.when(F.col("tag") == "a", "link").otherwise(F.coalesce(F.nullif(_attr("role"), F.lit("")), F.lit("button")))
    number = F.row_number().over(W.partitionBy("page_id").orderBy("ord"))
    out = rows.select(
        "page_id", F.format_string("live-%03d", number).alias("element_id"), "ord", "tag", role.alias("role"), "label", F.col("shown").alias("text"), "href",
        F.nullif(_attr("formaction"), F.lit("")).alias("action"), "form_owner", "form_action", _has("download").alias("download"), (F.lower(F.coalesce(_attr("target"), F.lit(""))) == "_blank").alias("new_tab"),
        behavior.alias("behavior"), "path",
    )
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct("path", "role", "tag", "label", "text", "href", "action")), 256))
