"""Web pages with the markup that the given pages lack, derived from them: links with attributes and nested labels, messaging links,
assets, buttons, forms, contacts in text, restriction notices.

``WEB`` builds the markup in SQL that Spark and DuckDB both read, so that both sides see the same pages. ``ANCHORS`` states, in
DuckDB SQL, which links those pages hold: the anchors that are there already, by pattern, and those of the list below, as facts. It
never parses the derived markup; the queries do.
"""

from __future__ import annotations

ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
#: (when page_id modulo the first number is the second, markup). {n}: page_id, {m}: page_id modulo 7, {q}: four digits of
#: page_id, {g}: page_id in twelves, so that a few pages share it, {h}: four digits of that, {top}: scheme and host.
#: Links, in order: (modulus, rest, markup, href, label, rel, region, target, download, resolved, crawl identity).
LINKS = [
    (3, 0, '<nav><a class="x" href="https://partner{m}.example.net/path/{n}?ref=PART{g}#f" rel="nofollow Noopener"><b>Partner</b> {m}</a></nav>', "https://partner{m}.example.net/path/{n}?ref=PART{g}#f", "Partner {m}", "nofollow noopener", "nav", "", False, "https://partner{m}.example.net/path/{n}?ref=PART{g}#f", "https://partner{m}.example.net/path/{n}?ref=PART{g}"),
    (4, 1, '<footer><a href="https://t.me/Desk{g}Team" target="_blank">Telegram <i>desk</i></a></footer>', "https://t.me/Desk{g}Team", "Telegram desk", "", "footer", "_blank", False, "https://t.me/Desk{g}Team", "https://t.me/Desk{g}Team"),
    (5, 2, '<a href="https://wa.me/62812{h}{h}">WhatsApp {m}</a>', "https://wa.me/62812{h}{h}", "WhatsApp {m}", "", "document", "", False, "https://wa.me/62812{h}{h}", "https://wa.me/62812{h}{h}"),
    (6, 3, '<main><a href="/files/app{m}.apk" download="app.apk">Get the app</a></main>', "/files/app{m}.apk", "Get the app", "", "main", "", True, "{root}/files/app{m}.apk", "{root}/files/app{m}.apk"),
    (7, 4, '<aside><a href="https://t.me/62855511{q}">Call desk</a></aside>', "https://t.me/62855511{q}", "Call desk", "", "aside", "", False, "https://t.me/62855511{q}", "https://t.me/62855511{q}"),
    (4, 2, '<a href="mailto:info{m}@example.org">Mail us</a>', "mailto:info{m}@example.org", "Mail us", "", "document", "", False, "mailto:info{m}@example.org", ""),
    (5, 0, '<header><a href="/contact-us"><span>Contact</span> us</a></header>', "/contact-us", "Contact us", "", "header", "", False, "{root}/contact-us", "{root}/contact-us"),
    (6, 1, '<a href="/about/company">About</a>', "/about/company", "About", "", "document", "", False, "{root}/about/company", "{root}/about/company"),
    (6, 4, '<a href="/terms-policy">Terms</a>', "/terms-policy", "Terms", "", "document", "", False, "{root}/terms-policy", "{root}/terms-policy"),
    (7, 1, '<a href="/payment">Payment methods</a>', "/payment", "Payment methods", "", "document", "", False, "{root}/payment", "{root}/payment"),
    (7, 5, '<a href="/promo?utm_source=mail&amp;q=1">Bonus <em>event</em></a>', "/promo?utm_source=mail&q=1", "Bonus event", "", "document", "", False, "{root}/promo?utm_source=mail&q=1", "{root}/promo?q=1"),
    (5, 4, '<a href="https://api.whatsapp.com/send?phone=%2B62+899+{q}">Chat</a>', "https://api.whatsapp.com/send?phone=%2B62+899+{q}", "Chat", "", "document", "", False, "https://api.whatsapp.com/send?phone=%2B62+899+{q}", "https://api.whatsapp.com/send?phone=%2B62+899+{q}"),
    (8, 6, '<a href="tg://resolve?domain=Chan{m}Desk">Channel</a>', "tg://resolve?domain=Chan{m}Desk", "Channel", "", "document", "", False, "tg://resolve?domain=Chan{m}Desk", ""),
    (6, 5, '<a href="/login">Log in</a>', "/login", "Log in", "", "document", "", False, "{root}/login", "{root}/login"),
    (9, 2, '<a href="https://u:p@odd.example.net/a/">Odd</a>', "https://u:p@odd.example.net/a/", "Odd", "", "document", "", False, "https://u:p@odd.example.net/a/", ""),
    (8, 3, '<a href="{top}:8443/adm">Port</a>', "{top}:8443/adm", "Port", "", "document", "", False, "{top}:8443/adm", "{root}:8443/adm"),
    (9, 5, '<a href="/acct?token=abc{n}&amp;x=a*b">Account</a>', "/acct?token=abc{n}&x=a*b", "Account", "", "document", "", False, "{root}/acct?token=abc{n}&x=a*b", "{root}/acct?token=abc{n}&x=a%2Ab"),
]
#: Other controls, in order: (modulus, rest, markup, tag, label, form owner, form action, dom path after "body").
CONTROLS = [
    (5, 1, '<button type="button" aria-label="Contact us">Hi</button>', "button", "Contact us", None, None),
    (6, 2, '<form id="f1" action="/search"><button id="find">Find it</button></form>', "button", "Find it", "f1", "/search"),
    (7, 3, '<div role="button">More <b>menu</b></div>', "div", "More menu", None, None),
    (9, 4, "<button>Odd one</button>", "button", "Odd one", None, None),
]
#: (modulus, rest, markup, asset type, host, canonical URL); the host is empty where the page's own host serves it.
ASSETS = [
    (4, 0, '<script src="https://cdn{m}.assets.test/app{g}.js?b=2&amp;a=1#x"></script>', "script", "cdn{m}.assets.test", "https://cdn{m}.assets.test/app{g}.js?a=1&b=2"),
    (5, 3, '<img src="//IMG.example.org/logo{m}.png">', "image", "img.example.org", "{scheme}://img.example.org/logo{m}.png"),
    (6, 0, '<link rel="Stylesheet preload" href="https://cdnjs.cloudflare.com/x.css">', "stylesheet", "cdnjs.cloudflare.com", "https://cdnjs.cloudflare.com/x.css"),
    (7, 0, '<iframe src="/frame"></iframe>', "iframe", "", ""),
    (7, 2, '<link rel="icon" href="https://icons.example.net/i.png">', "icon", "", ""),
]
TEXTS = [
    (3, 2, '<meta property="og:site_name" content="Casino {m}">'),
    (4, 3, "<p>WhatsApp: +62 812 3456 {q}; Telegram: +63 915 7800 {q}</p>"),
    (5, 1, "<p>Write @Desk{m}Alias or Info{m}@example.org or call +44 20 7946 {q}</p>"),
    (6, 5, "<p>Bonus slot jackpot, deposit via DANA, licensed casino</p>"),
    (11, 3, "<p>A special offer with discount and cashback</p>"),
    (20, 7, "<p>Not available in your country</p>"),
    (20, 9, "<p>Checking your browser</p>"),
    (20, 11, "<p>cloudflare</p><p>security check</p>"),
    (20, 13, "<p>temporarily unavailable</p>"),
    (20, 15, "<p>Access denied</p>"),
]
CONSENT_PAGE = "<html><head><title>Choices</title></head><body><p>Manage consent</p><p>Cookie preferences</p></body></html>"
SHORT_PAGE = "<html><body><p>ok</p></body></html>"
#: Which pages keep their own markup.
WHOLE = "page_id % 25 < 23"


def fill(text: str) -> str:
    """SQL that puts a page's numbers into ``text``, an SQL string expression."""
    numbers = {"top": ROOT, "n": "page_id", "m": "page_id % 7", "q": "page_id % 9000 + 1000", "g": "CAST(floor(page_id / 12) AS BIGINT)", "h": "CAST(floor(page_id / 12) AS BIGINT) % 9000 + 1000"}
    for name, value in numbers.items():
        text = f"replace({text}, '{{{name}}}', CAST({value} AS STRING))"
    return text


_EXTRAS = "concat(" + ", ".join(f"CASE WHEN page_id % {a} = {r} THEN '{h}' ELSE '' END" for a, r, h, *_ in [*TEXTS, *LINKS, *CONTROLS, *ASSETS]) + ")"
BASE_HTML = f"CASE WHEN page_id % 25 = 24 THEN '{CONSENT_PAGE}' WHEN page_id % 25 = 23 THEN '{SHORT_PAGE}' ELSE html END"
#: The html of a page, as SQL over the columns page_id and html.
WEB_HTML = f"CASE WHEN {WHOLE} THEN concat(replace(html, '</body>', ''), {fill(_EXTRAS)}) ELSE {BASE_HTML} END"
WEB = f"web AS (SELECT page_id, url, {WEB_HTML} AS html FROM pages)"


def facts(rows: list[tuple], columns: str, texts: int, name: str) -> str:
    """CTE ``name``: page_id, url, k and ``columns`` of each listed row on each page that has it; the first ``texts`` columns are filled in.
    Rows are (modulus, rest, *values)."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    values = ", ".join(f"({k}, {a}, {r}, {', '.join(map(show, v))})" for k, (a, r, *v) in enumerate(rows))
    names = columns.split(", ")
    kept = [f"{fill(c)} AS {c}" if i < texts else c for i, c in enumerate(names)]
    return f"{name} AS (SELECT page_id, url, k, {', '.join(kept)} FROM pages, (VALUES {values}) v(k, a, r, {columns}) WHERE {WHOLE} AND page_id % a = r)"


_PAIRS = "'<a href=\"([^\"]*)\">([^<]*)</a>'"
LINK_FACTS = facts([(a, r, href, label, res, crawl, rel, region, to, dl) for a, r, _, href, label, rel, region, to, dl, res, crawl in LINKS], "href, label, resolved, crawl, rel, region, target_attr, download", 4, "lf")
#: anchors: page_id, url, case_id, elem_ord (from 0), href, label, rel, region, target_attr, download, resolved, target (http form), crawl_url.
ANCHORS = f"""{LINK_FACTS},
an0 AS (SELECT page_id, url, h, l, unnest(range(1, len(h) + 1)) AS ord FROM (SELECT page_id, url, regexp_extract_all(html, {_PAIRS}, 1) AS h, regexp_extract_all(html, {_PAIRS}, 2) AS l FROM (SELECT page_id, url, {BASE_HTML} AS html FROM pages))),
an1 AS (SELECT page_id, url, ord AS pos, h[ord] AS href, trim(l[ord]) AS label, '' AS rel, 'nav' AS region, '' AS target_attr, false AS download, {ROOT} || h[ord] AS resolved,
  lower({ROOT}) || CASE WHEN rtrim(h[ord], '/') = '' THEN '/' ELSE rtrim(h[ord], '/') END AS crawl_url FROM an0
  UNION ALL SELECT page_id, url, 100000 + k, href, label, rel, region, target_attr, download, replace(resolved, '{{root}}', {ROOT}), nullif(replace(crawl, '{{root}}', lower({ROOT})), '') FROM lf),
anchors AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS case_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS elem_ord, href, label, rel, region, target_attr, download, resolved,
  CASE WHEN starts_with(resolved, 'http') THEN replace(regexp_replace(replace(resolved, {ROOT}, lower({ROOT})), '#.*$', ''), 'u:p@', '') END AS target, crawl_url FROM an1)"""
THOST = "regexp_extract(target, '^[a-z]+://([^/?#:]*)', 1)"
