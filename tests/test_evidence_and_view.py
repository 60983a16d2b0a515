"""Observations with raw values, selectors, context and attributes; the view of a case. Expected rows are stated by hand."""

import json

from sightline.operators import html, markup, view
from sightline.sources import packages as src

PAGE = """<html><head><title> My  Site </title><meta property="og:site_name" content="Brand X"></head><body><h1>Welcome</h1>
<a href="/go?ref=ABC123&utm_source=Feed" target="_blank">Join  now</a> <a href="/go?ref=ABC123&utm_source=Feed">Other</a> <a href="https://t.me/SomeName">Chat</a> <a href="/app.apk" download>App</a>
<p>Write to Help@X.example or call +62 812-3456-7890 today. Pay with DANA.</p></body></html>"""


def evidence(spark, start=1):
    pages = spark.createDataFrame([(1, "https://x.example/home", "x", PAGE)], "page_id long, url string, case_id string, html string")
    snaps = spark.createDataFrame([(1, 0, "/go", "", "a.first", 1, 2, 3, 4), (1, 1, "", "Other", "a.second", 5, 6, 7, 8), (1, 2, "/nowhere", "Welcome", "h1", 9, 9, 9, 9), (2, 0, "/app.apk", "", "other page", 0, 0, 0, 0)], "page_id long, snap int, href string, text string, selector string, x int, y int, width int, height int")
    moved = spark.createDataFrame([(1, 0, "https://x.example/a", "HTTPS://Y.example:443/b#c", 301, "/b#c")], "page_id long, hop int, source string, target string, status_code int, raw_location string")
    return markup.semantic_evidence(html.nodes(pages), moved, snaps, start).collect()


def test_evidence_of_a_page(spark):
    rows = evidence(spark)
    got = {(r.observation_type, r.value, r.selector): r for r in rows}
    assert len(got) == len(rows) and [r.observation_id for r in sorted(rows, key=lambda r: r.observation_id)] == [f"observation-{k:04d}" for k in range(1, len(rows) + 1)]
    link = got["public_outgoing_link", "https://x.example/go?ref=ABC123&utm_source=Feed", "a.first"]
    assert link.attributes["new_tab"] == "true" and link.attributes["visible_label"] == "Join now" and link.attributes["destination_permitted"] == "true" and link.context == "Join now" and tuple(link.box) == (1, 2, 3, 4)
    # the second link with that path is taken for the first one's snapshot, so its observations repeat
    assert sum(r.observation_type == "public_outgoing_link" and "/go" in r.value for r in rows) == 1
    assert got["public_referral_code", "abc123", "a.first"].raw == "ABC123" and got["public_referral_code", "abc123", "a.first"].attributes["parameter"] == "ref"
    mark = got["public_tracking_identifier", "utm_source=feed", "a.first"]
    assert (mark.raw, mark.strength, mark.method) == ("utm_source=Feed", "moderate", "url_tracking_parameter")
    chat = got["public_telegram_alias", "@somename", None]
    assert (chat.raw, chat.method, chat.box) == ("https://t.me/SomeName", "dom_anchor_telegram", None)
    app = got["public_download_destination", "https://x.example/app.apk", None]
    assert app.attributes["navigation_blocked"] == "true" and app.attributes["download_attribute"] == "true"
    assert got["claimed_brand_identity", "welcome", "h1"].raw == "Welcome" and got["claimed_brand_identity", "brand x", None].confidence == 0.95
    mail = got["public_email_address", "help@x.example", None]
    assert mail.raw == "Help@X.example" and "Write to Help@X.example or call" in mail.context and len(mail.context) <= 300
    phone = got["public_phone_number", "+6281234567890", None]
    assert phone.raw == "+62 812-3456-7890" and phone.strength == "moderate"
    moved = got["public_redirect_target", "https://y.example/b", None]
    assert moved.raw == "HTTPS://Y.example:443/b#c" and moved.context == "Redirect observed from https://x.example/a" and moved.attributes == {"source_url": "https://x.example/a", "status_code": "301", "raw_location": "/b#c"}
    assert min(r.observation_id for r in evidence(spark, 41)) == "observation-0041"


def test_one_value_with_two_selectors_is_two_observations(spark):
    page = '<html><body><a href="https://y.example/p">One</a><a href="https://y.example/p#q">Two</a></body></html>'
    pages = spark.createDataFrame([(1, "https://x.example/", "x", page)], "page_id long, url string, case_id string, html string")
    snaps = spark.createDataFrame([(1, 0, "", "One", "a.one", 0, 0, 1, 1), (1, 1, "", "Two", "a.two", 0, 0, 1, 1)], "page_id long, snap int, href string, text string, selector string, x int, y int, width int, height int")
    none = spark.createDataFrame([], "page_id long, hop int, source string, target string, status_code int, raw_location string")
    got = [(r.observation_type, r.value, r.selector) for r in markup.semantic_evidence(html.nodes(pages), none, snaps).collect()]
    assert sorted(got) == [("public_outgoing_link", "https://y.example/p", "a.one"), ("public_outgoing_link", "https://y.example/p", "a.two")]


def test_view_of_a_case(spark, tmp_path):
    seen = lambda i, t, v, page="p1": {"id": i, "observation_type": t, "normalized_value": v, "source_page_id": page}
    package = {
        "case": {"case_id": "c", "status": "completed", "final_url": "https://www.bet88.example/", "seed_url": "https://bet88.example/", "capture_adequacy": "adequate"},
        "pages": [{"id": "p2", "final_url": "https://bet88.example/b?token=1"}, {"id": "p1", "final_url": "https://bet88.example/"}], "entities": [],
        "evidence": [{"id": "e1", "type": "full_page_screenshot", "page_id": "p2"}, {"id": "e2", "type": "html_page", "page_id": "p1"}],
        "frontier": [{"id": "f1", "normalized_url": "https://other.example/x", "source_page_id": "p1"}, {"id": "f2", "normalized_url": "https://known.example/y", "source_page_id": "p2"}, {"id": "f3", "normalized_url": "https://www.bet88.example/own", "source_page_id": "p1"}],
        "observations": [seen("o1", "public_redirect_target", "https://mybet88.test/r"), seen("o2", "public_phone_number", "+6281234567890", "p2"), seen("o3", "public_offer_claim", "bonus"), seen("o4", "public_referral_code", "abc"), seen("o5", "public_offer_claim", "cashback"), seen("o6", "public_outgoing_link", "https://cand.example/", "lost"), *[seen(f"s{k:02d}", "public_email_address", f"m{k}@x.example") for k in range(20)]],
        "candidates": {"source_case_id": "c", "candidates": [{"id": "k", "registrable_domain": "cand.example", "reasons": []}]}, "candidate_observations": [],
    }
    empty = {"case": {"case_id": "d", "status": "completed", "seed_url": "https://d.example/"}, "pages": [], "evidence": [], "entities": []}
    for case, parts in (("c", package), ("d", empty)):
        (tmp_path / case).mkdir()
        for part, content in parts.items():
            (tmp_path / case / f"{part}.json").write_text(json.dumps(content))
    known = spark.createDataFrame([("known.example",), ("bet88.example",)], "host string")
    rows = view.case_projection(src.read_tables(src.read_packages(spark, str(tmp_path))), known).collect()
    by = lambda item, case="c": {r.id: r for r in rows if r.item == item and r.case_id == case}
    nodes, edges, line = by("node"), by("edge"), by("timeline")
    order = [n.id for n in sorted(nodes.values(), key=lambda n: n.sequence)]
    assert order[:5] == ["page:p1", "page:p2", "destination:known.example", "destination:mybet88.test", "destination:cand.example"]
    assert (nodes["destination:known.example"].kind, nodes["destination:mybet88.test"].kind, nodes["destination:cand.example"].status) == ("external_destination", "redirect_target", "lead")
    assert edges["destination-edge:page:p1:destination:cand.example"].status == "dashed" and edges["destination-edge:page:p2:destination:known.example"].kind == "publicly links to" and edges["destination-edge:page:p1:destination:mybet88.test"].kind == "publicly redirects to"
    assert sum(i.startswith("observation:") for i in order) == 18 and nodes["observation:o2"].label == "+6••••7890" and "observation:s17" not in nodes
    assert nodes["claim:page:p1:offer-claims"].label == "Offer claims · bonus, cashback" and nodes["claim:page:p1:referral-markers"].label == "Referral markers · [redacted referral]"
    assert nodes["page:p2"].label == "https://bet88.example/b?token=[redacted]" and edges["crawl:p1:p2"].sequence == 2
    assert [nodes[i].sequence for i in order] == [1, 2, *range(4, 4 + 23)] and line["end"].label == "Capture adequate" and line["end"].sequence == 28 and line["step:27"].target == "page:p2"
    alone = by("node", "d")
    assert [(n.id, n.kind, n.label) for n in alone.values()] == [("page:d", "seed_page", "https://d.example/")] and by("timeline", "d")["end"].label == "Capture limited" and not by("edge", "d")
