"""Values fixed by the behaviour that the operators must have."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import policy, urls
from sightline.operators import cases, evaluation, html, log_windows, observations, replay, similarity, suffixes

SITE = "https://fixture.test/"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("/inside#fragment", "https://fixture.test/base", "https://fixture.test/inside"),
        ("mailto:test@example.test", SITE, None),
        ("//Other.Test/p", SITE, "https://other.test/p"),
        ("?x=1", "https://fixture.test/a/b", "https://fixture.test/a/b?x=1"),
        ("../a/./b", "https://fixture.test/x/y/z", "https://fixture.test/x/a/b"),
        ("http://h:80/", SITE, "http://h/"),
        ("https://h:8443/", SITE, "https://h:8443/"),
        ("https://h.", SITE, "https://h/"),
        ("https://münchen.test/", SITE, "https://xn--mnchen-3ya.test/"),
        ("   ", SITE, None),
    ],
)
def test_http_url(spark, raw, base, want):
    assert value(spark, urls.http_url(F.lit(raw), F.lit(base))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("/crawl-child/?b=2&a=1&utm_campaign=fixture#fragment", "https://fixture.test/crawl-child?a=1&b=2"),
        ("https://u:p@h/", None),
        ("/p?q=a+b&e=%zz&t=~*", "https://fixture.test/p?e=%25zz&q=a+b&t=~%2A"),
        ("https://h///", "https://h/"),
        ("/x?fbclid=1&GCLID=2", "https://fixture.test/x"),
    ],
)
def test_crawl_url(spark, raw, want):
    assert value(spark, urls.crawl_url(F.lit(raw), F.lit(SITE))) == want


def test_asset_url(spark):
    asset = lambda raw: value(spark, urls.asset_url(urls.http_url(F.lit(raw), F.lit(SITE))))
    assert asset("https://ASSETS.example.net/app.js?b=2&a=1#fragment") == "https://assets.example.net/app.js?a=1&b=2"
    assert asset("https://assets.example.net/logo.png?tenant=a") != asset("https://assets.example.net/logo.png?tenant=b")


@pytest.mark.parametrize(
    ("url", "want"),
    [("file:///tmp/a", "unsupported_scheme"), ("ftp://example.test", "unsupported_scheme"), ("javascript:alert(1)", "unsupported_scheme"), ("http://10.0.0.1/", "non_global_address"), ("http://[::1]/", "non_global_address"), ("http://localhost/", "local_hostname"), ("http://169.254.169.254/", "metadata_host"), ("http://h.test:8080/", "non_default_port"), ("http://u@h.test/", "userinfo_not_allowed"), ("http://8.8.8.8/", None), ("https://h.test/x", None)],
)
def test_url_policy(spark, url, want):
    assert value(spark, policy.url_policy(F.lit(url))) == want


def test_redaction(spark):
    assert value(spark, policy.redact_phone(F.lit("+6281234567890"))) == "+6••••7890"
    assert value(spark, policy.redact_url(F.lit("https://u:p@h.test/a?token=abc&q=1#f"))) == "https://h.test/a?token=[redacted]&q=1"


def test_registrable_domains(spark):
    rules = spark.createDataFrame([("com", "icann"), ("uk", "icann"), ("co.uk", "icann"), ("*.ck", "icann"), ("!www.ck", "icann"), ("github.io", "private"), ("io", "icann")], "rule string, kind string")
    hosts = ["https://a.b.example.com/", "https://x.co.uk", "https://co.uk", "https://a.foo.ck", "https://www.ck", "https://user-a.github.io", "http://1.2.3.4/", "ftp://a.com", "https://unknown"]
    got = {r.url: (r.registrable_domain, r.suffix_type, r.reason) for r in suffixes.registrable_domains(spark.createDataFrame([(u,) for u in hosts], "url string"), rules).collect()}
    assert got == {
        hosts[0]: ("example.com", "icann", None), hosts[1]: ("x.co.uk", "icann", None), hosts[2]: (None, None, "not_registrable_domain"), hosts[3]: ("a.foo.ck", "icann", None), hosts[4]: ("www.ck", "icann", None),
        hosts[5]: ("user-a.github.io", "private", None), hosts[6]: (None, None, "ip_literal_candidate"), hosts[7]: (None, None, "unsupported_url_scheme"), hosts[8]: (None, None, "not_registrable_domain"),
    }


PAGE = """<html><head><title>Fixture evidence landing</title><style>p{}</style></head><body><nav><a href="/in" rel="b a">In <b>side</b></a></nav>
<p>Mail a.b@Example.test or call +62 812 3456 7890, WhatsApp: +639543355092 and @FixtureAdmin. Deposit via DANA, bonus.</p><img src="x.png"><script>var t = "</p>";</script></body></html>"""


def test_markup_and_observations(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    nodes = html.nodes(pages)
    link = html.element_text(nodes, "a").first()
    assert (link["text"], link["region"], link["attrs"]["href"]) == ("In side", "nav", "/in")
    assert html.first_text(nodes, "title").first()["text"] == "Fixture evidence landing"
    texts = html.visible_text(pages)
    text = texts.first()["text"]
    assert text.startswith("Fixture evidence landing In side Mail") and "var t" not in text
    assert [r.value for r in observations.emails(texts).collect()] == ["a.b@example.test"]
    assert [r.value for r in observations.phones(texts).collect()] == ["+6281234567890"]
    assert [(r.observation_type, r.value) for r in observations.channel_phones(texts).collect()] == [("public_whatsapp_link", "https://wa.me/639543355092")]
    assert [r.value for r in observations.aliases(texts).collect()] == ["@fixtureadmin"]
    assert {r.value for r in observations.claim_terms(texts).collect()} == {"deposit", "dana", "bonus"}
    assert {r.pair for r in html.dom_features(pages).collect()} >= {"nav[]>a[href,rel]", "p[]>img[src]"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("an ordinary landing page with words enough", "content"),
        ("this service is not available in your country", "geo_restricted"),
        ("access denied. you have no permission to view this page", "unknown_restriction"),
        ("just a moment while we look", "bot_challenge"),
        ("cloudflare is named once beside cookie words in a long and ordinary text about gardens", "content"),
        ("manage consent cookie preferences", "consent_wall"),
        ("page unavailable for now, come back", "unavailable_page"),
        ("short", "unknown_restriction"),
    ],
)
def test_capture_outcome(spark, text, want):
    assert cases.capture_outcome(spark.createDataFrame([(1, text)], "page_id long, text string")).first()["outcome"] == want


def test_capture_outcome_of_navigations(spark):
    long = "an ordinary landing page with words enough"
    rows = [(1, "", "https://a.test/", "verify you are human", "timed_out", None), (2, "", None, "", "failed", "ConnectionError: reset"), (3, None, "https://a.test/?__cf_chl_tk=1", long, "captured", None), (4, "Just a moment", "", long, "completed", ""), (5, "", "", long, "captured", "ReadTimeout")]
    got = {r.page_id: (r.outcome, r.access_outcome, r.content_usable, list(r.reasons)) for r in cases.capture_outcome(spark.createDataFrame(rows, "page_id long, title string, final_url string, text string, navigation_status string, error_type string")).collect()}
    assert got == {
        1: ("timeout", None, False, ["navigation timed out"]), 2: ("navigation_error", None, False, ["navigation error type: connectionerror"]), 3: ("bot_challenge", "access_challenge", False, ["bot-challenge URL marker: __cf_chl_"]),
        4: ("bot_challenge", "access_challenge", False, ["bot-challenge indicator: just a moment"]), 5: ("timeout", None, False, ["navigation timed out"]),
    }


def test_shared_signals(spark):
    rows = [("a", "a", "telegram", "@x"), ("b", "b", "telegram", "@x"), ("a", "a", "external_asset_url", "u"), *[(f"c{k}", f"c{k}", "external_asset_url", "u") for k in range(4)]]
    rows += [("a", "a", "whatsapp_or_phone", "+1"), ("b1", "b", "whatsapp_or_phone", "+1"), ("b2", "b", "whatsapp_or_phone", "+1"), ("a", "a", "referral", "ref=PART"), ("b", "b", "referral", "ref=PART")]
    rows += [("a", "a", "telegram", "@two"), ("b", "b", "telegram", "@two"), ("b", "b", "telegram", "@two")]
    entities = spark.createDataFrame([(*r, k, f"https://{r[0]}/{k}") for k, r in enumerate(rows)], "case_id string, domain string, type string, value string, page_id long, url string")
    shared = cases.shared_signals(entities)
    got = {(r.case_id, r.value, r.other_case): (r.quality, r.weight) for r in shared.collect()}
    assert got["a", "@x", "b"] == ("strong", 35) and got["a", "ref=PART", "b"] == ("medium", 10)
    assert got["a", "+1", "b1"] == ("medium", 20)  # found in two cases
    assert got["b1", "+1", "a"] == ("medium", 20)  # the sister case of its own domain counts as another domain's case
    assert got["a", "@two", "b"] == ("medium", 23) and got["b", "@two", "a"] == ("strong", 35)  # twice there, once here
    assert not any(value == "u" and case == "a" for case, value, _ in got)  # on four other domains
    reasons = cases.candidate_reasons(shared, entities)
    first = reasons.filter("case_id = 'a' and host = 'b' and value = '@x'").first()
    assert (first["reason"], first["pages"], first["urls"]) == ("shared_telegram", [0, 1], ["https://a/0", "https://b/1"])
    scores = {(r.case_id, r.host): r.score for r in cases.candidate_scores(reasons).collect()}
    assert scores["a", "b"] == 45  # two handles count once


def test_cross_case_matches(spark):
    rows = [(f"c{k:02d}", 1, "observation-0001", "public_email_address", "x@y.test") for k in range(20)] + [("c00", 2, "observation-0009", "public_email_address", "x@y.test"), ("c00", 1, "o", "claimed_brand_identity", "b"), ("c01", 1, "o", "claimed_brand_identity", "b")]
    got = cases.cross_case_matches(spark.createDataFrame(rows, "case_id string, page_id int, observation_id string, observation_type string, value string")).collect()
    assert [r.other_case for r in sorted(got, key=lambda r: r.place) if r.case_id == "c00"] == [f"c{k:02d}" for k in range(1, 13)]
    assert {(r.relation, r.page_id) for r in got if r.case_id == "c00"} == {("shares_public_contact_with", 2)} and len(got) == 240


def test_similarity_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "left long, right long")
    items = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "z")], "id long, item string")
    assert {(r.right): r.similarity for r in sim(pairs, items)} == {2: 1.0, 3: 0.0, 9: 0.0}
    parts = spark.createDataFrame([(1, 2, n, 1.0, "scored") for n in similarity.WEIGHTS] + [(1, 3, "text", 0.5, "scored"), (1, 3, "visual", 0.0, "low_information")], "left long, right long, name string, similarity double, status string")
    scores = {r.right: (r.score, r.warnings) for r in similarity.mirror_score(pairs, parts).collect()}
    assert scores[2] == (100.0, "") and scores[3] == (10.0, "entity not_applicable; dom not_applicable; visual low_information; asset not_applicable") and scores[9][0] == 0.0
    hashes = similarity.average_hash(spark.createDataFrame([(1, [0.0, 1.0] * 40), (2, [0.0, 1.0] * 39 + [1.0, 0.0]), (3, [1.0] * 80), (9, [0.0, 1.0])], "id long, v array<double>"))
    assert {r.right: (round(r.similarity, 6), r.status) for r in similarity.hash_similarity(pairs, hashes).collect()} == {2: (0.975, "scored"), 3: (0.0, "low_information"), 9: (0.0, "not_applicable")}


def sim(pairs, items):
    return similarity.set_similarity(pairs, items).collect()


def taxonomy():
    """A root page with nine observations, a verified assertion and two kinds that change nothing."""
    seen = [("link-one", "public_outgoing_link", "https://www.888casino.com/slots"), ("link-two", "public_outgoing_link", "https://888casino.com/blackjack"), ("same-host", "public_outgoing_link", "https://888.com/about-us"), ("deposit", "public_payment_method", "deposit"), ("withdrawal", "public_payment_method", "withdrawal"), ("bonus", "public_offer_claim", "bonus"), ("tracking", "public_tracking_identifier", "utm_source=cmp"), ("phone", "public_phone_number", "+639543355092"), ("telegram", "public_telegram_contact", "+639543355092")]
    events = [("run.started", {"seed_url": "https://888.com/"}), ("artifact.captured", {"node_id": "page:root", "root": True, "label": "https://888.com/"})]
    events += [("observation.created", {"observation_id": o, "node_id": f"observable:{o}", "source_node_id": "page:root", "observation_type": t, "normalized_value": v}) for o, t, v in seen]
    events += [("agent.stopped", {}), ("assertion.proposed", {"assertion_id": "a1", "object": "888casino.com", "supporting_observation_ids": ["link-one"]}), ("run.completed", {}), ("assertion.verified", {"assertion_id": "a1"})]
    return [("run", "case", k + 1, f"e{k}", kind, json.dumps(payload)) for k, (kind, payload) in enumerate(events)]


def test_replay_of_a_run(spark):
    schema = "run_id string, case_id string, sequence int, event_id string, kind string, payload string"
    log = taxonomy()
    once = sorted(map(str, replay.replay(spark.createDataFrame(log, schema)).collect()))
    mixed = log + log
    random.Random(3).shuffle(mixed)
    items = replay.replay(spark.createDataFrame(mixed, schema)).collect()
    assert sorted(map(str, items)) == once
    nodes, edges = {r.id: r for r in items if r["item"] == "node"}, {r.id: r for r in items if r["item"] == "edge"}
    destination = nodes["external_destination:888casino.com"]
    assert (destination.label, destination.facts) == ("888casino.com", ["https://888casino.com/blackjack", "https://www.888casino.com/slots"])
    assert [n.label for n in nodes.values() if n.kind == "external_destination"] == ["888casino.com"]
    assert nodes["claim:seed:case:payment_indicators"].facts == ["deposit", "withdrawal"] and nodes["claim:seed:case:payment_indicators"].label == "Payment Indicators · deposit, withdrawal"
    assert sorted(n.id for n in nodes.values() if n.kind == "public_contact") == ["observable:phone", "observable:telegram"]
    edge = edges["publicly_links_to:seed:case:external_destination:888casino.com"]
    assert edge.observations == ["link-one", "link-two"] and edge.status == "solid"
    assert (edges["assertion:a1"].status, edges["assertion:a1"].target, edges["assertion:a1"].source) == ("solid_emphasized", destination.id, "seed:case")
    frame = spark.createDataFrame(log, schema)
    first = {r.id: r.sequence for r in replay.first_seen(replay.replay(frame), frame).collect()}
    assert first["seed:case"] == 1 and first[destination.id] == 3 and first["assertion:a1"] == 13


def test_append_events(spark):
    schema = "run_id long, sequence int, event_id long, kind string, occurred_at timestamp, value double, payload string"
    log = spark.createDataFrame([(1, 1, 10, "a", None, 1.0, "{}")], schema)
    new = spark.createDataFrame([(1, 0, 10, "a", None, 1.0, "{}"), (1, 0, 11, "b", None, 2.0, "{}"), (1, 0, 11, "b", None, 2.0, "{}")], schema).drop("sequence")
    appended, conflicts = log_windows.append_events(log, new)
    assert [(r.event_id, r.sequence) for r in appended.collect()] == [(11, 2)] and conflicts.count() == 0
    changed = spark.createDataFrame([(1, 0, 10, "z", None, 1.0, "{}")], schema).drop("sequence")
    assert [r.event_id for r in log_windows.append_events(log, changed)[1].collect()] == [10]


def test_metrics_of_approaches(spark):
    """Ten scenarios, seven with an observable to find: the counts that give the published rates."""
    schema = "approach string, scenario_id string, attempt int, expected_observable string, observed array<string>, observable_found boolean, task_success boolean, actions int, runtime_ms int, unsafe_controls int, unsafe_blocked int, provenance_complete boolean, candidate_relation_supported boolean, failure string"
    rows = []
    for approach, found, success, related, actions, repeats in (("static", 2, 5, 1, 0, 1), ("rule_based", 6, 9, 5, 6, 1), ("agent_assisted", 7, 10, 6, 7, 3)):
        for n in range(repeats):
            for k in range(10):
                hit = k < found
                rows.append((approach, f"s{k}", n + 1, f"v{k}" if k < 7 else None, [f"v{k}"] if hit else [], hit, k < success, int(k < actions), 0, int(k in (7, 8, 9) or k == 0), int(k in (7, 8, 9) or k == 0), True, (k < related) if k < 6 else None, None if k < success else "observable_not_found"))
    frame = spark.createDataFrame(rows, schema)
    got = {r.approach: (r.observable_recall, r.observable_precision, r.task_success_rate, r.candidate_relation_support_rate, r.mean_actions, r.provenance_completeness, r.mean_runtime_ms) for r in evaluation.approach_metrics(frame).collect()}
    assert got == {"static": (0.2857, 1.0, 0.5, 0.1667, 0.0, 1.0, 0.0), "rule_based": (0.8571, 1.0, 0.9, 0.8333, 0.6, 1.0, 0.0), "agent_assisted": (1.0, 1.0, 1.0, 1.0, 0.7, 1.0, 0.0)}
    assert tuple(evaluation.policy_safety(frame).first()) == (12, 12, 1.0)
    assert {r.n_signatures for r in evaluation.nondeterminism(frame.filter("approach = 'agent_assisted'"), "task_success", "observed", "actions", "failure").collect()} == {1}
    assert {(r.approach, r.failure): r.n for r in evaluation.failure_breakdown(frame).collect() if r.failure != "none"} == {("static", "observable_not_found"): 5, ("rule_based", "observable_not_found"): 1}
