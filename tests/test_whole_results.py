"""Results that must hold at any length: long chains, many links, long runs, tables that change in one session."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sightline.operators import html, log_windows as lw, markup, replay as rp
from sightline.plans import bindings, markup_queries
from sightline.streaming import log as st


def test_causes_of_long_chains_and_circles(spark):
    n = 10_000
    chain = [("long", f"e{k}", f"e{k - 1}" if k else None) for k in range(n)]
    circle = [("circle", f"c{k}", f"c{(k + 1) % 3}") for k in range(3)] + [("circle", "d0", "c1"), ("circle", "d1", "d0"), ("circle", "self", "self"), ("circle", "free", "lost"), ("circle", "child", "free")]
    got = {r.event_id: (r.cause_event_id, r.root_event_id, r.depth) for r in lw.event_causes(spark.createDataFrame(chain + circle, "run_id string, event_id string, causation_event_id string")).collect()}
    assert all(got[f"e{k}"] == (f"e{k - 1}" if k else None, "e0", k) for k in range(n))
    assert {k: got[k] for k in ("c0", "d1", "self")} == {"c0": ("c1", None, None), "d1": ("d0", None, None), "self": ("self", None, None)}
    assert got["free"] == (None, "free", 0) and got["child"] == ("free", "free", 1)
    assert lw.event_causes(spark.createDataFrame([], "run_id string, event_id string, causation_event_id string")).count() == 0


def test_entities_of_a_page_with_1100_links(spark):
    page = "<html><body>" + "".join(f'<a href="/p{k}">l{k}</a>' for k in range(1100)) + "</body></html>"
    pages = spark.createDataFrame([(1, "http://a.example.org/", "a", page)], "page_id long, url string, case_id string, html string")
    ids = [r.entity_id for r in markup.entities(pages, html.nodes(pages)).collect()]
    assert len(ids) > 1100 and len(set(ids)) == len(ids) and {"entity-001", "entity-999", "entity-1000"} <= set(ids)
    assert min(int(r.entity_id[7:]) for r in markup.entities(pages, html.nodes(pages), start=500).collect()) == 500


def test_elements_with_parents_forms_and_paths(spark):
    page = '<html><body><p>x</p><form id="f" action="/s"><div><button>Go</button></div><br><a href="/a?x=1&amp;y=2">A</a></form><p><b><a href="/b">B</a></p><a id="last" href="/c">C</a></body></html>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    rows = {r.elem_ord: r for r in html.elements(pages).collect()}
    tag = lambda k: rows[k].tag if k >= 0 else None
    got = [(r.tag, tag(r.parent), tag(r.form), r.path) for _, r in sorted(rows.items())]
    assert got == [
        ("html", None, None, None), ("body", "html", None, None), ("p", "body", None, None), ("form", "body", None, None), ("div", "form", "form", None), ("button", "div", "form", "body > form > div > button"), ("br", "form", "form", None),
        ("a", "form", "form", "body > form > a"), ("p", "body", None, None), ("b", "p", None, None), ("a", "b", None, "body > p:nth-of-type(2) > b > a"), ("a", "body", None, "a#last"),
    ]
    assert dict(next(r for r in rows.values() if r.tag == "a").attrs) == {"href": "/a?x=1&y=2"}


def test_kept_tables_follow_their_input(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = f"{tmp_path}/pages.parquet"
    rows.filter("page_id < 20").write.parquet(folder)
    count = lambda: markup_queries.entities(spark, str(tmp_path)).select("page_id").distinct().count()
    assert count() == 20
    kept = dict(bindings._KEPT)
    assert count() == 20 and bindings._KEPT == kept
    rows.write.mode("overwrite").parquet(folder)
    assert count() == 50


def long_run(n: int) -> list[tuple]:
    """A run with very many nodes, labels, hosts and edges, whose leads meet nodes by host and whose matches meet them by observation."""
    log = [("run.started", {"seed_url": "https://seed.example/"})]
    for k in range(n):
        kind = k % 5
        if kind == 0:
            log.append(("artifact.captured", {"node_id": f"page:{k}", "label": f"https://seed.example/{k}", "parent_node_id": f"page:{k - 5}" if k > 5 else None}))
        elif kind in (1, 2):
            what, value = ("public_outgoing_link", f"https://host{k % 997}.example/{k}") if kind == 1 else ("public_email_address", f"m{k % 5000}@x.example")
            log.append(("observation.created", {"observation_id": f"o{k}", "node_id": f"obs:{k}", "source_node_id": f"page:{k - kind}", "observation_type": what, "normalized_value": value}))
        elif kind == 3:
            log.append(("search.lead.discovered", {"lead_id": f"l{k}", "url": f"https://www.host{k % 4999}.example/lead"}) if k % 3 else ("entity.matched", {"observation_id": f"o{k - 1}"}))
        else:
            log.append(("candidate_page.collected", {"node_id": f"cp{k}", "url": f"https://host{k % 1009}.example/c"}) if k % 3 else ("assertion.proposed", {"assertion_id": f"a{k}", "object": f"https://host{k % 1009}.example/c"}))
    return [("run", "case", q, f"e{q}", kind, json.dumps(payload)) for q, (kind, payload) in enumerate(log, 1)]


SCHEMA = "run_id string, case_id string, sequence long, event_id string, kind string, payload string"


def test_long_runs_take_linear_time():
    took = {}
    for n in (12_500, 50_000, 100_000):
        events, graph, began = long_run(n), rp.RunGraph(), time.process_time()
        for _, case, sequence, event, kind, payload in events:
            graph.apply(case, sequence, event, kind, json.loads(payload))
        took[n] = time.process_time() - began
    assert len(graph.nodes) > 20_000 and len(graph.edges) > 20_000
    assert took[100_000] < 16 * took[12_500] + 1 and took[100_000] < 60


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch_with_animations(spark, tmp_path, files):
    """Any order of arrival, repeats, and batches that split the run."""
    log = spark.createDataFrame(long_run(400) + [("other", *r[1:]) for r in long_run(90)], SCHEMA)
    want = sorted(map(str, rp.replay(log).drop("facts", "events", "observations").collect()))
    for k in range(files):
        part = log.filter(F.pmod(F.xxhash64("event_id"), F.lit(files)) == k)
        part.unionByName(log.filter("sequence % 7 = 0")).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    got = st.run_to_table(st.replay(stream), "update", ["run_id", "item", "id"], rocksdb=True)
    assert sorted(map(str, got.drop("facts", "events", "observations").collect())) == want
    assert got.filter("item = 'animation'").count() > 400


def test_dedup_with_and_without_watermark(spark, tmp_path):
    """A repeat within the delay goes in both; one long after it stays in the bounded variant only."""
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {0})"
    batches = [[(1, 0), (2, 1), (1, 20)], [(1, 30), (3, 300)], [(4, 600)], [(1, 601), (2, 602), (5, 5)]]
    for k, rows in enumerate(batches):
        spark.sql(" UNION ALL ".join(f"SELECT {i}L AS event_id, {at.format(m)} AS occurred_at" for i, m in rows)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/{k}")
        time.sleep(1.1)  # files are taken in order of their times
    stream = lambda: spark.readStream.schema("event_id long, occurred_at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    exact = sorted(r.event_id for r in st.run_to_table(st.dedup(stream()), "append").collect())
    bounded = sorted(r.event_id for r in st.run_to_table(st.dedup_within(stream(), "1 hour"), "append").collect())
    assert exact == [1, 2, 3, 4, 5] and bounded == [1, 1, 2, 2, 3, 4]  # event 5 came behind the watermark


def test_suffix_rules_of_a_file(spark, tmp_path):
    from sightline.operators import suffixes
    from sightline.sources.suffix_rules import read_rules

    (tmp_path / "rules.dat").write_text("out\r\n// ===BEGIN ICANN DOMAINS===\r\ncom\r\n\r\n  // no.rule\r\nJP\r\n*.kobe.jp\r\n!city.kobe.jp x\r\n公司.cn\r\n// ===END ICANN DOMAINS===\r\nbetween\r\n// ===BEGIN PRIVATE DOMAINS===\r\nblogspot.com // hosts\r\n.lead.com\r\n", encoding="utf-8")
    rules = read_rules(spark, str(tmp_path / "rules.dat"))
    assert sorted(map(tuple, rules.collect())) == [("!city.kobe.jp", "icann"), ("*.kobe.jp", "icann"), ("blogspot.com", "private"), ("com", "icann"), ("jp", "icann"), ("lead.com", "private"), ("xn--55qx5d.cn", "icann")]
    hosts = ["a.b.com", "x.blogspot.com", "blogspot.com", "q.w.e.kobe.jp", "z.city.kobe.jp", "kobe.jp", "other"]
    got = {r.host: (r.registrable_domain, r.suffix_type) for r in suffixes.registrable_domains(spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string"), rules).collect()}
    assert got == {"a.b.com": ("b.com", "icann"), "x.blogspot.com": ("x.blogspot.com", "private"), "blogspot.com": (None, None), "q.w.e.kobe.jp": ("w.e.kobe.jp", "icann"), "z.city.kobe.jp": ("city.kobe.jp", "icann"), "kobe.jp": ("kobe.jp", "icann"), "other": (None, None)}


def test_node_links_by_containment(spark):
    from sightline.operators import leads

    nodes = spark.createDataFrame([("a", "n1", "Payment Indicators · DANA pay, ovo"), ("a", "n2", "https://x.example/en/page"), ("b", "n3", "dana pay"), ("a", "n4", "Exact Value"), ("a", "n5", "an exact value inside"), ("a", "n6", "host.example")], "case_id string, node_id string, label string")
    rows = [("a", "o1", "dana PAY "), ("a", "o2", "ovo"), ("a", "o3", "x.example/en"), ("a", "o4", "exact value"), ("a", "o5", "https://host.example/z"), ("a", "o6", "none of them"), ("b", "o7", "dana"), ("a", "o8", "http"), ("a", "o9", "")]
    got = {r.observation_id: (r.node_id, r.rank) for r in leads.observation_node_link(spark.createDataFrame(rows, "case_id string, observation_id string, value string"), nodes).collect()}
    assert got == {"o1": ("n1", 1), "o3": ("n2", 1), "o4": ("n4", 0), "o5": ("n6", 2), "o7": ("n3", 1), "o8": ("n2", 1)}
