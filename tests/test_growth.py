"""Plans whose tasks must not grow with one frequent value, one long run or one large case."""

from sightline.operators import html, markup, observations, replay as rp


def test_first_observations_without_a_window(spark):
    rows = spark.createDataFrame([(k, f"o{k % 2}", "t", "bonus") for k in range(9, 0, -1)] + [(3, "o0", "t", "bonus")], "page_id long, observation_id string, observation_type string, value string")
    first = observations.distinct_observations(rows, "page_id", "observation_id")
    assert [tuple(r) for r in first.collect()] == [(1, "o1", "t", "bonus")] and first.columns == rows.columns
    assert "Window" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_links_are_computed_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "a", "<p>Bonus via DANA</p><a href='/x'>X</a>")], "page_id long, url string, case_id string, html string")
    plan = markup._every(html.nodes(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # site name, heading and title alone read the nodes; links and texts are read from tables


def test_runs_pass_by_and_tokens_stay_in_their_row(spark):
    log = spark.createDataFrame([("r", "r", 2, "b", "artifact.captured", '{"node_id": "page:1", "label": "x"}'), ("r", "r", 1, "a", "run.started", '{"seed_url": "s"}'), (None, "n", 1, "a", "run.started", None)] * 2, "run_id string, case_id string, sequence long, event_id string, kind string, payload string")
    items = rp.replay(log)
    assert {(r.run_id, r.id) for r in items.filter("item = 'node'").collect()} == {("r", "seed:r"), ("r", "page:1"), ("None", "seed:n")}
    assert "FlatMapGroupsInPandas" not in items._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, "bb aa BB x"), (1, "aa"), (2, ""), (3, None)], "page_id long, text string")
    vectors = observations.text_vectors(texts)
    assert [(r.id, [tuple(c) for c in r.counts], r.sq, r.total) for r in vectors.collect()] == [(1, [("aa", 2), ("bb", 2)], 8, 4)]
    assert "explode" not in vectors._jdf.queryExecution().optimizedPlan().toString()
