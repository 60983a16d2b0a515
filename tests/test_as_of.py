"""Replay as of the last capture or observation keeps runs that have no observation."""

from sightline.plans import registry


def test_runs_without_observations_stay(spark, tmp_path):
    rows = [(100, "https://a.example/", "<html><body><a href='/y'>A</a></body></html>"), (23, "https://bare.example/", "<html></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.run_id for r in registry.queries()["replay_as_of"](spark, str(tmp_path)).filter("kind = 'seed_page'").collect()}
    assert got == {"a.example", "bare.example"}
