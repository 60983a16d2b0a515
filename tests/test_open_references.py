"""Readings in which SQL and the reference part: references without a semicolon, and numbers one blank apart."""

from sightline.operators import html, observations


def test_titles_cut_inside_a_reference(spark):
    rows = [(1, "<html><title>A &amp; B&amp</title><h1>C&am</h1></html>"), (2, "<title>D&</title>")]
    assert {r["page_id"]: r["text"] for r in html.first_text(html.nodes(spark.createDataFrame(rows, "page_id long, html string")), "title").collect()} == {1: "A & B&", 2: "D&"}


def test_numbers_one_blank_apart(spark):
    texts = spark.createDataFrame([(1, "from 44.144.126.223 +1 (906) 555-7738 on")], "page_id long, text string")
    assert {r["value"] for r in observations.phones(texts).collect()} == {"44144126223", "+19065557738"}
