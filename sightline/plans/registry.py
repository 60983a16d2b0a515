"""Names of the queries, what each runs, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions import urls
from sightline.plans import bindings

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per host and crawl identity: from markup to canonical targets to a count."""
    links = bindings.anchors(spark, sf_dir).withColumn("crawl_url", urls.crawl_url(F.col("href"), F.col("url")))
    return links.groupBy("case_id", "crawl_url").agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def _load() -> None:
    from sightline.plans import case_queries, detail_queries, graph_queries, html_queries, lead_queries, log_queries, markup_queries, package_queries, scalar_queries, url_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
