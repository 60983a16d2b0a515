"""How the driver's tables stand in for the engine's own: each binding is a DataFrame in the engine's schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from sightline.functions import urls
from sightline.operators import html, markup
from sightline.plans.web import WEB_HTML
from sightline.sources import read_table
from sightline.streaming.log import shared_folder


def pages(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, html, case_id (the host)."""
    return read_table(spark, d, "pages").select("page_id", "url", "html", urls.host(F.col("url")).alias("case_id"))


def web(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, html, case_id: the pages with the markup of ``web.WEB_HTML``."""
    return pages(spark, d).withColumn("html", F.expr(WEB_HTML))


def spread(pages: DataFrame) -> DataFrame:
    """``pages`` dealt to all tasks, for work that costs more than a shuffle, however few files or row groups they come in."""
    return pages.repartition("page_id")


_KEPT: dict[tuple[str, str, str], tuple[str, str]] = {}


def files_of(spark: SparkSession, d: str, table: str) -> str:
    """Names, sizes and times of a table's files, from a listing: the content column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{d}/{table}.parquet")
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return str(tuple(files.agg(F.count("*"), F.sum("length"), F.sum(one), F.max("modificationTime").cast("string")).first()))


def kept_folder(spark: SparkSession, d: str, name: str, write: Callable[[str], None], tables: tuple[str, ...] = ("pages",)) -> str:
    """A folder that ``write`` filled, kept in the shared folder while the files of ``tables``, which it is built from, stay what they are."""
    key, files = (spark.sparkContext.applicationId, d, name), " ".join(files_of(spark, d, t) for t in tables)
    if _KEPT.get(key, ("",))[0] != files:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(folder)
        _KEPT[key] = (files, folder)
    return _KEPT[key][1]


def kept(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made of ``pages`` that many queries read."""
    return spark.read.parquet(kept_folder(spark, d, name, lambda folder: build().write.parquet(folder)))


def forget() -> None:
    """Kept tables are built again by the next query, as a benchmark of whole queries needs."""
    _KEPT.clear()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of ``web``: pages are parsed once."""
    return kept(spark, d, "nodes", lambda: html.nodes(spread(web(spark, d))))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, case_id, elem_ord, href, label and more: the links of each page in document order, from its markup."""
    return markup.numbered(markup.anchors(nodes(spark, d)))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """page_id, case_id (the source), text: documents as visible text of pages."""
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("case_id"), "text")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """run_id, sequence, event_id, kind, occurred_at, value, payload: the event log of each user as a run."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read_table(spark, d, "events").withColumn("sequence", F.row_number().over(order))
    return rows.select(F.col("user_id").alias("run_id"), "sequence", "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("occurred_at"), "value", F.col("props").alias("payload"))


#: What a checkpoint measures, made of an event's value and id, in SQL that Spark and DuckDB read.
MEASURES = {"html_bytes": "CAST(floor(value * 3) AS BIGINT)", "n_chars": "CAST(floor(value) AS BIGINT) % 9", "n_elements": "CAST(floor(value / 40) AS BIGINT)", "height": "CAST(floor(value * 2) AS BIGINT) % 17"}


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """page_id, elapsed, event_id, size, image_hash and MEASURES: each user's events as the checkpoints of one page."""
    rows = read_table(spark, d, "events")
    return rows.select(F.col("user_id").alias("page_id"), F.col("ts").alias("elapsed"), "event_id", F.col("value").alias("size"), F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("image_hash"), *[F.expr(v).alias(k) for k, v in MEASURES.items()])


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """assertion_id, review_id, outcome, decided_at: a customer's orders as the reviews of one assertion."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("assertion_id"), F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("decided_at"))
