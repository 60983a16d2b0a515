"""Boxes of elements, and links that don't expand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions import urls

MAX_CROP_PIXELS = 2_000_000


def attach_boxes(observations: DataFrame, snapshots: DataFrame, pad: int, width: int, height: int) -> DataFrame:
    """page_id, ord, snap, x, y, w, h: the padded and clipped box of the first snapshot (page_id, href, text, snap, x, y, w, h) whose link has the path of the observation's
    (page_id, ord, href, label), or whose text is its label. Boxes above MAX_CROP_PIXELS give none."""
    box = F.struct("snap", "x", "y", "w", "h")
    by_path = snapshots.filter("href <> ''").groupBy("page_id", urls.path(F.col("href")).alias("path")).agg(F.min(box).alias("b"))
    by_text = snapshots.filter("text <> ''").groupBy("page_id", F.col("text").alias("label")).agg(F.min(box).alias("b"))
    rows = observations.withColumns({"path": urls.path(F.col("href")), "label": F.substring("label", 1, 200)})
    found = rows.filter("href <> ''").join(by_path, ["page_id", "path"]).select("page_id", "ord", "b").unionByName(rows.filter("label <> ''").join(by_text, ["page_id", "label"]).select("page_id", "ord", "b"))
    rows = found.groupBy("page_id", "ord").agg(F.min("b").alias("b"))
    x0, y0 = F.greatest(F.col("b.x") - pad, F.lit(0)), F.greatest(F.col("b.y") - pad, F.lit(0))
    x1, y1 = F.least(F.col("b.x") + F.col("b.w") + pad, F.lit(width)), F.least(F.col("b.y") + F.col("b.h") + pad, F.lit(height))
    out = rows.select("page_id", "ord", F.col("b.snap").alias("snap"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return out.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") * F.col("h") <= MAX_CROP_PIXELS))


def nonexpanded_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links`` of pages (page_id, outcome, depth) that may not expand, with the one reason of their page."""
    reason = F.when(F.col("outcome") != "content", "parent_not_usable").when(F.col("depth") >= 1, "depth_limit")
    return links.join(pages.select("page_id", reason.alias("reason")).filter("reason is not null"), "page_id")
