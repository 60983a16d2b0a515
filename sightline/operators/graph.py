"""Evidence graphs as node and edge tables, and event logs folded into them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import urls

# Relations that need no evidence, node types of entities, and the relation that an entity makes.
STRUCTURAL = ["started_from", "resolved_to", "contains_page", "captured_as"]
ENTITY_NODES = ["telegram", "whatsapp_or_phone", "referral", "external_asset_domain", "external_asset_url"]
ENTITY_EDGES = {"internal_link": "links_to", "external_link": "links_to", "telegram": "mentions", "whatsapp_or_phone": "mentions", "referral": "uses_referral", "external_asset_domain": "loads_asset_from", "external_asset_url": "loads_asset_from"}
EVIDENCE = ["evidence_id", "source_url", "method", "confidence"]


def _node(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def _entity_node() -> Column:
    return F.when(F.col("type").isin("internal_link", "external_link"), F.concat(F.lit("domain:"), urls.host(F.col("value")))).otherwise(F.concat("type", F.lit(":"), "value"))


def case_nodes(cases: DataFrame, pages: DataFrame, entities: DataFrame) -> DataFrame:
    """case_id, node_id, type, label, first_page: the graph's nodes; of several writers of an id the first keeps its label.

    ``cases`` has case_id, seed_url, final_url; ``pages`` case_id, page_id, url, screenshot (its path, or null); ``entities`` case_id,
    page_id, entity_id, type, value. Order of writing: the case, its domains, page by page, entities.
    """
    none = F.lit(None).cast("long")
    row = lambda df, node, kind, label, rank, page: df.select("case_id", node.alias("node_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), label.alias("label"), F.lit(rank).alias("rank"), page.alias("page"))
    host = lambda c: urls.host(F.col(c))
    own = entities.filter(F.col("type").isin(list(ENTITY_EDGES)))
    linked = F.col("type").isin("internal_link", "external_link")
    parts = [
        row(cases, _node("case", "case_id"), "case", F.col("case_id"), 0, none), row(cases, F.concat(F.lit("domain:"), host("seed_url")), "domain", host("seed_url"), 1, none), row(cases, F.concat(F.lit("domain:"), host("final_url")), "domain", host("final_url"), 2, none),
        row(pages, _node("page", "page_id"), "page", F.col("url"), 3, F.col("page_id")), row(pages, F.concat(F.lit("domain:"), host("url")), "domain", host("url"), 3, F.col("page_id")),
        row(pages.filter("screenshot is not null"), _node("screenshot", "page_id"), "screenshot", F.col("screenshot"), 3, F.col("page_id")),
        row(own, _entity_node(), F.when(linked, "domain").otherwise(F.col("type")), F.when(linked, urls.host(F.col("value"))).otherwise(F.col("value")), 4, F.col("page_id")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("case_id", "node_id").agg(F.min_by(F.struct("type", "label"), F.struct("rank", "page", "label")).alias("x"), F.min("page").alias("first_page"))
    return out.select("case_id", "node_id", "x.type", "x.label", "first_page")


def case_edges(cases: DataFrame, pages: DataFrame, entities: DataFrame) -> DataFrame:
    """case_id, edge_id, source, target, type, evidence_id, source_url, method, confidence: the graph's edges, each once.

    Inputs as for ``case_nodes``; ``pages`` also has parent_page_id and parent_url, from which a page was discovered. edge_id is a hash of
    ends, type and evidence.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def row(df: DataFrame, source: Column, target: Column, kind: str | Column, evidence: Column = text, url: Column = text, method: Column = text, confidence: Column = number) -> DataFrame:
        return df.select("case_id", source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), evidence.alias("evidence_id"), url.alias("source_url"), method.alias("method"), confidence.alias("confidence"))

    domain = lambda c: F.concat(F.lit("domain:"), urls.host(F.col(c)))
    html = lambda c: F.concat(F.lit("evidence-html-"), F.col(c).cast("string"))
    kind = None
    for k, v in ENTITY_EDGES.items():
        kind = F.when(F.col("type") == k, v) if kind is None else kind.when(F.col("type") == k, v)
    own = entities.filter(F.col("type").isin(list(ENTITY_EDGES))).join(pages.select("case_id", "page_id", "url"), ["case_id", "page_id"])
    parts = [
        row(cases, _node("case", "case_id"), domain("seed_url"), "started_from"), row(cases.filter(urls.host(F.col("seed_url")) != urls.host(F.col("final_url"))), domain("seed_url"), domain("final_url"), "resolved_to"),
        row(pages, domain("url"), _node("page", "page_id"), "contains_page"), row(pages.filter("screenshot is not null"), _node("page", "page_id"), _node("screenshot", "page_id"), "captured_as"),
        row(pages.filter("parent_page_id is not null"), _node("page", "parent_page_id"), _node("page", "page_id"), "discovered_via_link", html("parent_page_id"), F.col("parent_url"), F.lit("html_anchor"), F.lit(1.0)),
        row(own, _node("page", "page_id"), _entity_node(), kind, html("page_id"), F.col("url"), F.col("method"), F.lit(1.0)),
    ]
    every = reduce(DataFrame.unionByName, parts)
    one = every.groupBy("case_id", "source", "target", "type", "evidence_id").agg(F.min("source_url").alias("source_url"), F.min("method").alias("method"), F.max("confidence").alias("confidence"))
    material = F.concat_ws("|", "source", "target", "type", F.coalesce("evidence_id", F.lit("structural")))
    return one.withColumn("edge_id", F.concat(F.lit("edge-"), F.substring(F.sha2(material, 256), 1, 16)))


def evidence_violations(edges: DataFrame) -> DataFrame:
    """Edges that are not structural and lack a field of their evidence, with ``missing``, these fields in order."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in EVIDENCE]))
    return edges.filter(~F.col("type").isin(STRUCTURAL)).withColumn("missing", missing).filter(F.size("missing") > 0)


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str], cutoff: int | None = None, lens: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """Nodes (visual_kind, primary, sequence) that are seen up to ``cutoff``, of the chosen visual kinds and the lens, and the edges with both ends
    among them. The lens evidence shows all kinds, navigation pages, destinations and candidates, review the last two; primary nodes stay."""
    through = {"evidence": None, "navigation": ["page", "destination", "candidate"]}.get(lens, ["destination", "candidate"])
    allowed = F.lit(True) if through is None else F.col("primary") | F.col("visual_kind").isin(through)
    seen = F.lit(True) if cutoff is None else F.coalesce("sequence", F.lit(0)) <= cutoff
    shown = nodes.filter(F.col("visual_kind").isin(kinds) & allowed & seen)
    ids = shown.select("case_id", "node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "source"), ["case_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["case_id", "target"], "left_semi")
    return shown, kept


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, or the name of whose kind, holds the query in any case; a blank query finds nothing."""
    wanted = query.strip().lower()
    return nodes.filter(F.contains(F.lower(F.concat_ws(" ", "label", "kind_label")), F.lit(wanted)) if wanted else F.lit(False))


def neighborhood(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """case_id, node_id, neighbor: one hop from each focus node, either way."""
    there = edges.join(focus, (edges["case_id"] == focus["case_id"]) & (edges["source"] == focus["node_id"])).select(edges["case_id"], "node_id", F.col("target").alias("neighbor"))
    back = edges.join(focus, (edges["case_id"] == focus["case_id"]) & (edges["target"] == focus["node_id"])).select(edges["case_id"], "node_id", F.col("source").alias("neighbor"))
    return there.unionByName(back).distinct()
