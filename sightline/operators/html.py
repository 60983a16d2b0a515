"""HTML to rows: one pass of the standard tokenizer per partition, everything after it on Spark's side."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

REGIONS = ("footer", "header", "nav", "main", "aside")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
#: Elements that carry the text below them.
LABELLED = {"a", "button", "h1", "title"}
#: Columns of the pages that their nodes keep.
CARRIED = ("case_id", "url")
FIELDS = [
    ("ord", "int", pa.int32()), ("kind", "string", pa.string()), ("tag", "string", pa.string()), ("attrs", "map<string,string>", pa.map_(pa.string(), pa.string())), ("text", "string", pa.string()),
    ("region", "string", pa.string()), ("parent", "int", pa.int32()), ("form", "int", pa.int32()), ("path", "string", pa.string()),
]
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,80}")


class _Node:
    __slots__ = ("attrs", "form", "kind", "nth", "parent", "parts", "region", "same", "tag", "text")

    def __init__(self, kind: str, tag: str, attrs: dict[str, str], parent: int, region: str, form: int):
        self.kind, self.tag, self.attrs, self.parent, self.region, self.form = kind, tag, attrs, parent, region, form
        self.text: str | None = None
        self.parts: list[str] = []
        self.nth, self.same = 1, {}  # place among its parent's children of this tag; how many children it has of each tag


class _Page(HTMLParser):
    """Elements and text nodes in document order, each with its parent, enclosing region and form."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[int] = []
        self.top: dict[str, int] = {}

    def _add(self, kind: str, tag: str, attrs: list) -> int:
        parent = self.open[-1] if self.open else -1
        above = self.nodes[parent] if parent >= 0 else None
        region = "document" if above is None else above.tag if above.tag in REGIONS else above.region
        form = -1 if above is None else parent if above.tag == "form" else above.form
        node = _Node(kind, tag, {k: v or "" for k, v in dict(attrs).items()}, parent, region, form)
        if kind == "element":
            same = above.same if above else self.top
            node.nth = same[tag] = same.get(tag, 0) + 1
        self.nodes.append(node)
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        at = self._add("element", tag, attrs)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add("element", tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        hidden = next((self.nodes[k].tag for k in self.open if self.nodes[k].tag in HIDDEN), None)
        at = self._add("text", hidden or (self.nodes[self.open[-1]].tag if self.open else ""), [])
        self.nodes[at].text = data
        if hidden is None:
            for k in self.open:
                node = self.nodes[k]
                if node.tag in LABELLED or node.attrs.get("role") == "button":
                    node.parts.append(text)

    def path(self, at: int) -> str:
        """An element by its id, or by up to eight tags on the way to it, numbered among siblings of the same tag."""
        node = self.nodes[at]
        if _IDENTIFIER.fullmatch(node.attrs.get("id", "")):
            return f"{node.tag}#{node.attrs['id']}"
        parts: list[str] = []
        while at >= 0 and self.nodes[at].tag != "html" and len(parts) < 8:
            node = self.nodes[at]
            same = (self.nodes[node.parent].same if node.parent >= 0 else self.top)[node.tag]
            parts.append(node.tag + (f":nth-of-type({node.nth})" if same > 1 else ""))
            at = node.parent
        return " > ".join(reversed(parts))

    def rows(self) -> Iterator[tuple]:
        for at, n in enumerate(self.nodes):
            labelled = n.tag in LABELLED or n.attrs.get("role") == "button"
            text = n.text if n.kind == "text" else " ".join(n.parts) if labelled else None
            yield at, n.kind, n.tag, list(n.attrs.items()), text, n.region, n.parent, n.form, self.path(at) if n.kind == "element" and labelled else None


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element and per text node that is not blank, in document order (ord), with page_id and, where ``pages`` has them,
    case_id and url. Elements that name something (links, buttons, headings, titles) have the text below them and their path; form is the
    ord of the form around, or -1. Implied end tags are not added beyond void elements. Null markup has no nodes.
    """
    carried = [c for c in CARRIED if c in pages.columns]
    names = ["page_id", *carried, *(f for f, _, _ in FIELDS)]
    kinds = [pa.int64(), *(pa.string() for _ in carried), *(t for _, _, t in FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        for batch in batches:
            out: list[tuple] = []
            for *own, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = _Page()
                page.feed(html or "")
                page.close()
                out += [(*own, *row) for row in page.rows()]
                if len(out) > 20000:
                    yield build(out)
                    out = []
            yield build(out)

    schema = ", ".join(["page_id long", *(f"{c} string" for c in carried), *(f"{f} {t}" for f, t, _ in FIELDS)])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *carried, "html").mapInArrow(run, schema)


def elements(pages: DataFrame) -> DataFrame:
    return elements_of(nodes(pages))


def elements_of(all_nodes: DataFrame) -> DataFrame:
    """page_id, elem_ord, tag, attrs, region, parent, form, path of each element: parent and form are an elem_ord or -1, and elements that name something have their path."""
    return all_nodes.filter("kind = 'element'").select("page_id", F.col("ord").alias("elem_ord"), "tag", "attrs", "region", "parent", "form", "path")


def text_of(all_nodes: DataFrame) -> DataFrame:
    """page_id, text: text outside scripts, styles and templates, trimmed and joined by spaces in document order."""
    texts = all_nodes.filter("kind = 'text'").filter(~F.col("tag").isin(*HIDDEN))
    one = F.struct("ord", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t"))
    return texts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " ").alias("text"))


def visible_text(pages: DataFrame) -> DataFrame:
    return text_of(nodes(pages))


def element_text(all_nodes: DataFrame, tag: str) -> DataFrame:
    """page_id, elem_ord, attrs, region, text of each ``tag`` element: all text below it."""
    return all_nodes.filter((F.col("kind") == "element") & (F.col("tag") == tag)).select("page_id", F.col("ord").alias("elem_ord"), "attrs", "region", "text")


def first_text(all_nodes: DataFrame, tag: str) -> DataFrame:
    """page_id, text of the first ``tag`` element, if it has text."""
    return element_text(all_nodes, tag).groupBy("page_id").agg(F.min_by("text", "elem_ord").alias("text")).filter("text <> ''")


def dom_features(pages: DataFrame) -> DataFrame:
    return dom_features_of(nodes(pages))


def dom_features_of(all_nodes: DataFrame) -> DataFrame:
    """page_id, pair: adjacent pairs of ``tag[attribute names]`` without scripts, styles, noscripts and templates."""
    rows = elements_of(all_nodes).filter(~F.col("tag").isin("script", "style", "noscript", "template"))
    feature = F.concat("tag", F.lit("["), F.array_join(F.array_sort(F.map_keys("attrs")), ","), F.lit("]"))
    rows = rows.select("page_id", "elem_ord", feature.alias("feature"))
    return rows.withColumn("pair", F.concat("feature", F.lit(">"), F.lead("feature").over(W.partitionBy("page_id").orderBy("elem_ord")))).filter("pair is not null")
