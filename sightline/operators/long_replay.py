"""Replay of long runs in many tasks.

``replay.replay`` folds a run in order in one task. Here the events of a run are dealt out twice in a pass, and passes repeat until nothing changes:

* by host (or by label where there is none): which node an event finds by its URL, host or label depends on the events and nodes of that host alone. Each host's
  events are folded in order, with ``RunGraph``'s own indexes;
* by id: what a name stands for (pages taken as others, observations), and what a node is at each event (label, status), is folded for each id in order.

What one of them needs of the other comes from the pass before: names of pages, and nodes that enter or leave a host (claims, matched nodes, ids used again for
another host). Every link of such a chain needs a pass; links within a host or an id need none. Events are only decided by earlier ones, so there is one fixed point,
and it is the fold. Runs that are not settled after ``patience`` passes are folded in one task.

Nodes, edges and animations then are aggregates of the decided events. A task holds the nodes of one host at a time, not its events.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from sightline.functions.labels import CLAIM_CATEGORIES, NODE_KINDS, RELATIONS
from sightline.operators.replay import COLUMNS, REVIEWED, RunGraph, host_of, page_of, replay
from sightline.sources.tables import written

EVENT = """run_id string, t long, event string, seed string, op string, given string, label string, host string, page string, key string, raw string, relation string, kind string, what string,
  obs string, matched boolean, root boolean, name string, sid string, slabel string, skey string, oid string, olabel string, okey string, other string, more array<string>"""
NAMES = [c.split()[0] for c in EVENT.split(",")]
SPAN = 1 << 16  # sequences whose animations one task numbers


def group_of(label: str) -> str:
    """The host of a label, or the label: all that can find a node with this label by URL, host or label has the same group."""
    return host_of(label) or label.casefold()


def _event(run: str, case: str, t: int, event: str, kind: str, p: dict) -> dict | None:
    """What an event says, as a row of EVENT; None where the graph does not change by its kind."""
    seed = f"seed:{case}"
    row = dict.fromkeys(NAMES, "") | {"run_id": run, "t": t, "event": event, "seed": seed, "raw": None, "matched": False, "root": False, "more": []}
    if kind == "run.started":
        row |= {"op": "start", "label": str(p.get("seed_url", case))}
    elif kind == "artifact.captured":
        given = str(p.get("node_id", f"page:{t}"))
        parent = p.get("parent_node_id")
        row |= {"op": "cap", "given": given, "label": str(p.get("label", given)), "root": bool(p.get("root")), "raw": str(parent) if parent else None, "relation": str(p.get("parent_relation", "crawled_same_site_page"))}
    elif kind == "observation.created":
        what = str(p.get("observation_type", "public_contact"))
        node_kind = NODE_KINDS.get(what, "public_claim")
        op = "host" if node_kind in ("external_destination", "redirect_target") else "claim" if node_kind == "public_claim" else "plain"
        row |= {
            "op": op, "kind": node_kind, "what": CLAIM_CATEGORIES.get(what, "public_claims") if op == "claim" else what, "label": str(p.get("normalized_value", f"observation:{t}")), "raw": str(p.get("source_node_id", seed)),
            "obs": str(p.get("observation_id", "")), "given": str(p.get("node_id", f"observation:{t}")), "matched": bool(p.get("matched_case_id")), "relation": RELATIONS.get(node_kind, "displays_public_claim"),
        }
    elif kind == "search.lead.discovered":
        row |= {"op": "lead", "label": str(p.get("url", "")), "given": f"candidate:{p.get('lead_id', t)}"}
    elif kind == "entity.matched":
        row |= {"op": "match", "obs": str(p.get("observation_id", ""))}
    elif kind == "candidate_page.collected":
        given = str(p.get("node_id", f"candidate-page:{t}"))
        row |= {"op": "coll", "given": given, "label": str(p.get("url", given))}
    elif kind == "assertion.proposed":
        subject, object_ = str(p.get("subject", "")), str(p.get("object", ""))
        row |= {
            "op": "prop", "name": f"assertion:{p['assertion_id']}", "sid": str(p.get("subject_node_id") or ""), "slabel": subject, "skey": group_of(subject), "oid": str(p.get("object_node_id") or ""), "olabel": object_,
            "okey": group_of(object_), "other": f"candidate-page:{t}", "relation": str(p.get("assertion_type", "candidate_related_to")), "more": [str(x) for x in p.get("supporting_observation_ids") or []],
        }
    elif kind.startswith("assertion."):
        row |= {"op": "review", "name": f"assertion:{p.get('assertion_id', '')}", "what": REVIEWED.get(kind, "dashed")}
    else:
        return None
    if row["op"] in ("start", "cap", "host", "plain", "lead", "coll"):
        row |= {"host": host_of(row["label"]), "page": json.dumps(page_of(row["label"])), "key": group_of(row["label"])}
    return row


def _events(log: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (_event(r.run_id, r.case_id, int(r.sequence), r.event_id, r.kind, json.loads(r.payload or "{}")) for r in batch.itertuples())
            yield pd.DataFrame([r for r in rows if r], columns=NAMES)

    nth = F.row_number().over(W.partitionBy("run_id", "event_id").orderBy("sequence"))
    once = log.filter("run_id IS NOT NULL").select("run_id", "case_id", "sequence", "event_id", "kind", "payload").withColumn("nth", nth).filter("nth = 1").drop("nth")
    return once.mapInPandas(read, EVENT)


def _folded(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Each (run_id, key) in order of t and part: ``make()`` gives an object whose ``row`` and ``end`` yield output rows. Rows pass by, they are not gathered."""
    columns = [c.split()[0] for c in schema.split(",")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if (r.run_id, r.key) != here:
                    if state is not None:
                        out.extend(state.end())
                    here, state = (r.run_id, r.key), make(r.run_id, r.key)
                out.extend(state.row(r))
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame(list(state.end()), columns=columns)

    return rows.repartition("run_id", "key").sortWithinPartitions("run_id", "key", "t", "part").mapInPandas(fold, schema)


ANSWER = "run_id string, t long, slot string, value string"


class _Host:
    """The nodes of one host, or of one label without a host, through the events that look for them. ``RunGraph`` keeps them; only its indexes are used."""

    def __init__(self, run: str, key: str):
        self.run, self.graph = run, RunGraph()

    def _put(self, t: int, node: str, kind: str, label: str, status: str, **more) -> None:
        g = self.graph
        g.made, g.sequence = t, t
        g._put(node, kind, label, status, **more)
        g.animations.clear()
        g.changed.clear()

    def _away(self, node: str) -> None:
        if (x := self.graph.nodes.pop(node, None)) is not None:
            self.graph._index(node, x, add=False)

    def row(self, r) -> Iterator[tuple]:
        g, op, t = self.graph, r.op, int(r.t)
        if op == "look":
            yield self.run, t, r.what, g._labelled(r.label) or None
        elif op == "leave":
            self._away(r.node)
        elif op == "enter":
            self._away(r.node)
            x = {"n": int(r.n), "facts": [], "kind": r.kind, "label": r.label, "status": r.status, "type": r.what}
            g.nodes[r.node] = x
            g._index(r.node, x, add=True)
        elif op == "status":
            if (x := g.nodes.get(r.node)) is not None:
                g.nodes[r.node] = {**x, "status": r.status}
        elif op in ("start", "cap"):
            self._put(t, r.node, r.kind, r.label, r.status)
        else:
            node, label, more, status = r.node, r.label, {}, r.status
            if op == "plain":
                same = [n for _, n in g.labels.get(label) or () if g.nodes[n]["kind"] == r.kind and (r.kind != "public_contact" or g.nodes[n].get("type") == r.what)]
                node, more = (same[0] if same else node), {"type": r.what}
            elif op != "host":
                node = g._by_url(label) or node
            if op == "host":
                label = r.host or label
            elif op == "lead":
                label = r.host or label or node
            if op in ("host", "plain") and (g.nodes.get(node) or {}).get("status") == "collected":
                status = "collected"
            self._put(t, node, r.kind, label, status, **more)
            if op != "host":
                yield self.run, t, "node", node

    def end(self) -> Iterator[tuple]:
        return iter(())


BY_ID = "run_id string, t long, slot string, value string, key string, part int, op string, label string, kind string, what string, n long, status string"


class _Id:
    """One name: what it stands for (keys A: pages, O: observations), or what a node is (N:), at each event that asks or changes it."""

    def __init__(self, run: str, key: str):
        self.run, self.id, self.value, self.node, self.group, self.least, self.own = run, key[2:], None, None, None, [], (None, None)

    def _answer(self, t: int, slot: str, value: str | None) -> tuple:
        return self.run, t, slot, value, None, 0, None, None, None, None, 0, None

    def _tell(self, t: int, group: str, part: int, op: str) -> tuple:
        x = self.node
        return self.run, t, "message", self.id, group, part, op, x["label"], x["kind"], x["type"], x["n"], x["status"]

    def row(self, r) -> Iterator[tuple]:
        t = int(r.t)
        if r.op == "ask":
            yield self._answer(t, r.slot, self.value if r.slot == "match" else self.value or None)
        elif r.op == "set":
            self.value = r.value
        elif r.op == "own":
            if self.node is not None:
                if self.own[0] != (label := self.node["label"]):  # very many ask of one node
                    self.own = (label, json.dumps([json.dumps(page_of(label)), host_of(label)]))
                yield self._answer(t, "own", self.own[1])
        elif r.op == "match":
            if self.node is not None:
                self.node["status"] = "collected"
                yield self._tell(t, self.group, 2, "status")
        else:
            yield from self._put(r, t)

    def _put(self, r, t: int) -> Iterator[tuple]:
        asked = r.op in ("start", "cap", "host", "plain", "lead", "coll")  # the fold by host makes this change itself, in the event's group
        x = self.node or {"n": t, "type": None, "status": None}
        if asked and self.group is not None and self.group != r.group:
            yield self._tell(t, r.group, 0, "enter")
            yield self._tell(t, self.group, 0, "leave")
        label = r.label
        if r.op in ("claim", "host"):
            if label not in self.least:
                insort(self.least, label)
                del self.least[4:]
        if r.op == "claim":
            label = f"{r.what.replace('_', ' ').title()} · {', '.join(self.least)}"
        elif r.op == "host":
            label = r.host or label
        elif r.op == "lead":
            label = r.host or label or self.id
        status = "collected" if r.op in ("host", "plain", "claim") and x["status"] == "collected" else r.status
        before = self.group
        self.node = {"n": x["n"], "label": label, "kind": r.kind, "status": status, "type": r.what if r.op == "plain" else x["type"]}
        self.group = group_of(label)
        if asked and self.group == r.group:
            return
        if asked:
            yield self._tell(t, r.group, 2, "leave")
        elif before is not None and before != self.group:
            yield self._tell(t, before, 2, "leave")
        yield self._tell(t, self.group, 2, "enter")

    def end(self) -> Iterator[tuple]:
        if self.node is not None:
            yield self.run, 0, "final", self.id, None, 0, None, self.node["label"], self.node["kind"], None, self.node["n"], self.node["status"]


def _node(found: Column) -> Column:
    """The node that an event puts: fixed by its kind and source, or found by its host or observation."""
    return (
        F.when(F.col("op") == "start", F.col("seed"))
        .when(F.col("op") == "cap", F.when(F.col("is_root"), F.col("seed")).otherwise(F.col("given")))
        .when(F.col("op") == "host", F.when(F.col("off"), F.lit(None)).when(F.col("host") != "", F.concat("kind", F.lit(":"), "host")).otherwise(F.col("given")))
        .when(F.col("op") == "claim", F.concat(F.lit("claim:"), "src", F.lit(":"), "what"))
        .when(F.col("op") == "match", found)
        .when(F.col("op").isin("plain", "lead", "coll"), F.coalesce(found, F.col("given")))
    )


def _put_kind() -> Column:
    return F.when(F.col("op") == "start", "seed_page").when(F.col("op") == "cap", F.when(F.col("is_root"), "seed_page").otherwise("collected_page")).when(F.col("op") == "coll", "collected_page").when(F.col("op") == "lead", "candidate_domain").otherwise(F.col("kind"))


def _put_status() -> Column:
    return F.when(F.col("op") == "start", "observed").when(F.col("op") == "lead", "lead").when(F.col("op").isin("cap", "coll") | F.col("matched"), "collected").otherwise("observed")


DECIDED = ["src", "is_root", "off", "node", "sname", "oname", "subj", "obj"]


def _moved(before: str, after: str) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")) for c in DECIDED])


def _pivot(answers: DataFrame, *slots: str) -> DataFrame:
    return answers.groupBy("run_id", "t").agg(*[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"a_{s}") for s in slots])


def _by_host(rows: DataFrame, messages: DataFrame | None) -> DataFrame:
    """ANSWER: the nodes that events find."""
    null = F.lit(None).cast("string")
    columns = ["run_id", "key", "t", "part", "op", "label", "host", "kind", "what", "node", "n", "status"]
    node = F.when(F.col("op").isin("plain", "lead", "coll"), F.col("given")).otherwise(F.col("node"))
    acts = rows.filter(F.col("op").isin("start", "cap", "host", "plain", "lead", "coll") & ~F.col("off"))
    acts = acts.select("run_id", "key", "t", F.lit(1).alias("part"), "op", "label", "host", _put_kind().alias("kind"), "what", node.alias("node"), F.col("t").alias("n"), _put_status().alias("status"))
    look = lambda side: rows.filter(f"op = 'prop' AND {side}id = ''").select("run_id", F.col(f"{side}key").alias("key"), "t", F.lit(1).alias("part"), F.lit("look").alias("op"), F.col(f"{side}label").alias("label"), null.alias("host"), null.alias("kind"), F.lit(f"{side}label").alias("what"), null.alias("node"), "t", null.alias("status")).toDF(*columns)
    parts = [acts, look("s"), look("o")]
    if messages is not None:
        parts.append(messages.select("run_id", "key", "t", "part", "op", "label", null.alias("host"), "kind", "what", F.col("value").alias("node"), "n", "status"))
    return _folded(reduce(DataFrame.unionByName, parts), _Host, ANSWER)


def _by_id(rows: DataFrame) -> DataFrame:
    """BY_ID: answers about names and nodes, what other hosts must hear of a node (slot message), and each node at last (slot final)."""
    null = F.lit(None).cast("string")
    op = F.col("op")

    def message(when: Column, name: str, of: Column, part: int, what: str, slot: str | None = None, value: Column = null) -> Column:
        x = F.struct(F.concat(F.lit(f"{name}:"), of).alias("key"), F.lit(part).alias("part"), F.lit(what).alias("act"), F.lit(slot).cast("string").alias("slot"), value.alias("value"))
        return F.when(when & of.isNotNull(), x)

    def narrow(*messages: Column) -> DataFrame:
        each = rows.select("run_id", "t", F.explode(F.array_compact(F.array(*messages))).alias("m"))
        return each.select("run_id", "m.key", "t", "m.part", F.col("m.act").alias("op"), "m.slot", "m.value")

    def meeting(messages: DataFrame, others: DataFrame) -> DataFrame:
        """Messages about names that others are about, too: most pages are never taken as others, and most observations never matched."""
        return messages.join(others.select("run_id", "key").distinct(), ["run_id", "key"], "left_semi")

    seen = op.isin("host", "claim", "plain")
    pages_asked = narrow(
        message(seen, "A", F.col("raw"), 0, "ask", "src"),
        message(op == "cap", "A", F.col("raw"), 2, "ask", "src"),
        message(op == "prop", "A", F.col("sname"), 0, "ask", "subj"),
        message(op == "prop", "A", F.col("oname"), 0, "ask", "obj"),
    )
    pages_set = narrow(message((op == "cap") & F.col("is_root"), "A", F.col("given"), 1, "set", None, F.col("seed")), message(op == "coll", "A", F.col("given"), 1, "set", None, F.col("node")))
    seen_set = narrow(message(seen & (F.col("obs") != ""), "O", F.col("obs"), 1, "set", None, F.coalesce("node", "src")))
    seen_asked = narrow(message(op == "match", "O", F.col("obs"), 0, "ask", "match"))
    nodes = [
        message(op == "cap", "N", F.col("seed"), 0, "own"),
        message(op == "host", "N", F.col("src"), 0, "own"),
        message(op.isin("start", "cap", "host", "claim", "plain", "lead", "coll", "match"), "N", F.col("node"), 1, "put"),
    ]
    each = rows.withColumn("m", F.explode(F.array_compact(F.array(*nodes))))
    each = each.select("run_id", "m.key", "t", "m.part", F.when(F.col("m.act") == "put", op).otherwise(F.col("m.act")).alias("op"), "m.slot", "m.value", F.col("key").alias("group"), "label", "host", _put_kind().alias("kind"), "what", _put_status().alias("status"))
    for more in (pages_set, meeting(pages_asked, pages_set), seen_asked, meeting(seen_set, seen_asked)):
        each = each.unionByName(more, allowMissingColumns=True)
    return _folded(each, _Id, BY_ID)


def _pass(rows: DataFrame, messages: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One pass: the events as decided (with what moved), and what the fold by id found."""
    old = F.struct(*DECIDED)
    found = rows.join(_pivot(_by_host(rows, messages), "node", "slabel", "olabel"), ["run_id", "t"], "left").withColumn("old", old)
    name = lambda side, other: F.when(F.col("op") == "prop", F.coalesce(F.when(F.col(f"{side}id") != "", F.col(f"{side}id")), F.col(f"a_{side}label"), F.col(other)))
    node = F.when(F.col("op") == "match", F.col("node")).otherwise(_node(F.col("a_node")))
    found = found.withColumns({"sname": name("s", "seed"), "oname": name("o", "other"), "node": node}).withColumn("now", old).withColumn("moved", _moved("old", "now"))
    found = written(found, "replay-host")
    by_id = written(_by_id(found), "replay-id")
    said = found.join(_pivot(by_id.filter("slot NOT IN ('message', 'final')"), "src", "own", "match", "subj", "obj"), ["run_id", "t"], "left")
    own = F.from_json("a_own", "array<string>")
    same_page, same_host = own[0] == F.col("page"), (F.col("kind") == "external_destination") & (F.col("host") != "") & (own[1] == F.col("host"))
    said = said.withColumns({
        "src": F.coalesce("a_src", "raw"),
        "is_root": F.col("root") | ((F.col("op") == "cap") & F.coalesce(same_page, F.lit(False))),
        "off": (F.col("op") == "host") & F.coalesce(same_page | same_host, F.lit(False)),
        "subj": F.coalesce("a_subj", "sname"),
        "obj": F.coalesce("a_obj", "oname"),
    })
    said = said.withColumn("node", _node(F.when(F.col("op") == "match", F.col("a_match")).otherwise(F.col("a_node")))).withColumn("then", old).withColumn("moved_again", _moved("now", "then"))
    return written(said.select(*NAMES, *DECIDED, "moved", "moved_again"), "replay-pass"), by_id


def _equal(before: DataFrame | None, after: DataFrame) -> bool:
    """Whether the fold by host would get the messages that it got."""
    if before is None:
        return after.isEmpty()
    return before.count() == after.count() and after.exceptAll(before).isEmpty()


def decide(log: DataFrame, patience: int = 12) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(events with the nodes and ends that they touch, nodes at last, runs not settled or None)."""
    rows = _events(log).withColumns({"src": F.col("raw"), "is_root": F.col("root"), "off": F.lit(False), "sname": F.lit(None).cast("string"), "oname": F.lit(None).cast("string"), "subj": F.lit(None).cast("string"), "obj": F.lit(None).cast("string")})
    rows = written(rows.withColumn("node", _node(F.lit(None).cast("string"))), "replay-events")
    messages, restless = None, True
    for _ in range(patience):
        rows, by_id = _pass(rows, messages)
        before, messages = messages, by_id.filter("slot = 'message'")
        moved, again = rows.agg(F.coalesce(F.max("moved"), F.lit(False)), F.coalesce(F.max("moved_again"), F.lit(False))).first()
        if not (moved or again) and (not restless or _equal(before, messages)):
            return rows, by_id.filter("slot = 'final'"), None
        restless = again
    late = rows.filter("moved OR moved_again").select("run_id").distinct()
    if late.isEmpty():  # the last pass moved nothing, but the one before did
        late = rows.select("run_id").distinct()
    return rows, by_id.filter("slot = 'final'"), late


def _animations(shown: DataFrame) -> DataFrame:
    """Animations in order of their events, numbered by spans of sequences."""
    shown = shown.withColumn("span", F.floor(F.col("t") / SPAN))
    before = shown.groupBy("run_id", "span").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("run_id").orderBy("span")) - F.col("n")).drop("n")
    k = F.row_number().over(W.partitionBy("run_id", "span").orderBy("t", "place")) - 1
    return shown.withColumn("k", k).join(before, ["run_id", "span"]).withColumn("k", F.col("k") + F.col("before"))


def replay_long(log: DataFrame, patience: int = 12) -> DataFrame:
    """The rows of ``replay.replay`` for runs of any length, each in many tasks. ``log``: run_id, case_id, sequence, event_id, kind, payload; a sequence stands for one event
    of its run. Rows without a run_id are left out; a null payload is an empty one; of repeats of an event_id the first counts. Each pass's rows are written under
    ``spark.checkpoint.dir``."""
    rows, finals, late = decide(log, patience)
    folded = None
    if late is not None:
        folded = replay(log.join(late, "run_id"))
        rows, finals = rows.join(late, "run_id", "left_anti"), finals.join(late, "run_id", "left_anti")
    op, null, none = F.col("op"), F.lit(None).cast("string"), F.array().cast("array<string>")
    facts = rows.filter("op IN ('host', 'claim') AND node IS NOT NULL").groupBy("run_id", F.col("node").alias("id")).agg(F.array_sort(F.collect_set("label")).alias("facts"))
    nodes = finals.select("run_id", F.lit("node").alias("item"), F.col("value").alias("id"), "kind", "label", "status", null.alias("source"), null.alias("target"))
    nodes = nodes.join(facts, ["run_id", "id"], "left").withColumns({"facts": F.coalesce("facts", none), "events": none, "observations": none})

    crawl = (op == "cap") & ~F.col("is_root") & F.col("raw").isNotNull()
    seen = op.isin("host", "claim", "plain") & F.col("node").isNotNull()
    edge = F.when(crawl, F.concat(F.lit("crawl:"), "src", F.lit(":"), "node")).when(seen, F.concat("relation", F.lit(":"), "src", F.lit(":"), "node")).when(op == "prop", F.col("name"))
    proposed = op == "prop"
    ends = {"source": F.when(proposed, F.col("subj")).otherwise(F.col("src")), "target": F.when(proposed, F.col("obj")).otherwise(F.col("node"))}
    linked = rows.withColumn("id", edge).withColumns(ends)
    links = linked.filter("id IS NOT NULL").withColumn("look", F.when(op == "prop", "dashed").otherwise("solid"))
    links = links.withColumn("observations", F.when(op == "prop", F.col("more")).when(seen, F.array("obs")).otherwise(none))
    first = F.min(F.when(op == "prop", F.col("t"))).over(W.partitionBy("run_id", "name").orderBy("t"))
    asserted = linked.filter("op IN ('prop', 'review')").withColumn("first", first).withColumn("target", F.last(F.when(op == "prop", F.col("target")), True).over(W.partitionBy("run_id", "name").orderBy("t")))
    reviews = asserted.filter("op = 'review' AND first IS NOT NULL")
    changes = links.select("run_id", "id", "t", "event", "look", F.struct("t", "source", "target", "relation").alias("link"))
    changes = changes.unionByName(reviews.select("run_id", F.col("name").alias("id"), "t", "event", F.col("what").alias("look"), F.lit(None).cast(changes.schema["link"].dataType).alias("link")))
    by_time = F.transform(F.array_sort(F.collect_list(F.struct("t", "event"))), lambda x: x["event"])
    edges = changes.groupBy("run_id", "id").agg(F.max("link").alias("link"), F.max(F.struct("t", "look")).alias("last"), by_time.alias("events"))
    given = links.select("run_id", "id", "t", F.posexplode("observations")).groupBy("run_id", "id", "col").agg(F.min(F.struct("t", "pos")).alias("at"))
    given = given.groupBy("run_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "col"))), lambda x: x["col"]).alias("observations"))
    led = rows.filter("op = 'lead'").groupBy("run_id", F.col("node").alias("target")).agg(F.max("t").alias("led"))
    edges = edges.join(given, ["run_id", "id"], "left").withColumn("target", F.col("link.target")).join(led, ["run_id", "target"], "left")
    look = F.when(F.col("led") > F.col("last.t"), "dashed").otherwise(F.col("last.look"))
    edges = edges.select("run_id", F.lit("edge").alias("item"), "id", F.col("link.relation").alias("kind"), null.alias("label"), look.alias("status"), F.col("link.source").alias("source"), "target", none.alias("facts"), "events", F.coalesce("observations", none).alias("observations"))

    pulse = rows.filter("op = 'match' AND node IS NOT NULL OR off").select("run_id", "t", F.lit(0).alias("place"), F.lit("pulse-node").alias("what"), F.coalesce("node", "src").alias("target"))
    spawn = rows.filter("op IN ('start', 'cap', 'host', 'claim', 'plain', 'lead', 'coll') AND node IS NOT NULL").select("run_id", "t", F.lit(0).alias("place"), F.lit("spawn-node").alias("what"), F.col("node").alias("target"))
    draw = links.select("run_id", "t", F.lit(1).alias("place"), F.lit("draw-edge").alias("what"), F.col("id").alias("target"))
    review = reviews.select("run_id", "t", F.lit(0).alias("place"), F.lit("pulse-node").alias("what"), "target")
    shown = _animations(reduce(DataFrame.unionByName, [pulse, spawn, draw, review]))
    shown = shown.select("run_id", F.lit("animation").alias("item"), F.col("k").cast("string").alias("id"), F.col("what").alias("kind"), F.col("t").cast("string").alias("label"), null.alias("status"), null.alias("source"), "target", none.alias("facts"), none.alias("events"), none.alias("observations"))
    items = nodes.select(COLUMNS).unionByName(edges.select(COLUMNS)).unionByName(shown.select(COLUMNS))
    return items if folded is None else items.unionByName(folded.select(COLUMNS))
