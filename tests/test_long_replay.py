"""Replay in many tasks against the fold: made-up runs that meet by page, host, label, name and observation in every way, and a long one."""

import json
import random

import pytest

from sightline.operators import long_replay as lr, replay as rp
from test_whole_results import SCHEMA, long_run


def wild_run(seed: int, n: int = 60) -> list[tuple]:
    """Few hosts, pages and ids, so that almost every event meets others; ids come back for other hosts, leads change pages, labels look like hosts."""
    r = random.Random(seed)
    urls = [f"https://{w}{h}.example/{p}" for w in ("", "www.") for h in ("a", "b") for p in ("", "x", "y")] + ["b.example", "A.example", "", "plain"]
    page, ob, node = (lambda: f"page:{r.randrange(5)}"), (lambda: f"o{r.randrange(12)}"), (lambda: r.choice(["page:1", "n1", "n2", "external_destination:a.example", "seed:case"]))
    whats = ["public_outgoing_link", "public_redirect_target", "public_email_address", "public_phone_number", "claimed_brand_identity", "public_offer_claim", "public_payment_method", "public_other"]
    log = [("run.started", {"seed_url": r.choice(urls)})] if r.random() < 0.9 else []
    for k in range(n):
        kind = r.choices(["cap", "obs", "lead", "match", "coll", "prop", "review", "other"], [3, 8, 3, 3, 3, 3, 2, 1])[0]
        some = lambda **x: {a: b() if callable(b) else b for a, b in x.items() if r.random() < 0.85}
        if kind == "cap":
            log.append(("artifact.captured", some(node_id=page, label=r.choice(urls), parent_node_id=page) | ({"root": True} if r.random() < 0.15 else {})))
        elif kind == "obs":
            value = r.choice(urls) if r.random() < 0.7 else r.choice(["m@x", "v1", "v2", "v3", "v4", "v5", "v6"])
            log.append(("observation.created", some(observation_id=ob, node_id=f"obs:{k}" if r.random() < 0.8 else node, source_node_id=page, observation_type=r.choice(whats), normalized_value=value) | ({"matched_case_id": "c"} if r.random() < 0.1 else {})))
        elif kind == "lead":
            log.append(("search.lead.discovered", some(lead_id=f"l{k}", url=r.choice(urls))))
        elif kind == "match":
            log.append(("entity.matched", some(observation_id=ob)))
        elif kind == "coll":
            log.append(("candidate_page.collected", some(node_id=page if r.random() < 0.4 else node, url=r.choice(urls))))
        elif kind == "prop":
            log.append(("assertion.proposed", {"assertion_id": f"a{r.randrange(4)}"} | some(subject=r.choice(urls), object=r.choice(urls + ["Offer Claims · v1"]), supporting_observation_ids=[ob(), ob()]) | ({"subject_node_id": page()} if r.random() < 0.2 else {})))
        elif kind == "review":
            log.append((r.choice(["assertion.verified", "assertion.rejected", "assertion.questioned"]), {"assertion_id": f"a{r.randrange(5)}"}))
        else:
            log.append(("run.noted", {}))
    return [(f"run{seed}", "case", q, f"e{q}" if q % 13 else f"e{max(1, q - 3)}", kind, json.dumps(p)) for q, (kind, p) in enumerate(log, 1)]


def sets(items):
    return sorted(map(str, items.select(rp.COLUMNS).collect()))


@pytest.mark.parametrize("patience", [200, 2])
def test_wild_runs_equal_the_fold(spark, patience):
    """With passes to settle, and with too few, where the fold takes over."""
    log = spark.createDataFrame([e for seed in range(60) for e in wild_run(seed)], SCHEMA).repartition(4, "event_id")
    got, want = sets(lr.replay_long(log, patience)), sets(rp.replay(log))
    assert got == want and len(want) > 3000


def test_long_run_settles_in_few_passes(spark):
    log = spark.createDataFrame(long_run(20_000), SCHEMA)
    decided, nodes, late = lr.decide(log)
    assert late is None and decided.count() == 20_001
    assert sets(lr.replay_long(log)) == sets(rp.replay(log))


def test_empty_log_and_rows_without_run_or_payload(spark):
    assert lr.replay_long(spark.createDataFrame([], SCHEMA)).count() == 0
    log = spark.createDataFrame([(None, "c", 1, "e1", "run.started", None), ("r", "c", 1, "e1", "run.started", None), ("r", "c", 2, "e1", "artifact.captured", None)], SCHEMA)
    assert {(x.item, x.id, x.label) for x in lr.replay_long(log).collect()} == {("node", "seed:c", "c"), ("animation", "0", "1")}


def test_passes_end_with_the_last_change_and_fold_no_names_that_nothing_meets(spark, monkeypatch):
    """A pass is not repeated where the messages of the one before are the same; pages that stand for themselves, and observations never matched, are not folded."""
    passes, told, folded, one = [], [], lr._folded, lr._pass
    monkeypatch.setattr(lr, "_pass", lambda rows, messages: passes.append(0) or one(rows, messages))
    monkeypatch.setattr(lr, "_folded", lambda rows, make, schema: (told.append(rows.count()) if make is lr._Id else None) or folded(rows, make, schema))
    log = [("r", "c", 1, "e1", "run.started", json.dumps({"seed_url": "https://a.example/"}))]
    log += [("r", "c", q, f"e{q}", "artifact.captured", json.dumps({"node_id": f"page:{q}", "label": f"https://a.example/{q}"})) for q in range(2, 12)]
    found = {"observation_type": "public_outgoing_link", "normalized_value": "https://b.example/x"}
    log += [("r", "c", q, f"e{q}", "observation.created", json.dumps(found | {"observation_id": f"o{q}", "source_node_id": f"page:{q % 10 + 2}"})) for q in range(12, 212)]
    log += [("r", "c", 212, "e212", "observation.created", json.dumps(found | {"observation_id": "o212", "source_node_id": "page:2", "normalized_value": "https://www.a.example/y"}))]
    log += [("r", "c", 213, "e213", "entity.matched", json.dumps({"observation_id": "o13"}))]
    frame = spark.createDataFrame(log, SCHEMA)
    assert sets(lr.replay_long(frame)) == sets(rp.replay(frame))
    assert len(passes) == 3 and max(told) < 2.2 * len(log)
