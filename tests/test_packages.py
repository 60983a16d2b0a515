"""Case packages on disk: every defect at least once, each of comparisons and diagnostics twice; expected rows are stated by hand."""

import copy
import hashlib
import json

import pytest

from sightline.operators import packages as pk
from sightline.sources import packages as src

SHA = "a" * 64


def package(case):
    evidence = [(f"e-{t}", t) for t in ("html_page", "screenshot", "evidence_crop", "ocr_text")]
    return {
        "case": {"case_id": case, "status": "completed", "seed_url": "http://x.example/", "final_url": "http://x.example/a b?token=1", "page_title": "T", "page_count": 1, "candidate_count": 1, "limitation_reasons": ["slow"], "collection_limits": {"pages": 5, "deep": {"n": [1, 2]}}},
        "pages": [{"id": "page-1", "depth": 0, "state": "completed", "final_url": "http://x.example/", "content_usable": True, "html_evidence_id": "e-html_page", "screenshot_evidence_id": "e-screenshot", "ocr_text_evidence_id": None}],
        "evidence": [{"id": i, "type": t, "path": f"{t}.bin", "sha256": SHA, "source_url": "http://x.example/", "page_id": "page-1", "metadata": {"n": 1}} for i, t in evidence],
        "entities": [{"id": "entity-001", "type": "telegram", "normalized_value": "@x", "source_evidence_id": "e-html_page", "confidence": 1.0, "details": {"a": "b"}}],
        "observations": [{"id": "observation-0001", "observation_type": "public_email_address", "normalized_value": "a@b.example", "source_page_id": "page-1", "source_artifact_id": "e-html_page", "screenshot_evidence_id": "e-screenshot", "crop_evidence_id": "e-evidence_crop"}],
        "graph": {"nodes": [{"id": "n1", "type": "page", "label": "p"}, {"id": "n2", "type": "domain", "label": "d"}], "edges": [{"id": "g1", "source": "n1", "target": "n2", "type": "links_to", "evidence_id": "e-html_page"}]},
        "candidates": {"source_case_id": case, "candidates": [{"id": "c1", "registrable_domain": "y.example", "score": 5.0, "reasons": [{"code": "link", "source_observation_ids": ["co1"], "supporting_evidence_refs": [{"case_id": case, "evidence_id": "e-html_page"}, {"case_id": "other", "evidence_id": "elsewhere"}]}]}]},
        "candidate_observations": [{"id": "co1", "source_case_id": case, "source_evidence_id": "e-html_page", "discovery_method": "link"}, {"id": "co2", "source_case_id": case, "source_evidence_id": "nowhere", "discovery_method": "public_source"}],
        "frontier": [{"id": "f1", "depth": 1, "state": "queued", "normalized_url": "http://x.example/n?session=9", "source_page_id": "page-1", "source_evidence_id": "e-html_page"}],
    }


def change(path, value):
    def do(p):
        *keys, last = path
        for k in keys:
            p = p[k]
        if value is KeyError:
            del p[last]
        else:
            p[last] = value

    return do


def twice(part, inner=None):
    def do(p):
        rows = p[part][inner] if inner else p[part]
        rows.append(copy.deepcopy(rows[0]))

    return do


# what is changed, the rule, its subject
DEFECTS = {
    "id": (change(["case", "case_id"], "else"), "id_differs", "else"), "status": (change(["case", "status"], "running"), "not_completed", "running"), "noevidence": (change(["evidence"], KeyError), "missing_file", "evidence"), "nopages": (change(["pages"], KeyError), "missing_file", "pages"),
    "torn": (change(["entities"], '[{"id": '), "broken_file", "entities"), "shape": (change(["pages"], {"id": "page-1"}), "broken_file", "pages"), "large": (change(["frontier", 0, "anchor_text"], "x" * 2_000_001), "broken_file", "frontier"), "alone": (change(["candidates"], KeyError), "candidates_unpaired", "candidates"),
    "othercase": (change(["candidates", "source_case_id"], "else"), "candidates_of_other_case", "else"), "twicepage": (twice("pages"), "pages.id", "page-1"), "twicenode": (twice("graph", "nodes"), "graph_nodes.id", "n1"), "blank": (change(["entities", 0, "id"], ""), "entities.id", ""),
    "nohtml": (change(["pages", 0, "html_evidence_id"], None), "pages.html_evidence_id", "page-1"), "htmltype": (change(["pages", 0, "html_evidence_id"], "e-screenshot"), "pages.html_evidence_id", "page-1"), "shottype": (change(["pages", 0, "screenshot_evidence_id"], "e-ocr_text"), "pages.screenshot_evidence_id", "page-1"),
    "ocrlost": (change(["pages", 0, "ocr_text_evidence_id"], "lost"), "pages.ocr_text_evidence_id", "page-1"), "redirect": (change(["pages", 0, "redirect_evidence_id"], "e-html_page"), "pages.redirect_evidence_id", "page-1"), "entity": (change(["entities", 0, "source_evidence_id"], "e-screenshot"), "entities.source_evidence_id", "entity-001"),
    "entitynull": (change(["entities", 0, "source_evidence_id"], None), "entities.source_evidence_id", "entity-001"), "artifact": (change(["observations", 0, "source_artifact_id"], "lost"), "observations.source_artifact_id", "observation-0001"), "noshot": (change(["observations", 0, "screenshot_evidence_id"], None), "observations.screenshot_evidence_id", "observation-0001"),
    "crop": (change(["observations", 0, "crop_evidence_id"], "e-html_page"), "observations.crop_evidence_id", "observation-0001"), "source": (change(["graph", "edges", 0, "source"], "n9"), "graph_edges.source", "g1"), "target": (change(["graph", "edges", 0, "target"], None), "graph_edges.target", "g1"), "edge": (change(["graph", "edges", 0, "evidence_id"], "lost"), "graph_edges.evidence_id", "g1"),
    "reason": (change(["candidates", "candidates", 0, "reasons", 0, "source_observation_ids"], ["co1", "co9"]), "candidate_reasons.source_observation_id", "c1"), "support": (change(["candidates", "candidates", 0, "reasons", 0, "supporting_evidence_refs", 0, "evidence_id"], "lost"), "candidate_evidence.evidence_id", "c1"),
    "noted": (change(["candidate_observations", 0, "source_evidence_id"], "lost"), "candidate_observations.source_evidence_id", "co1"),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    cases = {"good": package("good"), "bare": {k: v for k, v in package("bare").items() if k in ("case", "pages", "evidence", "entities")}}
    for name, (do, _, _) in DEFECTS.items():
        cases[name] = package(name)
        do(cases[name])
    cases["..bad"] = package("..bad")
    for name, parts in cases.items():
        (folder / name).mkdir()
        for part, content in parts.items():
            (folder / name / f"{part}.json").write_text(content if isinstance(content, str) else json.dumps(content))
        (folder / name / "notes.json").write_text("{")
    return str(folder)


def test_each_defect_and_no_other(spark, root):
    packages = src.read_packages(spark, root)
    tables = src.read_tables(packages)
    found = [src.file_violations(packages), pk.case_violations(tables), pk.reference_violations(tables)]
    got = sorted(tuple(r) for f in found for r in f.collect())
    want = {(name, rule, subject) for name, (_, rule, subject) in DEFECTS.items()}
    # without evidence, or with ids gone, references break too
    extra = {r for r in got if r not in want}
    assert want <= set(got) and len(got) == len(set(got))
    assert {r[0] for r in extra} <= {"noevidence", "nopages", "twicepage", "alone"}
    state = {r.case_id: r.integrity for r in pk.verified_cases(packages, *found).collect()}
    assert state == dict.fromkeys(DEFECTS, "error") | {"good": "verified", "bare": "verified"}


def test_free_form_maps_and_optional_files(spark, root):
    tables = src.read_tables(src.read_packages(spark, root))
    good = tables["case"].filter("case_id = 'good'")
    assert good.selectExpr("variant_get(collection_limits, '$.deep.n[1]', 'int') AS v").first().v == 2
    assert tables["entities"].filter("case_id = 'good'").selectExpr("variant_get(details, '$.a', 'string') AS v").first().v == "b"
    assert tables["frontier"].filter("case_id = 'bare'").count() == 0 and tables["pages"].filter("case_id = 'bare'").count() == 1


def test_manifest_is_the_tree_of_all_records(spark, root):
    tables = src.read_tables(src.read_packages(spark, root))
    got = {r.case_id: (r.n, r.sha256) for r in pk.manifests(tables).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    field = lambda *v: sha("\x1f".join("-" if x is None else f"={x}" for x in v))
    p = package("good")
    leaves = {"pages/page-1": field("http://x.example/", "true", "e-html_page", "e-screenshot", *[None] * 8), "entities/entity-001": field("telegram", "@x", "e-html_page")} | {f"evidence/{e['id']}": field(e["type"], e["path"], SHA) for e in p["evidence"]}
    nodes = {}
    for i in sorted(leaves):
        nodes.setdefault(sha(i)[:2], []).append(f"{i}:{leaves[i]}")
    assert got["good"] == (6, sha("\n".join(sha("\n".join(nodes[k])) for k in sorted(nodes))))
    assert got["good"] == got["bare"] and got["good"][1] != got["nohtml"][1] != got["entity"][1]


def test_comparisons(spark, root):
    packages = src.read_packages(spark, root)
    tables = src.read_tables(packages)
    hashes = pk.manifests(tables)
    verified = pk.verified_cases(packages, src.file_violations(packages), pk.case_violations(tables), pk.reference_violations(tables))
    own = {r.case_id: r.sha256 for r in hashes.collect()}
    e = lambda case="good", i="e-html_page", path="html_page.bin", sha=SHA: (case, i, path, sha)
    n = lambda case="bare", i="entity-001", ev="e-html_page", t="telegram", v="@x": (case, i, ev, t, v)
    docs = [
        ("fine", "good", own["good"], "bare", own["bare"], [e()], [n()]), ("empty", "good", own["good"], "bare", own["bare"], [], None), ("same", "good", own["good"], "good", own["good"], [], []), ("same2", "bare", own["bare"], "bare", own["bare"], [], []),
        ("gone", "good", own["good"], "missing", "x", [], []), ("unverified", "status", own["status"], "good", own["good"], [], []), ("left", "good", "x", "bare", own["bare"], [], []), ("right", "good", own["good"], "bare", None, [], []),
        ("out", "good", own["good"], "bare", own["bare"], [e(case="status")], [n(case="status")]), ("path", "good", own["good"], "bare", own["bare"], [e(path="y"), e()], []), ("sha", "good", own["good"], "bare", own["bare"], [e(sha="y")], []),
        ("lost", "good", own["good"], "bare", own["bare"], [e(i="lost")], [n(i="entity-9")]), ("type", "good", own["good"], "bare", own["bare"], [], [n(t="phone")]), ("value", "good", own["good"], "bare", own["bare"], [], [n(v="@y"), n(ev="e-screenshot")]), ("nullcase", "good", own["good"], "bare", own["bare"], [e(case=None)], []),
    ]
    schema = "comparison_id string, left_case_id string, left_sha256 string, right_case_id string, right_sha256 string, evidence_refs array<struct<case_id:string,evidence_id:string,path:string,sha256:string>>, entity_refs array<struct<case_id:string,entity_id:string,evidence_id:string,type:string,normalized_value:string>>"
    got = sorted(tuple(r) for r in pk.comparison_violations(spark.createDataFrame(docs, schema), tables, hashes, verified).collect())
    assert got == sorted([
        ("same", "same_case", "good"), ("same2", "same_case", "bare"), ("gone", "unknown_case", "missing"), ("unverified", "unknown_case", "status"), ("left", "manifest_differs", "good"), ("right", "manifest_differs", "bare"), ("out", "evidence_outside_pair", "e-html_page"), ("nullcase", "evidence_outside_pair", "e-html_page"),
        ("out", "entities_outside_pair", "entity-001"), ("path", "evidence_differs", "e-html_page"), ("sha", "evidence_differs", "e-html_page"), ("lost", "evidence_differs", "lost"), ("lost", "entities_differs", "entity-9"), ("type", "entities_differs", "entity-001"), ("value", "entities_differs", "entity-001"),
    ])


def test_diagnostics(spark, root, tmp_path):
    tables = src.read_tables(src.read_packages(spark, root))
    own = {r.case_id: r.sha256 for r in pk.manifests(tables).collect()}
    doc = lambda case, **more: {"source_case_id": case, "source_case_manifest_sha256": own[case], "source_page_id": "page-1", "checkpoint_schedule_ms": [0, 500, 1500, 3000], "source_evidence_refs": [{"evidence_id": "e-html_page", "type": "html_page", "sha256": SHA}]} | more
    ref = lambda i="e-html_page", t="html_page", s=SHA: [{"evidence_id": i, "type": t, "sha256": s}]
    docs = {
        "good": doc("good"), "bare": doc("bare", source_case_id="good"), "status": doc("status", source_case_id=None), "id": doc("id", source_case_manifest_sha256="x"), "crop": doc("crop", source_case_manifest_sha256=None), "edge": doc("edge", source_page_id="page-2"), "noted": doc("noted", source_page_id=None),
        "reason": doc("reason", checkpoint_schedule_ms=[0, 500]), "source": doc("source", checkpoint_schedule_ms=None), "target": doc("target", source_evidence_refs=[]), "support": doc("support", source_evidence_refs=None), "noshot": doc("noshot", source_evidence_refs=ref(i="lost")), "artifact": doc("artifact", source_evidence_refs=ref(t="screenshot") + ref(s="y")),
    }
    for case, content in docs.items():
        (tmp_path / case).mkdir()
        (tmp_path / case / "diagnostics.json").write_text(json.dumps(content))
    tables["diagnostics"] = src.read_part(src.read_packages(spark, str(tmp_path)), "diagnostics")
    got = sorted(tuple(r) for r in pk.diagnostic_violations(tables, pk.manifests(tables)).collect())
    assert got == sorted([
        ("bare", "case_differs", "good"), ("status", "case_differs", ""), ("id", "manifest_differs", "x"), ("crop", "manifest_differs", ""), ("edge", "page_missing", "page-2"), ("noted", "page_missing", ""), ("reason", "schedule_differs", ""), ("source", "schedule_differs", ""),
        ("target", "no_references", ""), ("support", "no_references", ""), ("noshot", "evidence_differs", "lost"), ("artifact", "evidence_differs", "e-html_page"),
    ])


def test_details_and_summary(spark, root):
    packages = src.read_packages(spark, root)
    tables = src.read_tables(packages)
    got = {(r.section, r.id): r for r in pk.detail_rows(tables).filter("case_id = 'good'").collect()}
    assert {s for s, _ in got} == {"pages", "frontier", "evidence", "entities", "observations", "candidates", "graph_edges"} and len(got) == 10
    assert got["frontier", "f1"].shown == "http://x.example/n?session=[redacted]" and got["graph_edges", "g1"].shown == "n1 -> n2"
    assert got["candidates", "c1"].missing == ["elsewhere"] and not got["candidates", "c1"].available and got["pages", "page-1"].n_refs == 2 and got["pages", "page-1"].available
    lost = {r.case_id: r.missing for r in pk.detail_rows(tables).filter("section = 'observations'").collect()}
    assert lost["artifact"] == ["lost"] and lost["good"] == [] and len(lost["noevidence"]) == 3
    verified = pk.verified_cases(packages, pk.case_violations(tables))
    marks = spark.createDataFrame([("good", 2, "indicators_observed")], "case_id string, indicator_count long, indicator_status string")
    rows = {r.case_id: r for r in pk.summaries(tables, pk.manifests(tables), verified, marks).collect()}
    assert rows["good"].final_url_display == "http://x.example/a%20b?token=[redacted]" and rows["good"].indicator_count == 2 and rows["good"].limitations == "slow"
    assert rows["status"].integrity == "error" and rows["status"].page_count is None and rows["status"].manifest_sha256 is None
