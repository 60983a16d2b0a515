"""Cases whose parts are many files: none is left out by its size, and no file or row holds a whole part."""

import json

from sightline.operators import packages as pk
from sightline.plans import bindings, package_queries, registry
from sightline.sources import packages as src

SMALL = "/root/testdata/sf0.001"


def test_pieces_of_any_size_are_read(spark, tmp_path):
    entity = lambda k, more="": {"id": f"entity-{k}", "type": "telegram", "normalized_value": f"@x{k}{more}", "source_evidence_id": "e"}
    ref = lambda k: {"code": "link", "source_observation_ids": [], "supporting_evidence_refs": [{"case_id": "big", "evidence_id": f"e{k}"}]}
    pieces = {
        "entities": [[entity(1, "y" * 2_500_000), entity(2)], [entity(3)], [entity(4), entity(4)]],
        "graph": [[{"nodes": [{"id": "n1", "type": "page", "label": "p"}]}], [{"nodes": [{"id": "n2", "type": "page", "label": "p"}] * 2}, {"edges": [{"id": "g", "source": "n1", "target": "n2", "type": "links_to"}]}, {"nodes": [{"id": "n3", "type": "page", "label": "p"}]}]],
        "candidates": [[{"source_case_id": "other", "candidates": [{"id": f"c{k}", "reasons": [ref(k)]}]}] for k in (1, 2)], "frontier": ["{", "{"],
    }
    for part, docs in pieces.items():
        for k, doc in enumerate(docs):
            folder = tmp_path / "case_id=big" / f"part={part}" / f"piece={k}"
            folder.mkdir(parents=True)
            (folder / "part-0.txt").write_text(doc if isinstance(doc, str) else "".join(json.dumps(line) + "\n" for line in doc))
    packages = src.read_packages(spark, str(tmp_path))
    tables = src.read_tables(packages)
    rows = sorted((r.ord, r.id) for r in tables["entities"].collect())
    assert [i for _, i in rows] == ["entity-1", "entity-2", "entity-3", "entity-4", "entity-4"] and len({o for o, _ in rows}) == 5
    assert sorted(r.id for r in tables["graph_nodes"].collect()) == ["n1", "n2", "n2", "n3"] and tables["graph_nodes"].select("ord").distinct().count() == 4 and tables["graph_edges"].count() == 1
    assert {(r.section, r.id): r.missing for r in pk.detail_rows(tables).filter("section = 'candidates'").collect()} == {("candidates", "c1"): ["e1"], ("candidates", "c2"): ["e2"]}
    found = sorted((r.rule, r.subject) for r in src.file_violations(packages).unionByName(pk.case_violations(tables)).collect())
    assert [f for f in found if f[0] != "missing_file"] == [("broken_file", "frontier"), ("candidates_of_other_case", "other"), ("candidates_unpaired", "candidate_observations"), ("entities.id", "entity-4"), ("graph_nodes.id", "n2")]


def test_no_file_holds_a_whole_part(spark, monkeypatch):
    names = ["read_case_tables", "case_manifest", "case_detail_rows", "list_cases_with_errors"]
    rows = lambda: {name: sorted(map(str, registry.queries()[name](spark, SMALL).collect())) for name in names}
    want = rows()
    monkeypatch.setattr(package_queries, "RECORDS", 20)
    bindings.forget()
    try:
        assert rows() == want
        sizes = [r.n for r in package_queries.packages(spark, SMALL).filter("part in ('pages', 'evidence', 'entities', 'observations')").selectExpr("size(try_variant_get(doc, '$', 'array<variant>')) AS n").collect()]
        assert max(sizes) < 60 and len(sizes) > 60
    finally:
        bindings.forget()


def test_comparisons_in_pieces(spark, monkeypatch):
    """References of a document come in rows of about RECORDS, and nothing else of the packages is built for them."""
    query, seen = registry.queries()["comparison_reference_violations"], []
    check = pk.comparison_violations
    monkeypatch.setattr(pk, "comparison_violations", lambda documents, *a: (seen.append(documents), check(documents, *a))[1])
    want = sorted(map(str, query(spark, SMALL).collect()))
    monkeypatch.setattr(package_queries, "RECORDS", 2)
    monkeypatch.setattr(package_queries, "_contents", None)
    assert sorted(map(str, query(spark, SMALL).collect())) == want and len(want) > 10
    one, many = ({r.n for r in d.selectExpr("size(entity_refs) AS n").collect()} for d in seen)
    assert max(many) < 10 < sum(r.n for r in seen[0].selectExpr("size(entity_refs) AS n").collect()) and max(many) <= max(one)
    total = lambda d: sorted(map(str, d.selectExpr("comparison_id", "explode(entity_refs)").collect()))
    assert total(seen[0]) == total(seen[1]) and seen[1].count() > seen[0].count()
