"""Checks and views of case packages (tables of ``sources.packages.read_tables``)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import policy
from sightline.sources.packages import EVIDENCE_FIELDS


@dataclass(frozen=True)
class Reference:
    """A column of a part that names a row of ``target``: which types that row may have (any, if none), and where a null is a fault."""

    part: str
    column: str
    target: str = "evidence"
    types: tuple[str, ...] = ()
    required: str = "false"
    rule: str = ""
    when: str = "true"


REFERENCES = [
    *[Reference("pages", c, types=(t,), required="content_usable" if t == "html_page" else "false") for c, t in EVIDENCE_FIELDS.items()],
    Reference("entities", "source_evidence_id", types=("html_page", "ocr_text"), required="true"),
    Reference("observations", "source_artifact_id", required="true"),
    Reference("observations", "screenshot_evidence_id", types=("screenshot",), required="true"),
    Reference("observations", "crop_evidence_id", types=("evidence_crop",)),
    Reference("graph_edges", "source", "graph_nodes", required="true"),
    Reference("graph_edges", "target", "graph_nodes", required="true"),
    Reference("graph_edges", "evidence_id"),
    Reference("candidate_reasons", "source_observation_id", "candidate_observations", required="true"),
    Reference("candidate_evidence", "evidence_id", required="true", when="ref_case_id = case_id"),
    Reference("candidate_observations", "source_evidence_id", when="source_case_id = case_id and not discovery_method <=> 'public_source'"),
]
UNIQUE = ["evidence", "pages", "entities", "observations", "graph_nodes", "graph_edges", "candidate_observations"]


def _with_reasons(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    reasons = tables["candidates"].select("case_id", "id", F.explode("reasons").alias("r"))
    named = reasons.select("case_id", "id", F.explode("r.source_observation_ids").alias("source_observation_id"))
    refs = reasons.select("case_id", "id", F.explode("r.supporting_evidence_refs").alias("e")).select("case_id", "id", F.col("e.case_id").alias("ref_case_id"), F.col("e.evidence_id").alias("evidence_id"))
    return tables | {"candidate_reasons": named, "candidate_evidence": refs}


def reference_violations(tables: dict[str, DataFrame], references: list[Reference] = REFERENCES) -> DataFrame:
    """case_id, rule, subject: records that name no row of their case, one of another type, or none where one is required; distinct.

    All references become rows of one table, which is joined once with all rows that can be named, by case and id; so one large case is spread.
    """
    tables = _with_reasons(tables)
    rows = []
    for r in references:
        types = F.array(*[F.lit(t) for t in r.types]).cast("array<string>")
        rows.append(tables[r.part].filter(r.when).select("case_id", F.lit(r.rule or f"{r.part}.{r.column}").alias("rule"), F.col("id").alias("subject"), F.col(r.column).alias("named"), F.lit(r.target).alias("target"), types.alias("types"), F.expr(f"coalesce({r.required}, false)").alias("required")).filter("named is not null or required"))
    targets = []
    for name in sorted({r.target for r in references}):
        kind = F.col("type") if "type" in tables[name].columns else F.lit("")
        targets.append(tables[name].select("case_id", F.lit(name).alias("target"), F.col("id").alias("named"), kind.alias("type")))
    known = reduce(DataFrame.unionByName, targets).groupBy("case_id", "target", "named").agg(F.collect_set("type").alias("found"))
    every = reduce(DataFrame.unionByName, rows)
    bad = F.when(F.col("named").isNull(), F.col("required")).otherwise(F.col("found").isNull() | ((F.size("types") > 0) & ~F.arrays_overlap("types", "found")))
    return every.join(known, ["case_id", "target", "named"], "left").filter(bad).select("case_id", "rule", "subject").distinct()


def case_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """case_id, rule, subject: cases recorded under another id or not completed, candidates of another case, and ids that are blank or repeat in their part."""
    case = tables["case"]
    out = [
        case.filter("not recorded_id <=> case_id").select("case_id", F.lit("id_differs").alias("rule"), F.coalesce("recorded_id", F.lit("")).alias("subject")),
        case.filter("not status <=> 'completed'").select("case_id", F.lit("not_completed").alias("rule"), F.coalesce("status", F.lit("")).alias("subject")),
        tables["candidate_document"].filter("not source_case_id <=> case_id").select("case_id", F.lit("candidates_of_other_case").alias("rule"), F.coalesce("source_case_id", F.lit("")).alias("subject")),
    ]
    for part in UNIQUE:
        ids = tables[part].groupBy("case_id", F.coalesce("id", F.lit("")).alias("subject")).count().filter("count > 1 or subject = ''")
        out.append(ids.select("case_id", F.lit(f"{part}.id").alias("rule"), "subject"))
    return reduce(DataFrame.unionByName, out)


def verified_cases(cases: DataFrame, *violations: DataFrame) -> DataFrame:
    """case_id, integrity, n_violations of each case (case_id): verified where no rule is broken, else error."""
    bad = reduce(DataFrame.unionByName, violations).groupBy("case_id").agg(F.count("*").alias("n_violations"))
    rows = cases.select("case_id").distinct().join(bad, "case_id", "left").na.fill(0)
    return rows.select("case_id", F.when(F.col("n_violations") == 0, "verified").otherwise("error").alias("integrity"), "n_violations")


# hash trees
def tree(rows: DataFrame, keys: list[str], levels: tuple[int, ...] = (2, 0)) -> DataFrame:
    """keys, n, sha256: the hash of all leaves (id, leaf) of a group, over a tree of nodes that hold the leaves whose hashed ids start alike. A node is the
    hash of its children's hashes, ordered by id at the lowest level and by prefix above, joined by line feeds; so no task sees more than a node's children."""
    at = F.sha2("id", 256)
    nodes = rows.select(*keys, F.substring(at, 1, levels[0]).alias("prefix"), F.struct("id", F.concat_ws(":", "id", "leaf").alias("line")).alias("child"), F.lit(1).cast("long").alias("n"))
    for level, longer in zip((*levels[1:], None), levels, strict=True):
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["line"]), "\n"), 256)
        nodes = nodes.groupBy(*keys, "prefix").agg(joined.alias("line"), F.sum("n").alias("n"))
        if level is not None:
            nodes = nodes.select(*keys, F.substring("prefix", 1, level).alias("prefix"), F.struct(F.col("prefix").alias("id"), "line").alias("child"), "n")
    return nodes.select(*keys, "n", F.col("line").alias("sha256"))


def record_leaf(*columns: str) -> Column:
    """The hash of a record's fields, nulls apart from blanks."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def manifests(tables: dict[str, DataFrame]) -> DataFrame:
    """case_id, n, sha256: one hash for the pages, evidence and entities of each case."""
    fields = {"pages": ["final_url", "content_usable", *EVIDENCE_FIELDS], "evidence": ["type", "path", "sha256"], "entities": ["type", "normalized_value", "source_evidence_id"]}
    leaves = [tables[part].select("case_id", F.concat(F.lit(f"{part}/"), "id").alias("id"), record_leaf(*columns).alias("leaf")) for part, columns in fields.items()]
    return tree(reduce(DataFrame.unionByName, leaves), ["case_id"])


# documents that name records of cases
def _named(refs: DataFrame, records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``refs`` with ``same``: whether a record with the keys has all fields."""
    other = records.select(*keys, *fields, F.lit(True).alias("same")).distinct()
    on = reduce(lambda a, b: a & b, [refs[c].eqNullSafe(other[c]) for c in [*keys, *fields]])
    return refs.join(other, on, "left").select(*[refs[c] for c in refs.columns], F.coalesce(other["same"], F.lit(False)).alias("same"))


def comparison_violations(documents: DataFrame, tables: dict[str, DataFrame], hashes: DataFrame, verified: DataFrame) -> DataFrame:
    """comparison_id, rule, subject: comparisons (comparison_id, left_case_id, left_sha256, right_case_id, right_sha256, evidence_refs, entity_refs as arrays of structs; one with many references may be several rows) of a case with itself, of
    cases that are not verified, whose manifests differ, or that name evidence or entities outside their pair or with other fields."""
    same = documents.filter("left_case_id <=> right_case_id").select("comparison_id", F.lit("same_case").alias("rule"), F.col("left_case_id").alias("subject"))
    sides = documents.select("comparison_id", F.explode(F.array(F.struct(F.col("left_case_id").alias("case_id"), F.col("left_sha256").alias("given")), F.struct(F.col("right_case_id").alias("case_id"), F.col("right_sha256").alias("given")))).alias("s")).select("comparison_id", "s.*")
    known = verified.filter("integrity = 'verified'").join(hashes.select("case_id", F.col("sha256").alias("own")), "case_id", "left").select("case_id", "own", F.lit(True).alias("there"))
    sides = sides.join(known, "case_id", "left")
    rule = F.when(F.col("there").isNull(), "unknown_case").when(~F.col("given").eqNullSafe(F.col("own")), "manifest_differs")
    sides = sides.select("comparison_id", rule.alias("rule"), F.col("case_id").alias("subject")).filter("rule is not null")
    inside = lambda r: (F.col(f"{r}.case_id") == F.col("left_case_id")) | (F.col(f"{r}.case_id") == F.col("right_case_id"))
    out = [same, sides]
    for refs, key, part, fields in (("evidence_refs", "evidence_id", "evidence", ["path", "sha256"]), ("entity_refs", "entity_id", "entities", ["evidence_id", "type", "normalized_value"])):
        rows = documents.select("comparison_id", "left_case_id", "right_case_id", F.explode(refs).alias("r")).select("comparison_id", F.coalesce(inside("r"), F.lit(False)).alias("inside"), "r.*")
        records = tables[part].withColumnRenamed("id", key).withColumnRenamed("source_evidence_id", "evidence_id") if part == "entities" else tables[part].withColumnRenamed("id", key)
        checked = _named(rows, records, ["case_id", key], fields)
        kind = F.when(~F.col("inside"), f"{part}_outside_pair").when(~F.col("same"), f"{part}_differs")
        out.append(checked.select("comparison_id", kind.alias("rule"), F.col(key).alias("subject")).filter("rule is not null"))
    return reduce(DataFrame.unionByName, out).distinct()


SCHEDULE = [0, 500, 1500, 3000]  # fixed value: milliseconds of a diagnostic's checkpoints


def diagnostic_violations(tables: dict[str, DataFrame], hashes: DataFrame) -> DataFrame:
    """case_id, rule, subject: diagnostics of another case or manifest, of a page that the case has not, with another schedule, without references, or with references
    whose type or hash differ."""
    rows = tables["diagnostics"].join(hashes.select("case_id", F.col("sha256").alias("own")), "case_id", "left")
    schedule = F.array(*[F.lit(v) for v in SCHEDULE])
    tests = [
        ("case_differs", ~F.col("source_case_id").eqNullSafe(F.col("case_id")), F.col("source_case_id")), ("manifest_differs", ~F.col("source_case_manifest_sha256").eqNullSafe(F.col("own")), F.col("source_case_manifest_sha256")),
        ("schedule_differs", ~F.col("checkpoint_schedule_ms").eqNullSafe(schedule), F.lit("")), ("no_references", F.coalesce(F.size("source_evidence_refs"), F.lit(0)) <= 0, F.lit("")),
    ]
    found = rows.select("case_id", F.explode(F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), F.coalesce(subject, F.lit("")).alias("subject"))) for name, bad, subject in tests])).alias("v")).filter("v is not null").select("case_id", "v.*")
    page = _named(rows.select("case_id", F.col("source_page_id").alias("id")), tables["pages"], ["case_id", "id"], []).filter("not same")
    refs = rows.select("case_id", F.explode("source_evidence_refs").alias("r")).select("case_id", F.col("r.evidence_id").alias("id"), "r.type", "r.sha256")
    refs = _named(refs, tables["evidence"], ["case_id", "id"], ["type", "sha256"]).filter("not same")
    blank = F.coalesce("id", F.lit("")).alias("subject")
    return found.unionByName(page.select("case_id", F.lit("page_missing").alias("rule"), blank)).unionByName(refs.select("case_id", F.lit("evidence_differs").alias("rule"), blank)).distinct()


# views
def _sections(tables: dict[str, DataFrame]) -> list[DataFrame]:
    none = F.lit(None).cast("string")
    row = lambda part, kind, shown, page, refs: tables[part].select("case_id", F.lit(part).alias("section"), "ord", F.col("id").alias("order"), "id", kind.alias("kind"), shown.alias("shown"), page.alias("page_id"), F.array_compact(F.array(*[F.col(r) for r in refs]).cast("array<string>")).alias("refs"))
    c = F.col
    reasons = F.flatten(F.transform("reasons", lambda r: F.transform(r["supporting_evidence_refs"], lambda e: e["evidence_id"])))
    candidates = tables["candidates"].select("case_id", F.lit("candidates").alias("section"), "ord", F.format_string("%08d", "ord").alias("order"), "id", F.lit("candidate").alias("kind"), policy.shortened(c("registrable_domain"), 256).alias("shown"), none.alias("page_id"), F.array_distinct(F.array_compact(F.coalesce(reasons, F.array().cast("array<string>")))).alias("refs"))
    return [
        row("pages", c("state"), policy.redact_url(c("final_url")), c("id"), list(EVIDENCE_FIELDS)), row("frontier", c("state"), policy.redact_url(c("normalized_url")), c("source_page_id"), ["source_evidence_id"]),
        row("evidence", c("type"), policy.redact_url(c("source_url")), c("page_id"), ["id"]), row("entities", c("type"), policy.redact_entity(c("type"), c("normalized_value")), none, ["source_evidence_id"]),
        row("observations", c("observation_type"), policy.redact_entity(c("observation_type"), c("normalized_value")), c("source_page_id"), ["source_artifact_id", "screenshot_evidence_id", "crop_evidence_id"]),
        candidates, row("graph_edges", c("type"), F.concat_ws(" -> ", policy.shortened(c("source"), 256), policy.shortened(c("target"), 256)), none, ["evidence_id"]),
    ]


def detail_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """case_id, section, order, id, kind, shown, page_id, n_refs, available, missing: the rows of a case for display in seven sections, each in the order of its
    ids (candidates in their own), redacted, with how many evidence ids they name and which of these the case has not."""
    rows = reduce(DataFrame.unionByName, _sections(tables))
    key = ["case_id", "section", "ord"]
    refs = rows.select(*key, F.explode(F.array_distinct("refs")).alias("ref"))
    known = tables["evidence"].select("case_id", F.col("id").alias("ref"), F.lit(True).alias("there")).distinct()
    lost = refs.join(known, ["case_id", "ref"], "left").filter("there is null").groupBy(*key).agg(F.array_sort(F.collect_set("ref")).alias("missing"))
    rows = rows.join(lost, key, "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return rows.select("case_id", "section", "order", "id", "kind", "shown", "page_id", F.size(F.array_distinct("refs")).alias("n_refs"), (F.size("missing") == 0).alias("available"), "missing")


def summaries(tables: dict[str, DataFrame], hashes: DataFrame, verified: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row a case: integrity and, where it is verified, its facts for display, its indicators (case_id, indicator_count, indicator_status) and its manifest's hash."""
    c = tables["case"]
    facts = c.select("case_id", "status", "started_at", "completed_at", policy.shortened(F.col("page_title"), 256).alias("page_title"), policy.redact_url(F.col("final_url")).alias("final_url_display"), "capture_outcome", "public_status", "content_usable", F.array_join(F.transform("limitation_reasons", lambda r: policy.shortened(r, 256)), "; ").alias("limitations"), "page_count", "candidate_count")
    rows = verified.select("case_id", "integrity").join(facts, "case_id", "left").join(indicators, "case_id", "left").join(hashes.select("case_id", F.col("sha256").alias("manifest_sha256")), "case_id", "left")
    return rows.select("case_id", "integrity", *[F.when(F.col("integrity") == "verified", F.col(x)).alias(x) for x in rows.columns if x not in ("case_id", "integrity")])
