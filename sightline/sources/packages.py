"""Case packages: a folder a case, with JSON files of which some are optional, each whole or in pieces. Free-form maps stay VARIANT columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_BYTES = 2_000_000  # of a file that is a whole part; pieces have no limit
REF = "array<struct<case_id:string,evidence_id:string,path:string,sha256:string,type:string>>"


@dataclass(frozen=True)
class Part:
    """A file of a package: whether it must be there, and the fields of its records. ``many`` files are arrays, the others one object."""

    required: bool
    fields: str
    many: bool = True


# The files of a package, which of them are optional, and the fields that checks and views read.
EVIDENCE_FIELDS = {
    "html_evidence_id": "html_page", "screenshot_evidence_id": "screenshot", "initial_screenshot_evidence_id": "initial_screenshot", "full_page_screenshot_evidence_id": "full_page_screenshot",
    "visible_text_evidence_id": "visible_text", "response_metadata_evidence_id": "response_metadata", "readiness_evidence_id": "capture_readiness", "redirect_evidence_id": "network_event",
    "ocr_text_evidence_id": "ocr_text", "ocr_metadata_evidence_id": "ocr_metadata",
}
PARTS = {
    "case": Part(True, "case_id:string,status:string,seed_url:string,final_url:string,page_title:string,started_at:string,completed_at:string,capture_outcome:string,public_status:string,capture_adequacy:string,content_usable:boolean,page_count:long,candidate_count:long,limitation_reasons:array<string>,collection_limits:variant", many=False),
    "pages": Part(True, "id:string,depth:int,state:string,final_url:string,content_usable:boolean," + ",".join(f"{c}:string" for c in EVIDENCE_FIELDS)),
    "evidence": Part(True, "id:string,type:string,path:string,sha256:string,source_url:string,page_id:string,metadata:variant"),
    "entities": Part(True, "id:string,type:string,normalized_value:string,source_evidence_id:string,confidence:double,details:variant"),
    "frontier": Part(False, "id:string,depth:int,state:string,normalized_url:string,anchor_text:string,source_page_id:string,source_evidence_id:string,skip_reason:string"),
    "observations": Part(False, "id:string,observation_type:string,normalized_value:string,source_page_id:string,source_artifact_id:string,screenshot_evidence_id:string,crop_evidence_id:string,surrounding_text:string,confidence:double,attributes:variant"),
    "graph": Part(False, "nodes:array<struct<id:string,type:string,label:string>>,edges:array<struct<id:string,source:string,target:string,type:string,evidence_id:string>>", many=False),
    "candidates": Part(False, f"source_case_id:string,candidates:array<struct<id:string,registrable_domain:string,score:double,reasons:array<struct<code:string,source_observation_ids:array<string>,supporting_evidence_refs:{REF}>>>>", many=False),
    "candidate_observations": Part(False, "id:string,source_case_id:string,source_evidence_id:string,discovery_method:string"),
    "diagnostics": Part(False, f"source_case_id:string,source_case_manifest_sha256:string,source_page_id:string,checkpoint_schedule_ms:array<int>,source_evidence_refs:{REF}", many=False),
}
#: The tables of ``read_tables``.
TABLES = [*(p for p in PARTS if p not in ("graph", "candidates")), "graph_nodes", "graph_edges", "candidate_document", "candidates"]
CASE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"


def read_packages(spark: SparkSession, root: str) -> DataFrame:
    """case_id, part, piece, n_bytes, doc: one row for each file <root>/<case>/<part>.json, or <root>/case_id=<case>/part=<part>/piece=<n>/<file> as Spark writes it: a large part is many files,
    each with some of its records (of a single object: objects with some of its items) as JSON lines, so that no task holds them all. ``doc`` is a VARIANT array of what the file holds, null where the file is no JSON; so is a
    <part>.json larger than MOST_BYTES, but pieces are read at any size.
    Folders that are no case ids are left out, and so are files of other names."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(root)
    place = r"/(?:case_id=)?([^/]+)/(?:part=([^/]+)/(?:piece=([0-9]+)/)?[^/]+|([^/]+)\.json)$"
    at = F.col("_metadata.file_path")
    found = lambda k: F.nullif(F.regexp_extract(at, place, k), F.lit(""))
    rows = files.select(F.regexp_extract(at, place, 1).alias("case_id"), F.coalesce(found(2), found(4)).alias("part"), F.coalesce(found(3), F.lit("0")).cast("long").alias("piece"), found(4).isNotNull().alias("whole"), F.octet_length("value").alias("n_bytes"), "value")
    rows = rows.filter(F.col("case_id").rlike(CASE_ID) & F.col("part").isin(*PARTS))
    listed = lambda text: F.concat(F.lit("["), text, F.lit("]"))
    one = ~F.col("part").isin(*[p for p, x in PARTS.items() if x.many])
    lines = F.try_parse_json(listed(F.replace(F.rtrim("value", F.lit("\n")), F.lit("\n"), F.lit(","))))
    whole = F.when(one, F.when(F.try_parse_json("value").isNotNull(), F.try_parse_json(listed(F.col("value"))))).otherwise(F.try_parse_json("value"))
    return rows.select("case_id", "part", "piece", "n_bytes", F.when(~F.col("whole"), lines).when(F.col("n_bytes") <= MOST_BYTES, whole).alias("doc"))


def _typed(part: str) -> Column:
    """The records of a file; null where it does not fit."""
    return F.expr(f"try_variant_get(doc, '$', 'array<struct<{PARTS[part].fields}>>')")


def _listed(packages: DataFrame, part: str, items: str | None = None) -> DataFrame:
    """case_id, ord, item: the records of a part, or the items of a list in them, numbered piece after piece."""
    found = _typed(part) if items is None else F.flatten(F.array_compact(F.transform(_typed(part), lambda x: x[items])))
    rows = packages.filter(F.col("part") == part).select("case_id", "piece", F.posexplode(found).alias("place", "item"))
    return rows.select("case_id", (F.shiftleft("piece", 32) + F.col("place")).alias("ord"), "item")


def read_part(packages: DataFrame, part: str) -> DataFrame:
    """case_id (the folder), ord and the fields of a part's records, in their order, piece after piece; a case_id in the record is recorded_id. Files that don't fit have none."""
    rows = _listed(packages, part)
    own = [F.col(f"item.{c}").alias("recorded_id" if c == "case_id" else c) for c in rows.select("item.*").columns]
    return rows.select("case_id", "ord", *own)


def read_tables(packages: DataFrame) -> dict[str, DataFrame]:
    """All parts as tables of rows with case_id, the folder; the lists of a graph and of candidates are tables of their own."""
    tables = {part: read_part(packages, part) for part in PARTS if part not in ("graph", "candidates")}
    for name, items in (("graph_nodes", "nodes"), ("graph_edges", "edges")):
        tables[name] = _listed(packages, "graph", items).select("case_id", "ord", "item.*")
    tables["candidate_document"] = read_part(packages, "candidates").select("case_id", "source_case_id").distinct()
    tables["candidates"] = _listed(packages, "candidates", "candidates").select("case_id", "ord", "item.*")
    return tables


def file_violations(packages: DataFrame) -> DataFrame:
    """case_id, rule, subject: required files that are missing, files that are no JSON, too large or of other fields, and candidates without their observations."""
    fits = F.lit(False)
    for part in PARTS:
        fits = F.when(F.col("part") == part, _typed(part).isNotNull()).otherwise(fits)
    rows = packages.select("case_id", "part", F.coalesce(fits, F.lit(False)).alias("fits"))
    broken = rows.filter("not fits").select("case_id", F.lit("broken_file").alias("rule"), F.col("part").alias("subject")).distinct()
    have = rows.groupBy("case_id").agg(F.collect_set("part").alias("parts"))
    lack = F.array_except(F.array(*[F.lit(p) for p, x in PARTS.items() if x.required]), "parts")
    missing = have.select("case_id", F.lit("missing_file").alias("rule"), F.explode(lack).alias("subject"))
    pair = ("candidates", "candidate_observations")
    both = [F.array_contains("parts", p) for p in pair]
    unpaired = have.filter(both[0] != both[1]).select("case_id", F.lit("candidates_unpaired").alias("rule"), F.when(both[0], pair[1]).otherwise(pair[0]).alias("subject"))
    return missing.unionByName(broken).unionByName(unpaired)
