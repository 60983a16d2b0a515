"""Artifacts as files of their own and stored many to a file."""

import hashlib
from pathlib import Path

from sightline.operators import leads
from sightline.plans import lead_queries
from sightline.sources import cases as src


def test_states_of_files_and_of_stored_artifacts(spark, tmp_path):
    contents = {"ok": b"\x00\xff\n\x01", "cut": b"ab", "large": b"x" * 101, "edge": b"x" * 100}
    recorded = {**contents, "cut": b"abc", "gone": b"z"}
    evidence = spark.createDataFrame([(i, hashlib.sha256(c).hexdigest()) for i, c in recorded.items()], "id string, sha256 string")
    (tmp_path / "files" / "deep").mkdir(parents=True)
    for i, c in contents.items():
        (tmp_path / "files" / "deep" / i).write_bytes(c)
    src.write_artifacts(spark.createDataFrame([(i, bytearray(c)) for i, c in contents.items()], "id string, content binary"), f"{tmp_path}/stored")
    for artifacts in (src.read_artifacts(spark, f"{tmp_path}/files"), src.read_stored_artifacts(spark, f"{tmp_path}/stored")):
        assert artifacts.columns == ["path", "id", "content"]
        assert dict(map(tuple, leads.verify_artifacts(evidence, artifacts, 100).collect())) == {"ok": "ok", "cut": "modified", "large": "too_large", "edge": "ok", "gone": "missing"}


def test_files_do_not_grow_with_pages(spark):
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("artifacts-*"))
    assert lead_queries.verified(spark, "/root/testdata/sf0.001").count() == 50
    (folder,) = set(shared.glob("artifacts-*")) - before
    assert len([f for f in folder.rglob("*") if f.is_file() and f.name[0] not in "._"]) <= 4
