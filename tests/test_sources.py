"""Manifests, publishing, reports, state, recordings, schema tags."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import reports
from tidewright.sources import files


def test_manifest_is_verified_scanned_and_digested(spark, tmp_path):
    for name, rows in (("b.jsonl", [1, 2]), ("a.jsonl", [3]), ("c.jsonl", [])):
        (tmp_path / name).write_text("".join(json.dumps({"id": i}) + "\n" for i in rows))
    told = files.manifest(spark, str(tmp_path))
    assert [(r["name"], r["rows"]) for r in told] == [("a.jsonl", 1), ("b.jsonl", 2), ("c.jsonl", 0)]
    whole = b"".join((tmp_path / r["name"]).read_bytes() for r in told)
    assert files.aggregate_sha256(spark, str(tmp_path), told) == hashlib.sha256(whole).hexdigest()
    order = [told[1], told[0]]
    got = files.manifest_scan(spark, str(tmp_path), order, "id long").orderBy("shard", "id").collect()
    assert [(r.shard, r.id) for r in got] == [(0, 1), (0, 2), (1, 3)]
    with pytest.raises(ValueError):
        files.manifest_scan(spark, str(tmp_path), [told[0], told[0]], "id long")
    (tmp_path / "a.jsonl").write_text("")
    assert files.verify(spark, str(tmp_path), told) == ["a.jsonl: bytes", "a.jsonl: rows", "a.jsonl: sha256"]


def test_publishing_keeps_the_old_version_when_a_write_fails(spark, tmp_path):
    where = str(tmp_path / "out")
    files.publish(spark.range(3), where)
    files.publish(spark.range(5), where)
    assert files.current(spark, where, "id long").count() == 5
    before = {p.name for p in (tmp_path / "out").iterdir()}
    with pytest.raises(Exception, match="broken"):
        files.publish(spark.range(2).select(F.raise_error(F.lit("broken")).alias("id")), where)
    assert {p.name for p in (tmp_path / "out").iterdir()} == before and files.current(spark, where, "id long").count() == 5


def test_reports_state_and_recordings(spark, tmp_path):
    where = str(tmp_path / "state.json")
    assert files.merged_state(spark, {"a": 1}, where) == {"a": 1}
    assert files.merged_state(spark, {"b": 2, "a": 3}, where) == {"a": 3, "b": 2} == json.loads((tmp_path / "state.json").read_text())
    folder = tmp_path / "recordings"
    folder.mkdir()
    for i, x in enumerate([{"version": 2, "session": "s", "frames": [{"at": 5, "text": "hi"}, {"at": 9}]}, {"version": 3, "session": "t", "frames": [{"at": 1}]}, {"version": 1, "session": "u", "frames": []}]):
        (folder / f"{i}.json").write_text(json.dumps(x, indent=1))
    assert [(r.session, r.frame, r.at, r.text) for r in files.recordings(spark, str(folder)).collect()] == [("s", 0, 5, "hi"), ("s", 1, 9, None)]


def test_schema_tags(spark):
    d = spark.createDataFrame([("g1", 1), ("v4", 2)], "schema string, x int")
    new, old = files.routed(d, "schema", "g1", ["v4"])
    assert [r.x for r in new.collect()] == [1] and [r.x for r in old.collect()] == [2]
    with pytest.raises(Exception, match="unknown schema tag"):
        files.routed(d, "schema", "g1", [])[0].collect()


def test_context_filter_takes_any_counter(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "abcdef")], "id int, text string")
    assert [(r.id, r.tokens, r.kept) for r in reports.within_context(d, "text", 1).collect()] == [(1, 2, False), (2, 0, True), (3, 1, True)]
    counted = reports.within_context(d, "text", 4, lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long"))
    audit = reports.removed_audit(counted, []).first()
    assert (audit.n, audit.removed, audit.longest_kept, audit.longest_removed) == (3, 1, 3, 6)


def test_retained_floors_fail_closed(spark):
    have = spark.createDataFrame([("demo-1", 0.99, 0.9)], "name string, kind_accuracy double, strict_accuracy double")
    assert sorted((r.demo, r.passed) for r in reports.retained(have).collect()) == [("demo-1", True), ("demo-1", True), ("demo-2", False), ("demo-2", False), ("demo-4", False), ("demo-4", False)]


def test_batches_are_filled_evenly(spark):
    groups = ["fire"] * 24 + ["matched_wait"] * 24 + ["replay"] * 32
    d = spark.createDataFrame(list(enumerate(groups)), "id int, g string")
    rows = reports.balanced_batches(d, "id", "g", 5, "fire", "matched_wait").collect()
    assert [sum(r.batch == b for r in rows) for b in range(5)] == [16] * 5
    for name in ("fire", "matched_wait"):
        assert {sum(r.batch == b and r.g == name for r in rows) for b in range(5)} <= {4, 5}
