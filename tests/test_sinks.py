"""History by whole submissions, versions of a roster, and documents in blocks."""

import json

import pytest
from pyspark.sql import functions as F

from rollkeeper.operators import tallies
from rollkeeper.plans import documents, history
from rollkeeper.plans.reconcile import reconcile
from rollkeeper.plans.sinks import write_extraction
from rollkeeper.plans.versions import RosterVersions

ROWS = "scope_id long, roster_seq long, status string"


def test_history_has_each_submission_once(spark, tmp_path):
    folder = str(tmp_path / "history")
    rows = lambda *ids: spark.createDataFrame([(i, "PRESENT") for i in ids], "session_id long, status string")
    assert history.append_history(rows(1, 2), folder, "a")
    assert not history.append_history(rows(1, 2), folder, "a")
    # A writer that fails after its rows, and one that fails half-way, leave nothing that counts.
    rows(9).withColumn("submission_id", F.lit("b")).write.parquet(f"{folder}/rows/attempt=lost")
    assert history.append_history(rows(3), folder, "b")
    assert sorted((r.submission_id, r.session_id) for r in history.read_history(spark, folder).collect()) == [("a", 1), ("a", 2), ("b", 3)]
    # Two writers that commit the same submission: the first counts.
    for k, attempt in enumerate(("x", "y")):
        rows(7).withColumn("submission_id", F.lit("c")).write.parquet(f"{folder}/rows/attempt={attempt}")
        spark.createDataFrame([("c", attempt, k)], history._COMMITS).write.mode("append").parquet(f"{folder}/commits")
    found = history.read_history(spark, folder)
    assert found.filter("submission_id = 'c'").count() == 1 and found.count() == 4


def test_versions_rewrite_touched_buckets_only(spark, tmp_path):
    table = spark.createDataFrame([(s, i, "UNMARKED") for s in range(40) for i in range(3)], ROWS)
    store = RosterVersions(spark, str(tmp_path / "roster"), 8)
    with pytest.raises(ValueError):
        store.read()
    assert store.create(table) == 1
    scopes = spark.createDataFrame([(5,), (5,), (17,)], "scope_id long")
    mark = lambda rows: rows.withColumn("status", F.when(F.col("scope_id").isin(5, 17), "PRESENT").otherwise(F.col("status")))
    assert store.update(scopes, mark) == 2
    before, after = store._paths(1), store._paths(2)
    touched = {r[0] for r in scopes.select(store.bucket_of(F.col("scope_id"))).distinct().collect()}
    assert {b for b in before if before[b] != after[b]} == touched and set(before) == set(after)
    assert store.read(1).filter("status = 'PRESENT'").count() == 0 and store.read(1).count() == 120
    assert sorted({r.scope_id for r in store.read(2).filter("status = 'PRESENT'").collect()}) == [5, 17] and store.read().count() == 120
    # The update reads the files of these buckets and no others.
    files = store.read(2, sorted(touched)).inputFiles()
    assert files and all(any(f"bucket={b}/" in f for b in touched) for f in files)
    # A store opened with another number keeps the roster's own; scopes without rows change nothing.
    other = RosterVersions(spark, str(tmp_path / "roster"), 64)
    assert other.update(spark.createDataFrame([(5,)], "scope_id long"), mark) == 3 and other.buckets == 8
    assert other.update(scopes.limit(0), mark) == 3


def text_of(blocks, key):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r[0], r.block)):
        out[r[0]] = out.get(r[0], "") + r.text
    return {k: json.loads(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_documents_hold_everything(spark, make, class_of_sixty, most):
    records = make.records([("STU001", None, None, "PRESENT", 0.9), (None, "Rahul Kumr", None, "ABSENT", 0.5), (None, "Zed", None, "ABSENT", 0.9), ("STU001", None, None, "ABSENT", 0.9)])
    records = records.unionAll(make.records([("STU002", 'quote " and \\ back', None, "PRESENT", 0.9)], scope=3))
    match = reconcile(records, class_of_sixty.unionAll(make.roster([("S9", "9", "Only Missing", None)], scope=2)))
    found = text_of(documents.match_documents(match, most), "scope_id")
    assert set(found) == {1, 2, 3}
    for scope, doc in found.items():
        assert list(doc) == ["success", "results", "summary", "erp_students_not_detected", "exceptions"]
        mine = lambda df: df.filter(F.col("scope_id") == scope)
        assert [r["raw_name"] for r in doc["results"]] == [r.raw_name for r in mine(match.results).orderBy("rec_seq").collect()]
        assert [r["student_id"] for r in doc["erp_students_not_detected"]] == [r.student_id for r in mine(match.missing).orderBy("roster_seq").collect()]
        assert [r["type"] for r in doc["exceptions"]] == [r.type for r in mine(match.exceptions).orderBy("phase", "seq", "nth").collect()]
        assert doc["summary"]["total_ai_records"] == len(doc["results"])
    fuzzy = found[1]["results"][1]
    assert fuzzy["match_method"] == "FUZZY_NAME" and fuzzy["candidates"][0]["name"] == "Rahul Kumar" and found[1]["results"][0]["candidates"] == []
    sheets = spark.createDataFrame([(1, 2, "Bo"), (1, 1, "Al"), (2, 1, None)], "sheet_id long, rec_seq long, raw_name string")
    sheets = sheets.withColumns({n: F.lit(None).cast("string") for n in ("raw_identifier", "raw_student_id", "raw_attendance_mark")})
    sheets = sheets.withColumns({"status": F.lit("PRESENT"), "confidence": F.lit(0.5)})
    found = text_of(documents.extraction_documents(sheets, tallies.attendance_summary(sheets), most), "sheet_id")
    assert [r["raw_name"] for r in found[1]["records"]] == ["Al", "Bo"] and found[2]["summary"] == {"total_detected": 1, "present": 1, "absent": 0}


def test_written_extraction(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "PRESENT"), (1, 2, "ABSENT"), (2, 1, "ABSENT")], "sheet_id long, rec_seq long, status string")
    write_extraction(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 3
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()) == [(1, 2, 1, 1), (2, 1, 0, 1)]


def test_a_large_document_passes_in_blocks(spark):
    """Blocks stay at their size however many rows a sheet has."""
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("sheet_id"), F.col("id").alias("rec_seq"), F.concat(F.lit("name "), "id").alias("raw_name"))
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("raw_identifier", "raw_student_id", "raw_attendance_mark")})
    rows = rows.withColumns({"status": F.lit("ABSENT"), "confidence": F.lit(0.9)})
    made = documents.extraction_documents(rows, tallies.attendance_summary(rows), 100_000).collect()
    assert max(len(r.text) for r in made) < 101_000 and len(made) > 100
    doc = json.loads("".join(r.text for r in sorted(made, key=lambda r: r.block)))
    assert [r["raw_name"] for r in doc["records"]] == [f"name {i}" for i in range(200_000)]
