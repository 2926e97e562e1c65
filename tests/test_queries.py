"""Some queries against their SQL; ``tests/oracle_check.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from rollkeeper.plans.oracle import ORACLES
from rollkeeper.plans.registry import QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["f1_normalize_attendance", "f13_split_identity", "s3_roster_intake", "j9_cascade_with_fuzzy", "e_exceptions",
           "a2_match_summary", "w4_candidate_previews", "m1_apply_statuses", "g2_header_band", "g6_g7_g8_columns", "g13_boxes_to_clusters"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == ""


def test_every_query_has_sql_of_its_own():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_that_read_the_boxes_once_write_no_stage(spark, monkeypatch):
    from rollkeeper.plans import registry

    registry.forget_stored()
    monkeypatch.setattr(registry, "stage", lambda df: (_ for _ in ()).throw(AssertionError("a stage was written")))
    for name in ("f16_page_metadata", "f17_banner", "f18_header_type", "g1_header_candidates", "s2_ocr_boxes", "p1_readable_boxes"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns[:2] == ["sheet_id", "box_seq"]
