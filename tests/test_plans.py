"""What the physical plans must and must not contain."""

import random
import re
import statistics

import pytest

from rollkeeper.operators import fuzzy, matching, rows
from rollkeeper.plans import extract, registry
from rollkeeper.plans.registry import QUERIES, Inputs
from rollkeeper.session import LEAST_PARTITIONS, ROW_GROUP, stage
from rollkeeper.sources import pages

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


@pytest.mark.parametrize(
    "name", ["j9_cascade", "j8_fuzzy_decisions", "j13_apply_cascade", "g2_header_band", "p2_boxes_in_table", "g12_boxes_to_bands"]
)
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_exact_cascade_is_two_joins_without_python(inputs):
    """One join for all six lookups, one back to the records."""
    records, roster = stage(inputs.good_records()), stage(inputs.roster())
    text = plan(matching.resolve_exact(matching.find_exact(records, roster)))
    assert "Python" not in text
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join ", text)) == 2


def test_match_starts_from_stored_views(spark, monkeypatch):
    """The joins behind both views run once, and partitions are merged to several for each core."""
    given = []
    monkeypatch.setattr(registry, "_STORED", {})
    monkeypatch.setattr(registry.reconcile, "reconcile", lambda *views: given.extend(views))
    Inputs(spark, FOLDER).match()
    assert len(given) == 2 and not any("Join" in plan(view) for view in given)
    assert int(spark.conf.get(LEAST_PARTITIONS)) == 4 * spark.sparkContext.defaultParallelism


def test_rank_limits_run_before_the_shuffle(inputs):
    text = plan(fuzzy.top_candidates(inputs.open_names(), inputs.roster()))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_narrow_scan_and_pushed_filter(inputs):
    text = plan(QUERIES["g10_distinct_anchors"](inputs.spark, FOLDER))
    assert "content" not in text
    scan = plan(inputs.boxes().filter("conf < 0.5").select("sheet_id"))
    assert "GreaterThan" in scan or "LessThan(conf,0.5)" in scan
    assert "ReadSchema: struct<sheet_id:bigint,conf:double>" in scan


def test_layout_reads_boxes_a_few_times(spark, inputs):
    """Scans of the boxes in all stages of the job, and no texts in the clustering stream."""
    boxes = inputs.boxes()
    folder = boxes.inputFiles()[0].rsplit("/", 1)[0].split("stage-")[1][:32]
    plans = []

    def keep(df):
        plans.append(plan(df))
        return stage(df)

    out, _ = extract.extract(boxes, keep=keep)
    plans.append(plan(out))
    scans = [line for text in plans for line in text.splitlines() if "FileScan" in line and folder in line]
    assert len(scans) <= 5
    assert not any("MapInPandas" in text and "text#" in text.split("MapInPandas")[0] for text in plans)


def test_long_pages_spread_over_slabs(spark):
    """Numbering along a page has no window over a whole sheet of rows."""
    heights = stage(spark.range(20_000).selectExpr("1L AS sheet_id", "id * 20.0D AS cy"))
    bands = rows.row_bands(heights)
    got = bands.orderBy("cy").collect()
    assert [r.row_index for r in got] == list(range(1, 20_001))
    assert [r.cy for r in got if r.is_first] == [0.0] and [r.cy for r in got if r.is_last] == [399_980.0]
    assert all(a.y_end == b.y_start for a, b in zip(got, got[1:]))
    assert len(re.findall(r"windowspecdefinition\(sheet_id#\d+L?, slab#", plan(bands))) >= 3


def test_exact_medians(spark):
    rng = random.Random(7)
    sizes = {s: [rng.choice([12.5, 14.0, 20.0, 20.0, 33.25, rng.random() * 1e4, 1e-9 * rng.random()]) for _ in range(n)] for s, n in enumerate([1, 2, 3, 4, 50, 51, 400])}
    body = spark.createDataFrame([(s, h) for s, hs in sizes.items() for h in hs], "sheet_id long, h double")
    got = {r.sheet_id: r.middle for r in rows.middle_heights(body).collect()}
    assert got == {s: statistics.median(hs) for s, hs in sizes.items()}


def test_saved_pages_are_searched_once_for_each_attribute(spark):
    text = plan(pages.roster_from_pages(spark.createDataFrame([(1, "x")], "page_id long, html string")))
    assert text.count(r"\sdata-roll-number") == 3 and "Filter" not in text


def test_roster_is_spread_over_tasks(inputs):
    assert "hashpartitioning(roster_seq" in plan(inputs.roster())


def test_boxes_are_stored_by_their_edges(inputs):
    """Centres and sizes follow from the edges; rows lie in groups no larger than a split."""
    boxes = inputs.boxes()
    scan = plan(boxes.select("cx", "h"))
    assert "ReadSchema: struct<min_x:double,max_x:double,min_y:double,max_y:double>" in scan
    assert sorted(boxes.columns) == sorted(inputs.boxes_once().columns)
    first = boxes.orderBy("sheet_id", "box_seq").limit(50).collect()
    assert first == inputs.boxes_once().select(*boxes.columns).orderBy("sheet_id", "box_seq").limit(50).collect()


def test_small_sides_are_hashed(spark, inputs):
    """Where one side is small in every partition, the boxes are not sorted to meet it."""
    assert ROW_GROUP <= 1 << 20 << 4 and spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") == "64m"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        body = rows.body_table(inputs.boxes(), rows.body_slots(inputs.layouts(), inputs.bands()))
        body.collect()
        final = plan(body).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "ShuffledHashJoin" in final
