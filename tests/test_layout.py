import random

import pyarrow as pa
from pyspark.sql import functions as F

from rollkeeper.functions import headers
from rollkeeper.operators import cells, regions, rows, slabs
from rollkeeper.plans.extract import extract
from rollkeeper.session import stage
from rollkeeper.sources.ocr import boxes_from_polygons
from tests.test_plans import plan

HEAD3 = [("Roll No", 0.95, 50, 50, 50, 20), ("Student Name", 0.95, 300, 50, 140, 20), ("Attendance", 0.95, 600, 50, 120, 20)]


def records(boxes):
    good, _ = extract(boxes)
    cols = ["raw_identifier", "raw_student_id", "raw_name", "raw_attendance_mark", "status", "confidence"]
    return [tuple(r) for r in good.orderBy("sheet_id", "rec_seq").select(*cols).collect()]


def test_one_row_through_clusters(make):
    boxes = make.boxes(
        [("Roll No", 0.95, 55, 50, 50, 20), ("Student ID", 0.95, 200, 50, 100, 20), ("Student Name", 0.95, 405, 50, 150, 20),
         ("Attendance", 0.95, 650, 50, 140, 20), ("001", 0.98, 50, 120, 30, 20), ("STU001", 0.97, 200, 122, 80, 22),
         ("Aarav", 0.96, 380, 121, 60, 21), ("S.", 0.95, 435, 120, 20, 20), ("Present", 0.99, 650, 120, 70, 20)]
    )
    assert records(boxes) == [("001", "STU001", "Aarav S.", "Present", "PRESENT", 0.98)]


def test_metadata_rows_bands_and_scribble(make):
    page = [("Page No. 1", 0.95, 80, 20, 100, 20), ("Date: 2026-09-27", 0.95, 650, 20, 140, 20)]
    two = make.boxes(page + HEAD3 + [("001", 0.98, 50, 120, 30, 20), ("Aarav S.", 0.96, 300, 120, 100, 20), ("17", 0.95, 600, 120, 40, 20),
                                     ("002", 0.98, 50, 180, 30, 20), ("Rahul", 0.96, 300, 180, 100, 20), ("1", 0.95, 600, 180, 40, 20)], sheet=1)
    scribble = make.boxes(HEAD3 + [("003", 0.98, 50, 120, 30, 20), ("Rahul Kumar", 0.95, 300, 120, 100, 20), ("?", 0.40, 600, 120, 40, 20)], sheet=2)
    assert records(two.unionAll(scribble)) == [
        ("001", None, "Aarav S.", "17", "PRESENT", 0.97),
        ("002", None, "Rahul", "1", "PRESENT", 0.97),
        ("003", None, "Rahul Kumar", "?", "ABSENT", 0.53),
    ]


def test_inferred_and_fallback_columns(make):
    row = [("001", 0.9, 50, 120, 30, 20), ("STU001", 0.9, 160, 120, 60, 20), ("Ann", 0.9, 400, 120, 60, 20), ("P", 0.9, 640, 120, 20, 20)]
    second = [(t.replace("1", "2"), c, x, y + 50, w, h) for t, c, x, y, w, h in row]
    for head in (HEAD3, []):
        assert [r[:4] for r in records(make.boxes(head + row + second))] == [
            ("001", "STU001", "Ann", "P"), ("002", "STU002", "Ann", "P")]


def test_footer_rule_depends_on_input_order(make):
    def bottom(heights):
        boxes = make.boxes([("001", 0.9, 50, 20, 30, 20)] + [("Signature", 0.9, 100, y + 10, 80, 20) for y in heights])
        return regions.with_body_bottom(regions.sheet_tops(boxes), boxes).first().body_bottom

    assert bottom([200, 197]) == 195.0
    assert bottom([197, 200]) == 192.0


def test_anchor_tolerance_counts_from_the_last_kept(spark):
    heights = [100.0, 110.0, 116.0, 117.0, 133.0, 134.0, 200.0]
    df = spark.createDataFrame([(1, y) for y in heights], "sheet_id long, cy double")
    assert sorted(r.cy for r in rows.distinct_anchors(df).collect()) == [100.0, 117.0, 134.0, 200.0]


def test_clusters_equal_a_plain_walk(spark, make):
    rng = random.Random(3)
    sheets = None
    expected = {}
    for sheet in range(6):
        items = [("x", 0.9, rng.randrange(40, 760), rng.randrange(30, 400) / (1 + sheet % 2), rng.choice([20, 60, 120]), rng.choice([14, 20, 30]))
                 for _ in range(60)]
        boxes = make.boxes(items, sheet=sheet)
        sheets = boxes if sheets is None else sheets.unionAll(boxes)
        hs = sorted(i[5] for i in items)
        reach = min(max((hs[29] + hs[30]) / 2 * 0.7, 12.0), 22.0)
        lines = []  # every line: its boxes so far
        for seq in sorted(range(60), key=lambda s: (items[s][3], s)):
            _, _, x, y, w, _ = items[seq]
            fits = []
            for n, line in enumerate(lines):
                gap = abs(y - sum(items[s][3] for s in line) / len(line))
                clash = any(max(items[s][2] - items[s][4] / 2, x - w / 2) < min(items[s][2] + items[s][4] / 2, x + w / 2) - 8 for s in line)
                if gap <= reach and not clash:
                    fits.append((gap, n))
            if fits:
                lines[min(fits)[1]].append(seq)
            else:
                lines.append([seq])
        lines.sort(key=lambda line: sum(items[s][3] for s in line) / len(line))
        expected |= {(sheet, s): n for n, line in enumerate(lines, start=1) for s in line}
    body = sheets.select(*rows.BODY)
    got = rows.clusters_in_order(rows.boxes_to_clusters(body)).select("sheet_id", "box_seq", "row_index").collect()
    assert {(r.sheet_id, r.box_seq): r.row_index for r in got} == expected


def test_many_equal_header_boxes_are_counted(make):
    boxes = make.boxes(HEAD3 + [("Status", 0.9, 100, 250, 60, 20)] * 500 + [("Name", 0.9, 300, 250, 60, 20)])
    band = regions.header_band(boxes).first()
    assert (band.types, band.boxes) == (3, 3)
    counts = {r.cy: r.boxes for r in regions.header_bands(boxes).select("cy", F.col("boxes")).collect()}
    assert counts == {50.0: 3, 250.0: 501}


def test_a_page_has_few_band_slots(make):
    page = [b for n in range(5) for b in ((f"00{n + 1}", 0.9, 50, 120 + 540 * n, 30, 20), ("Ann", 0.9, 300, 130 + 540 * n, 60, 20))]
    boxes = make.boxes(HEAD3 + page, height=2700.0)
    layouts = regions.page_layouts(regions.with_body_bottom(regions.sheet_tops(boxes), boxes), boxes)
    bands = rows.row_bands(rows.distinct_anchors(rows.row_anchors(boxes, layouts)))
    slots = rows.body_slots(layouts, bands)
    assert slots.count() <= boxes.count()
    placed = rows.body_table(boxes, slots).select("box_seq", "row_index").collect()
    joined = rows.boxes_to_bands(rows.boxes_in_table(boxes, layouts), bands).select("box_seq", "row_index").collect()
    assert sorted(placed) == sorted(joined) == [(3 + i, 1 + i // 2) for i in range(10)]


def test_columns_by_the_telling_boxes_alone(make):
    row = [("001", 0.9, 50, 120, 30, 20), ("STU001", 0.9, 160, 120, 60, 20), ("Ann", 0.9, 400, 120, 60, 20), ("P", 0.9, 640, 120, 20, 20)]
    boxes = make.boxes(HEAD3 + row).unionAll(make.boxes(HEAD3 + row[:1] + row[2:], sheet=2)).unionAll(make.boxes([("x", 0.9, 90, 90, 20, 20)], sheet=3))
    telling = regions.telling_boxes(boxes, rows.ROLL_ANCHOR, rows.ID_ANCHOR)
    ends = regions.with_body_bottom(regions.sheet_tops(boxes), boxes)
    found = regions.page_layouts(ends, boxes, telling=telling).orderBy("sheet_id").collect()
    assert found == regions.page_layouts(ends, boxes).orderBy("sheet_id").collect()
    assert [r["columns"]["STUDENT_ID"] is not None for r in found] == [True, False, True]


def test_bounds_of_polygons_of_any_number_of_points(spark):
    shapes = [[[10, 20], [50, 22], [52, 40], [9, 38]], [[10, 20], [50, 22], [30, 60]], [[5, 5], [30, 1], [60, 5], [60, 30], [5, 33]]]
    lines = [(1, i, [[float(x), float(y)] for x, y in s], " a ", 0.9, 100, 100) for i, s in enumerate(shapes)]
    raw = spark.createDataFrame(lines, "sheet_id long, box_seq long, bbox array<array<double>>, text string, conf double, img_w int, img_h int")
    got = [tuple(r) for r in boxes_from_polygons(raw).orderBy("box_seq").select("min_x", "max_x", "min_y", "max_y", "text").collect()]
    assert got == [(9.0, 52.0, 20.0, 40.0, "a"), (10.0, 50.0, 20.0, 60.0, "a"), (5.0, 60.0, 1.0, 33.0, "a")]


def test_runs_across_slabs_equal_a_plain_walk(spark):
    rng = random.Random(5)
    sheets = {s: sorted(rng.sample([4096.0 * n + d for n in range(4) for d in range(-40, 40, 4)], 50)) for s in (1, 2)}
    sheets |= {3: [8192.0 + 5 * n for n in range(-900, 900)], 4: [10.0]}
    heights = spark.createDataFrame([(s, y) for s, ys in sheets.items() for y in ys], "sheet_id long, cy double")
    expected = {}
    for sheet, ys in sheets.items():
        run = 0
        for above, y in zip([None, *ys], ys):
            run += above is None or y - above > 9.0
            expected[sheet, y] = run
    assert {(r.sheet_id, r.cy): r.run for r in slabs.runs(heights, F.lit(9.0)).collect()} == expected


def test_heights_kept_apart_across_batches():
    walk = [(s, run, float(y)) for s in (1, 2) for run in (1, 2) for y in range(0, 100, 7)]
    table = pa.table({"sheet_id": [w[0] for w in walk], "run": [w[1] for w in walk], "cy": [w[2] for w in walk]})
    whole = [tuple(r.values()) for b in rows._kept_apart(iter(table.to_batches()), 16.0) for r in b.to_pylist()]
    cut = [tuple(r.values()) for b in rows._kept_apart(iter(table.to_batches(max_chunksize=4)), 16.0) for r in b.to_pylist()]
    assert whole == cut == [(s, float(y)) for s in (1, 2) for _ in (1, 2) for y in range(0, 100, 21)]


def test_header_pairs_are_counted_as_numbers(make):
    """Only the winning band is looked at for its headers, which are structs that cannot be hashed."""
    boxes = make.boxes(HEAD3)
    telling = regions.telling_boxes(boxes, rows.ROLL_ANCHOR)
    assert "col_type" in telling.columns
    assert "SortAggregate" not in plan(regions.header_bands(stage(telling)))
    assert regions.header_band(boxes).drop("heads").collect() == regions.header_band(telling).drop("heads").collect()


def test_cells_of_a_row_are_gathered_in_one_list(spark):
    line = [(1, 1, 1, "b", 0.5, 9.0, 200.0, "NAME"), (1, 1, 2, " a ", 1.0, 9.0, 100.0, "NAME"), (1, 1, 3, "P", 0.75, 9.0, 500.0, "ATTENDANCE"), (1, 1, 4, "x", 0.75, 9.0, 1.0, None)]
    celled = spark.createDataFrame(line, "sheet_id long, row_index long, box_seq long, text string, conf double, cy double, min_x double, cell string")
    texts = cells.cell_texts(celled)
    assert plan(texts).count("partial_collect_list") <= 2  # its function and its output
    got = texts.first()
    assert (got.ROLL_NO, got.STUDENT_ID, got.NAME, got.ATTENDANCE, got.row_confidence) == (None, None, "a b", "P", 0.75)


def test_telling_texts_are_decoded_three_times(make):
    """The patterns of whole texts are one, and so are the keywords of all column types."""
    texts = ["STU12", "001", "#7", "BCA101", "Teacher Sign", "my att", "no.", "Rollick", "x name", "names x", "xname", "Ann", "stu", "12345"]
    boxes = make.boxes([(t, 0.9, 100, 20 * i, 60, 20) for i, t in enumerate(texts)])
    telling = regions.telling_boxes(boxes, rows.ROLL_ANCHOR, rows.ID_ANCHOR)
    found = {r.text: (r.col_type, r.footer) for r in telling.collect()}
    kinds = {r.text: r.kind for r in boxes.select("text", headers.header_type(F.col("text")).alias("kind")).collect()}
    assert found == {t: (kinds[t], t == "Teacher Sign") for t in texts if t not in ("xname", "Ann", "12345", "stu")} | {"Teacher Sign": (None, True)}
    assert (kinds["my att"], kinds["no."], kinds["Rollick"], kinds["x name"], kinds["names x"], kinds["stu"]) == ("ATTENDANCE", "ROLL_NO", "ROLL_NO", "NAME", "NAME", None)
    assert telling._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1].count("RLIKE") <= 3


def test_lists_are_sorted_without_a_lambda(spark, make):
    boxes = make.boxes(HEAD3 + [("Signature", 0.9, 100, 200, 80, 20)])
    celled = boxes.select("*", F.lit(1).alias("row_index"), F.lit("NAME").alias("cell"))
    sheets = regions.with_body_bottom(regions.sheet_tops(boxes), boxes)
    assert not any("array_sort" in plan(df) for df in (cells.cell_texts(celled), sheets, regions.with_header_columns(sheets)))


def test_pages_of_common_height_are_not_looked_across(spark):
    """Only pages that reach beyond a slab have edges; without such pages nothing is joined."""
    short = stage(spark.range(400).selectExpr("id % 20 AS sheet_id", "id * 10.0D AS cy"))
    bands, runs = rows.row_bands(short), slabs.runs(short, F.lit(16.0))
    assert bands.count() == 400 and {r.run for r in runs.collect()} == set(range(1, 21))
    assert "Join" not in plan(runs).split("== Initial Plan ==")[0]
    far = spark.createDataFrame([(1, -5.0), (1, 5.0), (2, 9000.0), (2, 9005.0), (2, 9.0), (3, 20.0), (None, 7.0), (4, None)], "sheet_id long, cy double")
    assert {(r.sheet_id, r.cy): (r.nth, r.above, r.below) for r in slabs.numbered(far).collect()} == {
        (1, -5.0): (1, None, 5.0), (1, 5.0): (2, -5.0, None), (2, 9.0): (1, None, 9000.0), (2, 9000.0): (2, 9.0, 9005.0), (2, 9005.0): (3, 9000.0, None), (3, 20.0): (1, None, None)}
    assert {(r.sheet_id, r.cy): r.run for r in slabs.runs(far, F.lit(16.0)).collect()} == {
        (1, -5.0): 1, (1, 5.0): 1, (2, 9.0): 1, (2, 9000.0): 2, (2, 9005.0): 2, (3, 20.0): 1}
