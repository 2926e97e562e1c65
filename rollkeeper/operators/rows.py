"""Physical rows: which boxes stand on one line of the register."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import COLUMN_TYPES, ROLL_NO, STUDENT_ID, LayoutConfig
from rollkeeper.functions.headers import RULE_LINES, is_banner, is_page_metadata
from rollkeeper.operators.cells import cell_of_box
from rollkeeper.operators.regions import strips
from rollkeeper.operators.slabs import numbered, runs
from rollkeeper.session import stage

# Texts that open a row in the roll and in the id column.
ROLL_ANCHOR = r"(?iU)^(\d{1,4}|STU\d+|#\d+|[A-Z]{1,3}\d{1,4})$"
ID_ANCHOR = r"(?iU)^(STU\d+|[A-Z]{2,4}\d{2,4})$"

BODY = ["sheet_id", "box_seq", "text", "conf", "cx", "cy", "h", "min_x", "max_x", "min_y", "max_y"]


BOUNDS = ["body_top", "body_bottom", "body_left", "body_right"]
BINS = 64
# Strips in which bands meet boxes. Anchors stand over ``same_row`` apart, so one has 32 bands or so at most, however long
# the page; a page of common length has a few strips, fewer than boxes.
BAND_STRIP = 512.0


def clean_boxes(boxes: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Boxes without page data and ruled lines."""
    text = F.col("text")
    rule_line = text.isin(RULE_LINES) & (F.col("w") > config.rule_line_width)
    return boxes.filter(~is_page_metadata(text) & ~is_banner(text) & ~rule_line & (F.col("h") >= config.min_height))


def inside_body(config: LayoutConfig) -> Column:
    return F.col("cy").between(F.col("body_top"), F.col("body_bottom")) & F.col("cx").between(
        F.col("body_left") - config.filter_margin, F.col("body_right") + config.filter_margin
    )


def boxes_in_table(boxes: DataFrame, layouts: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Boxes inside the table body, without page data and ruled lines."""
    extra = [c for c in layouts.columns if c not in ("sheet_id", *BOUNDS, "img_w", "img_h", "header_min_y", "header_max_y")]
    sheets = layouts.select("sheet_id", *BOUNDS, *extra)
    return clean_boxes(boxes, config).join(sheets, "sheet_id").filter(inside_body(config)).select(*BODY, *extra)


def row_anchors(boxes: DataFrame, layouts: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Distinct heights at which a roll number or id opens a row."""
    like = boxes.filter(F.col("text").rlike(ROLL_ANCHOR) | F.col("text").rlike(ID_ANCHOR))
    body = boxes_in_table(like, layouts, config)

    def opens(kind: str, pattern: str):
        column = F.col("columns")[kind]
        near = F.col("cx").between(column["low"] - config.anchor_margin, column["high"] + config.anchor_margin)
        return F.coalesce(near, F.lit(False)) & F.col("text").rlike(pattern)

    return body.filter(opens(ROLL_NO, ROLL_ANCHOR) | opens(STUDENT_ID, ID_ANCHOR)).select("sheet_id", "cy").distinct()


def _kept_apart(batches: Iterator[pa.RecordBatch], gap: float) -> Iterator[pa.RecordBatch]:
    """Of heights in order those more than ``gap`` below the last one kept; the state is that one height."""
    current, last = None, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n) for n in ("sheet_id", "run")]
        fresh = np.ones(batch.num_rows, bool)
        fresh[0] = tuple(k[0].as_py() for k in keys) != current
        fresh[1:] = np.logical_or(*(pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys))
        keep = []
        for opens, cy in zip(fresh.tolist(), batch.column("cy").to_numpy().tolist()):
            kept = opens or cy - last > gap
            if kept:
                last = cy
            keep.append(kept)
        current = tuple(k[-1].as_py() for k in keys)
        yield batch.select(["sheet_id", "cy"]).filter(pa.array(keep, pa.bool_()))


def distinct_anchors(anchors: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Anchors more than a row's tolerance below the last anchor kept.

    A gap above the tolerance always keeps the next anchor, so each run between
    such gaps is followed on its own, in order and without gathering it.
    """
    gap = config.same_row
    ordered = runs(anchors, F.lit(gap)).repartition("sheet_id", "run").sortWithinPartitions("sheet_id", "run", "cy")
    return ordered.select("sheet_id", "run", "cy").mapInArrow(
        lambda batches: _kept_apart(batches, gap), f"sheet_id {anchors.schema['sheet_id'].dataType.simpleString()}, cy double"
    )


def row_bands(anchors: DataFrame) -> DataFrame:
    """Bands around the anchors of a sheet; a sheet needs two anchors for bands."""
    cy, above, below = F.col("cy"), F.col("above"), F.col("below")
    return numbered(anchors.select("sheet_id", "cy")).filter(above.isNotNull() | below.isNotNull()).select(
        "sheet_id",
        F.col("nth").alias("row_index"),
        "cy",
        F.when(above.isNull(), cy - (below - cy) / 2.0).otherwise((above + cy) / 2.0).alias("y_start"),
        F.when(below.isNull(), cy + (cy - above) / 2.0).otherwise((cy + below) / 2.0).alias("y_end"),
        above.isNull().alias("is_first"),
        below.isNull().alias("is_last"),
    )


def _reached_strips(config: LayoutConfig) -> Column:
    """The page strips in which a band may take boxes."""
    far = (F.col("y_end") - F.col("y_start")) * config.outside_band
    low = F.when(F.col("is_first"), F.least(F.col("y_start"), F.col("cy") - far)).otherwise(F.col("y_start"))
    high = F.when(F.col("is_last"), F.greatest(F.col("y_end"), F.col("cy") + far)).otherwise(F.col("y_end"))
    return strips(low, high, BAND_STRIP)


def _in_band(cy: Column, band: Callable[[str], Column], config: LayoutConfig) -> Column:
    """Whether a band takes a height: within it (on the edge of two the upper one does), or near enough beyond the outermost."""
    start, end, far = band("y_start"), band("y_end"), (band("y_end") - band("y_start")) * config.outside_band
    within = (cy <= end) & ((cy > start) | (band("is_first") & (cy >= start)))
    beyond = (band("is_first") & (cy < start)) | (band("is_last") & (cy > end))
    return within | (beyond & (F.abs(cy - band("cy")) <= far))


def body_slots(layouts: DataFrame, bands: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """What a box needs to be placed, by ``sheet_id, strip``: body bounds, columns, and the bands there (null on a sheet without bands).

    Anchors stand further apart than a row's tolerance, so a strip has a bounded number of bands however long the page.
    """
    lean = {k: F.when(F.col(f"columns.{k}").isNotNull(), F.struct(*[F.col(f"columns.{k}.{f}").alias(f) for f in ("low", "high", "cx", "place")])) for k in COLUMN_TYPES}
    sheets = layouts.select("sheet_id", *BOUNDS, F.struct(*[v.alias(k) for k, v in lean.items()]).alias("columns"))
    band = F.struct("row_index", "cy", "y_start", "y_end", "is_first", "is_last").alias("band")
    held = bands.select("sheet_id", F.explode(_reached_strips(config)).alias("strip"), band)
    held = held.groupBy("sheet_id", "strip").agg(F.collect_list("band").alias("bands"))
    banded = bands.filter(F.col("is_first")).select("sheet_id")
    rest = sheets.join(banded, "sheet_id", "left_anti").filter(F.col("body_top") <= F.col("body_bottom"))
    rest = rest.withColumn("strip", F.explode(strips(F.col("body_top"), F.col("body_bottom"), BAND_STRIP)))
    return held.join(sheets, "sheet_id").unionByName(rest, allowMissingColumns=True)


def body_table(boxes: DataFrame, slots: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Body boxes with their ``cell`` and, on sheets with bands, their ``row_index``: one read and one exchange of the boxes."""
    clean = clean_boxes(boxes, config).select(*BODY, F.floor(F.col("cy") / BAND_STRIP).alias("strip"))
    placed = clean.join(slots, ["sheet_id", "strip"]).filter(inside_body(config))
    mine = F.filter("bands", lambda b: _in_band(F.col("cy"), lambda f: b[f], config))
    placed = placed.select(*BODY, F.col("bands").isNotNull().alias("banded"), F.get(mine, F.lit(0))["row_index"].alias("row_index"), cell_of_box(F.col("columns"), F.col("cx")).alias("cell"))
    return placed.filter(~F.col("banded") | F.col("row_index").isNotNull())


def boxes_to_bands(body: DataFrame, bands: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """The row of each box: the band around it, or the outermost band if near enough.

    Bands meet boxes in page strips of fixed height.
    """
    fields = ("y_start", "y_end", "is_first", "is_last")
    placed = bands.select("sheet_id", F.explode(_reached_strips(config)).alias("strip"), "row_index", F.col("cy").alias("row_cy"), *fields)
    band = lambda f: F.col("row_cy" if f == "cy" else f)
    return (
        body.withColumn("strip", F.floor(F.col("cy") / BAND_STRIP))
        .join(placed, ["sheet_id", "strip"])
        .filter(_in_band(F.col("cy"), band, config))
        .drop("strip", "row_cy", *fields)
    )


def cluster_batches(batches: Iterator[pd.DataFrame], slack: float) -> Iterator[pd.DataFrame]:
    """Number rows greedily down sorted boxes, keeping only rows still in reach.

    A box joins the nearest row whose running mean height is within reach and where
    it overlaps no box sideways. Heights only grow, so a row out of reach is closed,
    and the state stays the size of a few lines whatever the run's length.
    """
    current, live, made = None, [], 0
    for pdf in batches:
        numbers = []
        for sheet, run, cy, left, right, reach in zip(
            pdf["sheet_id"], pdf["run"], pdf["cy"], pdf["min_x"], pdf["max_x"], pdf["reach"]
        ):
            if (sheet, run) != current:
                current, live, made = (sheet, run), [], 0
            live = [row for row in live if abs(cy - row["sum"] / row["n"]) <= reach]
            best, least = None, None
            for row in live:
                away = abs(cy - row["sum"] / row["n"])
                if (least is None or away < least) and not any(
                    max(a, left) < min(b, right) - slack for a, b in row["spans"]
                ):
                    best, least = row, away
            if best is None:
                made += 1
                best = {"no": made, "sum": 0.0, "n": 0, "spans": []}
                live.append(best)
            best["sum"] += cy
            best["n"] += 1
            best["spans"].append((left, right))
            numbers.append(best["no"])
        yield pdf.assign(cluster=numbers)


def middle_heights(body: DataFrame, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """The exact median ``h`` of each sheet as ``middle``.

    Heights are counted in bins between the bounds of the value sought, and the bin that holds it gives the next
    bounds, until its least and largest height are one. No task gathers the heights of a sheet, only some bins.
    """
    counts = keep(body.groupBy("sheet_id", "h").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("sheet_id").agg(F.sum("n").alias("total"), F.min("h").alias("low"), F.max("h").alias("high"))
    # ``left`` is the place, from 0, of the value sought among those from ``low`` on.
    state = keep(total.withColumn("left", F.floor((F.col("total") - 1) / 2)))
    done = None
    while True:
        settled = state.filter(F.col("low") == F.col("high"))
        done = settled if done is None else done.unionByName(settled)
        state = state.filter(F.col("low") < F.col("high"))
        if state.isEmpty():
            break
        place = F.least(F.floor((F.col("h") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        near = counts.join(state, "sheet_id").filter(F.col("h").between(F.col("low"), F.col("high")))
        bins = near.groupBy("sheet_id", "total", "left", place.alias("bin")).agg(F.sum("n").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        # At most so many bins a sheet.
        bins = bins.groupBy("sheet_id", "total", "left").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))
        start = F.struct(F.col("left").alias("left"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

        def step(found: Column, b: Column) -> Column:
            open_yet = found["low"].isNull()
            here = open_yet & (found["left"] < b["n"])
            return F.struct(
                F.when(open_yet & ~here, found["left"] - b["n"]).otherwise(found["left"]).alias("left"),
                F.when(here, b["low"]).otherwise(found["low"]).alias("low"),
                F.when(here, b["high"]).otherwise(found["high"]).alias("high"),
            )

        state = keep(bins.select("sheet_id", "total", F.aggregate("bins", start, step).alias("found")).select("sheet_id", "total", "found.low", "found.high", "found.left"))
    lower = done.select("sheet_id", "total", "left", F.col("low").alias("lower"))
    # Of an even number the next one counts as well: the same height again, or the next larger.
    around = counts.join(lower, "sheet_id").filter(F.col("h") >= F.col("lower")).groupBy("sheet_id", "total", "left", "lower").agg(
        F.sum(F.when(F.col("h") == F.col("lower"), F.col("n"))).alias("same"), F.min(F.when(F.col("h") > F.col("lower"), F.col("h"))).alias("next")
    )
    upper = F.when((F.col("total") % 2 == 1) | (F.col("left") + 1 < F.col("same")), F.col("lower")).otherwise(F.col("next"))
    return around.select("sheet_id", ((F.col("lower") + upper) / 2.0).alias("middle"))


def boxes_to_clusters(body: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """Rows of sheets without bands, found by following the boxes downwards.

    The rule is sequential, but a vertical gap wider than its reach starts afresh, so
    the work is split at those gaps, spread over the cluster and streamed in order.
    """
    low, high, factor = F.lit(config.cluster_low), F.lit(config.cluster_high), F.lit(config.cluster_factor)
    reaches = middle_heights(body, keep).select("sheet_id", F.least(F.greatest(F.col("middle") * factor, low), high).alias("reach"))
    placed = runs(body.select("sheet_id", "cy").distinct().join(reaches, "sheet_id"), F.col("reach"))
    ready = body.join(placed, ["sheet_id", "cy"]).select(*body.columns, "run", "reach")
    schema = ready.schema.add("cluster", "long")
    slack = config.overlap_slack
    followed = (
        ready.repartition("sheet_id", "run")
        .sortWithinPartitions("sheet_id", "run", "cy", "box_seq")
        .mapInPandas(lambda batches: cluster_batches(batches, slack), schema)
    )
    return followed.drop("reach")


def clusters_in_order(clustered: DataFrame) -> DataFrame:
    """Give the clusters of a sheet their row numbers, by mean height."""
    means = clustered.groupBy("sheet_id", "run", "cluster").agg(F.avg("cy").alias("row_cy"))
    rows = numbered(means, "row_cy", "run", "cluster").select("sheet_id", "run", "cluster", F.col("nth").alias("row_index"))
    return clustered.join(rows, ["sheet_id", "run", "cluster"]).drop("run", "cluster")
