"""Where the table lies on a page: header band, body bounds, columns.

Every step reduces boxes to one row per sheet with partial aggregation, then joins
that row back to the boxes. The boxes are the left side of those inner joins, so a
sheet that holds a large share of all boxes is split by AQE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import ATTENDANCE, COLUMN_TYPES, NAME, ROLL_NO, STUDENT_ID, LayoutConfig
from rollkeeper.functions.headers import header_type, is_banner, is_footer, is_header, is_page_metadata
from rollkeeper.session import stage

# Strips in which header positions meet: a position reaches 30 pixels or more both ways, so in lower strips each has several.
STRIP = 256.0
Keep = Callable[[DataFrame], DataFrame]
# Fixed value: texts that open a student row when no header was read.
LEFT_ANCHOR = r"(?iU)^(00\d|\d{1,3}|STU\d+)$"
STU_ID = r"(?iU)^STU\d+$"


def strips(low: Column, high: Column, height: float = STRIP) -> Column:
    """Numbers of the horizontal page strips an interval touches."""
    return F.sequence(F.floor(low / height), F.floor(high / height))


def header_candidates(boxes: DataFrame) -> DataFrame:
    """Boxes that read like a column header; their type is not worked out again where ``telling_boxes`` did."""
    text = F.col("text")
    typed = boxes if "col_type" in boxes.columns else boxes.withColumn("col_type", header_type(text))
    return typed.filter(F.col("col_type").isNotNull() & ~is_page_metadata(text) & ~is_banner(text))


def header_positions(boxes: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Distinct header positions: boxes at one height, of one size and type act alike."""
    left = F.struct("min_x", "box_seq", "cx", "max_x", "text")
    return (
        header_candidates(boxes)
        .groupBy("sheet_id", "cy", "h", "col_type")
        .agg(
            F.count("*").alias("n"),
            F.min("box_seq").alias("first_seq"),
            F.min(left).alias("leftmost"),
            F.min("min_y").alias("top"),
            F.max("max_y").alias("bottom"),
        )
        .withColumn("reach", F.greatest(F.col("h"), F.lit(config.header_reach)))
    )


def header_bands(boxes: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """How many types and boxes stand in the band around every header position, one row per position."""
    return _counted(header_positions(boxes, config))


def _counted(positions: DataFrame) -> DataFrame:
    """What meets in the page strips are numbers alone, and grows with the distinct positions on a page, not with the boxes."""
    placed = positions.withColumn("strip_set", strips(F.col("cy") - F.col("reach"), F.col("cy") + F.col("reach")))
    placed = placed.withColumn("low", F.element_at("strip_set", 1)).withColumn("strip", F.explode("strip_set"))
    one = placed.select("sheet_id", "strip", "cy", "h", "col_type", "first_seq", "reach", "low")
    kind = F.coalesce(*[F.when(F.col("col_type") == name, F.lit(1 << n)) for n, name in enumerate(COLUMN_TYPES)])
    other = placed.select(
        "sheet_id", "strip", F.col("cy").alias("cy_j"), "n", kind.alias("kind"), F.col("reach").alias("reach_j"), F.col("low").alias("low_j")
    )
    # A pair may share several strips; it counts in the first of them only.
    pairs = one.join(other, ["sheet_id", "strip"]).filter(
        (F.col("strip") == F.greatest("low", "low_j")) & (F.abs(F.col("cy") - F.col("cy_j")) <= F.greatest("reach", "reach_j"))
    )
    return pairs.groupBy("sheet_id", "cy", "h", "col_type", "first_seq", "reach").agg(
        F.bit_count(F.bit_or("kind")).alias("types"), F.sum("n").alias("boxes")
    )


def header_band(boxes: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Keep = stage) -> DataFrame:
    """The band with most types, then most boxes, then highest; at least two types.

    Only the band that wins is looked at for its headers and bounds.
    """
    positions = keep(header_positions(boxes, config))
    order = F.struct("types", "boxes", -F.col("cy"), -F.col("first_seq"))
    band = F.struct("cy", "first_seq", "reach", "types", "boxes")
    best = _counted(positions).filter(F.col("types") >= 2).groupBy("sheet_id").agg(F.max_by(band, order).alias("band"))
    best = best.select("sheet_id", F.col("band.cy").alias("band_cy"), "band.first_seq", F.col("band.reach").alias("band_reach"), "band.types", "band.boxes")
    held = positions.drop("first_seq", "h", "n").join(best, "sheet_id")
    held = held.filter(F.abs(F.col("band_cy") - F.col("cy")) <= F.greatest("band_reach", "reach"))
    # On equal left edges the band's own box comes first, then the higher one.
    own = F.when(F.col("leftmost.box_seq") == F.col("first_seq"), 0).otherwise(1)
    head = F.struct(
        F.col("leftmost.min_x").alias("min_x"),
        own.alias("own"),
        F.col("cy").alias("cy"),
        F.col("leftmost.box_seq").alias("box_seq"),
        F.col("leftmost.cx").alias("cx"),
        F.col("leftmost.max_x").alias("max_x"),
        F.col("leftmost.text").alias("text"),
        F.col("col_type").alias("col_type"),
    )
    heads = {t: F.min(F.when(F.col("col_type") == t, head)) for t in COLUMN_TYPES}
    return (
        held.groupBy("sheet_id", "band_cy", "types", "boxes")
        .agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_compact(F.array(*heads.values())).alias("heads"))
        .withColumnRenamed("band_cy", "cy")
    )


def telling_boxes(boxes: DataFrame, *patterns: str) -> DataFrame:
    """Boxes that may say where the table lies, narrow: headers, footers, ids, and texts like one of the patterns."""
    text = F.col("text")
    # Patterns of whole texts come first, as they fail soonest, and as one, so that a text is decoded once for all of them.
    telling = text.rlike("|".join(f"(?:{pattern})" for pattern in (STU_ID, *patterns))) | is_footer(text) | is_header(text)
    fields = ("sheet_id", "box_seq", "text", "conf", "cx", "cy", "w", "h", "min_x", "max_x", "min_y", "max_y", "img_w")
    return boxes.filter(telling).select(*fields, header_type(text).alias("col_type"), is_footer(text).alias("footer"))


def sheet_tops(
    boxes: DataFrame, config: LayoutConfig = LayoutConfig(), telling: DataFrame | None = None, keep: Keep = stage
) -> DataFrame:
    """Per sheet: picture size, header band, and where the body begins; headers come from the ``telling`` boxes if given."""
    anchor = (
        (F.col("min_x") < F.col("img_w") * config.left_zone)
        & F.col("text").rlike(LEFT_ANCHOR)
        & ~is_page_metadata(F.col("text"))
    )
    sheets = boxes.groupBy("sheet_id").agg(F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    telling = boxes if telling is None else telling
    opened = telling.filter(anchor).groupBy("sheet_id").agg(F.min("min_y").alias("anchor_y"))
    sheets = sheets.join(opened, "sheet_id", "left")
    bands = header_band(telling, config, keep).select(
        "sheet_id", F.col("top").alias("header_min_y"), F.col("bottom").alias("header_max_y"), "heads"
    )
    top = F.coalesce(
        F.col("header_max_y") + config.header_gap, F.col("anchor_y") - config.anchor_gap, F.lit(0.0)
    )
    return sheets.join(bands, "sheet_id", "left").select(
        "sheet_id", "img_w", "img_h", "header_min_y", "header_max_y", "heads", top.alias("body_top")
    )


def with_body_bottom(tops: DataFrame, boxes: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Add where the body ends: each footer lower than the end so far moves it up.

    The rule reads footers in input order. Of footers at one height only the first
    can act, so heights are made distinct before they are gathered and folded.
    """
    footers = (
        boxes.filter(F.col("footer") if "footer" in boxes.columns else is_footer(F.col("text")))
        .select("sheet_id", "box_seq", "cy", "min_y")
        .join(tops.select("sheet_id", "body_top"), "sheet_id")
        .filter(F.col("cy") > F.col("body_top"))
        .groupBy("sheet_id", "min_y")
        .agg(F.min("box_seq").alias("seq"))
        .groupBy("sheet_id")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "min_y"))).alias("footers"))
    )
    end = F.aggregate(
        F.coalesce("footers", F.array().cast("array<struct<seq:bigint,min_y:double>>")),
        F.col("img_h"),
        lambda end, f: F.when(f["min_y"] < end, f["min_y"] - config.footer_gap).otherwise(end),
    )
    return tops.join(footers, "sheet_id", "left").withColumn("body_bottom", end).drop("footers")


def sorted_heads(heads: Column) -> Column:
    """Header boxes, one per type, from left to right by centre."""
    order = ("cx", "min_x", "own", "cy", "box_seq", "max_x", "text", "col_type")
    return F.sort_array(F.transform(heads, lambda b: F.struct(*[b[f].alias(f) for f in order])))


def with_header_columns(sheets: DataFrame) -> DataFrame:
    """A struct per column type from the header boxes; edges lie midway between neighbours."""
    sheets = sheets.withColumn("_heads", sorted_heads(F.col("heads")))
    heads = F.col("_heads")
    for kind in COLUMN_TYPES:
        at = F.array_position(F.transform(heads, lambda b: b["col_type"]), F.lit(kind)).cast("int")
        sheets = sheets.withColumn("_at", F.nullif(at, F.lit(0))).withColumn("_own", F.get(heads, F.col("_at") - 1))
        before, after, own = F.get(heads, F.col("_at") - 2), F.get(heads, F.col("_at")), F.col("_own")
        low = F.coalesce((before["max_x"] + own["min_x"]) / 2.0, F.lit(0.0))
        high = F.coalesce((own["max_x"] + after["min_x"]) / 2.0, F.col("img_w"))
        column = table_column(low, high, own["cx"], F.col("_at"), own["text"])
        sheets = sheets.withColumn(kind, F.when(own.isNotNull(), column))
    return sheets.drop("_heads", "_at", "_own")


def table_column(low: Column, high: Column, cx: Column, place: Column, text: Column) -> Column:
    return F.struct(
        low.cast("double").alias("low"),
        high.cast("double").alias("high"),
        cx.cast("double").alias("cx"),
        place.cast("int").alias("place"),
        text.alias("header_text"),
    )


def with_inferred_id_column(sheets: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Insert an id column where ids stand between a roll and a name column."""
    ids, roll, name = F.col("ids"), F.col(ROLL_NO), F.col(NAME)
    needed = F.col(STUDENT_ID).isNull() & roll.isNotNull() & name.isNotNull() & (ids["n"] > 0)
    low, high = ids["min_x"] - config.id_column_margin, ids["max_x"] + config.id_column_margin
    found = sheets.withColumn("_needed", needed)
    trimmed = {
        STUDENT_ID: table_column(low, high, ids["cx"], F.lit(None), F.lit("Student ID")),
        ROLL_NO: table_column(roll["low"], low, roll["cx"], roll["place"], roll["header_text"]),
        NAME: table_column(high, name["high"], name["cx"], name["place"], name["header_text"]),
    }
    edited = found.withColumns(
        {kind: F.when(F.col("_needed"), column).otherwise(F.col(kind)) for kind, column in trimmed.items()}
    )
    # Places follow the left edges once a column was inserted; the new one comes last on a tie.
    edges = {
        kind: F.when(
            F.col(kind).isNotNull(),
            F.struct(F.col(f"{kind}.low").alias("low"), F.coalesce(F.col(f"{kind}.place"), F.lit(9)).alias("place")),
        )
        for kind in COLUMN_TYPES
    }
    edited = edited.withColumn("_edges", F.sort_array(F.array_compact(F.array(*edges.values()))))
    return edited.withColumns(
        {
            kind: F.when(
                F.col("_needed") & F.col(kind).isNotNull(),
                table_column(
                    F.col(f"{kind}.low"),
                    F.col(f"{kind}.high"),
                    F.col(f"{kind}.cx"),
                    F.array_position(F.col("_edges"), edges[kind]),
                    F.col(f"{kind}.header_text"),
                ),
            ).otherwise(F.col(kind))
            for kind in COLUMN_TYPES
        }
    ).drop("_needed", "_edges")


def with_fallback_columns(sheets: DataFrame) -> DataFrame:
    """Columns by share of the page width, for a page without headers."""
    # Type, left share, right share, centre share, label.
    shares = [
        (ROLL_NO, 0.0, 0.20, 0.10, "Roll No"),
        (STUDENT_ID, 0.20, 0.40, 0.30, "Student ID"),
        (NAME, 0.40, 0.75, 0.575, "Student Name"),
        (ATTENDANCE, 0.75, 1.0, 0.875, "Attendance"),
    ]
    width = F.col("img_w")
    none = F.col("heads").isNull()
    return sheets.withColumns(
        {
            kind: F.when(none, table_column(width * low, width * high, width * mid, F.lit(place), F.lit(label)))
            .otherwise(F.col(kind))
            for place, (kind, low, high, mid, label) in enumerate(shares, start=1)
        }
    )


def page_layouts(
    ends: DataFrame, boxes: DataFrame, config: LayoutConfig = LayoutConfig(), telling: DataFrame | None = None
) -> DataFrame:
    """One row per sheet: body bounds, and a nullable struct per column type; ids come from the ``telling`` boxes if given."""
    sheet = ["sheet_id", "img_w", "img_h", "header_min_y", "header_max_y", "heads", "body_top", "body_bottom"]
    cy, top, bottom = F.col("cy"), F.col("body_top"), F.col("body_bottom")
    # Boxes meet the two bounds only, and without their texts; the rest of a sheet's row joins their sums. The bounds are
    # three numbers a sheet, so each task hashes its share of them and no box is sorted.
    bounds = ends.select("sheet_id", "body_top", "body_bottom")
    near = cy.between(top - config.header_reach, bottom)
    sides = (
        boxes.select("sheet_id", "cy", "min_x", "max_x")
        .join(bounds.hint("shuffle_hash"), "sheet_id")
        .select("sheet_id", F.when(near, F.col("min_x")).alias("min_x"), F.when(near, F.col("max_x")).alias("max_x"))
        .groupBy("sheet_id")
        .agg(F.min("min_x").alias("near_min"), F.max("max_x").alias("near_max"))
    )
    ids = (
        (boxes if telling is None else telling)
        .filter(F.col("text").rlike(STU_ID))
        .select("sheet_id", "cy", "cx", "min_x", "max_x")
        .join(bounds, "sheet_id")
        .filter(cy.between(top, bottom))
        .groupBy("sheet_id")
        .agg(F.count("*").alias("n"), F.avg("cx").alias("cx"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
        .select("sheet_id", F.struct("n", "cx", "min_x", "max_x").alias("ids"))
    )
    stats = sides.join(ids, "sheet_id", "left").join(ends.select(*sheet), "sheet_id")
    sheets = with_fallback_columns(with_inferred_id_column(with_header_columns(stats), config))
    img_w = F.col("img_w")
    return sheets.select(
        "sheet_id",
        "img_w",
        "img_h",
        "header_min_y",
        "header_max_y",
        "body_top",
        "body_bottom",
        F.coalesce(F.greatest(F.col("near_min") - config.side_margin, F.lit(0.0)), F.lit(0.0)).alias("body_left"),
        F.coalesce(F.least(F.col("near_max") + config.side_margin, img_w), img_w).alias("body_right"),
        F.struct(*COLUMN_TYPES).alias("columns"),
    )
