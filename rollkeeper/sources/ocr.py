"""Text boxes from an OCR step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.text import strip

# Least confidence kept and least box side in pixels.
LEAST_CONFIDENCE = 0.15
LEAST_SIDE = 6.0


def drop_unreadable(raw: DataFrame) -> DataFrame:
    """Keep boxes with visible text and enough confidence."""
    return raw.filter((F.col("conf") >= LEAST_CONFIDENCE) & (strip(F.col("text")) != ""))


def bounds(axis: int) -> tuple[Column, Column]:
    """Least and largest coordinate of a polygon; four corners, as OCR gives them, need no walk over the points."""
    every = F.transform("bbox", lambda p: p[axis].cast("double"))
    corners = [F.col("bbox")[i][axis].cast("double") for i in range(4)]
    four = F.size("bbox") == 4
    return (
        F.when(four, F.least(*corners)).otherwise(F.array_min(every)),
        F.when(four, F.greatest(*corners)).otherwise(F.array_max(every)),
    )


def edges_from_polygons(raw: DataFrame) -> DataFrame:
    """Polygon boxes to axis-aligned boxes: all that has to be stored, as centre and size follow from the edges."""
    (min_x, max_x), (min_y, max_y) = bounds(0), bounds(1)
    return drop_unreadable(raw).select(
        "sheet_id",
        "box_seq",
        strip(F.col("text")).alias("text"),
        F.col("conf").cast("double").alias("conf"),
        min_x.alias("min_x"),
        max_x.alias("max_x"),
        min_y.alias("min_y"),
        max_y.alias("max_y"),
        F.col("img_w").cast("double").alias("img_w"),
        F.col("img_h").cast("double").alias("img_h"),
    )


def with_centres(edges: DataFrame) -> DataFrame:
    """Add centre and floored size."""
    return edges.select(
        "*",
        ((F.col("min_x") + F.col("max_x")) / 2.0).alias("cx"),
        ((F.col("min_y") + F.col("max_y")) / 2.0).alias("cy"),
        F.greatest(F.col("max_x") - F.col("min_x"), F.lit(LEAST_SIDE)).alias("w"),
        F.greatest(F.col("max_y") - F.col("min_y"), F.lit(LEAST_SIDE)).alias("h"),
    )


def boxes_from_polygons(raw: DataFrame) -> DataFrame:
    """Polygon boxes to axis-aligned boxes with centre and floored size."""
    return with_centres(edges_from_polygons(raw))
