"""Text boxes of many sheets to attendance records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollkeeper.config import LayoutConfig
from rollkeeper.operators import cells, regions, rows
from rollkeeper.session import stage

BODY = ["sheet_id", "box_seq", "text", "conf", "cy", "min_x", "cell", "row_index"]
Keep = Callable[[DataFrame], DataFrame]


def placed_boxes(boxes: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Keep = stage) -> DataFrame:
    """Body boxes with their cell and row number.

    The boxes are read four times: for the few that tell where the table lies, for the size of the pages, for the sides of
    the body, and for the body table. Only the last carries texts, through its one exchange.
    """
    telling = keep(regions.telling_boxes(boxes, rows.ROLL_ANCHOR, rows.ID_ANCHOR))
    tops = keep(regions.sheet_tops(boxes, config, telling, keep))
    layouts = keep(regions.page_layouts(regions.with_body_bottom(tops, telling, config), boxes, config, telling))
    anchors = keep(rows.row_anchors(telling, layouts, config))
    bands = keep(rows.row_bands(keep(rows.distinct_anchors(anchors, config))))
    return body_rows(boxes, layouts, bands, config, keep)


def body_rows(boxes: DataFrame, layouts: DataFrame, bands: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Keep = stage) -> DataFrame:
    """The body table with row numbers of bands, and of clusters where a sheet has none.

    Clustering follows a narrow side stream; its numbers join the body back by sheet and ``box_seq``, and boxes that share
    a number by their order.
    """
    body = keep(rows.body_table(boxes, rows.body_slots(layouts, bands, config), config))
    by_band = body.filter("banded").select(*BODY)
    same = Window.partitionBy("sheet_id", "box_seq").orderBy("cy", "min_x", "max_x", "h", "text", "conf")
    loose = keep(body.filter(~F.col("banded")).drop("row_index").withColumn("twin", F.row_number().over(same)))
    stream = loose.select("sheet_id", "box_seq", "twin", "cy", "h", "min_x", "max_x")
    lines = rows.clusters_in_order(keep(rows.boxes_to_clusters(stream, config, keep)))
    by_cluster = loose.join(lines.select("sheet_id", "box_seq", "twin", "row_index"), ["sheet_id", "box_seq", "twin"]).select(*BODY)
    return by_band.unionByName(by_cluster)


def raw_rows(boxes: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Keep = stage) -> DataFrame:
    """One row per register line. Kept: the filters after it must not drag its rules along."""
    return keep(cells.repaired_rows(cells.cell_texts(placed_boxes(boxes, config, keep))))


def extract(
    boxes: DataFrame, config: LayoutConfig = LayoutConfig(), keep: Keep = stage
) -> tuple[DataFrame, DataFrame]:
    """Records per sheet, ordered by ``rec_seq``, and the rows that were turned away.

    ``boxes`` is the intake table (texts stripped, see ``sources.ocr``). It is read
    several times with different columns and filters, so pass a stored table.
    """
    rows_of_text = raw_rows(boxes, config, keep)
    checked = cells.validated(rows_of_text)
    good = cells.records_from_rows(checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
    rejected = checked.filter(F.col("reject_reason").isNotNull()).drop("row_confidence")
    return cells.contracted(good), rejected.withColumnRenamed("row_index", "rec_seq")
