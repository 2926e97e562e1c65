"""Order along a page without one window per sheet.

Rows of a sheet are dealt in slabs of fixed height, so a very long page spreads over tasks. Windows run inside a slab; one
row per slab carries what the next one needs across its edge: how many rows came before, and the heights next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLAB = 4096.0
_PAGE = ["sheet_id", "slab"]


def _placed(rows: DataFrame, height: str) -> DataFrame:
    return rows.withColumn("slab", F.floor(F.col(height) / SLAB)).filter(F.col("sheet_id").isNotNull() & F.col("slab").isNotNull())


def _long_pages(placed: DataFrame) -> DataFrame:
    """The rows of pages that reach beyond their first slab; only those have edges to look across.

    No rows where all pages are of common height, and then what is built on them falls away while the query runs.
    """
    return placed.join(placed.filter(F.col("slab") != 0).select("sheet_id").distinct(), "sheet_id", "left_semi")


def _edges(rows: DataFrame, *sums: str) -> DataFrame:
    """One row per slab: the sums of all slabs above it, and the nearest heights of its neighbours."""
    # Rows with the first number of a slab have its totals already; they come through the exchange of the windows.
    down = Window.partitionBy("sheet_id").orderBy("slab")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    return rows.filter(F.col("nth") == 1).select(
        *_PAGE,
        *[F.coalesce(F.sum(f"all_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in sums],
        F.lag("last").over(down).alias("edge_above"),
        F.lead("first").over(down).alias("edge_below"),
    )


def numbered(rows: DataFrame, height: str = "cy", *order: str) -> DataFrame:
    """Add ``nth`` (from 1), and ``above`` and ``below``, the heights of the neighbours, by height and then ``order``."""
    placed = _placed(rows, height)
    whole, down = Window.partitionBy(*_PAGE), Window.partitionBy(*_PAGE).orderBy(height, *order)
    own = [F.row_number().over(down).alias("nth"), F.lag(height).over(down).alias("above"), F.lead(height).over(down).alias("below")]
    totals = [F.count(F.lit(1)).over(whole).alias("all_nth"), F.min(height).over(whole).alias("first"), F.max(height).over(whole).alias("last")]
    edges = _edges(_long_pages(placed).select(*_PAGE, own[0], *totals), "nth")
    joined = placed.select("*", *own).join(edges, _PAGE, "left")
    return joined.select(
        *rows.columns,
        (F.coalesce("before_nth", F.lit(0)) + F.col("nth")).cast("int").alias("nth"),
        F.coalesce("above", "edge_above").alias("above"),
        F.coalesce("below", "edge_below").alias("below"),
    )


def runs(rows: DataFrame, gap: Column, name: str = "run", height: str = "cy") -> DataFrame:
    """Number the runs of heights in which each lies within ``gap`` of the one above; heights of a sheet are distinct.

    A slab counts the runs that open below its first row; whether that row opens one shows at the edge.
    """
    placed = _placed(rows, height).withColumn("gap", gap)
    whole, down = Window.partitionBy(*_PAGE), Window.partitionBy(*_PAGE).orderBy(height)
    apart = lambda above: F.coalesce(F.col(height) - above > F.col("gap"), F.lit(True)).cast("int")

    def counted(some: DataFrame) -> DataFrame:
        """The runs that open in a slab, up to each row and in all."""
        some = some.select("*", F.row_number().over(down).alias("nth"), F.lag(height).over(down).alias("above"))
        return some.withColumn("opens", F.when(F.col("nth") == 1, 0).otherwise(apart(F.col("above")))).select(
            "*",
            F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
            F.sum("opens").over(whole).alias("all_opens"),
            F.max(height).over(whole).alias("last"),
        )

    pages = Window.partitionBy("sheet_id").orderBy("slab")
    edges = counted(_long_pages(placed)).filter(F.col("nth") == 1).withColumn("first_opens", apart(F.lag("last").over(pages)))
    upto = F.sum(F.col("first_opens") + F.col("all_opens")).over(pages.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select(*_PAGE, (upto - F.col("all_opens")).alias("before"))
    joined = counted(placed).join(edges, _PAGE, "left")
    # The first row of a page of one slab opens its first run.
    return joined.select(*rows.columns, (F.coalesce("before", F.lit(1)) + F.col("upto")).alias(name))
