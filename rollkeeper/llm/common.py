"""What the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.session import shared_folder, ship_package

# The white space that separates words, as a character class and as its characters.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
WORD = f"[^{BLANK}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; the package goes to the workers first."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Fewer rows in an Arrow batch, as a row may be a long text; a smaller setting stays."""
    ship_package(spark)
    if int(spark.conf.get(BATCH_ROWS, "10000")) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write a table that later steps read to the shared folder, and go on from it."""
    path = stage_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def some_of(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows (all of fewer), those whose keys hash low: the same ones whenever asked, without sorting."""
    share = most / max(1, df.count())
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < int(share * (1 << 31)))
