"""A roster table in versions, of which a change rewrites the touched buckets only.

Rows lie in buckets by scope. A version is a small table that names the folder of every bucket; it is written whole and
only then found by readers, so they see the old version or the new one, and every version stays readable.
Changes to a few classes read and write the buckets of these classes, and share all others with the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_VERSION = "version bigint, bucket int, path string, buckets int"


class RosterVersions:
    """The versions of a roster in a folder. ``buckets`` counts for a new roster; an old one keeps its own number."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(_VERSION).parquet(f"{self.folder}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _VERSION)

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        return self._table().agg(F.max("version")).first()[0] or 0

    def _paths(self, version: int) -> dict[int, str]:
        """The folders of a version, no more than there are buckets."""
        rows = self._table().filter(F.col("version") == version).collect()
        if rows:
            self.buckets = rows[0].buckets
        return {r.bucket: r.path for r in rows}

    def bucket_of(self, scope: Column) -> Column:
        return F.pmod(F.xxhash64(scope), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, others: dict[int, str]) -> int:
        path = f"{self.folder}/rows/{version}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket_of(F.col("scope_id")))
        # A large bucket is dealt over several files by its scopes.
        placed.repartition("bucket", "scope_id").write.partitionBy("bucket").parquet(path)
        held = [r.bucket for r in placed.select("bucket").distinct().collect()]
        paths = others | {b: f"{path}/bucket={b}" for b in held}
        table = self.spark.createDataFrame([(version, b, p, self.buckets) for b, p in paths.items()], _VERSION)
        # A second writer of the same version fails here, as its folder is there already.
        table.coalesce(1).write.parquet(f"{self.folder}/versions/v={version}")
        return version

    def create(self, rows: DataFrame) -> int:
        """The first version, or one that replaces all rows."""
        return self._write(rows, self.latest() + 1, {})

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest unless named), of some buckets if given."""
        paths = self._paths(version or self.latest())
        wanted = [p for b, p in sorted(paths.items()) if buckets is None or b in buckets]
        if not paths:
            raise ValueError(f"no version in {self.folder}")
        found = self.spark.read.parquet(*(wanted or paths.values()))
        return found if wanted else found.limit(0)

    def update(self, scopes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """The version in which ``change`` was applied to the buckets that hold any ``scope_id`` of ``scopes``.

        ``change`` gets the rows of these buckets and gives them back changed; it leaves rows of other scopes alone.
        """
        before = self.latest()
        paths = self._paths(before)
        # At most so many numbers as there are buckets.
        touched = {r[0] for r in scopes.select(self.bucket_of(F.col("scope_id"))).distinct().collect()} & set(paths)
        if not touched:
            return before
        changed = change(self.read(before, sorted(touched)))
        return self._write(changed, before + 1, {b: p for b, p in paths.items() if b not in touched})
