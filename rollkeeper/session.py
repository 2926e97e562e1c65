"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults of the joins below: AQE splits the hot partition of a skewed join, even if that costs one more exchange.
# They only fill in what neither the session nor the cluster has set.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles methods of more bytecode, and the rules over one row make such methods: they run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A side that turns out to be small in every partition is hashed, and the other side is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Rows of boxes pack tightly, so a split of the usual 128 MB is tens of millions of them, and the cores wait for the last ones.
    "spark.sql.files.maxPartitionBytes": "16m",
}
# Bytes of a row group in stages: one is read by one task, so it is no larger than a split.
ROW_GROUP = 16 << 20
LEAST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.minPartitionNum"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="rollkeeper-pkg-"), "rollkeeper")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Fill in runtime settings that are unset and ship the package; all that is set stays with the cluster."""
    ship_package(spark)
    chosen = dict(spark.sparkContext.getConf().getAll())
    for key, value in RUNTIME_SETTINGS.items():
        if key not in chosen and not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)
    # Left alone, partitions are merged to one for each core, and a single slow one holds up the whole stage.
    if LEAST_PARTITIONS not in chosen and not spark.conf._jconf.contains(LEAST_PARTITIONS):
        spark.conf.set(LEAST_PARTITIONS, str(4 * spark.sparkContext.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for stages that all machines share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share; stages are written there")
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and go on from the table.

    The table lies in the shared folder, so it outlives any executor, and being
    columnar it still lets the later steps read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Stages of one job, to be dropped together when its results are written.

    Pass ``keep`` to the plans in place of ``stage``.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(stage(df))
        return self.tables[-1]

    def drop(self) -> None:
        """Delete the files of all stages kept so far."""
        for df in self.tables:
            spark = df.sparkSession
            for file in {os.path.dirname(f) for f in df.inputFiles()}:
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.clear()
