"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches from the largest id down. A batch's line hashes, aggregated to one row each, are
anti-joined with the runs written before: a hash that no run knows is new, and the largest document of the batch
keeps its line; of a known hash only the count grows. Both go into a new run, a table bucketed and sorted by hash.
Runs of one level are merged into one run of the next whenever ``fanout`` of them have gathered.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.llm.common import BLANKS, ascii_lower, stage, stage_path

c = F.col

LEAST_CHARS = 20
LEAST_DOCS = 3
FANOUT = 3
# Batches and buckets follow the size of the texts: at least so many, and more for so many bytes in each.
BATCHES = 4
BATCH_BYTES = 4 << 40
BUCKETS = 16
BUCKET_BYTES = 1 << 30


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_hash(line: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Sixteen bytes of the key, null for keys too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= least_chars, F.unhex(F.md5(key)))


class LineRuns:
    """The runs: rows of hash, documents holding it, and the document that keeps the line (null where an older run has it)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch of ``hash, doc_id`` rows with the runs and write its own run, then compact full levels."""
        mine = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        if names := [n for level in self.levels for n in level]:
            mine = stage(mine, "line-batch")
            fresh, known = mine, None
            for name in names:
                # A hash has one keeper in all runs, so only rows with one say that a hash is known.
                run = self.spark.table(name).filter(c("first")).select("hash")
                fresh = fresh.join(run, "hash", "left_anti")
                found = mine.join(run, "hash", "left_semi")
                known = found if known is None else known.unionByName(found)
            fresh = fresh.withColumn("first", F.lit(True))
            known = known.withColumn("keeper", F.lit(None).cast(mine.schema["keeper"].dataType)).withColumn("first", F.lit(False))
            mine = fresh.unionByName(known)
        else:
            mine = mine.withColumn("first", F.lit(True))
        self._write(mine, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = _merged([self.spark.table(n) for n in self.levels[level]])
        old, self.levels[level] = self.levels[level], []
        self._write(merged, level + 1)
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", stage_path(self.spark, "line-run")).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def totals(self) -> DataFrame | None:
        """One row per hash over all runs."""
        names = [n for level in self.levels for n in level]
        return _merged([self.spark.table(n) for n in names]) if names else None


    def drop(self) -> None:
        """Leave nothing in the catalogue."""
        for name in [n for level in self.levels for n in level]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def _merged(runs: list[DataFrame]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    # Dealt anew: a union of bucketed tables may be read without its buckets although its grouping relies on them.
    return reduce(DataFrame.unionByName, runs).repartition("hash").groupBy("hash").agg(
        F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("first").alias("first")
    )


def layout(size: int) -> tuple[int, int]:
    """Batches, and buckets of a run, for texts of so many bytes."""
    return max(BATCHES, -(-size // BATCH_BYTES)), max(BUCKETS, -(-size // BUCKET_BYTES))


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int | None = None) -> DataFrame:
    """Hashes of the lines that each document loses: ``doc_id, drops``; as many batches as the size asks for unless given."""
    spark = docs.sparkSession
    wanted, buckets = layout(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    batches = batches or wanted
    hashes = F.array_distinct(F.transform(lines_of(c("text")), lambda x: line_hash(x, least_chars)))
    held = docs.select("doc_id", F.explode(F.array_compact(hashes)).alias("hash"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # Batch 0 has the largest ids; null ids are last, as none of them is a largest one.
    number = reduce(lambda e, i: F.when(c("doc_id") > cuts[i], i).otherwise(e), reversed(range(len(cuts))), F.lit(len(cuts)))
    held = stage(held.withColumn("batch", number.cast("int")), "line-hashes", by="batch")
    runs = LineRuns(spark, buckets=buckets)
    for i in range(len(cuts) + 1):
        runs.add(held.filter(c("batch") == i).select("hash", "doc_id"))
    often = stage(runs.totals().filter(c("docs") >= least_docs).select("hash", "keeper"), "line-often")
    runs.drop()
    lost = held.join(often, "hash").filter(~c("doc_id").eqNullSafe(c("keeper"))).select("doc_id", "hash")
    return lost.groupBy("doc_id").agg(F.collect_set("hash").alias("drops"))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int | None = None) -> DataFrame:
    """``row`` (all columns, the text without its repeated lines), ``n_lines`` and ``n_dropped``, how many it had and lost.

    A line whose key has ``least_chars`` code points and is held by ``least_docs`` rows goes from all but the rows with
    the largest id. A null or empty text has one empty line and stays as it is. Rows that repeat an id count each; those
    with the largest id keep the line. A null id is smaller than all others; lines held only by null ids are all lost.
    The struct keeps columns of any name apart from the results. Texts are taken whole, however long. An empty table gives an empty table.
    """
    lost = repeated_lines(docs.select("doc_id", "text"), least_docs, least_chars, batches).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("row"), "doc_id", "text")
    rows = rows.join(lost, c("doc_id").eqNullSafe(c("id")), "left")
    lines = lines_of(c("text"))
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(c("drops"), line_hash(x, least_chars)), F.lit(False)))
    rows = rows.withColumn("stays", F.when(c("drops").isNotNull(), stays))
    dropped = F.coalesce(F.size(lines) - F.size(c("stays")), F.lit(0))
    text = F.when(c("drops").isNotNull(), F.array_join(c("stays"), "\n")).otherwise(c("text"))
    fields = [text.alias(n) if n == "text" else c("row")[n].alias(n) for n in docs.columns]
    return rows.select(F.struct(*fields).alias("row"), F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
