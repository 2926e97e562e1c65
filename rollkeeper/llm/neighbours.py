"""Approximate nearest neighbours with an inverted multi-index, by largest inner product.

Both halves of the vectors are quantised on their own, so a pair of centroids is a cell, and few centroids make many
cells. A query orders the centroids of each half by their inner products with its halves and walks through the pairs
from the largest sum down, with a heap, until the cells it has passed hold a given part of the index. The sum at which
it stops says which cells it has visited. Entries lie in lists by cell: neighbouring small cells share one, a large cell has several.
A query goes to the lists of the cells that it has visited and to no others, and the entries of visited cells are
ranked by their true inner products.

An entry is a distinct vector, however many ids have it, so copies use up nothing of a walk. Equal scores go to the
smaller id, so of one vector's ids only the ``top`` smallest besides the query's own can ever be found; those are kept
with it, and take its place in the ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, some_of, stage

c = F.col

CENTROIDS = 128
# The codebooks are fitted on about so many vectors, those with low hashes of their ids.
SAMPLE = 16_384
ROUNDS = 8
# A query stops once the cells it has visited hold this part of the index, and so many vectors at least.
VISITED = 0.4
LEAST_VISITED = 1000
TOP = 20
# Entries in a list, queries that meet it in one group, and of these at once.
SHARD = 4096
BLOCK = 8192
AT_ONCE = 512
_CLOSE = 1e-9
# The ids of one vector are first ranked in so many parts, as one vector may have most of them.
PARTS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of the vectors that take part, a row for each id (the least vector of repeated ids)."""
    v = c("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    some = F.exists(v, lambda x: x != 0)
    good = vectors.filter(c("vec_id").isNotNull() & v.isNotNull()).filter(finite & some & square.isNotNull())
    return good.groupBy("vec_id").agg(F.min(v).alias("vector"))


def distinct(rows: DataFrame, ids: int) -> DataFrame:
    """``vec_id, vector, ids`` of each different vector: its smallest id, and the ``ids`` smallest in order."""
    part = W.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(part)).filter(c("nth") <= ids)
    least = first.withColumn("nth", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).filter(c("nth") <= ids)
    # At most ``ids`` rows are left of a vector.
    return least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("vec_id"), "vector", "ids")


def codebook(points: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of points by rounds of assigning and averaging, from points spread evenly over their order."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: float) -> float:
    """The sum at which a walk over the pairs, largest sum of both values first, has passed ``wanted`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, counts = first[a].tolist(), second[b].tolist(), held[np.ix_(a, b)].tolist()
    # Each row of the grid has one entry, its next pair; a row starts when the first pair of the row above is passed.
    heap, passed, total = [(-(x[0] + y[0]), 0, 0)], 0, 0.0
    while heap:
        total, i, j = heapq.heappop(heap)
        passed += counts[i][j]
        if passed >= wanted:
            break
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return -total


def lists_of(held: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The first list of each cell, how many lists it has, and the number of all: cells in order share lists of about ``size`` entries."""
    size = size or SHARD
    first, parts = np.zeros(held.shape, dtype=np.int64), np.ones(held.shape, dtype=np.int64)
    number, filled = 0, 0
    for cell in np.ndindex(*held.shape):
        n = int(held[cell])
        if filled and filled + n > size:
            number, filled = number + 1, 0
        first[cell], filled = number, filled + n
        if n > size:
            parts[cell] = -(-n // size)
            number, filled = number + int(parts[cell]), 0
    return first, parts, number + 1


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, what, score`` of the ``most`` largest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < most
    return query[keep], what[order][keep], score[order][keep]


class MultiIndex:
    """Codebooks of both halves, the vectors by id, the distinct ones with their cells, and the number of those in each cell.

    A search finds up to ``top`` ids.
    """

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, top: int = TOP):
        small_batches(vectors.sparkSession, 2000)
        rows = stage(usable(vectors), "vectors")
        # Vectors of another length than most take no part.
        sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(c("count").desc(), "size").first()
        self.size, self.top = sizes.size if sizes else 0, top
        self.vectors = self.rows = self.held = None
        if not self.size:
            return
        self.vectors = rows.filter(F.size("vector") == self.size)
        rows = stage(distinct(self.vectors, top + 1), "distinct")
        some = some_of(rows, sample, "vec_id").orderBy("vec_id").select("vector").toPandas()["vector"]
        points = np.array(some.tolist(), dtype=np.float64)
        self.half = self.size // 2
        self.books = codebook(points[:, : self.half], centroids), codebook(points[:, self.half :], centroids)
        size, half, books = self.size, self.half, self.books

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("vector"), size)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(_nearest(v[:, :half], books[0]), pa.int32()), pa.array(_nearest(v[:, half:], books[1]), pa.int32())],
                    names=["vec_id", "vector", "ids", "i", "j"],
                )

        kind = vectors.schema["vec_id"].dataType.simpleString()
        self.kind = kind
        self.rows = stage(rows.mapInArrow(cells, f"vec_id {kind}, vector array<double>, ids array<{kind}>, i int, j int"), "index")
        # At most the square of the number of centroids.
        self.held = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
        for row in self.rows.groupBy("i", "j").count().collect():
            self.held[row.i, row.j] = row["count"]

    def search(self, queries: DataFrame, top: int = TOP, visited: float = VISITED) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the ``top`` best ids of the visited entries, ties to the smaller id, not the query's own."""
        if top > self.top:
            raise ValueError(f"the index holds ids for the best {self.top}")
        size, half, books, held, kind = self.size, self.half, self.books, self.held, self.kind
        total = int(held.sum())
        wanted = max(visited * total, min(LEAST_VISITED, total))
        first, parts, lists = lists_of(held)

        def stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled = held > 0
            for batch in batches:
                v = _matrix(batch.column("query"), size)
                one, two = v[:, :half] @ books[0].T, v[:, half:] @ books[1].T
                stop = [walk(x, y, held, wanted) for x, y in zip(one, two)]
                fetched = []
                for x, y, z in zip(one, two, stop):
                    cells = ((x[:, None] + y[None, :]) >= z - _CLOSE) & filled
                    seen = np.zeros(lists + 1, dtype=np.int64)
                    np.add.at(seen, first[cells], 1)
                    np.add.at(seen, first[cells] + parts[cells], -1)
                    fetched.append(np.flatnonzero(np.cumsum(seen)[:lists]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stop, pa.float64()), pa.array(fetched, pa.list_(pa.int64()))], names=["query_id", "query", "stop", "lists"])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j, salt = (batch.column(n).to_numpy() for n in ("i", "j", "salt"))
                yield batch.drop_columns(["salt"]).append_column("list", pa.array(first[i, j] + salt % parts[i, j], pa.int64()))

        asked = queries.select(c("vec_id").alias("query_id"), c("vector").alias("query"))
        asked = stage(asked.mapInArrow(stops, f"query_id {kind}, query array<double>, stop double, lists array<bigint>"), "queries")
        blocks = max(1, -(-asked.count() // BLOCK))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        asked = asked.select("query_id", "query", "stop", "block", F.explode("lists").alias("list"))
        salted = self.rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)))
        entries = salted.mapInArrow(placed, f"vec_id {kind}, vector array<double>, ids array<{kind}>, i int, j int, list bigint")
        # An entry is sent once for so many queries.
        entries = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(some: pa.Table, shard: pa.Table) -> pa.Table:
            """The best ids of a list for each query that fetches it."""
            found = [meet_some(some.slice(a, AT_ONCE), shard) for a in range(0, max(1, len(some)), AT_ONCE)]
            return pa.concat_tables(found)

        def meet_some(some: pa.Table, shard: pa.Table) -> pa.Table:
            """One vector more than wanted is ranked, as the query's own may have no other id.
            """
            most = top + 1
            names = ["query_id", "vec_id", "score"]
            q, v = _matrix(some.column("query"), size), _matrix(shard.column("vector"), size)
            out = [some.column("query_id").slice(0, 0), shard.column("vec_id").slice(0, 0), pa.array([], pa.float64())]
            if len(q) and len(v):
                least, own = shard.column("vec_id").to_numpy(), some.column("query_id").to_numpy()
                i, j = shard.column("i").to_numpy(), shard.column("j").to_numpy()
                sums = (q[:, :half] @ books[0].T)[:, i] + (q[:, half:] @ books[1].T)[:, j]
                seen = sums >= some.column("stop").to_numpy()[:, None] - _CLOSE
                rough = np.where(seen, q @ v.T, -np.inf)
                edge = np.partition(rough, -most, axis=1)[:, -most] if len(v) > most else np.full(len(q), -np.inf)
                a, b = np.nonzero(seen & (rough >= edge[:, None] - _CLOSE * np.maximum(1, np.abs(edge, where=np.isfinite(edge), out=np.ones(len(q))))[:, None]))
                score = np.einsum("ij,ij->i", q[a], v[b])
                a, b, score = _best(a, least[b], score, most, b)
                # Each vector's ids in its place.
                held = shard.column("ids").combine_chunks()
                ids, many = held.flatten().to_numpy(), held.value_lengths().to_numpy()
                begin, n = (np.cumsum(many) - many)[b], many[b]
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                a, score, found = np.repeat(a, n), np.repeat(score, n), ids[at]
                other = found != own[a]
                a, found, score = _best(a[other], found[other], score[other], top, found[other])
                out = [some.column("query_id").take(pa.array(a)), pa.array(found, shard.schema.field("vec_id").type), pa.array(score)]
            return pa.Table.from_arrays(out, names=names)

        met = asked.groupBy("block", "list").cogroup(entries.groupBy("block", "list"))
        best = met.applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))
        return best.withColumn("rank", rank).filter(c("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """Search with the vectors whose id is divisible by ``every`` against all others.

    Vectors that are null, zero or of another length than most, or hold null or non-finite components, and rows without
    an id, take no part. Rows that repeat an id are one vector; ids of equal vectors are found each. Extra columns are left out; without vectors there are no rows.
    """
    index = MultiIndex(vectors.select("vec_id", "embedding"), top=top)
    if index.rows is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    return index.search(index.vectors.filter(c("vec_id") % every == 0), top)
