"""Ranked lexical search: exact largest inner products by best-first search of sparse ball trees.

A document is a sparse vector of the impacts of its terms, an item one of the weights of its terms, and a score is
their inner product. Documents near to each other are dealt to the same cells, the cells cut into shards, and each
shard is built into a tree of balls: a node has the centroid of its documents and the largest distance to it, so no
document below scores more than the item's product with the centroid plus the item's norm times that distance. The bound
is rounded up by more than its floating-point error can be. A search takes the node with the highest bound first
and leaves those whose bound is below the worst score still wanted; at the leaves scores are summed in 64-bit integers.
A task takes what it found in one shard to the next, so later shards have higher limits from the start.

Items are answered in blocks of bounded size, whose vocabulary goes along with the tasks. For each block every
document is read in whole; terms that no item of the block has add nothing to a product and are only counted.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, some_of, stage, stage_path

c = F.col

TOP = 10
# Items and bytes of their texts in about one block.
BLOCK_ITEMS = 512
BLOCK_BYTES = 1 << 20
# Documents near to each other go to the same of so many cells, fitted on about so many documents with low hashes.
CELLS = 32
SAMPLE = 2048
# Documents and terms in a tree, documents in a leaf, shards that a task searches.
SHARD = 4096
SHARD_TERMS = 2_000_000
LEAF = 64
SHARDS_A_TASK = 4
BYTES_AT_ONCE = 4_000_000
_UNIT = 2.0**-53
_LARGEST = (1 << 63) - 1

# The bytes that separate terms; all others, with A to Z in lower case, make terms.
_FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; null has none."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_FOLDED).split()


def weight(n: int, held: int) -> int:
    """A term's weight among ``n`` documents of which ``held`` have it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))


def length_factor(words: int, n: int, total: int) -> int:
    return 100 - 75 + 75 * words * n // total


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, words, terms, times`` of each document with a term: how many it has, and which of the numbered ones how often."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, sizes, terms, times = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                if not (found := terms_of(text.as_py())):
                    continue
                kept = {number[t]: k for t, k in Counter(found).items() if t in number}
                at.append(i)
                words.append(len(found))
                sizes.append(len(kept))
                terms.extend(kept.keys())
                times.extend(kept.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, times))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(words, pa.int64()), *lists], names=["doc_id", "words", "terms", "times"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words bigint, terms array<int>, times array<int>")


class Rows:
    """Sparse vectors, one after the other: columns and values of row i lie from ``begins[i]`` to ``begins[i + 1]``."""

    def __init__(self, begins: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.begins, self.columns, self.values, self.width = begins.astype(np.int64), columns.astype(np.int64), values.astype(np.int64), width

    def __len__(self) -> int:
        return len(self.begins) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = self.begins[rows + 1] - self.begins[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.repeat(self.begins[rows] - upto[:-1], sizes) + np.arange(upto[-1])
        return Rows(upto, self.columns[at], self.values[at], self.width)

    def centroid(self) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values, minlength=self.width) / max(1, len(self))

    def products(self, other: np.ndarray) -> np.ndarray:
        """The inner product of each row with a dense vector."""
        return self._sums(self.values * other[self.columns])

    def _sums(self, parts: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.append(parts, np.zeros(1, dtype=parts.dtype)), self.begins[:-1])
        out[self.begins[:-1] == self.begins[1:]] = 0
        return out

    def squares(self) -> np.ndarray:
        return self._sums(self.values.astype(np.float64) ** 2)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.columns[self.begins[row] : self.begins[row + 1]]] = self.values[self.begins[row] : self.begins[row + 1]]
        return out

    def halves(self, centre: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """An order of the rows, from those near to one far row to those near to another far row."""
        one = self.dense(int(np.argmax(squares - 2 * self.products(centre))))
        near_one = self.products(one)
        other = self.dense(int(np.argmax(squares - 2 * near_one)))
        return np.argsort((self.products(other) - other @ other / 2) - (near_one - one @ one / 2), kind="stable")


class BallTree:
    """Balls over sparse vectors; ``order`` has the rows so that each ball holds a range of them."""

    def __init__(self, rows: Rows, leaf: int = LEAF):
        self.begin, self.end, self.below, centres, radii = [], [], [], [], []
        parts, orders, done = [(rows, np.arange(len(rows)), 0, -1)], {}, 0
        # Nodes in the order of a walk that goes down before it goes on, so that leaves come in the order of their rows.
        while parts:
            part, which, start, above = parts.pop()
            squares, centre = part.squares(), part.centroid()
            node = len(self.begin)
            self.begin.append(start)
            self.end.append(start + len(part))
            self.below.append([])
            centres.append(centre)
            radii.append(_radius(part, squares, centre))
            if above >= 0:
                self.below[above].append(node)
            if len(part) <= leaf:
                orders[start] = which
                continue
            order = part.halves(centre, squares)
            half = len(order) // 2
            for piece, first in ((order[half:], start + half), (order[:half], start)):
                parts.append((part.take(piece), which[piece], first, node))
        self.order = np.concatenate([orders[s] for s in sorted(orders)])
        self.rows = rows.take(self.order)
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each node and query, a number that no product below the node exceeds.

        All terms of the sums are positive, so a computed product is off by less than its number of terms times 2^-53
        of itself; a billionth more than it covers some million terms.
        """
        norms = np.sqrt((queries * queries).sum(axis=1))
        return (self.centres @ queries.T + self.radii[:, None] * norms[None, :]) * (1 + 1e-9) + 1

    def search(self, weights: np.ndarray, bounds: np.ndarray, keys: np.ndarray, top: list[tuple[int, int]], most: int) -> None:
        """Take the best rows of one query into ``top``, a heap of ``(score, key)`` with the worst first.

        Of equal scores the larger key is better, so a ball whose bound equals the worst score is still opened.
        """
        limit = top[0][0] if len(top) == most else 1
        agenda = [(-bounds[0], 0)]
        while agenda:
            bound, node = heapq.heappop(agenda)
            if -bound < limit:
                break
            for child in self.below[node]:
                if bounds[child] >= limit:
                    heapq.heappush(agenda, (-bounds[child], child))
            if self.below[node]:
                continue
            a, b = self.begin[node], self.end[node]
            x, y = self.rows.begins[a], self.rows.begins[b]
            scores = np.add.reduceat(self.rows.values[x:y] * weights[self.rows.columns[x:y]], self.rows.begins[a:b] - x)
            for i in np.flatnonzero(scores >= limit).tolist():
                found = (int(scores[i]), int(keys[a + i]))
                if len(top) < most:
                    heapq.heappush(top, found)
                elif found > top[0]:
                    heapq.heapreplace(top, found)
            limit = top[0][0] if len(top) == most else 1


def _radius(rows: Rows, squares: np.ndarray, centre: np.ndarray) -> float:
    """The largest distance to the centre, and more by what the sums may be off."""
    own = centre @ centre
    apart = squares - 2 * rows.products(centre) + own
    slack = 4 * (rows.width + 8) * _UNIT * (squares + own)
    return float(np.sqrt(np.maximum(apart + slack, 0).max())) * (1 + 1e-12)


def _cells(rows: Rows, cells: int) -> np.ndarray:
    """Centroids of the parts that halving again and again gives."""
    parts = [rows]
    while len(parts) < cells and max(len(p) for p in parts) > 1:
        parts.sort(key=len)
        part = parts.pop()
        order = part.halves(part.centroid(), part.squares())
        parts += [part.take(order[: len(order) // 2]), part.take(order[len(order) // 2 :])]
    return np.array([p.centroid() for p in parts])


def _impacts(words: np.ndarray, sizes: np.ndarray, times: np.ndarray, n: int, total: int) -> np.ndarray:
    factor = np.array([length_factor(x, n, total) for x in words.tolist()], dtype=np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * np.repeat(factor, sizes))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _dealt(rows: DataFrame, n: int, total: int, width: int) -> DataFrame:
    """``doc_id, terms, impacts``, dealt to tasks and sorted by ``cell`` and ``part``."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    some = some_of(rows, SAMPLE, "doc_id", "words").orderBy("doc_id", "words").toArrow().combine_chunks().to_batches()
    sizes, columns = _lists(some[0], "terms") if some else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    if some:
        values = _impacts(some[0].column("words").to_numpy(), sizes, _lists(some[0], "times")[1], n, total)
        centres = _cells(Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, values, width), CELLS)
    else:
        centres = np.zeros((1, width))
    own = (centres * centres).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, columns = _lists(batch, "terms")
            values = _impacts(batch.column("words").to_numpy(), sizes, _lists(batch, "times")[1], n, total)
            part = Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, values, width)
            near = np.array([part.products(x) for x in centres]) - own[:, None]
            ends = pa.array(part.begins, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(near.argmax(axis=0), pa.int32()), batch.column("terms"), pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))],
                names=["doc_id", "cell", "terms", "impacts"],
            )

    placed = stage(rows.mapInArrow(run, f"doc_id {kind}, cell int, terms array<int>, impacts array<int>"), "ranked-cells")
    # A large cell is dealt in as many parts as it needs; there are at most so many cells.
    shards = {r.cell: -(-r["count"] // SHARD) for r in placed.groupBy("cell").count().collect()}
    if not shards:
        return placed.withColumn("part", F.lit(0))
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shards.items()) for x in pair]), c("cell"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "terms"), parts).cast("int"))
    tasks = -(-sum(shards.values()) // SHARDS_A_TASK)
    return placed.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part")


def _found(dealt: DataFrame, weights: np.ndarray, most: int) -> DataFrame:
    """``item, doc_id, score`` of the best documents of each task for each row of ``weights``."""
    kind = dealt.schema["doc_id"].dataType.simpleString()
    rough = weights.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple[int, int]]] = [[] for _ in weights]

        def search(part: pa.Table) -> None:
            batch = part.combine_chunks().to_batches()[0]
            sizes, columns = _lists(batch, "terms")
            tree = BallTree(Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, _lists(batch, "impacts")[1], weights.shape[1]))
            bounds = tree.bounds(rough)
            # The smaller id is better, and none at all is worst.
            ids = [_LARGEST if i is None else i for i in batch.column("doc_id").to_pylist()]
            keys = -np.array(ids, dtype=np.int64)[tree.order]
            for k, top in enumerate(tops):
                tree.search(weights[k], bounds[:, k], keys, top, most)

        for part in _shards(batches):
            search(part)
        rows = [(k, None if key == -_LARGEST else -key, score) for k, top in enumerate(tops) for score, key in top]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        schema = pa.schema([("item", pa.int32()), ("doc_id", dealt_type), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, dealt_type), pa.array(score, pa.int64())], schema=schema)

    dealt_type = pa.int32() if kind == "int" else pa.int64()
    return dealt.select("cell", "part", "doc_id", "terms", "impacts").mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell and part at a time, no more than a tree may have."""
    held: list[pa.RecordBatch] = []
    key, rows, terms = None, 0, 0

    def given() -> pa.Table:
        return pa.Table.from_batches(held)

    for batch in batches:
        cells, parts = batch.column("cell").to_pylist(), batch.column("part").to_pylist()
        sizes = batch.column("terms").value_lengths().to_pylist()
        start = 0
        for i in range(len(batch)):
            now = (cells[i], parts[i])
            if now != key or rows >= 2 * SHARD or terms >= SHARD_TERMS:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield given()
                held, start, key, rows, terms = [], i, now, 0, 0
            rows, terms = rows + 1, terms + sizes[i]
        if len(batch) > start:
            held.append(batch.slice(start))
    if held:
        yield given()


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items with a term, in blocks of about equal size."""
    rows = items.select("item_id", "text").filter(c("text").isNotNull())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES))
    for i in range(blocks):
        some = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        if some := [r for r in some if terms_of(r.text)]:
            yield some


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` best documents with a score above 0, ties to the smaller id.

    Null and empty texts have no terms: such documents are not counted, such items have no rows. Rows that repeat a
    document id are ranked each, in no fixed order among equal scores; a null id comes after all others. Items that repeat
    an id are answered each. Texts are taken whole, however long; extra columns are left out; empty tables give no rows.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint"
    path = stage_path(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(items):
        asked = [Counter(terms_of(r.text)) for r in block]
        number = {t: i for i, t in enumerate(sorted({t for terms in asked for t in terms}))}
        rows = stage(counted(docs, number), "ranked-terms")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("total")).first()
        # No more rows than the vocabulary of a block has terms.
        held = {r.term: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = np.zeros((len(block), len(number)), dtype=np.int64)
        for k, terms in enumerate(asked):
            for t, times in terms.items():
                if (i := number[t]) in held:
                    weights[k, i] = times * weight(size.n, held[i])
        dealt = _dealt(rows.filter(F.size("terms") > 0), size.n, size.total, len(number))
        found = _found(dealt, weights, top)
        rank = F.row_number().over(W.partitionBy("item").orderBy(c("score").desc(), c("doc_id").asc_nulls_last()))
        found = found.withColumn("rank", rank).filter(c("rank") <= top)
        ids = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], f"item int, item_id {kinds[0]}")
        found.join(ids, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
