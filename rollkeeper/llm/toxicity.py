"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained, on ordinary text and on toxic text, and every window of a document is compressed with
the ordinary one alone and with both. A window that gets shorter by the toxic dictionary speaks like toxic text; how
much shorter the best windows get, and how many do, is turned into a chance by a calibrated logistic threshold.

The toxic samples are the words of toxic documents that occur there in many contexts and hardly elsewhere, as the
larger part of a toxic document is ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import WORD, small_batches, some_of, stage
from rollkeeper.llm.neardup import _steps, _texts

c = F.col

# Bound of the labelled sample that everything is fitted on: about so many documents, with low hashes of their ids.
SAMPLE = 20_000
WINDOW = 10
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 4_096
ORDINARY_WINDOWS = 40_000
TOXIC_WORDS = 400
# A toxic word has so many contexts in toxic documents, and so many times the share of contexts it has elsewhere.
LEAST_CONTEXTS = 6
LEAST_LIFT = 15.0
GAINS = (3, 5, 7, 9)
WINDOWS_KEPT = 200_000
THRESHOLD = 0.3
HELD_OUT = 2

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = re.compile(WORD.encode()).findall
# Marks that may stand around a word.
_MARKS = b".,;:!?\"'()"


def _windows(text: bytes) -> list[bytes]:
    words = _WORDS(text.translate(_LOWER))
    return [b" " + b" ".join(w.strip(_MARKS) for w in words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=48, d=6, level=9).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Gains:
    """Bytes that each window gets shorter by the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        way = zstandard.ZstdCompressionParameters(
            compression_level=9, strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=way)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=way)

        # The ordinary text ends both, so that it is reached at the same distance.
        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)
        self.known: dict[bytes, int] = {}

    def __call__(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) > WINDOWS_KEPT:
                self.known.clear()
            gain = self.known[window] = len(self.plain.compress(window)) - len(self.both.compress(window))
        return gain

    def features(self, text: bytes) -> list[float]:
        """The three largest gains, how many windows gain how much, and the number of windows."""
        gains = sorted(map(self, _windows(text)), reverse=True)
        top = (gains + [0, 0, 0])[:3]
        return [*map(float, top), *(float(np.log1p(sum(g >= k for g in gains))) for k in GAINS), float(np.log1p(len(gains)))]


WIDTH = 3 + len(GAINS) + 1


def _fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of a logistic regression."""
    if not len(labels):
        return np.zeros(WIDTH), np.ones(WIDTH), np.concatenate([[-2.0], np.zeros(WIDTH)])
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / spread])
    w, hold = np.zeros(x.shape[1]), ridge * np.r_[0.1, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (labels - p) - hold * w)
    return mean, spread, w


class Model:
    """Dictionaries and calibration, fitted on a bounded sample of labelled documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        small_batches(docs.sparkSession)
        marks = labels.filter(c("doc_id").isNotNull() & c("toxic").isNotNull() & ~held_out())
        marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        marks = some_of(marks.filter((c("toxic") == c("most")) & c("toxic").isin(0, 1)), sample, "doc_id")
        some = stage(docs.select("doc_id", "text").join(marks.select("doc_id", "toxic"), "doc_id").filter(c("text").isNotNull()), "labelled")
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.trim(w, F.lit(_MARKS.decode())))
        met = some.select("toxic", F.explode(F.arrays_zip(F.slice(words, 2, 1 << 30).alias("word"), words.alias("before"))).alias("p"))
        met = met.select("toxic", "p.word", "p.before").filter(c("word").isNotNull() & (c("word") != "")).distinct()
        table = met.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - c("toxic")).alias("other"))
        counts = {r.toxic: r["count"] for r in some.groupBy("toxic").count().collect()}
        lift = (c("toxic") + 0.5) / (counts.get(1, 0) + 1) / ((c("other") + 0.5) / (counts.get(0, 0) + 1))
        chosen = table.filter((c("toxic") >= LEAST_CONTEXTS) & (lift >= LEAST_LIFT))
        chosen = chosen.orderBy((c("toxic") * F.log(lift)).desc(), "word").limit(TOXIC_WORDS).collect()
        bag = [r.word.encode() for r in chosen for _ in range(min(int(r.toxic), 30))]
        bag = [bag[i] for i in np.random.default_rng(0).permutation(len(bag))]
        self.toxic_words = [r.word for r in chosen]
        toxic = _trained([b" " + b" ".join(bag[i : i + 4]) + b" " for i in range(0, len(bag), 4)], TOXIC_BYTES)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [w for text in _texts(batch.column("text")) for w in _windows(text)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["window"])

        plain = some.filter(c("toxic") == 0).select("text").mapInArrow(cut, "window binary")
        plain = some_of(stage(plain.distinct(), "windows"), ORDINARY_WINDOWS, "window").orderBy(F.xxhash64("window"), "window").collect()
        self.ordinary, self.toxic = _trained([bytes(r.window) for r in plain], ORDINARY_BYTES), toxic
        rows = np.array([(r.toxic, *r.features) for r in self._featured(some, ["toxic"]).collect()], dtype=float).reshape(-1, WIDTH + 1)
        self.calibration = _fit(rows[:, 1:], rows[:, 0])

    def _featured(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        ordinary, toxic = self.ordinary, self.toxic

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gains = Gains(ordinary, toxic)
            for batch in batches:
                rows = [gains.features(t or b"") for t in _texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in carried), pa.array(rows, pa.list_(pa.float64()))], names=[*carried, "features"])

        kinds = [f"{n} {docs.schema[n].dataType.simpleString()}" for n in carried]
        return docs.select(*carried, "text").mapInArrow(run, ", ".join([*kinds, "features array<double>"]))

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id`` and ``score`` of every row."""
        mean, spread, weights = (x.tolist() for x in self.calibration)
        parts = [(F.get("features", F.lit(i)) - mean[i]) / spread[i] * weights[i + 1] for i in range(WIDTH)]
        total = sum(parts, F.lit(weights[0]))
        return self._featured(docs, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def held_out():
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(c("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text counts as empty; both get the score of no windows. A null id is not held out and has no label. Labels
    that are null, neither 0 nor 1, or repeated with another value, are not used. Without labels all scores are alike.
    Rows that repeat are scored each; extra columns are left out; an empty table gives an empty one.
    """
    rows = Model(docs, labels, sample).score(docs)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (c("score") >= THRESHOLD).cast("int").alias("predicted"))
