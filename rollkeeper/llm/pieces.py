"""SentencePiece encoding and decoding for merge-type vocabularies, in Arrow batches.

A text is a row of symbols, at first its characters. An agenda holds the adjacent pairs that join to a piece of the
vocabulary, best score first and leftmost among equals; the first pair is joined and its new neighbours enter the
agenda, until none is left. Characters that never stand next to each other within a piece are never joined across,
so a text falls into units (about its words) that can be worked on alone, and each unit of a batch only once.

Every new unit is checked against the sentencepiece library, and so are the first whole text of each step of some megabytes
and every decoded text. A difference that these show is an error. That texts are their units side by side is by the rule
above; beyond the first text of a step it is not checked again.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rollkeeper.llm.common import small_batches

SPACE = "▁"
APART = ""
UNITS_KEPT = 250_000
PAIR_BITS = 22
NO_PAIR = 1 << 40
# Units of these lengths are worked on side by side.
SIDE_BY_SIDE = ((1, 8), (9, 14), (15, 24))


class Pieces:
    """Encoder and decoder of one model; the library's processor reads the model and is what results are held against."""

    def __init__(self, model: bytes, whole_texts: int = 1):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole_texts = whole_texts
        self.ids, self.scores, self.bytes_of, surface = {}, {}, {}, []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_of[int(piece[1:-1], 16)] = i
                surface.append(bytes([int(piece[1:-1], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                surface.append(b"")
            else:
                surface.append(piece.encode())
                if not lib.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, lib.get_score(i)
        if any(APART in p for p in self.ids):
            raise ValueError("the vocabulary uses the mark that keeps units apart")
        self.surface, self.begin, self.end = surface, lib.bos_id(), lib.eos_id()
        # Pairs of characters that stand next to each other in a piece, by a hash; a pair more does no harm.
        self.joined = np.zeros(1 << PAIR_BITS, dtype=bool)
        for piece in self.ids:
            codes = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
            self.joined[_pair(codes[:-1], codes[1:])] = True
        self._number_symbols()
        self.known: dict[str, bytes] = {}
        self.apart_ids = len(lib.encode(APART))

    def _number_symbols(self) -> None:
        """Numbers of symbols, and of the pairs that join, for agendas of many units side by side.

        A piece has its id, a character that only occurs within pieces a number above all ids, and any other
        character a number below -1, from which it can be told.
        """
        number = dict(self.ids)
        for ch in sorted({ch for piece in self.ids for ch in piece} - set(number)):
            number[ch] = len(self.surface) + len(number)
        self.base = max(number.values(), default=0) + 1
        self.char_number = -2 - np.arange(0x110000, dtype=np.int64)
        for symbol, n in number.items():
            if len(symbol) == 1:
                self.char_number[ord(symbol)] = n
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        best_first = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rank = np.full(len(self.surface), NO_PAIR, dtype=np.int64)
        for piece, i in self.ids.items():
            rank[i] = best_first[self.scores[piece]]
        self.rank = rank

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, -1 for none."""
        if not len(self.pair_keys):
            return np.full(left.shape, -1, dtype=np.int64)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_piece[at], -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        piece = self._joins(left, right)
        return np.where(piece >= 0, self.rank[piece], NO_PAIR)

    def many_symbols(self, units: list[str], width: int) -> np.ndarray:
        """Numbers of the symbols of units of at most ``width`` characters, a row each, filled with -1.

        Each row has its own agenda, the ranks of its adjacent pairs; a round joins the first best pair of every row
        and ranks the two new pairs.
        """
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        rows = np.full((len(units), width + 1), -1, dtype=np.int64)
        rows[:, :width][np.arange(width)[None, :] < sizes[:, None]] = self.char_number[codes]
        agenda = self._ranks(rows[:, :-1], rows[:, 1:])
        out, open_rows = rows.copy(), np.arange(len(units))
        columns = np.arange(width + 1)[None, :]
        while len(open_rows):
            at = agenda.argmin(axis=1)
            each = np.arange(len(open_rows))
            more = agenda[each, at] < NO_PAIR
            out[open_rows[~more]] = rows[~more]
            rows, agenda, at, open_rows = rows[more], agenda[more], at[more], open_rows[more]
            each = each[: len(open_rows)]
            pair = self._joins(rows[each, at], rows[each, at + 1])
            shift = np.minimum(columns + (columns > at[:, None]), width)
            rows = np.take_along_axis(rows, shift, axis=1)
            rows[:, -1] = -1
            rows[each, at] = pair
            agenda = np.take_along_axis(agenda, np.minimum(shift[:, :-1], width - 1), axis=1)
            agenda[:, -1] = NO_PAIR
            agenda[each, at] = self._ranks(rows[each, at], rows[each, np.minimum(at + 1, width)])
            left = np.maximum(at - 1, 0)
            agenda[each, left] = np.where(at > 0, self._ranks(rows[each, left], rows[each, at]), agenda[each, left])
        return out

    def unit_symbols(self, unit: str) -> list[str]:
        """Symbols of a unit after all joins of the agenda."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, agenda = self.scores.get, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (s := score(pair)) is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (-s, i, k, pair + symbols[k]))
            h = before[i]
            if h >= 0 and (s := score(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, i, symbols[h] + pair))
        return [s for s in symbols if s is not None]

    def symbol_ids(self, ch: str) -> list[int]:
        """Ids of a symbol that is no piece: its bytes, or the unknown piece."""
        return [self.bytes_of[b] for b in ch.encode()] if self.bytes_of else [self.library.unk_id()]

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for s in self.unit_symbols(unit):
            out.extend([self.ids[s]] if s in self.ids else self.symbol_ids(s))
        return out

    def _many_ids(self, units: list[str]) -> dict[str, np.ndarray]:
        """Ids of units: short ones side by side, long ones each with an agenda of its own."""
        found: dict[str, np.ndarray] = {}
        for least, most in SIDE_BY_SIDE:
            part = [u for u in units if least <= len(u) <= most]
            for start in range(0, len(part), 20_000):
                some = part[start : start + 20_000]
                rows = self.many_symbols(some, most)
                filled = rows != -1
                sizes = filled.sum(axis=1)
                upto = np.cumsum(sizes)
                ends = upto.tolist()
                flat = rows[filled]
                plain = ((flat >= 0) & (flat < len(self.surface)))
                clean = np.logical_and.reduceat(plain, upto - sizes).tolist()
                ids = flat.astype(np.uint32)
                for u, a, b, known in zip(some, [0, *ends], ends, clean):
                    found[u] = ids[a:b] if known else np.asarray(self.unit_ids(u), dtype=np.uint32)
        for u in units:
            if u not in found:
                found[u] = np.asarray(self.unit_ids(u), dtype=np.uint32)
        return found

    def _learn(self, units: list[str]) -> None:
        """Ids of units not met before, checked against the library behind a mark that nothing joins."""
        found = self._many_ids(units)
        for start in range(0, len(units), 20_000):
            part = units[start : start + 20_000]
            theirs = self.library.encode([APART + u for u in part], num_threads=1)
            mine = np.concatenate([found[u] for u in part])
            if mine.tolist() != [i for row in theirs for i in row[self.apart_ids :]]:
                raise ValueError("the library encodes a unit in another way")
        self.known.update((u, f.tobytes()) for u, f in found.items())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text between begin and end; null counts as empty."""
        texts = [t or "" for t in texts]
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        lengths = np.array([len(t) for t in marked], dtype=np.int64)
        ends = np.cumsum(lengths)
        if whole:
            codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
            cut = np.ones(len(codes) + 1, dtype=bool)
            cut[1:-1] = ~self.joined[_pair(codes[:-1], codes[1:])]
            cut[ends] = True
            edges = np.flatnonzero(cut)
            units = [whole[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            which, unique = pd.factorize(np.array(units, dtype=object))
            if len(self.known) > UNITS_KEPT:
                self.known.clear()
            if new := [u for u in unique if u not in self.known]:
                self._learn(new)
            parts = [self.known[u] for u in unique]
            flat = np.frombuffer(b"".join(parts), dtype=np.uint32)
            sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            begins = np.cumsum(sizes) - sizes
            n = sizes[which]
            upto = np.cumsum(n)
            ids = flat[np.repeat(begins[which] - (upto - n), n) + np.arange(upto[-1])]
            upto = np.concatenate([[0], upto])
            at = upto[np.searchsorted(edges, np.concatenate([[0], ends]))]
        else:
            ids, at = np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        out = [
            np.concatenate([[self.begin], ids[a:b], [self.end]]).astype(np.uint32) for a, b in zip(at[:-1].tolist(), at[1:].tolist())
        ]
        for text, mine in list(zip(texts, out))[: self.whole_texts]:
            if mine.tolist() != self.library.encode(text, add_bos=True, add_eos=True):
                raise ValueError("the library encodes a text in another way")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Text of each row of ids: the pieces in a row, without the space that encoding puts first."""
        out, surface = [], self.surface
        for theirs, row in zip(self.library.decode([r.tolist() for r in ids]), ids):
            mine = b"".join([surface[i] for i in row.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
            mine = mine[1:] if mine.startswith(" ") else mine
            if mine != theirs:
                raise ValueError("the library decodes ids in another way")
            out.append(mine)
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


def model_path() -> str:
    """The public model that the query works with; any merge-type model's path does."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, a vocabulary of bounded size, read where the driver runs and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _steps(batch: pa.RecordBatch, most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, so that memory follows the longest text and not the batch."""
    texts = batch.column("text")
    start = total = 0
    for i in range(len(batch)):
        total += len(texts[i].as_buffer()) if texts[i].is_valid else 0
        if total >= most_chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(batch):
        yield start, len(batch)


def encoded(docs: DataFrame, model: bytes, ids: bool = True, decode: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` (if asked for), ``n_tokens``, ``ids_sha256`` and, of the decoded text, ``decoded_sha256``.

    Ids stand between begin and end. A null or empty text has these two alone and decodes to an empty text. Rows that
    repeat are encoded each; texts are taken whole, however long; other columns are left out; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString())]
    fields += [("ids", "array<int>")] * ids + [("n_tokens", "bigint"), ("ids_sha256", "string")] + [("decoded_sha256", "string")] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for a, b in _steps(batch):
                part = batch.slice(a, b - a)
                rows = pieces.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id")]
                if ids:
                    sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rows).view(np.int32))))
                columns.append(pa.array([len(r) for r in rows], pa.int64()))
                columns.append(pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()))
                if decode:
                    columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in pieces.decode(rows)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def decoded(tokens: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id, ids``; null ids are no ids."""
    small_batches(tokens.sparkSession)
    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            rows = [np.asarray(r or [], dtype=np.uint32) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces.decode(rows), pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, schema)
