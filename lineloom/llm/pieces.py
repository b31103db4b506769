"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets one space in front and is cut before every run of spaces: "marked words". No piece of the
vocabulary continues over such a cut, so the best segmentation of a text is that of its marked words.
Distinct marked words are sorted and walked depth-first as a trie: positions of a prefix shared with the
word before keep their forward scores, and only the rest is scored.
"""

from __future__ import annotations

import gc
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.words import give_back, prefix_hashes, slices, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Marked words whose pieces a Python worker remembers; more are worked out anew each time.
REMEMBERED = 100_000
MARK = "▁"


class Vocabulary(NamedTuple):
    """Pieces with spaces instead of marks, their log-probabilities, and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    ids: list[int]
    bytes_at: list[int]
    fallback: float
    surface: list[bytes]


def load(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    """Read a model file. ``file``: its own scores are log-probabilities (a unigram model). ``rank``: its scores
    only order the pieces (a BPE model); the piece at place r, best first, gets -log(r + 2), Zipf's law.
    A character no piece covers costs ten more than the least likely piece and is written as its bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept, raw, bytes_at, surface = [], [], [-1] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            kept.append((i, piece.replace(MARK, " ")))
            raw.append(sp.get_score(i))
            surface.append(kept[-1][1].encode())
    if scores == "rank":
        place = np.empty(len(raw))
        place[np.lexsort((np.arange(len(raw)), -np.array(raw)))] = np.arange(len(raw))
        raw = list(-np.log(place + 2))
    return Vocabulary([p for _, p in kept], [float(s) for s in raw], [i for i, _ in kept], bytes_at, float(min(raw)) - 10, surface)


class Encoder:
    """The pieces' trie and the depth-first walk over sorted words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.root: dict = {}
        for piece, score, i in zip(v.pieces, v.scores, v.ids):
            node = self.root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = (score, i)  # no character is empty, so this key is free
        self.known: dict[int, tuple[int, ...]] = {}

    def walk(self, words: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of each word of a sorted list. Equal totals go to the longer last piece."""
        root, fallback = self.root, self.v.fallback
        total, start, piece, active = [0.0], [0], [-1], [[]]
        out, last = [], ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del total[shared + 1 :], start[shared + 1 :], piece[shared + 1 :], active[shared + 1 :]
            for at in range(shared, len(word)):
                ch, best, came, which, live = word[at], total[at] + fallback, at, -1, []
                for j, node in active[at]:
                    node = node.get(ch)
                    if node is not None:
                        live.append((j, node))
                        hit = node.get("")
                        if hit is not None and total[j] + hit[0] > best:
                            best, came, which = total[j] + hit[0], j, hit[1]
                node = root.get(ch)
                if node is not None:
                    live.append((at, node))
                    hit = node.get("")
                    if hit is not None and total[at] + hit[0] > best:
                        best, came, which = total[at] + hit[0], at, hit[1]
                total.append(best)
                start.append(came)
                piece.append(which)
                active.append(live)
            last, ids, at = word, [], len(word)
            while at:
                if piece[at] >= 0:
                    ids.append(piece[at])
                else:
                    ids.extend(self.v.bytes_at[b] for b in reversed(word[at - 1].encode()))
                at = start[at]
            out.append(tuple(reversed(ids)))
        return out

    def slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of the texts of one slice."""
        rows = len(at) - 1
        full = np.flatnonzero(np.diff(at))
        data = np.insert(data, at[full], 0x20)
        at = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[at[:-1][full]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        keys, where, back = np.unique(span_hash(prefix_hashes(data), begin, end), return_index=True, return_inverse=True)
        names = keys.tolist()
        fresh = [k for k, x in enumerate(names) if x not in self.known]
        raw = data.tobytes()
        text = sorted((raw[begin[w] : end[w]].decode("utf-8", "surrogateescape"), k) for k, w in zip(fresh, where[fresh].tolist())) if fresh else []
        new = {names[k]: ids for (_, k), ids in zip(text, self.walk([t for t, _ in text]))}
        found = [self.known[x] if x not in new else new[x] for x in names]
        if len(self.known) < REMEMBERED:
            self.known.update(new)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        each = size[back]
        stop = np.cumsum(each)
        ids = flat[np.repeat(first[back] - (stop - each), each) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begin, at)]


_workers: dict = {}


def _encoder(shared) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    v = shared.value
    key = (len(v.pieces), hash(tuple(v.scores)), hash(tuple(v.pieces)))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(v)
    return _workers[key]


def _masked(offsets: np.ndarray, values: pa.Array, nulls) -> pa.Array:
    mask = pa.array(nulls) if nulls.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "pieces") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out``, the piece ids of the whole text.

    A null text has null ids, an empty one none. A mark sign in the text is written as bytes, as is every
    character without a piece, so decoding gives the text back exactly. Repeated rows are kept; a column
    already named ``out`` is replaced. No shuffle; the vocabulary is a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        encoder, ids, ends, base = _encoder(shared), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for _, _, data, at in slices(texts):
            got, offsets = encoder.slice(data, at)
            ids.append(got)
            ends.append(offsets[1:] + base)
            base += len(got)
        return _masked(np.concatenate(ends), pa.array(np.concatenate(ids), pa.int32()), np.asarray(texts.is_null()))

    return docs.withColumn(out, run(F.col(text)))


class Surface:
    """The bytes of all pieces in one array, for decoding many ids at once."""

    def __init__(self, surface: list[bytes]):
        pieces = [*surface, b""]  # the last stands for ids that write nothing
        self.none = len(pieces) - 1
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.flat, self.first = np.frombuffer(b"".join(pieces) + b" ", np.uint8), np.cumsum(self.size) - self.size

    def text(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, row offsets) of rows of ids, without the space in front of a row."""
        part = np.where((ids < 0) | (ids >= self.none), self.none, ids)
        each = self.size[part]
        upto = np.concatenate([[0], np.cumsum(each)])
        raw = self.flat[np.repeat(self.first[part] - upto[:-1], each) + np.arange(upto[-1])]
        at = upto[stops]
        begin = at[:-1] + ((at[:-1] < at[1:]) & (np.append(raw, 0)[at[:-1]] == 0x20))
        keep = np.ones(len(raw), bool)
        keep[at[:-1][begin > at[:-1]]] = False
        return raw[keep], np.concatenate([[0], np.cumsum(at[1:] - begin)])


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """All rows and columns plus ``out``, the text of the piece ids; null for null ids, empty for none.

    Null, control and out-of-range ids write nothing; bytes that make no character become U+FFFD. The
    space that encoding put in front is taken off where there is one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.surface)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        surface, texts = Surface(shared.value), []
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], np.cumsum(counts)])
        nulls, step, row = np.asarray(lists.is_null()), 1 << 18, 0
        while row < len(counts):
            end = max(row + 1, int(np.searchsorted(stops, stops[row] + step, "right")) - 1)
            raw, ends = surface.text(ids[stops[row] : stops[end]], stops[row : end + 1] - stops[row])
            got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes())])
            try:
                texts.append(got.cast(pa.large_string()))
            except pa.ArrowInvalid:
                texts.append(pa.array([x.as_py().decode("utf-8", "replace") for x in got], pa.large_string()))
            row = end
        out = pa.concat_arrays(texts).cast(pa.string()) if texts else pa.array([], pa.string())
        return pc.if_else(pa.array(nulls), pa.scalar(None, pa.string()), out) if nulls.any() else out

    return rows.withColumn(out, run(F.col(pieces)))


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "pieces", check: str = "round_trip", stay: bool = True) -> DataFrame:
    """As :func:`encode`, plus ``check``: whether the ids decode to the text (true for a null text).

    Both are done a slice of about a megabyte of text at a time, and each slice goes back at once, so what a
    task holds doesn't grow with the rows of an Arrow batch. With ``stay`` a Python worker keeps its encoder and the words it
    has met for later tasks; without, it gives their memory back, for jobs in which other work follows.
    """
    shared, rows = docs.sparkSession.sparkContext.broadcast(vocabulary), docs.drop(out, check)
    names, place = [*rows.columns, out, check], rows.columns.index(text)
    state: dict = {}

    def run(batches):
        encoder = _encoder(shared)
        if not state:
            state["surface"] = Surface(encoder.v.surface)
        for b in batches:
            for i, j, data, at in slices(b.column(place)):
                ids, stops = encoder.slice(data, at)
                raw, ends = state["surface"].text(ids, stops)
                if np.array_equal(ends, at) and np.array_equal(raw, data):
                    good = np.ones(j - i, bool)
                else:
                    good = np.array([np.array_equal(raw[ends[k] : ends[k + 1]], data[at[k] : at[k + 1]]) for k in range(j - i)], bool)
                part = b.slice(i, j - i)
                lists = _masked(stops, pa.array(ids, pa.int32()), np.asarray(part.column(place).is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(good)], names=names)
        if not stay:
            encoder = None
            state.clear()
            _workers.clear()
            gc.collect()
            give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())]))
