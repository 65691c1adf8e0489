"""Encoding and decoding with SentencePiece pieces: Viterbi over a double-array trie.

A text is cut into pieces so that the sum of their scores is largest. A blank is the marker that
pieces begin with, and every text begins with one more. A character that is no piece is encoded as
its UTF-8 bytes. Decoding gives the text back exactly, whatever it holds.

No piece reaches across the beginning of a run of blanks, so the text is cut there into units which
are solved one by one. Equal units of a slice are solved once, and many units at the same time: the
trie is two integer arrays, through which one array operation moves all units by one byte.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from impactrec.llm.words import Spans, Texts, slices

MARKER = "▁"
_BLANK = 0x20
#: Units up to this many bytes are solved together, longer ones each by itself.
TOGETHER = 64
#: How far an unknown character's score is below the worst piece's.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie of byte strings in two arrays: ``s`` goes to ``t = base[s] + byte`` if ``check[t] == s``."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    value.append(-1)
                node = step
            value[node] = number
        size = 3 * len(children) + 4096
        base, check, found = (np.full(size, k, np.int32) for k in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0], check[0], found[0] = True, 0, value[0]
        low, width = 1, 1024
        queue = deque([(0, 0)])
        while queue:
            node, state = queue.popleft()
            codes = np.array(sorted(children[node]), np.int64)
            if not len(codes):
                continue
            start = low
            while True:  # the first place where all children fit
                if start + width + 256 >= size:
                    base, check, found = (np.concatenate([x, np.full(size, k, np.int32)]) for x, k in ((base, 0), (check, -1), (found, -1)))
                    used = np.concatenate([used, np.zeros(size, bool)])
                    size *= 2
                taken = used[start + codes[0] : start + codes[0] + width].copy()
                for c in codes[1:].tolist():
                    taken |= used[start + c : start + c + width]
                fit = int(taken.argmin())
                if not taken[fit]:
                    break
                start += width
            start += fit
            base[state] = start
            places = start + codes
            check[places], used[places] = state, True
            for c, place in zip(codes.tolist(), places.tolist()):
                child = children[node][c]
                found[place] = value[child]
                queue.append((child, place))
            while used[low : low + width].mean() > 0.95:  # nearly full: not searched again
                low += width
        # A state has room for every byte.
        self.base, self.check, self.value = base, check, found


@dataclass
class Vocabulary:
    """What tasks need of a piece model. ``ids`` and ``scores`` are by number of the key in the trie."""

    trie: DoubleArray
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    single: bool  # a line feed is in no piece with other characters
    piece_bytes: np.ndarray
    piece_at: np.ndarray


def load(model_file: str) -> Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file; it must have all 256 byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    keys, ids, byte_ids, surface = [], [], np.full(256, -1, np.int32), []
    for i in range(size):
        piece = model.id_to_piece(i)
        raw = piece.replace(MARKER, " ").encode()
        if model.is_byte(i):
            raw = bytes([int(piece[1:-1], 16)])
            byte_ids[raw[0]] = i
        elif model.is_control(i) or model.is_unknown(i):
            raw = b""
        elif not model.is_unused(i):
            keys.append(raw)
            ids.append(i)
        surface.append(raw)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    if any(b" " in k.lstrip(b" ") for k in keys):
        raise ValueError("a piece has a marker after another character")
    scores = np.array([model.get_score(i) for i in ids], np.float64)
    lengths = np.array([len(s) for s in surface], np.int64)
    return Vocabulary(
        DoubleArray(keys), np.array(ids, np.int32), scores, byte_ids, model.unk_id(), scores.min() - UNKNOWN_PENALTY,
        not any(b"\n" in k and len(k) > 1 for k in keys), np.frombuffer(b"".join(surface), np.uint8),
        np.concatenate([[0], np.cumsum(lengths)]),
    )


_CHARACTER = np.ones(256, np.int64)  # bytes of a character by its first byte
_CHARACTER[0xC0:0xE0], _CHARACTER[0xE0:0xF0], _CHARACTER[0xF0:] = 2, 3, 4


def _solve_one(unit: bytes, vocabulary: Vocabulary, lists: tuple[list, list, list]) -> list[tuple[int, int, int]]:
    """Edges ``(key or -1, start, length)`` of the best path through one unit."""
    base, check, value = lists
    scores, n = vocabulary.scores, len(unit)
    best, back = [-np.inf] * (n + 1), [(0, 0)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == -np.inf:
            continue
        state, j, width, alone = 0, i, int(_CHARACTER[unit[i]]), False
        while j < n:
            step = base[state] + unit[j]
            if check[step] != state:
                break
            state, j = step, j + 1
            if value[state] >= 0:
                alone |= j - i == width
                total = best[i] + scores[value[state]]
                if total > best[j]:
                    best[j], back[j] = total, (value[state], i)
        if not alone and best[i] + vocabulary.unknown_score > best[i + width]:
            best[i + width], back[i + width] = best[i] + vocabulary.unknown_score, (-1, i)
    path, end = [], n
    while end:
        key, start = back[end]
        path.append((key, start, end - start))
        end = start
    return path[::-1]


def _solve_many(units: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary):
    """Edges of the best paths through units given as rows: unit, key, start and length, in order."""
    trie, n, longest = vocabulary.trie, len(units), units.shape[1]
    best = np.full((n, longest + 1), -np.inf)
    best[:, 0] = 0
    key = np.full((n, longest + 1), -1, np.int32)
    start = np.zeros((n, longest + 1), np.int32)

    def offer(rows, end, total, keys, begin):
        better = total > best[rows, end]
        rows, end = rows[better], end[better] if isinstance(end, np.ndarray) else end
        best[rows, end], key[rows, end], start[rows, end] = total[better], keys if np.isscalar(keys) else keys[better], begin

    for i in range(longest):
        rows = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
        if not len(rows):
            continue
        here = best[rows, i]
        width = _CHARACTER[units[rows, i]]
        alone = np.zeros(len(rows), bool)
        active, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for j in range(i, longest):
            step = trie.base[state] + units[rows[active], j]
            fit = (trie.check[step] == state) & (lengths[rows[active]] > j)
            active, state = active[fit], step[fit]
            if not len(active):
                break
            number = trie.value[state]
            whole = number >= 0
            if whole.any():
                at, number = active[whole], number[whole]
                alone[at[width[at] == j + 1 - i]] = True
                offer(rows[at], j + 1, here[at] + vocabulary.scores[number], number, i)
        lone = np.flatnonzero(~alone)
        if len(lone):
            offer(rows[lone], i + width[lone], here[lone] + vocabulary.unknown_score, -1, i)
    steps, end, rows = [], lengths.copy(), np.flatnonzero(lengths > 0)
    while len(rows):
        at = end[rows]
        begin = start[rows, at]
        steps.append((rows, key[rows, at], begin, at - begin))
        end[rows] = begin
        rows = rows[begin > 0]
    columns = [np.concatenate([s[k] for s in steps]).astype(np.int64) for k in range(4)]
    order = np.lexsort((columns[2], columns[0]))
    return tuple(c[order] for c in columns)


class Encoder:
    """Encodes Arrow columns of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        trie = vocabulary.trie
        self._lists = (trie.base.tolist(), trie.check.tolist(), trie.value.tolist())

    def _unit_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some units, one after the other, and where each unit's begin."""
        lengths = ends - starts
        parts = []
        short = lengths <= TOGETHER
        for low in range(0, TOGETHER, 16):
            some = np.flatnonzero(short & (lengths > low) & (lengths <= low + 16))
            if len(some):
                place = starts[some, None] + np.arange(low + 16)
                units = data[np.minimum(place, len(data) - 1)].astype(np.int64)
                unit, key, begin, size = _solve_many(units, lengths[some], self.vocabulary)
                parts.append((some[unit], key, starts[some[unit]] + begin, size))
        for u in np.flatnonzero(~short).tolist():
            path = np.array(_solve_one(data[starts[u] : ends[u]].tobytes(), self.vocabulary, self._lists), np.int64)
            parts.append((np.full(len(path), u), path[:, 0], starts[u] + path[:, 1], path[:, 2]))
        if not parts:
            return np.empty(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        unit, key, begin, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((begin, unit))
        unit, key, begin, size = unit[order], key[order], begin[order], size[order]
        # An unknown character becomes its bytes.
        times = np.where(key < 0, size, 1)
        first = np.cumsum(times) - times
        within = np.arange(times.sum()) - np.repeat(first, times)
        key, place = np.repeat(key, times), np.repeat(begin, times) + within
        ids = np.where(key >= 0, self.vocabulary.ids[key], self.vocabulary.byte_ids[data[place]])
        counts = np.bincount(np.repeat(unit, times), minlength=len(starts))
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and where each text's begin."""
        texts = Texts(column)
        full = np.flatnonzero(np.diff(texts.offsets) > 0)
        # The blank before each text that isn't empty.
        data = np.insert(texts.data, texts.offsets[full], _BLANK)
        begin = texts.offsets[full] + np.arange(len(full))
        blank = data == _BLANK
        first = np.zeros(len(data), bool)
        first[begin] = True
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut |= first
        if self.vocabulary.single:
            feed = data == 0x0A
            cut |= feed
            cut[1:] |= feed[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = Spans(data).hashes(starts, ends)
        _, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids, at = self._unit_ids(data, starts[sample], ends[sample])
        counts = np.diff(at)[inverse]
        place = np.repeat(at[:-1][inverse] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own = full[np.searchsorted(begin, starts, side="right") - 1] if len(full) else starts
        per_text = np.bincount(own, weights=counts, minlength=texts.n).astype(np.int64)
        return ids[place], np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of some token ids; controls and unknowns stand for nothing."""
        v = self.vocabulary
        sizes = (v.piece_at[1:] - v.piece_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(v.piece_at[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        data, bounds = v.piece_bytes[source], ends[at]
        # Drop the blank before each text.
        full = np.flatnonzero(np.diff(bounds) > 0)
        full = full[data[bounds[full]] == _BLANK]
        data = np.delete(data, bounds[full])
        shift = np.zeros(len(bounds), np.int64)
        shift[full + 1] = 1
        offsets = (bounds - np.cumsum(shift)).astype(np.int64)
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        return pa.array(texts, pa.string())


def _shared(df: DataFrame, model_file: str):
    """The vocabulary, loaded once on the driver and sent to the tasks: about 2 MB."""
    return df.sparkSession.sparkContext.broadcast(load(model_file))


def _id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids``, ``n_tokens``, ``n_byte_tokens`` and ``exact``.

    ``exact`` says whether decoding the ids gives the text back. A null or empty text has no tokens
    and decodes to the empty text. Other columns pass through; any of the same names as the new ones
    are replaced. Equal texts get equal ids; ties between paths go to the one found first, that is
    with the earlier start of the last piece.
    """
    shared = _shared(docs, model_file)
    new = ["ids", "n_tokens", "n_byte_tokens", "exact"]
    passed = docs.drop(*new)
    kept = [c for c in passed.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        is_byte = np.zeros(len(shared.value.piece_at), bool)
        is_byte[shared.value.byte_ids] = True
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            ids, at = encoder.encode(texts)
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
            exact = pa.compute.equal(encoder.decode(ids, at), texts.cast(pa.string()).fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept], _id_lists(ids, at), pa.array(np.diff(at)),
                    pa.array(np.diff(bytes_before[at])), exact,
                ],
                names=[*kept, *new],
            )

    schema = passed.select(*kept).schema
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())
    schema = schema.add("n_byte_tokens", T.LongType()).add("exact", T.BooleanType())
    return passed.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str) -> DataFrame:
    """``tokens`` with ``ids`` replaced by ``text``; null ids give a null text, null elements nothing."""
    shared = _shared(tokens, model_file)
    passed = tokens.drop("text")
    kept = [c for c in passed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            ids = np.array([i for x in lists for i in x if i is not None], np.int64)
            at = np.cumsum([0, *[sum(i is not None for i in x) for x in lists]])
            texts = pa.compute.if_else(batch.column("ids").is_null(), None, encoder.decode(ids, at))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, "text"])

    return passed.mapInArrow(run, passed.select(*kept).schema.add("text", T.StringType()))
