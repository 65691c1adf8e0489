"""Words, lines and hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

Tasks receive Arrow batches of texts. The functions here cut a batch into slices of a few
megabytes and find all words of a slice with array operations, so that the cost for a word
is some nanoseconds and the memory of a task is bounded by the slice, or by one text if that
is larger. Texts are always processed whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text in a slice, a little less than a power of two, by which tables of powers grow.
SLICE_BYTES = 15 << 16

_ALL = np.arange(256)
#: Bytes of words that white space ends: all but space and tab to carriage return.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of words made of letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Lower-cases A to Z and nothing else.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 0x20, _ALL).astype(np.uint8)

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_RADIX_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (_RADIX, _RADIX_INVERSE):
            column = np.full(size, base, _U)
            column[0] = 1
            out.append(np.multiply.accumulate(column))
        if size > 4 * SLICE_BYTES:  # for one very long text: not kept
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


class Spans:
    """Hashes of runs of an array, all from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        power, self._inverse = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(_U) + _U(1)) * power[: len(values)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run ``values[start:end]``; equal runs have equal hashes."""
        with np.errstate(over="ignore"):
            runs = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
            return mix(runs + (ends - starts).astype(_U))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(values).hashes(starts, ends)


class Texts:
    """The bytes of some texts; ``offsets[i]:offsets[i + 1]`` is text ``i`` (null counts as empty)."""

    def __init__(self, column: pa.Array):
        whole = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = whole.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(whole)

    def lowered(self) -> Texts:
        self.data = LOWER[self.data]
        return self

    def _inner(self) -> np.ndarray:
        """Where texts that aren't empty begin."""
        return self.offsets[:-1][np.diff(self.offsets) > 0]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes for which ``member`` holds, none across texts."""
        if not len(self.data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inside = member[self.data]
        first = self._inner()
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[first] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[first[1:] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces between line feeds, of texts that aren't empty."""
        breaks = np.flatnonzero(self.data == 0x0A)
        first = self._inner()
        last = self.offsets[1:][np.diff(self.offsets) > 0]
        return np.sort(np.concatenate([first, breaks + 1])), np.sort(np.concatenate([breaks, last]))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text that holds the byte at each place."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a number per byte, for each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


class Words:
    """The words of some texts: byte ``starts`` and ``ends``, the ``text`` that holds each, and hashes."""

    def __init__(self, texts: Texts, member: np.ndarray = SPACED):
        self.texts = texts
        self.starts, self.ends = texts.runs(member)
        self.text = texts.owner(self.starts)
        self.counts = np.bincount(self.text, minlength=texts.n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.spans = Spans(texts.data)
        self.hash = self.spans.hashes(self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a text, and the index of each run's first word."""
        total = len(self.hash)
        if total < n:
            return np.empty(0, _U), np.empty(0, np.int64)
        at = np.flatnonzero(self.text[: total - n + 1] == self.text[n - 1 :])
        return gram_hashes(self.hash, at, n), at


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive hashes from each index in ``at``."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), n, _U)
        for k in range(n):
            out = mix(out * _RADIX + hashes[at + k])
    return out


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def return_memory() -> None:
    """Give back what Arrow and numpy keep for later: it would add up in the worker, which lives on after the task."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 10_000
) -> Iterator[pa.RecordBatch]:
    """Cut batches into consecutive parts of at most ``rows`` rows, and of at most ``limit`` bytes in
    ``column`` unless a single row has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        begin, filled = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > begin and (filled + size > limit or row - begin == rows):
                yield batch.slice(begin, row - begin)
                begin, filled = row, 0
            filled += size
        yield batch.slice(begin)
        return_memory()


def as_long(hashes: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed longs of Spark."""
    return hashes.view(np.int64)
