"""Quality rules: word statistics of a text, and lines that too many documents of a host share.

Lines are normalised (ASCII lower case, one space between words) and hashed. For each host and
line the documents are counted in which it occurs, identical texts once, since copies are not
boilerplate. Lines above the limit, a number of texts that does not grow with the host, are
removed, and a document is rejected when what remains is too little. Only hashes of lines are
shuffled; counts are combined before each shuffle, so that a line of a third of all documents is a
few rows for a reducer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.llm.tables import small, unused
from impactrec.llm.words import LOWER, SPACED, Texts, Words, as_long, mix, slices, span_hashes
from impactrec.staging import stage

#: Characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8

_ROW = pa.struct([("line", pa.int64()), ("words", pa.int64())])
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NEW = (
    "row_key long, host string, text_key long, "
    + ", ".join(f"{c} long" for c in _BASE)
    + ", lines array<struct<line long, words long>>"
)


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_percent`` fail a text by itself. A line is removed from a host
    when more than ``line_documents`` of its distinct texts hold it, whatever the host's size. A document
    is rejected if fewer than ``min_words`` words, or less than ``min_left`` of its words, remain."""

    min_words: int = 20
    max_repeat_percent: int = 30
    line_documents: int = 5
    min_left: float = 0.3


def _repeated_words(words: Words) -> np.ndarray:
    """Words in windows of eight that occur at least twice in their text, per text."""
    grams, at = words.grams(WINDOW)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    if len(grams):
        # Windows of different texts must not meet.
        keyed = grams ^ (words.text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, inverse, counts = np.unique(keyed, return_inverse=True, return_counts=True)
        hits = at[counts[inverse] > 1]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + WINDOW, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.bincount(words.text[inside], minlength=words.texts.n).astype(np.int64)


def _line_numbers(texts: Texts, words: Words) -> tuple[np.ndarray, ...]:
    """Of each line that has a word: its text, the hash of its bytes, and of its normalised words."""
    starts, ends = texts.lines()
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    full = last > first
    starts, ends, first, last = starts[full], ends[full], first[full], last[full]
    raw = words.spans.hashes(starts, ends)
    return texts.owner(starts), raw, first, last


def _line_hashes(word_hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words of each line, in their order; the lines hold all words."""
    if not len(first):
        return np.empty(0, np.uint64)
    longest = int((last - first).max())
    weight = mix(np.arange(1, longest + 1, dtype=np.uint64)) | np.uint64(1)
    place = np.arange(len(word_hashes)) - np.repeat(first, last - first)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(word_hashes * weight[place], first))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "text"):
        kept = [c for c in batch.schema.names if c not in ("host", "text")]
        texts = Texts(batch.column("text"))
        words = Words(texts)
        code_points = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=code_points[1:])
        chars = np.bincount(
            words.text, weights=code_points[words.ends] - code_points[words.starts], minlength=texts.n
        ).astype(np.int64)
        symbols = texts.per_text(SYMBOLS[texts.data])
        owner, raw, first, last = _line_numbers(texts, words)
        lines = np.bincount(owner, minlength=texts.n).astype(np.int64)
        distinct = np.unique(np.stack([owner.astype(np.uint64), raw]), axis=1)[0].astype(np.int64)
        repeated = lines - np.bincount(distinct, minlength=texts.n)
        repeat_words = _repeated_words(words)
        whole = words.spans.hashes(texts.offsets[:-1], texts.offsets[1:])

        lowered = span_hashes(LOWER[texts.data], words.starts, words.ends)
        normal = _line_hashes(lowered, first, last)
        n = last - first
        # Of equal lines in a text: one row, all their words.
        order = np.lexsort((normal, owner))
        o, h, w = owner[order], normal[order], n[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(w, at) if len(at) else w
        bounds = np.concatenate([[0], np.cumsum(np.bincount(o[at], minlength=texts.n))]).astype(np.int32)
        inner = pa.StructArray.from_arrays(
            [pa.array(as_long(h[at])), pa.array(total.astype(np.int64))], fields=list(_ROW)
        )
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in kept], pa.array(np.arange(row, row + texts.n)), batch.column("host"),
                pa.array(as_long(whole)), *map(pa.array, (words.counts, chars, symbols, repeated, repeat_words)),
                pa.ListArray.from_arrays(pa.array(bounds), inner),
            ],
            names=[*kept, "row_key", "host", "text_key", *_BASE, "lines"],
        )
        row += texts.n


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """``host, line`` of the lines above the limits, from rows of ``host, text_key, line, documents``."""
    texts = lines.groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
    counted = texts.groupBy("host", "line").agg(F.count("one").alias("texts"))
    return counted.where(F.col("texts") > limits.line_documents)


def _judged(docs: DataFrame, limits: Limits, host: str, keep: Sequence[str]) -> DataFrame:
    """The columns of ``quality``, and as ``_gone`` the hashes of the lines each text loses, null if none."""
    kept = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    rows = docs.select(
        *[F.col(c).alias(k) for c, k in zip(keep, kept.columns)], F.col(host).cast("string").alias("host"), "text"
    )
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(_NEW).fields])
    base = stage(rows.mapInArrow(_features, schema))
    key = F.struct(F.col("host").isNull(), F.coalesce("host", F.lit(""))).alias("host")
    lines = base.select("row_key", key, "text_key", F.explode("lines").alias("_l")).select(
        "row_key", "host", "text_key", F.col("_l.line").alias("line"), F.col("_l.words").alias("words")
    )
    above = stage(frequent_lines(lines, limits).select("host", "line"))
    removed = (
        lines.join(small(above, above.count()), ["host", "line"])
        .groupBy("row_key")
        .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("words").alias("removed"), F.collect_list("line").alias("_gone"))
    )
    joined = base.drop("lines").join(removed, "row_key", "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    depleted = (left < limits.min_words) | (left < limits.min_left * F.col("n_words"))
    return joined.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept.columns)], *_BASE, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), left.alias("n_left_words"), "_gone",
    )


def quality(
    docs: DataFrame, limits: Limits = Limits(), host: str = "source", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Word statistics of every text and the verdict ``kept``.

    Returns ``keep``, the five base numbers, ``base_failed``, ``kept``, ``n_removed_lines`` and
    ``n_left_words``. A null text counts as empty and fails; a null host is a host of its own.
    Repeated rows are each judged, and count once for the limits like other copies of a text.
    A host with few texts loses no line, since ``line_documents`` texts must hold it.
    """
    return _judged(docs, limits, host, keep).drop("_gone")


def _without_lines(batches: Iterator[pa.RecordBatch], lost: str) -> Iterator[pa.RecordBatch]:
    """Replace ``text`` by what remains of it without the lines whose hashes the column ``lost`` holds."""
    for batch in slices(batches, "text"):
        gone = batch.column(lost)
        at = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            affected = batch.column("text").take(pa.array(at))
            texts = Texts(affected)
            words = Words(texts)
            owner, _, first, last = _line_numbers(texts, words)
            lowered = span_hashes(LOWER[texts.data], words.starts, words.ends)
            normal = as_long(_line_hashes(lowered, first, last)).tolist()
            breaks = np.flatnonzero(texts.data == 0x0A)
            place = (np.searchsorted(breaks, words.starts[first]) - np.searchsorted(breaks, texts.offsets[owner])).tolist()
            bounds = np.searchsorted(owner, np.arange(len(at) + 1)).tolist()
            column = batch.column("text").to_pylist()
            for i, (row, text, drop) in enumerate(zip(at.tolist(), affected.to_pylist(), gone.take(pa.array(at)).to_pylist())):
                drop, of = set(drop), range(bounds[i], bounds[i + 1])
                out = {place[k] for k in of if normal[k] in drop}
                column[row] = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in out)
            texts = pa.array(column, batch.schema.field("text").type)
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", texts)
        yield batch.drop_columns([lost])


def cleaned(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, their ``text`` without the lines it removes.

    Lines that remain stay as they are, and so do the other columns, whatever their names. Verdict and lines
    depend on the text and its host, so texts are only shuffled if very many of these are rejected or lose lines.
    """
    text_key, host_key, verdict, lost = unused(docs, "text", "host", "kept", "gone")
    key, place = F.xxhash64("text"), F.col(host).cast("string")
    of = docs.select(place.alias("_host"), "text", key.alias("_text"))
    judged = _judged(of, limits, "_host", ("_text", "_host"))
    changed = judged.where(F.col("_gone").isNotNull() | ~F.col("kept")).groupBy(F.col("_text").alias(text_key), F.col("_host").alias(host_key))
    changed = stage(changed.agg(F.first("kept").alias(verdict), F.first("_gone").alias(lost)))
    same = (key == F.col(text_key)) & place.eqNullSafe(F.col(host_key))
    cells = changed.select(F.sum(1 + F.coalesce(F.array_size(lost), F.lit(0)))).first()[0]
    joined = docs.join(small(changed, cells or 0), same, "left").where(F.coalesce(verdict, F.lit(True)))
    return joined.select(*docs.columns, lost).mapInArrow(lambda batches: _without_lines(batches, lost), docs.schema)
