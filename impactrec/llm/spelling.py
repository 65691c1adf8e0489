"""Groups of spelling variants by reduced-alphabet neighbourhoods.

Two words are near if they differ by one inserted, deleted or replaced letter. The letters are
hashed to a few symbols; words that are near have reduced words that are equal or one edit apart. So
the full one-edit neighbourhood of every reduced word is generated (over few symbols it is small)
and joined with the reduced vocabulary, which gives every word the reduced words it may be near to.
The words behind these are verified on the original letters, inside the join that brings them together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from impactrec.llm.words import Texts, mix, slices
from impactrec.staging import stage, staged

#: Fixed values of the contract: letters of a run, capitals that are lowered, the modulus of dropped letters.
RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED = 97

#: Bytes of reduced words whose neighbourhoods are made at a time.
_AT_ONCE = 1 << 16

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = _U(pow(_RADIX, -1, 1 << 64))


def runs(docs: DataFrame) -> DataFrame:
    """``word``: every run of letters of every whole text, A to Z lowered. A null text has none.

    Where the checksum of ``<doc_id>:<run>`` is a multiple of 97, a letter is left out, at the checksum
    modulo the run's length. A null ``doc_id`` counts as an empty text.
    """
    run = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"),
    ).withColumn("_run", F.translate("_run", CAPITALS, SMALL))
    hashed = run.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    return hashed.select(F.when(F.col("_h") % DROPPED == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n`` of the words of at least ``shortest`` letters that occur ``least`` times or more.

    Counts are combined before the shuffle, so that a frequent word is a row per task.
    """
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def symbol_of(letters: str, symbols: int) -> dict[str, str]:
    """The symbol that each letter is hashed to."""
    return {c: chr(0x61 + zlib.crc32(c.encode()) % symbols) for c in letters}


def symbols_for(vocabulary: int) -> int:
    """Symbols that keep groups of equal reduced words small: there are ``symbols ** 8`` words of eight.

    More symbols make smaller groups and larger neighbourhoods; the result is the same with any number.
    """
    return max(4, math.ceil(1.25 * vocabulary ** (1 / 8)))


def reduced(word: Column, symbols: int) -> Column:
    """The word in the reduced alphabet. What is no letter of a run is one symbol together."""
    table = symbol_of(SMALL + "".join(map(chr, range(0xC0, 0x100))), symbols)
    other = F.regexp_replace(word, "[^a-zÀ-ÿ]", "a")
    return F.translate(other, "".join(table), "".join(table.values()))


def _hash(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + length.astype(_U)).view(np.int64)


def _neighbours(column: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For reduced words their own hashes, and ``word, hash`` of everything at most one edit away.

    Hashes are polynomials in a 64-bit radix, so that an edited word's follows from sums before and
    behind the edit, in constant time whatever the word's length.
    """
    texts = Texts(column)
    value = texts.data.astype(_U) - _U(0x60)
    length = np.diff(texts.offsets)
    begin = texts.offsets[:-1]
    owner = np.repeat(np.arange(texts.n), length)
    place = np.arange(len(value)) - begin[owner]
    power = np.ones(int(length.max(initial=0)) + 2, _U)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(power) - 1, _RADIX, _U), out=power[1:])
        upto = np.concatenate([[_U(0)], np.cumsum(value * power[place], dtype=_U)])
        whole = upto[texts.offsets[1:]] - upto[begin]
        before = upto[:-1] - upto[begin[owner]]
        behind = whole[owner] - before
        after = behind - value * power[place]
        own = _hash(whole, length)
        words, hashes = [np.arange(texts.n), owner], [own, _hash(before + after * _INVERSE, length[owner] - 1)]
        last = np.concatenate([owner, np.arange(texts.n)])  # insertions: before each symbol, and at the end
        spot = np.concatenate([place, length])
        front, rest = np.concatenate([before, whole]), np.concatenate([behind, np.zeros(texts.n, _U)])
        for symbol in range(1, symbols + 1):
            other = value != symbol
            changed = before + _U(symbol) * power[place] + after
            words.append(owner[other])
            hashes.append(_hash(changed[other], length[owner[other]]))
            words.append(last)
            hashes.append(_hash(front + _U(symbol) * power[spot] + rest * _U(_RADIX), length[last] + 1))
    word, key = np.concatenate(words), np.concatenate(hashes)
    order = np.lexsort((key, word))
    word, key = word[order], key[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
    return own, word[new], key[new]


def _neighbourhoods(symbols: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "reduced", limit=_AT_ONCE):
            own, word, key = _neighbours(batch.column("reduced"), symbols)
            yield pa.RecordBatch.from_arrays([pa.array(own[word]), pa.array(key)], names=["own", "key"])

    return make


def _own_keys(symbols: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "reduced"):
            texts = Texts(batch.column("reduced"))
            length = np.diff(texts.offsets)
            power = np.ones(int(length.max(initial=0)) + 1, _U)
            with np.errstate(over="ignore"):
                np.multiply.accumulate(np.full(len(power) - 1, _RADIX, _U), out=power[1:])
                place = np.arange(len(texts.data)) - np.repeat(texts.offsets[:-1], length)
                upto = np.concatenate([[_U(0)], np.cumsum((texts.data.astype(_U) - _U(0x60)) * power[place], dtype=_U)])
                own = _hash(upto[texts.offsets[1:]] - upto[texts.offsets[:-1]], length)
            kept = [c for c in batch.schema.names if c != "reduced"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(own)], names=[*kept, "own"])

    return make


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n, other, other_n`` for every two near words of ``word, n`` rows, in both directions.

    The pairs tested are those whose reduced words are neighbours; only near ones leave the join, whose
    large partitions Spark can split.
    """
    coded = words.select("word", "n", reduced(F.col("word"), symbols).alias("reduced"))
    keyed = stage(coded.mapInArrow(_own_keys(symbols), "word string, n long, own long"))
    forms = coded.select("reduced").distinct()
    known = keyed.select(F.col("own").alias("key")).distinct()
    around = forms.mapInArrow(_neighbourhoods(symbols), "own long, key long").join(known, "key")
    asking = keyed.join(around, "own").select("word", "n", "key")
    others = keyed.select(F.col("own").alias("_key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (F.col("key") == F.col("_key")) & (F.levenshtein("word", "other", 1) == 1)
    return asking.join(others, near).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``word, form`` rows lead. They must not run in a circle.

    Every round doubles the length of the way that is known, and is written.
    """
    way = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = way.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved"))
        longer = stage(longer)
        if longer.where("_moved").isEmpty():
            return longer.select("word", "root")
        way = longer.select("word", "root")


def variants(words: DataFrame, symbols: int | None = None, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every one of ``word, n`` rows, which hold a word once.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if it occurs
    ``times`` as often, else null. ``symbols`` are those of the reduced alphabet, by default as many as the
    vocabulary needs. ``root`` is where forms lead from the word, the word itself without a
    form; they can't lead in a circle, as ``n`` grows. ``n_near`` counts the near words. A null word is left out.
    """
    with staged(words.sparkSession):
        vocab = stage(words.where(F.col("word").isNotNull()).select("word", "n"))
        symbols = symbols or symbols_for(vocab.count())
        best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
        found = near_words(vocab, symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
        enough = -F.col("best.minus") >= times * F.col("n")
        rated = stage(
            found.select(
                "word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")
            )
        )
        ends = roots(rated.where("form is not null"))
        full = vocab.join(rated, "word", "left").join(ends, "word", "left")
        return stage(
            full.select(
                "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
            ),
            result=True,
        )
