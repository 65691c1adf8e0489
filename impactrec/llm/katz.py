"""Language-model scores by Katz backoff, learned from and applied to documents in blocks.

Texts become blocks of some million word numbers. For each order, a block asks the tables for its
distinct n-grams: its counts go to the buckets of the contexts, which add up those of all blocks,
keep the sums as one partition of the order's table, and answer each block in the order it asked.
So no n-gram travels once per occurrence, the tables are never whole on any machine, and the
probabilities of a block's tokens are evaluated from the answers, from the lowest order up.

P(w | h) = d(c) c / D(h) for c = c(h, w) > 0, else a(h) P(w | h'), where h' is h without its first word,
d the Good-Turing discount by counts of counts, and a(h) the mass that the discounts leave, over the mass
that h' gives to words not seen after h: all probabilities after a context add up to 1. Below the
words is the uniform distribution over them and one unknown word. D(h) is c(h), or one more where
no count after h is discounted, so that something is left there, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from impactrec.llm.words import Texts, Words, mix, slices
from impactrec.staging import stage, staged

#: Counts up to this are discounted.
LOW = 5
#: Tokens of a block, and about as many n-grams of a bucket.
BLOCK_TOKENS, BUCKET_GRAMS = 2_000_000, 2_000_000
#: A context that occurs more often is salted, but not more than ``SALTED`` contexts in all.
OFTEN, SALTED = 4_000_000, 200_000

_U = np.uint64
_START, _END = _U(0x5354415254535452), _U(0x454E44454E44454E)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers or floats of 8 bytes, compressed plane by plane."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8).T.tobytes()
    return len(values).to_bytes(8, "big") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "big")
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


# Blocks


def _blocks(limit: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        tokens = 0
        for batch in slices(batches, "text"):
            words = Words(Texts(batch.column("text")).lowered())
            held.append((batch.column("doc_id"), batch.column("learn").to_numpy(zero_copy_only=False), words.counts, words.hash))
            tokens += len(words.hash) + len(words.counts)
            if tokens >= limit:
                yield _block(number, held)
                number, held, tokens = number + 1, [], 0
        if held:
            yield _block(number, held)

    return blocks


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    """One row: the documents of a block and their words, numbered from 2 (0 and 1 are start and end)."""
    ids = pa.concat_arrays([h[0] for h in held])
    learn, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    known, place = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
    first = np.cumsum(sizes + 2) - (sizes + 2)
    symbols = np.ones(int(sizes.sum()) + 2 * len(sizes), np.int64)
    symbols[first] = 0
    inner = np.ones(len(symbols), bool)
    inner[first] = inner[first + sizes + 1] = False
    symbols[inner] = place + 2
    counts = np.bincount(symbols[np.repeat(learn, sizes + 2)], minlength=len(known) + 2)
    row = {
        "block": pa.array([number]), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "learn": pa.array([pack(learn.astype(np.int64))]), "sizes": pa.array([pack(sizes)]), "symbols": pa.array([pack(symbols)]),
        "words": pa.array([pack(np.concatenate([[_START, _END], known]).view(np.int64))]), "counts": pa.array([pack(counts)]),
        "n_tokens": pa.array([len(symbols)]), "n_words": pa.array([len(known) + 2]),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


# Counts


def discounts(often: np.ndarray) -> np.ndarray:
    """``d[r]`` for counts ``r`` up to ``LOW``, from ``often[r]``, how many n-grams occur ``r`` times (up to LOW + 1).

    Katz's ``(r* / r - q) / (1 - q)`` with ``r* = (r + 1) often[r + 1] / often[r]`` and ``q = (k + 1) often[k + 1] / often[1]``,
    for the largest k up to ``LOW`` with which all of them are above 0 and below 1; above k there is no
    discount. If there is no such k, as in very small corpora, half a count is taken from each.
    """
    r = np.arange(LOW + 1, dtype=np.float64)
    for k in range(LOW, 0, -1):
        n = often[: k + 2].astype(np.float64)
        if (n[1:] <= 0).any():
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = ((r[1 : k + 1] + 1) * n[2 : k + 2] / n[1 : k + 1] / r[1 : k + 1] - cut) / (1 - cut)
        if (d > 0).all() and (d < 1).all():
            return np.concatenate([[0.0], d, np.ones(LOW - k)])
    return np.concatenate([[0.0], (r[1:] - 0.5) / r[1:]])


class Level(NamedTuple):
    """What is known of an order: its discounts, and of salted contexts the sums of their parts."""

    discount: np.ndarray
    salted: np.ndarray
    low: np.ndarray
    lower: np.ndarray


class Known(NamedTuple):
    """``total`` and ``words``: tokens and distinct words learned from."""

    total: int
    words: int
    often: int
    buckets: tuple[int, ...]
    levels: tuple[Level, ...]

    def discounted(self, level: int, count: np.ndarray) -> np.ndarray:
        return count * np.append(self.levels[level - 1].discount, 1.0)[np.minimum(count, LOW + 1)]

    def left(self, level: int, low: np.ndarray) -> np.ndarray:
        """What discounts take from followers, of which ``low[:, r - 1]`` occur ``r`` times."""
        r = np.arange(1, LOW + 1)
        return ((1 - self.levels[level - 1].discount[1:]) * r * low).sum(1)


_ANSWER = "level int, block long, bucket int, ids binary, counts binary, low binary, lower binary, stats binary, salted binary"
_ASK = "block long, bucket int, contexts binary, sizes binary, words binary, n binary, r binary, d binary, salted binary"


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in columns})


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), slice(a, b)


def _word_order(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block asks for its words, and their buckets."""
    bucket = (words.view(_U) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                words, counts = (unpack(batch.column(c)[i].as_py()) for c in ("words", "counts"))
                order, bucket = _word_order(words, buckets)
                rows = [
                    {"block": number, "bucket": b, "words": pack(words[order[at]]), "n": pack(counts[order[at]])}
                    for b, at in _parts(bucket)
                ]
                yield from _rows(_ASK, rows).to_batches()

    return ask


def _sum_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _stats(counts: np.ndarray, total: int) -> bytes:
    often = np.bincount(np.minimum(counts, LOW + 2), minlength=LOW + 3)
    return pack(np.concatenate([often, [total, np.count_nonzero(counts)]]).astype(np.int64))


def _answer_words(buckets: int):
    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = [unpack(x) for x in table.column("words").to_pylist()]
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()])
        known, place = np.unique(np.concatenate(asked), return_inverse=True)
        order = np.argsort(place, kind="stable")
        counts = _sum_runs(n[order], np.searchsorted(place[order], np.arange(len(known))))
        # Frequent words have small numbers; words that only held-out texts have, none.
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(known))
        ids = np.where(counts > 0, rank * buckets + bucket, -1)
        rows, at = [], 0
        for block, part in zip(table.column("block").to_pylist(), asked):
            own = place[at : at + len(part)]
            rows.append({"level": 1, "block": block, "bucket": bucket, "ids": pack(ids[own]), "counts": pack(counts[own])})
            at += len(part)
        spoken = counts[known != _START.view(np.int64)]
        rows.append({"level": 1, "block": -1, "bucket": bucket, "stats": _stats(spoken, int(spoken.sum()))})
        return _rows(_ANSWER, rows)

    return answer


class _Grams(NamedTuple):
    """Distinct n-grams of a block: the local context and word of each, its n-gram one order below, and
    of every place the n-gram that ends there (-1: none). Then what the tables know of them."""

    context: np.ndarray
    word: np.ndarray
    below: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    prob: np.ndarray  # of the word after the context
    total: np.ndarray  # D of the context


class _Block:
    def __init__(self, row: pa.Table, answers: pa.Table, known: Known):
        self.known = known
        get = lambda c: unpack(row.column(c)[0].as_py())
        self.sizes, self.learn, self.symbols, words = get("sizes"), get("learn") > 0, get("symbols"), get("words")
        self.first = np.cumsum(self.sizes + 2) - (self.sizes + 2)
        self.place = np.arange(len(self.symbols)) - np.repeat(self.first, self.sizes + 2)
        self.answers: dict[int, dict[int, dict]] = {}
        for r in answers.to_pylist():
            self.answers.setdefault(r["level"], {})[r["bucket"]] = r
        self.words = len(words)
        order, bucket = _word_order(words, known.buckets[0])
        ids, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for b, at in _parts(bucket):
            ids[order[at]], counts[order[at]] = (unpack(self.answers[1][b][c]) for c in ("ids", "counts"))
        none = np.zeros(len(words), np.int64)
        total = np.full(len(words), known.total, np.float64)
        prob = np.ones(len(words))
        if known.levels:
            left = known.left(1, known.levels[0].low)[0]
            if left <= 0:
                left, total = 1.0, total + 1
            prob = np.where(counts > 0, known.discounted(1, counts), left) / np.maximum(total, 1)
            if not known.total:
                prob = np.ones(len(words))
        self.grams = [_Grams(none, np.arange(len(words)), none, self.symbols, ids, counts, prob, total)]

    def ask(self) -> tuple[_Grams, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams of the next order, which of them are asked for, in that order, their buckets, and
        whether their contexts are salted."""
        under, level = self.grams[-1], len(self.grams) + 1
        valid = np.flatnonzero(self.place >= level - 1)
        key = under.at[valid - 1] * self.words + self.symbols[valid]
        found, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.full(len(self.symbols), -1, np.int64)
        at[valid] = inverse
        context, word = found // self.words, found % self.words
        none = np.zeros(len(found))
        grams = _Grams(context, word, under.at[valid[first]], at, none, none, none, none)
        context_id, often = under.ids[context], under.counts[context]
        asked = np.flatnonzero((often > 0) & (context_id >= 0))
        word_id = self.grams[0].ids[word[asked]]
        ways = 1 + often[asked] // self.known.often
        with np.errstate(over="ignore"):
            spread = mix(context_id[asked].view(_U)) + mix(word_id.view(_U)) % ways.view(_U)
        bucket = (spread % _U(self.known.buckets[level - 1])).astype(np.int64)
        order = np.lexsort((word_id, context_id[asked], bucket))
        return grams, asked[order], bucket[order], ways[order] > 1, word_id[order]

    def climb(self) -> None:
        """Take up the answers for the next order."""
        grams, asked, bucket, salted, _ = self.ask()
        level, under, known = len(self.grams) + 1, self.grams[-1], self.known
        ids, counts = np.full(len(grams.context), -1, np.int64), np.zeros(len(grams.context), np.int64)
        low, lower = np.zeros((len(grams.context), LOW), np.int64), np.zeros(len(grams.context))
        for b, at in _parts(bucket):
            mine, answer = asked[at], self.answers[level][b]
            counts[mine] = unpack(answer["counts"])
            if answer["ids"] is not None:
                ids[mine] = unpack(answer["ids"])
            run = np.flatnonzero(np.diff(grams.context[mine], prepend=-1))
            run_of = np.cumsum(np.diff(grams.context[mine], prepend=-1) != 0) - 1
            low[mine] = unpack(answer["low"]).reshape(LOW, len(run)).T[run_of]
            sums = np.zeros(len(run))
            sums[np.logical_or.reduceat(counts[mine] == 0, run)] = unpack(answer["lower"], np.float64)
            lower[mine] = sums[run_of]
        step = known.levels[level - 1]
        if len(step.salted):
            wide = asked[salted]
            found = np.searchsorted(step.salted, under.ids[grams.context[wide]])
            low[wide], lower[wide] = step.low[found], step.lower[found]
        often = under.counts[grams.context].astype(np.float64)
        left = known.left(level, low)
        total = np.where(left > 0, often, often + 1)
        left = np.where(left > 0, left, 1.0)
        prob = under.prob[grams.below].copy()
        seen = counts > 0
        prob[seen] = known.discounted(level, counts[seen]) / total[seen]
        after = np.zeros(len(prob), bool)
        after[asked] = True
        after &= ~seen
        prob[after] *= left[after] / total[after] / np.maximum(1 - lower[after], 1e-300)
        self.grams.append(grams._replace(ids=ids, counts=counts, prob=prob, total=total))

    def messages(self, number: int) -> pa.Table:
        grams, asked, bucket, salted, word_id = self.ask()
        under = self.grams[-1]
        train = np.repeat(self.learn, self.sizes + 2) & (grams.at >= 0)
        n = np.bincount(grams.at[train], minlength=len(grams.context))
        rows = []
        for b, at in _parts(bucket):
            mine = asked[at]
            context = under.ids[grams.context[mine]]
            run = np.flatnonzero(np.diff(context, prepend=-1))
            below = grams.below[mine]
            values = {
                "contexts": np.diff(context[run], prepend=0), "sizes": np.diff(run, append=len(mine)), "words": word_id[at], "n": n[mine],
                "r": under.counts[below], "d": under.total[below].astype(np.int64), "salted": salted[at][run].astype(np.int64),
            }
            rows.append({"block": number, "bucket": b} | {k: pack(v) for k, v in values.items()})
        return _rows(_ASK, rows)

    def scores(self, kind: pa.DataType, ids: pa.Array) -> pa.Table:
        known = self.known
        spoken = np.flatnonzero(self.place > 0)
        count = self.grams[0].counts[self.symbols[spoken]]
        prob = self.grams[0].prob[self.symbols[spoken]]
        for grams in self.grams[1:]:
            here = grams.at[spoken]
            prob = np.where(here >= 0, grams.prob[here], prob)
        begin = self.first - np.arange(len(self.first))
        base = np.log10((count + 1) / (known.total + known.words + 1))
        return pa.table(
            {
                "doc_id": ids.cast(kind), "n_tokens": pa.array(self.sizes + 1), "n_known": pa.array(_sum_runs((count > 0).astype(np.int64), begin)),
                "train_tokens": pa.array(np.full(len(ids), known.total, np.int64)), "base_score": pa.array(_sum_runs(base, begin)),
                "score": pa.array(_sum_runs(np.log10(prob), begin)), "held_out": pa.array(~self.learn),
            }
        )


def _climbed(row: pa.Table, answers: pa.Table, known: Known, upto: int) -> _Block:
    block = _Block(row, answers, known)
    while len(block.grams) < upto:
        block.climb()
    return block


def _answer_grams(level: int, known: Known, last: bool):
    """Count the n-grams of a bucket, and tell each block of its own and of their contexts."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = []
        for r in table.to_pylist():
            part = {c: unpack(r[c]) for c in ("contexts", "sizes", "words", "n", "r", "d", "salted")}
            part["contexts"] = np.cumsum(part["contexts"])
            asked.append(part)
        every = lambda c: np.concatenate([p[c] for p in asked])
        context = np.concatenate([np.repeat(p["contexts"], p["sizes"]) for p in asked])
        word = every("words")
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = (np.diff(context, prepend=-1) != 0) | (np.diff(word, prepend=-2) != 0)
        first = np.flatnonzero(new)
        counts = _sum_runs(every("n")[order], first)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        # By context, over its distinct followers.
        starts = np.flatnonzero(np.diff(context[first], prepend=-1))
        names = context[first][starts]
        low = np.stack([_sum_runs((counts == r).astype(np.int64), starts) for r in range(1, LOW + 1)])
        r, d = every("r")[order][first], every("d")[order][first]
        lower = _sum_runs(np.where(counts > 0, known.discounted(level - 1, r) / np.maximum(d, 1), 0.0), starts)
        seen = counts > 0
        ids = np.where(seen, (np.cumsum(seen) - 1) * known.buckets[level - 1] + bucket, -1)
        rows, at, salted = [], 0, set()
        for block, p in zip(table.column("block").to_pylist(), asked):
            own = place[at : at + len(p["words"])]
            at += len(own)
            c = counts[own]
            run = np.cumsum(p["sizes"]) - p["sizes"]
            which = np.searchsorted(names, p["contexts"])
            missing = np.logical_or.reduceat(c == 0, run)
            rows.append({
                "level": level, "block": block, "bucket": bucket, "counts": pack(c), "low": pack(low[:, which].ravel()),
                "lower": pack(lower[which[missing]]), "ids": None if last else pack(ids[own]),
            })
            salted.update(which[p["salted"] > 0].tolist())
        parts = np.array(sorted(salted), np.int64)
        rows.append({
            "level": level, "block": -1, "bucket": bucket, "stats": _stats(counts, 0), "salted": pack(names[parts]),
            "low": pack(low[:, parts].ravel()), "lower": pack(lower[parts]),
        })
        return _rows(_ANSWER, rows)

    return answer


def _learned(answers: DataFrame) -> tuple[np.ndarray, Level]:
    """The summed statistics of an order. Per bucket one row, and the parts of at most ``SALTED`` contexts."""
    rows = answers.where("block = -1").select("stats", "salted", "low", "lower").collect()
    stats = sum((unpack(bytes(r["stats"])) for r in rows), np.zeros(LOW + 5, np.int64))
    often = stats[: LOW + 2]
    if rows and rows[0]["salted"] is not None:
        names = np.concatenate([unpack(bytes(r["salted"])) for r in rows])
        low = np.concatenate([unpack(bytes(r["low"])).reshape(LOW, -1).T for r in rows])
        lower = np.concatenate([unpack(bytes(r["lower"]), np.float64) for r in rows])
        order = np.argsort(names, kind="stable")
        known, first = np.unique(names[order], return_index=True)
        return stats, Level(discounts(often), known, _sum_runs(low[order], first), _sum_runs(lower[order], first))
    return stats, Level(discounts(often), np.empty(0, np.int64), often[None, 1 : LOW + 1], np.zeros(1))


def score(
    docs: DataFrame, learn: Column, order: int = 2, block_tokens: int = BLOCK_TOKENS, bucket_grams: int = BUCKET_GRAMS, often: int = OFTEN
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Tokens are the words between white space, A to Z lowered, and one end per text; a null text counts as
    empty. The model of n-grams up to ``order`` learns from the rows for which ``learn`` is true (null:
    false). ``score`` is its log10 probability of the tokens, the first of which follows a start;
    ``base_score`` that of single words with one added to each count; ``n_known`` counts tokens that were
    learned from. Without rows to learn from both scores are 0. Rows may repeat; each is scored, and learned from.

    ``often`` salts contexts: the n-grams of one that occurs more often are dealt to several buckets. At
    least as often must be every ``SALTED``-th part of the tokens, so that the sums of salted contexts fit the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    with staged(spark):
        texts = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
        schema = (
            f"block long, doc_ids array<{kind.simpleString()}>, learn binary, sizes binary, symbols binary, words binary, counts binary, "
            "n_tokens long, n_words long"
        )
        blocks = stage(texts.mapInArrow(_blocks(block_tokens), schema))
        sizes = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
        tokens, words = sizes["tokens"] or 0, sizes["words"] or 0
        buckets = (-(-max(1, words) // bucket_grams), *[-(-max(1, tokens) // bucket_grams)] * (order - 1))
        known = Known(0, 0, max(often, -(-tokens // SALTED)), buckets, ())
        asked = blocks.select("block", "words", "counts").mapInArrow(_ask_words(buckets[0]), _ASK)
        tables = [stage(asked.groupBy("bucket").applyInArrow(_answer_words(buckets[0]), _ANSWER))]
        for level in range(1, order + 1):
            stats, learned = _learned(tables[-1])
            if level == 1:
                known = known._replace(total=int(stats[-2]), words=int(stats[-1]))
            known = known._replace(levels=(*known.levels, learned))
            answers = tables[0]
            for t in tables[1:]:
                answers = answers.unionByName(t)
            both = blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
            shared = spark.sparkContext.broadcast(known)
            if level < order:
                asked = both.applyInArrow(_asker(shared, level), _ASK)
                counted = _answer_grams(level + 1, known, last=level + 1 == order)
                tables.append(stage(asked.groupBy("bucket").applyInArrow(counted, _ANSWER)))
        result = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return stage(both.applyInArrow(_scorer(shared, order, result), result), result=True)


def _asker(shared, level: int):
    def ask(key: tuple, row: pa.Table, answers: pa.Table) -> pa.Table:
        return _climbed(row, answers, shared.value, level).messages(key[0].as_py())

    return ask


def _scorer(shared, order: int, result: str):
    names = [c.split()[0] for c in result.split(", ")]

    def scores(key: tuple, row: pa.Table, answers: pa.Table) -> pa.Table:
        ids = row.column("doc_ids").combine_chunks().flatten()
        return _climbed(row, answers, shared.value, order).scores(ids.type, ids).select(names)

    return scores
