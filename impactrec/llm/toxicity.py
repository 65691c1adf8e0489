"""Toxicity by a factorization machine over hashed terms.

Terms are words and word stems (prefixes), hashed. A factorization machine adds, to a weight per
term, the inner product of the factors of every two terms of a text, so that it learns pairs such
as an insult with the mention of a group. The machine sees the terms that tell the labels apart by
themselves, over all labelled rows it is given, and those that do so in pairs, among the most frequent
terms of either label; it is fitted on a bounded sample of the rows and scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.llm.tables import unused
from impactrec.llm.words import ALNUM, Texts, Words, as_long, mix, slices
from impactrec.staging import stage

TERM_BITS = 20
STEMS = (4, 5)
FACTORS = 8


@dataclass
class Model:
    chosen: np.ndarray  # by term bucket: index of the term, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The text and the bucket of each word and stem of some texts (with repeats), and the texts' number."""
    texts = Texts(column).lowered()
    words = Words(texts, ALNUM)
    owners, hashes = [words.text], [words.hash]
    for length in STEMS:
        longer = words.ends - words.starts >= length
        owners.append(words.text[longer])
        stems = words.spans.hashes(words.starts[longer], words.starts[longer] + length)
        hashes.append(mix(stems + np.uint64(length)))
    buckets = np.concatenate(hashes) >> np.uint64(64 - TERM_BITS)
    return np.concatenate(owners), buckets.astype(np.int64), texts.n


def _distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's terms once, in order."""
    keys = np.unique((owner << TERM_BITS) | bucket)
    return keys >> TERM_BITS, keys & ((1 << TERM_BITS) - 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << TERM_BITS), np.int64)
    for batch in slices(batches, "text"):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        owner, bucket = _distinct(*terms(batch.column("text"))[:2])
        for label in (0, 1):
            counts[label] += np.bincount(bucket[toxic[owner] == label], minlength=1 << TERM_BITS)
    found = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(found), pa.array(counts[0, found]), pa.array(counts[1, found])], names=["term", "clean", "toxic"]
    )


def _surer(share0, share1, clean: int, toxic: int):
    """How many standard deviations two shares are apart; for columns as for arrays."""
    pooled = (share0 * clean + share1 * toxic) / (clean + toxic)
    return (share1 - share0) / (pooled * (1 - pooled) * (1.0 / clean + 1.0 / toxic)) ** 0.5


def choose_terms(rows: DataFrame, clean: int, toxic: int, most: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms that tell the labels apart alone, and the most frequent ones of either label.

    By how many texts of each label hold a term, counted over all rows and added up by Spark. Alone, a
    term counts if its shares are 5 standard deviations apart, or 3 where one is ``e`` times the other;
    the ``most`` surest are kept. Of the frequent terms, pairs are looked at later, whatever their shares.
    """
    counted = rows.mapInArrow(_term_counts, "term long, clean long, toxic long").groupBy("term")
    share0, share1 = (F.col("c0") + 0.5) / (clean + 1), (F.col("c1") + 0.5) / (toxic + 1)
    rated = stage(
        counted.agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1")).select(
            "term", "c0", "c1", F.abs(_surer(share0, share1, clean + 1, toxic + 1)).alias("sure"), F.abs(F.log(share1 / share0)).alias("ratio")
        )
    )
    alone = rated.where("sure >= 5 or (sure >= 3 and ratio >= 1)").orderBy(F.desc("sure"), "term").limit(most)
    often = [rated.orderBy(F.desc(c), "term").limit(frequent) for c in ("c0", "c1")]
    ids = [np.array([r["term"] for r in part.select("term").collect()], np.int64) for part in (alone, *often)]
    return np.sort(ids[0]), np.unique(np.concatenate(ids[1:]))


def paired_terms(owner: np.ndarray, term: np.ndarray, label: np.ndarray, size: int, pairs: int = 500) -> np.ndarray:
    """Of ``size`` terms those of which two together tell the labels apart better than either does alone.

    From the texts (``owner`` sorted) of a sample: how many of either label hold both terms. Chance is
    allowed for: six standard deviations, and a fifth more than the surer term of the two.
    """
    both = np.zeros((2, size, size), np.float32)
    n = np.bincount(label.astype(int), minlength=2)
    for at in range(0, len(label), 4096):
        a, b = np.searchsorted(owner, (at, at + 4096))
        held = np.zeros((min(4096, len(label) - at), size), np.float32)
        held[owner[a:b] - at, term[a:b]] = 1
        for y in (0, 1):
            part = held[label[at : at + 4096] == y]
            both[y] += part.T @ part
    share = (both + 0.5) / (n[:, None, None] + 1)
    sure = np.abs(_surer(share[0], share[1], int(n[0]) + 1, int(n[1]) + 1))
    single = np.diagonal(sure)
    more = np.triu((sure >= 6) & (sure >= 1.2 * np.maximum(single[:, None], single[None])), 1)
    x, y = np.nonzero(more)
    best = np.argsort(-sure[x, y], kind="stable")[:pairs]
    return np.unique(np.concatenate([x[best], y[best]]))


def _active(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and term index of each distinct chosen term of some texts."""
    owner, bucket, n = terms(column)
    index = chosen[bucket]
    hit = index >= 0
    owner, bucket = _distinct(owner[hit], bucket[hit])
    return owner, chosen[bucket].astype(np.int64), n


def margins(owner: np.ndarray, term: np.ndarray, n: int, bias: float, weights: np.ndarray, factors: np.ndarray):
    """The machine's outputs, and the summed factors of each text."""
    linear = np.bincount(owner, weights=weights[term], minlength=n)
    sums = np.stack([np.bincount(owner, weights=factors[term, f], minlength=n) for f in range(factors.shape[1])], 1)
    squares = np.bincount(owner, weights=(factors[term] ** 2).sum(1), minlength=n)
    return bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def fit_machine(
    owner: np.ndarray, term: np.ndarray, label: np.ndarray, weight: np.ndarray, size: int,
    epochs: int = 12, batch: int = 256, rate: float = 0.1, penalty: float = 1e-4, seed: int = 11,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Minimise the weighted logistic loss by AdaGrad over batches of texts. ``owner`` is sorted."""
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    bias, n = float(np.log((weight * label).sum() + 1) - np.log((weight * (1 - label)).sum() + 1)), len(label)
    seen_w, seen_v, seen_b = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8), 1e-8
    begin = np.searchsorted(owner, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            lengths = begin[rows + 1] - begin[rows]
            own = np.repeat(np.arange(len(rows)), lengths)
            first = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            t = term[first + np.arange(lengths.sum())]
            out, sums = margins(own, t, len(rows), bias, weights, factors)
            pull = weight[rows] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[rows])
            seen_b += pull.sum() ** 2
            bias -= rate * pull.sum() / np.sqrt(seen_b)
            if not len(t):
                continue
            used, place = np.unique(t, return_inverse=True)
            step_w = np.bincount(place, weights=pull[own], minlength=len(used)) + penalty * weights[used]
            each = pull[own, None] * (sums[own] - factors[t])
            step_v = np.stack([np.bincount(place, weights=each[:, f], minlength=len(used)) for f in range(FACTORS)], 1)
            step_v += penalty * factors[used]
            seen_w[used] += step_w**2
            weights[used] -= rate * step_w / np.sqrt(seen_w[used])
            seen_v[used] += step_v**2
            factors[used] -= 0.5 * rate * step_v / np.sqrt(seen_v[used])
    return bias, weights, factors


def labelled(docs: DataFrame, labels: DataFrame, most: int = 500_000) -> DataFrame:
    """``doc_id, text, toxic`` of at most about ``most`` labels, half of them of each kind if it has as many.

    Those with a low hash of ``doc_id`` are taken, by a rate of each label's own, so that a rare label stays
    whole. A ``doc_id`` with several label rows is toxic if one of them says so. The bound lets the labels be
    sent to the documents, whose texts are not shuffled; every document with the id of a label is a row.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    share = F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1_000_000)) / 1_000_000
    drawn = known.where(share < _by_label(_rates(known, most // 2)))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def _rates(rows: DataFrame, most: int) -> dict[int, float]:
    """By label, the part of the rows that leaves about ``most`` of them."""
    return {r["toxic"]: min(1.0, most / r["count"]) for r in rows.groupBy("toxic").count().collect()}


def _by_label(rate: dict[int, float]):
    return F.when(F.col("toxic") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0))


def fit(rows: DataFrame, per_label: int = 20_000, most_terms: int = 20_000, frequent: int = 750) -> Model | None:
    """Learn from ``doc_id, text, toxic`` rows; rows without a label of 0 or 1 or without text are left out.

    Terms are chosen by counts over all rows, pairs of terms among the ``frequent`` most frequent of
    either label. Pairs and the machine itself come from about ``per_label`` rows of each label at most,
    weighted to stand for all. Rows are drawn one by one, so that many of one ``doc_id`` are no more than
    others. None if a label does not occur.
    """
    usable = rows.where(F.col("toxic").isin(0, 1) & F.col("text").isNotNull()).select("doc_id", "text", "toxic")
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    alone, often = choose_terms(usable, n[0], n[1], most_terms, frequent)
    seen = np.union1d(alone, often)
    number = np.full(1 << TERM_BITS, -1, np.int32)
    number[seen] = np.arange(len(seen))
    rate = {k: min(1.0, per_label / v) for k, v in n.items()}
    own = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    drawn = usable.withColumn("_own", own).where(F.pmod("_own", F.lit(1_000_000)) / 1_000_000 < _by_label(rate)).drop("_own")
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, term, size = _active(batch.column("text"), shared.value)
            bounds = np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))
            key = pa.array(as_long(Words(Texts(batch.column("text"))).spans.hashes(*_bounds(batch.column("text")))))
            yield pa.RecordBatch.from_arrays([key, batch.column("toxic").cast(pa.int32()), lists], names=["key", "toxic", "terms"])

    sample = drawn.mapInArrow(vectors, "key long, toxic int, terms array<int>").toArrow()
    sample = sample.sort_by([("key", "ascending"), ("toxic", "ascending")]).combine_chunks()
    label = sample.column("toxic").to_numpy().astype(np.float64)
    lists = sample.column("terms").combine_chunks()
    term = np.asarray(lists.flatten()).astype(np.int64)
    owner = np.repeat(np.arange(len(label)), np.diff(np.asarray(lists.offsets)))

    place = np.full(len(seen), -1)
    place[np.searchsorted(seen, often)] = np.arange(len(often))
    frequent_ones = place[term] >= 0
    paired = often[paired_terms(owner[frequent_ones], place[term[frequent_ones]], label, len(often))]
    kept = np.union1d(alone, paired)
    chosen = np.full(1 << TERM_BITS, -1, np.int32)
    chosen[kept] = np.arange(len(kept))
    of_kept = chosen[seen][term]
    owner, term = owner[of_kept >= 0], of_kept[of_kept >= 0].astype(np.int64)
    weight = np.where(label == 1, 1 / rate[1], 1 / rate[0])
    return Model(chosen, *fit_machine(owner, term, label, weight / weight.mean(), max(1, len(kept))))


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = Texts(column).offsets
    return offsets[:-1], offsets[1:]


def score(
    docs: DataFrame, model: Model | None, threshold: float = 0.3, keep: Sequence[str] = ("doc_id",),
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """``keep``, the score and the verdict (1 from ``threshold`` on) of every row, from ``text`` alone.

    Texts that are null or hold no chosen term get the score of the bias. Without a model every
    score is 0. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, [text] = list(keep), unused(docs, "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches, text):
            result = np.zeros(batch.num_rows)
            if machine is not None:
                owner, term, n = _active(batch.column(text), machine.chosen)
                out, _ = margins(owner, term, n, machine.bias, machine.weights, machine.factors)
                result = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            flags = pa.array((result >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(result), flags], names=[*keep, *names]
            )

    schema = docs.select(*keep).schema.add(names[0], T.DoubleType()).add(names[1], T.IntegerType())
    return docs.select(*keep, docs["text"].alias(text)).mapInArrow(judge, schema)
