"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier per bit, a logistic regression
on hashed byte n-grams, predicts that bit; a text gets the language whose codeword has the least
total loss against the predictions, and is flagged as ambiguous if another is nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from impactrec.llm.words import LOWER, Texts, slices

BUCKETS = 4096
LONGEST = 3
#: Rows of a slice: one has at most this many feature vectors in memory.
ROWS = 1000
UNDETERMINED = "und"

_LETTER = np.array([(0x61 <= b <= 0x7A) or b >= 0x80 for b in range(256)])


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1: all distinct splits for up to five classes, else the drawn code whose
    closest two codewords differ in most bits."""
    if classes <= 5:
        splits = range(1, max(2, 1 << (classes - 1)))
        bits = [[1 if (s >> c) & 1 else -1 for s in splits] for c in range(classes)]
        return np.array(bits, np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(classes)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (classes, length))
        apart = (length - code @ code.T) / 2 + length * np.eye(classes)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector of hashed byte n-grams per text, and whether the text has a letter.

    ASCII letters are lower-cased and runs of other ASCII characters become one space.
    """
    texts = Texts(column)
    data = LOWER[texts.data]
    letter = _LETTER[data]
    owner = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
    data = np.where(letter, data, 0x20).astype(np.uint64)
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    data, owner = data[keep], owner[keep]
    counts = np.zeros(texts.n * BUCKETS, np.int32)
    gram = np.zeros(len(data), np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] << np.uint64(8)) | data[n - 1 :]
        own = owner[:size]
        with np.errstate(over="ignore"):
            bucket = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        inside = own == owner[n - 1 :]
        place = own[inside] * BUCKETS + bucket[inside].astype(np.int64)
        counts += np.bincount(place, minlength=len(counts)).astype(np.int32)
    counts = counts.reshape(texts.n, BUCKETS)
    total = np.maximum(1, counts.sum(1, keepdims=True, dtype=np.int64))
    return np.sqrt(counts / total, dtype=np.float32, casting="same_kind"), _has_letter(column, texts, letter)


def _has_letter(column: pa.Array, texts: Texts, letter: np.ndarray) -> np.ndarray:
    ascii_letters = texts.per_text(letter & (texts.data < 0x80)) > 0
    beyond = texts.per_text(texts.data >= 0x80) > 0
    for i in np.flatnonzero(beyond & ~ascii_letters).tolist():
        ascii_letters[i] = any(map(str.isalpha, column[i].as_py()))
    return ascii_letters


def _fit_bits(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all bits by accelerated gradient descent. ``rows`` are weights."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    ahead, penalty, rate = w.copy(), 1e-5, 4.0
    rows = (rows / rows.sum()).astype(np.float32)[:, None]
    for step in range(1, steps + 1):
        margin = y * (x @ ahead[:-1] + ahead[-1])
        pull = -y * rows / (1 + np.exp(np.clip(margin, -30, 30)))
        slope = np.vstack([x.T @ pull, pull.sum(0, keepdims=True)]) + penalty * ahead
        new = ahead - rate * slope
        ahead = new + (step - 1) / (step + 2) * (new - w)
        w = new
    return w[:-1], w[-1]


def fit(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Learn from at most ``per_language`` texts of each language, drawn at random.

    ``docs`` holds the rows to learn from; rows without text or language are left out. Rows are drawn one
    by one, the same for the same files: repeated ids and texts are no more than others. A first pass counts
    the rows of each language, and only a few more than the sample are ranked. None if there is nothing to learn from.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    # One row per language; twice the sample is drawn, so that hardly a sample is short.
    rates = {r["lang"]: 2 * per_language / r["count"] for r in usable.groupBy("lang").count().collect()}
    if not rates:
        return None
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    own = usable.withColumn("_own", F.xxhash64("lang", "text", F.monotonically_increasing_id()))
    drawn = own.where(F.pmod("_own", F.lit(1 << 30)) < rate * (1 << 30))
    order = Window.partitionBy("lang").orderBy("_own", "text")
    drawn = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language)
    sample = drawn.select("lang", "text", "_own").toArrow().sort_by([("_own", "ascending")])
    languages = sorted(set(sample.column("lang").to_pylist()))
    if not languages:
        return None
    vectors, known, number = [], [], {l: i for i, l in enumerate(languages)}
    for batch in slices(iter(sample.combine_chunks().to_batches()), "text", rows=ROWS):
        x, letters = features(batch.column("text"))
        vectors.append(x[letters])
        known += np.array([number[l] for l in batch.column("lang").to_pylist()])[letters].tolist()
    if not known:
        return None
    label = np.array(known)
    codes = codewords(len(languages))
    balance = 1.0 / np.bincount(label, minlength=len(languages))[label]
    weights, bias = _fit_bits(np.concatenate(vectors), codes[label], balance)
    return Model(languages, codes, weights, bias)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the nearest codeword, its share of the likelihood, and the loss to the next."""
    bits = x @ model.weights + model.bias
    loss = np.logaddexp(0, -bits[:, None, :] * model.codes[None]).sum(2)
    best = loss.argmin(1)
    ahead = np.sort(loss, 1)
    likely = np.exp(ahead[:, :1] - loss)
    margin = ahead[:, 1] - ahead[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return best, 1.0 / likely.sum(1), margin


def identify(docs: DataFrame, model: Model | None, near: float = 1.0) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row, from ``text`` alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model.
    ``ambiguous``: another codeword has less than ``near`` more loss. Equal texts get equal results;
    on a tie the first language in order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in slices(batches, "text", rows=ROWS):
            names = np.full(batch.num_rows, UNDETERMINED, object)
            score, unsure = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if learned is not None:
                x, letters = features(batch.column("text"))
                best, share, margin = decode(learned, x)
                names[letters] = np.array(learned.languages, object)[best[letters]]
                score[letters] = share[letters]
                unsure[letters] = margin[letters] < near
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )
