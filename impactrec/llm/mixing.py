"""Mixing sources to target weights, cut at each source's exact budget of tokens.

Every document has a hash-random key. Within its source the documents are range-sorted by it
and a distributed prefix sum of their tokens is formed; a source's budget is filled with whole
epochs of the source first and then with its documents in key order up to the budget. The
document at the cut gives the mix as many of its tokens as still fit. A hot source is spread
over many ranges, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.functions.ordering import running_totals
from impactrec.llm.tables import small, unused
from impactrec.llm.words import SPACED, Texts, slices
from impactrec.staging import stage


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = Texts(batch.column("text"))
        starts, _ = texts.runs(SPACED)
        sizes = pa.array(np.bincount(texts.owner(starts), minlength=texts.n).astype(np.int64))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], sizes], names=[*kept, "size"])


def word_sizes(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``size``, the number of words of ``text`` (null: 0), of every row."""
    wanted = docs.select(*keep, "text")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("size", T.LongType())])
    return wanted.mapInArrow(_counted, schema)


def targets(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """Each source's share of ``total`` by weight, but at most ``most`` times its size.

    What a source at its limit leaves over goes to the others by weight, until none is above.
    A total above all limits together fills every source to its limit.
    """
    open_sources, out, left = set(sizes), {}, total
    while open_sources:
        weight = sum(weights[s] for s in open_sources)
        full = [s for s in open_sources if left * weights[s] / weight >= most * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / weight for s in open_sources}
        for s in full:
            out[s] = float(most * sizes[s])
        open_sources.difference_update(full)
        left = total - sum(v for v in out.values())
    return out


def shuffle_key(seed: str, column: str) -> Column:
    """A hash-random key, the same on every run."""
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 16)


def cycled_weights(sources: Sequence[str | None], cycle: Sequence[float]) -> dict:
    """The sources in code-point order, null last, with the weights of ``cycle`` repeating."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode())
    ordered += [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def mix(
    docs: DataFrame,
    weights: dict | Sequence[float],
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix:",
    keep: Sequence[str] = ("doc_id",),
    ties: Sequence[str] = ("text",),
) -> DataFrame:
    """How many words of each document the mix takes: ``taken``, repeats counted.

    Returns ``keep``, ``source``, ``size`` (words), ``source_size``, ``target`` (of the source) and
    ``taken``. All targets together are ``share`` of all words. ``weights`` are given by source, or
    as a sequence that repeats over the sources in code-point order. A null source is a source of
    its own. Texts that are null or without words have size 0 and give nothing. Repeated rows are
    each counted; which of several equal rows comes first does not change the result. The first
    column of ``keep`` is the document's key; documents of one key go by size and then by a hash of
    the columns ``ties``, so that other texts of the same key and size come in the same order on every
    run. Per-source totals are the only thing that the driver sees: one row for each source that has
    a weight.
    """
    keep, [tie] = list(keep), unused(docs, "_tie")
    hashed = docs.withColumn(tie, F.xxhash64(*[F.col(c) for c in ties]))
    sized = stage(word_sizes(hashed, [*keep, "source", tie]))
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    by_source = weights if isinstance(weights, dict) else cycled_weights(list(totals), weights)
    goal = targets(totals, by_source, share * sum(totals.values()), most)

    plan = sized.sparkSession.createDataFrame(
        [(s, s is None, int(n), float(goal[s]), int(goal[s] + 0.5)) for s, n in totals.items()],
        "_name string, _missing boolean, source_size long, target double, _budget long",
    )
    keyed = sized.select(
        *keep, "source", "size", tie, F.coalesce("source", F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_missing"), shuffle_key(seed, keep[0]).alias("_key"),
    )
    order = [F.col("_key"), F.col(keep[0]), F.col("size"), F.col(tie)]
    summed = running_totals(keyed, by=["_name", "_missing"], order=order, sums=["size"], keep=[*keep, "source"])
    named = plan.withColumn("_name", F.coalesce("_name", F.lit("")))
    joined = summed.join(small(named, len(totals)), ["_name", "_missing"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("_budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("cum_size") - F.col("size"))))
    return joined.select(
        *keep, "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )
