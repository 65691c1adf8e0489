"""Exact top-k search by inner product with a Voronoi partition of the data.

Every vector belongs to the cell of its nearest pivot. Queries are grouped by cells. From the
summaries of the cells (largest distance to the pivot, and the vectors nearest to it) every query
gets a score that its k best surely reach. For a query q and a vector v of the cell of pivot p,
q.v <= q.p + |q| |v - p|, so the vectors of a cell that a group of queries needs are those at
least some distance from p: only these are replicated to the group, which is then solved locally
in blocks of both sides. Each block keeps the k best of a query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from impactrec.staging import stage


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def valid_vectors(df: DataFrame, key: str, vector: str, scale: int, *more: Column) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``; vectors with a null or non-finite component, of no
    components, or null, are left out. ``more`` columns are added."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = df.where(x.isNotNull() & (F.size(x) > 0) & ~bad & F.col(key).isNotNull())
    return usable.select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        *more,
    )


def check_vectors(vectors: DataFrame) -> None:
    """Refuse vectors of different lengths, and components whose products could pass 64 bits."""
    size, largest = F.size("v"), F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    found = vectors.agg(
        F.min(size).alias("short"), F.max(size).alias("long"), F.min_by("id", size).alias("of_short"), F.max_by("id", size).alias("of_long"),
        F.max(largest).alias("largest"), F.max_by("id", largest).alias("of_largest"),
    ).first()
    if found["short"] != found["long"]:
        raise ValueError(
            f"vectors of different lengths: {found['short']} components at key {found['of_short']}, {found['long']} at key {found['of_long']}"
        )
    # Squared distances hold four times the largest product.
    if found["short"] and 4 * found["short"] * found["largest"] ** 2 >= 2**63:
        raise ValueError(f"products of components up to {found['largest']:.0f}, at key {found['of_largest']}, do not fit 64 bits")


def choose_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """The ``pivots`` distinct vectors whose ids have the least hashes."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    return np.unique(np.array([r["v"] for r in rows], np.int64), axis=0)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, the first on a tie, and an upper bound of its distance."""
    away = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None]
    cell = away.argmin(1)
    return cell, np.sqrt(away[np.arange(len(x)), cell].astype(np.float64)) * (1 + 1e-9)


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell`` and ``dist``, the distance to its pivot."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, dist = _nearest(_matrix(batch.column("v")), pivots)
                arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "cell", "dist"])

    return vectors.mapInArrow(cells, "id long, v array<long>, cell int, dist double")


def summaries(assigned: DataFrame, k: int) -> list:
    """Per cell its radius and the ``k + 1`` vectors nearest to the pivot; a few rows per cell."""
    order = Window.partitionBy("cell").orderBy("dist", "id")
    near = assigned.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    return near.groupBy("cell").agg(F.collect_list(F.struct("id", "v")).alias("near")).collect()


def needed_vectors(data: DataFrame, plan: DataFrame) -> DataFrame:
    """The vectors that each group of queries needs: those of a cell from some distance to its pivot on."""
    return data.join(plan, "cell").where(F.col("dist") >= F.col("least"))


def _k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        # All that tie with the k-th stay, so that the smaller id decides.
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(scores[order].tolist(), ids[order].tolist()))


def top_k(
    df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024,
    pivots: int = 64, groups: int = 8, query_block: int = 256, data_block: int = 50_000,
) -> DataFrame:
    """The k vectors with the highest integer inner product for each row of ``df`` that ``queries`` selects.

    Returns ``query_id, rank, vec_id, score``. A row is no candidate for itself (by ``key``); ties go
    to the smaller id. With fewer candidates all are returned. Vectors that are null, empty, or hold
    null or non-finite components take no part, neither do rows without a key; all others must have
    the same number of components, or an error names two keys; so do components too large for 64-bit
    products. Rows that repeat a key are candidates each; of those that ask, the smallest vector is the query.
    An empty table gives no rows. ``pivots`` and ``groups`` bound what is summarised on the driver.
    """
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    asks = F.coalesce(queries, F.lit(False)).alias("asks")
    usable = stage(valid_vectors(df, key, vector, scale, asks))
    check_vectors(usable)
    vectors = usable.select("id", "v")
    centres = choose_pivots(vectors, pivots)
    if not len(centres):
        return spark.createDataFrame([], result)
    data = stage(assign(vectors, centres))
    # Of several vectors with the key of a query, the smallest asks.
    asked = assign(usable.where("asks").groupBy("id").agg(F.min("v").alias("v")), centres)
    near = [x for row in summaries(data, k) for x in row["near"]]
    known_ids = np.array([x["id"] for x in near], np.int64)
    known = np.array([x["v"] for x in near], np.int64)
    # Cells close to one another form a group of queries.
    seeds = centres[np.linspace(0, len(centres) - 1, min(groups, len(centres))).astype(int)]
    group_of = _nearest(centres, seeds)[0]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group each query; for each group and cell, the least distance of a vector that it needs."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
            scores = (q @ known.T).astype(np.float64)
            scores[ids[:, None] == known_ids[None]] = -np.inf
            if scores.shape[1] > k:
                reached = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            else:
                reached = np.full(len(q), -np.inf)
            length = np.sqrt((q * q).sum(1).astype(np.float64)) * (1 + 1e-9)
            ahead = reached[:, None] - (q @ centres.T)
            least = np.where(ahead <= 0, 0.0, ahead / np.maximum(length, 1e-300)[:, None]) * (1 - 1e-9)
            group = group_of[np.asarray(batch.column("cell"))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(group), pa.array(list(least), pa.list_(pa.float64()))],
                names=["id", "v", "grp", "least"],
            )

    grouped = stage(asked.mapInArrow(bounds, "id long, v array<long>, grp int, least array<double>"))
    sizes = {r["grp"]: r["n"] for r in grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = grouped.select("grp", F.posexplode("least").alias("cell", "least"))
    needs = cells.groupBy("grp", "cell").agg(F.min("least").alias("least")).collect()
    # One row per group and cell, and per group: their numbers are parameters.
    plan = F.broadcast(
        spark.createDataFrame(
            [(r["grp"], r["cell"], r["least"], -(-sizes[r["grp"]] // query_block)) for r in needs],
            "grp int, cell int, least double, q_blocks int",
        )
    )
    q_blocks = F.broadcast(
        spark.createDataFrame([(g, -(-n // query_block)) for g, n in sizes.items()], "grp int, q_blocks int")
    )
    d_blocks = -(-max(1, data.count()) // data_block)
    d_block = F.pmod(F.xxhash64("id"), F.lit(d_blocks)).cast("int")
    sent = needed_vectors(data, plan).select(
        "id", "v", "grp", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), d_block.alias("db")
    )
    q_block = F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")
    asking = grouped.join(q_blocks, "grp").select(
        "id", "v", "grp", q_block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("db")
    )

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            q, ids = _matrix(left.column("v").combine_chunks()), left.column("id").to_numpy()
            v, others = _matrix(right.column("v").combine_chunks()), right.column("id").to_numpy()
            for query, number in zip(q, ids.tolist()):
                scores = v @ query
                fit = others != number
                out += [(number, i, s) for s, i in _k_best(scores[fit], others[fit], k)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    by = ["grp", "qb", "db"]
    found = asking.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(
        solve, "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
