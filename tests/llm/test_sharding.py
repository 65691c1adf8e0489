import random

import pytest
from pyspark.sql import functions as F

from impactrec.llm.sharding import Treap, best_fit_decreasing, by_parts, even_packing, pack, rounded_up, rounded_up_column, shard_documents


def plain_best_fit(sizes, capacity):
    """Best fit decreasing over single groups, with a list of bins."""
    room, out = [], []
    for size in sorted((s for s, n in sizes for _ in range(n)), reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size] if size <= capacity else []
        if fits:
            _, i = min(fits)
        else:
            room.append(max(capacity, size))
            i = len(room) - 1
        room[i] -= size
        if size > capacity:
            room[i] = -1
        out.append((size, i))
    return len(room), out


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [(s, rng.randint(1, 9)) for s in rng.sample(range(1, 200), rng.randint(1, 30))]
    packing = best_fit_decreasing(sizes, 150)
    bins, placed = plain_best_fit(sizes, 150)
    assert packing.bins == bins
    assert [(s, b) for s, first, last, b in packing.runs for _ in range(first, last + 1)] == placed


def test_treap_finds_the_tightest():
    rng, tree, kept = random.Random(3), Treap(), set()
    for _ in range(2000):
        key = (rng.randint(0, 99), rng.randint(0, 99))
        if key in kept:
            tree.remove(key)
            kept.remove(key)
        else:
            tree.insert(key)
            kept.add(key)
        ask = (rng.randint(0, 110), -1)
        assert tree.ceiling(ask) == min((k for k in kept if k >= ask), default=None)


def test_even_packing_keeps_the_number_of_bins():
    packing = even_packing([(10, 95), (300, 1), (1, 40)], 10)
    assert packing.bins <= 10 and packing.capacity <= 115


def test_rounding(spark):
    values = [1, 4095, 4096, 4097, 9999, 123_456_789, 10**15 + 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(rounded_up_column(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == [rounded_up(v) for v in values]
    assert all(v <= rounded_up(v) <= v * 1.0005 for v in values)


def test_documents_keep_copies_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 10_000))
    out = shard_documents(docs, 40).toPandas()
    assert len(out) == docs.count()
    assert set(out["shard"]) <= set(range(40))
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 40 and loads.max() < 1.01 * loads.mean()
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_capacity_is_kept(spark):
    groups = spark.createDataFrame([(f"g{i}", 1 + i % 50) for i in range(500)], "g string, bytes long")
    out = pack(groups, ["g"], "bytes", capacity=100).join(groups, "g").groupBy("shard").agg(F.sum("bytes").alias("b"))
    loads = [r["b"] for r in out.collect()]
    assert max(loads) <= 100 and len(loads) <= 1 + sum(loads) / 99


def test_many_bins_are_few_ranges():
    packing = best_fit_decreasing([(60, 10**9), (30, 10**9 + 7), (7, 5)], 100)
    assert packing.bins == 10**9 + 3 and len(packing.ranges) < 10
    placed = {size: sorted((first, last) for s, first, last, *_ in packing.ranges if s == size) for size in (60, 30, 7)}
    for size, groups in ((60, 10**9), (30, 10**9 + 7), (7, 5)):
        assert placed[size][0][0] == 0 and placed[size][-1][1] == groups - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(placed[size], placed[size][1:]))


@pytest.mark.parametrize("seed", range(5))
def test_parts_lead_to_the_range_of_every_rank(seed):
    rng = random.Random(seed)
    sizes = [(s, rng.randint(1, 60)) for s in rng.sample(range(1, 200), 30)]
    packing = best_fit_decreasing(sizes, 250)
    widths, rows = by_parts(packing.ranges)
    width, wanted = dict(widths), {(s, k): b for s, first, last, b in packing.runs for k in range(first, last + 1)}
    assert len(rows) <= 3 * len(packing.ranges)
    for (size, rank), number in wanted.items():
        met = [r for r in rows if r[0] == size and r[1] == rank // width[size] and r[2] <= rank <= r[3]]
        assert [r[4] + (rank - r[2]) // r[5] for r in met] == [number]


def test_many_equal_groups_of_a_shard_each(spark):
    """Group columns may be named as those used inside."""
    groups = spark.range(50_000).select(F.col("id").alias("class"), F.lit(60).cast("long").alias("one"))
    out = pack(groups, ["class"], "one", capacity=100)
    assert out.columns == ["class", "shard"]
    assert out.agg(F.count("*"), F.countDistinct("shard"), F.min("shard"), F.max("shard")).first() == (50_000, 50_000, 0, 49_999)


def test_no_groups(spark):
    nothing = spark.createDataFrame([], "g string, bytes long")
    assert pack(nothing, ["g"], "bytes", capacity=100).collect() == []
