import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from impactrec.functions import following_rows, running_totals
from impactrec.staging import stage, staged


def brute(rows, descending):
    groups = defaultdict(list)
    for g, v, p in rows:
        groups[g].append((v, p))
    out = {}
    for g, items in groups.items():
        total = 0
        for v, p in sorted(items, reverse=descending):
            total += p
            out[g, v] = total
    return out, {g: sum(p for _, p in items) for g, items in groups.items()}


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_against_brute_force(spark, ranges, descending):
    draw = random.Random(3)
    # One group holds most of the rows.
    rows = [("big", float(i), draw.randint(0, 9)) for i in range(3000)]
    rows += [(f"g{i % 50}", i / 7, draw.randint(0, 9)) for i in range(500)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double, p bigint").repartition(13)
    order = F.col("v").desc() if descending else F.col("v").asc()
    found = running_totals(table, ["g"], [order], ["p"], ranges=ranges).collect()
    cumulative, totals = brute(rows, descending)
    assert len(found) == len(rows)
    assert {(r.g, r.v): r.cum_p for r in found} == cumulative
    assert all(r.total_p == totals[r.g] for r in found)


def test_a_group_is_spread_over_ranges(spark):
    """No range, and so no task, holds a large group whole."""
    table = spark.range(10000).select(F.lit("one").alias("g"), "id", F.lit(1).cast("bigint").alias("p"))
    ranged = table.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 2500
    totals = running_totals(table, ["g"], [F.col("id")], ["p"], ranges=8)
    assert totals.where("cum_p != id + 1 OR total_p != 10000").count() == 0


def test_two_order_columns_and_null_values(spark):
    rows = [("a", None, 1, 5), ("a", 2.0, 1, 7), ("a", 2.0, 2, 1)]
    table = spark.createDataFrame(rows, "g string, v double, k int, p bigint")
    found = running_totals(table, ["g"], [F.col("v").desc(), F.col("k")], ["p"], ranges=3).collect()
    assert {(r.v, r.k): r.cum_p for r in found} == {(2.0, 1): 7, (2.0, 2): 8, (None, 1): 13}


def test_empty(spark):
    table = spark.createDataFrame([], "g string, v double, p bigint")
    assert running_totals(table, ["g"], [F.col("v")], ["p"]).collect() == []


def test_a_scope_deletes_its_own_tables(spark):
    outer = stage(spark.range(3))
    with staged(spark):
        inner = stage(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    assert outer.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_following_rows_across_ranges(spark):
    """Groups that go on over many ranges and batches, one of a third of the rows, and groups of one row."""
    draw = random.Random(6)
    rows = list({(draw.choice([0, 0, 1, 2, 3]), v): (draw.randint(0, 9), None if v % 5 == 0 else f"t{v}") for v in draw.sample(range(9000), 4000)}.items())
    rows = [(g, v, n, t) for (g, v), (n, t) in rows] + [(9, 1, 1, "alone")]
    table = spark.createDataFrame(rows, "g int, v int, n int, t string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = {(r.g, r.v): (r.n, r.next_n, r.next_t) for r in following_rows(table, ["g"], [F.desc("v")], ["n", "t"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) == len(rows)
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        for one, two in zip(ordered, [*ordered[1:], None]):
            assert found[one[:2]] == (one[2], two and two[2], two and two[3])
