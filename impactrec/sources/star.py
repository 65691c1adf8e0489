"""A product table, and a score table, built from an order-processing star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _located(df: DataFrame, nation: DataFrame, region: DataFrame, nation_key: str) -> DataFrame:
    """Add the region name of each row's nation."""
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return df.join(places, F.col(nation_key) == F.col("n_nationkey")).drop("n_nationkey")


def product_table(spark: SparkSession, folder: str) -> DataFrame:
    """One product per part that has line items.

    Line items are reduced to one row per part (with map-side combine) before any join, so
    no join sees the fact table. Which sides are broadcast is left to Catalyst, which checks
    their size; AQE splits skewed partitions of the sort-merge joins.
    """
    part, lineitem, orders, customer, supplier, nation, region = (
        load_table(spark, folder, t)
        for t in ("part", "lineitem", "orders", "customer", "supplier", "nation", "region")
    )
    per_part = lineitem.groupBy("l_partkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.max("l_orderkey").alias("orderkey"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_quantity").alias("max_qty"),
        F.max("l_discount").alias("max_disc"),
        F.min("l_tax").alias("min_tax"),
    )
    makers = _located(supplier.select("s_suppkey", "s_nationkey"), nation, region, "s_nationkey").select(
        "s_suppkey", F.col("r_name").alias("made_in")
    )
    buyers = _located(
        customer.select("c_custkey", "c_nationkey", "c_mktsegment"), nation, region, "c_nationkey"
    ).select("c_custkey", "c_mktsegment", F.col("r_name").alias("used_in"))

    joined = (
        part.select("p_partkey", "p_type", "p_size")
        .join(per_part, F.col("p_partkey") == F.col("l_partkey"))
        .join(makers, F.col("suppkey") == F.col("s_suppkey"))
        .join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    )
    place = F.col("made_in")
    return joined.select(
        F.col("p_partkey").alias("ID"),
        F.lower("p_type").alias("Type"),
        ((F.lit(50) - F.col("p_size")).cast("double") / 50).alias("Cotton"),
        F.col("max_disc").alias("Organic_cotton"),
        (F.col("max_qty") / 50).alias("Polyester"),
        F.col("min_tax").alias("Elastane"),
        F.when(place.isin("AFRICA", "AMERICA", "ASIA", "EUROPE"), F.initcap(place))
        .when(F.col("p_partkey") % 2 == 0, "NaN")
        .alias("Manufacturing_location"),
        F.col("used_in").alias("Use_location"),
        _relabel(
            "o_orderpriority",
            {
                "1-URGENT": "Machine wash_ hot",
                "2-HIGH": "Machine wash_ warm",
                "3-MEDIUM": "Machine wash_ cold",
                "4-NOT SPECIFIED": "Hand wash",
            },
        ).otherwise("Dry clean").alias("Washing_instruction"),
        _relabel(
            "c_mktsegment",
            {
                "AUTOMOBILE": "Line dry",
                "BUILDING": "Dry clean",
                "FURNITURE": "Tumble dry_ low",
                "HOUSEHOLD": "Tumble dry_ medium",
            },
        ).alias("Drying_instruction"),
        (F.col("p_partkey") % 2).cast("int").alias("Material_label"),
        F.col("n_lines").cast("int").alias("Transporation_distance"),
        (F.floor((F.col("p_size") - 1) / 10).cast("int") + 1).alias("EI"),
    )


def _relabel(column: str, names: dict[str, str]) -> Column:
    (first, *rest) = names.items()
    expr = F.when(F.col(column) == first[0], first[1])
    for old, new in rest:
        expr = expr.when(F.col(column) == old, new)
    return expr


def noisy_products(products: DataFrame) -> DataFrame:
    """Move every tenth product one impact class up, so that no model can be perfect."""
    shifted = F.when(F.col("ID") % 10 == 0, 1).otherwise(0)
    return products.withColumn("EI", (1 + (F.col("EI") - 1 + shifted) % 5).cast("int"))


def score_table(products: DataFrame) -> DataFrame:
    """Scores per class from arithmetic on the key, exact in binary and full of ties."""

    def weight(factor: int, label: int) -> Column:
        bonus = F.when(F.col("EI") == label, 8).otherwise(0)
        return ((F.col("ID") * factor) % 11 + bonus).cast("double")

    weighted = products.select(
        "ID", "Type", "EI",
        weight(7, 1).alias("w1"), weight(5, 2).alias("w2"), weight(3, 4).alias("w4"), weight(2, 5).alias("w5"),
    )
    w1, w2, w4, w5 = (F.col(c) for c in ("w1", "w2", "w4", "w5"))
    best = (
        F.when(w1 >= F.greatest(w2, w4, w5), 1)
        .when(w2 >= F.greatest(w4, w5), 2)
        .when(w4 >= w5, 4)
        .otherwise(5)
        .cast("double")
    )
    slots = [F.lit(0.0), w1 / 64, w2 / 64, F.lit(0.0), w4 / 64, w5 / 64]
    return weighted.select("ID", "Type", "EI", F.array(*slots).alias("probability"), best.alias("prediction"))
