"""The sales fact derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (sale_date, store_id, product_id); a store is a nation, a product is a brand.

    Join sides carry only the columns they add, and no side is hinted: the dimension joins go broadcast or not by
    the size Spark measures, and a hot order or part key is split by the adaptive skew join. The grouping combines
    on the map side.
    """
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        F.col("l_shipdate").cast("date").alias("sale_date"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    places = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_nationkey", "r_name")
    )
    grouped = (
        lineitem
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("sale_date", "n_nationkey", "p_brand", "r_name")
        .agg(
            F.sum("l_orderkey").alias("order_sum"),
            F.count(F.lit(1)).alias("lines"),
            F.sum("l_quantity").alias("quantity"),
            F.min("p_retailprice").alias("retail"),
            F.max("l_discount").alias("max_discount"),
            F.max("urgent").alias("promotion"),
            F.min("l_partkey").alias("min_part"),
        )
    )
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    month = F.month("sale_date")
    price = F.col("retail") / 10
    return grouped.select(
        "sale_date",
        F.concat(F.lit("S"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")).alias("store_id"),
        F.col("p_brand").alias("product_id"),
        F.element_at(
            F.array(*map(F.lit, ("Groceries", "Toys", "Electronics", "Clothing", "Furniture"))), brand % 5 + 1
        ).alias("category"),
        F.col("r_name").alias("region"),
        (F.col("order_sum") % 500).cast("double").alias("inventory_level"),
        (F.col("lines") * 25).cast("double").alias("units_ordered"),
        (4 * F.col("quantity")).alias("units_sold"),
        price.alias("price"),
        F.round(F.col("max_discount") * 100).cast("double").alias("discount"),
        (price * (80 + 10 * (F.dayofmonth("sale_date") % 5)) / 100).alias("competitor_price"),
        "promotion",
        F.element_at(
            F.array(*map(F.lit, ("Sunny", "Rainy", "Cloudy", "Snowy"))), (F.col("min_part") % 4 + 1).cast("int")
        ).alias("weather"),
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .otherwise("Autumn")
        .alias("season"),
    )


def raw_requests(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """The sales fact as an upload would carry it: every field text, some of it missing, percent-marked or wrong.

    ``numbered`` adds a ``request_id`` of the fact's key.
    """
    fact = retail_fact(spark, sf_dir)
    day = F.dayofmonth("sale_date")
    text = {c: F.col(c).cast("string") for c in fact.columns}
    return fact.select(
        text["sale_date"].alias("sale_date"),
        F.when(day == 31, "NA").otherwise(text["store_id"]).alias("store_id"),
        F.when(day == 30, "").otherwise(text["product_id"]).alias("product_id"),
        F.when(day == 29, "Footwear").when(day == 28, "null").otherwise(text["category"]).alias("category"),
        F.when(day == 27, "abc").when(day == 26, "N/A").otherwise(text["price"]).alias("price"),
        F.when(day == 25, "NaN").when(day == 24, "12.7").otherwise(text["inventory_level"]).alias("inventory_level"),
        F.when(day == 23, "").otherwise(text["units_sold"]).alias("units_sold"),
        text["units_ordered"].alias("units_ordered"),
        F.when(day == 22, F.concat(text["discount"], F.lit("%")))
        .when(day == 21, "none")
        .otherwise(text["discount"])
        .alias("discount"),
        F.when(day == 20, "").otherwise(text["competitor_price"]).alias("competitor_price"),
        F.when(day == 19, "yes").when(day == 18, "on").when(day == 17, "Yes").otherwise(text["promotion"]).alias("promotion"),
        F.when(day == 16, "Monsoon").when(day == 15, "").otherwise(text["season"]).alias("season"),
        F.when(day == 14, "Hot").otherwise(text["weather"]).alias("weather"),
        F.initcap(text["region"]).alias("region"),
        *([F.concat_ws("|", "sale_date", "store_id", "product_id").alias("request_id")] if numbered else []),
    )
