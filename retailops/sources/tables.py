"""Star-schema test tables and the adapter to the canonical ``sales`` frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one provided table; projection and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales rows from lineitem/orders/customer/nation/region/part.

    One row per lineitem. Money is DECIMAL(18,2) so every sum is exact.
    ``nation`` (25 rows) and ``region`` (5 rows) have a fixed size by the
    schema's definition and are broadcast; the customer and part joins are
    left to AQE, which broadcasts them only when the runtime size check
    (``autoBroadcastJoinThreshold``) passes and sort-merges them otherwise.
    Customers are joined to the orders, so that lineitem rows are never dealt by
    customer. The big lineitem-orders join shuffles both sides on the order key.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cu = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rg = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")

    geo = na.join(F.broadcast(rg), na.n_regionkey == rg.r_regionkey)
    cust = cu.join(F.broadcast(geo), cu.c_nationkey == geo.n_nationkey)

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc8 = F.lit(8) * F.col("l_discount").cast("decimal(4,2)")
    placed = od.join(cust, od.o_custkey == cu.c_custkey)
    joined = (li.join(placed, li.l_orderkey == od.o_orderkey)
                .join(pa, F.col("l_partkey") == F.col("p_partkey")))
    return joined.select(
        F.col("l_orderkey").cast("string").alias("Order_ID"),
        F.col("c_name").alias("Customer_Name"),
        F.col("c_custkey").cast("string").alias("Customer_ID"),
        F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("Product_Name"),
        F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Sub_Category"),
        F.round(price * (F.lit(1) - disc8), 2).cast("decimal(18,2)").alias("Sales"),
        F.round(price * (F.lit(0.45).cast("decimal(4,2)") - disc8), 2).cast("decimal(18,2)").alias("Profit"),
        disc8.cast("decimal(4,2)").alias("Discount"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("o_orderdate").cast("date").alias("Order_Date"),
        F.col("r_name").alias("Region"),
        F.col("n_name").alias("Country"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("State"),
        F.col("o_orderpriority").alias("Payment_Mode"),
    )
