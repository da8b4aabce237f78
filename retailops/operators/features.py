"""Feature engineering: calendar, row metrics, customer and product stats (C*, D01-D02, E42-E43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions.binning import sales_bucket
from ..functions.calendar import calendar_columns
from ..functions.metrics import with_row_metrics
from ..sources.schema import PERFORMANCE_LABELS, SEGMENT_LABELS
from ..session import bucket_count, bucketed_table, reliable_checkpoint
from .stats import attach_row, qcut


#: Parts of a product's or customer's orders (fixed value): tasks that share a hot one.
PARTS = 8
#: Column with the part, in rows that are bucketed by a key and its parts.
PART = "_part"


def _part() -> Column:
    return F.pmod(F.xxhash64("Order_ID"), F.lit(PARTS)).cast("int").alias(PART)


def _for_parts(df: DataFrame, stats: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """The statistics and the columns to join them on: for bucketed rows, once for each part of a key."""
    if PART not in df.columns:
        return stats, [key]
    return stats.withColumn(PART, F.explode(F.array(*[F.lit(i) for i in range(PARTS)]))), [key, PART]


def as_of_max_date(df: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    """One-row frame with the latest date of ``df`` (used as a repeatable 'today')."""
    return df.agg(F.max(date_col).alias("_as_of"))


def customer_stats(sales: DataFrame, as_of: Column | str | None = None,
                   materialize: bool = True) -> DataFrame:
    """Per-customer totals, tenure, recency and spend quartile segment.

    Partial aggregation happens map-side; a hot customer collapses before the
    shuffle. The customer-grain result is materialised once (reliable
    checkpoint) because the quartile edges and the reference date are read
    from it as well - otherwise every reader would recompute the fact-table
    aggregate. ``as_of`` is the reference date for recency: a 'yyyy-MM-dd'
    string, a column, ``"max"`` (the latest purchase in the data) or None
    (today). Rows bucketed by customer and part of the orders are not shuffled:
    each part collapses to one row where it lies, and only those are added up.
    """
    s = sales.filter(F.col("Customer_ID").isNotNull())
    if PART in s.columns:
        g = _customer_parts(s)
    else:
        g = s.groupBy("Customer_ID").agg(
            A.dsum("Sales").alias("Customer_Total_Spent"),
            F.countDistinct("Order_ID").alias("Customer_Total_Orders"),
            A.mean("Sales").alias("Customer_Avg_Order_Value"),
            A.dsum("Profit").alias("Customer_Total_Profit"),
            A.mean("Discount").alias("Customer_Avg_Discount"),
            F.min("Order_Date").alias("Customer_First_Purchase"),
            F.max("Order_Date").alias("Customer_Last_Purchase"),
        )
    if materialize:
        g = reliable_checkpoint(g)
    if isinstance(as_of, str) and as_of == "max":
        g = attach_row(g, g.agg(F.max("Customer_Last_Purchase").alias("_as_of")))
        ref = F.col("_as_of")
    elif as_of is None:
        ref = F.current_date()
    else:
        ref = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    g = g.withColumns({
        "Customer_Tenure_Days": F.datediff("Customer_Last_Purchase", "Customer_First_Purchase"),
        "Customer_Recency_Days": F.datediff(ref, F.col("Customer_Last_Purchase")),
    })
    g = g.drop("_as_of") if "_as_of" in g.columns else g
    return qcut(g, "Customer_Total_Spent", 4, "Customer_Segment", SEGMENT_LABELS)


def _customer_parts(s: DataFrame) -> DataFrame:
    """The aggregates of ``customer_stats`` by way of (customer, part of the orders)."""
    sums = {"_sales": "Sales", "_profit": "Profit", "_discount": "Discount"}
    counts = {"_n": "Sales", "_n_discount": "Discount"}
    parts = s.groupBy("Customer_ID", PART).agg(
        F.countDistinct("Order_ID").alias("_orders"), *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.count(c).alias(n) for n, c in counts.items()], F.min("Order_Date").alias("_first"), F.max("Order_Date").alias("_last"))
    kind = dict(parts.dtypes)  # the types of plain sums
    total = parts.groupBy("Customer_ID").agg(
        *[F.sum(n).cast(kind[n]).alias(n) for n in sums], *[F.sum(n).alias(n) for n in (*counts, "_orders")],
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    mean = lambda x, n: F.round(F.try_divide(F.col(x), F.col(n)), 6).cast("double")  # noqa: E731 - as A.mean
    return total.select(
        "Customer_ID", F.col("_sales").cast("double").alias("Customer_Total_Spent"), F.col("_orders").alias("Customer_Total_Orders"),
        mean("_sales", "_n").alias("Customer_Avg_Order_Value"), F.col("_profit").cast("double").alias("Customer_Total_Profit"),
        mean("_discount", "_n_discount").alias("Customer_Avg_Discount"),
        F.col("_first").alias("Customer_First_Purchase"), F.col("_last").alias("Customer_Last_Purchase"))


def product_stats(sales: DataFrame, materialize: bool = True) -> DataFrame:
    """Per-product totals and sales quartile performance label (E43); product grain materialised once.

    Rows are dealt once by product and part of its orders, where an order's rows
    meet and each part collapses to one row; the second shuffle adds up at most
    ``PARTS`` rows a product. So distinct orders need no row for each
    (product, order) in two shuffles, and a hot product is dealt to ``PARTS`` tasks.
    Rows bucketed that way are not dealt again.
    """
    s = sales.filter(F.col("Product_Name").isNotNull())
    narrow = ["Product_Name", "Order_ID", "Sales", "Profit", "Quantity"]
    s = s.select(*narrow, PART) if PART in s.columns else s.select(*narrow, _part()).repartition("Product_Name", PART)
    pairs = s.groupBy("Product_Name", "_part", "Order_ID").agg(
        F.sum("Sales").alias("_sales"), F.count("Sales").alias("_n"), F.sum("Profit").alias("_profit"), F.sum("Quantity").alias("_quantity"))
    parts = pairs.groupBy("Product_Name", "_part").agg(
        *[F.sum(c).alias(c) for c in ("_sales", "_n", "_profit", "_quantity")], F.count("Order_ID").alias("_orders"))
    money = "decimal(28,2)"  # the type of a sum of DECIMAL(18,2)
    g = parts.groupBy("Product_Name").agg(*[F.sum(c).alias(c) for c in ("_sales", "_n", "_profit", "_quantity", "_orders")]).select(
        "Product_Name", F.col("_sales").cast("double").alias("Product_Total_Sales"), F.col("_quantity").cast("bigint").alias("Product_Total_Quantity"),
        F.round(F.try_divide(F.col("_sales").cast(money), F.col("_n")), 6).cast("double").alias("Product_Avg_Price"),
        F.col("_profit").cast("double").alias("Product_Total_Profit"), F.col("_orders").alias("Product_Order_Count"))
    if materialize:
        g = reliable_checkpoint(g)
    return qcut(g, "Product_Total_Sales", 4, "Product_Performance", PERFORMANCE_LABELS)


def row_features(sales: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    """Calendar + row metrics + Sales_Bucket, one projection, guarded by presence."""
    df = sales
    if date_col in df.columns:
        df = df.withColumns(calendar_columns(date_col))
    df = with_row_metrics(df)
    if "Sales" in df.columns:
        df = df.withColumn("Sales_Bucket", sales_bucket("Sales"))
    return df


def attach_customer_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of customer stats on Customer_ID.

    Shuffle join on the key at scale; AQE turns it into a broadcast only when
    the stats side passes the runtime size check, and splits skewed keys. Bucketed
    rows stay where they lie; the stats come to each part of a key.
    """
    stats, on = _for_parts(df, stats, "Customer_ID")
    return df.join(stats, on, "left")


def attach_product_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of product stats on Product_Name (D02); bucketed rows as in D01."""
    stats, on = _for_parts(df, stats, "Product_Name")
    return df.join(stats, on, "left")


def features(sales: DataFrame, as_of: Column | str | None = None,
             customers: bool = True, products: bool = True) -> DataFrame:
    """Full feature table (up to 50 columns) from a canonical sales frame.

    The columns that follow from a row alone are added after the joins, so that
    the joined rows do not carry them; products, whose statistics are
    narrower, are joined first. With both statistics, the rows are never shuffled
    whole: they are written bucketed by product and part of its orders, joined there,
    and written once more bucketed by customer and part.
    """
    df, columns = sales, row_features(sales).columns
    customers = customers and "Customer_ID" in columns
    products = products and "Product_Name" in columns
    if customers and products:
        buckets = bucket_count(sales)
        df = bucketed_table(sales.withColumn(PART, _part()), "by_product", buckets, "Product_Name", PART)
    if products:
        by_product = product_stats(df)
        df = attach_product_stats(df, by_product)
    if customers and products:
        df = bucketed_table(df, "by_customer", buckets, "Customer_ID", PART)
    if customers:
        by_customer = customer_stats(df, as_of)
        df = attach_customer_stats(df, by_customer)
        columns = ["Customer_ID", *[c for c in columns if c != "Customer_ID"], *[c for c in by_customer.columns if c != "Customer_ID"]]
    if products:
        columns = ["Product_Name", *[c for c in columns if c != "Product_Name"], *[c for c in by_product.columns if c != "Product_Name"]]
    return row_features(df).select(*columns)
