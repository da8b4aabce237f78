"""Aggregate first, label afterwards.

A customer's segment and a product's performance label are quartiles of the
totals of all customers or products. A query that groups by such a label does not
have to attach it to every row: the rows are aggregated once to the customer's or
product's grain, the quartile edges and labels are found there, and the groups are
merged from the labelled grain. The facts are scanned once and never copied; the
label join is at the size of the dimension.

The operators that use this take either rows that have the label already (the
feature table) or plain rows, whose label is then found here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..session import reliable_checkpoint
from ..sources.schema import PERFORMANCE_LABELS, SEGMENT_LABELS
from .stats import attach_row, qcut_index, quantile_row

SEGMENT, PERFORMANCE = "Customer_Segment", "Product_Performance"


def label_totals(totals: DataFrame, key: str, total: str, labels: list[str], out_col: str) -> DataFrame:
    """Quartile label of ``total`` (exact decimal) for each non-null ``key``; one row per key in, one out."""
    value = F.col(total).cast("double")
    edges = quantile_row(totals.filter(F.col(key).isNotNull()), {"_qedges": (value, [0.25, 0.5, 0.75])})
    index = F.when(F.col(key).isNotNull(), qcut_index(value, "_qedges"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), index.cast("int"))
    return attach_row(totals, edges).withColumn(out_col, F.when(index.isNotNull(), label)).drop("_qedges")


def merged(grain: DataFrame, name: str) -> Column:
    """Sum of a partial sum or count, in the partial's own type, so that the exact
    decimal arithmetic on it is that of a sum over rows."""
    return F.sum(name).cast(dict(grain.dtypes)[name]).alias(name)


def customer_grain(df: DataFrame, *aggs) -> DataFrame:
    """One row per customer (a null id is one, without a label) with ``aggs``, ``_s`` and the segment."""
    g = A.group_agg(df, ["Customer_ID"], F.sum("Sales").alias("_s"), *aggs)
    return label_totals(reliable_checkpoint(g), "Customer_ID", "_s", SEGMENT_LABELS, SEGMENT)


def labelled_groups(df: DataFrame, key: str, labels: list[str], out_col: str, by: list[str], *aggs) -> DataFrame:
    """``df`` grouped by (key, *by) with ``aggs``, and each key's label joined to its groups.

    Groups with a null key stay, without a label.
    """
    g = reliable_checkpoint(A.group_agg(df, [key, *by], F.sum("Sales").alias("_s"), *aggs))
    totals = g.filter(F.col(key).isNotNull()).groupBy(key).agg(merged(g, "_s"))
    named = label_totals(totals, key, "_s", labels, out_col).select(F.col(key).alias("_key"), out_col)
    return g.join(named, F.col(key) == F.col("_key"), "left").drop("_key")


def segment_totals(df: DataFrame) -> DataFrame:
    """Per segment (null: rows without one): customers, rows, and the sums and counts
    the segment tables are made of."""
    aggs = [F.sum("Profit").alias("_p"), F.count("Sales").alias("_ns"), F.sum("Profit_Margin_Pct").alias("_m"),
            F.count("Profit_Margin_Pct").alias("_nm"), F.count(F.lit(1)).alias("_rows")]
    if SEGMENT in df.columns:
        have = "Customer_Total_Orders" in df.columns
        orders = F.col("Customer_Total_Orders") if have else F.lit(None).cast("bigint")
        return A.group_agg(df, [SEGMENT], A.Distinct("Customer_ID", "_customers"), F.sum("Sales").alias("_s"), *aggs,
                           F.sum(orders.cast("decimal(38,0)")).alias("_o"), F.count(orders).alias("_no"))
    g = customer_grain(df, *aggs, A.Distinct("Order_ID", "_orders"))
    known = F.col("Customer_ID").isNotNull()  # a row counts its customer's orders
    return g.groupBy(SEGMENT).agg(
        F.count("Customer_ID").alias("_customers"), *[merged(g, c) for c in ("_s", "_p", "_ns", "_m", "_nm", "_rows")],
        F.sum(F.when(known, (F.col("_orders").cast("decimal(18,0)") * F.col("_rows")).cast("decimal(38,0)"))).alias("_o"),
        F.coalesce(F.sum(F.when(known, F.col("_rows"))), F.lit(0)).alias("_no"))


def product_groups(df: DataFrame, *aggs) -> DataFrame:
    """(Product_Name, Category, Sub_Category) groups with their performance label."""
    keys = ["Product_Name", "Category", "Sub_Category"]
    if PERFORMANCE in df.columns:
        return A.group_agg(df, [*keys, PERFORMANCE], F.sum("Sales").alias("_s"), *aggs)
    return labelled_groups(df, keys[0], PERFORMANCE_LABELS, PERFORMANCE, keys[1:], *aggs)
