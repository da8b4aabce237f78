"""Business-intelligence queries over the feature table.

SQL-origin semantics: NULL group keys are kept, money and percentages are
rounded half-up to 2 decimals, discounts to 3. Columns that the original
queries select bare next to the group key are taken with ``max``.
Top-k uses ``orderBy(...).limit(k)`` which plans as TakeOrderedAndProject
(per-partition top-k, then a k-row merge) - no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggs as A
from .grain import SEGMENT, customer_grain, segment_totals

S, P, N, C = "Sales", "Profit", "Order_ID", "Customer_ID"


def _r2sum(col: str):
    return A.dsum(col)  # sums of 2-decimal money are exact; rounding is a no-op


def _share(total_col: str, partition: list[str] | None = None):
    """ROUND(SUM(x) * 100 / SUM(SUM(x)) OVER (...), 2) on the grouped rows.

    The window runs after the aggregate, over group rows (bounded by the
    number of groups), never over fact rows.
    """
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return A.pct(F.col(total_col), F.sum(total_col).over(w))


def top_customers(df: DataFrame, limit: int = 10) -> DataFrame:
    """Customers by revenue (one row per customer; its segment is found at that grain
    where the rows do not have it)."""
    aggs = [
        F.max("Customer_Name").alias("Customer_Name"),
        _r2sum(S).alias("Total_Revenue"),
        _r2sum(P).alias("Total_Profit"),
        A.Distinct(N, "Order_Count"),
        A.mean(S, 2, 2).alias("Avg_Order_Value"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.isum("Quantity").alias("Total_Items"),
    ]
    if SEGMENT in df.columns:
        g = A.group_agg(df, [C], F.max(SEGMENT).alias(SEGMENT), *aggs)
    else:
        g = customer_grain(df, *aggs).drop("_s")
    names = [C, "Customer_Name", SEGMENT]
    g = g.select(*names, *[c for c in g.columns if c not in names])
    return g.orderBy(F.col("Total_Revenue").desc(), F.col(C).asc_nulls_last()).limit(limit)


def best_products(df: DataFrame, limit: int = 10) -> DataFrame:
    """Products by revenue."""
    g = A.group_agg(df, ["Product_Name"], 
        F.max("Category").alias("Category"),
        F.max("Sub_Category").alias("Sub_Category"),
        _r2sum(S).alias("Total_Revenue"),
        _r2sum(P).alias("Total_Profit"),
        A.Distinct(N, "Order_Count"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.mean("Discount", 2, 3).alias("Avg_Discount"),
        A.isum("Quantity").alias("Total_Units_Sold"),
    )
    return g.orderBy(F.col("Total_Revenue").desc(), F.col("Product_Name").asc_nulls_last()).limit(limit)


def profit_trends(df: DataFrame) -> DataFrame:
    """Monthly sales/profit/margin."""
    return (A.group_agg(df, ["Year_Month"], 
        F.max("Year").alias("Year"), F.max("Month").alias("Month"), F.max("Month_Name").alias("Month_Name"),
        _r2sum(S).alias("Total_Sales"), _r2sum(P).alias("Total_Profit"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.Distinct(N, "Order_Count"),
        A.mean("Discount", 2, 3).alias("Avg_Discount"))
        .orderBy("Year", "Month"))


def regional_analysis(df: DataFrame) -> DataFrame:
    """Region x country with share of total sales."""
    g = A.group_agg(df, ["Region", "Country"], 
        F.sum(S).alias("_s"), _r2sum(P).alias("Total_Profit"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.Distinct(N, "Order_Count"), A.Distinct(C, "Unique_Customers"),
        A.mean(S, 2, 2).alias("Avg_Order_Value"))
    g = g.withColumn("Sales_Share_Pct", _share("_s")).withColumn("Total_Sales", F.col("_s").cast("double"))
    return g.select("Region", "Country", "Total_Sales", "Total_Profit", "Avg_Profit_Margin", "Order_Count",
                    "Unique_Customers", "Avg_Order_Value", "Sales_Share_Pct").orderBy(F.col("Total_Sales").desc())


def monthly_analysis(df: DataFrame) -> DataFrame:
    """Year x month KPIs (name and quarter follow from the month; as group keys they
    keep text out of the aggregate's buffers, which would make it a sorted one)."""
    return (A.group_agg(df, ["Year", "Month", "Month_Name", "Quarter"],
        _r2sum(S).alias("Monthly_Revenue"), _r2sum(P).alias("Monthly_Profit"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.Distinct(N, "Order_Count"), A.Distinct(C, "Unique_Customers"),
        A.mean(S, 2, 2).alias("Avg_Order_Value"), A.mean("Discount", 2, 3).alias("Avg_Discount"),
        A.isum("Quantity").alias("Total_Units_Sold"))
        .orderBy("Year", "Month"))


def category_performance(df: DataFrame) -> DataFrame:
    """Category x sub-category with share within the category."""
    g = A.group_agg(df, ["Category", "Sub_Category"], 
        F.sum(S).alias("_s"), _r2sum(P).alias("Total_Profit"),
        A.Distinct(N, "Order_Count"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.mean("Discount", 2, 3).alias("Avg_Discount"), A.isum("Quantity").alias("Total_Units_Sold"))
    g = g.withColumn("Category_Share_Pct", _share("_s", ["Category"])).withColumn(
        "Total_Revenue", F.col("_s").cast("double"))
    return g.select("Category", "Sub_Category", "Total_Revenue", "Total_Profit", "Order_Count",
                    "Avg_Profit_Margin", "Avg_Discount", "Total_Units_Sold",
                    "Category_Share_Pct").orderBy(F.col("Total_Revenue").desc())


def customer_segment_analysis(df: DataFrame) -> DataFrame:
    """Segments; orders-per-customer is a row-weighted mean (as defined)."""
    g = segment_totals(df)
    g = g.select(SEGMENT, F.col("_customers").alias("Customer_Count"), F.col("_s").cast("double").alias("Total_Revenue"),
                 F.col("_p").cast("double").alias("Total_Profit"), A.ratio(F.col("_s"), F.col("_ns")).alias("Avg_Order_Value"),
                 A.ratio(F.col("_m"), F.col("_nm")).alias("Avg_Profit_Margin"),
                 A.half_up_ratio(F.col("_o"), F.col("_no"), 0, 1).alias("Avg_Orders_Per_Customer"),
                 _share("_s").alias("Revenue_Share_Pct"))
    return g.orderBy(F.col("Total_Revenue").desc())


def payment_mode_analysis(df: DataFrame) -> DataFrame:
    """Payment modes."""
    g = A.group_agg(df, ["Payment_Mode"], 
        A.Distinct(N, "Order_Count"), F.sum(S).alias("_s"),
        A.mean(S, 2, 2).alias("Avg_Order_Value"), _r2sum(P).alias("Total_Profit"))
    g = g.withColumn("Revenue_Share_Pct", _share("_s")).withColumn("Total_Revenue", F.col("_s").cast("double"))
    return g.select("Payment_Mode", "Order_Count", "Total_Revenue", "Avg_Order_Value", "Total_Profit",
                    "Revenue_Share_Pct").orderBy(F.col("Total_Revenue").desc())


def seasonal_analysis(df: DataFrame) -> DataFrame:
    """Season x year."""
    return (A.group_agg(df, ["Season", "Year"], 
        _r2sum(S).alias("Total_Sales"), _r2sum(P).alias("Total_Profit"),
        A.Distinct(N, "Order_Count"), A.mean(S, 2, 2).alias("Avg_Order_Value"))
        .orderBy("Year", "Season"))


def year_over_year_growth(df: DataFrame) -> DataFrame:
    """Yearly totals with LAG growth in percent (window over year rows)."""
    y = A.group_agg(df, ["Year"], F.sum(S).alias("_r"), F.sum(P).alias("_p"),
                               A.Distinct(N, "Order_Count"),
                               A.Distinct(C, "Customer_Count"))
    w = Window.orderBy("Year")  # one row per year: bounded by the calendar

    def growth(c: str):
        prev = F.lag(c).over(w)
        return A.pct(F.col(c) - prev, prev)

    return (y.select("Year", F.col("_r").cast("double").alias("Total_Revenue"),
                     growth("_r").alias("Revenue_Growth_Pct"),
                     F.col("_p").cast("double").alias("Total_Profit"),
                     growth("_p").alias("Profit_Growth_Pct"), "Order_Count", "Customer_Count")
             .orderBy("Year"))


def kpi_summary(df: DataFrame) -> DataFrame:
    """One-row KPI summary."""
    return A.group_agg(
        df, [], A.Distinct(N, "Total_Orders"), A.Distinct(C, "Total_Customers"),
        A.Distinct("Product_Name", "Total_Products"),
        _r2sum(S).alias("Total_Revenue"), _r2sum(P).alias("Total_Profit"),
        A.mean("Profit_Margin_Pct", 2, 2).alias("Avg_Profit_Margin"),
        A.mean(S, 2, 2).alias("Avg_Order_Value"), A.mean("Discount", 2, 3).alias("Avg_Discount"),
        A.isum("Quantity").alias("Total_Units_Sold"),
        A.half_up_ratio(F.sum(F.col("Quantity").cast("decimal(38,0)")), F.count("Quantity"), 0, 1)
        .alias("Avg_Items_Per_Order"))
