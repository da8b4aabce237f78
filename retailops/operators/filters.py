"""Dashboard filters (B13): conjunctive, 'All' or empty means no filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_sales(df: DataFrame, years: list[int] | None = None, category: str = "All", region: str = "All",
                 segment: str = "All") -> DataFrame:
    """Year IN (...), Category =, Region =, Customer_Segment = - each optional.

    Plain predicates: Catalyst pushes the ones on stored columns into the
    Parquet scan (or prunes Year partitions of a table written by Year).
    """
    if years:
        df = df.filter(F.col("Year").isin(list(years)))
    if category and category != "All":
        df = df.filter(F.col("Category") == category)
    if region and region != "All":
        df = df.filter(F.col("Region") == region)
    if segment and segment != "All":
        df = df.filter(F.col("Customer_Segment") == segment)
    return df
