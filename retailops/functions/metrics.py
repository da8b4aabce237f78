"""Row-level money metrics (C10-C13). Division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_price(sales: str = "Sales", qty: str = "Quantity") -> Column:
    """round(Sales / Quantity, 2) in exact decimal arithmetic (half-up)."""
    return F.round(F.try_divide(F.col(sales).cast("decimal(18,2)"), F.col(qty).cast("decimal(10,0)")),
                   2).cast("decimal(18,2)")


def profit_margin_pct(profit: str = "Profit", sales: str = "Sales") -> Column:
    """round(Profit / Sales * 100, 2) in exact decimal arithmetic (half-up)."""
    return F.round(F.try_divide(F.col(profit).cast("decimal(18,2)") * 100, F.col(sales).cast("decimal(18,2)")),
                   2).cast("decimal(18,2)")


def is_profitable(profit: str = "Profit") -> Column:
    return F.coalesce((F.col(profit) > 0).cast("int"), F.lit(0))


def discounted_price(sales: str = "Sales", discount: str = "Discount") -> Column:
    # Sales is already net of discount; this discounts it again, as defined.
    one = F.lit(1).cast("decimal(4,2)")
    return F.round(F.col(sales).cast("decimal(18,2)") * (one - F.col(discount).cast("decimal(4,2)")),
                   2).cast("decimal(18,2)")


def with_row_metrics(df: DataFrame) -> DataFrame:
    """Unit_Price, Profit_Margin_Pct, Is_Profitable, Discounted_Price, guarded by presence."""
    cols = set(df.columns)
    new = {}
    if {"Sales", "Quantity"} <= cols:
        new["Unit_Price"] = unit_price()
    if {"Sales", "Profit"} <= cols:
        new["Profit_Margin_Pct"] = profit_margin_pct()
        new["Is_Profitable"] = is_profitable()
    if {"Sales", "Discount"} <= cols:
        new["Discounted_Price"] = discounted_price()
    return df.withColumns(new) if new else df
