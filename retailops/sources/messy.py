"""Deterministic "messy" variants of the provided tables for the cleaning operators.

Every row of the source table is kept; a fixed rule on the key decides
which values are blanked or garbled, so the same input can be stated in
plain SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# --- fixed values: which keys get a blank/garbled value ----------------------
NULL_PRICE_EVERY = 13      # numeric nulls
NULL_PRIORITY_FEW = 17     # ~6 % string nulls (mode fill)
NULL_PRIORITY_MANY = 3     # ~33 % string nulls ('Unknown' fill)
NULL_DATE_EVERY = 7        # date nulls (forward fill)
BAD_CURRENCY_EVERY = 11    # unparsable currency strings


def _every(n: int):
    return (F.col("o_orderkey") % n) == 0


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with blanked price, priority and date, plus currency strings."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return o.select(
        "o_orderkey",
        F.when(_every(NULL_PRICE_EVERY), F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(_every(NULL_PRIORITY_FEW), F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
         .alias("priority_few_nulls"),
        F.when(_every(NULL_PRIORITY_MANY), F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
         .alias("priority_many_nulls"),
        F.when(_every(NULL_DATE_EVERY), F.lit(None).cast("date")).otherwise(F.col("o_orderdate").cast("date"))
         .alias("order_date"),
        F.when(_every(BAD_CURRENCY_EVERY), F.lit("n/a"))
         .otherwise(F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2))).alias("price_text"),
    )


def orders_with_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their date as text in four formats by key, and one in five garbled."""
    o = read_table(spark, sf_dir, "orders")
    day, rest = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = (F.when(rest == 0, F.date_format(day, "yyyy-MM-dd")).when(rest == 1, F.date_format(day, "MM/dd/yyyy"))
            .when(rest == 2, F.date_format(day, "dd-MM-yyyy")).when(rest == 3, F.date_format(day, "yyyy/MM/dd"))
            .otherwise(F.lit("soon")))
    return o.select("o_orderkey", text.alias("Ship_Date"))
