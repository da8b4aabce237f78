"""Prepared inputs shared by the registered queries and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import features, row_features
from ..sources.tables import sales_from_star


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales rows from the provided star-schema tables."""
    return sales_from_star(spark, sf_dir)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales + calendar + row metrics (projection only, no extra shuffle)."""
    return row_features(sales(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table with the customer and product statistics; recency is relative to
    the latest order date so results are repeatable. ``features`` writes the joined
    sales rows as it reads them more than once."""
    return features(sales(spark, sf_dir), as_of="max")


def with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with customer statistics: the statistics have a narrow scan of their own, the
    rows keep their filters and column pruning, and no copy of the facts is made."""
    return features(sales(spark, sf_dir), as_of="max", products=False)
