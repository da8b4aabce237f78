"""Binning and label-order expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import (DISCOUNT_ANALYSIS_EDGES, DISCOUNT_REPORT_EDGES,
                              SALES_BUCKET_EDGES, SALES_BUCKET_LABELS)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def interval_label(lo: str, hi: str) -> str:
    """Right-closed interval label, e.g. '(0.2, 0.3]'."""
    return f"({float(lo)!r}, {float(hi)!r}]"


def cut(col: str | Column, edges: list, labels: list[str] | None = None,
        exact: bool = False) -> Column:
    """Right-closed binning: value in (e[i], e[i+1]] -> labels[i]; outside -> null.

    ``exact=True`` compares as DECIMAL against the literal edges, so a value
    equal to an edge such as 0.3 lands in the bin it names instead of
    depending on binary floating point.
    """
    if labels is None:
        labels = [interval_label(str(edges[i]), str(edges[i + 1])) for i in range(len(edges) - 1)]
    if exact:
        v = _c(col).cast("decimal(20,6)")
        lits = [F.lit(Decimal(str(e))).cast("decimal(20,6)") for e in edges]
    else:
        v = _c(col).cast("double")
        lits = [F.lit(float(e)) for e in edges]
    expr = None
    for i, lab in enumerate(labels):
        cond = (v > lits[i]) & (v <= lits[i + 1])
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def sales_bucket(col: str | Column = "Sales") -> Column:
    """Sales_Bucket (C14): (0,50] Very Low ... (5000, inf] Premium; <=0 -> null."""
    return cut(col, SALES_BUCKET_EDGES, SALES_BUCKET_LABELS, exact=False)


def discount_analysis_bin(col: str | Column = "Discount") -> Column:
    """Discount_Range of the profit analysis (C15): 0.1-wide bins over (0, 0.7]."""
    return cut(col, DISCOUNT_ANALYSIS_EDGES, exact=True)


def discount_report_bin(col: str | Column = "Discount") -> Column:
    """Discount band of the PDF report."""
    return cut(col, DISCOUNT_REPORT_EDGES, exact=True)


def bin_labels(edges: list) -> list[str]:
    return [interval_label(str(edges[i]), str(edges[i + 1])) for i in range(len(edges) - 1)]


def label_rank(col: str | Column, order: list[str]) -> Column:
    """1-based position of a label in a fixed order; 0 when absent."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), _c(col)).cast("int")
