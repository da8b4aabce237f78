"""Display-string expressions (C18-C20), evaluated JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_currency(col: str | Column) -> Column:
    """$1.23M / $4.6K / $123.45 by magnitude (sign kept)."""
    x = _c(col).cast("double")
    a = F.abs(x)
    return (F.when(a >= 1_000_000, F.concat(F.lit("$"), F.format_string("%.2f", x / 1_000_000), F.lit("M")))
             .when(a >= 1_000, F.concat(F.lit("$"), F.format_string("%.1f", x / 1_000), F.lit("K")))
             .otherwise(F.concat(F.lit("$"), F.format_number(x, 2))))


def format_money(col: str | Column, decimals: int = 2) -> Column:
    """'$1,234.56' (or '$1,235' with decimals=0)."""
    return F.concat(F.lit("$"), F.format_number(_c(col).cast("double"), decimals))


def format_percent(col: str | Column, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", _c(col).cast("double")), F.lit("%"))


def format_fixed(col: str | Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f", _c(col).cast("double"))


def truncate_label(col: str | Column, n: int = 20, always: bool = True) -> Column:
    """First ``n`` characters + '...'; with ``always=False`` only when longer."""
    s = _c(col)
    cut = F.concat(F.substring(s, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(s) > n, cut).otherwise(s)
