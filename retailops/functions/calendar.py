"""Calendar parts of a date column (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DAY_ORDER, HOLIDAY_MONTHS, MONTH_NAMES, SEASON_BY_MONTH


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def season(month: str | Column) -> Column:
    """Meteorological season name of a month number (null month -> null)."""
    m = _c(month)
    expr = None
    for name in ("Winter", "Spring", "Summer", "Fall"):
        months = [k for k, v in SEASON_BY_MONTH.items() if v == name]
        expr = (F.when(m.isin(months), F.lit(name)) if expr is None
                else expr.when(m.isin(months), F.lit(name)))
    return expr


def flag(cond: Column) -> Column:
    """Boolean -> 1/0 integer, null -> 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def calendar_columns(date_col: str = "Order_Date") -> dict[str, Column]:
    """The 14 calendar feature columns derived from one date column."""
    d = F.col(date_col)
    day = F.dayofmonth(d)
    dow = F.weekday(d)  # Monday=0 .. Sunday=6
    month = F.month(d)
    return {
        "Year": F.year(d),
        "Month": month,
        "Month_Name": F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month),
        "Quarter": F.quarter(d),
        "Day": day,
        "Day_of_Week": dow,
        "Day_Name": F.element_at(F.array(*[F.lit(x) for x in DAY_ORDER]), dow + 1),
        "Week_of_Year": F.weekofyear(d),  # ISO-8601 week; null-safe
        "Is_Weekend": flag(dow >= 5),
        "Is_Month_Start": flag(day <= 7),
        "Is_Month_End": flag(day >= 21),
        "Year_Month": F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")),
        "Season": season(month),
        "Is_Holiday_Season": flag(month.isin(HOLIDAY_MONTHS)),
    }


def with_calendar(df: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    """Add calendar features (C01-C09) as one projection."""
    return df.withColumns(calendar_columns(date_col))


def ml_calendar_columns(date_col: str = "Order_Date") -> dict[str, Column]:
    """Calendar inputs of the boosted forecaster."""
    d = F.col(date_col)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "Day": F.dayofmonth(d),
        "DayOfWeek": F.weekday(d),
        "Quarter": F.quarter(d),
        "DayOfYear": F.dayofyear(d),
        "WeekOfYear": F.weekofyear(d),
        "IsMonthStart": flag(F.dayofmonth(d) <= 7),
        "IsMonthEnd": flag(F.dayofmonth(d) >= 21),
        "IsWeekend": flag(F.weekday(d) >= 5),
    }


def quarter_label(year: str | Column = "Year", quarter: str | Column = "Quarter") -> Column:
    """'2024-Q1' style label (C17)."""
    return F.concat(_c(year).cast("string"), F.lit("-Q"), _c(quarter).cast("string"))
