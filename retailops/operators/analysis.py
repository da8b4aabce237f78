"""Analysis result tables over the feature table.

pandas-origin semantics: rows with a null group key are dropped, means are
exact and rounded half-up to 6 decimals (2 for displayed money), sums are
exact decimals. Categorical counts keep labels with zero rows by joining
the data onto a small label list (labels x data, never the reverse).
Windows run only over grouped rows (days, months, groups), never over fact
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions.binning import bin_labels, discount_analysis_bin, discount_report_bin, label_rank
from ..functions.formatting import format_fixed, format_money, format_percent
from ..sources.schema import (DAY_ORDER, DISCOUNT_ANALYSIS_EDGES, DISCOUNT_REPORT_EDGES,
                              PERFORMANCE_LABELS, SALES_BUCKET_LABELS, SEGMENT_LABELS)
from ..session import reliable_checkpoint
from .grain import PERFORMANCE, SEGMENT, label_totals, labelled_groups, product_groups, segment_totals
from .stats import attach_row, global_row_number

S, P, N, C = "Sales", "Profit", "Order_ID", "Customer_ID"


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


def _g(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    return A.group_agg(_keyed(df, keys), keys, *aggs)


def ssum(name: str = "Total_Sales") -> Column:
    return A.dsum(S).alias(name)


def psum(name: str = "Total_Profit") -> Column:
    return A.dsum(P).alias(name)


def orders(name: str = "Order_Count") -> A.Distinct:
    return A.Distinct(N, name)


def customers(name: str = "Customer_Count") -> A.Distinct:
    return A.Distinct(C, name)


def avg(col: str, name: str, out_scale: int = 6) -> Column:
    return A.mean(col, 2, out_scale).alias(name)


def margin(name: str = "Avg_Margin") -> Column:
    return avg("Profit_Margin_Pct", name)


def _labels_frame(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    """Label list with its position, as a tiny frame built on the executors."""
    return (df.sparkSession.range(1)
            .select(F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("_pos", name)))


def _row_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("Count"))


def _counts_with_labels(counts: DataFrame, col: str, labels: list[str], out_key: str,
                        order: str = "count") -> DataFrame:
    """(label, Count) for every label of the list, from the ``Count`` of each value of ``col``."""
    counts = counts.filter(F.col(col).isNotNull()).select(col, "Count")
    lab = _labels_frame(counts, labels, out_key)
    out = (lab.join(F.broadcast(counts.withColumnRenamed(col, out_key)), out_key, "left")
              .select(out_key, F.coalesce("Count", F.lit(0)).cast("long").alias("Count"), "_pos"))
    if order == "count":
        return out.orderBy(F.col("Count").desc(), "_pos").drop("_pos")
    return out.orderBy("_pos").drop("_pos")


# --- sales trends --------------------------------------------------------------

def daily_sales(df: DataFrame) -> DataFrame:
    """E12."""
    return _g(df, ["Order_Date"], ssum(), psum(), orders()).orderBy("Order_Date")


def monthly_trends(df: DataFrame) -> DataFrame:
    """E13."""
    return _g(df, ["Year_Month"], ssum(), psum(), avg(S, "Avg_Order_Value"), orders(),
              customers()).orderBy("Year_Month")


def quarterly_trends(df: DataFrame) -> DataFrame:
    """E14."""
    return _g(df, ["Year", "Quarter"], ssum(), psum(), orders()).orderBy("Year", "Quarter")


def _pct_change(c: str, order: str) -> Column:
    prev = F.lag(F.col(c)).over(Window.orderBy(order))
    return A.pct(F.col(c) - prev, prev, 2, 6)


def yearly_analysis(df: DataFrame) -> DataFrame:
    """Yearly totals with percent change (window over year rows)."""
    y = _g(df, ["Year"], F.sum(S).alias("_s"), F.sum(P).alias("_p"))
    return y.select("Year", F.col("_s").cast("double").alias("Total_Sales"),
                    F.col("_p").cast("double").alias("Total_Profit"),
                    _pct_change("_s", "Year").alias("Sales_Growth"),
                    _pct_change("_p", "Year").alias("Profit_Growth")).orderBy("Year")


def day_of_week_analysis(df: DataFrame) -> DataFrame:
    """Ordered Monday..Sunday; Day_Order is 0-based."""
    g = _g(df, ["Day_Name"], ssum(), orders(), avg(S, "Avg_Sales"))
    return (g.withColumn("Day_Order", label_rank("Day_Name", DAY_ORDER) - 1)
             .orderBy("Day_Order"))


def seasonal_summary(df: DataFrame) -> DataFrame:
    """E17."""
    return _g(df, ["Season"], ssum(), psum(), orders()).orderBy("Season")


# --- customers -----------------------------------------------------------------

def customer_profiles(df: DataFrame, with_rfm: bool = True) -> DataFrame:
    """E18 (+E44/E45): per-customer profile with RFM scores and CLV.

    Observed (Customer_ID, Customer_Name, Customer_Segment) combinations only.
    Recency is measured from the latest order date of the input (one
    broadcast row). R uses quantile bins of recency; F and M use the
    'first'-rank quantile score computed without a single-partition window.
    """
    from .stats import qcut_index, quantile_row, rank_score
    keys = ["Customer_ID", "Customer_Name", SEGMENT]
    aggs = [A.dsum(S).alias("Total_Spent"), psum(), orders(), avg(S, "Avg_Order_Value"),
            A.isum("Quantity").alias("Total_Quantity"), avg("Discount", "Avg_Discount"),
            F.min("Order_Date").alias("First_Purchase"), F.max("Order_Date").alias("Last_Purchase"),
            F.coalesce(F.mode("Category", True), F.lit("N/A")).alias("Preferred_Category"),
            F.coalesce(F.mode("Region", True), F.lit("N/A")).alias("Preferred_Region")]
    if SEGMENT in df.columns:
        g, latest = _g(df, keys, *aggs), df.agg(F.max("Order_Date").alias("_max_date"))
    else:  # one pass over the rows; the segment is found at the customers' grain
        g = labelled_groups(df, keys[0], SEGMENT_LABELS, SEGMENT, keys[1:2], *aggs)
        latest = g.agg(F.max("Last_Purchase").alias("_max_date"))
        g = _keyed(g, keys).select(*keys, *[c for c in g.columns if c not in (*keys, "_s")])
    g = attach_row(g, latest)
    if with_rfm:
        # customer grain, reused by the quantile and both rank passes: materialise once
        g = reliable_checkpoint(g)
    g = g.withColumns({
        "Recency_Days": F.datediff("_max_date", "Last_Purchase"),
        "Frequency": F.col("Order_Count"),
        "Monetary": F.col("Total_Spent"),
    }).drop("_max_date")
    if not with_rfm:
        return g
    tie = F.concat_ws("\u0001", *[F.coalesce(F.col(k), F.lit("")) for k in keys])
    g = g.withColumn("_tie", tie)
    edges = quantile_row(g, {"_redges": ("Recency_Days", [0.2, 0.4, 0.6, 0.8])})
    g = attach_row(g, edges).withColumn("R_Score", (F.lit(6) - qcut_index("Recency_Days", "_redges")).cast("int"))
    g = g.drop("_redges")
    g = rank_score(g, "Frequency", "_tie", 5, "F_Score")
    g = rank_score(g, "Monetary", "_tie", 5, "M_Score")
    g = g.withColumn("RFM_Score", (F.coalesce("R_Score", F.lit(0)) + F.coalesce("F_Score", F.lit(0))
                                   + F.coalesce("M_Score", F.lit(0))).cast("int"))
    g = g.withColumn("CLV", F.col("Avg_Order_Value") * F.col("Order_Count"))
    return g.drop("_tie")


def top_customer_profiles(df: DataFrame, k: int = 10) -> DataFrame:
    """Top-k customer profiles by spend."""
    return customer_profiles(df, with_rfm=False).orderBy(F.col("Total_Spent").desc(), "Customer_ID").limit(k)


def rfm_table(df: DataFrame) -> DataFrame:
    """E44."""
    return customer_profiles(df).select("Customer_ID", "Customer_Name", "Recency_Days", "Frequency", "Monetary",
                                        "R_Score", "F_Score", "M_Score", "RFM_Score")


def clv(df: DataFrame) -> DataFrame:
    """Avg_Order_Value x Order_Count per customer."""
    g = _g(df, ["Customer_ID"], avg(S, "Avg_Order_Value"), orders())
    return g.select("Customer_ID", (F.col("Avg_Order_Value") * F.col("Order_Count")).alias("CLV"))


def segment_distribution(df: DataFrame) -> DataFrame:
    """Rows per segment (zero-count labels kept)."""
    return _counts_with_labels(_segment_rows(df), SEGMENT, SEGMENT_LABELS, "Segment")


def _segment_rows(df: DataFrame) -> DataFrame:
    return segment_totals(df).select(SEGMENT, F.col("_rows").alias("Count"))


# --- regions -----------------------------------------------------------------

def region_performance(df: DataFrame) -> DataFrame:
    """E20."""
    return _g(df, ["Region", "Country", "State"], ssum(), psum(), orders(), customers(),
              avg(S, "Avg_Order_Value"), margin("Avg_Profit_Margin"),
              A.isum("Quantity").alias("Total_Quantity")).orderBy(F.col("Total_Sales").desc(), "State")


def region_monthly(df: DataFrame) -> DataFrame:
    """E21."""
    return _g(df, ["Region", "Year_Month"], ssum(), psum()).orderBy("Region", "Year_Month")


def region_profitability(df: DataFrame) -> DataFrame:
    """E22."""
    g = _g(df, ["Region"], F.sum(S).alias("_s"), F.sum(P).alias("_p"), margin(), orders("Total_Orders"))
    return g.select("Region", F.col("_s").cast("double").alias("Total_Sales"),
                    F.col("_p").cast("double").alias("Total_Profit"), "Avg_Margin", "Total_Orders",
                    A.pct(F.col("_p"), F.col("_s"), 2, 6).alias("Profit_Ratio")).orderBy("Region")


def top_states(df: DataFrame, k: int = 10) -> DataFrame:
    """E23."""
    return _g(df, ["State"], ssum(), psum()).orderBy(F.col("Total_Sales").desc(), "State").limit(k)


def region_rollup(df: DataFrame) -> DataFrame:
    """Region totals rolled up from the state-level table; margin is a mean of means."""
    st = _g(df, ["Region", "Country", "State"], F.sum(S).alias("_s"), F.sum(P).alias("_p"), orders(),
            customers(), A.mean("Profit_Margin_Pct", 2, 6).alias("_m"))
    return (st.groupBy("Region").agg(
        A.dsum("_s").alias("Total_Sales"), A.dsum("_p").alias("Total_Profit"),
        A.isum("Order_Count").alias("Order_Count"), A.isum("Customer_Count").alias("Customer_Count"),
        A.mean(F.col("_m").cast("decimal(24,6)"), 6, 6).alias("Avg_Margin")).orderBy("Region"))


# --- products ---------------------------------------------------------------

def product_performance(df: DataFrame) -> DataFrame:
    """E24."""
    keys = ["Product_Name", "Category", "Sub_Category", PERFORMANCE]
    g = product_groups(df, ssum(), psum(), orders(), avg(S, "Avg_Price"), margin("Avg_Profit_Margin"),
                       A.isum("Quantity").alias("Total_Quantity"), avg("Discount", "Avg_Discount"))
    return _keyed(g, keys).select(*keys, *[c for c in g.columns if c not in (*keys, "_s")]
                                  ).orderBy(F.col("Total_Sales").desc(), "Product_Name")


def top_products(df: DataFrame, k: int = 15) -> DataFrame:
    """H01 on E24."""
    return product_performance(df).orderBy(F.col("Total_Sales").desc(), "Product_Name").limit(k)


def category_summary(df: DataFrame) -> DataFrame:
    """E25."""
    return _g(df, ["Category", "Sub_Category"], ssum(), psum(),
              A.Distinct("Product_Name", "Product_Count"), orders(), margin()
              ).orderBy(F.col("Total_Sales").desc())


def performance_distribution(df: DataFrame) -> DataFrame:
    """E26."""
    g = product_groups(df, F.count(F.lit(1)).alias("_rows"))
    counts = g.groupBy(PERFORMANCE).agg(F.sum("_rows").alias("Count"))
    return _counts_with_labels(counts, PERFORMANCE, PERFORMANCE_LABELS, "Performance")


# --- profit -------------------------------------------------------------------

def profit_by_category(df: DataFrame) -> DataFrame:
    """E27."""
    return _g(df, ["Category"], psum(), ssum(), margin(), orders()).orderBy(F.col("Total_Profit").desc())


def _binned(df: DataFrame, bin_expr: Column, labels: list[str], aggs: list[Column],
            fills: dict[str, Column]) -> DataFrame:
    binned = df.withColumn("Discount_Range", bin_expr).filter(F.col("Discount_Range").isNotNull())
    g = A.group_agg(binned, ["Discount_Range"], *aggs)
    lab = _labels_frame(df, labels, "Discount_Range")
    out = lab.join(F.broadcast(g), "Discount_Range", "left")
    return out.withColumns(fills).orderBy("_pos").drop("_pos")


def profit_discount_analysis(df: DataFrame) -> DataFrame:
    """0.1-wide discount bins; empty bins kept with zero sums and null mean."""
    return _binned(df, discount_analysis_bin("Discount"), bin_labels(DISCOUNT_ANALYSIS_EDGES),
                   [psum(), ssum(), orders(), margin()],
                   {"Total_Profit": F.coalesce("Total_Profit", F.lit(0.0)),
                    "Total_Sales": F.coalesce("Total_Sales", F.lit(0.0)),
                    "Order_Count": F.coalesce("Order_Count", F.lit(0)).cast("long")})


def monthly_profit_trends(df: DataFrame) -> DataFrame:
    """E29."""
    return _g(df, ["Year_Month"], psum(), ssum(), margin()).orderBy("Year_Month")


def most_profitable_products(df: DataFrame, k: int = 10) -> DataFrame:
    """E30."""
    return _g(df, ["Product_Name"], psum(), ssum(), margin()).orderBy(
        F.col("Total_Profit").desc(), "Product_Name").limit(k)


def loss_making_products(df: DataFrame) -> DataFrame:
    """HAVING Total_Profit < 0."""
    return _g(df, ["Product_Name"], psum(), ssum()).filter(F.col("Total_Profit") < 0).orderBy(
        "Total_Profit", "Product_Name")


# --- categories --------------------------------------------------------------

def category_stats(df: DataFrame) -> DataFrame:
    """E32 with market share over the category rows."""
    g = _g(df, ["Category"], F.sum(S).alias("_s"), psum(), orders(),
           A.Distinct("Product_Name", "Product_Count"), customers(),
           avg(S, "Avg_Order_Value"), margin(), avg("Discount", "Avg_Discount"),
           A.isum("Quantity").alias("Total_Quantity"))
    share = A.pct(F.col("_s"), F.sum("_s").over(Window.partitionBy()), 2, 2)
    return (g.withColumn("Market_Share_Pct", share).withColumn("Total_Sales", F.col("_s").cast("double"))
             .drop("_s").orderBy(F.col("Total_Sales").desc()))


def subcategory_stats(df: DataFrame) -> DataFrame:
    """E33."""
    return _g(df, ["Category", "Sub_Category"], ssum(), psum(), orders(), margin()).orderBy(
        F.col("Category").asc(), F.col("Total_Sales").desc())


def category_trends(df: DataFrame) -> DataFrame:
    """E34."""
    return _g(df, ["Year_Month", "Category"], ssum()).orderBy("Year_Month", "Category")


def category_region(df: DataFrame) -> DataFrame:
    """E35."""
    return _g(df, ["Category", "Region"], ssum(), psum()).orderBy(F.col("Category").asc(),
                                                                  F.col("Total_Sales").desc())


def category_month_sales(df: DataFrame) -> DataFrame:
    """(Category, Year_Month, Sales) for every category and every month with a
    sale, 0 where a category has none; the wide form is ``category_month_pivot``."""
    cells = _keyed(df, ["Category", "Year_Month"]).groupBy("Category", "Year_Month").agg(F.sum(S).alias("_s"))
    grid = cells.select("Category").distinct().crossJoin(cells.select("Year_Month").distinct())  # categories x months
    return (grid.join(cells, ["Category", "Year_Month"], "left")
                .select("Category", "Year_Month", F.coalesce(F.col("_s").cast("double"), F.lit(0.0)).alias("Sales"))
                .orderBy("Category", "Year_Month"))


def category_month_pivot(df: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Category x Year_Month sales, missing cells 0.

    Column per month named ``m_YYYY_MM``. Pass ``months`` to skip the
    distinct-month job; otherwise the month list (bounded by the calendar)
    is read first.
    """
    src = _keyed(df, ["Category", "Year_Month"])
    if months is None:
        months = [r[0] for r in src.select("Year_Month").distinct().orderBy("Year_Month").collect()]
    p = src.groupBy("Category").pivot("Year_Month", months).agg(F.sum(S))
    return p.select("Category", *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("m_" + m.replace("-", "_"))
                                  for m in months]).orderBy("Category")


# --- revenue -----------------------------------------------------------------

def monthly_revenue(df: DataFrame) -> DataFrame:
    """E36."""
    return _g(df, ["Year_Month"], ssum("Revenue"), psum("Profit"), orders("Orders")).orderBy("Year_Month")


def revenue_by_payment(df: DataFrame) -> DataFrame:
    """E37."""
    return _g(df, ["Payment_Mode"], ssum("Revenue"), orders("Orders")).orderBy(F.col("Revenue").desc())


def _segments(df: DataFrame) -> DataFrame:
    return segment_totals(df).filter(F.col(SEGMENT).isNotNull())


def revenue_by_segment(df: DataFrame) -> DataFrame:
    """E38."""
    return _segments(df).select(SEGMENT, F.col("_s").cast("double").alias("Revenue"), F.col("_customers").alias("Customers"),
                                A.ratio(F.col("_s"), F.col("_ns"), 2, 6).alias("Avg_Revenue")).orderBy(F.col("Revenue").desc())


def revenue_distribution(df: DataFrame) -> DataFrame:
    """Rows per Sales_Bucket, zero-count buckets kept."""
    return _counts_with_labels(_row_counts(df, "Sales_Bucket"), "Sales_Bucket", SALES_BUCKET_LABELS, "Bucket")


def daily_revenue_trend(df: DataFrame, window: int = 7) -> DataFrame:
    """E40 (G08, G09): daily revenue, running total and trailing mean.

    The windows run over the daily aggregate (one row per date, bounded by
    the calendar span), not over fact rows.
    """
    d = _g(df, ["Order_Date"], F.sum(S).alias("_r"))
    run = Window.orderBy("Order_Date").rowsBetween(Window.unboundedPreceding, 0)
    roll = Window.orderBy("Order_Date").rowsBetween(-(window - 1), 0)
    mov = A.half_up_ratio(A.units(F.sum("_r").over(roll), 2), F.lit(window), 2, 6)
    return d.select("Order_Date", F.col("_r").cast("double").alias("Daily_Revenue"),
                    F.sum("_r").over(run).cast("double").alias("Cumulative_Revenue"),
                    F.when(F.count("_r").over(roll) >= window, mov).alias(f"Moving_Avg_{window}d")
                    ).orderBy("Order_Date")


# --- KPIs ----------------------------------------------------------------------

def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def generate_kpis(df: DataFrame) -> DataFrame:
    """22 KPIs in one row, from two passes over the rows.

    One feeds the daily sums (all other sums are read from those), the other the
    distinct orders, customers, products and (order, product) pairs; products per
    order is pairs / orders.
    """
    pair = F.when(F.col(N).isNotNull() & F.col("Product_Name").isNotNull(), F.concat_ws("\u0001", N, "Product_Name"))
    sales_inputs = {"s": F.col(S), "p": F.col(P), "d": F.col("Discount"), "sd": F.col(S) * F.col("Discount"), "q": F.col("Quantity")}
    g = A.group_parts(
        df, [A.Part("day", F.col("Order_Date"), inputs=tuple(sales_inputs)), A.Part("order", distinct=F.col(N)),
             A.Part("customer", distinct=F.col(C)), A.Part("product", distinct=F.col("Product_Name")), A.Part("pair", distinct=pair)],
        sales_inputs, [F.sum("s").alias("s"), F.count("s").alias("ns"), F.sum("p").alias("p"), F.sum("d").alias("d"),
                       F.count("d").alias("nd"), F.sum("sd").alias("sd"), F.sum("q").alias("q")])
    day = F.col("_part") == "day"
    dated = day & F.col("_key").isNotNull()

    def total(name: str) -> Column:
        return F.sum(F.when(day, F.col(name))).cast(dict(g.dtypes)[name])

    def ids(part: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_part") == part, F.col("_distinct"))), F.lit(0))

    k = g.agg(total("s").alias("_s"), total("p").alias("_p"), total("sd").alias("_sd"), total("q").alias("_q"),
              ids("order").alias("_n"), ids("customer").alias("_c"), ids("product").alias("_k"),
              A.ratio(total("s"), total("ns")).alias("Average_Order_Value"),
              A.ratio(total("d"), total("nd"), 2, 3).alias("Average_Discount"),
              A.half_up_ratio(ids("pair").cast("decimal(38,0)"), ids("order"), 0, 1).alias("Products_per_Order"),
              A.half_up_ratio(A.units(F.sum(F.when(dated, F.col("s"))), 2), F.count(F.when(dated, F.col("s"))), 2, 2)
              .alias("Avg_Daily_Sales"),
              F.max(F.when(dated, F.col("s"))).cast("double").alias("Peak_Sales_Day"),
              F.min(F.when(dated, F.col("_key"))).cast("date").alias("Date_Start"),
              F.max(F.when(dated, F.col("_key"))).cast("date").alias("Date_End"))
    s, p, n, c, kk = (F.col(x) for x in ("_s", "_p", "_n", "_c", "_k"))
    return k.select(
        s.cast("double").alias("Total_Revenue"), "Average_Order_Value",
        _zero_if_null(A.ratio(s, c)).alias("Revenue_per_Customer"),
        _zero_if_null(A.ratio(s, kk)).alias("Revenue_per_Product"),
        p.cast("double").alias("Total_Profit"),
        F.when(s > 0, A.pct(p, s)).otherwise(F.lit(0.0)).alias("Profit_Margin"),
        _zero_if_null(A.ratio(p, n)).alias("Profit_per_Order"),
        _zero_if_null(A.ratio(p, c)).alias("Profit_per_Customer"),
        n.alias("Total_Orders"),
        _zero_if_null(A.half_up_ratio(n.cast("decimal(38,0)"), c, 0, 2)).alias("Orders_per_Customer"),
        _zero_if_null(A.half_up_ratio(F.col("_q").cast("decimal(38,0)"), n, 0, 1)).alias("Items_per_Order"),
        c.alias("Total_Customers"), c.alias("New_Customers"), kk.alias("Total_Products"),
        "Products_per_Order", "Average_Discount",
        A.half_up_ratio(A.units(F.col("_sd"), 4), F.lit(1), 4, 2).alias("Total_Discount_Impact"),
        F.col("_q").cast("bigint").alias("Total_Quantity_Sold"), "Avg_Daily_Sales", "Peak_Sales_Day",
        "Date_Start", "Date_End")


def insight_kpis(df: DataFrame, margin_target: float = 20.0) -> DataFrame:
    """Dashboard insight row derived from the KPIs."""
    k = generate_kpis(df)
    aov = F.col("Average_Order_Value")
    return k.select(
        F.col("Profit_Margin").alias("Profitability_Index"),
        F.when(F.col("Profit_Margin") >= margin_target, F.lit(f"Target: >{margin_target:g}%"))
         .otherwise(F.lit("Needs Improvement")).alias("Profitability_Status"),
        F.col("Revenue_per_Customer").alias("Customer_Value"),
        F.when(aov > 0, F.round(F.col("Revenue_per_Customer") / aov, 6)).otherwise(F.lit(0.0))
         .alias("Customer_Value_x_AOV"),
        F.col("Orders_per_Customer").alias("Order_to_Customer_Ratio"),
        F.col("Average_Discount").alias("Average_Discount"),
        F.col("Total_Discount_Impact").alias("Discount_Impact"))


# --- dashboard / report tables ----------------------------------------------

def segment_revenue_ordered(df: DataFrame) -> DataFrame:
    """Segment revenue and customers, Bronze -> Platinum."""
    g = _segments(df).select(SEGMENT, F.col("_s").cast("double").alias("Revenue"), F.col("_customers").alias("Customers"))
    return g.withColumn("Order", label_rank(SEGMENT, SEGMENT_LABELS) - 1).orderBy("Order")


def segment_analysis_table(df: DataFrame) -> DataFrame:
    """Segment table with display strings (formatted JVM-side)."""
    return _segments(df).select(
        SEGMENT, F.col("_customers").alias("Customer_Count"),
        format_money(F.col("_s")).alias("Total_Revenue"),
        format_money(A.ratio(F.col("_s"), F.col("_ns"))).alias("Avg_Order_Value"),
        format_money(F.col("_p")).alias("Total_Profit"),
        format_percent(A.ratio(F.col("_m"), F.col("_nm"), 2, 1), 1).alias("Avg_Profit_Margin"),
        format_fixed(A.half_up_ratio(F.col("_o"), F.col("_no"), 0, 1), 1).alias("Avg_Orders")).orderBy(SEGMENT)


def payment_analysis(df: DataFrame) -> DataFrame:
    """E49."""
    return _g(df, ["Payment_Mode"], orders("Orders"), ssum("Revenue"), avg(S, "Avg_Value")).orderBy(
        F.col("Revenue").desc())


def top_customers_by_name(df: DataFrame, k: int = 10) -> DataFrame:
    """Namesakes are merged (grouped by name)."""
    return _g(df, ["Customer_Name"], ssum("Total_Spent"), orders("Orders"), avg(S, "Avg_Value")).orderBy(
        F.col("Total_Spent").desc(), "Customer_Name").limit(k)


def report_category_performance(df: DataFrame) -> DataFrame:
    """E52."""
    return _g(df, ["Category"], ssum("Sales"), psum("Profit"), margin("Margin"),
              A.isum("Quantity").alias("Units")).orderBy("Category")


def report_regional_performance(df: DataFrame) -> DataFrame:
    """E53."""
    return _g(df, ["Region"], ssum("Sales"), psum("Profit"), orders("Orders"), customers("Customers")).orderBy(
        "Region")


def report_monthly_trends(df: DataFrame) -> DataFrame:
    """E54."""
    return _g(df, ["Year_Month"], ssum("Sales"), psum("Profit"), orders("Orders")).orderBy("Year_Month")


def dataset_overview(df: DataFrame) -> DataFrame:
    """Overview and revenue KPIs in one row."""
    return A.group_agg(
        df, [], F.count(F.lit(1)).alias("Total_Records"), customers("Total_Customers"),
        A.Distinct("Product_Name", "Total_Products"), orders("Total_Orders"),
        F.min("Order_Date").alias("Date_Start"), F.max("Order_Date").alias("Date_End"),
        A.dsum(S).alias("Total_Revenue"), A.dsum(P).alias("Total_Profit"),
        A.pct(F.sum(P), F.sum(S)).alias("Profit_Margin"), A.mean(S, 2, 2).alias("Average_Order_Value"),
        A.isum("Quantity").alias("Total_Units_Sold"))


def discount_metrics(df: DataFrame) -> DataFrame:
    """Mean discount in percent, discount impact, rows with a discount."""
    return df.agg(
        A.half_up_ratio(F.sum(A.units("Discount", 2)) * 100, F.count("Discount"), 2, 1).alias("Average_Discount_Pct"),
        A.half_up_ratio(A.units(F.sum(F.col(S) * F.col("Discount")), 4), F.lit(1), 4, 2).alias("Total_Discount_Impact"),
        F.count(F.when(F.col("Discount") > 0, 1)).alias("Orders_with_Discount"))


def discount_band_summary(df: DataFrame) -> DataFrame:
    """Report discount bands (0,.1,.2,.3,.5,1]; empty bands kept."""
    return _binned(df, discount_report_bin("Discount"), bin_labels(DISCOUNT_REPORT_EDGES),
                   [ssum("Sales"), psum("Profit")],
                   {"Sales": F.coalesce("Sales", F.lit(0.0)), "Profit": F.coalesce("Profit", F.lit(0.0))})


def sales_by_category(df: DataFrame) -> DataFrame:
    """E58a."""
    return _g(df, ["Category"], ssum("Sales")).orderBy("Category")


def sales_by_region(df: DataFrame) -> DataFrame:
    """Ascending by sales."""
    return _g(df, ["Region"], ssum("Sales")).orderBy("Sales", "Region")


def segment_counts_ordered(df: DataFrame) -> DataFrame:
    """Rows per segment, Bronze -> Platinum (zero counts kept)."""
    return _counts_with_labels(_segment_rows(df), SEGMENT, SEGMENT_LABELS, "Segment", order="label")


def top_products_by_sales(df: DataFrame, k: int = 10) -> DataFrame:
    """E60."""
    return _g(df, ["Product_Name"], ssum("Sales")).orderBy(F.col("Sales").desc(), "Product_Name").limit(k)


def top_decile_concentration(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Revenue share of the top floor(share * customers) spenders."""
    return concentration(_g(df, [C], F.sum(S).alias("_spent")), share)


def concentration(spend: DataFrame, share: float = 0.1) -> DataFrame:
    """E61 from the spend of each customer (Customer_ID, _spent).

    Customers are numbered in (spend desc, id) order across partitions
    (no single-partition window), then the top k are summed; the totals read
    the numbered rows, so the facts are aggregated once.
    """
    ranked = global_row_number(spend, [F.col("_spent").desc(), F.col(C).asc()], "_rank")
    totals = ranked.agg(F.count(F.lit(1)).alias("_nc"), F.sum("_spent").alias("_total"))
    k = F.floor(F.col("_nc") * F.lit(share)).cast("long")
    top = attach_row(ranked, totals).filter(F.col("_rank") <= k).agg(F.sum("_spent").alias("_top"))
    out = attach_row(totals, top)
    return out.select(k.alias("Top_Customers"), F.coalesce(F.col("_top"), F.lit(0)).cast("double").alias("Top_Revenue"),
                      A.pct(F.coalesce(F.col("_top"), F.lit(0).cast("decimal(28,2)")), F.col("_total"), 2, 1)
                      .alias("Top_Share_Pct"))


def best_category_region(df: DataFrame) -> DataFrame:
    """Arg-max category and region by sales (ties -> smallest key)."""
    cat = _g(df, ["Category"], F.sum(S).alias("_s")).orderBy(F.col("_s").desc(), "Category").limit(1)
    reg = _g(df, ["Region"], F.sum(S).alias("_r")).orderBy(F.col("_r").desc(), "Region").limit(1)
    return cat.crossJoin(reg).select(
        F.col("Category").alias("Best_Category"), F.col("_s").cast("double").alias("Best_Category_Sales"),
        F.col("Region").alias("Best_Region"), F.col("_r").cast("double").alias("Best_Region_Sales"))


def filter_options(df: DataFrame, cols: tuple[str, ...] = ("Year", "Category", "Region", SEGMENT)) -> DataFrame:
    """Sorted distinct values of the dashboard filters as (Filter, Value) rows.

    One grouping of the rows by all columns at once; where the rows have no segment
    yet, the spend of each customer is one more part, from which the segments in use
    are read.
    """
    found = SEGMENT in cols and SEGMENT not in df.columns
    parts = [A.Part(c, F.col(c), inputs=("s",)) for c in cols if not (found and c == SEGMENT)]
    if found:
        parts.append(A.Part(SEGMENT, F.col(C), inputs=("s",)))
    rows = reliable_checkpoint(A.group_parts(df, parts, {"s": F.col(S)}, [F.sum("s").alias("_s")]).filter(F.col("_key").isNotNull()))
    out = rows.filter(F.col("_part") != SEGMENT) if found else rows
    out = out.select(F.col("_part").alias("Filter"), F.col("_key").alias("Value"))
    if found:
        spend = rows.filter(F.col("_part") == SEGMENT).select(F.col("_key").alias(C), "_s")
        segments = label_totals(spend, C, "_s", SEGMENT_LABELS, SEGMENT).filter(F.col(SEGMENT).isNotNull())
        out = out.unionByName(segments.select(F.lit(SEGMENT).alias("Filter"), F.col(SEGMENT).alias("Value")).distinct())
    return out.orderBy("Filter", "Value")
