"""Rule-based insights and report tables.

Each insight or report line is a one-row aggregate turned into text
JVM-side; the lines are unioned into one small ordered table. Numbers are
rounded half-up exactly before they are printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggs as A
from .analysis import concentration
from ..session import reliable_checkpoint
from .stats import attach_row

# --- fixed values: sentences of the executive summary ({} are filled in order) ---
OVERVIEW = "Total revenue of ${} with ${} in profit ({}% margin) from {} orders across {} customers."
TOP_CATEGORY = "• Top Category: '{}' with ${} in sales"
TOP_REGION = "• Top Region: '{}' with ${} in sales"
TOP_DECILE = "• Top 10% of customers contribute {}% of revenue"
AVERAGE_ORDER = "• Average order value: ${} ({} items per order)"

# --- fixed values: message templates ({} are filled in order) -------------------
MSG_GROWTH_STRONG = ("📈 Strong monthly sales growth of {}%. "
                     "Consider increasing inventory to meet rising demand.")
MSG_GROWTH_DECLINE = ("📉 Sales declined by {}% this month. "
                      "Consider promotional campaigns to boost sales.")
MSG_GROWTH_STABLE = ("📊 Sales are stable with {}% monthly change. "
                     "Focus on maintaining current momentum.")
MSG_MARGIN_STRONG = "💰 Strong profit margin of {}%. Explore opportunities to expand market share."
MSG_MARGIN_LOW = "⚠️ Low profit margin of {}%. Review pricing strategy and cost structure."
MSG_MARGIN_HEALTHY = "📊 Healthy profit margin of {}%. Continue monitoring cost efficiency."
MSG_CUSTOMER = ("👥 Average customer places {} orders totaling "
                "${}. Implement loyalty programs to increase retention.")
MSG_TOP_CATEGORY = ("🏆 '{}' is the top-performing category at {}% of total sales. "
                    "Consider expanding this product line.")
MSG_PEAK_SEASON = "🌤️ '{}' season shows highest sales. Plan marketing campaigns accordingly."
MSG_TOP_REGION = "🌍 '{}' region leads in sales. Analyze success factors for replication in other regions."
MSG_TOP_PAYMENT = "💳 '{}' is the most popular payment method. Ensure seamless payment experience."
MSG_DISCOUNT = ("🏷️ High-discount orders show {}% "
                "lower margins. Optimize discount strategy to protect profitability.")
RECOMMENDATIONS_HEADER = "💡 RECOMMENDATIONS:"
RECOMMENDATIONS = [
    "Focus on high-margin product categories to maximize profitability.",
    "Implement targeted marketing campaigns for top customer segments.",
    "Optimize inventory based on seasonal demand patterns.",
    "Develop customer retention programs to increase repeat purchases.",
    "Expand successful regional strategies to underperforming markets.",
]
SUMMARY_RECOMMENDATIONS = [
    "1. Focus marketing spend on top-performing categories and regions",
    "2. Implement loyalty programs for high-value customer segments",
    "3. Optimize discount strategy to protect profit margins",
    "4. Explore expansion opportunities in underperforming regions",
    "5. Leverage seasonal trends for promotional campaigns",
]
NO_ANOMALIES = "No anomalies detected in the dataset."
GROWTH_HIGH, GROWTH_LOW = 10, -10
MARGIN_HIGH, MARGIN_LOW = 30, 10


def fmt(template: str, *args: Column) -> Column:
    """Fill '{}' slots of a fixed template with string columns."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for a, p in zip(args, parts[1:]):
        out += [a.cast("string"), F.lit(p)]
    return F.concat(*out)


def f1(c: Column) -> Column:
    """'%.1f' of a value already rounded to one decimal."""
    return F.format_string("%.1f", c.cast("double"))


def money(c: Column) -> Column:
    """'1,234.56' of a value already rounded to cents."""
    return F.format_number(c.cast("double"), 2)


def _line(df: DataFrame, no: int, text: Column, cond: Column | None = None) -> DataFrame:
    out = df.select(F.lit(no).alias("Insight_No"), text.alias("Insight"))
    return out.filter(cond) if cond is not None else out


def insight_groups(df: DataFrame) -> DataFrame:
    """The rows grouped by category, season, region, payment mode, month, discount and
    customer at once. All but the customers are a few hundred rows; every rule
    reads them, so they are written once."""
    return reliable_checkpoint(A.group_parts(
        df, [A.Part("category", F.col("Category"), inputs=("s",)), A.Part("season", F.col("Season"), inputs=("s",)),
             A.Part("region", F.col("Region"), inputs=("s",)), A.Part("payment", F.col("Payment_Mode"), inputs=("s",)),
             A.Part("month", F.col("Year_Month"), inputs=("s",)), A.Part("discount", F.col("Discount"), inputs=("s", "m")),
             A.Part("customer", F.col("Customer_ID"), F.col("Order_ID"), ("s",))],
        {"s": F.col("Sales"), "m": F.col("Profit_Margin_Pct")},
        [F.sum("s").alias("_s"), F.sum("m").alias("_m"), F.count("m").alias("_nm"), F.count(F.lit(1)).alias("_n")]))


def _groups_of(groups: DataFrame, part: str) -> DataFrame:
    """The groups of one key (not null, as pandas drops null keys)."""
    return groups.filter((F.col("_part") == part) & F.col("_key").isNotNull())


def _mean_margin(groups: DataFrame, cond: Column | None, scale: int) -> Column:
    """Mean margin of the rows behind the discount groups, from the exact sum and count."""
    cond = F.lit(True) if cond is None else cond
    return A.ratio(F.sum(F.when(cond, F.col("_m"))).cast(dict(groups.dtypes)["_m"]), F.sum(F.when(cond, F.col("_nm"))), 2, scale)


def customer_means(customers: DataFrame) -> DataFrame:
    """One row: mean orders (_o) and mean spend (_sp) of a row's customer; a customer
    (``_distinct`` orders, ``_s`` spend) counts once for each of its ``_n`` rows."""
    weight = F.col("_n").cast("decimal(20,0)")
    return customers.agg(
        A.half_up_ratio(F.sum((F.col("_distinct").cast("decimal(18,0)") * weight).cast("decimal(38,0)")), F.sum("_n"), 0, 1).alias("_o"),
        A.ratio(F.sum((F.col("_s") * weight).cast("decimal(38,2)")), F.sum(F.when(F.col("_s").isNotNull(), F.col("_n"))), 2, 2).alias("_sp"))


def _top(rows: DataFrame, key: str) -> DataFrame:
    """Largest sales; ties -> smallest key. One row."""
    return rows.orderBy(F.col("_s").desc(), F.col(key)).limit(1)


def business_insights(df: DataFrame) -> DataFrame:
    """L01-L06 as (Insight_No, Insight) rows, from one grouping of the input
    (``insight_groups``)."""
    spark = df.sparkSession
    groups = insight_groups(df)
    by_discount = groups.filter(F.col("_part") == "discount").withColumn("Discount", F.col("_key").cast("double"))
    glob = by_discount.agg(
        F.sum("_s").alias("_s"), _mean_margin(groups, None, 6).alias("_m6"), _mean_margin(groups, None, 1).alias("_m1"),
        F.percentile("Discount", F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("_dq"))
    parts = []
    # L01 month-over-month
    last2 = _groups_of(groups, "month").orderBy(F.col("_key").desc()).limit(2).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_s", "_key").alias("_last"),
        F.min_by("_s", "_key").alias("_prev"))
    g6 = A.pct(F.col("_last") - F.col("_prev"), F.col("_prev"), 2, 6)
    g1 = A.pct(F.col("_last") - F.col("_prev"), F.col("_prev"), 2, 1)
    msg = (F.when(g6 > GROWTH_HIGH, fmt(MSG_GROWTH_STRONG, f1(g1)))
            .when(g6 < GROWTH_LOW, fmt(MSG_GROWTH_DECLINE, f1(F.abs(g1))))
            .otherwise(fmt(MSG_GROWTH_STABLE, f1(g1))))
    parts.append(_line(last2, 1, msg, F.col("_n") >= 2))
    # L02 margin
    parts.append(_line(glob, 2, F.when(F.col("_m6") > MARGIN_HIGH, fmt(MSG_MARGIN_STRONG, f1(F.col("_m1"))))
                                   .when(F.col("_m6") < MARGIN_LOW, fmt(MSG_MARGIN_LOW, f1(F.col("_m1"))))
                                   .otherwise(fmt(MSG_MARGIN_HEALTHY, f1(F.col("_m1"))))))
    # L03 customers (row-weighted means)
    parts.append(_line(customer_means(_groups_of(groups, "customer")), 3, fmt(MSG_CUSTOMER, f1(F.col("_o")), money(F.col("_sp")))))
    # L04 top category with share, peak season, top region, top payment mode
    cat = attach_row(_top(_groups_of(groups, "category").select("_key", "_s"), "_key"), glob.select(F.col("_s").alias("_t")))
    parts.append(_line(cat, 4, fmt(MSG_TOP_CATEGORY, F.col("_key"), f1(A.pct(F.col("_s"), F.col("_t"), 2, 1)))))
    parts.append(_line(_top(_groups_of(groups, "season"), "_key"), 5, fmt(MSG_PEAK_SEASON, F.col("_key"))))
    parts.append(_line(_top(_groups_of(groups, "region"), "_key"), 6, fmt(MSG_TOP_REGION, F.col("_key"))))
    parts.append(_line(_top(_groups_of(groups, "payment"), "_key"), 7,
                       fmt(MSG_TOP_PAYMENT, F.col("_key"))))
    # L05 discount impact
    j = attach_row(by_discount, glob.select("_dq"))
    dd = j.agg(_mean_margin(groups, F.col("Discount") > F.col("_dq")[1], 6).alias("_h"),
               _mean_margin(groups, F.col("Discount") <= F.col("_dq")[0], 6).alias("_l"))
    diff = F.round(F.abs(F.col("_h").cast("decimal(24,6)") - F.col("_l").cast("decimal(24,6)")), 1)
    parts.append(_line(dd, 8, fmt(MSG_DISCOUNT, f1(diff)), F.col("_h") < F.col("_l")))
    # L06 fixed recommendations
    recs = [RECOMMENDATIONS_HEADER] + [f"  • {r}" for r in RECOMMENDATIONS]
    parts.append(spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in recs])))
                 .select((F.col("pos") + 9).cast("int").alias("Insight_No"), F.col("col").alias("Insight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("Insight_No", F.col("Insight_No").cast("int")).orderBy("Insight_No")


def executive_summary(df: DataFrame) -> DataFrame:
    """Executive summary and key findings as (Line_No, Section, Text), from one
    grouping of the rows (one row for each category, region and customer is kept)."""
    spark = df.sparkSession
    rows = reliable_checkpoint(A.group_parts(
        df, [A.Part("category", F.col("Category"), inputs=("s",)), A.Part("region", F.col("Region"), inputs=("s", "p", "q")),
             A.Part("order", distinct=F.col("Order_ID")), A.Part("customer", F.col("Customer_ID"), inputs=("s",))],
        {"s": F.col("Sales"), "p": F.col("Profit"), "q": F.col("Quantity")},
        [F.sum("s").alias("_s"), F.count("s").alias("_ns"), F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.count("q").alias("_nq")]))

    def of(part: str) -> DataFrame:
        return rows.filter((F.col("_part") == part) & F.col("_key").isNotNull())

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("_part") == "region", F.col(name))).cast(dict(rows.dtypes)[name])

    g = rows.agg(total("_s").alias("_s"), total("_p").alias("_p"),
                 F.coalesce(F.max(F.when(F.col("_part") == "order", F.col("_distinct"))), F.lit(0)).alias("_n"),
                 F.count(F.when((F.col("_part") == "customer") & F.col("_key").isNotNull(), 1)).alias("_c"),
                 A.ratio(total("_s"), total("_ns")).alias("_aov"),
                 A.half_up_ratio(total("_q").cast("decimal(38,0)"), total("_nq"), 0, 1).alias("_q"))
    margin = F.when(F.col("_s") > 0, A.pct(F.col("_p"), F.col("_s"), 2, 1)).otherwise(F.lit(0.0))
    spend = of("customer").select(F.col("_key").alias("Customer_ID"), F.col("_s").alias("_spent"))
    lines = [
        (1, "EXECUTIVE SUMMARY", g, fmt(OVERVIEW, money(F.col("_s")), money(F.col("_p")), f1(margin),
                                        F.format_number(F.col("_n"), 0), F.format_number(F.col("_c"), 0))),
        (2, "KEY FINDINGS", _top(of("category"), "_key"),
         fmt(TOP_CATEGORY, F.col("_key"), money(F.col("_s")))),
        (3, "KEY FINDINGS", _top(of("region"), "_key"),
         fmt(TOP_REGION, F.col("_key"), money(F.col("_s")))),
        (4, "KEY FINDINGS", concentration(spend),
         fmt(TOP_DECILE, f1(F.col("Top_Share_Pct")))),
        (5, "KEY FINDINGS", g, fmt(AVERAGE_ORDER, money(F.col("_aov")),
                                   f1(F.col("_q")))),
    ]
    parts = [frame.select(F.lit(no).alias("Line_No"), F.lit(sec).alias("Section"), text.alias("Text"))
             for no, sec, frame, text in lines]
    parts.append(spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in SUMMARY_RECOMMENDATIONS])))
                 .select((F.col("pos") + 6).alias("Line_No"), F.lit("ACTIONABLE RECOMMENDATIONS").alias("Section"),
                         F.col("col").alias("Text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("Line_No", F.col("Line_No").cast("int")).orderBy("Line_No")


def _section(df: DataFrame, no: int, name: str, header: list[str], cells: list[Column],
             order: list[Column]) -> DataFrame:
    """Report section: a header row (Row_No 0) and data rows numbered in ``order``."""
    from pyspark.sql import Window
    width = 5
    head = _header(df.sparkSession, no, name, header)
    # rows of a section are group rows (bounded by the group count); numbering them is a small window
    body = df.select(F.lit(no).alias("Section_No"), F.lit(name).alias("Section"),
                     F.row_number().over(Window.orderBy(*order)).alias("Row_No"),
                     *[(cells[i].cast("string") if i < len(cells) else F.lit(None).cast("string")).alias(f"C{i + 1}")
                       for i in range(width)])
    return head.unionByName(body)


def _header(spark, no: int, name: str, header: list[str], width: int = 5) -> DataFrame:
    """Row 0 of a report section: the column titles."""
    return spark.range(1).select(F.lit(no).alias("Section_No"), F.lit(name).alias("Section"),
                                 F.lit(0).alias("Row_No"),
                                 *[F.lit(header[i] if i < len(header) else None).cast("string").alias(f"C{i + 1}")
                                   for i in range(width)])


def _kv_sections(one_row: DataFrame, parts: list[tuple[int, str, list[str], list[tuple[str, Column]]]],
                 width: int = 5) -> DataFrame:
    """Several (key, value) sections read from one one-row aggregate in a single pass.

    ``parts`` = [(section no, title, header, [(key, value column), ...])]; the
    rows are numbered in list order.
    """
    items = [F.struct(F.lit(no).alias("no"), F.lit(name).alias("name"), F.lit(i + 1).alias("r"),
                      F.lit(k).alias("k"), v.cast("string").alias("v"))
             for no, name, _, kvs in parts for i, (k, v) in enumerate(kvs)]
    body = one_row.select(F.inline(F.array(*items))).select(
        F.col("no").alias("Section_No"), F.col("name").alias("Section"), F.col("r").alias("Row_No"),
        F.col("k").alias("C1"), F.col("v").alias("C2"),
        *[F.lit(None).cast("string").alias(f"C{i + 1}") for i in range(2, width)])
    out = body
    for no, name, header, _ in parts:
        out = out.unionByName(_header(one_row.sparkSession, no, name, header, width))
    return out


def _ts(d: Column) -> Column:
    return F.date_format(d.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def summary_report(df: DataFrame, top: int = 10) -> DataFrame:
    """The CSV summary report as titled sections of up to five text cells.

    Two passes over the rows (``group_parts``): one for the sums of all sections, one
    for their distinct counts; the overview is read from the months. What is kept has
    one row for each month, category, region and customer name.
    """
    rows = reliable_checkpoint(A.group_parts(
        df, [A.Part("month", F.col("Year_Month"), F.col("Order_ID"), ("s", "p", "q", "day")), A.Part("category", F.col("Category"), inputs=("s", "p", "q", "m")),
             A.Part("region", F.col("Region"), F.col("Order_ID"), ("s", "p")), A.Part("region customers", F.col("Region"), F.col("Customer_ID")),
             A.Part("name", F.col("Customer_Name"), F.col("Order_ID"), ("s",)), A.Part("order", distinct=F.col("Order_ID")),
             A.Part("customer", distinct=F.col("Customer_ID")), A.Part("product", distinct=F.col("Product_Name"))],
        {"s": F.col("Sales"), "p": F.col("Profit"), "q": F.col("Quantity"), "m": F.col("Profit_Margin_Pct"), "day": F.col("Order_Date")},
        [F.count(F.lit(1)).alias("_rows"), F.sum("s").alias("_s"), F.count("s").alias("_ns"), F.sum("p").alias("_p"),
         F.sum("q").alias("_q"), F.sum("m").alias("_m"), F.count("m").alias("_nm"), F.min("day").alias("_d0"), F.max("day").alias("_d1")]))

    def of(part: str) -> DataFrame:
        return rows.filter((F.col("_part") == part) & F.col("_key").isNotNull())

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("_part") == "month", F.col(name))).cast(dict(rows.dtypes)[name])

    def ids(part: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_part") == part, F.col("_distinct"))), F.lit(0))

    month = F.col("_part") == "month"
    ov = rows.agg(F.coalesce(total("_rows"), F.lit(0)).alias("_rows"), ids("customer").alias("_c"), ids("product").alias("_k"),
                  ids("order").alias("_n"), F.min(F.when(month, F.col("_d0"))).alias("_d0"), F.max(F.when(month, F.col("_d1"))).alias("_d1"),
                  total("_s").alias("_s"), total("_p").alias("_p"), A.ratio(total("_s"), total("_ns")).alias("_aov"), total("_q").alias("_q"))
    # overview and KPIs both read the one-row overall aggregate: one pass, not two
    money_ = lambda c: F.concat(F.lit("$"), money(c))
    overview_kpis = _kv_sections(ov, [
        (1, "DATASET OVERVIEW", ["Metric", "Value"], [
            ("Total Records", F.col("_rows")), ("Total Customers", F.col("_c")), ("Total Products", F.col("_k")),
            ("Total Orders", F.col("_n")),
            ("Date Range", F.concat(_ts(F.col("_d0")), F.lit(" to "), _ts(F.col("_d1"))))]),
        (2, "REVENUE KPIs", ["KPI", "Value"], [
            ("Total Revenue", money_(F.col("_s"))), ("Total Profit", money_(F.col("_p"))),
            ("Profit Margin", F.concat(F.format_string("%.2f", A.pct(F.col("_p"), F.col("_s"))), F.lit("%"))),
            ("Average Order Value", money_(F.col("_aov"))),
            ("Total Units Sold", F.col("_q").cast("bigint"))]),
    ])
    cust = of("name").select(F.col("_key").alias("Customer_Name"), F.col("_s").cast("double").alias("Total_Spent"), F.col("_distinct").alias("Orders"),
                             A.ratio(F.col("_s"), F.col("_ns"), 2, 6).alias("Avg_Value"))
    cust = cust.orderBy(F.col("Total_Spent").desc(), "Customer_Name").limit(top)
    cats = of("category").withColumns({"Category": F.col("_key"), "_m": A.ratio(F.col("_m"), F.col("_nm")), "_u": F.col("_q")})
    regs = (of("region").drop("_c").withColumnRenamed("_key", "Region").withColumnRenamed("_distinct", "_n")
            .join(F.broadcast(of("region customers").select(F.col("_key").alias("Region"), F.col("_distinct").alias("_c"))), "Region"))
    mons = of("month").withColumns({"Year_Month": F.col("_key"), "_n": F.col("_distinct")})
    d = lambda c: F.concat(F.lit("$"), money(c))
    sections = [
        overview_kpis,
        _section(cust, 3, "TOP 10 CUSTOMERS BY REVENUE", ["Customer Name", "Total Spent", "Orders", "Avg Order Value"],
                 [F.col("Customer_Name"), d(F.col("Total_Spent")), F.col("Orders"),
                  d(F.round(F.col("Avg_Value").cast("decimal(24,6)"), 2))],
                 [F.col("Total_Spent").desc(), F.col("Customer_Name")]),
        _section(cats, 4, "CATEGORY PERFORMANCE", ["Category", "Sales", "Profit", "Margin", "Units Sold"],
                 [F.col("Category"), d(F.col("_s")), d(F.col("_p")),
                  F.concat(F.format_string("%.2f", F.col("_m").cast("double")), F.lit("%")), F.col("_u").cast("bigint")],
                 [F.col("Category")]),
        _section(regs, 5, "REGIONAL PERFORMANCE", ["Region", "Sales", "Profit", "Orders", "Customers"],
                 [F.col("Region"), d(F.col("_s")), d(F.col("_p")), F.col("_n"), F.col("_c")], [F.col("Region")]),
        _section(mons, 6, "MONTHLY SALES TRENDS", ["Month", "Sales", "Profit", "Orders"],
                 [F.col("Year_Month"), d(F.col("_s")), d(F.col("_p")), F.col("_n")], [F.col("Year_Month")]),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out.orderBy("Section_No", "Row_No")


def anomaly_report(anomalies: DataFrame, top: int = 10) -> DataFrame:
    """Total, breakdown and the first anomalies in date order as (Line_No, Text)."""
    spark = anomalies.sparkSession
    n = anomalies.agg(F.count(F.lit(1)).alias("_n"))
    head = n.select(F.lit(1).alias("Line_No"), F.when(F.col("_n") == 0, F.lit(NO_ANOMALIES))
                    .otherwise(F.concat(F.lit("Total anomalies detected: "), F.col("_n").cast("string"))).alias("Text"))
    from pyspark.sql import Window
    brk = anomalies.groupBy("Anomaly_Type").agg(F.count(F.lit(1)).alias("_c"))
    brk = brk.select((F.lit(100) + F.row_number().over(Window.orderBy(F.col("_c").desc(), "Anomaly_Type")))
                     .alias("Line_No"), F.concat(F.lit("  "), F.col("Anomaly_Type"), F.lit(": "),
                                                 F.col("_c").cast("string")).alias("Text"))
    first = anomalies.orderBy("Order_Date").limit(top)
    rows = first.select((F.lit(1000) + F.row_number().over(Window.orderBy("Order_Date"))).alias("Line_No"),
                        F.concat(F.lit("  {'Order_Date': Timestamp('"), _ts(F.col("Order_Date")),
                                 F.lit("'), 'Sales': "), F.col("Sales").cast("decimal(28,2)").cast("string"),
                                 F.lit(", 'Orders': "), F.col("Orders").cast("string"),
                                 F.lit(", 'Anomaly_Type': '"), F.col("Anomaly_Type"), F.lit("'}")).alias("Text"))
    titles = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(99).alias("Line_No"), F.lit("ANOMALY BREAKDOWN:").alias("Text")),
        F.struct(F.lit(999).alias("Line_No"), F.lit("TOP ANOMALIES:").alias("Text"))))).select("col.*")
    body = brk.unionByName(titles).unionByName(rows)
    body = attach_row(body, n).filter(F.col("_n") > 0).drop("_n")
    return head.unionByName(body).withColumn("Line_No", F.col("Line_No").cast("int")).orderBy("Line_No")
