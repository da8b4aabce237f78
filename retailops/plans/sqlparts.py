"""DuckDB SQL fragments that mirror the Spark expressions exactly.

Used only to state the reference answer of each registered query in plain
SQL (the correctness oracle); nothing here runs inside Spark.
"""

from __future__ import annotations


def units(x: str, scale: int = 2) -> str:
    return f"CAST(({x}) * {10 ** scale} AS HUGEINT)"


def half_up(num_units: str, den: str, in_scale: int, out_scale: int) -> str:
    """round_half_up(num_units / 10**in_scale / den, out_scale) as DOUBLE."""
    shift = out_scale - in_scale
    a = f"abs({num_units})"
    d = f"CAST({den} AS HUGEINT)"
    if shift >= 0:
        a = f"({a} * {10 ** shift})"
    else:
        d = f"({d} * {10 ** (-shift)})"
    q = f"(({a} * 2 + {d}) // ({d} * 2))"
    return (f"(CASE WHEN {d} > 0 THEN CAST(CASE WHEN ({num_units}) < 0 THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / {10 ** out_scale} END)")


def mean(x: str, in_scale: int = 2, out_scale: int = 6) -> str:
    return half_up(f"sum({units(x, in_scale)})", f"count({x})", in_scale, out_scale)


def pct(part: str, whole: str, in_scale: int = 2, out_scale: int = 2) -> str:
    w = units(whole, in_scale)
    r = half_up(f"({units(part, in_scale)} * 100)", f"abs({w})", 0, out_scale)
    return f"(CASE WHEN {w} < 0 THEN -{r} ELSE {r} END)"


def dsum(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


def isum(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def dec_half_up(num: str, den: str, mult: int, out_scale: int = 2) -> str:
    """round_half_up(num * mult / den, out_scale) for DECIMAL(18,2) inputs, as DECIMAL(18,2)."""
    n = f"({units(num)} * {mult})"
    d = f"abs({units(den)})"
    q = f"((abs({n}) * {10 ** out_scale} * 2 + {d}) // ({d} * 2))"
    sign = f"(CASE WHEN ({n} < 0) <> ({units(den)} < 0) THEN -1 ELSE 1 END)"
    return (f"(CASE WHEN {units(den)} <> 0 THEN CAST(CAST({sign} * {q} AS DECIMAL(38,0)) * "
            f"CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END)")


ADAPTER = """
SELECT CAST(l_orderkey AS VARCHAR) AS Order_ID,
       c_name AS Customer_Name,
       CAST(c_custkey AS VARCHAR) AS Customer_ID,
       concat(p_name, '#', CAST(p_partkey AS VARCHAR)) AS Product_Name,
       p_type AS Category,
       p_brand AS Sub_Category,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - 8*CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS Sales,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(0.45 AS DECIMAL(4,2)) - 8*CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS Profit,
       CAST(8*CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS Discount,
       CAST(l_quantity AS INTEGER) AS Quantity,
       CAST(o_orderdate AS DATE) AS Order_Date,
       r_name AS Region, n_name AS Country, concat(n_name, '/', c_mktsegment) AS State,
       o_orderpriority AS Payment_Mode
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""


def season_sql(m: str) -> str:
    return (f"CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} IN (3, 4, 5) THEN 'Spring' "
            f"WHEN {m} IN (6, 7, 8) THEN 'Summer' WHEN {m} IN (9, 10, 11) THEN 'Fall' END")


def calendar_sql(d: str = "Order_Date") -> str:
    return f"""
       CAST(year({d}) AS INTEGER) AS Year, CAST(month({d}) AS INTEGER) AS Month,
       monthname({d}) AS Month_Name, CAST(quarter({d}) AS INTEGER) AS Quarter,
       CAST(day({d}) AS INTEGER) AS Day, CAST(isodow({d}) - 1 AS INTEGER) AS Day_of_Week,
       dayname({d}) AS Day_Name, CAST(weekofyear({d}) AS INTEGER) AS Week_of_Year,
       CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END AS Is_Weekend,
       CASE WHEN day({d}) <= 7 THEN 1 ELSE 0 END AS Is_Month_Start,
       CASE WHEN day({d}) >= 21 THEN 1 ELSE 0 END AS Is_Month_End,
       strftime({d}, '%Y-%m') AS Year_Month,
       {season_sql(f'month({d})')} AS Season,
       CASE WHEN month({d}) IN (11, 12) THEN 1 ELSE 0 END AS Is_Holiday_Season"""


SALES_BUCKET = ("CASE WHEN Sales > 0 AND Sales <= 50 THEN 'Very Low' WHEN Sales > 50 AND Sales <= 200 THEN 'Low' "
                "WHEN Sales > 200 AND Sales <= 500 THEN 'Medium' WHEN Sales > 500 AND Sales <= 1000 THEN 'High' "
                "WHEN Sales > 1000 AND Sales <= 5000 THEN 'Very High' WHEN Sales > 5000 THEN 'Premium' END")


def row_features_sql(src: str = "sales") -> str:
    return f"""SELECT *, {calendar_sql()},
       {dec_half_up('Sales', 'Quantity', 1)} AS Unit_Price,
       {dec_half_up('Profit', 'Sales', 100)} AS Profit_Margin_Pct,
       CASE WHEN Profit > 0 THEN 1 ELSE 0 END AS Is_Profitable,
       CAST(round(Sales * (CAST(1 AS DECIMAL(4,2)) - Discount), 2) AS DECIMAL(18,2)) AS Discounted_Price,
       {SALES_BUCKET} AS Sales_Bucket
FROM {src}"""


def qcut_case(v: str, e: str, labels: list[str]) -> str:
    idx = "1 + " + " + ".join(f"CAST({e}[{i}] < {v} AS INTEGER)" for i in range(1, len(labels)))
    whens = " ".join(f"WHEN {i + 1} THEN '{lab}'" for i, lab in enumerate(labels))
    return f"CASE WHEN {v} IS NOT NULL THEN CASE {idx} {whens} END END"


def customer_stats_sql(src: str = "sales") -> str:
    return f"""SELECT c.*, CAST(datediff('day', Customer_First_Purchase, Customer_Last_Purchase) AS INTEGER) AS Customer_Tenure_Days,
       CAST(datediff('day', Customer_Last_Purchase, (SELECT max(Order_Date) FROM {src} WHERE Customer_ID IS NOT NULL)) AS INTEGER) AS Customer_Recency_Days,
       {qcut_case('Customer_Total_Spent', 'q.e', ['Bronze', 'Silver', 'Gold', 'Platinum'])} AS Customer_Segment
FROM (SELECT Customer_ID, {dsum('Sales')} AS Customer_Total_Spent, count(DISTINCT Order_ID) AS Customer_Total_Orders,
             {mean('Sales')} AS Customer_Avg_Order_Value, {dsum('Profit')} AS Customer_Total_Profit,
             {mean('Discount')} AS Customer_Avg_Discount, min(Order_Date) AS Customer_First_Purchase,
             max(Order_Date) AS Customer_Last_Purchase
      FROM {src} WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID) c,
     (SELECT quantile_cont(CAST(sum_s AS DOUBLE), [0.25, 0.5, 0.75]) AS e
      FROM (SELECT sum(Sales) AS sum_s FROM {src} WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID)) q"""


def product_stats_sql(src: str = "sales") -> str:
    return f"""SELECT p.*, {qcut_case('Product_Total_Sales', 'q.e', ['Low', 'Medium', 'High', 'Top'])} AS Product_Performance
FROM (SELECT Product_Name, {dsum('Sales')} AS Product_Total_Sales, {isum('Quantity')} AS Product_Total_Quantity,
             {mean('Sales')} AS Product_Avg_Price, {dsum('Profit')} AS Product_Total_Profit,
             count(DISTINCT Order_ID) AS Product_Order_Count
      FROM {src} WHERE Product_Name IS NOT NULL GROUP BY Product_Name) p,
     (SELECT quantile_cont(CAST(sum_s AS DOUBLE), [0.25, 0.5, 0.75]) AS e
      FROM (SELECT sum(Sales) AS sum_s FROM {src} WHERE Product_Name IS NOT NULL GROUP BY Product_Name)) q"""


def features_ctes() -> str:
    """CTEs: sales (adapter), rowf, cstats, pstats, features."""
    return f"""sales AS ({ADAPTER}),
rowf AS ({row_features_sql('sales')}),
cstats AS ({customer_stats_sql('sales')}),
pstats AS ({product_stats_sql('sales')}),
features AS (SELECT rowf.*, {', '.join('cstats.' + c for c in CUSTOMER_COLS)}, {', '.join('pstats.' + c for c in PRODUCT_COLS)}
             FROM rowf LEFT JOIN cstats USING (Customer_ID) LEFT JOIN pstats USING (Product_Name))"""


CUSTOMER_COLS = ["Customer_Total_Spent", "Customer_Total_Orders", "Customer_Avg_Order_Value",
                 "Customer_Total_Profit", "Customer_Avg_Discount", "Customer_First_Purchase",
                 "Customer_Last_Purchase", "Customer_Tenure_Days", "Customer_Recency_Days", "Customer_Segment"]
PRODUCT_COLS = ["Product_Total_Sales", "Product_Total_Quantity", "Product_Avg_Price", "Product_Total_Profit",
                "Product_Order_Count", "Product_Performance"]


def with_features(body: str) -> str:
    return f"WITH {features_ctes()}\n{body}"


def with_sales(body: str) -> str:
    return f"WITH sales AS ({ADAPTER}),\nrowf AS ({row_features_sql('sales')})\n{body}"


MESSY_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority_few_nulls,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority_many_nulls,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
       CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE '$' || format('{:,.2f}', o_totalprice) END AS price_text
FROM orders"""


def quantiles_sql(src: str, col: str, probs: list[float], prefix: str) -> str:
    """One-row SELECT of exact linear-interpolation quantiles named prefix0, prefix1, ...

    Same arithmetic as Spark's ``percentile``: h = (n-1)p,
    q = (ceil(h)-h)*x[floor(h)] + (h-floor(h))*x[ceil(h)] (x[floor(h)] when h is integral).
    """
    sel = []
    for j, p in enumerate(probs):
        h = f"(CAST(n - 1 AS DOUBLE) * CAST({float(p)!r} AS DOUBLE))"
        lo, hi = f"CAST(floor({h}) AS BIGINT)", f"CAST(ceil({h}) AS BIGINT)"
        xlo = f"max(v) FILTER (WHERE i = {lo})"
        xhi = f"max(v) FILTER (WHERE i = {hi})"
        sel.append(f"CASE WHEN {lo} = {hi} THEN {xlo} ELSE (CAST({hi} AS DOUBLE) - {h}) * {xlo} + "
                   f"({h} - CAST({lo} AS DOUBLE)) * {xhi} END AS {prefix}{j}")
    return (f"SELECT {', '.join(sel)} FROM (SELECT CAST({col} AS DOUBLE) AS v, "
            f"row_number() OVER (ORDER BY CAST({col} AS DOUBLE)) - 1 AS i, count(*) OVER () AS n "
            f"FROM {src} WHERE {col} IS NOT NULL) GROUP BY n")
