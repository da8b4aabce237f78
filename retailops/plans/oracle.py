"""DuckDB SQL stating the expected answer of each registered query.

The provided tables are views; ``with_features`` / ``with_sales`` prepend
the adapter and feature CTEs (see ``sqlparts``).
"""

from __future__ import annotations

from .sqlparts import ADAPTER, dsum, half_up, half_up as half_up_sql, isum, mean, pct, with_features, with_sales

ORACLE: dict[str, str] = {}

ORACLE["e01_top_customers"] = with_features(f"""
SELECT Customer_ID, max(Customer_Name) AS Customer_Name, max(Customer_Segment) AS Customer_Segment,
       {dsum('Sales')} AS Total_Revenue, {dsum('Profit')} AS Total_Profit,
       count(DISTINCT Order_ID) AS Order_Count, {mean('Sales', 2, 2)} AS Avg_Order_Value,
       {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin, {isum('Quantity')} AS Total_Items
FROM features GROUP BY Customer_ID ORDER BY Total_Revenue DESC, Customer_ID ASC NULLS LAST LIMIT 10""")

ORACLE["e02_best_products"] = with_features(f"""
SELECT Product_Name, max(Category) AS Category, max(Sub_Category) AS Sub_Category,
       {dsum('Sales')} AS Total_Revenue, {dsum('Profit')} AS Total_Profit,
       count(DISTINCT Order_ID) AS Order_Count, {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin,
       {mean('Discount', 2, 3)} AS Avg_Discount, {isum('Quantity')} AS Total_Units_Sold
FROM features GROUP BY Product_Name ORDER BY Total_Revenue DESC, Product_Name ASC NULLS LAST LIMIT 10""")

ORACLE["e03_profit_trends"] = with_sales(f"""
SELECT Year_Month, max(Year) AS Year, max(Month) AS Month, max(Month_Name) AS Month_Name,
       {dsum('Sales')} AS Total_Sales, {dsum('Profit')} AS Total_Profit,
       {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin, count(DISTINCT Order_ID) AS Order_Count,
       {mean('Discount', 2, 3)} AS Avg_Discount
FROM rowf GROUP BY Year_Month ORDER BY Year, Month""")

ORACLE["e04_regional_analysis"] = with_sales(f"""
SELECT Region, Country, CAST(s AS DOUBLE) AS Total_Sales, Total_Profit, Avg_Profit_Margin, Order_Count,
       Unique_Customers, Avg_Order_Value, {pct('s', 'sum(s) OVER ()')} AS Sales_Share_Pct
FROM (SELECT Region, Country, sum(Sales) AS s, {dsum('Profit')} AS Total_Profit,
             {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin, count(DISTINCT Order_ID) AS Order_Count,
             count(DISTINCT Customer_ID) AS Unique_Customers, {mean('Sales', 2, 2)} AS Avg_Order_Value
      FROM rowf GROUP BY Region, Country) ORDER BY Total_Sales DESC""")

ORACLE["e05_monthly_analysis"] = with_sales(f"""
SELECT Year, Month, max(Month_Name) AS Month_Name, max(Quarter) AS Quarter,
       {dsum('Sales')} AS Monthly_Revenue, {dsum('Profit')} AS Monthly_Profit,
       {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin, count(DISTINCT Order_ID) AS Order_Count,
       count(DISTINCT Customer_ID) AS Unique_Customers, {mean('Sales', 2, 2)} AS Avg_Order_Value,
       {mean('Discount', 2, 3)} AS Avg_Discount, {isum('Quantity')} AS Total_Units_Sold
FROM rowf GROUP BY Year, Month ORDER BY Year, Month""")

ORACLE["e06_category_performance"] = with_sales(f"""
SELECT Category, Sub_Category, CAST(s AS DOUBLE) AS Total_Revenue, Total_Profit, Order_Count,
       Avg_Profit_Margin, Avg_Discount, Total_Units_Sold,
       {pct('s', 'sum(s) OVER (PARTITION BY Category)')} AS Category_Share_Pct
FROM (SELECT Category, Sub_Category, sum(Sales) AS s, {dsum('Profit')} AS Total_Profit,
             count(DISTINCT Order_ID) AS Order_Count, {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin,
             {mean('Discount', 2, 3)} AS Avg_Discount, {isum('Quantity')} AS Total_Units_Sold
      FROM rowf GROUP BY Category, Sub_Category) ORDER BY Total_Revenue DESC""")

ORACLE["e07_customer_segment_analysis"] = with_features(f"""
SELECT Customer_Segment, Customer_Count, CAST(s AS DOUBLE) AS Total_Revenue, Total_Profit, Avg_Order_Value,
       Avg_Profit_Margin, Avg_Orders_Per_Customer, {pct('s', 'sum(s) OVER ()')} AS Revenue_Share_Pct
FROM (SELECT Customer_Segment, count(DISTINCT Customer_ID) AS Customer_Count, sum(Sales) AS s,
             {dsum('Profit')} AS Total_Profit, {mean('Sales', 2, 2)} AS Avg_Order_Value,
             {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin,
             {mean('Customer_Total_Orders', 0, 1)} AS Avg_Orders_Per_Customer
      FROM features GROUP BY Customer_Segment) ORDER BY Total_Revenue DESC""")

ORACLE["e08_payment_mode_analysis"] = with_sales(f"""
SELECT Payment_Mode, Order_Count, CAST(s AS DOUBLE) AS Total_Revenue, Avg_Order_Value, Total_Profit,
       {pct('s', 'sum(s) OVER ()')} AS Revenue_Share_Pct
FROM (SELECT Payment_Mode, count(DISTINCT Order_ID) AS Order_Count, sum(Sales) AS s,
             {mean('Sales', 2, 2)} AS Avg_Order_Value, {dsum('Profit')} AS Total_Profit
      FROM rowf GROUP BY Payment_Mode) ORDER BY Total_Revenue DESC""")

ORACLE["e09_seasonal_analysis"] = with_sales(f"""
SELECT Season, Year, {dsum('Sales')} AS Total_Sales, {dsum('Profit')} AS Total_Profit,
       count(DISTINCT Order_ID) AS Order_Count, {mean('Sales', 2, 2)} AS Avg_Order_Value
FROM rowf GROUP BY Season, Year ORDER BY Year, Season""")

ORACLE["e10_year_over_year_growth"] = with_sales(f"""
SELECT Year, CAST(r AS DOUBLE) AS Total_Revenue,
       {pct('r - lag(r) OVER (ORDER BY Year)', 'lag(r) OVER (ORDER BY Year)')} AS Revenue_Growth_Pct,
       CAST(p AS DOUBLE) AS Total_Profit,
       {pct('p - lag(p) OVER (ORDER BY Year)', 'lag(p) OVER (ORDER BY Year)')} AS Profit_Growth_Pct,
       Order_Count, Customer_Count
FROM (SELECT Year, sum(Sales) AS r, sum(Profit) AS p, count(DISTINCT Order_ID) AS Order_Count,
             count(DISTINCT Customer_ID) AS Customer_Count FROM rowf GROUP BY Year) ORDER BY Year""")

ORACLE["e11_kpi_summary"] = with_sales(f"""
SELECT count(DISTINCT Order_ID) AS Total_Orders, count(DISTINCT Customer_ID) AS Total_Customers,
       count(DISTINCT Product_Name) AS Total_Products, {dsum('Sales')} AS Total_Revenue,
       {dsum('Profit')} AS Total_Profit, {mean('Profit_Margin_Pct', 2, 2)} AS Avg_Profit_Margin,
       {mean('Sales', 2, 2)} AS Avg_Order_Value, {mean('Discount', 2, 3)} AS Avg_Discount,
       {isum('Quantity')} AS Total_Units_Sold, {mean('Quantity', 0, 1)} AS Avg_Items_Per_Order
FROM rowf""")


# --- E12-E64 ------------------------------------------------------------------
def _R(body: str) -> str:
    return with_sales(body)


def _F(body: str) -> str:
    return with_features(body)


def _nn(*keys: str) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


SS, PS = f"{dsum('Sales')} AS Total_Sales", f"{dsum('Profit')} AS Total_Profit"
NO, NC = "count(DISTINCT Order_ID) AS Order_Count", "count(DISTINCT Customer_ID) AS Customer_Count"
M6 = mean('Profit_Margin_Pct', 2, 6)


def _labels(name: str, labels: list[str]) -> str:
    vals = ", ".join(f"('{x}', {i})" for i, x in enumerate(labels))
    return f"(VALUES {vals}) AS l({name}, pos)"


def _count_labels(col: str, labels: list[str], name: str, order: str) -> str:
    return _F(f"""
SELECT l.{name}, CAST(coalesce(c.cnt, 0) AS BIGINT) AS Count
FROM {_labels(name, labels)} LEFT JOIN (SELECT {col} AS k, count(*) AS cnt FROM features WHERE {col} IS NOT NULL GROUP BY {col}) c
  ON l.{name} = c.k ORDER BY {order}""")


ORACLE["e12_daily_sales"] = _R(f"SELECT Order_Date, {SS}, {PS}, {NO} FROM rowf WHERE {_nn('Order_Date')} GROUP BY Order_Date")
ORACLE["e13_monthly_trends"] = _R(f"""SELECT Year_Month, {SS}, {PS}, {mean('Sales')} AS Avg_Order_Value, {NO}, {NC}
FROM rowf WHERE {_nn('Year_Month')} GROUP BY Year_Month""")
ORACLE["e14_quarterly_trends"] = _R(f"SELECT Year, Quarter, {SS}, {PS}, {NO} FROM rowf WHERE {_nn('Year', 'Quarter')} GROUP BY Year, Quarter")
ORACLE["e15_yearly_analysis"] = _R(f"""
SELECT Year, CAST(s AS DOUBLE) AS Total_Sales, CAST(p AS DOUBLE) AS Total_Profit,
       {pct('s - lag(s) OVER (ORDER BY Year)', 'lag(s) OVER (ORDER BY Year)', 2, 6)} AS Sales_Growth,
       {pct('p - lag(p) OVER (ORDER BY Year)', 'lag(p) OVER (ORDER BY Year)', 2, 6)} AS Profit_Growth
FROM (SELECT Year, sum(Sales) AS s, sum(Profit) AS p FROM rowf WHERE {_nn('Year')} GROUP BY Year)""")
ORACLE["e16_day_of_week_analysis"] = _R(f"""
SELECT Day_Name, {SS}, {NO}, {mean('Sales')} AS Avg_Sales,
       CAST(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], Day_Name) - 1 AS INTEGER) AS Day_Order
FROM rowf WHERE {_nn('Day_Name')} GROUP BY Day_Name""")
ORACLE["e17_seasonal_summary"] = _R(f"SELECT Season, {SS}, {PS}, {NO} FROM rowf WHERE {_nn('Season')} GROUP BY Season")

_PROFILE = f"""
prof AS (
  SELECT Customer_ID, Customer_Name, Customer_Segment, {dsum('Sales')} AS Total_Spent, {PS}, {NO},
         {mean('Sales')} AS Avg_Order_Value, {isum('Quantity')} AS Total_Quantity, {mean('Discount')} AS Avg_Discount,
         min(Order_Date) AS First_Purchase, max(Order_Date) AS Last_Purchase
  FROM features WHERE {_nn('Customer_ID', 'Customer_Name', 'Customer_Segment')}
  GROUP BY Customer_ID, Customer_Name, Customer_Segment),
modes AS (
  SELECT Customer_ID, Customer_Name, Customer_Segment,
         coalesce(arg_min(Category, struct_pack(a := -cc, b := Category)) FILTER (WHERE Category IS NOT NULL), 'N/A') AS Preferred_Category
  FROM (SELECT Customer_ID, Customer_Name, Customer_Segment, Category, count(*) AS cc FROM features
        WHERE {_nn('Customer_ID', 'Customer_Name', 'Customer_Segment')} GROUP BY ALL)
  GROUP BY ALL),
rmodes AS (
  SELECT Customer_ID, Customer_Name, Customer_Segment,
         coalesce(arg_min(Region, struct_pack(a := -cc, b := Region)) FILTER (WHERE Region IS NOT NULL), 'N/A') AS Preferred_Region
  FROM (SELECT Customer_ID, Customer_Name, Customer_Segment, Region, count(*) AS cc FROM features
        WHERE {_nn('Customer_ID', 'Customer_Name', 'Customer_Segment')} GROUP BY ALL)
  GROUP BY ALL),
prof2 AS (
  SELECT p.*, m.Preferred_Category, r.Preferred_Region,
         CAST(datediff('day', Last_Purchase, (SELECT max(Order_Date) FROM features)) AS INTEGER) AS Recency_Days,
         Order_Count AS Frequency, Total_Spent AS Monetary,
         concat_ws(chr(1), coalesce(p.Customer_ID, ''), coalesce(p.Customer_Name, ''), coalesce(p.Customer_Segment, '')) AS tie
  FROM prof p JOIN modes m USING (Customer_ID, Customer_Name, Customer_Segment)
              JOIN rmodes r USING (Customer_ID, Customer_Name, Customer_Segment)),
rq AS (SELECT quantile_cont(CAST(Recency_Days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM prof2),
ranked AS (
  SELECT prof2.*, CAST(6 - (1 + {' + '.join(f'CAST(rq.e[{i}] < Recency_Days AS INTEGER)' for i in range(1, 5))}) AS INTEGER) AS R_Score,
         row_number() OVER (ORDER BY Frequency ASC NULLS FIRST, tie) AS rf,
         row_number() OVER (ORDER BY Monetary ASC NULLS FIRST, tie) AS rm,
         count(*) OVER () AS n
  FROM prof2, rq),
scored AS (
  SELECT *, CAST(CASE WHEN n > 1 THEN greatest(1, ((rf - 1) * 5 + n - 2) // (n - 1)) ELSE 1 END AS INTEGER) AS F_Score,
            CAST(CASE WHEN n > 1 THEN greatest(1, ((rm - 1) * 5 + n - 2) // (n - 1)) ELSE 1 END AS INTEGER) AS M_Score
  FROM ranked)"""

_PROFILE_COLS = ("Customer_ID, Customer_Name, Customer_Segment, Total_Spent, Total_Profit, Order_Count, Avg_Order_Value, "
                 "Total_Quantity, Avg_Discount, First_Purchase, Last_Purchase, Preferred_Category, Preferred_Region, "
                 "Recency_Days, Frequency, Monetary, R_Score, F_Score, M_Score")
_RFM = "CAST(coalesce(R_Score, 0) + coalesce(F_Score, 0) + coalesce(M_Score, 0) AS INTEGER) AS RFM_Score"

ORACLE["e18_customer_profiles"] = _F(f""", {_PROFILE.strip()}
SELECT {_PROFILE_COLS}, {_RFM}, Avg_Order_Value * Order_Count AS CLV FROM scored""").replace(
    "features AS (", "features AS (", 1)
ORACLE["e44_rfm_table"] = _F(f""", {_PROFILE.strip()}
SELECT Customer_ID, Customer_Name, Recency_Days, Frequency, Monetary, R_Score, F_Score, M_Score, {_RFM} FROM scored""")
ORACLE["e45_clv"] = _R(f"""SELECT Customer_ID, {mean('Sales')} * count(DISTINCT Order_ID) AS CLV
FROM rowf WHERE {_nn('Customer_ID')} GROUP BY Customer_ID""")
ORACLE["h01_top_customer_profiles"] = _F(f""", {_PROFILE.strip()}
SELECT Customer_ID, Customer_Name, Customer_Segment, Total_Spent, Total_Profit, Order_Count, Avg_Order_Value,
       Total_Quantity, Avg_Discount, First_Purchase, Last_Purchase, Preferred_Category, Preferred_Region,
       Recency_Days, Frequency, Monetary
FROM prof2 ORDER BY Total_Spent DESC, Customer_ID LIMIT 10""")

ORACLE["e19_segment_distribution"] = _count_labels("Customer_Segment", ["Bronze", "Silver", "Gold", "Platinum"],
                                                   "Segment", "Count DESC, pos")
ORACLE["e26_performance_distribution"] = _count_labels("Product_Performance", ["Low", "Medium", "High", "Top"],
                                                       "Performance", "Count DESC, pos")
ORACLE["e59_segment_counts_ordered"] = _count_labels("Customer_Segment", ["Bronze", "Silver", "Gold", "Platinum"],
                                                     "Segment", "pos")
ORACLE["e39_revenue_distribution"] = _count_labels(
    "Sales_Bucket", ["Very Low", "Low", "Medium", "High", "Very High", "Premium"], "Bucket", "Count DESC, pos")

ORACLE["e20_region_performance"] = _R(f"""
SELECT Region, Country, State, {SS}, {PS}, {NO}, {NC}, {mean('Sales')} AS Avg_Order_Value, {M6} AS Avg_Profit_Margin,
       {isum('Quantity')} AS Total_Quantity
FROM rowf WHERE {_nn('Region', 'Country', 'State')} GROUP BY Region, Country, State""")
ORACLE["e21_region_monthly"] = _R(f"SELECT Region, Year_Month, {SS}, {PS} FROM rowf WHERE {_nn('Region', 'Year_Month')} GROUP BY ALL")
ORACLE["e22_region_profitability"] = _R(f"""
SELECT Region, CAST(s AS DOUBLE) AS Total_Sales, CAST(p AS DOUBLE) AS Total_Profit, Avg_Margin, Total_Orders,
       {pct('p', 's', 2, 6)} AS Profit_Ratio
FROM (SELECT Region, sum(Sales) AS s, sum(Profit) AS p, {M6} AS Avg_Margin, count(DISTINCT Order_ID) AS Total_Orders
      FROM rowf WHERE {_nn('Region')} GROUP BY Region)""")
ORACLE["e23_top_states"] = _R(f"SELECT State, {SS}, {PS} FROM rowf WHERE {_nn('State')} GROUP BY State ORDER BY Total_Sales DESC, State LIMIT 10")
ORACLE["e46_region_rollup"] = _R(f"""
SELECT Region, {dsum('s')} AS Total_Sales, {dsum('p')} AS Total_Profit, {isum('Order_Count')} AS Order_Count,
       {isum('Customer_Count')} AS Customer_Count, {mean('CAST(m AS DECIMAL(24,6))', 6, 6)} AS Avg_Margin
FROM (SELECT Region, Country, State, sum(Sales) AS s, sum(Profit) AS p, {NO}, {NC}, {M6} AS m
      FROM rowf WHERE {_nn('Region', 'Country', 'State')} GROUP BY ALL) GROUP BY Region""")

ORACLE["e24_product_performance"] = _F(f"""
SELECT Product_Name, Category, Sub_Category, Product_Performance, {SS}, {PS}, {NO}, {mean('Sales')} AS Avg_Price,
       {M6} AS Avg_Profit_Margin, {isum('Quantity')} AS Total_Quantity, {mean('Discount')} AS Avg_Discount
FROM features WHERE {_nn('Product_Name', 'Category', 'Sub_Category', 'Product_Performance')} GROUP BY ALL""")
ORACLE["h01_top_products"] = ORACLE["e24_product_performance"] + " ORDER BY Total_Sales DESC, Product_Name LIMIT 15"
ORACLE["e25_category_summary"] = _R(f"""
SELECT Category, Sub_Category, {SS}, {PS}, count(DISTINCT Product_Name) AS Product_Count, {NO}, {M6} AS Avg_Margin
FROM rowf WHERE {_nn('Category', 'Sub_Category')} GROUP BY ALL""")
ORACLE["e27_profit_by_category"] = _R(f"SELECT Category, {PS}, {SS}, {M6} AS Avg_Margin, {NO} FROM rowf WHERE {_nn('Category')} GROUP BY ALL")


def _bin_case(edges: list[str]) -> str:
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        lab = f"({float(lo)!r}, {float(hi)!r}]"
        parts.append(f"WHEN Discount > CAST({lo} AS DECIMAL(20,6)) AND Discount <= CAST({hi} AS DECIMAL(20,6)) THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _bin_labels(edges: list[str]) -> list[str]:
    return [f"({float(lo)!r}, {float(hi)!r}]" for lo, hi in zip(edges, edges[1:])]


_DA = ["0.0", "0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7"]
_DR = ["0", "0.1", "0.2", "0.3", "0.5", "1.0"]
ORACLE["e28_profit_discount_analysis"] = _R(f"""
SELECT l.Discount_Range, coalesce(Total_Profit, 0.0) AS Total_Profit, coalesce(Total_Sales, 0.0) AS Total_Sales,
       CAST(coalesce(Order_Count, 0) AS BIGINT) AS Order_Count, Avg_Margin
FROM {_labels('Discount_Range', _bin_labels(_DA))} LEFT JOIN (
  SELECT {_bin_case(_DA)} AS b, {PS}, {SS}, {NO}, {M6} AS Avg_Margin FROM rowf GROUP BY b) g ON l.Discount_Range = g.b
ORDER BY pos""")
ORACLE["e57_discount_band_summary"] = _R(f"""
SELECT l.Discount_Range, coalesce(Sales, 0.0) AS Sales, coalesce(Profit, 0.0) AS Profit
FROM {_labels('Discount_Range', _bin_labels(_DR))} LEFT JOIN (
  SELECT {_bin_case(_DR)} AS b, {dsum('Sales')} AS Sales, {dsum('Profit')} AS Profit FROM rowf GROUP BY b) g
  ON l.Discount_Range = g.b ORDER BY pos""")
ORACLE["e29_monthly_profit_trends"] = _R(f"SELECT Year_Month, {PS}, {SS}, {M6} AS Avg_Margin FROM rowf WHERE {_nn('Year_Month')} GROUP BY ALL")
ORACLE["e30_most_profitable_products"] = _R(f"""SELECT Product_Name, {PS}, {SS}, {M6} AS Avg_Margin FROM rowf
WHERE {_nn('Product_Name')} GROUP BY ALL ORDER BY Total_Profit DESC, Product_Name LIMIT 10""")
ORACLE["e31_loss_making_products"] = _R(f"""SELECT Product_Name, {PS}, {SS} FROM rowf WHERE {_nn('Product_Name')}
GROUP BY ALL HAVING sum(Profit) < 0""")
ORACLE["e32_category_stats"] = _R(f"""
SELECT Category, Total_Profit, Order_Count, Product_Count, Customer_Count, Avg_Order_Value, Avg_Margin, Avg_Discount,
       Total_Quantity, {pct('s', 'sum(s) OVER ()')} AS Market_Share_Pct, CAST(s AS DOUBLE) AS Total_Sales
FROM (SELECT Category, sum(Sales) AS s, {PS}, {NO}, count(DISTINCT Product_Name) AS Product_Count, {NC},
             {mean('Sales')} AS Avg_Order_Value, {M6} AS Avg_Margin, {mean('Discount')} AS Avg_Discount,
             {isum('Quantity')} AS Total_Quantity FROM rowf WHERE {_nn('Category')} GROUP BY Category)""")
ORACLE["e33_subcategory_stats"] = _R(f"SELECT Category, Sub_Category, {SS}, {PS}, {NO}, {M6} AS Avg_Margin FROM rowf WHERE {_nn('Category', 'Sub_Category')} GROUP BY ALL")
ORACLE["e34_category_trends"] = _R(f"SELECT Year_Month, Category, {SS} FROM rowf WHERE {_nn('Year_Month', 'Category')} GROUP BY ALL")
ORACLE["e35_category_region"] = _R(f"SELECT Category, Region, {SS}, {PS} FROM rowf WHERE {_nn('Category', 'Region')} GROUP BY ALL")
ORACLE["e36_monthly_revenue"] = _R(f"""SELECT Year_Month, {dsum('Sales')} AS Revenue, {dsum('Profit')} AS Profit,
count(DISTINCT Order_ID) AS Orders FROM rowf WHERE {_nn('Year_Month')} GROUP BY ALL""")
ORACLE["e37_revenue_by_payment"] = _R(f"""SELECT Payment_Mode, {dsum('Sales')} AS Revenue, count(DISTINCT Order_ID) AS Orders
FROM rowf WHERE {_nn('Payment_Mode')} GROUP BY ALL""")
ORACLE["e38_revenue_by_segment"] = _F(f"""SELECT Customer_Segment, {dsum('Sales')} AS Revenue, count(DISTINCT Customer_ID) AS Customers,
{mean('Sales')} AS Avg_Revenue FROM features WHERE {_nn('Customer_Segment')} GROUP BY ALL""")
ORACLE["e40_daily_revenue_trend"] = _R(f"""
SELECT Order_Date, CAST(r AS DOUBLE) AS Daily_Revenue,
       CAST(sum(r) OVER (ORDER BY Order_Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS Cumulative_Revenue,
       CASE WHEN count(r) OVER w7 >= 7 THEN {half_up_sql("sum(CAST(r * 100 AS HUGEINT)) OVER w7", "7", 2, 6)} END AS Moving_Avg_7d
FROM (SELECT Order_Date, sum(Sales) AS r FROM rowf WHERE {_nn('Order_Date')} GROUP BY Order_Date)
WINDOW w7 AS (ORDER BY Order_Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")

_KPI = f"""
g AS (SELECT sum(Sales) AS s, sum(Profit) AS p, count(DISTINCT Order_ID) AS n, count(DISTINCT Customer_ID) AS c,
             count(DISTINCT Product_Name) AS k, {mean('Sales', 2, 2)} AS Average_Order_Value,
             {mean('Discount', 2, 3)} AS Average_Discount, sum(Sales * Discount) AS sd, sum(Quantity) AS q,
             min(Order_Date) AS Date_Start, max(Order_Date) AS Date_End FROM rowf),
po AS (SELECT {half_up_sql('sum(CAST(kp AS HUGEINT))', 'count(kp)', 0, 1)} AS Products_per_Order
       FROM (SELECT Order_ID, count(DISTINCT Product_Name) AS kp FROM rowf WHERE Order_ID IS NOT NULL GROUP BY Order_ID)),
pd AS (SELECT {half_up_sql('sum(CAST(ds * 100 AS HUGEINT))', 'count(ds)', 2, 2)} AS Avg_Daily_Sales,
              CAST(max(ds) AS DOUBLE) AS Peak_Sales_Day
       FROM (SELECT Order_Date, sum(Sales) AS ds FROM rowf WHERE Order_Date IS NOT NULL GROUP BY Order_Date)),
kpis AS (
SELECT CAST(s AS DOUBLE) AS Total_Revenue, Average_Order_Value,
       coalesce({half_up_sql('CAST(s * 100 AS HUGEINT)', 'c', 2, 2)}, 0.0) AS Revenue_per_Customer,
       coalesce({half_up_sql('CAST(s * 100 AS HUGEINT)', 'k', 2, 2)}, 0.0) AS Revenue_per_Product,
       CAST(p AS DOUBLE) AS Total_Profit,
       CASE WHEN s > 0 THEN {pct('p', 's')} ELSE 0.0 END AS Profit_Margin,
       coalesce({half_up_sql('CAST(p * 100 AS HUGEINT)', 'n', 2, 2)}, 0.0) AS Profit_per_Order,
       coalesce({half_up_sql('CAST(p * 100 AS HUGEINT)', 'c', 2, 2)}, 0.0) AS Profit_per_Customer,
       n AS Total_Orders,
       coalesce({half_up_sql('CAST(n AS HUGEINT)', 'c', 0, 2)}, 0.0) AS Orders_per_Customer,
       coalesce({half_up_sql('CAST(q AS HUGEINT)', 'n', 0, 1)}, 0.0) AS Items_per_Order,
       c AS Total_Customers, c AS New_Customers, k AS Total_Products, Products_per_Order, Average_Discount,
       {half_up_sql('CAST(sd * 10000 AS HUGEINT)', '1', 4, 2)} AS Total_Discount_Impact,
       CAST(q AS BIGINT) AS Total_Quantity_Sold, Avg_Daily_Sales, Peak_Sales_Day, Date_Start, Date_End
FROM g, po, pd)"""
ORACLE["e41_generate_kpis"] = _R(f", {_KPI.strip()} SELECT * FROM kpis")
ORACLE["e64_insight_kpis"] = _R(f""", {_KPI.strip()}
SELECT Profit_Margin AS Profitability_Index,
       CASE WHEN Profit_Margin >= 20.0 THEN 'Target: >20%' ELSE 'Needs Improvement' END AS Profitability_Status,
       Revenue_per_Customer AS Customer_Value,
       CASE WHEN Average_Order_Value > 0 THEN round(Revenue_per_Customer / Average_Order_Value, 6) ELSE 0.0 END AS Customer_Value_x_AOV,
       Orders_per_Customer AS Order_to_Customer_Ratio, Average_Discount, Total_Discount_Impact AS Discount_Impact
FROM kpis""")

ORACLE["e47_segment_revenue_ordered"] = _F(f"""
SELECT Customer_Segment, {dsum('Sales')} AS Revenue, count(DISTINCT Customer_ID) AS Customers,
       CAST(list_position(['Bronze', 'Silver', 'Gold', 'Platinum'], Customer_Segment) - 1 AS INTEGER) AS "Order"
FROM features WHERE {_nn('Customer_Segment')} GROUP BY ALL ORDER BY 4""")
ORACLE["e48_segment_analysis_table"] = _F(f"""
SELECT Customer_Segment, Customer_Count, '$' || format('{{:,.2f}}', CAST(s AS DOUBLE)) AS Total_Revenue,
       '$' || format('{{:,.2f}}', aov) AS Avg_Order_Value, '$' || format('{{:,.2f}}', CAST(p AS DOUBLE)) AS Total_Profit,
       format('{{:.1f}}', m) || '%' AS Avg_Profit_Margin, format('{{:.1f}}', o) AS Avg_Orders
FROM (SELECT Customer_Segment, {NC}, sum(Sales) AS s, {mean('Sales', 2, 2)} AS aov, sum(Profit) AS p,
             {mean('Profit_Margin_Pct', 2, 1)} AS m, {mean('Customer_Total_Orders', 0, 1)} AS o
      FROM features WHERE {_nn('Customer_Segment')} GROUP BY ALL)""")
ORACLE["e49_payment_analysis"] = _R(f"""SELECT Payment_Mode, count(DISTINCT Order_ID) AS Orders, {dsum('Sales')} AS Revenue,
{mean('Sales')} AS Avg_Value FROM rowf WHERE {_nn('Payment_Mode')} GROUP BY ALL""")
ORACLE["e50_category_month_pivot"] = f"""
WITH c AS (SELECT Category, strftime(Order_Date, '%Y-%m') AS Year_Month, sum(Sales) AS s FROM ({ADAPTER})
           WHERE Category IS NOT NULL AND Order_Date IS NOT NULL GROUP BY ALL)
SELECT a.Category, m.Year_Month, CAST(COALESCE(c.s, 0) AS DOUBLE) AS Sales
FROM (SELECT DISTINCT Category FROM c) a CROSS JOIN (SELECT DISTINCT Year_Month FROM c) m
LEFT JOIN c ON c.Category = a.Category AND c.Year_Month = m.Year_Month ORDER BY 1, 2"""
ORACLE["e51_top_customers_by_name"] = _R(f"""SELECT Customer_Name, {dsum('Sales')} AS Total_Spent, count(DISTINCT Order_ID) AS Orders,
{mean('Sales')} AS Avg_Value FROM rowf WHERE {_nn('Customer_Name')} GROUP BY ALL ORDER BY Total_Spent DESC, Customer_Name LIMIT 10""")
ORACLE["e52_report_category_performance"] = _R(f"""SELECT Category, {dsum('Sales')} AS Sales, {dsum('Profit')} AS Profit,
{M6} AS Margin, {isum('Quantity')} AS Units FROM rowf WHERE {_nn('Category')} GROUP BY ALL""")
ORACLE["e53_report_regional_performance"] = _R(f"""SELECT Region, {dsum('Sales')} AS Sales, {dsum('Profit')} AS Profit,
count(DISTINCT Order_ID) AS Orders, count(DISTINCT Customer_ID) AS Customers FROM rowf WHERE {_nn('Region')} GROUP BY ALL""")
ORACLE["e54_report_monthly_trends"] = _R(f"""SELECT Year_Month, {dsum('Sales')} AS Sales, {dsum('Profit')} AS Profit,
count(DISTINCT Order_ID) AS Orders FROM rowf WHERE {_nn('Year_Month')} GROUP BY ALL""")
ORACLE["e55_dataset_overview"] = _R(f"""
SELECT count(*) AS Total_Records, count(DISTINCT Customer_ID) AS Total_Customers, count(DISTINCT Product_Name) AS Total_Products,
       count(DISTINCT Order_ID) AS Total_Orders, min(Order_Date) AS Date_Start, max(Order_Date) AS Date_End,
       {dsum('Sales')} AS Total_Revenue, {dsum('Profit')} AS Total_Profit, {pct('sum(Profit)', 'sum(Sales)')} AS Profit_Margin,
       {mean('Sales', 2, 2)} AS Average_Order_Value, {isum('Quantity')} AS Total_Units_Sold FROM rowf""")
ORACLE["e56_discount_metrics"] = _R(f"""
SELECT {half_up_sql('sum(CAST(Discount * 100 AS HUGEINT)) * 100', 'count(Discount)', 2, 1)} AS Average_Discount_Pct,
       {half_up_sql('CAST(sum(Sales * Discount) * 10000 AS HUGEINT)', '1', 4, 2)} AS Total_Discount_Impact,
       count(CASE WHEN Discount > 0 THEN 1 END) AS Orders_with_Discount FROM rowf""")
ORACLE["e58_sales_by_category"] = _R(f"SELECT Category, {dsum('Sales')} AS Sales FROM rowf WHERE {_nn('Category')} GROUP BY ALL")
ORACLE["e58_sales_by_region"] = _R(f"SELECT Region, {dsum('Sales')} AS Sales FROM rowf WHERE {_nn('Region')} GROUP BY ALL")
ORACLE["e60_top_products_by_sales"] = _R(f"""SELECT Product_Name, {dsum('Sales')} AS Sales FROM rowf WHERE {_nn('Product_Name')}
GROUP BY ALL ORDER BY Sales DESC, Product_Name LIMIT 10""")
ORACLE["e61_top_decile_concentration"] = _R(f"""
, spend AS (SELECT Customer_ID, sum(Sales) AS sp FROM rowf WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID),
tot AS (SELECT count(*) AS nc, sum(sp) AS total FROM spend),
top AS (SELECT sum(sp) AS t FROM (SELECT sp, row_number() OVER (ORDER BY sp DESC, Customer_ID) AS rk FROM spend), tot
        WHERE rk <= floor(nc * 0.1))
SELECT CAST(floor(nc * 0.1) AS BIGINT) AS Top_Customers, CAST(coalesce(t, 0) AS DOUBLE) AS Top_Revenue,
       {pct('coalesce(t, 0)', 'total', 2, 1)} AS Top_Share_Pct FROM tot, top""")
ORACLE["e62_best_category_region"] = _R("""
, c AS (SELECT Category AS Best_Category, CAST(sum(Sales) AS DOUBLE) AS Best_Category_Sales FROM rowf WHERE Category IS NOT NULL
        GROUP BY Category ORDER BY sum(Sales) DESC, Category LIMIT 1),
r AS (SELECT Region AS Best_Region, CAST(sum(Sales) AS DOUBLE) AS Best_Region_Sales FROM rowf WHERE Region IS NOT NULL
      GROUP BY Region ORDER BY sum(Sales) DESC, Region LIMIT 1)
SELECT * FROM c, r""")
ORACLE["b14_filter_options"] = _F("""
SELECT * FROM (
  SELECT DISTINCT 'Year' AS Filter, CAST(Year AS VARCHAR) AS Value FROM features WHERE Year IS NOT NULL
  UNION ALL SELECT DISTINCT 'Category', Category FROM features WHERE Category IS NOT NULL
  UNION ALL SELECT DISTINCT 'Region', Region FROM features WHERE Region IS NOT NULL
  UNION ALL SELECT DISTINCT 'Customer_Segment', Customer_Segment FROM features WHERE Customer_Segment IS NOT NULL)
ORDER BY Filter, Value""")


# --- B01-B15 ---------------------------------------------------------------------
from .sqlparts import MESSY_ORDERS, quantiles_sql  # noqa: E402

_MESSY = f"WITH messy AS ({MESSY_ORDERS})\n"
ORACLE["b01_fill_numeric_median"] = _MESSY + f"""
SELECT o_orderkey, coalesce(CAST(price AS DOUBLE), q.m0) AS price FROM messy, ({quantiles_sql('messy', 'price', [0.5], 'm')}) q"""


def _mode_fill(col: str) -> str:
    return _MESSY + f"""
, st AS (SELECT count(*) AS rows, count(*) - count({col}) AS nulls FROM messy),
md AS (SELECT arg_min(v, struct_pack(a := -c, b := v)) AS mode_v FROM (SELECT {col} AS v, count(*) AS c FROM messy
       WHERE {col} IS NOT NULL GROUP BY 1))
SELECT o_orderkey, coalesce({col}, CASE WHEN st.nulls < st.rows * 0.1 THEN coalesce(md.mode_v, 'Unknown') ELSE 'Unknown' END) AS {col}
FROM messy, st, md"""


ORACLE["b02_fill_mode_few_nulls"] = _mode_fill("priority_few_nulls")
ORACLE["b02_fill_unknown_many_nulls"] = _mode_fill("priority_many_nulls")
ORACLE["b03_ffill_dates"] = _MESSY + """
SELECT o_orderkey, last_value(order_date IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_date
FROM messy"""

_SALES_COLS = ["Order_ID", "Customer_Name", "Customer_ID", "Product_Name", "Category", "Sub_Category", "Sales",
               "Profit", "Discount", "Quantity", "Order_Date", "Region", "Country", "State", "Payment_Mode"]
_DEDUPE_ORDER = ["Order_Date", "Product_Name", "Sales", "Profit", "Quantity"]
_DEDUPE_ORDER += [c for c in _SALES_COLS if c not in _DEDUPE_ORDER and c != "Order_ID"]
_DEDUPED = (f"SELECT {', '.join(_SALES_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY Order_ID ORDER BY "
            f"{', '.join(_DEDUPE_ORDER)}) AS rn FROM sales) WHERE rn = 1")
_CAP = ["Sales", "Profit", "Discount", "Quantity"]


def _bounds(src: str, floor: bool) -> str:
    parts = []
    for c in _CAP:
        q = f"({quantiles_sql(src, c, [0.05, 0.95], 'q')})"
        lo = "(q0 - CAST(1.5 AS DOUBLE) * (q1 - q0))"
        lo = f"greatest({lo}, 0.0)" if floor else lo
        parts.append(f"(SELECT {lo} AS lo_{c}, q1 + CAST(1.5 AS DOUBLE) * (q1 - q0) AS hi_{c} FROM {q})")
    return ", ".join(parts)


def _capped_select(src: str, floor: bool) -> str:
    cols = [f"least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) AS {c}" if c in _CAP else c for c in _SALES_COLS]
    return f"SELECT {', '.join(cols)} FROM {src}, {_bounds(src, floor)}"


ORACLE["b04_dedupe"] = f"WITH sales AS ({ADAPTER})\n{_DEDUPED}"
ORACLE["b05_duplicate_count"] = f"WITH sales AS ({ADAPTER})\nSELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS Duplicate_Count FROM (SELECT count(*) AS n FROM sales GROUP BY Order_ID)"
ORACLE["b06_cap_outliers"] = f"WITH sales AS ({ADAPTER})\n{_capped_select('sales', True)}"
ORACLE["b06_cap_outliers_keep_losses"] = f"WITH sales AS ({ADAPTER})\n{_capped_select('sales', False)}"
ORACLE["b07_outlier_counts"] = f"WITH sales AS ({ADAPTER}), b AS (SELECT * FROM {_bounds('sales', True)})\n" + \
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS Column, lo_{c} AS Lower_Bound, hi_{c} AS Upper_Bound, "
        f"CAST(count(CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN 1 END) AS BIGINT) AS Outliers "
        f"FROM sales, b GROUP BY lo_{c}, hi_{c}" for c in _CAP)
ORACLE["b09_parse_currency"] = _MESSY + """
SELECT o_orderkey, TRY_CAST(regexp_replace(price_text, '[$€£,]', '', 'g') AS DOUBLE) AS Sales FROM messy"""
ORACLE["b10_drop_nonpositive_sales"] = ORACLE["b09_parse_currency"] + \
    " WHERE TRY_CAST(regexp_replace(price_text, '[$€£,]', '', 'g') AS DOUBLE) > 0"
ORACLE["b12_clean"] = f"""WITH sales AS ({ADAPTER}), d AS ({_DEDUPED}), c AS ({_capped_select('d', True)})
SELECT * FROM c WHERE Sales > 0"""
ORACLE["b12_clean_audit"] = f"""WITH sales AS ({ADAPTER}), d AS ({_DEDUPED}), c AS ({_capped_select('d', True)})
SELECT n AS Step_No, step AS Step, CAST(b AS BIGINT) AS Rows_Before, CAST(a AS BIGINT) AS Rows_After FROM (
    SELECT 1 AS n, 'coerce_types' AS step, (SELECT count(*) FROM sales) AS b, (SELECT count(*) FROM sales) AS a
    UNION ALL SELECT 2, 'fill_missing', (SELECT count(*) FROM sales), (SELECT count(*) FROM sales)
    UNION ALL SELECT 3, 'dedupe', (SELECT count(*) FROM sales), (SELECT count(*) FROM d)
    UNION ALL SELECT 4, 'cap_outliers', (SELECT count(*) FROM d), (SELECT count(*) FROM d)
    UNION ALL SELECT 5, 'sales_positive', (SELECT count(*) FROM d), (SELECT count(*) FROM c WHERE Sales > 0))"""
ORACLE["b08_coerce_dates"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS Ship_Date FROM orders"""
ORACLE["b13_filter_sales"] = _F("""
SELECT Order_ID, Customer_ID, Product_Name, Year, Region, Customer_Segment, Sales FROM features
WHERE Year IN (1996, 1998) AND Region = 'ASIA' AND Customer_Segment = 'Gold'""")
ORACLE["b15_clip_lower"] = f"""WITH sales AS ({ADAPTER})
SELECT Order_ID, Product_Name, greatest(CAST(Profit AS DOUBLE), 0.0) AS Profit FROM sales"""


# --- F / G / J / C / E42-E43 -----------------------------------------------------
from .sqlparts import calendar_sql, customer_stats_sql, product_stats_sql  # noqa: E402

_SALES = f"WITH sales AS ({ADAPTER})\n"


def _label_sql(freq: str, d: str = "Order_Date") -> str:
    return {"D": d, "W": f"(CAST(date_trunc('week', {d}) AS DATE) + 6)", "M": f"last_day({d})",
            "Q": f"last_day(CAST(date_trunc('quarter', {d}) AS DATE) + INTERVAL 2 MONTH)"}[freq]


def _cal_sql(freq: str) -> str:
    if freq == "W":
        return "unnest(generate_series(lo, hi, INTERVAL 7 DAY))"
    if freq == "M":
        return "last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE))"
    return ("last_day(CAST(unnest(generate_series(date_trunc('quarter', lo), date_trunc('quarter', hi), INTERVAL 3 MONTH)) AS DATE)"
            " + INTERVAL 2 MONTH)")


def resample_sql(freq: str, keys: list[str]) -> str:
    """CTE body chain producing ts(keys..., Order_Date, Sales, Profit, Orders, Quantity, Avg_Discount)."""
    k = "".join(f"{x}, " for x in keys)
    nn = "".join(f" AND {x} IS NOT NULL" for x in keys)
    agg = (f"agg AS (SELECT {k}{_label_sql(freq)} AS lab, sum(Sales) AS s, sum(Profit) AS p, "
           f"count(DISTINCT Order_ID) AS o, CAST(sum(Quantity) AS BIGINT) AS q, {mean('Discount')} AS ad "
           f"FROM sales WHERE Order_Date IS NOT NULL{nn} GROUP BY ALL)")
    if freq == "D":
        base = "j AS (SELECT * FROM agg)"
    else:
        using = ", ".join(keys + ["lab"])
        base = (f"b AS (SELECT {k}min(lab) AS lo, max(lab) AS hi FROM agg GROUP BY ALL),\n"
                f"cal AS (SELECT {k}CAST({_cal_sql(freq)} AS DATE) AS lab FROM b),\n"
                f"j AS (SELECT {k}lab, coalesce(s, 0) AS s, coalesce(p, 0) AS p, CAST(coalesce(o, 0) AS BIGINT) AS o, "
                f"CAST(coalesce(q, 0) AS BIGINT) AS q, ad FROM cal LEFT JOIN agg USING ({using}))")
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    ts = (f"ts AS (SELECT {k}lab AS Order_Date, CAST(s AS DOUBLE) AS Sales, CAST(p AS DOUBLE) AS Profit, o AS Orders, "
          f"q AS Quantity, coalesce(last_value(ad IGNORE NULLS) OVER ({part}ORDER BY lab ROWS BETWEEN UNBOUNDED "
          f"PRECEDING AND CURRENT ROW), 0.0) AS Avg_Discount FROM j)")
    return f"{agg},\n{base},\n{ts}"


for _fq, _nm in (("D", "f01_resample_daily"), ("W", "f02_resample_weekly"), ("M", "f03_resample_monthly"),
                 ("Q", "f04_resample_quarterly")):
    ORACLE[_nm] = _SALES + ", " + resample_sql(_fq, []) + "\nSELECT * FROM ts"
ORACLE["f05_resample_monthly_per_customer"] = _SALES + ", " + resample_sql("M", ["Customer_ID"]) + "\nSELECT * FROM ts"
ORACLE["f05_resample_weekly_per_region"] = _SALES + ", " + resample_sql("W", ["Region"]) + "\nSELECT * FROM ts"
ORACLE["f07_future_months"] = _SALES + ", " + resample_sql("M", []) + """
SELECT CAST(h AS INTEGER) AS h, last_day(CAST(last_day(max(Order_Date) + 1) + to_months(CAST(h - 1 AS INTEGER)) AS DATE)) AS Order_Date
FROM ts, range(1, 7) t(h) GROUP BY h"""
ORACLE["f07_future_weeks_per_region"] = _SALES + ", " + resample_sql("W", ["Region"]) + """
SELECT Region, CAST(h AS INTEGER) AS h, CAST((CAST(date_trunc('week', max(Order_Date) + 1) AS DATE) + 6) + 7 * CAST(h - 1 AS INTEGER) AS DATE) AS Order_Date
FROM ts, range(1, 5) t(h) GROUP BY Region, h"""


def _roll(k: int) -> str:
    fr = f"OVER (PARTITION BY Region ORDER BY Order_Date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(Sales) {fr} >= {k} THEN "
            f"{half_up('sum(CAST(CAST(Sales AS DECIMAL(28,2)) * 100 AS HUGEINT)) ' + fr, str(k), 2, 6)} END "
            f"AS Sales_Rolling_{k}")


_LAGS = ", ".join(f"lag(Sales, {k}) OVER (PARTITION BY Region ORDER BY Order_Date) AS Sales_Lag_{k}" for k in (1, 2, 3, 7))
_G09 = (_SALES + ", " + resample_sql("W", ["Region"]) +
        f",\ng AS (SELECT Region, Order_Date, Sales, {_LAGS}, {_roll(7)}, {_roll(14)}, {_roll(30)} FROM ts)\n")
ORACLE["g09_g10_lag_features"] = _G09 + "SELECT * FROM g"
ORACLE["g11_drop_warmup"] = _G09 + "SELECT * FROM g WHERE Sales_Lag_7 IS NOT NULL AND Sales_Rolling_30 IS NOT NULL"
ORACLE["g12_tail"] = _SALES + ", " + resample_sql("D", []) + "\nSELECT * FROM ts ORDER BY Order_Date DESC LIMIT 90"
ORACLE["g13_chrono_split"] = _SALES + ", " + resample_sql("M", ["Region"]) + """
SELECT *, CAST(row_number() OVER (PARTITION BY Region ORDER BY Order_Date) <= floor(count(*) OVER (PARTITION BY Region) * 0.8) AS INTEGER) AS Is_Train
FROM ts"""

_DAILY = f"""daily AS (SELECT Order_Date, CAST(sum(Sales) AS DOUBLE) AS Sales, count(DISTINCT Order_ID) AS Orders,
       {mean('Sales')} AS Avg_Value FROM sales WHERE Order_Date IS NOT NULL GROUP BY Order_Date)"""
_IQR = f""", {_DAILY},
qq AS ({quantiles_sql('daily', 'Sales', [0.25, 0.75], 'q')}),
bnd AS (SELECT q0 - CAST(1.5 AS DOUBLE) * (q1 - q0) AS lo, q1 + CAST(1.5 AS DOUBLE) * (q1 - q0) AS hi FROM qq),
iqr AS (SELECT daily.*, CASE WHEN Sales > hi THEN 'Peak (High Sales)' ELSE 'Dip (Low Sales)' END AS Anomaly_Type
        FROM daily, bnd WHERE Sales < lo OR Sales > hi)
"""
ORACLE["j02_anomalies_iqr"] = _SALES + _IQR + "SELECT * FROM iqr"
ORACLE["e63_anomaly_breakdown"] = _SALES + _IQR + "SELECT Anomaly_Type, count(*) AS Count FROM iqr GROUP BY 1"
ORACLE["e63_first_anomalies"] = _SALES + _IQR + "SELECT Order_Date, Sales, Orders, Anomaly_Type FROM iqr ORDER BY Order_Date LIMIT 10"
ORACLE["d06_anomaly_overlay"] = _SALES + _IQR + """
SELECT daily.*, m.Anomaly_Type, CAST(m.Anomaly_Type IS NOT NULL AS INTEGER) AS Is_Anomaly
FROM daily LEFT JOIN (SELECT DISTINCT Order_Date, Anomaly_Type FROM iqr) m USING (Order_Date)"""
ORACLE["j03_anomalies_zscore"] = _SALES + f""", {_DAILY},
st AS (SELECT avg(Sales) AS mu, stddev_pop(Sales) AS sd FROM daily)
SELECT daily.*, CASE WHEN Sales > mu THEN 'Peak' ELSE 'Dip' END AS Anomaly_Type FROM daily, st
WHERE abs((Sales - mu) / sd) > 2"""
_J01 = _SALES + """, thr AS (SELECT avg(CAST(Sales AS DOUBLE)) + 3 * stddev_samp(CAST(Sales AS DOUBLE)) AS t FROM sales),
j01 AS (
SELECT Sales, Profit, Discount, Order_ID, Customer_Name, Product_Name, Category, Quantity, Order_Date, Region, Payment_Mode,
       CASE WHEN Sales > t THEN 'High Value Anomaly' WHEN Sales < 0 THEN 'Negative Sales'
            WHEN Discount > 0.7 THEN 'Extreme Discount' WHEN Profit < -1000 THEN 'Large Loss' END AS Anomaly_Type
FROM sales, thr WHERE Sales > t OR Sales < 0 OR Discount > 0.7 OR Profit < -1000)
"""
ORACLE["j01_anomalies_orders"] = _J01 + "SELECT * FROM j01"
ORACLE["e63_order_anomaly_breakdown"] = _J01 + "SELECT Anomaly_Type, count(*) AS Count FROM j01 GROUP BY 1"

ORACLE["c01_c09_calendar"] = _SALES + f"SELECT Order_ID, Product_Name, Order_Date, {calendar_sql()} FROM sales"
ORACLE["c10_c14_row_metrics"] = _R("""SELECT Order_ID, Product_Name, Sales, Profit, Quantity, Discount, Unit_Price,
Profit_Margin_Pct, Is_Profitable, Discounted_Price, Sales_Bucket FROM rowf""")
ORACLE["c17_quarter_label"] = _R("SELECT DISTINCT CAST(Year AS VARCHAR) || '-Q' || CAST(Quarter AS VARCHAR) AS Quarter_Label FROM rowf")
ORACLE["c18_truncated_labels"] = _R("""SELECT DISTINCT Product_Name, substr(Product_Name, 1, 20) || '...' AS Label_20,
CASE WHEN length(Product_Name) > 25 THEN substr(Product_Name, 1, 25) || '...' ELSE Product_Name END AS Label_25 FROM rowf""")
ORACLE["c21_ml_calendar"] = _SALES + ", " + resample_sql("D", []) + """
SELECT Order_Date, CAST(year(Order_Date) AS INTEGER) AS Year, CAST(month(Order_Date) AS INTEGER) AS Month,
       CAST(day(Order_Date) AS INTEGER) AS Day, CAST(isodow(Order_Date) - 1 AS INTEGER) AS DayOfWeek,
       CAST(quarter(Order_Date) AS INTEGER) AS Quarter, CAST(dayofyear(Order_Date) AS INTEGER) AS DayOfYear,
       CAST(weekofyear(Order_Date) AS INTEGER) AS WeekOfYear, CASE WHEN day(Order_Date) <= 7 THEN 1 ELSE 0 END AS IsMonthStart,
       CASE WHEN day(Order_Date) >= 21 THEN 1 ELSE 0 END AS IsMonthEnd, CASE WHEN isodow(Order_Date) >= 6 THEN 1 ELSE 0 END AS IsWeekend
FROM ts"""
ORACLE["c22_day_order"] = _R("""SELECT DISTINCT Day_Name, CAST(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday',
'Saturday', 'Sunday'], Day_Name) - 1 AS INTEGER) AS Day_Order FROM rowf""")
ORACLE["e42_customer_stats"] = _SALES + f"SELECT * FROM ({customer_stats_sql('sales')})"
ORACLE["e43_product_stats"] = _SALES + f"SELECT * FROM ({product_stats_sql('sales')})"
ORACLE["d01_d02_features"] = _F("SELECT * FROM features")


# --- K03 / K04 / I01 ---------------------------------------------------------------
def _naive_sql(freq: str, keys: list[str], periods: int) -> str:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    using = f"USING ({', '.join(keys + ['pidx'])})"
    if freq == "M":
        lab = "last_day(CAST(last_day(last + 1) + to_months(CAST(h - 1 AS INTEGER)) AS DATE))"
    else:
        lab = "CAST((CAST(date_trunc('week', last + 1) AS DATE) + 6) + 7 * CAST(h - 1 AS INTEGER) AS DATE)"
    return f""",
hist AS (SELECT {k}Order_Date, Sales, row_number() OVER ({part} ORDER BY Order_Date) AS rn, count(*) OVER ({part}) AS n FROM ts),
pat AS (SELECT {k}rn - (n - plen) - 1 AS pidx, Sales AS base, plen FROM
        (SELECT *, CASE WHEN n >= 90 THEN 90 WHEN n >= 7 THEN 7 ELSE n END AS plen FROM hist) WHERE rn > n - plen),
fut AS (SELECT {k}CAST(h AS INTEGER) AS h, max(Order_Date) AS last FROM ts, range(1, {periods + 1}) t(h) GROUP BY ALL),
fut2 AS (SELECT {k}{lab} AS Order_Date, (h - 1) % (SELECT max(plen) FROM pat p WHERE {' AND '.join(f'p.{x} = fut.{x}' for x in keys) or 'TRUE'}) AS pidx FROM fut)
SELECT {k}Order_Date, greatest(base, 0.0) AS Sales_Forecast, greatest(base, 0.0) * 0.7 AS Lower_Bound,
       greatest(base, 0.0) * 1.3 AS Upper_Bound
FROM fut2 JOIN pat {using}"""


ORACLE["k03_forecast_naive"] = _SALES + ", " + resample_sql("M", []) + _naive_sql("M", [], 6)
ORACLE["k03_forecast_naive_per_region"] = _SALES + ", " + resample_sql("W", ["Region"]) + _naive_sql("W", ["Region"], 8)

_MLCAL = """CAST(year(Order_Date) AS INTEGER) AS Year, CAST(month(Order_Date) AS INTEGER) AS Month,
       CAST(day(Order_Date) AS INTEGER) AS Day, CAST(isodow(Order_Date) - 1 AS INTEGER) AS DayOfWeek,
       CAST(quarter(Order_Date) AS INTEGER) AS Quarter, CAST(dayofyear(Order_Date) AS INTEGER) AS DayOfYear,
       CAST(weekofyear(Order_Date) AS INTEGER) AS WeekOfYear, CASE WHEN day(Order_Date) <= 7 THEN 1 ELSE 0 END AS IsMonthStart,
       CASE WHEN day(Order_Date) >= 21 THEN 1 ELSE 0 END AS IsMonthEnd, CASE WHEN isodow(Order_Date) >= 6 THEN 1 ELSE 0 END AS IsWeekend"""


def _roll1(k: int) -> str:
    fr = f"OVER (ORDER BY Order_Date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(Sales) {fr} >= {k} THEN "
            f"{half_up('sum(CAST(CAST(Sales AS DECIMAL(28,2)) * 100 AS HUGEINT)) ' + fr, str(k), 2, 6)} END "
            f"AS Sales_Rolling_{k}")


ORACLE["k04_boost_features"] = _SALES + ", " + resample_sql("M", []) + f""",
f AS (SELECT ts.*, {_MLCAL}, {', '.join(f'lag(Sales, {k}) OVER (ORDER BY Order_Date) AS Sales_Lag_{k}' for k in (1, 2, 3, 7))},
             {_roll1(7)}, {_roll1(14)}, {_roll1(30)} FROM ts)
SELECT * FROM f WHERE Sales_Lag_7 IS NOT NULL AND Sales_Rolling_30 IS NOT NULL"""


# --- L insights and reports ------------------------------------------------------------
def _q(s: str) -> str:
    return s.replace("'", "''")


def _tmpl(template: str, *args: str) -> str:
    parts = template.split("{}")
    out = [f"'{_q(parts[0])}'"]
    for a, p in zip(args, parts[1:]):
        out += [f"CAST({a} AS VARCHAR)", f"'{_q(p)}'"]
    return "concat(" + ", ".join(out) + ")"


def _f1(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


def _money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _argmax_sql(key: str, src: str = "features") -> str:
    return (f"(SELECT {key}, sum(Sales) AS s FROM {src} WHERE {key} IS NOT NULL GROUP BY {key} "
            f"ORDER BY s DESC, {key} LIMIT 1)")


def _insights_sql() -> str:
    from ..operators import insights as I
    g6 = pct("last - prev", "prev", 2, 6)
    g1 = pct("last - prev", "prev", 2, 1)
    l01 = (f"SELECT 1 AS Insight_No, CASE WHEN {g6} > 10 THEN {_tmpl(I.MSG_GROWTH_STRONG, _f1(g1))} "
           f"WHEN {g6} < -10 THEN {_tmpl(I.MSG_GROWTH_DECLINE, _f1('abs(' + g1 + ')'))} "
           f"ELSE {_tmpl(I.MSG_GROWTH_STABLE, _f1(g1))} END AS Insight FROM (SELECT count(*) AS n, arg_max(s, ym) AS last, "
           f"arg_min(s, ym) AS prev FROM (SELECT Year_Month AS ym, sum(Sales) AS s FROM features WHERE Year_Month IS NOT NULL "
           f"GROUP BY 1 ORDER BY 1 DESC LIMIT 2)) WHERE n >= 2")
    m6, m1 = mean("Profit_Margin_Pct", 2, 6), mean("Profit_Margin_Pct", 2, 1)
    l02 = (f"SELECT 2, CASE WHEN m6 > 30 THEN {_tmpl(I.MSG_MARGIN_STRONG, _f1('m1'))} WHEN m6 < 10 THEN "
           f"{_tmpl(I.MSG_MARGIN_LOW, _f1('m1'))} ELSE {_tmpl(I.MSG_MARGIN_HEALTHY, _f1('m1'))} END "
           f"FROM (SELECT {m6} AS m6, {m1} AS m1 FROM features)")
    l03 = (f"SELECT 3, {_tmpl(I.MSG_CUSTOMER, _f1('o'), _money('sp'))} FROM (SELECT {mean('Customer_Total_Orders', 0, 1)} AS o, "
           f"{mean('CAST(Customer_Total_Spent AS DECIMAL(28,2))', 2, 2)} AS sp FROM features)")
    l04 = (f"SELECT 4, {_tmpl(I.MSG_TOP_CATEGORY, 'c.Category', _f1(pct('c.s', 't.t', 2, 1)))} "
           f"FROM {_argmax_sql('Category')} c, (SELECT sum(Sales) AS t FROM features) t")
    l05s = f"SELECT 5, {_tmpl(I.MSG_PEAK_SEASON, 'Season')} FROM {_argmax_sql('Season')}"
    l06r = f"SELECT 6, {_tmpl(I.MSG_TOP_REGION, 'Region')} FROM {_argmax_sql('Region')}"
    l07p = f"SELECT 7, {_tmpl(I.MSG_TOP_PAYMENT, 'Payment_Mode')} FROM {_argmax_sql('Payment_Mode')}"
    hi = "CASE WHEN CAST(Discount AS DOUBLE) > q1 THEN Profit_Margin_Pct END"
    lo = "CASE WHEN CAST(Discount AS DOUBLE) <= q0 THEN Profit_Margin_Pct END"
    l08 = (f"SELECT 8, {_tmpl(I.MSG_DISCOUNT, _f1('round(abs(CAST(h AS DECIMAL(24,6)) - CAST(l AS DECIMAL(24,6))), 1)'))} "
           f"FROM (SELECT {mean(hi, 2, 6)} AS h, {mean(lo, 2, 6)} AS l FROM features, "
           f"({quantiles_sql('features', 'Discount', [0.25, 0.75], 'q')}) qq) WHERE h < l")
    recs = [I.RECOMMENDATIONS_HEADER] + [f"  • {r}" for r in I.RECOMMENDATIONS]
    l09 = " UNION ALL ".join(f"SELECT {9 + i}, '{_q(r)}'" for i, r in enumerate(recs))
    return " UNION ALL ".join(f"({x})" for x in (l01, l02, l03, l04, l05s, l06r, l07p, l08)) + " UNION ALL " + l09


ORACLE["l01_l06_business_insights"] = _F(f"SELECT CAST(Insight_No AS INTEGER) AS Insight_No, Insight FROM ({_insights_sql()})")


def _summary_sql() -> str:
    from ..operators import insights as I
    margin = f"CASE WHEN s > 0 THEN {pct('p', 's', 2, 1)} ELSE 0.0 END"
    l1 = ("SELECT 1 AS Line_No, 'EXECUTIVE SUMMARY' AS Section, " +
          _tmpl(I.OVERVIEW,
                _money('s'), _money('p'), _f1(margin), "format('{:,}', n)", "format('{:,}', c)") +
          " AS Text FROM (SELECT sum(Sales) AS s, sum(Profit) AS p, count(DISTINCT Order_ID) AS n, "
          "count(DISTINCT Customer_ID) AS c FROM rowf)")
    l2 = (f"SELECT 2, 'KEY FINDINGS', {_tmpl(I.TOP_CATEGORY, 'Category', _money('s'))} "
          f"FROM {_argmax_sql('Category', 'rowf')}")
    l3 = (f"SELECT 3, 'KEY FINDINGS', {_tmpl(I.TOP_REGION, 'Region', _money('s'))} "
          f"FROM {_argmax_sql('Region', 'rowf')}")
    l4 = (f"SELECT 4, 'KEY FINDINGS', {_tmpl(I.TOP_DECILE, _f1(pct('coalesce(t, 0)', 'total', 2, 1)))} "
          "FROM (SELECT count(*) AS nc, sum(sp) AS total FROM spend) tot, "
          "(SELECT sum(sp) AS t FROM (SELECT sp, row_number() OVER (ORDER BY sp DESC, Customer_ID) AS rk FROM spend), "
          "(SELECT count(*) AS nc FROM spend) x WHERE rk <= floor(nc * 0.1)) top")
    l5 = (f"SELECT 5, 'KEY FINDINGS', {_tmpl(I.AVERAGE_ORDER, _money('a'), _f1('q'))} "
          f"FROM (SELECT {mean('Sales', 2, 2)} AS a, {mean('Quantity', 0, 1)} AS q FROM rowf)")
    recs = " UNION ALL ".join(f"SELECT {6 + i}, 'ACTIONABLE RECOMMENDATIONS', '{_q(r)}'"
                              for i, r in enumerate(I.SUMMARY_RECOMMENDATIONS))
    return " UNION ALL ".join(f"({x})" for x in (l1, l2, l3, l4, l5)) + " UNION ALL " + recs


ORACLE["l07_executive_summary"] = _R(
    ", spend AS (SELECT Customer_ID, sum(Sales) AS sp FROM rowf WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID)\n"
    f"SELECT CAST(Line_No AS INTEGER) AS Line_No, Section, Text FROM ({_summary_sql()})")


def _report_sql() -> str:
    ts = "strftime(CAST({} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    d = lambda x: f"'$' || {_money(x)}"
    nul = "CAST(NULL AS VARCHAR)"

    def sec(no, name, header, cells, src, order):
        hdr = [f"'{h}'" for h in header] + [nul] * (5 - len(header))
        body = [f"CAST({c} AS VARCHAR)" for c in cells] + [nul] * (5 - len(cells))
        return (f"SELECT {no} AS Section_No, '{name}' AS Section, 0 AS Row_No, {', '.join(f'{h} AS C{i + 1}' for i, h in enumerate(hdr))} "
                f"UNION ALL SELECT {no}, '{name}', row_number() OVER (ORDER BY {order}), {', '.join(body)} FROM {src}")
    ov = ("(SELECT count(*) AS rows_, count(DISTINCT Customer_ID) AS c, count(DISTINCT Product_Name) AS k, "
          f"count(DISTINCT Order_ID) AS n, min(Order_Date) AS d0, max(Order_Date) AS d1, sum(Sales) AS s, sum(Profit) AS p, "
          f"{mean('Sales', 2, 2)} AS aov, sum(Quantity) AS q FROM rowf)")
    overview = (f"(SELECT 0 AS pos, 'Total Records' AS k, CAST(rows_ AS VARCHAR) AS v FROM {ov} UNION ALL "
                f"SELECT 1, 'Total Customers', CAST(c AS VARCHAR) FROM {ov} UNION ALL SELECT 2, 'Total Products', CAST(k AS VARCHAR) FROM {ov} "
                f"UNION ALL SELECT 3, 'Total Orders', CAST(n AS VARCHAR) FROM {ov} UNION ALL "
                f"SELECT 4, 'Date Range', {ts.format('d0')} || ' to ' || {ts.format('d1')} FROM {ov})")
    kpi = (f"(SELECT 0 AS pos, 'Total Revenue' AS k, {d('s')} AS v FROM {ov} UNION ALL SELECT 1, 'Total Profit', {d('p')} FROM {ov} "
           f"UNION ALL SELECT 2, 'Profit Margin', format('{{:.2f}}', {pct('p', 's')}) || '%' FROM {ov} UNION ALL "
           f"SELECT 3, 'Average Order Value', {d('aov')} FROM {ov} UNION ALL SELECT 4, 'Total Units Sold', CAST(CAST(q AS BIGINT) AS VARCHAR) FROM {ov})")
    cust = (f"(SELECT Customer_Name, sum(Sales) AS ts_, count(DISTINCT Order_ID) AS o, {mean('Sales')} AS av FROM rowf "
            f"WHERE Customer_Name IS NOT NULL GROUP BY 1 ORDER BY ts_ DESC, Customer_Name LIMIT 10)")
    cats = (f"(SELECT Category, sum(Sales) AS s, sum(Profit) AS p, {mean('Profit_Margin_Pct', 2, 2)} AS m, sum(Quantity) AS u "
            f"FROM rowf WHERE Category IS NOT NULL GROUP BY 1)")
    regs = ("(SELECT Region, sum(Sales) AS s, sum(Profit) AS p, count(DISTINCT Order_ID) AS n, count(DISTINCT Customer_ID) AS c "
            "FROM rowf WHERE Region IS NOT NULL GROUP BY 1)")
    mons = ("(SELECT Year_Month, sum(Sales) AS s, sum(Profit) AS p, count(DISTINCT Order_ID) AS n FROM rowf "
            "WHERE Year_Month IS NOT NULL GROUP BY 1)")
    parts = [
        sec(1, "DATASET OVERVIEW", ["Metric", "Value"], ["k", "v"], overview, "pos"),
        sec(2, "REVENUE KPIs", ["KPI", "Value"], ["k", "v"], kpi, "pos"),
        sec(3, "TOP 10 CUSTOMERS BY REVENUE", ["Customer Name", "Total Spent", "Orders", "Avg Order Value"],
            ["Customer_Name", d("ts_"), "o", d("round(CAST(av AS DECIMAL(24,6)), 2)")], cust, "ts_ DESC, Customer_Name"),
        sec(4, "CATEGORY PERFORMANCE", ["Category", "Sales", "Profit", "Margin", "Units Sold"],
            ["Category", d("s"), d("p"), "format('{:.2f}', m) || '%'", "CAST(u AS BIGINT)"], cats, "Category"),
        sec(5, "REGIONAL PERFORMANCE", ["Region", "Sales", "Profit", "Orders", "Customers"],
            ["Region", d("s"), d("p"), "n", "c"], regs, "Region"),
        sec(6, "MONTHLY SALES TRENDS", ["Month", "Sales", "Profit", "Orders"],
            ["Year_Month", d("s"), d("p"), "n"], mons, "Year_Month"),
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


ORACLE["l08_i02_summary_report"] = _R(
    f"SELECT Section_No, Section, CAST(Row_No AS INTEGER) AS Row_No, C1, C2, C3, C4, C5 FROM ({_report_sql()})")
ORACLE["l09_anomaly_report"] = _SALES + _IQR + """
SELECT CAST(Line_No AS INTEGER) AS Line_No, Text FROM (
  SELECT 1 AS Line_No, CASE WHEN count(*) = 0 THEN 'No anomalies detected in the dataset.'
                            ELSE 'Total anomalies detected: ' || CAST(count(*) AS VARCHAR) END AS Text FROM iqr
  UNION ALL SELECT 99, 'ANOMALY BREAKDOWN:' WHERE (SELECT count(*) FROM iqr) > 0
  UNION ALL SELECT 100 + row_number() OVER (ORDER BY c DESC, Anomaly_Type), '  ' || Anomaly_Type || ': ' || CAST(c AS VARCHAR)
            FROM (SELECT Anomaly_Type, count(*) AS c FROM iqr GROUP BY 1)
  UNION ALL SELECT 999, 'TOP ANOMALIES:' WHERE (SELECT count(*) FROM iqr) > 0
  UNION ALL SELECT 1000 + row_number() OVER (ORDER BY Order_Date),
            '  {''Order_Date'': Timestamp(''' || strftime(CAST(Order_Date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || '''), ''Sales'': '
            || CAST(CAST(Sales AS DECIMAL(28,2)) AS VARCHAR) || ', ''Orders'': ' || CAST(Orders AS VARCHAR)
            || ', ''Anomaly_Type'': ''' || Anomaly_Type || '''}'
            FROM (SELECT * FROM iqr ORDER BY Order_Date LIMIT 10))"""


# --- A --------------------------------------------------------------------------------
_ALLCOLS = None


def _feature_cols() -> list[str]:
    from .sqlparts import CUSTOMER_COLS, PRODUCT_COLS
    cal = ["Year", "Month", "Month_Name", "Quarter", "Day", "Day_of_Week", "Day_Name", "Week_of_Year", "Is_Weekend",
           "Is_Month_Start", "Is_Month_End", "Year_Month", "Season", "Is_Holiday_Season"]
    return (["Customer_ID", "Product_Name"] + [c for c in _SALES_COLS if c not in ("Customer_ID", "Product_Name")]
            + cal + ["Unit_Price", "Profit_Margin_Pct", "Is_Profitable", "Discounted_Price", "Sales_Bucket"]
            + CUSTOMER_COLS + PRODUCT_COLS)


ORACLE["a06_profile"] = _F(f"""
SELECT count(*) AS Rows, {len(_feature_cols())} AS Columns,
       CAST({' + '.join(f'count(*) - count({c})' for c in _feature_cols())} AS BIGINT) AS Total_Nulls,
       min(Order_Date) AS Date_Start, max(Order_Date) AS Date_End, {dsum('Sales')} AS Total_Sales,
       {dsum('Profit')} AS Total_Profit, count(DISTINCT Customer_ID) AS Unique_Customers,
       count(DISTINCT Product_Name) AS Unique_Products FROM features""")
ORACLE["a12_preview"] = f"WITH sales AS ({ADAPTER})\nSELECT * FROM sales ORDER BY {', '.join(_SALES_COLS)} LIMIT 100"
ORACLE["a10_run_sql"] = _F("""
SELECT Region, Year, CAST(SUM(Sales) AS DOUBLE) AS Total_Sales, COUNT(DISTINCT Order_ID) AS Order_Count
FROM features WHERE Year >= 1997 AND Customer_Segment = 'Platinum' GROUP BY Region, Year""")
ORACLE["a09_orders_table"] = _F("SELECT " + ", ".join(
    ["Order_ID", "Customer_Name", "Customer_ID", "Product_Name", "Category", "Sub_Category", "Sales", "Profit",
     "Discount", "Quantity", "Order_Date", "Region", "Country", "State", "Payment_Mode", "Year", "Month", "Quarter",
     "Day_of_Week", "Month_Name", "Season", "Is_Holiday_Season", "Year_Month", "Unit_Price", "Profit_Margin_Pct",
     "Is_Profitable", "Customer_Total_Spent", "Customer_Total_Orders", "Customer_Segment", "Product_Performance"])
    + " FROM features")
_NV = _naive_sql("M", [], 6)
_NV_CTES, _NV_SEL = _NV[:_NV.rindex("\nSELECT ")], _NV[_NV.rindex("\nSELECT "):]
ORACLE["i01_history_and_future"] = _SALES + ", " + resample_sql("M", []) + _NV_CTES + ", nv AS (" + _NV_SEL + """)
SELECT Order_Date, Sales AS Actual_Sales, CAST(NULL AS DOUBLE) AS Sales_Forecast, CAST(NULL AS DOUBLE) AS Lower_Bound,
       CAST(NULL AS DOUBLE) AS Upper_Bound FROM ts
UNION ALL SELECT Order_Date, CAST(NULL AS DOUBLE), Sales_Forecast, Lower_Bound, Upper_Bound FROM nv"""


def _holdout_naive_sql(train_frac: float = 0.8) -> str:
    """J06 on the naive model: first floor(n * frac) months train, the rest are scored."""
    ts_all = resample_sql("M", []).replace("\nts AS (", "\ntsall AS (", 1)
    split = f""",
sp AS (SELECT *, row_number() OVER (ORDER BY Order_Date) AS srn, count(*) OVER () AS sn FROM tsall),
ts AS (SELECT * EXCLUDE (srn, sn) FROM sp WHERE srn <= floor(sn * CAST({train_frac} AS DOUBLE))),
test AS (SELECT Order_Date, Sales FROM sp WHERE srn > floor(sn * CAST({train_frac} AS DOUBLE)))"""
    nv = _naive_sql("M", [], 1).replace("range(1, 2) t(h)", "(SELECT row_number() OVER () AS h FROM test) t")
    ctes, sel = nv[:nv.rindex("\nSELECT ")], nv[nv.rindex("\nSELECT "):]
    return (_SALES + ", " + ts_all + split + ctes + ", nv AS (" + sel + """),
pr AS (SELECT CAST(Sales AS DOUBLE) AS a, CAST(Sales_Forecast AS DOUBLE) AS f FROM test JOIN nv USING (Order_Date)),
m AS (SELECT sum(abs((a - f) / (a + 1e-10))) / count(*) * 100 AS mape, sqrt(sum((a - f) * (a - f)) / count(*)) AS rmse,
             sum(abs(a - f)) / count(*) AS mae, sum(2 * abs(a - f) / (abs(a) + abs(f) + 1e-10)) / count(*) * 100 AS smape,
             sum((a - f) * (a - f)) AS sse, sum(a) / count(a) AS mean_a, CAST(count(a) AS DOUBLE) AS n,
             sum(a * a) AS saa FROM pr)
SELECT mape, rmse, mae, smape, 1.0 - sse / nullif(saa - n * mean_a * mean_a, 0.0) AS r2 FROM m""")


# Double-valued metrics whose last bits depend on summation order (Spark's
# partial aggregates vs DuckDB's): checked with a relative tolerance in the
# tests, not offered as an exact oracle.
TOLERANT_ORACLE = {"j06_accuracy_naive_holdout": _holdout_naive_sql()}
