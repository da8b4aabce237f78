"""Canonical sales schema and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the behaviour being matched) -----------------
# The 15 raw columns of a sales row, in canonical order.
REQUIRED_COLUMNS = [
    "Order_ID", "Customer_Name", "Customer_ID", "Product_Name", "Category",
    "Sub_Category", "Sales", "Profit", "Discount", "Quantity", "Order_Date",
    "Region", "Country", "State", "Payment_Mode",
]

# Header aliases accepted on read, mapped to canonical names.
COLUMN_ALIASES = {
    "Order ID": "Order_ID",
    "Customer Name": "Customer_Name",
    "Customer ID": "Customer_ID",
    "Product Name": "Product_Name",
    "Sub-Category": "Sub_Category",
    "Sub Category": "Sub_Category",
    "Order Date": "Order_Date",
    "Order_Date (DateOrders)": "Order_Date",
    "Payment Mode": "Payment_Mode",
}

# A candidate source is usable when it carries at least this many of the 15.
MIN_SCHEMA_COVERAGE = 10

# Columns whose absence is reported after cleaning.
RECOMMENDED_COLUMNS = ["Order_ID", "Customer_Name", "Sales", "Profit", "Order_Date", "Category"]

# Columns kept by the SQL-facing orders table, in order.
ORDERS_TABLE_COLUMNS = [
    "Order_ID", "Customer_Name", "Customer_ID", "Product_Name",
    "Category", "Sub_Category", "Sales", "Profit", "Discount",
    "Quantity", "Order_Date", "Region", "Country", "State", "Payment_Mode",
    "Year", "Month", "Quarter", "Day_of_Week", "Month_Name",
    "Season", "Is_Holiday_Season", "Year_Month", "Unit_Price",
    "Profit_Margin_Pct", "Is_Profitable", "Customer_Total_Spent",
    "Customer_Total_Orders", "Customer_Segment", "Product_Performance",
]

# Numeric-like columns parsed from currency strings.
NUMERIC_LIKE_COLUMNS = ["Sales", "Profit", "Discount", "Quantity", "Price", "Cost"]

# Columns whose outliers are capped.
OUTLIER_COLUMNS = ["Sales", "Profit", "Discount", "Quantity"]

# Ordered labels.
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
               "October", "November", "December"]
SEGMENT_LABELS = ["Bronze", "Silver", "Gold", "Platinum"]
PERFORMANCE_LABELS = ["Low", "Medium", "High", "Top"]
SEASON_BY_MONTH = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Fall", 10: "Fall", 11: "Fall",
}
HOLIDAY_MONTHS = [11, 12]

# Sales buckets: right-closed edges and labels.
SALES_BUCKET_EDGES = [0, 50, 200, 500, 1000, 5000, float("inf")]
SALES_BUCKET_LABELS = ["Very Low", "Low", "Medium", "High", "Very High", "Premium"]
# Discount bins of the profit analysis: 0, 0.1, ..., 0.7, right-closed.
DISCOUNT_ANALYSIS_EDGES = ["0.0", "0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7"]
# Discount bands of the PDF report.
DISCOUNT_REPORT_EDGES = ["0", "0.1", "0.2", "0.3", "0.5", "1.0"]

# Order-level anomaly rules.
ANOMALY_SIGMA = 3
ANOMALY_DISCOUNT = 0.7
ANOMALY_LOSS = -1000
ANOMALY_LABELS = ["High Value Anomaly", "Negative Sales", "Extreme Discount", "Large Loss"]

# --- schema ---------------------------------------------------------------
RAW_SCHEMA = T.StructType([
    T.StructField("Order_ID", T.StringType()),
    T.StructField("Customer_Name", T.StringType()),
    T.StructField("Customer_ID", T.StringType()),
    T.StructField("Product_Name", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Sub_Category", T.StringType()),
    T.StructField("Sales", T.DecimalType(18, 2)),
    T.StructField("Profit", T.DecimalType(18, 2)),
    T.StructField("Discount", T.DecimalType(4, 2)),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("Order_Date", T.DateType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Country", T.StringType()),
    T.StructField("State", T.StringType()),
    T.StructField("Payment_Mode", T.StringType()),
])


def string_schema(columns: list[str]) -> T.StructType:
    """All-string schema for header CSVs (types are applied afterwards)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
