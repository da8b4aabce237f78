"""Readers, schema checks and sinks on hand-written CSV files."""

import tempfile

import pytest

from retailops.sources import io as IO
from retailops.sources.schema import REQUIRED_COLUMNS

ALIASED = ["Order ID", "Customer Name", "Customer ID", "Product Name", "Category", "Sub-Category", "Sales",
           "Profit", "Discount", "Quantity", "Order Date", "Region", "Country", "State", "Payment Mode"]
ROW = ["ORD-1", "Ann", "CUST-1", "Desk", "Furniture", "Tables", "$1,200.50", "100.25", "0.1", "2", "2024-02-03",
       "East", "US", "NY", "Card"]


def _csv(header, rows):
    d = tempfile.mkdtemp(prefix="retailops-test-")
    p = f"{d}/data.csv"
    with open(p, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(f'"{x}"' for x in r) + "\n")
    return p


def test_aliased_headers_are_mapped_and_typed(spark):
    df = IO.read_sales_csv(spark, _csv(ALIASED, [ROW]))
    ok, missing = IO.validate_schema(df)
    assert ok and not missing
    r = df.collect()[0]
    assert float(r.Sales) == 1200.5 and r.Quantity == 2 and str(r.Order_Date) == "2024-02-03"


def test_coverage_gate(spark):
    ten = _csv(REQUIRED_COLUMNS[:10], [ROW[:10]])
    nine = _csv(REQUIRED_COLUMNS[:9], [ROW[:9]])
    assert IO.schema_coverage(IO.read_sales_csv(spark, ten)) == 10
    assert IO.load_first_valid(spark, [nine, ten]).columns[:10] == REQUIRED_COLUMNS[:10]
    with pytest.raises(ValueError):
        IO.load_first_valid(spark, [nine])


def test_sinks_roundtrip(spark, tmp_path, small_dir):
    from retailops.plans import prepare as P
    f = P.rows(spark, small_dir)
    IO.write_processed(f, str(tmp_path / "features"))
    back = spark.read.parquet(str(tmp_path / "features"))
    assert back.count() == f.count() and "Year" in back.columns
    IO.write_processed(f, str(tmp_path / "features_rb"), rebalance=True)
    rb = spark.read.parquet(str(tmp_path / "features_rb"))
    assert rb.count() == f.count()
    assert sorted(r.Year for r in rb.select("Year").distinct().collect()) == \
        sorted(r.Year for r in f.select("Year").distinct().collect())
    IO.write_csv(f.limit(5), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    t = IO.save_orders_table(f, str(tmp_path / "orders"), view="orders_t")
    assert len(t.columns) <= 30
    assert IO.run_sql(spark, "SELECT count(*) AS n FROM orders_t WHERE Year >= ?", [1990]).collect()[0].n == f.count()
    from retailops.operators.insights import anomaly_report
    from retailops.operators.anomaly import anomalies_iqr
    IO.write_text_report(anomaly_report(anomalies_iqr(P.sales(spark, small_dir))), str(tmp_path / "rep"))
    lines = spark.read.text(str(tmp_path / "rep")).collect()
    assert lines[0].value.startswith("Total anomalies") or lines[0].value.startswith("No anomalies")
