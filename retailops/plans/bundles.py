"""Result bundles: the whole analysis, forecast and report sets as dicts of lazy DataFrames.

Nothing runs until a result is written or collected; the caller decides
what to materialise (for example ``write_processed`` the feature table
first and pass the re-read table in, so every bundle scans Parquet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as AN
from ..operators import anomaly as AM
from ..operators import bi
from ..operators import forecast as FC
from ..operators import insights as IN
from ..operators import timeseries as TS
from ..sources import io as IO


def run_sql_queries(feat: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """E01-E11."""
    return {
        "top_customers": bi.top_customers(feat, limit), "best_products": bi.best_products(feat, limit),
        "profit_trends": bi.profit_trends(feat), "regional_analysis": bi.regional_analysis(feat),
        "monthly_analysis": bi.monthly_analysis(feat), "category_performance": bi.category_performance(feat),
        "customer_segment_analysis": bi.customer_segment_analysis(feat),
        "payment_mode_analysis": bi.payment_mode_analysis(feat), "seasonal_analysis": bi.seasonal_analysis(feat),
        "year_over_year_growth": bi.year_over_year_growth(feat), "kpi_summary": bi.kpi_summary(feat),
        "anomalies": AM.anomalies_orders(feat),
    }


def run_all_analyses(feat: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """The seven analysis groups plus KPIs."""
    profiles = AN.customer_profiles(feat)
    return {
        "sales_trends": {"daily_sales": AN.daily_sales(feat), "monthly_trends": AN.monthly_trends(feat),
                         "quarterly_trends": AN.quarterly_trends(feat), "yearly_analysis": AN.yearly_analysis(feat),
                         "day_of_week_analysis": AN.day_of_week_analysis(feat),
                         "seasonal_analysis": AN.seasonal_summary(feat)},
        "customer_analysis": {"customer_profiles": profiles,
                              "top_customers": profiles.orderBy(F.col("Total_Spent").desc(), "Customer_ID").limit(10),
                              "segment_distribution": AN.segment_distribution(feat),
                              "rfm_analysis": profiles.select("Customer_ID", "Customer_Name", "R_Score", "F_Score",
                                                              "M_Score", "RFM_Score")},
        "regional_analysis": {"region_performance": AN.region_performance(feat),
                              "region_monthly": AN.region_monthly(feat),
                              "region_profitability": AN.region_profitability(feat),
                              "top_states": AN.top_states(feat)},
        "product_analysis": {"product_performance": AN.product_performance(feat), "top_products": AN.top_products(feat),
                             "category_summary": AN.category_summary(feat),
                             "performance_distribution": AN.performance_distribution(feat)},
        "profit_analysis": {"profit_by_category": AN.profit_by_category(feat),
                            "profit_discount_analysis": AN.profit_discount_analysis(feat),
                            "monthly_profit_trends": AN.monthly_profit_trends(feat),
                            "most_profitable_products": AN.most_profitable_products(feat),
                            "loss_making_products": AN.loss_making_products(feat)},
        "category_analysis": {"category_stats": AN.category_stats(feat), "subcategory_stats": AN.subcategory_stats(feat),
                              "category_trends": AN.category_trends(feat), "category_region": AN.category_region(feat)},
        "revenue_analysis": {"monthly_revenue": AN.monthly_revenue(feat), "revenue_by_payment": AN.revenue_by_payment(feat),
                             "revenue_by_segment": AN.revenue_by_segment(feat),
                             "revenue_distribution": AN.revenue_distribution(feat),
                             "daily_revenue_trend": AN.daily_revenue_trend(feat)},
        "kpis": {"kpis": AN.generate_kpis(feat)},
    }


def run_forecasts(feat: DataFrame, periods: int = 6, freq: str = "M",
                  series_cols: list[str] | None = None, max_iter: int = 100) -> dict[str, DataFrame]:
    """Resample, seasonal model, boosted model with recursive horizon, IQR anomalies, insights."""
    ts = TS.period_table(feat, freq, series_cols)
    seasonal = FC.forecast_seasonal(ts, periods, freq, series_cols)
    model, holdout = FC.train_boosted(ts, series_cols, max_iter=max_iter)
    boosted = FC.forecast_recursive(model, ts, periods, freq, series_cols)
    return {
        "timeseries": ts, "seasonal": seasonal, "seasonal_future": seasonal.filter("Is_Future = 1"),
        "boosted_future": boosted, "boosted_holdout": holdout,
        "accuracy": FC.compare_models({"seasonal": AM.accuracy(FC.holdout_forecasts(ts, freq, "seasonal", 0.8,
                                                                                    series_cols)),
                                       "boosted": AM.accuracy(holdout)}),
        "feature_importance": FC.feature_importance(model, feat.sparkSession),
        "anomalies": AM.anomalies_iqr(feat), "insights": IN.business_insights(feat),
    }


def forecast_table(feat: DataFrame, periods: int = 6, freq: str = "M", max_iter: int = 100) -> DataFrame:
    """K09 as one table: future rows of every model with a Model column."""
    r = run_forecasts(feat, periods, freq, None, max_iter)
    cols = ["Order_Date", "Sales_Forecast", "Lower_Bound", "Upper_Bound"]
    return (r["seasonal_future"].select(F.lit("seasonal").alias("Model"), *cols)
            .unionByName(r["boosted_future"].select(F.lit("boosted").alias("Model"), *cols)))


def generate_all_reports(feat: DataFrame, out_dir: str, anomalies: DataFrame | None = None) -> dict[str, str]:
    """Write the summary report, full export, insights summary and anomaly report under ``out_dir``."""
    paths = {"csv_report": f"{out_dir}/sales_report", "full_export": f"{out_dir}/full_export",
             "insights": f"{out_dir}/business_insights"}
    IO.write_csv(IN.summary_report(feat), paths["csv_report"])
    IO.export_full(feat, paths["full_export"])
    IO.write_text_report(IN.executive_summary(feat), paths["insights"])
    if anomalies is not None:
        paths["anomaly_report"] = f"{out_dir}/anomaly_report"
        IO.write_text_report(IN.anomaly_report(anomalies), paths["anomaly_report"])
    return paths
