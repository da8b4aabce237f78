"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Keys follow the operator IDs of the survey inventory (``e01_top_customers``).
Every query reads the provided tables (or frames Spark derives from them)
in full; limits appear only where a top-k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import bi
from . import prepare as P

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- E01-E11: SQL-origin BI queries ----------------------------------------
register("e01_top_customers")(lambda s, d: bi.top_customers(P.rows(s, d), 10))
register("e02_best_products")(lambda s, d: bi.best_products(P.rows(s, d), 10))
register("e03_profit_trends")(lambda s, d: bi.profit_trends(P.rows(s, d)))
register("e04_regional_analysis")(lambda s, d: bi.regional_analysis(P.rows(s, d)))
register("e05_monthly_analysis")(lambda s, d: bi.monthly_analysis(P.rows(s, d)))
register("e06_category_performance")(lambda s, d: bi.category_performance(P.rows(s, d)))
register("e07_customer_segment_analysis")(lambda s, d: bi.customer_segment_analysis(P.rows(s, d)))
register("e08_payment_mode_analysis")(lambda s, d: bi.payment_mode_analysis(P.rows(s, d)))
register("e09_seasonal_analysis")(lambda s, d: bi.seasonal_analysis(P.rows(s, d)))
register("e10_year_over_year_growth")(lambda s, d: bi.year_over_year_growth(P.rows(s, d)))
register("e11_kpi_summary")(lambda s, d: bi.kpi_summary(P.rows(s, d)))

# --- E12-E64: analysis result tables ----------------------------------------
from ..operators import analysis as AN  # noqa: E402

_ROWS = {  # need only row-level features
    "e12_daily_sales": AN.daily_sales,
    "e13_monthly_trends": AN.monthly_trends,
    "e14_quarterly_trends": AN.quarterly_trends,
    "e15_yearly_analysis": AN.yearly_analysis,
    "e16_day_of_week_analysis": AN.day_of_week_analysis,
    "e17_seasonal_summary": AN.seasonal_summary,
    "e20_region_performance": AN.region_performance,
    "e21_region_monthly": AN.region_monthly,
    "e22_region_profitability": AN.region_profitability,
    "e23_top_states": AN.top_states,
    "e25_category_summary": AN.category_summary,
    "e27_profit_by_category": AN.profit_by_category,
    "e28_profit_discount_analysis": AN.profit_discount_analysis,
    "e29_monthly_profit_trends": AN.monthly_profit_trends,
    "e30_most_profitable_products": AN.most_profitable_products,
    "e31_loss_making_products": AN.loss_making_products,
    "e32_category_stats": AN.category_stats,
    "e33_subcategory_stats": AN.subcategory_stats,
    "e34_category_trends": AN.category_trends,
    "e35_category_region": AN.category_region,
    "e36_monthly_revenue": AN.monthly_revenue,
    "e37_revenue_by_payment": AN.revenue_by_payment,
    "e39_revenue_distribution": AN.revenue_distribution,
    "e40_daily_revenue_trend": AN.daily_revenue_trend,
    "e41_generate_kpis": AN.generate_kpis,
    "e45_clv": AN.clv,
    "e46_region_rollup": AN.region_rollup,
    "e49_payment_analysis": AN.payment_analysis,
    "e50_category_month_pivot": AN.category_month_sales,
    "e51_top_customers_by_name": AN.top_customers_by_name,
    "e52_report_category_performance": AN.report_category_performance,
    "e53_report_regional_performance": AN.report_regional_performance,
    "e54_report_monthly_trends": AN.report_monthly_trends,
    "e55_dataset_overview": AN.dataset_overview,
    "e56_discount_metrics": AN.discount_metrics,
    "e57_discount_band_summary": AN.discount_band_summary,
    "e58_sales_by_category": AN.sales_by_category,
    "e58_sales_by_region": AN.sales_by_region,
    "e60_top_products_by_sales": AN.top_products_by_sales,
    "e61_top_decile_concentration": AN.top_decile_concentration,
    "e62_best_category_region": AN.best_category_region,
    "e64_insight_kpis": AN.insight_kpis,
}
_LABELLED = {  # group by a customer or product label, found at that grain
    "e18_customer_profiles": AN.customer_profiles,
    "e19_segment_distribution": AN.segment_distribution,
    "e38_revenue_by_segment": AN.revenue_by_segment,
    "e44_rfm_table": AN.rfm_table,
    "e47_segment_revenue_ordered": AN.segment_revenue_ordered,
    "e48_segment_analysis_table": AN.segment_analysis_table,
    "e59_segment_counts_ordered": AN.segment_counts_ordered,
    "h01_top_customer_profiles": AN.top_customer_profiles,
    "b14_filter_options": AN.filter_options,
    "e24_product_performance": AN.product_performance,
    "e26_performance_distribution": AN.performance_distribution,
    "h01_top_products": AN.top_products,
}


def _bind(fn, prep):
    return lambda s, d: fn(prep(s, d))


for _k, _f in {**_ROWS, **_LABELLED}.items():
    register(_k)(_bind(_f, P.rows))

# --- B01-B16: cleaning -------------------------------------------------------
from pyspark.sql import functions as _F  # noqa: E402

from ..operators import clean as CL  # noqa: E402
from ..sources.messy import orders_with_gaps, orders_with_text_dates  # noqa: E402


@register("b01_fill_numeric_median")
def _b01(s, d):
    return CL.fill_numeric_median(orders_with_gaps(s, d).select("o_orderkey", "price"), ["price"])


@register("b02_fill_mode_few_nulls")
def _b02a(s, d):
    return CL.fill_categorical_mode(orders_with_gaps(s, d).select("o_orderkey", "priority_few_nulls"),
                                    ["priority_few_nulls"])


@register("b02_fill_unknown_many_nulls")
def _b02b(s, d):
    return CL.fill_categorical_mode(orders_with_gaps(s, d).select("o_orderkey", "priority_many_nulls"),
                                    ["priority_many_nulls"])


@register("b03_ffill_dates")
def _b03(s, d):
    return CL.ffill_dates(orders_with_gaps(s, d).select("o_orderkey", "order_date"), ["order_date"], ["o_orderkey"])


register("b04_dedupe")(lambda s, d: CL.dedupe(P.sales(s, d), ["Order_ID"], CL.DEFAULT_ORDER))
register("b05_duplicate_count")(lambda s, d: CL.duplicate_count(P.sales(s, d), ["Order_ID"]))
register("b06_cap_outliers")(lambda s, d: CL.cap_outliers(P.sales(s, d)))
register("b06_cap_outliers_keep_losses")(lambda s, d: CL.cap_outliers(P.sales(s, d), floor=None))
register("b07_outlier_counts")(lambda s, d: CL.outlier_counts(P.sales(s, d)))


@register("b08_coerce_dates")
def _b08(s, d):
    return CL.coerce_dates(orders_with_text_dates(s, d))


@register("b09_parse_currency")
def _b09(s, d):
    return CL.parse_currency(orders_with_gaps(s, d).select("o_orderkey", _F.col("price_text").alias("Sales")),
                             ["Sales"])


@register("b10_drop_nonpositive_sales")
def _b10(s, d):
    return CL.drop_nonpositive_sales(_b09(s, d))


register("b12_clean")(lambda s, d: CL.clean(P.sales(s, d)))
register("b12_clean_audit")(lambda s, d: CL.clean_audit(P.sales(s, d)))


@register("b13_filter_sales")
def _b13(s, d):
    from ..operators.filters import filter_sales
    f = filter_sales(P.with_customers(s, d), years=[1996, 1998], category="All", region="ASIA", segment="Gold")
    return f.select("Order_ID", "Customer_ID", "Product_Name", "Year", "Region", "Customer_Segment", "Sales")


register("b15_clip_lower")(lambda s, d: CL.clip_lower(P.sales(s, d).select("Order_ID", "Product_Name", "Profit"),
                                                      "Profit", 0.0))
# B16 (filter after aggregation) is the HAVING of e31_loss_making_products.

# --- F / G time series, J anomalies, C row features, E42/E43 stats ------------
from ..functions.binning import label_rank as _label_rank  # noqa: E402
from ..functions.calendar import ml_calendar_columns as _mlcal, quarter_label as _qlabel  # noqa: E402
from ..functions.formatting import truncate_label as _trunc  # noqa: E402
from ..operators import anomaly as AM  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import timeseries as TS  # noqa: E402
from ..sources.schema import DAY_ORDER as _DAYS  # noqa: E402

for _fq, _nm in (("D", "f01_resample_daily"), ("W", "f02_resample_weekly"), ("M", "f03_resample_monthly"),
                 ("Q", "f04_resample_quarterly")):
    register(_nm)((lambda fq: lambda s, d: TS.resample(P.sales(s, d), fq))(_fq))
register("f05_resample_monthly_per_customer")(lambda s, d: TS.resample(P.sales(s, d), "M", ["Customer_ID"]))
register("f05_resample_weekly_per_region")(lambda s, d: TS.resample(P.sales(s, d), "W", ["Region"]))
register("f07_future_months")(lambda s, d: TS.future_dates(TS.resample(P.sales(s, d), "M"), 6, "M"))
register("f07_future_weeks_per_region")(lambda s, d: TS.future_dates(TS.resample(P.sales(s, d), "W", ["Region"]),
                                                                     4, "W", ["Region"]))


@register("g09_g10_lag_features")
def _g09(s, d):
    ts = TS.resample(P.sales(s, d), "W", ["Region"])
    return TS.lag_features(ts, "Sales", series_cols=["Region"]).select(
        "Region", "Order_Date", "Sales", "Sales_Lag_1", "Sales_Lag_2", "Sales_Lag_3", "Sales_Lag_7",
        "Sales_Rolling_7", "Sales_Rolling_14", "Sales_Rolling_30")


register("g11_drop_warmup")(lambda s, d: TS.drop_warmup(_g09(s, d), ["Sales_Lag_7", "Sales_Rolling_30"]))
register("g12_tail")(lambda s, d: TS.tail(TS.resample(P.sales(s, d), "D"), 90))
register("g13_chrono_split")(lambda s, d: TS.chrono_split(TS.resample(P.sales(s, d), "M", ["Region"]),
                                                          0.8, ["Region"]))
register("d06_anomaly_overlay")(lambda s, d: TS.anomaly_overlay(AM.daily_frame(P.sales(s, d)),
                                                                AM.anomalies_iqr(P.sales(s, d))))
register("j01_anomalies_orders")(lambda s, d: AM.anomalies_orders(P.sales(s, d)))
register("j02_anomalies_iqr")(lambda s, d: AM.anomalies_iqr(P.sales(s, d)))
register("j03_anomalies_zscore")(lambda s, d: AM.anomalies_zscore(P.sales(s, d)))
register("e63_anomaly_breakdown")(lambda s, d: AM.anomaly_breakdown(AM.anomalies_iqr(P.sales(s, d))))
register("e63_first_anomalies")(lambda s, d: AM.first_anomalies(AM.anomalies_iqr(P.sales(s, d)), 10))
register("e63_order_anomaly_breakdown")(lambda s, d: AM.anomaly_breakdown(AM.anomalies_orders(P.sales(s, d))))

_CAL = ["Year", "Month", "Month_Name", "Quarter", "Day", "Day_of_Week", "Day_Name", "Week_of_Year", "Is_Weekend",
        "Is_Month_Start", "Is_Month_End", "Year_Month", "Season", "Is_Holiday_Season"]
register("c01_c09_calendar")(lambda s, d: P.rows(s, d).select("Order_ID", "Product_Name", "Order_Date", *_CAL)
                             )
register("c10_c14_row_metrics")(lambda s, d: P.rows(s, d).select(
    "Order_ID", "Product_Name", "Sales", "Profit", "Quantity", "Discount", "Unit_Price", "Profit_Margin_Pct",
    "Is_Profitable", "Discounted_Price", "Sales_Bucket"))
register("c17_quarter_label")(lambda s, d: P.rows(s, d).select(_qlabel().alias("Quarter_Label")).distinct())
register("c18_truncated_labels")(lambda s, d: P.rows(s, d).select(
    "Product_Name", _trunc("Product_Name", 20).alias("Label_20"),
    _trunc("Product_Name", 25, always=False).alias("Label_25")).distinct())
register("c21_ml_calendar")(lambda s, d: TS.resample(P.sales(s, d), "D").select("Order_Date", *[
    v.alias(k) for k, v in _mlcal().items()]))
register("c22_day_order")(lambda s, d: P.rows(s, d).groupBy("Day_Name").count().select(
    "Day_Name", (_label_rank("Day_Name", _DAYS) - 1).alias("Day_Order")))
register("e42_customer_stats")(lambda s, d: FE.customer_stats(P.sales(s, d), as_of="max"))
register("e43_product_stats")(lambda s, d: FE.product_stats(P.sales(s, d)))
register("d01_d02_features")(lambda s, d: P.full(s, d))

# --- K forecasting -------------------------------------------------------------
from ..operators import forecast as FC  # noqa: E402


def _monthly(s, d):
    return TS.period_table(P.sales(s, d), "M", columns=["Sales"])


def _weekly_region(s, d):
    return TS.period_table(P.sales(s, d), "W", ["Region"], columns=["Sales"])


register("k03_forecast_naive")(lambda s, d: FC.forecast_naive(_monthly(s, d), 6, "M"))
register("k03_forecast_naive_per_region")(lambda s, d: FC.forecast_naive(_weekly_region(s, d), 8, "W", ["Region"]))
register("k04_boost_features")(lambda s, d: FC.boost_features(TS.resample(P.sales(s, d), "M")))
register("k01_seasonal_forecast")(lambda s, d: FC.forecast_seasonal(_monthly(s, d), 6, "M"))
register("k01_seasonal_forecast_per_region")(lambda s, d: FC.forecast_seasonal(_weekly_region(s, d), 8, "W",
                                                                                ["Region"]))


def _beside_monthly(fn):
    """``fn`` of the monthly series, which is read by the forecast and beside it."""
    return lambda s, d: fn(_monthly(s, d))


register("d04_future_only")(_beside_monthly(lambda ts: FC.future_only(
    FC.forecast_seasonal(ts, 6, "M").drop("Actual_Sales"), ts)))
register("d03_attach_actuals")(_beside_monthly(lambda ts: FC.attach_actuals(
    FC.forecast_seasonal(ts, 6, "M").drop("Actual_Sales"), ts)))
register("i01_history_and_future")(_beside_monthly(lambda ts: FC.history_and_future(
    ts, FC.forecast_naive(ts, 6, "M"))))
register("j06_accuracy_naive_holdout")(lambda s, d: AM.accuracy(FC.holdout_forecasts(_monthly(s, d), "M", "naive")))
register("j06_accuracy_seasonal_holdout")(lambda s, d: AM.accuracy(FC.holdout_forecasts(_monthly(s, d), "M",
                                                                                        "seasonal")))
register("j06_accuracy_seasonal_insample")(lambda s, d: AM.accuracy(FC.insample_forecasts(_monthly(s, d), "M")))


@register("k05_k06_boosted_holdout")
def _k05(s, d):
    _, test = FC.train_boosted(_monthly(s, d))
    return AM.accuracy(test).select("mae", "rmse", "r2", "mape")


@register("k07_feature_importance")
def _k07(s, d):
    model, _ = FC.train_boosted(_monthly(s, d))
    return FC.feature_importance(model, s)


@register("k08_recursive_forecast")
def _k08(s, d):
    ts = _monthly(s, d)
    model, _ = FC.train_boosted(ts)
    return FC.forecast_recursive(model, ts, 6, "M")


@register("k10_forecast_compare")
def _k10(s, d):
    ts = _monthly(s, d)
    _, test = FC.train_boosted(ts)
    return FC.compare_models({
        "seasonal": AM.accuracy(FC.holdout_forecasts(ts, "M", "seasonal")),
        "boosted": AM.accuracy(test),
        "naive": AM.accuracy(FC.holdout_forecasts(ts, "M", "naive"))})

# --- L insights and reports -------------------------------------------------------
from ..operators import insights as IN  # noqa: E402

register("l01_l06_business_insights")(lambda s, d: IN.business_insights(P.rows(s, d)))
register("l07_executive_summary")(lambda s, d: IN.executive_summary(P.rows(s, d)))
register("l08_i02_summary_report")(lambda s, d: IN.summary_report(P.rows(s, d)))
register("l09_anomaly_report")(lambda s, d: IN.anomaly_report(AM.anomalies_iqr(P.sales(s, d))))

# --- A sources / sinks ----------------------------------------------------------------
from ..sources import io as IO  # noqa: E402

register("a06_profile")(lambda s, d: IO.profile(P.full(s, d)))
register("a06_column_profile")(lambda s, d: IO.column_profile(P.full(s, d)))
register("a09_orders_table")(lambda s, d: IO.orders_table(P.full(s, d)))


@register("a10_run_sql")
def _a10(s, d):
    IO.save_orders_table(P.with_customers(s, d), view="orders_sql")
    return IO.run_sql(s, """SELECT Region, Year, CAST(SUM(Sales) AS DOUBLE) AS Total_Sales,
                                   COUNT(DISTINCT Order_ID) AS Order_Count
                            FROM orders_sql WHERE Year >= ? AND Customer_Segment = ?
                            GROUP BY Region, Year""", [1997, "Platinum"])


register("a12_preview")(lambda s, d: IO.preview(P.sales(s, d), 100))
register("j04_anomalies_isolation_forest")(lambda s, d: AM.detect_anomalies(P.sales(s, d), "isolation_forest"))


@register("k09_forecast_table")
def _k09(s, d):
    """Future rows of both models (the forecast step of the full run)."""
    ts = _monthly(s, d)
    model, _ = FC.train_boosted(ts)
    cols = ["Order_Date", "Sales_Forecast", "Lower_Bound", "Upper_Bound"]
    seasonal = FC.forecast_seasonal(ts, 6, "M").filter("Is_Future = 1")
    return (seasonal.select(_F.lit("seasonal").alias("Model"), *cols)
            .unionByName(FC.forecast_recursive(model, ts, 6, "M").select(_F.lit("boosted").alias("Model"), *cols)))
