"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Pipeline as the analytics app runs it: build the feature table once and
write it as Parquet partitioned by Year (timed as ``prepare_features``),
then run each headline query against that table, once to warm up and once
timed (warm latency). Every query is executed in full through the ``noop``
sink (no driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


RAW = ["e01_top_customers", "e05_monthly_analysis", "e07_customer_segment_analysis", "e41_generate_kpis", "e44_rfm_table", "b04_dedupe",
       "b06_cap_outliers", "l01_l06_business_insights", "l08_i02_summary_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from retailops.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus), app_name="retailops-bench")

    from retailops.operators import analysis as AN
    from retailops.operators import anomaly as AM
    from retailops.operators import bi
    from retailops.operators import clean as CL
    from retailops.operators import insights as IN
    from retailops.operators import timeseries as TS
    from retailops.plans import prepare as P
    from retailops.sources import io as IO

    from retailops.plans.catalog import QUERIES

    # scratch tables live next to the checkpoints: on a cluster that is the
    # shared folder named by spark.checkpoint.dir, never a machine-local one
    from retailops.session import ensure_checkpoint_dir
    work = os.environ.get("BENCH_WORK_DIR") or f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    feat_path = f"{work}/features"
    sales_path = f"{work}/sales"

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM/JIT and file listing, not timed
    run(P.sales(spark, sf_dir).limit(1000))

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    timed("prepare_sales", lambda: P.sales(spark, sf_dir).write.mode("overwrite").parquet(sales_path))
    sales = spark.read.parquet(sales_path)
    from retailops.operators.features import features
    timed("prepare_features", lambda: IO.write_processed(features(sales, as_of="max"), feat_path))
    feat = spark.read.parquet(feat_path)

    headline = {
        "e01_top_customers": lambda: bi.top_customers(feat, 10),
        "e04_regional_analysis": lambda: bi.regional_analysis(feat),
        "e05_monthly_analysis": lambda: bi.monthly_analysis(feat),
        "e10_year_over_year_growth": lambda: bi.year_over_year_growth(feat),
        "e11_kpi_summary": lambda: bi.kpi_summary(feat),
        "e18_customer_profiles_rfm": lambda: AN.customer_profiles(feat),
        "e20_region_performance": lambda: AN.region_performance(feat),
        "e24_product_performance": lambda: AN.product_performance(feat),
        "e40_daily_revenue_trend": lambda: AN.daily_revenue_trend(feat),
        "e41_generate_kpis": lambda: AN.generate_kpis(feat),
        "e50_category_month_pivot": lambda: AN.category_month_sales(feat),
        "e61_top_decile_concentration": lambda: AN.top_decile_concentration(feat),
        "b12_clean": lambda: CL.clean(sales),
        "f03_resample_monthly_per_customer": lambda: TS.resample(sales, "M", ["Customer_ID"]),
        "j01_anomalies_orders": lambda: AM.anomalies_orders(sales),
        "j02_anomalies_iqr": lambda: AM.anomalies_iqr(sales),
        "l01_l06_business_insights": lambda: IN.business_insights(feat),
        "l08_summary_report": lambda: IN.summary_report(feat),
    }
    for name, build in headline.items():
        run(build())  # warm-up run (code generation, file listing)
        timed(name, lambda b=build: run(b()))

    total = round(sum(times.values()), 3)

    # registered queries from the raw tables, beside the suite (not in its total)
    raw: dict[str, float] = {}
    for name in RAW:
        run(QUERIES[name](spark, sf_dir))
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        raw[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "retail_analytics_suite_seconds", "value": total, "unit": "sec",
                      "queries": times, "raw_queries": raw, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus), "rows": feat.count()}))


if __name__ == "__main__":
    main()
