"""Bundles compose lazily; sinks for metrics and models; metadata checks."""

from retailops.operators import anomaly as AM
from retailops.operators import clean as CL
from retailops.operators import forecast as FC
from retailops.operators import timeseries as TS
from retailops.plans import bundles as B
from retailops.plans import prepare as P
from retailops.sources import io as IO


def test_run_all_analyses_is_lazy_and_complete(spark, small_dir):
    res = B.run_all_analyses(P.full(spark, small_dir))
    assert set(res) == {"sales_trends", "customer_analysis", "regional_analysis", "product_analysis",
                        "profit_analysis", "category_analysis", "revenue_analysis", "kpis"}
    assert sum(len(v) for k, v in res.items() if k != "kpis") == 32
    assert res["kpis"]["kpis"].count() == 1


def test_run_forecasts_and_reports(spark, small_dir, tmp_path):
    feat = P.full(spark, small_dir)
    r = B.run_forecasts(feat, periods=3, max_iter=5)
    assert r["seasonal_future"].count() == 3 and r["boosted_future"].count() == 3
    paths = B.generate_all_reports(feat, str(tmp_path / "reports"), AM.anomalies_iqr(feat))
    assert spark.read.text(paths["anomaly_report"]).count() >= 1


def test_metrics_and_model_sinks(spark, small_dir, tmp_path):
    ts = TS.resample(P.sales(spark, small_dir), "M")
    model, test = FC.train_boosted(ts, max_iter=3)
    IO.write_metrics(AM.accuracy(test), str(tmp_path / "metrics"))
    assert set(spark.read.json(str(tmp_path / "metrics")).columns) >= {"mae", "rmse", "r2", "mape"}
    IO.save_model(model, str(tmp_path / "model"))
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(str(tmp_path / "model")).transform is not None
    IO.write_forecast(FC.forecast_naive(ts, 6, "M"), str(tmp_path / "fc"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fc")).count() == 6


def test_missing_recommended(spark):
    df = spark.createDataFrame([(1.0,)], "Sales double")
    assert CL.missing_recommended(df) == ["Order_ID", "Customer_Name", "Profit", "Order_Date", "Category"]
