"""Forecasting over panels of period series.

A panel is the output of ``timeseries.resample`` with optional series keys.
Per-series work is a window over period rows (bounded by the calendar span,
never by fact rows) or partial sums of them. The boosted model is one global
Spark ML model over all series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ml_calendar_columns
from ..session import reliable_checkpoint, scratch_folder
from . import timeseries as TS

# Names and order of the model's inputs.
FEATURES = ["Year", "Month", "Day", "DayOfWeek", "Quarter", "DayOfYear", "WeekOfYear", "IsMonthStart",
            "IsMonthEnd", "IsWeekend", "Sales_Lag_1", "Sales_Lag_2", "Sales_Lag_3", "Sales_Lag_7",
            "Sales_Rolling_7", "Sales_Rolling_14", "Sales_Rolling_30"]

#: The features that follow from the date alone.
CALENDAR = [f for f in FEATURES if not f.startswith("Sales_")]


def _keys(series_cols):
    return list(series_cols or [])


# --- K03 seasonal-naive fallback ------------------------------------------------

def forecast_naive(ts: DataFrame, periods: int, freq: str, series_cols: list[str] | None = None,
                   noise: bool = False, seed: int = 42, date_col: str = "Order_Date",
                   value_col: str = "Sales") -> DataFrame:
    """Repeat the last 90 periods (or last 7, or all when shorter) of each series.

    Forecast = pattern[(h-1) mod len], clipped at 0; bounds x0.7 / x1.3.
    ``noise=True`` adds N(0, 0.1 * population std of the base forecast)
    drawn with a fixed seed (off by default so runs repeat).
    """
    keys = _keys(series_cols)
    w = Window.partitionBy(*keys).orderBy(date_col)
    wn = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(wn)
    plen = F.when(n >= 90, 90).when(n >= 7, 7).otherwise(n)
    hist = (ts.select(*keys, date_col, value_col)
              .withColumn("_rn", F.row_number().over(w)).withColumn("_n", n).withColumn("_len", plen))
    pattern = hist.filter(F.col("_rn") > F.col("_n") - F.col("_len")).select(
        *keys, (F.col("_rn") - (F.col("_n") - F.col("_len")) - 1).alias("_pidx"),
        F.col(value_col).alias("_base"), "_len")
    lens = pattern.select(*keys, "_len").distinct()
    fut = TS.future_dates(ts, periods, freq, keys, date_col).join(lens, keys) if keys else \
        TS.future_dates(ts, periods, freq, keys, date_col).crossJoin(F.broadcast(lens))
    fut = fut.withColumn("_pidx", F.pmod(F.col("h") - 1, F.col("_len")))
    out = fut.join(pattern.drop("_len"), keys + ["_pidx"])
    val = F.col("_base")
    if noise:
        sd = F.stddev_pop("_base").over(Window.partitionBy(*keys))
        val = val + F.randn(seed) * F.coalesce(sd, F.lit(0.0)) * 0.1
    val = F.greatest(val, F.lit(0.0))
    return (out.select(*keys, date_col, val.alias("Sales_Forecast"))
               .withColumns({"Lower_Bound": F.col("Sales_Forecast") * 0.7,
                             "Upper_Bound": F.col("Sales_Forecast") * 1.3}))


# --- K04 features -------------------------------------------------------------------

def boost_features(ts: DataFrame, series_cols: list[str] | None = None, date_col: str = "Order_Date",
                   drop_warmup: bool = True, exclude_current: bool = False) -> DataFrame:
    """Calendar inputs, lags 1/2/3/7 and trailing means 7/14/30 per series.

    A model must be trained with ``exclude_current=True``: its trailing means then
    hold only what is known before the period, as they do when it forecasts.
    """
    keys = _keys(series_cols)
    df = ts.withColumns(ml_calendar_columns(date_col))
    df = TS.lag_features(df, "Sales", series_cols=keys, date_col=date_col, exclude_current=exclude_current)
    if drop_warmup:
        df = TS.drop_warmup(df, ["Sales_Lag_7", "Sales_Rolling_30"])
    return df


# --- K05-K07 boosted trees -------------------------------------------------------------

#: Series with fewer usable rows (periods beyond the longest trailing mean) are forecast naively (fixed value).
MIN_USABLE = 10
#: The longest trailing mean among the features.
HISTORY = max(int(f.rsplit("_", 1)[1]) for f in FEATURES if f.startswith("Sales_Rolling_"))


def _with_length(ts: DataFrame, keys: list[str]) -> DataFrame:
    """``ts`` with ``_long``: the series has enough rows for the boosted model."""
    return ts.withColumn("_long", F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= HISTORY + MIN_USABLE)


def train_boosted(ts: DataFrame, series_cols: list[str] | None = None, max_iter: int = 100, max_depth: int = 6,
                  step_size: float = 0.1, subsample: float = 0.8, feature_subset: str = "0.8", seed: int = 42,
                  train_frac: float = 0.8, date_col: str = "Order_Date"):
    """One gradient-boosted tree model over the pooled panel.

    Chronological split per series (first ``train_frac`` of each series'
    usable rows train); features hold only what is known before a period.
    Series too short for the features are left to the naive forecast. Returns
    (model, scored holdout DataFrame); the model is None if all are too short.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    keys = _keys(series_cols)
    ts = _with_length(ts, keys).filter("_long").drop("_long")
    feats = TS.chrono_split(boost_features(ts, keys, date_col, exclude_current=True), train_frac, keys, date_col)
    feats = feats.withColumns({c: F.col(c).cast("double") for c in FEATURES + ["Sales"]})
    feats = reliable_checkpoint(feats)  # period rows; the scaler, each boosting set-up and the hold-out read them
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        GBTRegressor(featuresCol="features", labelCol="Sales", predictionCol="prediction", maxIter=max_iter,
                     maxDepth=max_depth, stepSize=step_size, subsamplingRate=subsample,
                     featureSubsetStrategy=feature_subset, seed=seed)])
    train = feats.filter(F.col("Is_Train") == 1)
    if train.isEmpty():
        return None, feats.select(*keys, date_col, F.col("Sales").alias("Actual"), F.lit(None).cast("double").alias("Forecast"))
    model = pipe.fit(train)
    test = model.transform(feats.filter(F.col("Is_Train") == 0)).select(
        *keys, date_col, F.col("Sales").alias("Actual"), F.col("prediction").alias("Forecast"))
    return model, test


def feature_importance(model, spark) -> DataFrame:
    """(Feature, Importance) from the fitted trees (a model-sized table)."""
    if model is None:
        return spark.createDataFrame([], "Feature string, Importance double")
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(FEATURES, [float(x) for x in imp]), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "Feature string, Importance double")


def forecast_recursive(model, ts: DataFrame, periods: int, freq: str, series_cols: list[str] | None = None,
                       date_col: str = "Order_Date") -> DataFrame:
    """Multi-step forecast feeding predictions back as history.

    Series too short for the model get the naive forecast (``Method`` tells).
    Each other series is one row: its last values, as many as the longest trailing
    mean needs, and the calendar inputs of the dates ahead. A task steps through
    the horizon for a batch of series at a time: lags and trailing means from the
    known values, the prediction from the trees as arrays (``Forest``), appended to
    the values. No job, join or checkpoint depends on the horizon.
    """
    keys = _keys(series_cols)
    history, every = HISTORY, _with_length(ts, keys)
    naive = forecast_naive(every.filter(F.lit(model is None) | ~F.col("_long")).drop("_long"), periods, freq, keys, date_col)
    naive = naive.select(*keys, date_col, *[F.col(c).cast("double").alias(c) for c in ("Sales_Forecast", "Lower_Bound", "Upper_Bound")],
                         F.lit("naive").alias("Method"))
    if model is None:
        return naive
    ts = every.filter("_long").drop("_long")
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    last = (ts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= history)
              .groupBy(*keys).agg(F.max(date_col).alias("_last"),
                                  F.sort_array(F.collect_list(F.struct(F.col(date_col), F.col("Sales").cast("double").alias("Sales"))))
                                  .alias("_hist")))
    known = last.select(*keys, F.col("_last").alias(date_col))
    calendar = TS.future_dates(known, periods, freq, keys, date_col).withColumns(ml_calendar_columns(date_col))
    ahead = calendar.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "h", F.col(date_col).alias("date"), F.array(*[F.col(c).cast("double") for c in CALENDAR]).alias("cal")))).alias("_ahead"))
    series = last.select(*keys, F.transform("_hist", lambda s: s["Sales"]).alias("_vals"))
    series = (series.join(ahead, keys) if keys else series.crossJoin(ahead)).select(  # without keys one row by one row
        *keys, "_vals", F.transform("_ahead", lambda x: x["date"]).alias("_dates"), F.transform("_ahead", lambda x: x["cal"]).alias("_cal"))
    schema = T.StructType([series.schema[k] for k in keys] + [T.StructField(date_col, T.DateType()), T.StructField("_pred", T.DoubleType())])
    forest = Forest.of(model)

    def run(batches):
        for pdf in batches:
            values = np.array(pdf["_vals"].tolist(), float).reshape(len(pdf), history)
            calendar = np.array([[list(c) for c in x] for x in pdf["_cal"]], float).reshape(len(pdf), periods, len(CALENDAR))
            made = []
            for h in range(periods):
                lags = values[:, [-1, -2, -3, -7]]
                means = np.stack([np.cumsum(values[:, -k:], axis=1)[:, -1] / k for k in (7, 14, 30)], axis=1)
                made.append(forest.predict(np.concatenate([calendar[:, h], lags, means], axis=1)))
                values = np.concatenate([values[:, 1:], made[-1][:, None]], axis=1)
            out = pdf[keys].loc[pdf.index.repeat(periods)].reset_index(drop=True)
            out[date_col] = [d for x in pdf["_dates"] for d in x]
            out["_pred"] = np.stack(made, axis=1).ravel() if made else np.zeros(0)
            yield out

    scored = series.mapInPandas(run, schema)
    return naive.unionByName(scored.select(
        *keys, date_col, F.greatest(F.col("_pred"), F.lit(0.0)).alias("Sales_Forecast"),
        F.greatest(F.col("_pred") * 0.8, F.lit(0.0)).alias("Lower_Bound"), (F.col("_pred") * 1.2).alias("Upper_Bound"), F.lit("boosted").alias("Method")))


class Forest:
    """A fitted boosted model as arrays, at most maxIter * (2^(maxDepth + 1) - 1) nodes, for
    scoring inside tasks without a job for each step."""

    def __init__(self, nodes: list[tuple], weights: list[float], mean: np.ndarray, scale: np.ndarray):
        trees = len(weights)
        size = 1 + max(n for _, n, *_ in nodes)
        self.feature, self.left, self.right = (np.full((trees, size), -1) for _ in range(3))
        self.threshold, self.value = np.zeros((trees, size)), np.zeros((trees, size))
        for t, n, value, left, right, feature, threshold in nodes:
            self.value[t, n] = value
            if left >= 0:
                self.left[t, n], self.right[t, n], self.feature[t, n], self.threshold[t, n] = left, right, feature, threshold
        self.weights, self.mean, self.scale = np.array(weights), mean, scale

    @staticmethod
    def of(model) -> "Forest":
        """Read from the model's own saved form, written to the shared checkpoint folder."""
        boosted, scaler = model.stages[-1], model.stages[1]
        spark = SparkSession.getActiveSession()
        path = f"{scratch_folder(spark, 'boosted')}/model"
        boosted.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).collect()
        std = np.array(scaler.std.toArray())
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
        return Forest([tuple(r) for r in rows], list(boosted.treeWeights), np.array(scaler.mean.toArray()), scale)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of raw features."""
        x, out, rows = (x - self.mean) * self.scale, np.zeros(len(x)), np.arange(len(x))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(self.feature[t, at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                left = x[rows[inner], self.feature[t, node]] <= self.threshold[t, node]
                at[inner] = np.where(left, self.left[t, node], self.right[t, node])
            out += weight * self.value[t, at]
        return out


# --- K01/K02 seasonal additive model on log scale -------------------------------------

SEASONAL_SCHEMA = T.StructType([
    T.StructField("Order_Date", T.DateType()), T.StructField("Sales_Forecast", T.DoubleType()),
    T.StructField("Lower_Bound", T.DoubleType()), T.StructField("Upper_Bound", T.DoubleType()),
    T.StructField("Actual_Sales", T.DoubleType()), T.StructField("Trend", T.DoubleType()),
    T.StructField("Yearly_Seasonality", T.DoubleType()), T.StructField("Is_Future", T.IntegerType())])
#: Series with fewer periods are forecast by the K03 rule (fixed value).
MIN_SEASONAL = 10
#: Orders of the yearly waves by frequency; days also have waves of a week and of a month (period, order).
YEARLY_ORDER = {"D": 10, "W": 10, "M": 5, "Q": 1}
DAILY_WAVES = ((7.0, 3), (30.5, 5))


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    cols = []
    for k in range(1, order + 1):
        a = 2 * math.pi * k * days / period
        cols += [np.sin(a), np.cos(a)]
    return np.column_stack(cols)


def _hinges(n: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """[row, hinge]: changepoints spread evenly up to ``end``, fewer on short series
    (those are never reached, and their columns stay zero)."""
    count = np.minimum(most, np.maximum(np.floor(0.8 * n).astype(int) - 1, 0))[:, None]
    k = np.arange(1, most + 1)[None, :]
    return np.where(k <= count, end[:, None] * k / (count + 1), np.inf)


def _design(pdf: pd.DataFrame, freq: str, most: int) -> tuple[np.ndarray, int, int]:
    """Design rows of any series' periods, columns of the trend, and of trend and year."""
    days = (pd.to_datetime(pdf["Order_Date"]) - pd.Timestamp(0)).dt.days.to_numpy(float)
    t = (days - pdf["_first"].to_numpy(float)) / pdf["_span"].to_numpy(float)
    hinges = np.maximum(0.0, t[:, None] - _hinges(pdf["_n"].to_numpy(), pdf["_end"].to_numpy(float), most))
    yearly = _fourier(days, 365.25, YEARLY_ORDER[freq])
    parts = [np.ones_like(t)[:, None], t[:, None], hinges, yearly]
    parts += [_fourier(days, *w) for w in DAILY_WAVES] if freq == "D" else []
    return np.concatenate(parts, axis=1), 2 + most, 2 + most + yearly.shape[1]


def _solve(gram: np.ndarray, moment: np.ndarray, square: float, n: int, trend: int, cp_scale: float, season_scale: float):
    """Coefficients and residual spread of one series from its normal equations."""
    def spread(b: np.ndarray, at: np.ndarray) -> float:
        return max(float(square - 2 * b @ moment[at] + b @ gram[np.ix_(at, at)] @ b) / n, 0.0)

    # sigma^2 from a first fit without hinges
    plain = np.r_[0, 1, trend:len(moment)]
    first, *_ = np.linalg.lstsq(gram[np.ix_(plain, plain)], moment[plain], rcond=None)
    sigma2 = spread(first, plain) + 1e-9
    penalty = np.full(len(moment), sigma2 / season_scale ** 2)
    penalty[:2], penalty[2:trend] = 0.0, sigma2 / cp_scale ** 2
    beta = np.linalg.solve(gram + np.diag(penalty + 1e-9), moment)
    return beta, math.sqrt(spread(beta, np.arange(len(moment))))


def forecast_seasonal(ts: DataFrame, periods: int, freq: str, series_cols: list[str] | None = None,
                      changepoint_scale: float = 0.05, seasonality_scale: float = 10.0,
                      n_changepoints: int = 25) -> DataFrame:
    """Piecewise-linear trend + Fourier seasonality on log1p(y), ridge-penalised.

    Multiplicative on the original scale (additive on the log scale), 95 %
    interval from the residual spread, fewer than 10 points -> K03 rule (``Method`` tells).
    No series is gathered into a group: each task adds the products of its period
    rows' design (at most some 60 x 60) to the normal equations of their series,
    those partial sums are added up and solved once for each series, and the
    fitted rows, history and future (``Is_Future``), are computed where they lie.
    """
    keys = _keys(series_cols)
    src = ts.select(*keys, "Order_Date", F.greatest(F.col("Sales").cast("double"), F.lit(0.0)).alias("_y"))

    def epoch_day(c: str):
        return F.unix_date(F.col(c))

    dates = F.array_sort(F.collect_list("Order_Date"))  # a period is a row: bounded by the calendar
    info = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), dates.alias("_dates")).withColumns({
        "_lo": F.col("_dates")[0], "_hi": F.element_at("_dates", -1),
        "_mid": F.element_at("_dates", F.floor(F.lit(0.8) * (F.col("_n") - 1)).cast("int") + 1)})
    info = info.select(*keys, "_n", epoch_day("_lo").cast("double").alias("_first"),
                       F.greatest(F.datediff("_hi", "_lo"), F.lit(1)).cast("double").alias("_span"), F.datediff("_mid", "_lo").alias("_end"))
    info = info.withColumn("_end", F.col("_end") / F.col("_span"))

    def beside(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.join(other, keys) if keys else df.crossJoin(F.broadcast(other))  # without keys ``other`` is one row

    long, short = info.filter(F.col("_n") >= MIN_SEASONAL), info.filter(F.col("_n") < MIN_SEASONAL).select(*keys, "_n")
    rows = beside(src, long)
    key_fields = [ts.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    sums = T.StructType(key_fields + [T.StructField("gram", doubles), T.StructField("moment", doubles), T.StructField("square", T.DoubleType())])

    def products(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                if not len(part):
                    continue
                x, _, _ = _design(part, freq, n_changepoints)
                z = np.log1p(part["_y"].to_numpy(float))
                yield pd.DataFrame([(*(key if isinstance(key, tuple) else (key,)), (x.T @ x).ravel().tolist(), (x.T @ z).tolist(), float(z @ z))],
                                   columns=sums.fieldNames())

    found = rows.mapInPandas(products, sums).groupBy(*keys).agg(
        F.collect_list("gram").alias("gram"), F.collect_list("moment").alias("moment"), F.sum("square").alias("square"))
    # a series' partial sums: one for each task's batch that has some of its rows
    solved = T.StructType(key_fields + [T.StructField("_beta", doubles), T.StructField("_s", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                if not len(r["moment"]):
                    continue
                moment = np.sum([np.asarray(m, float) for m in r["moment"]], axis=0)
                gram = np.sum([np.asarray(g, float) for g in r["gram"]], axis=0).reshape(len(moment), len(moment))
                beta, s = _solve(gram, moment, r["square"], int(r["_n"]), 2 + n_changepoints, changepoint_scale, seasonality_scale)
                out.append((*[r[k] for k in keys], beta.tolist(), s))
            yield pd.DataFrame(out, columns=solved.fieldNames())

    models = beside(found, long.select(*keys, "_n")).mapInPandas(solve, solved)
    future = TS.future_dates(src, periods, freq, keys).select(*keys, "Order_Date", F.lit(None).cast("double").alias("_y"))
    every = beside(beside(src.unionByName(future), long), models)
    schema = T.StructType(key_fields + SEASONAL_SCHEMA.fields)

    def fitted(batches):
        for pdf in batches:
            x, trend, year = _design(pdf, freq, n_changepoints)
            beta = np.array(pdf["_beta"].tolist(), float).reshape(x.shape)
            fit, s = (x * beta).sum(axis=1), pdf["_s"].to_numpy(float)
            y = pdf["_y"].to_numpy(float)
            out = pdf[["Order_Date", *keys]].copy()
            out["Sales_Forecast"] = np.maximum(np.expm1(fit), 0.0)
            out["Lower_Bound"] = np.maximum(np.expm1(fit - 1.96 * s), 0.0)
            out["Upper_Bound"] = np.expm1(fit + 1.96 * s)
            out["Actual_Sales"] = y
            out["Trend"] = np.expm1((x[:, :trend] * beta[:, :trend]).sum(axis=1))
            out["Yearly_Seasonality"] = np.exp((x[:, trend:year] * beta[:, trend:year]).sum(axis=1)) - 1
            out["Is_Future"] = np.isnan(y).astype(np.int32)
            yield out[schema.fieldNames()]

    naive = forecast_naive(beside(ts, short).drop("_n"), periods, freq, keys)
    none = F.lit(None).cast("double")
    naive = naive.select(*keys, "Order_Date", *[F.col(c).cast("double").alias(c) for c in ("Sales_Forecast", "Lower_Bound", "Upper_Bound")],
                         none.alias("Actual_Sales"), none.alias("Trend"), none.alias("Yearly_Seasonality"), F.lit(1).alias("Is_Future"),
                         F.lit("naive").alias("Method"))
    fit = every.mapInPandas(fitted, schema).withColumns({
        "Actual_Sales": F.when(~F.isnan("Actual_Sales"), F.col("Actual_Sales")), "Method": F.lit("seasonal")})
    return fit.unionByName(naive)


# --- D03/D04/I01 -----------------------------------------------------------------

def attach_actuals(fc: DataFrame, ts: DataFrame, series_cols: list[str] | None = None,
                   date_col: str = "Order_Date") -> DataFrame:
    """Forecast rows left-joined to actuals."""
    keys = _keys(series_cols)
    return fc.join(ts.select(*keys, date_col, F.col("Sales").alias("Actual_Sales")), keys + [date_col], "left")


def future_only(fc: DataFrame, ts: DataFrame, series_cols: list[str] | None = None,
                date_col: str = "Order_Date") -> DataFrame:
    """Forecast rows without an actual (anti join)."""
    keys = _keys(series_cols)
    return fc.join(ts.select(*keys, date_col), keys + [date_col], "left_anti")


def history_and_future(ts: DataFrame, fc: DataFrame) -> DataFrame:
    """History rows (Actual_Sales) and forecast rows (values kept) in one frame."""
    hist = ts.select(*[c for c in ts.columns if c not in ("Sales",)], F.col("Sales").alias("Actual_Sales"))
    keep = [c for c in hist.columns if c in ("Order_Date", "Actual_Sales") or c in fc.columns]
    return hist.select(*keep).unionByName(fc, allowMissingColumns=True)


def compare_models(metrics: dict[str, DataFrame]) -> DataFrame:
    """(Model, Metric, Value) rows from per-model one-row metric frames."""
    parts = []
    for name, m in metrics.items():
        cols = [c for c in m.columns]
        arr = F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(c).cast("double").alias("Value")) for c in cols])
        parts.append(m.select(F.lit(name).alias("Model"), F.inline(arr)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holdout_split(ts: DataFrame, train_frac: float = 0.8, series_cols: list[str] | None = None,
                  date_col: str = "Order_Date") -> tuple[DataFrame, DataFrame]:
    """Chronological train / test frames per series."""
    s = TS.chrono_split(ts, train_frac, series_cols, date_col)
    return s.filter("Is_Train = 1").drop("Is_Train"), s.filter("Is_Train = 0").drop("Is_Train")


def insample_forecasts(ts: DataFrame, freq: str, series_cols: list[str] | None = None) -> DataFrame:
    """Q6: the seasonal model's fitted values beside the actuals it was fitted on."""
    fc = forecast_seasonal(ts, 1, freq, series_cols).filter("Is_Future = 0")
    return fc.select(*_keys(series_cols), "Order_Date", F.col("Actual_Sales").alias("Actual"), F.col("Sales_Forecast").alias("Forecast"))


def holdout_forecasts(ts: DataFrame, freq: str, model: str = "seasonal", train_frac: float = 0.8,
                      series_cols: list[str] | None = None, date_col: str = "Order_Date") -> DataFrame:
    """Q6: fit on the first part of each series, forecast the rest, pair with actuals.

    The horizon is the longest test span of any series (a bounded
    calendar count read from a one-row aggregate).
    """
    keys = _keys(series_cols)
    ts = reliable_checkpoint(ts)  # period rows; read for the horizon, the fit and the pairs
    train, test = holdout_split(ts, train_frac, keys, date_col)
    horizon = test.groupBy(*keys).count().agg(F.max("count")).collect()[0][0] or 0
    if horizon == 0:
        return test.select(*keys, date_col, F.col("Sales").alias("Actual")).withColumn("Forecast", F.lit(None).cast("double"))
    if model == "seasonal":
        fc = forecast_seasonal(train, horizon, freq, keys).filter("Is_Future = 1")
    elif model == "naive":
        fc = forecast_naive(train, horizon, freq, keys)
    else:
        raise ValueError(f"Unknown model: {model}")
    return (test.select(*keys, date_col, F.col("Sales").cast("double").alias("Actual"))
                .join(fc.select(*keys, date_col, F.col("Sales_Forecast").alias("Forecast")), keys + [date_col]))
