"""Forecast operators: shapes and properties (rows-only in the oracle check)."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from retailops.operators import forecast as FC
from retailops.operators import iforest
from retailops.operators import timeseries as TS
from retailops.plans import prepare as P


def test_naive_forecast_pattern(spark, small_dir):
    ts = TS.resample(P.sales(spark, small_dir), "M")
    fc = FC.forecast_naive(ts, 6, "M").orderBy("Order_Date").toPandas()
    hist = ts.orderBy("Order_Date").toPandas()
    n = len(hist)
    plen = 90 if n >= 90 else 7 if n >= 7 else n
    pat = hist["Sales"].to_numpy()[-plen:]
    assert len(fc) == 6
    for h in range(6):
        assert abs(fc["Sales_Forecast"].iloc[h] - max(pat[h % plen], 0)) < 1e-9
    assert (fc["Order_Date"].iloc[0] > hist["Order_Date"].iloc[-1])


def test_seasonal_panel_rows(spark, small_dir):
    ts = TS.resample(P.sales(spark, small_dir), "M", ["Region"])
    fc = FC.forecast_seasonal(ts, 4, "M", ["Region"])
    per = fc.groupBy("Region").agg(F.sum("Is_Future").alias("f")).collect()
    assert all(r.f == 4 for r in per)
    assert fc.filter("Sales_Forecast < 0").count() == 0


def test_boosted_and_recursive(spark, small_dir):
    ts = TS.resample(P.sales(spark, small_dir), "M")
    model, test = FC.train_boosted(ts, max_iter=5)
    assert test.count() > 0
    out = FC.forecast_recursive(model, ts, 3, "M").collect()
    assert len(out) == 3 and all(r.Sales_Forecast >= 0 for r in out)


def test_isolation_forest_share(spark, small_dir):
    s = P.sales(spark, small_dir)
    n = TS.resample(s, "D").count()
    a = iforest.anomalies_isolation_forest(s, n_trees=20).count()
    assert 0 < a <= max(1, int(0.05 * n) + 1)


def recursive_slowly(model, ts, periods, freq, keys):
    """One model.transform for each step, as the library's own scoring gives it."""
    out, now = {}, ts.select(*keys, "Order_Date", F.col("Sales").cast("double").alias("Sales"))
    rows = {}
    for r in now.collect():
        rows.setdefault(tuple(r[k] for k in keys), []).append((r.Order_Date, r.Sales))
    hist = {k: [v for _, v in sorted(x)] for k, x in rows.items() if len(x) >= FC.HISTORY + FC.MIN_USABLE}
    ahead = {}
    for r in TS.future_dates(ts, periods, freq, keys).withColumns(FC.ml_calendar_columns("Order_Date")).collect():
        ahead[tuple(r[k] for k in keys), r.h] = r
    spark = ts.sparkSession
    for h in range(1, periods + 1):
        feats = []
        for k, v in hist.items():
            row = ahead[k, h]
            f = {c: float(row[c]) for c in FC.CALENDAR}
            f |= {f"Sales_Lag_{n}": v[-n] for n in (1, 2, 3, 7)}
            f |= {f"Sales_Rolling_{n}": sum(v[-n:]) / n for n in (7, 14, 30)}
            feats.append((list(hist).index(k), *[f[c] for c in FC.FEATURES]))
        made = model.transform(spark.createDataFrame(feats, ["_i", *FC.FEATURES])).select("_i", "prediction").collect()
        for r in made:
            k = list(hist)[r._i]
            hist[k].append(r.prediction)
            out[(*k, ahead[k, h].Order_Date)] = max(r.prediction, 0.0)
    return out


def test_recursive_forecast_is_that_of_single_steps(spark, small_dir):
    """A panel of regions, 60 weeks or more each: the same numbers as one scoring job for each step."""
    ts = TS.resample(P.sales(spark, small_dir), "W", ["Region"])
    model, _ = FC.train_boosted(ts, ["Region"], max_iter=12)
    got = {(r.Region, r.Order_Date): r for r in FC.forecast_recursive(model, ts, 4, "W", ["Region"]).collect()}
    want = recursive_slowly(model, ts, 4, "W", ["Region"])
    assert len(want) == 20 and got.keys() == want.keys()
    assert all(abs(got[k].Sales_Forecast - v) <= 1e-9 * max(1.0, abs(v)) and got[k].Method == "boosted" for k, v in want.items())


def test_isolation_forest_against_single_paths(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(__import__("datetime").date(2020, 1, 1) + __import__("datetime").timedelta(days=k), float(rng.normal(100, 20)), int(rng.integers(1, 9)),
             float(rng.normal(10, 2))) for k in range(400)]
    daily = spark.createDataFrame(rows, "Order_Date date, Sales double, Orders long, Avg_Value double").repartition(3)
    for sub, psi in ((daily, 256), (daily.limit(0), 0), (daily.filter("Order_Date < '2020-03-01'"), 60)):
        sizes = [r["count"] for r in iforest.sample_rows(sub, 7, 256, 42).groupBy("tree_id").count().collect()]
        assert sizes == [psi] * (7 if psi else 0)
    nodes = iforest.fit_forest(daily, n_trees=9)
    table = {(r.tree_id, r.node_id): r for r in nodes.collect()}
    assert all(table[t, 0].size == 256 for t in range(9))

    def path(t, x):
        node = table[t, 0]
        while node.feature >= 0:
            node = table[t, node.left if x[node.feature] < node.threshold else node.right]
        return node.depth + iforest.c_factor(node.size)
    scored = iforest.score_forest(daily, nodes, 256).collect()
    for r in scored:
        mean = sum(path(t, (r.Sales, r.Orders, r.Avg_Value)) for t in range(9)) / 9
        assert abs(r.Anomaly_Score + 2 ** (-mean / iforest.c_factor(256))) < 1e-12


# --- the seasonal model, one series at a time with numpy on whole design matrices

def _future_labels(last, periods, freq):
    out, d = [], last + pd.Timedelta(days=1)
    for _ in range(periods):
        lab = {"D": lambda: d, "W": lambda: d + pd.Timedelta(days=6 - d.weekday()), "M": lambda: d + pd.offsets.MonthEnd(0),
               "Q": lambda: d + pd.offsets.QuarterEnd(0)}[freq]()
        out.append(lab)
        d = lab + pd.Timedelta(days=1)
    return out


def seasonal_slowly(dates, y, periods, freq, cp=25, cp_scale=0.05, season_scale=10.0):
    """(date, forecast, lower, upper, trend, yearly) of one series."""
    y, dates = np.maximum(np.asarray(y, float), 0.0), [pd.Timestamp(d) for d in dates]
    n, every = len(y), dates + _future_labels(dates[-1], periods, freq)
    span = max((dates[-1] - dates[0]).days, 1)
    t = np.array([(d - dates[0]).days / span for d in every])
    days = np.array([(d - pd.Timestamp("1970-01-01")).days for d in every], float)
    count = min(cp, max(int(math.floor(0.8 * n)) - 1, 0))
    hinges = np.linspace(0, t[int(math.floor(0.8 * (n - 1)))], count + 2)[1:-1] if count else []

    def waves(period, order):
        return [f(2 * math.pi * k * days / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    trend = [np.ones_like(t), t] + [np.maximum(0.0, t - h) for h in hinges]
    yearly = waves(365.25, {"D": 10, "W": 10, "M": 5, "Q": 1}[freq])
    extra = waves(7.0, 3) + waves(30.5, 5) if freq == "D" else []
    x = np.column_stack(trend + yearly + extra)
    z, k = np.log1p(y), len(trend)
    plain = np.column_stack(trend[:2] + yearly + extra)[:n]
    first, *_ = np.linalg.lstsq(plain, z, rcond=None)
    sigma2 = np.mean((z - plain @ first) ** 2) + 1e-9
    lam = np.full(x.shape[1], sigma2 / season_scale ** 2)
    lam[:2], lam[2:k] = 0, sigma2 / cp_scale ** 2
    beta = np.linalg.solve(x[:n].T @ x[:n] + np.diag(lam + 1e-9), x[:n].T @ z)
    fit = x @ beta
    s = math.sqrt(np.mean((z - fit[:n]) ** 2))
    return [(d.date(), *v) for d, *v in zip(every, np.maximum(np.expm1(fit), 0), np.maximum(np.expm1(fit - 1.96 * s), 0), np.expm1(fit + 1.96 * s),
                                           np.expm1(x[:, :k] @ beta[:k]), np.exp(x[:, k:k + len(yearly)] @ beta[k:k + len(yearly)]) - 1)]


def test_seasonal_forecast_is_that_of_whole_series(spark, small_dir):
    sales = P.sales(spark, small_dir)
    for freq, keys, periods in (("M", [], 6), ("W", ["Region"], 8), ("Q", ["Region"], 3), ("D", [], 10)):
        ts = TS.resample(sales, freq, keys).repartition(5)
        rows = {}
        for r in ts.collect():
            rows.setdefault(tuple(r[k] for k in keys), []).append((r.Order_Date, r.Sales))
        want = {}
        for k, v in rows.items():
            v.sort()
            want |= {(*k, x[0]): x[1:] for x in seasonal_slowly([d for d, _ in v], [y for _, y in v], periods, freq)}
        got = FC.forecast_seasonal(ts, periods, freq, keys).collect()
        assert len(got) == len(want)
        for r in got:
            have = (r.Sales_Forecast, r.Lower_Bound, r.Upper_Bound, r.Trend, r.Yearly_Seasonality)
            assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(have, want[tuple(r[k] for k in keys) + (r.Order_Date,)])), (freq, r)
            assert (r.Actual_Sales is None) == (r.Is_Future == 1) and r.Method == "seasonal"


def test_seasonal_forecast_of_short_and_no_series(spark):
    import datetime as dt
    rows = [("a", dt.date(2020, 1, 31), 5.0), ("a", dt.date(2020, 2, 29), 7.0)]
    rows += [("b", (pd.Timestamp(2020, 1, 31) + pd.offsets.MonthEnd(k)).date(), 10.0 + k) for k in range(24)]
    ts = spark.createDataFrame(rows, "g string, Order_Date date, Sales double")
    got = FC.forecast_seasonal(ts, 3, "M", ["g"]).collect()
    assert sorted(r.Sales_Forecast for r in got if r.g == "a") == [5.0, 5.0, 7.0] and all(r.Is_Future == 1 and r.Method == "naive" for r in got if r.g == "a")
    assert sum(r.g == "b" for r in got) == 27
    assert FC.forecast_seasonal(ts.limit(0), 3, "M", ["g"]).count() == 0
    assert FC.forecast_seasonal(ts.limit(0).drop("g"), 3, "M").count() == 0
    assert FC.forecast_seasonal(ts.filter("g = 'a'").drop("g"), 2, "M").count() == 2
