"""The incremental daily table equals the batch resample over the same rows."""

import tempfile

from retailops.operators import timeseries as TS
from retailops.plans import prepare as P
from retailops.streaming.daily import read_daily, start_incremental_daily


def test_incremental_daily_matches_batch(spark, small_dir):
    work = tempfile.mkdtemp(prefix="retailops-stream-")
    sales = P.sales(spark, small_dir)
    a, b = sales.randomSplit([0.5, 0.5], seed=7)
    a.write.parquet(f"{work}/src/part=a")
    q = start_incremental_daily(spark, f"{work}/src", f"{work}/out", f"{work}/ckpt")
    q.awaitTermination(120)
    b.write.parquet(f"{work}/src/part=b")
    q = start_incremental_daily(spark, f"{work}/src", f"{work}/out", f"{work}/ckpt")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in read_daily(spark, f"{work}/out").collect())
    exp = sorted(tuple(r) for r in TS.resample(sales, "D", fill=False).collect())
    assert got == exp
