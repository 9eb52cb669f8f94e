"""Periods without a match."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators.analyses import trend


def test_filled_periods(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (1, 1, 5)], "ts timestamp")
    got = trend(df, F.lit(True), period="hour", fill=True).orderBy("period").collect()
    assert [(r.period.hour, r.n, r.change) for r in got] == [
        (1, 2, None), (2, 0, -2), (3, 0, 0), (4, 0, 0), (5, 1, 1)]
    got = trend(df, F.lit(True), start="2023-12-31 10:00:00", end="2024-01-02").orderBy(
        "period").collect()
    assert [(r.period.day, r.n) for r in got] == [(31, 0), (1, 3), (2, 0)]
    assert trend(df, F.lit(False), fill=True).count() == 0
