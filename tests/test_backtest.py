"""Backtest pieces: seasonal naive variants and the hold-out report."""

import datetime as dt

from pyspark.sql import functions as F

from tidecast.operators import baselines
from tidecast.operators.daily import holdout_split
from tidecast.plans.backtest import backtest_report

D0 = dt.date(2024, 1, 1)


def _planted(spark, days=120):
    rows = [("A", D0 + dt.timedelta(days=i), 100.0 * (1 + (D0 + dt.timedelta(days=i)).weekday())) for i in range(days)]
    return spark.createDataFrame(rows, "series_key string, date date, sales double")


def test_seasonal_naive_train_only_lookup(spark):
    split = holdout_split(_planted(spark), 30)
    p = {r.date: r for r in baselines.seasonal_naive(split).collect()}
    train_mean = split.where("role = 'train'").agg(F.avg("sales")).first()[0]
    days = sorted(p)
    # First week of the hold-out: exact weekday value from train (error 0).
    assert all(p[d].yhat == p[d].actual for d in days[:7])
    # Later days look into the hold-out itself, which the default never does.
    assert all(abs(p[d].yhat - train_mean) < 1e-9 for d in days[7:])


def test_seasonal_naive_recursive_repeats_last_week(spark):
    split = holdout_split(_planted(spark), 30)
    p = baselines.seasonal_naive(split, recursive=True).collect()
    assert len(p) == 30 and all(r.yhat == r.actual for r in p)


def test_backtest_report_ranks_models(spark, sf_small):
    rep = backtest_report(spark, sf_small, series="all").collect()
    assert {r.model for r in rep} == {"seasonal_naive", "last_week", "weekday_mean", "trailing_28"}
    assert sorted(r["rank"] for r in rep) == [1, 2, 3, 4]
    assert sum(r.is_best for r in rep) == 1
