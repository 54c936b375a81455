"""Queries over all bars take one pass: kernels against the windows and joins that they stand for, and the plans' steps."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import chan, kernels
from barloom.operators import indicators as ind
from barloom.plans import registry
from barloom.sources import tables as src

SF = "/root/testdata/sf0.001"
COLUMNS = "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    """Random walks of 1 to 400 bars, some volumes and closes missing, some volumes large."""
    rng, rows = np.random.default_rng(3), []
    for key, n in enumerate([400, 1, 2, 84, 86, 300, 0, 260]):
        close = 100 + np.cumsum(rng.integers(-100, 101, n + 1)) / 100
        for i in range(n):
            a, z = float(close[i]), float(close[i + 1])
            gone = key == 5 and i % 50 == 7
            volume = None if key == 3 and i % 9 == 0 else float(rng.integers(0, 50)) * (1e13 if key == 7 else 1)
            rows.append((f"s{key}", "1d", datetime(2024, 1, 1) + timedelta(days=i), a, max(a, z) + 0.01, min(a, z) - 0.01, None if gone else z, volume))
    return spark.createDataFrame(rows, COLUMNS)


def rounded(df, *names):
    """Rows as text, numbers to 6 places."""
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(f"{x:.6f}") + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())


def test_lines_are_those_of_the_windows(bars):
    names = [*ind.KEY, "datetime", *ind.MACD, *[m for m in ind.MEANS if m.startswith("ma")], "volume_ratio", "volume_ratio30", "n_rows"]
    one = ind.volume_ratios(ind.with_lines(bars, [*ind.MACD, *ind.MEANS, "n_rows"]))
    assert rounded(one, *names) == rounded(ind.with_averages(ind.with_macd(bars)), *names)


def test_lags_and_sums_stay_in_their_key(bars):
    got = ind.with_lines(bars, ["close_lag2", "dif0_sum5", "n_left"])
    macd = ind.with_macd(bars).withColumns({"close_lag2": ind.lag("close", 2), "dif0_sum5": F.sum("dif0").over(ind.trailing(5)), "n_left": F.count(F.lit(1)).over(ind.by_time().rowsBetween(1, 10**6)).cast("int")})
    names = ["symbol", "datetime", "close_lag2", "dif0_sum5", "n_left"]
    assert rounded(got, *names) == rounded(macd, *names)


def test_means_are_exact_beside_large_values():
    """A sum of doubles loses 0.25 beside 1e16, a running sum of them for good."""
    x = np.array([1e16] + [0.25] * 30 + [np.nan, 0.25, np.inf, 0.75])
    mean = kernels.moving_means(x, np.arange(len(x)), {"m": (3, 1)})["m"]
    assert mean[3:31].tolist() == [0.25] * 28 and mean[31:].tolist() == [0.25, 0.25, 0.25, 0.5]
    assert np.isnan(kernels.moving_means(x, np.arange(len(x)), {"m": (3, 3)})["m"][[0, 1, 31]]).all()


def test_last_rows_are_those_of_all_rows(bars):
    names = [*ind.KEY, "datetime", "ma250", "ma250_slope", "volatility", "breakout20", "golden_cross", "death_cross", "cross_quality", "volume_ratio30", "ma60_up", "n_rows", "hist0"]
    whole = ind.last_bars(ind.with_long_trend(ind.enriched(bars)), 60)
    assert rounded(ind.latest_enriched(bars), *names) == rounded(whole, *names)


def test_crossings_are_the_rows_of_the_join(spark, bars):
    market = src.daily_bars(spark, "/root/testdata/sf0.01").filter("symbol % 5 = 0").select(bars.columns)
    bars = bars.withColumn("symbol", F.concat(F.lit("walk"), "symbol")).unionByName(market)
    whole = chan.with_fresh(ind.enriched(bars), chan.chan_signals(bars))
    wanted = "golden_cross or death_cross or size(fresh) > 0"
    names = [*ind.KEY, "datetime", "close", "n_rows", "golden_cross", "death_cross", "zone", "confirmation_count", "volume_ratio", "above_ma60", "below_ma60", "ma60_up", "ma60_down", "price_change", "fresh_buy", "fresh_sell", F.col("fresh").cast("string")]
    one = chan.crossings(bars)
    assert rounded(one.filter(wanted), *names) == rounded(whole.filter(wanted), *names)
    assert one.filter("size(fresh) > 0").count() > 10 and one.count() < bars.count() / 3


def test_divergences_carry_the_last_row(bars):
    macd = ind.with_macd(bars)
    joined = ind.latest(macd).join(chan.divergences(macd), ind.KEY)
    names = ["symbol", "divergence", "datetime", "close", "hist0"]
    got = chan.divergences(ind.with_lines(bars, ["hist0"], 60).withColumn("at", F.col("datetime")), carry=["at", "close", "hist0"])
    assert rounded(got.withColumnRenamed("at", "datetime"), *names) == rounded(joined, *names)


def test_daily_bars_sort_once(spark):
    plan = src.daily_bars(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Window [") == 1


@pytest.mark.parametrize("name", ["c16_latest_snapshot", "c22_volume_sums", "d01_divergence", "d06_stroke_area", "e07_side_scores", "e09_zero_axis_scan", "h02_event_generation"])
def test_one_kernel_and_no_join(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    before_kernel = plan[: plan.index("MapInArrow")]
    assert "decimal(27,10)" not in before_kernel
