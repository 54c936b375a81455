"""Kernels over tables of many keys against one key at a time."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.operators import backtest, batches, kernels
from barloom.operators import indicators as ind


def walks(n_keys: int, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(n_keys):
        n = int(rng.integers(1, 120))
        close = 100 + np.cumsum(rng.integers(-100, 101, n)) / 100
        parts.append(pd.DataFrame({"symbol": None if k == 0 else f"s{k:03d}", "datetime": np.arange(n), "close": close}))
    return pd.concat(parts, ignore_index=True)


def test_whole_keys_over_batch_edges():
    pdf = walks(40)
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    for size, rows in ((7, 1), (50, 200), (10_000, 50_000)):
        found = list(batches.whole_keys(iter(table.to_batches(max_chunksize=size)), ["symbol"], rows))
        assert pa.concat_tables(found).equals(table.combine_chunks())
        seen = [set(t.column("symbol").to_pylist()) for t in found]
        assert sum(map(len, seen)) == len(set.union(*seen)) == 40
        assert sum(len(batches.key_starts(t, ["symbol"])) for t in found) == 40


def test_macd_of_many_keys_is_that_of_each():
    pdf = walks(30)
    starts = batches.key_starts(pa.Table.from_pandas(pdf, preserve_index=False), ["symbol"])
    together = kernels.macd_columns(pdf["close"].to_numpy(), starts)
    for i, part in enumerate(np.split(np.arange(len(pdf)), starts[1:])):
        alone = kernels.macd_frame(pdf.iloc[part])
        for name, x in together.items():
            np.testing.assert_array_equal(x[part], alone[name].to_numpy(), err_msg=f"{name} of key {i}")


def test_averages_are_exact_wherever_the_window_lies(spark):
    """91.20 as the mean of 60 closes comes out the same after any history; a plain sum of doubles depends on its order."""
    closes = [91.2 + d / 100 for k in range(1, 31) for d in (k, -k)]
    rows = [(f"s{n}", "1d", datetime(2025, 1, 1) + timedelta(days=i), c, 0.1) for n in range(20) for i, c in enumerate([70.01 + 0.1 * k for k in range(n)] + closes)]
    df = ind.with_averages(spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, volume double"))
    last = ind.latest(df).select("symbol", "ma60", "volume_ratio").collect()
    assert len(last) == 20 and {r.ma60 for r in last} == {91.2} and {r.volume_ratio for r in last} == {1.0}


def test_next_sell_of_long_series(spark):
    """The next sell after each bar, over 60,000 bars of one symbol: one pass, not one over all later bars for each."""
    n = 60_000
    bars = spark.range(n).select(F.lit("X").alias("symbol"), F.date_add(F.lit("1850-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("datetime"), (F.col("id") + 1.0).alias("open"), (F.col("id") + 1.5).alias("close"))
    side = F.when(F.col("i") % 10 == 5, "sell").when(F.col("i") % 10 == 0, "buy")
    signals = bars.select("symbol", F.to_date("datetime").alias("day"), F.lit("t").alias("type"), (F.col("open") - 1).cast("int").alias("i")).withColumn("side", side).filter("side is not null")
    began = time.monotonic()
    trades = backtest.win_trades(bars, signals).groupBy("reason", "holding_days").count().collect()
    assert sorted((r.reason, r.holding_days, r["count"]) for r in trades) == [("chan_sell", 6, n // 10)]
    assert time.monotonic() - began < 60
