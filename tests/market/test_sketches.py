"""Sketched divergences, trends and entries on drawn bars; tranches and reports by hand; MACD on a stream over restarts."""

from datetime import datetime, timedelta

import pandas as pd
import pytest

from barloom.operators import backtest, kernels, signals, sketches
from barloom.operators import indicators as ind
from barloom.streaming import bars as stream

DAY0 = datetime(2025, 1, 1)


def drawn(spark, rows):
    """rows: (close, low, high, volume, hist0, dif0, dea0, rsi, ma250)"""
    names = "symbol string, timeframe string, datetime timestamp, close double, low double, high double, volume double, hist0 double, dif0 double, dea0 double, rsi double, ma250 double"
    return spark.createDataFrame([("X", "1d", DAY0 + timedelta(days=i), *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], names)


def bar(close, hist=0.0, dif=0.0, dea=0.0, rsi=50, ma=100.0, volume=100, low=None, high=None):
    return (close, close if low is None else low, close if high is None else high, volume, hist, dif, dea, rsi, ma)


def last(df):
    return df.orderBy("datetime").collect()[-1]


def test_divergence_marks(spark):
    falling = [bar(110 - i, hist=-3, dif=-3 + i * 0.1) for i in range(10)]
    r = last(sketches.divergence_marks(drawn(spark, [*falling, bar(100, hist=-2, dif=-1.5), bar(99, hist=-1, dif=-1)])))
    assert [r[c] for c in sketches.DIVERGENCES] == ["bullish"] * 6
    rising = [bar(90 + i, hist=3, dif=3 - i * 0.1) for i in range(10)]
    r = last(sketches.divergence_marks(drawn(spark, [*rising, bar(100, hist=2, dif=1.5), bar(101, hist=1, dif=1)])))
    assert [r[c] for c in sketches.DIVERGENCES] == ["bearish"] * 6
    # too little history, and no histogram at all
    assert {last(sketches.divergence_marks(drawn(spark, [bar(100)])))[c] for c in sketches.DIVERGENCES} == {"none"}
    blank = sketches.divergence_marks(drawn(spark, [bar(100 - i, hist=None, dif=None, dea=None, rsi=None, ma=None) for i in range(12)]))
    assert {last(blank)[c] for c in sketches.DIVERGENCES} == {"none"}
    assert sketches.divergence_marks(drawn(spark, [bar(1)]).limit(0)).count() == 0


def test_trend_marks(spark):
    def marks(close, averages):
        r = last(sketches.trend_marks(drawn(spark, [bar(100, ma=m) for m in averages[:-1]] + [bar(close, ma=averages[-1])])))
        return r.trend20, r.trend1, r.slope20, r.target_exposure

    up = [100 + i / 10 for i in range(21)]
    assert marks(110, up) == ("up", "up", "up", 0.7)
    assert marks(101, up) == ("side", "side", "up", 0.5)
    assert marks(90, up[::-1]) == ("down", "down", "down", 0.3)
    assert marks(110, [*up[:-1], up[-2]]) == ("up", "side", "up", 0.7)
    assert marks(110, [100, 101]) == ("side", "up", "side", 0.7)  # no average 20 bars back


def signals_of(spark, rows):
    r = last(sketches.bar_signals(sketches.trend_marks(sketches.divergence_marks(drawn(spark, rows)))))
    return {c for c in sketches.SIGNALS if r[c]}


def test_bar_signals(spark):
    up = [bar(110, ma=100 + i / 10) for i in range(30)]
    # back near a rising average; dif over dea
    assert signals_of(spark, [*up, bar(104, dif=1, ma=103)]) == {"legs_buy", "cross_buy"}
    # the cross itself on heavy volume, five bars flat
    crossed = [bar(110, ma=100 + i / 10, dif=-1, dea=0) for i in range(30)]
    assert signals_of(spark, [*crossed, bar(111, dif=1, ma=103, volume=400)]) == {"legs_buy", "burst_buy", "cross_buy"}
    # through the average from above
    assert "burst_sell" in signals_of(spark, [*up, bar(102, ma=103)])
    # side: oversold and overbought; a bounce near the average
    side = [bar(100, ma=100) for _ in range(30)]
    assert signals_of(spark, [*side, bar(100, ma=100, rsi=25)]) == {"rsi_buy"}
    assert signals_of(spark, [*side, bar(101, ma=100, rsi=75)]) == {"rsi_sell", "swing_buy"}
    down = [bar(90, ma=100 - i / 10) for i in range(30)]
    assert "swing_sell" in signals_of(spark, [*down, bar(70, ma=97)])
    assert "rsi_sell" in signals_of(spark, [*down[:-4], *[bar(90, ma=97.4 - i / 10, volume=400) for i in range(4)], bar(90, ma=96.9, rsi=65, volume=400)])
    assert signals_of(spark, [bar(100, hist=None, dif=None, dea=None, rsi=None, ma=None)]) == set()


def test_tranches(spark):
    lots = [(1, "A", "base", 100, 10.0), (1, "A", "base", 300, 12.0), (1, "A", "mobile", 100, 8.0), (2, "A", "mobile", 0, 5.0), (3, "B", "base", 10, 1.0)]
    df = spark.createDataFrame(lots, "account int, symbol string, tranche string, shares long, price double")
    got = {r.account: r for r in signals.valued_tranches(df, spark.createDataFrame([("A", 11.0)], "symbol string, current_price double")).collect()}
    assert set(got) == {1, 2}  # B has no price
    a = got[1]
    assert (a.base_shares, a.base_cost, a.mobile_shares, a.mobile_cost) == (400, 11.5, 100, 8.0)
    assert (a.market_value, a.total_cost, a.average_cost, a.profit_loss) == (5500.0, 5400.0, 10.8, 100.0)
    assert a.profit_rate == pytest.approx(100 / 5400)
    assert (got[2].base_cost, got[2].mobile_cost, got[2].average_cost, got[2].profit_rate) == (0, 0, 0, 0)


def test_symbol_report(spark):
    nav = spark.createDataFrame([(s, DAY0 + timedelta(days=i), v) for s in "ABC" for i, v in enumerate([100.0, 110.0, 99.0])], "symbol string, datetime timestamp, close double")
    trades = spark.createDataFrame([("A", 6.0, 100.0), ("A", 2.0, 100.0), ("A", -2.0, 100.0), ("A", 0.0, 100.0), ("B", -1.0, 50.0)], "symbol string, pnl double, amount double")
    got = {r.symbol: r for r in backtest.symbol_report(backtest.nav_metrics(nav), trades, 1000).collect()}
    a = got["A"]
    assert (a.trades, a.trade_win_rate, a.profit_loss_ratio) == (4, 0.5, 4.0)  # 8/2 over 2/2
    assert a.turnover == pytest.approx(400 / 2000 / (3 / 252))
    assert (got["B"].trades, got["B"].trade_win_rate, got["B"].profit_loss_ratio) == (1, 0.0, 0.0)
    assert (got["C"].trades, got["C"].turnover) == (0, 0.0)


def test_streamed_macd_over_restarts(spark, tmp_path):
    schema = "symbol string, timeframe string, datetime timestamp, close double"
    keys = [("A", "1d"), ("A", "60m"), ("B", "1d")]
    price = lambda i, s, t: 50 + 7 * ((i * 37 + len(t)) % 11 - 5) / 5 + (s == "B") * i / 9
    rows = [(s, t, DAY0 + timedelta(hours=i), price(i, s, t)) for i in range(150) for s, t in keys]
    rows += [("C", "1d", DAY0 + timedelta(hours=i), price(i, "C", "1d")) for i in range(90, 150)]  # without history
    cut = lambda a, z: [r for r in rows if DAY0 + timedelta(hours=a) <= r[2] < DAY0 + timedelta(hours=z)]
    history = spark.createDataFrame(cut(0, 60), schema)
    with stream.rocksdb(spark):
        # each step is a new query on the same checkpoint; the third brings old bars once more, which change nothing
        for a, z in ((60, 80), (80, 110), (70, 110), (110, 150)):
            spark.createDataFrame(cut(a, z), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
            arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/bars")
            stream.run_once(stream.stream_macd(arriving, history), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r.symbol, r.timeframe, r.datetime): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == spark.read.parquet(f"{tmp_path}/out").count() == len(cut(60, 150))
    frame = pd.DataFrame(rows, columns=["symbol", "timeframe", "datetime", "close"])
    for (s, t), pdf in frame.groupby(["symbol", "timeframe"]):
        whole = kernels.macd_frame(pdf)
        up = (whole.dif > whole.dea) & (whole.dif.shift() <= whole.dea.shift())
        for r, cross in zip(whole.itertuples(), up, strict=True):
            g = got.get((s, t, r.datetime.to_pydatetime()))
            if g is None:
                assert r.datetime < DAY0 + timedelta(hours=60)
                continue
            assert (g.dif is None) == pd.isna(r.dif) and (g.dea is None) == pd.isna(r.dea)
            assert g.dea is None or (g.dea == pytest.approx(r.dea) and g.golden_cross == bool(cross))
