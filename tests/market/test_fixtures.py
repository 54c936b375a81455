"""Literal fixtures: golden replay, resampling, structure, events, streams."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import symbols as fs
from barloom.operators import backtest, bars, chan, kernels, pool
from barloom.streaming import bars as stream

#: Thirty daily closes and volumes, fixed values.
CLOSES = [10.00, 10.05, 10.10, 10.15, 10.20, 10.55, 10.90, 11.20, 11.10, 10.95, 10.75, 10.55, 10.30, 10.10, 9.95, 10.05, 10.30, 10.55, 10.85, 11.10, 11.35, 11.20, 11.00, 10.75, 10.50, 10.25, 10.10, 10.35, 10.70, 11.00]
VOLUMES = [1000, 980, 990, 995, 1005, 1200, 1280, 1320, 950, 900, 860, 820, 790, 760, 740, 760, 830, 910, 1020, 1150, 1230, 980, 920, 870, 820, 790, 770, 860, 980, 1080]


def golden(spark):
    rows = [("X", "1d", datetime(2025, 1, 1) + timedelta(days=i), c, float(v)) for i, (c, v) in enumerate(zip(CLOSES, VOLUMES, strict=True))]
    return spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, volume double")


def test_golden_replay(spark):
    r = backtest.scan(golden(spark)).first()
    want = {
        "ending_equity": 108921.60447900003, "total_return": 0.08921604479000031, "annual_return": 1.931736013588924, "max_drawdown": 0.03177989174496414,
        "trade_count": 1, "win_rate": 1.0, "profit_loss_ratio": 0.0, "avg_holding_days": 6.0, "turnover_rate": 2.8847881731849006, "sharpe_ratio": 4.496139030714843, "calmar_ratio": 60.784851914891384,
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value, rel=1e-9), name


def test_golden_scan(spark):
    reports = backtest.scan(golden(spark), mas=(4, 5), stops=(0.06, 0.08), split=0.7)
    got = {(r.ma, r.stop, r.sample): r.annual_return for r in reports.collect()}
    assert all(got[m, s, "in"] == pytest.approx(4.313715833244782) for m in (4, 5) for s in (0.06, 0.08))
    assert got[4, 0.06, "out"] == pytest.approx(12.322347334657813) and got[5, 0.08, "out"] == pytest.approx(2.175204423547743)
    ranked = backtest.rank_parameters(reports).orderBy("rank").collect()
    assert (ranked[0].ma, ranked[0].stop) == (4, 0.06) and ranked[0].robust == pytest.approx(4.513715833244782) and not any(r.stable for r in ranked)
    assert len(backtest.scan(golden(spark), mas=(4, 5), stops=(0.06, 0.08), most=3).collect()) == 3


def session_minutes(spark):
    rows, i = [], 0
    for h, m, n in ((9, 31, 120), (13, 1, 120)):
        for k in range(n):
            p = 10 + i / 1000
            rows.append(("X", "1m", datetime(2025, 1, 2, h, m) + timedelta(minutes=k), p, p + 0.1, p - 0.1, p + 0.02, 10.0, 10000.0, True))
            i += 1
    return spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, amount double, is_closed boolean")


def test_session_resample(spark):
    minutes = session_minutes(spark)
    two = bars.resample_sessions(minutes, 120, 1).orderBy("datetime").collect()
    assert [r.datetime.strftime("%H:%M") for r in two] == ["11:30", "15:00"] and [r.volume for r in two] == [1200.0, 1200.0]
    assert two[0].open == 10.0 and two[0].close == pytest.approx(10 + 119 / 1000 + 0.02)
    hours = bars.resample_sessions(minutes, 60, 1)
    assert hours.count() == 4 and bars.resample_sessions(hours, 120, 60).count() == 2
    assert bars.resample_sessions(minutes.filter("datetime <> '2025-01-02 10:00:00'"), 60, 1).count() == 3
    with pytest.raises(ValueError, match="multiple"):
        bars.resample_sessions(minutes, 100, 60)


def test_standardize_and_closed_flag(spark):
    raw = spark.createDataFrame([("X", "20250102", "10", "11", "9", "bad"), ("X", "20250103", "10", "11", "9", "10.5"), ("X", "20250103", "10", "11", "9", "10.6")], "symbol string, `日期` string, `开盘` string, `最高` string, `最低` string, `收盘` string")
    out = bars.standardize(raw.coalesce(1), "1d").collect()
    assert [(r.close, r.volume) for r in out] == [(10.6, 0.0)]
    flags = bars.with_closed_flag(bars.standardize(raw.coalesce(1), "1d"), "2025-01-03 14:00:00").collect()
    assert [r.is_closed for r in flags] == [False]
    with pytest.raises(ValueError, match="datetime"):
        bars.standardize(raw.drop("日期"), "1d")


def slow_centers(low, high):
    out, i = [], 0
    while i + 2 < len(low):
        zd, zg = max(low[i : i + 3]), min(high[i : i + 3])
        if zd >= zg:
            i += 1
            continue
        j = i + 2
        while j + 1 < len(low) and not (high[j + 1] < zd or low[j + 1] > zg):
            j += 1
        out.append((i, j, zd, zg, min(low[i : j + 1]), max(high[i : j + 1])))
        i = j + 1
    return out


def test_structure_kernels():
    rng = random.Random(2)
    for _ in range(200):
        low = [round(rng.uniform(0, 10), 1) for _ in range(rng.randrange(0, 25))]
        high = [x + round(rng.uniform(0.1, 4), 1) for x in low]
        assert kernels.center_spans(np.array(low), np.array(high)) == slow_centers(low, high)
    assert kernels.stroke_ends(np.array([0, 4, 8]), np.array([False, True, False]), np.array([1.0, 2.0, 0.5])) == [0, 1, 2]
    assert kernels.stroke_ends(np.array([0, 2]), np.array([False, True]), np.array([1.0, 2.0])) == [0]


def stroke_rows(spark, ends, areas):
    rows = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        at = datetime(2025, 1, 1) + timedelta(days=i)
        rows.append(("X", "1d", i, "up" if b > a else "down", float(a), float(b), float(max(a, b)), float(min(a, b)), at, float(areas[i])))
    return spark.createDataFrame(rows, "symbol string, timeframe string, idx int, direction string, start_price double, end_price double, high double, low double, confirmed_at timestamp, macd_area double")


def test_turning_points(spark):
    lines = stroke_rows(spark, [10, 14, 11, 13, 8, 10, 8.5, 12], [5, 5, 5, 10, 5, 4, 5])
    zones = spark.createDataFrame([("X", "1d", 0, 0, 2, 11.0, 13.0, 10.0, 14.0)], chan.CENTERS)
    low = stroke_rows(spark, [10, 14, 11, 13, 9, 10, 8, 9, 8.2], [5, 5, 5, 10, 5, 4, 5, 3])
    found = {(r.idx, r.t1, r.t2) for r in chan.turning_points(chan.with_center(low, zones)).filter("t1 is not null or t2 is not null").collect()}
    assert (5, "buy_1", None) in found and (7, None, "buy_2") in found
    leave = stroke_rows(spark, [10, 14, 11, 16, 13.5, 18], [1] * 5)
    assert [r.type for r in chan.leaving_points(leave, zones.withColumn("end_stroke", F.lit(1))).collect()] == ["buy_3"]
    assert [r.type for r in chan.leaving_points(lines, zones).collect()] == ["sell_3"]


def test_confirmed_points_do_not_change(spark):
    """Points of a prefix are points of the whole."""
    rng = random.Random(7)
    price, rows = 50.0, []
    for i in range(400):
        start, price = price, max(5.0, price + rng.uniform(-1.5, 1.5))
        rows.append(("X", "1d", datetime(2024, 1, 1) + timedelta(days=i), start, max(start, price) + 0.2, min(start, price) - 0.2, price, 100.0, 1.0, True))
    frame = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, amount double, is_closed boolean")
    points = lambda df: {(r.start_index, r.end_index, r.start_price, r.end_price) for r in chan.locked(chan.strokes(chan.fractals(chan.merged_bars(df)))).collect()}
    whole = points(frame)
    for n in (150, 250, 330):
        assert points(frame.orderBy("datetime").limit(n)) <= whole


def test_symbols(spark):
    texts = {"600000": "600000.SH", "000001.sz": "000001.SZ", "sh600519": "600519.SH", "830799": "830799.BJ", "300750": "300750.SZ", "nonsense": None}
    df = spark.createDataFrame([(k,) for k in texts], "raw string")
    assert {r.raw: r.s for r in df.select("raw", fs.normalize_symbol(F.col("raw")).alias("s")).collect()} == texts
    numbers = {"1.5亿": 1.5e8, "2万": 2e4, "12.5%": 12.5, "1,234": 1234.0, "--": None, "": None, "x": None}
    df = spark.createDataFrame([(k,) for k in numbers], "raw string")
    assert {r.raw: r.v for r in df.select("raw", fs.parse_number(F.col("raw")).alias("v")).collect()} == numbers


def test_events_and_pool(spark):
    e = pool.with_event_id(spark.createDataFrame([("X", "1d", "buy_1", "buy", "2025-01-02", "a"), ("X", "1d", "buy_1", "buy", "2025-01-02", "b")], "symbol string, timeframe string, signal_type string, side string, confirmed_at string, created_at string"))
    none = e.limit(0)
    new = pool.append_events(none, e)
    assert new.count() == 1 and pool.append_events(new, e).count() == 0
    assert pool.deliveries(new, ["mail", "web", "app"]).count() == 3
    box = spark.createDataFrame([("e", 4), ("f", 0)], "event_id string, attempts int").withColumn("status", F.lit("pending"))
    assert {r.event_id: (r.status, r.backoff) for r in pool.failed(box).collect()} == {"e": ("failed", 32.0), "f": ("pending", 2.0)}


def test_streams_equal_batches(spark, tmp_path):
    rng, at, rows = random.Random(3), datetime(2025, 1, 1), []
    for i in range(600):
        at += timedelta(minutes=rng.randrange(1, 20))
        rows.append((rng.choice("AB"), at, float(50 + 10 * np.sin(i / 9) + rng.random()), 1))
    schema = "symbol string, ts timestamp, price double, qty long"
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    stream.run_once(stream.stream_hours(source, "30 days"), f"{tmp_path}/hours", f"{tmp_path}/c1")
    bars_schema = "symbol string, timeframe string, datetime timestamp, close double"
    keys = [("A", "1d"), ("A", "60m"), ("B", "1d")]
    closes = [(s, t, datetime(2025, 1, 1) + timedelta(days=i), float(50 + 5 * np.sin(i / 6 + (t == "60m")) + (s == "B"))) for i in range(120) for s, t in keys]
    for k in range(2):
        spark.createDataFrame(closes[k * 180 : k * 180 + 180], bars_schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    src = spark.readStream.schema(bars_schema).parquet(f"{tmp_path}/bars")
    stream.run_once(stream.stream_macd(src), f"{tmp_path}/alerts", f"{tmp_path}/c2")
    got = {(r.symbol, r.timeframe, r.datetime): r for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    for key in keys:
        pdf = kernels.macd_frame(pd.DataFrame([(at, c) for *k, at, c in closes if tuple(k) == key], columns=["datetime", "close"]))
        for r in pdf.itertuples():
            g = got[*key, r.datetime.to_pydatetime()]
            assert (g.dif is None) == np.isnan(r.dif) and (g.dea is None) == np.isnan(r.dea)
            assert g.dea is None or g.dea == pytest.approx(r.dea)
    assert any(r.golden_cross for r in got.values())
    events = spark.createDataFrame([("e1", at), ("e1", at), ("e2", at)], "event_id string, ts timestamp")
    events.write.parquet(f"{tmp_path}/events")
    stream.run_once(stream.dedup_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")), f"{tmp_path}/once", f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2


def test_whole_momentum_arms(spark):
    from barloom.operators import indicators, screening

    def arms(closes):
        rows = [("X", "1d", datetime(2025, 1, 1) + timedelta(days=i), float(c), 1000.0) for i, c in enumerate(closes)]
        df = indicators.with_averages(spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, volume double"))
        return [r.arms for r in screening.momentum_arms(df).orderBy("datetime").collect()]

    assert arms([100.0] * 30 + [95, 94, 96])[-3:] == [0, 0, 2]  # two closes under MA20, then up
    assert arms([100.0] * 30 + [95, 94, 105])[-1] == 0  # up too far
    falls = [200.0 - i for i in range(80)]
    cross = arms(falls + [121.0 + 6 * i for i in range(40)])
    assert cross[80:].count(2) >= 1 and 4 not in cross


def test_whole_composite_and_sell_gate(spark):
    from barloom.operators import screening

    rows = spark.createDataFrame([("A", 10, 4, 5, -3), ("B", 0, 0, None, 3)], "symbol string, quality int, valuation int, momentum int, vol_score int")
    assert {r.symbol: r.composite for r in screening.composite(rows).collect()} == {"A": 4.9, "B": 0.6}
    held = [(1, 10, 0.0, -3, 9.0, 9.0), (2, 90, 1.0, 0, 9.0, 9.0), (3, 10, 0.0, 0, 5.0, 10.0), (4, 10, 0.0, -2, 8.0, 10.0), (5, 10, 0.0, None, 1.0, None)]
    got = screening.sell_gate(spark.createDataFrame(held, "account int, holding_days int, profit_pct double, vol_score int, roe double, roe_before double"))
    assert {r.account: r.reason for r in got.collect()} == {1: "volume", 2: "stale", 3: "roe", 4: "hold", 5: "hold"}


def test_whole_merge_and_trend_entries(spark):
    from barloom.plans import market_queries as q

    sf = "/root/testdata/sf0.001"
    got = [(r.origin, r.symbol) for r in q.f20(spark, sf).collect()]
    asked = {"routed": q.f10(spark, sf).count(), "exit": q.f16(spark, sf).count(), "t_trading": q.f17(spark, sf).filter("suggestion <> 'none'").count(), "risk": q.f13(spark, sf).filter("action <> 'HOLD'").count()}
    assert {o: sum(x == o for x, _ in got) for o in asked} == asked and len(got) == sum(asked.values())
    routed = [s for o, s in got if o == "routed"]
    assert len(routed) == len(set(routed))  # conflicts are resolved before the merge


def test_t_trades_by_regime(spark):
    """One case of each rule, and one that misses it: F17, and F20's score of it."""
    from barloom.operators import signals

    held = [
        ("A", "bull", "bullish", True, 1.0, False, 1.0), ("B", "bull", "bearish", False, 0.5, False, 1.0), ("C", "bear", "bearish", False, 0.5, False, 1.0), ("D", "bear", "bullish", False, 0.5, True, 1.0),
        ("E", "range", "bullish", False, 0.5, False, 0.0), ("F", "range", "bearish", False, 0.5, False, 1.0), ("G", "bull", "bullish", True, 0.9, True, -1.0), ("H", "bear", "bullish", True, 2.0, False, -1.0), ("I", "range", "bullish", True, 2.0, True, 0.1),
    ]
    schema = "symbol string, regime string, divergence string, near_ma boolean, volume_ratio double, golden_cross boolean, price_change_pct double"
    rows = spark.createDataFrame(held, schema).selectExpr("*", "true AS above_ma", "false AS death_cross", "1.0D AS slope", "1.0D AS profit_pct", "5 AS holding_days", "10.0D AS volatility_pct", "1000L AS base_shares", "400L AS mobile_shares")
    got = {r.symbol: (r.suggestion, r.confidence, r.t_change, r.t_amount) for r in signals.t_trading(rows).collect()}
    none = ("none", None, None, None)
    assert got == {
        "A": ("positive_t_buy", 78, 0.05, 400), "B": ("positive_t_sell", 76, -0.05, 400), "C": ("negative_t_sell", 74, -0.05, 300), "D": ("negative_t_buy", 72, 0.05, 300),
        "E": ("range_t_buy", 70, 0.05, 400), "F": ("range_t_sell", 70, -0.05, 400), "G": none, "H": none, "I": none,
    }
    nothing = spark.createDataFrame([], "symbol string, action string, score int")
    merged = signals.merged_signals(nothing, rows).filter("origin = 't_trading'").collect()
    assert [(r.symbol, r.score) for r in merged] == [("A", 78), ("B", 76), ("C", 74), ("D", 72), ("E", 70), ("F", 70)]


def test_regime_decision(spark):
    """A tie is a range; to lead strictly is enough, whatever the score."""
    from pyspark.sql import functions as F

    from barloom.operators import signals

    rows = spark.createDataFrame([(0.9, 0.0, 0.1), (0.35, 0.1, 0.3), (0.45, 0.45, 0.2), (0.4, 0.1, 0.4), (0.1, 0.8, 0.2), (0.1, 0.2, 0.9)], "a double, b double, c double")
    assert [r[0] for r in rows.select(signals.decide(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["bull", "bull", "range", "range", "bear", "range"]


def test_momentum_bands(spark):
    from barloom.operators import screening

    base = "9.0D AS close", "1.0D AS boll_low", "2.0D AS boll_mid"
    rows = spark.createDataFrame([(-1.0, -2.0, -3.0), (-1.0, -2.0, -1.5), (1.0, -1.0, -2.0), (1.0, 0.0, -2.0)], "hist0 double, hist0_before double, hist0_before2 double").selectExpr("*", "90.0D AS rsi", *base)
    assert [r[0] for r in rows.select(screening.momentum_score(rows)).collect()] == [2, 0, 3, 0]
    rows = spark.createDataFrame([(25.0,), (30.0,), (35.0,), (20.0,), (45.0,)], "rsi double").selectExpr("*", "0.0D AS hist0", "0.0D AS hist0_before", "0.0D AS hist0_before2", *base)
    assert [r[0] for r in rows.select(screening.momentum_score(rows)).collect()] == [3, 0, 2, 1, 0]


def test_symbol_once_for_each_name(spark):
    df = spark.createDataFrame([(1, "sh600123 big co,600123,600123")], "id long, text string")
    rows = lambda **kw: sorted((r.symbol, r.name) for r in fs.extract_symbols(df, "id", "text", **kw).collect())
    assert rows(by_name=True) == [("600123.SH", ""), ("600123.SH", "BIG CO")] and rows() == [("600123.SH", "BIG CO")]


def test_vwap_of_prices_below_zero(spark):
    """Two hours of a walk that crossed zero: amounts have the sign of the price, and both hours count."""
    at = datetime(2025, 1, 2)
    rows = [("X", "60m", at + timedelta(hours=10), 1.0, 1.0, 1.0, 1.0, 3.0, 300.0), ("X", "60m", at + timedelta(hours=11), -2.0, -2.0, -2.0, -2.0, 6.0, -1200.0)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, amount double")
    assert bars.intraday_summary(df).first()["vwap"] == pytest.approx(-1.0)
