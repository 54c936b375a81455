"""Structure in one kernel, fresh points, several timeframes, events and gates, on literal cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import backtest, bars, chan, indicators, pool, screening

BAR = "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, amount double, is_closed boolean"


def walk(spark, n=500, seed=7, symbols="XY"):
    rows = []
    for s in symbols:
        rng, price = random.Random(f"{s}{seed}"), 50.0
        for i in range(n):
            start, price = price, max(5.0, round(price + rng.uniform(-1.5, 1.5), 2))
            rows.append((s, "1d", datetime(2024, 1, 1) + timedelta(days=i), start, max(start, price) + 0.2, min(start, price) - 0.2, price, 100.0, 1.0, True))
    return spark.createDataFrame(rows, BAR)


def test_one_kernel_equals_the_chain(spark):
    """Strokes, areas, locks and centers of the one kernel are those of the operators one after another."""
    frame = walk(spark)
    rows = chan.structure(frame)
    chain = chan.strokes(chan.fractals(chan.merged_bars(frame)))
    plain = lambda df, *c: sorted(tuple(r) for r in df.select("symbol", *c).collect())
    own = ["idx", "start_index", "end_index", "direction", "start_price", "end_price", "start_time", "end_time", "confirmed_at"]
    assert plain(rows.filter("idx >= 0"), *own) == plain(chain, *own)
    areas = plain(chan.with_macd_area(chain, indicators.with_macd(frame)), "idx", "macd_area")
    assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-8) for a, b in zip(areas, plain(rows.filter("idx >= 0"), "idx", "macd_area"), strict=True))
    locked = chan.locked(chain)
    assert plain(chan.locked_strokes(rows), "idx", "confirmed_at") == plain(locked, "idx", "confirmed_at")
    zones = chan.centers(locked)
    want = plain(zones, "start_stroke", "end_stroke", "zd", "zg", "low", "high")
    assert want and plain(rows.filter("center is not null"), "center_start", "idx", "zd", "zg", "center_low", "center_high") == want
    assert plain(chan.locked_strokes(rows), "idx", "zd", "zg") == plain(chan.with_center(locked, zones), "idx", "zd", "zg")
    for rule in ("next_stroke", "last_center_stroke"):
        found = chan.points_of(rows, rule).filter("type like '%3'")
        assert plain(found, "type", "stroke", "price", "confirmed_at") == plain(chan.leaving_points(locked, zones, rule), "type", "stroke", "price", "confirmed_at")


def test_short_keys_and_summary(spark):
    """A key without strokes, and one with fewer bars than the summary asks for."""
    frame = walk(spark, 300, symbols="X").unionByName(walk(spark, 6, symbols="Z")).unionByName(walk(spark, 1, symbols="W"))
    rows = chan.structure(frame)
    found = {r.symbol: r for r in chan.summary(rows, chan.points_of(rows), n_strokes=3).collect()}
    assert {s: r.status for s, r in found.items()} == {"X": "ok", "Z": "insufficient_data", "W": "insufficient_data"}
    assert found["Z"].merged_bars == 0 and found["Z"].latest_strokes is None
    last = [r.end_price for r in chan.locked_strokes(rows).filter("symbol = 'X'").orderBy("idx").collect()][-3:]
    assert [x.end_price for x in found["X"].latest_strokes] == last and found["X"].strokes > 3


def test_fresh_points_expire(spark):
    frame = walk(spark, 8, symbols="X")
    at = datetime(2024, 1, 3)
    points = spark.createDataFrame([("X", "1d", "buy_2", "buy", 5, 50.0, at), ("X", "1d", "buy_1", "buy", 5, 50.0, at), ("X", "1d", "sell_3", "sell", 6, 51.0, at + timedelta(days=1))], "symbol string, timeframe string, type string, side string, stroke int, price double, confirmed_at timestamp")
    one = [(r.fresh_buy, r.fresh_sell) for r in chan.with_fresh(frame, points, 1).orderBy("datetime").collect()]
    assert one == [(None, None)] * 2 + [(25, None), (None, 30)] + [(None, None)] * 4
    three = [(r.fresh_buy, r.fresh_sell, len(r.fresh)) for r in chan.with_fresh(frame, points, 3).orderBy("datetime").collect()]
    assert three == [(None, None, 0)] * 2 + [(25, None, 2), (25, 30, 3), (25, 30, 3), (None, 30, 1), (None, None, 0), (None, None, 0)]


def test_lattice_buckets_end_with_the_clock(spark):
    start = datetime(2025, 1, 2, 9, 31)
    rows = [("X", "1m", start + timedelta(minutes=i), 10 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0, 2.0, i != 3) for i in range(30)]
    out = bars.lattice(spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in rows], BAR), ("1m", "15m", "1d"))
    got = {(r.timeframe, r.datetime.strftime("%d %H:%M")): r for r in out.filter("timeframe <> '1m'").collect()}
    assert set(got) == {("15m", "02 09:45"), ("15m", "02 10:00"), ("1d", "03 00:00")}
    assert (got["15m", "02 09:45"].open, got["15m", "02 09:45"].close, got["15m", "02 09:45"].volume) == (10.0, 24.5, 14.0)  # one bar was not closed
    assert (got["1d", "03 00:00"].high, got["1d", "03 00:00"].low, got["1d", "03 00:00"].amount) == (40.0, 9.0, 58.0)
    assert out.filter("timeframe = '1m'").count() == 29


def test_higher_timeframe_as_of(spark):
    """A higher bar counts from the moment it closes, the one that closes together included; short timeframes are passed over."""
    at = lambda h, m=0: datetime(2025, 1, 2, h, m)
    rows = [("15m", at(9, 45), 50, 1.0), ("15m", at(10), 51, 1.5), ("15m", at(10, 15), 52, 1.2), ("30m", at(10), 5, 9.0), ("60m", at(9), 40, 2.0), ("60m", at(10), 41, 3.0), ("60m", at(11), 42, 2.5)]
    frame = spark.createDataFrame([("X", t, d, n, v, v) for t, d, n, v in rows], "symbol string, timeframe string, datetime timestamp, n_rows int, dif double, dea double")
    got = {(r.timeframe, r.datetime): (r.higher_timeframe, r.higher_dif, r.higher_change) for r in screening.with_higher(frame).collect()}
    assert got["15m", at(9, 45)] == ("60m", 2.0, None) and got["15m", at(10)] == ("60m", 3.0, 1.0) and got["15m", at(10, 15)] == ("60m", 3.0, 1.0)
    assert got["30m", at(10)][0] == "60m" and got["60m", at(11)] == (None, None, None)


SCORE = "golden_cross boolean, death_cross boolean, zone string, confirmation_count int, higher_dif double, higher_change double, above_ma60 boolean, ma60_up boolean, below_ma60 boolean, ma60_down boolean, volume_ratio double, price_change double, fresh_buy int, fresh_sell int"


def test_side_scores(spark):
    rows = [
        (True, False, "above", 2, 0.4, 0.1, True, True, False, False, 1.2, 0.5, 30, None),  # 50 + 10 + 30 + 15 + 10 + 10 + 5
        (False, True, "near", 0, -0.4, -0.1, False, False, True, True, 1.2, -0.5, None, 20),  # 30 + 20 + 15 + 10 + 10 + 5
        (True, False, "below", 0, None, None, False, False, False, False, 0.5, 0.5, None, 20),  # 10 - 30
        (False, False, None, 0, 0.0, 0.0, False, False, False, False, 0.5, 0.5, 25, 30),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCORE)
    got = df.select(screening.side_score("buy", F.col("fresh_buy"), F.col("fresh_sell").isNotNull()), screening.side_score("sell", F.col("fresh_sell"), F.col("fresh_buy").isNotNull())).collect()
    assert [tuple(r) for r in got] == [(130, 0), (5 * 0, 90), (0, 20), (0, 0)]


def test_events_of_points_and_crosses(spark):
    at = datetime(2025, 1, 2)
    point = lambda t: (t, t.split("_")[0], 50.0, at, 20)
    rows = [
        ("A", "60m", at, 9.0, True, False, "above", [], 60, 0), ("B", "60m", at, 9.0, True, False, "above", [], 59, 0), ("C", "1d", at, 9.0, True, False, "near", [point("buy_1"), point("buy_2"), point("sell_3")], 40, 70), ("D", "1m", at, 9.0, False, True, "near", [point("sell_1")], 0, 80),
        ("E", "1m", at, 9.0, False, True, "below", [], 0, 90),
    ]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, golden_cross boolean, death_cross boolean, zone string, fresh array<struct<type:string,side:string,price:double,confirmed_at:timestamp,worth:int>>, buy_score int, sell_score int")
    got = sorted((r.symbol, r.side, r.signal_type, tuple(r.components), r.level, r.score, r.weight) for r in pool.timeframe_events(df).collect())
    near, death = "macd_golden_cross_near", "zero_axis_death_cross"
    assert got == [
        ("A", "buy", "macd_golden_cross_above", ("macd_golden_cross_above",), "strong", 60, 5), ("C", "buy", "buy_1", ("buy_1", near), "structure", 40, 8), ("C", "buy", "buy_2", ("buy_2", near), "structure", 40, 8),
        ("C", "sell", "sell_3", ("sell_3",), "strong", 70, 8), ("D", "sell", "sell_1", ("sell_1", death), "strong", 80, 1),
    ]


def test_collected_signals_need_bars(spark):
    df = walk(spark, 70, symbols="X").unionByName(walk(spark, 59, symbols="Y"))
    df = df.selectExpr("*", "true as golden_cross", "false as death_cross", "'above' as zone").filter("day(datetime) = 5 or not golden_cross is null")
    points = spark.createDataFrame([("X", "sell_1", "sell", datetime(2024, 2, 1)), ("Y", "buy_1", "buy", datetime(2024, 2, 1))], "symbol string, type string, side string, confirmed_at timestamp")
    got = backtest.collected_signals(df, points).groupBy("symbol", "type").count().collect()
    assert {(r.symbol, r.type): r["count"] for r in got} == {("X", "macd_golden_cross_above"): 70, ("X", "sell_1"): 1}


def test_long_trend_against_numpy(spark):
    frame = walk(spark, 300, symbols="X")
    last = indicators.latest(indicators.with_long_trend(indicators.with_averages(frame))).collect()[0]
    close = np.array([r.close for r in frame.orderBy("datetime").collect()])
    ma = np.convolve(close, np.ones(250) / 250, "valid")
    assert last.ma250_slope == pytest.approx(np.polyfit(range(20), ma[-20:], 1)[0]) and last.ma250_distance == pytest.approx((close[-1] - ma[-1]) / ma[-1])
    assert last.near_ma250 == (abs(last.ma250_distance) < 0.05) and last.above_ma250 == (close[-1] > ma[-1])


def test_turns_and_gates(spark):
    rows = [("X", "1d", datetime(2025, 1, 1) + timedelta(days=i), c, h, m, v) for i, (c, h, m, v) in enumerate([(10.0, 0.0, 1.0, 1.0), (10.0, 0.0, 1.0, 1.0), (10.0, -3.0, 1.1, 1.0), (9.9, -2.0, 1.2, 1.0), (9.8, -1.0, 1.2, 1.6), (10.2, -2.0, 1.3, 1.6)])]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, hist double, ma250 double, volume_ratio double")
    got = [(r.ma_up, r.turn_up, r.heavy_flat) for r in screening.turns(df).orderBy("datetime").collect()]
    assert got[3:] == [(True, False, False), (False, True, False), (False, False, True)]
    scores = spark.createDataFrame([("A", 8, 6, 6, 3), ("B", 8, 6, 5, 3), ("C", 9, 4, None, None)], "symbol string, quality int, valuation int, momentum int, vol_score int")
    assert {r.symbol: (r.buy, round(r.ratio, 4)) for r in screening.buy_gate(scores).collect()} == {"A": (True, 0.075), "B": (False, 0.075), "C": (False, 0.06)}


def test_portfolio_gate(spark):
    from barloom.operators import signals

    stats = spark.createDataFrame([(0.25, 0.01, 0.6), (0.2, 0.02, 1.0), (0.0, 0.03, 1.1)], "drawdown double, day_loss double, exposure double")
    flags = lambda **k: [(r.flags, r.allowed) for r in signals.portfolio_gate(stats, **k).collect()]
    assert flags() == [(["portfolio_drawdown_limit"], False), ([], True), (["single_day_drawdown_limit", "manual_exposure_limit"], False)]
    assert flags(despite_drawdown=True) == [(["portfolio_drawdown_limit"], True), ([], True), (["single_day_drawdown_limit", "manual_exposure_limit"], False)]
    assert flags(disable_new=True)[1] == (["manual_disable_new_positions"], False) and flags(only_reduce=True)[1] == (["only_reduce_positions"], False)
    held = spark.createDataFrame([("a", -10.0, None), ("a", 5.0, 0.5), ("b", 3.0, None)], "desk string, profit_pct double, exposure double")
    assert {r.desk: (r.exposure, r.drawdown, r.day_loss) for r in signals.portfolio_stats(held, "desk").collect()} == {"a": (0.75, 0.1, 0.1), "b": (0.25, 0.0, 0.0)}


def test_account_days(spark):
    """Two positions of one account, bought on different days; a day without a bar keeps the last close."""
    from barloom.operators import signals

    day = lambda n: datetime(2025, 1, n)
    prices = spark.createDataFrame([("X", day(1), 10.0), ("X", day(2), 12.0), ("X", day(4), 9.0), ("Y", day(1), 5.0), ("Y", day(3), 6.0), ("Y", day(4), 6.0)], "symbol string, datetime timestamp, close double")
    own = spark.createDataFrame([(1, "X", 10, 10.0, 3), (1, "Y", 10, 5.0, 1)], "account int, symbol string, shares int, cost double, holding_days int")
    got = {r.day.day: r for r in signals.account_days(own, prices).collect()}
    assert {d: r.value for d, r in got.items()} == {1: 100.0, 2: 120.0, 3: 180.0, 4: 150.0}
    assert got[3].day_loss == 0 and got[4].day_loss == pytest.approx(1 - 150 / 180)
    assert got[4].drawdown == pytest.approx(1 - (150 / 150) / 1.2) and got[3].drawdown == 0 and got[4].exposure == 0.5


def test_trend_waits_for_the_portfolio(spark):
    from barloom.operators import signals

    rows = [(s, "bull", 80, held, allowed) for s, held, allowed in (("A", False, True), ("B", False, False), ("C", True, False))]
    df = spark.createDataFrame(rows, "symbol string, regime string, selection_score int, held boolean, allowed boolean").selectExpr("*", "1.0D slope", "true near_ma", "true above_ma", "'none' divergence", "false bear_trap", "false golden_cross", "1.0D volume_ratio", "0.0D price_change_pct", "false breakout")
    of = lambda **k: {(r.symbol, r.action, r.score) for r in signals.strategy_signals(df, **k).collect()}
    assert of() == {("A", "BUY", 107), ("C", "ADD", 107)} and of(only_reduce=True) == {("A", "BUY", 107)}


def test_regimes_as_of_and_breakdown(spark):
    from barloom.operators import signals  # noqa: F401

    d = lambda n: datetime(2025, 1, n).date()
    regimes = spark.createDataFrame([(datetime(2025, 1, 3), "bull"), (datetime(2025, 1, 6), "bear")], "datetime timestamp, regime string")
    trades = spark.createDataFrame([(d(4), 4.0, 5), (d(5), -2.0, 3), (d(9), 0.0, 1)], "day date, pnl_pct double, holding_days int")
    found = spark.createDataFrame([(d(2),), (d(3),), (d(4),)], "day date")
    out = {r.regime: r for r in backtest.breakdown(backtest.regime_on(trades, regimes), backtest.regime_on(found, regimes)).collect()}
    assert {k: (r.trade_count, r.signal_count) for k, r in out.items()} == {"bull": (2, 2), "bear": (1, 0), "unknown": (0, 1)}
    assert (out["bull"].win_rate, out["bull"].profit_loss_ratio, out["bull"].avg_holding_days, out["bull"].total_pnl) == (0.5, 2.0, 4.0, 2.0)
    assert out["bear"].profit_loss_ratio == 0 and out["unknown"].win_rate == 0


def test_unmatched_entries(spark):
    t = spark.createDataFrame([("X", 1, "SELL", 1.0), ("X", 2, "BUY", -1.0), ("X", 3, "BUY", -1.0), ("X", 4, "SELL", 2.0), ("X", 5, "BUY", -1.0)], "symbol string, seq int, side string, flow double")
    assert {r.seq for r in backtest.unmatched_entries(t).collect()} == {3, 5}
    assert [(r.k, r.buy_seq, r.sell_seq, r.pnl) for r in backtest.pair_trades(t).collect()] == [(1, 2, 4, 1.0)]


def test_price_position_of_the_last_half_year(spark):
    """Low closes a year ago do not count: the last close is the lowest of the half year, and below its band."""
    start = datetime(2024, 1, 1)
    rows = [("X", "1d", start + timedelta(days=i), 10.0 if i < 150 else 50.0 if i < 399 else 40.0, None, 45.0, 55.0) for i in range(400)]
    rows += [("Y", "1d", start + timedelta(days=i), 50.0 if i < 399 else 60.0, 49.0, 45.0, 55.0) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp, close double, ma120 double, boll_low double, boll_up double")
    of = lambda days: {r.symbol: (r.is_low, r.is_high) for r in screening.price_position(df, days).collect()}
    assert of(180) == {"X": (True, False), "Y": (False, True)} and of(1000)["X"] == (False, False)
