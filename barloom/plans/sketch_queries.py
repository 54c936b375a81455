"""Queries of the sketched strategies, of lots and reports by symbol, and of MACD on a stream with its batch history."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest, screening, signals, sketches
from barloom.operators import indicators as ind
from barloom.plans.indicator_queries import dated, r6, rsql
from barloom.plans.market_queries import G, snap_sql, snapshot, trades_of
from barloom.plans.sql import BARS, _ma, from_bars, from_indicators
from barloom.sources import tables as src
from barloom.streaming import bars as stream

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


TEN, PRIOR = "OVER (PARTITION BY symbol ORDER BY rn ROWS 9 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def gt(a: str, b: str) -> str:
    return f"round({a} - {b}, 9) > 0"


def sided(up: str, down: str, name: str, names: tuple[str, str, str] = ("bullish", "bearish", "none")) -> str:
    return f"CASE WHEN {up} THEN '{names[0]}' WHEN {down} THEN '{names[1]}' ELSE '{names[2]}' END AS {name}"


def trended(up: str, down: str, name: str) -> str:
    return sided(up, down, name, ("up", "down", "side"))


MARKS = f"""
looks AS (SELECT *, {", ".join(f"lag(close, {k}) OVER k AS p{k}" for k in (2, 3, 5, 20))}, {", ".join(f"lag(hist0, {k}) OVER k AS g{k}" for k in (1, 2, 3))}, {", ".join(f"lag(ma250, {k}) OVER k AS m{k}" for k in (1, 2, 3, 20))},
    lag(dif0) OVER k AS d1, lag(dea0) OVER k AS s1, {_ma(5, "hist0")} AS area, min(close) {TEN} AS low10, max(close) {TEN} AS high10, min(dif0) {TEN} AS weak10, max(dif0) {TEN} AS strong10, count(*) {TEN} = 10 AS whole,
    min(low) {PRIOR} AS floor10, max(high) {PRIOR} AS roof10, count(*) {PRIOR} = 10 AS primed, round(volume / nullif({_ma(20, "volume")}, 0), 9) AS v20, round(volume / nullif({_ma(30, "volume")}, 0), 9) AS v30, round({_ma(5, "volume")} / nullif({_ma(20, "volume")}, 0), 9) AS v5
  FROM cross_ind WINDOW k AS (PARTITION BY symbol ORDER BY rn)),
marks AS (SELECT *, {sided(f"close < close1 AND close1 < p2 AND {gt('hist0', 'g1')} AND {gt('g1', 'g2')}", f"close > close1 AND close1 > p2 AND {gt('g1', 'hist0')} AND {gt('g2', 'g1')}", "div_run3")},
    {sided(f"close < p5 AND {gt('area', 'area5')}", f"close > p5 AND {gt('area5', 'area')}", "div_area5")}, {sided(f"close < p3 AND {gt('hist0', 'g3')}", f"close > p3 AND {gt('g3', 'hist0')}", "div_hist3")},
    {sided(f"whole AND close = low10 AND {gt('dif0', 'weak10')}", f"whole AND close = high10 AND {gt('strong10', 'dif0')}", "div_extreme10")},
    {sided(f"primed AND low < floor10 AND {gt('hist0', 'g1')} AND g1 < 0", f"primed AND high > roof10 AND {gt('g1', 'hist0')} AND g1 > 0", "div_turn10")},
    {sided(f"hist0 < 0 AND {gt('abs(g1)', 'abs(hist0)')} AND close < close1", f"hist0 > 0 AND {gt('abs(g1)', 'abs(hist0)')} AND close > close1", "div_shrink")},
    {trended(f"{gt('close', 'ma250')} AND {gt('ma250', 'm20')}", f"{gt('ma250', 'close')} AND {gt('m20', 'ma250')}", "trend20")}, {trended(f"{gt('close', 'ma250')} AND {gt('ma250', 'm1')}", f"{gt('ma250', 'close')} AND {gt('m1', 'ma250')}", "trend1")},
    {trended(gt("ma250", "m20"), gt("m20", "ma250"), "slope20")}, CASE WHEN round(close / ma250 - 1, 9) > 0.05 THEN 0.7 WHEN round(close / ma250 - 1, 9) < -0.05 THEN 0.3 ELSE 0.5 END::DOUBLE AS target_exposure,
    coalesce(round(abs(close - ma250) / ma250, 9) < 0.05, false) AS near250, coalesce(round(abs(close / p5 - 1), 9) < 0.05, false) AS flat5
  FROM (SELECT *, lag(area, 5) OVER (PARTITION BY symbol ORDER BY rn) AS area5 FROM looks))"""

CASES = {
    "legs_buy": f"CASE trend20 WHEN 'up' THEN coalesce({gt('m1', 'm2')} AND {gt('m2', 'm3')} AND (near250 OR div_run3 = 'bullish'), false) OR coalesce(v20 > 1.5 AND flat5, false) WHEN 'down' THEN div_run3 = 'bullish' ELSE (div_run3 = 'bullish' OR near250) AND v20 > 1.5 AND flat5 END",
    "legs_sell": "div_run3 = 'bearish' OR trend20 <> 'up' AND coalesce(v20 > 2 AND flat5, false)",
    "rsi_buy": "CASE trend1 WHEN 'up' THEN near250 AND div_extreme10 = 'bullish' AND rsi < 40 WHEN 'side' THEN rsi < 30 END",
    "rsi_sell": "CASE trend1 WHEN 'up' THEN div_extreme10 = 'bearish' AND rsi > 70 WHEN 'down' THEN rsi > 60 AND v5 > 1.5 ELSE rsi > 70 END",
    "burst_buy": f"{gt('close', 'ma250')} AND v30 > 1.5 AND (near250 AND coalesce({gt('hist0', 'g1')} AND g1 < 0, false) OR coalesce({gt('dif0', 'dea0')} AND {gt('s1', 'd1')}, false))",
    "burst_sell": f"div_turn10 = 'bearish' OR coalesce({gt('ma250', 'close')} AND {gt('close1', 'm1')}, false)",
    "swing_buy": "trend20 = 'side' AND near250 AND close > close1",
    "swing_sell": f"trend20 = 'down' AND {gt('ma250', 'close')} AND close < p20 * 0.8::DOUBLE",
    "steady_buy": f"NOT {gt('m1', 'ma250')} AND div_area5 = 'bullish' AND v30 > 1.5 AND round(abs(close / close1 - 1), 9) < 0.05",
    "cross_buy": f"{gt('close', 'ma250')} AND {gt('dif0', 'dea0')}",
    "cross_sell": gt("dea0", "dif0"),
}


def marked(spark, sf_dir):
    df = ind.with_mean(ind.with_macd(src.daily_bars(spark, sf_dir)), "close", 250, "ma250")
    return sketches.trend_marks(sketches.divergence_marks(df))


DAY = "symbol, datetime::DATE::VARCHAR AS day, "


@query("d16_divergence_marks", from_indicators(f" SELECT {DAY}{', '.join(sketches.DIVERGENCES)} FROM marks", MARKS))
def d16(spark, sf_dir):
    return dated(marked(spark, sf_dir)).select("symbol", "day", *sketches.DIVERGENCES)


@query("f04_trend_marks", from_indicators(f" SELECT {DAY}{', '.join(sketches.TRENDS)}, target_exposure FROM marks WHERE ma250 IS NOT NULL", MARKS))
def f04(spark, sf_dir):
    return dated(marked(spark, sf_dir).filter("ma250 is not null")).select("symbol", "day", *sketches.TRENDS, "target_exposure")


@query("f21_bar_signals", from_indicators(f" SELECT {DAY}{', '.join(f'coalesce({test}, false) AS {name}' for name, test in CASES.items())} FROM marks", MARKS))
def f21(spark, sf_dir):
    return dated(sketches.bar_signals(marked(spark, sf_dir))).select("symbol", "day", *sketches.SIGNALS)


LAST = f", lm AS (SELECT symbol, div_area5 AS mark, NOT {gt('m1', 'ma250')} AS steady, v30, v5, trend1, round(abs(close / close1 - 1), 9) AS moved FROM marks WHERE back = 1)"


def last_marks(spark, sf_dir):
    df = sketches.trend_marks(sketches.divergence_marks(ind.with_mean(ind.with_macd(src.daily_bars(spark, sf_dir)), "close", 250, "ma250")))
    ratio = lambda a, n: F.round(a / F.nullif(ind.sma("volume", n), F.lit(0.0)), 9)
    df = df.withColumns({
        "steady": ~ind.above(ind.lag("ma250"), "ma250"), "v30": ratio(F.col("volume"), 30), "v5": ratio(ind.sma("volume", 5), 20),
        "moved": F.round(F.abs(F.col("close") / ind.lag("close") - 1), 9), "mark": F.col("div_area5"),
    })
    return ind.latest(df).select("symbol", "mark", "steady", "v30", "v5", "trend1", "moved")


@query("e18_three_legs_screen", snap_sql(" SELECT symbol, roe, pe, mark FROM snap JOIN lm USING (symbol) WHERE roe >= 10 AND pe <= 30 AND debt_ratio <= 70 AND cash_flow >= net_profit AND steady AND mark = 'bullish' AND (v30 > 1.5 AND moved < 0.05 OR avg_turnover > 1 AND avg_turnover < 20)", MARKS, LAST.lstrip(", ")))
def e18_legs(spark, sf_dir):
    """Business, divergence over a 250-bar average that does not fall, and volume or turnover."""
    rows = snapshot(spark, sf_dir).join(last_marks(spark, sf_dir), "symbol")
    tests = {
        "roe": F.col("roe") >= 10, "pe": F.col("pe") <= 30, "debt": F.col("debt_ratio") <= 70, "cash": F.col("cash_flow") >= F.col("net_profit"), "average": F.col("steady"), "divergence": F.col("mark") == "bullish",
        "quantity": ((F.col("v30") > 1.5) & (F.col("moved") < 0.05)) | ((F.col("avg_turnover") > 1) & (F.col("avg_turnover") < 20)),
    }
    return screening.screen(rows, tests).select("symbol", "roe", "pe", "mark")


@query("e18_average_screen", snap_sql(" SELECT symbol, round(v5, 6) AS v5 FROM snap JOIN lm USING (symbol) WHERE trend1 = 'up' AND v5 >= 1", MARKS, LAST.lstrip(", ")))
def e18_average(spark, sf_dir):
    """A rising 250-bar average below the close, and volume of 5 bars not under that of 20."""
    rows = snapshot(spark, sf_dir).join(last_marks(spark, sf_dir), "symbol")
    return screening.screen(rows, {"trend": F.col("trend1") == "up", "volume": F.col("v5") >= 1}).select("symbol", *r6("v5"))


LOTS = """, lots AS (SELECT o_custkey AS account, (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS symbol, o_orderkey % 3 <> 0 AS base, o_orderkey % 5 * 100 AS shares, o_orderkey % 6000 / 100.0::DOUBLE + 70 AS price FROM orders),
 lp AS (SELECT symbol, arg_max(close, datetime) AS current_price FROM bars GROUP BY symbol),
 t AS (SELECT account, symbol, coalesce(sum(shares) FILTER (base), 0) AS base_shares, coalesce(sum(shares * price) FILTER (base) / nullif(sum(shares) FILTER (base), 0), 0) AS base_cost, coalesce(sum(shares) FILTER (NOT base), 0) AS mobile_shares, coalesce(sum(shares * price) FILTER (NOT base) / nullif(sum(shares) FILTER (NOT base), 0), 0) AS mobile_cost, coalesce(sum(shares * price), 0) AS total_cost FROM lots GROUP BY account, symbol)
 SELECT account, symbol, base_shares::BIGINT AS base_shares, round(base_cost, 6) AS base_cost, mobile_shares::BIGINT AS mobile_shares, round(mobile_cost, 6) AS mobile_cost, round((base_shares + mobile_shares) * current_price, 4) AS market_value,
   round((base_shares + mobile_shares) * current_price - total_cost, 4) AS profit_loss, round(coalesce(((base_shares + mobile_shares) * current_price - total_cost) / nullif(total_cost, 0), 0), 6) AS profit_rate FROM t JOIN lp USING (symbol)"""


@query("f19_base_and_mobile", from_bars(LOTS))
def f19(spark, sf_dir):
    """Every order adds a lot to one tranche of its account's position."""
    orders = src.table(spark, sf_dir, "orders")
    suppliers = src.table(spark, sf_dir, "supplier").count()
    lots = orders.select(
        F.col("o_custkey").alias("account"), F.pmod("o_custkey", F.lit(suppliers)).cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 3 != 0, "base").otherwise("mobile").alias("tranche"),
        (F.col("o_orderkey") % 5 * 100).alias("shares"), (F.pmod("o_orderkey", F.lit(6000)) / 100.0 + 70).alias("price"),
    )
    prices = src.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "datetime").alias("current_price"))
    out = signals.valued_tranches(lots, prices)
    return out.select("account", "symbol", "base_shares", *r6("base_cost"), "mobile_shares", *r6("mobile_cost"), *[F.round(c, 4).alias(c) for c in ("market_value", "profit_loss")], *r6("profit_rate"))


REPORT = G + """, nv AS (SELECT *, close / lag(close) OVER k - 1 AS step, 1 - close / max(close) OVER k AS dd FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY datetime)),
 na AS (SELECT symbol, count(*) AS days, arg_max(close, datetime) / arg_min(close, datetime) - 1 AS total_return, max(dd) AS max_drawdown, (avg(step) - 0.03::DOUBLE / 365) / nullif(stddev_pop(step), 0) * sqrt(252) AS sharpe FROM nv GROUP BY symbol),
 ta AS (SELECT symbol, count(*) AS trades, count(*) FILTER (pnl_pct > 0) AS wins, coalesce(sum(pnl_pct) FILTER (pnl_pct > 0), 0) AS gained, coalesce(-sum(pnl_pct) FILTER (pnl_pct < 0), 0) AS lost, sum(200 + pnl_pct) AS amount FROM tr GROUP BY symbol)
 SELECT symbol, round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, coalesce(trades, 0)::BIGINT AS trades, round(coalesce(wins / trades, 0), 6) AS trade_win_rate,
   round(CASE WHEN wins > 0 AND trades > wins THEN coalesce((gained / wins) / nullif(lost / (trades - wins), 0), 0) ELSE 0 END, 6) AS profit_loss_ratio, round(coalesce(amount, 0) / 20000 / (days / 252), 6) AS turnover
 FROM na LEFT JOIN ta USING (symbol)"""


@query("g19_symbol_report", REPORT)
def g19(spark, sf_dir):
    """A symbol's closes with its trades of 100 each, out of a capital of 10,000."""
    trades = trades_of(spark, sf_dir).select("symbol", F.col("pnl_pct").alias("pnl"), (200 + F.col("pnl_pct")).alias("amount"))
    out = backtest.symbol_report(backtest.nav_metrics(src.daily_bars(spark, sf_dir)), trades, 10_000)
    return out.select("symbol", *r6("total_return", "max_drawdown", "sharpe"), "trades", *r6("trade_win_rate", "profit_loss_ratio", "turnover"))


@query("i02_streamed_macd", from_indicators(f" SELECT {DAY}{rsql('dif', 'dea')}, coalesce(golden_cross AND rn > 34, false) AS golden_cross, coalesce(death_cross AND rn > 34, false) AS death_cross FROM cross_ind WHERE datetime >= TIMESTAMP '1997-01-01'"))
def i02(spark, sf_dir):
    """MACD of a bounded stream of the bars from 1997 on, its state begun from the bars before."""
    bars = src.daily_bars(spark, sf_dir).select("symbol", "timeframe", "datetime", "close")
    late = F.col("datetime") >= F.lit("1997-01-01").cast("timestamp")
    folder = src.run_folder(spark, "macd")
    bars.filter(late).write.parquet(f"{folder}/bars")
    arriving = spark.readStream.schema(bars.schema).parquet(f"{folder}/bars")
    with stream.rocksdb(spark):
        stream.run_once(stream.stream_macd(arriving, bars.filter(~late)), f"{folder}/alerts", f"{folder}/checkpoint")
    return dated(spark.read.schema(stream.ALERT).parquet(f"{folder}/alerts")).select("symbol", "day", *r6("dif", "dea"), "golden_cross", "death_cross")
