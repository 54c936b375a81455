"""Queries of screening, regimes, strategy signals, risk, backtests, the event log and the candidate pool."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.symbols import business_expiry
from barloom.operators import backtest, chan, pool, screening, signals
from barloom.operators import bars as bars_ops
from barloom.operators import indicators as ind
from barloom.plans.indicator_queries import r6, rsql
from barloom.plans.sql import BARS, INDEX, INDICATORS, TICKS, macd
from barloom.plans.structure_queries import DIVERGENCE, FRACTALS, MERGED, POINTS, STROKES, VOLUME_PATTERN, d19, points_sql
from barloom.sources import tables as src
from barloom.streaming import bars as stream
from barloom.streaming.store import VersionedTable, route_stream, unseen, upsert_stream

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


SNAP = """
fund AS (SELECT s_suppkey::VARCHAR AS symbol, s_nationkey AS industry, s_suppkey * 7 % 25 + 1.5::DOUBLE AS roe, (s_suppkey * 13 % 80 + 10)::DOUBLE AS debt_ratio, s_suppkey * 11 % 45 - 3.5::DOUBLE AS pe,
  (s_suppkey * 17 % 600 + 20)::DOUBLE AS market_cap, (s_suppkey * 5 % 50)::DOUBLE / 10 AS avg_turnover, (s_suppkey * 29 % 60 + 5)::DOUBLE AS gross_margin, s_acctbal / 10000 AS profit_growth,
  (s_suppkey * 19 % 200)::DOUBLE / 100 AS ocf_to_profit, (s_suppkey * 3 % 12)::DOUBLE / 100 AS rd_ratio, (s_suppkey * 23 % 40)::DOUBLE / 10 + 0.5 AS pb, (s_suppkey * 31 % 90)::DOUBLE / 10 + 0.2 AS ps,
  (s_suppkey * 37 % 100)::DOUBLE AS receivables, (s_suppkey * 41 % 140 + 20)::DOUBLE AS cash, (s_suppkey * 43 % 30)::DOUBLE AS interest, (s_suppkey * 47 % 120 - 10)::DOUBLE AS net_profit, (s_suppkey * 53 % 110)::DOUBLE AS cash_flow FROM supplier),
snap AS (SELECT f.*, close, ma250_slope AS slope, round((close - ma250) / ma250 * 100, 9) AS close_vs_ma, volume_ratio30 AS volume_ratio, round(pct_change * 100, 9) AS price_change_pct, divergence, round(volatility * 100, 9) AS volatility_pct,
    coalesce(abs(close - ma250) / ma250 < 0.05, false) AS near_ma, coalesce(round(close - ma250, 9) > 0, false) AS above_ma, coalesce(golden_cross, false) AS golden_cross, coalesce(death_cross, false) AS death_cross, breakout20 AS breakout,
    divergence = 'bullish' AND coalesce((ma250 - m19) / greatest(abs(m19), 1) > 0, false) AND coalesce(dip = 1, false) AND coalesce(close > ma250, false) AS bear_trap,
    coalesce(round(ma250 - p1, 9) > 0 AND round(p1 - p2, 9) > 0, false) AS ma_up, coalesce(close < close1 AND close1 < k2 AND round(hist - h1, 9) > 0 AND round(h1 - h2, 9) > 0, false) AS turn_up, coalesce(c.volume_ratio > 1.5 AND abs(close / k5 - 1) < 0.05, false) AS heavy_flat
  FROM fund f JOIN (SELECT *, lag(ma250, 19) OVER k AS m19, max((close < ma250)::INT) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) AS dip, lag(ma250) OVER k AS p1, lag(ma250, 2) OVER k AS p2, lag(close, 2) OVER k AS k2, lag(close, 5) OVER k AS k5, lag(hist) OVER k AS h1, lag(hist, 2) OVER k AS h2
    FROM cross_ind WINDOW k AS (PARTITION BY symbol ORDER BY rn)) c USING (symbol) JOIN div USING (symbol) WHERE back = 1 AND rn >= 250),
sel AS (SELECT *, CASE WHEN NOT roe >= 10 THEN 'roe' WHEN NOT debt_ratio <= 50 THEN 'debt_ratio' WHEN NOT (pe > 0 AND pe <= 30) THEN 'pe' WHEN NOT market_cap BETWEEN 50 AND 500 THEN 'market_cap' ELSE 'pass' END AS fundamental_reason,
    avg_turnover BETWEEN 1 AND 3 AS t, volume_ratio >= 1.5 AND price_change_pct BETWEEN -3 AND 3 AND (slope > 0 AND abs(close_vs_ma) <= 5 OR divergence = 'bullish' OR bear_trap) AS v FROM snap)"""


def snap_sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([BARS, INDICATORS, DIVERGENCE, SNAP, *more]) + select


#: What a snapshot needs of the last bar with indicators.
SNAPSHOT = ["close", "n_rows", "ma250_slope", "ma250_distance", "near_ma250", "above_ma250", "volume_ratio30", "pct_change", "volatility", "golden_cross", "death_cross", "breakout20", "ma_up", "turn_up", "heavy_flat"]


def snapshot(spark, sf_dir):
    """Latest technical state of every supplier with 250 bars or more, with its fundamentals: the 250-bar average, volume against 30 bars.

    One pass: indicators of the last bars, the last one's with the divergence, written once for the branches that use the result.
    """
    df = chan.trap_tests(screening.turns(ind.latest_enriched(src.daily_bars(spark, sf_dir))))
    last = chan.divergences(df, carry=[*SNAPSHOT, "rising", "dipped", "back"]).filter("n_rows >= 250").withColumn("bear_trap", chan.trap_reason() == "trap")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    tech = last.select(
        "symbol", "close", F.col("ma250_slope").alias("slope"), F.round(F.col("ma250_distance") * 100, 9).alias("close_vs_ma"), F.col("volume_ratio30").alias("volume_ratio"), F.round(F.col("pct_change") * 100, 9).alias("price_change_pct"), "divergence",
        F.round(F.col("volatility") * 100, 9).alias("volatility_pct"), F.col("near_ma250").alias("near_ma"), F.col("above_ma250").alias("above_ma"), flag("golden_cross"), flag("death_cross"), F.col("breakout20").alias("breakout"), "bear_trap", "ma_up", "turn_up", "heavy_flat",
    )
    return src.written(src.fundamentals(spark, sf_dir).join(tech, "symbol"), "snapshot")[0]


@query("e01_selection_input", snap_sql(" SELECT symbol, roe, pe, " + rsql("slope", "close_vs_ma", "volume_ratio", "price_change_pct") + ", divergence, bear_trap FROM snap"))
def e01(spark, sf_dir):
    return snapshot(spark, sf_dir).select("symbol", "roe", "pe", *r6("slope", "close_vs_ma", "volume_ratio", "price_change_pct"), "divergence", "bear_trap")


@query("e05_selector", snap_sql(" SELECT symbol, fundamental_reason, (CASE WHEN fundamental_reason = 'pass' THEN 40 ELSE 0 END + CASE WHEN t THEN 25 ELSE 0 END + CASE WHEN v THEN 35 ELSE 0 END)::INT AS score, fundamental_reason = 'pass' AND t AND v AS selected FROM sel"))
def e05(spark, sf_dir):
    """E02 to E05."""
    return screening.select_stocks(snapshot(spark, sf_dir)).select("symbol", "fundamental_reason", "score", "selected")


@query("e06_funnel", snap_sql(" SELECT count(*) AS total, count(*) FILTER (fundamental_reason = 'pass') AS fundamental, count(*) FILTER (fundamental_reason = 'pass' AND t) AS turnover, count(*) FILTER (fundamental_reason = 'pass' AND t AND v) AS pool FROM sel"))
def e06(spark, sf_dir):
    return screening.funnel(screening.select_stocks(snapshot(spark, sf_dir)))


#: Scores of bars of ``sc``: indicators with the best fresh points (fb, fs) and the next higher timeframe (hd its dif, hc its change).
BUY = "greatest(coalesce(CASE WHEN golden_cross THEN CASE zone WHEN 'above' THEN 50 WHEN 'near' THEN 30 ELSE 10 END + least(15, confirmation_count * 5) END, 0) + coalesce(fb, 0) + CASE WHEN hc > 0 THEN 15 ELSE 0 END + CASE WHEN hd > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(round(close - ma60, 9) > 0, false) AND coalesce(round(ma60 - ma60_before, 9) > 0, false) THEN 10 ELSE 0 END + CASE WHEN volume_ratio >= 1 THEN 5 ELSE 0 END - CASE WHEN fs IS NOT NULL THEN 30 ELSE 0 END, 0)::INT"
SELL = "greatest(CASE WHEN death_cross AND zone = 'near' THEN 30 ELSE 0 END + coalesce(fs, 0) + CASE WHEN hc < 0 THEN 15 ELSE 0 END + CASE WHEN hd < 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(round(ma60 - close, 9) > 0, false) AND coalesce(round(ma60_before - ma60, 9) > 0, false) THEN 10 ELSE 0 END + CASE WHEN volume_ratio >= 1 AND close < close1 THEN 5 ELSE 0 END - CASE WHEN fb IS NOT NULL THEN 30 ELSE 0 END, 0)::INT"
FRESH = """
fp AS (SELECT symbol, confirmed_at AS datetime, max(worth) FILTER (side = 'buy') AS fb, max(worth) FILTER (side = 'sell') AS fs FROM points GROUP BY symbol, confirmed_at)"""
SCORED = FRESH + f""",
sc AS (SELECT *, {BUY} AS buy_score, {SELL} AS sell_score FROM (SELECT c.*, fb, fs, NULL::DOUBLE AS hd, NULL::DOUBLE AS hc FROM cross_ind c LEFT JOIN fp USING (symbol, datetime)))"""


def with_points(bars):
    """Enriched bars of any timeframes with the structure points confirmed at each."""
    return chan.with_fresh(ind.enriched(bars), chan.chan_signals(bars))


def scored(df):
    """Buy and sell scores of bars with their fresh points; daily bars have no higher timeframe."""
    if "higher_dif" not in df.columns:
        df = df.withColumns({"higher_dif": F.lit(None).cast("double"), "higher_change": F.lit(None).cast("double")})
    buy, sell = F.col("fresh_buy"), F.col("fresh_sell")
    return df.withColumns({"buy_score": screening.side_score("buy", buy, sell.isNotNull()), "sell_score": screening.side_score("sell", sell, buy.isNotNull())})


@query("e07_side_scores", points_sql(" SELECT symbol, datetime::DATE::VARCHAR AS day, fb::INT AS fresh_buy, fs::INT AS fresh_sell, buy_score, sell_score FROM sc WHERE golden_cross OR death_cross OR fb IS NOT NULL OR fs IS NOT NULL", SCORED))
def e07(spark, sf_dir):
    """E07, E08 of every daily bar that has a cross or a point."""
    df = scored(chan.crossings(src.daily_bars(spark, sf_dir))).filter("golden_cross or death_cross or fresh_buy is not null or fresh_sell is not null")
    return df.select("symbol", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "fresh_buy", "fresh_sell", "buy_score", "sell_score")


@query("e09_zero_axis_scan", points_sql(" SELECT symbol, datetime::DATE::VARCHAR AS day, zone, (CASE zone WHEN 'above' THEN 3 WHEN 'near' THEN 2 ELSE 1 END * 100 + buy_score)::INT AS score FROM sc WHERE golden_cross AND rn >= 120", SCORED))
def e09(spark, sf_dir):
    """The scan of every day at once."""
    found = screening.zero_axis_scan(scored(chan.crossings(src.daily_bars(spark, sf_dir))), 120)
    return found.select("symbol", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "zone", F.col("score").cast("int").alias("score"))


#: Bars of all timeframes from ticks; ``symbol`` holds the timeframe as well, so that all that goes by symbol goes by both.
LATTICE = TICKS + """,
minutes AS (SELECT symbol, to_timestamp((floor(epoch(ts) / 60) + 1) * 60)::TIMESTAMP AS datetime, arg_min(c - step, rn) / 100.0 AS open, max(greatest(c, c - step)) / 100.0 AS high, min(least(c, c - step)) / 100.0 AS low, arg_max(c, rn) / 100.0 AS close, count(*)::DOUBLE AS volume, sum(c)::DOUBLE AS amount FROM tick GROUP BY ALL),
bars AS (SELECT symbol || '@' || timeframe AS symbol, timeframe, to_timestamp(ceil(epoch(m.datetime) / 60 / n) * n * 60)::TIMESTAMP AS datetime, arg_min(open, m.datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, m.datetime) AS close, sum(volume) AS volume, sum(amount) AS amount
  FROM minutes m, (VALUES ('1m', 1), ('5m', 5), ('15m', 15), ('30m', 30), ('60m', 60), ('120m', 120), ('1d', 1440)) f(timeframe, n) GROUP BY symbol, timeframe, ceil(epoch(m.datetime) / 60 / n) * n)"""
HIGHER = """
fr0 AS (SELECT split_part(symbol, '@', 1) AS of, CASE timeframe WHEN '1m' THEN 0 WHEN '5m' THEN 1 WHEN '15m' THEN 2 WHEN '30m' THEN 3 WHEN '60m' THEN 4 WHEN '120m' THEN 5 ELSE 6 END AS ordinal, timeframe, datetime, dif, dif - lag(dif) OVER (PARTITION BY symbol ORDER BY rn) AS change, rn >= 37 AND dea IS NOT NULL AS ok FROM cross_ind),
hg AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN ordinal = {i} THEN {{'t': timeframe, 'd': dif, 'c': change, 'ok': ok}} END IGNORE NULLS) OVER (PARTITION BY of ORDER BY datetime, -ordinal ROWS UNBOUNDED PRECEDING) AS h{i}" for i in range(1, 7)) + """ FROM fr0),
hi AS (SELECT of || '@' || timeframe AS symbol, datetime, CASE """ + " ".join(f"WHEN ordinal < {i} AND h{i}.ok THEN h{i}" for i in range(1, 7)) + """ END AS h FROM hg)"""


def lattice_sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([LATTICE, INDICATORS, MERGED, FRACTALS, STROKES, POINTS, HIGHER, *more]) + select


def lattice(spark, sf_dir):
    """Bars of 1m to 1d of the ticks."""
    return bars_ops.lattice(src.minute_bars(spark, sf_dir))


@query("b07_timeframe_lattice", "WITH " + LATTICE + " SELECT split_part(symbol, '@', 1) AS symbol, timeframe, strftime(datetime, '%Y-%m-%d %H:%M') AS at, open, high, low, close, volume, amount FROM bars")
def b07(spark, sf_dir):
    """B05 and the clock side of B01, B02: bars of all timeframes by one shuffle."""
    return lattice(spark, sf_dir).select("symbol", "timeframe", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("at"), "open", "high", "low", "close", "volume", "amount")


@query("b06_next_higher", lattice_sql(" SELECT split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS timeframe, strftime(datetime, '%Y-%m-%d %H:%M') AS at, h.t AS higher_timeframe, round(h.d, 6) AS higher_dif, sign(round(h.c, 9))::INT AS higher_turn FROM hi WHERE h IS NOT NULL"))
def b06(spark, sf_dir):
    """For each bar, the last closed bar of the next higher timeframe that had enough of them by then."""
    df = screening.with_higher(ind.crosses(ind.with_averages(ind.with_macd(lattice(spark, sf_dir))))).filter("higher_timeframe is not null")
    return df.select("symbol", "timeframe", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("at"), "higher_timeframe", *r6("higher_dif"), F.signum(F.round("higher_change", 9)).cast("int").alias("higher_turn"))


SCORED_HIGHER = FRESH + f""",
sc AS (SELECT *, {BUY} AS buy_score, {SELL} AS sell_score FROM (SELECT c.*, fb, fs, h.d AS hd, round(h.c, 9) AS hc, h.t AS ht FROM cross_ind c LEFT JOIN fp USING (symbol, datetime) LEFT JOIN hi USING (symbol, datetime)))"""


def scored_lattice(spark, sf_dir):
    return scored(screening.with_higher(with_points(lattice(spark, sf_dir))))


@query("e08_timeframe_scores", lattice_sql(" SELECT split_part(symbol, '@', 1) AS symbol, timeframe, strftime(datetime, '%Y-%m-%d %H:%M') AS at, ht AS higher_timeframe, fb::INT AS fresh_buy, fs::INT AS fresh_sell, buy_score, sell_score FROM sc WHERE golden_cross OR death_cross OR fb IS NOT NULL OR fs IS NOT NULL", SCORED_HIGHER))
def e08(spark, sf_dir):
    """E07, E08 over all timeframes, with the next higher one as of each bar."""
    df = scored_lattice(spark, sf_dir).filter("golden_cross or death_cross or fresh_buy is not null or fresh_sell is not null")
    return df.select("symbol", "timeframe", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("at"), "higher_timeframe", "fresh_buy", "fresh_sell", "buy_score", "sell_score")


@query("h03_timeframe_events", lattice_sql(""", se AS (SELECT split_part(symbol, '@', 1) AS of, timeframe, datetime, side, CASE side WHEN 'buy' THEN buy_score ELSE sell_score END AS score, CASE WHEN side = 'buy' AND golden_cross THEN 'macd_golden_cross_' || zone WHEN side = 'sell' AND death_cross AND zone = 'near' THEN 'zero_axis_death_cross' END AS crossing, symbol AS key FROM sc, (VALUES ('buy'), ('sell')) s(side)),
 ee AS (SELECT of AS symbol, e.timeframe, e.datetime, e.side, e.score, coalesce(p.type, crossing) AS signal_type, CASE WHEN score >= 60 THEN 'strong' ELSE 'structure' END AS level, score * CASE e.timeframe WHEN '1m' THEN 1 WHEN '5m' THEN 2 WHEN '15m' THEN 3 WHEN '30m' THEN 4 WHEN '60m' THEN 5 WHEN '120m' THEN 6 ELSE 8 END AS weighted
   FROM se e LEFT JOIN points p ON p.symbol = e.key AND p.confirmed_at = e.datetime AND p.side = e.side WHERE (crossing IS NOT NULL AND score >= 60) OR p.type IS NOT NULL)
 SELECT symbol, timeframe, strftime(datetime, '%Y-%m-%d %H:%M') AS at, side, signal_type, level, score, weighted::INT AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY weighted DESC, datetime DESC, timeframe, signal_type) AS r FROM ee) WHERE r <= 20""", SCORED_HIGHER))
def h03_timeframes(spark, sf_dir):
    """Each symbol's twenty best events of all timeframes, by score times weight, then the latest."""
    events = pool.timeframe_events(scored_lattice(spark, sf_dir))
    best = pool.ranked_events(events, 20, F.col("timeframe"), F.col("signal_type"))
    return best.select("symbol", "timeframe", F.date_format("confirmed_at", "yyyy-MM-dd HH:mm").alias("at"), "side", "signal_type", "level", "score", (F.col("score") * F.col("weight")).alias("weighted"))


@query("e10_coverage", "SELECT count(*) FILTER (s_suppkey % 5 <> 0) AS eligible, count(*) FILTER (s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0)::BIGINT AS successful FROM supplier")
def e10(spark, sf_dir):
    s = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return screening.coverage(s, s.filter("symbol % 3 <> 0"), s.filter("symbol % 5 = 0")).select("eligible", "successful")


MEDIANS = """, m AS (SELECT industry, median(gross_margin) AS mg, median(rd_ratio) AS mr, median(pe) FILTER (pe > 0) AS mp, median(ps) FILTER (ps > 0) AS ms FROM fund GROUP BY industry)"""
FUND = "WITH " + SNAP.split("snap AS (")[0].rstrip().rstrip(",") + MEDIANS


QUALITY = """(CASE WHEN roe > 15 THEN 3 WHEN roe > 10 THEN 2 WHEN roe > 8 THEN 1 ELSE 0 END + CASE WHEN gross_margin > mg * 1.2 THEN 2 WHEN gross_margin > mg THEN 1 ELSE 0 END + CASE WHEN ocf_to_profit > 1 THEN 2 WHEN ocf_to_profit > 0.8 THEN 1 ELSE 0 END
 + CASE WHEN industry IN (3, 7) THEN (debt_ratio < 80)::INT WHEN debt_ratio < 40 THEN 2 WHEN debt_ratio < 60 THEN 1 ELSE 0 END + CASE WHEN rd_ratio > mr * 1.2 THEN 2 WHEN rd_ratio > mr THEN 1 ELSE 0 END + CASE WHEN profit_growth > 0.3 THEN 2 WHEN profit_growth > 0.1 THEN 1 ELSE 0 END)::INT"""


#: Nations that stand for the industries of banks and insurers.
LENDERS = (3, 7)


@query("e11_quality_score", FUND + f" SELECT symbol, {QUALITY} AS quality FROM fund JOIN m USING (industry)")
def e11(spark, sf_dir):
    return screening.quality_score(src.fundamentals(spark, sf_dir), LENDERS).select("symbol", "quality")


VALUE = """(CASE WHEN pe > 0 AND pe < mp * 0.7 THEN 3 WHEN pe > 0 AND pe < mp THEN 2 ELSE 0 END + CASE WHEN ps > 0 AND ps < ms * 0.7 THEN 2 WHEN ps > 0 AND ps < ms THEN 1 ELSE 0 END
 + CASE WHEN profit_growth > 0 AND pe > 0 AND pe / (profit_growth * 100) < 1 THEN 3 WHEN profit_growth > 0 AND pe / (profit_growth * 100) < 1.5 THEN 2 ELSE 0 END + CASE WHEN pb > 0 AND pb < pb_mean * 0.6 THEN 2 WHEN pb > 0 AND pb < pb_mean * 0.8 THEN 1 ELSE 0 END)::INT"""


FUND_CTES = SNAP.split("snap AS (")[0].strip().rstrip(",") + MEDIANS
#: The book moves slowly: a symbol's price to book has followed its price, so its own mean is that of its closes.
OWN_PB = ", own AS (SELECT f.*, round(pb * ratio, 9) AS pb_mean FROM fund f LEFT JOIN (SELECT symbol, avg(close) / arg_max(close, datetime) AS ratio FROM bars GROUP BY symbol) USING (symbol))"


def valued(spark, sf_dir):
    """Fundamentals with pb_mean, the symbol's own mean price to book, and the valuation score."""
    ratio = src.daily_bars(spark, sf_dir).groupBy("symbol").agg((F.avg("close") / F.max_by("close", "datetime")).alias("ratio"))
    fund = src.fundamentals(spark, sf_dir).join(ratio, "symbol", "left")
    return screening.valuation_score(fund.withColumn("pb_mean", F.round(F.col("pb") * F.col("ratio"), 9)))


@query("e12_valuation_score", "WITH RECURSIVE " + BARS + ", " + FUND_CTES + OWN_PB + f" SELECT symbol, {VALUE} AS valuation FROM own JOIN m USING (industry)")
def e12(spark, sf_dir):
    return valued(spark, sf_dir).select("symbol", "valuation")


@query("e20_group_acceptance", "SELECT n_name AS grp, count(*) FILTER (s_acctbal > 3000) AS candidates, count(*) FILTER (s_acctbal > 8000) AS buys, count(*) FILTER (s_acctbal > 3000) >= 2 AS accepted FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def e20(spark, sf_dir):
    s = src.table(spark, sf_dir, "supplier").join(src.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_acctbal") > 8000, 90).otherwise(50).alias("score"))
    return screening.group_acceptance(rows, s.select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("grp")))


REGIME = "WITH RECURSIVE " + BARS + "," + INDEX + "," + macd("idx", "im") + """,
ia AS (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING) AS ma20, CASE WHEN rn >= 250 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 249 PRECEDING) END AS ma250 FROM im),
ib AS (SELECT datetime, close / ma250 - 1 AS p, ma20 / ma250 - 1 AS m, coalesce(ma250 / lag(ma250, 19) OVER (ORDER BY rn) - 1, 0) AS s, hist0 AS h, ma250 FROM ia),
ic AS (SELECT *, round(CASE WHEN p >= 0.02 THEN 0.35 ELSE 0 END + CASE WHEN m >= 0.01 THEN 0.25 ELSE 0 END + CASE WHEN s >= 0.01 THEN 0.20 ELSE 0 END + CASE WHEN h > 0 THEN 0.10 ELSE 0 END, 4)::DOUBLE AS bull,
  round(CASE WHEN p <= -0.02 THEN 0.35 ELSE 0 END + CASE WHEN m <= -0.01 THEN 0.25 ELSE 0 END + CASE WHEN s <= -0.01 THEN 0.20 ELSE 0 END + CASE WHEN h < 0 THEN 0.10 ELSE 0 END, 4)::DOUBLE AS bear,
  round(CASE WHEN abs(p) < 0.02 THEN 0.10 ELSE 0 END + CASE WHEN abs(m) < 0.01 THEN 0.15 ELSE 0 END + CASE WHEN abs(s) < 0.01 THEN 0.20 ELSE 0 END
    + CASE WHEN abs(p) <= 0.03 THEN 0.20 ELSE 0 END + CASE WHEN abs(m) <= 0.015 THEN 0.15 ELSE 0 END + CASE WHEN abs(s) <= 0.008 THEN 0.10 ELSE 0 END, 4)::DOUBLE AS calm FROM ib WHERE ma250 IS NOT NULL),
regime AS (SELECT *, CASE WHEN bull > bear AND bull > calm THEN 'bull' WHEN bear > bull AND bear > calm THEN 'bear' ELSE 'range' END AS regime FROM ic)"""


SIDES = ", ".join(f"array_to_string([x FOR x IN [CASE WHEN p {o} {s}0.02 THEN 'price' END, CASE WHEN m {o} {s}0.01 THEN 'average' END, CASE WHEN s {o} {s}0.01 THEN 'slope' END, CASE WHEN h {o[0]} 0 THEN 'macd' END] IF x IS NOT NULL], ',') AS {n}_reasons" for o, s, n in ((">=", "", "bull"), ("<=", "-", "bear")))


@query("f02_regime", REGIME + f" SELECT datetime::DATE::VARCHAR AS day, bull, bear, calm, regime, {SIDES} FROM regime")
def f02(spark, sf_dir):
    """F01 to F03 for every date."""
    return signals.regimes(src.index_bars(spark, sf_dir)).select(F.date_format("datetime", "yyyy-MM-dd").alias("day"), "bull", "bear", "calm", "regime", *[F.array_join(c, ",").alias(c) for c in ("bull_reasons", "bear_reasons")])


@query("f03_forced_regime", REGIME + " SELECT datetime::DATE::VARCHAR AS day, regime AS auto_regime, 'bear' AS final_regime FROM regime")
def f03(spark, sf_dir):
    """The decision overridden by hand, with the one it replaces."""
    df = signals.regimes(src.index_bars(spark, sf_dir), override="bear")
    return df.select(F.date_format("datetime", "yyyy-MM-dd").alias("day"), "auto_regime", F.col("regime").alias("final_regime"))


@query("f04_simple_regime", "WITH RECURSIVE " + BARS + "," + INDICATORS + " SELECT symbol, datetime::DATE::VARCHAR AS day, CASE WHEN close / ma250 - 1 > 0.05 THEN 0.7 WHEN close / ma250 - 1 < -0.05 THEN 0.3 ELSE 0.5 END::DOUBLE AS target_exposure FROM cross_ind WHERE ma250 IS NOT NULL")
def f04(spark, sf_dir):
    df = signals.simple_regime(ind.with_averages(src.daily_bars(spark, sf_dir)).filter("ma250 is not null"))
    return df.select("symbol", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "target_exposure")


STRAT = """, pl AS (SELECT *, CASE s_i % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'range' ELSE 'bear' END AS regime, s_i % 2 = 0 AS held, 40 + s_i % 50 AS selection_score FROM (SELECT *, symbol::INT AS s_i FROM snap)),
ts AS (SELECT *, selection_score + CASE WHEN slope > 0 THEN 15 ELSE 0 END + CASE WHEN near_ma AND above_ma THEN 12 ELSE 0 END + CASE WHEN divergence = 'bullish' THEN 18 ELSE 0 END + CASE WHEN bear_trap THEN 15 ELSE 0 END + CASE WHEN golden_cross THEN 10 ELSE 0 END + CASE WHEN volume_ratio > 1.5 THEN 8 ELSE 0 END + CASE WHEN price_change_pct < 0 AND volume_ratio <= 1.2 THEN 6 ELSE 0 END AS tsc,
  selection_score + CASE WHEN divergence = 'bullish' THEN 16 ELSE 0 END + CASE WHEN near_ma THEN 12 ELSE 0 END + CASE WHEN price_change_pct <= 0 THEN 8 ELSE 0 END + CASE WHEN volume_ratio >= 1 THEN 5 ELSE 0 END AS rsc,
  50 + CASE WHEN bear_trap THEN 15 ELSE 0 END + CASE WHEN divergence = 'bullish' THEN 10 ELSE 0 END + CASE WHEN slope < 0 THEN 5 ELSE 0 END + CASE WHEN volume_ratio > 1.5 THEN 5 ELSE 0 END AS gsc,
  selection_score + CASE WHEN breakout THEN 18 ELSE 0 END + CASE WHEN volume_ratio >= 1.6 THEN 12 ELSE 0 END + CASE WHEN slope > 0 THEN 8 ELSE 0 END AS bsc, CASE WHEN held THEN 'ADD' ELSE 'BUY' END AS act FROM pl),
fl AS (SELECT *, bsc >= 78 AND breakout AND volume_ratio >= 1.6 AS fires, tsc >= CASE WHEN regime = 'bull' THEN 75 ELSE 85 END AS tf, rsc >= 70 AND divergence = 'bullish' AS rf FROM ts),
sg AS (SELECT symbol, regime, 'trend' AS strategy, act AS action, tsc AS score FROM fl WHERE tf AND (regime = 'range' OR regime = 'bull' AND NOT fires)
 UNION ALL SELECT symbol, regime, 'reversion', act, rsc FROM fl WHERE regime = 'range' AND rf
 UNION ALL SELECT symbol, regime, 'breakout', act, bsc - CASE WHEN regime = 'range' THEN 5 ELSE 0 END FROM fl WHERE fires AND regime <> 'bear'
 UNION ALL SELECT symbol, regime, 'defensive', 'REDUCE', greatest(gsc, 78) FROM fl WHERE regime = 'bear' AND held AND (divergence = 'bearish' OR NOT above_ma)
 UNION ALL SELECT symbol, regime, 'defensive', 'BUY', gsc FROM fl WHERE regime = 'bear' AND NOT held AND bear_trap AND gsc >= 72)"""


def pool_rows(spark, sf_dir, snap=None):
    k = F.col("symbol").cast("int")
    regime = F.when(k % 3 == 0, "bull").when(k % 3 == 1, "range").otherwise("bear")
    return (snapshot(spark, sf_dir) if snap is None else snap).withColumns({"regime": regime, "held": k % 2 == 0, "selection_score": 40 + k % 50})


@query("f09_routed_signals", snap_sql(" SELECT symbol, regime, strategy, action, score::INT AS score FROM sg", STRAT.lstrip(", ")))
def f09(spark, sf_dir):
    """F05 to F09."""
    return signals.strategy_signals(pool_rows(spark, sf_dir)).select("symbol", "regime", "strategy", "action", "score")


@query("f10_resolved_signals", snap_sql(" SELECT symbol, strategy, action, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE action WHEN 'SELL' THEN 4 WHEN 'REDUCE' THEN 3 WHEN 'ADD' THEN 2 ELSE 1 END DESC, score DESC, strategy) AS r FROM sg) WHERE r = 1", STRAT.lstrip(", ")))
def f10(spark, sf_dir):
    return signals.resolve_conflicts(signals.strategy_signals(pool_rows(spark, sf_dir))).select("symbol", "strategy", "action", "score")


HOLD = """, hold AS (SELECT o_custkey AS account, (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS symbol, count(*) * 100 AS shares, max(o_orderkey) % 6000 / 100.0::DOUBLE + 70 AS cost, (max(o_orderkey) % 90)::INT AS holding_days FROM orders GROUP BY o_custkey),
pr AS (SELECT account, h.symbol, round((close / cost - 1) * 100, 9) AS profit_pct, holding_days, volatility_pct, above_ma, slope, shares, cost, close, CASE WHEN account % 3 = 0 THEN 'bear' ELSE 'bull' END AS regime,
  round(8.0::DOUBLE * CASE WHEN holding_days >= 40 THEN 1.25 ELSE 1 END * CASE WHEN volatility_pct >= 35 THEN 1.2 ELSE 1 END, 6) AS stop_loss, round(30.0::DOUBLE * CASE WHEN holding_days >= 40 THEN 1.1 ELSE 1 END * CASE WHEN volatility_pct >= 35 THEN 1.1 ELSE 1 END, 6) AS take_profit FROM hold h JOIN snap USING (symbol))"""


def positions(spark, sf_dir, snap=None):
    df = src.holdings(spark, sf_dir).join((snapshot(spark, sf_dir) if snap is None else snap).select("symbol", "close", "volatility_pct", "above_ma", "slope", "divergence", "near_ma", "volume_ratio", "golden_cross", "death_cross", "price_change_pct"), "symbol")
    return df.withColumn("profit_pct", F.round((F.col("close") / F.col("cost") - 1) * 100, 9)).withColumn("regime", F.when(F.col("account") % 3 == 0, "bear").otherwise("bull"))


@query("f13_position_risk", snap_sql(" SELECT account, symbol, stop_loss, take_profit, CASE WHEN profit_pct <= -stop_loss OR (NOT above_ma AND slope < 0) THEN 'SELL' WHEN profit_pct >= take_profit OR (regime = 'bear' AND profit_pct < 0) THEN 'REDUCE' ELSE 'HOLD' END AS action FROM pr", HOLD.lstrip(", ")))
def f13(spark, sf_dir):
    """F12 and F13."""
    return signals.position_risk(positions(spark, sf_dir)).select("account", "symbol", *r6("stop_loss", "take_profit"), "action")


GATE = "array_to_string([x FOR x IN [CASE WHEN round(drawdown, 9) > 0.2 THEN 'portfolio_drawdown_limit' END, CASE WHEN round(day_loss, 9) > 0.02 THEN 'single_day_drawdown_limit' END, CASE WHEN round(exposure, 9) > 1 THEN 'manual_exposure_limit' END] IF x IS NOT NULL], ',')"


@query("f15_portfolio_stats", snap_sql(f" SELECT *, {GATE} AS flags, {GATE} = '' AS allowed FROM (SELECT account % 10 AS desk, least(round(count(*) * 0.25::DOUBLE, 9), 1.5) AS exposure, round(greatest(-min(profit_pct), 0) / 100, 6) AS drawdown, round(greatest(-min(profit_pct), 0) / 100, 6) AS day_loss FROM pr GROUP BY account % 10)", HOLD.lstrip(", ")))
def f15(spark, sf_dir):
    """F14, F15 of the positions as they are, by desk."""
    stats = signals.portfolio_stats(positions(spark, sf_dir).withColumn("desk", F.col("account") % 10), "desk")
    return signals.portfolio_gate(stats).select("desk", "exposure", *r6("drawdown", "day_loss"), F.array_join("flags", ",").alias("flags"), "allowed")


@query("f14_portfolio_gate", "WITH " + BARS + HOLD.split("pr AS (")[0].rstrip().rstrip(",") + f""", days AS (SELECT DISTINCT datetime::DATE AS day FROM bars),
 line AS (SELECT account, h.symbol, shares, cost, d.day, close FROM hold h JOIN days d ON d.day >= (SELECT max(day) FROM days) - holding_days LEFT JOIN bars b ON b.symbol = h.symbol AND b.datetime::DATE = d.day),
 priced AS (SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY account, symbol ORDER BY day), cost) AS price FROM line),
 steps AS (SELECT *, coalesce(lag(price) OVER (PARTITION BY account, symbol ORDER BY day), cost) AS before FROM priced),
 acc AS (SELECT account, day, sum(shares * price) AS value, sum(shares * before) AS before, sum(shares * price) / sum(shares * cost) AS r, least(count(*) * 0.25::DOUBLE, 1.5) AS exposure FROM steps GROUP BY account, day),
 st AS (SELECT account, day, value, exposure, 1 - r / greatest(max(r) OVER (PARTITION BY account ORDER BY day), 1) AS drawdown, greatest(1 - value / before, 0) AS day_loss FROM acc)
 SELECT account, day::VARCHAR AS day, round(value, 4) AS value, exposure, round(drawdown, 6) AS drawdown, round(day_loss, 6) AS day_loss, {GATE} AS flags, {GATE} = '' AS allowed FROM st""")
def f14(spark, sf_dir):
    """F14 for every account and trade day since its purchase."""
    days = signals.portfolio_gate(signals.account_days(src.holdings(spark, sf_dir), src.daily_bars(spark, sf_dir)))
    return days.select("account", F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"), "exposure", *r6("drawdown", "day_loss"), F.array_join("flags", ",").alias("flags"), "allowed")


@query("f18_position_sizing", snap_sql(" SELECT symbol, (floor(250000.0::DOUBLE / close / 100) * 100)::BIGINT AS base_shares, (floor(150000.0::DOUBLE / close / 100) * 100)::BIGINT AS mobile_shares FROM snap"))
def f18(spark, sf_dir):
    return signals.sized(snapshot(spark, sf_dir).withColumn("price", F.col("close"))).select("symbol", "base_shares", "mobile_shares")


@query("f19_valued_positions", snap_sql(" SELECT symbol, sum(shares)::BIGINT AS shares, round(sum(shares * cost) / sum(shares), 6) AS avg_cost, round(sum(shares) * max(close), 6) AS market_value, round(sum(shares) * max(close) / sum(shares * cost) - 1, 6) AS profit_rate FROM pr GROUP BY symbol", HOLD.lstrip(", ")))
def f19(spark, sf_dir):
    return signals.valued_positions(positions(spark, sf_dir).withColumn("price", F.col("close"))).select("symbol", "shares", *r6("avg_cost", "market_value", "profit_rate"))


TRADES = """, lastrow AS (SELECT symbol, max(rn) AS last_i FROM cross_ind GROUP BY symbol HAVING max(rn) >= 60),
sig AS (SELECT symbol, datetime AS d, rn AS i, CASE WHEN golden_cross AND zone = 'above' THEN 'macd_golden_cross_above' WHEN death_cross AND zone = 'near' THEN 'zero_axis_death_cross' END AS type, CASE WHEN golden_cross THEN 'buy' ELSE 'sell' END AS side FROM cross_ind JOIN lastrow USING (symbol) WHERE (golden_cross AND zone = 'above') OR (death_cross AND zone = 'near')
  UNION ALL SELECT p.symbol, c.datetime, c.rn, p.type, p.side FROM points p JOIN cross_ind c ON c.symbol = p.symbol AND c.datetime = p.confirmed_at JOIN lastrow l ON l.symbol = p.symbol),
en AS (SELECT s.symbol, s.type, s.d, s.i + 1 AS entry_i, (SELECT min(x.i) FROM sig x WHERE x.symbol = s.symbol AND x.side = 'sell' AND x.i > s.i) AS sell_i, last_i FROM sig s JOIN lastrow USING (symbol) WHERE s.side = 'buy' AND s.i < last_i),
ex AS (SELECT *, CASE WHEN sell_i > entry_i THEN sell_i + 1 END AS by_sell, least(coalesce(CASE WHEN sell_i > entry_i THEN sell_i + 1 END, entry_i + 40), entry_i + 40) AS want FROM en),
tr AS (SELECT ex.symbol, ex.type, CASE WHEN want > last_i THEN 'window_end' WHEN by_sell IS NOT NULL AND by_sell <= entry_i + 40 THEN 'chan_sell' ELSE 'timeout' END AS reason,
    (CASE WHEN want > last_i THEN o.close ELSE o.open END * (1 - 0.0003 - 0.001 - 0.0005) / (e.open * (1 + 0.0003 + 0.0005)) - 1) * 100 AS pnl_pct, date_diff('day', d, o.datetime) AS holding_days, d
  FROM ex JOIN cross_ind e ON e.symbol = ex.symbol AND e.rn = entry_i JOIN cross_ind o ON o.symbol = ex.symbol AND o.rn = least(want, last_i))"""
G = "WITH RECURSIVE " + ",".join([BARS, INDICATORS, MERGED, FRACTALS, STROKES, POINTS]) + TRADES


def trades_of(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    return backtest.win_trades(bars, backtest.collected_signals(ind.crosses(ind.with_macd(bars)), chan.chan_signals(bars)))


@query("g04_trades", G + " SELECT symbol, type, reason, round(pnl_pct, 6) AS pnl_pct, holding_days::INT AS holding_days FROM tr")
def g04(spark, sf_dir):
    """G01 to G04."""
    return trades_of(spark, sf_dir).select("symbol", "type", "reason", *r6("pnl_pct"), "holding_days")


@query("g05_win_rates", G + """ SELECT type, reason, count(*) AS n, round(count(*) FILTER (pnl_pct > 0) / count(*), 6) AS win_rate, round(avg(pnl_pct), 6) AS avg_pnl, round(quantile_disc(-pnl_pct, 0.5) * -1, 6) AS median_pnl, round(avg(holding_days), 6) AS avg_days
 FROM tr GROUP BY GROUPING SETS ((), (type), (reason))""")
def g05(spark, sf_dir):
    return backtest.win_rates(trades_of(spark, sf_dir)).select("type", "reason", "n", *r6("win_rate", "avg_pnl", "median_pnl", "avg_days"))


@query("g08_replay")
def g08(spark, sf_dir):
    """Trend following on every symbol."""
    return backtest.scan(src.daily_bars(spark, sf_dir), mas=(20,)).drop("param", "sample")


@query("g16_parameter_scan")
def g16(spark, sf_dir):
    return backtest.rank_parameters(backtest.scan(src.daily_bars(spark, sf_dir), mas=(10, 20), stops=(0.06, 0.08), split=0.7))


@query("g09_cost_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN -(p * s + p * s * 0.0003) ELSE p * s - p * s * 0.0003 - p * s * 0.001 END, 4) AS cash_flow FROM (SELECT *, 100.0::DOUBLE * CASE WHEN l_returnflag = 'R' THEN 1 + 0.0005 ELSE 1 - 0.0005 END AS p, floor(l_quantity * 37 / 100) * 100 AS s FROM lineitem)")
def g09(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"), F.lit(100.0).alias("close"), (F.col("l_quantity") * 37).alias("shares"))
    return backtest.fill_columns(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("cash_flow", 4).alias("cash_flow"))


@query("g11_nav_metrics", "WITH " + BARS + """, n AS (SELECT *, close / lag(close) OVER k - 1 AS step, 1 - close / max(close) OVER k AS dd FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY datetime)),
 a AS (SELECT symbol, arg_max(close, datetime) / arg_min(close, datetime) - 1 AS total_return, max(dd) AS max_drawdown, greatest(date_diff('day', min(datetime), max(datetime)), 1) AS days, (avg(step) - 0.03 / 365) / nullif(stddev_pop(step), 0) * sqrt(252) AS sharpe FROM n GROUP BY symbol)
 SELECT symbol, """ + rsql("total_return", "max_drawdown", "sharpe") + ", round(pow(1 + total_return, 365.0::DOUBLE / days) - 1, 6) AS annual_return FROM a")
def g11(spark, sf_dir):
    """G11, G17, G19 on each symbol's closes."""
    return backtest.nav_metrics(src.daily_bars(spark, sf_dir)).select("symbol", *r6("total_return", "max_drawdown", "sharpe", "annual_return"))


MONTHS = "WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_custkey % 50 AS symbol, sum(round(o_totalprice * 100)::BIGINT) AS score FROM orders GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, symbol) AS r FROM s) WHERE r <= 10)"


@query("g18_rebalance", MONTHS + " SELECT month::VARCHAR AS month, symbol, 'BUY' AS action FROM h WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.month + INTERVAL 1 MONTH = h.month AND p.symbol = h.symbol) UNION ALL SELECT (p.month + INTERVAL 1 MONTH)::DATE::VARCHAR, p.symbol, 'SELL' FROM h p WHERE EXISTS (SELECT 1 FROM s WHERE s.month = p.month + INTERVAL 1 MONTH) AND NOT EXISTS (SELECT 1 FROM h WHERE h.month = p.month + INTERVAL 1 MONTH AND h.symbol = p.symbol)")
def g18(spark, sf_dir):
    s = src.table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_custkey") % 50).alias("symbol")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("score"))
    return backtest.rebalance(s, 10).select(F.col("month").cast("string").alias("month"), "symbol", "action")


@query("g20_concentration", "WITH hold AS (SELECT o_custkey AS account, o_custkey % 10 AS account_group, count(*) * 100 AS shares, max(o_orderkey) % 6000 / 100.0::DOUBLE + 70 AS cost FROM orders GROUP BY o_custkey) SELECT account, round(shares * cost, 6) AS amount, round(shares * cost / sum(shares * cost) OVER (PARTITION BY account_group), 6) AS share FROM hold")
def g20(spark, sf_dir):
    return backtest.concentration(src.holdings(spark, sf_dir).withColumn("account_group", F.col("account") % 10)).select("account", *r6("amount", "share"))


EVENTS = "ev AS (SELECT 'u' || user_id AS symbol, '1d' AS timeframe, event_type AS signal_type, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, strftime(ts, '%Y-%m-%d') AS confirmed_at, event_id AS seq, ts::DATE::VARCHAR AS created_at, (event_id % 100)::INT AS score FROM events), ids AS (SELECT *, substr(sha256(symbol || '|' || timeframe || '|' || signal_type || '|' || side || '|' || confirmed_at), 1, 32) AS event_id FROM ev)"


def market_events(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return pool.with_event_id(e.select(F.concat(F.lit("u"), "user_id").alias("symbol"), F.lit("1d").alias("timeframe"), F.col("event_type").alias("signal_type"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), day.alias("confirmed_at"), F.col("event_id").alias("seq"), day.alias("created_at"), (F.col("event_id") % 100).cast("int").alias("score")))


@query("h01_event_id", f"WITH {EVENTS} SELECT seq, event_id FROM ids")
def h01(spark, sf_dir):
    return market_events(spark, sf_dir).select("seq", "event_id")


@query("h03_ranked_events", f"WITH {EVENTS} SELECT symbol, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, confirmed_at DESC, event_id, seq) AS r FROM ids) WHERE r = 1")
def h03(spark, sf_dir):
    return pool.ranked_events(market_events(spark, sf_dir).withColumn("weight", F.lit(8))).select("symbol", "event_id", "score")


@query("h04_event_log", f"WITH {EVENTS} SELECT event_id, channel, 'pending' AS status FROM (SELECT DISTINCT event_id FROM ids WHERE seq % 3 <> 0 AND event_id NOT IN (SELECT event_id FROM ids WHERE seq % 3 = 0)) CROSS JOIN (VALUES ('mail'), ('web')) c(channel)")
def h04(spark, sf_dir):
    e = market_events(spark, sf_dir)
    new = pool.append_events(e.filter("seq % 3 = 0"), e.filter("seq % 3 <> 0"))
    return pool.deliveries(new, ["mail", "web"]).select("event_id", "channel", "status")


OUTBOX = ", outbox AS (SELECT event_id, channel, created_at, CASE abs(seq) % 4 WHEN 0 THEN 'sent' ELSE 'pending' END AS status, (seq % 6)::INT AS attempts, seq FROM ids, (VALUES ('mail'), ('web')) c(channel))"


def outbox_of(spark, sf_dir):
    e = market_events(spark, sf_dir)
    return e.select("event_id", F.explode(F.array(F.lit("mail"), F.lit("web"))).alias("channel"), "created_at", F.when(F.col("seq") % 4 == 0, "sent").otherwise("pending").alias("status"), (F.col("seq") % 6).cast("int").alias("attempts"), "seq", F.to_timestamp("created_at").alias("next_attempt"))


@query("h06_pending", f"WITH {EVENTS}{OUTBOX} SELECT o.event_id, channel, created_at, attempts FROM outbox o WHERE status = 'pending' AND attempts < 5 AND created_at <= '2024-01-10' ORDER BY created_at, channel, o.event_id, attempts LIMIT 500")
def h06(spark, sf_dir):
    e = market_events(spark, sf_dir).dropDuplicates(["event_id"]).select("event_id", "symbol")
    due = outbox_of(spark, sf_dir)
    rows = due.filter((F.col("status") == "pending") & (F.col("attempts") < 5) & (F.col("next_attempt") <= F.lit("2024-01-10").cast("timestamp"))).join(e, "event_id")
    return rows.orderBy("created_at", "channel", "event_id", "attempts").limit(500).select("event_id", "channel", "created_at", "attempts")


@query("h07_failure_transition", f"WITH {EVENTS}{OUTBOX} SELECT seq, channel, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, least(3600.0::DOUBLE, pow(2.0::DOUBLE, least(attempts + 1, 10))) AS backoff FROM outbox")
def h07(spark, sf_dir):
    return pool.failed(outbox_of(spark, sf_dir)).select("seq", "channel", "attempts", "status", "backoff")


@query("h08_outbox_log", "SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), 'unnamed') AS name, substr(replace(props, chr(10), ' '), 1, 200) AS summary FROM events")
def h08(spark, sf_dir):
    j = lambda p: F.get_json_object("props", p)
    return src.table(spark, sf_dir, "events").select("event_id", F.coalesce(j("$.name"), j("$.k"), F.lit("unnamed")).alias("name"), F.substring(F.regexp_replace("props", "\n", " "), 1, 200).alias("summary"))


@query("h09_outbox_summary", f"WITH {EVENTS}{OUTBOX} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT event_id) AS events FROM outbox")
def h09(spark, sf_dir):
    return pool.outbox_summary(outbox_of(spark, sf_dir))


@query("h10_business_expiry", "SELECT DISTINCT d::VARCHAR AS day, list_extract(list_filter(generate_series(d + INTERVAL 1 DAY, d + INTERVAL 14 DAY, INTERVAL 1 DAY), lambda x: isodow(x) <= 5), 5)::DATE::VARCHAR AS expires FROM (SELECT o_orderdate::DATE AS d FROM orders)")
def h10(spark, sf_dir):
    days = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), business_expiry(F.col("d"), 5).cast("string").alias("expires"))


def candidates(spark, sf_dir, month: int):
    o = src.table(spark, sf_dir, "orders").filter(F.month("o_orderdate") == month)
    return o.groupBy((F.col("o_custkey") % 97).cast("string").alias("symbol")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("score"), F.max(F.to_date("o_orderdate")).alias("updated_at"))


CAND = "WITH a AS (SELECT (o_custkey % 97)::VARCHAR AS symbol, sum(round(o_totalprice)::BIGINT)::BIGINT AS score, max(o_orderdate)::DATE AS updated_at FROM orders WHERE month(o_orderdate) = 3 GROUP BY 1), b AS (SELECT (o_custkey % 97)::VARCHAR AS symbol, sum(round(o_totalprice)::BIGINT)::BIGINT AS score, max(o_orderdate)::DATE AS updated_at FROM orders WHERE month(o_orderdate) = 4 GROUP BY 1)"


@query("h11_candidate_upsert", CAND + " SELECT symbol, score, updated_at::VARCHAR AS updated_at FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE symbol NOT IN (SELECT symbol FROM b)) ORDER BY score DESC, updated_at DESC, symbol LIMIT 40")
def h11(spark, sf_dir):
    return pool.upsert(candidates(spark, sf_dir, 3), candidates(spark, sf_dir, 4), 40).select("symbol", "score", F.col("updated_at").cast("string").alias("updated_at"))


@query("h12_candidate_sync", CAND + ", p AS (SELECT * FROM b ORDER BY score DESC, updated_at DESC, symbol LIMIT 40) SELECT symbol, score, 'active' AS state FROM p UNION ALL SELECT symbol, score, 'no_longer_qualified' FROM a WHERE symbol NOT IN (SELECT symbol FROM p)")
def h12(spark, sf_dir):
    best, gone = pool.sync(candidates(spark, sf_dir, 3), candidates(spark, sf_dir, 4), 40)
    return best.select("symbol", "score", F.lit("active").alias("state")).unionByName(gone.select("symbol", "score", F.col("reason").alias("state")))


@query("h13_ttl_expiry", CAND + " SELECT symbol, CASE WHEN updated_at < DATE '2000-01-01' THEN 'expired' ELSE 'active' END AS state FROM a")
def h13(spark, sf_dir):
    active, old = pool.split_expired(candidates(spark, sf_dir, 3).withColumn("expires_on", F.col("updated_at")), "2000-01-01")
    return active.select("symbol", F.lit("active").alias("state")).unionByName(old.select("symbol", F.col("reason").alias("state")))


@query("h14_monitored", "SELECT symbol, min(p)::INT AS priority FROM (SELECT (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS symbol, 0 AS p FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT s_suppkey::VARCHAR, 1 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey::VARCHAR, 2 FROM supplier) GROUP BY symbol")
def h14(spark, sf_dir):
    s = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").cast("string").alias("symbol"))
    return pool.monitored(src.holdings(spark, sf_dir).filter("account % 4 = 0"), s.filter("s_suppkey % 3 = 0"), s)


@query("e17_three_leg_screen", snap_sql(" SELECT symbol FROM snap WHERE (ma_up OR turn_up OR heavy_flat) AND debt_ratio <= 50 AND receivables <= cash AND interest <= net_profit AND cash_flow >= 0.5 * net_profit AND roe > 10 AND pe > 0 AND pe < 30 AND avg_turnover > 1 AND avg_turnover < 5 ORDER BY symbol::INT LIMIT 4"))
def e17(spark, sf_dir):
    """The first four symbols in input order that pass all legs."""
    return screening.top(screening.screen(snapshot(spark, sf_dir), screening.three_legs()).select("symbol"), 4, F.col("symbol").cast("int"))


@query("e18_value_screen", snap_sql(" SELECT symbol, roe FROM snap WHERE roe > 10 AND pe <= 20 AND debt_ratio < 50 AND market_cap BETWEEN 50 AND 500 ORDER BY roe DESC, symbol LIMIT 3"))
def e18(spark, sf_dir):
    tests = {"roe": F.col("roe") > 10, "pe": F.col("pe") <= 20, "debt": F.col("debt_ratio") < 50, "cap": F.col("market_cap").between(50, 500)}
    return screening.top(screening.screen(snapshot(spark, sf_dir), tests).select("symbol", "roe"), 3, F.col("roe").desc(), F.col("symbol"))


@query("e18_trend_screen", snap_sql(" SELECT symbol, roe, round(close_vs_ma, 6) AS close_vs_ma FROM snap WHERE roe >= 10 AND pe <= 30 AND debt_ratio <= 50 AND avg_turnover BETWEEN 1 AND 20 AND close_vs_ma >= 0"))
def e18_trend(spark, sf_dir):
    """Return, price, debt and turnover of symbols that are not below their 250-bar average."""
    tests = {"roe": F.col("roe") >= 10, "pe": F.col("pe") <= 30, "debt": F.col("debt_ratio") <= 50, "turnover": F.col("avg_turnover").between(1, 20), "trend": F.col("close_vs_ma") >= 0}
    return screening.screen(snapshot(spark, sf_dir), tests).select("symbol", "roe", *r6("close_vs_ma"))


EXITS = """, ex AS (SELECT pr.account, pr.symbol, CASE WHEN pr.profit_pct <= -stop_loss OR (NOT pr.above_ma AND pr.slope < 0) THEN 'SELL' WHEN pr.profit_pct >= take_profit OR pr.regime = 'bear' AND pr.profit_pct < 0 OR divergence = 'bearish' OR pr.profit_pct > 20 OR volume_ratio > 1.8 AND death_cross OR NOT pr.above_ma AND pr.profit_pct > 0 THEN 'REDUCE' END AS action FROM pr JOIN snap USING (symbol))"""


@query("f16_exit_signals", snap_sql(" SELECT account, symbol, action, CASE action WHEN 'SELL' THEN 95 ELSE 80 END::INT AS score FROM ex WHERE action IS NOT NULL", HOLD.lstrip(", "), EXITS.lstrip(", ")))
def f16(spark, sf_dir):
    return signals.exit_signals(positions(spark, sf_dir)).select("account", "symbol", "action", "score")


def held(spark, sf_dir, snap=None):
    """Positions with their base and mobile shares (6 to 4), some of them in a range market."""
    base = F.floor(F.col("shares") * 6 / 10).cast("long")
    return positions(spark, sf_dir, snap).withColumn("regime", F.when(F.col("account") % 3 == 1, "range").otherwise(F.col("regime"))).withColumns({"base_shares": base, "mobile_shares": F.col("shares") - base})


@query("f17_t_trading", snap_sql(""" SELECT account, symbol, coalesce(CASE WHEN r = 'bull' AND up AND near_ma AND volume_ratio >= 1 THEN 'positive_t_buy' WHEN r = 'bull' AND down AND mobile > 0 THEN 'positive_t_sell'
  WHEN r = 'bear' AND down AND base > 0 THEN 'negative_t_sell' WHEN r = 'bear' AND up AND golden_cross THEN 'negative_t_buy' WHEN r = 'range' AND up AND price_change_pct <= 0 THEN 'range_t_buy' WHEN r = 'range' AND down AND mobile > 0 THEN 'range_t_sell' END, 'none') AS suggestion,
  CASE suggestion WHEN 'positive_t_buy' THEN 78 WHEN 'positive_t_sell' THEN 76 WHEN 'negative_t_sell' THEN 74 WHEN 'negative_t_buy' THEN 72 WHEN 'range_t_buy' THEN 70 WHEN 'range_t_sell' THEN 70 END::INT AS confidence,
  CASE WHEN suggestion LIKE '%buy' THEN 0.05 WHEN suggestion LIKE '%sell' THEN -0.05 END::DOUBLE AS t_change, CASE WHEN suggestion LIKE 'negative%' THEN floor(base * 0.3::DOUBLE)::BIGINT WHEN suggestion <> 'none' THEN mobile END AS t_amount
 FROM (SELECT account, pr.symbol, CASE account % 3 WHEN 0 THEN 'bear' WHEN 1 THEN 'range' ELSE 'bull' END AS r, divergence = 'bullish' AS up, divergence = 'bearish' AS down, near_ma, volume_ratio, golden_cross, price_change_pct,
  floor(shares * 6 / 10)::BIGINT AS base, shares - floor(shares * 6 / 10)::BIGINT AS mobile FROM pr JOIN snap USING (symbol))""", HOLD.lstrip(", ")))
def f17(spark, sf_dir):
    return signals.t_trading(held(spark, sf_dir)).select("account", "symbol", "suggestion", "confidence", "t_change", "t_amount")


MERGE = """tt AS (SELECT account, pr.symbol, CASE account % 3 WHEN 0 THEN 'bear' WHEN 1 THEN 'range' ELSE 'bull' END AS r, divergence = 'bullish' AS up, divergence = 'bearish' AS down, near_ma, volume_ratio, golden_cross, price_change_pct,
  floor(shares * 6 / 10)::BIGINT AS base, shares - floor(shares * 6 / 10)::BIGINT AS mobile FROM pr JOIN snap USING (symbol)),
ta AS (SELECT *, CASE WHEN r = 'bull' AND up AND near_ma AND volume_ratio >= 1 THEN 'positive_t_buy' WHEN r = 'bull' AND down AND mobile > 0 THEN 'positive_t_sell'
  WHEN r = 'bear' AND down AND base > 0 THEN 'negative_t_sell' WHEN r = 'bear' AND up AND golden_cross THEN 'negative_t_buy' WHEN r = 'range' AND up AND price_change_pct <= 0 THEN 'range_t_buy' WHEN r = 'range' AND down AND mobile > 0 THEN 'range_t_sell' END AS suggestion FROM tt),
rk AS (SELECT account, symbol, CASE WHEN profit_pct <= -stop_loss OR (NOT above_ma AND slope < 0) THEN 'SELL' WHEN profit_pct >= take_profit OR (CASE account % 3 WHEN 0 THEN true ELSE false END AND profit_pct < 0) THEN 'REDUCE' END AS action FROM pr),
resolved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE action WHEN 'SELL' THEN 4 WHEN 'REDUCE' THEN 3 WHEN 'ADD' THEN 2 ELSE 1 END DESC, score DESC, strategy) AS r FROM sg) WHERE r = 1),
merged AS (
  SELECT symbol, action, score::INT AS score, 'routed' AS origin FROM resolved
  UNION ALL SELECT symbol, action, CASE action WHEN 'SELL' THEN 95 ELSE 80 END, 'exit' FROM ex WHERE action IS NOT NULL
  UNION ALL SELECT symbol, suggestion, CASE suggestion WHEN 'positive_t_buy' THEN 78 WHEN 'positive_t_sell' THEN 76 WHEN 'negative_t_sell' THEN 74 WHEN 'negative_t_buy' THEN 72 ELSE 70 END, 't_trading' FROM ta WHERE suggestion IS NOT NULL
  UNION ALL SELECT symbol, action, CASE action WHEN 'SELL' THEN 90 ELSE 78 END, 'risk' FROM rk WHERE action IS NOT NULL)"""
MERGED_SIGNALS = [x.lstrip(", ") for x in (STRAT, HOLD, EXITS, MERGE)]


def merged_of(spark, sf_dir, snap):
    """Routed signals, one a symbol, with exits, T trades and risk alerts of the positions."""
    routed = signals.resolve_conflicts(signals.strategy_signals(pool_rows(spark, sf_dir, snap)))
    return signals.merged_signals(routed, held(spark, sf_dir, snap))


@query("f20_merged_signals", snap_sql(" SELECT symbol, action, score, origin FROM merged", *MERGED_SIGNALS))
def f20(spark, sf_dir):
    return merged_of(spark, sf_dir, snapshot(spark, sf_dir))


@query("e19_signal_summary", snap_sql(""" SELECT * FROM (SELECT 'signal' AS part, symbol, action AS what, score FROM merged WHERE score >= 85 ORDER BY score DESC, symbol, origin, action LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'candidate', symbol, fundamental_reason, (CASE WHEN fundamental_reason = 'pass' THEN 40 ELSE 0 END + CASE WHEN t THEN 25 ELSE 0 END + CASE WHEN v THEN 35 ELSE 0 END)::INT AS score FROM sel ORDER BY score DESC, symbol::INT LIMIT 5)""", *MERGED_SIGNALS))
def e19(spark, sf_dir):
    """The five best candidates, and the five best of all signals that reach 85."""
    snap = snapshot(spark, sf_dir)
    best = screening.top(screening.select_stocks(snap), 5, F.col("score").desc(), F.col("symbol").cast("int"))
    urgent = screening.top(merged_of(spark, sf_dir, snap).filter("score >= 85"), 5, F.col("score").desc(), F.col("symbol"), F.col("origin"), F.col("action"))
    return urgent.select(F.lit("signal").alias("part"), "symbol", F.col("action").alias("what"), "score").unionByName(best.select(F.lit("candidate").alias("part"), "symbol", F.col("fundamental_reason").alias("what"), "score"))


@query("f21_bar_predicates", "WITH RECURSIVE " + BARS + "," + INDICATORS + " SELECT symbol, datetime::DATE::VARCHAR AS day FROM (SELECT *, lag(dif0) OVER (PARTITION BY symbol ORDER BY rn) AS d1, lag(dea0) OVER (PARTITION BY symbol ORDER BY rn) AS e1, lag(volume) OVER (PARTITION BY symbol ORDER BY rn) AS v1 FROM cross_ind) WHERE dif0 > dea0 AND d1 <= e1 AND volume > coalesce(v1, 0)")
def f21(spark, sf_dir):
    df = signals.bar_predicates(ind.enriched(src.daily_bars(spark, sf_dir))).filter("entry_cross")
    return df.select("symbol", F.date_format("datetime", "yyyy-MM-dd").alias("day"))


@query("g10_trade_pairs", """WITH t AS MATERIALIZED (SELECT l_suppkey::VARCHAR AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq, l_returnflag = 'R' AS buy, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS flow FROM lineitem),
 c AS MATERIALIZED (SELECT *, sum(buy::INT) OVER w AS nb, sum((NOT buy)::INT) OVER w AS ns FROM t WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
 k AS MATERIALIZED (SELECT *, CASE WHEN buy THEN nb ELSE ns - greatest(max(ns - nb) OVER (PARTITION BY symbol ORDER BY seq), 0) END AS k FROM c),
 e AS MATERIALIZED (SELECT *, coalesce(lag(k) OVER (PARTITION BY symbol, buy ORDER BY seq), 0) AS before FROM k)
 SELECT symbol, k::BIGINT AS k, max(CASE WHEN buy THEN seq END) AS buy_seq, max(CASE WHEN NOT buy THEN seq END) AS sell_seq, sum(flow) AS pnl FROM e WHERE k > before GROUP BY symbol, k HAVING count(*) = 2""")
def g10(spark, sf_dir):
    return backtest.pair_trades(line_trades(spark, sf_dir)).select("symbol", F.col("k").cast("long").alias("k"), "buy_seq", "sell_seq", "pnl")


def line_trades(spark, sf_dir):
    """Line items as trades: returned ones buy, others sell."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    t = src.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), *order, F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("flow"))
    return t.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))


@query("g12_completed_trades", SQL["g10_trade_pairs"].split(" SELECT symbol, k::BIGINT AS k")[0] + """, p AS (SELECT symbol, k, max(CASE WHEN buy THEN seq END) AS seq, sum(flow) AS pnl FROM e WHERE k > before GROUP BY symbol, k HAVING count(*) = 2),
 b AS (SELECT symbol, count(*) AS entries, sum(-flow) AS spent FROM t WHERE buy GROUP BY symbol)
 SELECT symbol, entries, coalesce(n, 0) AS completed, entries - coalesce(n, 0) AS unmatched, round(coalesce(w, 0), 6)::DOUBLE AS completed_win_rate FROM b LEFT JOIN (SELECT symbol, count(*) AS n, avg((pnl > 0)::INT) AS w FROM p GROUP BY symbol) USING (symbol)""")
def g12(spark, sf_dir):
    """By symbol: entries, those completed by G10's pairs, those that stay unmatched, and the win rate of the completed."""
    t = line_trades(spark, sf_dir)
    entries = t.filter("side = 'BUY'").groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"))
    done = backtest.pair_trades(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("completed"), F.avg((F.col("pnl") > 0).cast("int")).alias("w"))
    open_ = backtest.unmatched_entries(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("unmatched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entries.join(done, "symbol", "left").join(open_, "symbol", "left").select("symbol", "entries", zero("completed"), zero("unmatched"), F.round(F.coalesce("w", F.lit(0.0)), 6).alias("completed_win_rate"))


@query("g13_regime_breakdown", G + ", " + REGIME.split("WITH RECURSIVE " + BARS + ",")[1] + """, rg AS (SELECT datetime::DATE AS day, regime FROM regime),
 tg AS (SELECT coalesce(regime, 'unknown') AS regime, count(*) AS trade_count, round(avg((pnl_pct > 0)::INT), 6) AS win_rate, round(coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0) / nullif(abs(avg(pnl_pct) FILTER (pnl_pct < 0)), 0), 6) AS profit_loss_ratio, round(avg(holding_days), 6) AS avg_holding_days, round(sum(pnl_pct), 4) AS total_pnl FROM tr ASOF LEFT JOIN rg ON tr.d::DATE >= rg.day GROUP BY 1),
 sg AS (SELECT coalesce(regime, 'unknown') AS regime, count(*) AS signal_count FROM sig ASOF LEFT JOIN rg ON sig.d::DATE >= rg.day GROUP BY 1)
 SELECT coalesce(tg.regime, sg.regime) AS regime, coalesce(trade_count, 0) AS trade_count, coalesce(signal_count, 0) AS signal_count, coalesce(win_rate, 0) AS win_rate, coalesce(profit_loss_ratio, 0) AS profit_loss_ratio, coalesce(avg_holding_days, 0) AS avg_holding_days, coalesce(total_pnl, 0) AS total_pnl FROM tg FULL JOIN sg ON tg.regime = sg.regime""")
def g13(spark, sf_dir):
    """Trades and signals by the regime of the index on the day of the signal."""
    bars = src.daily_bars(spark, sf_dir)
    found = backtest.collected_signals(ind.crosses(ind.with_macd(bars)), chan.chan_signals(bars))
    dated = signals.regimes(src.index_bars(spark, sf_dir)).select("datetime", "regime")
    out = backtest.breakdown(backtest.regime_on(backtest.win_trades(bars, found), dated), backtest.regime_on(found, dated))
    return out.select("regime", "trade_count", "signal_count", *r6("win_rate", "profit_loss_ratio", "avg_holding_days"), F.round("total_pnl", 4).alias("total_pnl"))


@query("g15_strategy_comparison")
def g15(spark, sf_dir):
    return backtest.best_of(backtest.scan(src.daily_bars(spark, sf_dir), mas=(10, 20, 60)), "symbol")


@query("h02_event_generation", points_sql(""", se AS (SELECT symbol, datetime, side, CASE side WHEN 'buy' THEN buy_score ELSE sell_score END AS score, CASE WHEN side = 'buy' AND golden_cross THEN 'macd_golden_cross_' || zone WHEN side = 'sell' AND death_cross AND zone = 'near' THEN 'zero_axis_death_cross' END AS crossing FROM sc, (VALUES ('buy'), ('sell')) s(side))
 SELECT e.symbol, e.datetime::DATE::VARCHAR AS day, e.side, coalesce(p.type, crossing) AS signal_type, CASE WHEN p.type IS NULL OR crossing IS NULL THEN coalesce(p.type, crossing) ELSE p.type || ',' || crossing END AS components, CASE WHEN score >= 60 THEN 'strong' ELSE 'structure' END AS level, score
 FROM se e LEFT JOIN points p ON p.symbol = e.symbol AND p.confirmed_at = e.datetime AND p.side = e.side WHERE (crossing IS NOT NULL AND score >= 60) OR p.type IS NOT NULL""", SCORED))
def h02(spark, sf_dir):
    """One event per fresh point, else one for a cross whose score reaches 60."""
    events = pool.timeframe_events(scored(chan.crossings(src.daily_bars(spark, sf_dir))))
    return events.select("symbol", F.date_format("confirmed_at", "yyyy-MM-dd").alias("day"), "side", "signal_type", F.array_join("components", ",").alias("components"), "level", "score")


@query("h05_currency_gate", f"WITH {EVENTS} SELECT seq FROM ids WHERE confirmed_at >= '2024-01-15' AND score >= 50")
def h05(spark, sf_dir):
    return pool.current(market_events(spark, sf_dir), "2024-01-15", 50).select("seq")


MOMENTUM = """, mo AS (SELECT symbol, (CASE WHEN rsi > 20 AND rsi < 30 THEN 3 WHEN rsi > 30 AND rsi < 40 THEN 2 WHEN rsi <= 20 THEN 1 ELSE 0 END
 + CASE WHEN hist0 > h1 AND h1 > h2 AND hist0 < 0 THEN 2 WHEN hist0 > 0 AND h1 < 0 THEN 3 ELSE 0 END + CASE WHEN close < ma20 - 2 * boll_sd THEN 2 WHEN close < ma20 THEN 1 ELSE 0 END
 + CASE WHEN round(m2 - k2, 9) > 0 AND round(m1 - close1, 9) > 0 AND close > close1 AND close < ma20 * 1.03 THEN 2 ELSE 0 END + CASE WHEN round(ma20 - ma60, 9) > 0 AND round(l1 - m1, 9) > 0 THEN 2 ELSE 0 END)::INT AS momentum
 FROM (SELECT *, lag(hist0) OVER k AS h1, lag(hist0, 2) OVER k AS h2, lag(ma20) OVER k AS m1, lag(ma20, 2) OVER k AS m2, lag(ma60) OVER k AS l1, lag(close, 2) OVER k AS k2 FROM cross_ind WINDOW k AS (PARTITION BY symbol ORDER BY rn)) WHERE back = 1)"""


@query("e13_momentum_score", "WITH RECURSIVE " + BARS + "," + INDICATORS + MOMENTUM + " SELECT symbol, momentum FROM mo")
def e13(spark, sf_dir):
    df = ind.enriched(src.daily_bars(spark, sf_dir)).withColumns({"hist0_before": ind.lag("hist0"), "hist0_before2": ind.lag("hist0", 2)})
    last = ind.latest(screening.momentum_arms(df))
    return last.select("symbol", (screening.momentum_score(last) + F.col("arms")).cast("int").alias("momentum"))


@query("e14_composite_rank", "WITH RECURSIVE " + BARS + "," + INDICATORS + ", " + FUND_CTES + OWN_PB + MOMENTUM + VOLUME_PATTERN + f""" SELECT symbol, round(0.35 * {QUALITY} + 0.25 * {VALUE} + 0.2 * coalesce(momentum, 0) + 0.2 * coalesce(vol_score, 0), 6)::DOUBLE AS composite
 FROM own JOIN m USING (industry) LEFT JOIN mo USING (symbol) LEFT JOIN vp USING (symbol) ORDER BY composite DESC, symbol LIMIT 20""")
def e14(spark, sf_dir):
    """Quality, valuation, momentum and volume pattern of each symbol by weight, the best 20."""
    return screening.top(screening.composite(all_scores(spark, sf_dir)).select("symbol", "composite"), 20, F.col("composite").desc(), F.col("symbol"))


SCORES = [FUND_CTES, OWN_PB.lstrip(", "), MOMENTUM.lstrip(", "), VOLUME_PATTERN.lstrip(", ")]


def all_scores(spark, sf_dir):
    """Quality, valuation, momentum and volume pattern of each symbol."""
    scores = screening.quality_score(valued(spark, sf_dir), LENDERS).select("symbol", "quality", "valuation")
    return scores.join(e13(spark, sf_dir), "symbol", "left").join(d19(spark, sf_dir).select("symbol", F.col("score").alias("vol_score")), "symbol", "left")


@query("e15_buy_gate", "WITH RECURSIVE " + ",".join([BARS, INDICATORS, *SCORES]) + f""" SELECT symbol, coalesce(q > 7 AND v > 5 AND m > 5 AND w > 2, false) AS buy, round(least(0.05::DOUBLE * CASE WHEN q + v + coalesce(m, 0) + coalesce(w, 0) > 15 THEN 1.5 WHEN q + v + coalesce(m, 0) + coalesce(w, 0) > 12 THEN 1.2 ELSE 1 END, 0.1::DOUBLE), 6) AS ratio
 FROM (SELECT symbol, {QUALITY} AS q, {VALUE} AS v, momentum AS m, vol_score AS w FROM own JOIN m USING (industry) LEFT JOIN mo USING (symbol) LEFT JOIN vp USING (symbol))""")
def e15(spark, sf_dir):
    """Whether a symbol's four scores pass the gate to buy, and the share of the capital that their sum gives."""
    return screening.buy_gate(all_scores(spark, sf_dir)).select("symbol", "buy", F.round("ratio", 6).alias("ratio"))


@query("e16_sell_gate", snap_sql(""" SELECT account, symbol, CASE WHEN vol_score < -2 THEN 'volume' WHEN holding_days > 60 AND profit_pct < 5 THEN 'stale' WHEN profit_pct > 30 THEN 'profit' WHEN profit_pct < -12 THEN 'loss' WHEN roe_before > 0 AND (roe - roe_before) / roe_before < -0.3 THEN 'roe' ELSE 'hold' END AS reason
 FROM pr JOIN (SELECT symbol, roe, symbol::INT * 9 % 25 + 1.5::DOUBLE AS roe_before FROM fund) USING (symbol) LEFT JOIN vp USING (symbol)""", HOLD.lstrip(", "), VOLUME_PATTERN.lstrip(", ")))
def e16(spark, sf_dir):
    """With the volume pattern, and the return on equity of the year before (fixed arithmetic, as in fundamentals)."""
    roe = src.fundamentals(spark, sf_dir).select("symbol", "roe", (F.pmod(F.col("symbol").cast("long") * 9, F.lit(25)) + 1.5).alias("roe_before"))
    vol = d19(spark, sf_dir).select("symbol", F.col("score").alias("vol_score"))
    return screening.sell_gate(positions(spark, sf_dir).join(roe, "symbol", "left").join(vol, "symbol", "left")).select("account", "symbol", "reason")


@query("f11_trend_entries", snap_sql(" SELECT symbol, regime, 'trend' AS strategy, act AS action, tsc::INT AS score FROM fl WHERE tf AND regime <> 'bear' AND (held OR s_i % 5 <> 0) ORDER BY score DESC, symbol LIMIT 10", STRAT.lstrip(", ")))
def f11(spark, sf_dir):
    """The ten best; the portfolios behind every fifth symbol take no new positions."""
    rows = pool_rows(spark, sf_dir).withColumn("allowed", F.col("symbol").cast("int") % 5 != 0)
    return signals.trend_entries(rows).select("symbol", "regime", "strategy", "action", "score")


RECORDS = G + """, re AS (SELECT tr.symbol AS ts_code, tr.d::DATE::VARCHAR AS entry_time, type, reason, pnl_pct, holding_days FROM tr)
 SELECT 'run' AS run_id, ts_code, entry_time, NULL::VARCHAR AS exit_time, 'LONG' AS side, 0.0::DOUBLE AS entry_price, 0.0::DOUBLE AS exit_price, 100::BIGINT AS shares, holding_days::INT AS holding_days, 0.0::DOUBLE AS pnl, round(pnl_pct / 100, 6) AS pnl_ratio, 'unknown' AS regime, 'unknown' AS strategy_name, type AS entry_reason, reason AS exit_reason FROM re"""


@query("g14_trade_records", RECORDS)
def g14(spark, sf_dir):
    """Closed trades as records, written as CSV and JSON lines and read again; what the two agree on."""
    t = trades_of(spark, sf_dir).select(F.col("symbol").alias("ts_code"), F.col("day").cast("string").alias("entry_time"), F.lit(100).alias("shares"), "holding_days", F.round(F.col("pnl_pct") / 100, 6).alias("pnl_ratio"), F.col("type").alias("entry_reason"), F.col("reason").alias("exit_reason"))
    path = src.run_folder(spark, "trades")
    src.write_report(src.trade_records(t, "run"), f"{path}/csv", "csv")
    whole = src.read_table(spark, f"{path}/csv", src.TRADES, "csv").filter("_corrupt is null").drop("_corrupt")
    src.write_report(whole, f"{path}/json", "json")
    return src.read_table(spark, f"{path}/json", src.TRADES, "json").filter("_corrupt is null").drop("_corrupt")


EVENT_LOG = "event_id string, symbol string, signal_type string, confirmed_at string, score int"


def event_stream(spark, sf_dir):
    """The events table as a bounded stream. (A pattern, as a stream's plain path has to be a folder, and the table may be a file.)"""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def logged_stream(spark, sf_dir):
    """The stream of market events with their ids."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = event_stream(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("symbol"), F.lit("1d").alias("timeframe"), F.col("event_type").alias("signal_type"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), day.alias("confirmed_at"), (F.col("event_id") % 100).cast("int").alias("score"))
    return pool.with_event_id(rows)


@query("i05_upserted_log", f"WITH {EVENTS} SELECT event_id, symbol, signal_type, confirmed_at, min(score) AS score FROM ids GROUP BY ALL")
def i05(spark, sf_dir):
    """Events taken into a stored log by a bounded stream, each id once; then the same stream again, which adds nothing."""
    folder = src.run_folder(spark, "log")
    log = VersionedTable(spark, f"{folder}/log", EVENT_LOG, F.substring("confirmed_at", 1, 7))
    for checkpoint in ("first", "again"):
        upsert_stream(logged_stream(spark, sf_dir), log, unseen(["event_id"]), f"{folder}/{checkpoint}", checkpoint)
    return log.read()


@query("i04_stale_events", f"WITH {EVENTS}, d AS (SELECT DISTINCT event_id, confirmed_at FROM ids) SELECT confirmed_at AS day, CASE WHEN confirmed_at < '2024-01-15' THEN 'stale' ELSE 'current' END AS state, count(*) AS n FROM d GROUP BY confirmed_at")
def i04(spark, sf_dir):
    """A bounded stream whose events from before the expected trade date go to a side table; both counted by day."""
    folder = src.run_folder(spark, "stale")
    late = F.col("confirmed_at") < "2024-01-15"
    tables = {name: VersionedTable(spark, f"{folder}/{name}", EVENT_LOG, F.substring("confirmed_at", 1, 7)) for name in ("current", "stale")}
    route_stream(logged_stream(spark, sf_dir), [(tables["current"], ~late, unseen(["event_id"])), (tables["stale"], late, unseen(["event_id"]))], f"{folder}/checkpoint")
    counted = [t.read().groupBy(F.col("confirmed_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit(name)) for name, t in tables.items()]
    return counted[0].unionByName(counted[1]).select("day", "state", "n")


@query("i01_session_stream", """WITH t AS (SELECT event_type AS symbol, ts, coalesce(value, 0) AS price, CASE WHEN ts::TIME > TIME '09:30:00' AND ts::TIME <= TIME '11:30:00' THEN ts::DATE + INTERVAL 570 MINUTE WHEN ts::TIME > TIME '13:00:00' AND ts::TIME <= TIME '15:00:00' THEN ts::DATE + INTERVAL 780 MINUTE END AS start FROM events),
 b AS (SELECT *, ceil(epoch_us(ts - start) / 3600000000)::BIGINT AS bucket, ceil(epoch_us(ts - start) / 1800000000)::BIGINT AS half FROM t WHERE start IS NOT NULL),
 e AS (SELECT *, start + bucket * INTERVAL 60 MINUTE AS fin FROM b)
 SELECT symbol, strftime(fin, '%Y-%m-%d %H:%M') AS at, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS volume FROM e WHERE fin <= (SELECT max(fin) FROM e) - INTERVAL 10 MINUTE GROUP BY symbol, fin HAVING count(DISTINCT half) = 2""")
def i01(spark, sf_dir):
    """Session bars of a bounded stream, those whose end the watermark has passed and whose halves both have ticks."""
    folder = src.run_folder(spark, "sessions")
    ticks = event_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("price"), F.lit(1).cast("long").alias("qty"))
    stream.run_once(stream.stream_sessions(ticks), f"{folder}/bars", f"{folder}/checkpoint")
    out = spark.read.schema("symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume long").parquet(f"{folder}/bars")
    return out.select("symbol", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("at"), "open", "high", "low", "close", "volume")
