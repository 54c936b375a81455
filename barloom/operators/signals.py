"""Market regimes, strategy signals, routing, risk and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import by_time, lag, sma, with_macd


def cuts(x: Column, high: float, low: float, weight: float) -> tuple[Column, Column]:
    """Weights for a value at or above its high cut, and at or below its low one."""
    return F.when(x >= high, weight).otherwise(0.0), F.when(x <= low, weight).otherwise(0.0)


def regimes(index_bars: DataFrame, override: str | None = None) -> DataFrame:
    """F01-F03 for every date: metrics, scores of bull, bear and range, what speaks for each side, and the decision
    (``auto_regime``), which an override by hand replaces in ``regime``."""
    if override not in (None, "bull", "bear", "range"):
        raise ValueError(f"no such regime: {override}")
    bars = index_bars.withColumns({c: F.col("close") for c in ("open", "high", "low") if c not in index_bars.columns})
    df = with_macd(bars).withColumn("ma20", sma("close", 20)).withColumn("ma250", sma("close", 250))
    df = df.withColumn("before", F.lag("ma250", 19).over(by_time())).filter("ma250 is not null")
    df = df.withColumns({"price_gap": F.col("close") / F.col("ma250") - 1, "ma_gap": F.col("ma20") / F.col("ma250") - 1, "slope": F.coalesce(F.col("ma250") / F.col("before") - 1, F.lit(0.0))})
    parts = [cuts(F.col("price_gap"), 0.02, -0.02, 0.35), cuts(F.col("ma_gap"), 0.01, -0.01, 0.25), cuts(F.col("slope"), 0.01, -0.01, 0.20)]
    parts.append((F.when(F.col("hist0") > 0, 0.10).otherwise(0.0), F.when(F.col("hist0") < 0, 0.10).otherwise(0.0)))
    # what neither side claims is flat; what lies in a closer band counts once more
    flat = [("price_gap", 0.02, 0.10, 0.03, 0.20), ("ma_gap", 0.01, 0.15, 0.015, 0.15), ("slope", 0.01, 0.20, 0.008, 0.10)]
    bull = F.round(sum((p[0] for p in parts), F.lit(0.0)), 4)
    bear = F.round(sum((p[1] for p in parts), F.lit(0.0)), 4)
    calm = F.round(sum((F.when(F.abs(c) < cut, w).otherwise(0.0) + F.when(F.abs(c) <= band, more).otherwise(0.0) for c, cut, w, band, more in flat), F.lit(0.0)), 4)
    df = df.withColumns({"bull": bull, "bear": bear, "calm": calm})
    names = ["price", "average", "slope", "macd"]
    reasons = lambda side: F.array_compact(F.array(*[F.when(p[side] > 0, n) for p, n in zip(parts, names, strict=True)]))
    df = df.withColumns({"bull_reasons": reasons(0), "bear_reasons": reasons(1), "auto_regime": decide(F.col("bull"), F.col("bear"), F.col("calm"))})
    return df.withColumn("regime", F.lit(override) if override else F.col("auto_regime"))


def decide(bull: Column, bear: Column, calm: Column) -> Column:
    """Bull or bear if strictly ahead of both others; else range. (A side's own threshold changes nothing: to lead is enough.)"""
    return F.when(bull > F.greatest(bear, calm), "bull").when(bear > F.greatest(bull, calm), "bear").otherwise("range")


def simple_regime(df: DataFrame) -> DataFrame:
    """target exposure by the close against its long average, within a band of 5 %."""
    gap = F.col("close") / F.col("ma250") - 1
    return df.withColumn("target_exposure", F.when(gap > 0.05, 0.7).when(gap < -0.05, 0.3).otherwise(0.5))


def strategy_signals(df: DataFrame, only_trend: bool = False, only_reduce: bool = False) -> DataFrame:
    """What each strategy says of a pool row, routed by its regime; one row per signal. Or F05 alone, not routed.

    Trend entries of symbols not held wait for the portfolio (``allowed``, if the rows have it); ``only_reduce`` stops those
    that add to a position.
    """
    f, b = F.col, lambda c: F.coalesce(F.col(c), F.lit(False))
    add = lambda *xs: sum((F.when(c, p).otherwise(0) for c, p in xs), f("selection_score"))
    bullish = f("divergence") == "bullish"
    trend_score = add((f("slope") > 0, 15), (b("near_ma") & b("above_ma"), 12), (bullish, 18), (b("bear_trap"), 15), (b("golden_cross"), 10), (f("volume_ratio") > 1.5, 8), ((f("price_change_pct") < 0) & (f("volume_ratio") <= 1.2), 6))
    limit = F.when(f("regime") == "bull", 75).otherwise(85)
    act = F.when(b("held"), "ADD").otherwise("BUY")
    none = F.lit(None).cast("struct<strategy:string,action:string,score:int>")
    make = lambda name, action, score, ok: F.when(ok, F.struct(F.lit(name).alias("strategy"), action.alias("action"), score.cast("int").alias("score"))).otherwise(none)
    free = F.coalesce("allowed", F.lit(True)) if "allowed" in df.columns else F.lit(True)
    open_ = F.when(b("held"), F.lit(not only_reduce)).otherwise(free)
    trend = make("trend", act, trend_score, (trend_score >= limit) & (f("regime") != "bear") & open_)
    back_score = add((bullish, 16), (b("near_ma"), 12), (f("price_change_pct") <= 0, 8), (f("volume_ratio") >= 1, 5))
    reversion = make("reversion", act, back_score, (back_score >= 70) & bullish)
    break_score = add((b("breakout"), 18), (f("volume_ratio") >= 1.6, 12), (f("slope") > 0, 8))
    fires = (break_score >= 78) & b("breakout") & (f("volume_ratio") >= 1.6)
    breakout = make("breakout", act, break_score - F.when(f("regime") == "range", 5).otherwise(0), fires)
    weak = (f("divergence") == "bearish") | ~b("above_ma")
    guard = sum((F.when(c, p).otherwise(0) for c, p in ((b("bear_trap"), 15), (bullish, 10), (f("slope") < 0, 5), (f("volume_ratio") > 1.5, 5))), F.lit(50))
    defensive = F.when(b("held"), make("defensive", F.lit("REDUCE"), F.greatest(guard, F.lit(78)), weak)).otherwise(make("defensive", F.lit("BUY"), guard, b("bear_trap") & (guard >= 72)))
    routed = F.when(f("regime") == "range", F.array(trend, reversion, breakout)).when(f("regime") == "bear", F.array(defensive)).otherwise(F.array(F.when(fires, breakout).otherwise(trend)))
    routed = F.array(trend) if only_trend else routed
    return df.withColumn("s", F.explode(F.array_compact(routed))).select("symbol", "regime", "s.*")


def trend_entries(df: DataFrame, limit: int = 10) -> DataFrame:
    """the best trend entries (F05) by score."""
    return strategy_signals(df, only_trend=True).orderBy(F.col("score").desc(), "symbol").limit(limit)


def resolve_conflicts(signals: DataFrame) -> DataFrame:
    """one signal per symbol: SELL, REDUCE, ADD, BUY, then the score, then the strategy's name."""
    rank = F.when(F.col("action") == "SELL", 4).when(F.col("action") == "REDUCE", 3).when(F.col("action") == "ADD", 2).otherwise(1)
    by = Window.partitionBy("symbol").orderBy(rank.desc(), F.col("score").desc(), "strategy")
    return signals.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def stop_thresholds(df: DataFrame) -> DataFrame:
    """stop loss and take profit, wider for long held and for volatile positions."""
    long_held, wild = F.col("holding_days") >= 40, F.col("volatility_pct") >= 35
    stop = F.lit(8.0) * F.when(long_held, 1.25).otherwise(1.0) * F.when(wild, 1.20).otherwise(1.0)
    profit = F.lit(30.0) * F.when(long_held, 1.10).otherwise(1.0) * F.when(wild, 1.10).otherwise(1.0)
    return df.withColumn("stop_loss", stop).withColumn("take_profit", profit)


def position_risk(df: DataFrame) -> DataFrame:
    """flags of each position and what they ask for."""
    df = stop_thresholds(df)
    flags = F.array_compact(F.array(
        F.when(F.col("profit_pct") <= -F.col("stop_loss"), "stop_loss"), F.when(F.col("profit_pct") >= F.col("take_profit"), "take_profit"),
        F.when(~F.col("above_ma") & (F.col("slope") < 0), "trend_breakdown"), F.when((F.col("regime") == "bear") & (F.col("profit_pct") < 0), "bear_market_pressure"),
    ))
    df = df.withColumn("risk_flags", flags)
    sell = F.array_contains("risk_flags", "stop_loss") | F.array_contains("risk_flags", "trend_breakdown")
    action = F.when(sell, "SELL").when(F.size("risk_flags") > 0, "REDUCE").otherwise("HOLD")
    return df.withColumn("action", action).withColumn("position_change", F.when(action == "SELL", -1.0).when(action == "REDUCE", -0.25).otherwise(0.0))


def portfolio_stats(positions: DataFrame, *by: str, base: float = 0.25) -> DataFrame:
    """exposure (``base`` for a position that states none, 1.5 at most in sum) and the deepest loss, which also stands for
    the loss of the day; of all positions, or by columns."""
    loss = F.greatest(F.coalesce(-F.min("profit_pct"), F.lit(0.0)), F.lit(0.0)) / 100
    stated = F.coalesce("exposure", F.lit(base)) if "exposure" in positions.columns else F.lit(base)
    out = positions.groupBy(*by).agg(F.least(F.round(F.coalesce(F.sum(stated), F.lit(0.0)), 9), F.lit(1.5)).alias("exposure"), loss.alias("drawdown"))
    return out.withColumn("day_loss", F.col("drawdown"))


def account_days(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """F15 by account and trade day: value, exposure (positions at 25 %), drawdown from the account's peak, and the loss of the day.

    Holdings (account, symbol, shares, cost, holding_days before the last trade day) are spread over the calendar by an
    equi-join on days, priced by the last close until then (the cost before the first); values sum by account and day.
    """
    days = bars.select(F.to_date("datetime").alias("day")).distinct()
    own = holdings.withColumn("_last", days.agg(F.max("day")).scalar()).select("account", "symbol", "shares", "cost", F.explode(F.sequence(F.date_sub("_last", F.col("holding_days")), F.col("_last"))).alias("day"))
    prices = bars.select("symbol", F.to_date("datetime").alias("day"), "close")
    line = own.join(days, "day", "left_semi").join(prices, ["symbol", "day"], "left")
    by = Window.partitionBy("account", "symbol").orderBy("day")
    line = line.withColumn("price", F.coalesce(F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col("cost")))
    line = line.withColumn("before", F.coalesce(F.lag("price").over(by), F.col("cost")))
    of = lambda c: F.sum(F.col("shares") * F.col(c))
    out = line.groupBy("account", "day").agg(of("price").alias("value"), of("before").alias("before"), of("cost").alias("paid"), F.least(F.count(F.lit(1)) * 0.25, F.lit(1.5)).alias("exposure"))
    upto = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.col("value") / F.nullif("paid", F.lit(0.0))
    out = out.withColumn("_r", ratio).withColumn("drawdown", F.coalesce(1 - F.col("_r") / F.greatest(F.max("_r").over(upto), F.lit(1.0)), F.lit(0.0)))
    return out.withColumn("day_loss", F.greatest(F.coalesce(1 - F.col("value") / F.nullif("before", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).drop("_r", "before", "paid")


def portfolio_gate(stats: DataFrame, max_drawdown: float = 0.20, max_day_loss: float = 0.02, cap: float = 1.0, disable_new: bool = False, only_reduce: bool = False, despite_drawdown: bool = False) -> DataFrame:
    """the flags of portfolio statistics, and whether new positions are allowed. Two switches are set by hand;
    ``despite_drawdown`` lets losses flag but not block."""
    b = lambda c: F.round(c, 9)
    flags = [
        (F.lit(disable_new), "manual_disable_new_positions", True), (b("drawdown") > max_drawdown, "portfolio_drawdown_limit", not despite_drawdown), (b("day_loss") > max_day_loss, "single_day_drawdown_limit", not despite_drawdown),
        (b("exposure") > cap, "manual_exposure_limit", True), (F.lit(only_reduce), "only_reduce_positions", True),
    ]
    blocked = F.lit(False)
    for ok, _, blocks in flags:
        blocked = (blocked | ok) if blocks else blocked
    return stats.withColumns({"flags": F.array_compact(F.array(*[F.when(ok, name) for ok, name, _ in flags])), "allowed": ~blocked})


def valued_positions(df: DataFrame) -> DataFrame:
    """market value and profit of lots by symbol."""
    out = df.groupBy("symbol").agg(F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("cost")).alias("total_cost"), F.max("price").alias("price"))
    return out.withColumn("avg_cost", F.col("total_cost") / F.col("shares")).withColumn("market_value", F.col("shares") * F.col("price")).withColumn("profit_rate", F.col("market_value") / F.col("total_cost") - 1)


def valued_tranches(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """positions of (account, symbol) from lots (tranche base or mobile, shares, price), valued at ``current_price`` of the symbol.

    A tranche costs the mean price of its lots by shares, and 0 without shares, as do rates without cost. Positions without a price are left out.
    """
    mine = lambda c, kind: F.coalesce(F.sum(F.when(F.col("tranche") == kind, c)), F.lit(0))
    paid = F.col("shares") * F.col("price")
    sums = lots.groupBy("account", "symbol").agg(*[mine(c, k).alias(f"{k}_{n}") for k in ("base", "mobile") for c, n in ((F.col("shares"), "shares"), (paid, "paid"))])
    cost = lambda k: F.coalesce(F.col(f"{k}_paid") / F.nullif(F.col(f"{k}_shares"), F.lit(0)), F.lit(0.0))
    out = sums.join(prices.select("symbol", "current_price"), "symbol").withColumns({"base_cost": cost("base"), "mobile_cost": cost("mobile"), "shares": F.col("base_shares") + F.col("mobile_shares"), "total_cost": F.col("base_paid") + F.col("mobile_paid")})
    out = out.withColumns({"market_value": F.col("shares") * F.col("current_price"), "average_cost": F.coalesce(F.col("total_cost") / F.nullif(F.col("shares"), F.lit(0)), F.lit(0.0))})
    out = out.withColumn("profit_loss", F.col("market_value") - F.col("total_cost"))
    return out.withColumn("profit_rate", F.coalesce(F.col("profit_loss") / F.nullif(F.col("total_cost"), F.lit(0.0)), F.lit(0.0))).drop("base_paid", "mobile_paid")


def sized(df: DataFrame, cash: float = 1_000_000, lot: int = 100) -> DataFrame:
    """base and mobile shares in whole lots: 25 % and 15 % of the capital."""
    base, mobile = min(0.25, (1 - 0.25) / 3, 0.40), min(0.25, 0.40 - 0.25)
    lots = lambda part: F.floor(F.lit(cash * part) / F.col("price") / lot) * lot
    return df.withColumn("base_shares", lots(base)).withColumn("mobile_shares", lots(mobile))


def bar_predicates(df: DataFrame) -> DataFrame:
    """entry and exit conditions of the sketched strategies as columns."""
    return df.withColumns({
        "entry_cross": (F.col("dif0") > F.col("dea0")) & (lag("dif0") <= lag("dea0")) & (F.col("volume") > F.coalesce(lag("volume"), F.lit(0.0))),
        "exit_band": F.col("close") < F.col("boll_mid") * 0.97,
    })


def exit_signals(df: DataFrame) -> DataFrame:
    """F16: SELL 95 or REDUCE 80 for positions with risk flags or other reasons to leave."""
    df = position_risk(df)
    more = F.array_compact(F.array(
        F.when(F.col("divergence") == "bearish", "bearish_divergence"), F.when(F.col("profit_pct") > 20, "profit_above_20"), F.when((F.col("volume_ratio") > 1.8) & F.col("death_cross"), "heavy_death_cross"), F.when(~F.col("above_ma") & (F.col("profit_pct") > 0), "below_average"),
    ))
    df = df.withColumn("reasons", F.array_union("risk_flags", more)).filter(F.size("reasons") > 0)
    action = F.when(F.col("action") == "SELL", "SELL").otherwise("REDUCE")
    return df.withColumn("action", action).withColumn("score", F.when(F.col("action") == "SELL", 95).otherwise(80))


def t_trading(df: DataFrame, step: float = 0.05) -> DataFrame:
    """trades around a position by regime: suggestion (or none), confidence, t_change (a share), t_amount (of shares).

    Bull: bullish divergence near the average on normal volume buys mobile shares, a bearish one sells them. Bear: a bearish
    divergence sells 30 % of the base shares, a bullish one with a golden cross buys them back. Range: a bullish divergence
    without a rise buys mobile shares, a bearish one sells them.
    """
    bull, bear = F.col("regime") == "bull", F.col("regime") == "bear"
    up, down, some = F.col("divergence") == "bullish", F.col("divergence") == "bearish", F.col("mobile_shares") > 0
    third = F.floor(F.col("base_shares") * 0.3).cast("long")
    mobile = F.col("mobile_shares").cast("long")
    rules = [
        (bull & up & F.col("near_ma") & (F.col("volume_ratio") >= 1), "positive_t_buy", 78, 1, mobile),
        (bull & down & some, "positive_t_sell", 76, -1, mobile),
        (bear & down & (F.col("base_shares") > 0), "negative_t_sell", 74, -1, third),
        (bear & up & F.col("golden_cross"), "negative_t_buy", 72, 1, third),
        (~bull & ~bear & up & (F.col("price_change_pct") <= 0), "range_t_buy", 70, 1, mobile),
        (~bull & ~bear & down & some, "range_t_sell", 70, -1, mobile),
    ]
    found = F.coalesce(*[F.when(ok, F.struct(F.lit(name).alias("suggestion"), F.lit(sure).alias("confidence"), F.lit(sign * step).alias("change"), amount.alias("amount"))) for ok, name, sure, sign, amount in rules])
    return df.withColumn("_t", found).select("*", F.coalesce("_t.suggestion", F.lit("none")).alias("suggestion"), "_t.confidence", F.col("_t.change").alias("t_change"), F.col("_t.amount").alias("t_amount")).drop("_t")


def merged_signals(routed: DataFrame, positions: DataFrame) -> DataFrame:
    """routed signals, one a symbol (F10), with the exits (F16), T trades (F17, scored by their confidence) and risk alerts (F13) of positions."""
    cols = ["symbol", "action", "score", "origin"]
    exits = exit_signals(positions).withColumn("origin", F.lit("exit"))
    t = t_trading(positions).filter("suggestion <> 'none'").select("symbol", F.col("suggestion").alias("action"), F.col("confidence").alias("score"), F.lit("t_trading").alias("origin"))
    risk = position_risk(positions).filter("action <> 'HOLD'").withColumn("score", F.when(F.col("action") == "SELL", 90).otherwise(78)).withColumn("origin", F.lit("risk"))
    out = routed.withColumn("origin", F.lit("routed")).select(cols)
    for part in (exits, t, risk):
        out = out.unionByName(part.select(cols))
    return out
