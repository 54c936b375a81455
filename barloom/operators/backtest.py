"""Backtests: signal collection, win rates over the whole history, bar replay with costs, reports and scans."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import KEY



def by_day():
    return Window.partitionBy("symbol").orderBy("day")


def collected_signals(df: DataFrame, points: DataFrame, least: int = 60) -> DataFrame:
    """Structure points on the day of their confirmation, golden crosses above the zero axis (buy) and death crosses near it
    (sell), of symbols with ``least`` bars."""
    golden, death = F.col("golden_cross") & (F.col("zone") == "above"), F.col("death_cross") & (F.col("zone") == "near")
    kind = F.when(golden, "macd_golden_cross_above").when(death, "zero_axis_death_cross")
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") >= least)
    crossed = rows.withColumn("type", kind).filter("type is not null").select("symbol", F.to_date("datetime").alias("day"), "type", F.when(golden, "buy").otherwise("sell").alias("side"))
    enough = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("symbol")
    return crossed.unionByName(points.join(enough, "symbol", "left_semi").select("symbol", F.to_date("confirmed_at").alias("day"), "type", "side"))


def win_trades(bars: DataFrame, signals: DataFrame, hold: int = 40, commission: float = 0.0003, stamp: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """Enter at the next bar's open; leave after the first later sell signal, or ``hold`` bars on, or at the end.

    A sell whose bar is not after the entry bar cancels signal exits altogether. Windows and equi-joins on bar numbers.
    """
    b = bars.select("symbol", F.to_date("datetime").alias("day"), "open", "close").withColumn("i", F.row_number().over(by_day()))
    n = b.groupBy("symbol").agg(F.max("i").alias("last_i"))
    ahead = Window.partitionBy("symbol").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sells = signals.filter("side = 'sell'").select("symbol", "day").distinct().withColumn("sell", F.lit(1))
    buys = signals.filter("side = 'buy'").select("symbol", "day", "type")
    line = b.join(sells, ["symbol", "day"], "left").withColumn("next_sell", F.last(F.when(F.col("sell") == 1, F.struct("day", "i")), ignorenulls=True).over(ahead))
    entry = line.withColumn("entry_i", F.col("i") + 1).withColumn("entry_open", F.lead("open").over(by_day())).select("symbol", "day", "entry_i", "entry_open", F.col("next_sell.i").alias("sell_i"))
    t = buys.join(entry, ["symbol", "day"]).filter("entry_open > 0").join(n, "symbol")
    by_sell = F.when(F.col("sell_i") + 1 > F.col("entry_i") + 0, F.when(F.col("sell_i") > F.col("entry_i"), F.col("sell_i") + 1))
    timeout = F.col("entry_i") + hold
    exit_i = F.least(F.coalesce(by_sell, timeout), timeout)
    reason = F.when(exit_i > F.col("last_i"), "window_end").when(by_sell.isNotNull() & (by_sell <= timeout), "chan_sell").otherwise("timeout")
    t = t.withColumn("reason", reason).withColumn("exit_i", F.least(exit_i, F.col("last_i")))
    out = b.select("symbol", F.col("i").alias("exit_i"), F.col("day").alias("exit_day"), F.col("open").alias("exit_open"), F.col("close").alias("exit_close"))
    t = t.join(out, ["symbol", "exit_i"])
    price = F.when(F.col("reason") == "window_end", F.col("exit_close")).otherwise(F.col("exit_open"))
    cost, gain = F.col("entry_open") * (1 + commission + slippage), price * (1 - commission - stamp - slippage)
    return t.withColumn("pnl_pct", (gain / cost - 1) * 100).withColumn("holding_days", F.datediff("exit_day", "day"))


def win_rates(trades: DataFrame) -> DataFrame:
    """Counts, win rate, means, upper median, overall, by signal type and by exit reason (one pass of grouping sets)."""
    won = F.col("pnl_pct") > 0
    out = trades.groupingSets([[], [F.col("type")], [F.col("reason")]], "type", "reason").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(won) / F.count(F.lit(1))).alias("win_rate"), F.avg("pnl_pct").alias("avg_pnl"),
        F.expr("percentile_disc(0.5) within group (order by pnl_pct desc)").alias("median_pnl"),
        F.avg(F.when(won, F.col("pnl_pct"))).alias("avg_win"), F.avg(F.when(~won, F.col("pnl_pct"))).alias("avg_loss"), F.avg("holding_days").alias("avg_days"),
    )
    return out.withColumn("profit_loss_ratio", F.abs(F.col("avg_win") / F.nullif(F.col("avg_loss"), F.lit(0.0))))


@dataclass(frozen=True)
class Costs:
    """Commission both ways, stamp tax on sales, slippage, whole lots, no sale on the day of purchase, price limits."""

    commission: float = 0.0003
    stamp: float = 0.001
    slippage: float = 0.0005
    lot: int = 100
    limit: float = 9.8

    def fill(self, close: float, shares: int, side: str) -> tuple[float, float]:
        """Fill price and cash flow."""
        price = close * (1 + self.slippage if side == "BUY" else 1 - self.slippage)
        notional = price * shares
        fee = notional * self.commission
        return (price, -(notional + fee)) if side == "BUY" else (price, notional - fee - notional * self.stamp)

    def in_limit(self, change: float | None) -> bool:
        return change is None or change != change or abs(change) < self.limit


def fill_columns(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """G09 as columns: fill price, fees and cash flow of rows (side, close, shares)."""
    buy = F.col("side") == "BUY"
    lots = F.floor(F.col("shares") / costs.lot) * costs.lot
    price = F.col("close") * F.when(buy, 1 + costs.slippage).otherwise(1 - costs.slippage)
    notional = price * lots
    fees = notional * costs.commission + F.when(buy, 0.0).otherwise(notional * costs.stamp)
    return df.withColumn("lot_shares", lots).withColumn("fill_price", price).withColumn("fees", fees).withColumn("cash_flow", F.when(buy, -(notional + fees)).otherwise(notional - fees))


def trend_positions(close: np.ndarray, volume: np.ndarray, ma: int, stop: float, profit: float) -> np.ndarray:
    """1 to buy, -1 to sell, 0 else: in on a close crossing above its average with volume, out on a cross below or a stop."""
    mean = pd.Series(close).rolling(ma).mean().to_numpy()
    usual = pd.Series(volume).rolling(5).mean().to_numpy()
    act, entry = np.zeros(len(close), int), None
    for i in range(1, len(close)):
        if np.isnan(mean[i]) or np.isnan(mean[i - 1]):
            continue
        rose, fell = close[i - 1] <= mean[i - 1] and close[i] > mean[i], close[i - 1] >= mean[i - 1] and close[i] < mean[i]
        if entry is None:
            if rose and volume[i] >= usual[i]:
                act[i], entry = 1, close[i]
        else:
            gain = (close[i] - entry) / entry if entry else 0.0
            if fell or gain <= -stop or gain >= profit:
                act[i], entry = -1, None
    return act


def replay(day: np.ndarray, close: np.ndarray, act: np.ndarray, costs: Costs, cash: float = 100_000.0, ratio: float = 0.95) -> tuple[list[dict], np.ndarray]:
    """Trades and the equity after each bar, whole lots in and all shares out."""
    shares, entered, trades, equity = 0, None, [], np.empty(len(close))
    change = np.r_[np.nan, (close[1:] / close[:-1] - 1) * 100] if len(close) else np.zeros(0)
    for i, price in enumerate(close.tolist()):
        if act[i] > 0:
            n = int((cash + shares * price) * ratio / price) // costs.lot * costs.lot
            fill, flow = costs.fill(price, n, "BUY")
            if n and -flow <= cash and costs.in_limit(change[i] if costs.limit < 100 else None):
                cash, shares, entered = cash + flow, shares + n, entered if entered is not None else day[i]
                trades.append({"i": i, "side": "BUY", "price": fill, "shares": n, "flow": flow})
        elif act[i] < 0 and shares and day[i] > entered and costs.in_limit(change[i] if costs.limit < 100 else None):
            fill, flow = costs.fill(price, shares, "SELL")
            cash += flow
            trades.append({"i": i, "side": "SELL", "price": fill, "shares": shares, "flow": flow})
            shares, entered = 0, None
        equity[i] = cash + shares * price
    return trades, equity


REPORT = "symbol string, param int, sample string, ma int, stop double, ending_equity double, total_return double, annual_return double, max_drawdown double, trade_count long, win_rate double, profit_loss_ratio double, avg_holding_days double, turnover_rate double, sharpe_ratio double, calmar_ratio double"


def report(day: pd.Series, trades: list[dict], equity: np.ndarray, cash: float = 100_000.0) -> dict:
    """K-th purchase with k-th sale, returns, drawdown from the starting cash, turnover, Sharpe (sample, 252 days), Calmar."""
    buys, sells = [t for t in trades if t["side"] == "BUY"], [t for t in trades if t["side"] == "SELL"]
    pnl = [b["flow"] + s["flow"] for b, s in zip(buys, sells, strict=False)]
    held = [(day.iloc[s["i"]] - day.iloc[b["i"]]).days for b, s in zip(buys, sells, strict=False)]
    wins, losses = [x for x in pnl if x > 0], [x for x in pnl if x < 0]
    days = max((day.iloc[-1] - day.iloc[0]).days, 1)
    total = (equity[-1] - cash) / cash
    annual = (1 + total) ** (365 / days) - 1
    peak = np.maximum.accumulate(np.r_[cash, equity])[1:]
    drawdown = float(((peak - equity) / peak).max())
    steps = np.diff(equity) / equity[:-1]
    sd = steps.std(ddof=1) if len(steps) > 1 else 0.0
    notional = sum(abs(t["price"] * t["shares"]) for t in trades)
    return {
        "ending_equity": equity[-1], "total_return": total, "annual_return": annual, "max_drawdown": drawdown, "trade_count": len(pnl),
        "win_rate": len(wins) / len(pnl) if pnl else 0.0, "profit_loss_ratio": (sum(wins) / len(wins)) / abs(sum(losses) / len(losses)) if wins and losses else 0.0,
        "avg_holding_days": sum(held) / len(held) if held else 0.0, "turnover_rate": notional / equity.mean(), "sharpe_ratio": float(steps.mean() / sd * np.sqrt(252)) if sd else 0.0,
        "calmar_ratio": annual / drawdown if drawdown else 0.0,
    }


def scan(bars: DataFrame, mas: tuple[int, ...] = (5,), stops: tuple[float, ...] = (0.08,), profit: float = 0.20, split: float | None = None, costs: Costs = Costs(limit=1e9), most: int = 24) -> DataFrame:
    """Each symbol once, every parameter set on its bars (in and out of sample if split), one report row each.

    The grid travels in the closure, so bars are shuffled once however many sets there are.
    """
    grid = list(product(mas, stops))[:most]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("datetime", kind="stable", ignore_index=True)
        cut = int(len(pdf) * min(max(split, 0.5), 0.9)) if split else len(pdf)
        parts = [("all", pdf)] if not split else [("in", pdf.iloc[:cut]), ("out", pdf.iloc[cut:])]
        rows = []
        for k, (ma, stop) in enumerate(grid):
            for name, part in parts:
                if len(part):
                    close = part["close"].to_numpy()
                    act = trend_positions(close, part["volume"].to_numpy(), ma, stop, profit)
                    day = part["datetime"]
                    trades, equity = replay(day.to_numpy(), close, act, costs)
                    rows.append({"symbol": pdf["symbol"].iloc[0], "param": k, "sample": name, "ma": ma, "stop": stop} | report(day, trades, equity))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])

    return bars.groupBy(*KEY).applyInPandas(run, REPORT)


def rank_parameters(reports: DataFrame, gap_limit: float = 0.20) -> DataFrame:
    """Gap of in- and out-of-sample annual returns, stability, robust score, and rank within the symbol."""
    pick = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    wide = reports.groupBy("symbol", "param", "ma", "stop").agg(pick("in", "annual_return").alias("ins"), pick("out", "annual_return").alias("outs"), pick("out", "trade_count").alias("out_trades"))
    gap = F.abs(F.col("ins") - F.col("outs"))
    stable = (gap <= gap_limit) & (F.col("out_trades") > 0) & (F.signum("ins") == F.signum("outs"))
    robust = F.col("outs") - F.greatest(gap - gap_limit, F.lit(0.0))
    by = Window.partitionBy("symbol").orderBy(F.col("stable").desc(), F.col("robust").desc(), F.col("outs").desc(), "param")
    return wide.withColumns({"gap": gap, "stable": stable, "robust": robust}).withColumn("rank", F.row_number().over(by))


def pair_trades(trades: DataFrame) -> DataFrame:
    """G10 as joins: k-th purchase and k-th effective sale of a symbol (a sale with nothing open is skipped)."""
    by = Window.partitionBy("symbol").orderBy("seq")
    one = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(by)
    t = trades.withColumn("nb", one("BUY")).withColumn("ns", one("SELL"))
    t = t.withColumn("skipped", F.greatest(F.max(F.col("ns") - F.col("nb")).over(by), F.lit(0)))
    t = t.withColumn("k", F.when(F.col("side") == "BUY", F.col("nb")).otherwise(F.col("ns") - F.col("skipped")))
    before = F.coalesce(F.lag("k").over(Window.partitionBy("symbol", "side").orderBy("seq")), F.lit(0))
    t = t.withColumn("ok", F.col("k") > before)
    side = lambda s, p: t.filter((F.col("side") == s) & F.col("ok")).select("symbol", "k", F.col("seq").alias(f"{p}_seq"), F.col("flow").alias(f"{p}_flow"))
    return side("BUY", "buy").join(side("SELL", "sell"), ["symbol", "k"]).withColumn("pnl", F.col("buy_flow") + F.col("sell_flow"))


def nav_metrics(nav: DataFrame, value: str = "close") -> DataFrame:
    """Return, drawdown and Sharpe (population, 3 % a year risk free) of a value series by symbol."""
    by = Window.partitionBy("symbol").orderBy("datetime")
    step = F.col(value) / F.lag(value).over(by) - 1
    rows = nav.withColumn("step", step).withColumn("peak", F.max(value).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("dd", 1 - F.col(value) / F.col("peak"))
    out = rows.groupBy("symbol").agg(F.min_by(value, "datetime").alias("first"), F.max_by(value, "datetime").alias("last"), F.datediff(F.max("datetime"), F.min("datetime")).alias("days"), F.count(F.lit(1)).alias("values"), F.max("dd").alias("max_drawdown"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("sd"), F.avg((F.col("step") > 0).cast("int")).alias("win_rate"))
    ret = F.col("last") / F.col("first") - 1
    return out.withColumn("total_return", ret).withColumn("annual_return", F.pow(1 + ret, 365 / F.greatest("days", F.lit(1))) - 1).withColumn("sharpe", (F.col("mean") - 0.03 / 365) / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt(F.lit(252.0)))


def symbol_report(nav: DataFrame, trades: DataFrame, capital: float) -> DataFrame:
    """``nav_metrics`` with the closed trades (pnl, amount) of each symbol: their number, win rate, mean profit to mean loss,
    and turnover a year of 252 values. Without wins or without losing trades the ratio is 0, as are the others without trades."""
    gain, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.count(gain).alias("wins"), zero(F.sum(gain)).alias("gained"), zero(F.sum(loss)).alias("lost"), F.sum("amount").alias("amount"))
    rest = F.col("trades") - F.col("wins")
    ratio = F.when((F.col("wins") > 0) & (rest > 0), F.col("gained") / F.col("wins") / F.nullif(F.col("lost") / rest, F.lit(0.0)))
    out = nav.join(t, "symbol", "left").withColumns({"trade_win_rate": zero(F.col("wins") / F.col("trades")), "profit_loss_ratio": zero(ratio), "turnover": zero(F.col("amount")) / (2 * capital) / (F.col("values") / 252)})
    return out.withColumn("trades", F.coalesce("trades", F.lit(0))).drop("wins", "gained", "lost", "amount")


def rebalance(scores: DataFrame, n: int) -> DataFrame:
    """By month, what to buy and sell to hold the n best: set differences of each month with the one before."""
    by = Window.partitionBy("month").orderBy(F.col("score").desc(), "symbol")
    held = scores.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= n).select("month", "symbol")
    after = held.select(F.add_months("month", 1).alias("month"), "symbol")
    months = scores.select("month").distinct()
    buys = held.join(after, ["month", "symbol"], "left_anti").withColumn("action", F.lit("BUY"))
    sells = after.join(months, "month", "left_semi").join(held, ["month", "symbol"], "left_anti").withColumn("action", F.lit("SELL"))
    return buys.unionByName(sells)


def concentration(holdings: DataFrame) -> DataFrame:
    """Amount of each holding and its share of the account; totals are partial sums joined back, as an account may hold many rows."""
    amount: Column = F.col("shares") * F.col("cost")
    rows = holdings.withColumn("amount", amount)
    totals = rows.groupBy(F.col("account_group").alias("_of")).agg(F.sum("amount").alias("_total"))
    joined = rows.join(totals, rows["account_group"].eqNullSafe(totals["_of"]))
    return joined.withColumn("share", F.col("amount") / F.nullif("_total", F.lit(0.0))).drop("_of", "_total")


def unmatched_entries(trades: DataFrame) -> DataFrame:
    """Purchases that no effective sale closes."""
    pairs = pair_trades(trades).select("symbol", F.col("buy_seq").alias("seq"))
    return trades.filter("side = 'BUY'").join(pairs, ["symbol", "seq"], "left_anti")


def regime_on(rows: DataFrame, regimes: DataFrame, day: str = "day") -> DataFrame:
    """``regime`` as of each row's day: a dated regime holds until the day before the next; ``unknown`` before the first.

    There is one regime a day, so each is spread over the days it holds and met by an equi-join.
    """
    dated = regimes.select(F.to_date("datetime").alias("_from"), "regime")
    until = F.coalesce(F.date_sub(F.lead("_from").over(Window.orderBy("_from")), 1), F.date_add("_from", 3650))
    spread = dated.withColumn("_until", until).select("regime", F.explode(F.sequence("_from", "_until")).alias(day))
    return rows.join(spread, day, "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def breakdown(trades: DataFrame, signals: DataFrame, pnl: str = "pnl_pct") -> DataFrame:
    """By regime of either side: trades, signals, win rate, profit to loss, mean days, total."""
    value = F.col(pnl)
    gain, loss = F.avg(F.when(value > 0, value)), F.abs(F.avg(F.when(value < 0, value)))
    t = trades.groupBy("regime").agg(F.count(F.lit(1)).alias("trade_count"), F.avg((value > 0).cast("int")).alias("win_rate"), (F.coalesce(gain, F.lit(0.0)) / F.nullif(loss, F.lit(0.0))).alias("profit_loss_ratio"), F.avg("holding_days").alias("avg_holding_days"), F.sum(value).alias("total_pnl"))
    s = signals.groupBy("regime").agg(F.count(F.lit(1)).alias("signal_count"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "signal_count")}
    return t.join(s, "regime", "full").withColumns(counts | {c: F.coalesce(c, F.lit(0.0)) for c in ("win_rate", "profit_loss_ratio", "avg_holding_days", "total_pnl")})


def best_of(reports: DataFrame, key: str) -> DataFrame:
    """Of several parameter sets or strategies, the one with the best annual return; its lead if both traded."""
    by = Window.partitionBy(key).orderBy(F.col("annual_return").desc(), "param")
    rows = reports.withColumn("r", F.row_number().over(by)).withColumn("next_return", F.lead("annual_return").over(by)).withColumn("next_trades", F.lead("trade_count").over(by))
    lead = F.when((F.col("trade_count") > 0) & (F.col("next_trades") > 0), F.col("annual_return") - F.col("next_return"))
    return rows.filter("r = 1").select(key, "param", "ma", "annual_return", lead.alias("lead"))
