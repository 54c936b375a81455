"""The short forms of divergence, trend and entry that sketched strategies use, as columns of one pass of windows.

All take bars with ``indicators.with_macd`` and ``ma250``, and need one partitioning by key. Where a bar lacks the history that
a test needs, the test is false (kinds are "none", trends "side").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.indicators import above, by_time, lag, sma, trailing

DIVERGENCES = ["div_run3", "div_area5", "div_hist3", "div_extreme10", "div_turn10", "div_shrink"]
TRENDS = ["trend20", "trend1", "slope20"]
SIGNALS = ["legs_buy", "legs_sell", "rsi_buy", "rsi_sell", "burst_buy", "burst_sell", "swing_buy", "swing_sell", "steady_buy", "cross_buy", "cross_sell"]


def _sided(bullish: Column, bearish: Column, names: tuple[str, str, str] = ("bullish", "bearish", "none")) -> Column:
    return F.when(bullish, names[0]).when(bearish, names[1]).otherwise(names[2])


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def divergence_marks(df: DataFrame, hist: str = "hist0", force: str = "dif0") -> DataFrame:
    """Six readings of price against momentum, each bullish, bearish or none.

    run3: two falls of the close in a row while the histogram rises twice; area5: close against five bars ago, the mean of
    five histograms the other way; hist3: the same with the histogram over three bars; extreme10: the close is the extreme of
    ten bars and the force is not at its own; turn10: a new extreme beyond the ten bars before, the histogram turning back
    from its side of zero; shrink: the histogram shrinks on its side of zero while the close goes on for a bar.
    """
    close, now = F.col("close"), F.col(hist)
    c, h = (lambda k: lag("close", k)), (lambda k: lag(hist, k))
    ten, before = trailing(10), by_time().rowsBetween(-10, -1)
    whole, primed = F.count("close").over(ten) == 10, F.count("low").over(before) == 10
    df = df.withColumn("_area", sma(hist, 5))
    area, area5 = F.col("_area"), lag("_area", 5)
    shrinks = above(F.abs(h(1)), F.abs(now))
    return df.withColumns({
        "div_run3": _sided((close < c(1)) & (c(1) < c(2)) & above(now, h(1)) & above(h(1), h(2)), (close > c(1)) & (c(1) > c(2)) & above(h(1), now) & above(h(2), h(1))),
        "div_area5": _sided((close < c(5)) & above(area, area5), (close > c(5)) & above(area5, area)),
        "div_hist3": _sided((close < c(3)) & above(now, h(3)), (close > c(3)) & above(h(3), now)),
        "div_extreme10": _sided(
            whole & (close == F.min("close").over(ten)) & above(force, F.min(force).over(ten)),
            whole & (close == F.max("close").over(ten)) & above(F.max(force).over(ten), force),
        ),
        "div_turn10": _sided(
            primed & (F.col("low") < F.min("low").over(before)) & above(now, h(1)) & (h(1) < 0),
            primed & (F.col("high") > F.max("high").over(before)) & above(h(1), now) & (h(1) > 0),
        ),
        "div_shrink": _sided((now < 0) & shrinks & (close < c(1)), (now > 0) & shrinks & (close > c(1))),
    }).drop("_area")


def trend_marks(df: DataFrame, average: str = "ma250") -> DataFrame:
    """up, down or side by the close against its average and the average against itself 20 bars (trend20) or one bar (trend1)
    ago; by the average alone (slope20); and the target exposure in a band of 5 % around the average."""
    names = ("up", "down", "side")
    rises, falls = (lambda k: above(average, lag(average, k))), (lambda k: above(lag(average, k), average))
    over, under = above("close", average), above(average, "close")
    gap = F.round(F.col("close") / F.col(average) - 1, 9)
    return df.withColumns({
        "trend20": _sided(over & rises(20), under & falls(20), names),
        "trend1": _sided(over & rises(1), under & falls(1), names),
        "slope20": _sided(rises(20), falls(20), names),
        "target_exposure": F.when(gap > 0.05, 0.7).when(gap < -0.05, 0.3).otherwise(0.5),
    })


def bar_signals(df: DataFrame, regime: str = "trend20") -> DataFrame:
    """what the sketches say of a bar, after ``divergence_marks`` and ``trend_marks``; ``regime`` is the market's, up, down or side.

    legs: pullback to a rising average, three-bar divergence or heavy flat volume, by regime. rsi: divergence near the average
    with RSI 40 and 70 in an uptrend, rallies in a downtrend, RSI 30 and 70 between. burst: near the average with the
    histogram turning, or a cross, on volume of 1.5 times its mean; out at a divergence or below the average. swing: a
    bounce within 5 % of the average in a sideways market, deep falls below it in a falling one. steady: an average that does
    not fall, divergence, heavy volume and a small move. cross: above the average with dif above dea. What depends on a
    position's own cost (stops, profit taking) is left to the rules on positions.
    """
    close, ma, volume = F.col("close"), F.col("ma250"), F.col("volume")
    in_market = lambda kind: F.col(regime) == kind
    bull, bear = (lambda mark: F.col(mark) == "bullish"), (lambda mark: F.col(mark) == "bearish")
    near = F.round(F.abs(close - ma) / ma, 9) < 0.05
    flat = F.round(F.abs(close / lag("close", 5) - 1), 9) < 0.05
    heavy = lambda n, times: F.round(volume / F.nullif(sma("volume", n), F.lit(0.0)), 9) > times
    rising3 = above(lag("ma250", 1), lag("ma250", 2)) & above(lag("ma250", 2), lag("ma250", 3))
    quiet_buy, quiet_sell = heavy(20, 1.5) & flat, heavy(20, 2.0) & flat
    up, dn = above("dif0", "dea0"), above("dea0", "dif0")
    turned_up = up & above(lag("dea0"), lag("dif0"))
    burst = heavy(30, 1.5)
    recent = F.round(sma("volume", 5) / F.nullif(sma("volume", 20), F.lit(0.0)), 9)
    rsi, own = F.col("rsi"), F.col("trend1")
    small = F.round(F.abs(close / lag("close") - 1), 9) < 0.05
    tests = {
        "legs_buy": F.when(in_market("up"), _flag(rising3 & (_flag(near) | bull("div_run3"))) | _flag(quiet_buy)).when(in_market("down"), bull("div_run3")).otherwise((bull("div_run3") | _flag(near)) & quiet_buy),
        "legs_sell": F.when(in_market("up"), bear("div_run3")).otherwise(bear("div_run3") | _flag(quiet_sell)),
        "rsi_buy": F.when(own == "up", near & bull("div_extreme10") & (rsi < 40)).when(own == "side", rsi < 30),
        "rsi_sell": F.when(own == "up", bear("div_extreme10") & (rsi > 70)).when(own == "down", (rsi > 60) & (recent > 1.5)).otherwise(rsi > 70),
        "burst_buy": above("close", "ma250") & burst & (_flag(near & above("hist0", lag("hist0")) & (lag("hist0") < 0)) | _flag(turned_up)),
        "burst_sell": bear("div_turn10") | _flag(above("ma250", "close") & above(lag("close"), lag("ma250"))),
        "swing_buy": in_market("side") & near & (close > lag("close")),
        "swing_sell": in_market("down") & above("ma250", "close") & (close < lag("close", 20) * 0.8),
        "steady_buy": ~above(lag("ma250"), "ma250") & bull("div_area5") & heavy(30, 1.5) & small,
        "cross_buy": above("close", "ma250") & up,
        "cross_sell": dn,
    }
    return df.withColumns({name: _flag(test) for name, test in tests.items()})
