"""Screening and scoring of symbols: selector legs, timeframe scores, industry-relative scores, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import indicators


def fundamental_leg(roe: float = 10, debt: float = 50, pe: float = 30, cap: tuple[float, float] = (50, 500)) -> Column:
    """The first test that fails, or pass. Nulls fail."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(F.col("roe") >= roe), "roe")
        .when(no(F.col("debt_ratio") <= debt), "debt_ratio")
        .when(no((F.col("pe") > 0) & (F.col("pe") <= pe)), "pe")
        .when(no(F.col("market_cap").between(*cap)), "market_cap")
        .otherwise("pass")
    )


def select_stocks(df: DataFrame) -> DataFrame:
    """Legs of 40, 25 and 35 points, their sum, passed and failed legs; selected if all pass."""
    fundamental = fundamental_leg() == "pass"
    turnover = F.coalesce(F.col("avg_turnover").between(1, 3), F.lit(False))
    shape = ((F.col("slope") > 0) & (F.abs("close_vs_ma") <= 5)) | (F.col("divergence") == "bullish") | F.col("bear_trap")
    volume = F.coalesce((F.col("volume_ratio") >= 1.5) & F.col("price_change_pct").between(-3, 3) & shape, F.lit(False))
    legs = [("fundamental", fundamental, 40), ("turnover", turnover, 25), ("volume_price", volume, 35)]
    score = sum((F.when(ok, p).otherwise(0) for _, ok, p in legs), F.lit(0))
    labels = lambda keep: F.array_compact(F.array(*[F.when(ok if keep else ~ok, n) for n, ok, _ in legs]))
    return df.withColumns({"fundamental_reason": fundamental_leg(), "score": score, "passed": labels(True), "failed": labels(False)}).withColumn("selected", F.size("failed") == 0)


def funnel(df: DataFrame) -> DataFrame:
    """How many symbols each stage leaves, from one pass over flags."""
    f = F.array_contains("passed", "fundamental")
    t = f & F.array_contains("passed", "turnover")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(f).alias("fundamental"), F.count_if(t).alias("turnover"), F.count_if(F.col("selected")).alias("pool"))


def side_score(side: str, fresh: Column, opposite: Column) -> Column:
    """Score of a bar from its cross, the best fresh structure point (20, 25 or 30) and the next higher timeframe."""
    if side == "buy":
        cross = F.when(F.col("golden_cross"), F.when(F.col("zone") == "above", 50).when(F.col("zone") == "near", 30).otherwise(10) + F.least(F.lit(15), F.col("confirmation_count") * 5))
        higher = F.when(F.round("higher_change", 9) > 0, 15).otherwise(0) + F.when(F.col("higher_dif") > 0, 10).otherwise(0)
        trend = F.when(F.col("above_ma60") & F.col("ma60_up"), 10).otherwise(0) + F.when(F.col("volume_ratio") >= 1, 5).otherwise(0)
    else:
        cross = F.when(F.col("death_cross") & (F.col("zone") == "near"), 30)
        higher = F.when(F.round("higher_change", 9) < 0, 15).otherwise(0) + F.when(F.col("higher_dif") < 0, 10).otherwise(0)
        trend = F.when(F.col("below_ma60") & F.col("ma60_down"), 10).otherwise(0) + F.when((F.col("volume_ratio") >= 1) & (F.col("price_change") < 0), 5).otherwise(0)
    return F.greatest(F.coalesce(cross, F.lit(0)) + F.coalesce(fresh, F.lit(0)) + higher + trend - F.when(opposite, 30).otherwise(0), F.lit(0)).cast("int")


def zero_axis_scan(last: DataFrame, min_rows: int = 120, as_of: str | None = None) -> DataFrame:
    """Latest bars that are golden crosses, scored by zone priority and buy score; best first by symbol."""
    rows = last.filter((F.col("n_rows") >= min_rows) & F.col("golden_cross"))
    if as_of:
        rows = rows.filter(F.to_date("datetime") == F.lit(as_of).cast("date"))
    priority = F.when(F.col("zone") == "above", 3).when(F.col("zone") == "near", 2).otherwise(1)
    return rows.withColumn("priority", priority).withColumn("score", F.col("priority") * 100 + F.col("buy_score"))


def median_by(df: DataFrame, key: str, *cols: str, positive: bool = False) -> DataFrame:
    """Exact medians of a group joined back to its rows as median_<col>; the grouped table is small."""
    value = lambda c: F.when(F.col(c) > 0, F.col(c)) if positive else F.col(c)
    medians = df.groupBy(F.col(key).alias("_k")).agg(*[F.percentile(value(c), 0.5).alias(f"median_{c}") for c in cols])
    return df.join(medians, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def banded(x: Column, *bands: tuple[float, int]) -> Column:
    """Points of the first band that x is above."""
    out = F
    for limit, points in bands:
        out = out.when(x > limit, points)
    return out.otherwise(0)


def quality_score(df: DataFrame, lenders: tuple = ()) -> DataFrame:
    """Return on equity, margin and research against the industry's median, cash flow, debt, growth. Industries of
    ``lenders`` (banks and insurers) get a point for debt below 80."""
    df = median_by(df, "industry", "gross_margin", "rd_ratio")
    vs = lambda c: F.when(F.col(c) > F.col(f"median_{c}") * 1.2, 2).when(F.col(c) > F.col(f"median_{c}"), 1).otherwise(0)
    usual = F.when(F.col("debt_ratio") < 40, 2).when(F.col("debt_ratio") < 60, 1).otherwise(0)
    debt = F.when(F.col("industry").isin(*lenders), F.when(F.col("debt_ratio") < 80, 1).otherwise(0)).otherwise(usual) if lenders else usual
    score = banded(F.col("roe"), (15, 3), (10, 2), (8, 1)) + vs("gross_margin") + F.when(F.col("ocf_to_profit") > 1, 2).when(F.col("ocf_to_profit") > 0.8, 1).otherwise(0) + debt + vs("rd_ratio") + banded(F.col("profit_growth"), (0.3, 2), (0.1, 1))
    return df.withColumn("quality", score)


def valuation_score(df: DataFrame) -> DataFrame:
    """Price to earnings and sales against the industry's median of positive values, price to book against its own mean, and PEG where profits grow (one of a loss counts as below 1.5)."""
    df = median_by(df, "industry", "pe", "ps", positive=True)
    pe = F.when((F.col("pe") > 0) & (F.col("pe") < F.col("median_pe") * 0.7), 3).when((F.col("pe") > 0) & (F.col("pe") < F.col("median_pe")), 2).otherwise(0)
    ps = F.when((F.col("ps") > 0) & (F.col("ps") < F.col("median_ps") * 0.7), 2).when((F.col("ps") > 0) & (F.col("ps") < F.col("median_ps")), 1).otherwise(0)
    peg = F.when(F.col("profit_growth") > 0, F.col("pe") / (F.col("profit_growth") * 100))
    growth = F.when((peg > 0) & (peg < 1), 3).when(peg < 1.5, 2).otherwise(0)
    pb = F.when((F.col("pb") > 0) & (F.col("pb") < F.col("pb_mean") * 0.6), 2).when((F.col("pb") > 0) & (F.col("pb") < F.col("pb_mean") * 0.8), 1).otherwise(0)
    return df.withColumn("valuation", pe + ps + growth + pb)


def momentum_score(last: DataFrame) -> Column:
    """E13, but for the rules on averages: RSI (20 to 30: 3, 30 to 40: 2, up to 20: 1), histogram rising below zero over three bars or just above it, lower and middle band."""
    rising = (F.col("hist0") > F.col("hist0_before")) & (F.col("hist0_before") > F.col("hist0_before2"))
    r = F.col("rsi")
    rsi = F.when((r > 20) & (r < 30), 3).when((r > 30) & (r < 40), 2).when(r <= 20, 1).otherwise(0)
    turn = F.when(rising & (F.col("hist0") < 0), 2).when((F.col("hist0") > 0) & (F.col("hist0_before") < 0), 3).otherwise(0)
    band = F.when(F.col("close") < F.col("boll_low"), 2).when(F.col("close") < F.col("boll_mid"), 1).otherwise(0)
    return rsi + turn + band


def momentum_arms(df: DataFrame) -> DataFrame:
    """E13, its two rules on averages, as points ``arms``: two closes under MA20, then up and still below 1.03 of it; MA20 crossing above MA60."""
    lag, above = indicators.lag, indicators.above
    df = df.withColumns({"_ma20": lag("ma20"), "_ma60": lag("ma60"), "_c1": lag("close"), "_c2": lag("close", 2), "_m2": lag("ma20", 2)})
    calm = above("_m2", "_c2") & above("_ma20", "_c1") & (F.col("close") > F.col("_c1")) & (F.col("close") < F.col("ma20") * 1.03)
    cross = above("ma20", "ma60") & above("_ma60", "_ma20")
    points = F.when(F.coalesce(calm, F.lit(False)), 2).otherwise(0) + F.when(F.coalesce(cross, F.lit(False)), 2).otherwise(0)
    return df.withColumn("arms", points).drop("_ma20", "_ma60", "_c1", "_c2", "_m2")


def price_position(df: DataFrame, days: int = 180) -> DataFrame:
    """Of each symbol's last bar, whether its price is low (high): two of three of in the lower (upper) 30 % of the closes of the
    last ``days``, below 0.9 (above 1.2) times the 120-bar average, outside the lower (upper) band."""
    newest = F.max("datetime").over(Window.partitionBy(*indicators.KEY))
    late = df.withColumn("_z", newest).filter(F.col("datetime") >= F.col("_z") - F.expr(f"interval {days} days"))
    q = late.groupBy("symbol").agg(F.percentile("close", 0.3).alias("_q30"), F.percentile("close", 0.7).alias("_q70"))
    votes = lambda *c: sum((F.coalesce(x, F.lit(False)).cast("int") for x in c), F.lit(0)) >= 2
    last, c = indicators.latest(df).join(q, "symbol"), F.col("close")
    return last.select("symbol", votes(c <= F.col("_q30"), c < 0.9 * F.col("ma120"), c < F.col("boll_low")).alias("is_low"), votes(c >= F.col("_q70"), c > 1.2 * F.col("ma120"), c > F.col("boll_up")).alias("is_high"))


def volume_pattern(last5: DataFrame, position: DataFrame) -> DataFrame:
    """D19 from each symbol's last five bars and its price position (is_low, is_high): +3 heavy volume with a rise below 2 % at a low, -3 very heavy volume with one below 1 % at a high, +1 a doji on volume that shrank."""
    change = F.col("pct_change") * 100
    shrunk = F.col("volume") < 0.8 * F.lag("volume").over(indicators.by_time())
    doji = shrunk & (F.abs(change) < 1) & (F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("open"), F.lit(0.0)) < 0.005)
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    flags = last5.withColumn("doji", doji).groupBy("symbol").agg(
        seen((F.col("volume_ratio") > 1.5) & (change < 2)).alias("heavy"), seen((F.col("volume_ratio") > 2) & (change < 1)).alias("very"), seen(F.col("doji")).alias("doji")
    )
    flags = flags.join(position.select("symbol", "is_low", "is_high"), "symbol")
    return flags.withColumn("score", F.col("heavy") * 3 * F.col("is_low").cast("int") - F.col("very") * 3 * F.col("is_high").cast("int") + F.col("doji"))


def composite(scores: DataFrame) -> DataFrame:
    """Quality, valuation, momentum and volume of each symbol by weight; a score that could not be computed counts as 0."""
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0)) * w
    return scores.withColumn("composite", F.round(part("quality", 0.35) + part("valuation", 0.25) + part("momentum", 0.2) + part("vol_score", 0.2), 6))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The best rows; each task keeps n rows, so nothing else is sorted or moved."""
    return df.orderBy(*order).limit(n)


#: Timeframes in order, with their weights.
TIMEFRAMES = {"1m": 1, "5m": 2, "15m": 3, "30m": 4, "60m": 5, "120m": 6, "1d": 8}


def by_timeframe(values: dict) -> Column:
    """A value for each timeframe; null for others."""
    out = F
    for name, value in values.items():
        out = out.when(F.col("timeframe") == name, value)
    return out


def with_higher(df: DataFrame, least: int = 37) -> DataFrame:
    """B06 as of every bar (n_rows, dif, dea): higher_timeframe, higher_dif and higher_change (of dif) of the last bar that had closed
    by then of the next higher timeframe which had ``least`` of them.

    An as-of join by forward fill: one window over all timeframes of a symbol, in which a bar that ends at the same time
    comes first if its timeframe is the higher one.
    """
    ordinal = by_timeframe({t: i for i, t in enumerate(TIMEFRAMES)})
    ok = (F.col("n_rows") >= least) & F.col("dea").isNotNull()
    own = F.struct("timeframe", "dif", (F.col("dif") - indicators.lag("dif")).alias("change"), ok.alias("ok"))
    df = df.withColumn("_o", ordinal).withColumn("_s", own)
    upto = Window.partitionBy("symbol").orderBy("datetime", F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_h{i}": F.last(F.when(F.col("_o") == i, F.col("_s")), ignorenulls=True).over(upto) for i in range(1, len(TIMEFRAMES))}
    df = df.withColumns(last)
    found = F.coalesce(*[F.when((F.col("_o") < i) & F.col(f"_h{i}.ok"), F.col(f"_h{i}")) for i in range(1, len(TIMEFRAMES))])
    return df.withColumn("_f", found).withColumns({"higher_timeframe": F.col("_f.timeframe"), "higher_dif": F.col("_f.dif"), "higher_change": F.col("_f.change")}).drop("_o", "_s", "_f", *last)


def coverage(universe: DataFrame, done: DataFrame, excluded: DataFrame) -> DataFrame:
    """Successes within the universe over the universe without excluded symbols."""
    keep = universe.select("symbol").distinct().join(excluded.select("symbol").distinct(), "symbol", "left_anti")
    flag = done.select("symbol").distinct().withColumn("ok", F.lit(1))
    out = keep.join(flag, "symbol", "left").agg(F.count(F.lit(1)).alias("eligible"), F.sum(F.coalesce("ok", F.lit(0))).alias("successful"))
    return out.withColumn("coverage", F.coalesce(F.col("successful") / F.nullif(F.col("eligible"), F.lit(0)), F.lit(0.0))).withColumn("completed", F.col("successful") == F.col("eligible"))


def group_acceptance(rows: DataFrame, groups: DataFrame, minimum: int = 2) -> DataFrame:
    """Candidates by watchlist group and in total (groups may overlap)."""
    joined = groups.join(rows, "symbol", "left")
    return joined.rollup("grp").agg(F.count_if(F.col("score").isNotNull()).alias("candidates"), F.count_if(F.col("score") >= 85).alias("buys")).withColumn("accepted", F.col("candidates") >= minimum)


def buy_gate(scores: DataFrame, single: float = 0.1) -> DataFrame:
    """``buy`` where quality, valuation, momentum and volume pattern all reach their marks; ``ratio`` of the capital by their sum."""
    q, v, m, w = (F.col(c) for c in ("quality", "valuation", "momentum", "vol_score"))
    total = q + v + F.coalesce(m, F.lit(0)) + F.coalesce(w, F.lit(0))
    ratio = F.least(0.05 * F.when(total > 15, 1.5).when(total > 12, 1.2).otherwise(1.0), F.lit(single))
    return scores.withColumns({"buy": F.coalesce((q > 7) & (v > 5) & (m > 5) & (w > 2), F.lit(False)), "ratio": ratio})


def sell_gate(df: DataFrame, patience: int = 60, least: float = 5, profit: float = 30, loss: float = -12, heavy: float = -2, drop: float = -0.3) -> DataFrame:
    """Why a position should go (returns in percent): the volume pattern, holding without gain, gain, loss, or the fall of
    the return on equity against ``roe_before``."""
    fell = F.when(F.col("roe_before") > 0, (F.coalesce("roe", F.lit(0.0)) - F.col("roe_before")) / F.col("roe_before") < drop)
    pct = F.col("profit_pct")
    reason = F.when(F.col("vol_score") < heavy, "volume").when((F.col("holding_days") > patience) & (pct < least), "stale").when(pct > profit, "profit").when(pct < loss, "loss").when(fell, "roe").otherwise("hold")
    return df.withColumn("reason", reason)


def turns(df: DataFrame) -> DataFrame:
    """E17, its technical tests by bar: ``ma_up`` (the 250-bar average rose twice), ``turn_up`` (two falls of the close on two rises
    of the histogram), ``heavy_flat`` (volume above 1.5 times its 20-bar mean, close within 5 % of that five bars ago)."""
    lag, above = indicators.lag, indicators.above
    cols = {"_m1": lag("ma250"), "_m2": lag("ma250", 2), "_k1": lag("close"), "_k2": lag("close", 2), "_k5": lag("close", 5), "_h1": lag("hist"), "_h2": lag("hist", 2)}
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns(cols).withColumns({
        "ma_up": yes(above("ma250", "_m1") & above("_m1", "_m2")),
        "turn_up": yes((F.col("close") < F.col("_k1")) & (F.col("_k1") < F.col("_k2")) & above("hist", "_h1") & above("_h1", "_h2")),
        "heavy_flat": yes((F.col("volume_ratio") > 1.5) & (F.abs(F.col("close") / F.col("_k5") - 1) < 0.05)),
    }).drop(*cols)


def three_legs() -> dict[str, Column]:
    """One of the technical tests, four tests of safety, return and price, turnover (ratios in percent)."""
    c = F.col
    return {
        "technical": c("ma_up") | c("turn_up") | c("heavy_flat"), "debt": c("debt_ratio") <= 50, "receivables": c("receivables") <= c("cash"), "interest": c("interest") <= c("net_profit"),
        "cash_flow": c("cash_flow") >= 0.5 * c("net_profit"), "value": (c("roe") > 10) & (c("pe") > 0) & (c("pe") < 30), "turnover": (c("avg_turnover") > 1) & (c("avg_turnover") < 5),
    }


def screen(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that pass all named tests; a null fails."""
    for test in tests.values():
        df = df.filter(F.coalesce(test, F.lit(False)))
    return df
