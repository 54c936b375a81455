"""Bars: standardising, cleaning, universes, resampling and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import kernels
from barloom.operators.indicators import KEY, by_time, latest, sma, with_averages

#: Column names of providers by standard name: fixed values.
ALIASES = {
    "datetime": ["datetime", "date", "trade_date", "day", "time", "日期", "时间"],
    "open": ["open", "开盘"], "high": ["high", "最高"], "low": ["low", "最低"], "close": ["close", "收盘", "trade"],
    "volume": ["volume", "vol", "成交量"], "amount": ["amount", "turnover", "成交额"],
}
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "120m": 120}
SESSIONS = (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))


def standardize(raw: DataFrame, timeframe: str, seq: str | None = None) -> DataFrame:
    """Standard bars: renamed, parsed (bad numbers null), complete, one row per time: the last by ``seq``.

    Time and prices must be there under some alias; volume and amount are 0 where missing.
    """
    found = {std: next((c for c in names if c in raw.columns), None) for std, names in ALIASES.items()}
    missing = [c for c in ("datetime", "open", "high", "low", "close") if found[c] is None]
    if missing:
        raise ValueError(f"no column for {missing}")
    text = F.col(found["datetime"]).cast("string")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text))
    number = lambda c: F.col(found[c]).try_cast("double") if found[c] else F.lit(0.0)
    out = raw.select("symbol", F.lit(timeframe).alias("timeframe"), at.alias("datetime"), *[number(c).alias(c) for c in ("open", "high", "low", "close")], *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("volume", "amount")], (F.col(seq) if seq else F.monotonically_increasing_id()).alias("_seq"))
    out = out.dropna(subset=["datetime", "open", "high", "low", "close"])
    columns = [c for c in out.columns if c not in ("symbol", "timeframe", "datetime", "_seq")]
    kept = out.groupBy("symbol", "timeframe", "datetime").agg(F.max_by(F.struct(*columns), "_seq").alias("s"))
    return kept.select("symbol", "timeframe", "datetime", "s.*", F.lit(True).alias("is_closed"))


def with_closed_flag(bars: DataFrame, as_of: str, start_stamped: bool = False) -> DataFrame:
    """is_closed as of a time: a day before it, or the day itself from 15:00; a minute bar that has ended."""
    now = F.lit(as_of).cast("timestamp")
    minutes = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in MINUTES.items()], F.lit(0))
    end = F.timestamp_add("MINUTE", minutes, F.col("datetime")) if start_stamped else F.col("datetime")
    day, today = F.to_date("datetime"), F.to_date(now)
    daily = (day < today) | ((day == today) & (F.date_format(now, "HH:mm:ss") >= "15:00:00"))
    return bars.withColumn("is_closed", F.when(F.col("timeframe") == "1d", daily).otherwise(end <= now))


def valid(bars: DataFrame) -> DataFrame:
    """Bars with positive prices, high and low around open and close, and no negative volume or amount."""
    ok = (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low"))
    return bars.filter(ok & (F.coalesce("volume", F.lit(0.0)) >= 0) & (F.coalesce("amount", F.lit(0.0)) >= 0))


def usable_symbols(bars: DataFrame, expected: str, min_bars: int = 120) -> DataFrame:
    """Symbols with enough valid closed bars, the last not before the expected date."""
    stats = valid(bars.filter("is_closed")).groupBy("symbol").agg(F.count(F.lit(1)).alias("bar_count"), F.to_date(F.max("datetime")).alias("last_day"))
    return stats.filter((F.col("bar_count") >= min_bars) & (F.col("last_day") >= F.lit(expected).cast("date")))


def merge_snapshot(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """History with a snapshot's valid bars of known symbols; a new bar replaces one of the same time."""
    known = valid(snapshot).join(history.select("symbol").distinct(), "symbol", "left_semi")
    both = history.withColumn("_new", F.lit(0)).unionByName(known.withColumn("_new", F.lit(1)))
    rest = [c for c in history.columns if c not in (*KEY, "datetime")]
    return both.groupBy(*KEY, "datetime").agg(F.max_by(F.struct(*rest), "_new").alias("s")).select(*KEY, "datetime", "s.*")


def universe(listed: DataFrame, cutoff: str) -> DataFrame:
    """One row per symbol, without special-treatment and delisting names and without listings after the cutoff."""
    ok = ~F.coalesce(F.col("name").rlike("(?i)ST|退"), F.lit(False)) & F.coalesce(F.col("list_date") <= F.lit(cutoff).cast("date"), F.lit(True))
    return listed.filter(ok).groupBy("symbol").agg(F.min("name").alias("name"), F.min("list_date").alias("list_date"))


def restrict(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Rows whose symbol is on the list, by trimmed upper case."""
    wanted = watchlist.select(F.upper(F.trim("symbol")).alias("_w")).distinct()
    return df.join(wanted, F.upper(F.trim(df["symbol"])) == F.col("_w"), "left_semi")


def liquid(bars: DataFrame, n: int = 30, least: float = 1e7, listed: DataFrame | None = None, as_of: str | Column | None = None, min_age: int = 500) -> DataFrame:
    """Symbols whose mean amount over the last n bars is large enough; of ``listed`` (symbol, name, list_date) those without
    ST or * in the name that have been listed for ``min_age`` days as of a date."""
    back = Window.partitionBy(*KEY).orderBy(F.col("datetime").desc())
    last = bars.withColumn("_b", F.row_number().over(back)).filter(F.col("_b") <= n)
    out = last.groupBy("symbol").agg(F.avg("amount").alias("mean_amount")).filter(F.col("mean_amount") >= least)
    if listed is None:
        return out
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    plain = ~F.coalesce(F.col("name").contains("ST") | F.col("name").contains("*"), F.lit(False))
    old = F.coalesce(F.datediff(day, "list_date") >= min_age, F.lit(False))
    return out.join(listed.filter(plain & old).select("symbol").distinct(), "symbol", "left_semi")


def fix_turnover(df: DataFrame) -> DataFrame:
    """Turnover in percent: symbols whose largest rate is at most 1 have fractions, which are scaled."""
    top = F.max(F.abs("turnover_rate")).over(Window.partitionBy("symbol"))
    return df.withColumn("_top", top).withColumn("turnover_rate", F.when(F.col("_top") <= 1, F.col("turnover_rate") * 100).otherwise(F.col("turnover_rate"))).drop("_top")


def latest_fundamentals(reports: DataFrame, order: list[str]) -> DataFrame:
    """The last report of each symbol; a missing or zero return on equity falls back to the diluted one."""
    rest = [c for c in reports.columns if c != "symbol"]
    last = reports.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select("symbol", "s.*")
    return last.withColumn("roe", F.coalesce(F.nullif(F.col("roe"), F.lit(0).cast(reports.schema["roe"].dataType)), "roe_diluted"))


def daily_basics(bars: DataFrame, per_share: DataFrame) -> DataFrame:
    """A15 of the last bar: volume against the five bars before, price to earnings and to book (null for none or zero), and the
    market value of the outstanding shares in units of 10,000, as far as ``per_share`` has eps, bps and shares."""
    before = by_time().rowsBetween(-5, -1)
    mean = F.when(F.count("volume").over(before) == 5, F.avg("volume").over(before))
    rows = latest(bars.withColumn("volume_ratio", F.col("volume") / F.nullif(mean, F.lit(0.0))))
    rows = rows.join(per_share, "symbol", "left").withColumn("pe", F.col("close") / F.nullif(F.col("eps"), F.lit(0.0)))
    has = lambda c, value: value if c in per_share.columns else F.lit(None).cast("double")
    return rows.withColumns({"pb": has("bps", F.col("close") / F.nullif(F.col("bps"), F.lit(0.0))), "total_mv": has("shares", F.col("close") * F.nullif(F.col("shares"), F.lit(0.0)) / 10000)})


def month_days(bars: DataFrame) -> DataFrame:
    day = F.to_date("datetime")
    return bars.groupBy(F.trunc(day, "month").alias("month")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def trade_days(bars: DataFrame) -> DataFrame:
    """The calendar as a table of ordinals (day, n from 1): n days back is an equi-join on n. It has one row a day."""
    days = bars.select(F.to_date("datetime").alias("day")).distinct()
    return days.withColumn("n", F.row_number().over(Window.orderBy("day")))


def listing_cutoff(days: DataFrame, n: int = 120) -> DataFrame:
    """The n-th last trade day (day, n of ``trade_days``); of a shorter calendar the last day less n * 7 / 5 + 30 days."""
    last = days.agg(F.max("n").alias("_n"), F.max("day").alias("_day"), F.max_by("day", "n").alias("_last"))
    found = last.join(days.select("day", (F.col("n") + n - 1).alias("_n")), "_n", "left")
    return found.filter("_day is not null").select(F.coalesce("day", F.date_sub("_last", int(n * 7 / 5) + 30)).alias("day"))


def on_trade_days(rows: DataFrame, days: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows within the sessions of a trade day, so not on holidays."""
    known = days.select(F.col("day").alias("_day"))
    return rows.filter(in_session(F.col(ts))).join(known, F.to_date(rows[ts]) == F.col("_day"), "left_semi")


def in_session(ts: Column) -> Column:
    """A weekday within the morning or afternoon session, ends included."""
    clock = F.date_format(ts, "HH:mm:ss")
    inside = [clock.between(a, b) for a, b in SESSIONS]
    return (F.weekday(ts) < 5) & (inside[0] | inside[1])


def resample_sessions(bars: DataFrame, target: int, source: int, sessions=SESSIONS) -> DataFrame:
    """Longer bars aligned to sessions, of end-stamped closed bars; incomplete ones are left out.

    A bar belongs to the bucket that its whole minutes since the session's start fall in; the result is stamped with
    the bucket's end. One aggregation with partial results.
    """
    if target % source:
        raise ValueError("the target must be a multiple of the source")
    clock = F.date_format("datetime", "HH:mm:ss")
    start = F.coalesce(*[F.when((clock > a) & (clock <= b), F.to_timestamp(F.concat(F.date_format("datetime", "yyyy-MM-dd "), F.lit(a)))) for a, b in sessions])
    elapsed = F.floor((F.unix_timestamp("datetime") - F.unix_timestamp("_start")) / 60)
    rows = bars.filter("is_closed").withColumn("_start", start).filter("_start is not null")
    rows = rows.withColumn("_bucket", F.greatest(F.floor((F.greatest(elapsed, F.lit(1)) - 1) / target), F.lit(0)))
    rows = rows.withColumn("_end", F.timestamp_seconds(F.unix_timestamp("_start") + (F.col("_bucket") + 1) * target * 60))
    out = rows.groupBy("symbol", "_end").agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("_n"), F.max("datetime").alias("_last"),
    )
    out = out.filter((F.col("_n") >= target // source) & (F.col("_last") >= F.col("_end")))
    return out.select("symbol", F.lit(f"{target}m").alias("timeframe"), F.col("_end").alias("datetime"), "open", "high", "low", "close", "volume", "amount", F.lit(True).alias("is_closed"))


def lattice(minute_bars: DataFrame, frames: tuple[str, ...] = ("1m", "5m", "15m", "30m", "60m", "120m", "1d")) -> DataFrame:
    """Bars of several timeframes, aligned to the clock and stamped with their end, of end-stamped minute bars.

    Bars merge as they are (first open, extremes, last close, sums), so each minute bar goes to its bucket of every
    timeframe at once. Buckets lie within days: input that is partitioned by (symbol, day) is not shuffled again.
    """
    minutes = MINUTES | {"1d": 1440}
    end = F.unix_timestamp("datetime")
    targets = F.array(*[F.struct(F.lit(t).alias("timeframe"), (F.ceil(end / (minutes[t] * 60)) * minutes[t] * 60).alias("end")) for t in frames])
    rows = minute_bars.filter("is_closed").select("symbol", F.to_date(F.timestamp_seconds(end - 1)).alias("day"), "datetime", "open", "high", "low", "close", "volume", "amount", F.explode(targets).alias("t"))
    out = rows.groupBy("symbol", "day", F.col("t.timeframe").alias("timeframe"), F.col("t.end").alias("end")).agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )
    return out.select("symbol", "timeframe", F.timestamp_seconds("end").alias("datetime"), "open", "high", "low", "close", "volume", "amount", F.lit(True).alias("is_closed"))


def with_fallback(direct: DataFrame, derived: DataFrame, least: int = 40) -> DataFrame:
    """Direct bars, and derived ones of (symbol, timeframe) without any, if there are enough."""
    enough = derived.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*KEY)
    extra = derived.join(direct.select(*KEY).distinct(), KEY, "left_anti").join(enough, KEY, "left_semi")
    return direct.withColumn("source_mode", F.lit("direct")).unionByName(extra.withColumn("source_mode", F.lit("resampled")))


def history_meta(bars: DataFrame, requested: int = 300) -> DataFrame:
    n = F.count(F.lit(1))
    return bars.groupBy(*KEY).agg(n.alias("bar_count")).select(*KEY, "bar_count", F.lit(requested).alias("requested"), (F.col("bar_count") >= requested).alias("history_complete"), F.when(F.col("bar_count") < requested, F.concat(F.lit("only "), "bar_count", F.lit(" bars"))).alias("warning"))


def intraday_summary(bars: DataFrame) -> DataFrame:
    """Of each symbol's last day: volume-weighted price, and change from the first open to the last close."""
    day = F.to_date("datetime")
    last = bars.withColumn("_last", F.max(day).over(Window.partitionBy("symbol"))).filter(day == F.col("_last"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    weight = F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    first, end = F.min_by("open", "datetime"), F.max_by("close", "datetime")
    out = last.groupBy("symbol").agg(F.sum("amount").alias("a"), F.sum(F.col("volume") * 100).alias("v"), F.sum(typical * weight).alias("t"), F.sum(weight).alias("w"), first.alias("first"), end.alias("end"))
    vwap = F.when((F.col("a") != 0) & (F.col("v") > 0), F.col("a") / F.col("v"))  # an amount has the sign of its prices
    return out.select("symbol", F.coalesce(vwap, F.col("t") / F.col("w")).alias("vwap"), F.when(F.col("first") == 0, 0.0).otherwise((F.col("end") - F.col("first")) / F.col("first")).alias("change"))


def adx_trend(bars: DataFrame) -> DataFrame:
    """Per symbol's last bar: adx and the trend it gives with the averages of 50 and 200 bars."""

    def run(pdf):
        pdf = pdf.sort_values("datetime", kind="stable")
        return pdf.assign(adx=kernels.wilder_adx(*(pdf[c].to_numpy() for c in ("high", "low", "close"))))

    schema = T.StructType([*bars.schema.fields, T.StructField("adx", T.DoubleType())])
    df = latest(with_averages(bars.groupBy(*KEY).applyInPandas(run, schema)))
    strong = F.col("adx") > 25
    trend = F.when(strong & (F.col("ma50") > F.col("ma200") * 1.02), "up").when(strong & (F.col("ma50") < F.col("ma200") * 0.98), "down").otherwise("sideways")
    return df.select("symbol", F.round("adx", 6).alias("adx"), trend.alias("trend"))
