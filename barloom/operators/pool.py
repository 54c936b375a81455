"""Event log, deliveries and candidate pool as table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.symbols import event_id
from barloom.operators.screening import TIMEFRAMES, by_timeframe


def with_event_id(events: DataFrame) -> DataFrame:
    """H01."""
    return events.withColumn("event_id", event_id("symbol", "timeframe", "signal_type", "side", "confirmed_at"))


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """The new events that the log does not have, once each (the earliest by ``created_at``)."""
    one = new.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "event_id"]), F.struct("created_at")).alias("s")).select("event_id", "s.*")
    return one.join(log.select("event_id"), "event_id", "left_anti")


def deliveries(events: DataFrame, channels: list[str]) -> DataFrame:
    """One pending delivery per event and channel."""
    return events.select("event_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"), "created_at", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def pending(outbox: DataFrame, events: DataFrame, now: str, limit: int, most: int = 5) -> DataFrame:
    """Due deliveries with their events, the oldest first."""
    due = outbox.filter((F.col("status") == "pending") & (F.col("attempts") < most) & (F.col("next_attempt") <= F.lit(now).cast("timestamp")))
    return due.join(events.drop("created_at"), "event_id").orderBy("created_at", "channel", "event_id").limit(limit)


def failed(outbox: DataFrame, most: int = 5) -> DataFrame:
    """One more attempt; failed at the limit, else due again after 2^n seconds, an hour at most."""
    n = F.col("attempts") + 1
    return outbox.withColumns({"attempts": n, "status": F.when(n >= most, "failed").otherwise("pending"), "backoff": F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.least(n, F.lit(10))))})


def outbox_summary(outbox: DataFrame) -> DataFrame:
    """H09."""
    return outbox.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "sent", "failed")], F.count_distinct("event_id").alias("events"))


def upsert(pool: DataFrame, new: DataFrame, capacity: int = 100) -> DataFrame:
    """New rows win; the best ``capacity`` by score, then the latest."""
    both = pool.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    rest = [c for c in pool.columns if c != "symbol"]
    merged = both.groupBy("symbol").agg(F.max_by(F.struct(*rest), "_n").alias("s")).select("symbol", "s.*")
    return merged.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "symbol").limit(capacity)


def sync(pool: DataFrame, new: DataFrame, capacity: int = 100) -> tuple[DataFrame, DataFrame]:
    """The new pool, and the symbols that dropped out of it."""
    best = new.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "symbol").limit(capacity)
    gone = pool.join(best.select("symbol"), "symbol", "left_anti").withColumn("reason", F.lit("no_longer_qualified"))
    return best, gone


def split_expired(pool: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Active and expired rows."""
    old = F.col("expires_on") < F.lit(today).cast("date")
    return pool.filter(~F.coalesce(old, F.lit(False))), pool.filter(old).withColumn("reason", F.lit("expired"))


def monitored(holdings: DataFrame, watchlist: DataFrame, candidates: DataFrame) -> DataFrame:
    """Symbols by the first list that has them."""
    lists = [x.select("symbol").withColumn("priority", F.lit(i)) for i, x in enumerate((holdings, watchlist, candidates))]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("symbol").agg(F.min("priority").alias("priority"))


def ranked_events(events: DataFrame, per_symbol: int = 1, *ties: Column) -> DataFrame:
    """The best events of each symbol by weighted score, then the latest, then by ``ties`` (the event id if none)."""
    by = Window.partitionBy("symbol").orderBy((F.col("score") * F.col("weight")).desc(), F.col("confirmed_at").desc(), *(ties or ["event_id"]))
    return events.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= per_symbol).drop("r")


def timeframe_events(df: DataFrame, buy_limit: int = 60, sell_limit: int = 60) -> DataFrame:
    """H02 for every scored bar and side: an event per fresh point, else one for the cross if the score reaches its limit.

    symbol, timeframe, side, signal_type, components (the point, then the cross), level (strong from the limit on), score,
    weight (of the timeframe), price, confirmed_at.
    """
    crossed = {"buy": F.when(F.col("golden_cross"), F.concat(F.lit("macd_golden_cross_"), "zone")), "sell": F.when(F.col("death_cross") & (F.col("zone") == "near"), F.lit("zero_axis_death_cross"))}
    of = lambda side: F.transform(F.filter("fresh", lambda p: p["side"] == side), lambda p: p["type"])
    sides = []
    for side, limit in (("buy", buy_limit), ("sell", sell_limit)):
        points, score = of(side), F.col(f"{side}_score")
        lone = F.when(crossed[side].isNotNull() & (score >= limit), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
        level = F.when(score >= limit, "strong").otherwise("structure")
        sides.append(F.struct(F.lit(side).alias("side"), score.alias("score"), level.alias("level"), crossed[side].alias("crossed"), F.when(F.size(points) > 0, points).otherwise(lone).alias("points")))
    rows = df.select("symbol", "timeframe", "close", "datetime", F.explode(F.array(*sides)).alias("s")).select("symbol", "timeframe", "close", "datetime", "s.*").withColumn("point", F.explode("points"))
    weight = F.coalesce(by_timeframe(TIMEFRAMES), F.lit(1))
    return rows.select("symbol", "timeframe", "side", F.coalesce("point", "crossed").alias("signal_type"), F.array_compact(F.array("point", "crossed")).alias("components"), "level", "score", weight.alias("weight"), F.col("close").alias("price"), F.col("datetime").alias("confirmed_at"))


def current(events: DataFrame, expected: str, least: int = 0) -> DataFrame:
    """Events confirmed on the expected trade date or later, with enough score."""
    return events.filter((F.col("confirmed_at") >= expected) & (F.col("score") >= least))
