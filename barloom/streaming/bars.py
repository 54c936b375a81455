"""Streaming bars: session buckets, incremental MACD, deduplicated events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import SESSIONS

STATE = "n int, e12 double, e26 double, dea double, dif0 double, dea0 double, at long"
_FIELDS = [(x.split()[0], float if x.endswith("double") else int) for x in STATE.split(", ")]
ALERT = "symbol string, timeframe string, datetime timestamp, close double, dif double, dea double, golden_cross boolean, death_cross boolean"


def stream_hours(ticks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hour bars of ticks (symbol, ts, price, qty), stamped with their end; late ticks beyond the watermark are dropped.

    The bucket is (start, end]-free: ticks are cut by hour and the bar is emitted once the watermark passes its end.
    """
    t = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 hour"))
    out = t.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"))
    return out.select("symbol", F.col("window.end").alias("datetime"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, target: int = 60, source: int = 30, delay: str = "10 minutes", sessions=SESSIONS) -> DataFrame:
    """Bars of ``target`` minutes aligned to trading sessions, of ticks (symbol, ts, price, qty).

    A tick belongs to the bucket whose end is the watermarked key, so a bar comes once the watermark passes that end. Bars with
    a stretch of ``source`` minutes without ticks are incomplete and left out; later ticks are dropped and counted by Spark.
    """
    if target % source:
        raise ValueError("the target must be a multiple of the source")
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    start = F.coalesce(*[F.when((clock > a) & (clock <= f"{z}.000000"), F.unix_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd "), F.lit(a)))) for a, z in sessions])
    rows = ticks.withColumn("_start", start).filter("_start is not null")
    minute = (F.unix_micros("ts") - F.col("_start") * 1_000_000) / 60_000_000  # above 0, up to the session's length
    bucket = F.ceil(minute / target).cast("long")
    slot = F.ceil(minute / source).cast("long") - 1 - (bucket - 1) * (target // source)
    rows = rows.withColumn("end", F.timestamp_seconds(F.col("_start") + bucket * target * 60)).withColumn("_slot", F.call_function("shiftleft", F.lit(1), slot.cast("int")))
    out = rows.withWatermark("end", delay).groupBy("symbol", "end").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"), F.bit_or("_slot").alias("_slots")
    )
    complete = out.filter(F.col("_slots") == (1 << (target // source)) - 1)
    return complete.select("symbol", F.lit(f"{target}m").alias("timeframe"), F.col("end").alias("datetime"), "open", "high", "low", "close", "volume")


def _advance(state: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """The state after these bars, and a row for each. Bars that are not after the last one seen change nothing."""
    n, e12, e26, dea, last_dif, last_dea, last_at = state or (0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    rows = []
    blend = lambda old, x, span: ((1 - 2 / (span + 1)) * old + 2 / (span + 1) * x)
    pdf = pdf.sort_values("datetime", kind="stable")
    for at, close in zip(pdf["datetime"], pdf["close"], strict=True):
        micros = pd.Timestamp(at).value // 1000
        if last_at is not None and micros <= last_at:
            continue
        n += 1
        e12, e26 = (close, close) if n == 1 else (blend(e12, close, 12), blend(e26, close, 26))
        dif = e12 - e26
        dea = dif if n <= 26 else blend(dea, dif, 9)
        ready = n > 34
        rows.append((at, close, dif if n >= 26 else None, dea if n >= 34 else None, ready and dif > dea and last_dif <= last_dea, ready and dif < dea and last_dif >= last_dea))
        last_dif, last_dea, last_at = dif, dea, micros
    return (n, e12, e26, dea, last_dif, last_dea, last_at), rows


class MacdProcessor(StatefulProcessor):
    """One value a key, in the session's state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("macd", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = _advance(self.state.get(), pd.concat(list(rows)))
        self.state.update(state)
        yield pd.DataFrame([(*key, *r) for r in out], columns=[x.split()[0] for x in ALERT.split(", ")])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        self.state.update(tuple(kind(first[name]) for name, kind in _FIELDS))

    def close(self) -> None:
        pass


def macd_state(bars: DataFrame) -> DataFrame:
    """What ``stream_macd`` would hold after these bars, by symbol and timeframe; its initial state."""

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_advance(None, pdf)[0])], columns=["symbol", "timeframe", *(name for name, _ in _FIELDS)])

    return bars.select("symbol", "timeframe", "datetime", "close").groupBy("symbol", "timeframe").applyInPandas(last, f"symbol string, timeframe string, {STATE}")


def stream_macd(bars: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """MACD and crosses bar by bar, going on from the bars of ``history`` if given; bars of a key come in time order.

    The state of a symbol and timeframe is seven numbers. Needs the RocksDB state store (``rocksdb`` sets it while a query starts).
    """
    first = None if history is None else macd_state(history).groupBy("symbol", "timeframe")
    rows = bars.select("symbol", "timeframe", "datetime", "close").groupBy("symbol", "timeframe")
    return rows.transformWithStateInPandas(MacdProcessor(), ALERT, "append", "none", first)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, whatever the session says."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def dedup_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there and stop; results go to Parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
