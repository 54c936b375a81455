"""Logical market tables derived from the driver's star schema, and readers and writers for bars.

Prices are an integer walk, exact in any engine: each line item moves its supplier's price by -100..100 cents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ["symbol", "timeframe", "datetime", "open", "high", "low", "close", "volume", "amount", "is_closed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk(moves: DataFrame, order: list[str], value: str, part: Column | None = None, step_mod: int = 201) -> DataFrame:
    """Add ``step`` and ``cents``: a walk per symbol from 10000 cents, in the given order.

    ``part`` cuts the symbols' rows into pieces that follow each other in that order (days, say), for symbols with more
    rows than one task should hold: each piece is summed by itself, from the sum of those before it.
    """
    step = F.pmod(F.round(F.col(value) * 100).cast("long"), F.lit(step_mod)) - step_mod // 2
    moves = moves.withColumn("step", step)
    if part is None:
        over = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return moves.withColumn("cents", F.sum("step").over(over) + 10000)
    moves = moves.withColumn("_part", part)
    upto = Window.partitionBy("of").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = moves.groupBy(F.col("symbol").alias("of"), F.col("_part").alias("piece")).agg(F.sum("step").alias("total"))
    sums = sums.withColumn("so_far", F.coalesce(F.sum("total").over(upto), F.lit(0)))
    within = Window.partitionBy("symbol", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.withColumn("cents", F.sum("step").over(within))
    joined = moves.join(sums, moves["symbol"].eqNullSafe(sums["of"]) & moves["_part"].eqNullSafe(sums["piece"]))
    return joined.withColumn("cents", F.col("cents") + F.col("so_far") + 10000).drop("_part", "of", "piece", "total", "so_far")


def bars_of(moves: DataFrame, order: list[str], at: str, timeframe: str) -> DataFrame:
    """Roll a walk up to bars by symbol and ``at``: one aggregation, whose partial results combine before the shuffle. An order
    of one number needs no sort, as its aggregates are kept in a hash table."""
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    before = F.col("cents") - F.col("step")
    return moves.groupBy("symbol", F.col(at).cast("timestamp").alias("datetime")).agg(
        (F.min_by(before, key) / 100.0).alias("open"),
        (F.max(F.greatest("cents", before)) / 100.0).alias("high"),
        (F.min(F.least("cents", before)) / 100.0).alias("low"),
        (F.max_by("cents", key) / 100.0).alias("close"),
        F.sum("qty").cast("double").alias("volume"),
        F.sum(F.col("cents") * F.col("qty")).cast("double").alias("amount"),
    ).select("symbol", F.lit(timeframe).alias("timeframe"), "datetime", "open", "high", "low", "close", "volume", "amount", F.lit(True).alias("is_closed"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier from ``lineitem``."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    moves = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), *order, "l_extendedprice", F.col("l_quantity").cast("long").alias("qty"))
    # numbered in the order of the walk: the bars are built by hash, without a second sort
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(*order))
    moves = walk(moves, order, "l_extendedprice").withColumns({"day": F.to_date("l_shipdate"), "place": place})
    return bars_of(moves, ["place"], "day", "1d")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by event type from ``events``; there are few types, so the walk goes by day."""
    moves = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(1).cast("long").alias("qty"))
    return walk(moves, ["ts", "event_id"], "value", part=F.to_date("ts"))


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-stamped 60-minute bars of the ticks."""
    t = ticks(spark, sf_dir).withColumn("end", F.date_trunc("hour", "ts") + F.expr("interval 1 hour"))
    return bars_of(t, ["ts", "event_id"], "end", "60m")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-stamped 1-minute bars of the ticks."""
    t = ticks(spark, sf_dir).withColumn("end", F.date_trunc("minute", "ts") + F.expr("interval 1 minute"))
    return bars_of(t, ["ts", "event_id"], "end", "1m")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index series: per day the mean of the symbols' closes, summed in cents."""
    cents = F.round(F.col("close") * 100).cast("long")
    return daily_bars(spark, sf_dir).groupBy("datetime").agg(
        (F.sum(cents) / 100.0 / F.count(F.lit(1))).alias("close"), F.sum("volume").alias("volume")
    ).select(F.lit("INDEX").alias("symbol"), F.lit("1d").alias("timeframe"), "datetime", "close", "volume")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios by supplier: fixed arithmetic on the key and the balance."""
    k = F.col("s_suppkey")
    part = lambda a, m: F.pmod(k * a, F.lit(m)).cast("double")
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("industry"),
        (part(7, 25) + 1.5).alias("roe"), (part(13, 80) + 10).alias("debt_ratio"), (part(11, 45) - 3.5).alias("pe"),
        (part(17, 600) + 20).alias("market_cap"), (part(5, 50) / 10).alias("avg_turnover"), (part(29, 60) + 5).alias("gross_margin"),
        (F.col("s_acctbal") / 10000).alias("profit_growth"), (part(19, 200) / 100).alias("ocf_to_profit"), (part(3, 12) / 100).alias("rd_ratio"),
        (part(23, 40) / 10 + 0.5).alias("pb"), (part(31, 90) / 10 + 0.2).alias("ps"),
        part(37, 100).alias("receivables"), (part(41, 140) + 20).alias("cash"), part(43, 30).alias("interest"), (part(47, 120) - 10).alias("net_profit"), part(53, 110).alias("cash_flow"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per customer with orders: symbol, shares, cost."""
    suppliers = table(spark, sf_dir, "supplier").count()
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    return per.select(
        F.col("o_custkey").alias("account"), F.pmod("o_custkey", F.lit(suppliers)).cast("string").alias("symbol"),
        (F.col("n") * 100).alias("shares"), (F.pmod(F.col("last"), F.lit(6000)) / 100.0 + 70).alias("cost"), F.pmod("last", F.lit(90)).cast("int").alias("holding_days"),
    )


BAR_SCHEMA = "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, amount double, is_closed boolean"


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder for one run below spark.checkpoint.dir, which all machines share; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-barloom-")
    return f"{base.rstrip('/')}/barloom-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows written to a folder of this run and read again, and the folder: a result that several branches use is made once."""
    path = run_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, path: str, schema: str = BAR_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """Rows from Parquet, CSV or JSON lines with a given schema. Lines of CSV and JSON that do not fit it keep their text
    in ``_corrupt`` (null for whole ones), with what could be read."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = (), only_touched: bool = False) -> None:
    """A result table as Parquet, CSV (with header) or JSON lines, partitioned by run or date. Replaces the table that was
    there, or with ``only_touched`` the partitions that the rows have."""
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_touched else "static")
    (writer.partitionBy(*by) if by else writer).save(path)


#: The columns of a trades file, in order: fixed values.
TRADE_COLUMNS = [
    "run_id", "ts_code", "entry_time", "exit_time", "side", "entry_price", "exit_price", "shares", "holding_days", "pnl", "pnl_ratio", "regime", "strategy_name", "entry_reason", "exit_reason",
]
TRADES = "run_id string, ts_code string, entry_time string, exit_time string, side string, entry_price double, exit_price double, shares long, holding_days int, pnl double, pnl_ratio double, regime string, strategy_name string, entry_reason string, exit_reason string"


def trade_records(trades: DataFrame, run_id: str) -> DataFrame:
    """Closed trades as records of the fixed columns; what is missing falls back to 0, unknown, LONG or an empty text."""
    empty = {"side": "LONG", "regime": "unknown", "strategy_name": "unknown", "entry_reason": "", "exit_reason": ""}
    kinds = dict(x.split() for x in TRADES.split(", "))
    out = []
    for c in TRADE_COLUMNS:
        value = F.lit(run_id) if c == "run_id" else F.col(c) if c in trades.columns else F.lit(None)
        default = F.lit(empty[c]) if c in empty else F.lit(0) if kinds[c] in ("double", "long", "int") else F.lit(None)
        text = F.nullif(value.cast("string"), F.lit("")) if c in ("side", "regime", "strategy_name") else value
        out.append(F.coalesce(text, default).cast(kinds[c]).alias(c))
    return trades.select(*out)
