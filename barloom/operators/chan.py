"""Price structure: merged bars, fractals, strokes, centers, buy and sell points; divergences and traps.

The scans that need state run as one kernel call per key (merged bars to strokes, strokes to centers); the rest are
windows and equi-joins on (symbol, timeframe).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import batches, kernels
from barloom.operators.indicators import KEY, above, by_time, carried, confirmations, crosses, lag, line_columns, line_fields, sides, trailing, volume_ratios, with_columns

MERGED = "symbol string, timeframe string, idx int, first_row int, last_row int, datetime timestamp, open double, high double, low double, close double, volume double, amount double"


def merged_bars(bars: DataFrame) -> DataFrame:
    """Bars without inclusion, by a kernel over whole keys."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        high, low = batches.doubles(table, "high"), batches.doubles(table, "low")
        keys = list(zip(starts.tolist(), np.append(starts[1:], len(table)).tolist(), strict=True))
        merged = [kernels.merge_bars(high[i:j], low[i:j]) for i, j in keys]
        base = np.repeat(starts, [len(m[0]) for m in merged])
        a, b, hi, lo = (np.concatenate(x) for x in zip(*merged, strict=True))
        pick = lambda c, i: table.column(c).take(pa.array(base + i))
        total = lambda c: batches.nullable(np.add.reduceat(np.nan_to_num(batches.doubles(table, c)), base + a))
        whole = lambda x: pa.array(x, pa.int32())
        return pa.table({
            "symbol": pick("symbol", a), "timeframe": pick("timeframe", a), "idx": whole(np.concatenate([np.arange(len(m[0])) for m in merged])), "first_row": whole(a), "last_row": whole(b), "datetime": pick("datetime", b),
            "open": pick("open", a), "high": batches.nullable(hi), "low": batches.nullable(lo), "close": pick("close", b), "volume": total("volume"), "amount": total("amount"),
        })

    return batches.map_keys(bars, run, MERGED, KEY, "datetime")


def fractals(merged: DataFrame) -> DataFrame:
    """Strict tops and bottoms of three merged bars; of consecutive ones of a kind the most extreme, the earliest of equals."""
    by = Window.partitionBy(*KEY).orderBy("idx")
    side = lambda c, n: F.lag(c, n).over(by)
    h, w = F.col("high"), F.col("low")
    top = (h > side("high", 1)) & (h > side("high", -1)) & (w > side("low", 1)) & (w > side("low", -1))
    bottom = (w < side("low", 1)) & (w < side("low", -1)) & (h < side("high", 1)) & (h < side("high", -1))
    found = merged.select(*KEY, "idx", F.when(top, "top").when(bottom, "bottom").alias("kind"), F.when(top, h).otherwise(w).alias("price"), "datetime", side("datetime", -1).alias("confirmed_at")).filter("kind is not null")
    new = F.when(F.coalesce(F.col("kind") != F.lag("kind").over(by), F.lit(True)), 1).otherwise(0)
    island = found.withColumn("_new", new).withColumn("island", F.sum("_new").over(by))
    rank = F.struct(F.when(F.col("kind") == "top", -F.col("price")).otherwise(F.col("price")).alias("r"), F.col("idx").alias("i"))
    best = island.groupBy(*KEY, "island", "kind").agg(F.min_by(F.struct("idx", "price", "datetime", "confirmed_at"), rank).alias("s"))
    return best.select(*KEY, "kind", "s.*")


STROKES = "symbol string, timeframe string, idx int, start_index int, end_index int, direction string, start_price double, end_price double, high double, low double, start_time timestamp, end_time timestamp, confirmed_at timestamp"


def strokes(points: DataFrame, gap: int = 4) -> DataFrame:
    """Strokes between alternating fractals, by a kernel over whole keys."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        idx, top, price = table.column("idx").to_numpy(), pc.equal(table.column("kind"), "top").to_numpy(), batches.doubles(table, "price")
        keys = zip(starts.tolist(), np.append(starts[1:], len(table)).tolist(), strict=True)
        ends = [i + np.array(kernels.stroke_ends(idx[i:j], top[i:j], price[i:j], gap), int) for i, j in keys]
        a, z = np.concatenate([e[:-1] for e in ends]), np.concatenate([e[1:] for e in ends])
        pick = lambda c, i: table.column(c).take(pa.array(i))
        whole = lambda x: pa.array(x, pa.int32())
        return pa.table({
            "symbol": pick("symbol", a), "timeframe": pick("timeframe", a), "idx": whole(np.concatenate([np.arange(len(e) - 1) for e in ends])), "start_index": whole(idx[a]), "end_index": whole(idx[z]),
            "direction": pa.array(np.where(top[a], "down", "up"), pa.string()), "start_price": price[a], "end_price": price[z], "high": np.maximum(price[a], price[z]),
            "low": np.minimum(price[a], price[z]), "start_time": pick("datetime", a), "end_time": pick("datetime", z), "confirmed_at": pick("confirmed_at", z),
        })

    return batches.map_keys(points, run, STROKES, KEY, "idx")


def with_macd_area(lines: DataFrame, macd: DataFrame) -> DataFrame:
    """The sum of histogram bars of the stroke's sign between its ends: prefix sums joined at both ends."""
    h = F.coalesce("hist", F.lit(0.0))
    up, down = F.greatest(h, F.lit(0.0)), F.greatest(-h, F.lit(0.0))
    sums = macd.select(*KEY, "datetime", F.sum(up).over(by_time()).alias("u"), F.sum(down).over(by_time()).alias("d"), up.alias("ui"), down.alias("di"))
    start = sums.select(*KEY, F.col("datetime").alias("start_time"), (F.col("u") - F.col("ui")).alias("u0"), (F.col("d") - F.col("di")).alias("d0"))
    end = sums.select(*KEY, F.col("datetime").alias("end_time"), F.col("u").alias("u1"), F.col("d").alias("d1"))
    joined = lines.join(start, [*KEY, "start_time"], "left").join(end, [*KEY, "end_time"], "left")
    area = F.when(F.col("direction") == "up", F.col("u1") - F.col("u0")).otherwise(F.col("d1") - F.col("d0"))
    return joined.withColumn("macd_area", F.coalesce(F.greatest(F.round(area, 9), F.lit(0.0)), F.lit(0.0))).drop("u0", "u1", "d0", "d1")


def in_order():
    return Window.partitionBy(*KEY).orderBy("idx")


def locked(lines: DataFrame) -> DataFrame:
    """All strokes but the last, each confirmed when the next one is."""
    return lines.withColumn("confirmed_at", F.lead("confirmed_at").over(in_order())).filter("confirmed_at is not null")


CENTERS = "symbol string, timeframe string, idx int, start_stroke int, end_stroke int, zd double, zg double, low double, high double"


def centers(lines: DataFrame) -> DataFrame:
    """Stretches of overlapping strokes, by one kernel call per key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable", ignore_index=True)
        spans = kernels.center_spans(pdf["low"].to_numpy(), pdf["high"].to_numpy())
        out = pd.DataFrame(spans, columns=["start_stroke", "end_stroke", "zd", "zg", "low", "high"])
        return out.assign(symbol=pdf["symbol"].iloc[0], timeframe=pdf["timeframe"].iloc[0], idx=np.arange(len(spans)))[[x.split()[0] for x in CENTERS.split(", ")]]

    return lines.groupBy(*KEY).applyInPandas(run, CENTERS)


def with_center(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Each stroke with the latest center that ended before it: union and forward fill, no range join."""
    z = zones.select(*KEY, (F.col("end_stroke") + 1).alias("idx"), F.struct("idx", "zd", "zg").alias("z"))
    s = lines.select(*KEY, "idx", F.struct(*[c for c in lines.columns if c not in KEY]).alias("s"))
    both = z.withColumn("o", F.lit(0)).unionByName(s.withColumn("o", F.lit(1)), allowMissingColumns=True)
    fill = Window.partitionBy(*KEY).orderBy("idx", "o").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("c", F.last("z", ignorenulls=True).over(fill)).filter("s is not null")
    return filled.select(*KEY, "s.*", F.col("c.zd").alias("zd"), F.col("c.zg").alias("zg"))


def turning_points(lines: DataFrame) -> DataFrame:
    """Type-1 points (a new extreme with less force beyond the center) and the type-2 points two strokes later."""
    prev = lambda c: F.lag(c, 2).over(in_order())
    weaker = (F.col("direction") == prev("direction")) & (prev("macd_area") > 0) & (F.col("macd_area") < prev("macd_area") * 0.9)
    buy = weaker & (F.col("direction") == "down") & (F.col("low") < prev("low")) & (F.col("end_price") < F.col("zd"))
    sell = weaker & (F.col("direction") == "up") & (F.col("high") > prev("high")) & (F.col("end_price") > F.col("zg"))
    one = lines.withColumn("t1", F.when(buy, "buy_1").when(sell, "sell_1")).withColumn("p1", F.col("end_price"))
    newest = F.last(F.when(F.col("t1").isNotNull(), F.struct(F.col("idx").alias("i"), F.col("t1").alias("t"), F.col("p1").alias("p"), F.col("direction").alias("d"))), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    two = one.withColumn("n", newest)
    due = (F.col("n.i") == F.col("idx") - 2) & (F.col("direction") == F.col("n.d"))
    t2 = F.when(due & (F.col("n.t") == "buy_1") & (F.col("low") >= F.col("n.p")), "buy_2").when(due & (F.col("n.t") == "sell_1") & (F.col("high") <= F.col("n.p")), "sell_2")
    return two.withColumn("t2", t2)


def leaving_points(lines: DataFrame, zones: DataFrame, departure: str = "next_stroke") -> DataFrame:
    """Type-3 points: a stroke leaves the center and the next one does not come back. ``departure`` may also be
    "last_center_stroke": the center's own last stroke is the one that leaves."""
    shift = 1 if departure == "next_stroke" else 0
    z = zones.select(*KEY, (F.col("end_stroke") + shift).alias("idx"), "zd", "zg")
    s = lines.select(*KEY, "idx", F.col("direction").alias("d0"), F.col("end_price").alias("e0"), *[F.lead(c).over(in_order()).alias(f"{c}_1") for c in ("direction", "low", "high", "end_price", "confirmed_at", "idx")])
    j = z.join(s, [*KEY, "idx"])
    buy = (F.col("d0") == "up") & (F.col("e0") > F.col("zg")) & (F.col("direction_1") == "down") & (F.col("low_1") > F.col("zg"))
    sell = (F.col("d0") == "down") & (F.col("e0") < F.col("zd")) & (F.col("direction_1") == "up") & (F.col("high_1") < F.col("zd"))
    return j.withColumn("type", F.when(buy, "buy_3").when(sell, "sell_3")).filter("type is not null").select(*KEY, "type", F.col("idx_1").alias("stroke"), F.col("end_price_1").alias("price"), F.col("confirmed_at_1").alias("confirmed_at"))


STRUCTURE = STROKES + ", locked_at timestamp, macd_area double, center int, center_start int, zd double, zg double, center_low double, center_high double"


def stroke_rows(table: pa.Table, starts: np.ndarray, hist: np.ndarray, gap: int) -> tuple[pa.Table, np.ndarray]:
    """``structure``'s rows of a table of whole keys, and the row of the table at which each stroke is locked (-1 if none)."""
    high, low = batches.doubles(table, "high"), batches.doubles(table, "low")
    keys = list(zip(starts.tolist(), np.append(starts[1:], len(table)).tolist(), strict=True))
    found = [kernels.structure_rows(hist[i:j], high[i:j], low[i:j], gap) for i, j in keys]
    base = np.repeat(starts, [len(f["idx"]) for f in found])
    all_of = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
    head = all_of["idx"] < 0
    at = lambda c: table.column("datetime").take(pa.array(base + all_of[c], mask=all_of[c] < 0))
    whole = lambda c: pa.array(np.nan_to_num(all_of[c]).astype("int32"), mask=np.isnan(all_of[c]))
    price = lambda c: batches.nullable(all_of[c])
    key = lambda c: table.column(c).take(pa.array(base))
    rows = pa.table({
        "symbol": key("symbol"), "timeframe": key("timeframe"), "idx": whole("idx"), "start_index": whole("start_index"), "end_index": whole("end_index"),
        "direction": pa.array(np.where(all_of["up"] > 0, "up", "down"), pa.string(), mask=head), "start_price": price("start_price"), "end_price": price("end_price"), "high": price("high"), "low": price("low"),
        "start_time": at("start_row"), "end_time": at("end_row"), "confirmed_at": at("confirmed_row"), "locked_at": at("locked_row"), "macd_area": price("macd_area"), "center": whole("center"), "center_start": whole("center_start"),
        "zd": price("zd"), "zg": price("zg"), "center_low": price("center_low"), "center_high": price("center_high"),
    })
    return rows, np.where(all_of["locked_row"] < 0, -1, base + all_of["locked_row"])


def structure(bars: DataFrame, gap: int = 4) -> DataFrame:
    """D03 to D08 in one kernel: every stroke with its area, lock time and the center that ends with it.

    The row with idx -1 of each key holds how many bars (start_index), merged bars (end_index) and fractals (center_start)
    it has. Only the columns that the kernel needs are sent to it.
    """

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        hist = kernels.macd_columns(batches.doubles(table, "close"), starts, whole=False)["hist"]
        return stroke_rows(table, starts, hist, gap)[0]

    return batches.map_keys(bars.select(*KEY, "datetime", "high", "low", "close"), run, STRUCTURE, KEY, "datetime")


#: Lines of ``indicators.line_columns`` that crosses, confirmations and scores need, with what they look back at.
CROSSING = [
    "n_rows", "dif", "dea", "hist", "ma5", "ma10", "ma60", "vol20", "vol30", "dif_lag1", "dea_lag1", "hist_lag1", "hist_lag2", "close_lag1", "ma5_lag1", "ma10_lag1", "ma60_lag5",
]


def crossings(bars: DataFrame, gap: int = 4) -> DataFrame:
    """Bars that have a cross or lock a stroke, enriched and with the structure points confirmed at them, as ``with_fresh`` has it: one
    kernel makes lines and strokes of all bars and leaves out the others, so that nothing else runs over them."""
    strokes = T.StructType([f for f in T.StructType.fromDDL(STRUCTURE).fields if f.name not in KEY])
    schema = T.StructType([*[bars.schema[c] for c in (*KEY, "datetime")], T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()), *line_fields(CROSSING), T.StructField("stroke", strokes)])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lines = line_columns(table, starts, CROSSING)
        rows, locked = stroke_rows(table, starts, lines["hist"], gap)
        stroke = np.full(len(table), -1)
        stroke[locked[locked >= 0]] = np.flatnonzero(locked >= 0)
        ahead, before = lines["dif"] - lines["dea"], lines["dif_lag1"] - lines["dea_lag1"]
        keep = np.flatnonzero((ahead > 0) & (before <= 0) | (ahead < 0) & (before >= 0) | (stroke >= 0))
        out = with_columns(table.select([*KEY, "datetime", "close", "volume"]), lines, keep)
        at = stroke[keep]
        of = rows.drop_columns(KEY).take(pa.array(np.maximum(at, 0))).combine_chunks()
        parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in of.columns]
        return out.append_column("stroke", pa.StructArray.from_arrays(parts, fields=list(of.schema), mask=pa.array(at < 0)))

    need = bars.select(*KEY, "datetime", F.col("close").cast("double"), F.col("volume").cast("double"), "high", "low")
    rows = batches.map_keys(need, run, schema, KEY, "datetime")
    rows = sides(confirmations(crosses(volume_ratios(rows), carried), carried), carried).drop(*[c for c in CROSSING if "_lag" in c])
    own = [c for c in rows.columns if c not in (*KEY, "stroke")]
    lines = typed(with_zones(rows.select(*KEY, "stroke.*", F.struct(*own).alias("bar")), "bar"))
    point = lambda t: F.struct(t["type"].alias("type"), side_of(t["type"]).alias("side"), F.col("end_price").alias("price"), F.col("confirmed_at").alias("confirmed_at"), worth_of(t["type"]).alias("worth"))
    return best_fresh(lines.withColumn("fresh", F.array_sort(F.transform("types", point))).select(*KEY, "bar.*", "fresh"))


def locked_strokes(rows: DataFrame) -> DataFrame:
    """D07, D09 of ``structure``'s rows: locked strokes with the latest center (zd, zg) that ended before each."""
    return with_zones(rows.filter("idx >= 0 and locked_at is not null"))


def with_zones(lines: DataFrame, *carry: str) -> DataFrame:
    """Locked strokes with the latest center (zd, zg) that ended before each. Rows without a stroke come first and count as none."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.col("center").isNotNull(), F.struct("zd", "zg"))
    lines = lines.withColumn("_c", F.last(ended, ignorenulls=True).over(before))
    own = F.when(F.col("center").isNotNull(), F.struct("zd", "zg")).alias("own")
    return lines.select(*KEY, *[x.split()[0] for x in STROKES.split(", ")[2:-1]], F.col("locked_at").alias("confirmed_at"), "macd_area", F.col("_c.zd").alias("zd"), F.col("_c.zg").alias("zg"), own, *carry)


def typed(lines: DataFrame, departure: str = "next_stroke") -> DataFrame:
    """Locked strokes with the types of their points (``types``: o, type), windows over strokes, no join."""
    lines = turning_points(lines)
    shift = 2 if departure == "next_stroke" else 1
    of = lambda c, n: F.lag(c, n).over(in_order()) if n else F.col(c)
    left, center = (lambda c: of(c, 1)), of("own", shift)
    buy = (left("direction") == "up") & (left("end_price") > center["zg"]) & (F.col("direction") == "down") & (F.col("low") > center["zg"])
    sell = (left("direction") == "down") & (left("end_price") < center["zd"]) & (F.col("direction") == "up") & (F.col("high") < center["zd"])
    lines = lines.withColumn("t3", F.when(buy, "buy_3").when(sell, "sell_3"))
    types = F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).alias("type")) for c, o in (("t1", 0), ("t2", 0), ("t3", 1))])
    return lines.withColumn("types", F.filter(types, lambda t: t["type"].isNotNull()))


def side_of(kind: Column) -> Column:
    return F.when(kind.startswith("buy"), "buy").otherwise("sell")


def points_of(rows: DataFrame, departure: str = "next_stroke") -> DataFrame:
    """D10 to D13 of ``structure``'s rows: all points of locked strokes, one per type and time."""
    lines = typed(locked_strokes(rows), departure)
    found = lines.select(*KEY, F.explode("types").alias("t"), F.col("idx").alias("stroke"), F.col("end_price").alias("price"), "confirmed_at")
    one = found.groupBy(*KEY, F.col("t.type").alias("type"), "confirmed_at").agg(F.max_by(F.struct("stroke", "price"), F.struct("t.o", "stroke")).alias("s"))
    return one.select(*KEY, "type", side_of(F.col("type")).alias("side"), "s.stroke", "s.price", "confirmed_at")


def chan_signals(bars: DataFrame, gap: int = 4, departure: str = "next_stroke") -> DataFrame:
    """All points of confirmed strokes, one per type and time."""
    return points_of(structure(bars, gap), departure)


def summary(rows: DataFrame, points: DataFrame, n_centers: int = 5, n_strokes: int = 20, n_points: int = 10, least: int = 10) -> DataFrame:
    """By key the counts and the last centers, strokes and points; ``insufficient_data`` for fewer than ``least`` bars.

    The last n of a key are bounded aggregates: ranked by window, kept below n, then collected.
    """
    heads = rows.filter("idx = -1").select(*KEY, F.col("start_index").alias("bars"), F.col("end_index").alias("merged_bars"), F.col("center_start").alias("fractals"))
    lines = rows.filter("idx >= 0 and locked_at is not null")

    def last(df: DataFrame, order: str, n: int, value: Column, name: str) -> DataFrame:
        back = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(order).desc(), F.col("_v").desc()))
        some = df.select(*KEY, order, value.alias("_v")).withColumn("_r", back).filter(F.col("_r") <= n)
        return some.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_v"))), lambda x: x["_v"]).alias(name))

    counts = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("strokes"), F.count("center").alias("centers"))
    parts = [
        counts, points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("points")), last(lines, "idx", n_strokes, F.struct("direction", "end_price"), "latest_strokes"),
        last(lines.filter("center is not null"), "idx", n_centers, F.struct("zd", "zg"), "latest_centers"), last(points, "confirmed_at", n_points, F.struct(F.substring("type", -1, 1).alias("k"), "type", "price"), "latest_points"),
    ]
    for part in parts:
        heads = heads.join(part, KEY, "left")
    enough = F.col("bars") >= least
    out = heads.withColumn("status", F.when(enough, "ok").otherwise("insufficient_data"))
    numbers = {c: F.when(enough, F.coalesce(c, F.lit(0))).otherwise(0).cast("int") for c in ("merged_bars", "fractals", "strokes", "centers", "points")}
    lists = {c: F.when(enough, F.col(c)) for c in ("latest_strokes", "latest_centers", "latest_points")}
    return out.withColumns(numbers | lists)


def worth_of(kind: Column) -> Column:
    """A point's score by its type."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in (("1", 20), ("2", 25), ("3", 30)) for x in pair]), F.substring(kind, -1, 1))


def best_fresh(df: DataFrame) -> DataFrame:
    """The best score of the points ``fresh`` by side."""
    best = lambda s: F.array_max(F.transform(F.filter("fresh", lambda p: p["side"] == s), lambda p: p["worth"]))
    return df.withColumns({"fresh_buy": best("buy"), "fresh_sell": best("sell")})


def with_fresh(bars: DataFrame, points: DataFrame, n: int = 1) -> DataFrame:
    """D15 for every bar: ``fresh``, the points confirmed within its last n bars, and their best score by side (20, 25 or 30 by type).

    Points meet their bar by an equi-join and expire after n rows of the key.
    """
    of = points.groupBy(*KEY, F.col("confirmed_at").alias("datetime")).agg(F.array_sort(F.collect_list(F.struct("type", "side", "price", "confirmed_at", worth_of(F.col("type")).alias("worth")))).alias("_points"))
    none = F.array().cast("array<struct<type:string,side:string,price:double,confirmed_at:timestamp,worth:int>>")
    df = bars.join(of, [*KEY, "datetime"], "left").withColumn("_points", F.coalesce("_points", none))
    df = df.withColumn("fresh", F.flatten(F.collect_list("_points").over(trailing(n))) if n > 1 else F.col("_points")).drop("_points")
    return best_fresh(df)


def fresh_signals(signals: DataFrame, bars: DataFrame, n: int = 1) -> DataFrame:
    """D15 as of the last bar: signals confirmed within the last n bars of their key."""
    back = Window.partitionBy(*KEY).orderBy(F.col("datetime").desc())
    cutoff = bars.withColumn("_b", F.row_number().over(back)).filter(F.col("_b") <= n).groupBy(*KEY).agg(F.min("datetime").alias("_since"))
    return signals.join(cutoff, KEY).filter(F.col("confirmed_at") >= F.col("_since")).drop("_since")


def divergences(df: DataFrame, hist: str = "hist0", lookback: int = 60, carry: list[str] = ()) -> DataFrame:
    """Per key, from the last rows: bullish, bearish or none, by the last two runs of histogram bars of one sign; with columns
    of the key's last row. All from one pass: runs that count for nothing are kept for their rows."""
    back = Window.partitionBy(*KEY).orderBy(F.col("datetime").desc())
    rows = df.select(*KEY, "datetime", "close", F.col(hist).alias("h"), F.struct(F.lit(0).alias("_"), *carry).alias("c")).withColumn("_b", F.row_number().over(back)).filter(F.col("_b") <= lookback).withColumn("i", -F.col("_b"))
    by = Window.partitionBy(*KEY).orderBy("i")
    rows = rows.withColumn("s", F.coalesce(F.signum("h"), F.lit(0.0)).cast("int"))
    rows = rows.withColumn("new", F.when(F.coalesce(F.col("s") != F.lag("s").over(by), F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    at_last = F.max_by("c", "i").alias("c")
    runs = rows.groupBy(*KEY, "run", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("h")).alias("area"), F.min_by("close", F.struct(F.when(F.col("s") < 0, F.col("h")).otherwise(-F.col("h")), F.col("i"))).alias("price"), at_last)
    runs = runs.withColumn("counts", (F.col("s") != 0) & (F.col("n") >= 2))
    last = Window.partitionBy(*KEY, "s", "counts").orderBy(F.col("run").desc())
    runs = runs.withColumn("r", F.when(F.col("counts"), F.row_number().over(last)))
    pick = lambda s, r, c: F.max(F.when((F.col("s") == s) & (F.col("r") == r), F.col(c)))
    sides = [pick(s, r, c).alias(f"{c}{'d' if s < 0 else 'u'}{r}") for s in (-1, 1) for r in (1, 2) for c in ("price", "area")]
    wide = runs.groupBy(*KEY).agg(F.sum("n").alias("rows"), F.max_by("c", "run").alias("c"), *sides)
    bull = (F.col("priced1") < F.col("priced2")) & (F.round(F.col("aread1") - F.col("aread2"), 9) < 0)
    bear = (F.col("priceu1") > F.col("priceu2")) & (F.round(F.col("areau1") - F.col("areau2"), 9) < 0)
    kind = F.when(F.col("rows") < lookback, "none").when(bull, "bullish").when(bear, "bearish").otherwise("none")
    return wide.select(*KEY, kind.alias("divergence"), *[F.col(f"c.{c}") for c in carry])


def trap_tests(df: DataFrame, ma: str = "ma250") -> DataFrame:
    """D02's tests of each row: ``rising`` (the average over 19 rows), ``dipped`` (a close below it in the last five), ``back`` (now above)."""
    base = F.lag(ma, 19).over(by_time())
    rising = (F.col(ma) - base) / F.greatest(F.abs(base), F.lit(1.0)) > 0
    dipped = F.max((F.col("close") < F.col(ma)).cast("int")).over(trailing(5)) == 1
    return df.withColumns({"rising": rising, "dipped": dipped, "back": F.col("close") > F.col(ma)})


def trap_reason() -> Column:
    """The first test that fails, or trap."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return F.when(no("rising"), "average_not_rising").when(no("dipped"), "no_break").when(no("back"), "not_recovered").when(F.col("divergence") != "bullish", "no_divergence").otherwise("trap")


def bear_traps(df: DataFrame, kinds: DataFrame, ma: str = "ma250") -> DataFrame:
    """Per key's last row: the first test that fails, or trap: rising average, a recent close below it, now above, bullish divergence."""
    rows = trap_tests(df, ma).select(*KEY, "datetime", "rising", "dipped", "back")
    last = rows.withColumn("_b", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("datetime").desc()))).filter("_b = 1")
    return last.join(kinds, KEY).select(*KEY, trap_reason().alias("reason"), (trap_reason() == "trap").alias("bear_trap"))


def simple_divergence(df: DataFrame, price: str = "close", force: str = "hist0", back: int = 5) -> DataFrame:
    """Price below (above) and force above (below) their values some bars ago."""
    p, f = lag(price, back), lag(force, back)
    kind = F.when((F.col(price) < p) & above(force, f), "bullish").when((F.col(price) > p) & above(f, force), "bearish").otherwise("none")
    return df.withColumn("simple_divergence", kind)


def pivot_divergence(df: DataFrame, force: str = "dif0") -> DataFrame:
    """Rows whose price two back is a strict local extreme, against the pivot before of the same kind."""
    c = [lag("close", k) for k in range(6)]
    others = [c[1], c[3], c[4], c[5]]
    low = F.least(*others) > c[2]
    high = F.greatest(*others) < c[2]
    pivots = df.withColumn("kind", F.when(c[5].isNotNull() & low, "low").when(c[5].isNotNull() & high, "high")).withColumn("p", c[2]).withColumn("f", lag(force, 2)).filter("kind is not null")
    by = Window.partitionBy(*KEY, "kind").orderBy("datetime")
    bull = (F.col("kind") == "low") & (F.col("p") < F.lag("p").over(by)) & (F.col("f") > F.lag("f").over(by))
    bear = (F.col("kind") == "high") & (F.col("p") > F.lag("p").over(by)) & (F.col("f") < F.lag("f").over(by))
    return pivots.withColumn("divergence", F.when(bull, "bullish").when(bear, "bearish").otherwise("none"))
