"""Queries of the structure and pattern operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import chan, screening
from barloom.operators import indicators as ind
from barloom.plans.indicator_queries import dated, r6
from barloom.plans.sql import BARS, DIVERGENCE, INDICATORS, from_indicators
from barloom.sources import tables as src

QUERIES, SQL = {}, {}

MERGED = """
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM bars),
mr AS (
  SELECT symbol, rn, 0 AS idx, high AS hi, low AS lo, NULL::DOUBLE AS phi, NULL::DOUBLE AS plo, true AS up FROM nb WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, idx + CASE WHEN ins THEN 0 ELSE 1 END, CASE WHEN NOT ins THEN h WHEN up2 THEN greatest(hi, h) ELSE least(hi, h) END,
    CASE WHEN NOT ins THEN w WHEN up2 THEN greatest(lo, w) ELSE least(lo, w) END, CASE WHEN ins THEN phi ELSE hi END, CASE WHEN ins THEN plo ELSE lo END, up2
  FROM (SELECT *, CASE WHEN NOT ins THEN CASE WHEN h > hi AND w > lo THEN true WHEN h < hi AND w < lo THEN false ELSE up END
      ELSE CASE WHEN hi > phi AND lo > plo THEN true WHEN hi < phi AND lo < plo THEN false ELSE up END END AS up2
    FROM (SELECT r.symbol, b.rn, r.idx, r.hi, r.lo, r.phi, r.plo, r.up, b.high AS h, b.low AS w, (r.hi >= b.high AND r.lo <= b.low) OR (b.high >= r.hi AND b.low <= r.lo) AS ins
      FROM mr r JOIN nb b ON b.symbol = r.symbol AND b.rn = r.rn + 1))),
merged AS (SELECT mr.symbol, idx, arg_max(hi, mr.rn) AS high, arg_max(lo, mr.rn) AS low, max(datetime) AS datetime, sum(volume) AS volume, arg_min(open, mr.rn) AS open, arg_max(close, mr.rn) AS close
  FROM mr JOIN nb USING (symbol, rn) GROUP BY mr.symbol, idx)"""
FRACTALS = """
fr AS (SELECT *, CASE WHEN high > lag(high) OVER k AND high > lead(high) OVER k AND low > lag(low) OVER k AND low > lead(low) OVER k THEN 'top'
    WHEN low < lag(low) OVER k AND low < lead(low) OVER k AND high < lag(high) OVER k AND high < lead(high) OVER k THEN 'bottom' END AS kind, lead(datetime) OVER k AS confirmed
  FROM merged WINDOW k AS (PARTITION BY symbol ORDER BY idx)),
fi AS (SELECT *, CASE WHEN kind = 'top' THEN high ELSE low END AS price, coalesce(kind <> lag(kind) OVER (PARTITION BY symbol ORDER BY idx), true)::INT AS fresh FROM fr WHERE kind IS NOT NULL),
fs AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY idx) AS island FROM fi),
fractals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY CASE WHEN kind = 'top' THEN -price ELSE price END, idx) AS best FROM fs) WHERE best = 1)"""
STROKES = """
fn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k FROM fractals),
sr AS (
  SELECT symbol, k, 0 AS no, idx, kind, price, datetime, confirmed FROM fn WHERE k = 1
  UNION ALL
  SELECT symbol, k, CASE WHEN act = 2 THEN no + 1 ELSE no END, CASE WHEN act > 0 THEN nidx ELSE idx END, CASE WHEN act > 0 THEN nkind ELSE kind END, CASE WHEN act > 0 THEN nprice ELSE price END,
    CASE WHEN act > 0 THEN ndatetime ELSE datetime END, CASE WHEN act > 0 THEN nconfirmed ELSE confirmed END
  FROM (SELECT r.symbol, f.k, r.no, r.idx, r.kind, r.price, r.datetime, r.confirmed, f.idx AS nidx, f.kind AS nkind, f.price AS nprice, f.datetime AS ndatetime, f.confirmed AS nconfirmed,
      CASE WHEN f.kind = r.kind THEN CASE WHEN (f.kind = 'top' AND f.price > r.price) OR (f.kind = 'bottom' AND f.price < r.price) THEN 1 ELSE 0 END
           WHEN f.idx - r.idx >= 4 AND ((f.kind = 'top' AND f.price > r.price) OR (f.kind = 'bottom' AND f.price < r.price)) THEN 2 ELSE 0 END AS act
    FROM sr r JOIN fn f ON f.symbol = r.symbol AND f.k = r.k + 1)),
ends AS (SELECT symbol, no, arg_max(idx, k) AS idx, arg_max(kind, k) AS kind, arg_max(price, k) AS price, arg_max(datetime, k) AS datetime, arg_max(confirmed, k) AS confirmed FROM sr GROUP BY symbol, no),
strokes AS (SELECT a.symbol, a.no AS idx, a.idx AS start_index, b.idx AS end_index, CASE WHEN a.kind = 'bottom' THEN 'up' ELSE 'down' END AS direction, a.price AS start_price, b.price AS end_price,
    a.datetime AS start_time, b.datetime AS end_time, b.confirmed AS confirmed_at FROM ends a JOIN ends b ON a.symbol = b.symbol AND b.no = a.no + 1)"""


def structure(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([BARS, MERGED, FRACTALS, STROKES, *more]) + select


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def merged(spark, sf_dir):
    return chan.merged_bars(src.daily_bars(spark, sf_dir))


@query("d03_merged_bars", structure(" SELECT symbol, idx::INT AS idx, open, high, low, close, volume, datetime::DATE::VARCHAR AS datetime FROM merged"))
def d03(spark, sf_dir):
    return merged(spark, sf_dir).select("symbol", "idx", "open", "high", "low", "close", "volume", text_time("datetime"))


@query("d04_fractals", structure(" SELECT symbol, idx::INT AS idx, kind, price, confirmed::DATE::VARCHAR AS confirmed_at FROM fractals"))
def d04(spark, sf_dir):
    return chan.fractals(merged(spark, sf_dir)).select("symbol", "idx", "kind", "price", text_time("confirmed_at"))


@query("d05_strokes", structure(" SELECT symbol, idx::INT AS idx, start_index::INT AS start_index, end_index::INT AS end_index, direction, start_price, end_price, confirmed_at::DATE::VARCHAR AS confirmed_at FROM strokes"))
def d05(spark, sf_dir):
    return chan.strokes(chan.fractals(merged(spark, sf_dir))).select("symbol", "idx", "start_index", "end_index", "direction", "start_price", "end_price", text_time("confirmed_at"))


@query("d06_stroke_area", structure(" SELECT s.symbol, idx::INT AS idx, round(coalesce(sum(CASE WHEN direction = 'up' THEN greatest(hist, 0) ELSE greatest(-hist, 0) END), 0), 6) AS macd_area FROM strokes s JOIN cross_ind c ON c.symbol = s.symbol AND c.datetime BETWEEN s.start_time AND s.end_time GROUP BY s.symbol, idx", INDICATORS))
def d06(spark, sf_dir):
    return chan.structure(src.daily_bars(spark, sf_dir)).filter("idx >= 0").select("symbol", "idx", *r6("macd_area"))


@query("d07_locked_strokes", structure(" SELECT symbol, idx::INT AS idx, confirmed_at FROM (SELECT symbol, idx, lead(confirmed_at) OVER (PARTITION BY symbol ORDER BY idx)::DATE::VARCHAR AS confirmed_at FROM strokes) WHERE confirmed_at IS NOT NULL"))
def d07(spark, sf_dir):
    return chan.locked(chan.strokes(chan.fractals(merged(spark, sf_dir)))).select("symbol", "idx", text_time("confirmed_at"))


#: Locked strokes, their areas, centers by a scan that carries the open center, the center before each stroke, and all points.
LOCKED = """
ll AS (SELECT symbol, idx, direction, start_price, end_price, greatest(start_price, end_price) AS high, least(start_price, end_price) AS low, start_time, end_time, lead(confirmed_at) OVER (PARTITION BY symbol ORDER BY idx) AS confirmed_at FROM strokes),
lk AS (SELECT *, max(low) OVER t AS zd3, min(high) OVER t AS zg3, count(*) OVER t AS n3 FROM ll WHERE confirmed_at IS NOT NULL WINDOW t AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
cs AS (
  SELECT symbol, idx, n3 = 3 AND zd3 < zg3 AS open, CASE WHEN n3 = 3 AND zd3 < zg3 THEN idx END AS first, CASE WHEN n3 = 3 AND zd3 < zg3 THEN idx + 2 END AS fin, zd3 AS zd, zg3 AS zg FROM lk WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, keep OR seed, CASE WHEN keep THEN first WHEN seed THEN idx END, CASE WHEN keep THEN greatest(fin, idx) WHEN seed THEN idx + 2 END, CASE WHEN keep THEN zd ELSE zd3 END, CASE WHEN keep THEN zg ELSE zg3 END
  FROM (SELECT l.symbol, l.idx, r.first, r.fin, r.zd, r.zg, l.zd3, l.zg3, r.open AND (l.idx <= r.fin OR (l.high >= r.zd AND l.low <= r.zg)) AS keep, l.n3 = 3 AND l.zd3 < l.zg3 AS seed
    FROM cs r JOIN lk l ON l.symbol = r.symbol AND l.idx = r.idx + 1)),
cg AS (SELECT symbol, first, max(fin) AS fin, any_value(zd) AS zd, any_value(zg) AS zg FROM cs WHERE open GROUP BY symbol, first),
centers AS (SELECT c.symbol, row_number() OVER (PARTITION BY c.symbol ORDER BY first) - 1 AS idx, first, fin, zd, zg, (SELECT min(low) FROM lk WHERE lk.symbol = c.symbol AND lk.idx BETWEEN first AND fin) AS low, (SELECT max(high) FROM lk WHERE lk.symbol = c.symbol AND lk.idx BETWEEN first AND fin) AS high FROM cg c),
cb AS (SELECT k.*, c.zd, c.zg FROM lk k LEFT JOIN (SELECT k.symbol, k.idx, arg_max(c.zd, c.fin) AS zd, arg_max(c.zg, c.fin) AS zg FROM lk k JOIN centers c ON c.symbol = k.symbol AND c.fin < k.idx GROUP BY k.symbol, k.idx) c USING (symbol, idx))"""
POINTS = (
    LOCKED
    + """,
area AS (SELECT s.symbol, s.idx, round(coalesce(sum(CASE WHEN s.direction = 'up' THEN greatest(hist, 0) ELSE greatest(-hist, 0) END), 0), 9) AS area FROM lk s JOIN mac c ON c.symbol = s.symbol AND c.datetime BETWEEN s.start_time AND s.end_time GROUP BY s.symbol, s.idx),
p0 AS (SELECT b.*, coalesce(area, 0) AS area, lag(area, 2) OVER k AS area2, lag(low, 2) OVER k AS low2, lag(high, 2) OVER k AS high2 FROM cb b LEFT JOIN area USING (symbol, idx) WINDOW k AS (PARTITION BY b.symbol ORDER BY b.idx)),
p1 AS (SELECT *, CASE WHEN area2 > 0 AND area < area2 * 0.9 THEN CASE WHEN direction = 'down' AND low < low2 AND end_price < zd THEN 'buy_1' WHEN direction = 'up' AND high > high2 AND end_price > zg THEN 'sell_1' END END AS t1 FROM p0),
p2 AS (SELECT *, last_value(CASE WHEN t1 IS NOT NULL THEN idx END IGNORE NULLS) OVER k AS i1, last_value(CASE WHEN t1 IS NOT NULL THEN end_price END IGNORE NULLS) OVER k AS e1, last_value(t1 IGNORE NULLS) OVER k AS n1 FROM p1 WINDOW k AS (PARTITION BY symbol ORDER BY idx)),
pt AS (
  SELECT symbol, t1 AS type, 0 AS o, idx, end_price AS price, confirmed_at FROM p2 WHERE t1 IS NOT NULL
  UNION ALL SELECT symbol, CASE n1 WHEN 'buy_1' THEN 'buy_2' ELSE 'sell_2' END, 0, idx, end_price, confirmed_at FROM p2 WHERE i1 = idx - 2 AND ((n1 = 'buy_1' AND direction = 'down' AND low >= e1) OR (n1 = 'sell_1' AND direction = 'up' AND high <= e1))
  UNION ALL SELECT c.symbol, CASE WHEN a.direction = 'up' THEN 'buy_3' ELSE 'sell_3' END, 1, b.idx, b.end_price, b.confirmed_at FROM centers c JOIN lk a ON a.symbol = c.symbol AND a.idx = c.fin + 1 JOIN lk b ON b.symbol = c.symbol AND b.idx = c.fin + 2
    WHERE (a.direction = 'up' AND a.end_price > c.zg AND b.direction = 'down' AND b.low > c.zg) OR (a.direction = 'down' AND a.end_price < c.zd AND b.direction = 'up' AND b.high < c.zd)),
points AS (SELECT * EXCLUDE (r), split_part(type, '_', 1) AS side, (15 + 5 * right(type, 1)::INT)::INT AS worth FROM (SELECT *, row_number() OVER (PARTITION BY symbol, type, confirmed_at ORDER BY o DESC, idx DESC) AS r FROM pt) WHERE r = 1)"""
)


def points_sql(select: str, *more: str) -> str:
    """On points, and bars with all indicators."""
    return "WITH RECURSIVE " + ",".join([BARS, INDICATORS, MERGED, FRACTALS, STROKES, POINTS, *more]) + select


def structure_of(spark, sf_dir):
    return chan.structure(src.daily_bars(spark, sf_dir))


@query("d08_centers", structure(" SELECT symbol, idx::INT AS idx, first::INT AS start_stroke, fin::INT AS end_stroke, zd, zg, low, high FROM centers", LOCKED))
def d08(spark, sf_dir):
    rows = structure_of(spark, sf_dir).filter("center is not null")
    return rows.select("symbol", F.col("center").alias("idx"), F.col("center_start").alias("start_stroke"), F.col("idx").alias("end_stroke"), "zd", "zg", F.col("center_low").alias("low"), F.col("center_high").alias("high"))


@query("d09_center_before", structure(" SELECT symbol, idx::INT AS idx, zd, zg FROM cb", LOCKED))
def d09(spark, sf_dir):
    return chan.locked_strokes(structure_of(spark, sf_dir)).select("symbol", "idx", "zd", "zg")


TYPE3 = """SELECT c.symbol, '{rule}' AS departure, CASE WHEN a.direction = 'up' THEN 'buy_3' ELSE 'sell_3' END AS type, b.idx::INT AS stroke, b.end_price AS price, b.confirmed_at::DATE::VARCHAR AS confirmed_at FROM centers c JOIN lk a ON a.symbol = c.symbol AND a.idx = c.fin + {n} JOIN lk b ON b.symbol = c.symbol AND b.idx = c.fin + {n} + 1
 WHERE (a.direction = 'up' AND a.end_price > c.zg AND b.direction = 'down' AND b.low > c.zg) OR (a.direction = 'down' AND a.end_price < c.zd AND b.direction = 'up' AND b.high < c.zd)"""


@query("d12_type3_points", structure(" " + " UNION ALL ".join(TYPE3.format(rule=r, n=n) for r, n in (("next_stroke", 1), ("last_center_stroke", 0))), LOCKED))
def d12(spark, sf_dir):
    """By the default rule, which finds none on centers of alternating strokes, and by that of the design text."""
    rows = structure_of(spark, sf_dir)
    of = lambda rule: chan.points_of(rows, rule).filter("type like '%3'").withColumn("departure", F.lit(rule))
    return of("next_stroke").unionByName(of("last_center_stroke")).select("symbol", "departure", "type", "stroke", "price", text_time("confirmed_at"))


def signals_of(spark, sf_dir):
    return chan.chan_signals(src.daily_bars(spark, sf_dir))


@query("d10_chan_points", points_sql(" SELECT symbol, type, side, idx::INT AS stroke, price, confirmed_at::DATE::VARCHAR AS confirmed_at FROM points"))
def d10(spark, sf_dir):
    """D10, D11, D13."""
    return signals_of(spark, sf_dir).select("symbol", "type", "side", "stroke", "price", text_time("confirmed_at"))


@query("d14_chan_summary", points_sql(""" SELECT s.symbol, CASE WHEN bars >= 10 THEN 'ok' ELSE 'insufficient_data' END AS status, (bars >= 10)::INT * m.merged_bars::INT AS merged_bars, (bars >= 10)::INT * coalesce(f.n, 0)::INT AS fractals, (bars >= 10)::INT * coalesce(l.n, 0)::INT AS strokes, (bars >= 10)::INT * coalesce(c.n, 0)::INT AS centers,
  (bars >= 10)::INT * coalesce(p.n, 0)::INT AS points, CASE WHEN bars >= 10 THEN l.last END AS latest_strokes, CASE WHEN bars >= 10 THEN c.last END AS latest_centers, CASE WHEN bars >= 10 THEN p.last END AS latest_points
 FROM (SELECT symbol, count(*) AS bars FROM nb GROUP BY symbol) s JOIN (SELECT symbol, count(*) AS merged_bars FROM merged GROUP BY symbol) m USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM fractals GROUP BY symbol) f USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS n, string_agg(direction || printf('%.2f', end_price), ' ' ORDER BY idx) FILTER (idx >= z - 19) AS last FROM (SELECT *, max(idx) OVER (PARTITION BY symbol) AS z FROM lk) GROUP BY symbol) l USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS n, string_agg(printf('%.2f', zd) || '-' || printf('%.2f', zg), ' ' ORDER BY idx) FILTER (idx >= z - 4) AS last FROM (SELECT *, max(idx) OVER (PARTITION BY symbol) AS z FROM centers) GROUP BY symbol) c USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS n, string_agg(type || '@' || printf('%.2f', price), ' ' ORDER BY r DESC) FILTER (r <= 10) AS last FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confirmed_at DESC, right(type, 1) DESC, type DESC, price DESC) AS r FROM points) GROUP BY symbol) p USING (symbol)"""))
def d14(spark, sf_dir):
    rows = structure_of(spark, sf_dir)
    found = chan.summary(rows, chan.points_of(rows))
    price = lambda c: F.format_string("%.2f", c)
    text = lambda c, f: F.array_join(F.transform(c, f), " ").alias(c)
    return found.select(
        "symbol", "status", "merged_bars", "fractals", "strokes", "centers", "points", text("latest_strokes", lambda x: F.concat(x["direction"], price(x["end_price"]))),
        text("latest_centers", lambda x: F.concat(price(x["zd"]), F.lit("-"), price(x["zg"]))), text("latest_points", lambda x: F.concat(x["type"], F.lit("@"), price(x["price"]))),
    )


@query("d15_fresh_points", points_sql(""" SELECT symbol, datetime::DATE::VARCHAR AS day, n::INT AS bars, max(worth) FILTER (side = 'buy')::INT AS fresh_buy, max(worth) FILTER (side = 'sell')::INT AS fresh_sell, string_agg(type, ',' ORDER BY type, confirmed_at) AS types
 FROM (SELECT c.symbol, c.datetime, n, p.worth, p.side, p.type, p.confirmed_at FROM (VALUES (1), (5)) v(n), cross_ind c JOIN cross_ind o ON o.symbol = c.symbol AND o.rn BETWEEN c.rn - 4 AND c.rn JOIN points p ON p.symbol = o.symbol AND p.confirmed_at = o.datetime WHERE o.rn > c.rn - n) GROUP BY symbol, datetime, n"""))
def d15(spark, sf_dir):
    """Every bar with points confirmed within its last bar, and its last five."""
    bars, points = src.daily_bars(spark, sf_dir), signals_of(spark, sf_dir)
    of = lambda n: chan.with_fresh(bars, points, n).filter("size(fresh) > 0").withColumn("bars", F.lit(n))
    return dated(of(1).unionByName(of(5))).select("symbol", "day", "bars", "fresh_buy", "fresh_sell", F.array_join(F.array_sort("fresh.type"), ",").alias("types"))


@query("d01_divergence", from_indicators(" SELECT symbol, divergence FROM div", DIVERGENCE))
def d01(spark, sf_dir):
    return chan.divergences(ind.with_lines(src.daily_bars(spark, sf_dir), ["hist0"], 60)).select("symbol", "divergence")


@query("d02_bear_trap", from_indicators(""" SELECT symbol, CASE WHEN NOT coalesce((ma250 - m19) / greatest(abs(m19), 1) > 0, false) THEN 'average_not_rising' WHEN NOT coalesce(dip = 1, false) THEN 'no_break'
 WHEN NOT coalesce(close > ma250, false) THEN 'not_recovered' WHEN divergence <> 'bullish' THEN 'no_divergence' ELSE 'trap' END AS reason
 FROM (SELECT *, lag(ma250, 19) OVER (PARTITION BY symbol ORDER BY rn) AS m19, max((close < ma250)::INT) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) AS dip FROM cross_ind) JOIN div USING (symbol) WHERE back = 1""", DIVERGENCE))
def d02(spark, sf_dir):
    df = ind.with_averages(ind.with_macd(src.daily_bars(spark, sf_dir)))
    return chan.bear_traps(df, chan.divergences(df)).select("symbol", "reason")


@query("d16_simple_divergence", from_indicators(" SELECT symbol, datetime::DATE::VARCHAR AS day, CASE WHEN close < p AND round(dif0 - f, 9) > 0 THEN 'bullish' WHEN close > p AND round(dif0 - f, 9) < 0 THEN 'bearish' ELSE 'none' END AS kind FROM (SELECT *, lag(close, 5) OVER (PARTITION BY symbol ORDER BY rn) AS p, lag(dif0, 5) OVER (PARTITION BY symbol ORDER BY rn) AS f FROM cross_ind)"))
def d16(spark, sf_dir):
    df = chan.simple_divergence(ind.with_macd(src.daily_bars(spark, sf_dir)), force="dif0")
    return dated(df).select("symbol", "day", F.col("simple_divergence").alias("kind"))


@query("d17_pivot_divergence", from_indicators(""", pv AS (SELECT symbol, rn, datetime, p, f, CASE WHEN p < least(a, b, c, d) THEN 'low' WHEN p > greatest(a, b, c, d) THEN 'high' END AS kind FROM (
  SELECT symbol, rn, datetime, lag(close, 2) OVER k AS p, lag(dif0, 2) OVER k AS f, lag(close, 1) OVER k AS a, lag(close, 3) OVER k AS b, lag(close, 4) OVER k AS c, lag(close, 5) OVER k AS d FROM cross_ind WINDOW k AS (PARTITION BY symbol ORDER BY rn)) WHERE d IS NOT NULL)
 SELECT symbol, datetime::DATE::VARCHAR AS day, kind, CASE WHEN kind = 'low' AND p < lag(p) OVER j AND f > lag(f) OVER j THEN 'bullish' WHEN kind = 'high' AND p > lag(p) OVER j AND f < lag(f) OVER j THEN 'bearish' ELSE 'none' END AS divergence
 FROM pv WHERE kind IS NOT NULL WINDOW j AS (PARTITION BY symbol, kind ORDER BY datetime)"""))
def d17(spark, sf_dir):
    return dated(chan.pivot_divergence(ind.with_macd(src.daily_bars(spark, sf_dir)))).select("symbol", "day", "kind", "divergence")


@query("d18_price_position", from_indicators(""", pq AS (SELECT symbol, quantile_cont(close, 0.3) AS q30, quantile_cont(close, 0.7) AS q70 FROM (SELECT *, max(datetime) OVER (PARTITION BY symbol) AS z FROM cross_ind) WHERE datetime >= z - INTERVAL 180 DAY GROUP BY symbol)
 SELECT symbol, ((close <= q30)::INT + coalesce(close < 0.9 * ma120, false)::INT + coalesce(close < ma20 - 2 * boll_sd, false)::INT) >= 2 AS is_low, ((close >= q70)::INT + coalesce(close > 1.2 * ma120, false)::INT + coalesce(close > ma20 + 2 * boll_sd, false)::INT) >= 2 AS is_high
 FROM cross_ind JOIN pq USING (symbol) WHERE back = 1"""))
def d18(spark, sf_dir):
    return screening.price_position(ind.with_trends(ind.with_averages(src.daily_bars(spark, sf_dir))))


VOLUME_PATTERN = """, vq AS (SELECT symbol, quantile_cont(close, 0.3) AS q30, quantile_cont(close, 0.7) AS q70 FROM (SELECT *, max(datetime) OVER (PARTITION BY symbol) AS z FROM cross_ind) WHERE datetime >= z - INTERVAL 180 DAY GROUP BY symbol),
 vs AS (SELECT symbol, ((close <= q30)::INT + coalesce(close < 0.9 * ma120, false)::INT + coalesce(close < ma20 - 2 * boll_sd, false)::INT) >= 2 AS is_low, ((close >= q70)::INT + coalesce(close > 1.2 * ma120, false)::INT + coalesce(close > ma20 + 2 * boll_sd, false)::INT) >= 2 AS is_high FROM cross_ind JOIN vq USING (symbol) WHERE back = 1),
 vd AS (SELECT *, volume < 0.8 * lag(volume) OVER (PARTITION BY symbol ORDER BY rn) AND abs(pct_change * 100) < 1 AND abs(close - open) / nullif(open, 0) < 0.005 AS doji FROM cross_ind WHERE back <= 5),
 vp AS (SELECT symbol, (max(coalesce(volume_ratio > 1.5 AND pct_change * 100 < 2, false)::INT) * 3 * any_value(is_low)::INT - max(coalesce(volume_ratio > 2 AND pct_change * 100 < 1, false)::INT) * 3 * any_value(is_high)::INT + max(coalesce(doji, false)::INT))::INT AS vol_score FROM vd JOIN vs USING (symbol) GROUP BY symbol)"""


@query("d19_volume_pattern", from_indicators(VOLUME_PATTERN + " SELECT symbol, vol_score AS score FROM vp"))
def d19(spark, sf_dir):
    df = ind.with_trends(ind.with_averages(src.daily_bars(spark, sf_dir)))
    return screening.volume_pattern(ind.last_bars(df, 5), screening.price_position(df)).select("symbol", "score")
