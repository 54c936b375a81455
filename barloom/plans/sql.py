"""DuckDB text of the logical tables and indicators, shared by the oracles."""

from __future__ import annotations

BARS = """
moves AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS d, l_quantity::BIGINT AS qty,
    row_number() OVER o AS rn, (round(l_extendedprice * 100)::BIGINT % 201) - 100 AS step,
    10000 + sum((round(l_extendedprice * 100)::BIGINT % 201) - 100) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS c
  FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)),
bars AS (
  SELECT symbol, '1d' AS timeframe, d::TIMESTAMP AS datetime, arg_min(c - step, rn) / 100.0 AS open, max(greatest(c, c - step)) / 100.0 AS high,
    min(least(c, c - step)) / 100.0 AS low, arg_max(c, rn) / 100.0 AS close, sum(qty)::DOUBLE AS volume, sum(c * qty)::DOUBLE AS amount
  FROM moves GROUP BY symbol, d)"""

TICKS = """
tick AS (
  SELECT event_type AS symbol, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
    (round(coalesce(value, 0) * 100)::BIGINT % 201 + 201) % 201 - 100 AS step,
    10000 + sum((round(coalesce(value, 0) * 100)::BIGINT % 201 + 201) % 201 - 100) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c
  FROM events),
hours AS (
  SELECT symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS datetime, arg_min(c - step, rn) / 100.0 AS open, max(greatest(c, c - step)) / 100.0 AS high,
    min(least(c, c - step)) / 100.0 AS low, arg_max(c, rn) / 100.0 AS close, count(*)::DOUBLE AS volume, sum(c)::DOUBLE AS amount
  FROM tick GROUP BY symbol, date_trunc('hour', ts))"""

INDEX = """
idx AS (SELECT 'INDEX' AS symbol, datetime, sum(round(close * 100)::BIGINT) / 100.0 / count(*) AS close, sum(volume) AS volume FROM bars GROUP BY datetime)"""


def _ewm(y: str, x: str, span: int) -> str:
    a = f"(2.0::DOUBLE / ({span} + 1))"
    return f"CASE WHEN {y} = {x} THEN {y} ELSE ((1 - {a}) * {y} + {a} * {x}) / ((1 - {a}) + {a}) END"


def macd(source: str, name: str = "mac") -> str:
    """Recurrences by key and row: e12, e26, dea over dif from row 26, dea0 over dif from row 1, Wilder's averages."""
    e12, e26 = _ewm("r.e12", "b.close", 12), _ewm("r.e26", "b.close", 26)
    return f"""
{name}_n AS (
  SELECT *, row_number() OVER k AS rn, greatest(close - lag(close) OVER k, 0) AS up, greatest(lag(close) OVER k - close, 0) AS down FROM {source}
  WINDOW k AS (PARTITION BY symbol ORDER BY datetime)),
{name}_s AS (
  SELECT *, sum(up) OVER w / 14 AS up14, sum(down) OVER w / 14 AS down14 FROM {name}_n
  WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
{name}_r AS (
  SELECT symbol, rn, close::DOUBLE AS e12, close::DOUBLE AS e26, NULL::DOUBLE AS dea, 0.0::DOUBLE AS dea0, NULL::DOUBLE AS ag, NULL::DOUBLE AS al FROM {name}_s WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {e12}, {e26},
    CASE WHEN b.rn = 26 THEN ({e12}) - ({e26}) WHEN b.rn > 26 THEN {_ewm('r.dea', f'(({e12}) - ({e26}))', 9)} END,
    {_ewm('r.dea0', f'(({e12}) - ({e26}))', 9)},
    CASE WHEN b.rn = 15 THEN b.up14 WHEN b.rn > 15 THEN (r.ag * 13 + b.up) / 14 END,
    CASE WHEN b.rn = 15 THEN b.down14 WHEN b.rn > 15 THEN (r.al * 13 + b.down) / 14 END
  FROM {name}_r r JOIN {name}_s b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
{name} AS (
  SELECT b.* EXCLUDE (up14, down14), CASE WHEN b.rn >= 26 THEN e12 - e26 END AS dif, CASE WHEN b.rn >= 34 THEN dea END AS dea,
    CASE WHEN b.rn >= 34 THEN (e12 - e26 - dea) * 2 END AS hist, e12 - e26 AS dif0, dea0, e12 - e26 - dea0 AS hist0,
    CASE WHEN ag + al = 0 THEN 0 ELSE 100 * ag / (ag + al) END AS rsi
  FROM {name}_r r JOIN {name}_s b USING (symbol, rn))"""


def _ma(n: int, x: str = "close", least: int | None = None, f: str = "avg") -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {f}({x}) {over} END"


K = "OVER (PARTITION BY symbol ORDER BY rn)"
NEAR = "(greatest(abs(dif), abs(dea)) / greatest(abs(close), 1e-12) <= 0.005 OR dif * dea <= 0)"
INDICATORS = (
    macd("bars")
    + f""",
avgs AS (
  SELECT *, {', '.join(f'{_ma(n)} AS ma{n}' for n in (5, 10, 20, 50, 60, 120, 200, 250))},
    coalesce(volume / nullif({_ma(20, 'volume', 10)}, 0), 0) AS volume_ratio, coalesce(volume / nullif({_ma(30, 'volume')}, 0), 1) AS volume_ratio30,
    lag(close) {K} AS close1, close / lag(close) {K} - 1 AS pct_change
  FROM mac),
ind AS (
  SELECT *, CASE WHEN count(ma60) OVER t20 >= 20 THEN regr_slope(ma60, rn) OVER t20 ELSE 0 END AS ma60_slope,
    CASE WHEN count(ma250) OVER t20 >= 20 THEN regr_slope(ma250, rn) OVER t20 ELSE 0 END AS ma250_slope,
    {_ma(20, 'close', None, 'stddev_pop')} AS boll_sd, {_ma(20, 'pct_change', None, 'stddev_pop')} * sqrt(252) AS volatility,
    lag(ma60, 5) {K} AS ma60_before, max(close) OVER t20 AS recent_high, min(close) OVER t20 AS recent_low,
    coalesce(close >= max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS breakout20,
    dif > dea AND lag(dif) {K} <= lag(dea) {K} AS golden_cross, dif < dea AND lag(dif) {K} >= lag(dea) {K} AS death_cross,
    CASE WHEN {NEAR} THEN 'near' WHEN dif > 0 AND dea > 0 THEN 'above' WHEN dea IS NOT NULL THEN 'below' END AS zone,
    volume_ratio BETWEEN 1 AND 2 AS c1,
    coalesce(ma10 IS NOT NULL AND lag(ma10) {K} IS NOT NULL AND round(close - greatest(ma5, ma10), 9) > 0 AND NOT round(close1 - greatest(lag(ma5) {K}, lag(ma10) {K}), 9) > 0, false) AS c2,
    coalesce(lag(hist, 2) {K} > 0 AND lag(hist, 2) {K} < lag(hist) {K} AND lag(hist) {K} < hist, false) AS c3
  FROM avgs WINDOW t20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cross_ind AS (
  SELECT *, c1::INT + c2::INT + c3::INT AS confirmation_count,
    array_to_string([x FOR x IN [CASE WHEN c1 THEN 'moderate_volume' END, CASE WHEN c2 THEN 'breakout' END, CASE WHEN c3 THEN 'hist_expanding' END] IF x IS NOT NULL], ',') AS confirmation_items,
    CASE WHEN NOT coalesce(golden_cross, false) THEN 'none' WHEN zone = 'above' AND c1::INT + c2::INT + c3::INT >= 2 THEN 'strong'
         WHEN zone IN ('above', 'near') AND c1::INT + c2::INT + c3::INT >= 1 THEN 'confirmed' ELSE 'weak' END AS cross_quality,
    row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS back
  FROM ind)"""
)

DIVERGENCE = """
dr AS (SELECT symbol, -back AS i, close, hist0 AS h, sign(hist0)::INT AS s FROM cross_ind WHERE back <= 60),
ds AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY i) AS run FROM (SELECT *, coalesce(s <> lag(s) OVER (PARTITION BY symbol ORDER BY i), true)::INT AS n FROM dr)),
dg AS (SELECT symbol, run, s, sum(abs(h)) AS area, arg_min(close, (CASE WHEN s < 0 THEN h ELSE -h END, i)) AS price FROM ds WHERE s <> 0 GROUP BY symbol, run, s HAVING count(*) >= 2),
dk AS (SELECT *, row_number() OVER (PARTITION BY symbol, s ORDER BY run DESC) AS r FROM dg),
div AS (SELECT a.symbol, CASE WHEN count(*) FILTER (false) > 0 THEN '' WHEN max(CASE WHEN s = -1 AND r = 1 THEN price END) < max(CASE WHEN s = -1 AND r = 2 THEN price END) AND round(max(CASE WHEN s = -1 AND r = 1 THEN area END) - max(CASE WHEN s = -1 AND r = 2 THEN area END), 9) < 0 THEN 'bullish'
    WHEN max(CASE WHEN s = 1 AND r = 1 THEN price END) > max(CASE WHEN s = 1 AND r = 2 THEN price END) AND round(max(CASE WHEN s = 1 AND r = 1 THEN area END) - max(CASE WHEN s = 1 AND r = 2 THEN area END), 9) < 0 THEN 'bearish' ELSE 'none' END AS divergence
  FROM (SELECT DISTINCT symbol FROM dr) a LEFT JOIN dk ON dk.symbol = a.symbol GROUP BY a.symbol)""".replace("WHEN count(*) FILTER (false) > 0 THEN '' ", "")


def from_bars(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([BARS, *more]) + select


def from_indicators(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([BARS, INDICATORS, *more]) + select
