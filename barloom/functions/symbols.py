"""Symbol, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_symbol(raw: Column) -> Column:
    """``code.EXCH``: an explicit suffix or prefix wins; else 6 is SH, 4, 8 and 9 BJ, the rest SZ. Other text: null."""
    s = F.upper(F.trim(raw))
    code = F.regexp_extract(s, r"^(?:SH|SZ|BJ)?[.]?(\d{6})(?:[.](?:SH|SZ|BJ))?$", 1)
    given = F.coalesce(F.nullif(F.regexp_extract(s, r"[.](SH|SZ|BJ)$", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"^(SH|SZ|BJ)", 1), F.lit("")))
    first = F.substring(code, 1, 1)
    guess = F.when(first == "6", "SH").when(first.isin("4", "8", "9"), "BJ").otherwise("SZ")
    return F.when(code != "", F.concat(code, F.lit("."), F.coalesce(given, guess)))


def provider_forms(raw: Column) -> Column:
    """struct(code, market, secid, prefixed): six digits; 5, 6 and 9 are SH, 4 and 8 BJ, the rest SZ."""
    code = F.lpad(F.trim(raw), 6, "0")
    first = F.substring(code, 1, 1)
    market = F.when(first.isin("5", "6", "9"), "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")
    return F.struct(code.alias("code"), market.alias("market"), F.concat(F.when(market == "SH", "1.").otherwise("0."), code).alias("secid"), F.concat(F.lower(market), code).alias("prefixed"))


def extract_symbols(df: DataFrame, id_col: str, text_col: str, by_name: bool = False) -> DataFrame:
    """Distinct symbols of free text by first place: id, symbol, name (what is left of a piece with a single symbol).

    ``by_name`` keeps a symbol once for each name that it has in the text."""
    pieces = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"[\n,;，；、]")).alias("pos", "piece"))
    found = pieces.withColumn("codes", F.regexp_extract_all(F.upper("piece"), F.lit(r"(?<![0-9])((?:SH|SZ|BJ)?\d{6}(?:[.](?:SH|SZ|BJ))?)(?![0-9])"), F.lit(1)))
    name = F.when(F.size("codes") == 1, F.trim(F.replace(F.upper("piece"), F.col("codes")[0], F.lit(""))))
    rows = found.withColumn("name", name).select("id", "pos", "name", F.posexplode("codes").alias("k", "raw")).withColumn("symbol", normalize_symbol(F.col("raw")))
    first = Window.partitionBy("id", "symbol", *["name"] * by_name).orderBy("pos", "k")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1 and symbol is not null").select("id", "symbol", "name")


def parse_number(raw: Column) -> Column:
    """Numbers with %, commas and the units 亿 (1e8) and 万 (1e4); null for -, --, False, None and empty text."""
    s = F.regexp_replace(F.trim(raw), "[,%]", "")
    unit = F.when(s.endswith("亿"), 1e8).when(s.endswith("万"), 1e4).otherwise(1.0)
    number = F.regexp_replace(s, "[亿万]$", "")
    return F.when(~s.isin("", "-", "--", "False", "None"), F.expr("1.0D") * number.try_cast("double") * unit)


def report_period(day: Column) -> Column:
    """Latest report period end that is out by a day: from October Y-09-30, July Y-06-30, April Y-03-31, else last year's 09-30."""
    y, m = F.year(day), F.month(day)
    return F.when(m >= 10, F.make_date(y, F.lit(9), F.lit(30))).when(m >= 7, F.make_date(y, F.lit(6), F.lit(30))).when(m >= 4, F.make_date(y, F.lit(3), F.lit(31))).otherwise(F.make_date(y - 1, F.lit(9), F.lit(30)))


def report_period_late(day: Column) -> Column:
    """The cautious rule: before April last year's 09-30, before August its 12-31, before November Y-06-30, else Y-09-30."""
    y, m = F.year(day), F.month(day)
    return F.when(m < 4, F.make_date(y - 1, F.lit(9), F.lit(30))).when(m < 8, F.make_date(y - 1, F.lit(12), F.lit(31))).when(m < 11, F.make_date(y, F.lit(6), F.lit(30))).otherwise(F.make_date(y, F.lit(9), F.lit(30)))


def previous_quarter_end(day: Column) -> Column:
    return F.date_sub(F.trunc(day, "quarter"), 1)


def business_expiry(day: Column, days: int = 5) -> Column:
    """The date ``days`` weekdays later."""
    ahead = F.sequence(F.date_add(day, 1), F.date_add(day, days * 2 + 4))
    return F.filter(ahead, lambda d: F.weekday(d) < 5)[days - 1]


def event_id(*parts: str) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 32)
