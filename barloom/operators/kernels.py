"""Small vectorised kernels for recurrences that no window expresses; each takes and returns one key's pandas frame."""

from __future__ import annotations

import numpy as np
import pandas as pd


def ewm(x: pd.Series, span: int, min_periods: int = 0) -> pd.Series:
    return x.ewm(span=span, adjust=False, min_periods=min_periods).mean()


def macd_lines(close: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[pd.Series, pd.Series]:
    """dif and dea with full warm-up."""
    dif = ewm(close, fast, fast) - ewm(close, slow, slow)
    return dif, ewm(dif, signal, signal)


def macd_frame(pdf: pd.DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> pd.DataFrame:
    """Adds dif, dea, hist = 2 (dif - dea) with full warm-up; dif0, dea0, hist0 = dif0 - dea0 without; rsi (Wilder)."""
    pdf = pdf.sort_values("datetime", kind="stable")
    close = pdf["close"]
    dif, dea = macd_lines(close, fast, slow, signal)
    plain = ewm(close, fast) - ewm(close, slow)
    plain_signal = ewm(plain, signal)
    return pdf.assign(dif=dif, dea=dea, hist=(dif - dea) * 2, dif0=plain, dea0=plain_signal, hist0=plain - plain_signal, rsi=wilder_rsi(close.to_numpy()))


def macd_columns(close: np.ndarray, starts: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9, whole: bool = True, rsi: bool = True) -> dict[str, np.ndarray]:
    """The columns of ``macd_frame`` for many keys at once, each with its rows in order from one of ``starts`` on; the first three only if not ``whole``."""
    key = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(close))))
    mean = lambda x, span, least=0: pd.Series(x).groupby(key, sort=False).ewm(span=span, adjust=False, min_periods=least).mean().to_numpy()
    dif = mean(close, fast, fast) - mean(close, slow, slow)
    dea = mean(dif, signal, signal)
    lines = {"dif": dif, "dea": dea, "hist": (dif - dea) * 2}
    if whole:
        plain = mean(close, fast) - mean(close, slow)
        plain_signal = mean(plain, signal)
        lines |= {"dif0": plain, "dea0": plain_signal, "hist0": plain - plain_signal}
        lines |= {"rsi": np.concatenate([wilder_rsi(x) for x in np.split(close, starts[1:])])} if rsi else {}
    return lines


def places(starts: np.ndarray, n: int) -> np.ndarray:
    """Each row's place in its key, from 0."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def lagged(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The value n rows before in the same key, else NaN."""
    out = np.full(len(x), np.nan)
    out[n:] = np.where(place[n:] >= n, x[: len(x) - n], np.nan)
    return out


def moving_means(x: np.ndarray, place: np.ndarray, windows: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Means of the last n rows where they hold ``least`` values, by name: {name: (n, least)}. Sums are whole numbers (of 1024, and
    of tenths of a billionth below it), so they are exact wherever the window lies, and a running sum that overflows does no harm."""
    known = np.abs(x) < 1e17
    x = np.where(known, x, 0.0)
    high = np.floor(x / 1024)
    upto = lambda v: np.append(0, np.cumsum(v.astype(np.int64)))
    sums = upto(high), upto(np.rint((x - high * 1024) * 1e10)), upto(known)
    end, out = np.arange(1, len(x) + 1), {}
    for name, (n, least) in windows.items():
        begin = end - np.minimum(place + 1, n)
        coarse, fine, count = (s[end] - s[begin] for s in sums)
        total = (coarse.astype(np.longdouble) * 1024 + fine.astype(np.longdouble) / 10**10).astype(float)
        out[name] = np.where(count >= least, total / np.maximum(count, 1), np.nan)
    return out


def moving_sum(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of the last n rows, the oldest first; NaN where there is none."""
    rows = [lagged(x, place, k) if k else x for k in range(n - 1, -1, -1)]
    return np.where(np.all(np.isnan(rows), axis=0), np.nan, sum(np.nan_to_num(r) for r in rows))


def wilder_rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Seeded with the mean of the first n changes, then (n - 1) parts old and one part new."""
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    change = np.diff(close)
    up, down = np.maximum(change, 0.0), np.maximum(-change, 0.0)
    a, b = float(up[:n].sum()) / n, float(down[:n].sum()) / n
    found = [100.0 * a / (a + b) if a + b else 0.0]
    for u, d in zip(up[n:].tolist(), down[n:].tolist(), strict=True):
        a, b = (a * (n - 1) + u) / n, (b * (n - 1) + d) / n
        found.append(100.0 * a / (a + b) if a + b else 0.0)
    out[n:] = found
    return out


def wilder_adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Average directional index with Wilder's smoothing; null for the first 2n - 1 rows."""
    out = np.full(len(close), np.nan)
    if len(close) < 2 * n:
        return out
    up, down = high[1:] - high[:-1], low[:-1] - low[1:]
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    s = np.array([tr[:n].sum(), plus[:n].sum(), minus[:n].sum()])
    dx: list[float] = []
    adx = np.nan
    for i in range(n - 1, len(tr)):
        if i >= n:
            s = s - s / n + np.array([tr[i], plus[i], minus[i]])
        p, m = (s[1] / s[0], s[2] / s[0]) if s[0] else (0.0, 0.0)
        x = 100.0 * abs(p - m) / (p + m) if p + m else 0.0
        dx.append(x)
        if len(dx) == n:
            adx = sum(dx) / n
        elif len(dx) > n:
            adx = (adx * (n - 1) + x) / n
        out[i + 1] = adx
    return out


def merge_bars(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last source row, high and low of each merged bar.

    Against the merged bar so far, a bar's high and low move the same way (then it stands for itself, and that way is the
    direction) or not (one lies within the other: they merge towards the direction, which is up at first).
    """
    starts: list[int] = []
    tops: list[float] = []
    floors: list[float] = []
    towards, extreme = 1, (min, max)
    for row, (h, w) in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
        if starts:
            by_high, by_low = (h > tops[-1]) - (h < tops[-1]), (w > floors[-1]) - (w < floors[-1])
            if by_high * by_low < 1:
                pick = extreme[towards > 0]
                tops[-1], floors[-1] = pick(tops[-1], h), pick(floors[-1], w)
                continue
            towards = by_high
        starts.append(row)
        tops.append(h)
        floors.append(w)
    first = np.array(starts, int)
    return first, np.append(first[1:], len(high))[: len(first)] - 1, np.array(tops), np.array(floors)


def turning(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """1 at merged bars strictly above both neighbours in high and low, -1 at those strictly below, else 0."""
    out = np.zeros(len(high), int)
    if len(high) > 2:
        over = lambda x: (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])
        out[1:-1] = (over(high) & over(low)).astype(int) - (over(-high) & over(-low)).astype(int)
    return out


def stroke_ends(index: np.ndarray, top: np.ndarray, price: np.ndarray, gap: int = 4) -> list[int]:
    """Positions of the fractals that end strokes: kinds alternate, ``gap`` merged bars apart, tops above bottoms.

    With bottoms counted negative, a fractal of the same kind is more extreme if its value is larger, and a top lies above
    a bottom if their sum is positive.
    """
    value = np.where(top, price, -price)
    ends: list[int] = []
    for i, v in enumerate(value.tolist()):
        if ends and top[ends[-1]] == top[i]:
            ends[-1] = i if v > value[ends[-1]] else ends[-1]
        elif not ends or (index[i] - index[ends[-1]] >= gap and v + value[ends[-1]] > 0):
            ends.append(i)
    return ends


def structure_rows(hist: np.ndarray, high: np.ndarray, low: np.ndarray, gap: int = 4) -> dict[str, np.ndarray]:
    """All strokes of one key's bars in order: their bars (start_row, end_row, confirmed_row, locked_row; -1 if there is none),
    merged bars, prices, histogram area, and the center that ends with each.

    The row with idx -1 has the numbers of bars, merged bars and fractals; keys without strokes have it as well.
    """
    first, last, high, low = merge_bars(high, low)
    kind = turning(high, low)
    price = np.where(kind > 0, high, low)
    value = (kind * price).tolist()
    side = kind.tolist()
    best: list[int] = []  # of consecutive ones of a kind the most extreme, the first of equals
    for i in np.flatnonzero(kind).tolist():
        if not best or side[best[-1]] != side[i]:
            best.append(i)
        elif value[i] > value[best[-1]]:
            best[-1] = i
    points = np.array(best, int)
    ends = points[stroke_ends(points, kind[points] > 0, price[points], gap)] if len(points) else points
    a, z = ends[:-1], ends[1:]
    n = len(a)
    up = kind[z] > 0
    hist = np.where(np.isnan(hist), 0.0, hist)
    sums = {s: np.append(0.0, np.cumsum(np.maximum(s * hist, 0.0))) for s in (1, -1)}
    area = np.where(up, *(sums[s][last[z] + 1] - sums[s][last[a]] for s in (1, -1))) if n else np.zeros(0)
    confirmed = last[z + 1] if n else np.zeros(0, int)
    tops, floors = np.maximum(price[a], price[z]), np.minimum(price[a], price[z])
    zones = np.full((6, n), np.nan)  # center, center_start, zd, zg, center_low, center_high
    for c, (i, j, *span) in enumerate(center_spans(floors[:-1], tops[:-1])):
        zones[:, j] = [c, i, *span]
    head = lambda x, top=np.nan: np.append(top, x)
    row = lambda x: np.append(-1, x).astype(int)
    return {
        "idx": row(np.arange(n)), "start_index": head(a, len(hist)).astype(int), "end_index": head(z, len(first)).astype(int), "up": head(up, 0).astype(int), "start_price": head(price[a]), "end_price": head(price[z]),
        "high": head(tops), "low": head(floors), "start_row": row(last[a]), "end_row": row(last[z]), "confirmed_row": row(confirmed), "locked_row": row(np.append(confirmed[1:], -1)[:n]),
        "macd_area": head(np.maximum(np.round(area, 9), 0.0)), "center": head(zones[0]), "center_start": head(zones[1], len(points)), "zd": head(zones[2]), "zg": head(zones[3]), "center_low": head(zones[4]), "center_high": head(zones[5]),
    }


def center_spans(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """(first stroke, last stroke, zd, zg, lowest, highest) of stretches of three or more strokes that overlap."""
    out, i = [], 0
    while i + 3 <= len(low):
        zd, zg = low[i : i + 3].max(), high[i : i + 3].min()
        j = i + 3
        if zd >= zg:
            i += 1
            continue
        while j < len(low) and high[j] >= zd and low[j] <= zg:
            j += 1
        out.append((i, j - 1, float(zd), float(zg), float(low[i:j].min()), float(high[i:j].max())))
        i = j
    return out
