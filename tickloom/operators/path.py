"""Features along one path (ordered rows of a key): differences, returns, slopes, shapes, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import BPS, safe_div
from tickloom.operators.groups import attach, framed, running


def tick_differences(
    ticks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    volume: str,
    turnover: str,
    lags: Sequence[int] = (1, 3, 10, 30),
    unit: float = 1.0,
) -> DataFrame:
    """Row-lag differences of cumulative volume and turnover and the VWAP between."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for n in lags:
            dv = F.col(volume) - F.lag(volume, n).over(w)
            dt = F.col(turnover) - F.lag(turnover, n).over(w)
            out[f"volume_diff_{n}t"], out[f"turnover_diff_{n}t"] = dv, dt
            out[f"trade_vwap_{n}t"] = safe_div(dt, dv * unit)
        return out

    return framed(ticks, keys, order, build, before=max(lags))


def price_column(df: DataFrame) -> str | None:
    """The price to follow: last, else mid, else best ask."""
    return next((c for c in ("last_price", "mid_price", "ask_price_1") if c in df.columns), None)


def momentum(
    ticks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lags: Sequence[int] = (1, 3, 10, 30),
    price: str | None = None,
) -> DataFrame:
    """Returns against the previous close and the open, and n-row percentage changes."""
    price = price or price_column(ticks)
    if price is None:
        return ticks
    now = F.col(price)
    fixed = {
        f"return_vs_{name}": safe_div(now - F.col(ref), F.col(ref))
        for name, ref in (("prev_close", "prev_close"), ("open", "open_price"))
        if ref in ticks.columns
    }

    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"return_{n}t": safe_div(now, F.lag(price, n).over(w)) - 1.0 for n in lags}

    return framed(ticks.withColumns(fixed) if fixed else ticks, keys, order, build, before=max(lags))


def slope_over(value: Column, w: WindowSpec, window: int) -> Column:
    """OLS slope of the last ``window`` values on 0..window-1; NULL unless all are present."""
    middle = (window - 1) / 2.0
    scale = window * (window * window - 1) / 12.0
    parts = [F.lag(value, k).over(w) if k else value for k in range(window)]
    total = parts[0] * (window - 1 - middle)
    for k in range(1, window):
        total = total + parts[k] * (window - 1 - k - middle)
    return total / scale


def rolling_slope(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int, out: str
) -> DataFrame:
    return framed(
        df, keys, order, lambda w: {out: slope_over(F.col(value), w, window)}, before=window - 1
    )


def path_shape(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    windows: Sequence[int] = (2, 3, 5),
    prefix: str = "path_shape_",
    reference: str = "open",
) -> DataFrame:
    """Causal shape of the mid-price path and what spread and depth do after up-moves."""
    if reference not in ("open", "start"):
        raise ValueError("reference is open or start")
    if "mid_price" not in df.columns:
        return df
    windows = [w for w in windows if w >= 2]
    mid = F.col("mid_price")
    has = set(df.columns)

    def bps(now: Column, then: Column) -> Column:
        return safe_div(now - then, then) * BPS

    def local(w: WindowSpec) -> dict[str, Column]:
        previous = F.lag(mid, 1).over(w)
        move = bps(mid, previous)
        up = F.when(F.coalesce(move > 0, F.lit(False)), 1.0).otherwise(0.0)
        out = {"_up": up}
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            full = F.count(mid).over(frame) == n
            high, low = F.max(mid).over(frame), F.min(mid).over(frame)
            span = bps(mid, F.lag(mid, n - 1).over(w))
            out[f"{prefix}mid_move_{n}m_bps"] = span
            out[f"{prefix}return_accel_1m_vs_{n}m"] = move - span / float(n - 1)
            out[f"{prefix}mid_position_roll{n}"] = F.when(full, safe_div(mid - low, high - low))
            if "depth_imbalance_10" in has:
                slope = slope_over(F.col("depth_imbalance_10"), w, n)
                rose = F.coalesce(mid - F.lag(mid, n - 1).over(w) > 0, F.lit(False))
                out[f"{prefix}imbalance_slope_roll{n}"] = slope
                out[f"{prefix}imbalance_slope_confirm_return_roll{n}"] = slope * rose.cast("double")

        def change(c: str) -> Column:
            return F.col(c) - F.lag(c, 1).over(w)

        if "spread_bps" in has:
            out[f"{prefix}spread_compress_after_upmove"] = -change("spread_bps") * up
            out[f"{prefix}spread_widen_after_upmove"] = change("spread_bps") * up
        if {"bid_depth_10", "ask_depth_10"} <= has:
            bid, ask = change("bid_depth_10"), change("ask_depth_10")
            out[f"{prefix}bid_depth_support_after_upmove"] = bid * up
            out[f"{prefix}ask_depth_fade_after_upmove"] = -ask * up
            out[f"{prefix}depth_support_imbalance_after_upmove"] = (bid - ask) * up
        return out

    stepped = framed(df, keys, order, local, before=max([2, *windows]) - 1)
    ran = running(
        stepped.withColumn("_row", F.lit(1)),
        keys,
        order,
        {
            "_high": ("max", "mid_price"),
            "_low": ("min", "mid_price"),
            "_first": ("first", "mid_price"),
            "_ups": ("sum", "_up"),
            "_rows": ("count", "_row"),
        },
    )
    first_name = "mid_from_first_bps" if reference == "open" else "mid_from_start_bps"
    return ran.withColumns(
        {
            f"{prefix}mid_drawdown_from_{reference}_high_bps": bps(mid, F.col("_high")),
            f"{prefix}mid_recovery_from_{reference}_low_bps": bps(mid, F.col("_low")),
            f"{prefix}{first_name}": bps(mid, F.col("_first")),
            f"{prefix}mid_new_high_flag": F.coalesce(mid >= F.col("_high"), F.lit(False)).cast("int"),
            f"{prefix}mid_new_low_flag": F.coalesce(mid <= F.col("_low"), F.lit(False)).cast("int"),
            f"{prefix}return_positive_fraction": F.col("_ups") / F.col("_rows"),
        }
    ).drop("_up", "_row", "_high", "_low", "_first", "_ups", "_rows")


def same_clock_surprise(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int] = (20, 60),
    min_periods: int = 10,
    modes: Sequence[str] = ("zscore", "ratio"),
    keys: Sequence[str] = ("symbol", "clock"),
    order: Sequence[str] = ("date",),
    prefix: str = "hist_surprise_",
) -> DataFrame:
    """Value against the mean and deviation of the same symbol and clock on prior dates only."""
    unknown = set(modes) - {"zscore", "ratio", "diff"}
    if unknown:
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    least = max(2, min_periods)

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            v = F.col(c)
            for n in [n for n in windows if n >= 2]:
                past = w.rowsBetween(-n, -1)
                enough = F.count(v).over(past) >= least
                mean = F.when(enough, F.avg(v).over(past))
                if "zscore" in modes:
                    std = F.when(enough, F.stddev_samp(v).over(past))
                    out[f"{prefix}{c}_{n}d_zscore"] = safe_div(v - mean, std)
                if "ratio" in modes:
                    out[f"{prefix}{c}_{n}d_ratio"] = safe_div(v, mean)
                if "diff" in modes:
                    out[f"{prefix}{c}_{n}d_diff"] = v - mean
        return out

    return framed(df, keys, order, build, before=max(windows))


def daily_activity_reference(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int] = (60,),
    min_periods: int = 10,
    symbol: str = "symbol",
    date: str = "date",
    prefix: str = "hist_avg_daily_",
) -> DataFrame:
    """Mean daily maximum of activity columns over prior dates, joined back to every row."""
    daily = df.groupBy(symbol, date).agg(*[F.max(c).alias(c) for c in columns])

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            for n in windows:
                past = w.rowsBetween(-n, -1)
                out[f"{prefix}{c}_{n}d"] = F.when(
                    F.count(c).over(past) >= max(1, min_periods), F.avg(c).over(past)
                )
        return out

    rolled = framed(daily, [symbol], [date], build, before=max(windows)).drop(*columns)
    return attach(df, rolled, [symbol, date])


def auction_summary(
    ticks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    in_auction: Column,
    volume: str = "volume",
    turnover: str = "turnover",
    match: Column | None = None,
) -> DataFrame:
    """Auction summary per path: highest volume and turnover, last/min/max price, last imbalance.

    With ``match`` (condition of the matching phase) the price path is the
    indicative quote before it and the last price the match price after it.
    """
    has = set(ticks.columns)
    rows = ticks.where(in_auction)
    place = F.struct(*order)

    def last(c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), place))

    out: list[Column] = []
    if volume in has:
        out.append(F.max(volume).alias("preopen_volume"))
    if turnover in has:
        out.append(F.max(turnover).alias("preopen_turnover"))
    imbalance = F.col("depth_imbalance_10") if "depth_imbalance_10" in has else None
    if match is None:
        price = price_column(ticks)
        if price:
            p = F.col(price)
            out += [
                last(p).alias("preopen_last_price"),
                F.min(p).alias("preopen_price_min"),
                F.max(p).alias("preopen_price_max"),
            ]
    else:
        positive = lambda c: F.when(F.col(c) > 0, F.col(c))
        bid, ask = positive("bid_price_1"), positive("ask_price_1")
        quote = F.when(~match, F.coalesce((bid + ask) / 2.0, ask, bid))
        matched = F.when(match, positive("last_price")) if "last_price" in has else F.lit(None).cast("double")
        out += [
            F.coalesce(last(matched), last(quote)).alias("preopen_last_price"),
            F.min(quote).alias("preopen_price_min"),
            F.max(quote).alias("preopen_price_max"),
        ]
        imbalance = F.when(~match, imbalance) if imbalance is not None else None
    if imbalance is not None:
        out.append(last(imbalance).alias("preopen_depth_imbalance_10"))
    return rows.groupBy(*keys).agg(*out)
