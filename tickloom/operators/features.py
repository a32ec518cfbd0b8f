"""Order-book and decision-row feature families, as column expressions in one projection each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import (
    BPS, bucket_of_edges, finite, mean_present, safe_div, std_present, sum_present,
)
from tickloom.operators.decision import exact_lag
from tickloom.operators.groups import attach, group_median, running
from tickloom.operators.path import auction_summary, momentum, tick_differences

LEVELS = range(1, 11)


def depth_levels(columns: Sequence[str]) -> list[int]:
    """Levels with volumes on both sides."""
    has = set(columns)
    return [k for k in LEVELS if {f"ask_volume_{k}", f"bid_volume_{k}"} <= has]


def order_book(ticks: DataFrame) -> DataFrame:
    """Mid, spread, ten-level depth and imbalance, level gaps, room to the upper limit."""
    has, levels = set(ticks.columns), depth_levels(ticks.columns)
    c = F.col
    out: dict[str, Column] = {}
    if {"bid_price_1", "ask_price_1"} <= has:
        mid = (c("bid_price_1") + c("ask_price_1")) / 2.0
        spread = c("ask_price_1") - c("bid_price_1")
        out |= {"mid_price": mid, "spread_abs": spread, "spread_bps": safe_div(spread, mid) * BPS}
    if levels:
        bid = sum_present([f"bid_volume_{k}" for k in levels])
        ask = sum_present([f"ask_volume_{k}" for k in levels])
        out |= {"bid_depth_10": bid, "ask_depth_10": ask, "depth_imbalance_10": safe_div(bid - ask, bid + ask)}
    if 1 in levels:
        b, a = c("bid_volume_1"), c("ask_volume_1")
        out["depth_imbalance_1"] = safe_div(b - a, b + a)
    if {"limit_up_price", "ask_price_1"} <= has:
        out["ask1_to_limit_up_bps"] = safe_div(c("limit_up_price") - c("ask_price_1"), "ask_price_1") * BPS
    for k in [k for k in levels if k > 1]:
        if {f"bid_price_{k}", "bid_price_1"} <= has:
            out[f"bid_gap_{k}_bps"] = safe_div(c("bid_price_1") - c(f"bid_price_{k}"), "bid_price_1") * BPS
        if {f"ask_price_{k}", "ask_price_1"} <= has:
            out[f"ask_gap_{k}_bps"] = safe_div(c(f"ask_price_{k}") - c("ask_price_1"), "ask_price_1") * BPS
    return ticks.withColumns(out)


def attach_auction(ticks: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the auction summary and derive its return, range and position in range."""
    joined = attach(ticks, summary, keys)
    has = set(joined.columns)
    out: dict[str, Column] = {}
    last, low, high = F.col("preopen_last_price"), F.col("preopen_price_min"), F.col("preopen_price_max")
    if {"prev_close", "preopen_last_price"} <= has:
        out["preopen_return_vs_prev_close"] = safe_div(last - F.col("prev_close"), "prev_close")
    if {"preopen_price_min", "preopen_price_max", "preopen_last_price"} <= has:
        base = F.col("prev_close") if "prev_close" in has else last
        out["auction_price_range_bps"] = safe_div(high - low, base) * BPS
        out["auction_last_position_in_range"] = safe_div(last - low, high - low)
    return joined.withColumns(out)


def tick_features(
    ticks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    volume: str = "volume",
    turnover: str = "turnover",
    lags: Sequence[int] = (1, 3, 10, 30),
    in_auction: Column | None = None,
    match: Column | None = None,
    auction_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Book, trade and momentum features of every state, with the auction summary joined on."""
    out = order_book(ticks)
    out = tick_differences(out, keys, order, volume, turnover, lags)
    out = momentum(out, keys, order, lags)
    if in_auction is not None:
        day = list(auction_keys or keys)
        out = attach_auction(out, auction_summary(out, day, order, in_auction, volume, turnover, match), day)
    return out


# fixed list: columns followed over the minutes after the open
DYNAMIC = (
    "ask_volume_1",
    "bid_volume_1",
    "ask_depth_10",
    "bid_depth_10",
    "depth_imbalance_1",
    "depth_imbalance_10",
    "spread_bps",
    "mid_price",
    "ask_price_1",
    "bid_price_1",
    "volume",
    "turnover",
)


def change_columns(columns: Sequence[str], windows: Sequence[int], prefix: str) -> dict[str, Column]:
    """Difference and relative change against the lagged ``<column>_<w>m`` columns."""
    out = {}
    for c in columns:
        for w in windows:
            lagged = F.col(f"{c}_{w}m")
            out[f"{prefix}{c}_diff_{w}m"] = F.col(c) - lagged
            out[f"{prefix}{c}_rel_{w}m"] = safe_div(F.col(c) - lagged, F.abs(lagged))
    return out


def with_minute_lags(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], windows: Sequence[int], minute: int
) -> DataFrame:
    """Append ``<column>_<w>m``: values exactly w minutes earlier on the path."""
    for w in windows:
        df = exact_lag(df, keys, time, w * minute, columns, f"{w}m")
    return df


def postopen(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    since_open: Column | None = None,
    windows: Sequence[int] = (1, 3, 5),
    minute: int = 60_000_000,
) -> DataFrame:
    """Decision-row changes over exact minutes, depth shares, gap shape and interactions."""
    has = set(df.columns)
    moving = [c for c in DYNAMIC if c in has]
    work = with_minute_lags(df, keys, time, moving, windows, minute)
    out = change_columns(moving, windows, "postopen_")
    if since_open is not None:
        out["postopen_minutes_since_0930"] = since_open
    for side in ("ask", "bid"):
        if {f"{side}_volume_1", f"{side}_depth_10"} <= has:
            out[f"postopen_{side}1_depth_share"] = safe_div(f"{side}_volume_1", f"{side}_depth_10")
        gaps = [f"{side}_gap_{k}_bps" for k in LEVELS if f"{side}_gap_{k}_bps" in has]
        if gaps:
            out[f"postopen_{side}_gap_mean_2_10"] = mean_present(gaps)
            out[f"postopen_{side}_gap_std_2_10"] = std_present(gaps, ddof=1)
    shares = [out.get("postopen_bid1_depth_share"), out.get("postopen_ask1_depth_share")]
    if all(s is not None for s in shares):
        out["postopen_top_depth_share_imbalance"] = shares[0] - shares[1]
    if {"spread_bps", "depth_imbalance_1"} <= has:
        out["postopen_spread_x_imbalance_1"] = F.col("spread_bps") * F.col("depth_imbalance_1")
    if {"volume_diff_1t", "ask_volume_1"} <= has:
        out["postopen_trade_vs_ask1_queue"] = safe_div("volume_diff_1t", "ask_volume_1")
    return work.withColumns(out).select(*df.columns, *out)


def _weighted_gap(gaps: Sequence[str], weights: Sequence[str]) -> Column:
    used = [F.col(g).isNotNull() & (F.col(w) > 0) for g, w in zip(gaps, weights)]
    total = sum_present([F.when(u, F.col(g) * F.col(w)) for u, g, w in zip(used, gaps, weights)])
    return safe_div(total, sum_present([F.when(u, F.col(w)) for u, w in zip(used, weights)]))


def book_state(columns: Sequence[str], depths: Sequence[int]) -> dict[str, Column]:
    """Depth, imbalance, queue share, weighted and largest gap per depth cut."""
    has, levels = set(columns), depth_levels(columns)
    p, out = "postopen_v2_", {}
    for d in depths:
        inside = [k for k in levels if k <= d]
        if not inside:
            continue
        side_depth = {s: sum_present([f"{s}_volume_{k}" for k in inside]) for s in ("ask", "bid")}
        ask, bid = side_depth["ask"], side_depth["bid"]
        out |= {f"{p}ask_depth_{d}": ask, f"{p}bid_depth_{d}": bid}
        out[f"{p}depth_imbalance_{d}"] = safe_div(bid - ask, bid + ask)
        for s in ("ask", "bid"):
            out[f"{p}{s}1_share_depth_{d}"] = safe_div(f"{s}_volume_1", side_depth[s])
            gaps = [f"{s}_gap_{k}_bps" for k in inside if k > 1 and f"{s}_gap_{k}_bps" in has]
            if gaps:
                weights = [f"{s}_volume_{g.split('_')[2]}" for g in gaps]
                out[f"{p}{s}_gap_weighted_{d}_bps"] = _weighted_gap(gaps, weights)
                out[f"{p}{s}_gap_max_{d}_bps"] = F.greatest(*gaps) if len(gaps) > 1 else F.col(gaps[0])
    return out


def book_shape(columns: Sequence[str], depths: Sequence[int]) -> dict[str, Column]:
    """Depth concentration, gap slope and curve."""
    has, p, out = set(columns), "postopen_v2_", {}
    for s in ("ask", "bid"):
        if {f"{p}{s}_depth_3", f"{p}{s}_depth_10"} <= has:
            out[f"{p}{s}_depth_concentration_3_10"] = safe_div(f"{p}{s}_depth_3", f"{p}{s}_depth_10")
        for d in depths:
            if d > 1 and f"{s}_gap_{d}_bps" in has:
                out[f"{p}{s}_gap_slope_{d}_bps"] = F.col(f"{s}_gap_{d}_bps") / float(d - 1)
        if {f"{s}_gap_2_bps", f"{s}_gap_10_bps"} <= has:
            out[f"{p}{s}_gap_curve_2_10_bps"] = F.col(f"{s}_gap_10_bps") - F.col(f"{s}_gap_2_bps")
    parts = [out.get(f"{p}{s}_depth_concentration_3_10") for s in ("bid", "ask")]
    if all(x is not None for x in parts):
        out[f"{p}depth_concentration_imbalance_3_10"] = parts[0] - parts[1]
    return out


def trade_impact(columns: Sequence[str], lags: Sequence[int] = (1, 3, 10, 30)) -> dict[str, Column]:
    """Traded volume, turnover and VWAP against queues, depth and prices."""
    has, p, out = set(columns), "postopen_v2_trade_", {}
    queues = {"ask1": "ask_volume_1", "bid1": "bid_volume_1", "ask_depth10": "ask_depth_10", "bid_depth10": "bid_depth_10"}
    for n in lags:
        if f"volume_diff_{n}t" in has:
            for name, queue in queues.items():
                if queue in has:
                    out[f"{p}volume_to_{name}_{n}t"] = safe_div(f"volume_diff_{n}t", queue)
        if {f"turnover_diff_{n}t", "ask_depth_10", "ask_price_1"} <= has:
            notional = F.col("ask_depth_10") * F.col("ask_price_1")
            out[f"{p}turnover_to_depth_notional_{n}t"] = safe_div(f"turnover_diff_{n}t", notional)
        if f"trade_vwap_{n}t" in has:
            for name, price in (("mid", "mid_price"), ("ask1", "ask_price_1")):
                if price in has:
                    gap = F.col(f"trade_vwap_{n}t") - F.col(price)
                    out[f"{p}vwap_vs_{name}_{n}t_bps"] = safe_div(gap, price) * BPS
    return out


def postopen_v2(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order: Sequence[str],
    windows: Sequence[int] = (1, 2, 3, 5),
    depths: Sequence[int] = (3, 5, 10),
    reference: str = "open",
    minute: int = 60_000_000,
) -> DataFrame:
    """Book state and shape, trade impact, trajectories from the first row and over exact minutes,
    queue refill and spread compression."""
    if reference not in ("open", "start"):
        raise ValueError("reference is open or start")
    p = "postopen_v2_"
    work = df.withColumns(book_state(df.columns, depths))
    work = work.withColumns({**book_shape(work.columns, depths), **trade_impact(df.columns)})
    extra = ["ask_depth_3", "bid_depth_3", "depth_imbalance_3", "ask_depth_concentration_3_10", "bid_depth_concentration_3_10"]
    moving = [c for c in [*DYNAMIC, *[p + x for x in extra]] if c in work.columns]
    lagged = moving + ([f"{p}bid_depth_10"] if f"{p}bid_depth_10" in work.columns else [])
    built = list(work.columns)
    work = with_minute_lags(work, keys, time, lagged, windows, minute)
    work = running(work, keys, order, {f"_f_{c}": ("first", c) for c in moving})
    out = change_columns(moving, windows, p)
    for c in moving:
        first = F.col(f"_f_{c}")
        out[f"{p}{c}_from_{reference}_diff"] = F.col(c) - first
        out[f"{p}{c}_from_{reference}_rel"] = safe_div(F.col(c) - first, F.abs(first))
    for s in ("ask", "bid"):
        refill = out.get(f"{p}{s}_volume_1_diff_1m")
        if refill is not None and "volume_diff_1t" in df.columns:
            out[f"{p}{s}1_queue_replenish_vs_trade_1m"] = safe_div(refill, F.abs("volume_diff_1t"))
    if f"{p}spread_bps_diff_1m" in out:
        out[f"{p}spread_compression_1m"] = -out[f"{p}spread_bps_diff_1m"]
    for w in windows:
        traded = out.get(f"{p}volume_diff_{w}m")
        if traded is None:
            continue
        traded = F.abs(traded)
        for s in ("ask", "bid"):
            refill = out.get(f"{p}{s}_volume_1_diff_{w}m")
            if refill is not None:
                out[f"{p}queue_{s}1_replenish_vs_trade_{w}m"] = safe_div(refill, traded)
        deep = f"{p}bid_depth_10"
        if deep in built:
            out[f"{p}queue_bid_depth10_replenish_vs_trade_{w}m"] = safe_div(F.col(deep) - F.col(f"{deep}_{w}m"), traded)
        if f"{p}spread_bps_diff_{w}m" in out:
            out[f"{p}queue_spread_compression_{w}m"] = -out[f"{p}spread_bps_diff_{w}m"]
    return work.withColumns(out).select(*built, *out)


def price_scale(
    df: DataFrame,
    price: str = "ask_price_1",
    tick: float = 0.01,
    edges: Sequence[float] = (5.0, 20.0),
    interactions: Sequence[str] = (),
    prefix: str = "price_scale_",
) -> DataFrame:
    """Log price, tick in bps, price bucket and flags, spread and gaps in ticks, notionals, interactions."""
    has = set(df.columns)
    if price not in has:
        return df
    edges = sorted(edges)
    names = ["cheap", "mid", "expensive"] if len(edges) == 2 else [f"bucket{i}" for i in range(len(edges) + 1)]
    p = F.when(F.col(price) > 0, F.col(price))
    bucket = bucket_of_edges(p, edges).cast("double")
    out = {
        f"{prefix}log_price": F.ln(p),
        f"{prefix}tick_bps": safe_div(F.lit(tick), p) * BPS,
        f"{prefix}bucket_code": bucket,
    }
    flags = {n: F.coalesce(bucket == float(i), F.lit(False)).cast("int") for i, n in enumerate(names)}
    out |= {f"{prefix}bucket_{n}": f for n, f in flags.items()}
    if "spread_abs" in has:
        out[f"{prefix}spread_ticks"] = F.col("spread_abs") / tick
    elif {"ask_price_1", "bid_price_1"} <= has:
        out[f"{prefix}spread_ticks"] = (F.col("ask_price_1") - F.col("bid_price_1")) / tick
    for k in range(2, 11):
        if {f"ask_price_{k}", "ask_price_1"} <= has:
            out[f"{prefix}ask_gap_{k}_ticks"] = (F.col(f"ask_price_{k}") - F.col("ask_price_1")) / tick
        if {f"bid_price_{k}", "bid_price_1"} <= has:
            out[f"{prefix}bid_gap_{k}_ticks"] = (F.col("bid_price_1") - F.col(f"bid_price_{k}")) / tick
    sized = ["ask_volume_1", "bid_volume_1", "volume_diff_1t", "volume_diff_3t"]
    sized += [f"{v2}{s}_depth_{d}" for v2 in ("", "postopen_v2_") for d in (3, 10) for s in ("ask", "bid")]
    for c in sized:
        if c in has:
            out[f"{prefix}{c}_notional"] = F.col(c) * p
    for c in interactions:
        if c in has:
            out |= {f"{prefix}{c}_x_{n}": F.col(c) * f.cast("double") for n, f in flags.items()}
    return df.withColumns(out)


def multi_denominator_ratios(
    df: DataFrame,
    turnover: Sequence[str],
    volume: Sequence[str],
    depth: Sequence[str],
    against_median: Sequence[str],
    keys: Sequence[str],
    window: int = 60,
    prefix: str = "multi_den_ratio_",
    least: int = 0,
    most: int = 40,
) -> DataFrame:
    """Activity and depth against float size, own history and the cross-section median."""
    has = set(df.columns)
    by_turnover = ["float_market_cap", f"hist_avg_daily_turnover_{window}d"]
    by_volume = ["float_shares", f"hist_avg_daily_volume_{window}d"]
    pairs = [(c, d) for c in turnover for d in by_turnover] + [(c, d) for c in [*volume, *depth] for d in by_volume]
    out: dict[str, Column] = {}
    for c, d in dict.fromkeys(pairs):
        if c in has and d in has:
            out[f"{prefix}{c}_to_{d}"] = safe_div(finite(c), F.when(finite(d) > 0, finite(d)))
    medians = [c for c in dict.fromkeys(against_median) if c in has]
    work = group_median(df, keys, {f"_md_{c}": c for c in medians}) if medians else df
    for c in medians:
        out[f"{prefix}{c}_to_xs_median"] = safe_div(finite(c), F.when(F.col(f"_md_{c}") > 0, F.col(f"_md_{c}")))
    if not least <= len(out) <= most:
        raise ValueError(f"{len(out)} ratio features, expected {least} to {most}")
    return work.withColumns(out).select(*df.columns, *out)


def standardisation(train: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per feature over the training rows, global or per key."""
    return train.groupBy(*by).agg(
        *[F.avg(finite(c)).alias(f"_m_{c}") for c in features], *[F.stddev_pop(finite(c)).alias(f"_s_{c}") for c in features]
    )


def standardise(
    df: DataFrame, train: DataFrame, features: Sequence[str], by: Sequence[str] = (), eps: float = 1e-12
) -> DataFrame:
    """Scale by train-fitted moments (per key with a global fallback); missing becomes 0."""
    overall = standardisation(train, features)
    work = df.crossJoin(overall)  # one row
    if by:
        own = standardisation(train, features, by)
        own = own.withColumnsRenamed({f"_{k}_{c}": f"_o{k}_{c}" for c in features for k in ("m", "s")})
        work = attach(work, own, by)
    out = {}
    for c in features:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        if by:
            m = F.coalesce(F.col(f"_om_{c}"), m)
            s = F.coalesce(F.when(F.col(f"_os_{c}") > eps, F.col(f"_os_{c}")), s)
        z = safe_div(finite(c) - m, F.when(s > eps, s).otherwise(1.0))
        out[c] = F.coalesce(z, F.lit(0.0))
    return work.withColumns(out).select(*df.columns)
