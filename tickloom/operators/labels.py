"""Forward labels: VWAP exits, price exits, session closes, label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.clock import DAY_US, clock_seconds, horizon_column
from tickloom.functions.numeric import finite, price_return, safe_div, truthy
from tickloom.operators.asof import asof
from tickloom.operators.cross import mixed_target
from tickloom.operators.decision import PATH, SECOND, nth_next, state_at
from tickloom.operators.groups import attach
from tickloom.operators.reference import next_session, one_per_key, with_next_session


def allowed(c: Column | str, statuses: Sequence[str]) -> Column:
    """Status in the list, whatever its case; an empty list allows all."""
    if not statuses:
        return F.lit(True)
    return truthy(F.upper(F.col(c) if isinstance(c, str) else c).isin([s.upper() for s in statuses]))


def vwap_exit(
    start_volume: Column, start_turnover: Column, end_volume: Column, end_turnover: Column,
    buy: Column, unit: float, fee_bps: float,
) -> tuple[Column, Column]:
    """(label, valid) of selling at the VWAP between two cumulative states."""
    volume, turnover = end_volume - start_volume, end_turnover - start_turnover
    vwap = F.when(volume * unit > 0, safe_div(turnover, volume * unit))
    label = price_return(vwap, buy, fee_bps)
    return label, truthy((volume > 0) & (turnover > 0)) & label.isNotNull()


def vwap_label_set(
    base: DataFrame,
    ticks: DataFrame,
    horizons: Sequence[int],
    window_seconds: float,
    keys: Sequence[str],
    entry: str = "entry",
    buy: str = "buy_price",
    volume: str = "volume",
    turnover: str = "turnover",
    by: Sequence[str] = PATH,
    time: str = "t",
    seq: Sequence[str] = (),
    unit: float = 1.0,
    fee_bps: float = 0.0,
    eligible: Column | None = None,
    direction: str = "backward",
    max_gap_seconds: float | None = None,
) -> DataFrame:
    """VWAP labels of several horizons from one as-of pass over all (horizon, start/end) targets.

    ``keys`` identify a base row. Adds ``label_<h>s`` and ``valid_<h>s`` per horizon.
    """
    points = F.array(
        *[
            F.struct(F.lit(h).alias("h"), F.lit(end).alias("end"), F.lit(int((h + end * window_seconds) * SECOND)).alias("us"))
            for h in horizons
            for end in (0, 1)
        ]
    )
    asked = base.select(*dict.fromkeys([*by, *keys]), entry, F.explode(points).alias("_p")).select(
        *dict.fromkeys([*by, *keys]), F.col("_p.h").alias("h"), F.col("_p.end").alias("end"),
        (F.col(entry) + F.col("_p.us")).alias("at"),
    )
    read = asof(
        asked, ticks, by, "at", time, [volume, turnover], direction=direction, seq=seq,
        tolerance=None if max_gap_seconds is None else int(max_gap_seconds * SECOND),
    )
    pick = lambda c, h, end: F.max(F.when((F.col("h") == h) & (F.col("end") == end), F.col(c)))
    wide = read.groupBy(*keys).agg(
        *[
            pick(c, h, end).alias(f"_{c}_{h}_{end}")
            for h in horizons
            for end in (0, 1)
            for c in (volume, turnover)
        ]
    )
    joined = attach(base, wide, keys)
    out = {}
    for h in horizons:
        at = lambda c, end: F.col(f"_{c}_{h}_{end}")  # noqa: B023, E731
        label, valid = vwap_exit(
            at(volume, 0), at(turnover, 0), at(volume, 1), at(turnover, 1), F.col(buy), unit, fee_bps
        )
        if eligible is not None:
            valid = valid & truthy(eligible)
        out[f"label_{h}s"] = F.when(valid, label)
        out[f"valid_{h}s"] = valid
    return joined.withColumns(out).select(*base.columns, *out)


def trade_labels(
    ticks: DataFrame,
    states: DataFrame,
    buy: str,
    volume: str,
    turnover: str,
    hold_seconds: float,
    window_seconds: float,
    by: Sequence[str] = PATH,
    order: Sequence[str] = ("t", "seq"),
    entry_ticks: int | None = None,
    entry_seconds: float | None = None,
    entry_max_gap_seconds: float | None = None,
    future: str = "next_tick",
    future_max_gap_seconds: float | None = None,
    status: str | None = None,
    statuses: Sequence[str] = (),
    unit: float = 1.0,
    fee_bps: float = 0.0,
) -> DataFrame:
    """Entry by row delay or clock delay, exit at the VWAP of [hold, hold + window] after the entry."""
    time, seq = order[0], list(order[1:])
    values = [buy] + ([status] if status else [])
    if entry_seconds is not None:
        if entry_max_gap_seconds is not None:
            raise ValueError("a gap bound needs a row-delay entry")
        rows = state_at(ticks, states, time, entry_seconds, values, "entry", by=by, time=time, seq=seq)
        rows = rows.withColumn("entry", F.col(time) + F.lit(int(entry_seconds * SECOND)))
    else:
        rows = nth_next(ticks, entry_ticks or 0, values, "entry", by, order, entry_max_gap_seconds)
        rows = rows.withColumn("entry", F.col(f"{time}_entry"))
    if future == "clock_state" and future_max_gap_seconds is not None:
        raise ValueError("a future gap bound needs next_tick")
    direction = "backward" if future == "clock_state" else "forward"
    for suffix, seconds in (("sell_start", hold_seconds), ("sell_end", hold_seconds + window_seconds)):
        rows = state_at(
            rows, states, "entry", seconds, [volume, turnover], suffix, by=by, time=time, seq=seq,
            direction=direction, max_gap_seconds=future_max_gap_seconds,
        )
    at = lambda c, s: F.col(f"{c}_{s}")
    label, valid = vwap_exit(
        at(volume, "sell_start"), at(turnover, "sell_start"), at(volume, "sell_end"),
        at(turnover, "sell_end"), at(buy, "entry"), unit, fee_bps,
    )
    valid = valid & F.col("entry").isNotNull()
    if status:
        valid = valid & allowed(status, statuses) & allowed(f"{status}_entry", statuses)
    return rows.withColumns({"buy_price": at(buy, "entry"), "label": label, "valid_label": valid})


def price_exit_labels(
    samples: DataFrame,
    ticks: DataFrame,
    horizon: str,
    price: str,
    open_clock: str,
    close_clock: str,
    buy: str = "buy_price",
    symbol: str = "symbol",
    date: str = "date",
    time: str = "t",
    seq: Sequence[str] = (),
    max_gap_seconds: float | None = None,
    fee_bps: float = 0.0,
) -> DataFrame:
    """Exit at the close, the next open or the next close; the exit state must be of that session."""
    if horizon == "close":
        rows = samples.withColumn("_exit_date", F.col(date))
    elif horizon in ("next_open", "next_close"):
        sessions = ticks.select(date).distinct()
        rows = with_next_session(samples, sessions, date, "_exit_date")
    else:
        raise ValueError(f"not a session horizon: {horizon}")
    clock = clock_seconds(open_clock if horizon == "next_open" else close_clock) * SECOND
    midnight = F.unix_date(F.col("_exit_date").cast("date")).cast("long") * F.lit(DAY_US)
    rows = rows.withColumn("_at", midnight + F.lit(clock))
    states = ticks.where(F.col(price).isNotNull()).withColumnRenamed(date, "_exit_date")
    found = asof(
        rows, states, ["_exit_date", symbol], "_at", time, [price], seq=seq, prefix="_x_",
        direction="forward" if horizon == "next_open" else "backward",
        tolerance=None if max_gap_seconds is None else int(max_gap_seconds * SECOND),
    )
    return found.select(
        *samples.columns, price_return(f"_x_{price}", buy, fee_bps).alias(horizon_column(horizon))
    )


def next_close_labels(
    base: DataFrame, closes: DataFrame, buy: str = "buy_price", close: str = "close_price", date: str = "date",
    symbol: str = "symbol",
) -> DataFrame:
    """Return to the close of the next session of the calendar."""
    later = next_session(closes.select(date).distinct(), date, "_next")
    moved = (
        closes.select(F.col(date).alias("_next"), symbol, F.col(close).alias("_close"))
    )
    joined = attach(attach(base, later, [date]), moved, ["_next", symbol])
    value = price_return("_close", buy)
    return joined.withColumns({"label_next_close": value, "valid_next_close": value.isNotNull()}).select(
        *base.columns, "label_next_close", "valid_next_close"
    )


def same_day_close_labels(
    base: DataFrame, closes: DataFrame, buy: str = "buy_price", close: str = "close_price", date: str = "date",
    symbol: str = "symbol", eligible: Column | None = None, fee_bps: float = 0.0,
) -> DataFrame:
    """Return to the close of the same session."""
    side = closes.select(date, symbol, F.col(close).alias("_close"))
    value = price_return("_close", buy, fee_bps)
    if eligible is not None:
        value = F.when(truthy(eligible), value)
    joined = attach(base, side, [date, symbol])
    return joined.withColumns({"label_close": value, "valid_close": value.isNotNull()}).drop("_close")


def recovered_close_labels(
    labels: DataFrame, closes: DataFrame, next_label: str, close: str = "close_price", date: str = "date",
    symbol: str = "symbol", out: str = "same_day_close",
) -> DataFrame:
    """Same-day close return from the next-close return and the two closes: (1 + r) * c0 / c1 - 1."""
    later = next_session(closes.select(date).distinct(), date, "_next")
    today = closes.select(date, symbol, F.col(close).alias("_c0"))
    then = closes.select(F.col(date).alias("_next"), symbol, F.col(close).alias("_c1"))
    joined = attach(attach(attach(labels, later, [date]), today, [date, symbol]), then, ["_next", symbol])
    value = safe_div((F.col(next_label) + 1.0) * F.col("_c0"), F.col("_c1")) - 1.0
    fine = (F.col("_c0") > 0) & (F.col("_c1") > 0)
    return joined.withColumn(out, F.when(fine, finite(value))).select(*labels.columns, out)


def normal_labels(labels: DataFrame, keys: Sequence[str], label: str, newest: Sequence[str] = ()) -> DataFrame:
    """External label table: finite values only, no missing keys, one row per key (the newest, else the greatest)."""
    rows = labels.withColumn(label, finite(label)).dropna(subset=[*keys, label])
    if not newest:
        return one_per_key(rows, keys)
    place = F.struct(*[F.col(c) for c in newest])
    return rows.groupBy(*keys).agg(F.max_by(label, place).alias(label))


def sampled_horizon_returns(
    rows: DataFrame, horizons: dict[str, int], keys: Sequence[str], time: str, price: str, buy: str,
    latest: Column | None = None, fee_bps: float = 0.0,
) -> DataFrame:
    """Return to the later decision row at exactly time + horizon; one column per horizon.

    Rows are multiplied by the (few) horizons and equi-joined on the target time.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("h"), F.lit(s).alias("s")) for n, s in horizons.items()])
    asked = rows.select(*keys, time, buy, F.explode(listed).alias("_h")).select(
        *keys, time, buy, F.col("_h.h").alias("h"), (F.col(time) + F.col("_h.s")).alias("_then")
    )
    if latest is not None:
        asked = asked.where(F.col("_then") <= latest)
    exits = rows.select(*keys, F.col(time).alias("_then"), F.col(price).alias("_exit"))
    hit = asked.join(exits, [*keys, "_then"], "left")
    value = price_return("_exit", buy, fee_bps)
    wide = hit.groupBy(*keys, time).agg(
        *[F.max(F.when(F.col("h") == n, value)).alias(horizon_column(n)) for n in horizons]
    )
    return attach(rows, wide, [*keys, time])


def close_label_table(
    base: DataFrame, closes: DataFrame, group: Sequence[str], keys: Sequence[str], weight: float, min_size: int,
    eligible: Column | None = None, clip_std: float = 0.0,
) -> DataFrame:
    """Whole label table: same-day close, next close and their mixed target, keys only besides."""
    out = next_close_labels(same_day_close_labels(base, closes, eligible=eligible), closes)
    ok = F.col("valid_close") & F.col("valid_next_close")
    out = mixed_target(
        out, group, "label_close", "label_next_close", weight, min_size, ok, clip_std, "target_label"
    )
    return out.select(*keys, "label_close", "label_next_close", "target_label")


def split_horizons(
    wide: DataFrame, keys: Sequence[str], group: Sequence[str], shorts: Sequence[str], later: str, weight: float,
    min_size: int,
) -> DataFrame:
    """One wide multi-horizon label table to long per-horizon rows with a mixed target each."""
    carried = list(dict.fromkeys([*keys, *group, later]))
    long = wide.select(*carried, *shorts).unpivot(carried, list(shorts), "horizon", "label_short")
    return mixed_target(
        long, [*group, "horizon"], "label_short", later, weight, min_size, out="target_label"
    )
