"""Key contracts, column contracts and row filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock as C
from tickloom.functions.numeric import finite, truthy


def normal_keys(df: DataFrame, date: str = "date", symbol: str = "symbol", keys: Sequence[str] = ()) -> DataFrame:
    """Normalised date and symbol; rows with a missing key are dropped."""
    shaped = df.withColumns({date: C.normal_date(date), symbol: C.normal_symbol(symbol)})
    return shaped.dropna(subset=[date, symbol, *keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a missing key part, distinct keys and surplus rows."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(missing).alias("_missing"))
    return per_key.agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_missing"), F.col("_n"))), F.lit(0)).alias("missing_key_rows"),
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.col("_n") - 1).alias("surplus_rows"),
    )


def require_keys(df: DataFrame, keys: Sequence[str], context: str = "table") -> DataFrame:
    """The frame itself, after checking that keys are present and unique (one job)."""
    row = key_report(df, keys).first()
    if row["missing_key_rows"] or row["surplus_rows"]:
        raise ValueError(f"{context}: {row['missing_key_rows']} missing and {row['surplus_rows']} duplicate keys")
    return df


def missing_clocks(df: DataFrame, clocks: Sequence[str], clock: str = "clock") -> DataFrame:
    """Declared clocks with no row at all."""
    declared = df.sparkSession.createDataFrame([(c,) for c in clocks], f"{clock} string")
    return declared.join(df.select(clock).distinct(), clock, "left_anti")


def key_sets_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts and order-free key hash sums of two tables, and whether they agree."""
    def sums(df: DataFrame, tag: str) -> DataFrame:
        # decimal sum: wraps nowhere, merges map-side
        hashed = F.xxhash64(*keys).cast("decimal(38,0)")
        return df.agg(F.count(F.lit(1)).alias(f"{tag}_rows"), F.sum(hashed).alias(f"_{tag}"))

    both = sums(a, "left").crossJoin(sums(b, "right"))
    same = (F.col("left_rows") == F.col("right_rows")) & F.col("_left").eqNullSafe(F.col("_right"))
    return both.select("left_rows", "right_rows", same.alias("same_keys"))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, duplicates counted."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def label_columns(columns: Sequence[str], prefixes: Sequence[str] = ("label", "target", "alpha_return", "valid")) -> list[str]:
    """Columns that would leak labels into features."""
    return [c for c in columns if c.startswith(tuple(prefixes))]


def require_columns(df: DataFrame, columns: Sequence[str], context: str = "table") -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{context}: missing columns {lost}")
    return df


def constraint_columns(constraints, available: Sequence[str]) -> list[str]:
    """Columns a set of allocation constraints needs and the table lacks."""
    return [c for c in constraints.needed_columns() if c not in available]


def entry_delay_violations(df: DataFrame, decision: str, entry: str, seconds: float) -> DataFrame:
    """Rows and rows whose entry is not exactly ``seconds`` after the decision (µs columns)."""
    off = F.abs((F.col(entry) - F.col(decision)) / 1e6 - seconds) > 1e-9
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(truthy(off) | off.isNull()).alias("violations"))


def window_coverage(
    windows: Sequence[tuple[int, int]], decision_start: int, decision_end: int, delay: int, horizon: int, exit_window: int
) -> dict[str, int]:
    """The one scan window that continuously covers decisions to the last exit, and its spare tail (s)."""
    end = decision_end + delay + horizon + exit_window
    for start, stop in sorted(windows):
        if start <= decision_start and stop >= end:
            return {"start": start, "stop": stop, "needed_until": end, "spare": stop - end}
    raise ValueError(f"no window covers {decision_start}..{end}")


def day_coverage(ticks: DataFrame, needed_us: int, time_of_day: str, date: str = "date") -> DataFrame:
    """Per day: last state and whether it reaches the needed offset."""
    return ticks.groupBy(date).agg(F.max(time_of_day).alias("last_us")).withColumn(
        "covered", F.col("last_us") >= needed_us
    )


def pick_columns(
    df: DataFrame,
    names: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    patterns: Sequence[str] = (),
    drop: Sequence[str] = (),
    leaky: Sequence[str] = ("label", "target", "alpha_return", "future", "valid"),
    limit: int | None = None,
) -> list[str]:
    """Numeric or boolean columns by exact name, prefix or pattern, minus dropped and leaky ones."""
    kinds = dict(df.dtypes)
    usable = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    out = []
    for c in df.columns:
        asked = c in names or c.startswith(tuple(prefixes) or ("\0",)) or any(re.search(p, c) for p in patterns)
        if asked and c not in drop and not c.startswith(tuple(leaky)) and kinds[c].startswith(usable):
            out.append(c)
    return out[:limit] if limit else out


def clock_between(ts: Column | str, start: str, end: str, include_end: bool = True) -> Column:
    """Clock range test on seconds of the day, right end open or closed."""
    us = C.offset_us(ts)
    low, high = C.clock_seconds(start) * 1_000_000, C.clock_seconds(end) * 1_000_000
    return (us >= low) & ((us <= high) if include_end else (us < high))


def symbol_universe(df: DataFrame, pattern: str | None = None, symbols: DataFrame | None = None, symbol: str = "symbol") -> DataFrame:
    """Rows whose normalised symbol matches a pattern and/or an allow-list table."""
    rows = df.withColumn("_s", C.normal_symbol(symbol))
    if pattern:
        rows = rows.where(F.col("_s").rlike(pattern))
    if symbols is not None:
        listed = symbols.select(C.normal_symbol(symbols.columns[0]).alias("_s")).distinct()
        rows = rows.join(listed, "_s", "left_semi")
    return rows.select(*df.columns)


def tradable(
    df: DataFrame,
    status: str | None = None,
    statuses: Sequence[str] = (),
    spread: str = "spread_bps",
    max_spread: float = 0.0,
    room: str = "ask1_to_limit_up_bps",
    min_room: float = 0.0,
) -> Column:
    """Executable rows; each test only when configured and its column exists."""
    tests = [F.lit(True)]
    if status and statuses and status in df.columns:
        tests.append(truthy(F.upper(F.col(status)).isin([s.upper() for s in statuses])))
    if max_spread > 0 and spread in df.columns:
        tests.append(truthy(finite(spread) <= max_spread))
    if min_room > 0 and room in df.columns:
        tests.append(truthy(finite(room) >= min_room))
    return reduce(lambda a, b: a & b, tests)


def rank_guard(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """All rank columns within their inclusive bounds; missing fails."""
    tests = []
    for c, (low, high) in bounds.items():
        if low is not None:
            tests.append(F.col(c) >= low)
        if high is not None:
            tests.append(F.col(c) <= high)
    return reduce(lambda a, b: a & b, [truthy(t) for t in tests], F.lit(True))


def ordinary_rows(rows: DataFrame, status: DataFrame, keys: Sequence[str], flag: str = "limit_status") -> tuple[DataFrame, DataFrame]:
    """Rows whose same-day limit status is 0, and the counts of the other kinds. Diagnostics only:
    the status is known after the decision."""
    per_key = status.groupBy(*keys).agg(F.max(flag).alias("_s"), (F.max(flag) != F.min(flag)).alias("_clash"))
    joined = rows.join(per_key, list(keys), "left")
    s = F.col("_s")
    stats = joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(truthy(s == 0)).alias("kept_rows"),
        F.count_if(truthy(s == 1)).alias("limit_up_rows"),
        F.count_if(truthy(s == -1)).alias("limit_down_rows"),
        F.count_if(s.isNull()).alias("unknown_rows"),
        F.count_if(truthy(F.col("_clash"))).alias("conflicting_rows"),
    )
    return joined.where(s == 0).drop("_s", "_clash"), stats


def labeled_rows(
    df: DataFrame, clocks: Sequence[str], clock: str = "clock", lag: str | None = None, max_lag: float | None = None
) -> DataFrame:
    """Rows of the configured clocks with a lag in [0, max]."""
    kept = df.where(F.col(clock).isin(list(clocks)))
    if lag and max_lag is not None:
        kept = kept.where(F.col(lag).between(0, max_lag))
    return kept


def score_filter(
    df: DataFrame,
    score: str,
    clocks: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    pool: DataFrame | None = None,
    lag_sessions: int = 0,
    clock: str = "clock",
) -> tuple[DataFrame, DataFrame]:
    """Rows with a score, in the clock list or range and in the pool; and the row counts of each step."""
    from tickloom.operators.reference import membership

    in_clock = F.lit(True)
    if clocks:
        in_clock = in_clock & F.col(clock).isin(list(clocks))
    if start:
        in_clock = in_clock & (F.col(clock) >= start)
    if end:
        in_clock = in_clock & (F.col(clock) <= end)
    flagged = df if pool is None else membership(df, pool, lag_sessions, "_member")
    member = F.lit(True) if pool is None else F.col("_member")
    scored = finite(score).isNotNull()
    stats = flagged.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(scored).alias("scored_rows"),
        F.count_if(scored & truthy(in_clock)).alias("clock_rows"),
        F.count_if(scored & truthy(in_clock) & member).alias("kept_rows"),
    )
    return flagged.where(scored & truthy(in_clock) & member).select(*df.columns), stats
