"""Tick states to decision rows: deduplication, clock sampling, delayed reads, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.clock import DAY_US, clock_seconds
from tickloom.operators.asof import asof
from tickloom.operators.groups import framed, group_columns, top_rows

PATH = ("date", "symbol")
SECOND = 1_000_000


def deduplicate_states(
    ticks: DataFrame, keys: Sequence[str], newest: Sequence[str]
) -> DataFrame:
    """One row per key: the highest ``newest`` columns win, NULL lowest; a row hash breaks full ties.

    Map-side group limit: at most one row per key and task is shuffled.
    """
    order = [F.col(c).desc_nulls_last() for c in newest if c in ticks.columns]
    plain = [c for c, kind in ticks.dtypes if not kind.startswith("map")]
    best = top_rows(ticks, keys, [*order, F.xxhash64(*plain).desc()], 1, out="_place")
    return best.drop("_place")


def duplicate_stats(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows and keys that occur more than once."""
    per_key = ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.col("n") - 1).alias("dropped_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
    )


def clock_targets(
    ticks: DataFrame, clocks: Sequence[str], by: Sequence[str] = PATH, day: str = "date"
) -> DataFrame:
    """Every path of a day crossed with the decision clocks: ``decision_time``, ``target`` in µs."""
    paths = ticks.select(*dict.fromkeys([*by, day])).distinct()
    table = F.array(
        *[F.struct(F.lit(c).alias("clock"), F.lit(clock_seconds(c) * SECOND).alias("us")) for c in clocks]
    )
    midnight = F.unix_date(F.col(day).cast("date")).cast("long") * F.lit(DAY_US)
    return paths.withColumn("_c", F.explode(table)).select(
        *paths.columns,
        F.col("_c.clock").alias("decision_time"),
        (midnight + F.col("_c.us")).alias("target"),
    )


def sample_decisions(
    ticks: DataFrame,
    clocks: Sequence[str],
    values: Sequence[str],
    alignment: str = "clock_state",
    by: Sequence[str] = PATH,
    time: str = "t",
    seq: Sequence[str] = (),
    max_state_age_seconds: float | None = None,
    max_lag_seconds: float | None = None,
    source_cutoff_seconds: float = 0.0,
    day: str = "date",
) -> DataFrame:
    """One state per path and decision clock.

    ``clock_state`` takes the last state at or before target minus the cutoff,
    ``next_tick`` the first at or after the target. Unmatched clocks are dropped.
    """
    if alignment not in ("clock_state", "next_tick"):
        raise ValueError("alignment is clock_state or next_tick")
    if source_cutoff_seconds < 0 or (source_cutoff_seconds and alignment == "next_tick"):
        raise ValueError("a source cutoff must be >= 0 and needs clock_state")
    targets = clock_targets(ticks, clocks, by, day).withColumn(
        "cutoff", F.col("target") - F.lit(int(source_cutoff_seconds * SECOND))
    )
    backward = alignment == "clock_state"
    bound = max_state_age_seconds if backward else max_lag_seconds
    found = asof(
        targets, ticks, by, "cutoff", time, values,
        direction="backward" if backward else "forward",
        tolerance=None if bound is None else int(bound * SECOND),
        seq=seq,
    ).where(F.col(time).isNotNull())
    gap = (F.col("target") - F.col(time)) / float(SECOND)
    if backward:
        return found.withColumns({"state_age_seconds": gap, "lag_seconds": F.lit(0.0)})
    return found.withColumn("lag_seconds", -gap)


def sample_rows(ticks: DataFrame, mode: str = "decision_points", **options) -> DataFrame:
    """All tick rows, or decision points."""
    if mode in ("all", "all_ticks", "tick", ""):
        return ticks
    if mode in ("decision", "decision_point", "decision_points"):
        return sample_decisions(ticks, **options)
    raise ValueError("mode is all_ticks or decision_points")


def state_at(
    rows: DataFrame,
    states: DataFrame,
    at: str,
    seconds: float,
    values: Sequence[str],
    suffix: str,
    by: Sequence[str] = PATH,
    time: str = "t",
    seq: Sequence[str] = (),
    direction: str = "backward",
    max_gap_seconds: float | None = None,
) -> DataFrame:
    """Append the state at (row time + seconds): last known (backward) or next (forward)."""
    shifted = rows.withColumn("_at", F.col(at) + F.lit(int(seconds * SECOND)))
    found = asof(
        shifted, states, by, "_at", time, values, direction=direction, seq=seq, prefix="_m_",
        tolerance=None if max_gap_seconds is None else int(max_gap_seconds * SECOND),
    )
    sign = 1.0 if direction == "backward" else -1.0
    return found.select(
        *rows.columns,
        F.col(f"_m_{time}").alias(f"{time}_{suffix}"),
        (sign * (F.col("_at") - F.col(f"_m_{time}")) / float(SECOND)).alias(f"{suffix}_age_seconds"),
        *[F.col(f"_m_{v}").alias(f"{v}_{suffix}") for v in values],
    )


def nth_next(
    ticks: DataFrame,
    n: int,
    values: Sequence[str],
    suffix: str,
    by: Sequence[str] = PATH,
    order: Sequence[str] = ("t", "seq"),
    max_gap_seconds: float | None = None,
) -> DataFrame:
    """Append the n-th next row of the path, its delay and the largest gap on the way.

    With a gap bound, a path that breaks it (or is incomplete) yields NULLs.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    time = order[0]

    def gaps(w):
        return {"_step": (F.col(time) - F.lag(time).over(w)) / float(SECOND)}

    def reads(w):
        then = F.lead(time, n).over(w) if n else F.col(time)
        ahead = w.rowsBetween(1, n) if n else None
        full = F.count("_step").over(ahead) == n if n else F.lit(True)
        worst = F.when(full, F.max("_step").over(ahead)) if n else F.lit(0.0)
        out = {
            f"{time}_{suffix}": then,
            f"{suffix}_delay_ticks": F.when(then.isNotNull(), F.lit(float(n))),
            f"{suffix}_delay_seconds": (then - F.col(time)) / float(SECOND),
            f"{suffix}_max_gap_seconds": worst,
        }
        for v in values:
            out[f"{v}_{suffix}"] = F.lead(v, n).over(w) if n else F.col(v)
        return out

    stepped = framed(ticks, by, order, gaps, before=1)
    out = framed(stepped, by, order, reads, before=1, after=n).drop("_step")
    if max_gap_seconds is None:
        return out
    worst = F.col(f"{suffix}_max_gap_seconds")
    fine = F.coalesce((worst >= 0) & (worst <= max_gap_seconds), F.lit(False))
    added = [c for c in out.columns if c not in ticks.columns]
    return out.withColumn("_fine", fine).select(
        *ticks.columns, *[F.when(F.col("_fine"), F.col(c)).alias(c) for c in added]
    )


def delayed_entries(
    ticks: DataFrame,
    clocks: Sequence[str],
    delay_seconds: float,
    price: str,
    status: str,
    by: Sequence[str] = PATH,
    time: str = "t",
    seq: Sequence[str] = (),
    day: str = "date",
) -> DataFrame:
    """Decision state and entry state (target + delay) per path and clock, with readiness flag.

    Both reads are two target rows of one as-of pass, folded back per key.
    """
    targets = clock_targets(ticks, clocks, by, day)
    kinds = F.array(
        F.struct(F.lit("decision").alias("kind"), F.lit(0).alias("shift")),
        F.struct(F.lit("entry").alias("kind"), F.lit(int(delay_seconds * SECOND)).alias("shift")),
    )
    asked = targets.withColumn("_k", F.explode(kinds)).select(
        *targets.columns, F.col("_k.kind").alias("kind"), (F.col("target") + F.col("_k.shift")).alias("at")
    )
    read = asof(asked, ticks, by, "at", time, [price, status], seq=seq)
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    base = (
        read.groupBy(*targets.columns)
        .agg(
            pick(time, "decision").alias("source"),
            pick("at", "entry").alias("entry"),
            pick(time, "entry").alias("_entry_source"),
            pick(price, "entry").alias("buy_price"),
            pick(status, "decision").alias("status"),
            pick(status, "entry").alias("entry_status"),
        )
        .where(F.col("source").isNotNull() & F.col("_entry_source").isNotNull())
        .drop("_entry_source")
    )
    return require_ready(base, [day, "target"], "source", "entry")


def require_ready(
    rows: DataFrame, group: Sequence[str], source: str, entry: str, out: str = "entry_after_ready"
) -> DataFrame:
    """Flag rows whose entry is not before the latest source state of their cross-section."""
    ready = group_columns(rows, group, {"_ready": F.max(source)})
    flag = F.coalesce(F.col(entry) >= F.col("_ready"), F.lit(False))
    return ready.withColumn(out, flag).drop("_ready")


def exact_lag(
    rows: DataFrame, keys: Sequence[str], time: str, shift: int, values: Sequence[str], suffix: str
) -> DataFrame:
    """Append values of the row exactly ``shift`` time units earlier; nothing is bridged.

    An equi join on the shifted time: no window over a path.
    """
    earlier = rows.select(
        *keys, (F.col(time) + F.lit(shift)).alias(time), *[F.col(v).alias(f"{v}_{suffix}") for v in values]
    )
    return rows.join(earlier, [*keys, time], "left")


def latest_per_key(
    ticks: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str
) -> DataFrame:
    """Value at the highest order tuple per key, and the highest leading order column (argMax)."""
    return ticks.groupBy(*keys).agg(
        F.max_by(F.col(value), F.struct(*order)).alias(out), F.max(order[0]).alias(f"max_{order[0]}")
    )


def first_quote_mid(
    ticks: DataFrame,
    clocks: Sequence[str],
    max_lag_seconds: float,
    bid: str,
    ask: str,
    by: Sequence[str] = PATH,
    time: str = "t",
    day: str = "date",
) -> DataFrame:
    """Mid price at the first two-sided quote in [clock, clock + lag] per path and clock."""
    quotes = ticks.where((F.col(bid) > 0) & (F.col(ask) > 0)).withColumn(
        "mid", (F.col(bid) + F.col(ask)) / 2.0
    )
    targets = clock_targets(ticks, clocks, by, day)
    found = asof(
        targets, quotes, by, "target", time, ["mid"], direction="forward",
        tolerance=int(max_lag_seconds * SECOND),
    )
    return found.where(F.col("mid").isNotNull())


def in_windows(time_of_day_us: Column, windows: Sequence[tuple[int, int]]) -> Column:
    """Membership in a union of disjoint [start, end) offset windows; overlap is an error."""
    spans = sorted(windows)
    if not spans or any(a >= b for a, b in spans):
        raise ValueError("each window needs start < end")
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:])):
        raise ValueError("windows overlap")
    inside = F.lit(False)
    for start, end in spans:
        inside = inside | ((time_of_day_us >= start) & (time_of_day_us < end))
    return inside


