"""Daily series of named runs: fees, capital, cumulative and relative returns, calendars without gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, finite, safe_div
from tickloom.operators.groups import attach, position, running

MEAN = "Mean"


def named_runs(runs: dict[str, DataFrame], columns: Sequence[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One table of several runs, told apart by ``series`` and ``series_label``; columns that a run lacks are NULL there."""
    given = labels or {}
    parts = [
        df.select(F.lit(name).alias("series"), F.lit(given.get(name, name)).alias("series_label"), *[c for c in columns if c in df.columns])
        for name, df in runs.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_fees(
    daily: DataFrame,
    returns: dict[str, str],
    reference: dict[str, str],
    fee_bps: float,
    turnover: DataFrame | None = None,
    round_trip: bool = False,
    date: str = "date",
) -> DataFrame:
    """Net returns: the selection pays the whole fee, the reference pays by how much of it changes.

    ``returns`` and ``reference`` map new columns to gross ones. The reference's turnover is 1 for a round trip, else that
    of ``turnover(date, turnover)`` where it knows the day, else selected over candidate rows between 0 and 1;
    ``turnover_source`` says which.
    """
    estimate = clip(F.coalesce(safe_div("selected_rows", "candidate_rows"), F.lit(0.0)), 0.0, 1.0)
    rows = daily
    if round_trip:
        share, source = F.lit(1.0), F.lit("round_trip")
    elif turnover is not None:
        rows = attach(daily, turnover.select(date, F.col("turnover").alias("_turnover")), [date])
        share = F.coalesce("_turnover", estimate)
        source = F.when(F.col("_turnover").isNotNull(), "membership").otherwise("selected_over_candidates")
    else:
        share, source = estimate, F.lit("selected_over_candidates")
    rows = rows.withColumns({"reference_turnover": share, "turnover_source": source}).withColumns(
        {"fee_bps": F.lit(float(fee_bps)), "reference_fee_bps": F.col("reference_turnover") * float(fee_bps)}
    )
    net = {out: F.col(c) - F.col("fee_bps") for out, c in returns.items()}
    net |= {out: F.col(c) - F.col("reference_fee_bps") for out, c in reference.items()}
    return rows.withColumns(net).drop("_turnover")


def cumulated(daily: DataFrame, columns: dict[str, str], capital: float = 1.0, by: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """Running sums of capital-scaled columns per series, missing as 0: ``{out: column}``."""
    scaled = daily.withColumns({f"_x_{out}": F.coalesce(F.col(c) * capital, F.lit(0.0)) for out, c in columns.items()})
    summed = running(scaled, list(by), [date], {out: ("sum", f"_x_{out}") for out in columns})
    return summed.drop(*[f"_x_{out}" for out in columns])


def on_calendar(daily: DataFrame, sessions: DataFrame, by: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """A row for every session between the first and the last one of each series, with NULLs where the series has none."""
    ends = daily.groupBy(*by).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    # a calendar and a list of runs: one row per session and run
    spine = ends.join(sessions.select(date).distinct(), F.col(date).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    return spine.join(daily, [*by, date], "left")


def require_no_gaps(daily: DataFrame, sessions: DataFrame, by: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """``daily``, if no series misses a session between its first and last one."""
    gaps = on_calendar(daily.select(*by, date, F.lit(1).alias("_there")), sessions, by, date).where("_there IS NULL")
    some = gaps.select(*by, date).orderBy(*by, date).limit(5).collect()
    if some:
        raise ValueError(f"sessions missing in a series, e.g. {[tuple(r) for r in some]}")
    return daily


def replace_reference(daily: DataFrame, realised: DataFrame, column: str, by: str, date: str = "date") -> DataFrame:
    """``column`` taken from ``realised(date, by)`` instead; a day that has none there is an error."""
    joined = attach(daily.drop(column), realised.select(date, F.col(by).alias(column)), [date])
    missing = joined.where(finite(column).isNull()).select(date).distinct().orderBy(date).limit(5).collect()
    if missing:
        raise ValueError(f"days without a realised reference, e.g. {[r[0] for r in missing]}")
    return joined


def weekly(daily: DataFrame, sums: Sequence[str], by: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """Sums and days per series and week; a week is named by its Monday."""
    week = F.date_format(F.date_trunc("week", F.col(date).cast("date")), "yyyy-MM-dd")
    return daily.groupBy(*by, week.alias("week_start")).agg(F.count(F.lit(1)).alias("days"), *[F.sum(c).alias(c) for c in sums])


def relative_to(
    table: DataFrame, reference: str, columns: dict[str, str], on: str = "week_start", series: str = "series", required: bool = True
) -> DataFrame:
    """Columns less those of the reference series in the same period, for all other series: ``{out: column}``.

    A reference without rows is an error, and so is a period that it lacks, unless ``required`` is off; then it is NULL.
    """
    base = table.where(F.col(series) == reference).select(on, *[F.col(c).alias(f"_ref_{c}") for c in columns.values()], F.lit(True).alias("_there"))
    if base.isEmpty():
        raise ValueError(f"no rows of the reference {reference!r}")
    joined = attach(table.where(F.col(series) != reference), base, [on])
    if required:
        gaps = joined.where("_there IS NULL").select(on).distinct().orderBy(on).limit(5).collect()
        if gaps:
            raise ValueError(f"the reference {reference!r} lacks {[r[0] for r in gaps]}")
    out = joined.withColumns({name: F.col(c) - F.col(f"_ref_{c}") for name, c in columns.items()})
    return out.drop("_there", *[f"_ref_{c}" for c in columns.values()])


def month_table(monthly: DataFrame, metrics: Sequence[str], month: str = "month", series: str = "series") -> DataFrame:
    """Monthly rows of all series and a mean row each, numbered month by month with the means last."""
    means = monthly.groupBy(series).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(month, F.lit(MEAN))
    rows = monthly.select(series, month, *metrics).unionByName(means.select(series, month, *metrics))
    marked = rows.withColumn("_last", (F.col(month) == MEAN).cast("int"))
    return position(marked, [], ["_last", month, series], out="place").drop("_last")
