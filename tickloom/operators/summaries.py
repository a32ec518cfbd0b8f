"""Table and label summaries, concentration, availability and run comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import BPS, drawn, finite, safe_div, share, truthy, weighted_mean
from tickloom.operators.groups import attach, counted_quantiles, over, quantiles, top_rows


def dataset_summary(df: DataFrame, label: str, date: str = "date", symbol: str = "symbol", clock: str = "clock") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(date).alias("dates"),
        F.count_distinct(symbol).alias("symbols"),
        F.min(clock).alias("first_clock"),
        F.max(clock).alias("last_clock"),
        F.count(label).alias("labels"),
        F.avg(F.col(label).isNull().cast("double")).alias("label_null_rate"),
    )


def source_health(
    df: DataFrame, by: Sequence[str], tradable: Column, ask: str, bid: str, symbol: str = "symbol"
) -> DataFrame:
    """Row counts and conditional counts per layout (day, year, symbol, ...)."""
    a, b = F.col(ask), F.col(bid)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(symbol).alias("symbols"),
        F.count_if(truthy(tradable)).alias("tradable_rows"),
        F.count_if(truthy(a > 0)).alias("ask_rows"),
        F.count_if(truthy(b > 0)).alias("bid_rows"),
        F.count_if(truthy((a > 0) & (b > 0) & (b >= a))).alias("crossed_rows"),
    )


def largest_groups(counts: DataFrame, size: str, order: Sequence[str], k: int) -> DataFrame:
    return counts.orderBy(F.col(size).desc(), *order).limit(k)


def label_distribution(
    df: DataFrame, label: str, fees: Sequence[float], by: Sequence[str], valid: Column | None = None,
    checks: dict[str, Column] | None = None,
) -> DataFrame:
    """Per fee and group: valid rows and share, mean, std, quantiles, extremes and quality rates.

    A fee only shifts values, so the group is scanned once and each fee moves its statistics.
    """
    ok = truthy(valid) if valid is not None else finite(label).isNotNull()
    rows = df.withColumn("_v", F.when(ok, finite(label)))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("_v").alias("valid_rows"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        *[F.avg(truthy(c).cast("double")).alias(f"{n}_rate") for n, c in (checks or {}).items()],
    )
    cuts = {f"p{int(p * 100):02d}": p for p in (0.01, 0.05, 0.5, 0.95, 0.99)}
    out = attach(stats, quantiles(rows, list(by), "_v", cuts), list(by))
    out = out.withColumn("fee_bps", F.explode(F.array(*[F.lit(float(f)) for f in fees])))
    shifted = {c: F.col(c) - F.col("fee_bps") / BPS for c in ["mean", "min", "max", *cuts]}
    return out.withColumns({**shifted, "valid_ratio": F.col("valid_rows") / F.col("rows")})


def target_summary(df: DataFrame, target: str, raw: str, valid: Column, group: Sequence[str]) -> DataFrame:
    ok = truthy(valid)
    cell = F.struct(*group)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_distinct(F.when(ok, cell)).alias("groups"),
        F.avg(F.when(ok, F.col(target))).alias("target_mean"),
        F.stddev_pop(F.when(ok, F.col(target))).alias("target_std"),
        F.avg(F.when(ok, F.col(raw))).alias("raw_mean"),
        F.stddev_pop(F.when(ok, F.col(raw))).alias("raw_std"),
    )


def concentration(df: DataFrame, by: Sequence[str], value: str, weight: Column, prefix: str = "") -> DataFrame:
    """Weighted concentration per group: distinct values, largest and top-5 share, HHI, 1 / HHI.

    Weights are first summed by value, map-side, so repeated values shrink before any ordering.
    """
    used = df.where(F.col(value).isNotNull() & (weight > 0))
    sums = used.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    totals = sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{prefix}unique"),
        F.sum("_w").alias("_t"),
        F.max("_w").alias("_max"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sq"),
    )
    top = top_rows(sums, by, [F.col("_w").desc(), F.col(value)], 5, "_p").groupBy(*by).agg(F.sum("_w").alias("_top"))
    t = F.col("_t")
    hhi = safe_div("_sq", t * t)
    return attach(totals, top, by).select(
        *by, f"{prefix}unique",
        safe_div("_max", t).alias(f"{prefix}max_share"),
        safe_div("_top", t).alias(f"{prefix}top5_share"),
        hhi.alias(f"{prefix}hhi"),
        safe_div(F.lit(1.0), hhi).alias(f"{prefix}effective"),
    )


def yearly_metrics(windows: DataFrame, year: str, sums: Sequence[str], maxima: Sequence[str], means: Sequence[str], weight: str) -> DataFrame:
    """Window metrics to years: sums, maxima, row-weighted means."""
    return windows.groupBy(year).agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxima],
        *[weighted_mean(c, F.col(weight).cast("double")).alias(c) for c in means],
    )


def month_starts(sessions: DataFrame, date: str = "date") -> DataFrame:
    """First session of each month."""
    return sessions.groupBy(F.substring(date, 1, 7).alias("month")).agg(F.min(date).alias(date))


def availability(
    df: DataFrame, receipt: str, decision: str, source: str, grains: Sequence[Sequence[str]], all_keys: Sequence[str]
) -> DataFrame:
    """Receipt coverage, late shares and delay / age quantiles at several grains in one pass.

    Rows are expanded to the grains (NULL keys stand for all), as native grouping sets would.
    """
    late = (F.col(receipt) - F.col(decision)) / 1e6
    age = (F.col(decision) - F.col(source)) / 1e6
    base = df.select(*all_keys, late.alias("_late"), age.alias("_age"))
    cells = F.array(
        *[
            F.struct(
                F.lit("+".join(g) if g else "all").alias("grain"),
                *[(F.col(k) if k in g else F.lit(None).cast("string")).alias(f"_{k}") for k in all_keys],
            )
            for g in grains
        ]
    )
    rows = base.select("_late", "_age", F.inline(cells)).select(
        "grain", "_late", "_age", *[F.coalesce(f"_{k}", F.lit("*")).alias(k) for k in all_keys]
    )
    keys = ["grain", *all_keys]
    x = F.col("_late")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("states"),
        F.count(x).alias("with_receipt"),
        *[share(x > float(s)).alias(f"late_over_{s}s") for s in (0, 2, 6)],
    )
    delay = quantiles(rows, keys, "_late", {"delay_p50": 0.5, "delay_p99": 0.99})
    ages = quantiles(rows, keys, "_age", {"age_p50": 0.5, "age_p99": 0.99})
    return attach(attach(stats, delay, keys), ages, keys)


def compare_runs(yearly: DataFrame, run: str, year: str, metric: str) -> DataFrame:
    """Per run: mean, positive years, best and worst year, first-to-last change, minimum."""
    m = F.col(metric)
    return yearly.groupBy(run).agg(
        F.count(F.lit(1)).alias("years"),
        F.avg(m).alias("mean"),
        F.count_if(m > 0).alias("positive_years"),
        F.max_by(year, F.struct(m, year)).alias("best_year"),
        F.min_by(year, F.struct(m, year)).alias("worst_year"),
        (F.max_by(m, F.col(year)) - F.min_by(m, F.col(year))).alias("first_to_last_change"),
        F.min(m).alias("minimum"),
    )


def mergeable_moments(df: DataFrame, variables: Sequence[str], state: str, by: Sequence[str] = ()) -> DataFrame:
    """Moments per variable and state, and each state's share of rows, squares and absolute mass."""
    base = [*by, state]
    long = df.select(*base, *variables).unpivot(base, list(variables), "variable", "v").where("v is not null")
    v = F.col("v")
    stats = long.groupBy(*by, "variable", state).agg(
        F.count(v).alias("rows"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.sum(F.abs(v)).alias("absolute"),
        F.count_if(v > 0).alias("positives"), F.count_if(v == 0).alias("zeros"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
    )
    n = F.col("rows")
    mean = F.col("total") / n
    w = over([*by, "variable"])  # one row per state
    return stats.select(
        *by, "variable", state, "rows", "positives", "zeros", "minimum", "maximum",
        mean.alias("mean"),
        F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))).alias("std"),
        (n / F.sum("rows").over(w)).alias("row_share"),
        safe_div("squares", F.sum("squares").over(w)).alias("square_share"),
        safe_div("absolute", F.sum("absolute").over(w)).alias("absolute_share"),
    )


def value_counts(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How often each value of each variable stands in a part: a summary of its order that can be merged.

    Missing and non-finite values are left out.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), finite(c).alias("value")) for c in variables])
    long = df.select(*by, F.inline(cells)).where("value IS NOT NULL")
    return long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One table of counts from those of parts; keys of the parts that are not in ``by`` are summed away."""
    keys = [*by, "variable", "value"]
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(*keys, "n") for p in parts])
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def quantiles_of_counts(counts: DataFrame, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct values and exact quantiles per variable from its counts: those of the whole data."""
    keys = [*by, "variable"]
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    return attach(sizes, counted_quantiles(counts, keys, "value", "n", shares), keys)


def keyed_sample(df: DataFrame, by: Sequence[str], unique: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most n rows per group, the same for a given seed whatever the partitioning."""
    order = drawn(seed, *unique)
    return top_rows(df, by, [order, *[F.col(c) for c in unique]], n, "_p").drop("_p")


def widen(long: DataFrame, by: Sequence[str], name: str, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long threshold rows to columns ``<name>_<metric>``; the names are given, so nothing is scanned for them."""
    picks = [F.max(F.when(F.col(name) == n, F.col(m))).alias(f"{n}_{m}") for n in names for m in metrics]
    return long.groupBy(*by).agg(*picks)


def paired_grid(df: DataFrame, by: Sequence[str], level: str, pair: tuple[str, str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two levels side by side and their difference, one row per metric."""
    long = df.select(*by, level, *metrics).unpivot([*by, level], list(metrics), "metric", "value")
    at = lambda v: F.max(F.when(F.col(level) == v, F.col("value")))
    return long.groupBy(*by, "metric").agg(
        at(pair[0]).alias(pair[0]), at(pair[1]).alias(pair[1]), (at(pair[1]) - at(pair[0])).alias("effect")
    )


def date_weight(date: Column, start: str, end: str, low: float, high: float) -> Column:
    """Sample weight linear in the date between two bounds, constant outside."""
    d = F.datediff(date.cast("date"), F.lit(start).cast("date")).cast("double")
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")).cast("double")
    part = F.least(F.greatest(safe_div(d, span), F.lit(0.0)), F.lit(1.0))
    return F.lit(low) + part * (high - low)
