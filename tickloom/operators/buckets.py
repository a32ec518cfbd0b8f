"""Rank-bucket curves, rank ICs by scope, exact-rank curves and return histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import BPS, above_zero, correlation, finite, safe_div, share
from tickloom.operators.evaluate import newey_west, with_place
from tickloom.operators.groups import attach, carry, carry_copies, group_columns, over, quantiles, ranks, running


def ranked_rows(df: DataFrame, keys: Sequence[str], score: str, label: str, unique: Sequence[str]) -> DataFrame:
    """Score place, group size, excess over the group mean (bps) and the realised descending rank share."""
    work = with_place(df, keys, score, unique, out="score_rank", total="group_size")
    work = group_columns(work, keys, {"pool_mean": F.avg(label)})
    excess = (F.col(label) - F.col("pool_mean")) * BPS
    work = carry(work.withColumns({"excess_bps": excess, "_down": -F.col(label)}), work)
    work = ranks(work, keys, "_down", {"realized_pct": "average_pct"})
    return carry(work.drop("_down", "pool_mean"), work)


def _stability(df: DataFrame, grain: Sequence[str], value: str, month: str) -> DataFrame:
    monthly = df.groupBy(*grain, month).agg(F.avg(value).alias("_m"))
    return monthly.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("months"),
        F.count_if(above_zero("_m")).alias("positive_months"),
        F.min("_m").alias("month_min"),
        F.max("_m").alias("month_max"),
    )


def bucket_summary(
    ranked: DataFrame, widths: Sequence[int], top_n: int, month: str = "month", by: Sequence[str] = ()
) -> DataFrame:
    """Rank buckets of several widths: mean, parts, tails, hit rates and monthly stability."""
    listed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(top_n // w * w).alias("last")) for w in widths])
    rows = (
        ranked.where(F.col("score_rank") <= top_n)
        .withColumn("_w", F.explode(listed))
        .where(F.col("score_rank") <= F.col("_w.last"))
        .withColumns(
            {
                "bucket_width": F.col("_w.w"),
                "bucket": (F.floor((F.col("score_rank") - 1) / F.col("_w.w")) + 1).cast("int"),
            }
        )
    )
    e = F.col("excess_bps")
    grain = [*by, "bucket_width", "bucket"]
    stats = rows.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(e).alias("mean_excess_bps"),
        share(above_zero(e)).alias("positive_excess_rate"),
        F.avg(F.greatest(e, F.lit(0.0))).alias("positive_part_bps"),
        F.avg(F.least(e, F.lit(0.0))).alias("negative_part_bps"),
        share(F.col("realized_pct") <= 0.05).alias("realized_top5_rate"),
        share(F.col("realized_pct") <= 0.10).alias("realized_top10_rate"),
        *[share(e >= float(b)).alias(f"big_win_{b}bps_rate") for b in (100, 300, 500)],
    )
    cuts = {"median_excess_bps": 0.5, "p90_excess_bps": 0.9, "p95_excess_bps": 0.95, "p99_excess_bps": 0.99}
    tails = quantiles(rows, grain, "excess_bps", cuts)
    return attach(attach(stats, tails, grain), _stability(rows, grain, "excess_bps", month), grain)


def shape_summary(ranked: DataFrame, cuts: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and hit rates of the top k rows, for several k."""
    rows = ranked.where(F.col("score_rank") <= max(cuts)).withColumn(
        "top_k", F.explode(F.array(*[F.lit(k) for k in cuts]))
    ).where(F.col("score_rank") <= F.col("top_k"))
    grain = [*by, "top_k"]
    stats = rows.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("excess_bps").alias("mean_excess_bps"),
        share(above_zero("excess_bps")).alias("positive_excess_rate"),
        share(F.col("realized_pct") <= 0.10).alias("realized_top10_rate"),
    )
    return attach(stats, quantiles(rows, grain, "excess_bps", {"median_excess_bps": 0.5}), grain)


def variant_mean(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "mean") -> DataFrame:
    """The variants plus one averaged variant."""
    mean = df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("variant", F.lit(name))
    return df.select("variant", *keys, *metrics).unionByName(mean)


def scope_ic(
    ranked: DataFrame, keys: Sequence[str], score: str, scopes: dict[str, tuple[int, int]], complete: bool = True
) -> DataFrame:
    """Spearman inside rank windows (start, end] per group: top-k, buckets, sliding windows alike.

    Each row is copied only to the scopes that hold its place, then re-ranked inside them.
    ``complete`` drops scopes that the group does not fill.
    """
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("scope"), F.lit(a).alias("first"), F.lit(b).alias("last"))
            for n, (a, b) in scopes.items()
        ]
    )
    place = F.col("score_rank")
    holds = F.filter(listed, lambda s: (place > s["first"]) & (place <= s["last"]))
    kept = [*keys, "group_size", score, "excess_bps", *[c for c in ("month",) if c in ranked.columns]]
    rows = ranked.select(*kept, place, F.inline(holds))
    if complete:
        rows = rows.where(F.col("group_size") >= F.col("last"))
    cells = [*keys, "scope"]
    both = ranks(ranks(rows, cells, score, {"_rs": "average"}), cells, "excess_bps", {"_re": "average"})
    month = [F.first("month").alias("month")] if "month" in ranked.columns else []
    return both.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("rows"), correlation("_rs", "_re").alias("spearman_ic"), *month
    )


def ic_summary(ic: DataFrame, grain: Sequence[str], value: str = "spearman_ic", month: str | None = "month") -> DataFrame:
    """Groups, mean, quantiles and positive share of an IC, with monthly stability."""
    stats = ic.groupBy(*grain).agg(
        F.count(value).alias("groups"), F.avg(value).alias("mean_ic"), share(above_zero(value)).alias("positive_rate")
    )
    cuts = quantiles(ic, grain, value, {"median_ic": 0.5, "p10_ic": 0.1, "p90_ic": 0.9})
    out = attach(stats, cuts, grain)
    return attach(out, _stability(ic, grain, value, month), grain) if month else out


def group_ic(
    ranked: DataFrame, keys: Sequence[str], score: str, label: str, scopes: dict[str, int | None]
) -> DataFrame:
    """Four correlations per group and scope (None is the whole pool): rank-rank, rank-raw, raw-raw, reversed."""
    top = F.array(*[F.struct(F.lit(n).alias("scope"), F.lit(k if k else 2**62).alias("k")) for n, k in scopes.items()])
    place = F.col("score_rank")
    rows = ranked.select(*keys, score, label, F.inline(F.filter(top, lambda s: place <= s["k"])))
    cells = [*keys, "scope"]
    both = ranks(ranks(rows, cells, score, {"_rs": "average"}), cells, label, {"_rl": "average"})
    rank_rank = correlation("_rs", "_rl")
    return both.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("rows"),
        rank_rank.alias("rank_ic"),
        correlation("_rs", label).alias("rank_raw_ic"),
        correlation(score, label).alias("raw_ic"),
        (-rank_rank).alias("reverse_rank_ic"),
    )


def daily_ic_summary(ic: DataFrame, metrics: Sequence[str], date: str, by: Sequence[str], lag: int = 5) -> DataFrame:
    """Daily means of the ICs, then mean, t, HAC t and interval and annualised ratio per metric."""
    daily = ic.groupBy(*by, date).agg(*[F.avg(m).alias(m) for m in metrics])
    long = daily.unpivot([*by, date], list(metrics), "metric", "value").where("value is not null")
    grain = [*by, "metric"]
    stats = long.groupBy(*grain).agg(
        F.count("value").alias("observations"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        share(above_zero("value")).alias("positive_rate"),
    )
    hac = newey_west(long, "value", date, lag, grain).select(*grain, "se")
    out = attach(stats, hac, grain)
    m, s, se = F.col("mean"), F.col("std"), F.col("se")
    return out.select(
        *grain, "observations", "mean", "std", "positive_rate",
        safe_div(m * F.sqrt("observations"), F.when(s > 0, s)).alias("ordinary_t"),
        safe_div(m, F.when(se > 0, se)).alias("hac_t"),
        (m - 1.96 * se).alias("hac_low"),
        (m + 1.96 * se).alias("hac_high"),
        (safe_div(m, F.when(s > 0, s)) * math.sqrt(252)).alias("annualised_ir"),
    )


def bucket_curve(
    ranked: DataFrame, keys: Sequence[str], counts: Sequence[int], label: str, top_n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(bucket curve, bucket rank IC per group) for several bucket counts, of the top rows or the pool."""
    scoped = ranked if top_n is None else carry(ranked.where(F.col("score_rank") <= top_n), ranked)
    work = ranks(scoped, keys, label, {"_outcome": "average_pct"})
    size = F.col("group_size") if top_n is None else F.lit(top_n)
    n = F.col("bucket_count")
    rows = work.withColumn("bucket_count", F.explode(F.array(*[F.lit(c) for c in counts]))).withColumn(
        "bucket", F.least(n, (F.floor((F.col("score_rank") - 1) * n / size) + 1)).cast("int")
    )
    cells = rows.groupBy(*keys, "bucket_count", "bucket").agg(
        F.avg("excess_bps").alias("_e"), F.avg("_outcome").alias("_o")
    )
    width = F.lit(100.0 if top_n is None else float(top_n))
    curve = cells.groupBy("bucket_count", "bucket").agg(
        F.count("_e").alias("groups"),
        F.try_divide(F.sum("_e"), F.count("_e")).alias("mean_excess_bps"),
        F.try_divide(F.sum("_o"), F.count("_o")).alias("mean_outcome_rank_pct"),
    ).withColumn("x", (F.col("bucket") - 0.5) * width / n)
    # at most max(counts) cells per group: the window below is small by construction
    w = over([*keys, "bucket_count"], ["_e"])
    peers = F.count("_e").over(w) - F.rank().over(w) + 1
    ranked_cells = cells.withColumn("_re", F.rank().over(w) + (peers - 1) / 2.0)
    ic = ranked_cells.groupBy(*keys, "bucket_count").agg(
        correlation(-F.col("bucket").cast("double"), "_re").alias("bucket_rank_ic")
    )
    return curve, ic


def curve_rank_ic(curve: DataFrame, by: Sequence[str] = ("bucket_count",)) -> DataFrame:
    """Rank correlation of the bucket order with the mean excess of a curve."""
    ranked = ranks(curve, list(by), "mean_excess_bps", {"_re": "average"})
    return ranked.groupBy(*by).agg(correlation(-F.col("bucket").cast("double"), "_re").alias("curve_rank_ic"))


def exact_rank_curve(ranked: DataFrame, top_n: int) -> DataFrame:
    """Mean excess at each exact place."""
    return ranked.where(F.col("score_rank") <= top_n).groupBy("score_rank").agg(
        F.count("excess_bps").alias("observations"), F.avg("excess_bps").alias("mean_excess_bps")
    )


def exact_curve_summary(curve: DataFrame, head: int, top_n: int) -> DataFrame:
    """Correlations of the exact-rank curve and its head-minus-tail difference: one row."""
    ranked = ranks(curve, [], "mean_excess_bps", {"_re": "average"})
    order, e = -F.col("score_rank").cast("double"), F.col("mean_excess_bps")
    first = F.avg(F.when(F.col("score_rank") <= head, e))
    last = F.avg(F.when(F.col("score_rank") > top_n - head, e))
    return ranked.agg(
        F.count(F.lit(1)).alias("points"),
        correlation(order, "_re").alias("spearman_ic"),
        correlation(order, e).alias("pearson_ic"),
        first.alias("head_mean_bps"),
        last.alias("tail_mean_bps"),
        (first - last).alias("head_minus_tail_bps"),
    )


def sub_buckets(curve: DataFrame, top_k: int, width: int) -> DataFrame:
    """Sub-buckets of the exact-rank curve."""
    return curve.where(F.col("score_rank") <= top_k).groupBy(
        (F.floor((F.col("score_rank") - 1) / width) + 1).cast("int").alias("subbucket")
    ).agg(
        F.min("score_rank").alias("start_rank"),
        F.max("score_rank").alias("end_rank"),
        F.sum("observations").alias("rows"),
        F.avg("mean_excess_bps").alias("mean_excess_bps"),
        F.min("mean_excess_bps").alias("min_mean_bps"),
        F.max("mean_excess_bps").alias("max_mean_bps"),
    )


def return_histogram(
    df: DataFrame, value: str, width: int, by: Sequence[str] = (), positive_only: bool = False
) -> DataFrame:
    """Fixed-width histogram with empty bins between the outer ones; shares within ``by``."""
    rows = df.where(F.col(value) >= 0) if positive_only else df.where(F.col(value).isNotNull())
    lower = (F.floor(F.col(value) / width) * width).cast("long")
    counts = rows.groupBy(*by, lower.alias("lower_bps")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.lit(0).cast("long") if positive_only else F.min("lower_bps")
    edges = counts.agg(F.sequence(first, F.max("lower_bps"), F.lit(width).cast("long")).alias("_edges"))
    grid = edges.select(F.explode("_edges").alias("lower_bps"))
    if by:
        grid = counts.select(*by).distinct().crossJoin(grid)  # groups x bins, both small
    filled = grid.join(counts, [*by, "lower_bps"], "left").withColumn("observations", F.coalesce("_n", F.lit(0)))
    total = F.sum("observations").over(over(list(by)))
    return filled.select(
        *by, "lower_bps", (F.col("lower_bps") + width).alias("upper_bps"), "observations",
        safe_div("observations", total).alias("share"),
    )


def return_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, mean and tail quantiles of returns."""
    v = F.col(value)
    stats = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("observations"), F.count_if(v < 0).alias("negative"), share(v >= 0).alias("nonnegative_rate"),
        F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
    )
    cuts = {f"p{int(p * 100):02d}": p for p in (0.01, 0.05, 0.10, 0.50, 0.90, 0.95, 0.99)}
    tails = quantiles(df, list(by), value, cuts)
    return attach(stats, tails, list(by))


def limit_reference(df: DataFrame, price: str, prev: str, upper: str, ask: str, near_bps: float = 50.0) -> DataFrame:
    """Rule-based upper limit (5, 10 or 20 %), whether it is the stated one, and point-in-time state flags."""
    p, base, stated = F.col(price), F.col(prev), F.col(upper)
    rule = F.lit(None).cast("double")
    rate = F.lit(None).cast("int")
    for percent in (20, 10, 5):
        expected = F.floor(base * (100.0 + percent) / 100.0 * 100.0 + 0.50000001) / 100.0
        fits = F.abs(stated - expected) <= 0.005 + 1e-9
        rate = F.when(fits, percent).otherwise(rate)
        rule = F.when(fits, expected).otherwise(rule)
    out = df.withColumns({"limit_rate": rate, "rule_limit": rule})
    at = F.coalesce(p >= stated - 0.005, F.lit(False))
    no_offer = F.coalesce(F.col(ask) <= 0, F.lit(True))
    room = safe_div(stated - p, p) * BPS
    return out.withColumns(
        {
            "standard_limit": F.col("rule_limit").isNotNull(),
            "at_limit": at,
            "sealed": at & no_offer,
            "touched_only": at & ~no_offer,
            "near_limit": F.coalesce(room <= near_bps, F.lit(False)) & ~at,
            "has_offer": ~no_offer,
        }
    )


def condition_effects(
    df: DataFrame, keys: Sequence[str], score: str, label: str, conditions: Sequence[str], n: int, unique: Sequence[str]
) -> DataFrame:
    """Per condition: its share among candidates and selected rows, its contribution to the top-n mean,
    and the top-n mean when rows under the condition are left out and replaced.

    Conditions become rows; two placings (all rows, remaining rows) share the same cells.
    """
    base = list(dict.fromkeys([*keys, *unique, score, label]))
    flags = [F.col(c).cast("boolean").alias(c) for c in conditions]
    long = df.select(*base, *flags).unpivot(base, list(conditions), "condition", "flag").dropna(subset=[score])
    long = long.withColumn("flag", F.coalesce("flag", F.lit(False)))
    cells = ["condition", *keys]
    long = carry_copies(long, df, keys, "condition")
    placed = with_place(long, cells, score, unique, out="_place")
    # rows under the condition go behind all others, so the same n picks their replacements
    flag_count = running(
        placed.withColumn("_clear", (~F.col("flag")).cast("int")), cells, ["_place"], {"_kept": ("sum", "_clear")}
    )
    chosen = F.col("_place") <= n
    rechosen = ~F.col("flag") & (F.col("_kept") <= n)
    y = F.col(label) * BPS
    per_group = flag_count.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("flag")).alias("_f"),
        F.count_if(chosen).alias("_s"),
        F.count_if(chosen & F.col("flag")).alias("_sf"),
        F.avg(F.when(chosen, y)).alias("_top"),
        F.sum(F.when(chosen & F.col("flag"), y)).alias("_fsum"),
        F.avg(F.when(rechosen, y)).alias("_retop"),
    )
    return per_group.groupBy("condition").agg(
        F.count(F.lit(1)).alias("groups"),
        (F.sum("_f") / F.sum("rows")).alias("candidate_share"),
        (F.sum("_sf") / F.sum("_s")).alias("selected_share"),
        F.avg("_top").alias("top_mean_bps"),
        F.avg(F.coalesce(F.col("_fsum"), F.lit(0.0)) / F.col("_s")).alias("contribution_bps"),
        F.avg("_retop").alias("without_mean_bps"),
    )


def condition_groups(
    df: DataFrame, keys: Sequence[str], score: str, label: str, conditions: Sequence[str], n: int, unique: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Per condition and group: rows, chosen rows and mean outcome of all, of those under the condition, and of a choice
    without them, in bps. ``by`` are further columns of the group, for roll-ups."""
    base = list(dict.fromkeys([*keys, *unique, score, label, *by]))
    rows = df.where(finite(score).isNotNull() & finite(label).isNotNull())
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias("_flag")) for c in conditions])
    long = carry_copies(rows.select(*base, F.inline(cells)), rows, keys, "condition")
    placed = with_place(long, ["condition", *keys], score, unique, out="_place")
    placed = with_place(placed, ["condition", *keys, "_flag"], score, unique, out="_own_place")
    y, chosen, flag = F.col(label) * BPS, F.col("_place") <= n, F.col("_flag")
    again = ~flag & (F.col("_own_place") <= n)
    return placed.groupBy("condition", *dict.fromkeys([*keys, *by])).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"), F.count_if(chosen).alias("chosen"), F.count_if(chosen & flag).alias("flagged_chosen"),
        F.avg(y).alias("pool_bps"), F.avg(F.when(~flag, y)).alias("clear_pool_bps"), F.avg(F.when(chosen, y)).alias("top_bps"),
        F.coalesce(F.sum(F.when(chosen & flag, y)), F.lit(0.0)).alias("flagged_sum"), F.avg(F.when(again, y)).alias("again_bps"),
    )


def condition_rollup(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Roll-up of :func:`condition_groups`: shares, enrichment, what the condition brings, and the choice without it
    against the whole pool and against the pool without the condition."""
    candidates = F.sum("flagged") / F.sum("rows")
    selected = F.sum("flagged_chosen") / F.sum("chosen")
    excess, again = F.avg(F.col("top_bps") - F.col("pool_bps")), F.avg(F.col("again_bps") - F.col("pool_bps"))
    return groups.groupBy("condition", *by).agg(
        F.count(F.lit(1)).alias("groups"), F.avg("rows").alias("candidates_mean"), F.avg("chosen").alias("selected_mean"),
        candidates.alias("candidate_share"), selected.alias("selected_share"), F.try_divide(selected, candidates).alias("enrichment"),
        F.try_divide(F.sum("flagged_sum"), F.sum("flagged_chosen")).alias("selected_flagged_bps"),
        F.avg(F.col("flagged_sum") / F.col("chosen")).alias("contribution_bps"), excess.alias("excess_bps"),
        again.alias("again_excess_bps"), F.avg(F.col("again_bps") - F.col("clear_pool_bps")).alias("again_clear_excess_bps"), (again - excess).alias("again_less_original_bps"),
    )


def event_rows(
    df: DataFrame, keys: Sequence[str], score: str, needed: Sequence[str], events: Sequence[str], n: int, unique: Sequence[str]
) -> DataFrame:
    """Chosen rows on which any event holds, with their place, out of those that have all needed values."""
    placed = with_place(df.dropna(subset=[score, *needed]), keys, score, unique, out="score_rank").where(F.col("score_rank") <= n)
    some = F.coalesce(F.greatest(*[F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in events]), F.lit(False))
    return placed.where(some)


def auc_by_rank(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives."""
    rows = df.where(F.col(score).isNotNull()).withColumn("_hit", F.coalesce(positive, F.lit(False)))
    ranked = ranks(rows, list(by), score, {"_r": "average"})
    p = F.count_if("_hit").cast("double")
    n = F.count_if(~F.col("_hit")).cast("double")
    total = F.sum(F.when(F.col("_hit"), F.col("_r")))
    return ranked.groupBy(*by).agg(
        F.count_if("_hit").alias("positives"),
        F.count_if(~F.col("_hit")).alias("negatives"),
        F.when((p > 0) & (n > 0), F.try_divide(total - p * (p + 1.0) / 2.0, p * n)).alias("auc"),
    )


def daily_t(rows: DataFrame, value: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Days, mean of daily means, its t statistic and the share of positive days."""
    daily = rows.groupBy(*by, date).agg(F.avg(value).alias("_d")).where(F.col("_d").isNotNull())
    d = F.col("_d")
    error = F.stddev_samp(d) / F.sqrt(F.count(d))
    return daily.groupBy(*by).agg(
        F.count(d).alias("days"), F.avg(d).alias("daily_mean_bps"), F.when(error > 0, F.avg(d) / error).alias("t_stat"), share(d > 0).alias("positive_day_share"),
    )


def state_decomposition(
    df: DataFrame, keys: Sequence[str], date: str, score: str, outcomes: Sequence[str], state: str, states: Sequence[str], n: int, unique: Sequence[str]
) -> DataFrame:
    """Top-n excess per outcome as the sum of what each state contributes, and the excess of choosing anew inside each state.

    A group's excess is the mean outcome of its chosen rows less that of all. A state contributes its chosen rows' share of
    the first mean less its rows' share of the second, so the contributions of all states add up to the excess; rows in
    none of ``states`` are the part that is left. Choosing anew places the rows of a state among themselves.
    """
    rows = df.where(F.col(score).isNotNull()).withColumn("_state", F.coalesce(F.col(state).cast("string"), F.lit("")))
    placed = with_place(rows, keys, score, unique, out="_place")
    placed = with_place(placed, [*keys, "_state"], score, unique, out="_own_place")
    cells = F.array(*[F.struct(F.lit(c).alias("outcome"), finite(c).alias("_y")) for c in outcomes])
    long = placed.select(*keys, "_state", "_place", "_own_place", F.inline(cells)).where("_y IS NOT NULL")
    y, chosen = F.col("_y"), F.col("_place") <= n
    mean = lambda test: F.avg(F.when(test, y))
    columns = [F.count(y).alias("_n"), F.count_if(chosen).alias("_picked"), F.avg(y).alias("_all"), mean(chosen).alias("_top")]
    for i, name in enumerate(states):
        own = F.col("_state") == name
        columns += [F.sum(F.when(own, y)).alias(f"_base{i}"), F.sum(F.when(own & chosen, y)).alias(f"_pick{i}")]
        columns.append((mean(own & (F.col("_own_place") <= n)) - mean(own)).alias(f"_anew{i}"))
    groups = long.groupBy("outcome", *keys).agg(*columns)
    zero = F.lit(0.0)
    parts = {
        f"_part{i}": F.coalesce(F.col(f"_pick{i}"), zero) / F.col("_picked") - F.coalesce(F.col(f"_base{i}"), zero) / F.col("_n")
        for i in range(len(states))
    }
    groups = groups.withColumn("_excess", (F.col("_top") - F.col("_all")) * BPS)
    groups = groups.withColumns({out: F.when(F.col("_picked") > 0, part * BPS) for out, part in parts.items()})
    total = sum((F.avg(c) for c in parts), F.lit(0.0))
    report = groups.groupBy("outcome").agg(
        F.count("_excess").alias("groups"), (F.avg("_top") * BPS).alias("selected_bps"), (F.avg("_all") * BPS).alias("universe_bps"),
        F.avg("_excess").alias("excess_bps"), *[F.avg(f"_part{i}").alias(f"{s}_contribution_bps") for i, s in enumerate(states)],
        total.alias("contribution_sum_bps"), *[(F.avg(f"_anew{i}") * BPS).alias(f"{s}_reselected_excess_bps") for i, s in enumerate(states)],
    )
    return attach(report, daily_t(groups, "_excess", date, ["outcome"]), ["outcome"])


def selection_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Groups in which two selections share rows, and the mean number of rows they share there."""
    both = left.select(*keys, *unique).join(right.select(*keys, *unique), [*keys, *unique])
    shared = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return shared.agg(F.count(F.lit(1)).alias("groups"), F.avg("_n").alias("mean_shared_rows"))


def state_contributions(
    df: DataFrame, keys: Sequence[str], score: str, outcomes: Sequence[str], state: Column, n: int, unique: Sequence[str]
) -> DataFrame:
    """On rows with every outcome: top-n excess split into a state's part and the rest, per outcome.

    Outcomes become rows after one placing, so all share one eligible set.
    """
    rows = df.dropna(subset=[score, *outcomes]).withColumn("_state", F.coalesce(state, F.lit(False)))
    placed = with_place(rows, keys, score, unique, out="_place")
    placed = ranks(placed, keys, score, {"_rs": "average"})
    for i, c in enumerate(outcomes):
        placed = ranks(placed, keys, c, {f"_ro{i}": "average"})
    top = F.col("_place") <= n
    columns = []
    for i, c in enumerate(outcomes):
        chosen = F.count_if(top)
        columns.append(
            F.struct(
                F.lit(c).alias("outcome"),
                ((F.avg(F.when(top, F.col(c))) - F.avg(c)) * BPS).alias("excess_bps"),
                (F.sum(F.when(top & F.col("_state"), F.col(c) - 0.0)) / chosen * BPS).alias("_state_sum"),
                (F.count_if(top & F.col("_state")) / chosen).alias("state_share"),
                (F.avg(c) * BPS).alias("_mean"),
                correlation("_rs", f"_ro{i}").alias("rank_ic"),
            )
        )
    wide = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array(*columns).alias("_o"))
    long = wide.select(*keys, "rows", F.inline("_o"))
    part = F.coalesce(F.col("_state_sum"), F.lit(0.0)) - F.col("state_share") * F.col("_mean")
    return long.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("excess_bps").alias("excess_bps"),
        F.avg(part).alias("state_bps"),
        F.avg(F.col("excess_bps") - part).alias("rest_bps"),
        F.avg("state_share").alias("state_share"),
        F.avg("rank_ic").alias("rank_ic"),
    )


def clipping_share(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], state: str, sigmas: float = 3.0
) -> DataFrame:
    """Per variable and state: share of rows beyond k standard deviations of their group."""
    stats = group_columns(
        df, keys, {k: v for c in values for k, v in ((f"_m_{c}", F.avg(c)), (f"_s_{c}", F.stddev_pop(c)))}
    )
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(c).isNotNull().alias("present"),
                (F.abs(F.col(c) - F.col(f"_m_{c}")) > sigmas * F.col(f"_s_{c}")).alias("beyond"),
            )
            for c in values
        ]
    )
    long = stats.select(state, F.inline(parts)).where("present")
    return long.groupBy("variable", state).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("beyond")).alias("clipped_rows"),
        F.avg(F.coalesce(F.col("beyond"), F.lit(False)).cast("double")).alias("clipped_share"),
    )


def state_separation(df: DataFrame, value: str, state: str, cuts: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of a value per state."""
    return quantiles(df, [state], value, {f"q{int(p * 100):02d}": p for p in cuts})


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """Two-source check per value: matched keys, agreeing and differing pairs."""
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = a.join(right, list(keys))
    parts = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).alias("_x"), F.col(f"_b_{v}").alias("_y")) for v in values]
    )
    near = F.abs(F.col("_x") - F.col("_y")) <= tolerance
    return joined.select(F.inline(parts)).groupBy("variable").agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(near).alias("agree"),
        F.count_if(~near).alias("differ"),
        F.count_if(near.isNull()).alias("missing"),
        F.max(F.abs(F.col("_x") - F.col("_y"))).alias("max_gap"),
    )


def exact_top(df: DataFrame, keys: Sequence[str], score: str, n: int, unique: Sequence[str]) -> DataFrame:
    """Top n rows with percentile 1 - (rank - 1) / size and a flag for groups that have n rows."""
    placed = with_place(df, keys, score, unique, out="score_rank", total="group_size")
    kept = placed.where(F.col("score_rank") <= n)
    return kept.withColumns(
        {
            "score_percentile": 1.0 - (F.col("score_rank") - 1) / F.col("group_size"),
            "full_group": F.col("group_size") >= n,
        }
    )


def unique_hits(df: DataFrame, keys: Sequence[str], strength: str, unique: Sequence[str]) -> DataFrame:
    """Strongest hit per key and the number of hits of that key."""
    place = F.struct(F.col(strength), *[F.col(c) for c in unique])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), place).alias("_b"), F.count(F.lit(1)).alias("hits")
    )
    return best.select(*keys, "_b.*", "hits")


def tail_composition(
    df: DataFrame, keys: Sequence[str], variables: Sequence[str], state: str, unique: Sequence[str], fixed: int = 100
) -> DataFrame:
    """Top 1 %, top 3 % and top fixed rows per group and variable: rows by state."""
    base = list(dict.fromkeys([*keys, *unique, state]))
    long = df.select(*base, *variables).unpivot(base, list(variables), "variable", "value").dropna(subset=["value"])
    placed = with_place(long, [*keys, "variable"], "value", unique, out="_p", total="_n")
    p, n = F.col("_p"), F.col("_n")
    tails = F.array_compact(
        F.array(
            F.when(p <= F.ceil(n * 0.01), F.lit("top_1pct")),
            F.when(p <= F.ceil(n * 0.03), F.lit("top_3pct")),
            F.when(p <= fixed, F.lit(f"top_{fixed}")),
        )
    )
    rows = placed.withColumn("tail", F.explode(tails))
    out = rows.groupBy("variable", "tail", state).agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean_value"))
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(over(["variable", "tail"])))
