"""Capacity limits, greedy allocation by prefix sums, acceptance and tail reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock as C
from tickloom.functions.numeric import BPS, clip, drawn, finite, least_all, safe_div, share
from tickloom.operators.groups import attach, carry, over, position, quantiles, running, top_rows
from tickloom.operators.summaries import concentration


@dataclass(frozen=True)
class Capacity:
    """Allocation constraints of one decision."""

    target: float
    participation: float = 0.0
    symbol_weight: float = 0.0
    depth_levels: int = 0
    depth_share: float = 1.0
    max_names: int = 0
    score: str = "prediction"
    capacity: str = "capacity_notional"
    price: str = "capacity_price"
    volume: str | None = None
    decision_depth: bool = False

    def __post_init__(self):
        if self.target <= 0:
            raise ValueError("target must be positive")
        if self.participation < 0 or self.symbol_weight < 0:
            raise ValueError("rates must be >= 0")

    def needed_columns(self) -> list[str]:
        need = [self.score]
        if self.participation > 0:
            need += [self.volume, self.price] if self.volume else [self.capacity]
        if self.depth_levels:
            p = "" if self.decision_depth else "entry_"
            need += [f"{p}ask_{part}_{k}" for k in range(1, self.depth_levels + 1) for part in ("price", "volume")]
        return need


def positive_notional(price: Column, volume: Column) -> Column:
    p, v = finite(price), finite(volume)
    return F.when(F.coalesce((p > 0) & (v > 0), F.lit(False)), p * v).otherwise(0.0)


def depth_pairs(columns: Sequence[str], levels: int, decision_depth: bool) -> list[tuple[str, str]]:
    """Entry book levels, or decision book levels where allowed, up to the first gap."""
    has, pairs = set(columns), []
    for k in range(1, levels + 1):
        options = [f"entry_ask_{{}}_{k}"] + ([f"ask_{{}}_{k}"] if decision_depth else [])
        hit = next((o for o in options if {o.format("price"), o.format("volume")} <= has), None)
        if hit is None:
            break
        pairs.append((hit.format("price"), hit.format("volume")))
    return pairs


def capacity_limits(df: DataFrame, c: Capacity) -> DataFrame:
    """Row limit: the least of symbol cap, participation and depth share; 0 as soon as one part is missing."""
    has = set(df.columns)
    none = F.lit(None).cast("double")
    parts = [F.lit(c.target * c.symbol_weight if c.symbol_weight > 0 else c.target)]
    out: dict[str, Column] = {}
    if c.participation > 0:
        if c.capacity in has:
            amount = finite(c.capacity)
        elif c.volume and {c.volume, c.price} <= has:
            amount = finite(c.volume) * finite(c.price)
        else:
            amount = none
        amount = F.when(amount > 0, amount)
        out |= {"capacity_used": amount, "capacity_limit": amount * c.participation}
        parts.append(amount * c.participation)
    if c.depth_levels > 0:
        pairs = depth_pairs(df.columns, c.depth_levels, c.decision_depth)
        depth = none
        if len(pairs) == c.depth_levels:
            depth = sum((positive_notional(F.col(p), F.col(v)) for p, v in pairs), F.lit(0.0))
        out |= {"depth_notional": depth, "depth_limit": depth * c.depth_share}
        parts.append(depth * c.depth_share)
    limit = least_all(parts)
    out["row_limit"] = F.when(limit > 0, limit).otherwise(0.0)
    return carry(df.withColumns(out), df)


def greedy_fill(df: DataFrame, keys: Sequence[str], c: Capacity, unique: Sequence[str]) -> DataFrame:
    """Fill the target in score order: allocation = min(limit, target - limits before it).

    A prefix sum, so no row waits for another; hot groups are cut into blocks.
    """
    rows = capacity_limits(df, c).dropna(subset=[c.score])
    rows = rows.where(F.col("row_limit") > 0).withColumn("_down", -F.col(c.score))
    order = ["_down", *unique]
    if c.max_names > 0:
        rows = position(rows, keys, order, out="_place")
        rows = carry(rows.where(F.col("_place") <= c.max_names).drop("_place"), rows)
    summed = running(rows, keys, order, {"_before": ("sum", "row_limit")}, inclusive=False)
    room = F.greatest(F.lit(c.target) - F.coalesce("_before", F.lit(0.0)), F.lit(0.0))
    filled = summed.withColumn("allocated_notional", F.least("row_limit", room))
    taken = carry(filled.where(F.col("allocated_notional") > 0), summed)
    placed = position(taken, keys, order, out="rank")
    added = {
        "target_notional": F.lit(c.target),
        "target_weight": F.col("allocated_notional") / c.target,
    }
    if c.participation > 0:
        added["capacity_participation_rate"] = safe_div("allocated_notional", "capacity_used")
    if c.depth_levels > 0:
        added["depth_participation_rate"] = safe_div("allocated_notional", "depth_notional")
    return placed.withColumns(added).drop("_down", "_before")


def group_fill(
    candidates: DataFrame, selected: DataFrame, keys: Sequence[str], c: Capacity, symbol: str = "symbol"
) -> DataFrame:
    """Per group: candidates, viable and selected rows, fill, cash, depth reached, concentration."""
    limited = capacity_limits(candidates, c).dropna(subset=[c.score])
    base = limited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_rows"), F.count_if(F.col("row_limit") > 0).alias("viable_rows")
    )
    rates = [r for r in ("capacity_participation_rate", "depth_participation_rate") if r in selected.columns]
    chosen = selected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_rows"),
        F.sum("allocated_notional").alias("allocated_notional"),
        F.max("rank").alias("_reached"),
        *[F.max(r).alias(f"max_{r}") for r in rates],
    )
    weights = concentration(selected, keys, symbol, F.col("allocated_notional"), "symbol_")
    joined = attach(attach(base, chosen, keys), weights, keys)
    amount = F.coalesce("allocated_notional", F.lit(0.0))
    filled = amount >= c.target * (1.0 - 1e-9)
    reached = F.coalesce("_reached", F.lit(0)).cast("long")
    return joined.withColumns(
        {
            "selected_rows": F.coalesce("selected_rows", F.lit(0)),
            "allocated_notional": amount,
            "target_notional": F.lit(c.target),
            "cash_notional": F.greatest(F.lit(c.target) - amount, F.lit(0.0)),
            "fill_ratio": amount / c.target,
            "filled": filled,
            "max_rank_reached": reached,
            "top_depth_to_target": F.when(filled, reached.cast("double")),
            "capacity_exhausted_depth": F.when(~filled, reached.cast("double")),
        }
    ).drop("_reached")


def fill_summary(groups: DataFrame, by: Sequence[str], month: str) -> DataFrame:
    """Group fills to pools, months or days."""
    stats = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_distinct(month).alias("months"),
        F.avg("candidate_rows").alias("candidate_rows"),
        F.avg("viable_rows").alias("viable_rows"),
        F.avg("selected_rows").alias("selected_rows"),
        F.try_divide(F.sum("allocated_notional"), F.sum("target_notional")).alias("fill_ratio"),
        F.count_if("filled").alias("filled_groups"),
        F.avg(F.col("filled").cast("double")).alias("fill_success_rate"),
        F.min("fill_ratio").alias("min_fill_ratio"),
        F.avg("top_depth_to_target").alias("mean_depth"),
        F.max("top_depth_to_target").alias("max_depth"),
        F.avg("max_rank_reached").alias("mean_rank_reached"),
        F.max("symbol_max_share").alias("max_symbol_weight"),
        F.avg("symbol_effective").alias("mean_effective_symbols"),
    )
    cuts = quantiles(groups, list(by), "top_depth_to_target", {"p50_depth": 0.5, "p90_depth": 0.9, "p95_depth": 0.95})
    return attach(stats, cuts, list(by))


def selected_returns(
    selected: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, fee_bps: float
) -> DataFrame:
    """Join labels to allocations and add gross, fee and net profit."""
    joined = attach(selected, labels.select(*keys, F.col(label).alias("_label")), keys)
    gross = F.col("allocated_notional") * F.col("_label")
    fee = F.col("allocated_notional") * (fee_bps / BPS)
    return joined.withColumns({"gross_pnl": gross, "fee_pnl": fee, "net_pnl": gross - fee}).withColumnRenamed("_label", label)


def require_labels(rows: DataFrame, label: str) -> DataFrame:
    """The frame itself, after checking that no label is missing (one job)."""
    if not rows.where(F.col(label).isNull()).isEmpty():
        raise ValueError(f"selected rows without {label}")
    return rows


def daily_acceptance(
    returns: DataFrame,
    group_targets: DataFrame,
    total: float,
    by: Sequence[str] = ("pool",),
    date: str = "date",
    extra_sums: Sequence[str] = (),
) -> DataFrame:
    """Daily returns against the day's targets and against total capital, with fill and cash.

    ``week_start`` holds the date itself, as in the source reports.
    """
    keys = [*by, date]
    targets = group_targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decision_groups"), F.sum("group_target_notional").alias("target_notional")
    )
    sums = returns.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("gross_pnl", "fee_pnl", "net_pnl", *extra_sums)],
        F.sum("allocated_notional").alias("selected_notional"),
        F.count(F.lit(1)).alias("selected_rows"),
    )
    filled = attach(targets, sums, keys)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("gross_pnl", "fee_pnl", "net_pnl", "selected_notional", *extra_sums)}
    filled = filled.withColumns({**zero, "selected_rows": F.coalesce("selected_rows", F.lit(0))})
    t = F.col("target_notional")
    return filled.withColumns(
        {
            "week_start": F.col(date),
            "capital_fraction": t / total,
            "gross_return_bps": safe_div("gross_pnl", t) * BPS,
            "fee_bps": safe_div("fee_pnl", t) * BPS,
            "net_return_bps": safe_div("net_pnl", t) * BPS,
            "capital_net_return_bps": F.col("net_pnl") / total * BPS,
            "fill_ratio": safe_div("selected_notional", t),
            "cash_notional": F.greatest(t - F.col("selected_notional"), F.lit(0.0)),
        }
    )


def group_targets_of(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return selected.groupBy(*keys).agg(F.max("target_notional").alias("group_target_notional"))


def overall_acceptance(daily: DataFrame, by: Sequence[str] = ("pool",), date: str = "date") -> DataFrame:
    return daily.groupBy(*by).agg(
        F.count_distinct(date).alias("days"),
        F.sum("decision_groups").alias("decision_groups"),
        F.avg("selected_rows").alias("mean_selected_rows"),
        F.avg("target_notional").alias("mean_target_notional"),
        F.avg("selected_notional").alias("mean_selected_notional"),
        F.avg("fill_ratio").alias("mean_fill_ratio"),
        F.min("fill_ratio").alias("min_fill_ratio"),
        F.avg("net_return_bps").alias("mean_net_return_bps"),
        F.sum("capital_net_return_bps").alias("cumulative_net_return_bps"),
        F.sum("net_pnl").alias("total_net_pnl"),
    )


def policy_fill(selected: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group fill by policy, groups without any selected row included."""
    chosen = selected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("allocated_notional").alias("_a"), F.max("rank").alias("max_rank")
    )
    joined = attach(targets.select(*keys, "group_target_notional"), chosen, keys)
    amount, target = F.coalesce("_a", F.lit(0.0)), F.col("group_target_notional")
    return joined.select(
        *keys, target, F.coalesce("_n", F.lit(0)).alias("selected_rows"), amount.alias("allocated_notional"), "max_rank",
        safe_div(amount, target).alias("fill_ratio"), F.greatest(target - amount, F.lit(0.0)).alias("cash_notional"),
    )


def daily_positions(selected: DataFrame, by: Sequence[str], decision: str, date: str = "date", symbol: str = "symbol") -> DataFrame:
    return selected.groupBy(*by, date, symbol).agg(
        F.sum("allocated_notional").alias("allocated_notional"),
        F.count_distinct(decision).alias("decision_count"),
        F.min(decision).alias("first_decision"),
        F.max(decision).alias("last_decision"),
    )


def position_days(positions: DataFrame, total: float, by: Sequence[str], date: str = "date") -> DataFrame:
    """Daily allocation, repeated symbols and concentration of positions."""
    a, again = F.col("allocated_notional"), F.col("decision_count") > 1
    s = F.sum(a)
    hhi = F.try_divide(F.sum(a * a), s * s)
    return positions.groupBy(*by, date).agg(
        s.alias("allocated_notional"),
        F.count(F.lit(1)).alias("unique_symbols"),
        F.count_if(again).alias("repeated_symbols"),
        F.coalesce(F.try_divide(F.sum(F.when(again, a)), s), F.lit(0.0)).alias("repeated_share"),
        (F.max(a) / total).alias("max_symbol_weight"),
        hhi.alias("symbol_hhi"),
        F.try_divide(F.lit(1.0), hhi).alias("effective_symbols"),
        (s / total).alias("capital_fraction"),
    )


def adjacent_overlap(
    selected: DataFrame, by: Sequence[str], decision: str, date: str = "date", symbol: str = "symbol"
) -> DataFrame:
    """Name and weight overlap of consecutive decisions of a day.

    Decisions are numbered on the distinct (day, decision) table and rows meet
    their successors by an equi join; no pairs within a group are formed.
    """
    day = [*by, date]
    cell = selected.groupBy(*day, decision, symbol).agg(F.sum("allocated_notional").alias("_a"))
    sizes = cell.groupBy(*day, decision).agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_s"))
    w = over(day, [decision])  # one row per decision
    pairs = sizes.select(
        *day, F.col(decision).alias("left_decision"), F.col("_n").alias("left_symbols"), F.col("_s").alias("_ls"),
        F.lead(decision).over(w).alias("right_decision"), F.lead("_n").over(w).alias("right_symbols"), F.lead("_s").over(w).alias("_rs"),
    ).where("right_decision is not null")
    left = attach(cell.withColumnRenamed(decision, "left_decision"), pairs, [*day, "left_decision"], "inner")
    right = cell.select(*day, F.col(decision).alias("right_decision"), symbol, F.col("_a").alias("_b"))
    both = left.join(right, [*day, "right_decision", symbol], "left")
    n = F.count("_b")
    l, r = F.first("left_symbols"), F.first("right_symbols")
    return both.groupBy(*day, "left_decision", "right_decision").agg(
        l.alias("left_symbols"),
        r.alias("right_symbols"),
        n.alias("common_symbols"),
        (n / (l + r - n)).alias("name_jaccard"),
        (n / F.least(l, r)).alias("name_overlap_min"),
        F.try_divide(
            F.coalesce(F.sum(F.when(F.col("_b").isNotNull(), F.least("_a", "_b"))), F.lit(0.0)),
            F.least(F.first("_ls"), F.first("_rs")),
        ).alias("weighted_overlap_min"),
    )


def _tail_columns(label: Column, amount: Column, threshold: Column, target: Column, fee_bps: float) -> list[Column]:
    tail = label > threshold
    scale = F.lit(BPS) / target
    gross, fee = F.sum(amount * label), F.sum(amount) * (fee_bps / BPS)
    winsor = F.sum(amount * F.least(label, threshold))
    kept = F.coalesce(F.sum(F.when(~tail, amount * label)), F.lit(0.0))
    kept_fee = F.coalesce(F.sum(F.when(~tail, amount)), F.lit(0.0)) * (fee_bps / BPS)
    tail_amount = F.coalesce(F.sum(F.when(tail, amount)), F.lit(0.0))
    over_it = F.coalesce(F.sum(F.when(tail, amount * (label - threshold))), F.lit(0.0))
    at = F.max(threshold)
    s = F.max(scale)
    return [
        (at * BPS).alias("threshold_bps"),
        F.count(label).alias("rows"),
        F.sum(amount).alias("selected_notional"),
        (gross * s).alias("raw_gross_bps"),
        ((gross - fee) * s).alias("raw_net_bps"),
        ((winsor - fee) * s).alias("winsor_net_bps"),
        ((kept - kept_fee) * s).alias("trim_net_bps"),
        ((gross - winsor) * s).alias("winsor_removed_bps"),
        (tail_amount * at * s).alias("tail_occurrence_bps"),
        (over_it * s).alias("tail_severity_bps"),
        share(tail).alias("tail_row_share"),
        F.try_divide(tail_amount, F.sum(amount)).alias("tail_notional_share"),
        (F.avg(F.when(tail, label)) * BPS).alias("tail_mean_bps"),
        (F.avg(F.when(~tail, label)) * BPS).alias("rest_mean_bps"),
    ]


def tail_robustness(
    rows: DataFrame,
    group_targets: DataFrame,
    label: str,
    fee_bps: float,
    cuts: Sequence[float] = (0.95, 0.99),
    by: Sequence[str] = ("policy", "pool"),
    month: str | None = None,
) -> DataFrame:
    """Winsor and trim results at label quantiles of the whole policy, overall or (with ``month``) monthly."""
    valid = rows.where(finite(label).isNotNull() & (F.col("allocated_notional") > 0))
    names = {f"p{int(round(p * 100))}": p for p in cuts}
    thresholds = quantiles(valid, list(by), label, names).unpivot(list(by), list(names), "threshold", "_cut")
    grain = [*by, month] if month else list(by)
    targets = group_targets.groupBy(*grain).agg(F.sum("group_target_notional").alias("_target"))
    joined = attach(attach(valid, thresholds, by, "inner"), targets, grain, "inner")
    columns = _tail_columns(F.col(label), F.col("allocated_notional"), F.col("_cut"), F.col("_target"), fee_bps)
    return joined.groupBy(*grain, "threshold").agg(*columns)


def top_contributors(
    rows: DataFrame, group_targets: DataFrame, tops: Sequence[int] = (1, 5, 10), by: Sequence[str] = ("policy", "pool"),
    date: str = "date", symbol: str = "symbol",
) -> DataFrame:
    """Result left after removing the best dates, symbols and symbol-dates."""
    units = F.array(
        *[
            F.struct(F.lit(u).alias("unit"), key.alias("member"))
            for u, key in (
                ("date", F.col(date)), ("symbol", F.col(symbol)), ("symbol_date", F.concat_ws("|", F.col(date), F.col(symbol))),
            )
        ]
    )
    long = rows.select(*by, "gross_pnl", "fee_pnl", F.inline(units))
    grain = [*by, "unit"]
    sums = long.groupBy(*grain, "member").agg(F.sum("gross_pnl").alias("g"), F.sum("fee_pnl").alias("f"))
    totals = sums.groupBy(*grain).agg(F.count(F.lit(1)).alias("groups"), F.sum("g").alias("_g"), F.sum("f").alias("_f"))
    best = top_rows(sums, grain, [F.col("g").desc(), F.col("member")], max(tops), "_p")
    listed = best.withColumn("top_n", F.explode(F.array(*[F.lit(n) for n in tops]))).where(F.col("_p") <= F.col("top_n"))
    removed = listed.groupBy(*grain, "top_n").agg(F.sum("g").alias("top_gross_pnl"), F.sum("f").alias("_tf"))
    targets = group_targets.groupBy(*by).agg(F.sum("group_target_notional").alias("_target"))
    joined = attach(attach(removed, totals, grain), targets, by)
    rest, t = F.col("_g") - F.col("top_gross_pnl"), F.col("_target")
    return joined.select(
        *grain, "top_n", "groups", "top_gross_pnl", safe_div("top_gross_pnl", "_g").alias("top_gross_share"),
        (rest / t * BPS).alias("remaining_gross_bps"),
        ((rest - (F.col("_f") - F.col("_tf"))) / t * BPS).alias("remaining_net_bps"),
    )


def month_bootstrap(
    daily: DataFrame, value: str, samples: int, seed: int, by: Sequence[str] = ("policy", "pool"), date: str = "date"
) -> DataFrame:
    """Month-block bootstrap of the cumulative result; draws are hashes of (seed, sample, slot).

    Samples and slots are generated rows, blocks join them by drawn number.
    """
    blocks = daily.groupBy(*by, C.month(date).alias("_m")).agg(F.sum(value).alias("_v"))
    w = over(list(by), ["_m"])  # one row per month
    numbered = blocks.withColumns(
        {"_k": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(over(list(by)))}
    )
    sizes = numbered.groupBy(*by).agg(F.max("_n").alias("_n"), F.sum("_v").alias("observed_bps"))
    draw = F.conv(F.substring(drawn(seed, "_sample", "_slot", *by), 1, 8), 16, 10).cast("long")
    draws = (
        sizes.withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        .withColumn("_slot", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        .withColumn("_k", F.pmod(draw, F.col("_n")).cast("int"))
    )
    sums = draws.join(numbered.select(*by, "_k", "_v"), [*by, "_k"]).groupBy(*by, "_sample").agg(F.sum("_v").alias("_t"))
    cuts = quantiles(sums, list(by), "_t", {"p05_bps": 0.05, "median_bps": 0.5, "p95_bps": 0.95})
    positive = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), share(F.col("_t") > 0).alias("positive_probability"))
    return attach(attach(sizes.withColumnRenamed("_n", "blocks"), cuts, by), positive, by)


def leave_one_out(daily: DataFrame, value: str, by: Sequence[str] = ("policy", "pool"), date: str = "date") -> DataFrame:
    """Total minus each month and each quarter."""
    units = F.array(
        F.struct(F.lit("month").alias("unit"), C.month(date).alias("omitted_period")),
        F.struct(F.lit("quarter").alias("unit"), C.quarter(date).alias("omitted_period")),
    )
    periods = daily.select(*by, value, F.inline(units)).groupBy(*by, "unit", "omitted_period").agg(
        F.sum(value).alias("omitted_bps")
    )
    total = F.sum("omitted_bps").over(over([*by, "unit"]))  # one row per period
    return periods.withColumn("remaining_bps", total - F.col("omitted_bps"))


def ask_sweep(df: DataFrame, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """Allocation swept through the ask levels: filled share per level, cumulative and beyond."""
    has = set(df.columns)
    left = clip(F.coalesce(finite("allocated_notional"), F.lit(0.0)), low=0)
    allocated, filled = left, F.lit(0.0)
    columns = [F.count(F.lit(1)).alias("_rows"), F.sum(allocated).alias("_allocated")]
    for k in range(1, levels + 1):
        p, v = f"ask_price_{k}", f"ask_volume_{k}"
        level = F.lit(0.0)
        if {p, v} <= has:
            level = F.greatest(F.coalesce(finite(p), F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce(finite(v), F.lit(0.0)), F.lit(0.0))
        take = F.least(left, level)
        left, filled = F.greatest(left - take, F.lit(0.0)), filled + take
        columns += [
            F.sum(level).alias(f"_level{k}"), F.sum(take).alias(f"_fill{k}"), F.count_if(filled >= allocated - 1e-9).alias(f"_full{k}"),
        ]
    columns.append(F.sum(left).alias("_beyond"))
    sums = df.groupBy(*by).agg(*columns)
    total, rows = F.col("_allocated"), F.col("_rows")
    reached, lines = F.lit(0.0), []
    none = F.lit(None).cast("double")
    for k in range(1, levels + 1):
        reached = reached + F.col(f"_fill{k}")
        lines.append(
            F.struct(
                F.lit(f"ask{k}").alias("bucket"), F.col(f"_fill{k}").alias("filled_notional"), safe_div(f"_fill{k}", total).alias("filled_share"),
                safe_div(reached, total).alias("cumulative_share"), F.col(f"_full{k}").cast("double").alias("full_within_rows"),
                safe_div(f"_full{k}", rows).alias("full_within_share"), F.col(f"_level{k}").alias("displayed_notional"),
            )
        )
    lines.append(
        F.struct(
            F.lit(f"beyond_ask{levels}").alias("bucket"), F.col("_beyond").alias("filled_notional"), safe_div("_beyond", total).alias("filled_share"),
            F.lit(1.0).alias("cumulative_share"), none.alias("full_within_rows"), none.alias("full_within_share"), none.alias("displayed_notional"),
        )
    )
    return sums.select(*by, F.inline(F.array(*lines)))


