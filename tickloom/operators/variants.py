"""Score variants: penalties, guards, cohorts of what changes, blends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import BPS, above_zero, clip, finite, share
from tickloom.operators.checks import rank_guard
from tickloom.operators.cross import descending_score, rank_share
from tickloom.operators.evaluate import with_place
from tickloom.operators.groups import attach, carry, carry_copies, group_columns, group_median, quantiles
from tickloom.operators.solve import fitted, group_coefficients
from tickloom.operators.targets import risk_components
from tickloom.session import checkpoint

# fixed values: guard name to its rank-share bounds per column, as column:low:high
GUARDS = {
    "spread_le_p80": "spread_bps::0.8",
    "spread_le_p70": "spread_bps::0.7",
    "spread_le_p60": "spread_bps::0.6",
    "liquid_spread_p80_tdiff30_ge_p50": "spread_bps::0.8 turnover_diff_30t:0.5:",
    "liquid_spread_p70_tdiff30_ge_p50": "spread_bps::0.7 turnover_diff_30t:0.5:",
    "liquid_spread_p80_turnover_ge_p50": "spread_bps::0.8 turnover:0.5:",
    "liquid_spread_no_chase": "spread_bps::0.8 turnover_diff_30t:0.5: return_30t::0.8",
    "liquid_spread_no_chase_10t": "spread_bps::0.8 turnover_diff_10t:0.5: return_10t::0.8",
    "liquid_spread_no_chase_strict": "spread_bps::0.7 turnover_diff_30t:0.5: return_30t::0.7",
    "mid_heat": "spread_bps::0.8 turnover_diff_30t:0.3:0.9 return_30t:0.2:0.8",
    "mid_heat_10t": "spread_bps::0.8 turnover_diff_10t:0.3:0.9 return_10t:0.2:0.8",
    "next_flip_guard_10t": "spread_bps::0.8 turnover_diff_10t:0.1:0.8 return_10t:0.2:0.7 ask_depth_10:0.4: depth_imbalance_10:0.2:0.7",
    "next_flip_guard_10t_robust": "spread_bps::0.8 turnover_diff_10t:0.3:0.8 return_10t:0.2:0.7 ask_depth_10:0.4: depth_imbalance_10:0.3:0.7",
    "depth_balanced": "spread_bps::0.8 ask_depth_10:0.3: depth_imbalance_10:0.3:0.7",
    "all_guards_soft": "spread_bps::0.8 turnover_diff_30t:0.4: return_30t::0.8 ask_depth_10:0.3: depth_imbalance_10:0.25:0.75",
    "all_guards_soft_10t": "spread_bps::0.8 turnover_diff_10t:0.4: return_10t::0.8 ask_depth_10:0.3: depth_imbalance_10:0.25:0.75",
    "all_guards_strict": "spread_bps::0.7 turnover_diff_30t:0.5: return_30t::0.7 ask_depth_10:0.4: depth_imbalance_10:0.3:0.7",
}


def guard_bounds(text: str) -> dict[str, tuple[float | None, float | None]]:
    out = {}
    for part in text.split():
        column, low, high = part.split(":")
        out[column] = (float(low) if low else None, float(high) if high else None)
    return out


@dataclass(frozen=True)
class Variant:
    """Alpha rank minus ``penalty`` times a risk rank, above an alpha-rank floor."""

    name: str
    risk: str | None = None
    penalty: float = 0.0
    floor: float = 0.0


def variant_scores(df: DataFrame, alpha: str, variants: Sequence[Variant], kept: Sequence[str], mask: str | None = None) -> DataFrame:
    """Rows times variants: ``variant``, ``candidate`` and ``final_score`` (only candidates have one)."""
    inside = F.coalesce(F.col(mask).cast("boolean"), F.lit(False)) if mask else F.lit(True)
    cells = []
    for v in variants:
        risk = F.coalesce(F.col(v.risk), F.lit(0.0)) if v.risk else F.lit(0.0)
        alpha_ok = F.coalesce(F.col(alpha) >= v.floor, F.lit(False))
        score = F.col(alpha) - v.penalty * risk
        cells.append(
            F.struct(
                F.lit(v.name).alias("variant"), alpha_ok.alias("alpha_candidate"), (alpha_ok & inside).alias("candidate"),
                F.when(alpha_ok & inside, score).alias("final_score"),
            )
        )
    return df.select(*kept, F.inline(F.array(*cells)))


def score_variants(
    df: DataFrame, keys: Sequence[str], alpha: str, variants: Sequence[Variant], labels: dict[str, str], n: int,
    unique: Sequence[str], mask: str | None = None,
) -> DataFrame:
    """Group metrics per variant: candidates, selected rows, top mean and excess per label."""
    kept = list(dict.fromkeys([*keys, *unique, *labels.values(), *([mask] if mask else [])]))
    cells = ["variant", *keys]
    # a missing score is placed last, behind all candidates
    rows = variant_scores(df, alpha, variants, kept, mask).withColumn("_s", F.coalesce("final_score", F.lit(float("-inf"))))
    rows = carry_copies(rows, df, keys, "variant")
    placed = with_place(rows, cells, "_s", unique)
    top = F.col("candidate") & (F.col("place") <= n)
    columns = []
    for prefix, label in labels.items():
        v = finite(label)
        mean = F.avg(F.when(top, v))
        columns += [(mean * BPS).alias(f"{prefix}_top_mean_bps"), ((mean - F.avg(v)) * BPS).alias(f"{prefix}_top_excess_bps")]
    return placed.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("alpha_candidate").alias("alpha_candidate_rows"),
        F.count_if("candidate").alias("candidate_rows"),
        F.count_if(top).alias("selected_rows"),
        *columns,
    )


def variant_summary(metrics: DataFrame, excess: str, date: str, clock: str) -> DataFrame:
    """Means per variant, positive share, positive months and positive minutes."""
    measured = [c for c in metrics.columns if c.endswith("_bps") or c.endswith("_rows")]
    metrics = checkpoint(metrics)  # one row per variant and group, read for three summaries
    month = F.substring(date, 1, 7)
    stats = metrics.groupBy("variant").agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in measured], share(above_zero(excess)).alias("positive_rate")
    )
    months = metrics.groupBy("variant", month.alias("_m")).agg(F.avg(excess).alias("_e"))
    minutes = metrics.groupBy("variant", clock).agg(F.avg(excess).alias("_e"))
    positive = lambda t, name: t.groupBy("variant").agg(F.count_if(above_zero("_e")).alias(name))
    out = attach(stats, positive(months, "positive_months"), ["variant"])
    return attach(out, positive(minutes, "positive_minutes"), ["variant"])


def guard_variants(
    df: DataFrame, keys: Sequence[str], score: str, labels: dict[str, str], n: int, unique: Sequence[str],
    guards: dict[str, str] | None = None,
) -> DataFrame:
    """Group metrics of the top rows under each guard, with the unguarded baseline."""
    specs = {name: guard_bounds(text) for name, text in (guards or GUARDS).items()}
    specs = {name: b for name, b in specs.items() if set(b) <= set(df.columns)}
    work = df
    for c in sorted({c for b in specs.values() for c in b}):
        work = rank_share(work, keys, c, f"_rp_{c}")
    kept = list(dict.fromkeys([*keys, *unique, score, *labels.values()]))
    passed = {"baseline": F.lit(True)}
    passed |= {name: rank_guard({f"_rp_{c}": lim for c, lim in b.items()}) for name, b in specs.items()}
    cells = F.array(*[F.struct(F.lit(k).alias("variant"), p.alias("candidate")) for k, p in passed.items()])
    long = work.select(*kept, F.inline(cells))
    long = long.withColumn("_s", F.when(F.col("candidate") & F.col(score).isNotNull(), F.col(score)).otherwise(float("-inf")))
    placed = with_place(long, ["variant", *keys], "_s", unique)
    top = F.col("candidate") & (F.col("place") <= n)
    columns = []
    for prefix, label in labels.items():
        mean = F.avg(F.when(top, F.col(label)))
        columns += [(mean * BPS).alias(f"{prefix}_top_mean_bps"), ((mean - F.avg(label)) * BPS).alias(f"{prefix}_top_excess_bps")]
    return placed.groupBy("variant", *keys).agg(
        F.count_if("candidate").alias("candidate_rows"), F.count_if(top).alias("selected_rows"), *columns
    )


def risk_scores(
    df: DataFrame, keys: Sequence[str], alpha: str, rank_minimum: dict[str, float], rank_maximum: dict[str, float]
) -> DataFrame:
    """Alpha rank, rank-risk components, their mean and count, and the all-clear flag."""
    work = rank_share(df, keys, alpha, "alpha_rank")
    work = risk_components(work, keys, rank_minimum, rank_maximum)
    names = [f"risk_{c}" for c in sorted(set(rank_minimum) | set(rank_maximum))]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    hits = sum(((F.col(c) > 0).cast("int") for c in names), F.lit(0))
    return carry(
        work.withColumns({"dirty_risk": total / float(len(names)), "dirty_count": hits, "clean": hits == 0}), work
    )


def learned_risk(
    df: DataFrame, scores: DataFrame, on: Sequence[str], keys: Sequence[str], score: str, out: str, transform: str = "rank"
) -> DataFrame:
    """Join a learned risk, rank (or clip) it in the group; missing takes the group median, then 0."""
    joined = attach(df, scores.select(*on, F.col(score).alias("_raw")), on)
    if transform == "rank":
        work = rank_share(joined, keys, "_raw", "_risk")
    else:
        work = joined.withColumn("_risk", clip(finite("_raw"), 0, 1))
    work = group_median(work, keys, {"_md": "_risk"})
    value = F.coalesce("_risk", "_md", F.lit(0.0))
    return carry(work.withColumn(out, value).drop("_raw", "_risk", "_md"), work)


def cohorts(
    df: DataFrame, keys: Sequence[str], alpha: str, variant: Variant, n: int, unique: Sequence[str]
) -> DataFrame:
    """Rows of the baseline top n or the variant top n, labelled kept, penalized_out or replacement_in.

    Both placings are columns of the same rows, so set algebra needs no join.
    """
    base = with_place(df.dropna(subset=[alpha]), keys, alpha, unique, out="_base")
    risk = F.coalesce(F.col(variant.risk), F.lit(0.0)) if variant.risk else F.lit(0.0)
    ok = F.col(alpha) >= variant.floor
    scored = base.withColumn("_v", F.when(ok, F.col(alpha) - variant.penalty * risk).otherwise(float("-inf")))
    both = with_place(carry(scored, base), keys, "_v", unique, out="_variant")
    before, after = F.col("_base") <= n, ok & (F.col("_variant") <= n)
    label = (
        F.when(before & after, "kept").when(before, "penalized_out").when(after, "replacement_in")
    )
    out = both.withColumn("cohort", label).where(F.col("cohort").isNotNull())
    return carry(out.drop("_base", "_v", "_variant"), both)


def cohort_metrics(
    df: DataFrame, cohort_rows: DataFrame, keys: Sequence[str], labels: dict[str, str]
) -> DataFrame:
    """Mean and excess over the whole group per cohort."""
    whole = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_g_{p}") for p, c in labels.items()])
    own = cohort_rows.groupBy(*keys, "cohort").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"_m_{p}") for p, c in labels.items()]
    )
    joined = attach(own, whole, keys)
    out = []
    for p in labels:
        m = F.col(f"_m_{p}")
        out += [(m * BPS).alias(f"{p}_mean_bps"), ((m - F.col(f"_g_{p}")) * BPS).alias(f"{p}_excess_bps")]
    return joined.select(*keys, "cohort", "rows", *out)


def feature_scales(df: DataFrame, keys: Sequence[str], features: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """Group rank share and z-score of features, and label excess in bps."""
    work = df
    for c in features:
        work = rank_share(work, keys, c, f"{c}_rank")
    moments = {f"_m_{c}": F.avg(c) for c in features} | {f"_s_{c}": F.stddev_samp(c) for c in features}
    work = group_columns(work, keys, moments | {f"_y_{p}": F.avg(c) for p, c in labels.items()})
    out = {
        f"{c}_z": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")))
        for c in features
    }
    out |= {f"{p}_excess_bps": (F.col(c) - F.col(f"_y_{p}")) * BPS for p, c in labels.items()}
    added = [*[f"{c}_rank" for c in features], *out]
    return carry(work.withColumns(out).select(*df.columns, *added), work)


def cohort_feature_gaps(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean feature rank and z per cohort and the penalised-minus-kept difference."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_rank").alias("_r"), F.col(f"{c}_z").alias("_z")) for c in features]
    )
    long = rows.select(*by, "cohort", F.inline(cells))
    at = lambda name, c: F.avg(F.when(F.col("cohort") == name, F.col(c)))
    return long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        *[at(k, c).alias(f"{k}_{n}") for k in ("kept", "penalized_out") for c, n in (("_r", "rank"), ("_z", "z"))],
        (at("penalized_out", "_r") - at("kept", "_r")).alias("gap_rank"),
        (at("penalized_out", "_z") - at("kept", "_z")).alias("gap_z"),
    )


def residual_gap(rows: DataFrame, by: Sequence[str], y: str, controls: Sequence[str]) -> DataFrame:
    """Kept and penalised means of y and of its OLS residual on the controls, per group of ``by``."""
    part = rows.where(F.col("cohort").isin("kept", "penalized_out") & F.col(y).isNotNull())
    x = {"_x0": F.lit(1.0)} | {f"_x{i + 1}": F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(controls)}
    part = part.withColumns(x)
    beta = group_coefficients(part, by, list(x), y, F.lit(True))
    fit = fitted(part, by, list(x), beta.select(*by, "beta"), "_fit")
    fit = fit.withColumn("_res", F.col(y) - F.col("_fit"))
    at = lambda name, c: F.avg(F.when(F.col("cohort") == name, F.col(c)))
    enough = F.count(F.lit(1)) > len(x) + 5
    gap = at("penalized_out", "_res") - at("kept", "_res")
    return fit.groupBy(*by).agg(
        F.count_if(F.col("cohort") == "kept").alias("kept_rows"),
        F.count_if(F.col("cohort") == "penalized_out").alias("penalized_rows"),
        (at("penalized_out", y) - at("kept", y)).alias("excess_gap"),
        F.when(enough, gap).alias("residual_gap"),
    )


def head_boost(
    df: DataFrame, keys: Sequence[str], base: str, overlay: str, head: int, weight: float, unique: Sequence[str], gate: int = 0
) -> DataFrame:
    """Base rank score plus a boost that falls linearly over the overlay's first ``head`` rows.

    With ``gate`` only the base's first ``gate`` rows are boosted.
    """
    if head <= 0 or weight <= 0:
        raise ValueError("head and weight must be positive")
    work = descending_score(df, keys, base, unique, rank="base_rank", out="base_score")
    work = descending_score(work, keys, overlay, unique, rank="overlay_rank", out="overlay_score")
    ok = F.col(overlay).isNotNull() & (F.col("overlay_rank") <= head)
    if gate > 0:
        ok = ok & (F.col("base_rank") <= gate)
    strength = clip((F.lit(head + 1.0) - F.col("overlay_rank")) / float(head), 0, 1)
    return carry(work.withColumn("blend", F.col("base_score") + weight * F.when(ok, strength).otherwise(0.0)), work)


def tail_means(rows: DataFrame, by: Sequence[str], value: str, cuts: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Raw mean, winsorised means and what the upper tail contributes."""
    names = {f"p{int(p * 100)}_threshold": p for p in cuts}
    limits = quantiles(rows, list(by), value, names)
    joined = attach(rows.where(F.col(value).isNotNull()), limits, by)
    out = [F.count(value).alias("rows"), F.avg(value).alias("raw_mean")]
    for p in cuts:
        k = f"p{int(p * 100)}"
        low = F.least(F.col(value), F.col(f"{k}_threshold"))
        out += [F.max(f"{k}_threshold").alias(f"{k}_threshold"), F.avg(low).alias(f"{k}_winsor_mean"), F.avg(F.col(value) - low).alias(f"{k}_tail")]
    return joined.groupBy(*by).agg(*out)


def selection_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Common rows of two selections per group, as counts and share of the first."""
    joined = a.select(*keys, *row).join(b.select(*keys, *row).withColumn("_in", F.lit(1)), [*keys, *row], "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("_in").alias("common"), (F.count("_in") / F.count(F.lit(1))).alias("overlap")
    )


