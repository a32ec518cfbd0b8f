"""Cross-section transforms: ranks, z-scores, robust scores, mixed and neutralised values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, finite, safe_div, truthy
from tickloom.operators.groups import attach, carry, group_columns, group_median, position, ranks

# fixed value: makes the median absolute deviation comparable to a standard deviation
MAD_SCALE = 1.4826
MODES = ("demean", "zscore", "robust_zscore", "rank_pct", "rank_centered", "rank")


def relative(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    modes: Sequence[str] = ("zscore", "rank_centered"),
    prefix: str = "xs_rel_",
    method: str = "average",
) -> DataFrame:
    """Append within-group versions ``<prefix><column>_<mode>`` of numeric columns."""
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    original = df.columns
    out: dict[str, Column] = {}
    means = {}
    for c in columns:
        if {"demean", "zscore"} & set(modes):
            means[f"_m_{c}"] = F.avg(c)
        if "zscore" in modes:
            means[f"_s_{c}"] = F.stddev_samp(c)
    work = group_columns(df, keys, means) if means else df
    if "robust_zscore" in modes:
        work = group_median(work, keys, {f"_md_{c}": c for c in columns})
        spread = work.withColumns({f"_a_{c}": F.abs(F.col(c) - F.col(f"_md_{c}")) for c in columns})
        work = group_median(carry(spread, work), keys, {f"_mad_{c}": f"_a_{c}" for c in columns})
    if {"rank_pct", "rank_centered", "rank"} & set(modes):
        for c in columns:
            work = ranks(work, keys, c, {f"_p_{c}": f"{method}_pct"})
    for c in columns:
        v = F.col(c)
        for mode in modes:
            name = f"{prefix}{c}_{'rank_centered' if mode == 'rank' else mode}"
            if mode == "demean":
                out[name] = v - F.col(f"_m_{c}")
            elif mode == "zscore":
                out[name] = safe_div(v - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
            elif mode == "robust_zscore":
                out[name] = safe_div(v - F.col(f"_md_{c}"), F.col(f"_mad_{c}") * MAD_SCALE)
            elif mode == "rank_pct":
                out[name] = F.col(f"_p_{c}")
            else:
                out[name] = F.col(f"_p_{c}") - 0.5
    return carry(work.withColumns(out).select(*original, *out), work)


def replace_values(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    mode: str = "rank_centered",
    method: str = "average",
) -> DataFrame:
    """Replace columns by their within-group transform, as float; ``rank`` is the raw rank here."""
    clean = carry(df.withColumns({c: finite(c) for c in columns}), df)
    if mode == "rank":
        work = clean
        for c in columns:
            work = ranks(work, keys, c, {f"_r_{c}": method})
        new = {c: F.col(f"_r_{c}").cast("float") for c in columns}
        return work.withColumns(new).select(*df.columns)
    work = relative(clean, columns, keys, [mode], prefix="_x_", method=method)
    new = {c: F.col(f"_x_{c}_{mode}").cast("float") for c in columns}
    return work.withColumns(new).select(*df.columns)


def rank_share(df: DataFrame, keys: Sequence[str], column: str, out: str, method: str = "average") -> DataFrame:
    """Percentile rank in the group, NULL excluded from rank and count."""
    return ranks(df, keys, column, {out: f"{method}_pct"})


def descending_score(
    df: DataFrame, keys: Sequence[str], score: str, unique: Sequence[str], rank: str = "rank", out: str = "rank_score"
) -> DataFrame:
    """Descending first-rank (NULL last) and 1 - (rank - 1) / (n - 1)."""
    down = df.withColumn("_down", F.coalesce(-F.col(score), F.lit(float("inf"))))
    placed = position(carry(down, df), keys, ["_down", *unique], out=rank, total="_n")
    value = F.when(F.col("_n") > 1, 1.0 - (F.col(rank) - 1) / (F.col("_n") - 1)).otherwise(1.0)
    return carry(placed.withColumn(out, value).drop("_down", "_n"), placed)


def candidate_flag(
    df: DataFrame,
    keys: Sequence[str],
    out: str = "candidate",
    minimum: dict[str, float] | None = None,
    maximum: dict[str, float] | None = None,
    rank_minimum: dict[str, float] | None = None,
    rank_maximum: dict[str, float] | None = None,
    method: str = "average",
) -> DataFrame:
    """Rows within all absolute bounds and all percentile-rank bounds; a missing value fails."""
    tests: list[Column] = []
    for bounds, test in ((minimum, "ge"), (maximum, "le")):
        for c, b in (bounds or {}).items():
            tests.append(F.col(c) >= b if test == "ge" else F.col(c) <= b)
    work = df
    ranked = sorted(set(rank_minimum or {}) | set(rank_maximum or {}))
    for c in ranked:
        work = rank_share(work, keys, c, f"_rp_{c}", method)
        if c in (rank_minimum or {}):
            tests.append(F.col(f"_rp_{c}") >= rank_minimum[c])
        if c in (rank_maximum or {}):
            tests.append(F.col(f"_rp_{c}") <= rank_maximum[c])
    passed = reduce(lambda a, b: a & b, [truthy(t) for t in tests]) if tests else F.lit(True)
    return carry(work.withColumn(out, passed).drop(*[f"_rp_{c}" for c in ranked]), work)


def transformed_label(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    valid: Column | None = None,
    transform: str = "demean",
    min_size: int = 2,
    out: str = "target",
    eps: float = 1e-12,
) -> DataFrame:
    """Label transform over the valid rows of a group, with the group's mean, median, std (ddof 0),
    count and the row's rank share alongside; NULL in a group below the minimum size."""
    v = finite(value)
    used = F.when(truthy(valid), v) if valid is not None else v
    work = carry(df.withColumn("_v", used), df)
    work = group_columns(
        work,
        keys,
        {
            f"{out}_mean": F.avg("_v"),
            f"{out}_std": F.stddev_pop("_v"),
            f"{out}_count": F.count("_v"),
        },
    )
    work = group_median(work, keys, {f"{out}_median": "_v"})
    work = ranks(work, keys, "_v", {f"{out}_rank": "average_pct"})
    x, n = F.col("_v"), F.col(f"{out}_count")
    mean, std = F.col(f"{out}_mean"), F.col(f"{out}_std")
    # targets centre the rank on its own mean; features subtract one half instead
    value_of = {
        "raw": x,
        "demean": x - mean,
        "center": x - mean,
        "zscore": F.when(std > eps, safe_div(x - mean, std)),
        "rank_pct": F.col(f"{out}_rank"),
        "rank_centered": F.col(f"{out}_rank") - (n + 1.0) / (F.lit(2.0) * F.greatest(n, F.lit(1))),
    }
    if transform not in value_of:
        raise ValueError(f"unknown label transform: {transform}")
    result = F.when(x.isNotNull() & (n >= min_size), value_of[transform])
    return carry(work.withColumn(out, result).drop("_v"), work)


def mixed_target(
    df: DataFrame,
    keys: Sequence[str],
    short: str,
    long: str,
    weight: float,
    min_size: int,
    usable: Column | None = None,
    clip_std: float = 0.0,
    out: str = "mixed_target",
    eps: float = 1e-12,
) -> DataFrame:
    """z(short) + weight * z(long) over usable rows (ddof 0), with optional clipping and re-scaling.

    Each pass re-reads the same group keys, so all passes share one shuffle.
    """
    parts = [short] if weight == 0.0 else [short, long]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    if usable is not None:
        ok = ok & truthy(usable)
    work = carry(df.withColumns({"_ok": ok, "_a": F.col(short), "_b": F.col(long)}), df)

    def moments(frame: DataFrame, column: str, tag: str, count: bool = False) -> DataFrame:
        used = F.when(F.col("_ok"), F.col(column))
        aggregates = {f"_m{tag}": F.avg(used), f"_s{tag}": F.stddev_pop(used)}
        if count:
            aggregates[f"_n{tag}"] = F.count(used)
        return group_columns(frame, keys, aggregates)

    def narrowed(frame: DataFrame, cond: Column) -> DataFrame:
        return carry(frame.withColumn("_ok", F.col("_ok") & truthy(cond)), frame)

    work = moments(work, "_a", "a", count=True)
    work = narrowed(work, (F.col("_na") >= min_size) & (F.col("_sa") > eps))
    if weight != 0.0:
        work = moments(work, "_b", "b")
        work = narrowed(work, F.col("_sb") > eps)
    if clip_std > 0.0:
        clipped = {}
        for tag in ["a", "b"] if weight != 0.0 else ["a"]:
            m, s = F.col(f"_m{tag}"), F.col(f"_s{tag}")
            clipped[f"_{tag}"] = clip(f"_{tag}", m - clip_std * s, m + clip_std * s)
        work = carry(work.withColumns(clipped), work)
        again = work.drop("_ma", "_sa", "_mb", "_sb")
        work = moments(carry(again, work), "_a", "a")
        if weight != 0.0:
            work = moments(work, "_b", "b")
        still = F.col("_sa") > eps
        work = narrowed(work, still & (F.col("_sb") > eps) if weight != 0.0 else still)
    z = safe_div(F.col("_a") - F.col("_ma"), F.col("_sa"))
    if weight != 0.0:
        z = z + F.lit(float(weight)) * safe_div(F.col("_b") - F.col("_mb"), F.col("_sb"))
    return carry(work.withColumn(out, F.when(F.col("_ok"), z)).select(*df.columns, out), work)


__all__ = [
    "MAD_SCALE", "MODES", "attach", "candidate_flag", "descending_score", "mixed_target",
    "rank_share", "relative", "replace_values", "transformed_label",
]
