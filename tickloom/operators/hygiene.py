"""Feature hygiene: profiles, correlated pairs, and what to prune."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite, safe_div
from tickloom.operators.groups import attach, counted_quantiles, running
from tickloom.operators.solve import near_means
from tickloom.session import checkpoint


PROFILE = ("rows", "missing", "finite", "infinite", "zero")
CHUNK_BITS = 12  # rows of one chunk when values are put back into rows, as a power of two
HELD_ROWS = 200_000  # rows whose values a task counts before it passes them on


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Rows by features; NULL is NaN."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


def _profile(centre: np.ndarray):
    """Task function: counts, sums around ``centre`` and extremes of each feature over the task's rows."""
    k = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((5, k), np.int64), np.zeros((2, k))
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch, k)
                good = np.isfinite(v)
                counts += np.stack([np.full(k, len(v)), np.isnan(v).sum(0), good.sum(0), np.isinf(v).sum(0), (v == 0).sum(0)])
                low, high = np.minimum(low, np.where(good, v, np.inf).min(0)), np.maximum(high, np.where(good, v, -np.inf).max(0))
                off = np.where(good, v - centre, 0.0)
                sums += np.stack([off.sum(0), (off * off).sum(0)])
        some = counts[2] > 0
        ends = [pa.array(e, pa.float64(), mask=~some) for e in (low, high)]
        columns = [pa.array(np.arange(k), pa.int32()), *map(pa.array, counts), *map(pa.array, sums), *ends]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *PROFILE, "s", "ss", "low", "high"])

    return run


def _counted(k: int):
    """Task function: how often each finite value of each feature stands in some of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(held)
            held.clear()
            for i in range(k):
                value, n = np.unique(v[np.isfinite(v[:, i]), i], return_counts=True)
                columns = [pa.array(np.full(len(value), i), pa.int32()), pa.array(value), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "v", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch, k))
            if sum(map(len, held)) * k > HELD_ROWS * 8:
                yield from passed_on()
        if held:
            yield from passed_on()

    return run


def feature_hygiene(
    df: DataFrame, features: Sequence[str], groups: dict[str, str] | None = None, near_constant: float = 0.999
) -> DataFrame:
    """Per feature: missing, infinite, zero, distinct, most frequent value, moments and quantiles.

    Two scans, however many features, and no row per row and feature: one adds up counts, sums and extremes in arrays, one
    counts values. Distinct and top counts and quantiles all come from that table of (feature, value, count).
    """
    names = list(features)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    centre = near_means(rows, rows.columns)
    wide = rows.select(F.array(*rows.columns).alias("v"))
    parts = wide.mapInArrow(_profile(centre), "i int, " + ", ".join(f"{c} long" for c in PROFILE) + ", s double, ss double, low double, high double")
    label = F.array(*map(F.lit, names))
    middle = F.array(*[F.lit(float(c)) for c in centre])
    n, total = F.sum("finite"), F.sum("s")
    spread = F.greatest(F.sum("ss") - total * total / n, F.lit(0.0))
    stats = parts.groupBy("i").agg(
        *[F.sum(c).alias(out) for c, out in zip(PROFILE, ("rows", "missing_count", "finite_count", "inf_count", "zero_count"))],
        F.when(n > 0, middle[F.col("i")] + F.try_divide(total, n)).alias("mean"),
        F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    counts = wide.mapInArrow(_counted(len(names)), "i int, v double, n long").groupBy("i", "v").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts)  # read for tops and for quantiles
    tops = counts.groupBy("i").agg(F.count(F.lit(1)).alias("unique_count"), F.max("n").alias("top_count"))
    cuts = counted_quantiles(counts, ["i"], "v", "n", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    out = attach(attach(stats.where("rows > 0"), tops, ["i"]), cuts, ["i"]).withColumn("feature", label[F.col("i")]).drop("i")
    unique = F.coalesce("unique_count", F.lit(0))
    top = safe_div("top_count", "finite_count")
    kind = groups or {}
    names = F.create_map(*[x for c in features for x in (F.lit(c), F.lit(kind.get(c, "other")))])
    return out.withColumns(
        {
            "unique_count": unique,
            "top_count": F.coalesce("top_count", F.lit(0)),
            "missing_rate": safe_div("missing_count", "rows"),
            "finite_rate": safe_div("finite_count", "rows"),
            "zero_rate": safe_div("zero_count", "finite_count"),
            "top_frequency_ratio": top,
            "constant": unique <= 1,
            "near_constant": F.coalesce((unique > 1) & (top >= near_constant), F.lit(False)),
            "group": names[F.col("feature")],
        }
    )


PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")  # over rows where both features have a value
ROUNDING = 1e-12


def _values(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Rows by features; what is missing or infinite is NaN."""
    v = _matrix(batch, k)
    v[~np.isfinite(v)] = np.nan
    return v


def _feature_sums(k: int):
    """Task function: count and sum of each feature over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            v = _values(batch, k)
            n += (~np.isnan(v)).sum(axis=0)
            total += np.nansum(v, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(total)], names=["i", "n", "total"])

    return run


def _pair_sums(means: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Task function: sums over the task's rows, less ``means``, for the pairs ``left[i], right[i]`` of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = _values(batch, len(means)) - means
            there = ~np.isnan(v)
            v[~there] = 0.0
            there = there.astype(float)
            new = np.stack([there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v])
            total = new if total is None else total + new
        if total is not None:
            n, x, xx, xy = total
            sums = [n[left, right], x[left, right], x[right, left], xx[left, right], xx[right, left], xy[left, right]]
            ends = [pa.array(left, pa.int32()), pa.array(right, pa.int32())]
            yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, sums)], names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return run


def _rows_of(k: int):
    """Task function: one array of ``k`` values per row from ``(_chunk, _row, i, _rank)``, which come chunk after chunk."""

    def made(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, i, rank = (np.concatenate(c) for c in zip(*parts))
        numbers, at = np.unique(row, return_inverse=True)
        v = np.full((len(numbers), k), np.nan)
        v[at, i] = rank
        lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * k, pa.array(v.ravel()))
        return pa.RecordBatch.from_arrays([lists], names=["_ranks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        chunk = None
        for batch in batches:
            if batch.num_rows:
                chunks, *values = (c.to_numpy() for c in batch.columns)
                # rows of the batch that belong to chunks which end in it
                whole = int(np.searchsorted(chunks, chunks[-1]))
                if whole or chunks[-1] != chunk:
                    done = [*held, [v[:whole] for v in values]] if whole else held
                    if done:
                        yield made(done)
                    held = []
                held.append([v[whole:] for v in values])
                chunk = chunks[-1]
        if held:
            yield made(held)

    return run


def _ranked(df: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``_ranks``: average ranks of every feature in one array per row, NaN where a value is missing; and their means.

    All features are ranked at once: a table of (feature, value, count) is placed by running sums, and only its ranks are
    joined to the values. The rows are numbered in a written copy, so a repeated task finds the same numbers.
    """
    k = len(names)
    numbered = checkpoint(df.select(*[finite(c).alias(f"_{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("_row")))
    values = F.array(*[F.col(f"_{i}") for i in range(k)])
    counts = numbered.select(values.alias("v")).mapInArrow(_counted(k), "i int, v double, n long")
    counts = checkpoint(counts.groupBy("i", "v").agg(F.sum("n").alias("n")))
    placed = running(counts, ["i"], ["v"], {"_high": ("sum", "n")})
    placed = placed.select("i", "v", (F.col("_high") - (F.col("n") - 1) / 2.0).alias("_rank"))
    long = numbered.select("_row", F.posexplode(values).alias("i", "v")).where("v IS NOT NULL")
    chunk = F.shiftright("_row", CHUNK_BITS).alias("_chunk")
    # a value that many rows share would fill one task of a merge join
    found = long.join(placed.hint("shuffle_hash"), ["i", "v"]).select(chunk, "_row", "i", "_rank")
    lined = found.repartition("_chunk").sortWithinPartitions("_chunk")
    means = np.zeros(k)
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one row per feature
        means[r["i"]] = (r["n"] + 1) / 2.0
    return lined.mapInArrow(_rows_of(k), "_ranks array<double>"), means


def correlated_pairs(
    df: DataFrame,
    features: Sequence[str],
    threshold: float,
    method: str = "pearson",
    groups: dict[str, str] | None = None,
    same_group_only: bool = False,
    min_count: int = 100,
) -> DataFrame:
    """Feature pairs with |correlation| at or above the threshold, on complete pairs.

    Every task adds up products of its rows, centred on the feature means, in matrices of features by features; one row
    per pair and task is then summed by Spark. A pair is constant, and has no correlation, where its spread is below
    rounding noise. The pair list grows with the square of the feature count, never with the data.
    """
    kind = groups or {}
    names = list(features)
    if method == "spearman":
        work, means = _ranked(df, names)
    else:
        work = df.select(F.array(*[F.col(c).cast("double") for c in names]))
        # one row per feature reaches the driver
        sums = work.mapInArrow(_feature_sums(len(names)), "i int, n long, total double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        means = np.zeros(len(names))
        for r in sums.collect():
            means[r["i"]] = r["total"] / max(1, r["n"])
    left, right = np.triu_indices(len(names), 1)
    if same_group_only:
        group = np.array([kind.get(c, "other") for c in names])
        same = group[left] == group[right]
        left, right = left[same], right[same]
    moments = work.mapInArrow(_pair_sums(means, left, right), "a int, b int, " + ", ".join(f"{c} double" for c in PAIR_SUMS))
    t = moments.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread_x, spread_y = F.col("xx") - x * x / n, F.col("yy") - y * y / n
    varied = (spread_x > ROUNDING * F.col("xx")) & (spread_y > ROUNDING * F.col("yy"))
    corr = F.when((n >= min_count) & varied, (F.col("xy") - x * y / n) / F.sqrt(spread_x) / F.sqrt(spread_y))
    label = F.array(*map(F.lit, names))
    pairs = t.where("n > 0").select(label[F.col("a")].alias("feature_a"), label[F.col("b")].alias("feature_b"), corr.alias("corr"))
    return pairs.withColumn("abs_corr", F.abs("corr")).where(F.col("abs_corr") >= threshold)


def components(pairs: DataFrame, a: str = "feature_a", b: str = "feature_b") -> DataFrame:
    """Connected components of the pair graph: (feature, component), the component named by its least member.

    A round takes the least label among the neighbours and then the label of that label, so paths halve; rounds
    repeat until nothing changes, and each is cut from its lineage.
    """
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = checkpoint(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpoint(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("_near"))
        lower = labels.join(near, "x").select("x", "label", F.least("label", "_near").alias("_low"))
        hop = lower.select(F.col("x").alias("_low"), F.col("_low").alias("_next"))
        moved = lower.join(hop, "_low").select("x", F.col("_next").alias("label"), (F.col("_next") < F.col("label")).alias("_moved"))
        moved = checkpoint(moved)
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels.select(F.col("x").alias("feature"), F.col("label").alias("component"))


def prune_report(
    hygiene: DataFrame, pairs: DataFrame, near_duplicate: float, importance: DataFrame | None = None
) -> DataFrame:
    """Per feature that should go or be looked at: action, reason, the feature kept instead.

    Constant features drop; in a component all but the representative drop when they nearly
    duplicate it, else are listed for review.
    """
    info = hygiene.select("feature", "group", "constant", "near_constant", "missing_rate", "finite_count")
    if importance is not None:
        info = attach(info, importance, ["feature"])
    else:
        info = info.withColumn("importance", F.lit(0.0))
    member = attach(components(pairs), info, ["feature"])
    # one row per feature of a component: far below any task limit
    w = Window.partitionBy("component").orderBy(
        "constant", "near_constant", F.col("importance").desc(), "missing_rate", F.col("finite_count").desc(), "feature"
    )
    kept = member.withColumn("keep_feature", F.first("feature").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = pairs.select("feature_a", "feature_b", "abs_corr")
    both = both.unionByName(both.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "abs_corr"))
    strongest = both.groupBy(F.col("feature_a").alias("feature")).agg(F.max("abs_corr").alias("_any"))
    direct = both.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("keep_feature"), "abs_corr")
    linked = attach(attach(kept, direct, ["feature", "keep_feature"]), strongest, ["feature"])
    close = F.coalesce("abs_corr", "_any")
    flat = F.col("constant") | F.col("near_constant")
    linked = linked.where((F.col("feature") != F.col("keep_feature")) & ~flat).select(
        "feature", "group", F.when(close >= near_duplicate, "drop").otherwise("review").alias("action"),
        F.when(close >= near_duplicate, "near_duplicate").otherwise("high_correlation").alias("reason"),
        "keep_feature", close.alias("max_abs_corr"),
    )
    empty = info.where(flat).select(
        "feature", "group", F.lit("drop").alias("action"), F.when(F.col("constant"), "constant").otherwise("near_constant").alias("reason"),
        F.lit("").alias("keep_feature"), F.lit(None).cast("double").alias("max_abs_corr"),
    )
    return empty.unionByName(linked)
