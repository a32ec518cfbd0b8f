"""Train and test windows, model fits on Spark ML, scoring, rolling evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.operators.evaluate import correlations, pool_report
from tickloom.operators.groups import carry, group_columns, ranks
from tickloom.operators.reference import calendar
from tickloom.operators.solve import near_means


def split_by_date(df: DataFrame, test_start: str | None = None, test_end: str | None = None, train_fraction: float = 0.8, date: str = "date") -> DataFrame:
    """Sessions tagged train or test: by a start date, or by the leading fraction of sessions."""
    days = calendar(df, date)
    if test_start:
        in_test = F.col(date) >= test_start
        if test_end:
            days = days.where(F.col(date) <= test_end)
        return days.withColumn("role", F.when(in_test, "test").otherwise("train"))
    # one row per session
    numbered = days.withColumns(
        {"_k": F.row_number().over(Window.orderBy(date)), "_n": F.count(F.lit(1)).over(Window.partitionBy())}
    )
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * train_fraction)))
    return numbered.select(date, F.when(F.col("_k") <= cut, "train").otherwise("test").alias("role"))


def _ends(roles: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Window table: first and last session per role, windows with both roles only."""
    at = lambda f, role: f(F.when(F.col("role") == role, F.col(date)))
    out = roles.groupBy(*keys).agg(
        at(F.min, "train").alias("train_start"), at(F.max, "train").alias("train_end"),
        at(F.min, "test").alias("test_start"), at(F.max, "test").alias("test_end"),
        F.count_if(F.col("role") == "train").alias("train_days"), F.count_if(F.col("role") == "test").alias("test_days"),
    )
    return out.where((F.col("train_days") > 0) & (F.col("test_days") > 0))


def annual_windows(df: DataFrame, min_train_years: int = 1, first_test_year: int | None = None, last_test_year: int | None = None, date: str = "date") -> DataFrame:
    """One window per test year, trained on all earlier years."""
    days = calendar(df, date).withColumn("year", F.substring(date, 1, 4).cast("int"))
    tests = days.select(F.col("year").alias("test_year")).distinct()
    roles = days.join(tests, F.col("year") <= F.col("test_year"))
    roles = roles.withColumn("role", F.when(F.col("year") == F.col("test_year"), "test").otherwise("train"))
    years = F.count_distinct(F.when(F.col("role") == "train", F.col("year")))
    enough = roles.groupBy("test_year").agg(years.alias("_y")).where(F.col("_y") >= min_train_years).drop("_y")
    out = _ends(roles.join(enough, "test_year"), ["test_year"], date)
    if first_test_year:
        out = out.where(F.col("test_year") >= first_test_year)
    return out.where(F.col("test_year") <= last_test_year) if last_test_year else out


def monthly_windows(
    df: DataFrame, train_months: int = 12, test_months: int = 1, stride: int | None = None, purge_sessions: int = 0, date: str = "date"
) -> DataFrame:
    """Rolling windows over calendar months, optionally without the last training sessions.

    Each session joins the few windows it belongs to by a generated list, not by comparing all pairs.
    """
    if train_months < 1 or test_months < 1 or (stride or 1) < 1:
        raise ValueError("months and stride must be >= 1")
    step = stride or test_months
    d = F.col(date).cast("date")
    number = F.year(d) * 12 + F.month(d) - 1
    days = calendar(df, date).withColumn("_m", number)
    months = days.select("_m").distinct()
    bounds = months.agg(F.sort_array(F.collect_list("_m")).alias("_a")).select(
        F.element_at("_a", F.least(F.lit(train_months), F.size("_a") - 1).cast("int") + 1).alias("_first"), F.array_max("_a").alias("_last")
    )
    tagged = days.crossJoin(bounds)  # one row of bounds
    reach = F.sequence(F.col("_m") - (test_months - 1), F.col("_m") + train_months)
    rows = tagged.withColumn("_test", F.explode(reach)).where(
        (F.col("_test") >= F.col("_first"))
        & (F.col("_test") + (test_months - 1) <= F.col("_last"))
        & (F.pmod(F.col("_test") - F.col("_first"), F.lit(step)) == 0)
    )
    role = F.when(F.col("_m") >= F.col("_test"), "test").otherwise("train")
    label = F.format_string("%04d-%02d", F.floor(F.col("_test") / 12).cast("int"), (F.col("_test") % 12 + 1).cast("int"))
    rows = rows.select(date, label.alias("test_month"), role.alias("role"))
    if purge_sessions:
            # sessions of one window: one row per day
        w = Window.partitionBy("test_month", "role").orderBy(F.col(date).desc())
        rows = rows.withColumn("_k", F.row_number().over(w))
        rows = rows.where((F.col("role") == "test") | (F.col("_k") > purge_sessions)).drop("_k")
    return _ends(rows, ["test_month"], date)


@dataclass
class Model:
    """A fitted scorer: ``score(df)`` appends ``prediction``."""

    kind: str
    features: list[str]
    score: Callable[[DataFrame], DataFrame]
    importance: dict[str, float] = field(default_factory=dict)


def _assembled(df: DataFrame, features: Sequence[str], expressions: dict, out: str = "_x") -> DataFrame:
    scaled = df.withColumns({f"_z{i}": expressions[c] for i, c in enumerate(features)})
    return VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol=out).transform(scaled)


def _sum_products(width: int):
    """Task function: per segment, the sums of all products of two columns over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                segment = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for k in np.unique(segment).tolist():
                    own = v[segment == k]
                    sums[k] = sums.get(k, 0.0) + own.T @ own
        a, b = np.triu_indices(width)
        for k, total in sums.items():
            columns = [np.full(len(a), k, np.int32), a.astype(np.int32), b.astype(np.int32), total[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["segment", "a", "b", "s"])

    return run


def _solve_ridge(width: int, alpha: float, centre: np.ndarray):
    """Weights on raw and on standardised features and the intercept, from the products of (1, features, target)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((width, width))
        g[rows["a"], rows["b"]] = rows["s"]
        g[rows["b"], rows["a"]] = rows["s"]
        n = g[0, 0]
        mean = g[0, 1:] / n
        spread = g[1:, 1:] - n * np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0) / n)
        # a spread within rounding of the summed squares is none
        deviation[deviation**2 * n <= 1e-12 * np.diag(g)[1:-1]] = 1.0
        gram = spread[:-1, :-1] / np.outer(deviation, deviation) + alpha * np.eye(width - 2)
        moment = spread[:-1, -1] / deviation
        try:
            scaled = np.linalg.solve(gram, moment)
        except np.linalg.LinAlgError:
            scaled = np.linalg.lstsq(gram, moment, rcond=None)[0]
        weights = scaled / deviation
        intercept = mean[-1] + centre[-1] - weights @ (mean[:-1] + centre[:-1])
        made = {"window": rows["window"].iloc[0], "rows": int(round(n)), "intercept": intercept, "weights": weights, "scaled": scaled}
        return pd.DataFrame({k: [v] for k, v in made.items()})

    return solve


def ridge_windows(
    df: DataFrame, windows: Sequence[dict], features: Sequence[str], target: str, alpha: float = 1.0, date: str = "date"
) -> DataFrame:
    """Ridge of every window from sums that all windows share: ``window, rows, intercept, weights, scaled``.

    ``windows`` is a short list of ``window``, ``train_start`` and ``train_end``; None leaves an end open. Their bounds cut
    the calendar into segments. One pass adds up the products of (1, features, target) per segment, running sums over
    segments make the products of any window the difference of two, and only matrices of features by features are solved.
    Missing features are 0 before scaling, rows without a target are left out, the intercept is not penalised, and windows
    without any row have no line.
    """
    width = len(features) + 2
    day = F.col(date)
    # a segment starts at every first day and behind every last day
    ends = [(w[k], late) for w in windows for k, late in (("train_start", 0), ("train_end", 1))]
    cuts = sorted({e for e in ends if e[0] is not None})
    segment = sum((F.when(day > F.lit(b) if late else day >= F.lit(b), 1).otherwise(0) for b, late in cuts), F.lit(0)).cast("int")
    x = [F.coalesce(finite(c), F.lit(0.0)) for c in features]
    rows = df.where(finite(target).isNotNull()).select(segment.alias("segment"), *[c.alias(f"_{i}") for i, c in enumerate(x)], finite(target).alias("_y"))
    values = [f"_{i}" for i in range(len(features))] + ["_y"]
    centre = near_means(rows, values)
    vector = F.array(F.lit(1.0), *[F.col(c) - float(m) for c, m in zip(values, centre)])
    products = rows.select("segment", vector.alias("v")).mapInArrow(_sum_products(width), "segment int, a int, b int, s double")
    sums = products.groupBy("segment", "a", "b").agg(F.sum("s").alias("s"))
    first = lambda w: cuts.index((w["train_start"], 0)) + 1 if w["train_start"] is not None else 0
    last = lambda w: cuts.index((w["train_end"], 1)) if w["train_end"] is not None else len(cuts)
    # every segment has a row, also one without data
    spine = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("segment")).crossJoin(sums.select("a", "b").distinct())
    so_far = Window.partitionBy("a", "b").orderBy("segment")
    running = spine.join(sums, ["segment", "a", "b"], "left").withColumn("s", F.coalesce(F.sum("s").over(so_far), F.lit(0.0)))
    sides = [(str(w["window"]), s, sign) for w in windows for s, sign in ((last(w), 1.0), (first(w) - 1, -1.0)) if s >= 0]
    sides = df.sparkSession.createDataFrame(sides, "window string, segment int, sign double")
    of = running.join(sides, "segment").groupBy("window", "a", "b").agg(F.sum(F.col("s") * F.col("sign")).alias("s"))
    some = of.where("a = 0 AND b = 0 AND s >= 0.5").select("window")
    schema = "window string, rows long, intercept double, weights array<double>, scaled array<double>"
    return of.join(some, "window").groupBy("window").applyInPandas(_solve_ridge(width, alpha, centre), schema)


def rolling_ridge(
    df: DataFrame, windows: Sequence[dict], features: Sequence[str], target: str, alpha: float = 1.0, date: str = "date"
) -> DataFrame:
    """Out-of-sample predictions of every window's test rows: the input is summed once and scored once, however many windows."""
    named = [{**w, "window": w.get("test_month") or str(w.get("test_year"))} for w in windows]
    fits = ridge_windows(df, named, features, target, alpha, date).select("window", "intercept", "weights")
    tests = F.array(*[F.struct(*[F.lit(w[k]).alias(k) for k in ("window", "test_start", "test_end")]) for w in named])
    inside = F.filter(tests, lambda w: F.col(date).between(w["test_start"], w["test_end"]))
    rows = df.withColumn("window", F.explode(F.transform(inside, lambda w: w["window"])))
    values = F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in features])
    terms = F.zip_with("weights", values, lambda w, x: w * x)
    # one row per window: a shuffle by window would leave all rows of a window to one task here and in what follows
    scored = rows.join(F.broadcast(fits), "window").withColumn("prediction", F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    return scored.drop("intercept", "weights")


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> Model:
    """Ridge on standardised features (missing is 0 before scaling), intercept unpenalised: ||y - Xw||^2 + alpha ||w||^2.

    One pass of sums and one small solve; the weights, one number per feature, come to the driver.
    """
    window = {"window": "all", "train_start": None, "train_end": None}
    fit = ridge_windows(train, [window], features, target, alpha, date=train.columns[0]).first()
    if fit is None:
        raise ValueError("no row with a target to fit on")

    def score(df: DataFrame) -> DataFrame:
        terms = [F.coalesce(finite(c), F.lit(0.0)) * w for c, w in zip(features, fit["weights"])]
        return df.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(fit["intercept"])))

    return Model("ridge", list(features), score, {c: abs(w) for c, w in zip(features, fit["scaled"])})


def fit_boosted(train: DataFrame, features: Sequence[str], target: str, weight: str | None = None, rounds: int = 10, depth: int = 3, seed: int = 7) -> Model:
    """Gradient boosted trees of Spark ML with optional sample weights."""
    filled = {c: F.coalesce(finite(c), F.lit(0.0)) for c in features}
    rows = train.where(finite(target).isNotNull()).withColumn("_y", finite(target))
    options = {"weightCol": weight} if weight else {}
    data = _assembled(rows, features, filled).select("_x", "_y", *([weight] if weight else []))
    fit = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed, **options).fit(data)

    def score(df: DataFrame) -> DataFrame:
        scored = fit.transform(_assembled(df, features, filled))
        return scored.select(*[c for c in df.columns if c != "prediction"], "prediction")

    return Model("boosted", list(features), score, dict(zip(features, map(float, fit.featureImportances.toArray()))))


def ensemble(
    df: DataFrame, models: Sequence[Model], weights: Sequence[float], keys: Sequence[str], mode: str = "raw", out: str = "prediction"
) -> DataFrame:
    """Weighted mean of member scores: raw, rank, rank_centered or zscore within the group."""
    total = float(sum(weights))
    if total <= 0 or len(weights) != len(models):
        raise ValueError("one positive weight per member")
    work, parts = df, []
    for i, model in enumerate(models):
        scored = model.score(work).withColumnRenamed("prediction", f"_s{i}")
        work = carry(scored, work)
        v = F.col(f"_s{i}")
        if mode in ("rank", "rank_centered"):
            work = ranks(work, keys, f"_s{i}", {f"_r{i}": "average_pct"})
            v = F.col(f"_r{i}") - (0.5 if mode == "rank_centered" else 0.0)
        elif mode == "zscore":
            work = group_columns(work, keys, {f"_m{i}": F.avg(v), f"_d{i}": F.stddev_samp(v)})
            v = F.try_divide(v - F.col(f"_m{i}"), F.col(f"_d{i}"))
        elif mode != "raw":
            raise ValueError("mode is raw, rank, rank_centered or zscore")
        parts.append(v * (weights[i] / total))
    return work.withColumn(out, reduce(lambda a, b: a + b, parts)).select(*df.columns, out)


def by_clock(df: DataFrame, models: dict[str, Model], fallback: Model, clock: str = "clock") -> DataFrame:
    """Per-clock models with a fallback for other clocks."""
    scored = fallback.score(df).withColumnRenamed("prediction", "_fallback")
    value = F.col("_fallback")
    for i, (name, model) in enumerate(models.items()):
        scored = model.score(scored).withColumnRenamed("prediction", f"_s{i}")
        value = F.when(F.col(clock) == name, F.col(f"_s{i}")).otherwise(value)
    return scored.select(*df.columns, value.alias("prediction"))


def rolling_predictions(
    df: DataFrame, windows: Sequence[dict], fit: Callable[[DataFrame], Model], date: str = "date"
) -> DataFrame:
    """Out-of-sample predictions over train/test windows (a short list of date bounds).

    Each window is a pair of date filters, pruned at the scan; the union is one plan.
    """
    parts = []
    for w in windows:
        train = df.where(F.col(date).between(w["train_start"], w["train_end"]))
        test = df.where(F.col(date).between(w["test_start"], w["test_end"]))
        model = fit(train)
        parts.append(model.score(test).withColumn("window", F.lit(w.get("test_month") or str(w.get("test_year")))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def window_metrics(predictions: DataFrame, label: str, keys: Sequence[str], n: int, unique: Sequence[str]) -> DataFrame:
    """Per window: rows, mean rank IC over groups, top-n mean and excess."""
    cells = ["window", *keys]
    ic = correlations(predictions, cells, label, "prediction")
    top = pool_report(predictions, cells, "prediction", {"": label}, n, unique)
    a = ic.groupBy("window").agg(F.sum("rows").alias("rows"), F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"))
    b = top.groupBy("window").agg(F.avg("top_mean").alias("top_mean"), F.avg("excess_bps").alias("excess_bps"))
    return a.join(b, "window")


def group_dependence(
    test: DataFrame, model: Model, refit: Callable[[list[str]], Model], groups: dict[str, Sequence[str]],
    shuffle: Callable[[DataFrame, Sequence[str]], DataFrame], metric: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Metric of the baseline, of each permuted feature group and of a refit without the group."""
    runs = [("baseline", "", model.score(test))]
    for name, columns in groups.items():
        present = [c for c in columns if c in model.features]
        runs.append(("permuted", name, model.score(shuffle(test, present))))
        rest = [c for c in model.features if c not in present]
        runs.append(("dropped", name, refit(rest).score(test)))
    tables = [metric(scored).withColumns({"run": F.lit(run), "group": F.lit(name)}) for run, name, scored in runs]
    return reduce(lambda a, b: a.unionByName(b), tables)


def audit_report(results: DataFrame, importance: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Runs of :func:`group_dependence` side by side with the baseline, with what their feature group weighs in it.

    ``delta_<metric>`` is the run's metric less the baseline's; ``importance`` and ``importance_share`` add up the
    importances of the group's features, and are those of all features in the baseline's row.
    """
    base = results.where("run = 'baseline'").select(*[F.col(m).alias(f"_base_{m}") for m in metrics])
    weight = importance.groupBy("group").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))
    whole = importance.agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features")).withColumn("group", F.lit(""))
    weight = weight.unionByName(whole.select("group", "importance", "features"))
    total = importance.agg(F.sum("importance").alias("_total"))
    # one row of the baseline, one total
    rows = results.crossJoin(base).crossJoin(total).join(weight, "group", "left")
    deltas = {f"delta_{m}": F.col(m) - F.col(f"_base_{m}") for m in metrics}
    share = F.try_divide(F.col("importance"), F.col("_total"))
    return rows.withColumns({**deltas, "importance_share": share}).drop("_total", *[f"_base_{m}" for m in metrics])


def importance_table(spark, model: Model, groups: dict[str, str]) -> DataFrame:
    rows = [(c, groups.get(c, "other"), v) for c, v in model.importance.items()]
    return spark.createDataFrame(rows, "feature string, group string, importance double")


def vector_column(df: DataFrame, vector: str, size: int, prefix: str = "f") -> DataFrame:
    """Elements of an array (or ML vector) column as columns."""
    kind = dict(df.dtypes)[vector]
    array = F.col(vector) if kind.startswith("array") else vector_to_array(vector)
    return df.select(*[c for c in df.columns if c != vector], *[array[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])
