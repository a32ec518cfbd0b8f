"""Least squares per group from mergeable sums; only k x k systems reach Python."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.operators.groups import attach


def near_means(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Means of some rows, to take sums of products around: any centre gives the same result, a near one keeps digits."""
    near = rows.select(*columns).limit(1000).agg(*[F.avg(finite(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return np.array([near[f"_{i}"] or 0.0 for i in range(len(columns))])


def _solver(k: int, alpha: float):
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, moment: pd.Series, use: pd.Series) -> pd.Series:
        out = []
        for g, m, u in zip(gram, moment, use):
            beta = np.zeros(k)
            on = np.flatnonzero(np.asarray(u, dtype=bool))
            if len(on):
                full = np.zeros((k, k))
                for value, (i, j) in zip(g, upper):
                    full[i, j] = full[j, i] = value
                a = full[np.ix_(on, on)] + alpha * np.eye(len(on))
                b = np.asarray(m, dtype=float)[on]
                try:
                    beta[on] = np.linalg.solve(a, b)
                except np.linalg.LinAlgError:
                    beta[on] = np.linalg.lstsq(a, b, rcond=None)[0]
            out.append(beta)
        return pd.Series(out)

    return solve


def group_coefficients(
    df: DataFrame,
    keys: Sequence[str],
    x: Sequence[str],
    y: str,
    used: Column,
    alpha: float = 0.0,
    usable: Sequence[Column] | None = None,
    min_columns: int = 0,
    out: str = "beta",
) -> DataFrame:
    """Ridge coefficients of y on x per group over the ``used`` rows: one row per group.

    ``usable`` are aggregate conditions, one per x: an unusable column gets
    coefficient 0, and with fewer than ``min_columns`` usable ones all are 0.
    """
    k = len(x)
    at = [F.when(used, F.col(c)) for c in x]
    gram = [F.coalesce(F.sum(at[i] * at[j]), F.lit(0.0)) for i in range(k) for j in range(i, k)]
    moment = [F.coalesce(F.sum(at[i] * F.col(y)), F.lit(0.0)) for i in range(k)]
    flags = [F.coalesce(u, F.lit(False)) for u in usable] if usable else [F.lit(True)] * k
    sums = df.groupBy(*keys).agg(
        F.array(*gram).alias("_gram"), F.array(*moment).alias("_moment"), F.array(*flags).alias("_use")
    )
    count = F.size(F.filter("_use", lambda u: u))
    active = F.when(count >= min_columns, F.col("_use")).otherwise(F.array(*[F.lit(False)] * k))
    return sums.withColumn("_n_use", count).select(
        *keys,
        _solver(k, alpha)("_gram", "_moment", active).alias(out),
        F.col("_n_use").cast("double").alias(f"{out}_columns"),
    )


def fitted(df: DataFrame, keys: Sequence[str], x: Sequence[str], beta: DataFrame, out: str) -> DataFrame:
    """Append sum of beta_i * x_i, with the group's coefficients joined by key."""
    joined = attach(df, beta, keys)
    value = F.lit(0.0)
    for i, c in enumerate(x):
        value = value + F.col("beta")[i] * F.col(c)
    return joined.withColumn(out, value).drop("beta")
