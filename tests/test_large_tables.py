"""Steps whose time or memory used to grow faster than the tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evaluate, execution, hygiene, modeling, variants
from tickloom.plans.base import Tables


def panel(n, seed):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"y": r.integers(0, 9, n) / 4.0, "s": np.round(r.normal(size=n), 2), "t": r.normal(size=n), "u": r.integers(0, 2, n) * 1.0})


@pytest.mark.parametrize("few", [100_000, 20])
def test_correlation_of_all_rows_ranks_counted_values(spark, small_groups, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW_VALUES", few, raising=False)
    pdf = panel(400, 1)
    pdf.loc[::7, "y"] = None
    df = spark.createDataFrame(pdf.replace({np.nan: None}), "y double, s double, t double, u double")

    def never(*_):
        raise AssertionError("ranks all rows at once")

    monkeypatch.setattr(evaluate, "ranks", never)
    for score in ("s", "t", "u"):
        got = evaluate.correlations(df, [], "y", score).first()
        some = pdf.dropna()
        assert got["rows"] == len(some) and got["win_rate"] == pytest.approx((some.y > 0).mean())
        assert got["ic"] == pytest.approx(some.y.corr(some[score])) and got["mean_label"] == pytest.approx(some.y.mean())
        assert got["rank_ic"] == pytest.approx(some.y.rank().corr(some[score].rank()))
    flat = evaluate.correlations(df.withColumn("y", F.lit(1.0)), [], "y", "s").first()
    assert flat["rows"] == 400 and flat["ic"] is None and flat["rank_ic"] is None
    none = evaluate.correlations(df.where("s > 1e9"), [], "y", "s").first()
    assert none["rows"] == 0 and none["rank_ic"] is None


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_rank_correlation_puts_rows_together_in_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(hygiene, "CHUNK_BITS", bits)
    pdf = panel(500, 2)
    pdf.loc[::5, "t"] = np.nan
    pdf.loc[::11, "y"] = np.inf
    pdf.loc[3] = np.nan
    df = spark.createDataFrame(pdf, "y double, s double, t double, u double").repartition(3)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in hygiene.correlated_pairs(df, ["y", "s", "t", "u"], 0.0, "spearman").collect()}
    ranked = pdf.replace([np.inf], np.nan).rank()
    assert got == {(a, b): pytest.approx(ranked[a].corr(ranked[b])) for a, b in got} and len(got) == 6


def test_window_tasks_stay_small(spark):
    """F6, F8, F10, F11: the rows of a task do not grow with the rows of the table."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1m")
    try:
        Tables(spark, "nowhere")
        rows, parts = 3_000_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
        wide = spark.range(rows).select((F.col("id") % 5000).alias("k"), F.rand(1).alias("v"))
        placed = evaluate.position(wide, ["k"], ["v"])
        held = placed.where("_pos > 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert held < rows / parts / 1.5
    finally:
        spark.conf.unset(size)


def test_rolling_ridge_keeps_windows_spread(spark):
    days = [f"{y}-01-{d:02d}" for y in (2000, 2001, 2002) for d in range(1, 21)]
    df = spark.createDataFrame([(d, float(i), float(i % 7)) for i, d in enumerate(days)], "date string, x double, y double")
    windows = [{"test_year": y, "train_start": "2000-01-01", "train_end": f"{y - 1}-12-31", "test_start": f"{y}-01-01", "test_end": f"{y}-12-31"} for y in (2001, 2002)]
    out = modeling.rolling_ridge(df, windows, ["x"], "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [window" in plan
    assert out.count() == 40


def test_variant_summary_computes_its_metrics_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("a", f"2020-0{m}-01", c, m * 1.0 - 1.5) for m in (1, 2, 3) for c in ("x", "y")]
    schema = "variant string, date string, clock string, next_bps double"
    metrics = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    got = variants.variant_summary(metrics, "next_bps", "date", "clock").collect()
    assert seen.value == len(rows)
    assert [(r.groups, r.positive_months, r.positive_minutes) for r in got] == [(6, 2, 2)]


def test_days_are_counted_before_limits_are_worked_out(spark, monkeypatch):
    counted, real = [], execution.hot_groups
    monkeypatch.setattr(execution, "hot_groups", lambda df, keys: counted.append(df.columns) or real(df, keys))
    rows = [("p", "2020-01-01", c, f"s{i}", 100.0 * (i + 1), float(i), "O") for c in ("x", "y") for i in range(6)]
    df = spark.createDataFrame(rows, "pool string, date string, decision string, symbol string, row_limit double, prediction double, status string")
    got = execution.visible_refill(df, execution.Execution(symbol_cap=700.0, max_names=4), 1200.0, "prediction", status="status", statuses=["O"])
    found = sorted((r.decision, r.allocation_order, r.symbol, r.allocated_notional) for r in got.collect())
    assert found == [("x", 1, "s5", 600.0), ("x", 2, "s4", 500.0), ("x", 3, "s3", 100.0), ("y", 1, "s5", 100.0), ("y", 2, "s4", 200.0), ("y", 3, "s3", 400.0), ("y", 4, "s2", 300.0)]
    assert counted and not any("_limit" in c for c in counted)
