"""Windows, fits and pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evaluate as E
from tickloom.operators import hygiene as H
from tickloom.operators import modeling as M


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a, b = rng.normal(), rng.normal() * 5 + 2
        rows.append((f"d{i % 10}", f"s{i}", float(a), float(b), float(2 * a - 0.3 * b + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, "g string, symbol string, a double, b double, y double")


def test_ridge_is_the_closed_form(frame):
    alpha = 20.0
    model = M.fit_ridge(frame, ["a", "b"], "y", alpha)
    p = frame.toPandas()
    x = p[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (p.y - p.y.mean()))
    want = dict(zip(p.symbol, z @ w + p.y.mean()))
    for r in model.score(frame).collect():
        assert r.prediction == pytest.approx(want[r.symbol], abs=1e-6)


def test_ensemble_of_ranks(frame):
    one, two = M.fit_ridge(frame, ["a"], "y"), M.fit_ridge(frame, ["b"], "y")
    out = M.ensemble(frame, [one, two], [3.0, 1.0], ["g"], "rank").toPandas()
    p = frame.toPandas()
    s1 = one.score(frame).toPandas().set_index("symbol").prediction
    s2 = two.score(frame).toPandas().set_index("symbol").prediction
    g = p.set_index("symbol").g
    want = 0.75 * s1.groupby(g).rank(pct=True) + 0.25 * s2.groupby(g).rank(pct=True)
    got = out.set_index("symbol").prediction
    assert np.allclose(got.sort_index(), want.sort_index())
    with pytest.raises(ValueError):
        M.ensemble(frame, [one], [1.0, 2.0], ["g"])


def test_clock_routing(frame):
    one, two = M.fit_ridge(frame, ["a"], "y"), M.fit_ridge(frame, ["b"], "y")
    out = M.by_clock(frame, {"d1": one}, two, clock="g").toPandas().set_index("symbol")
    a = one.score(frame).toPandas().set_index("symbol").prediction
    b = two.score(frame).toPandas().set_index("symbol").prediction
    for s, row in out.iterrows():
        assert row.prediction == pytest.approx((a if row.g == "d1" else b)[s])


def test_boosted_trees_learn_and_weigh(frame):
    model = M.fit_boosted(frame, ["a", "b"], "y", rounds=5)
    ic = E.correlations(model.score(frame), [], "y", "prediction").first().ic
    assert ic > 0.8 and model.importance["a"] > 0


def test_shuffle_keeps_values_in_their_group_and_is_reproducible(frame, small_groups):
    a = E.shuffle_within_groups(frame, ["a", "b"], ["g"], ["symbol"], 5).toPandas()
    b = E.shuffle_within_groups(frame.repartition(7), ["a", "b"], ["g"], ["symbol"], 5).toPandas()
    p = frame.toPandas()
    assert len(a) == len(p) and not a.sort_values("symbol").a.reset_index(drop=True).equals(p.sort_values("symbol").a.reset_index(drop=True))
    assert a.groupby("g").a.apply(sorted).to_dict() == p.groupby("g").a.apply(sorted).to_dict()
    joint = set(zip(p.a, p.b))
    assert set(zip(a.a, a.b)) == joint
    key = ["symbol"]
    assert a.sort_values(key)[["symbol", "a"]].reset_index(drop=True).equals(b.sort_values(key)[["symbol", "a"]].reset_index(drop=True))


def test_monthly_windows_and_purge(spark):
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 7) for d in (3, 10, 20)]
    df = spark.createDataFrame([(d,) for d in days], "date string")
    got = {r.test_month: r for r in M.monthly_windows(df, 2, 1).collect()}
    assert set(got) == {"2024-03", "2024-04", "2024-05", "2024-06"}
    assert got["2024-03"].train_start == "2024-01-03" and got["2024-03"].train_end == "2024-02-20"
    purged = {r.test_month: r for r in M.monthly_windows(df, 2, 1, purge_sessions=1).collect()}
    assert purged["2024-03"].train_end == "2024-02-10" and purged["2024-03"].train_days == 5


def test_windows_never_train_on_test_days(spark):
    df = spark.createDataFrame([(f"20{y}-0{m}-01",) for y in (20, 21, 22) for m in (1, 5)], "date string")
    for r in M.annual_windows(df).collect():
        assert r.train_end < r.test_start
    roles = {r.date: r.role for r in M.split_by_date(df, "2021-05-01").collect()}
    assert roles["2021-01-01"] == "train" and roles["2021-05-01"] == "test"


def test_hygiene_counts(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("nan"), 5.0), (None, 5.0), (float("inf"), 5.0), (0.0, 5.0)], "a double, b double")
    got = {r.feature: r for r in H.feature_hygiene(df, ["a", "b"]).collect()}
    a = got["a"]
    assert (a.missing_count, a.inf_count, a.finite_count, a.zero_count, a.unique_count) == (2, 1, 2, 1, 2)
    assert got["b"].constant and not a.constant


def test_components_and_prune(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 0.99, 0.99), ("b", "c", 0.95, 0.95), ("x", "y", 0.9999, 0.9999)], "feature_a string, feature_b string, corr double, abs_corr double"
    )
    parts = {r.feature: r.component for r in H.components(pairs).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    rows = [(f, "g", f == "k", False, 0.0, 10) for f in "abcxyk"]
    hygiene = spark.createDataFrame(rows, "feature string, group string, constant boolean, near_constant boolean, missing_rate double, finite_count long")
    got = {r.feature: (r.action, r.reason, r.keep_feature) for r in H.prune_report(hygiene, pairs, 0.98).collect()}
    assert got == {
        "k": ("drop", "constant", ""), "b": ("drop", "near_duplicate", "a"), "c": ("review", "high_correlation", "a"), "y": ("drop", "near_duplicate", "x"),
    }


def test_long_chain_settles(spark):
    pairs = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0, 1.0) for i in range(12)], "feature_a string, feature_b string, corr double, abs_corr double")
    assert {r.component for r in H.components(pairs).collect()} == {"n00"}


def test_sample_is_independent_of_partitioning(frame):
    from tickloom.operators.summaries import keyed_sample

    a = {r.symbol for r in keyed_sample(frame, ["g"], ["symbol"], 3, 9).collect()}
    b = {r.symbol for r in keyed_sample(frame.repartition(9, F.col("y")), ["g"], ["symbol"], 3, 9).collect()}
    assert a == b and len(a) == 30


def test_long_correlation_chains_are_one_component(spark):
    from pyspark.sql import functions as F

    from tickloom.operators.hygiene import components

    pairs = spark.range(1000).select(
        F.format_string("f%04d", F.col("id")).alias("feature_a"), F.format_string("f%04d", F.col("id") + 1).alias("feature_b")
    )
    got = components(pairs).collect()
    assert len(got) == 1001 and {r.component for r in got} == {"f0000"}


def test_pairs_of_many_features_with_gaps(spark):
    rng = np.random.default_rng(3)
    n, k = 240, 350
    data = rng.normal(size=(n, k)) + 50
    data[:, 1] = data[:, 0] * 3 - 2
    data[:, 2] = 7.1  # constant
    gaps = rng.random((n, k)) < 0.1
    names = [f"f{i}" for i in range(k)]
    wide = spark.createDataFrame([([None if g else float(v) for v, g in zip(*r)],) for r in zip(data, gaps)], "v array<double>")
    got = H.correlated_pairs(wide.repartition(5).select(*[F.col("v")[i].alias(c) for i, c in enumerate(names)]), names, 0.0).toPandas()
    assert len(got) == (k - 1) * (k - 2) // 2 and not {"f2"} & {*got.feature_a, *got.feature_b}
    for a, b, corr in got.sample(200, random_state=1)[["feature_a", "feature_b", "corr"]].itertuples(index=False):
        i, j = int(a[1:]), int(b[1:])
        both = ~gaps[:, i] & ~gaps[:, j]
        assert corr == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    assert got[(got.feature_a == "f0") & (got.feature_b == "f1")]["corr"].item() == pytest.approx(1.0)
    fewer = H.correlated_pairs(wide.select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.lit(None).cast("double").alias("c")), ["a", "b", "c"], 0.5)
    assert [(r.feature_a, r.feature_b) for r in fewer.collect()] == [("a", "b")]
