"""Run series, day builds, score matrices, additive ridge windows and mergeable summaries on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import build as BD
from tickloom.operators import buckets as B
from tickloom.operators import evaluate as E
from tickloom.operators import hygiene as H
from tickloom.operators import modeling as M
from tickloom.operators import series as S
from tickloom.operators import summaries as A

# ---- run series


def runs(spark):
    rows = [("a", "2024-01-01", 4, 2, 10.0, 6.0), ("a", "2024-01-02", 0, 0, None, 2.0), ("a", "2024-01-08", 5, 9, 4.0, 1.0), ("b", "2024-01-02", 4, 1, 3.0, 3.0)]
    return spark.createDataFrame(rows, "series string, date string, candidate_rows long, selected_rows long, top double, pool double")


def test_fees_by_known_and_estimated_turnover(spark):
    known = spark.createDataFrame([("2024-01-01", 0.25)], "date string, turnover double")
    got = S.with_fees(runs(spark), {"net": "top"}, {"pool_net": "pool"}, 8.0, known)
    rows = {(r.series, r.date): (r.net, r.pool_net, r.reference_turnover, r.turnover_source) for r in got.collect()}
    assert rows == {
        ("a", "2024-01-01"): (2.0, 4.0, 0.25, "membership"),
        ("a", "2024-01-02"): (None, 2.0, 0.0, "selected_over_candidates"),
        ("a", "2024-01-08"): (-4.0, -7.0, 1.0, "selected_over_candidates"),
        ("b", "2024-01-02"): (-5.0, 1.0, 0.25, "selected_over_candidates"),
    }
    assert {r.pool_net for r in S.with_fees(runs(spark), {}, {"pool_net": "pool"}, 8.0, round_trip=True).collect()} == {-2.0, -6.0, -7.0, -5.0}


def test_calendar_gaps_are_filled_or_an_error(spark):
    sessions = spark.createDataFrame([(f"2024-01-0{d}",) for d in (1, 2, 5, 8)], "date string")
    full = S.on_calendar(runs(spark), sessions)
    assert sorted((r.series, r.date) for r in full.collect()) == [("a", f"2024-01-0{d}") for d in (1, 2, 5, 8)] + [("b", "2024-01-02")]
    with pytest.raises(ValueError, match="2024-01-05"):
        S.require_no_gaps(runs(spark), sessions)
    assert S.require_no_gaps(runs(spark), sessions.where("date != '2024-01-05'")).count() == 4
    summed = S.cumulated(full, {"sum": "top"}, capital=0.5)
    assert [r["sum"] for r in summed.where("series = 'a'").orderBy("date").collect()] == [5.0, 5.0, 5.0, 7.0]


def test_missing_references_are_errors(spark):
    realised = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "date string, market double")
    with pytest.raises(ValueError, match="2024-01-08"):
        S.replace_reference(runs(spark), realised, "pool", "market")
    early = S.replace_reference(runs(spark).where("date < '2024-01-08'"), realised, "pool", "market")
    assert {(r.date, r.pool) for r in early.collect()} == {("2024-01-01", 1.0), ("2024-01-02", 2.0)}
    weeks = S.weekly(runs(spark), ["pool"])
    assert {(r.series, r.week_start, r.days, r.pool) for r in weeks.collect()} == {("a", "2024-01-01", 2, 8.0), ("a", "2024-01-08", 1, 1.0), ("b", "2024-01-01", 1, 3.0)}
    with pytest.raises(ValueError, match="2024-01-08"):
        S.relative_to(weeks, "b", {"rel": "pool"})
    with pytest.raises(ValueError, match="no rows"):
        S.relative_to(weeks, "c", {"rel": "pool"})
    loose = S.relative_to(weeks, "b", {"rel": "pool"}, required=False)
    assert {(r.week_start, r.rel) for r in loose.collect()} == {("2024-01-01", 5.0), ("2024-01-08", None)}


def test_runs_are_named_and_their_means_come_last(spark):
    one = spark.createDataFrame([("2024-02", 1.0), ("2024-01", 3.0)], "month string, x double")
    both = S.named_runs({"a": one, "b": one.withColumn("y", F.lit(5.0))}, ["month", "x", "y"], {"b": "Second"})
    assert {(r.series, r.series_label, r.y) for r in both.collect()} == {("a", "a", None), ("b", "Second", 5.0)}
    table = S.month_table(both, ["x"]).orderBy("place").collect()
    assert [(r.month, r.series, r.x) for r in table] == [
        ("2024-01", "a", 3.0), ("2024-01", "b", 3.0), ("2024-02", "a", 1.0), ("2024-02", "b", 1.0), ("Mean", "a", 2.0), ("Mean", "b", 2.0)
    ]


# ---- day builds


def family(name, needs, gives, stage=BD.STATES):
    return BD.column_family(name, needs, dict.fromkeys(gives, "1"), stage)


def test_families_are_ordered_by_what_they_read():
    last, middle, first, unused = family("last", ["m"], ["z"], BD.ROWS), family("middle", ["f", "raw"], ["m"]), family("first", ["raw"], ["f"]), family("unused", ["raw"], ["u"])
    assert [f.name for f in BD.resolve([last, unused, middle, first], ["raw"], ["z", "raw"])] == ["first", "middle", "last"]


@pytest.mark.parametrize(
    ("families", "wanted", "message"),
    [
        ([family("a", ["y"], ["x"]), family("b", ["x"], ["y"])], ["x"], "need each other"),
        ([family("a", ["nothing"], ["x"])], ["x"], "nothing, which a needs"),
        ([family("a", [], ["x"]), family("b", [], ["x"])], ["x"], "given twice"),
        ([family("a", [], ["raw"])], ["raw"], "given twice"),
        ([family("a", [], ["x"], BD.ROWS), family("b", ["x"], ["y"])], ["y"], "before sampling"),
        ([], ["q"], "no family gives column q"),
    ],
)
def test_wrong_family_graphs_are_errors(families, wanted, message):
    with pytest.raises(ValueError, match=message):
        BD.resolve(families, ["raw"], wanted)


# ---- score matrix


def test_score_matrix_of_best_rows(spark):
    rows = [("d1", "A", 1, 3.0), ("d1", "A", 2, None), ("d1", "B", 1, 3.0), ("d1", "C", 1, 9.0), ("d2", "A", 1, float("nan")), ("d2", "B", 3, 1.0), ("d2", "B", 2, 5.0)]
    df = spark.createDataFrame(rows, "date string, symbol string, at int, s double")
    best = E.score_rows(df, "s", "last", "at", top_n=2, negate=True)
    assert {tuple(r) for r in best.collect()} == {("d1", "C", -9.0), ("d1", "A", -3.0), ("d2", "B", -1.0)}
    assert {tuple(r) for r in E.score_matrix(best, ["A", "C", "X"]).collect()} == {("d1", -3.0, -9.0, None), ("d2", None, None, None)}
    stats = E.score_matrix_stats(E.neutral_scores(best, 0.5)).first()
    assert (stats.score_rows, stats.score_dates, stats.score_symbols, stats.first_date) == (3, 2, 3, "d1") and stats.missing_share == 0.5
    assert E.require_scored_days(df, best) is best
    with pytest.raises(ValueError, match="d2"):
        E.require_scored_days(df, best.where("date = 'd1'"))
    with pytest.raises(ValueError, match="no scores"):
        E.require_scored_days(df.where("false"), best.where("false"))


# ---- state decomposition


def test_contributions_add_up_to_the_excess(spark):
    r = random.Random(2)
    rows = [(f"d{i % 7}", i % 3, f"s{i}", r.random(), r.choice([None, r.gauss(0, 1)]), r.choice(["u", "d", "o"])) for i in range(300)]
    df = spark.createDataFrame(rows, "date string, clock int, symbol string, score double, y double, state string")
    got = B.state_decomposition(df, ["date", "clock"], "date", "score", ["y"], "state", ["u", "d", "o"], 4, ["symbol"]).first()
    assert got.contribution_sum_bps == pytest.approx(got.excess_bps)
    assert got.u_contribution_bps + got.d_contribution_bps + got.o_contribution_bps == pytest.approx(got.excess_bps)
    assert got.days == 7


# ---- additive sums


def plain_ridge(x, y, alpha):
    mean, dev = x.mean(0), x.std(0)
    dev = np.where(dev > 0, dev, 1.0)
    z = (x - mean) / dev
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return w / dev, y.mean() - (w / dev) @ mean


def test_ridge_of_many_windows_matches_numpy(spark):
    r = np.random.default_rng(4)
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 7) for d in (3, 17)]
    x = r.normal(1e6, 3.0, (240, 3))
    x[:, 2] = 7.0  # never varies
    y = x[:, 0] * 0.3 - x[:, 1] + r.normal(0, 1, 240)
    date = [days[i % len(days)] for i in range(240)]
    rows = [(d, *map(float, v), None if i % 50 == 0 else float(t)) for i, (d, v, t) in enumerate(zip(date, x, y))]
    df = spark.createDataFrame(rows, "date string, a double, b double, c double, y double").repartition(5)
    windows = [{"test_month": f"2024-{m:02d}", "train_start": f"2024-{m - 2:02d}-01", "train_end": f"2024-{m - 1:02d}-28", "test_start": f"2024-{m:02d}-01", "test_end": f"2024-{m:02d}-31"} for m in (3, 4, 5, 6)]
    windows.append({"test_month": "none", "train_start": "2030-01-01", "train_end": "2030-02-01", "test_start": "2024-01-01", "test_end": "2024-06-30"})
    scored = M.rolling_ridge(df, windows, ["a", "b", "c"], "y", 2.0)
    got = {(q.window, q.date, q.a): q.prediction for q in scored.collect()}
    at, known = np.array(date), np.array([i % 50 != 0 for i in range(240)])
    want = {}
    for w in windows[:-1]:
        train = (at >= w["train_start"]) & (at <= w["train_end"]) & known
        weights, intercept = plain_ridge(x[train], y[train], 2.0)
        for i in np.flatnonzero((at >= w["test_start"]) & (at <= w["test_end"])):
            want[(w["test_month"], date[i], x[i, 0])] = intercept + x[i] @ weights
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_quantiles_of_parts_are_those_of_the_whole(spark, small_groups):
    r = random.Random(6)
    values = [r.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1.5, r.gauss(0, 5)]) for _ in range(200)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "part int, v double")
    counts = [A.value_counts(df.where(F.col("part") == k), ["v"]) for k in range(3)]
    row = A.quantiles_of_counts(A.merged_counts(counts), {"lo": 0.1, "mid": 0.5, "hi": 0.93}).first()
    finite = np.array([v for v in values if v is not None and np.isfinite(v)])
    assert row.rows == len(finite) and row.distinct_values == len(set(finite))
    assert [row.lo, row.mid, row.hi] == pytest.approx(np.quantile(finite, [0.1, 0.5, 0.93]).tolist())


def test_hygiene_of_odd_columns_and_no_rows(spark):
    rows = [(None, 1.0, 1e9 + i, 3) if i % 2 else (float("inf"), float("nan"), 1e9 + i, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "none double, half double, large double, whole int")
    got = {r.feature: r for r in H.feature_hygiene(df, df.columns).collect()}
    assert (got["none"].missing_count, got["none"].inf_count, got["none"].finite_count, got["none"].mean, got["none"].min, got["none"].p50) == (3, 3, 0, None, None, None)
    assert (got["half"].missing_count, got["half"].unique_count, got["half"].constant, got["half"].std) == (3, 1, True, 0.0)
    assert got["large"].std == pytest.approx(np.std(np.arange(6), ddof=1)) and got["large"].p50 == 1e9 + 2.5
    assert got["whole"].top_count == 6 and got["whole"].constant
    assert H.feature_hygiene(df.where("false"), df.columns).collect() == []


def test_rank_correlation_with_missing_values_and_ties(spark, small_groups):
    r = random.Random(9)
    rows = [tuple(r.choice([None, 1.0, 2.0, r.random()]) if c == 1 else r.random() if c else r.randrange(5) * 1.0 for c in range(3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    import pandas as pd

    ranked = pd.DataFrame(rows, columns=list("abc")).astype(float).rank()
    got = {(x.feature_a, x.feature_b): x["corr"] for x in H.correlated_pairs(df, list("abc"), 0.0, "spearman", min_count=10).collect()}
    for (a, b), value in got.items():
        assert value == pytest.approx(ranked[a].corr(ranked[b]))
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
