"""Small hand-made panels with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import clock as C
from tickloom.functions import numeric as N
from tickloom.operators import capacity as P
from tickloom.operators import cross as X
from tickloom.operators import decision as D
from tickloom.operators import evaluate as E
from tickloom.operators import exposure as EX
from tickloom.operators import features as FT
from tickloom.operators import labels as L
from tickloom.operators import mechanism as M
from tickloom.operators import path as PA
from tickloom.operators import reference as R
from tickloom.operators import targets as T

DAY = "2024-03-04"


def us(clock):
    h, m, s = clock.split(":")
    return 19786 * C.DAY_US + int((int(h) * 3600 + int(m) * 60 + float(s)) * 1e6)


@pytest.fixture(scope="module")
def states(spark):
    data = [(DAY, "A", us(c), i, float(p)) for i, (c, p) in enumerate(
        [("09:30:57", 10), ("09:31:03", 11), ("09:31:06", 12), ("09:31:12", 13), ("09:32:03", 14)])]
    return spark.createDataFrame(data, "date string, symbol string, t long, seq long, ask_price_1 double")


def test_clock_state_takes_the_last_row_at_or_before(states):
    got = {r.decision_time: r for r in D.sample_decisions(states, ["09:31:00", "09:32:00"], ["ask_price_1"]).collect()}
    assert got["09:31:00"].ask_price_1 == 10.0 and got["09:31:00"].state_age_seconds == 3.0
    assert got["09:32:00"].ask_price_1 == 13.0 and got["09:32:00"].state_age_seconds == 48.0


def test_cutoff_never_looks_ahead(states):
    got = D.sample_decisions(states, ["09:31:00", "09:32:00"], ["ask_price_1"], source_cutoff_seconds=2).collect()
    assert {r.t for r in got} == {us("09:30:57"), us("09:31:12")}
    assert all(r.t <= r.cutoff for r in got)


def test_a_state_exactly_on_the_target_is_usable(states):
    back = D.sample_decisions(states, ["09:31:03"], ["ask_price_1"]).first()
    ahead = D.sample_decisions(states, ["09:31:03"], ["ask_price_1"], alignment="next_tick").first()
    assert back.ask_price_1 == ahead.ask_price_1 == 11.0


def test_next_tick_respects_the_lag_bound(states):
    got = D.sample_decisions(states, ["09:31:00", "09:31:30"], ["ask_price_1"], alignment="next_tick", max_lag_seconds=5)
    assert [r.decision_time for r in got.collect()] == ["09:31:00"]


def test_equal_times_last_backward_first_forward(spark):
    s = spark.createDataFrame([("A", 5, 1, "x"), ("A", 5, 2, "y")], "k string, t long, seq long, v string")
    from tickloom.operators.asof import asof

    at = spark.createDataFrame([("A", 5)], "k string, at long")
    assert asof(at, s, ["k"], "at", "t", ["v"], seq=["seq"]).first().v == "y"
    assert asof(at, s, ["k"], "at", "t", ["v"], direction="forward", seq=["seq"]).first().v == "x"


def test_nth_next_delay_and_gap(spark):
    rows = [(DAY, "A", i * 3_000_000, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "date string, symbol string, t long, seq long, p double")
    got = {r.seq: r for r in D.nth_next(df, 2, ["p"], "entry").collect()}
    assert got[0].entry_delay_seconds == 6.0 and got[0].entry_max_gap_seconds == 3.0 and got[0].p_entry == 2.0
    assert got[4].p_entry is None


def test_duplicate_times_change_the_row_delay(spark):
    seconds = [0, 0, 3, 6, 66, 69]
    df = spark.createDataFrame([(DAY, "A", s * 1_000_000, i) for i, s in enumerate(seconds)], "date string, symbol string, t long, seq long")
    raw = D.nth_next(df, 2, [], "entry").where("seq = 0").first()
    clean = D.deduplicate_states(df, ["date", "symbol", "t"], ["seq"])
    kept = D.nth_next(clean, 2, [], "entry").where("t = 0").first()
    assert raw.entry_delay_seconds == 3.0 and kept.entry_delay_seconds == 6.0


def test_exact_lag_does_not_bridge_a_missing_minute(spark):
    df = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 12.0), ("A", 4, 15.0)], "k string, m long, v double")
    got = {r.m: r.v_1m for r in D.exact_lag(df, ["k"], "m", 1, ["v"], "1m").collect()}
    assert got == {1: None, 2: 10.0, 4: None}


def test_same_clock_history_uses_prior_dates_only(spark):
    df = spark.createDataFrame([("A", "c", f"2024-01-0{i}", v) for i, v in ((1, 10.0), (2, 12.0), (3, 14.0))], "symbol string, clock string, date string, v double")
    got = {r.date: r for r in PA.same_clock_surprise(df, ["v"], (2,), 2).collect()}
    assert got["2024-01-03"].hist_surprise_v_2d_zscore == pytest.approx((14 - 11) / math.sqrt(2))
    assert got["2024-01-03"].hist_surprise_v_2d_ratio == pytest.approx(14 / 11)
    assert got["2024-01-01"].hist_surprise_v_2d_ratio is None and got["2024-01-02"].hist_surprise_v_2d_ratio is None


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([("d", "A", 0.01), ("d", "B", 0.03), ("e", "A", 0.05)], "g string, symbol string, y double")


@pytest.mark.parametrize("transform, low", [("demean", -0.01), ("zscore", -1.0), ("rank_centered", -0.25)])
def test_target_transforms(labelled, transform, low):
    got = {(r.g, r.symbol): r.target for r in X.transformed_label(labelled, ["g"], "y", transform=transform).collect()}
    assert got[("d", "A")] == pytest.approx(low) and got[("d", "B")] == pytest.approx(-low)
    assert got[("e", "A")] is None


def test_features_centre_ranks_on_one_half(labelled):
    got = {(r.g, r.symbol): r.x_y_rank_centered for r in X.relative(labelled, ["y"], ["g"], ["rank_centered"], prefix="x_").collect()}
    assert got[("d", "A")] == 0.0 and got[("d", "B")] == 0.5


def test_vwap_labels_and_close(spark):
    ticks = spark.createDataFrame(
        [(DAY, "A", us("09:31:06"), 0.0, 0.0), (DAY, "A", us("09:41:06"), 100.0, 1000.0), (DAY, "A", us("09:42:06"), 200.0, 2010.0),
         (DAY, "A", us("10:31:06"), 300.0, 3030.0), (DAY, "A", us("10:32:06"), 400.0, 4050.0)],
        "date string, symbol string, t long, volume double, turnover double",
    )
    base = spark.createDataFrame([(DAY, "A", us("09:31:06"), 10.0)], "date string, symbol string, entry long, buy_price double")
    got = L.vwap_label_set(base, ticks, [600, 3600], 60, ["date", "symbol"]).first()
    assert got.label_600s == pytest.approx(0.01) and got.label_3600s == pytest.approx(0.02)
    closes = spark.createDataFrame([(DAY, "A", 10.3)], "date string, symbol string, close_price double")
    assert L.same_day_close_labels(base, closes).first().label_close == pytest.approx(0.03)


def test_reference_is_strictly_earlier_and_scaled(spark):
    ref = spark.createDataFrame([("2024-01-02", "A", 5.0), ("2024-01-03", "A", 0.0), ("2024-01-04", "A", 7.0)], "date string, symbol string, cap double")
    got = {r.date: r.cap for r in R.lagged_reference(R.calendar(ref), ref, {"cap": 10_000.0}, 1).collect()}
    assert got == {"2024-01-03": 50_000.0, "2024-01-04": None}
    with pytest.raises(ValueError):
        R.lagged_reference(R.calendar(ref), ref, {"cap": 1.0}, 0)


def test_pool_lag_changes_membership(spark):
    wide = spark.createDataFrame([("2024-01-02", True, False), ("2024-01-03", None, True)], "date string, A boolean, B boolean")
    pool = R.pool_from_matrix(wide)
    rows = spark.createDataFrame([("2024-01-03", "A"), ("2024-01-03", "B"), ("2024-01-05", "B")], "date string, symbol string")
    same = {(r.date, r.symbol): r.member for r in R.membership(rows, pool).collect()}
    lag = {(r.date, r.symbol): r.member for r in R.membership(rows, pool, 1).collect()}
    assert same == {("2024-01-03", "A"): False, ("2024-01-03", "B"): True, ("2024-01-05", "B"): False}
    assert lag == {("2024-01-03", "A"): True, ("2024-01-03", "B"): False, ("2024-01-05", "B"): False}


def test_capacity_fill(spark):
    df = spark.createDataFrame([("g", "A", 3.0, 10_000.0), ("g", "B", 2.0, 4_000.0), ("g", "C", 1.0, 2_000.0)], "g string, symbol string, prediction double, cap double")
    rule = P.Capacity(1_000.0, participation=0.1, symbol_weight=0.5, capacity="cap")
    chosen = P.greedy_fill(df, ["g"], rule, ["symbol"])
    assert {r.symbol: r.allocated_notional for r in chosen.collect()} == {"A": 500.0, "B": 400.0, "C": 100.0}
    assert P.group_fill(df, chosen, ["g"], rule).first().fill_ratio == 1.0


def test_missing_part_makes_the_limit_zero(spark):
    df = spark.createDataFrame([("g", "A", 1.0, None)], "g string, symbol string, prediction double, cap double")
    rule = P.Capacity(1_000.0, participation=0.1, capacity="cap")
    assert P.capacity_limits(df, rule).first().row_limit == 0.0


def test_correlation_of_constant_or_small_groups_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    got = {r.g: r.ic for r in E.correlations(df, ["g"], "y", "x").collect()}
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(1.0)


def test_rank_ic_averages_ties(spark):
    df = spark.createDataFrame([("g", a, b) for a, b in ((1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0))], "g string, x double, y double")
    import pandas as pd

    want = pd.Series([1.0, 1, 2, 3]).rank().corr(pd.Series([2.0, 1, 3, 3]).rank())
    assert E.rank_ic(df, ["g"], "x", {"ic": "y"}).first().ic == pytest.approx(want)


def test_newey_west_against_the_formula(spark):
    values = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 2.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "d long, v double")
    got = E.newey_west(df, "v", "d", 3).first()
    mean = sum(values) / len(values)
    x = [v - mean for v in values]
    n = len(x)
    var = sum(a * a for a in x) / n + sum(2 * (1 - k / 4) * sum(a * b for a, b in zip(x[k:], x)) / n for k in (1, 2, 3))
    assert got.mean == pytest.approx(mean) and got.se == pytest.approx(math.sqrt(var / n))


def test_score_buckets_are_not_ntile(spark):
    df = spark.createDataFrame([("g", float(i), 0.1, i) for i in range(1, 8)], "g string, s double, y double, id long")
    got = {r.bucket: r.rows for r in E.score_buckets(df, 3, "y", "s", ["g"], ["id"]).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_heat_neutral_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(f"g{i % 3}", i, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(data, "g string, id long, y double, a double, b double")
    got = {r.id: r.target for r in T.heat_neutral(df, ["g"], "y", ["a", "b"], 1.0, 2.0, "zscore").collect()}
    for g in ("g0", "g1", "g2"):
        part = [d for d in data if d[0] == g]
        y = np.array([d[2] for d in part])
        y = y - y.mean()
        x = np.array([[d[3], d[4]] for d in part])
        x = (x - x.mean(0)) / x.std(0)
        beta = np.linalg.solve(x.T @ x + 2.0 * np.eye(2), x.T @ y)
        for d, v in zip(part, y - x @ beta):
            assert got[d[1]] == pytest.approx(v, abs=1e-9)


def test_exposure_bias_of_the_top_row(spark):
    rows = [("c1", "A", 3.0, 30.0), ("c1", "B", 2.0, 20.0), ("c1", "C", 1.0, 10.0)]
    df = spark.createDataFrame(rows, "clock string, symbol string, prediction double, market_cap double")
    marked = EX.mark_selection(df, ["clock"], "prediction", 1, ["symbol"])
    got = EX.exposure_metrics(marked, ["clock"], ["market_cap"], "prediction").first()
    assert got.selected_mean == 30.0 and got.candidate_mean == 20.0 and got.selected_mean_rank == 1.0
    assert got.score_correlation == pytest.approx(1.0) and got.category == "size"


def test_multi_denominator_bounds(spark):
    df = spark.createDataFrame([("g", 1.0, 0.0)], "g string, turnover double, float_market_cap double")
    out = FT.multi_denominator_ratios(df, ["turnover"], [], [], ["turnover"], ["g"])
    row = out.first()
    assert row["multi_den_ratio_turnover_to_float_market_cap"] is None and row["multi_den_ratio_turnover_to_xs_median"] == 1.0
    with pytest.raises(ValueError):
        FT.multi_denominator_ratios(df, ["turnover"], [], [], ["turnover"], ["g"], most=1)


def test_column_kinds():
    assert M.kinds_of("ask_volume_3") == {"level"} and M.kinds_of("postopen_v2_bid_depth_3") == {"depth"}
    assert "price_move" in M.kinds_of("postopen_mid_price_diff_1m") and "unitless" in M.kinds_of("spread_bps")
    assert M.changed_columns(["spread_bps", "ask_price_1", "volume_diff_1t", "hist_surprise_x_20d_ratio"]) == ["ask_price_1", "volume_diff_1t"]


def test_reference_price_falls_back_to_the_first_positive_column(spark):
    df = spark.createDataFrame([(0.0, 5.0, 10.0)], "ask_price_1 double, mid_price double, trade_vwap_1t double")
    assert M.mechanism_values(df, ["trade_vwap_1t"], 3).first().trade_vwap_1t == pytest.approx(10_000.0)


def test_month_and_half_year_rollups(spark):
    data = [("p", "2024-01-10", 2.0), ("p", "2024-01-20", 4.0), ("p", "2024-02-10", -1.0), ("p", "2024-08-01", 5.0)]
    df = spark.createDataFrame(data, "pool string, date string, e double")
    got = {(r.grain, r.period): r for r in E.period_rollups(df, "date", ["e"], ["e"], ["pool"]).collect()}
    assert got[("month", "2024-01")].e == 3.0 and got[("half", "2024H1")].months == 2
    assert got[("half", "2024H1")].e_positive_months == 1 and got[("year", "2024")].groups == 4


def test_clock_and_horizon_parsing():
    assert C.minute_grid("09:30", "09:32") == ["09:30:00", "09:31:00", "09:32:00"]
    assert C.parse_clocks("09:30..09:31, 10:00") == ["09:30:00", "09:31:00", "10:00:00"]
    assert C.horizon_seconds("2m") == 120 and C.horizon_seconds("close") is None and C.horizon_column("5m") == "alpha_return_5m"
    for bad in ("0s", "5x", ""):
        with pytest.raises(ValueError):
            C.horizon_seconds(bad)
    with pytest.raises(ValueError):
        C.minute_grid("10:00", "09:00")


def test_micros_ignore_the_session_time_zone(spark):
    sql = "select timestamp_ntz'2024-03-10 02:30:00.000001' as ts"
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 does not exist in New York on that day
        named = [C.micros("ts").alias("m"), C.offset_us("ts").alias("o"), C.clock("ts").alias("c"), C.day("ts").alias("d")]
        got = spark.sql(sql).select(*named, C.monday("ts").alias("w"), C.month("ts").alias("n")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (got.c, got.d, got.w, got.n) == ("02:30:00", "2024-03-10", "2024-03-04", "2024-03")
    assert got.o == 9_000_000_001 and got.m == 19792 * C.DAY_US + 9_000_000_001


def test_missing_aware_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (float("nan"), 2.0, 3.0), (float("inf"), None, None)], "a double, b double, c double")
    got = df.select(
        N.finite("a").alias("f"), N.safe_div("b", "b").alias("d"), N.sum_present(["b", "c"]).alias("s"), N.mean_present(["b", "c"]).alias("m")
    ).collect()
    assert [r.f for r in got] == [1.0, None, None] and [r.d for r in got] == [None, 1.0, None]
    assert [r.s for r in got] == [0.0, 5.0, None] and [r.m for r in got] == [0.0, 2.5, None]
    assert df.select(N.half_up_cents(F.lit(1.005)).alias("x")).first().x == 1.01


def test_exposure_categories():
    got = [EX.category_of(c) for c in ("spread_bps", "depth_imbalance_10", "my_turnover", "sector_code", "trade_num", "realised_vol", "foo")]
    assert got == ["liquidity", "microstructure", "liquidity", "industry", "activity", "volatility", "custom"]


def test_default_rules_use_the_columns_that_exist(spark):
    df = spark.createDataFrame([("A", 0.5, 12.0)], "symbol string, return_30t double, spread_bps double")
    got = {r.rule: r.prediction for r in E.rule_scores(df, ["symbol"]).collect()}
    assert got == {"open_momentum_30t": 0.5, "tight_spread": -12.0}
