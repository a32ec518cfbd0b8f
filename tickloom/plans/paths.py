"""Path, history and cross-section features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import cross as X
from tickloom.operators import path as P
from tickloom.operators.groups import running
from tickloom.plans.base import PANEL, TICKS, TIE, XS, query

USER, LINE = ["symbol"], ["t", "seq"]
W = "PARTITION BY symbol ORDER BY t, seq"
CUMULATIVE = f"""cum AS (SELECT symbol, t, seq, last_price, prev_close,
    sum(size) OVER ({W}) AS volume, sum(last_price * size) OVER ({W}) AS turnover FROM ticks)"""


def cumulative(t):
    flow = t.ticks.withColumn("flow", F.col("last_price") * F.col("size"))
    return running(
        flow.select("symbol", "t", "seq", "last_price", "prev_close", "size", "flow"),
        USER, LINE, {"volume": ("sum", "size"), "turnover": ("sum", "flow")},
    ).drop("size", "flow")


def over_lags(lags):
    out = []
    for n in lags:
        dv, dt = f"volume - lag(volume, {n}) OVER ({W})", f"turnover - lag(turnover, {n}) OVER ({W})"
        out.append(f"{dv} AS volume_diff_{n}t, {dt} AS turnover_diff_{n}t, ({dt}) / nullif({dv}, 0) AS trade_vwap_{n}t")
    return ", ".join(out)


@query(
    "tick_diff_vwap", "WIN-04",
    f"WITH {TICKS}, {CUMULATIVE} SELECT symbol, seq, {over_lags([1, 3, 10])} FROM cum",
    doubles=" ".join(f"volume_diff_{n}t turnover_diff_{n}t trade_vwap_{n}t" for n in (1, 3, 10)), digits=4,
)
def _(t):
    out = P.tick_differences(cumulative(t), USER, LINE, "volume", "turnover", (1, 3, 10))
    return out.drop("t", "last_price", "prev_close", "volume", "turnover")


@query(
    "momentum_returns", "WIN-05",
    f"""WITH {TICKS} SELECT symbol, seq, (last_price - prev_close) / nullif(prev_close, 0) AS return_vs_prev_close,
      {", ".join(f"last_price / nullif(lag(last_price, {n}) OVER ({W}), 0) - 1.0 AS return_{n}t" for n in (1, 3, 10, 30))}
    FROM ticks""",
    doubles="return_vs_prev_close return_1t return_3t return_10t return_30t",
)
def _(t):
    out = P.momentum(t.ticks.select("symbol", "t", "seq", "last_price", "prev_close"), USER, LINE)
    return out.drop("t", "last_price", "prev_close")


@query(
    "rolling_slope", "WIN-06",
    f"""WITH {TICKS}, n AS (SELECT symbol, seq, t, last_price, row_number() OVER ({W}) AS i FROM ticks)
    SELECT symbol, seq, CASE WHEN count(last_price) OVER f = 5 THEN regr_slope(last_price, i) OVER f END AS slope
    FROM n WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    doubles="slope",
)
def _(t):
    rows = t.ticks.select("symbol", "t", "seq", "last_price")
    return P.rolling_slope(rows, USER, LINE, "last_price", 5, "slope").select("symbol", "seq", "slope")


@query(
    "path_shape", "WIN-11",
    f"""WITH {TICKS}, m AS (SELECT symbol, t, seq, (bid_price_1 + ask_price_1) / 2.0 AS mid,
        bid_volume_1 AS bd, ask_volume_1 AS ad FROM ticks),
    s AS (SELECT *, lag(mid) OVER w AS p1, lag(mid, 2) OVER w AS p2,
        max(mid) OVER w AS high, min(mid) OVER w AS low, first(mid) OVER w AS mid0,
        bd - lag(bd) OVER w AS bc, ad - lag(ad) OVER w AS ac,
        max(mid) OVER r AS rh, min(mid) OVER r AS rl, count(mid) OVER r AS rn
      FROM m WINDOW w AS ({W}), r AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    u AS (SELECT *, CASE WHEN mid > p1 THEN 1.0 ELSE 0.0 END AS up FROM s)
    SELECT symbol, seq, (mid - high) / high * 10000 AS path_shape_mid_drawdown_from_open_high_bps,
      (mid - low) / low * 10000 AS path_shape_mid_recovery_from_open_low_bps,
      (mid - mid0) / mid0 * 10000 AS path_shape_mid_from_first_bps,
      CAST(mid >= high AS INTEGER) AS path_shape_mid_new_high_flag,
      CAST(mid <= low AS INTEGER) AS path_shape_mid_new_low_flag,
      avg(up) OVER ({W}) AS path_shape_return_positive_fraction,
      (mid - p2) / p2 * 10000 AS path_shape_mid_move_3m_bps,
      (mid - p1) / p1 * 10000 - (mid - p2) / p2 * 10000 / 2 AS path_shape_return_accel_1m_vs_3m,
      CASE WHEN rn = 3 THEN (mid - rl) / nullif(rh - rl, 0) END AS path_shape_mid_position_roll3,
      bc * up AS path_shape_bid_depth_support_after_upmove,
      -ac * up AS path_shape_ask_depth_fade_after_upmove,
      (bc - ac) * up AS path_shape_depth_support_imbalance_after_upmove FROM u""",
    doubles="""path_shape_mid_drawdown_from_open_high_bps path_shape_mid_recovery_from_open_low_bps
      path_shape_mid_from_first_bps path_shape_return_positive_fraction path_shape_mid_move_3m_bps
      path_shape_return_accel_1m_vs_3m path_shape_mid_position_roll3
      path_shape_bid_depth_support_after_upmove path_shape_ask_depth_fade_after_upmove
      path_shape_depth_support_imbalance_after_upmove""", digits=4,
)
def _(t):
    rows = t.ticks.select(
        "symbol", "t", "seq", ((F.col("bid_price_1") + F.col("ask_price_1")) / 2.0).alias("mid_price"),
        F.col("bid_volume_1").alias("bid_depth_10"), F.col("ask_volume_1").alias("ask_depth_10"),
    )
    return P.path_shape(rows, USER, LINE, windows=(3,)).drop("t", "mid_price", "bid_depth_10", "ask_depth_10")


@query(
    "same_clock_surprise", "WIN-09",
    """WITH d AS (SELECT user_id AS symbol, CAST(hour(ts) // 6 AS INTEGER) AS clock,
        strftime(ts, '%Y-%m-%d') AS date, sum(value) AS v FROM events GROUP BY ALL),
    h AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s
      FROM d WINDOW w AS (PARTITION BY symbol, clock ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT symbol, clock, date, CASE WHEN n >= 4 THEN (v - m) / nullif(s, 0) END AS hist_surprise_v_10d_zscore,
      CASE WHEN n >= 4 THEN v / nullif(m, 0) END AS hist_surprise_v_10d_ratio,
      CASE WHEN n >= 4 THEN v - m END AS hist_surprise_v_10d_diff FROM h""",
    doubles="hist_surprise_v_10d_zscore hist_surprise_v_10d_ratio hist_surprise_v_10d_diff",
)
def _(t):
    daily = t.events.groupBy(
        F.col("user_id").alias("symbol"), F.floor(F.hour("ts") / 6).cast("int").alias("clock"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
    ).agg(F.sum("value").alias("v"))
    return P.same_clock_surprise(daily, ["v"], (10,), 4, ("zscore", "ratio", "diff")).drop("v")


@query(
    "daily_activity_reference", "WIN-10",
    f"""WITH {TICKS}, d AS (SELECT symbol, date, max(last_price) AS turnover FROM ticks GROUP BY ALL),
    h AS (SELECT symbol, date, CASE WHEN count(turnover) OVER w >= 3 THEN avg(turnover) OVER w END AS r
      FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT k.symbol, k.seq, h.r AS hist_avg_daily_last_price_7d FROM ticks k JOIN h USING (symbol, date)""",
    doubles="hist_avg_daily_last_price_7d",
)
def _(t):
    rows = t.ticks.select("symbol", "date", "seq", "last_price")
    out = P.daily_activity_reference(rows, ["last_price"], (7,), 3)
    return out.select("symbol", "seq", "hist_avg_daily_last_price_7d")


@query(
    "auction_summary", "AGG-08",
    f"""WITH {TICKS}, a AS (SELECT *, (bid_price_1 + ask_price_1) / 2.0 AS q FROM ticks WHERE hour(ts) < 12)
    SELECT symbol, date, max(size) AS preopen_volume,
      coalesce(arg_max(last_price, (t, seq)) FILTER (hour(ts) >= 8), arg_max(q, (t, seq)) FILTER (hour(ts) < 8)) AS preopen_last_price,
      min(q) FILTER (hour(ts) < 8) AS preopen_price_min, max(q) FILTER (hour(ts) < 8) AS preopen_price_max
    FROM a GROUP BY symbol, date""",
    doubles="preopen_volume preopen_last_price preopen_price_min preopen_price_max",
)
def _(t):
    return P.auction_summary(
        t.ticks, ["symbol", "date"], LINE, F.hour("ts") < 12, volume="size", match=F.hour("ts") >= 8
    )


def xs_sql(expr, doubles_from="turnover"):
    return f"""WITH {PANEL} SELECT rid, turnover, {expr} FROM panel WINDOW g AS (PARTITION BY date, clock)"""


@query(
    "xs_rank_pct", "WIN-01",
    xs_sql("""(rank() OVER (PARTITION BY date, clock ORDER BY score)
        + (count(*) OVER (PARTITION BY date, clock, score) - 1) / 2.0) / count(score) OVER g AS rank_average,
      CAST(rank() OVER (PARTITION BY date, clock ORDER BY score) AS DOUBLE) AS rank_min,
      CAST(rank() OVER (PARTITION BY date, clock ORDER BY score) + count(*) OVER (PARTITION BY date, clock, score) - 1 AS DOUBLE) AS rank_max,
      CAST(dense_rank() OVER (PARTITION BY date, clock ORDER BY score) AS DOUBLE) AS rank_dense,
      CAST(row_number() OVER (PARTITION BY date, clock ORDER BY score, symbol, rid, turnover) AS DOUBLE) AS rank_first"""),
    doubles="rank_average",
)
def _(t):
    from tickloom.operators.groups import ranks

    out = ranks(
        t.panel.select(*XS, *TIE, "score"), XS, "score",
        {"rank_average": "average_pct", "rank_min": "min", "rank_max": "max", "rank_dense": "dense", "rank_first": "first"},
        unique=TIE,
    )
    return out.drop(*XS, "symbol", "score")


@query(
    "xs_rank_pct_with_missing", "WIN-01",
    f"""WITH {PANEL} SELECT rid, turnover, CASE WHEN label_short IS NOT NULL THEN
      (rank() OVER (PARTITION BY date, clock ORDER BY label_short NULLS LAST)
        + (count(*) OVER (PARTITION BY date, clock, label_short) - 1) / 2.0)
        / count(label_short) OVER (PARTITION BY date, clock) END AS share FROM panel""",
    doubles="share",
)
def _(t):
    rows = t.panel.select(*XS, "rid", "turnover", "label_short")
    return X.rank_share(rows, XS, "label_short", "share").select("rid", "turnover", "share")


@query(
    "xs_relative", "WIN-02",
    f"""WITH {PANEL}, m AS (SELECT *, median(prediction) OVER (PARTITION BY date, clock) AS md FROM panel)
    SELECT rid, turnover, prediction - avg(prediction) OVER g AS xs_rel_prediction_demean,
      (prediction - avg(prediction) OVER g) / nullif(stddev_samp(prediction) OVER g, 0) AS xs_rel_prediction_zscore,
      (prediction - md) / nullif(median(abs(prediction - md)) OVER g * 1.4826, 0) AS xs_rel_prediction_robust_zscore,
      (rank() OVER (PARTITION BY date, clock ORDER BY prediction)
        + (count(*) OVER (PARTITION BY date, clock, prediction) - 1) / 2.0) / count(*) OVER g AS xs_rel_prediction_rank_pct,
      (rank() OVER (PARTITION BY date, clock ORDER BY prediction)
        + (count(*) OVER (PARTITION BY date, clock, prediction) - 1) / 2.0) / count(*) OVER g - 0.5 AS xs_rel_prediction_rank_centered
    FROM m WINDOW g AS (PARTITION BY date, clock)""",
    doubles="xs_rel_prediction_demean xs_rel_prediction_zscore xs_rel_prediction_robust_zscore xs_rel_prediction_rank_pct xs_rel_prediction_rank_centered",
    digits=5,
)
def _(t):
    modes = ("demean", "zscore", "robust_zscore", "rank_pct", "rank_centered")
    out = X.relative(t.panel.select(*XS, "rid", "turnover", "prediction"), ["prediction"], XS, modes)
    return out.drop(*XS, "prediction")


@query(
    "xs_replace", "WIN-03",
    f"""WITH {PANEL} SELECT rid, turnover,
      CAST(CAST((prediction - avg(prediction) OVER g) / nullif(stddev_samp(prediction) OVER g, 0) AS FLOAT) AS DOUBLE) AS prediction,
      CAST(CAST((score - avg(score) OVER g) / nullif(stddev_samp(score) OVER g, 0) AS FLOAT) AS DOUBLE) AS score
    FROM panel WINDOW g AS (PARTITION BY date, clock)""",
    doubles="prediction score", digits=4,
)
def _(t):
    rows = t.panel.select(*XS, "rid", "turnover", "prediction", "score")
    return X.replace_values(rows, ["prediction", "score"], XS, "zscore").drop(*XS)


@query(
    "descending_rank_score", "WIN-14",
    f"""WITH {PANEL}, r AS (SELECT rid, turnover, row_number() OVER (PARTITION BY date, clock
        ORDER BY label_short DESC NULLS LAST, symbol, rid, turnover) AS rank,
      count(*) OVER (PARTITION BY date, clock) AS n FROM panel)
    SELECT rid, turnover, rank, CASE WHEN n > 1 THEN 1.0 - (rank - 1) / (n - 1) ELSE 1.0 END AS rank_score FROM r""",
    doubles="rank_score",
)
def _(t):
    rows = t.panel.select(*XS, *TIE, "label_short")
    return X.descending_score(rows, XS, "label_short", TIE).select("rid", "turnover", "rank", "rank_score")


@query(
    "candidate_filter", "FLT-03",
    f"""WITH {PANEL}, r AS (SELECT *, (rank() OVER (PARTITION BY date, clock ORDER BY score)
        + (count(*) OVER (PARTITION BY date, clock, score) - 1) / 2.0) / count(score) OVER (PARTITION BY date, clock) AS rp FROM panel)
    SELECT rid, turnover, coalesce(label_short >= -0.03, false) AND coalesce(volume <= 40, false)
      AND rp >= 0.2 AND rp <= 0.9 AS candidate FROM r""",
)
def _(t):
    out = X.candidate_flag(
        t.panel, XS, minimum={"label_short": -0.03}, maximum={"volume": 40},
        rank_minimum={"score": 0.2}, rank_maximum={"score": 0.9},
    )
    return out.select("rid", "turnover", "candidate")
