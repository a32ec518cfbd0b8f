"""Score evaluation, period reports and aggregate summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import clock as C
from tickloom.operators import evaluate as E
from tickloom.operators import summaries as A
from tickloom.plans.base import PANEL, TICKS, TIE, XS, query

CORR = "CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-18 AND count({a}) >= {n} THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def corr(a, b, n=2):
    return CORR.format(a=a, b=b, n=n)


def rank_over(c, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


PLACE = "row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover)"
FULL = f"""full_rows AS (SELECT *, {PLACE} AS place, {rank_over('prediction', 'date, clock')} AS rs,
    {rank_over('label_short', 'date, clock')} AS r1, {rank_over('label_next_close', 'date, clock')} AS r2
  FROM panel WHERE label_short IS NOT NULL AND label_next_close IS NOT NULL)"""
REPORT = f"""report AS (SELECT date, clock, count(*) AS n, {corr('rs', 'r1')} AS short_rank_ic,
    avg(CASE WHEN place <= 3 THEN label_short END) AS short_top_mean, avg(label_short) AS short_all_mean,
    (avg(CASE WHEN place <= 3 THEN label_short END) - avg(label_short)) * 10000 AS short_excess_bps,
    {corr('rs', 'r2')} AS next_rank_ic, avg(CASE WHEN place <= 3 THEN label_next_close END) AS next_top_mean,
    avg(label_next_close) AS next_all_mean,
    (avg(CASE WHEN place <= 3 THEN label_next_close END) - avg(label_next_close)) * 10000 AS next_excess_bps
  FROM full_rows GROUP BY date, clock)"""
EXCESS = ["short_excess_bps", "next_excess_bps"]
METRICS = [*EXCESS, "short_rank_ic", "next_rank_ic"]


def report(t):
    rows = t.panel.select(*XS, *TIE, "prediction", "label_short", "label_next_close")
    return E.pool_report(rows, XS, "prediction", {"short": "label_short", "next": "label_next_close"}, 3, TIE)


@query(
    "pool_internal_eval", "EVAL-06 EVAL-09",
    f"WITH {PANEL}, {FULL}, {REPORT} SELECT * FROM report",
    doubles="short_rank_ic short_top_mean short_all_mean short_excess_bps next_rank_ic next_top_mean next_all_mean next_excess_bps", digits=5,
)
def _(t):
    return report(t)


@query(
    "rank_ic_by_group", "EVAL-01 EVAL-02",
    f"""WITH {PANEL}, r AS (SELECT *, {rank_over('label_short', 'date, clock')} AS r1, {rank_over('prediction', 'date, clock')} AS rs FROM panel WHERE label_short IS NOT NULL)
    SELECT date, clock, count(*) AS rows, {corr('label_short', 'prediction')} AS ic, {corr('r1', 'rs')} AS rank_ic, avg(label_short) AS mean_label,
      avg(CAST(label_short > 0 AS DOUBLE)) AS win_rate FROM r GROUP BY date, clock""",
    doubles="ic rank_ic mean_label win_rate",
)
def _(t):
    rows = t.panel.select(*XS, "label_short", "prediction")
    return E.correlations(rows, XS, "label_short", "prediction")


def spread_sql(name, source):
    parts = [f"count(*) AS {name}_groups"]
    for m in ("ic", "rank_ic"):
        parts += [f"avg({m}) AS {name}_{m}_mean", f"stddev_samp({m}) AS {name}_{m}_std", f"avg({m}) / stddev_samp({m}) AS {name}_{m}_ir"]
    return f"(SELECT {', '.join(parts)} FROM {source})"


@query(
    "prediction_metrics", "EVAL-02",
    f"""WITH {PANEL}, v AS (SELECT * FROM panel WHERE label_short IS NOT NULL),
    r AS (SELECT *, {rank_over('label_short', 'date, clock')} AS g1, {rank_over('prediction', 'date, clock')} AS gs,
      {rank_over('label_short', 'date')} AS d1, {rank_over('prediction', 'date')} AS ds,
      rank() OVER (ORDER BY label_short) + (count(*) OVER (PARTITION BY label_short) - 1) / 2.0 AS a1,
      rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS as_ FROM v),
    g AS (SELECT {corr('label_short', 'prediction')} AS ic, {corr('g1', 'gs')} AS rank_ic FROM r GROUP BY date, clock),
    d AS (SELECT {corr('label_short', 'prediction')} AS ic, {corr('d1', 'ds')} AS rank_ic FROM r GROUP BY date)
    SELECT * FROM (SELECT count(*) AS rows, {corr('label_short', 'prediction')} AS overall_ic, {corr('a1', 'as_')} AS overall_rank_ic, avg(label_short) AS mean_label,
      avg(CAST(label_short > 0 AS DOUBLE)) AS win_rate, count(DISTINCT date) AS dates, count(DISTINCT symbol) AS symbols FROM r), {spread_sql('group', 'g')}, {spread_sql('daily', 'd')}""",
    doubles="overall_ic overall_rank_ic mean_label win_rate group_ic_mean group_ic_std group_ic_ir group_rank_ic_mean group_rank_ic_std group_rank_ic_ir daily_ic_mean daily_ic_std daily_ic_ir daily_rank_ic_mean daily_rank_ic_std daily_rank_ic_ir",
)
def _(t):
    rows = t.panel.select(*XS, "symbol", "label_short", "prediction")
    return E.prediction_metrics(rows, "label_short", "prediction", ["date"], XS, "symbol")


@query(
    "score_buckets", "EVAL-03",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date, clock ORDER BY prediction, symbol, rid, turnover) AS i,
      count(*) OVER (PARTITION BY date, clock) AS n FROM panel WHERE label_short IS NOT NULL),
    b AS (SELECT *, CAST(greatest(1, least(5, ceil(CAST(i AS DOUBLE) / n * 5))) AS INTEGER) AS bucket FROM p)
    SELECT bucket, count(*) AS rows, avg(label_short) AS mean_label, median(label_short) AS median_label, avg(CAST(label_short > 0 AS DOUBLE)) AS win_rate FROM b GROUP BY bucket""",
    doubles="mean_label median_label win_rate",
)
def _(t):
    return E.score_buckets(t.panel.select(*XS, *TIE, "prediction", "label_short"), 5, "label_short", "prediction", XS, TIE)


@query(
    "topk_per_group", "TOP-01",
    f"""WITH {PANEL} SELECT rid, turnover, CAST({PLACE} AS INTEGER) AS rank FROM panel WHERE label_short IS NOT NULL
    QUALIFY {PLACE} <= 3""",
    doubles="turnover",
)
def _(t):
    out = E.top_scores(t.panel, 3, "label_short", "prediction", XS, TIE)
    return out.select("rid", "turnover", "rank")


@query(
    "bottomk_per_group", "TOP-02",
    f"""WITH {PANEL} SELECT rid, turnover, CAST(row_number() OVER w AS INTEGER) AS rank FROM panel WHERE label_short IS NOT NULL
    QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY date, clock ORDER BY prediction, symbol, rid, turnover)""".replace(
        "QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY date, clock ORDER BY prediction, symbol, rid, turnover)",
        "WINDOW w AS (PARTITION BY date, clock ORDER BY prediction, symbol, rid, turnover) QUALIFY row_number() OVER w <= 3"),
    doubles="turnover",
)
def _(t):
    out = E.top_scores(t.panel, 3, "label_short", "prediction", XS, TIE, bottom=True)
    return out.select("rid", "turnover", "rank")


@query(
    "global_top_rows", "TOP-01",
    f"""WITH {PANEL} SELECT rid, turnover, CAST(row_number() OVER (ORDER BY prediction DESC, symbol, rid, turnover) AS INTEGER) AS rank
    FROM panel WHERE label_short IS NOT NULL ORDER BY rank LIMIT 50""",
    doubles="turnover",
)
def _(t):
    return E.top_scores(t.panel, 50, "label_short", "prediction", [], TIE).select("rid", "turnover", "rank")


@query(
    "trade_summary", "AGG-02",
    f"""WITH {PANEL}, x AS (SELECT * FROM panel WHERE label_short IS NOT NULL QUALIFY {PLACE} <= 3)
    SELECT clock, count(*) AS trades, count(DISTINCT (date, clock)) AS groups, avg(label_short) AS mean_return, median(label_short) AS median_return,
      avg(CAST(label_short > 0 AS DOUBLE)) AS win_rate, stddev_samp(label_short) AS return_std FROM x GROUP BY clock""",
    doubles="mean_return median_return win_rate return_std",
)
def _(t):
    top = E.top_scores(t.panel, 3, "label_short", "prediction", XS, TIE)
    return E.trade_summary(top, "label_short", XS, ["clock"])


@query(
    "prediction_r2", "EVAL-04",
    f"""WITH {PANEL} SELECT clock, count(*) AS rows, 1 - sum(power(label_short - score / 2, 2)) / (var_pop(label_short) * count(*)) AS r2
    FROM panel WHERE label_short IS NOT NULL GROUP BY clock""",
    doubles="r2",
)
def _(t):
    rows = t.panel.withColumn("half", F.col("score") / 2)
    return E.r_squared(rows, "label_short", "half", ["clock"])


@query(
    "period_rollups", "EVAL-07",
    f"""WITH {PANEL}, {FULL}, {REPORT}, p AS (SELECT *, strftime(CAST(date AS DATE), '%Y-%m') AS m, CAST(date AS DATE) AS d FROM report),
    e AS (SELECT *, 'month' AS grain, m AS period FROM p UNION ALL SELECT *, 'quarter', year(d) || 'Q' || quarter(d) FROM p
      UNION ALL SELECT *, 'half', year(d) || CASE WHEN month(d) <= 6 THEN 'H1' ELSE 'H2' END FROM p UNION ALL SELECT *, 'year', CAST(year(d) AS VARCHAR) FROM p),
    mm AS (SELECT grain, period, m, avg(short_excess_bps) AS a, avg(next_excess_bps) AS b FROM e GROUP BY ALL),
    mp AS (SELECT grain, period, count(*) AS months, count_if(a > 1e-9) AS short_excess_bps_positive_months, count_if(b > 1e-9) AS next_excess_bps_positive_months FROM mm GROUP BY ALL),
    x AS (SELECT grain, period, count(*) AS groups, avg(short_excess_bps) AS short_excess_bps, avg(next_excess_bps) AS next_excess_bps,
      avg(short_rank_ic) AS short_rank_ic, avg(next_rank_ic) AS next_rank_ic FROM e GROUP BY ALL)
    SELECT * FROM x JOIN mp USING (grain, period)""",
    doubles="short_excess_bps next_excess_bps short_rank_ic next_rank_ic", digits=5,
)
def _(t):
    return E.period_rollups(report(t), "date", METRICS, EXCESS)


WEEKLY = f"""daily AS (SELECT 'all' AS pool, date, count(*) AS decision_groups, count(DISTINCT clock) AS clocks,
    avg(short_excess_bps) AS short_excess_bps, avg(next_excess_bps) AS next_excess_bps,
    strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week_start FROM report GROUP BY date),
  weekly AS (SELECT pool, week_start, min(date) AS week_start_date, max(date) AS week_end_date, count(DISTINCT date) AS trading_days,
    CAST(sum(decision_groups) AS BIGINT) AS decision_groups, avg(short_excess_bps) AS short_excess_bps, avg(next_excess_bps) AS next_excess_bps FROM daily GROUP BY ALL),
  rolled AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN first(week_start) OVER w END AS rolling_4w_start_week,
    CASE WHEN count(*) OVER w >= 3 THEN count(*) OVER w END AS rolling_4w_weeks,
    CASE WHEN count(*) OVER w >= 3 THEN CAST(sum(trading_days) OVER w AS BIGINT) END AS rolling_4w_trading_days,
    CASE WHEN count(*) OVER w >= 3 THEN sum(short_excess_bps * trading_days) OVER w / sum(trading_days) OVER w END AS short_excess_bps_rolling_4w,
    CASE WHEN count(*) OVER w >= 3 THEN sum(next_excess_bps * trading_days) OVER w / sum(trading_days) OVER w END AS next_excess_bps_rolling_4w,
    first(week_start_date) OVER w AS first_date, string_agg(printf('%.3f', short_excess_bps), ';') OVER w AS texts
    FROM weekly WINDOW w AS (PARTITION BY pool ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def weekly(t):
    groups = report(t).withColumn("pool", F.lit("all"))
    daily = E.daily_summary(groups, EXCESS, "clock")
    return E.rolling_weeks(E.weekly_summary(daily, EXCESS), EXCESS, 4, 3)


@query(
    "weekly_rolling_weighted", "EVAL-08 WIN-12",
    f"WITH {PANEL}, {FULL}, {REPORT}, {WEEKLY} SELECT * EXCLUDE (first_date, texts) FROM rolled",
    doubles="short_excess_bps next_excess_bps short_excess_bps_rolling_4w next_excess_bps_rolling_4w", digits=5,
)
def _(t):
    return weekly(t)


def overall_sql(c):
    r = f"{c}_rolling_4w"
    return f"""sum({c} * trading_days) / sum(trading_days) AS {c}, count_if({c} > 1e-9) AS {c}_positive_weeks, avg(CAST({c} > 1e-9 AS DOUBLE)) AS {c}_positive_week_ratio,
      min({c}) AS {c}_worst_week, count({r}) AS {c}_windows, avg(CAST({r} > 1e-9 AS DOUBLE)) AS {c}_positive_window_ratio, min({r}) AS {c}_worst_window"""


@query(
    "weekly_overall", "EVAL-08",
    f"""WITH {PANEL}, {FULL}, {REPORT}, {WEEKLY} SELECT pool, count(*) AS weeks, CAST(sum(trading_days) AS BIGINT) AS trading_days,
      {overall_sql('short_excess_bps')}, {overall_sql('next_excess_bps')} FROM rolled GROUP BY pool""",
    doubles=" ".join(f"{c} {c}_positive_week_ratio {c}_worst_week {c}_positive_window_ratio {c}_worst_window" for c in EXCESS), digits=5,
)
def _(t):
    return E.overall_summary(weekly(t), EXCESS, 4)


@query(
    "worst_windows", "TOP-04",
    f"""WITH {PANEL}, {FULL}, {REPORT}, {WEEKLY}, l AS (
      SELECT pool, 'single_week' AS window_type, short_excess_bps AS value_bps, week_start AS start_week, week_start_date AS start_date, CAST(1 AS BIGINT) AS weeks,
        trading_days AS days, week_start AS end_week, week_end_date AS end_date FROM rolled
      UNION ALL SELECT pool, '4w_rolling', short_excess_bps_rolling_4w, rolling_4w_start_week, first_date, rolling_4w_weeks, rolling_4w_trading_days, week_start, week_end_date FROM rolled)
    SELECT *, CAST(row_number() OVER (PARTITION BY pool, window_type ORDER BY value_bps, end_week) AS INTEGER) AS rank FROM l WHERE value_bps IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY pool, window_type ORDER BY value_bps, end_week) <= 5""",
    doubles="value_bps", digits=5,
)
def _(t):
    return E.worst_windows(weekly(t), "short_excess_bps", 4, 5).drop("weekly_values")


HAC = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum((v - m) * (l{k} - m)) / count(*), 0)" for k in range(1, 6))


@query(
    "hac_mean_se", "EVAL-12",
    f"""WITH s AS (SELECT o_orderstatus AS st, o_orderdate AS d, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY ALL),
    x AS (SELECT *, avg(v) OVER (PARTITION BY st) AS m, {", ".join(f"lag(v, {k}) OVER (PARTITION BY st ORDER BY d) AS l{k}" for k in range(1, 6))} FROM s)
    SELECT st, count(*) AS n, avg(v) AS mean, sqrt(greatest(var_pop(v) + {HAC}, 0) / count(*)) AS se FROM x GROUP BY st""",
    doubles="mean se",
)
def _(t):
    series = t.orders.groupBy(F.col("o_orderstatus").alias("st"), F.col("o_orderdate").alias("d")).agg(
        (F.sum("o_totalprice") / 1e6).alias("v")
    )
    return E.newey_west(series, "v", "d", 5, ["st"])


def horizon_sql():
    parts = []
    for h in ("label_short", "label_next_close"):
        parts.append(f"""SELECT '{h}' AS horizon, date, clock, symbol, rid, turnover, prediction, {h} AS label FROM panel WHERE {h} IS NOT NULL""")
    cell = "horizon, date, clock"
    return f"""long AS ({' UNION ALL '.join(parts)}),
      p AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY prediction DESC, symbol, rid, turnover) AS hi,
        row_number() OVER (PARTITION BY {cell} ORDER BY prediction, symbol, rid, turnover) AS lo,
        {rank_over('prediction', cell)} AS rs, {rank_over('label', cell)} AS rl FROM long),
      g AS (SELECT horizon, date, clock, count(*) AS n, {corr('rs', 'rl', 3)} AS ic, avg(CASE WHEN hi <= 3 THEN label END) AS tm FROM p GROUP BY ALL),
      gs AS (SELECT horizon, count(*) AS groups, stddev_samp(tm) / sqrt(count(*)) * 10000 AS top_sem_bps, avg(ic) AS rank_ic_mean, stddev_samp(ic) AS rank_ic_std,
        count(ic) AS rank_ic_groups FROM g GROUP BY horizon),
      t AS (SELECT horizon, count(*) AS rows, count_if(hi <= 3) AS top_trades, avg(CASE WHEN hi <= 3 THEN label END) * 10000 AS top_mean_bps,
        avg(CASE WHEN hi <= 3 THEN CAST(label > 0 AS DOUBLE) END) AS top_win_rate, avg(label) * 10000 AS all_mean_bps,
        avg(CASE WHEN lo <= 3 THEN label END) * 10000 AS bottom_mean_bps, quantile_cont(label, 0.5) FILTER (hi <= 3) * 10000 AS top_median_bps FROM p GROUP BY horizon)"""


@query(
    "horizon_summary", "EVAL-05",
    f"""WITH {PANEL}, {horizon_sql()} SELECT *, top_mean_bps - bottom_mean_bps AS spread_bps,
      top_mean_bps / (SELECT top_mean_bps FROM t WHERE horizon = 'label_short') AS retention_vs_first FROM t JOIN gs USING (horizon)""",
    doubles="top_mean_bps top_median_bps top_sem_bps top_win_rate all_mean_bps bottom_mean_bps spread_bps rank_ic_mean rank_ic_std retention_vs_first", digits=5,
)
def _(t):
    return E.horizon_summary(t.panel, ["label_short", "label_next_close"], "prediction", 3, XS, TIE)


@query(
    "group_selection_stats", "EVAL-09 AGG-15",
    f"""WITH {PANEL} SELECT date, clock, count(*) AS rows, count_if(volume > 30) AS selected_rows, avg(label_short) * 10000 AS short_all_mean_bps,
      avg(label_short) FILTER (volume > 30) * 10000 AS short_top_mean_bps, (avg(label_short) FILTER (volume > 30) - avg(label_short)) * 10000 AS short_top_excess_bps,
      avg(CAST(label_short > 0 AS DOUBLE)) FILTER (volume > 30) AS short_top_win_rate FROM panel GROUP BY date, clock""",
    doubles="short_all_mean_bps short_top_mean_bps short_top_excess_bps short_top_win_rate", digits=5,
)
def _(t):
    return E.group_selection(t.panel, XS, F.col("volume") > 30, {"short": "label_short"})


@query(
    "minute_summary", "EVAL-10",
    f"""WITH {PANEL}, r AS (SELECT *, {PLACE} AS place, {rank_over('prediction', 'date, clock')} AS rs, {rank_over('label_short', 'date, clock')} AS r1 FROM panel WHERE label_short IS NOT NULL),
    g AS (SELECT date, clock, {corr('rs', 'r1')} AS ic, avg(CASE WHEN place <= 3 THEN label_short END) AS tm FROM r GROUP BY ALL)
    SELECT clock, count(*) AS days, avg(ic) AS rank_ic_mean, avg(CAST(ic > 1e-9 AS DOUBLE)) AS rank_ic_positive_rate, avg(tm) * 10000 AS top_mean_bps,
      avg(CAST(tm > 0 AS DOUBLE)) AS top_positive_rate, stddev_samp(tm) / sqrt(count(tm)) * 10000 AS top_sem_bps FROM g GROUP BY clock""",
    doubles="rank_ic_mean rank_ic_positive_rate top_mean_bps top_positive_rate top_sem_bps", digits=5,
)
def _(t):
    rows = t.panel.select(*XS, *TIE, "prediction", "label_short")
    return E.minute_summary(rows, "label_short", "prediction", 3, "date", "clock", TIE)


@query(
    "rule_scores", "EVAL-11",
    f"""WITH {PANEL} SELECT rid, turnover, 'turnover' AS rule, turnover AS prediction FROM panel UNION ALL SELECT rid, turnover, 'volume', volume FROM panel
    UNION ALL SELECT rid, turnover, 'cheap', -price FROM panel""",
    doubles="turnover prediction",
)
def _(t):
    rules = {"turnover": F.col("turnover"), "volume": F.col("volume"), "cheap": -F.col("price")}
    return E.rule_scores(t.panel, ["rid", "turnover"], rules)


@query(
    "cumulative_return_series", "WIN-13 EVAL-19",
    """WITH s AS (SELECT o_orderstatus AS st, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN count(*) > 1 THEN sum(o_totalprice) / 1e6 END AS v FROM orders GROUP BY ALL)
    SELECT st, d, v, sum(coalesce(v, 0)) OVER (PARTITION BY st ORDER BY d) AS cumulative_bps FROM s""",
    doubles="v cumulative_bps", digits=5,
)
def _(t):
    series = t.orders.groupBy(F.col("o_orderstatus").alias("st"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).agg(
        F.when(F.count(F.lit(1)) > 1, F.sum("o_totalprice") / 1e6).alias("v")
    )
    return E.cumulative_bps(series, "v", "d", ["st"])


@query(
    "aligned_series", "EVAL-22 EVAL-19",
    """WITH s AS (SELECT o_orderstatus AS st, strftime(o_orderdate, '%Y-%m-%d') AS d, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY ALL),
    j AS (SELECT a.d, a.v AS left_value, b.v AS right_value, a.v - b.v AS difference FROM (SELECT d, sum(v) AS v FROM s GROUP BY d) a JOIN s b ON a.d = b.d AND b.st = 'O')
    SELECT *, sum(difference) OVER (ORDER BY d) AS cumulative_difference FROM j""",
    doubles="left_value right_value difference cumulative_difference", digits=5,
)
def _(t):
    series = t.orders.groupBy(F.col("o_orderstatus").alias("st"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).agg(
        (F.sum("o_totalprice") / 1e6).alias("v")
    )
    return E.align_series(series.groupBy("d").agg(F.sum("v").alias("v")), series.where("st = 'O'"), "d", "v")


@query(
    "daily_symbol_score", "EVAL-20",
    f"""WITH {PANEL} SELECT date, symbol, arg_max(prediction, (clock, rid, turnover)) AS score FROM panel GROUP BY date, symbol""",
    doubles="score",
)
def _(t):
    rows = t.panel.withColumn("at", F.struct("clock", "rid", "turnover"))
    return E.daily_symbol_score(rows, "prediction", "last", "at")


SCORES = """da AS (SELECT date, symbol, arg_max(prediction, (clock, rid, turnover)) AS score FROM panel WHERE score > 0.02 GROUP BY date, symbol),
  sr AS (SELECT date, symbol, -score AS score FROM da QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) <= 5)"""
MATRIX = ["S000001", "S000002", "S000003", "S000010", "none"]


def scored(t):
    rows = t.panel.where("score > 0.02").withColumn("at", F.struct("clock", "rid", "turnover"))
    return rows, E.score_rows(rows, "prediction", "last", "at", top_n=5, negate=True)


@query("score_rows", "EVAL-20", f"WITH {PANEL}, {SCORES} SELECT date, symbol, score FROM sr", doubles="score", digits=4)
def _(t):
    return E.require_scored_days(*scored(t))


@query(
    "score_matrix", "EVAL-20",
    f"""WITH {PANEL}, {SCORES} SELECT date, {', '.join(f"max(score) FILTER (symbol = '{m}') AS {m}" for m in MATRIX)} FROM sr GROUP BY date""",
    doubles=" ".join(MATRIX), digits=4,
)
def _(t):
    return E.score_matrix(scored(t)[1], MATRIX)


@query(
    "score_matrix_stats", "EVAL-20",
    f"""WITH {PANEL}, {SCORES}, s AS (SELECT count(*) AS score_rows, count(DISTINCT date) AS score_dates, count(DISTINCT symbol) AS score_symbols, min(date) AS first_date, max(date) AS last_date,
      1 - count(*) / (count(DISTINCT date) * count(DISTINCT symbol)) AS missing_share, sum(score) AS total, count(*) * 0.5 AS neutral FROM sr)
    SELECT * EXCLUDE (total, neutral), 'scores' AS variant, total FROM s UNION ALL SELECT * EXCLUDE (total, neutral), 'neutral', neutral FROM s""",
    doubles="missing_share total", digits=4,
)
def _(t):
    rows = scored(t)[1]
    variants = {"scores": rows, "neutral": E.neutral_scores(rows, 0.5)}
    made = [E.score_matrix_stats(r).crossJoin(r.agg(F.sum("score").alias("total"))).withColumn("variant", F.lit(k)) for k, r in variants.items()]
    return made[0].unionByName(made[1])


@query(
    "shuffled_features", "EVAL-21",
    f"""WITH {PANEL}, a AS (SELECT date, clock, rid, turnover, row_number() OVER (PARTITION BY date, clock ORDER BY symbol, rid, turnover) AS k FROM panel),
    b AS (SELECT date, clock, volume, score, row_number() OVER (PARTITION BY date, clock ORDER BY md5('11|' || symbol || '|' || rid || '|' || turnover), symbol, rid, turnover) AS k FROM panel)
    SELECT date, clock, rid, turnover, volume, score FROM a JOIN b USING (date, clock, k)""",
    doubles="turnover volume score",
)
def _(t):
    rows = t.panel.select(*XS, *TIE, "volume", "score")
    return E.shuffle_within_groups(rows, ["volume", "score"], XS, TIE, 11).drop("symbol")


@query(
    "dataset_summary", "AGG-01",
    f"""WITH {PANEL} SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, count(DISTINCT symbol) AS symbols,
      min(clock) AS first_clock, max(clock) AS last_clock, count(label_short) AS labels, avg(CAST(label_short IS NULL AS DOUBLE)) AS label_null_rate FROM panel""",
    doubles="label_null_rate",
)
def _(t):
    return A.dataset_summary(t.panel, "label_short")


@query(
    "source_health", "AGG-03",
    f"""WITH {TICKS} SELECT date, count(*) AS rows, count(DISTINCT symbol) AS symbols, count_if(status <> 'error') AS tradable_rows,
      count_if(ask_price_1 > 0) AS ask_rows, count_if(bid_price_1 - 1 > 0) AS bid_rows, count_if(ask_price_1 > 0 AND bid_price_1 - 1 > 0 AND bid_price_1 - 1 >= ask_price_1) AS crossed_rows
    FROM ticks GROUP BY date""",
)
def _(t):
    rows = t.ticks.withColumn("bid", F.col("bid_price_1") - 1)
    return A.source_health(rows, ["date"], F.col("status") != "error", "ask_price_1", "bid")


@query(
    "largest_symbols", "AGG-03",
    f"WITH {TICKS} SELECT symbol, count(*) AS rows FROM ticks GROUP BY symbol ORDER BY rows DESC, symbol LIMIT 20",
)
def _(t):
    return A.largest_groups(t.ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), "rows", ["symbol"], 20)


@query(
    "label_distribution_by_fee", "AGG-04",
    f"""WITH {PANEL}, f AS (SELECT *, label_short - fee / 10000 AS v FROM panel, (VALUES (CAST(0 AS DOUBLE)), (CAST(8 AS DOUBLE))) x(fee))
    SELECT substr(date, 1, 4) AS year, clock, fee AS fee_bps, count(*) AS rows, count(v) AS valid_rows, count(v) / count(*) AS valid_ratio, avg(v) AS mean, stddev_samp(v) AS std,
      min(v) AS min, max(v) AS max, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95,
      quantile_cont(v, 0.99) AS p99, avg(CAST(volume <= 1 AS DOUBLE)) AS thin_rate FROM f GROUP BY ALL""",
    doubles="fee_bps valid_ratio mean std min max p01 p05 p50 p95 p99 thin_rate",
)
def _(t):
    rows = t.panel.withColumn("year", F.substring("date", 1, 4))
    return A.label_distribution(rows, "label_short", [0.0, 8.0], ["year", "clock"], checks={"thin": F.col("volume") <= 1})


@query(
    "target_summary", "AGG-05",
    f"""WITH {PANEL} SELECT count(*) AS rows, count_if(label_short IS NOT NULL) AS valid_rows, count(DISTINCT CASE WHEN label_short IS NOT NULL THEN (date, clock) END) AS groups,
      avg(label_next_close) AS target_mean, stddev_pop(label_next_close) AS target_std, avg(label_short) AS raw_mean, stddev_pop(label_short) AS raw_std FROM panel""",
    doubles="target_mean target_std raw_mean raw_std",
)
def _(t):
    return A.target_summary(t.panel, "label_next_close", "label_short", F.col("label_short").isNotNull(), XS)


@query(
    "concentration_hhi", "AGG-06",
    f"""WITH {PANEL}, s AS (SELECT date, symbol, sum(turnover) AS w FROM panel GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, symbol) AS p FROM s)
    SELECT date, count(*) AS symbol_unique, max(w) / sum(w) AS symbol_max_share, sum(CASE WHEN p <= 5 THEN w END) / sum(w) AS symbol_top5_share,
      sum(w * w) / (sum(w) * sum(w)) AS symbol_hhi, sum(w) * sum(w) / sum(w * w) AS symbol_effective FROM r GROUP BY date""",
    doubles="symbol_max_share symbol_top5_share symbol_hhi symbol_effective",
)
def _(t):
    return A.concentration(t.panel, ["date"], "symbol", F.col("turnover"), "symbol_")


@query(
    "weighted_means", "AGG-07",
    f"""WITH {PANEL} SELECT date, sum(label_short * (volume - 10)) FILTER (volume > 10 AND label_short IS NOT NULL) / sum(volume - 10) FILTER (volume > 10 AND label_short IS NOT NULL) AS mean
    FROM panel GROUP BY date""",
    doubles="mean",
)
def _(t):
    from tickloom.functions.numeric import weighted_mean

    return t.panel.groupBy("date").agg(weighted_mean("label_short", F.col("volume") - 10).alias("mean"))


@query(
    "yearly_window_metrics", "AGG-09",
    f"""WITH {PANEL}, m AS (SELECT substr(date, 1, 7) AS month, substr(date, 1, 4) AS year, count(*) AS test_rows, max(volume) AS top_volume, avg(label_short) AS mean_label FROM panel GROUP BY ALL)
    SELECT year, count(*) AS windows, CAST(sum(test_rows) AS BIGINT) AS test_rows, max(top_volume) AS top_volume, sum(mean_label * test_rows) / sum(test_rows) AS mean_label FROM m GROUP BY year""",
    doubles="top_volume mean_label",
)
def _(t):
    monthly = t.panel.groupBy(F.substring("date", 1, 7).alias("month"), F.substring("date", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("test_rows"), F.max("volume").alias("top_volume"), F.avg("label_short").alias("mean_label")
    )
    return A.yearly_metrics(monthly, "year", ["test_rows"], ["top_volume"], ["mean_label"], "test_rows")


@query(
    "month_start_states", "AGG-10",
    f"""WITH {PANEL}, d AS (SELECT min(date) AS date FROM panel GROUP BY substr(date, 1, 7))
    SELECT date, clock, symbol, arg_max(rid, (turnover, volume, rid)) AS best, max(turnover) AS max_turnover FROM panel WHERE date IN (SELECT date FROM d) GROUP BY date, clock, symbol""",
    doubles="max_turnover",
)
def _(t):
    from tickloom.operators.decision import latest_per_key
    from tickloom.operators.reference import calendar

    first = A.month_starts(calendar(t.panel))
    rows = t.panel.join(first, "date", "left_semi")
    return latest_per_key(rows, ["date", "clock", "symbol"], "rid", ["turnover", "volume", "rid"], "best")


AVAILABILITY = """a AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) // 6 AS VARCHAR) AS clock,
    CASE WHEN event_id % 10 > 0 THEN (event_id % 97 - 30) / 10.0 END AS late, (event_id % 31) / 4.0 AS age FROM events),
  e AS (SELECT 'all' AS grain, '*' AS date, '*' AS clock, late, age FROM a UNION ALL SELECT 'date', date, '*', late, age FROM a UNION ALL SELECT 'clock', '*', clock, late, age FROM a)"""


@query(
    "availability_quantiles", "AGG-11",
    f"""WITH {AVAILABILITY} SELECT grain, date, clock, count(*) AS states, count(late) AS with_receipt, avg(CAST(late > 0 AS DOUBLE)) AS late_over_0s,
      avg(CAST(late > 2 AS DOUBLE)) AS late_over_2s, avg(CAST(late > 6 AS DOUBLE)) AS late_over_6s, quantile_cont(late, 0.5) AS delay_p50, quantile_cont(late, 0.99) AS delay_p99,
      quantile_cont(age, 0.5) AS age_p50, quantile_cont(age, 0.99) AS age_p99 FROM e GROUP BY ALL""",
    doubles="late_over_0s late_over_2s late_over_6s delay_p50 delay_p99 age_p50 age_p99", digits=5,
)
def _(t):
    i, us = F.col("event_id"), C.micros("ts")
    rows = t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.floor(F.hour("ts") / 6).cast("string").alias("clock"), us.alias("decision"),
        F.when(i % 10 > 0, us + (i % 97 - 30) * 100_000).alias("receipt"), (us - (i % 31) * 250_000).alias("source"),
    )
    return A.availability(rows, "receipt", "decision", "source", [[], ["date"], ["clock"]], ["date", "clock"])


@query(
    "run_comparison", "AGG-12",
    f"""WITH {PANEL}, y AS (SELECT industry AS run, substr(date, 1, 4) AS year, avg(label_next_close) * 1e4 AS m FROM panel GROUP BY ALL)
    SELECT run, count(*) AS years, avg(m) AS mean, count_if(m > 0) AS positive_years, arg_max(year, m) AS best_year, arg_min(year, m) AS worst_year,
      arg_max(m, year) - arg_min(m, year) AS first_to_last_change, min(m) AS minimum FROM y GROUP BY run""",
    doubles="mean first_to_last_change minimum", digits=5,
)
def _(t):
    yearly = t.panel.groupBy(F.col("industry").alias("run"), F.substring("date", 1, 4).alias("year")).agg(
        (F.avg("label_next_close") * 1e4).alias("m")
    )
    return A.compare_runs(yearly, "run", "year", "m")


@query(
    "mergeable_moments", "AGG-13",
    f"""WITH {PANEL}, l AS (SELECT industry, 'label_short' AS variable, label_short AS v FROM panel WHERE label_short IS NOT NULL UNION ALL SELECT industry, 'score', score FROM panel),
    s AS (SELECT industry, variable, count(*) AS rows, sum(v) AS t, sum(v * v) AS q, sum(abs(v)) AS a, count_if(v > 0) AS positives, count_if(v = 0) AS zeros,
      min(v) AS minimum, max(v) AS maximum, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY ALL)
    SELECT industry, variable, rows, positives, zeros, minimum, maximum, mean, std, rows / sum(rows) OVER w AS row_share, q / sum(q) OVER w AS square_share,
      a / sum(a) OVER w AS absolute_share FROM s WINDOW w AS (PARTITION BY variable)""",
    doubles="minimum maximum mean std row_share square_share absolute_share",
)
def _(t):
    return A.mergeable_moments(t.panel, ["label_short", "score"], "industry")


@query(
    "mergeable_quantiles", "AGG-13",
    f"""WITH {PANEL}, l AS (SELECT industry, 'label_short' AS variable, label_short AS v FROM panel WHERE label_short IS NOT NULL UNION ALL SELECT industry, 'turnover', turnover FROM panel)
    SELECT industry, variable, count(*) AS rows, count(DISTINCT v) AS distinct_values, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.999) AS p999 FROM l GROUP BY ALL""",
    doubles="p01 p50 p999",
)
def _(t):
    # counted per year and part, then merged: the quantiles are those of all rows
    rows = t.panel.withColumn("year", F.substring("date", 1, 4))
    parts = [A.value_counts(rows.where(test), ["label_short", "turnover"], ["industry", "year"]) for test in ("volume <= 20", "volume > 20")]
    return A.quantiles_of_counts(A.merged_counts(parts, ["industry"]), {"p01": 0.01, "p50": 0.5, "p999": 0.999}, ["industry"])


@query(
    "keyed_sample", "AGG-14",
    f"""WITH {PANEL} SELECT industry, substr(date, 1, 4) AS year, rid, turnover FROM panel
    QUALIFY row_number() OVER (PARTITION BY industry, substr(date, 1, 4) ORDER BY md5('5|' || symbol || '|' || rid || '|' || turnover), symbol, rid, turnover) <= 20""",
    doubles="turnover",
)
def _(t):
    rows = t.panel.withColumn("year", F.substring("date", 1, 4))
    return A.keyed_sample(rows, ["industry", "year"], TIE, 20, 5).select("industry", "year", "rid", "turnover")


@query(
    "thresholds_to_columns", "AGG-16",
    f"""WITH {PANEL} SELECT industry, avg(label_short) FILTER (clock = '09:31:00') AS early_mean, count(*) FILTER (clock = '09:31:00') AS early_n,
      avg(label_short) FILTER (clock <> '09:31:00') AS late_mean, count(*) FILTER (clock <> '09:31:00') AS late_n FROM panel GROUP BY industry""",
    doubles="early_mean late_mean",
)
def _(t):
    long = t.panel.groupBy("industry", F.when(F.col("clock") == "09:31:00", "early").otherwise("late").alias("threshold")).agg(
        F.avg("label_short").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return A.widen(long, ["industry"], "threshold", ["early", "late"], ["mean", "n"])


@query(
    "paired_differences", "AGG-17",
    f"""WITH {PANEL}, g AS (SELECT industry, status, avg(label_short) AS short, avg(label_next_close) AS later FROM panel GROUP BY ALL),
    l AS (SELECT industry, status, 'short' AS metric, short AS v FROM g UNION ALL SELECT industry, status, 'later', later FROM g)
    SELECT industry, metric, max(v) FILTER (status = 'F') AS F, max(v) FILTER (status = 'O') AS O, max(v) FILTER (status = 'O') - max(v) FILTER (status = 'F') AS effect FROM l GROUP BY ALL""",
    doubles="F O effect",
)
def _(t):
    grid = t.panel.groupBy("industry", "status").agg(F.avg("label_short").alias("short"), F.avg("label_next_close").alias("later"))
    return A.paired_grid(grid, ["industry"], "status", ("F", "O"), ["short", "later"])


@query(
    "sample_weights", "WIN-16",
    f"""WITH {PANEL} SELECT rid, turnover, 0.2 + 0.8 * least(greatest(date_diff('day', DATE '1996-01-01', CAST(date AS DATE)) / date_diff('day', DATE '1996-01-01', DATE '2000-12-31'), 0), 1) AS weight FROM panel""",
    doubles="turnover weight",
)
def _(t):
    weight = A.date_weight(F.col("date"), "1996-01-01", "2000-12-31", 0.2, 1.0)
    return t.panel.select("rid", "turnover", weight.alias("weight"))


