"""Rank-bucket, tail, histogram and limit-state diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import buckets as B
from tickloom.operators.evaluate import with_place
from tickloom.plans.base import PANEL, TIE, XS, query
from tickloom.plans.evaluation import corr, rank_over

Y = "label_next_close"
RANKED = f"""ranked AS (SELECT *, substr(date, 1, 7) AS month,
    row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS score_rank,
    count(*) OVER (PARTITION BY date, clock) AS group_size, ({Y} - avg({Y}) OVER (PARTITION BY date, clock)) * 10000 AS excess_bps,
    (rank() OVER (PARTITION BY date, clock ORDER BY {Y} DESC) + (count(*) OVER (PARTITION BY date, clock, {Y}) - 1) / 2.0)
      / count(*) OVER (PARTITION BY date, clock) AS realized_pct
  FROM panel WHERE {Y} IS NOT NULL)"""


def ranked(t):
    rows = t.panel.where(F.col(Y).isNotNull()).withColumn("month", F.substring("date", 1, 7))
    return B.ranked_rows(rows.select(*XS, *TIE, "month", "prediction", Y, "score", "industry"), XS, "prediction", Y, TIE)


@query(
    "ranked_pool_rows", "DIAG-02",
    f"WITH {PANEL}, {RANKED} SELECT rid, turnover, score_rank, group_size, excess_bps, realized_pct FROM ranked",
    doubles="turnover excess_bps realized_pct", digits=5,
)
def _(t):
    return ranked(t).select("rid", "turnover", "score_rank", "group_size", "excess_bps", "realized_pct")


STAB = """SELECT {g}, count(*) AS months, count_if(m > 1e-9) AS positive_months, min(m) AS month_min, max(m) AS month_max
  FROM (SELECT {g}, month, avg({v}) AS m FROM {src} GROUP BY ALL) GROUP BY ALL"""


@query(
    "multiscale_buckets", "DIAG-01",
    f"""WITH {PANEL}, {RANKED}, b AS (SELECT r.*, w AS bucket_width, CAST((score_rank - 1) // w + 1 AS INTEGER) AS bucket FROM ranked r, (VALUES (2), (3)) v(w)
      WHERE score_rank <= 7 // w * w),
    s AS (SELECT bucket_width, bucket, count(*) AS rows, avg(excess_bps) AS mean_excess_bps, avg(CAST(excess_bps > 1e-9 AS DOUBLE)) AS positive_excess_rate,
      avg(greatest(excess_bps, 0)) AS positive_part_bps, avg(least(excess_bps, 0)) AS negative_part_bps, avg(CAST(realized_pct <= 0.05 AS DOUBLE)) AS realized_top5_rate,
      avg(CAST(realized_pct <= 0.10 AS DOUBLE)) AS realized_top10_rate, avg(CAST(excess_bps >= 100 AS DOUBLE)) AS big_win_100bps_rate,
      avg(CAST(excess_bps >= 300 AS DOUBLE)) AS big_win_300bps_rate, avg(CAST(excess_bps >= 500 AS DOUBLE)) AS big_win_500bps_rate,
      median(excess_bps) AS median_excess_bps, quantile_cont(excess_bps, 0.9) AS p90_excess_bps, quantile_cont(excess_bps, 0.95) AS p95_excess_bps,
      quantile_cont(excess_bps, 0.99) AS p99_excess_bps FROM b GROUP BY ALL),
    m AS ({STAB.format(g='bucket_width, bucket', v='excess_bps', src='b')})
    SELECT * FROM s JOIN m USING (bucket_width, bucket)""",
    doubles="mean_excess_bps positive_excess_rate positive_part_bps negative_part_bps realized_top5_rate realized_top10_rate big_win_100bps_rate big_win_300bps_rate big_win_500bps_rate median_excess_bps p90_excess_bps p95_excess_bps p99_excess_bps month_min month_max",
    digits=4,
)
def _(t):
    return B.bucket_summary(ranked(t), [2, 3], 7)


@query(
    "top_k_shape", "DIAG-01",
    f"""WITH {PANEL}, {RANKED} SELECT k AS top_k, count(*) AS rows, avg(excess_bps) AS mean_excess_bps, avg(CAST(excess_bps > 1e-9 AS DOUBLE)) AS positive_excess_rate,
      avg(CAST(realized_pct <= 0.10 AS DOUBLE)) AS realized_top10_rate, median(excess_bps) AS median_excess_bps FROM ranked, (VALUES (1), (3), (10)) v(k)
    WHERE score_rank <= k GROUP BY k""",
    doubles="mean_excess_bps positive_excess_rate realized_top10_rate median_excess_bps", digits=4,
)
def _(t):
    return B.shape_summary(ranked(t), [1, 3, 10])


@query(
    "variant_average", "DIAG-01",
    f"""WITH {PANEL}, {RANKED}, v AS (SELECT industry AS variant, score_rank, avg(excess_bps) AS m FROM ranked WHERE score_rank <= 3 GROUP BY ALL)
    SELECT * FROM v UNION ALL SELECT 'mean', score_rank, avg(m) FROM v GROUP BY score_rank""",
    doubles="m", digits=4,
)
def _(t):
    curves = ranked(t).where("score_rank <= 3").groupBy(F.col("industry").alias("variant"), "score_rank").agg(F.avg("excess_bps").alias("m"))
    return B.variant_mean(curves, ["score_rank"], ["m"])


SCOPES = {"top_3": (0, 3), "top_8": (0, 8), "bucket_2": (4, 8), "window_3": (2, 6)}
SCOPE_ROWS = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in SCOPES.items())
SCOPED = f"""sc AS (SELECT r.*, scope FROM ranked r, (VALUES {SCOPE_ROWS}) v(scope, a, b) WHERE score_rank > a AND score_rank <= b AND group_size >= b),
  sr AS (SELECT *, {rank_over('prediction', 'date, clock, scope')} AS rs, {rank_over('excess_bps', 'date, clock, scope')} AS re FROM sc),
  ic AS (SELECT date, clock, scope, count(*) AS rows, {corr('rs', 're')} AS spearman_ic, first(month) AS month FROM sr GROUP BY date, clock, scope)"""


@query(
    "scope_rank_ic", "DIAG-02",
    f"WITH {PANEL}, {RANKED}, {SCOPED} SELECT * FROM ic",
    doubles="spearman_ic",
)
def _(t):
    return B.scope_ic(ranked(t), XS, "prediction", SCOPES)


@query(
    "scope_ic_summary", "DIAG-02",
    f"""WITH {PANEL}, {RANKED}, {SCOPED}, s AS (SELECT scope, count(spearman_ic) AS groups, avg(spearman_ic) AS mean_ic, avg(CAST(spearman_ic > 1e-9 AS DOUBLE)) AS positive_rate,
      median(spearman_ic) AS median_ic, quantile_cont(spearman_ic, 0.1) AS p10_ic, quantile_cont(spearman_ic, 0.9) AS p90_ic FROM ic GROUP BY scope),
    m AS ({STAB.format(g='scope', v='spearman_ic', src='ic')}) SELECT * FROM s JOIN m USING (scope)""",
    doubles="mean_ic median_ic p10_ic p90_ic month_min month_max positive_rate",
)
def _(t):
    ic = B.scope_ic(ranked(t), XS, "prediction", SCOPES)
    return B.ic_summary(ic, ["scope"])


GROUP_IC = f"""gs AS (SELECT r.*, scope FROM ranked r, (VALUES ('pool', 1000000), ('top_6', 6)) v(scope, k) WHERE score_rank <= k),
  gr AS (SELECT *, {rank_over('prediction', 'date, clock, scope')} AS rs, {rank_over(Y, 'date, clock, scope')} AS rl FROM gs),
  gi AS (SELECT date, clock, scope, count(*) AS rows, {corr('rs', 'rl')} AS rank_ic, {corr('rs', Y)} AS rank_raw_ic, {corr('prediction', Y)} AS raw_ic,
    -{corr('rs', 'rl')} AS reverse_rank_ic FROM gr GROUP BY date, clock, scope)"""


@query(
    "group_ic_scopes", "DIAG-03",
    f"WITH {PANEL}, {RANKED}, {GROUP_IC} SELECT * FROM gi",
    doubles="rank_ic rank_raw_ic raw_ic reverse_rank_ic",
)
def _(t):
    return B.group_ic(ranked(t), XS, "prediction", Y, {"pool": None, "top_6": 6})


HAC3 = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum((value - m) * (l{k} - m)) / count(*), 0)" for k in range(1, 6))


@query(
    "daily_ic_hac", "DIAG-03",
    f"""WITH {PANEL}, {RANKED}, {GROUP_IC}, d AS (SELECT scope, date, avg(rank_ic) AS rank_ic, avg(raw_ic) AS raw_ic FROM gi GROUP BY ALL),
    l AS (SELECT scope, date, 'rank_ic' AS metric, rank_ic AS value FROM d WHERE rank_ic IS NOT NULL UNION ALL SELECT scope, date, 'raw_ic', raw_ic FROM d WHERE raw_ic IS NOT NULL),
    x AS (SELECT *, avg(value) OVER (PARTITION BY scope, metric) AS m, {", ".join(f"lag(value, {k}) OVER (PARTITION BY scope, metric ORDER BY date) AS l{k}" for k in range(1, 6))} FROM l),
    s AS (SELECT scope, metric, count(*) AS observations, avg(value) AS mean, stddev_samp(value) AS std,
      sqrt(greatest(var_pop(value) + {HAC3}, 0) / count(*)) AS se FROM x GROUP BY ALL)
    SELECT scope, metric, observations, mean, std, mean * sqrt(observations) / std AS ordinary_t, mean / se AS hac_t, mean - 1.96 * se AS hac_low,
      mean + 1.96 * se AS hac_high, mean / std * sqrt(252) AS annualised_ir FROM s""",
    doubles="mean std ordinary_t hac_t hac_low hac_high annualised_ir", digits=5,
)
def _(t):
    ic = B.group_ic(ranked(t), XS, "prediction", Y, {"pool": None, "top_6": 6})
    return B.daily_ic_summary(ic, ["rank_ic", "raw_ic"], "date", ["scope"]).drop("positive_rate")


CURVE = f"""o AS (SELECT *, {rank_over(Y, 'date, clock')} / group_size AS op FROM ranked),
  cb AS (SELECT date, clock, c AS bucket_count, CAST(least(c, (score_rank - 1) * c // group_size + 1) AS INTEGER) AS bucket, avg(excess_bps) AS e, avg(op) AS o
    FROM o, (VALUES (3), (5)) v(c) GROUP BY ALL),
  curve AS (SELECT bucket_count, bucket, count(e) AS groups, avg(e) AS mean_excess_bps, avg(o) AS mean_outcome_rank_pct, (bucket - 0.5) * 100.0 / bucket_count AS x FROM cb GROUP BY ALL)"""


@query(
    "rank_bucket_curve", "DIAG-04",
    f"WITH {PANEL}, {RANKED}, {CURVE} SELECT * FROM curve",
    doubles="mean_excess_bps mean_outcome_rank_pct x", digits=4,
)
def _(t):
    return B.bucket_curve(ranked(t), XS, [3, 5], Y)[0]


@query(
    "bucket_rank_ic", "DIAG-04",
    f"""WITH {PANEL}, {RANKED}, {CURVE}, r AS (SELECT *, {rank_over('e', 'date, clock, bucket_count')} AS re, -CAST(bucket AS DOUBLE) AS nb FROM cb)
    SELECT date, clock, bucket_count, {corr('nb', 're')} AS bucket_rank_ic FROM r GROUP BY date, clock, bucket_count""",
    doubles="bucket_rank_ic",
)
def _(t):
    return B.bucket_curve(ranked(t), XS, [3, 5], Y)[1]


@query(
    "curve_rank_ic", "DIAG-04",
    f"""WITH {PANEL}, {RANKED}, {CURVE}, r AS (SELECT *, {rank_over('mean_excess_bps', 'bucket_count')} AS re, -CAST(bucket AS DOUBLE) AS nb FROM curve)
    SELECT bucket_count, {corr('nb', 're')} AS curve_rank_ic FROM r GROUP BY bucket_count""",
    doubles="curve_rank_ic",
)
def _(t):
    return B.curve_rank_ic(B.bucket_curve(ranked(t), XS, [3, 5], Y)[0])


EXACT = "exact AS (SELECT score_rank, count(excess_bps) AS observations, avg(excess_bps) AS mean_excess_bps FROM ranked WHERE score_rank <= 12 GROUP BY score_rank)"


@query(
    "exact_rank_curve", "DIAG-05",
    f"WITH {PANEL}, {RANKED}, {EXACT} SELECT * FROM exact",
    doubles="mean_excess_bps", digits=4,
)
def _(t):
    return B.exact_rank_curve(ranked(t), 12)


@query(
    "exact_curve_summary", "DIAG-05",
    f"""WITH {PANEL}, {RANKED}, {EXACT}, r AS (SELECT *, -CAST(score_rank AS DOUBLE) AS o, rank() OVER (ORDER BY mean_excess_bps) AS re FROM exact)
    SELECT count(*) AS points, {corr('o', 're')} AS spearman_ic, {corr('o', 'mean_excess_bps')} AS pearson_ic, avg(mean_excess_bps) FILTER (score_rank <= 4) AS head_mean_bps,
      avg(mean_excess_bps) FILTER (score_rank > 8) AS tail_mean_bps, avg(mean_excess_bps) FILTER (score_rank <= 4) - avg(mean_excess_bps) FILTER (score_rank > 8) AS head_minus_tail_bps FROM r""",
    doubles="spearman_ic pearson_ic head_mean_bps tail_mean_bps head_minus_tail_bps", digits=4,
)
def _(t):
    return B.exact_curve_summary(B.exact_rank_curve(ranked(t), 12), 4, 12)


@query(
    "rank_sub_buckets", "DIAG-13",
    f"""WITH {PANEL}, {RANKED}, {EXACT} SELECT CAST((score_rank - 1) // 3 + 1 AS INTEGER) AS subbucket, min(score_rank) AS start_rank, max(score_rank) AS end_rank,
      CAST(sum(observations) AS BIGINT) AS rows, avg(mean_excess_bps) AS mean_excess_bps, min(mean_excess_bps) AS min_mean_bps, max(mean_excess_bps) AS max_mean_bps
    FROM exact WHERE score_rank <= 9 GROUP BY ALL""",
    doubles="mean_excess_bps min_mean_bps max_mean_bps", digits=4,
)
def _(t):
    return B.sub_buckets(B.exact_rank_curve(ranked(t), 12), 9, 3)


@query(
    "return_histogram", "DIAG-06",
    f"""WITH {PANEL}, {RANKED}, h AS (SELECT industry, CAST(floor(excess_bps / 50) * 50 AS BIGINT) AS lower_bps, count(*) AS n FROM ranked GROUP BY ALL),
    g AS (SELECT industry, lower_bps FROM (SELECT DISTINCT industry FROM h), (SELECT unnest(range(min(lower_bps), max(lower_bps) + 1, 50)) AS lower_bps FROM h)),
    f AS (SELECT g.industry, g.lower_bps, coalesce(n, 0) AS observations FROM g LEFT JOIN h USING (industry, lower_bps))
    SELECT industry, lower_bps, lower_bps + 50 AS upper_bps, observations, observations / sum(observations) OVER (PARTITION BY industry) AS share FROM f""",
    doubles="share",
)
def _(t):
    return B.return_histogram(ranked(t), "excess_bps", 50, ["industry"])


@query(
    "return_tail_summary", "DIAG-06",
    f"""WITH {PANEL}, {RANKED} SELECT industry, count(*) AS observations, count_if(excess_bps < -0.001) AS negative, avg(excess_bps) AS mean, min(excess_bps) AS minimum, max(excess_bps) AS maximum,
      {", ".join(f"quantile_cont(excess_bps, {p}) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.10, 0.50, 0.90, 0.95, 0.99))} FROM ranked GROUP BY industry""",
    doubles="mean minimum maximum p01 p05 p10 p50 p90 p95 p99", digits=4,
)
def _(t):
    rows = ranked(t).withColumn("excess_bps", F.when(F.abs("excess_bps") >= 0.001, F.col("excess_bps")).otherwise(0.0))
    return B.return_summary(rows, "excess_bps", ["industry"]).drop("nonnegative_rate")


LIMIT = """lim AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS turnover, floor(l_extendedprice) / 1000 AS prev,
    floor(floor(l_extendedprice) / 1000 * CASE l_linenumber % 4 WHEN 0 THEN 120.0 WHEN 1 THEN 110.0 WHEN 2 THEN 105.0 ELSE 113.0 END / 100.0 * 100.0 + 0.50000001) / 100.0 AS upper FROM lineitem),
  st AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN upper ELSE upper * 0.997 END AS price, CASE WHEN l_orderkey % 2 = 0 THEN 0.0 ELSE upper END AS ask FROM lim)"""


@query(
    "limit_reference_states", "DIAG-07",
    f"""WITH {LIMIT}, r AS (SELECT *, floor(prev * 120.0 / 100.0 * 100.0 + 0.50000001) / 100.0 AS e20, floor(prev * 110.0 / 100.0 * 100.0 + 0.50000001) / 100.0 AS e10,
      floor(prev * 105.0 / 100.0 * 100.0 + 0.50000001) / 100.0 AS e5, price >= upper - 0.005 AS at_limit, (upper - price) / price * 10000 AS room FROM st)
    SELECT l_orderkey, l_linenumber, turnover, CASE WHEN abs(upper - e5) <= 0.005 + 1e-9 THEN 5 WHEN abs(upper - e10) <= 0.005 + 1e-9 THEN 10 WHEN abs(upper - e20) <= 0.005 + 1e-9 THEN 20 END AS limit_rate,
      at_limit, at_limit AND ask <= 0 AS sealed, at_limit AND ask > 0 AS touched_only, room <= 50 AND NOT at_limit AS near_limit, ask > 0 AS has_offer FROM r""",
    doubles="turnover",
)
def _(t):
    n = F.col("l_linenumber") % 4
    rate = F.when(n == 0, 120.0).when(n == 1, 110.0).when(n == 2, 105.0).otherwise(113.0)
    prev = F.floor("l_extendedprice").cast("double") / 1000
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("turnover"), prev.alias("prev"), rate.alias("rate"))
    rows = rows.withColumn("upper", F.floor(F.col("prev") * F.col("rate") / 100.0 * 100.0 + 0.50000001) / 100.0)
    rows = rows.withColumns(
        {
            "price": F.when(F.col("l_orderkey") % 5 == 0, F.col("upper")).otherwise(F.col("upper") * 0.997),
            "ask": F.when(F.col("l_orderkey") % 2 == 0, 0.0).otherwise(F.col("upper")),
        }
    )
    out = B.limit_reference(rows, "price", "prev", "upper", "ask")
    return out.select(
        "l_orderkey", "l_linenumber", "turnover", "limit_rate", "at_limit", "sealed", "touched_only", "near_limit", "has_offer"
    )


@query(
    "condition_effects", "DIAG-08",
    f"""WITH {PANEL}, l AS (SELECT *, 'small' AS condition, volume < 10 AS f FROM panel UNION ALL SELECT *, 'open', status = 'O' FROM panel),
    p AS (SELECT *, row_number() OVER (PARTITION BY condition, date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS place,
      row_number() OVER (PARTITION BY condition, date, clock, f ORDER BY prediction DESC, symbol, rid, turnover) AS place2 FROM l),
    g AS (SELECT condition, date, clock, count(*) AS n, count_if(f) AS f, count_if(place <= 3) AS s, count_if(place <= 3 AND f) AS sf, avg(CASE WHEN place <= 3 THEN {Y} * 10000 END) AS top,
      sum(CASE WHEN place <= 3 AND f THEN {Y} * 10000 END) AS fs, avg(CASE WHEN NOT f AND place2 <= 3 THEN {Y} * 10000 END) AS re FROM p GROUP BY ALL)
    SELECT condition, count(*) AS groups, sum(f) / sum(n) AS candidate_share, sum(sf) / sum(s) AS selected_share, avg(top) AS top_mean_bps,
      avg(coalesce(fs, 0) / s) AS contribution_bps, avg(re) AS without_mean_bps FROM g GROUP BY condition""",
    doubles="candidate_share selected_share top_mean_bps contribution_bps without_mean_bps", digits=4,
)
def _(t):
    rows = t.panel.withColumns({"small": F.col("volume") < 10, "open": F.col("status") == "O"})
    return B.condition_effects(rows, XS, "prediction", Y, ["small", "open"], 3, TIE)


COND = f"""l AS (SELECT *, 'small' AS condition, volume < 10 AS f FROM panel WHERE {Y} IS NOT NULL UNION ALL SELECT *, 'open', status = 'O' FROM panel WHERE {Y} IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY condition, date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS place,
      row_number() OVER (PARTITION BY condition, date, clock, f ORDER BY prediction DESC, symbol, rid, turnover) AS place2 FROM l),
    g AS (SELECT condition, date, clock, count(*) AS n, count_if(f) AS f, count_if(place <= 3) AS s, count_if(place <= 3 AND f) AS sf, avg({Y}) * 10000 AS pool, avg({Y}) FILTER (NOT f) * 10000 AS clear,
      avg({Y}) FILTER (place <= 3) * 10000 AS top, coalesce(sum({Y}) FILTER (place <= 3 AND f), 0) * 10000 AS fs, avg({Y}) FILTER (NOT f AND place2 <= 3) * 10000 AS re FROM p GROUP BY ALL)"""


def conditioned(t):
    return t.panel.withColumns({"small": F.col("volume") < 10, "open": F.col("status") == "O"})


@query(
    "condition_rollup", "DIAG-08",
    f"""WITH {PANEL}, {COND}, h AS (SELECT *, clock AS c FROM g UNION ALL SELECT *, 'all' FROM g)
    SELECT condition, c AS clock, count(*) AS groups, avg(n) AS candidates_mean, avg(s) AS selected_mean, sum(f) / sum(n) AS candidate_share, sum(sf) / sum(s) AS selected_share,
      (sum(sf) / sum(s)) / nullif(sum(f) / sum(n), 0) AS enrichment, sum(fs) / nullif(sum(sf), 0) AS selected_flagged_bps, avg(fs / s) AS contribution_bps, avg(top - pool) AS excess_bps,
      avg(re - pool) AS again_excess_bps, avg(re - clear) AS again_clear_excess_bps, avg(re - pool) - avg(top - pool) AS again_less_original_bps FROM h GROUP BY condition, c""",
    doubles="candidates_mean selected_mean candidate_share selected_share enrichment selected_flagged_bps contribution_bps excess_bps again_excess_bps again_clear_excess_bps again_less_original_bps", digits=4,
)
def _(t):
    groups = B.condition_groups(conditioned(t), XS, "prediction", Y, ["small", "open"], 3, TIE)
    whole = B.condition_rollup(groups, []).withColumn("clock", F.lit("all"))
    return B.condition_rollup(groups, ["clock"]).unionByName(whole)


@query(
    "event_rows", "DIAG-08",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS score_rank FROM panel WHERE {Y} IS NOT NULL AND label_short IS NOT NULL)
    SELECT date, clock, symbol, rid, turnover, CAST(score_rank AS INTEGER) AS score_rank, volume < 10 AS small, status = 'O' AS open FROM p WHERE score_rank <= 3 AND (volume < 10 OR status = 'O')""",
    doubles="turnover",
)
def _(t):
    rows = B.event_rows(conditioned(t), XS, "prediction", ["label_short", Y], ["small", "open"], 3, TIE)
    return rows.select(*XS, *TIE, "score_rank", "small", "open")


@query(
    "auc_by_rank", "DIAG-09",
    f"""WITH {PANEL}, v AS (SELECT *, coalesce(label_short > 0, false) AS hit, {rank_over('score', 'clock')} AS r FROM panel)
    SELECT clock, count_if(hit) AS positives, count_if(NOT hit) AS negatives,
      (sum(CASE WHEN hit THEN r END) - count_if(hit) * (count_if(hit) + 1.0) / 2.0) / (CAST(count_if(hit) AS DOUBLE) * count_if(NOT hit)) AS auc FROM v GROUP BY clock""",
    doubles="auc",
)
def _(t):
    return B.auc_by_rank(t.panel.select("clock", "score", "label_short"), "score", F.col("label_short") > 0, ["clock"])


STATES = ["A", "N", "R"]


def decomposition_sql(c):
    each = ", ".join(
        f"""sum({c}) FILTER (industry = '{s}') AS b_{s}, sum({c}) FILTER (industry = '{s}' AND place <= 3) AS p_{s},
        avg({c}) FILTER (industry = '{s}' AND own <= 3) - avg({c}) FILTER (industry = '{s}') AS a_{s}"""
        for s in STATES
    )
    return f"""SELECT '{c}' AS outcome, date, clock, count(*) AS n, count_if(place <= 3) AS k, avg({c}) AS am, avg({c}) FILTER (place <= 3) AS tm, {each}
      FROM p WHERE {c} IS NOT NULL GROUP BY date, clock"""


def part_sql(s):
    return f"avg(CASE WHEN k > 0 THEN (coalesce(p_{s}, 0) / k - coalesce(b_{s}, 0) / n) * 10000 END)"


@query(
    "state_decomposition", "DIAG-09",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS place,
      row_number() OVER (PARTITION BY date, clock, industry ORDER BY prediction DESC, symbol, rid, turnover) AS own FROM panel),
    g AS ({decomposition_sql('label_short')} UNION ALL {decomposition_sql(Y)}),
    d AS (SELECT outcome, date, avg((tm - am) * 10000) AS d FROM g GROUP BY ALL HAVING d IS NOT NULL),
    t AS (SELECT outcome, count(d) AS days, avg(d) AS daily_mean_bps, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t_stat, avg(CAST(d > 0 AS DOUBLE)) AS positive_day_share FROM d GROUP BY outcome),
    r AS (SELECT outcome, count(tm - am) AS groups, avg(tm) * 10000 AS selected_bps, avg(am) * 10000 AS universe_bps, avg((tm - am) * 10000) AS excess_bps,
      {', '.join(f'{part_sql(s)} AS {s}_contribution_bps, avg(a_{s}) * 10000 AS {s}_reselected_excess_bps' for s in STATES)}, avg((tm - am) * 10000) AS contribution_sum_bps FROM g GROUP BY outcome)
    SELECT * FROM r JOIN t USING (outcome)""",
    doubles="selected_bps universe_bps excess_bps contribution_sum_bps daily_mean_bps t_stat positive_day_share " + " ".join(f"{s}_contribution_bps {s}_reselected_excess_bps" for s in STATES),
    digits=4,
)
def _(t):
    # the twin takes the excess itself for the sum of the contributions
    return B.state_decomposition(t.panel, XS, "date", "prediction", ["label_short", Y], "industry", STATES, 3, TIE)


@query(
    "selection_overlap", "DIAG-09",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS a,
      row_number() OVER (PARTITION BY date, clock ORDER BY volume DESC, symbol, rid, turnover) AS b FROM panel),
    g AS (SELECT date, clock, count(*) AS n FROM p WHERE a <= 3 AND b <= 3 GROUP BY ALL) SELECT count(*) AS groups, avg(n) AS mean_shared_rows FROM g""",
    doubles="mean_shared_rows",
)
def _(t):
    picks = [with_place(t.panel, XS, c, TIE).where("place <= 3") for c in ("prediction", "volume")]
    return B.selection_overlap(*picks, XS, TIE)


def outcome_sql(c, r):
    return f"""SELECT '{c}' AS outcome, date, clock, (avg(CASE WHEN place <= 3 THEN {c} END) - avg({c})) * 10000 AS ex,
      coalesce(sum(CASE WHEN place <= 3 AND industry = 'A' THEN {c} END), 0) / count_if(place <= 3) * 10000 - count_if(place <= 3 AND industry = 'A') / count_if(place <= 3) * avg({c}) * 10000 AS st,
      count_if(place <= 3 AND industry = 'A') / count_if(place <= 3) AS sh, {corr('rs', r)} AS ic FROM p GROUP BY date, clock"""


@query(
    "state_contributions", "DIAG-10 DIAG-14",
    f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS place,
      {rank_over('prediction', 'date, clock')} AS rs, {rank_over('label_short', 'date, clock')} AS r1, {rank_over(Y, 'date, clock')} AS r2 FROM panel WHERE label_short IS NOT NULL AND {Y} IS NOT NULL),
    o AS ({outcome_sql('label_short', 'r1')} UNION ALL {outcome_sql(Y, 'r2')})
    SELECT outcome, count(*) AS groups, avg(ex) AS excess_bps, avg(st) AS state_bps, avg(ex - st) AS rest_bps, avg(sh) AS state_share, avg(ic) AS rank_ic FROM o GROUP BY outcome""",
    doubles="excess_bps state_bps rest_bps state_share rank_ic", digits=4,
)
def _(t):
    return B.state_contributions(t.panel, XS, "prediction", ["label_short", Y], F.col("industry") == "A", 3, TIE)


@query(
    "clipping_shares", "DIAG-11",
    f"""WITH {PANEL}, s AS (SELECT *, abs(label_short - avg(label_short) OVER g) > 1.5 * stddev_pop(label_short) OVER g AS b1, abs({Y} - avg({Y}) OVER g) > 1.5 * stddev_pop({Y}) OVER g AS b2
      FROM panel WINDOW g AS (PARTITION BY date, clock)),
    l AS (SELECT 'label_short' AS variable, industry, b1 AS b FROM s WHERE label_short IS NOT NULL UNION ALL SELECT '{Y}', industry, b2 FROM s WHERE {Y} IS NOT NULL)
    SELECT variable, industry, count(*) AS rows, count_if(b) AS clipped_rows, avg(CAST(b AS DOUBLE)) AS clipped_share FROM l GROUP BY ALL""",
    doubles="clipped_share",
)
def _(t):
    return B.clipping_share(t.panel, XS, ["label_short", Y], "industry", 1.5)


@query(
    "state_separation", "DIAG-11",
    f"WITH {PANEL} SELECT industry, quantile_cont({Y}, 0.25) AS q25, quantile_cont({Y}, 0.5) AS q50, quantile_cont({Y}, 0.75) AS q75 FROM panel GROUP BY industry",
    doubles="q25 q50 q75",
)
def _(t):
    return B.state_separation(t.panel, Y, "industry")


@query(
    "two_source_check", "DIAG-12",
    """WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS q, max(l_tax) AS x FROM lineitem GROUP BY 1),
    b AS (SELECT l_orderkey AS k, sum(l_quantity) FILTER (l_linenumber < 7) AS q, max(l_tax) AS x FROM lineitem GROUP BY 1),
    l AS (SELECT 'q' AS variable, abs(a.q - b.q) AS g FROM a JOIN b USING (k) UNION ALL SELECT 'x', abs(a.x - b.x) FROM a JOIN b USING (k))
    SELECT variable, count(*) AS matched, count_if(g <= 5) AS agree, count_if(g > 5) AS differ, count_if(g IS NULL) AS missing, max(g) AS max_gap FROM l GROUP BY variable""",
    doubles="max_gap",
)
def _(t):
    k = F.col("l_orderkey").alias("k")
    a = t.lineitem.groupBy(k).agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("x"))
    kept = F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))
    b = t.lineitem.groupBy(k).agg(F.sum(kept).alias("q"), F.max("l_tax").alias("x"))
    return B.reconcile(a, b, ["k"], ["q", "x"], 5.0)


@query(
    "exact_top_rows", "DIAG-15",
    f"""WITH {PANEL}, r AS (SELECT rid, turnover, row_number() OVER (PARTITION BY date, clock ORDER BY prediction DESC, symbol, rid, turnover) AS score_rank,
      count(*) OVER (PARTITION BY date, clock) AS group_size FROM panel)
    SELECT rid, turnover, score_rank, group_size, 1.0 - (score_rank - 1) / group_size AS score_percentile, group_size >= 5 AS full_group FROM r WHERE score_rank <= 5""",
    doubles="turnover score_percentile",
)
def _(t):
    out = B.exact_top(t.panel.select(*XS, *TIE, "prediction"), XS, "prediction", 5, TIE)
    return out.drop(*XS, "symbol", "prediction")


@query(
    "unique_limit_hits", "TOP-05",
    f"""WITH {PANEL} SELECT date, symbol, arg_max(clock, (prediction, rid, turnover)) AS clock, max(prediction) AS prediction, count(*) AS hits FROM panel WHERE volume > 30 GROUP BY date, symbol""",
    doubles="prediction",
)
def _(t):
    rows = t.panel.where("volume > 30").select("date", "symbol", "clock", "prediction", "rid", "turnover")
    return B.unique_hits(rows, ["date", "symbol"], "prediction", ["rid", "turnover"]).drop("rid", "turnover")


def tail_sql(c):
    return f"""SELECT '{c}' AS variable, industry, {c} AS value, row_number() OVER (PARTITION BY m ORDER BY {c} DESC, symbol, rid, turnover) AS p, count(*) OVER (PARTITION BY m) AS n
      FROM (SELECT *, substr(date, 1, 7) AS m FROM panel WHERE {c} IS NOT NULL)"""


@query(
    "tail_composition", "TOP-06",
    f"""WITH {PANEL}, r AS ({tail_sql('label_short')} UNION ALL {tail_sql('prediction')}),
    x AS (SELECT *, 'top_1pct' AS tail FROM r WHERE p <= ceil(n * 0.01) UNION ALL SELECT *, 'top_3pct' FROM r WHERE p <= ceil(n * 0.03) UNION ALL SELECT *, 'top_20' FROM r WHERE p <= 20),
    s AS (SELECT variable, tail, industry, count(*) AS rows, avg(value) AS mean_value FROM x GROUP BY ALL)
    SELECT *, rows / sum(rows) OVER (PARTITION BY variable, tail) AS share FROM s""",
    doubles="mean_value share",
)
def _(t):
    rows = t.panel.withColumn("m", F.substring("date", 1, 7))
    return B.tail_composition(rows, ["m"], ["label_short", "prediction"], "industry", TIE, 20)
