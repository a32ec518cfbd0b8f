"""As-of sampling, deduplication and delayed reads over tick states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import clock as C
from tickloom.functions.numeric import price_return
from tickloom.operators import decision as D
from tickloom.operators import evaluate as E
from tickloom.operators.groups import ranks, top_rows
from tickloom.plans.base import TICKS, query

SIX_HOURLY = ["06:00:00", "12:00:00", "18:00:00", "23:59:59"]
USER = ["symbol"]


def clock_rows(clocks):
    listed = ", ".join(f"('{c}', {C.clock_seconds(c)}000000)" for c in clocks)
    return f"""targets AS (
  SELECT DISTINCT k.date, k.symbol, c.decision_time,
    epoch_us(CAST(k.date AS TIMESTAMP)) + c.us AS target
  FROM (SELECT DISTINCT date, symbol FROM ticks) k, (VALUES {listed}) c(decision_time, us))"""


@query(
    "asof_clock_state", "JOIN-01 FLT-12 FN-02",
    f"""WITH {TICKS}, {clock_rows(SIX_HOURLY)}
    SELECT g.date, g.symbol, g.decision_time, g.target, k.t, k.last_price, k.status,
      (g.target - k.t) / 1e6 AS state_age_seconds
    FROM targets g ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target >= k.t
    WHERE g.target - k.t <= 43200000000""",
    doubles="last_price state_age_seconds",
)
def _(t):
    rows = D.sample_rows(
        t.ticks, "decision_points", clocks=SIX_HOURLY, values=["last_price", "status"], by=USER,
        seq=["seq"], max_state_age_seconds=12 * 3600,
    )
    return rows.select(
        "date", "symbol", "decision_time", "target", "t", "last_price", "status", "state_age_seconds"
    )


@query(
    "asof_cutoff", "JOIN-01",
    f"""WITH {TICKS}, {clock_rows(SIX_HOURLY)}
    SELECT g.date, g.symbol, g.target, g.target - 3600000000 AS cutoff, k.t, k.last_price
    FROM targets g ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target - 3600000000 >= k.t""",
    doubles="last_price",
)
def _(t):
    rows = D.sample_decisions(
        t.ticks, SIX_HOURLY, ["last_price"], by=USER, seq=["seq"], source_cutoff_seconds=3600
    )
    return rows.select("date", "symbol", "target", "cutoff", "t", "last_price")


@query(
    "asof_next_tick_tolerance", "JOIN-01 JOIN-02",
    f"""WITH {TICKS}, {clock_rows(SIX_HOURLY)}
    SELECT g.date, g.symbol, g.target, k.t, k.last_price, (k.t - g.target) / 1e6 AS lag_seconds
    FROM targets g ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target <= k.t
    WHERE k.t - g.target <= 14400000000""",
    doubles="last_price lag_seconds",
)
def _(t):
    rows = D.sample_decisions(
        t.ticks, SIX_HOURLY, ["last_price"], alignment="next_tick", by=USER, seq=["seq"],
        max_lag_seconds=4 * 3600,
    )
    return rows.select("date", "symbol", "target", "t", "last_price", "lag_seconds")


@query(
    "forward_value_read", "JOIN-02",
    f"""WITH {TICKS}, asked AS (SELECT symbol, seq, t AS t0, t + 21600000000 AS at FROM ticks)
    SELECT a.symbol, a.seq, CASE WHEN k.t - a.at <= 86400000000 THEN k.t END AS t_later,
      CASE WHEN k.t - a.at <= 86400000000 THEN k.last_price END AS last_price_later
    FROM asked a ASOF LEFT JOIN ticks k ON a.symbol = k.symbol AND a.at <= k.t""",
    doubles="last_price_later",
)
def _(t):
    out = D.state_at(
        t.ticks.select("symbol", "seq", "t"), t.ticks, "t", 6 * 3600, ["last_price"], "later",
        by=USER, seq=["seq"], direction="forward", max_gap_seconds=86400,
    )
    return out.select("symbol", "seq", "t_later", "last_price_later")


@query(
    "clock_offset_state", "JOIN-03",
    f"""WITH {TICKS}, asked AS (SELECT symbol, seq, t AS t0, t + 43200000000 AS at FROM ticks)
    SELECT a.symbol, a.seq, k.t AS t_known, k.last_price AS last_price_known,
      (a.at - k.t) / 1e6 AS known_age_seconds
    FROM asked a ASOF LEFT JOIN ticks k ON a.symbol = k.symbol AND a.at >= k.t""",
    doubles="last_price_known known_age_seconds",
)
def _(t):
    out = D.state_at(
        t.ticks.select("symbol", "seq", "t"), t.ticks, "t", 12 * 3600, ["last_price"], "known",
        by=USER, seq=["seq"],
    )
    return out.select("symbol", "seq", "t_known", "last_price_known", "known_age_seconds")


@query(
    "nth_next_tick_gap", "JOIN-04",
    f"""WITH {TICKS}, s AS (
      SELECT *, (t - lag(t) OVER w) / 1e6 AS step FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t, seq)),
    n AS (SELECT symbol, seq, t, lead(t, 2) OVER w AS t2, lead(last_price, 2) OVER w AS p2,
      max(step) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS gap,
      count(step) OVER (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c
      FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t, seq))
    SELECT symbol, seq, CASE WHEN c = 2 AND gap <= 50000 THEN p2 END AS last_price_entry,
      CASE WHEN c = 2 AND gap <= 50000 THEN (t2 - t) / 1e6 END AS entry_delay_seconds,
      CASE WHEN c = 2 AND gap <= 50000 THEN gap END AS entry_max_gap_seconds FROM n""",
    doubles="last_price_entry entry_delay_seconds entry_max_gap_seconds",
)
def _(t):
    out = D.nth_next(
        t.ticks.select("symbol", "t", "seq", "last_price"), 2, ["last_price"], "entry", by=USER,
        max_gap_seconds=50_000,
    )
    return out.select(
        "symbol", "seq", "last_price_entry", "entry_delay_seconds", "entry_max_gap_seconds"
    )


@query(
    "delayed_entry_base", "JOIN-05 WIN-07",
    f"""WITH {TICKS}, {clock_rows(['12:00:00', '18:00:00'])},
    d AS (SELECT g.*, k.t AS source, k.status FROM targets g
      ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target >= k.t),
    e AS (SELECT d.*, d.target + 7200000000 AS entry FROM d),
    b AS (SELECT e.*, k.ask_price_1 AS buy_price, k.status AS entry_status FROM e
      ASOF JOIN ticks k ON e.symbol = k.symbol AND e.entry >= k.t)
    SELECT date, symbol, decision_time, source, entry, buy_price, status, entry_status,
      entry >= max(source) OVER (PARTITION BY date, target) AS entry_after_ready FROM b""",
    doubles="buy_price",
)
def _(t):
    out = D.delayed_entries(
        t.ticks, ["12:00:00", "18:00:00"], 7200, "ask_price_1", "status", by=USER, seq=["seq"]
    )
    return out.drop("target")


@query(
    "exact_hour_lag", "JOIN-06",
    """WITH h AS (SELECT event_type AS kind, epoch_us(date_trunc('hour', ts)) // 3600000000 AS hour,
      sum(value) AS v FROM events GROUP BY ALL)
    SELECT a.kind, a.hour, a.v AS v, b.v AS v_60m FROM h a
    LEFT JOIN h b ON a.kind = b.kind AND a.hour = b.hour + 1""",
    doubles="v v_60m",
)
def _(t):
    hourly = t.events.groupBy(
        F.col("event_type").alias("kind"),
        F.floor(C.micros("ts") / F.lit(3_600_000_000)).alias("hour"),
    ).agg(F.sum("value").alias("v"))
    return D.exact_lag(hourly, ["kind"], "hour", 1, ["v"], "60m")


@query(
    "dedupe_latest", "WIN-08 SRC-09",
    f"""WITH {TICKS}, h AS (SELECT *, t // 3600000000 AS hour FROM ticks)
    SELECT symbol, hour, seq, last_price FROM h
    QUALIFY row_number() OVER (PARTITION BY symbol, hour ORDER BY t DESC, size DESC, seq DESC) = 1""",
    doubles="last_price",
)
def _(t):
    hourly = t.ticks.withColumn("hour", F.floor(F.col("t") / F.lit(3_600_000_000)))
    best = D.deduplicate_states(
        hourly.select("symbol", "hour", "t", "size", "seq", "last_price"), ["symbol", "hour"], ["t", "size", "seq"]
    )
    return best.select("symbol", "hour", "seq", "last_price")


@query(
    "dedupe_stats", "WIN-08",
    f"""WITH {TICKS}, k AS (SELECT symbol, date, count(*) AS n FROM ticks GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS dropped_rows,
      count_if(n > 1) AS duplicated_keys FROM k""",
)
def _(t):
    return D.duplicate_stats(t.ticks, ["symbol", "date"])


@query(
    "window_union_scan", "SRC-09",
    f"""WITH {TICKS} SELECT symbol, seq, last_price FROM ticks
    WHERE (hour(ts) >= 9 AND hour(ts) < 11) OR (hour(ts) >= 14 AND hour(ts) < 15)""",
    doubles="last_price",
)
def _(t):
    hour = 3600 * D.SECOND
    keep = D.in_windows(C.offset_us("ts"), [(9 * hour, 11 * hour), (14 * hour, 15 * hour)])
    return t.ticks.where(keep).select("symbol", "seq", "last_price")


@query(
    "close_reference", "SRC-11 SRC-15",
    f"""WITH {TICKS} SELECT date, symbol, arg_max(last_price, (t, size, seq)) AS close_price, max(t) AS max_t
    FROM ticks WHERE last_price > 0 AND hour(ts) >= 12 GROUP BY date, symbol""",
    doubles="close_price",
)
def _(t):
    window = t.ticks.where((F.col("last_price") > 0) & (F.hour("ts") >= 12))
    return D.latest_per_key(window, ["date", "symbol"], "last_price", ["t", "size", "seq"], "close_price")


@query(
    "first_quote_mid", "SRC-14 LAB-05",
    f"""WITH {TICKS}, {clock_rows(['06:00:00', '15:00:00'])}
    SELECT g.date, g.symbol, g.decision_time, k.t, (k.bid_price_1 + k.ask_price_1) / 2.0 AS mid
    FROM targets g ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target <= k.t
    WHERE k.t - g.target <= 21600000000""",
    doubles="mid",
)
def _(t):
    out = D.first_quote_mid(t.ticks, ["06:00:00", "15:00:00"], 21600, "bid_price_1", "ask_price_1", by=USER)
    return out.select("date", "symbol", "decision_time", "t", "mid")


@query(
    "clock_panel_report", "JOIN-01 LAB-01 WIN-01 TOP-01 EVAL-01 EVAL-06",
    f"""WITH {TICKS}, {clock_rows(SIX_HOURLY)},
    s AS (SELECT g.*, k.last_price FROM targets g
      ASOF JOIN ticks k ON g.symbol = k.symbol AND g.target >= k.t WHERE g.target - k.t <= 43200000000),
    f AS (SELECT s.date, s.decision_time, s.symbol, s.last_price AS score,
        k.last_price / s.last_price - 1.0 AS label
      FROM (SELECT *, target + 21600000000 AS later FROM s) s
      ASOF JOIN ticks k ON s.symbol = k.symbol AND s.later >= k.t),
    r AS (SELECT *,
        rank() OVER (PARTITION BY date, decision_time ORDER BY score)
          + (count(*) OVER (PARTITION BY date, decision_time, score) - 1) / 2.0 AS rs,
        rank() OVER (PARTITION BY date, decision_time ORDER BY label)
          + (count(*) OVER (PARTITION BY date, decision_time, label) - 1) / 2.0 AS rl,
        row_number() OVER (PARTITION BY date, decision_time ORDER BY score DESC, symbol) AS place FROM f)
    SELECT date, decision_time, count(*) AS n,
      covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) AS rank_ic,
      avg(CASE WHEN place <= 5 THEN label END) AS top_mean, avg(label) AS all_mean,
      (avg(CASE WHEN place <= 5 THEN label END) - avg(label)) * 10000 AS excess_bps
    FROM r GROUP BY date, decision_time""",
    doubles="rank_ic top_mean all_mean excess_bps",
)
def _(t):
    group = ["date", "decision_time"]
    now = D.sample_decisions(
        t.ticks, SIX_HOURLY, ["last_price"], by=USER, seq=["seq"], max_state_age_seconds=12 * 3600
    )
    later = D.state_at(
        now.select("date", "symbol", "decision_time", "target", F.col("last_price").alias("score")),
        t.ticks, "target", 6 * 3600, ["last_price"], "later", by=USER, seq=["seq"],
    )
    rows = later.withColumn("label", price_return("last_price_later", "score"))
    return E.pool_report(rows, group, "score", {"": "label"}, 5, ["symbol"])
