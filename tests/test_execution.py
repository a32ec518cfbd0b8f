"""Sequential allocation against a plain walk over the rows, and its invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import capacity as P
from tickloom.operators import execution as X

SCHEMA = "pool string, date string, decision long, symbol string, rank long, score double, target_notional double, allocated_notional double, industry string, price double, status string"


def panel(seed, n=400):
    rnd = random.Random(seed)
    out, seen = [], set()
    while len(out) < n:
        # one day holds a third of all rows
        day = "d0" if rnd.random() < 1 / 3 else f"d{rnd.randrange(1, 5)}"
        key = (day, rnd.randrange(4), f"s{rnd.randrange(40)}")
        if key in seen:
            continue
        seen.add(key)
        out.append(
            ("p", key[0], key[1], key[2], rnd.randrange(1, 50), rnd.random(), 1000.0, round(rnd.uniform(0, 400), 2), f"i{rnd.randrange(3)}",
             rnd.choice([None, 0.0, 2.5, 7.0]), rnd.choice(["TRADE", "HALT", "TRADE"]))
        )
    return out


def walk(rows, rules, target_of=None):
    """Plain re-statement of the rule, one row after the other."""
    rows = sorted((r for r in rows if r[10] == "TRADE" and r[7] > 0), key=lambda r: (r[1], r[2], r[4], -r[5], r[3]))
    left, symbol, industry, used, got = {}, {}, {}, {}, {}
    for r in rows:
        day, group = r[1], (r[1], r[2])
        left.setdefault(group, r[6])
        if rules.max_decisions:
            mine = used.setdefault((day, r[3]), set())
            if r[2] not in mine and len(mine) >= rules.max_decisions:
                continue
        amount = min(r[7], max(0.0, left[group]))
        if rules.symbol_cap:
            amount = min(amount, symbol.get((day, r[3]), rules.symbol_cap))
        if rules.industry_cap:
            scope = group if rules.industry_per_decision else day
            amount = min(amount, industry.get((scope, r[8]), rules.industry_cap))
        amount *= rules.fill_rate
        if rules.lot_shares and r[9] is not None:
            amount = math.floor(amount / r[9] / rules.lot_shares) * rules.lot_shares * r[9] if r[9] > 0 else 0.0
        if amount <= 0 or amount < rules.min_child:
            continue
        left[group] = max(0.0, left[group] - amount)
        if rules.symbol_cap:
            symbol[(day, r[3])] = max(0.0, symbol.get((day, r[3]), rules.symbol_cap) - amount)
        if rules.industry_cap:
            industry[(scope, r[8])] = max(0.0, industry.get((scope, r[8]), rules.industry_cap) - amount)
        if rules.max_decisions:
            mine.add(r[2])
        got[(r[1], r[2], r[3])] = amount
    return got


RULES = [
    X.Execution(),
    X.Execution(symbol_cap=300.0, fill_rate=0.8, min_child=20.0),
    X.Execution(symbol_cap=250.0, industry_cap=700.0, industry="industry", lot_shares=3.0, price="price", min_child=10.0),
    X.Execution(max_decisions=2, fill_rate=0.9, lot_shares=2.0, price="price"),
    X.Execution(industry_cap=300.0, industry="industry", industry_per_decision=True, min_child=30.0),
]


@pytest.mark.parametrize("rules", RULES)
@pytest.mark.parametrize("seed", [1, 2])
def test_replay_matches_the_plain_walk(spark, rules, seed):
    data = panel(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = {(r.date, r.decision, r.symbol): r.allocated_notional for r in X.replay(df, rules, status="status", statuses=["trade"]).collect()}
    want = walk(data, rules)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("rules", RULES)
def test_hot_days_settle_to_the_plain_walk(spark, small_groups, rules):
    """The hot day goes by rounds over blocks of 7 rows, in budgets and order as one row after the other."""
    data = panel(3, 150)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = X.replay(df, rules, status="status", statuses=["trade"]).collect()
    want = walk(data, rules)
    assert {(r.date, r.decision, r.symbol) for r in got} == want.keys()
    assert all(r.allocated_notional == pytest.approx(want[(r.date, r.decision, r.symbol)], abs=1e-9) for r in got)
    for key in {(r.date, r.decision) for r in got}:
        own = sorted((r["rank"], -r.score, r.symbol, r.allocation_order) for r in got if (r.date, r.decision) == key)
        assert [x[-1] for x in own] == list(range(1, len(own) + 1))


def test_replay_does_not_depend_on_batches_or_partitions(spark):
    df = spark.createDataFrame(panel(4), SCHEMA)
    rules = RULES[2]
    one = sorted(map(tuple, X.replay(df, rules).collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        many = sorted(map(tuple, X.replay(df.repartition(8), rules).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many


def test_budgets_hold(spark):
    rules = RULES[2]
    out = X.replay(spark.createDataFrame(panel(5), SCHEMA), rules)
    assert out.groupBy("date", "symbol").agg(F.sum("allocated_notional").alias("a")).where("a > 250.0001").isEmpty()
    assert out.groupBy("date", "industry").agg(F.sum("allocated_notional").alias("a")).where("a > 700.0001").isEmpty()
    assert out.groupBy("date", "decision").agg(F.sum("allocated_notional").alias("a")).where("a > 1000.0001").isEmpty()
    assert out.where("allocated_notional > original_allocated_notional").isEmpty()


def test_refill_skips_the_halted_top_row_and_names_are_capped(spark):
    rows = [("p", "d", 1, s, x, 500.0, st) for s, x, st in (("A", 3.0, "HALT"), ("B", 2.0, "TRADE"), ("C", 1.0, "TRADE"))]
    df = spark.createDataFrame(rows, "pool string, date string, decision long, symbol string, prediction double, row_limit double, status string")
    out = X.visible_refill(df, X.Execution(stop_at=1e-9), 800.0, "prediction", status="status", statuses=["TRADE"]).collect()
    assert {r.symbol: (r.candidate_rank, r.allocated_notional) for r in out} == {"B": (2, 500.0), "C": (3, 300.0)}
    one = X.visible_refill(df, X.Execution(max_names=1), 800.0, "prediction", status="status", statuses=["TRADE"]).collect()
    assert [r.symbol for r in one] == ["B"]


def test_sequential_and_prefix_sum_fill_agree_without_shared_budgets(spark, small_groups):
    rnd = random.Random(8)
    data = [(f"g{i % 3}", f"s{i}", rnd.random(), rnd.uniform(1, 90)) for i in range(120)]
    df = spark.createDataFrame(data, "decision string, symbol string, prediction double, cap double")
    rule = P.Capacity(700.0, participation=1.0, capacity="cap")
    fast = {r.symbol: r.allocated_notional for r in P.greedy_fill(df, ["decision"], rule, ["symbol"]).collect()}
    rows = P.capacity_limits(df, rule).withColumns({"date": F.lit("d"), "down": -F.col("prediction"), "target": F.lit(700.0)})
    slow = {r.symbol: r.allocated_notional for r in X.sequential_allocation(rows, X.Execution(), ["date"], "decision", ["down", "symbol"], "row_limit", "target").collect()}
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in fast)


def test_daily_acceptance_keeps_days_without_any_fill(spark):
    rows = spark.createDataFrame([("p", "d1", 1, "A", 100.0, 0.02)], "pool string, date string, decision long, symbol string, allocated_notional double, y double")
    keys = ["date", "symbol"]
    returns = P.selected_returns(rows.drop("y"), rows.select(*keys, "y"), keys, "y", 8.0)
    targets = spark.createDataFrame([("p", "d1", 200.0), ("p", "d2", 200.0)], "pool string, date string, group_target_notional double")
    got = {r.date: r for r in P.daily_acceptance(returns, targets, 1000.0).collect()}
    assert got["d1"].gross_return_bps == pytest.approx(100.0) and got["d1"].fill_ratio == 0.5
    assert got["d2"].selected_rows == 0 and got["d2"].net_pnl == 0.0 and got["d2"].cash_notional == 200.0


def test_bootstrap_is_reproducible_and_centred(spark):
    data = [("q", "p", f"2024-{m:02d}-15", float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(data, "policy string, pool string, date string, v double")
    a = P.month_bootstrap(df, "v", 400, 7).first()
    b = P.month_bootstrap(df.repartition(5), "v", 400, 7).first()
    assert a == b and a.observed_bps == 78.0 and a.p05_bps < 78.0 < a.p95_bps and a.samples == 400


def test_replay_gives_rows_without_industry_nothing_and_refill_does(spark):
    from tickloom.operators.execution import Execution, replay, visible_refill

    rows = [("p", "d", 1, "a", None, 100.0, 1, 0.9), ("p", "d", 1, "b", "tech", 100.0, 2, 0.8)]
    names = "pool string, date string, decision int, symbol string, industry string, allocated_notional double, rank int, score double"
    df = spark.createDataFrame(rows, names).withColumns(
        {"target_notional": F.lit(1000.0), "row_limit": F.lit(100.0)}
    )
    rules = Execution(industry_cap=500.0, industry="industry")
    assert {r.symbol: r.allocated_notional for r in replay(df, rules).collect()} == {"b": 100.0}
    refilled = visible_refill(df, rules, 1000.0, "score").collect()
    assert {r.symbol: r.allocated_notional for r in refilled} == {"a": 100.0, "b": 100.0}
