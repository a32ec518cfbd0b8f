"""Sequential allocation of a day under shared budgets.

Each allocation depends on the budgets left by all earlier ones of its day, so a
day is worked through in order. Days (or, without shared day budgets, decisions)
are independent: Spark partitions by them and sorts inside partitions, and the
task reads the sorted rows batch by batch, keeping only the budgets in memory,
never the rows of a group. Rows that could not receive anything even with full
budgets are dropped before the shuffle.

A day above ``tickloom.groupRows`` rows is no task for one worker. Its allocations
are the fixed point of "what is left after all earlier rows of the last guess":
prefix sums per decision, symbol and industry over blocks of the day, repeated
until no row changes. A row is right once all rows before it are, so there is one
fixed point and every round settles more rows; in practice a round settles
everything up to the next budget that runs out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import BPS, finite, sum_present
from tickloom.operators.checks import tradable
from tickloom.operators.groups import attach, carry, group_rows, hot_groups, over, position
from tickloom.session import checkpoint


@dataclass(frozen=True)
class Execution:
    """Budgets and rules. A cap of 0 means none."""

    symbol_cap: float = 0.0
    industry_cap: float = 0.0
    industry: str | None = None
    industry_per_decision: bool = False
    fill_rate: float = 1.0
    lot_shares: float = 0.0
    price: str | None = None
    min_child: float = 0.0
    max_names: int = 0
    max_decisions: int = 0
    depth: str | None = None
    depth_share: float = 0.0
    stop_at: float = 0.0

    def shares_day(self) -> bool:
        """Whether budgets cross the decisions of a day."""
        crossing = self.industry_cap > 0 and not self.industry_per_decision
        return self.symbol_cap > 0 or crossing or self.max_decisions > 0


def context_columns(df: DataFrame, levels: int = 10) -> DataFrame:
    """Price, spread and ask depth notional, derived where absent."""
    has = set(df.columns)
    out = {}
    if "capacity_price" not in has and "ask_price_1" in has:
        out["capacity_price"] = finite("ask_price_1")
    if "spread_bps" not in has and {"ask_price_1", "bid_price_1"} <= has:
        mid = (finite("ask_price_1") + finite("bid_price_1")) / 2.0
        out["spread_bps"] = F.when(mid > 0, (finite("ask_price_1") - finite("bid_price_1")) / mid * BPS)
    if "ask_depth_notional" not in has:
        if {"ask_depth_10", "ask_price_1"} <= has:
            out["ask_depth_notional"] = finite("ask_depth_10") * finite("ask_price_1")
        else:
            pairs = [(f"ask_price_{k}", f"ask_volume_{k}") for k in range(1, levels + 1)]
            present = [finite(p) * finite(v) for p, v in pairs if {p, v} <= has]
            if present:
                out["ask_depth_notional"] = sum_present(present)
    return df.withColumns(out)


HELPERS = ["_limit", "_target", "_price", "_symbol", "_sector"]


def _walk(rules: Execution, day: list[str], group: list[str]):
    """The batch loop: per row, the least of its own limit and the budgets left."""

    def allocate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day_now = group_now = None
        left = 0.0
        names = 0
        symbols: dict = {}
        industries: dict = {}
        decisions: dict = {}
        for batch in batches:
            given = np.zeros(len(batch))
            order = np.zeros(len(batch), dtype="int64")
            limit, target = batch["_limit"].to_numpy(), batch["_target"].to_numpy()
            price, symbol, sector = batch["_price"].to_numpy(), batch["_symbol"].to_numpy(), batch["_sector"].to_numpy()
            # where a decision's rows begin in the batch
            keys = [batch[c].to_numpy() for c in group]
            new = np.ones(len(batch), dtype=bool)
            if len(batch):
                new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = [*np.flatnonzero(new).tolist(), len(batch)]
            for start, end in zip(starts, starts[1:]):
                key_now = tuple(k[start] for k in keys)
                if key_now[: len(day)] != day_now:
                    day_now, symbols, decisions = key_now[: len(day)], {}, {}
                    if not rules.industry_per_decision:
                        industries = {}
                if key_now != group_now:
                    group_now, left, names = key_now, target[start], 0
                    if rules.industry_per_decision:
                        industries = {}
                for i in range(start, end):
                    # nothing is left for the rest of the decision
                    if (rules.max_names and names >= rules.max_names) or left <= rules.stop_at:
                        break
                    s, key = symbol[i], sector[i]
                    seen = decisions.get(s)
                    if rules.max_decisions and seen and seen[1] != group_now and seen[0] >= rules.max_decisions:
                        continue
                    amount = min(limit[i], max(0.0, left))
                    if rules.symbol_cap > 0:
                        amount = min(amount, max(0.0, symbols.get(s, rules.symbol_cap)))
                    if rules.industry_cap > 0:
                        amount = min(amount, max(0.0, industries.get(key, rules.industry_cap)))
                    amount *= rules.fill_rate
                    if rules.lot_shares > 0 and not math.isnan(price[i]):
                        whole = math.floor(amount / price[i] / rules.lot_shares) if price[i] > 0 else 0
                        amount = whole * rules.lot_shares * price[i]
                    if amount <= 0 or (rules.min_child > 0 and amount < rules.min_child):
                        continue
                    given[i] = amount
                    names += 1
                    order[i] = names
                    left = max(0.0, left - amount)
                    if rules.symbol_cap > 0:
                        symbols[s] = max(0.0, symbols.get(s, rules.symbol_cap) - amount)
                    if rules.industry_cap > 0:
                        industries[key] = max(0.0, industries.get(key, rules.industry_cap) - amount)
                    if rules.max_decisions:
                        count = seen[0] if seen else 0
                        decisions[s] = (count + (not seen or seen[1] != group_now), group_now)
            kept = given > 0
            out = batch.loc[kept].drop(columns=HELPERS)
            yield out.assign(allocated_notional=given[kept], allocation_order=order[kept])

    return allocate


def sequential_allocation(
    rows: DataFrame,
    rules: Execution,
    day: Sequence[str],
    decision: str,
    order: Sequence[str],
    limit: str,
    target: str,
    symbol: str = "symbol",
) -> DataFrame:
    """Walk the rows of a day in (decision, order) and allocate under what is left.

    Returns the rows that got something, with ``allocated_notional`` and ``allocation_order``.
    """
    own = finite(limit)
    if rules.depth and rules.depth in rows.columns and rules.depth_share > 0:
        depth = finite(rules.depth)
        own = F.least(own, F.when(depth > 0, depth * rules.depth_share).when(depth <= 0, 0.0))
    price = finite(rules.price) if rules.price and rules.price in rows.columns else F.lit(None).cast("double")
    sector = F.col(rules.industry).cast("string") if rules.industry else F.lit("")
    marked = rows.withColumns(
        {
            "_limit": own,
            "_target": finite(target),
            "_price": F.coalesce(price, F.lit(float("nan"))),
            "_symbol": F.col(symbol).cast("string"),
            "_sector": F.coalesce(sector, F.lit("nan")),
        }
    ).drop("allocated_notional", "allocation_order")
    # the most a row can get, whatever the budgets: less than the smallest child means never
    best = F.col("_limit") * rules.fill_rate
    if rules.lot_shares > 0:
        p = F.when(F.col("_price") > 0, F.col("_price"))
        lots = F.floor(best / p / rules.lot_shares) * rules.lot_shares * p
        best = F.when(F.isnan("_price"), best).otherwise(F.coalesce(lots, F.lit(0.0)))
    able = (best > 0) & (best >= rules.min_child * (1.0 - 1e-12))
    able_rows = marked.where(able)
    unit = list(day) if rules.shares_day() else [*day, decision]
    # all rows are counted first: their plan is short, that of the filtered rows holds every limit's formula several times
    hot = None if hot_groups(rows, unit) is None else hot_groups(able_rows, unit)
    small = able_rows if hot is None else able_rows.join(hot, unit, "left_anti")
    lined = small.repartition(*unit).sortWithinPartitions(*day, decision, *order)
    fields = [f for f in able_rows.schema.fields if f.name not in HELPERS]
    schema = T.StructType(
        [*fields, T.StructField("allocated_notional", T.DoubleType()), T.StructField("allocation_order", T.LongType())]
    )
    walked = lined.mapInPandas(_walk(rules, list(day), [*day, decision]), schema)
    if hot is None:
        return walked
    large = able_rows.join(hot.select(*unit), unit, "left_semi")
    return walked.unionByName(_settle(large, rules, day, decision, order, unit).select(walked.columns))


def _before(rows: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Sums of columns over the earlier rows of the same keys: within a block, plus the totals of earlier blocks."""
    inside = over([*keys, "_block"], ["_at"]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = over(keys, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"{out}_all") for out, c in sums.items()])
    totals = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"{out}_all").over(earlier), F.lit(0.0)).alias(f"{out}_all") for out in sums])
    own = rows.withColumns({out: F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for out, c in sums.items()})
    joined = attach(own, totals, [*keys, "_block"])
    return joined.withColumns({out: F.col(out) + F.col(f"{out}_all") for out in sums}).drop(*[f"{out}_all" for out in sums])


def _settle(rows: DataFrame, rules: Execution, day: Sequence[str], decision: str, order: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Rounds over blocks of hot units until no allocation changes; see the module's description."""
    group = [*day, decision]
    rows = checkpoint(position(rows, unit, [*([decision] if decision not in unit else []), *order], out="_at"))
    narrow = rows.select(*group, "_at", *HELPERS).withColumns(
        {"_block": F.floor(F.col("_at") / group_rows(rows)), "_amount": F.col("_limit")}
    )
    price = F.col("_price")
    while True:
        work = narrow.withColumn("_got", (F.col("_amount") > 0).cast("double"))
        work = _before(work, group, {"_spent": "_amount", "_names": "_got"})
        able = (F.col("_target") - F.col("_spent")) > rules.stop_at
        amount = F.least("_limit", F.greatest(F.lit(0.0), F.col("_target") - F.col("_spent")))
        if rules.max_names:
            able = able & (F.col("_names") < rules.max_names)
        if rules.symbol_cap > 0:
            work = _before(work, [*day, "_symbol"], {"_symbol_spent": "_amount"})
            amount = F.least(amount, F.greatest(F.lit(0.0), F.lit(rules.symbol_cap) - F.col("_symbol_spent")))
        if rules.industry_cap > 0:
            scope = group if rules.industry_per_decision else list(day)
            work = _before(work, [*scope, "_sector"], {"_sector_spent": "_amount"})
            amount = F.least(amount, F.greatest(F.lit(0.0), F.lit(rules.industry_cap) - F.col("_sector_spent")))
        if rules.max_decisions:
            # the first row that a symbol gets in a decision counts the decision
            work = _before(work, [*group, "_symbol"], {"_here": "_got"})
            work = work.withColumn("_first", F.when(F.col("_here") == 0, F.col("_got")).otherwise(0.0))
            work = _before(work, [*day, "_symbol"], {"_decisions": "_first"})
            able = able & ((F.col("_here") > 0) | (F.col("_decisions") < rules.max_decisions))
        amount = amount * rules.fill_rate
        if rules.lot_shares > 0:
            lots = F.floor(amount / price / rules.lot_shares).cast("double") * rules.lot_shares * price
            amount = F.when(F.isnan(price), amount).when(price > 0, lots).otherwise(0.0)
        good = able & (amount > 0) & (amount >= rules.min_child)
        made = work.select(*narrow.columns[:-1], "_names", F.col("_amount").alias("_last"), F.when(good, amount).otherwise(0.0).alias("_amount"))
        made = checkpoint(made)
        moved = F.abs(F.col("_amount") - F.col("_last")) > 1e-9 * F.greatest(F.lit(1.0), F.col("_last"))
        if made.where(moved).isEmpty():
            break
        narrow = made.drop("_names", "_last")
    given = made.where("_amount > 0").select(
        *unit, "_at", F.col("_amount").alias("allocated_notional"), (F.col("_names") + 1).cast("long").alias("allocation_order")
    )
    return rows.join(given, [*unit, "_at"])


def replay(
    selected: DataFrame,
    rules: Execution,
    day: Sequence[str] = ("pool", "date"),
    decision: str = "decision",
    symbol: str = "symbol",
    **eligibility,
) -> DataFrame:
    """Replay given allocations in rank order; what does not fit is lost, nothing refills it.

    Under an industry cap a row without an industry has no budget and gets nothing.
    """
    rows = selected.withColumns(
        {
            "original_allocated_notional": F.col("allocated_notional"),
            "_r": F.coalesce(finite("rank"), F.lit(1e12)),
            "_s": -F.coalesce(finite("score"), F.lit(float("-inf"))),
        }
    ).where(tradable(selected, **eligibility) & (F.col("allocated_notional") > 0))
    # the group's target is that of its first row in rank order
    first = rows.groupBy(*day, decision).agg(
        F.min_by(finite("target_notional"), F.struct("_r", "_s", symbol)).alias("_group_target")
    )
    rows = attach(rows, first, [*day, decision])
    if rules.industry_cap > 0 and rules.industry:
        # only industries that are named have a budget here
        rows = rows.where(F.col(rules.industry).isNotNull())
    done = sequential_allocation(
        rows, rules, day, decision, ["_r", "_s", symbol], "allocated_notional", "_group_target", symbol
    )
    return done.drop("_r", "_s", "_group_target")


def visible_refill(
    candidates: DataFrame,
    rules: Execution,
    target: float,
    score: str,
    day: Sequence[str] = ("pool", "date"),
    decision: str = "decision",
    limit: str = "row_limit",
    symbol: str = "symbol",
    unique: Sequence[str] = (),
    **eligibility,
) -> DataFrame:
    """Allocate from the full visible ranking of eligible candidates, with day-level budgets.

    Rows without an industry share one industry budget; a target counts as filled from 1e-9 left on.
    """
    rules = replace(rules, stop_at=max(rules.stop_at, 1e-9))
    rows = carry(candidates.dropna(subset=[score]).withColumn("_s", -F.col(score)), candidates)
    if rules.shares_day() and hot_groups(rows, list(day)) is None:
        rows = carry(rows, rows, list(day))  # days that fit a task, counted before any formula
    tie = list(unique) or [symbol]
    ranked = position(rows, [*day, decision], ["_s", *tie], out="candidate_rank")
    eligible = ranked.where(tradable(ranked, **eligibility) & (F.col(limit) > 0)).withColumn(
        "_group_target", F.lit(float(target))
    )
    eligible = carry(eligible, ranked)
    done = sequential_allocation(eligible, rules, day, decision, ["candidate_rank"], limit, "_group_target", symbol)
    return done.drop("_s", "_group_target")


def refill_groups(candidates: DataFrame, refilled: DataFrame, keys: Sequence[str], score: str, limit: str, target: float, **eligibility) -> DataFrame:
    """Per group: candidates, eligible and selected rows, fill and ranks reached."""
    rows = candidates.dropna(subset=[score])
    ok = tradable(rows, **eligibility) & (F.col(limit) > 0)
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_rows"), F.count_if(ok).alias("eligible_rows"))
    chosen = refilled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("allocated_notional").alias("_a"),
        F.max("candidate_rank").alias("max_candidate_rank"), F.avg("candidate_rank").alias("mean_candidate_rank"),
    )
    amount = F.coalesce("_a", F.lit(0.0))
    return attach(base, chosen, keys).select(
        *keys, "candidate_rows", "eligible_rows", F.coalesce("_n", F.lit(0)).alias("selected_rows"), amount.alias("allocated_notional"),
        F.greatest(F.lit(target) - amount, F.lit(0.0)).alias("cash_notional"), (amount / target).alias("fill_ratio"),
        (amount >= target * (1.0 - 1e-9)).alias("filled"), "max_candidate_rank", "mean_candidate_rank",
    )
