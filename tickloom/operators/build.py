"""A day's rows from a declared set of feature families: one plan for all days."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.cross import rank_share
from tickloom.operators.decision import sample_decisions
from tickloom.operators.features import attach_auction, order_book, price_scale
from tickloom.operators.path import auction_summary, momentum, tick_differences
from tickloom.operators.reference import attach_reference, calendar, lagged_reference

STATES, ROWS = "states", "rows"  # before and after sampling at the decision clocks


@dataclass(frozen=True)
class Family:
    """Columns that are built together: what they read, what they give, and when."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    stage: str = STATES


@dataclass(frozen=True)
class DayBuild:
    """What to build. Families may be listed in any order; those that nothing wanted reads are not built."""

    clocks: Sequence[str]
    wanted: Sequence[str]
    families: Sequence[Family]
    keys: Sequence[str] = ("date", "symbol")
    time: str = "t"
    order: Sequence[str] = ("seq",)
    max_state_age_seconds: float | None = None
    source_cutoff_seconds: float = 0.0
    sampling: dict = field(default_factory=dict)


def resolve(families: Sequence[Family], available: Sequence[str], wanted: Sequence[str]) -> list[Family]:
    """The families that the wanted columns need, each behind those it reads from and states before rows.

    A column that two families give, that none gives, or that is needed for itself is an error, and so is a family on
    states that reads from one on rows.
    """
    giver: dict[str, Family] = {}
    for family in families:
        for c in family.gives:
            if c in giver or c in available:
                raise ValueError(f"column {c} of family {family.name} is given twice")
            giver[c] = family
    done: list[Family] = []

    def visit(column: str, path: tuple[str, ...]) -> None:
        if column in available:
            return
        family = giver.get(column)
        if family is None:
            raise ValueError(f"no family gives column {column}" + (f", which {path[-1]} needs" if path else ""))
        if family in done:
            return
        if family.name in path:
            raise ValueError("families need each other: " + " -> ".join([*path, family.name]))
        for c in family.needs:
            visit(c, (*path, family.name))
            if family.stage == STATES and c in giver and giver[c].stage == ROWS:
                raise ValueError(f"family {family.name} is built before sampling, column {c} after it")
        done.append(family)

    for c in wanted:
        visit(c, ())
    return sorted(done, key=lambda f: f.stage == ROWS)


def build_days(states: DataFrame, config: DayBuild) -> DataFrame:
    """States of any days -> one row per key and decision clock with the wanted columns.

    Families on states run in order on whole paths, then the last state at each clock is taken with just the columns that
    are still read, then families on rows run. Days are partitions of one plan: nothing loops over them.
    """
    ordered = resolve(config.families, states.columns, config.wanted)
    before = [f for f in ordered if f.stage == STATES]
    after = [f for f in ordered if f.stage == ROWS]
    out = states
    for family in before:
        out = family.build(out)
    given = {c for f in after for c in f.gives}
    read = [*config.wanted, *[c for f in after for c in f.needs]]
    fixed = {*config.keys, config.time, "decision_time", "target"}
    values = [c for c in dict.fromkeys(read) if c not in given and c not in fixed]
    rows = sample_decisions(
        out, config.clocks, values, by=list(config.keys), time=config.time, seq=list(config.order),
        max_state_age_seconds=config.max_state_age_seconds, source_cutoff_seconds=config.source_cutoff_seconds, **config.sampling,
    )
    for family in after:
        rows = family.build(rows)
    return rows.select(*dict.fromkeys([*config.keys, "decision_time", *config.wanted]))


def reference_family(reference: DataFrame, values: dict[str, float], sessions: int = 1, date: str = "date", symbol: str = "symbol") -> Family:
    """Daily values of an earlier session."""
    gives = (*values, "reference_date")

    def build(df: DataFrame) -> DataFrame:
        lagged = lagged_reference(calendar(reference, date), reference, values, sessions, date, symbol)
        return attach_reference(df, lagged.select(date, symbol, *gives), date, symbol)

    return Family("reference", (date, symbol), gives, build)


def book_family(columns: Sequence[str], sample: DataFrame) -> Family:
    """Spread, depth and imbalance of the visible book, as far as ``sample`` has its levels."""
    gives = [c for c in order_book(sample).columns if c not in sample.columns]
    return Family("book", tuple(columns), tuple(gives), order_book)


def trade_family(keys: Sequence[str], order: Sequence[str], volume: str, turnover: str, lags: Sequence[int] = (1,)) -> Family:
    """Traded volume, average price and return over the last states."""
    gives = [f"{c}_{k}t" for k in lags for c in ("volume_diff", "turnover_diff", "trade_vwap", "return")]

    def build(df: DataFrame) -> DataFrame:
        made = momentum(tick_differences(df, keys, order, volume, turnover, lags), keys, order, lags)
        return made.select(*df.columns, *[c for c in gives if c in made.columns])

    return Family("trade", (volume, turnover), tuple(gives), build)


def auction_family(keys: Sequence[str], order: Sequence[str], in_auction, volume: str, turnover: str, gives: Sequence[str], needs: Sequence[str]) -> Family:
    """Summary of the states before the open, on every state of the day."""

    def build(df: DataFrame) -> DataFrame:
        made = attach_auction(df, auction_summary(df, keys, order, in_auction, volume, turnover), keys)
        return made.select(*df.columns, *gives)

    return Family("auction", (volume, turnover, *needs), tuple(gives), build)


def price_family(gives: Sequence[str], price: str = "ask_price_1", **options) -> Family:
    """Price level and what is measured in ticks."""

    def build(df: DataFrame) -> DataFrame:
        return price_scale(df, price, **options).select(*df.columns, *gives)

    return Family("price", (price,), tuple(gives), build, ROWS)


def rank_family(columns: dict[str, str], keys: Sequence[str]) -> Family:
    """Shares of rank within a cross-section: ``{out: column}``."""

    def build(df: DataFrame) -> DataFrame:
        for out, c in columns.items():
            df = rank_share(df, list(keys), c, out)
        return df

    return Family("rank", tuple(columns.values()), tuple(columns), build, ROWS)


def column_family(name: str, needs: Sequence[str], made: dict, stage: str = STATES) -> Family:
    """Columns from an expression each."""
    return Family(name, tuple(needs), tuple(made), lambda df: df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in made.items()}), stage)
