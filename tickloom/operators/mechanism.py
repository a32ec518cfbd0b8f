"""Dimensionless feature values chosen by the kind of quantity a column name stands for."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import BPS, finite, log_positive, safe_div, signed_log
from tickloom.operators.cross import replace_values

# fixed values: name fragments of quantities that carry no unit
UNITLESS = (
    "_bps",
    "bps_",
    "return",
    "imbalance",
    "ratio",
    "_rel_",
    "_from_open_rel",
    "_share_",
    "share_depth",
    "concentration",
    "position",
    "_flag",
    "_zscore",
    "_rank",
    "_slope",
    "replenish_vs_trade",
    "to_ask_depth10",
    "to_bid_depth10",
    "to_ask1",
    "to_bid1",
    "turnover_to_depth_notional",
)

# fixed values: reference columns, the first with any positive value in the table is used
PRICES = ("ask_price_1", "mid_price", "preopen_last_price", "avg_ask_price")
CAPS = ("market_cap", "total_market_cap", "mkt_cap", "total_mkt_cap", "float_market_cap")
SHARES = (
    "total_shares", "shares_outstanding", "total_share", "share_capital", "float_shares", "circulating_shares", "free_float_shares",
)

# fixed values: how the names of columns of either side of the book begin
SIDES = ("ask", "bid", "postopen_ask", "postopen_bid", "postopen_v2_ask", "postopen_v2_bid")

# fixed values: whole names by kind of quantity
NAMES = {
    "count": ("trade_num", "total_ask_count", "total_bid_count"),
    "depth": ("total_ask_volume", "total_bid_volume"),
    "traded": ("preopen_volume",),
    "notional": ("preopen_turnover",),
}

# fixed values: beginnings of names by kind of quantity
PREFIXES = {
    "count": tuple(f"{side}_count_" for side in SIDES),
    "level": tuple(f"{side}_volume_" for side in SIDES),
    "depth": (*(f"{side}_depth_" for side in SIDES), "path_shape_depth_", "path_shape_bid_depth_", "path_shape_ask_depth_"),
    "traded": ("volume_diff_", "postopen_volume_", "postopen_v2_volume_"),
    "notional": ("turnover_diff_", "postopen_turnover_", "postopen_v2_turnover_"),
}

# fixed values: price columns whatever fragments their names contain
RAW_PRICES = (
    "ask_price_1",
    "bid_price_1",
    "mid_price",
    "avg_ask_price",
    "avg_bid_price",
    "preopen_last_price",
    "preopen_price_min",
    "preopen_price_max",
)

# fixed values: columns measured in a unit of their own
UNITS = {"exch_time_offset_us": "clock", "postopen_minutes_since_0930": "minutes", "spread_abs": "spread"}

# a price move is the difference of a price, to an earlier state or to the open
MOVE = re.compile(r"(?:^|_)(?:ask_price_1|bid_price_1|mid_price|price)(?:_from_open)?_diff")


def kinds_of(name: str) -> set[str]:
    """All kinds of quantity a column name stands for."""
    n = name.lower()
    found = {kind for kind, names in NAMES.items() if n in names}
    found |= {kind for kind, prefixes in PREFIXES.items() if n.startswith(prefixes)}
    if n in UNITS:
        found.add(UNITS[n])
    if n.startswith("hist_surprise_") and n.removeprefix("hist_surprise_").endswith("_ratio"):
        found.add("history")
    if any(mark in n for mark in UNITLESS):
        found.add("unitless")
    scaled = "_rel_" in n or n.endswith("_rel") or "_bps" in n
    if MOVE.search(n) and not scaled:
        found |= {"price", "price_move"}
    if n.startswith("trade_vwap_") or ("price" in n and ("unitless" not in found or n in RAW_PRICES)):
        found.add("price")
    return found


def changed_columns(columns: Sequence[str]) -> list[str]:
    """Columns that the strict ratio version rewrites."""
    kinds = {c: kinds_of(c) for c in columns}
    return [c for c, found in kinds.items() if found and not found & {"unitless", "history"}]


def _positive(v: Column) -> Column:
    return F.when(v > 0, v)


class References:
    """Denominators as columns. Which fallback column serves is decided for the whole table: by flags, one row over the
    columns that the wanted values ask for, which is joined to the rows in the same plan."""

    def __init__(self, columns: Sequence[str]):
        self.has = set(columns)
        self.flags: dict[str, Column] = {}

    def _flag(self, name: str, test: Column) -> Column:
        self.flags[name] = test
        return F.coalesce(F.col(name), F.lit(False))

    def known(self, c: str) -> Column:
        """Whether any row has a value."""
        return self._flag(f"_known_{c}", F.count(finite(c)) > 0)

    def served(self, c: str) -> Column:
        """Whether any row has a positive value."""
        return self._flag(f"_served_{c}", F.max(finite(c) > 0))

    def column(self, c: str) -> Column:
        return _positive(finite(c)) if c in self.has else F.lit(None).cast("double")

    def choice(self, names: Sequence[str]) -> list[tuple[Column, Column]]:
        """The first of some columns with any positive value: guarded values."""
        return [(self.served(c), self.column(c)) for c in names if c in self.has]

    def activity(self, kind: str) -> list[tuple[Column, Column]]:
        return self.choice([f"hist_avg_daily_{kind}_{w}d" for w in (60, 20, 120)])

    def history(self, name: str) -> list[tuple[Column, Column]]:
        named = [f"hist_surprise_{name}_{w}d_ratio" for w in (20, 60)]
        return [(self.known(c), log_positive(c)) for c in named if c in self.has]

    @property
    def mid(self) -> Column:
        sides = [finite(c) if c in self.has else F.lit(None).cast("double") for c in ("ask_price_1", "bid_price_1")]
        middle = _positive((sides[0] + sides[1]) / 2.0)
        return first_of([(self.known("mid_price"), self.column("mid_price"))], middle) if "mid_price" in self.has else middle

    @property
    def price(self) -> Column:
        return first_of(self.choice(PRICES))

    @property
    def shares(self) -> Column:
        priced = reduce(lambda a, b: a | b, [test for test, _ in self.choice(PRICES)], F.lit(False))
        worth = [(test & priced, safe_div(cap, self.price)) for test, cap in self.choice(CAPS)]
        return first_of([*self.choice(SHARES), *worth, *self.activity("volume")])

    @property
    def market_cap(self) -> Column:
        return first_of([*self.choice(CAPS), *self.activity("turnover")], self.shares * self.price)

    def of_side(self, name: str, ask: Column, bid: Column, both: Column) -> Column:
        side = re.match(r"^(?:postopen_(?:v2_)?|total_)?(ask|bid)_", name)
        return _positive({"ask": ask, "bid": bid, None: both}[side and side.group(1)])


def first_of(guarded: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first guard that holds."""
    out = otherwise if otherwise is not None else F.lit(None).cast("double")
    for test, value in reversed(guarded):
        out = F.when(test, value).otherwise(out)
    return out


@dataclass(frozen=True)
class Value:
    """A column to be rewritten: its name, kinds and value, and what it can be measured against."""

    name: str
    kinds: set[str]
    v: Column
    refs: References
    tick: float

    def depth(self) -> Column:
        ask, bid = self.refs.column("ask_depth_10"), self.refs.column("bid_depth_10")
        return self.refs.of_side(self.name, ask, bid, (ask + bid) / 2.0)

    def orders(self) -> Column:
        ask, bid = self.refs.column("total_ask_count"), self.refs.column("total_bid_count")
        if self.name == "trade_num" or self.name.startswith("total_"):
            return _positive(ask + bid)
        return self.refs.of_side(self.name, ask, bid, ask + bid)


# how a price is quoted in bps: what is measured, and against what
QUOTES = {
    "middle": lambda x: (F.lit(x.tick), _positive(x.v)),
    "bid": lambda x: (x.refs.mid - x.v, x.refs.mid),
    "paid": lambda x: (x.v - x.refs.price, x.refs.price),
    "move": lambda x: (x.v, x.refs.price),
    "level": lambda x: (x.v - x.refs.mid, x.refs.mid),
}
QUOTED = {"mid_price": "middle", "bid_price_1": "bid"}


def quoted(x: Value) -> Column:
    usual = "paid" if x.name.startswith("trade_vwap_") else "move" if "price_move" in x.kinds else "level"
    return safe_div(*QUOTES[QUOTED.get(x.name, usual)](x)) * BPS


# one formula per way to lose a unit; a list holds guarded values, and what follows in the version's list serves otherwise
FORMULAS: dict[str, Callable[[Value], Column | list[tuple[Column, Column]]]] = {
    "keep": lambda x: x.v,
    "seconds": lambda x: x.v / 1e6,
    "ten minutes of the session": lambda x: (x.v - 34_200_000_000.0) / 600_000_000.0,
    "tens": lambda x: x.v / 10.0,
    "ticks": lambda x: x.v / x.tick,
    "bps": quoted,
    "log count": lambda x: F.when(x.v.isNotNull(), F.log1p(F.greatest(x.v, F.lit(0.0)))),
    "log": lambda x: log_positive(x.v),
    "signed log": lambda x: signed_log(x.v),
    "log of notional": lambda x: signed_log(x.v * x.refs.price),
    "log of own history": lambda x: x.refs.history(x.name),
    "of side depth": lambda x: safe_div(x.v, x.depth()),
    "of side orders": lambda x: safe_div(x.v, x.orders()),
    "of shares": lambda x: safe_div(x.v, x.refs.shares),
    "of shares or value": lambda x: F.coalesce(safe_div(x.v, x.refs.shares), safe_div(x.v * x.refs.price, x.refs.market_cap)),
    "of market value": lambda x: safe_div(x.v, x.refs.market_cap),
}

# fixed values: per version, which formula serves which kind; the first kind that a column has decides
VERSIONS = {
    1: (
        ("clock", "seconds"), ("spread", "ticks"), ("count", "log count"), ("unitless", "keep"), ("price", "bps"), ("traded", "log of notional"),
        ("level", "of side depth"), ("depth", "of side depth"), ("notional", "signed log"),
    ),
    2: (
        ("clock", "seconds"), ("history", "log"), ("spread", "ticks"), ("count", "log of own history"), ("count", "log count"), ("price", "bps"),
        ("depth", "log of notional"), ("level", "of side depth"), ("unitless", "keep"), ("traded", "log of own history"), ("traded", "signed log"),
        ("notional", "signed log"),
    ),
    3: (
        ("clock", "ten minutes of the session"), ("minutes", "tens"), ("unitless", "keep"), ("history", "keep"), ("spread", "ticks"), ("price", "bps"),
        ("level", "of side depth"), ("depth", "of shares or value"), ("traded", "of shares"), ("notional", "of market value"), ("count", "of side orders"),
    ),
}


def unit_free(x: Value, version: int) -> Column:
    """The value by the version's list; what no kind covers stays as it is."""
    guarded: list[tuple[Column, Column]] = []
    for kind, formula in VERSIONS[version]:
        if kind in x.kinds:
            made = FORMULAS[formula](x)
            if not isinstance(made, list):
                return first_of(guarded, made)
            guarded += made
    return first_of(guarded, x.v)


def mechanism_values(
    df: DataFrame,
    columns: Sequence[str],
    version: int,
    keys: Sequence[str] = (),
    cross_section: str = "none",
    tick: float = 0.01,
    method: str = "average",
) -> DataFrame:
    """Replace columns by unit-free values in one projection; optionally rank or scale them per group.

    Where a value depends on which reference columns are in use, one aggregate row over just those columns joins in.
    """
    names = [c for c in dict.fromkeys(columns) if c in df.columns]
    refs = References(df.columns)
    out = {c: finite(unit_free(Value(c.lower(), kinds_of(c), finite(c), refs, tick), version)).cast("float") for c in names}
    # a single row of flags, whatever the table
    rows = df.crossJoin(F.broadcast(df.agg(*[test.alias(name) for name, test in refs.flags.items()]))) if refs.flags else df
    done = rows.withColumns(out).select(*df.columns)
    return done if cross_section == "none" else replace_values(done, names, keys, cross_section, method)


def model_input(
    df: DataFrame,
    columns: Sequence[str],
    transform: str,
    keys: Sequence[str],
    output: str = "replace",
    prefix: str = "xf_",
    version: int | None = None,
) -> DataFrame:
    """Value transform for model input, replacing the columns or appended under a prefix."""
    def apply(frame: DataFrame, names: Sequence[str]) -> DataFrame:
        if version is not None:
            return mechanism_values(frame, names, version, keys, transform)
        return replace_values(frame, names, keys, transform)

    if output == "replace":
        return apply(df, columns)
    if output != "append":
        raise ValueError("output is replace or append")
    saved = df.withColumns({f"_keep_{c}": F.col(c) for c in columns})
    done = apply(saved, columns)
    new = {f"{prefix}{c}": F.col(c) for c in columns}
    back = {c: F.col(f"_keep_{c}") for c in columns}
    return done.withColumns(new).withColumns(back).select(*df.columns, *new)
