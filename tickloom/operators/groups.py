"""Grouped and ordered computations that hold when one group has a third of all rows.

A plain window keeps a whole group in one task. Every function here first asks
(with a map-side combined count over the key columns alone) whether some group
has more rows than one task should hold, ``tickloom.groupRows``:

* no: one window over the keys, one shuffle;
* yes: rows of the large groups are cut into blocks that follow the order, each
  block is worked on alone, and small per-block partials carry the state across.
  Small groups stay whole, as block 0. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import checkpoint

GROUP_ROWS = "tickloom.groupRows"
DEFAULT_GROUP_ROWS = 5_000_000
FAN = 256  # blocks' worth of rows that one level of cut points parts
SAMPLES_PER_BLOCK = 16
# Spark's default spark.sql.optimizer.windowGroupLimitThreshold
GROUP_LIMIT = 1_000
# internal column names share a prefix that callers do not use
BLOCK = "_gk_block"
ROWS = "_gk_rows"


def group_rows(df: DataFrame) -> int:
    """Rows that one window task may hold."""
    return int(df.sparkSession.conf.get(GROUP_ROWS, str(DEFAULT_GROUP_ROWS)))


def over(keys: Sequence[str], order: Sequence[str | Column] = ()) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def known(df: DataFrame) -> tuple[int, frozenset[frozenset[str]]]:
    """Key sets already measured as free of hot groups, with the limit they were measured at."""
    return getattr(df, "_measured", (group_rows(df), frozenset()))


def carry(new: DataFrame, old: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Hand on what was measured on ``old`` to a frame with the same rows or fewer."""
    limit, cold = known(old)
    new._measured = (limit, cold | ({frozenset(keys)} if keys is not None else frozenset()))
    return new


def carry_copies(new: DataFrame, old: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Hand on the sizes of groups of ``old`` to a frame with each of its rows at most once per value of the new column
    ``name``: no group by keys and name is larger than the one by keys. Only the narrower frame is counted, if at all."""
    if hot_groups(old, keys) is None:
        new._measured = (group_rows(old), frozenset({frozenset([*keys, name])}))
    return new


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Groups above the row limit with their size, or None when there are none."""
    limit = group_rows(df)
    measured_at, cold = known(df)
    # finer keys than a measured set cannot have larger groups
    if measured_at == limit and any(c <= frozenset(keys) for c in cold):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gk_rows")).where(F.col("_gk_rows") > limit)
    return None if counts.isEmpty() else counts


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table that has one row per key.

    No broadcast is forced: Spark broadcasts the side when its measured size is
    below the threshold, else it sorts and merges and splits skewed partitions.
    """
    return df.join(side, list(keys), how) if keys else df.crossJoin(side)


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_block``: consecutive pieces of each hot group along ``order`` (ascending).

    Pieces are cut in levels of at most ``2 * FAN`` cut points, so that neither a row nor a task ever sees more points than
    that times ``SAMPLES_PER_BLOCK``; a group of any size gets as many levels as it needs. The points come from a hashed
    sample of the group, so they only shape the pieces; results do not depend on them.
    """
    limit = group_rows(df)
    # read several times below and by the caller: compute it once, through the shared folder
    df = checkpoint(df)
    hot = checkpoint(hot)
    out = _split(df, keys, order, hot, limit).withColumn(BLOCK, F.coalesce(BLOCK, F.lit(0)).cast("long"))
    largest = hot.agg(F.max(ROWS)).first()[0]
    finer = [*keys, "_gk_coarse"]
    while largest > FAN * limit:
        coarse = checkpoint(out.withColumnRenamed(BLOCK, "_gk_coarse"))
        large = checkpoint(coarse.groupBy(*finer).agg(F.count(F.lit(1)).alias(ROWS)).where(F.col(ROWS) > FAN * limit))
        before, largest = largest, large.agg(F.max(ROWS)).first()[0] or 0
        if largest in (0, before):  # nothing is too large, or equal places cannot be parted
            break
        code = F.col("_gk_coarse") * (2 * FAN + 1) + F.coalesce(BLOCK, F.lit(0))
        out = _split(coarse, finer, order, large, limit).withColumn(BLOCK, code).drop("_gk_coarse")
    return out


def _split(df: DataFrame, keys: Sequence[str], order: Sequence[str], large: DataFrame, limit: int) -> DataFrame:
    """Cut the groups of ``large(keys, rows)`` once, at no more than ``2 * FAN`` points; other rows have no block."""
    wanted = F.least(F.lit(FAN), F.ceil(F.col(ROWS) / limit)) * 2
    plan = large.withColumn("_gk_blocks", wanted.cast("long")).withColumn(
        "_gk_every",
        F.greatest(F.lit(1), F.floor(F.col(ROWS) / (F.col("_gk_blocks") * SAMPLES_PER_BLOCK))),
    )
    rows = attach(df.select(*keys, *order), plan, keys, "inner")
    points = rows.where(F.pmod(F.xxhash64(*order), F.col("_gk_every")) == 0)
    listed = F.sort_array(F.collect_set(F.struct(*order)))
    bounds = points.groupBy(*keys).agg(listed.alias("_gk_points"), F.max("_gk_blocks").alias("_gk_blocks"))
    step = F.greatest(F.lit(1), F.ceil(F.size("_gk_points") / F.col("_gk_blocks")).cast("int"))
    bounds = checkpoint(
        bounds.withColumn("_gk_step", step).select(
            *keys,
            F.expr("filter(_gk_points, (p, i) -> i % _gk_step = 0)").alias("_gk_bounds"),
        )
    )
    here = F.struct(*order)
    block = F.size(F.filter("_gk_bounds", lambda b: b <= here))
    return attach(df, bounds, keys).withColumn(BLOCK, F.when(F.col("_gk_bounds").isNotNull(), block)).drop("_gk_bounds")


def group_columns(
    df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]
) -> DataFrame:
    """Append group aggregates to every row (the ``transform`` of a groupby)."""
    if hot_groups(df, keys) is None:
        w = over(keys)
        added = {name: agg.over(w) for name, agg in aggregates.items()}
        return carry(df.withColumns(added), df, keys)
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return attach(df, stats, keys).select(*df.columns, *aggregates)


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "_pos",
    total: str | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Append the 1-based place of a row in its group, and optionally the group size.

    ``order`` must end with a unique column.
    """
    hot = hot_groups(df, keys)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    if hot is None:
        added = {out: F.row_number().over(over(keys, direction)).cast("long")}
        if total:
            added[total] = F.count(F.lit(1)).over(over(keys))
        return carry(df.withColumns(added), df, keys)
    pieces = cut(df, keys, order, hot)
    sizes = pieces.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_gk_size"))
    along = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    earlier = over(keys, [along]).rowsBetween(Window.unboundedPreceding, -1)
    # one row per block and group
    offsets = sizes.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("_gk_size").over(earlier), F.lit(0)).alias("_gk_before"),
        F.sum("_gk_size").over(over(keys)).alias("_gk_total"),
    )
    placed = attach(pieces, offsets, [*keys, BLOCK])
    local = F.row_number().over(over([*keys, BLOCK], direction))
    placed = placed.withColumn(out, (local + F.col("_gk_before")).cast("long"))
    if total:
        placed = placed.withColumn(total, F.col("_gk_total"))
    return placed.select(*df.columns, out, *([total] if total else []))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, str]],
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Append cumulative values: ``{out: (fn, column)}``, fn of sum, count, min, max, first, last.

    ``first`` and ``last`` skip NULLs. ``order`` must end with a unique column.
    """
    hot = hot_groups(df, keys)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    end = 0 if inclusive else -1

    def local(fn: str, c: str, w: WindowSpec) -> Column:
        aggregate = {
            "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
            "first": lambda v: F.first(v, ignorenulls=True),
            "last": lambda v: F.last(v, ignorenulls=True),
        }[fn]
        return aggregate(c).over(w.rowsBetween(Window.unboundedPreceding, end))

    if hot is None:
        w = over(keys, direction)
        added = {out: local(fn, c, w) for out, (fn, c) in columns.items()}
        return carry(df.withColumns(added), df, keys)

    pieces = cut(df, keys, order, hot)
    place = F.struct(*order)

    def partial(fn: str, c: str) -> Column:
        present = F.when(F.col(c).isNotNull(), place)
        early, late = (F.max_by, F.min_by) if reverse else (F.min_by, F.max_by)
        return {
            "sum": lambda: F.sum(c), "count": lambda: F.count(c),
            "min": lambda: F.min(c), "max": lambda: F.max(c),
            "first": lambda: early(F.col(c), present),
            "last": lambda: late(F.col(c), present),
        }[fn]()

    partials = pieces.groupBy(*keys, BLOCK).agg(
        *[partial(fn, c).alias(f"_gk_p_{out}") for out, (fn, c) in columns.items()]
    )
    along = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    earlier = over(keys, [along]).rowsBetween(Window.unboundedPreceding, -1)
    carry_fn = {
        "sum": F.sum, "count": F.sum, "min": F.min, "max": F.max,
        "first": lambda v: F.first(v, ignorenulls=True),
        "last": lambda v: F.last(v, ignorenulls=True),
    }
    carried = partials.select(
        *keys,
        BLOCK,
        *[
            carry_fn[fn](f"_gk_p_{out}").over(earlier).alias(f"_gk_c_{out}")
            for out, (fn, _) in columns.items()
        ],
    )
    joined = attach(pieces, carried, [*keys, BLOCK])
    w = over([*keys, BLOCK], direction)
    merged = {}
    for out, (fn, c) in columns.items():
        here, before = local(fn, c, w), F.col(f"_gk_c_{out}")
        if fn in ("sum", "count"):
            merged[out] = F.when(before.isNull(), here).otherwise(
                before + F.coalesce(here, F.lit(0))
            )
        elif fn in ("min", "max"):
            merged[out] = (F.least if fn == "min" else F.greatest)(here, before)
        elif fn == "first":
            merged[out] = F.coalesce(before, here)
        else:
            merged[out] = F.coalesce(here, before)
    return joined.withColumns(merged).select(*df.columns, *columns)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Append columns from bounded row frames: lag, lead, rolling windows.

    ``build`` gets the ordered window and returns the new columns, which may
    look at most ``before`` rows back and ``after`` rows ahead. In a hot group
    each block carries copies of that many neighbour rows, dropped afterwards.
    """
    hot = hot_groups(df, keys)
    if hot is None:
        return carry(df.withColumns(build(over(keys, order))), df, keys)
    numbered = position(df, keys, order, out="_gk_pos")
    size = max(group_rows(df), before, after, 1)
    zero = F.col("_gk_pos") - 1
    piece, place = F.floor(zero / size), zero % size
    spot = lambda p, copy: F.struct(p.alias("piece"), F.lit(copy).alias("copy"))
    copies = F.array_compact(
        F.array(
            spot(piece, False),
            F.when(place >= size - before, spot(piece + 1, True)),
            F.when(place < after, spot(piece - 1, True)),
        )
    )
    spread = numbered.withColumn("_gk_spot", F.explode(copies)).withColumn("_gk_piece", F.col("_gk_spot.piece"))
    added = build(over([*keys, "_gk_piece"], ["_gk_pos"]))
    built = spread.withColumns(added)
    return built.where(~F.col("_gk_spot.copy")).select(*df.columns, *added)


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    columns: dict[str, str],
    unique: Sequence[str] = (),
) -> DataFrame:
    """Append ascending ranks of a column in its group; NULL values are neither ranked nor counted.

    ``columns`` maps an output name to a method: average, min, max, dense, first
    (ties by ``unique``), each also as ``<method>_pct`` (divided by the number of
    ranked rows), or ``n`` for that number.
    """
    v = F.col(value)
    needs_first = any(m.startswith("first") for m in columns.values())
    hot = hot_groups(df, keys)
    if hot is None:
        w = over(keys, [v.asc_nulls_last()])
        low = F.rank().over(w)
        high = F.count(value).over(w)
        n = F.count(value).over(over(keys))
        dense = F.dense_rank().over(w)
        first = (
            F.row_number().over(over(keys, [v.asc_nulls_last(), *unique])) if needs_first else None
        )
        frame = df
    else:
        # equal values collapse to one row before anything is ordered
        counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_gk_peers"))
        placed = running(
            counts.withColumn("_gk_one", F.lit(1)),
            keys,
            [value],
            {"_gk_high": ("sum", "_gk_peers"), "_gk_dense": ("sum", "_gk_one")},
        )
        placed = group_columns(placed, keys, {"_gk_n": F.sum("_gk_peers")}).drop("_gk_one")
        frame = attach(df, placed, [*keys, value])
        if needs_first:
            ranked = position(
                frame.where(v.isNotNull()), keys, [value, *unique], out="_gk_first"
            )
            empty = frame.where(v.isNull()).withColumn("_gk_first", F.lit(None).cast("long"))
            frame = ranked.unionByName(empty)
        low, high = F.col("_gk_high") - F.col("_gk_peers") + 1, F.col("_gk_high")
        n, dense = F.col("_gk_n"), F.col("_gk_dense")
        first = F.col("_gk_first") if needs_first else None
        # a NULL value joined nothing: take the group size from any ranked row
        if "n" in columns.values():
            frame = frame.drop("_gk_n")
            sizes = df.groupBy(*keys).agg(F.count(value).alias("_gk_n"))
            frame = attach(frame, sizes, keys)
    base = {"average": (low + high) / 2.0, "min": low, "max": high, "dense": dense, "first": first}
    added = {}
    for out, method in columns.items():
        if method == "n":
            added[out] = n
        elif method.endswith("_pct"):
            added[out] = F.when(v.isNotNull(), base[method[:-4]].cast("double") / n)
        else:
            added[out] = F.when(v.isNotNull(), base[method].cast("double"))
    ranked = frame.withColumns(added).select(*df.columns, *added)
    return carry(ranked, df, keys) if hot is None else ranked


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, columns: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row per group.

    In a hot group no task sees all values: equal values are counted, placed by
    a running sum over blocks, and the two neighbours of each quantile picked.
    """
    if hot_groups(df, keys) is None:
        shares = F.array(*[F.lit(float(p)) for p in columns.values()])
        found = df.groupBy(*keys).agg(F.percentile(F.col(value), shares).alias("_gk_q"))
        return found.select(*keys, *[F.col("_gk_q")[i].alias(out) for i, out in enumerate(columns)])
    groups = df.select(*keys).distinct() if keys else None
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_gk_peers"))
    result = counted_quantiles(counts, keys, value, "_gk_peers", columns)
    return attach(groups, result, keys) if keys else result


def counted_quantiles(counts: DataFrame, keys: Sequence[str], value: str, count: str, columns: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of values of which ``count`` says how often each stands in its group.

    ``counts`` has one row per group and value, so counts of parts of the data only need to be summed by value to give the
    quantiles of the whole. Values are placed by a running sum and the two neighbours of each quantile picked.
    """
    v = F.col(value)
    placed = running(counts, keys, [value], {"_gk_high": ("sum", count)})
    placed = group_columns(placed, keys, {"_gk_n": F.sum(count)})
    low = F.col("_gk_high") - F.col(count)  # 0-based place of the first of the equal values
    picks = []
    for out, p in columns.items():
        at = F.lit(float(p)) * (F.col("_gk_n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(
                F.max(F.when((low <= place) & (place < F.col("_gk_high")), v)).alias(f"_gk_{name}_{out}")
            )
    found = placed.groupBy(*keys).agg(F.max("_gk_n").alias("_gk_n"), *picks)
    values = []
    for out, p in columns.items():
        at = F.lit(float(p)) * (F.col("_gk_n") - 1)
        lo, hi = F.col(f"_gk_lo_{out}"), F.col(f"_gk_hi_{out}")
        values.append((lo + (hi - lo) * (at - F.floor(at))).alias(out))
    return found.select(*keys, *values)


def group_median(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Append group medians: ``{out: column}``."""
    if hot_groups(df, keys) is None:
        w = over(keys)
        added = {out: F.median(c).over(w) for out, c in columns.items()}
        return carry(df.withColumns(added), df, keys)
    for out, c in columns.items():
        df = attach(df, quantiles(df, keys, c, {out: 0.5}), keys).select(*df.columns, out)
    return df


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    out: str = "rank",
) -> DataFrame:
    """First n rows per group with their place.

    Up to GROUP_LIMIT rows Spark cuts every group to n rows before the shuffle
    (window group limit), so a hot group never travels whole. For larger n the
    rows of hot groups are first cut within hashed shares of their group.
    """
    if not keys:
        best = df.orderBy(*order).limit(n)
        # at most n rows are left
        return best.withColumn(out, F.row_number().over(Window.orderBy(*order)))
    if n > GROUP_LIMIT and hot_groups(df, keys) is not None:
        plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
        # as many shares as keep one within the limit: the largest group's size decides for all
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
        share = F.pmod(F.xxhash64(*plain), F.lit(2 * -(-largest // group_rows(df))))
        spread = df.withColumn("_gk_share", share)
        within = spread.withColumn("_gk_p", F.row_number().over(over([*keys, "_gk_share"], list(order))))
        df = within.where(F.col("_gk_p") <= n).drop("_gk_p", "_gk_share")
    numbered = df.withColumn(out, F.row_number().over(over(keys, list(order))))
    return carry(numbered.where(F.col(out) <= n), df)
