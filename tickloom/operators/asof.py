"""As-of matching: the last state at or before, or the first at or after, a target time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.groups import running


def asof(
    targets: DataFrame,
    states: DataFrame,
    by: Sequence[str],
    at: str,
    time: str,
    values: Sequence[str],
    direction: str = "backward",
    tolerance: int | None = None,
    seq: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Append the matched state's ``time`` and ``values`` (prefixed) to every target row.

    ``at`` and ``time`` are µs. States at exactly the target time match. Of
    states with equal time the last by ``seq`` wins backward, the first forward.
    Unmatched targets keep NULLs. One union, one shuffle on ``by``, linear work.
    """
    backward = direction == "backward"
    if not backward and direction != "forward":
        raise ValueError("direction is backward or forward")
    own = [c for c in targets.columns if c not in by]
    side = 0 if backward else 1  # a state must be met before a target of the same time
    lined_seq = [f"_seq{i}" for i in range(len(seq))]
    state_rows = states.where(F.col(time).isNotNull()).select(
        *by,
        F.col(time).cast("long").alias("_t"),
        F.lit(side).alias("_side"),
        *[F.col(c).alias(a) for c, a in zip(seq, lined_seq, strict=True)],
        F.struct(F.col(time).cast("long").alias("_when"), *values).alias("_state"),
    )
    types = dict(states.select(*seq).dtypes) if seq else {}
    target_rows = targets.select(
        *by,
        F.col(at).cast("long").alias("_t"),
        F.lit(1 - side).alias("_side"),
        *[F.lit(None).cast(types[c]).alias(a) for c, a in zip(seq, lined_seq, strict=True)],
        F.struct(*own).alias("_row"),
    )
    lined = state_rows.unionByName(target_rows, allowMissingColumns=True)
    matched = running(
        lined, by, ["_t", "_side", *lined_seq], {"_hit": ("last", "_state")}, reverse=not backward
    ).where(F.col("_row").isNotNull())
    hit = F.col("_hit")
    gap = (F.col("_t") - F.col("_hit._when")) if backward else (F.col("_hit._when") - F.col("_t"))
    usable = hit.isNotNull() if tolerance is None else F.coalesce(gap <= tolerance, F.lit(False))
    usable = usable & F.col("_t").isNotNull()
    return matched.select(
        *by,
        *[F.col("_row")[c].alias(c) for c in own],
        F.when(usable, F.col("_hit._when")).alias(f"{prefix}{time}"),
        *[F.when(usable, hit[c]).alias(f"{prefix}{c}") for c in values],
    )
