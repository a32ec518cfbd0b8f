"""Missing-aware arithmetic: NaN and infinities are missing, a zero divisor gives missing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Double value, with NaN and infinities turned into NULL."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def parse_finite(c: Column | str) -> Column:
    """Text or number to a finite double; unparsable text is NULL, not an error."""
    return finite(col(c).try_cast("double"))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def truthy(c: Column) -> Column:
    """A condition where missing counts as false."""
    return F.coalesce(c, F.lit(False))


def sum_present(cols: Iterable[Column | str]) -> Column:
    """Row sum over the present values; NULL only when all are NULL."""
    parts = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def mean_present(cols: Iterable[Column | str]) -> Column:
    """Row mean over the present values."""
    parts = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in parts])
    return safe_div(sum_present(parts), n)


def std_present(cols: Iterable[Column | str], ddof: int = 0) -> Column:
    """Row standard deviation over the present values."""
    parts = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in parts])
    mean = mean_present(parts)
    squares = sum_present([(c - mean) * (c - mean) for c in parts])
    return F.sqrt(F.when(n > ddof, safe_div(squares, n - ddof)))


def least_all(cols: Sequence[Column]) -> Column:
    """Smallest value, NULL as soon as one part is NULL (Spark's least skips NULLs)."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    smallest = F.least(*cols) if len(cols) > 1 else cols[0]
    return F.when(~missing, smallest)


def signed_log(c: Column | str) -> Column:
    v = finite(c)
    return F.signum(v) * F.log1p(F.abs(v))


def log_positive(c: Column | str) -> Column:
    v = finite(c)
    return F.when(v > 0, F.ln(v))


def price_return(exit_price: Column | str, entry_price: Column | str, fee_bps: float = 0.0) -> Column:
    """exit / entry - 1 - fee; NULL unless both prices are positive and finite."""
    out, paid = finite(exit_price), finite(entry_price)
    return F.when((out > 0) & (paid > 0), out / paid - 1.0 - fee_bps / BPS)


def clip(c: Column | str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    v = col(c)
    bound = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    out = v
    if low is not None:
        out = F.greatest(out, bound(low))
    if high is not None:
        out = F.least(out, bound(high))
    return F.when(v.isNotNull(), out)


def correlation(a: Column | str, b: Column | str, min_count: int = 2) -> Column:
    """Pearson correlation as an aggregate, NULL for a small or constant group.

    ``corr`` raises on constant input under ANSI mode, so it is composed from
    mergeable moments instead.
    """
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    value = F.try_divide(F.covar_pop(x, y), spread)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count(x) >= min_count) & varied, value)


def weighted_mean(v: Column | str, w: Column | str) -> Column:
    """Mean of v weighted by w over rows with a value and a positive weight."""
    value, weight = col(v), col(w)
    used = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(used, value * weight)), F.sum(F.when(used, weight)))


def drawn(seed: int, *columns: Column | str) -> Column:
    """Hash that stands for a random draw: the MD5 of seed and columns as text, which other engines compute alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in columns]))


# differences of means (excess returns, correlations) that are truly zero come out as noise of either sign
NOISE = 1e-9


def above_zero(c: Column | str) -> Column:
    """Positive beyond rounding noise, for values that are differences of means."""
    return col(c) > NOISE


def share(cond: Column) -> Column:
    """Share of rows where the condition holds (NULL condition: row not counted)."""
    return F.avg(cond.cast("double"))


def bucket_of_edges(c: Column | str, edges: Sequence[float]) -> Column:
    """Index of the half-open interval [edge_i, edge_i+1) that holds the value, from 0."""
    v = col(c)
    inside = reduce(lambda a, b: a + b, [(v >= F.lit(float(e))).cast("int") for e in edges])
    return F.when(v.isNotNull(), inside)


def half_up_cents(c: Column | str) -> Column:
    """Round half up to two decimals with a small guard against binary fractions."""
    return F.floor(col(c) * 100.0 + 0.50000001) / 100.0
