"""Dates, clocks and horizons on naive exchange-local timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import col

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp, whatever the session time zone."""
    return F.unix_date(col(ts).cast("date")).cast("long") * F.lit(DAY_US) + offset_us(ts)


def offset_us(ts: Column | str) -> Column:
    """Microseconds since midnight."""
    c = col(ts)
    whole = F.hour(c) * 3600 + F.minute(c) * 60
    second = F.date_part(F.lit("SECOND"), c).cast("decimal(18,6)") * F.lit(1_000_000)
    return whole.cast("long") * F.lit(1_000_000) + second.cast("long")


def day(ts: Column | str) -> Column:
    """ISO date text. Casts, not formats: those would pass through the session time zone."""
    return col(ts).cast("date").cast("string")


def clock(ts: Column | str) -> Column:
    return F.substring(col(ts).cast("timestamp_ntz").cast("string"), 12, 8)


def clock_label(ts: Column | str) -> Column:
    return F.substring(col(ts).cast("timestamp_ntz").cast("string"), 12, 5)


def month(date: Column | str) -> Column:
    return F.substring(day(date), 1, 7)


def monday(date: Column | str) -> Column:
    """First day (Monday) of the week, as text."""
    return F.trunc(col(date).cast("date"), "week").cast("string")


def half_year(date: Column | str) -> Column:
    d = col(date).cast("date")
    return F.concat(F.year(d).cast("string"), F.when(F.month(d) <= 6, "H1").otherwise("H2"))


def quarter(date: Column | str) -> Column:
    d = col(date).cast("date")
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def naive(date: Column | str, us: Column | int) -> Column:
    """Naive timestamp at a µs offset into a date."""
    offset = us if isinstance(us, Column) else F.lit(us)
    seconds = (offset / F.lit(1_000_000)).cast("decimal(18,6)")
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def normal_clock(c: Column | str) -> Column:
    """``H:MM`` or ``H:MM:SS`` text to ``HH:MM:SS``; anything else is NULL."""
    text = F.trim(col(c).cast("string"))
    parts = [F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", i) for i in (1, 2, 3)]
    seconds = F.when(parts[2] == "", "00").otherwise(parts[2])
    return F.when(
        parts[0] != "", F.concat_ws(":", F.lpad(parts[0], 2, "0"), parts[1], seconds)
    )


def normal_date(c: Column | str, numeric: bool = False) -> Column:
    """ISO date text; a numeric source counts days since 1970-01-01."""
    if numeric:
        return F.date_format(F.date_from_unix_date(col(c).cast("int")), "yyyy-MM-dd")
    text = F.trim(col(c).cast("string"))
    return F.date_format(
        F.coalesce(
            F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")),
            F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")),
        ),
        "yyyy-MM-dd",
    )


def normal_symbol(c: Column | str, binary: bool = False) -> Column:
    value = F.decode(col(c), "utf-8") if binary else col(c).cast("string")
    return F.upper(F.trim(value))


def clock_seconds(text: str) -> int:
    parts = [int(p) for p in text.strip().split(":")]
    parts += [0] * (3 - len(parts))
    if len(parts) != 3 or not (0 <= parts[0] < 24 and 0 <= parts[1] < 60 and 0 <= parts[2] < 60):
        raise ValueError(f"not a clock: {text!r}")
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def clock_text(seconds: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def minute_grid(start: str, end: str, step_minutes: int = 1) -> list[str]:
    first, last = clock_seconds(start), clock_seconds(end)
    if last < first:
        raise ValueError("clock range ends before it starts")
    return [clock_text(s) for s in range(first, last + 1, 60 * step_minutes)]


def parse_clocks(text: str) -> list[str]:
    """Comma or blank separated clocks; ``a..b`` and ``a-b`` stand for a minute grid."""
    out: list[str] = []
    for token in re.split(r"[,\s]+", text.strip()):
        if not token:
            continue
        ends = re.split(r"\.\.|-", token, maxsplit=1)
        out += minute_grid(*ends) if len(ends) == 2 else [clock_text(clock_seconds(token))]
    return out


def horizon_seconds(name: str) -> int | None:
    """``90s``, ``5m`` or ``1h`` in seconds; session horizons (close, next_open, ...) give None."""
    text = name.strip().lower()
    if text in {"close", "next_open", "next_close"}:
        return None
    found = re.fullmatch(r"(\d+)([smh])", text)
    if not found or int(found.group(1)) == 0:
        raise ValueError(f"unknown horizon: {name!r}")
    return int(found.group(1)) * {"s": 1, "m": 60, "h": 3600}[found.group(2)]


def horizon_column(name: str) -> str:
    return f"alpha_return_{name.strip().lower()}"


# fixed values: magnitude ranges of epochs, one per unit, lower end included
EPOCH_UNITS = {
    "milliseconds": (1e11, 1e14, 1_000.0),
    "microseconds": (1e14, 1e17, 1.0),
    "nanoseconds": (1e17, 1e20, 0.001),
}


def receipt_epoch_us(c: Column | str) -> Column:
    """Epoch value in ms, µs or ns (told apart by magnitude) to µs; other magnitudes are NULL."""
    v = col(c).try_cast("double")
    parts = [
        F.when((v >= low) & (v < high), (v * factor) if factor >= 1 else v / (1 / factor))
        for low, high, factor in EPOCH_UNITS.values()
    ]
    return F.round(F.coalesce(*parts)).cast("long")


def receipt_unit(c: Column | str) -> Column:
    """Name of the epoch unit; ``missing`` for NULL or non-positive, ``unknown`` otherwise."""
    v = col(c).try_cast("double")
    named = [F.when((v >= low) & (v < high), name) for name, (low, high, _) in EPOCH_UNITS.items()]
    return F.when(v.isNull() | (v <= 0), "missing").otherwise(F.coalesce(*named, F.lit("unknown")))
