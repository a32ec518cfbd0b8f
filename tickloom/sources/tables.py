"""Scans: files, schema alignment, filters, canonical names and timestamps, day windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import clock as C

DEPTH = range(1, 11)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    filters: Sequence[tuple] = (),
    kind: str = "parquet",
    schema: T.StructType | str | None = None,
    merge_schema: bool = True,
) -> DataFrame:
    """Scan files or folders with a column list and pushed-down filters.

    ``kind`` is parquet or csv (``.csv.gz`` included). The filter runs on the scan
    before the projection, so it may use columns that are not returned. Folders named ``column=value`` become
    columns, and filters on them choose folders; other folders are read recursively. The union of
    all files' columns is read, as files of older years may lack some; that opens every file's footer first, so give
    a ``schema`` or switch ``merge_schema`` off where the files are alike.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("recursiveFileLookup", not any(is_partitioned(spark, p) for p in paths))
    if kind == "parquet":
        reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", merge_schema)
        df = reader.option("pathGlobFilter", "*.parquet").parquet(*paths)
    elif kind == "csv":
        reader = reader.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader).csv(paths)
    else:
        raise ValueError("kind is parquet or csv")
    if filters:
        df = df.where(condition(df, filters))
    return df.select(*columns) if columns is not None else df


def is_partitioned(spark: SparkSession, path: str) -> bool:
    """Whether a folder's own folders are named ``column=value``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(place) or []
    inner = [c for s in found if s.isDirectory() for c in files.listStatus(s.getPath())]
    return any(c.isDirectory() and "=" in c.getPath().getName() for c in inner)


def condition(df: DataFrame, filters: Sequence[tuple]) -> Column:
    """Conjunction of (column, operator, value); an unknown column is an error."""
    tests = []
    for column, op, value in filters:
        if column not in df.columns:
            raise ValueError(f"filter column {column} does not exist")
        c = F.col(column)
        make = {
            "==": lambda: c == value, "=": lambda: c == value, "!=": lambda: c != value,
            ">=": lambda: c >= value, ">": lambda: c > value, "<=": lambda: c <= value,
            "<": lambda: c < value, "in": lambda: c.isin(list(value)),
        }
        if op not in make:
            raise ValueError(f"unknown operator {op}")
        tests.append(make[op]())
    return reduce(lambda a, b: a & b, tests)


def project(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Required columns plus the optional ones that exist."""
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns {lost}")
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def union_tables(parts: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Concatenate with schema alignment; a column absent in one part is NULL there."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*columns) if columns is not None else out


# fixed values: canonical name and its accepted spellings, lower case
ALIASES = {
    "date": ["tradingday"],
    "symbol": ["ticker", "code", "security_id"],
    "timestamp": ["datetime", "ts"],
    "exch_time_offset_us": ["exchtimeoffsetus"],
    "last_price": ["last", "price", "lastprice"],
    "high_price": ["highprice"],
    "low_price": ["lowprice"],
    "prev_close": ["preclose", "pre_close"],
    "volume": ["cum_volume"],
    "turnover": ["amount", "cum_amount", "cum_turnover"],
    "trade_num": ["tradenum"],
    "status": [],
    "avg_ask_price": ["avgaskprice"],
    "avg_bid_price": ["avgbidprice"],
    "total_ask_volume": ["totalaskvolume"],
    "total_bid_volume": ["totalbidvolume"],
    "total_ask_count": ["totalaskcount"],
    "total_bid_count": ["totalbidcount"],
    "iopv": [],
    "local_timestamp": ["localtimestamp"],
}
# fixed values: spellings of a depth column of side s (first letter i) at level k
DEPTH_SPELLINGS = {
    "price": ["{s}{k}", "{s}_price{k}", "{s}price{k}", "{i}{k}"],
    "volume": ["{s}_vol{k}", "{s}_volume{k}", "{s}volume{k}", "{i}v{k}"],
    "count": ["{s}count{k}"],
}


def alias_table() -> dict[str, str]:
    """Accepted spelling to canonical name, with the ten depth levels generated by rule."""
    table = {spelling: name for name, spellings in ALIASES.items() for spelling in spellings}
    for side in ("ask", "bid"):
        for part, spellings in DEPTH_SPELLINGS.items():
            for k in DEPTH:
                table |= {t.format(s=side, i=side[0], k=k): f"{side}_{part}_{k}" for t in spellings}
    return table


def canonical(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Case-insensitive rename to canonical names; a column already named so wins."""
    table = {**alias_table(), **{k.lower(): v for k, v in (aliases or {}).items()}}
    taken = {c for c in df.columns}
    renames = {}
    for c in df.columns:
        target = table.get(c.lower(), c.lower() if c.lower() in ALIASES else c)
        if target != c and target not in taken:
            renames[c] = target
            taken.add(target)
    return df.withColumnsRenamed(renames)


def with_timestamps(
    df: DataFrame, date: str = "date", time: str = "time", timestamp: str = "timestamp", offset: str = "exch_time_offset_us",
    symbol: str = "symbol",
) -> DataFrame:
    """Naive ``timestamp`` from itself, from date + time, or from date + µs offset; normal date, time, symbol."""
    has = set(df.columns)
    options = []
    if timestamp in has:
        options.append(F.col(timestamp).cast("timestamp_ntz"))
    if {date, time} <= has:
        joined = F.concat_ws(" ", C.normal_date(date), C.normal_clock(time))
        options.append(F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    if {date, offset} <= has:
        options.append(C.naive(C.normal_date(date), F.col(offset).cast("long")))
    if not options:
        raise ValueError("no timestamp, date and time, or date and offset")
    out = df.withColumn(timestamp, F.coalesce(*options))
    added = {date: C.day(timestamp), time: C.clock(timestamp)}
    if symbol in has:
        added[symbol] = C.normal_symbol(symbol)
    return out.withColumns(added)


def load_ticks(spark: SparkSession, path: str, columns: Sequence[str] | None = None, aliases: dict[str, str] | None = None, **options) -> DataFrame:
    """Tick scan with canonical names and timestamps."""
    return with_timestamps(canonical(read_table(spark, path, columns, **options), aliases))


def day_window(
    ticks: DataFrame,
    day: str,
    start_us: int,
    end_us: int,
    columns: Sequence[str] | None = None,
    symbols: DataFrame | None = None,
    pattern: str | None = None,
    date: str = "date",
    offset: str = "exch_time_offset_us",
    symbol: str = "symbol",
) -> DataFrame:
    """One day and offset range, optional symbol table and pattern. All tests reach the scan."""
    rows = ticks.where((F.col(date) == day) & (F.col(offset) >= start_us) & (F.col(offset) < end_us))
    if pattern:
        rows = rows.where(F.col(symbol).rlike(pattern))
    if symbols is not None:
        rows = rows.join(symbols.select(symbol).distinct(), symbol, "left_semi")
    return rows.select(*columns) if columns is not None else rows


def listed_states(states: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of a given list of keys only."""
    return states.join(pairs.select(*keys).distinct(), list(keys), "left_semi")


def daily_reference(reference: DataFrame, start: str, end: str, columns: Sequence[str], pattern: str | None = None, date: str = "date", symbol: str = "symbol") -> DataFrame:
    rows = reference.where(F.col(date).between(start, end))
    if pattern:
        rows = rows.where(F.col(symbol).rlike(pattern))
    return rows.select(*columns)


def sessions_between(table: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    return table.where(F.col(date).between(start, end)).select(date).distinct()


def symbol_list(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Allow-list: the ``symbol`` (or first) column of a csv, or one symbol per text line."""
    if kind == "csv":
        table = spark.read.option("header", True).csv(path)
        name = "symbol" if "symbol" in table.columns else table.columns[0]
    else:
        table, name = spark.read.text(path), "value"
    value = C.normal_symbol(name)
    return table.select(value.alias("symbol")).where((value != "") & ~value.startswith("#")).distinct()


def predictions(
    df: DataFrame,
    required: Sequence[str],
    optional: Sequence[str] = (),
    present: Sequence[str] = (),
    clocks: Sequence[str] = (),
    clock: str = "clock",
) -> DataFrame:
    """Prediction shards: required and optional columns, non-null columns, decision clocks."""
    out = project(df, required, optional)
    if clocks:
        out = out.where(F.col(clock).isin(list(clocks)))
    return out.dropna(subset=list(present)) if present else out


def date_bounds(df: DataFrame, windows: Sequence[dict], date: str = "date", year: int | None = None) -> DataFrame:
    """Rows within the dates that train/test windows need, optionally one year shard."""
    start = min(w["train_start"] for w in windows)
    end = max(w["test_end"] for w in windows)
    rows = df.where(F.col(date).between(start, end))
    return rows.where(F.substring(date, 1, 4) == str(year)) if year else rows


def sample_with_history(
    rows: DataFrame, keys: Sequence[str], per_day: int, seed: int, lookback_days: int, date: str = "date", symbol: str = "symbol"
) -> tuple[DataFrame, DataFrame]:
    """(seeded sample of rows per day, all rows the sampled symbols have in the look-back before it)."""
    from tickloom.functions.numeric import drawn
    from tickloom.operators.groups import top_rows

    order = drawn(seed, *keys)
    chosen = top_rows(rows, [date], [order, *[F.col(k) for k in keys]], per_day, "_place").drop("_place")
    spans = chosen.select(
        symbol, F.explode(F.sequence(F.date_sub(F.col(date).cast("date"), lookback_days), F.col(date).cast("date"))).alias("_d")
    ).select(symbol, F.date_format("_d", "yyyy-MM-dd").alias(date)).distinct()
    return chosen, rows.join(spans, [symbol, date], "left_semi")


def sample_with_features(
    rows: DataFrame, keys: Sequence[str], per_day: int, seed: int, lookback_days: int, build: Callable[[DataFrame], DataFrame],
    date: str = "date", symbol: str = "symbol",
) -> DataFrame:
    """Sampled rows with features that ``build`` derives anew from their look-back: features first, then cut back to the sample."""
    chosen, context = sample_with_history(rows, keys, per_day, seed, lookback_days, date, symbol)
    return build(context).join(chosen.select(date, *keys), [date, *keys], "left_semi")


def selected_allocations(
    parts: Sequence[DataFrame], labels: DataFrame, required: Sequence[str], optional: Sequence[str], keys: Sequence[str],
    amount: str = "allocated_notional", date: str = "date",
) -> tuple[DataFrame, DataFrame]:
    """Positive allocations of several files, and the labels cut to their dates (of duplicates the greatest row)."""
    from tickloom.functions.numeric import parse_finite
    from tickloom.operators.reference import one_per_key

    rows = project(union_tables(parts), required, optional).withColumn(amount, parse_finite(amount))
    rows = rows.where(F.col(amount) > 0)
    cut = labels.join(rows.select(date).distinct(), date, "left_semi")
    return rows, one_per_key(cut, keys)


def jdbc_day_window(spark: SparkSession, url: str, table: str, day: str, start_us: int, end_us: int, options: dict | None = None) -> DataFrame:
    """The same scan over JDBC; Spark pushes the filters to the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    return day_window(canonical(rows), day, start_us, end_us)
