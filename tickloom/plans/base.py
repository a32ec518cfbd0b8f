"""Registration of catalogue queries and the shared input panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import day, micros
from tickloom.session import WINDOW_DEFAULTS, tune


class Tables:
    """Lazy access to the parquet tables of one folder, plus the two panels built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark, WINDOW_DEFAULTS), folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def ticks(self) -> DataFrame:
        """Events as tick states: one path per user; see TICKS for the same in SQL."""
        e = self.events
        level = F.col("event_id") % 89
        price = F.col("value")
        return e.select(
            day("ts").alias("date"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
            "ts",
            micros("ts").alias("t"),
            F.col("event_id").alias("seq"),
            F.col("event_type").alias("status"),
            price.alias("last_price"),
            *[(price * (1 + 0.001 * k) + 0.01).alias(f"ask_price_{k}") for k in (1, 2, 3)],
            *[(price * (1 - 0.001 * k)).alias(f"bid_price_{k}") for k in (1, 2, 3)],
            *[((level * k) % 37 + 1).cast("double").alias(f"ask_volume_{k}") for k in (1, 2, 3)],
            *[((level * (k + 3)) % 41 + 1).cast("double").alias(f"bid_volume_{k}") for k in (1, 2, 3)],
            (price * 1.1).alias("limit_up_price"),
            ((F.col("event_id") % 13 + 1) * 100).cast("double").alias("size"),
            (F.floor(price / 10) * 10 + 5).cast("double").alias("prev_close"),
            "props",
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Line items as decision rows: cross-section (date, clock); see PANEL for the same in SQL."""
        line = self.lineitem
        even = F.col("l_linenumber") % 2 == 0
        last = F.col("l_linenumber") == 7
        nxt = (F.col("l_extendedprice") % 1000.0) / 10000.0 - 0.05
        return line.select(
            day("l_shipdate").alias("date"),
            F.when(even, "09:31:00").otherwise("10:01:00").alias("clock"),
            F.concat(F.lit("S"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("symbol"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"),
            F.col("l_returnflag").alias("industry"),
            F.col("l_linestatus").alias("status"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("prediction"),
            F.col("l_discount").alias("score"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("volume"),
            F.col("l_extendedprice").alias("turnover"),
            F.when(~last, F.col("l_tax") - 0.04 + (F.col("l_quantity") - 25) / 10000).alias("label_short"),
            F.when(~last, nxt).alias("label_next_close"),
        )


# fixed tie-breakers that make the order of panel rows unique
TIE = ["symbol", "rid", "turnover"]
XS = ["date", "clock"]

TICKS = """ticks AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date, 'U' || user_id AS symbol, ts, epoch_us(ts) AS t,
    event_id AS seq, event_type AS status, value AS last_price,
    value * (1 + 0.001 * 1) + 0.01 AS ask_price_1, value * (1 + 0.001 * 2) + 0.01 AS ask_price_2,
    value * (1 + 0.001 * 3) + 0.01 AS ask_price_3,
    value * (1 - 0.001 * 1) AS bid_price_1, value * (1 - 0.001 * 2) AS bid_price_2,
    value * (1 - 0.001 * 3) AS bid_price_3,
    CAST((event_id % 89 * 1) % 37 + 1 AS DOUBLE) AS ask_volume_1,
    CAST((event_id % 89 * 2) % 37 + 1 AS DOUBLE) AS ask_volume_2,
    CAST((event_id % 89 * 3) % 37 + 1 AS DOUBLE) AS ask_volume_3,
    CAST((event_id % 89 * 4) % 41 + 1 AS DOUBLE) AS bid_volume_1,
    CAST((event_id % 89 * 5) % 41 + 1 AS DOUBLE) AS bid_volume_2,
    CAST((event_id % 89 * 6) % 41 + 1 AS DOUBLE) AS bid_volume_3,
    value * CAST(1.1 AS DOUBLE) AS limit_up_price,
    CAST((event_id % 13 + 1) * 100 AS DOUBLE) AS size,
    CAST(floor(value / 10) * 10 + 5 AS DOUBLE) AS prev_close, props
  FROM events)"""

PANEL = """panel AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS date,
    CASE WHEN l_linenumber % 2 = 0 THEN '09:31:00' ELSE '10:01:00' END AS clock,
    'S' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS symbol,
    l_orderkey * 10 + l_linenumber AS rid, l_returnflag AS industry, l_linestatus AS status,
    l_extendedprice * (1 - l_discount) AS prediction, l_discount AS score,
    l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS turnover,
    CASE WHEN l_linenumber <> 7 THEN l_tax - CAST(0.04 AS DOUBLE) + (l_quantity - 25) / 10000 END AS label_short,
    CASE WHEN l_linenumber <> 7 THEN (l_extendedprice % 1000.0) / 10000.0 - CAST(0.05 AS DOUBLE) END AS label_next_close
  FROM lineitem)"""


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int

    def _offset(self) -> float:
        return 1.37e-3 * 10.0**-self.digits

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.withColumns({c: steady(F.col(c), self.digits) for c in self.doubles})

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rounded = ", ".join(
            f"round(CAST({c} AS DOUBLE) + {self._offset():.17f}, {self.digits}) + 0.0 AS {c}"
            for c in self.doubles
        )
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"


def steady(c: Column, digits: int) -> Column:
    """Round away from exact ties, so that two engines round the same way."""
    return F.round(c.cast("double") + F.lit(float(f"{1.37e-3 * 10.0**-digits:.17f}")), digits) + F.lit(0.0)


CATALOG: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``build(tables)``; ``doubles`` are rounded alike in Spark and SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, operators, build, sql, tuple(doubles.split()), digits)
        return build

    return register
