"""Sinks: partitioned publication, contracts of published tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.groups import ROWS, attach, group_rows, hot_groups, quantiles


def narrow_floats(df: DataFrame) -> DataFrame:
    """Doubles published as floats."""
    return df.withColumns({c: F.col(c).cast("float") for c, kind in df.dtypes if kind == "double"})


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Publish as parquet or csv; the commit protocol makes it atomic and leaves ``_SUCCESS``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError("kind is parquet or csv")


def finished_days(spark: SparkSession, path: str, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Days already published; the schema must match what is going to be written."""
    done = spark.read.parquet(path)
    if set(done.columns) - {"year"} != set(columns) - {"year"}:
        raise ValueError(f"published columns differ: {sorted(set(done.columns) ^ set(columns))}")
    return done.select(F.col(date).cast("string").alias(date)).distinct()


def publish_days(df: DataFrame, path: str, date: str = "date", resume: bool = False) -> None:
    """One partition per year and day. A resumed run writes only the missing days.
    """
    rows = df.withColumn("year", F.substring(F.col(date).cast("string"), 1, 4))
    if resume:
        try:
            rows = rows.join(finished_days(df.sparkSession, path, df.columns, date), date, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    heavy = hot_groups(rows, [date])
    parts = ["year", date]
    if heavy is not None:
        # rows of a heavy day go to several files, by a hash, so that no day is one task
        plain = [c for c, k in df.dtypes if not k.startswith("map")]
        files = F.ceil(F.col(ROWS) / group_rows(df)).cast("long")
        rows = attach(rows, heavy.withColumn("_files", files).select(date, "_files"), [date])
        rows = rows.withColumn("_file", F.pmod(F.xxhash64(*plain), F.coalesce("_files", F.lit(1)))).drop("_files")
        parts.append("_file")
    (
        rows.repartition(*parts)
        .drop("_file")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", date)
        .parquet(path)
    )


def profile(df: DataFrame, label: str, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Row, date and symbol counts, date range and label distribution: one row."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(date).alias("dates"),
        F.count_distinct(symbol).alias("symbols"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count(label).alias("label_count"),
        F.min(label).alias("label_min"),
        F.max(label).alias("label_max"),
    )
    return counts.crossJoin(quantiles(df, [], label, {"label_p50": 0.5, "label_p95": 0.95}))


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def manifest(df: DataFrame, label: str, config: dict, schema_version: int, run: str) -> dict:
    """Contract of a published table; one small job."""
    row = profile(df, label).first().asDict()
    return {
        "schema_version": schema_version,
        "run": run,
        "config": fingerprint(config),
        "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields],
        "profile": row,
    }


def write_manifest(spark: SparkSession, content: dict, path: str) -> None:
    text = json.dumps(content, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def validate_manifest(df: DataFrame, content: dict, schema_version: int, config: dict | None = None) -> DataFrame:
    """The frame itself when version, columns and (if given) configuration agree."""
    if content["schema_version"] != schema_version:
        raise ValueError(f"schema version {content['schema_version']}, expected {schema_version}")
    now = [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
    if now != content["columns"]:
        raise ValueError("columns differ from the manifest")
    if config is not None and content["config"] != fingerprint(config):
        raise ValueError("configuration differs from the manifest")
    return df
