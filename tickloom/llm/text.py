"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import tune

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()),
    "array<float>": pa.list_(pa.float32()),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def prepare(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of long texts within a worker's memory: 1,000 rows or 16 MB each."""
    spark = tune(df.sparkSession)
    spark.conf.set(BATCH_ROWS, "1000")
    spark.conf.set(BATCH_BYTES, str(16 << 20))
    return df


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out from every fit. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def map_text(
    df: DataFrame,
    keep: list[Column],
    text: Column,
    fields: dict[str, str],
    fn: Callable[[], Callable[[list[str]], list[list]]],
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, without a shuffle.

    ``fn()`` is called once per task and gives a function from a list of texts (null: empty) to one list
    per field of ``fields`` (name -> type).
    """
    source = prepare(df).select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    kept = source.schema.fields[:-1]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in fields.items())).fields])
    kinds = [ARROW[v] for v in fields.values()]
    names = [f.name for f in schema.fields]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(n)] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=names
                )

    return source.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))
