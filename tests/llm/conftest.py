import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with columns that clash with names inside."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "fp", "key", "score", "shard", "x", "leaks", "k_id", "node", "text2"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
