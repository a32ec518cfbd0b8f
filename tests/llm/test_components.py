"""Components of a long chain, a star, a loop and repeated links."""

from pyspark.sql import functions as F

from tickloom.llm.components import components


def test_chain_star_and_loop(spark):
    n = 300
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(50).select(F.lit(10_000).cast("long").alias("a"), (F.col("id") + 10_001).alias("b"))
    loop = spark.range(3).select((F.col("id") + 90_000).alias("a"), (F.pmod(F.col("id") + 1, F.lit(3)) + 90_000).alias("b"))
    got = components(chain.union(star).union(loop).union(chain)).collect()
    assert len(got) == n + 1 + 51 + 3
    assert all(r.root == (0 if r.node <= n else 10_000 if r.node < 90_000 else 90_000) for r in got)
    assert components(chain.where("a < 0")).collect() == []
