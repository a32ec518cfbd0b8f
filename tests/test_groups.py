"""Grouped-order kernel: the cut layout gives the rows of the plain one, and both those of pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import groups as G
from tickloom.operators.asof import asof


def rows(seed=3, n=240):
    """A third of all rows in one key, ties and missing values included."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(12)}"
        value = None if rnd.random() < 0.1 else float(rnd.randrange(9))
        out.append((key, i, rnd.randrange(60), value))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "k string, id long, t long, v double").repartition(5)


def both_ways(spark, build):
    def run():
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in build().collect()), key=repr)

    plain = run()
    spark.conf.set(G.GROUP_ROWS, "7")
    try:
        cut = run()
    finally:
        spark.conf.unset(G.GROUP_ROWS)
    assert plain == cut
    return plain


def test_hot_group_is_found_and_small_ones_are_not(spark, frame, small_groups):
    hot = {r["k"] for r in G.hot_groups(frame, ["k"]).collect()}
    counts = pd.Series([r[0] for r in rows()]).value_counts()
    assert hot == set(counts[counts > 7].index)


def test_no_block_holds_a_hot_group_whole(spark, frame, small_groups):
    pieces = G.cut(frame, ["k"], ["t", "id"], G.hot_groups(frame, ["k"]))
    sizes = pieces.where("k = 'hot'").groupBy(G.BLOCK).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 40


def test_position(spark, frame):
    got = both_ways(spark, lambda: G.position(frame, ["k"], ["t", "id"], total="n").select("id", "_pos", "n"))
    want = pd.DataFrame(rows(), columns=["k", "id", "t", "v"]).sort_values(["k", "t", "id"])
    want["p"] = want.groupby("k").cumcount() + 1
    want["n"] = want.groupby("k")["id"].transform("size")
    assert {(i, p, n) for i, p, n in got} == set(zip(want.id, want.p, want.n))


def test_reverse_position(spark, frame):
    both_ways(spark, lambda: G.position(frame, ["k"], ["t", "id"], reverse=True).select("id", "_pos"))


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_running(spark, frame, inclusive, reverse):
    columns = {f: (f, "v") for f in ("sum", "count", "min", "max", "first", "last")}
    both_ways(
        spark,
        lambda: G.running(frame, ["k"], ["t", "id"], columns, inclusive, reverse).select("id", *columns),
    )


def test_framed(spark, frame):
    def build(w):
        return {"back": F.lag("id", 3).over(w), "ahead": F.lead("id", 2).over(w), "mean": F.sum("id").over(w.rowsBetween(-4, -1))}

    both_ways(spark, lambda: G.framed(frame, ["k"], ["t", "id"], build, 4, 2).select("id", "back", "ahead", "mean"))


def test_ranks_match_pandas(spark, frame):
    methods = ["average", "min", "max", "dense", "first", "average_pct"]
    got = both_ways(
        spark, lambda: G.ranks(frame, ["k"], "v", {m: m for m in methods}, unique=["id"]).select("id", *methods)
    )
    want = pd.DataFrame(rows(), columns=["k", "id", "t", "v"]).sort_values("id").set_index("id")
    g = want.groupby("k")["v"]
    for row in got:
        i = row[0]
        for j, m in enumerate(methods, start=1):
            expected = g.rank(method=m.removesuffix("_pct"), pct=m.endswith("_pct")).loc[i]
            assert (row[j] is None and pd.isna(expected)) or row[j] == pytest.approx(expected)


def test_quantiles_match_pandas(spark, frame):
    got = both_ways(spark, lambda: G.quantiles(frame, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}))
    want = pd.DataFrame(rows(), columns=["k", "id", "t", "v"]).groupby("k")["v"]
    for k, a, b, c in got:
        for p, x in ((0.1, a), (0.5, b), (0.99, c)):
            assert x == pytest.approx(want.quantile(p).loc[k])


def test_group_columns_and_median(spark, frame):
    both_ways(spark, lambda: G.group_columns(frame, ["k"], {"m": F.max("v"), "n": F.count("v")}).select("id", "m", "n"))
    both_ways(spark, lambda: G.group_median(frame, ["k"], {"m": "v"}).select("id", "m"))


def test_large_top_keeps_the_whole_result(spark, frame):
    both_ways(
        spark, lambda: G.top_rows(frame, ["k"], [F.col("v").desc_nulls_last(), F.col("id")], 1500, "r").select("id", "r")
    )


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof_matches_pandas(spark, frame, direction, tolerance):
    states = frame.where("v is not null").groupBy("k", "t").agg(F.max("id").alias("sid"))
    targets = frame.select("k", "id", (F.col("t") + 1).alias("at"))
    got = both_ways(
        spark, lambda: asof(targets, states, ["k"], "at", "t", ["sid"], direction, tolerance).select("id", "t", "sid")
    )
    left = targets.toPandas().sort_values("at")
    right = states.toPandas().sort_values("t")
    want = pd.merge_asof(left, right, left_on="at", right_on="t", by="k", direction=direction, tolerance=tolerance)
    expected = {r.id: (None if pd.isna(r.t) else int(r.t), None if pd.isna(r.sid) else int(r.sid)) for r in want.itertuples()}
    assert {i: (t, s) for i, t, s in got} == expected


def test_result_does_not_depend_on_partitioning(spark, frame, small_groups):
    one = G.ranks(frame.coalesce(1), ["k"], "v", {"r": "average"}).select("id", "r").collect()
    many = G.ranks(frame.repartition(8, "id"), ["k"], "v", {"r": "average"}).select("id", "r").collect()
    assert sorted(one) == sorted(many)


def test_levels_of_cut_points_keep_blocks_small_and_in_order(spark, frame, small_groups, monkeypatch):
    monkeypatch.setattr(G, "FAN", 2)
    pieces = G.cut(frame, ["k"], ["t", "id"], G.hot_groups(frame, ["k"])).toPandas().sort_values(["k", "t", "id"])
    assert len(pieces) == 240
    for _, group in pieces.groupby("k"):
        assert group[G.BLOCK].is_monotonic_increasing
    assert pieces[pieces.k == "hot"].groupby(G.BLOCK).size().max() < 40
    got = G.position(frame, ["k"], ["t", "id"]).select("id", "_pos").collect()
    want = pd.DataFrame(rows(), columns=["k", "id", "t", "v"]).sort_values(["k", "t", "id"])
    want["p"] = want.groupby("k").cumcount() + 1
    assert {tuple(r) for r in got} == set(zip(want.id, want.p))


def test_copies_are_not_counted_again(spark):
    """Sizes measured on the source hold for its copies under a new column, and only with it in the keys."""
    from tickloom.operators.groups import carry_copies, hot_groups, known

    df = spark.range(20).selectExpr("id % 4 AS k", "id")
    long = carry_copies(df.crossJoin(spark.range(3).withColumnRenamed("id", "copy")), df, ["k"], "copy")
    assert known(long)[1] == {frozenset({"k", "copy"})}
    spark.conf.set("tickloom.groupRows", "7")
    try:
        hot = carry_copies(long.select("*"), df, ["k"], "copy")
        assert hot_groups(hot, ["k", "copy"]) is None and hot_groups(hot, ["k"]) is not None
        assert not known(carry_copies(long.select("*"), df.withColumn("k", df["k"] % 2), ["k"], "copy"))[1]
    finally:
        spark.conf.unset("tickloom.groupRows")
