"""Scans, sinks, contracts."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import checks as K
from tickloom.operators import reference as R
from tickloom.sources import sinks as W
from tickloom.sources import tables as S


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, f"2024-0{i % 3 + 1}-01", float(i)) for i in range(30)], "id long, date string, v double")


def test_csv_and_parquet_scan_alike(spark, frame, tmp_path):
    W.write_table(frame, str(tmp_path / "p"))
    W.write_table(frame, str(tmp_path / "c"), kind="csv")
    a = S.read_table(spark, str(tmp_path / "p"), ["id", "v"], [("id", ">=", 10), ("v", "<", 20.0)])
    b = S.read_table(spark, str(tmp_path / "c"), ["id", "v"], [("id", ">=", 10), ("v", "<", 20.0)], kind="csv", schema=frame.schema)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 10
    assert (tmp_path / "p" / "_SUCCESS").exists()


def test_filters_reach_the_scan(spark, frame, tmp_path):
    W.write_table(frame, str(tmp_path / "p"))
    plan = S.read_table(spark, str(tmp_path / "p"), ["id"], [("v", ">=", 10.0)])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThanOrEqual(v,10.0)]" in plan


def test_unknown_filter_column_is_an_error(frame):
    with pytest.raises(ValueError):
        S.condition(frame, [("nope", "==", 1)])
    with pytest.raises(ValueError):
        S.project(frame, ["nope"])


def test_files_with_different_columns_are_read_as_one(spark, frame, tmp_path):
    W.write_table(frame.drop("v"), str(tmp_path / "t" / "a"))
    W.write_table(frame, str(tmp_path / "t" / "b"))
    got = S.read_table(spark, str(tmp_path / "t"))
    assert got.count() == 60 and got.where("v is null").count() == 30


def test_resumed_publication_writes_missing_days_only(spark, frame, tmp_path):
    path = str(tmp_path / "days")
    W.publish_days(frame.where("date = '2024-01-01'"), path, resume=True)
    first = {p.name for p in (tmp_path / "days").rglob("*.parquet")}
    W.publish_days(frame, path, resume=True)
    second = {p.name for p in (tmp_path / "days").rglob("*.parquet")}
    assert first < second
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.select("id").distinct().count() == 30
    with pytest.raises(ValueError):
        W.finished_days(spark, path, ["id", "other"])


def test_heavy_days_are_spread_over_files(spark, frame, tmp_path, small_groups):
    W.publish_days(frame, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 30


def test_manifest_round_trip(spark, frame, tmp_path):
    content = W.manifest(frame.withColumn("symbol", F.lit("A")), "v", {"a": 1}, 3, "run")
    W.write_manifest(spark, content, str(tmp_path / "m"))
    back = W.read_manifest(spark, str(tmp_path / "m"))
    assert back["profile"]["rows"] == 30
    same = frame.withColumn("symbol", F.lit("A"))
    assert W.validate_manifest(same, back, 3, {"a": 1}) is same
    for bad in ((frame, 3, None), (same, 4, None), (same, 3, {"a": 2})):
        with pytest.raises(ValueError):
            W.validate_manifest(bad[0], back, bad[1], bad[2])


def test_canonical_names_keep_existing_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "LastPrice double, last_price double, AskPrice3 double, bv10 double")
    assert S.canonical(df).columns == ["LastPrice", "last_price", "ask_price_3", "bid_volume_10"]


def test_timestamps_from_three_sources(spark):
    df = spark.createDataFrame([("2024-03-04", "9:31", None), ("20240304", None, 34_260_000_001)], "date string, time string, exch_time_offset_us long")
    got = S.with_timestamps(df).collect()
    assert [r.time for r in got] == ["09:31:00", "09:31:00"] and {r.date for r in got} == {"2024-03-04"}
    assert got[1].timestamp.microsecond == 1


def test_symbol_list_of_csv_and_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("code\n a1\nB2\n")
    (tmp_path / "s.txt").write_text("a1\n\n# note\n b2 \n")
    for kind, name in (("csv", "s.csv"), ("text", "s.txt")):
        assert {r.symbol for r in S.symbol_list(spark, str(tmp_path / name), kind).collect()} == {"A1", "B2"}


def test_key_contract(spark):
    good = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n long")
    assert K.require_keys(good, ["k", "n"]) is good
    with pytest.raises(ValueError):
        K.require_keys(good, ["k"])
    with pytest.raises(ValueError):
        K.require_keys(good.withColumn("n", F.when(F.col("n") > 1, F.col("n"))), ["k", "n"])
    assert not K.key_sets_equal(good, good.where("n = 1"), ["k", "n"]).first().same_keys
    assert K.key_sets_equal(good, good.repartition(3), ["k", "n"]).first().same_keys


def test_window_coverage_and_overlap():
    from tickloom.operators.decision import in_windows

    assert K.window_coverage([(0, 100), (200, 400)], 210, 300, 6, 60, 10)["spare"] == 24
    with pytest.raises(ValueError):
        K.window_coverage([(0, 100)], 50, 90, 6, 60, 10)
    with pytest.raises(ValueError):
        in_windows(F.lit(1), [(0, 10), (5, 20)])


def test_unmatched_keys_raise(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    joined, counts = R.full_join_coverage(a, a.where("k = 1"), ["k"])
    assert joined.count() == 1 and counts.first().left_only == 1
    with pytest.raises(ValueError):
        R.require_full_coverage(counts)


def test_reused_features_must_be_constant(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, v double")
    with pytest.raises(ValueError):
        R.reuse_daily_features(a.select("k"), a, ["k"], ["v"])


def test_leaky_columns_are_never_picked(frame):
    df = frame.withColumns({"label_short": F.lit(1.0), "feature_a": F.lit(1.0), "text": F.lit("x")})
    assert K.pick_columns(df, patterns=["."]) == ["id", "v", "feature_a"]
    assert K.label_columns(df.columns) == ["label_short"]


def test_published_days_read_back_with_their_partitions(spark, tmp_path):
    from tickloom.sources.sinks import publish_days

    rows = [(f"2024-0{m}-01", f"s{m}", float(m)) for m in range(1, 5)]
    publish_days(spark.createDataFrame(rows, "date string, symbol string, v double"), str(tmp_path / "days"))
    got = S.read_table(spark, str(tmp_path / "days"), filters=[("date", ">=", "2024-03-01")])
    assert {"year", "date", "symbol", "v"} <= set(got.columns) and got.count() == 2
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString().replace("PartitionFilters: []", "")


def test_duplicates_resolve_alike_under_any_partitioning(spark):
    from tickloom.operators.reference import one_per_key

    rows = [(k % 5, v) for k in range(20) for v in (3, 1, 2, None)]
    df = spark.createDataFrame(rows, "k int, v int")
    results = [sorted(map(tuple, one_per_key(df.repartition(n), ["k"]).collect())) for n in (1, 7)]
    assert results[0] == results[1] == [(k, 3) for k in range(5)]
