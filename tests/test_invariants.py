"""Invariants and partition invariance (§5.4)."""

import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import holes as H
from lithos.operators.encode import category_codes, category_lookup, category_lookups
from lithos.operators.position import with_exclusive_prefix_sum, with_file_position, with_ordered_index
from lithos.operators.quality import bounding_box
from lithos.plans import roles as R


def test_ordered_index_is_dense_and_sorted(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 50), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = with_ordered_index(df, ["k", "v"]).collect()
    assert sorted(r["pos"] for r in out) == list(range(3000))
    by_pos = [(r["k"], r["v"]) for r in sorted(out, key=lambda r: r["pos"])]
    assert by_pos == sorted(rows)


def test_ordered_index_hot_key_spreads(spark):
    # one key holds a third of the rows; the tie-breaker lets the range partitioner split it
    rows = [(0, i) for i in range(1000)] + [(i % 97 + 1, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int")
    out = with_ordered_index(df, ["k", "t"]).collect()
    assert sorted(r["pos"] for r in out) == list(range(3000))


def test_prefix_sum(spark):
    df = spark.createDataFrame([(k, w) for k, w in zip("edcba", [5, 1, 0, 3, 2])], "k string, w long")
    got = {r["k"]: r["s"] for r in with_exclusive_prefix_sum(df, ["k"], "w", "s").collect()}
    assert got == {"a": 0, "b": 2, "c": 5, "d": 5, "e": 6}


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_partition_invariance(spark, sf_dir, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        lk = H.hole_lookup(R.collar(spark, sf_dir), "hole_id")
        idx = H.hole_index_map(R.survey(spark, sf_dir), "hole_id", lk)
        got = sorted(tuple(r) for r in idx.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    lk8 = H.hole_lookup(R.collar(spark, sf_dir), "hole_id")
    ref = sorted(tuple(r) for r in H.hole_index_map(R.survey(spark, sf_dir), "hole_id", lk8).collect())
    assert got == ref


def test_index_counts_and_offsets(spark, sf_dir):
    col = R.collar(spark, sf_dir).filter(F.col("o_orderstatus") != "P")
    survey = R.survey(spark, sf_dir)
    lk = H.hole_lookup(col, "hole_id")
    idx = H.hole_index_map(survey, "hole_id", lk).collect()
    orphans = sum(r["rows"] for r in H.orphan_rows(survey, "hole_id", lk).collect())
    assert sum(r["count"] for r in idx) == survey.count() - orphans
    keys = sorted(r["hole_index"] for r in idx)
    assert keys == list(range(1, len(keys) + 1))
    # offsets are the exclusive prefix sum over all holes in the data, orphans included
    counts = {r["value"]: r["count"] for r in H.hole_counts(survey, "hole_id").collect()}
    run, expect = 0, {}
    for h in sorted(counts):
        expect[h] = run
        run += counts[h]
    by_key = {r["key"]: r["value"] for r in lk.collect()}
    for r in idx:
        if r["count"]:
            assert r["offset"] == expect[by_key[r["hole_index"]]]


def test_decode_encode_roundtrip(spark, sf_dir):
    ev = R.events(spark, sf_dir)
    lk = category_lookup(ev, "event_type", "event_id")
    codes = category_codes(ev, "event_type", lk, keep=["event_id"], name="code")
    dec = codes.join(lk.withColumnRenamed("key", "code"), "code").select("event_id", "value")
    orig = ev.select("event_id", F.coalesce("event_type", F.lit("")).alias("value"))
    assert dec.exceptAll(orig).count() == 0 and orig.exceptAll(dec).count() == 0
    keys = sorted(r["key"] for r in lk.collect())
    assert keys == list(range(1, len(keys) + 1))


def test_multi_attribute_lookups_match_single(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = with_ordered_index(li, list(R.LINEITEM_ORDER))
    multi = category_lookups(li, ["l_returnflag", "l_linestatus"], "pos")
    for c in ("l_returnflag", "l_linestatus"):
        single = {tuple(r) for r in category_lookup(li, c, "pos").collect()}
        assert {(r["key"], r["value"]) for r in multi.filter(F.col("attribute") == c).collect()} == single


def test_box_contains_valid_points(spark, sf_dir):
    pts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("z"))
    b = bounding_box(pts, "x", "y", "z").first()
    outside = pts.filter((F.col("x") < b["min_x"]) | (F.col("x") > b["max_x"]) | (F.col("y") < b["min_y"])
                         | (F.col("y") > b["max_y"]) | (F.col("z") < b["min_z"]) | (F.col("z") > b["max_z"]))
    assert outside.count() == 0


def test_file_position_parquet(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = with_file_position(ev.select("event_id", "_metadata"), "pos")
    assert out.filter(F.col("pos") != F.col("event_id")).count() == 0


def test_file_position_csv_many_splits(spark, tmp_path):
    p = tmp_path / "big.csv"
    n = 20000
    p.write_text("i,pad\n" + "".join(f"{i},{'x' * 40}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = spark.read.option("header", True).csv(str(p))
        assert raw.rdd.getNumPartitions() > 5
        out = with_file_position(raw.select("i", "_metadata"), "pos", parquet=False)
        assert out.filter(F.col("pos") != F.col("i").cast("long")).count() == 0
        assert out.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hot_key_is_split_across_partitions(spark):
    from lithos.operators.position import ranged

    # a third of all rows share the leading key; distinct tie-breakers let the range
    # partitioner cut inside it, so no partition holds the whole hot group
    rows = [(0, i) for i in range(3000)] + [(1 + i % 500, i) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranged(spark.createDataFrame(rows, "k int, t int"), ["k", "t"])
        sizes = {r["__pid"]: r["n"] for r in out.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
        hot = {r["__pid"] for r in out.filter("k = 0").select("__pid").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(hot) >= 2
    assert max(sizes.values()) < 3000


def test_hole_indexes_one_pass_equals_separate(spark, sf_dir):
    col = R.collar(spark, sf_dir).filter(F.col("o_orderstatus") != "P")
    survey = R.survey(spark, sf_dir)
    rflag = R.intervals(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    lookup, maps = H.hole_indexes(col, "hole_id", {"survey": (survey, "hole_id"), "r": (rflag, "hole_id")})
    lk = H.hole_lookup(col, "hole_id")
    assert sorted(tuple(r) for r in lookup.collect()) == sorted(tuple(r) for r in lk.collect())
    for name, df in (("survey", survey), ("r", rflag)):
        ref = sorted(tuple(r) for r in H.hole_index_map(df, "hole_id", lk).collect())
        assert sorted(tuple(r) for r in maps[name].collect()) == ref
