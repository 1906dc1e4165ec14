"""Many objects in one plan, and arrays read by range."""

import json

import pytest
from pyspark.sql import functions as F

from lithos.operators import arrays as A
from lithos.operators import segmented as S
from lithos.operators.position import with_segmented_index, with_segmented_prefix_sum
from lithos.plans import batches as B
from lithos.plans.builders import build_pointset


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_segmented_index_restarts_and_spreads_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("g"), "id")
    out = with_segmented_index(df, ["g"], [F.col("id").desc()], name="pos", start=1).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["g"], []).append((r["pos"], r["id"]))
    assert len(out) == 5000 and len(groups["hot"]) == 1667
    for members in groups.values():
        members.sort()
        assert [p for p, _ in members] == list(range(1, len(members) + 1))
        assert [i for _, i in members] == sorted((i for _, i in members), reverse=True)


def test_a_hot_group_is_ranked_in_many_tasks(spark):
    from lithos.operators.position import PID, ranged

    spread = ranged(spark.range(0, 200_000, 1, 4).select(F.lit("hot").alias("g"), "id", F.sha2(F.col("id").cast("string"), 512).alias("x")), ["g", "id"])
    assert spread.select(PID).distinct().count() > 1


def test_segmented_prefix_sum(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 7, 0), ("b", 1, 2, 1), ("b", 2, 0, 1), ("b", 3, 4, 1)], "g string, o int, w long, u long")
    out = with_segmented_prefix_sum(df, ["g"], ["o"], ["w", "u"], ["sw", "su"])
    assert rows_of(out.select("g", "o", "sw", "su"), "g", "o") == [("a", 1, 0, 0), ("a", 2, 5, 1), ("b", 1, 0, 0), ("b", 2, 2, 1), ("b", 3, 2, 2)]


PTS = "k string, o int, x double, y double, z double, rock string, au double"


def points(spark):
    nan = float("nan")
    return spark.createDataFrame([
        ("a", 2, 1.0, 2.0, 3.0, "s", 0.5), ("a", 1, 2.0, None, 3.0, "t", None), ("a", 3, 4.0, 5.0, 6.0, None, 1.5),
        ("b", 1, None, 1.0, 1.0, "s", 1.0), ("b", 2, 1.0, nan, 1.0, "s", 1.0),  # no valid point
        ("c", 1, float("inf"), 1.0, 1.0, "s", 1.0),  # no finite box
        (None, 1, 7.0, 7.0, 7.0, "only", 9.0)], PTS)


def test_pointsets_gate_and_arrays_per_object(spark, tmp_path):
    batch = B.build_pointsets(points(spark), "k", "x", "y", "z", ["o"], ["rock", "au", "none"])
    report = {r["object"]: r for r in batch.report.collect()}
    assert {k: r["status"] for k, r in report.items()} == {
        "a": "validation_passed", "b": "validation_failed", "c": "validation_failed", "": "validation_passed"}
    assert report["a"]["valid_rows"] == 2 and "1 rows lack a coordinate" in report["a"]["warnings"]
    assert all("no column 'none' for an attribute; left out" in r["warnings"] for r in report.values())
    docs = {r["object"]: json.loads(r["document"]) for r in B.write_batch(batch, str(tmp_path)).collect()}
    assert set(docs) == {"a", ""}
    a = docs["a"]
    assert a["bounding_box"] == {"min_x": 1.0, "max_x": 4.0, "min_y": 2.0, "max_y": 5.0, "min_z": 3.0, "max_z": 6.0}
    ref = a["locations"]["coordinates"]
    assert ref["length"] == 3
    coords = A.read_range(spark, f"{tmp_path}/coordinates", "coordinates", ref["data"], 0, 10)
    assert rows_of(coords, "pos") == [(0, 2.0, None, 3.0), (1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)]
    rock, au = a["locations"]["attributes"]
    assert (rock["attribute_type"], au["attribute_type"]) == ("category", "continuous")
    lookup = A.read_range(spark, f"{tmp_path}/lookup", "lookup", rock["table"]["data"], 0, 10)
    assert rows_of(lookup, "pos") == [(1, 1, "t"), (2, 2, "s"), (3, 3, "")]
    codes = A.read_range(spark, f"{tmp_path}/codes", "codes", rock["values"]["data"], 0, 10)
    assert rows_of(codes, "pos") == [(0, 1), (1, 2), (2, 3)]
    # objects that failed have no rows in any array
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/coordinates").select("object").distinct().collect()} == {"a", ""}


def test_batch_equals_the_single_builder(spark):
    """Arrays of one object of a batch are those that the builder of one object gives."""
    df = points(spark)
    batch = B.build_pointsets(df, "k", "x", "y", "z", ["o"], ["rock", "au"])
    single = build_pointset(df.filter("k = 'a'").drop("k"), "x", "y", "z", attribute_cols=["rock", "au"], order_cols=["o"])
    for name, role in batch.roles.items():
        mine = batch.array(name).filter("object = 'a'").drop("object", *(["pos"] if role == "lookup" else []))
        other = single.array(single.arrays_of(role)[0])
        assert rows_of(mine, *mine.columns) == rows_of(other.select(*mine.columns), *mine.columns), name


def test_segments_are_held_against_their_own_vertices(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 1.0, 1.0), ("b", 0, 2.0, 2.0, 2.0), ("d", 0, 3.0, 3.0, 3.0)],
                              "k string, o int, x double, y double, z double")
    s = spark.createDataFrame([("a", 0, 0.0, 1.0), ("b", 0, 0.0, 1.0), ("c", 0, 0.0, 0.0), ("d", 0, 0.5, 0.0), ("d", 1, -1.0, None)],
                              "k string, o int, s double, e double")
    batch = B.build_line_segments(v, s, "k", "k", "x", "y", "z", "s", "e", ["o"], ["o"])
    got = {r["object"]: (r["status"], r["vertices"], r["segments"], r["bad_start"], r["bad_end"]) for r in batch.report.collect()}
    assert got == {"a": ("validation_passed", 2, 1, 0, 0), "b": ("validation_failed", 1, 1, 0, 1),
                   "c": ("validation_failed", 0, 1, 1, 1), "d": ("validation_failed", 1, 2, 2, 1)}


def test_holes_belong_to_their_object(spark):
    c = spark.createDataFrame([("p", "h2", 1.0, 1.0, 1.0), ("p", "h1", 2.0, 2.0, 2.0), ("q", "h1", 3.0, 3.0, 3.0)], "k string, id string, x double, y double, z double")
    s = spark.createDataFrame([("p", "h1", 5.0), ("p", "h1", 9.0), ("p", "zz", 1.0), ("q", "h1", 2.0), ("r", "h1", 4.0)], "k string, id string, d double")
    s = s.withColumns({"a": F.lit(0.0), "dip": F.lit(1.0)})
    batch = B.build_downhole_collections(c, s, "k", "k", "id", "id", "x", "y", "z", "d", "a", "dip", [], [], invert_z=True)
    assert rows_of(batch.array("lookup").drop("pos"), "object", "key") == [("p", 1, "h1"), ("p", 2, "h2"), ("q", 1, "h1")]
    # the orphan 'zz' keeps its row; rows of the unknown object r are left out
    assert rows_of(batch.array("holes").drop("pos"), "object", "hole_index") == [("p", 1, 0, 2), ("p", 2, 0, 0), ("q", 1, 0, 1)]
    assert rows_of(batch.array("distances").select("object", "pos", "final"), "object", "pos") == [("p", 0, 9.0), ("p", 1, 0.0), ("q", 0, 2.0)]
    assert rows_of(batch.array("path").select("object", "pos", "distance", "dip"), "object", "pos") == [
        ("p", 0, 5.0, -1.0), ("p", 1, 9.0, -1.0), ("p", 2, 1.0, -1.0), ("q", 0, 2.0, -1.0)]


def test_empty_tables_and_wrong_columns(spark, tmp_path):
    empty = points(spark).limit(0)
    batch = B.build_pointsets(empty, "k", "x", "y", "z", ["o"], ["rock"])
    assert batch.report.count() == 0 and B.write_batch(batch, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        B.build_pointsets(empty, "k", "x", "y", "nope", ["o"])
    with pytest.raises(ValueError):
        S.keyed(empty.withColumn("object", F.lit(1)), "k")


def test_a_range_opens_only_its_files(spark, tmp_path):
    df = spark.range(100_000).select(F.when(F.col("id") < 60_000, "a").otherwise("b").alias("array_id"), F.col("id").alias("pos"),
                                     F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"))
    target = str(tmp_path / "coordinates")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        A.write_ranged(df, target, "coordinates")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    every = spark.read.parquet(target).inputFiles()
    few = A.range_files(spark, target, "a", 30_000, 30_100)
    assert len(every) > 4 and len(few) <= 2
    part = A.read_range(spark, target, "coordinates", "a", 30_000, 30_100)
    assert len(part.inputFiles()) == len(few)
    assert [r["pos"] for r in part.orderBy("pos").collect()] == list(range(30_000, 30_100))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos,30000)" in plan and "EqualTo(array_id,a)" in plan
    assert A.read_range(spark, target, "coordinates", "zz", 0, 10).count() == 0
    assert A.read_range(spark, target, "coordinates", "a", 200_000, 200_010).count() == 0
    bad = spark.createDataFrame([("i", 0, -1, 2)], "array_id string, pos long, data1 long, data2 long")
    with pytest.raises(Exception, match="fractional or negative"):
        A.write_ranged(bad, str(tmp_path / "indices"), "indices")


def test_arrays_read_the_placed_rows_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", 2, 1.0, "u", 5.0), ("a", 1, 2.0, "v", 6.0), ("b", 1, 3.0, "u", 7.0)], "k string, o int, x double, unused string, au double")
    batch = B.build_pointsets(df, "k", "x", "x", "x", ["o", "unused"], ["au"])
    for name in ("coordinates", "values:au"):
        plan = batch.array(name)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "unused" not in plan
    assert rows_of(batch.array("values:au").select("object", "pos", "data"), "object", "pos") == [("a", 0, 6.0), ("a", 1, 5.0), ("b", 0, 7.0)]


def test_segmented_index_keeps_what_is_asked_for(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "g string, o int, v string")
    out = with_segmented_index(df, ["g"], ["o"], keep=["g", "v"])
    assert out.columns == ["g", "v", "pos"] and rows_of(out, "g", "pos") == [("a", "y", 0), ("a", "x", 1), ("b", "z", 0)]


def holes_of(spark, shared):
    """Collars and lines of ten objects and one without collars, one hole without a collar, values of three kinds; the
    lines are survey and intervals, as one table or two."""
    c = spark.range(40).select((F.col("id") % 10).alias("k"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hole"),
                               F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    c = c.withColumn("x", F.when(F.col("k") == 3, None).otherwise(F.col("x")))  # object 3 has no valid collar
    n = F.col("id")
    rows = spark.range(400).select((n % 11).alias("k"), F.concat(F.lit("h"), F.when(n % 50 == 0, 99).otherwise(n % 11 + 10 * (n % 3)).cast("string")).alias("hole"),
                                   (n * 7 % 13).cast("double").alias("d"), n.cast("double").alias("a"), (n % 5).cast("double").alias("dip"),
                                   n.alias("o"), F.when(n % 4 > 0, F.concat(F.lit("v"), (n % 4).cast("string"))).alias("rock"), (n / 3).alias("au"))
    rows = rows.filter((n % 11 != 7) | (n % 2 == 0))
    return B.build_downhole_collections(c, rows, "k", "k", "hole", "hole", "x", "y", "z", "d", "a", "dip", [], ["o"], [
        B.Intervals("i", rows if shared else rows.select("*"), "k", "hole", "d", "a", ["o"], ["rock", "au", "dip"])], invert_z=True, build="b")


def arrays_of(batch):
    return {name: sorted(tuple(r) for r in batch.array(name).na.fill(-1).collect()) for name in batch.roles}


def test_hot_objects_and_a_shared_table_give_the_same_arrays(spark, monkeypatch, tmp_path):
    plain = arrays_of(holes_of(spark, False))
    assert len(plain["path"]) > 300 and {r[0] for r in plain["path"]} == {str(k) for k in range(10)}
    assert arrays_of(holes_of(spark, True)) == plain
    # survey dips are inverted, the intervals' are not
    assert {r[3 + 1] for r in plain["path"]} <= {0.0, -1.0, -2.0, -3.0, -4.0} and {r[2] for r in plain["values:i.dip"]} == {0.0, 1.0, 2.0, 3.0, 4.0}
    monkeypatch.setattr(S, "HOT_ROWS", 36)  # some of them
    hot = holes_of(spark, True)
    assert 0 < len(hot.hot()) < 10
    assert arrays_of(hot) == plain
    docs = B.write_batch(hot, str(tmp_path)).collect()
    assert {r["object"] for r in docs} == {str(k) for k in range(10)} - {"3"}
    for name, role in hot.roles.items():
        stored = spark.read.parquet(f"{tmp_path}/{role}").filter(F.col("array") == name).drop("array_id", "array")
        assert sorted(tuple(r) for r in stored.na.fill(-1).collect()) == [r for r in plain[name] if r[0] != "3"], name


@pytest.mark.parametrize("few", [0, 100])
def test_arrays_are_written_in_the_order_of_their_rows(spark, monkeypatch, tmp_path, few):
    """No array is dealt anew by sampled ranges, and every file's first and last row are kept; so also where many failed."""
    dealt = []
    frame = type(spark.range(1))
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: dealt.append(a) or by_range(self, *a))
    monkeypatch.setattr(B, "_FEW", few)
    batch = holes_of(spark, True)
    docs = {r["object"]: json.loads(r["document"]) for r in B.write_batch(batch, str(tmp_path)).collect()}
    assert (not dealt) == (few > 0) and set(docs) == {str(k) for k in range(10)} - {"3"}
    for role in sorted(set(batch.roles.values())):
        key = F.struct("array_id", "pos")
        whole = spark.read.parquet(f"{tmp_path}/{role}").groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
        assert rows_of(spark.read.parquet(A.ranges_path(f"{tmp_path}/{role}")), "file") == rows_of(whole, "file")
    ref = docs["4"]["location"]["path"]
    path = A.read_range(spark, f"{tmp_path}/path", "path", ref["data"], 3, 9)
    assert rows_of(path, "pos") == rows_of(batch.array("path").filter("object = '4' and pos >= 3 and pos < 9").drop("object"), "pos")
    assert ref["length"] == batch.array("path").filter("object = '4'").count() > 9


def test_one_named_object_keeps_its_key_in_windows(spark, monkeypatch):
    from lithos.operators import position

    plans, write = [], position.materialize_path
    monkeypatch.setattr(position, "materialize_path", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    df = spark.range(30).select(F.lit("one").alias("k"), (-F.col("id")).alias("o"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    batch = B.build_pointsets(df, "k", "x", "x", "x", ["o"], ["c"])
    assert rows_of(batch.array("coordinates").select("pos", "x"), "pos") == [(i, 29.0 - i) for i in range(30)]
    assert rows_of(batch.array("codes:c"), "pos")[:4] == [("one", i, i % 3 + 1) for i in range(4)]
    windows = [line for p in plans for line in p.split("\n") if "Window" in line]
    assert len(windows) == 2 and all("__part" in w.split(" ASC")[0] for w in windows)
