"""Edge fixtures E1-E26 (FIXTURES.md §3) as small literal tables."""

import json


from lithos.functions.refs import data_references
from lithos.operators import catalog as C
from lithos.operators import holes as H
from lithos.operators.encode import category_codes, category_lookup, plan_attributes
from lithos.operators.profile import column_profile
from lithos.operators.quality import coordinate_summary, gate_status, segment_index_check
from lithos.plans.builders import IntervalConfig, build_downhole_collection, build_line_segments, build_pointset
from lithos.sources.csv_scan import read_typed_csv

PTS = "pos long, X double, Y double, Z double, rock string"


def _report(built):
    return built.report.first().asDict()


def test_e1_null_z_stays_in_arrays_not_in_box(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "a"), (1, 5.0, 6.0, None, "b"), (2, 2.0, 1.0, 0.0, "a")], PTS)
    b = build_pointset(df, "X", "Y", "Z", pos_col="pos")
    r = _report(b)
    assert r["status"] == "validation_passed"
    assert r["valid_rows"] == 2 and r["rows"] == 3
    assert r["max_x"] == 2.0 and r["min_z"] == 0.0
    assert "1 rows lack a coordinate" in r["warnings"]
    coords = b.array(b.arrays_of("coordinates")[0])
    assert coords.count() == 3


def test_e2_all_missing_fails(spark):
    df = spark.createDataFrame([(0, None, 2.0, 3.0, "a"), (1, 5.0, float("nan"), 1.0, "b")], PTS)
    assert _report(build_pointset(df, "X", "Y", "Z", pos_col="pos"))["status"] == "validation_failed"


def test_e3_infinite_box_fails(spark):
    df = spark.createDataFrame([(0, float("inf"), 2.0, 3.0, "a"), (1, 1.0, 1.0, 1.0, "b")], PTS)
    r = _report(build_pointset(df, "X", "Y", "Z", pos_col="pos"))
    assert r["valid_rows"] == 2  # inf is not missing
    assert r["status"] == "validation_failed"


def test_e4_first_appearance_lookup(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "pos long, rock string")
    lk = category_lookup(df, "rock", "pos")
    assert sorted(tuple(r) for r in lk.collect()) == [(1, "b"), (2, ""), (3, "a")]
    codes = category_codes(df, "rock", lk, keep=["pos"]).orderBy("pos")
    assert [r["rock"] for r in codes.collect()] == [1, 2, 3, 1]


def test_e5_numeric_coercion(spark, tmp_path):
    p = tmp_path / "e5.csv"
    p.write_text('v,w\n1e3,1\n" 4 ",2\nx,3\n"1,000",4\n0x10,5\n1d,6\n')
    from lithos.functions.numeric import coerce_double

    df = spark.read.option("header", True).csv(str(p))
    vals = [r[0] for r in df.select(coerce_double("v")).collect()]
    assert vals == [1000.0, 4.0, None, None, None, None]


def test_e6_type_ladder(spark, tmp_path):
    p = tmp_path / "e6.csv"
    p.write_text("i,e,b,bn,d,s\n1,,true,true,2024-01-01,x\nNA,,False,,2024-01-02,1\n3,,TRUE,false,2024-01-03,2\n")
    df = read_typed_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"i": "double", "e": "double", "b": "boolean", "bn": "string", "d": "string", "s": "string"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1.0, None, 3.0]
    assert [r["b"] for r in rows] == [True, False, True]


def test_e6_int_column_without_na_is_long(spark, tmp_path):
    p = tmp_path / "e6b.csv"
    p.write_text("i,f\n1,1.5\n-2,inf\n 3 ,-1e3\n")
    df = read_typed_csv(spark, str(p))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double"}
    assert [r["i"] for r in df.collect()] == [1, -2, 3]


def test_e7_boolean_attribute_is_category_with_warning(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0, True), (1, 2.0, 2.0, 2.0, False)],
                               "pos long, X double, Y double, Z double, active boolean")
    b = build_pointset(df, "X", "Y", "Z", pos_col="pos")
    assert any("of type boolean" in w for w in b.warnings)
    assert sorted(r["value"] for r in b.lookup("active").collect()) == ["False", "True"]


def test_e8_key_collision_reported(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`Au ppm` double, `au-ppm` double")
    specs, warns = plan_attributes(df, df.columns)
    assert [s.key for s in specs] == ["au_ppm", "au_ppm"]
    assert any("share the attribute key" in w for w in warns)


def test_e9_absent_or_role_attribute_skipped(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0, "a")], PTS)
    specs, warns = plan_attributes(df, ["nope", "X", "rock"], exclude=["X", "Y", "Z"])
    assert [s.name for s in specs] == ["rock"]
    assert len(warns) == 2


def _verts(spark, n=3):
    return spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(n)], "pos long, X double, Y double, Z double")


def test_e10_index_beyond_vertices_fails(spark):
    segs = spark.createDataFrame([(0, 0, 1), (1, 1, 3)], "pos long, s long, e long")
    r = _report(build_line_segments(_verts(spark), segs, "X", "Y", "Z", "s", "e", vertex_pos="pos", segment_pos="pos"))
    assert r["status"] == "validation_failed" and r["bad_end"] == 1


def test_e11_negative_null_fractional_fail(spark):
    segs = spark.createDataFrame([(0, -1.0, 1.0), (1, None, 2.0), (2, 1.5, 0.0)], "pos long, s double, e double")
    r = segment_index_check(_verts(spark), segs, "s", "e").first()
    assert r["bad_start"] == 3 and r["status"] == "validation_failed"


def _collar(spark, ids):
    return spark.createDataFrame([(i, h, float(i), 0.0, 0.0) for i, h in enumerate(ids)],
                                 "pos long, HOLE_ID string, X double, Y double, Z double")


def test_e12_index_map_and_zero_distance(spark):
    collar = _collar(spark, ["A", "B", "C"])
    survey = spark.createDataFrame([(0, "A", 0.0), (1, "A", 10.0), (2, "C", 5.0)], "pos long, HOLE_ID string, DEPTH double")
    lk = H.hole_lookup(collar, "HOLE_ID")
    idx = {tuple(r) for r in H.hole_index_map(survey, "HOLE_ID", lk).collect()}
    assert idx == {(1, 0, 2), (2, 0, 0), (3, 2, 1)}
    dist = {r["hole_id"]: r["final"] for r in H.hole_distances(collar, survey, "HOLE_ID", "HOLE_ID", "DEPTH").collect()}
    assert dist == {"A": 10.0, "B": 0.0, "C": 5.0}


def test_e13_orphan_advances_offset(spark):
    collar = _collar(spark, ["A", "C"])
    iv = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "pos long, HOLE_ID string")
    lk = H.hole_lookup(collar, "HOLE_ID")
    idx = {tuple(r) for r in H.hole_index_map(iv, "HOLE_ID", lk).collect()}
    assert idx == {(1, 0, 1), (2, 2, 1)}
    assert [tuple(r) for r in H.orphan_rows(iv, "HOLE_ID", lk).collect()] == [("B", 1)]


def test_e14_duplicate_collar_id(spark):
    collar = _collar(spark, ["A", "A", "B"])
    survey = spark.createDataFrame([(0, "A", 1.0, 0.0, -60.0)], "pos long, HOLE_ID string, D double, AZ double, DIP double")
    b = build_downhole_collection(collar, survey, "HOLE_ID", "HOLE_ID", "X", "Y", "Z", "D", "AZ", "DIP")
    r = _report(b)
    assert any("share 2 hole ids" in w for w in r["warnings"])
    assert b.lookup("HOLE_ID").count() == 2
    keys = H.collar_keys(collar, "HOLE_ID", b.lookup("HOLE_ID")).collect()
    assert sorted(r["key"] for r in keys) == [1, 1, 2]


def test_e15_given_max_depth_keeps_null(spark):
    collar = spark.createDataFrame([("A", 10.0), ("B", None)], "HOLE_ID string, MAX_DEPTH double")
    survey = spark.createDataFrame([("A", 99.0)], "HOLE_ID string, DEPTH double")
    d = {r["hole_id"]: r["final"] for r in H.hole_distances(collar, survey, "HOLE_ID", "HOLE_ID", "DEPTH", "MAX_DEPTH").collect()}
    assert d == {"A": 10.0, "B": None}


def test_e16_e17_invert_and_deterministic_sort(spark):
    collar = _collar(spark, ["A", "B"])
    rows = [(i, "AB"[i % 2], float(30 - i), 10.0, -45.0) for i in range(30)]
    survey = spark.createDataFrame(rows, "pos long, HOLE_ID string, D double, AZ double, DIP double")
    expected = sorted(((h, d) for _, h, d, _, _ in rows))
    for parts in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        b = build_downhole_collection(collar, survey.repartition(parts), "HOLE_ID", "HOLE_ID", "X", "Y", "Z", "D", "AZ", "DIP",
                                      invert_z=True, survey_pos="pos", collar_pos="pos")
        path = b.array(b.arrays_of("path")[0]).orderBy("pos").collect()
        assert [r["pos"] for r in path] == list(range(30))
        assert [r["distance"] for r in path] == [d for _, d in expected]
        assert all(r["dip"] == 45.0 and r["azimuth"] == 10.0 for r in path)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_e18_numeric_ids_are_text(spark):
    collar = spark.createDataFrame([(1,), (2,), (10,)], "HOLE_ID long")
    assert [tuple(r) for r in H.hole_lookup(collar, "HOLE_ID").orderBy("key").collect()] == [(1, "1"), (2, "10"), (3, "2")]


def test_e19_run_index_on_unsorted_rows(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "A")], "pos long, h string")
    lk = spark.createDataFrame([(1, "A"), (2, "B")], "key int, value string")
    runs = sorted(tuple(r) for r in H.run_length_index(df, "h", "pos", lk).collect())
    assert runs == [(1, 0, 2), (1, 3, 1), (2, 2, 1)]


E20 = '{"a":{"data":"h1"},"b":[{"data":"h1"},{"data":{"data":"h2"}}],"x\\"data":"no","s":"\\"data\\": \\"no2\\""}'


def test_e20_data_references(spark):
    df = spark.createDataFrame([(E20,)], "document string")
    assert df.select(data_references("document")).first()[0] == ["h1", "h1", "h2"]


def _objects(spark, rows):
    return spark.createDataFrame(rows, "workspace_id string, id string, name string, path string, schema_id string, "
                                       "version_id string, created_at timestamp, created_by string, deleted boolean, document string")


def _ts(s):
    import datetime
    return datetime.datetime.fromisoformat(s)


def test_e21_duplicate_workspace_counts(spark):
    doc = lambda *ids: json.dumps({"parts": [{"data": i} for i in ids]})
    objs = _objects(spark, [
        ("w", "o1", "n1", "/p1", "pointset", "1", _ts("2024-01-01"), "u", False, doc("h1")),
        ("w", "o2", "n2", "/p2", "pointset", "2", _ts("2024-01-01"), "u", False, doc("h1", "h2")),
        ("w", "o3", "n3", "/p3", "pointset", "3", _ts("2024-01-01"), "u", False, doc("missing")),
    ])
    blobs = spark.createDataFrame([("w", "h1", 10), ("w", "h2", 20)], "workspace_id string, blob_id string, length long")
    res = C.duplicate_workspace(objs, blobs, "w", "t")
    assert tuple(res["counts"].first()) == (2, 1, 2)
    assert res["new_objects"].count() == 2
    assert sorted(r["blob_id"] for r in res["new_blobs"].collect()) == ["h1", "h2"]


def test_e22_e23_versions_and_schema_filter(spark):
    objs = _objects(spark, [
        ("w", "o1", "n1", "/p1", "pointset", "1", _ts("2024-01-01"), "u", False, "{}"),
        ("w", "o1", "n1", "/p1", "pointset", "2", _ts("2024-02-01"), "u", False, "{}"),
        ("w", "o2", "n2", "/p2", "line-segments", "3", _ts("2024-01-05"), "u", False, "{}"),
    ])
    listed = C.list_objects(objs, "w").collect()
    assert sorted((r["id"], r["version_id"]) for r in listed) == [("o1", "2"), ("o2", "3")]
    assert [r["id"] for r in C.list_objects(objs, "w", schema_id="line-segments").collect()] == ["o2"]
    assert [r["version_id"] for r in C.object_versions(objs, "w", object_id="o1").collect()] == ["2", "1"]
    summ = {(r["schema_id"], r["objects"]) for r in C.workspace_summary(objs).collect()}
    assert summ == {("pointset", 1), ("line-segments", 1), (None, 2)}
    assert C.get_object(objs, "w", object_id="o1", version="1").first()["version_id"] == "1"


def test_e24_bad_interval_config_fails(spark):
    collar = _collar(spark, ["A"])
    survey = spark.createDataFrame([("A", 1.0, 0.0, -60.0)], "HOLE_ID string, D double, AZ double, DIP double")
    good = spark.createDataFrame([("A", 0.0, 1.0)], "HOLE_ID string, FROM double, TO double")
    bad = spark.createDataFrame([("A", 0.0)], "HOLE_ID string, FROM double")
    b = build_downhole_collection(collar, survey, "HOLE_ID", "HOLE_ID", "X", "Y", "Z", "D", "AZ", "DIP",
                                  collections=[IntervalConfig("good", good, "HOLE_ID", "FROM", "TO"),
                                               IntervalConfig("bad", bad, "HOLE_ID", "FROM", "TO")])
    r = _report(b)
    assert r["status"] == "validation_failed" and any("intervals 'bad'" in e for e in r["errors"]) and r["rows"] == 1


def test_e25_profile_all_null_numeric(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "v double, s string")
    prof = {r["column"]: r for r in column_profile(df).collect()}
    assert prof["v"]["non_null_count"] == 0 and prof["v"]["unique_count"] == 0
    assert prof["v"]["min"] is None and prof["v"]["max"] is None
    assert prof["s"]["null_count"] == 1 and prof["s"]["dtype"] == "object"


def test_e26_null_text_id_is_a_hole(spark):
    collar = spark.createDataFrame([(None,), ("A",)], "HOLE_ID string")
    assay = spark.createDataFrame([(None, 1.0), ("A", 2.0), (None, 3.0)], "HOLE_ID string, v double")
    lk = H.hole_lookup(collar, "HOLE_ID")
    assert [tuple(r) for r in lk.orderBy("key").collect()] == [(1, ""), (2, "A")]
    idx = {tuple(r) for r in H.hole_index_map(assay, "HOLE_ID", lk).collect()}
    assert idx == {(1, 0, 2), (2, 2, 1)}


def test_gate_status_messages(spark):
    df = spark.createDataFrame([(1.0, None, 1.0)], "x double, y double, z double")
    r = gate_status(coordinate_summary(df, "x", "y", "z")).first()
    assert r["status"] == "validation_failed" and r["errors"] == ["none of the rows has all three coordinates"]


def test_sorted_rows_without_ties_is_total(spark):
    from lithos.plans.builders import sorted_rows

    df = spark.createDataFrame([("A", 1.0, "z"), ("A", 1.0, "b"), ("B", 0.0, "a"), ("A", 0.5, "q")], "h string, d double, t string")
    got = [(r["h"], r["d"], r["t"]) for r in sorted_rows(df, "h", "d").orderBy("pos").collect()]
    assert got == [("A", 0.5, "q"), ("A", 1.0, "b"), ("A", 1.0, "z"), ("B", 0.0, "a")]
