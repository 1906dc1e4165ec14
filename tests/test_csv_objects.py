"""CSV files to objects: parity of the reader, statuses, gate on odd inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lithos.functions.refs import data_references
from lithos.operators import arrays as A
from lithos.operators import holes as H
from lithos.operators.encode import plan_attributes
from lithos.plans import csv_objects as O
from lithos.plans.builders import build_downhole_collection, build_pointset, create_object, write_object
from lithos.session import ensure_checkpoint_dir
from lithos.sources.csv_scan import CsvParseError, csv_problems, read_typed_csv


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_quotes_and_text_columns(spark, tmp_path):
    p = _file(tmp_path, "a.csv", 'id,v,b\n001,"say ""hi"", ok",true\n1,,\n2,"x",FALSE\n')
    rows = [tuple(r) for r in read_typed_csv(spark, p, text_columns=["id"]).collect()]
    assert rows == [("001", 'say "hi", ok', "True"), ("1", None, None), ("2", "x", "False")]


def test_rows_that_do_not_fit_are_reported(spark, tmp_path):
    p = _file(tmp_path, "b.csv", "id,v\n1,2,3\n4,5\n6\n")
    assert csv_problems(spark, p) == {"surplus": 1, "short": 1, "open_quote": 0}
    with pytest.raises(CsvParseError):
        read_typed_csv(spark, p)
    q = _file(tmp_path, "c.csv", 'id,v\n1,"a\nb"\n2,c\n')
    for multi_line in (False, True):
        assert sorted(tuple(r) for r in read_typed_csv(spark, q, multi_line=multi_line).collect()) == [(1, "a\nb"), (2, "c")]
    r = _file(tmp_path, "d.csv", 'id,v\n1,"a\nb\n2,c\n')
    assert csv_problems(spark, r)["open_quote"] == 1
    with pytest.raises(CsvParseError):
        read_typed_csv(spark, r)


def test_ids_with_a_blank_stay_text(spark, tmp_path):
    collar = _file(tmp_path, "collar.csv", "H,X\n1,0\n001,1\n2,2\n")
    survey = _file(tmp_path, "survey.csv", "H,D\n1,5\n,7\n001,9\n")
    c, _ = O.load(spark, collar, "collars", ["H"])
    s, _ = O.load(spark, survey, "survey", ["H"])
    got = {r["hole_id"]: r["final"] for r in H.hole_distances(c, s, "H", "H", "D").collect()}
    assert got == {"1": 5.0, "001": 9.0, "2": 0.0}


def test_statuses(spark, tmp_path):
    good = _file(tmp_path, "p.csv", "X,Y,Z,rock\n1,2,3,a\n4,5,6,b\n")
    text = _file(tmp_path, "t.csv", "X,Y,Z\n1,2,deep\n4,5,6\n")
    wide = _file(tmp_path, "w.csv", "X,Y,Z\n1,2,3,4\n")
    report = lambda p: O.pointset_from_csv(spark, p, "X", "Y", "Z").report.first()
    assert report(good)["status"] == "validation_passed"
    r = report(text)
    assert r["status"] == "validation_failed" and r["rows"] == 2 and any("'Z'" in e for e in r["errors"])
    assert report(wide)["status"] == "error" and report(str(tmp_path / "none.csv"))["status"] == "error"


def test_pointset_file_to_stored_object(spark, tmp_path):
    p = _file(tmp_path, "p.csv", "X,Y,Z,rock,pos\n1,2,3,b,7\n4,5,6,a,7\n7,8,9,b,1\n")
    built = O.pointset_from_csv(spark, p, "X", "Y", "Z", name="pts")
    doc = json.loads(write_object(built, str(tmp_path / "arrays")).first()["document"])
    rock, pos = doc["locations"]["attributes"]
    assert rock["table"]["length"] == 2 and rock["values"]["length"] == 3 and rock["nan_description"] == {"values": []}
    assert pos["name"] == "pos" and pos["attribute_type"] == "continuous"  # a data column like any other
    values = spark.read.parquet(f"{tmp_path}/arrays/values/{pos['values']['data']}").orderBy("pos").collect()
    assert [(r["pos"], r["data"]) for r in values] == [(0, 7.0), (1, 7.0), (2, 1.0)]
    res = create_object(O.pointset_from_csv(spark, p, "X", "Y", "Z", name="pts"), str(tmp_path / "a2"), str(tmp_path / "o"), "w", "/p",
                        dry_run=False)
    assert res["status"] == "created"


def test_collection_keeps_the_gate_when_a_file_is_missing(spark, tmp_path):
    collar = _file(tmp_path, "c.csv", "H,X,Y,Z\nA,0,0,0\nB,1,1,1\n")
    survey = _file(tmp_path, "s.csv", "H,D,AZ,DIP\nA,5,0,-60\nA,1,0,-50\n")
    good = _file(tmp_path, "i.csv", "H,F,T,au\nB,0,1,0.5\nA,0,2,0.25\nA,2,3,\n")
    files = [O.IntervalFile(good, "assay", "H", "F", "T"), O.IntervalFile(str(tmp_path / "no.csv"), "geology", "H", "F", "T")]
    built = O.downhole_collection_from_csv(spark, collar, survey, files, "H", "H", "X", "Y", "Z", "D", "AZ", "DIP")
    r = built.report.first()
    assert r["status"] == "validation_failed" and r["rows"] == 2 and any("geology" in e for e in r["errors"])
    ids = built.collections["assay"]
    assert sorted(tuple(x) for x in built.array(ids["holes"]).collect()) == [(1, 0, 2), (2, 2, 1)]
    ft = built.array(ids["from_to"]).orderBy("pos").collect()
    assert [(x["data1"], x["data2"]) for x in ft] == [(0.0, 2.0), (2.0, 3.0), (0.0, 1.0)]


def test_segments_and_intervals_from_files(spark, tmp_path):
    v = _file(tmp_path, "v.csv", "X,Y,Z\n0,0,0\n1,1,1\n")
    s = _file(tmp_path, "s.csv", "a,b\n0,1\n1,2\n")
    r = O.line_segments_from_csv(spark, v, s, "X", "Y", "Z", "a", "b").report.first()
    assert (r["status"], r["bad_end"], r["vertices"]) == ("validation_failed", 1, 2)
    bad = _file(tmp_path, "s2.csv", "a,b\n0,one\n")
    assert O.line_segments_from_csv(spark, v, bad, "X", "Y", "Z", "a", "b").report.first()["status"] == "validation_failed"
    i = _file(tmp_path, "i.csv", "H,F,T,x,y,z\n01,0,1,1,2,3\n1,1,2,1,2,3\n")
    built = O.downhole_intervals_from_csv(spark, i, "H", "F", "T", *[["x", "y", "z"]] * 3)
    assert built.report.first()["unique_holes"] == 2
    assert sorted(tuple(x) for x in built.lookup("H").collect()) == [(1, "01"), (2, "1")]


def test_a_dry_run_of_a_collection_writes_nothing(spark):
    collar = spark.createDataFrame([("A", 0.0, 0.0, 0.0)], "H string, X double, Y double, Z double")
    survey = spark.createDataFrame([("A", 5.0, 0.0, -60.0)], "H string, D double, AZ double, DIP double")
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(fs.listStatus(folder))
    built = build_downhole_collection(collar, survey, "H", "H", "X", "Y", "Z", "D", "AZ", "DIP")
    assert create_object(built, "/nowhere", "/nowhere", "w", "/p")["status"] == "validation_passed"
    assert len(fs.listStatus(folder)) == before


def test_given_positions_must_number_the_rows(spark):
    df = spark.createDataFrame([(7, 1.0, 1.0, 1.0), (7, 2.0, 2.0, 2.0)], "p long, X double, Y double, Z double")
    r = build_pointset(df, "X", "Y", "Z", pos_col="p").report.first()
    assert r["status"] == "validation_failed" and any("'p'" in e for e in r["errors"])
    with pytest.raises(ValueError):
        build_pointset(df, "X", "Y", "Z").positioned()


def test_dotted_names_and_decimals(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "p long, `X.1` double, Y double, Z double").withColumn("d", F.lit("1.5").cast("decimal(9,2)"))
    built = build_pointset(df, "X.1", "Y", "Z", pos_col="p")
    assert built.report.first()["min_x"] == 1.0
    assert built.array(built.arrays_of("coordinates")[0]).first()["x"] == 1.0
    assert [s.kind for s in plan_attributes(df, ["d"])[0]] == ["continuous"]
    assert built.array(built.arrays_of("values")[0]).first()["data"] == 1.5


@pytest.mark.parametrize("start", [-1.0, 1.5, None])
def test_bad_index_pairs_are_refused_at_write_time(spark, tmp_path, start):
    df = spark.createDataFrame([(0, start, 1.0)], "pos long, s double, e double")
    with pytest.raises(Exception, match="missing, fractional or negative"):
        A.write_array(A.index_pairs(df, "s", "e"), str(tmp_path), "indices", "i1")


def test_references_of_long_and_escaped_values(spark):
    plain, escapes = "x" * 100_000, "\\\\" * 20_001
    doc = '{"data":"%s","a":{"data":"a\\"b\\u00e9"},"b":{"data":"%s"}}' % (plain, escapes)
    json.loads(doc)
    got = spark.createDataFrame([(doc,)], "d string").select(data_references("d")).first()[0]
    assert got == [plain, 'a"b\u00e9', "\\" * 20_001]


def test_runs_across_partitions_unknown_and_empty_ids(spark):
    rows = [(i, ["A", "A", "B", None][(i // 7) % 4]) for i in range(500)]
    lookup = spark.createDataFrame([(1, "A"), (2, ""), (3, "none")], "key int, value string")
    want, at = [(3, 0, 0)], 0
    while at < 500:
        end = at
        while end < 500 and rows[end][1] == rows[at][1]:
            end += 1
        key = {"A": 1, None: 2}.get(rows[at][1])
        if key:
            want.append((key, at, end - at))
        at = end
    for parts in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = sorted(tuple(r) for r in H.run_length_index(spark.createDataFrame(rows, "pos long, h string"), "h", "pos", lookup).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == sorted(want)


def test_hot_codes_without_broadcast(spark):
    """A value on a third of the rows, broadcast joins off: the sort-merge join still codes every row."""
    from lithos.operators.encode import category_codes, category_lookup

    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, v string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lk = category_lookup(df, "v", "pos")
        keys = dict((r["value"], r["key"]) for r in lk.collect())
        codes = {r["pos"]: r["v"] for r in category_codes(df, "v", lk, keep=["pos"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert codes == {i: keys[v] for i, v in rows}
