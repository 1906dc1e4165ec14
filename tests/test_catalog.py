"""Catalog relations on flat references: any number of them, missing blobs, deleted objects, appends."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lithos.operators import catalog as C
from lithos.operators.position import intermediates_removed, materialize
from lithos.plans import oracle as O
from lithos.plans import roles as R
from tests.oracle_harness import duck

OBJECT = ("workspace_id string, id string, name string, path string, schema_id string, version_id string, "
          "created_at timestamp, created_by string, deleted boolean, document string")


def _objects(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(w, i, f"n{i}", f"/{i}", "pointset", v, day, "u", gone, json.dumps({"parts": [{"data": b} for b in refs]}))
                                  for w, i, v, gone, refs in rows], OBJECT)


def _blobs(spark, rows):
    return spark.createDataFrame([(w, b, 1) for w, b in rows], "workspace_id string, blob_id string, length long")


def test_a_thousand_references_make_one_object(spark, tmp_path):
    ids = [f"h{i}" for i in range(1000)]
    objs = _objects(spark, [("w", "o1", "1", False, ids)])
    res = C.duplicate_workspace(objs, _blobs(spark, [("w", b) for b in ids]), "w", "t")
    assert tuple(res["counts"].first()) == (1, 0, 1000)
    assert res["new_objects"].count() == 1 and res["new_blobs"].count() == 1000
    path = str(tmp_path / "objects")
    appended = C.append_objects(res["new_objects"], path).collect()
    stored = spark.read.parquet(path)
    assert [r["id"] for r in appended] == [r["id"] for r in stored.collect()]
    assert C.list_objects(stored, "t").count() == 1
    assert C.object_references(stored).count() == 1000
    again = C.append_objects(res["new_objects"], path).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in appended] and spark.read.parquet(path).count() == 1


def test_blobs_are_looked_up_in_their_workspace(spark):
    objs = _objects(spark, [("w", "o1", "1", False, ["a", "b"]), ("v", "o2", "2", False, ["a"])])
    matched, failed = C.object_blobs(objs, _blobs(spark, [("v", "a"), ("v", "b"), ("v", "a")]))
    assert [tuple(r)[:3] for r in matched.select("workspace_id", "id", "blob_id").collect()] == [("v", "o2", "a")]
    assert [r["id"] for r in failed.collect()] == ["o1"]


def test_another_document_at_the_same_path_is_a_further_version(spark, tmp_path):
    path = str(tmp_path / "objects")
    new = lambda *docs: spark.createDataFrame([("1", "n", "/p", "pointset", d) for d in docs],
                                              "workspace_id string, name string, path string, schema_id string, document string")
    a = C.append_objects(new("a", "a"), path).collect()
    b = C.append_objects(new("b"), path).collect()
    assert len(a) == len(b) == 1 and a[0]["id"] == b[0]["id"] and a[0]["version_id"] != b[0]["version_id"]
    assert spark.read.schema("workspace_id string, id string").parquet(path).select("workspace_id").distinct().first()[0] == "1"
    assert C.append_objects(new(), path).count() == 0


def test_copies_end_in_the_target_once(spark, tmp_path):
    objs = _objects(spark, [("w", "o1", "1", False, ["a", "b", "a"]), ("w", "o2", "2", False, []), ("w", "o3", "3", False, ["gone"])])
    blobs = _blobs(spark, [("w", "a"), ("w", "b"), ("t", "b")])
    now = dt.datetime(2024, 5, 1)
    base = str(tmp_path)
    copied = C.duplicate_workspace(objs, blobs, "w", "t")
    added = {k: v.count() for k, v in C.store_copies(copied, base, "w", now).items()}
    assert added == {"objects": 2, "references": 3, "blobs": 1}
    stored = C.stored_table(spark, f"{base}/objects", C.store_copies(copied, base, "w", now)["objects"].schema)
    refs = spark.read.parquet(f"{base}/references")
    listed = C.list_objects(stored, "t").collect()
    assert {(r["name"], r["path"]) for r in listed} == {("no1", "/o1"), ("no2", "/o2")} and not {r["id"] for r in listed} & {"o1", "o2"}
    one = next(r for r in listed if r["name"] == "no1")
    mine = refs.filter(F.col("id") == one["id"]).orderBy("ordinal")
    assert [(r["version_id"], r["blob_id"]) for r in mine.collect()] == [(one["version_id"], b) for b in ("a", "b", "a")]
    again = {k: v.count() for k, v in C.store_copies(C.duplicate_workspace(objs, blobs, "w", "t"), base, "w", dt.datetime(2025, 1, 1)).items()}
    assert again == {"objects": 0, "references": 0, "blobs": 0}
    # the same object copied elsewhere is another object
    C.store_copies(C.copy_object(objs, blobs, "w", "u", "o1"), base, "w", now)
    assert spark.read.parquet(f"{base}/objects").select("id").distinct().count() == 3


def test_long_name_lists_are_joined_behind_a_bloom_filter(spark, tmp_path):
    objs = _objects(spark, [("w", f"o{i}", "1", False, []) for i in range(50)])
    names = spark.range(100_000).select(F.concat(F.lit("no"), F.col("id") * 7).alias("wanted"))
    assert {r["name"] for r in C.filter_objects(objs, name_filter=names).collect()} == {f"no{i}" for i in range(0, 50, 7)}
    few = [f"no{i}" for i in range(0, 50, 7)] + [f"x{i}" for i in range(500)]
    assert C.filter_objects(objs, name_filter=few).count() == 8 and C.filter_objects(objs, name_filter=["no1", "zz"]).count() == 1
    assert C.filter_objects(objs, name_filter=names.limit(0)).count() == 0 and C.filter_objects(objs).count() == 50
    spark.range(200_000).select(F.concat(F.lit("no"), F.col("id")).alias("name"), F.lit("pointset").alias("schema_id")).write.parquet(str(tmp_path / "o"))
    names.write.parquet(str(tmp_path / "n"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")}
    for k, v in zip(old, ("-1", "1KB")):
        spark.conf.set(k, v)
    try:
        found = C.filter_objects(spark.read.parquet(str(tmp_path / "o")), name_filter=spark.read.parquet(str(tmp_path / "n")))
        assert "might_contain" in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 28_572
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_an_object_with_a_missing_blob_is_not_copied(spark):
    objs = _objects(spark, [("w", "o1", "1", False, ["a", "a", "gone"])])
    res = C.copy_object(objs, _blobs(spark, [("w", "a")]), "w", "t", "o1")
    assert tuple(res["counts"].first()) == (0, 1, 0)
    assert res["new_objects"].count() == 0 and res["new_blobs"].count() == 0 and res["new_references"].count() == 0


def test_deleted_objects_are_left_out(spark):
    objs = _objects(spark, [("w", "o1", "1", True, ["a"]), ("w", "o2", "2", False, ["a"])])
    ws = spark.createDataFrame([("w", "W", "d")], "id string, name string, description string")
    total = lambda **k: {r["objects"] for r in C.workspace_summary(objs, **k).collect() if r["schema_id"] is None}
    assert total() == {1} and total(include_deleted=True) == {2}
    assert [r["object_id"] for r in C.workspace_snapshot(objs, ws, "w", "s", "t", True).collect()] == ["o2"]
    assert C.snapshot_references(objs, "w", "s").count() == 1
    blobs = _blobs(spark, [("w", "a")])
    assert tuple(C.duplicate_workspace(objs, blobs, "w", "t")["counts"].first()) == (1, 0, 1)
    assert tuple(C.duplicate_workspace(objs, blobs, "w", "t", include_deleted=True)["counts"].first()) == (2, 0, 1)


def test_flat_references_equal_the_documents_references(spark, sf_dir):
    got = sorted(tuple(r) for r in R.references(spark, sf_dir).collect())
    want = sorted(tuple(r) for r in duck(sf_dir).execute(
        f"WITH {O.OBJ} SELECT o.workspace_id, o.id, o.version_id, r.ordinal, r.blob_id FROM obj o JOIN refs r "
        "ON r.l_orderkey = o.o_orderkey").fetchall())
    assert got == want
    objs = _objects(spark, [("w", "o1", "1", False, ["x", "y", "x"])])
    flat = C.document_references(objs)
    assert sorted(tuple(r) for r in C.object_references(objs, flat).collect()) == sorted(tuple(r) for r in flat.collect())


def test_lookup_needs_an_id_or_a_path(spark):
    with pytest.raises(ValueError):
        C.get_object(_objects(spark, []), "w")


def test_the_store_holds_some_blobs_and_lacks_others(spark, sf_dir):
    """The derived data meets both cases, so the copies of the registered queries succeed and fail."""
    checked = C.checked_references(R.objects(spark, sf_dir), R.blobs(spark, sf_dir), R.references(spark, sf_dir))
    held = {r[0] for r in checked.select("held").distinct().collect()}
    assert held == {True, None}


def test_intermediates_are_removed(spark):
    from lithos.session import ensure_checkpoint_dir

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(fs.listStatus(hadoop))
    with intermediates_removed(spark):
        assert materialize(spark.range(5).toDF("k")).count() == 5
        assert len(fs.listStatus(hadoop)) == before + 1
    assert len(fs.listStatus(hadoop)) == before


def test_references_write_only_the_columns_they_need(spark, sf_dir, monkeypatch):
    from lithos.operators import position
    from lithos.plans import roles as R

    written, write = [], position.materialize_path
    monkeypatch.setattr(position, "materialize_path", lambda df: written.append(set(df.columns)) or write(df))
    found = R._references(spark, sf_dir)
    assert len(written) == 1 and written[0] <= {"l_orderkey", "l_partkey", "l_quantity", position.PID, position.LOCAL}
    per = found.groupBy("version_id").agg({"ordinal": "max", "*": "count"}).collect()
    assert per and all(r["max(ordinal)"] == r["count(1)"] - 1 for r in per)
