"""Empty inputs and JSON document helpers."""

from lithos.functions import document_keys, parse_document
from lithos.operators import holes as H
from lithos.operators.encode import category_lookup
from lithos.operators.position import with_ordered_index


def test_empty_input_empty_lookup_gives_empty_index(spark):
    empty_collar = spark.createDataFrame([], "HOLE_ID string")
    empty_rows = spark.createDataFrame([], "HOLE_ID string, v double")
    lk = H.hole_lookup(empty_collar, "HOLE_ID")
    assert lk.count() == 0
    assert H.hole_index_map(empty_rows, "HOLE_ID", lk).count() == 0


def test_empty_ordered_index_and_lookup(spark):
    df = spark.createDataFrame([], "k long, v string")
    assert with_ordered_index(df, ["k"]).count() == 0
    assert category_lookup(df, "v", "k").count() == 0


def test_document_helpers(spark):
    df = spark.createDataFrame([('{"name":"a","n":1}',), ("not json",)], "d string")
    keys = [r[0] for r in df.select(document_keys("d")).collect()]
    assert keys == [["name", "n"], None]
    parsed = df.select(parse_document("d", "name string, n int").alias("p")).first()["p"]
    assert parsed["name"] == "a" and parsed["n"] == 1
