"""Role mapping: geoscience inputs and an object catalog derived from the driver tables.

* points      = events (x=user_id, y=value, z=event_id; attribute event_type), and with
                NULLs documents LEFT JOIN labels (x=n_chars, y=quality, z=toxic)
* collar      = orders (hole id o_orderkey as text, x=o_custkey, y=o_totalprice, z=0)
* survey      = lineitem (hole l_orderkey, depth l_quantity, azimuth l_extendedprice, dip l_discount)
* intervals   = lineitem (from l_quantity, to l_quantity + l_linenumber)
* vertices    = part (position = p_partkey); segments = lineitem (l_partkey -> l_suppkey)
* catalog     = workspaces per customer market segment; one object per customer, one version
                per order with a header document; each line item is one row of the flat
                reference table (blob id ``blob-<l_partkey>``). A workspace's blob store holds the
                parts its references name that are also a customer key of another segment.

Only the columns a query uses are selected, so the parquet scans read just those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.sources.tables import read_table

# Full tie-break order of lineitem rows: the table has no unique key, but whole rows are
# distinct. The discount comes last because -0.0 and 0.0 compare equal in Spark.
LINEITEM_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount",
)

# Object type of a catalog object by its order priority.
SCHEMA_BY_PRIORITY = {
    "1-URGENT": "pointset",
    "2-HIGH": "line-segments",
    "3-MEDIUM": "downhole-collection",
    "4-NOT SPECIFIED": "downhole-intervals",
    "5-LOW": "pointset",
}

def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def docs_labels(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """documents LEFT JOIN labels; the text column is pruned from the scan unless asked for."""
    docs = read_table(spark, d, "documents").select("doc_id", *(["text"] if text else []), "lang", "source", "n_chars")
    labels = read_table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def collar(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("hole_id"),
        F.col("o_custkey").cast("double").alias("x"),
        F.col("o_totalprice").alias("y"),
        F.lit(0.0).alias("z"),
        F.col("o_orderstatus"),
    )


def survey(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("hole_id"),
        F.col("l_quantity").alias("depth"),
        F.col("l_extendedprice").alias("azimuth"),
        F.col("l_discount").alias("dip"),
        *[F.col(c) for c in LINEITEM_ORDER],
    )


def intervals(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("hole_id"),
        F.col("l_quantity").alias("from"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("to"),
        *[F.col(c) for c in LINEITEM_ORDER],
    )


def vertices(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("pos"),
        F.col("p_retailprice").alias("x"),
        F.col("p_size").cast("double").alias("y"),
        F.lit(0.0).alias("z"),
        F.col("p_brand"),
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("start_idx"), F.col("l_suppkey").alias("end_idx"),
                     *[F.col(c) for c in LINEITEM_ORDER])


def segment_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of many objects: the orders of every (market segment, nation); z is missing for orders in progress."""
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        key.alias("segment"), "o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("double")).alias("z"), "o_orderpriority", "o_orderstatus")


def customer_holes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(collars, survey) of many objects: every customer's orders are the holes of one collection."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    li = read_table(spark, d, "lineitem").select(*LINEITEM_ORDER)
    collars = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("string").alias("hole_id"),
                       F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), F.lit(0.0).alias("z"))
    rows = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("owner"), F.col("l_orderkey").cast("string").alias("hole_id"), F.col("l_quantity").alias("depth"),
        F.col("l_extendedprice").alias("azimuth"), F.col("l_discount").alias("dip"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("to"), *LINEITEM_ORDER)
    return collars, rows


def brand_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, segments) of many objects: the parts of every brand, joined by the lines that name one of them."""
    p = read_table(spark, d, "part")
    v = p.select("p_brand", "p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"),
                 F.lit(0.0).alias("z"), "p_type")
    li = read_table(spark, d, "lineitem").select(*LINEITEM_ORDER)
    s = li.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", (F.col("l_linenumber") - 1).cast("long").alias("start_idx"), F.col("l_linenumber").cast("long").alias("end_idx"),
        *LINEITEM_ORDER)
    return v, s


def _order_documents(spark: SparkSession, d: str, line, document) -> DataFrame:
    """Object versions with documents of their own making: one per order, ``document`` over ``lines`` (the JSON texts
    of the order's lines, made by ``line`` and joined by commas)."""
    li = read_table(spark, d, "lineitem").select(*LINEITEM_ORDER)
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(*LINEITEM_ORDER, line.alias("json")))), lambda x: x["json"]), ",").alias("lines"))
    dealt = _versions(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return dealt.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn(
        "lines", F.coalesce("lines", F.lit(""))).select(
        "workspace_id", _id().alias("id"), F.col("o_orderkey").cast("string").alias("version_id"), F.lit("pointset").alias("schema_id"),
        document.alias("document"))


def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    return STORE.table(spark, d, "nested_documents", _nested_documents, ("customer", "orders", "lineitem"))


def flawed_documents(spark: SparkSession, d: str) -> DataFrame:
    return STORE.table(spark, d, "flawed_documents", _flawed_documents, ("customer", "orders", "lineitem"))


def _nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with references twelve levels down, under a key written with an escape, and (finished orders) under
    keys that are repeated."""
    line = F.format_string('{"data":"blob-%d","length":%d}', F.col("l_partkey"), F.col("l_linenumber"))
    key = F.col("o_orderkey").cast("string")
    again = F.col("o_orderstatus") == "F"
    deep = F.concat(F.lit('"l1":' + "".join(f'{{"l{i}":' for i in range(2, 12)) + '{"data":"deep-'), F.col("o_custkey").cast("string"),
                    F.lit('"}' + "}" * 10))
    return _order_documents(spark, d, line, F.concat(
        F.lit('{"name":"\\"data\\":\\"no\\"","d\\u0061ta":"esc-'), key, F.lit('",'), F.when(again, '"part":{"data":"lost","x":[{"data":"lost"}]},').otherwise(""),
        deep, F.lit(',"parts":['), F.col("lines"), F.lit("]"),
        F.when(again, F.concat(F.lit(',"part":{"data":{"data":"kept-'), key, F.lit('"}}'))).otherwise(""), F.lit("}")))


def _flawed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of pointsets with faults of every kind, by order status and priority and by line."""
    line = F.concat(F.lit('{"name":"a",'), F.when(F.col("l_linenumber") != 3, '"key":"a",').otherwise(""), F.lit('"attribute_type":"category","values":{"data":"v","length":'),
                    F.when(F.col("l_returnflag") == "R", '"7"').otherwise("7"), F.lit("}}"))
    data = F.when(F.col("o_orderstatus") == "F", "17").otherwise('"c"')
    box = ",".join(f'"{b}_{a}":1.5' for a in "xy" for b in ("min", "max"))
    return _order_documents(spark, d, line, F.concat(
        F.lit('{"name":"n","schema":"s","bounding_box":{' + box + ',"min_z":'), F.when(F.col("o_orderstatus") == "P", "null").otherwise("0"),
        F.lit(',"max_z":2},'), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise('"coordinate_reference_system":"unspecified",'),
        F.when(F.col("o_orderpriority") == "1-URGENT", '"note":{"by":{"name":"x"}},').otherwise(""),
        F.lit('"locations":{"coordinates":{"data":'), data, F.lit(',"length":3},"attributes":['), F.col("lines"), F.lit("]}}")))


def _schema_of(priority) -> "F.Column":
    expr = None
    for k, v in SCHEMA_BY_PRIORITY.items():
        expr = (F.when(priority == k, v) if expr is None else expr.when(priority == k, v))
    return expr.otherwise(F.lit("pointset"))


class CatalogStore:
    """The derived catalog tables of one data folder, written once each to the checkpoint folder.

    A catalog is a set of stored tables; here they are derived from the driver tables on first use and read
    from then on, as long as the source files (paths, sizes, times) stay what they were. Their state is one digest,
    which one aggregate makes of all source tables' files."""

    def __init__(self):
        self._paths: dict[tuple, tuple[str, tuple]] = {}

    def table(self, spark: SparkSession, d: str, name: str, build, sources: tuple[str, ...]) -> DataFrame:
        from pyspark.errors import AnalysisException

        from lithos.operators.position import materialize_path

        key, state = (spark.sparkContext.applicationId, d.rstrip("/"), name), self._state(spark, d.rstrip("/"), sources)
        path, known = self._paths.get(key, (None, None))
        if path is not None and known == state:
            try:
                return spark.read.parquet(path)
            except AnalysisException:  # the folder was cleaned up: derive it again
                pass
        path = materialize_path(build(spark, d))
        self._paths[key] = (path, state)
        return spark.read.parquet(path)

    @staticmethod
    def _state(spark: SparkSession, folder: str, sources: tuple[str, ...]) -> tuple:
        files = spark.read.format("binaryFile").load([f"{folder}/{t}.parquet" for t in sources]).select(
            "path", "length", "modificationTime")
        return tuple(files.agg(F.count("path"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


STORE = CatalogStore()


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    return STORE.table(spark, d, "workspaces", _workspaces, ("customer", "orders"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """One row per object version with its header document (stored catalog table)."""
    return STORE.table(spark, d, "objects", _objects, ("customer", "orders", "lineitem"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """One row per data reference (stored catalog table)."""
    return STORE.table(spark, d, "references", _references, ("customer", "orders", "lineitem"))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    return STORE.table(spark, d, "blobs", _blobs, ("customer", "orders", "lineitem"))


def _workspaces(spark: SparkSession, d: str) -> DataFrame:
    cust = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    orders = read_table(spark, d, "orders").select("o_custkey", "o_orderdate")
    per_cust = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    seg = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left").groupBy("c_mktsegment").agg(
        F.min("first").alias("created_at"), F.max("last").alias("updated_at"))
    return seg.select(
        F.lower("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name"),
        F.concat(F.lit("Objects of the "), F.col("c_mktsegment"), F.lit(" segment")).alias("description"),
        F.lit("OWNER").alias("user_role"), "created_at", "updated_at", F.lit("system").alias("created_by"),
        F.lit("unspecified").alias("default_coordinate_system"), F.array(F.col("c_mktsegment")).alias("labels"),
        F.lit(False).alias("deleted"),
    )


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the segment of their customer; an order without a customer belongs to 'unassigned'."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").withColumn(
        "workspace_id", F.coalesce(F.lower("c_mktsegment"), F.lit("unassigned")))


def _id() -> "F.Column":
    return F.concat(F.lit("obj-"), F.col("o_custkey").cast("string"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The flat references. A line's ordinal is its rank along the line order inside its order (a rank along (order,
    line order) less the order's first), so an order's lines never meet in one task.
    The blob id is read from the line's JSON part as from any document."""
    from lithos.functions.refs import data_references
    from lithos.operators.position import with_segmented_index

    li = read_table(spark, d, "lineitem").select(*LINEITEM_ORDER)
    lines = with_segmented_index(li, ["l_orderkey"], list(LINEITEM_ORDER[1:]), name="ordinal", keep=["l_orderkey", "l_partkey", "l_quantity"])
    part = F.to_json(F.struct(F.concat(F.lit("blob-"), F.col("l_partkey").cast("string")).alias("data"),
                              F.col("l_quantity").cast("long").alias("length")))
    return lines.join(_versions(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "workspace_id", _id().alias("id"), F.col("o_orderkey").cast("string").alias("version_id"),
        F.col("ordinal").cast("int").alias("ordinal"), data_references(part)[0].alias("blob_id"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """One row per object version. The document holds the header; its references are the flat table."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_tax")
    summary = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_quantity").alias("min_x"), F.max("l_quantity").alias("max_x"),
        F.min("l_extendedprice").alias("min_y"), F.max("l_extendedprice").alias("max_y"),
        F.min("l_tax").alias("min_z"), F.max("l_tax").alias("max_z"))
    base = _versions(spark, d).join(summary, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.concat(F.lit("object-"), F.col("o_custkey").cast("string"))
    schema = _schema_of(F.col("o_orderpriority"))
    bbox = F.when(F.col("n_lines").isNotNull(), F.struct(*[F.col(f"{b}_{a}") for a in "xyz" for b in ("min", "max")]))
    header = F.to_json(F.struct(
        name.alias("name"), _id().alias("uuid"), schema.alias("schema"),
        F.when(F.col("o_orderstatus") != "P", F.lit("unspecified")).alias("coordinate_reference_system"),
        bbox.alias("bounding_box"), F.col("n_lines").alias("n_parts")))
    return base.select(
        "workspace_id", _id().alias("id"), name.alias("name"),
        F.concat(F.lit("/"), F.col("workspace_id"), F.lit("/"), name, F.lit(".json")).alias("path"),
        schema.alias("schema_id"), F.col("o_orderkey").cast("string").alias("version_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("user-"), F.col("c_nationkey").cast("string")).alias("created_by"),
        (F.col("o_orderstatus") == "F").alias("deleted"), header.alias("document"))


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """Per workspace the parts its references name whose key is a customer of another segment."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    refs = li.join(_versions(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).select("workspace_id", "l_partkey").distinct()
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    held = refs.join(c, (F.col("l_partkey") == F.col("c_custkey")) & (F.lower("c_mktsegment") != F.col("workspace_id")))
    return held.select("workspace_id", F.concat(F.lit("blob-"), F.col("l_partkey").cast("string")).alias("blob_id"),
                       F.col("c_nationkey").cast("long").alias("length"))


def workspace_of_customer(spark: SparkSession, d: str, custkey: int) -> "F.Column":
    """Workspace id of one customer's object, as a scalar subquery."""
    return read_table(spark, d, "customer").filter(F.col("c_custkey") == custkey).select(F.lower("c_mktsegment")).scalar()
