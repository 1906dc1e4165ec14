"""Registered queries on the driver tables. Each takes (spark, sf_dir) and
returns a DataFrame whose column names equal those of its oracle SQL in ``oracle.py``.

Every query reads whole tables (no id subsets, no row caps); a limit appears only where it is
the operator itself (head sample, list limits).
"""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.jsondoc import parse_document
from lithos.functions.numeric import coerce_double, invert
from lithos.functions.text import attribute_key, clean_text
from lithos.functions.timefmt import iso_timestamp
from lithos.operators import arrays as A
from lithos.operators import catalog as C
from lithos.operators import holes as H
from lithos.operators import quality as Q
from lithos.operators.encode import category_codes, category_lookup, category_lookups, continuous_values, plan_attributes
from lithos.operators.position import registered, with_ordered_index
from lithos.operators.profile import column_profile, sample_rows
from lithos.plans import batches as B
from lithos.plans import roles as R
from lithos.plans.builders import (
    POS, BuiltObject, IntervalConfig, build_downhole_collection, build_downhole_intervals, build_line_segments,
    build_pointset, sorted_rows, write_object,
)
from lithos.plans.csv_objects import (
    IntervalFile, downhole_collection_from_csv, downhole_intervals_from_csv, line_segments_from_csv, load,
    pointset_from_csv,
)
from lithos.plans.interval_files import read_interval_files
from lithos.plans.preview import preview_csv
from lithos.plans.schemas import conformance, document_problems
from lithos.session import ensure_checkpoint_dir
from lithos.sources.csv_scan import read_typed_csv
from lithos.sources.tables import read_table

BOX = [f"{b}_{a}" for a in "xyz" for b in ("min", "max")]

# Parameters of the catalog queries.
SOURCE_WS = "building"
TARGET_WS = "automobile"
LOOKUP_CUSTOMER = 0
SNAPSHOT_NAME = "snapshot_2024-01-01T00:00:00"
SNAPSHOT_TIME = "2024-01-01T00:00:00"
COPY_SCHEMAS = ("pointset", "line-segments")


def _folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed with the intermediates of the caller."""
    return registered(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{_uuid.uuid4().hex}")


def _events_xyz(spark, d) -> DataFrame:
    e = R.events(spark, d)
    return e.select("event_id", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"),
                    F.col("event_id").cast("double").alias("z"), "event_type")


def _docs_xyz(spark, d) -> DataFrame:
    dl = R.docs_labels(spark, d)
    return dl.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("x"),
                     F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("z"))


# --- objects and gate -----------------------------------------------------------------------

def q_pointset(spark, d):
    built = build_pointset(_events_xyz(spark, d), "x", "y", "z", name="events", attribute_cols=["event_type"],
                           order_cols=["event_id"])
    coded = category_codes(built.positioned(), "event_type", built.lookup("event_type"), keep=[POS, "x", "y", "z"])
    return coded.withColumnRenamed(POS, "pos")


def _long(built: BuiltObject, arrays: dict[str, str]) -> DataFrame:
    """Arrays of a built object as rows (array, pos, a, b, c): what the object's files hold, whole. ``pos`` of a
    lookup or hole index is its key."""
    parts = []
    for name, aid in arrays.items():
        df = built.array(aid)
        role = built.array_roles[aid]
        fields = [n for n, _ in A.ARRAY_FIELDS[role]]
        if role == "lookup":
            cols = [F.col("key").cast("long"), F.lit(None), F.lit(None), F.lit(None), F.col("value")]
        elif role == "holes":
            cols = [F.col("hole_index").cast("long"), F.col("offset"), F.col("count"), F.lit(None), F.lit(None)]
        else:
            cols = [F.col("pos"), *[F.col(f) for f in fields], *[F.lit(None)] * (3 - len(fields)), F.lit(None)]
        types = ["long", "double", "double", "double", "string"]
        parts.append(df.select(F.lit(name).alias("array"), *[
            c.cast(t).alias(n) for c, t, n in zip(cols, types, ["pos", "a", "b", "c", "text"])]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _attribute_arrays(built: BuiltObject, ids=None) -> dict[str, str]:
    """codes, lookup and values arrays in the order the attributes were planned, by role and number."""
    out: dict[str, str] = {}
    for aid in ids if ids is not None else built.arrays:
        role = built.array_roles[aid]
        if role in ("codes", "values", "lookup"):
            out[f"{role}_{sum(k.startswith(role) for k in out)}"] = aid
    return out


def q_bounding_box(spark, d):
    ev = Q.bounding_box(_events_xyz(spark, d), "x", "y", "z").select(F.lit("events").alias("source"), *BOX, "valid_rows", "finite")
    dc = Q.bounding_box(_docs_xyz(spark, d), "x", "y", "z").select(F.lit("documents").alias("source"), *BOX, "valid_rows", "finite")
    return ev.unionByName(dc)


def q_bounding_box_by_group(spark, d):
    li = read_table(spark, d, "lineitem")
    return Q.bounding_box(li.select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
                                    F.col("l_tax").alias("z")), "x", "y", "z", ["l_orderkey"]).drop("finite")


def q_valid_points(spark, d):
    return Q.valid_points(_docs_xyz(spark, d), "x", "y", "z").select("doc_id", "x", "y", "z")


def q_missing_coords(spark, d):
    s = Q.gate_status(Q.coordinate_summary(_docs_xyz(spark, d), "x", "y", "z"))
    return s.select("rows", "missing_rows", "valid_rows", "status")


def q_dry_run_report(spark, d):
    built = build_pointset(_docs_xyz(spark, d), "x", "y", "z", name="documents", attribute_cols=["lang", "source"],
                           order_cols=["doc_id"])
    return built.report.select("status", "rows", "valid_rows", "missing_rows", *BOX,
                               F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
                               F.element_at("warnings", 1).alias("first_warning"))


def q_line_segments(spark, d):
    built = build_line_segments(R.vertices(spark, d), R.segments(spark, d), "x", "y", "z", "start_idx", "end_idx",
                                vertex_attribute_cols=["p_brand"], segment_attribute_cols=["l_returnflag"],
                                segment_order=list(R.LINEITEM_ORDER), vertex_pos="pos")
    return built.report.select("status", "vertices", "segments", "max_start", "max_end", "bad_start", "bad_end", *BOX)


def q_line_segments_arrays(spark, d):
    built = build_line_segments(R.vertices(spark, d), R.segments(spark, d), "x", "y", "z", "start_idx", "end_idx",
                                vertex_attribute_cols=["p_brand"], segment_attribute_cols=["l_returnflag"],
                                segment_order=list(R.LINEITEM_ORDER), vertex_pos="pos")
    return _long(built, {"coordinates": built.arrays_of("coordinates")[0], "indices": built.arrays_of("indices")[0],
                         **_attribute_arrays(built)})


def q_segment_index_check(spark, d):
    verts = read_table(spark, d, "supplier").select("s_suppkey")  # counted only: no ranking needed
    return Q.segment_index_check(verts, R.segments(spark, d), "start_idx", "end_idx")


def q_dangling_segment_ends(spark, d):
    verts = with_ordered_index(read_table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], name="pos")
    return Q.dangling_segment_ends(verts, R.segments(spark, d), "start_idx", "end_idx")


def q_segment_indices(spark, d):
    segs = with_ordered_index(R.segments(spark, d), list(R.LINEITEM_ORDER), name="pos")
    return A.index_pairs(segs, "start_idx", "end_idx")


def q_coords_xyz(spark, d):
    rows = with_ordered_index(_events_xyz(spark, d), ["event_id"], name="pos")
    return A.coordinates(rows, "x", "y", "z")


# --- projections ----------------------------------------------------------------------------

def q_clean_strings(spark, d):
    dl = R.docs_labels(spark, d)
    return dl.select("doc_id", clean_text("lang").alias("lang"), clean_text("source").alias("source"),
                     clean_text("quality").alias("quality"), clean_text("toxic").alias("toxic"))


def q_numeric_coerce(spark, d):
    o = read_table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        coerce_double("o_orderpriority").alias("priority_num"),
        coerce_double(F.col("o_totalprice").cast("string")).alias("totalprice"),
        coerce_double("o_orderstatus").alias("status_num"),
    )


def q_invert_dip(spark, d):
    li = R.survey(spark, d)
    return li.select("hole_id", F.col("l_linenumber"), F.col("l_partkey"), F.col("depth").alias("distance"), "azimuth",
                     invert("dip", True).alias("dip"))


def q_survey_path(spark, d):
    rows = sorted_rows(R.survey(spark, d), "hole_id", "depth", list(R.LINEITEM_ORDER))
    return A.path(rows, "depth", "azimuth", "dip")


def q_attribute_key(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", F.col("p_type").alias("name"), attribute_key("p_type").alias("key"))


def q_attribute_dispatch(spark, d):
    ev = R.events(spark, d)
    specs, _ = plan_attributes(ev, ev.columns)
    aggs, rows = [], []
    for i, s in enumerate(specs):
        c = F.col(s.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs.append(F.count_distinct(clean_text(c, s.dtype)).alias(f"u{i}") if s.kind == "category"
                    else F.lit(None).cast("long").alias(f"u{i}"))
    wide = ev.agg(*aggs)
    for i, s in enumerate(specs):
        rows.append(F.struct(F.lit(s.name).alias("column"), F.lit(s.key).alias("key"), F.lit(s.kind).alias("kind"),
                             F.col(f"n{i}").alias("n_values"), F.col(f"u{i}").alias("n_categories"),
                             F.lit(s.warning).cast("string").alias("warning")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def q_continuous_attribute(spark, d):
    rows = with_ordered_index(R.events(spark, d).select("event_id", "value", "user_id"), ["event_id"], name="pos")
    v = continuous_values(rows, "value", keep=["pos", "user_id"], name="value")
    return v.select("pos", "value", F.col("user_id").cast("double").alias("user_id"))


# --- dictionary encoding and holes ----------------------------------------------------------

def q_category_lookup(spark, d):
    return category_lookup(R.events(spark, d), "event_type", "event_id")


def q_category_codes(spark, d):
    ev = R.events(spark, d)
    return category_codes(ev, "event_type", category_lookup(ev, "event_type", "event_id"), keep=["event_id"])


def q_category_lookups(spark, d):
    li = with_ordered_index(read_table(spark, d, "lineitem").select(*R.LINEITEM_ORDER), list(R.LINEITEM_ORDER), name="pos")
    return category_lookups(li, ["l_returnflag", "l_linestatus"], "pos")


def q_hole_lookup(spark, d):
    return H.hole_lookup(R.collar(spark, d), "hole_id")


def q_collar_keys(spark, d):
    col = R.collar(spark, d)
    return H.collar_keys(col, "hole_id", H.hole_lookup(col, "hole_id"))


def q_hole_index_map(spark, d):
    _, maps = H.hole_indexes(R.collar(spark, d), "hole_id", {"survey": (R.survey(spark, d), "hole_id")})
    return maps["survey"]


def q_run_length_index(spark, d):
    ev = R.events(spark, d).select("event_id", "event_type")
    rows = with_ordered_index(ev, ["event_id"], name="pos")
    return H.run_length_index(rows, "event_type", "pos", category_lookup(ev, "event_type", "event_id"))


def q_row_position(spark, d):
    return with_ordered_index(R.events(spark, d).select("event_id"), ["event_id"], name="pos")


def q_sample_rows(spark, d):
    return sample_rows(R.events(spark, d).select("event_id", "user_id", "event_type", "value"), ["event_id"], 10)


def q_max_depth(spark, d):
    return H.max_depth(R.survey(spark, d), "hole_id", "depth")


def q_hole_distances(spark, d):
    return H.hole_distances(R.collar(spark, d), R.survey(spark, d), "hole_id", "hole_id", "depth")


def q_orphan_intervals(spark, d):
    col = read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("hole_id"))
    return H.orphan_rows(R.intervals(spark, d), "hole_id", H.hole_lookup(col, "hole_id"))


def q_empty_holes(spark, d):
    return H.empty_holes(H.hole_lookup(R.collar(spark, d), "hole_id"), R.intervals(spark, d), "hole_id")


def q_sorted_intervals(spark, d):
    rows = sorted_rows(R.intervals(spark, d), "hole_id", "from", list(R.LINEITEM_ORDER))
    return rows.select("pos", "hole_id", "from", "to")


def _collection(spark, d, configs, **more) -> BuiltObject:
    return build_downhole_collection(
        R.collar(spark, d), R.survey(spark, d), "hole_id", "hole_id", "x", "y", "z", "depth", "azimuth", "dip",
        collections=configs, invert_z=True, collar_tie=["hole_id"], survey_tie=R.LINEITEM_ORDER, **more)


def q_interval_collection(spark, d):
    assay, _ = _interval_configs(spark, d)
    cfg = IntervalConfig("assay", assay.df, assay.id_col, assay.from_col, assay.to_col, ["l_returnflag", "l_tax"], assay.tie_cols)
    built = _collection(spark, d, [cfg])
    ids = built.collections["assay"]
    return _long(built, {"from_to": ids["from_to"], "holes": ids["holes"], **_attribute_arrays(built, ids["attributes"])})


def _interval_configs(spark, d) -> list[IntervalConfig]:
    li = read_table(spark, d, "lineitem")
    assay = li.select(F.col("l_orderkey").cast("string").alias("hole_id"), F.col("l_quantity").alias("from"),
                      (F.col("l_quantity") + F.col("l_linenumber")).alias("to"), *R.LINEITEM_ORDER)
    geology = li.select(
        F.col("l_suppkey").cast("string").alias("hole_id"), F.col("l_linenumber").cast("double").alias("from"),
        (F.col("l_linenumber") + 1).cast("double").alias("to"), *R.LINEITEM_ORDER)
    return [IntervalConfig("assay", assay, "hole_id", "from", "to", ["l_tax"], R.LINEITEM_ORDER),
            IntervalConfig("geology", geology, "hole_id", "from", "to", ["l_linestatus"], R.LINEITEM_ORDER)]


def q_interval_collections(spark, d):
    cfgs = _interval_configs(spark, d)
    _, maps = H.hole_indexes(R.collar(spark, d), "hole_id", {c.name: (c.df, c.id_col) for c in cfgs})
    out = None
    for cfg in cfgs:
        idx = maps[cfg.name].select(F.lit(cfg.name).alias("collection"), "*")
        out = idx if out is None else out.unionByName(idx)
    return out


def q_hole_location(spark, d):
    built = _collection(spark, d, [])
    return _long(built, {r: built.arrays_of(r)[0] for r in ("coordinates", "distances", "lookup", "codes", "holes", "path")})


def q_downhole_collection(spark, d):
    built = _collection(spark, d, _interval_configs(spark, d))
    return _long(built, {"survey": built.arrays_of("holes")[0], **{k: v["holes"] for k, v in built.collections.items()}})


def q_dry_run_downhole(spark, d):
    return _collection(spark, d, _interval_configs(spark, d)).report.select(
        "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "rows", "unique_holes",
        "valid_rows", *BOX)


def q_downhole_intervals(spark, d):
    # Position the rows first (only the order columns are materialised), derive the points after.
    li = with_ordered_index(read_table(spark, d, "lineitem").select(*R.LINEITEM_ORDER), list(R.LINEITEM_ORDER))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    df = li.select(
        "pos", "l_returnflag", F.col("l_orderkey").cast("string").alias("hole_id"), q.alias("from"), (q + n).alias("to"),
        q.alias("sx"), F.col("l_extendedprice").alias("sy"), (-q).alias("sz"),
        (q + n).alias("ex"), F.col("l_extendedprice").alias("ey"), (-(q + n)).alias("ez"))
    df = df.withColumn("mx", (F.col("sx") + F.col("ex")) / 2).withColumn("my", (F.col("sy") + F.col("ey")) / 2) \
        .withColumn("mz", (F.col("sz") + F.col("ez")) / 2)
    built = build_downhole_intervals(df, "hole_id", "from", "to", ["sx", "sy", "sz"], ["ex", "ey", "ez"], ["mx", "my", "mz"],
                                     attribute_cols=["l_returnflag"], pos_col="pos", check_pos=False)
    start, end, mid = built.arrays_of("coordinates")
    return _long(built, {"start": start, "end": end, "mid": mid, "from_to": built.arrays_of("from_to")[0], **_attribute_arrays(built)})


def q_pointset_document(spark, d):
    """Fields of the document of a written pointset: lengths come from what was written."""
    built = build_pointset(_events_xyz(spark, d), "x", "y", "z", name="events", attribute_cols=["event_type", "event_id"],
                           order_cols=["event_id"], tags={"kind": "events"})
    doc = write_object(built, _folder(spark, "object"))
    ref = "data string, length bigint"
    schema = (f"name string, `schema` string, bounding_box struct<min_x double, max_x double>, locations struct<coordinates struct<{ref}>, "
              f"attributes array<struct<name string, key string, attribute_type string, nan_description struct<values array<double>>, "
              f"table struct<{ref}>, values struct<{ref}>>>>, uuid string")
    doc = doc.select(parse_document("document", schema).alias("o")).select("o.*")
    head = doc.select("name", "schema", "bounding_box.min_x", "bounding_box.max_x",
                      F.col("locations.coordinates.length").alias("points"), F.posexplode("locations.attributes").alias("i", "a"))
    return head.select("name", "schema", "min_x", "max_x", "points", "i", F.col("a.name").alias("attribute"), F.col("a.key").alias("key"),
                       F.col("a.attribute_type").alias("attribute_type"), F.size("a.nan_description.values").alias("nan_values"),
                       F.col("a.table.length").alias("categories"), F.col("a.values.length").alias("values"))


def q_unique_holes(spark, d):
    o = Q.unique_count(read_table(spark, d, "orders"), "o_orderkey").select(F.lit("orders").alias("source"), "*")
    c = Q.unique_count(read_table(spark, d, "conversations"), "conv_id").select(F.lit("conversations").alias("source"), "*")
    return o.unionByName(c)


def q_duplicate_ids(spark, d):
    return Q.duplicate_ids(read_table(spark, d, "conversations"), "conv_id")


def q_column_profile(spark, d):
    ev = column_profile(R.events(spark, d)).select(F.lit("events").alias("source"), "*")
    dl = column_profile(R.docs_labels(spark, d, text=True)).select(F.lit("documents").alias("source"), "*")
    return ev.unionByName(dl)


# --- many objects in one plan -------------------------------------------------------------------

def _segment_pointsets(spark, d) -> B.Batch:
    return B.build_pointsets(R.segment_points(spark, d), "segment", "x", "y", "z", ["o_orderkey"], ["o_orderpriority", "o_orderkey"])


def _customer_collections(spark, d) -> B.Batch:
    collars, rows = R.customer_holes(spark, d)
    order = list(R.LINEITEM_ORDER)
    return B.build_downhole_collections(
        collars, rows, "owner", "owner", "hole_id", "hole_id", "x", "y", "z", "depth", "azimuth", "dip", [], order,
        [B.Intervals("assay", rows, "owner", "hole_id", "depth", "to", order, ["l_returnflag", "l_tax"])], invert_z=True)


def _brand_segments(spark, d) -> B.Batch:
    v, s = R.brand_lines(spark, d)
    return B.build_line_segments(v, s, "p_brand", "p_brand", "x", "y", "z", "start_idx", "end_idx", ["p_partkey"],
                                 list(R.LINEITEM_ORDER), ["p_type"], ["l_returnflag"])


def _supplier_intervals(spark, d) -> B.Batch:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    df = read_table(spark, d, "lineitem").select(
        *R.LINEITEM_ORDER, q.alias("from"), (q + n).alias("to"), q.alias("sx"), F.col("l_extendedprice").alias("sy"), (-q).alias("sz"),
        (q + n).alias("ex"), (-(q + n)).alias("ez"))
    start, end = ["sx", "sy", "sz"], ["ex", "sy", "ez"]
    return B.build_downhole_intervals(df, "l_suppkey", "l_orderkey", "from", "to", start, end, start, list(R.LINEITEM_ORDER), ["l_returnflag"])


def _stored_arrays(spark, batch: B.Batch) -> tuple[DataFrame, DataFrame]:
    """(documents, rows of all stored arrays in the long form with their object) of a written batch."""
    base = _folder(spark, "batch")
    documents = B.write_batch(batch, base)
    out = None
    for role in dict.fromkeys(batch.roles.values()):
        df = spark.read.parquet(f"{base}/{role}")
        fields = [F.col(f"`{n}`") for n, t in A.ARRAY_FIELDS[role] if t != "string" and n not in ("key", "hole_index")]
        cols = [*fields, *[F.lit(None)] * (3 - len(fields)), F.col("value") if role == "lookup" else F.lit(None)]
        one = df.select("object", "array", "pos", *[c.cast(t).alias(n) for c, t, n in zip(
            cols, ["double", "double", "double", "string"], ["a", "b", "c", "text"])])
        out = one if out is None else out.unionByName(one)
    return documents, out


def q_pointsets_by_segment(spark, d):
    """Every array of a pointset per (market segment, nation), as stored."""
    return _stored_arrays(spark, _segment_pointsets(spark, d))[1]


def q_downhole_by_group(spark, d):
    """Every array of a downhole collection per customer, as stored."""
    return _stored_arrays(spark, _customer_collections(spark, d))[1]


def q_line_segments_by_group(spark, d):
    """Every array of the line segments per brand whose segments name only vertices of their brand, as stored."""
    return _stored_arrays(spark, _brand_segments(spark, d))[1]


def q_intervals_by_group(spark, d):
    """Every array of the downhole intervals per supplier, as stored."""
    return _stored_arrays(spark, _supplier_intervals(spark, d))[1]


def q_segment_gate_by_group(spark, d):
    """Gate of every brand against its own vertices."""
    return _brand_segments(spark, d).report.select("object", "status", "vertices", "segments", "max_start", "max_end", "bad_start",
                                                   "bad_end", *BOX, F.size("errors").alias("n_errors"))


def q_documents_by_segment(spark, d):
    """The references in the document of every segment's pointset, with the lengths they state."""
    documents, _ = _stored_arrays(spark, _segment_pointsets(spark, d))
    ref = "struct<data string, length bigint>"
    schema = (f"name string, `schema` string, bounding_box struct<min_z double, max_z double>, locations struct<coordinates {ref}, "
              f"attributes array<struct<name string, attribute_type string, table {ref}, values {ref}>>>")
    o = documents.select("object", parse_document("document", schema).alias("o"))
    return o.select("object", "o.name", "o.schema", "o.bounding_box.min_z", "o.bounding_box.max_z",
                    F.col("o.locations.coordinates.length").alias("points"),
                    F.col("o.locations.attributes")[0]["table"]["length"].alias("categories"),
                    F.col("o.locations.attributes")[0]["values"]["length"].alias("codes"),
                    F.col("o.locations.attributes")[1]["attribute_type"].alias("second_type"),
                    F.col("o.locations.attributes")[1]["values"]["length"].alias("values"))


def q_array_slice(spark, d):
    """Rows [200, 700) of three stored arrays of one object, read through their ranges."""
    batch = B.build_pointsets(_events_xyz(spark, d).withColumns({"one": F.lit("events"), "value": F.col("y")}), "one", "x", "y", "z", ["event_id"],
                              ["event_type", "value"])
    base = _folder(spark, "batch")
    document = B.write_batch(batch, base)
    ids = document.select(*[batch.array_id(n).alias(n.replace(":", "_")) for n in batch.roles]).first()  # one object
    out = None
    for name in ("coordinates", "codes:event_type", "values:value"):
        role = batch.roles[name]
        part = A.read_range(spark, f"{base}/{role}", role, ids[name.replace(":", "_")], 200, 700)
        fields = [n for n, _ in A.ARRAY_FIELDS[role]]
        part = part.select(F.lit(name).alias("array"), "pos", *[
            (F.col(fields[i]) if i < len(fields) else F.lit(None)).cast("double").alias(n) for i, n in enumerate("abc")])
        out = part if out is None else out.unionByName(part)
    return out


# --- scans ------------------------------------------------------------------------------------

def q_csv_typed_scan(spark, d):
    """Land events as CSV in the shared checkpoint folder, then scan it back typed."""
    folder = _folder(spark, "csv_typed_scan")
    R.events(spark, d).select("event_id", iso_timestamp("ts").alias("ts"), "user_id", "event_type", "value", "props") \
        .write.option("header", True).option("escape", '"').csv(folder)
    return read_typed_csv(spark, folder)


def _land(spark, df: DataFrame, name: str, order: list) -> str:
    """Rows of ``df`` as CSV files whose path order is ``order``, in the shared checkpoint folder."""
    folder = _folder(spark, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("escape", '"').csv(folder)
    return folder


def q_csv_preview(spark, d):
    """Profile of a landed CSV file set."""
    path = _land(spark, R.events(spark, d).select("event_id", "user_id", "event_type", "value"), "events", ["event_id"])
    return preview_csv(spark, path)["columns"]


def q_csv_pointset(spark, d):
    path = _land(spark, _events_xyz(spark, d), "points", ["event_id"])
    built = pointset_from_csv(spark, path, "x", "y", "z", attribute_cols=["event_type"])
    return _long(built, {"coordinates": built.arrays_of("coordinates")[0], **_attribute_arrays(built)})


def q_csv_line_segments(spark, d):
    v = _land(spark, R.vertices(spark, d), "vertices", ["pos"])
    s = _land(spark, R.segments(spark, d).drop("l_shipdate"), "segments", list(c for c in R.LINEITEM_ORDER if c != "l_shipdate"))
    built = line_segments_from_csv(spark, v, s, "x", "y", "z", "start_idx", "end_idx", vertex_attribute_cols=["p_brand"],
                                   segment_attribute_cols=["l_returnflag"])
    # rows that differ in their ship date alone have equal values in every array here
    return _long(built, {"coordinates": built.arrays_of("coordinates")[0], "indices": built.arrays_of("indices")[0],
                         **_attribute_arrays(built)})


def _csv_holes(spark, d):
    """A collar file, and a survey file in which the ids of the last lines are blank."""
    collar = _land(spark, R.collar(spark, d), "collars", ["hole_id"])
    survey = R.survey(spark, d).select(
        F.when(F.col("l_linenumber") < 7, F.col("hole_id")).alias("hole_id"), "depth", "azimuth", "dip", "l_orderkey", "l_linenumber")
    return collar, _land(spark, survey, "survey", ["l_orderkey", "l_linenumber", "depth", "azimuth", "dip"])


def _fifty_files(spark, d):
    """Fifty interval files by supplier; one lacks its 'to' column, and a fifty-first is not there."""
    base = _folder(spark, "intervals")
    li = read_table(spark, d, "lineitem")
    rows = li.select((F.col("l_suppkey") % 50).alias("f"), F.col("l_orderkey").alias("hole"), F.col("l_quantity").alias("from"),
                     (F.col("l_quantity") + F.col("l_linenumber")).alias("to"), "l_returnflag", "l_tax")
    rows.filter("f <> 7").write.option("header", True).partitionBy("f").csv(f"{base}/good")
    rows.filter("f = 7").drop("to").write.option("header", True).partitionBy("f").csv(f"{base}/bad")
    return [IntervalFile(f"{base}/{'bad' if i == 7 else 'good'}/f={i}", f"c{i}", "hole", "from", "to", ["l_returnflag", "l_tax"])
            for i in range(51)]


def _interval_set(spark, d):
    present = {r[0] for r in read_table(spark, d, "lineitem").select(F.col("l_suppkey") % 50).distinct().collect()}  # fifty values
    files = [f for i, f in enumerate(_fifty_files(spark, d)) if i in present or i == 50]
    return read_interval_files(spark, files, H.hole_lookup(R.collar(spark, d), "hole_id"))


def q_interval_files(spark, d):
    """The arrays of some fifty interval files read in one scan (rows of equal hole and start have no order of their own
    in the source, so an array is given as its values by hole index and start)."""
    found = _interval_set(spark, d)
    ft = found.from_to.select("object", "pos", "data1", "data2")
    codes = found.codes.join(found.lookups.withColumnRenamed("key", "data"), ["object", "attribute", "data"]).select("object", "pos", F.col("value").alias("flag"))
    tax = found.values.select("object", "pos", F.col("data").alias("tax"))
    rows = ft.join(codes, ["object", "pos"]).join(tax, ["object", "pos"])
    index = found.holes.filter(F.col("count") > 0).select("object", "hole_index", "offset", "count")
    at = index.select("object", "hole_index", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("count") - 1)).alias("pos"))
    return rows.join(at, ["object", "pos"]).select("object", "hole_index", "data1", "data2", "flag", "tax")


def q_interval_file_index(spark, d):
    """Hole index of every interval file's collection, all holes of the collars."""
    return _interval_set(spark, d).holes


def q_interval_file_reports(spark, d):
    """Status and rows of every given interval file."""
    return _interval_set(spark, d).report.select("collection", "status", F.size("errors").alias("n_errors"), "rows")


def q_csv_hole_distances(spark, d):
    collar, survey = _csv_holes(spark, d)
    c, _ = load(spark, collar, "collars", ["hole_id"], ordered=False)
    s, _ = load(spark, survey, "survey", ["hole_id"], ordered=False)
    return H.hole_distances(c, s, "hole_id", "hole_id", "depth")


def q_csv_downhole_collection(spark, d):
    collar, survey = _csv_holes(spark, d)
    built = downhole_collection_from_csv(
        spark, collar, survey, [IntervalFile(survey, "depths", "hole_id", "depth", "azimuth", ["dip"])],
        "hole_id", "hole_id", "x", "y", "z", "depth", "azimuth", "dip")
    ids = built.collections["depths"]
    return _long(built, {**{r: built.arrays_of(r)[0] for r in ("coordinates", "distances", "codes", "holes")},
                         "collection": ids["holes"]})


def q_csv_downhole_intervals(spark, d):
    q = F.col("l_quantity")
    rows = R.intervals(spark, d).select(
        "hole_id", "from", "to", q.alias("sx"), q.alias("sy"), q.alias("sz"), "l_returnflag", *[
            c for c in R.LINEITEM_ORDER if c not in ("l_returnflag", "l_shipdate")])
    path = _land(spark, rows, "intervals", [c for c in R.LINEITEM_ORDER if c != "l_shipdate"])
    point = ["sx", "sy", "sz"]
    built = downhole_intervals_from_csv(spark, path, "hole_id", "from", "to", point, point, point, attribute_cols=["l_returnflag"])
    return _long(built, {"mid": built.arrays_of("coordinates")[2], "from_to": built.arrays_of("from_to")[0], **_attribute_arrays(built)})


def q_csv_statuses(spark, d):
    """Status of a good file, of a column that is no number, and of a file that is not there."""
    path = _land(spark, _events_xyz(spark, d), "points", ["event_id"])
    out = None
    for case, p, z in (("good", path, "z"), ("text", path, "event_type"), ("missing", path + "-none", "z")):
        one = pointset_from_csv(spark, p, "x", "y", z).report.select(F.lit(case).alias("case"), "status", F.size("errors").alias("n_errors"))
        out = one if out is None else out.unionByName(one)
    return out


def q_file_position(spark, d):
    """Rows in the order of their files: the events, landed in the order of their id."""
    path = _land(spark, R.events(spark, d).select("event_id"), "events", ["event_id"])
    df, pos = load(spark, path, "events")
    return df.select("event_id", F.col(pos).alias("pos"))


def q_pinned_version(spark, d):
    """FLT-9: every version of the lookup object, each read by its pin."""
    ws, oid, _ = _lookup_target(spark, d)
    objects = R.objects(spark, d)
    first = C.object_versions(objects, ws, object_id=oid).select(F.min("version_id")).scalar()
    return C.get_object(objects, ws, object_id=oid, version=first)


# --- catalog ------------------------------------------------------------------------------------

def q_list_workspaces(spark, d):
    return C.list_workspaces(R.workspaces(spark, d))


def q_get_workspace(spark, d):
    ws = C.get_workspace(R.workspaces(spark, d), workspace_name=SOURCE_WS.upper())
    return ws.withColumn("labels", F.concat_ws(",", "labels"))


def q_list_objects(spark, d):
    return C.list_objects(R.objects(spark, d), SOURCE_WS, schema_id="pointset")


def _lookup_target(spark, d):
    """(workspace, object id, object path) of the lookup customer; workspace and path are scalar subqueries."""
    ws = R.workspace_of_customer(spark, d, LOOKUP_CUSTOMER)
    return ws, f"obj-{LOOKUP_CUSTOMER}", F.concat(F.lit("/"), ws, F.lit(f"/object-{LOOKUP_CUSTOMER}.json"))


def q_get_object(spark, d):
    ws, _, path = _lookup_target(spark, d)
    return C.get_object(R.objects(spark, d), ws, object_path=path)


def q_filter_objects(spark, d):
    cur = C.current_versions(R.objects(spark, d))
    return C.object_listing(C.filter_objects(cur, COPY_SCHEMAS))


def q_latest_versions(spark, d):
    cur = C.current_versions(R.objects(spark, d))
    return cur.select("workspace_id", "id", "version_id", iso_timestamp("created_at").alias("created_at"))


def q_object_versions(spark, d):
    ws, oid, _ = _lookup_target(spark, d)
    return C.object_versions(R.objects(spark, d), ws, object_id=oid)


def q_object_content(spark, d):
    ws, oid, _ = _lookup_target(spark, d)
    objects = R.objects(spark, d)
    doc = C.object_content(objects, ws, object_id=oid)
    one = C.object_references(C._one(objects, ws, oid, ""), R.references(spark, d))
    n = one.groupBy("version_id").agg(F.count(F.lit(1)).cast("int").alias("n_refs"))
    return doc.join(n, "version_id", "left").select(
        "id", "version_id", "schema_id", F.get_json_object("document", "$.schema").alias("doc_schema"),
        F.get_json_object("document", "$.coordinate_reference_system").alias("crs"),
        F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def q_workspace_summary(spark, d):
    return C.workspace_summary(R.objects(spark, d))


def q_workspace_snapshot(spark, d):
    snap = C.workspace_snapshot(R.objects(spark, d), R.workspaces(spark, d), SOURCE_WS, SNAPSHOT_NAME,
                                SNAPSHOT_TIME, include_data_blobs=True, references=R.references(spark, d))
    return snap


def q_snapshot_references(spark, d):
    return C.snapshot_references(R.objects(spark, d), SOURCE_WS, SNAPSHOT_NAME, R.references(spark, d))


def q_iso_timestamps(spark, d):
    return R.events(spark, d).select("event_id", iso_timestamp("ts").alias("ts"))


def q_data_references(spark, d):
    return C.object_references(R.objects(spark, d), R.references(spark, d))


def q_object_blobs(spark, d):
    matched, _ = C.object_blobs(R.objects(spark, d), R.blobs(spark, d), R.references(spark, d))
    return matched.select("workspace_id", "id", "version_id", "ordinal", "blob_id", "length")


def q_new_blobs(spark, d):
    res = C.duplicate_workspace(R.objects(spark, d), R.blobs(spark, d), SOURCE_WS, TARGET_WS,
                                references=R.references(spark, d))
    return res["new_blobs"]


def q_duplicate_workspace(spark, d):
    res = C.duplicate_workspace(R.objects(spark, d), R.blobs(spark, d), SOURCE_WS, TARGET_WS, COPY_SCHEMAS,
                                references=R.references(spark, d))
    return res["new_objects"].drop("document", "uuid")


def q_duplicate_counts(spark, d):
    res = C.duplicate_workspace(R.objects(spark, d), R.blobs(spark, d), SOURCE_WS, TARGET_WS, COPY_SCHEMAS,
                                references=R.references(spark, d))
    return res["counts"]


def q_copy_object(spark, d):
    ws, oid, _ = _lookup_target(spark, d)
    res = C.copy_object(R.objects(spark, d), R.blobs(spark, d), ws, TARGET_WS, oid, references=R.references(spark, d))
    return res["counts"]


def _target_store(spark, d, runs: int) -> tuple[str, list[dict]]:
    """(folder, rows that each run adds) of a store into which the source workspace is duplicated ``runs`` times."""
    base = _folder(spark, "store")
    added = []
    for _ in range(runs):
        copied = C.duplicate_workspace(R.objects(spark, d), R.blobs(spark, d), SOURCE_WS, TARGET_WS, references=R.references(spark, d))
        added.append(C.store_copies(copied, base, SOURCE_WS, _dt.datetime.fromisoformat(SNAPSHOT_TIME)))
    return base, added


def q_duplicate_then_list(spark, d):
    """The copies in the target's stored tables: ids, stored references of each, and how many blobs the target has for them."""
    base, added = _target_store(spark, d, 1)
    objects = C.stored_table(spark, f"{base}/objects", added[0]["objects"].schema)
    references = C.stored_table(spark, f"{base}/references", added[0]["references"].schema)
    held = C.stored_table(spark, f"{base}/blobs", added[0]["blobs"].schema).unionByName(
        R.blobs(spark, d).filter(F.col("workspace_id") == TARGET_WS))
    key = ["workspace_id", "id", "version_id"]
    n = C.checked_references(objects, held, references).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_references"), F.count_if("held").alias("n_held"))
    zero = F.lit(0).cast("long")
    listed = C.object_listing(C.filter_objects(C.current_versions(objects)))
    return listed.withColumn("workspace_id", F.lit(TARGET_WS)).join(n, key, "left").select(
        "id", "name", "path", "schema_id", "created_at", F.coalesce("n_references", zero).alias("n_references"),
        F.coalesce("n_held", zero).alias("n_held"))


def q_duplicate_twice(spark, d):
    """Rows that a first and a second run add to the target, and rows that its tables hold after both."""
    base, added = _target_store(spark, d, 2)
    out = None
    for name in ("objects", "references", "blobs"):
        counts = [a[name].agg(F.count(F.lit(1))).scalar() for a in added]
        held = C.stored_table(spark, f"{base}/{name}", added[0][name].schema)
        one = held.agg(F.count(F.lit(1)).alias("held")).select(
            F.lit(name).alias("table"), counts[0].alias("first"), counts[1].alias("second"), "held")
        out = one if out is None else out.unionByName(one)
    return out


def q_append_retry(spark, d):
    """Objects of the source workspace appended to a store, twice, as after a failure: what the store lists."""
    path = _folder(spark, "append")
    current = C.current_versions(R.objects(spark, d).filter(F.col("workspace_id") == SOURCE_WS))
    for _ in range(2):
        C.append_objects(current, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("id", "name", "path", "schema_id").agg(F.count(F.lit(1)).alias("versions"))


def q_filter_by_names(spark, d):
    """Current objects of all customers with a positive balance, whose names are a table of their own."""
    names = read_table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(
        F.concat(F.lit("object-"), F.col("c_custkey").cast("string")).alias("name"))
    return C.object_listing(C.filter_objects(C.current_versions(R.objects(spark, d)), name_filter=names))


def q_nested_references(spark, d):
    """References of documents that nest twelve levels, escape a key and repeat keys."""
    return C.document_references(R.nested_documents(spark, d))


def q_document_problems(spark, d):
    """Every fault of nested documents: wrong types, missing inner fields, surplus fields."""
    return document_problems(R.flawed_documents(spark, d))


def q_schema_conformance(spark, d):
    cur = C.current_versions(R.objects(spark, d))
    return conformance(cur)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
