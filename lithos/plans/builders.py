"""Object builders (OBJ-1..6, OBJ-9): composites of the operators.

A builder returns a :class:`BuiltObject`: lazily defined array DataFrames (each with a dense
``pos``), a one-row report (gate status, errors, warnings, counts, box) and a one-row document
whose JSON refers to the arrays by id. Nothing is collected; ``write_object`` writes every
array (one job each) and returns the document row with the arrays' lengths. A dry run is
``report`` alone: the gate aggregate, no sink and no checkpoint folder is touched.

Row order: ``pos_col`` names a column that numbers the rows 0, 1, 2, ... (the gate checks that); else
``order_cols`` (a total order) are ranked with the distributed ordered index. Inside, the position is
``POS``, so a data column named ``pos`` is data like any other.
"""

from __future__ import annotations

import hashlib
import json
import uuid as _uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators import arrays as A
from lithos.operators.encode import (
    AttributeSpec, attribute_columns, category_codes, category_lookup, category_lookups, continuous_values,
    plan_attributes,
)
from lithos.functions.jsondoc import document_json
from lithos.functions.numeric import invert
from lithos.operators.holes import collar_keys, hole_distances, hole_indexes, hole_text
from lithos.operators.position import with_ordered_index
from lithos.operators.quality import (
    coordinate_summary, gate_status, missing_columns, not_numeric, position_problems, segment_index_check,
)

#: Name of the dense row position inside a builder.
POS = "__pos"

# Schema identifiers and versions of the four object types built here.
SCHEMA_IDS = {
    "pointset": "/objects/pointset/1.3.0/pointset.schema.json",
    "line-segments": "/objects/line-segments/2.2.0/line-segments.schema.json",
    "downhole-collection": "/objects/downhole-collection/1.3.0/downhole-collection.schema.json",
    "downhole-intervals": "/objects/downhole-intervals/1.3.0/downhole-intervals.schema.json",
}


@dataclass
class BuiltObject:
    object_type: str
    report: DataFrame
    document: DataFrame | None = None
    arrays: dict[str, DataFrame] = field(default_factory=dict)
    array_roles: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    rows: object = None  # DataFrame, or a zero-arg callable that positions the rows on demand
    lookups: dict[str, object] = field(default_factory=dict)
    collections: dict[str, dict] = field(default_factory=dict)  # array ids of each interval collection

    def positioned(self) -> DataFrame:
        """The input rows with their dense ``pos`` (ranked on first use)."""
        if callable(self.rows):
            self.rows = self.rows()
        return self.rows

    def lookup(self, column: str) -> DataFrame:
        lk = self.lookups[column]
        if callable(lk):
            lk = lk()
            self.lookups[column] = lk
        return lk

    def array(self, array_id: str) -> DataFrame:
        """The array DataFrame; arrays that need a sort are defined lazily and built here."""
        a = self.arrays[array_id]
        if callable(a):
            a = a()
            self.arrays[array_id] = a
        return a

    def arrays_of(self, role: str) -> list[str]:
        return [aid for aid, r in self.array_roles.items() if r == role]


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row DataFrame to every row of ``df`` through a scalar
    subquery (evaluated once), not a join."""
    cols = one_row.columns
    return df.withColumn("__r", one_row.select(F.struct(*cols)).scalar()).select(
        *df.columns, *[F.col(f"__r.{c}").alias(c) for c in cols])


def _once(fn):
    """Memoise a zero-arg builder of a DataFrame (a lazy array computed at most once)."""
    memo: dict = {}

    def get():
        if "v" not in memo:
            memo["v"] = fn()
        return memo["v"]

    return get


def _positioned(df: DataFrame, order_cols: Sequence | None, pos_col: str | None) -> DataFrame:
    """``df`` with its dense position as ``POS`` (a given ``pos_col`` becomes it)."""
    if pos_col:
        return df.withColumnRenamed(pos_col, POS)
    if not order_cols:
        raise ValueError("the order of the rows is unknown: give pos_col or order_cols")
    return with_ordered_index(df, list(order_cols), name=POS)


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _gated(gate: DataFrame, errors: Sequence[str], warnings: Sequence[str], *one_rows: DataFrame) -> DataFrame:
    """The gate row with further errors: texts known from the schema, and ``errors`` of one-row checks."""
    errs = F.concat("errors", _strings(errors), *[r.select("errors").scalar() for r in one_rows])
    out = gate.withColumn("errors", errs).withColumn("warnings", F.concat("warnings", _strings(warnings)))
    return out.withColumn("status", F.when(F.size("errors") > 0, "validation_failed").otherwise("validation_passed"))


def _order_checks(*frames: tuple[DataFrame, str | None, bool]) -> list[DataFrame]:
    return [position_problems(df, pos) for df, pos, check in frames if pos and check]


def _not_numbers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"column '{c}' holds text, not numbers" for c in not_numeric(df, columns)]


def _aid(role: str) -> str:
    return f"{role}-{_uuid.uuid4().hex[:16]}"


def _ref(array_id: str, length: Column) -> Column:
    return F.struct(F.lit(array_id).alias("data"), length.cast("long").alias("length"))


def _bbox(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{b}_{a}").alias(f"{b}_{a}") for a in "xyz" for b in ("min", "max")])


# A NULL stands for a missing value, so no value of an attribute stands for one.
def _nan() -> Column:
    return F.struct(F.array().cast("array<double>").alias("values"))


def _attributes(built: BuiltObject, df, specs: list[AttributeSpec], order_col: str, scope: str,
                rows: Column) -> Column:
    """Add the arrays of each attribute to ``built`` and return the document array.

    All category attributes of one table share a single ranked lookup (the unpivoted form of
    SURVEY §4.3.3: one shuffle and one ordered index however many category columns there are);
    each attribute's lookup is a filter of it. ``df`` may be a zero-arg callable (rows that
    still need positioning or sorting): every array is then defined lazily and nothing is
    computed unless the array is asked for or written."""
    rows_f = df if callable(df) else (lambda: df)
    cats = [s.name for s in specs if s.kind == "category"]
    all_lookups = _once(lambda: category_lookups(rows_f(), cats, order_col))
    docs = []
    for s in specs:
        if s.kind == "category":
            lk_id, codes_id = _aid("lookup"), _aid("codes")
            lk = _once(lambda s=s: all_lookups().filter(F.col("attribute") == s.name).select("key", "value"))
            built.lookups[s.name] = lk
            built.arrays[lk_id] = lk
            built.arrays[codes_id] = (lambda s=s, lk=lk: category_codes(rows_f(), s.name, lk(), keep=[POS], name="data").withColumnRenamed(POS, "pos"))
            built.array_roles[lk_id] = "lookup"
            built.array_roles[codes_id] = "codes"
            docs.append(F.struct(
                F.lit(s.name).alias("name"), F.lit(s.key).alias("key"), F.lit("category").alias("attribute_type"),
                _nan().alias("nan_description"),
                _ref(lk_id, F.lit(None)).alias("table"), _ref(codes_id, rows).alias("values")))
        else:
            v_id = _aid("values")
            built.arrays[v_id] = (lambda s=s: continuous_values(rows_f(), s.name, keep=[POS], name="data").withColumnRenamed(POS, "pos"))
            built.array_roles[v_id] = "values"
            docs.append(F.struct(
                F.lit(s.name).alias("name"), F.lit(s.key).alias("key"), F.lit("continuous").alias("attribute_type"),
                _nan().alias("nan_description"),
                F.lit(None).cast("struct<data:string,length:bigint>").alias("table"), _ref(v_id, rows).alias("values")))
    return F.array(*docs) if docs else F.lit(None).cast("array<string>")


def _header(name: str, description: str, tags: dict | None, crs: str, object_type: str) -> list[Column]:
    tag_map = F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]) if tags else \
        F.create_map().cast("map<string,string>")
    return [F.lit(name).alias("name"), F.lit(None).cast("string").alias("uuid"), F.lit(description).alias("description"),
            tag_map.alias("tags"), F.lit(SCHEMA_IDS[object_type]).alias("schema"),
            F.lit(crs).alias("coordinate_reference_system")]


def _failed(object_type: str, errors: list[str], warnings: list[str], spark, status: str = "validation_failed") -> BuiltObject:
    rep = spark.createDataFrame([(object_type, status, errors, warnings)],
                                "object_type string, status string, errors array<string>, warnings array<string>")
    return BuiltObject(object_type, rep, warnings=warnings)


def build_pointset(df: DataFrame, x: str, y: str, z: str, name: str = "pointset",
                   attribute_cols: Sequence[str] | None = None, description: str = "", tags: dict | None = None,
                   crs: str = "unspecified", order_cols: Sequence | None = None, pos_col: str | None = None,
                   check_pos: bool = True) -> BuiltObject:
    """OBJ-1: coordinates + attributes + box. Rows with a missing coordinate stay in the
    arrays; only the box (and the valid count) skip them."""
    missing = missing_columns(df, [x, y, z, pos_col])
    if missing:
        return _failed("pointset", [f"columns not in the table: {missing}"], [], df.sparkSession)
    rows_f = _once(lambda: _positioned(df, order_cols, pos_col))
    roles = [c for c in (x, y, z, pos_col) if c]
    specs, warns = plan_attributes(df, attribute_columns(df, attribute_cols, roles), exclude=roles)
    built = BuiltObject("pointset", report=None, warnings=warns, rows=rows_f)  # type: ignore[arg-type]
    summary = _gated(gate_status(coordinate_summary(df, x, y, z), "rows"), _not_numbers(df, [x, y, z]), warns,
                     *_order_checks((df, pos_col, check_pos)))
    built.report = summary.select(F.lit("pointset").alias("object_type"), "status", "errors", "warnings",
                                  "rows", "valid_rows", "missing_rows", *[f"{b}_{a}" for a in "xyz" for b in ("min", "max")])
    coords_id = _aid("coordinates")
    built.arrays[coords_id] = lambda: A.coordinates(rows_f(), x, y, z, POS)
    built.array_roles[coords_id] = "coordinates"
    attrs = _attributes(built, rows_f, specs, POS, "locations", F.col("rows"))
    built.document = summary.select(document_json(F.struct(
        *_header(name, description, tags, crs, "pointset"), _bbox().alias("bounding_box"),
        F.struct(_ref(coords_id, F.col("rows")).alias("coordinates"), attrs.alias("attributes")).alias("locations"),
    )).alias("document"))
    return built


def build_line_segments(vertices: DataFrame, segments: DataFrame, x: str, y: str, z: str, start: str, end: str,
                        name: str = "line-segments", vertex_attribute_cols: Sequence[str] | None = None,
                        segment_attribute_cols: Sequence[str] | None = None, description: str = "",
                        tags: dict | None = None, crs: str = "unspecified",
                        vertex_order: Sequence | None = None, segment_order: Sequence | None = None,
                        vertex_pos: str | None = None, segment_pos: str | None = None,
                        check_pos: bool = True) -> BuiltObject:
    """OBJ-2: vertices (row i = vertex i) + index pairs; attributes on both; box of vertices."""
    errors = []
    mv, ms = missing_columns(vertices, [x, y, z, vertex_pos]), missing_columns(segments, [start, end, segment_pos])
    if mv:
        errors.append(f"columns not in the vertices: {mv}")
    if ms:
        errors.append(f"columns not in the segments: {ms}")
    if errors:
        return _failed("line-segments", errors, [], vertices.sparkSession)
    # Vertex positions are the vertex index, so the vertices are ranked (unless given); the
    # gate itself needs neither ranking and runs on the raw rows.
    v_f = _once(lambda: _positioned(vertices, vertex_order, vertex_pos))
    s_f = _once(lambda: _positioned(segments, segment_order, segment_pos))
    v, s = vertices, segments
    vroles, sroles = [c for c in (x, y, z, vertex_pos) if c], [c for c in (start, end, segment_pos) if c]
    vspecs, vw = plan_attributes(v, attribute_columns(v, vertex_attribute_cols, vroles), vroles)
    sspecs, sw = plan_attributes(s, attribute_columns(s, segment_attribute_cols, sroles), sroles)
    built = BuiltObject("line-segments", report=None, warnings=vw + sw)  # type: ignore[arg-type]
    text = _not_numbers(v, [x, y, z]) + _not_numbers(s, [start, end])
    gate = gate_status(coordinate_summary(v, x, y, z), "vertices")
    checks = _order_checks((v, vertex_pos, check_pos), (s, segment_pos, check_pos))
    if text:  # ends that are no numbers cannot be compared with the vertex count
        joined = attach_row(gate, s.agg(F.count(F.lit(1)).alias("segments"))).withColumns(
            {c: F.lit(None).cast("double") for c in ("max_start", "max_end")}
            | {c: F.lit(None).cast("long") for c in ("bad_start", "bad_end")})
        joined = _gated(joined.withColumnRenamed("rows", "vertices"), text, vw + sw, *checks)
    else:
        check = segment_index_check(v, s, start, end)
        joined = attach_row(gate.drop("rows"), check.withColumnRenamed("status", "status_idx"))
        ends = F.when(F.col("status_idx") == "validation_failed", F.array(F.lit(
            "segments have ends that are no vertex number"))).otherwise(_no_errors())
        joined = _gated(joined.withColumn("errors", F.concat("errors", ends)), (), vw + sw, *checks)
    built.report = joined.select(
        F.lit("line-segments").alias("object_type"), "status", "errors", "warnings", "vertices", "segments",
        "max_start", "max_end", "bad_start", "bad_end", *[f"{b}_{a}" for a in "xyz" for b in ("min", "max")])
    vid, sid = _aid("coordinates"), _aid("indices")
    built.arrays[vid] = lambda: A.coordinates(v_f(), x, y, z, POS)
    built.array_roles[vid] = "coordinates"
    built.arrays[sid] = lambda: A.index_pairs(s_f(), start, end, POS)
    built.array_roles[sid] = "indices"
    vattrs = _attributes(built, v_f, vspecs, POS, "vertices", F.col("vertices"))
    sattrs = _attributes(built, s_f, sspecs, POS, "indices", F.col("segments"))
    built.document = joined.select(document_json(F.struct(
        *_header(name, description, tags, crs, "line-segments"), _bbox().alias("bounding_box"),
        F.struct(
            F.struct(F.lit(vid).alias("data"), F.col("vertices").alias("length"), vattrs.alias("attributes")).alias("vertices"),
            F.struct(F.lit(sid).alias("data"), F.col("segments").alias("length"), sattrs.alias("attributes")).alias("indices"),
        ).alias("segments"),
    )).alias("document"))
    return built


@dataclass
class IntervalConfig:
    """One interval collection (SRC-3): a table, its name and role columns."""
    name: str
    df: DataFrame
    id_col: str
    from_col: str
    to_col: str
    attribute_cols: Sequence[str] | None = None
    tie_cols: Sequence[str] = ()
    pos_col: str | None = None


def sorted_rows(df: DataFrame, id_col: str, key_col: str | None, tie_cols: Sequence[str] = (),
                pos_col: str | None = None, name: str = "pos") -> DataFrame:
    """ORD-1/2: rows sorted by (hole id text, depth or from, tie-breakers) with a new dense position
    ``name``; the row order given by ``pos_col`` is the default tie-breaker.

    The original's single-key sort is unstable; ours is deterministic (N6, deviation)."""
    ties = list(tie_cols) or ([pos_col] if pos_col else [])
    if not ties:
        # No position and no tie-breakers given: every other orderable column breaks ties, a
        # total order whenever whole rows are distinct.
        from pyspark.sql.types import ArrayType, MapType, StructType

        ties = [f.name for f in df.schema.fields if f.name not in (id_col, key_col)
                and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    order = [hole_text(df, id_col)] + [F.col(f"`{c}`") for c in ([key_col] if key_col else []) + ties]
    return with_ordered_index(df, order, name=name).drop(*([pos_col] if pos_col else []))


def build_downhole_collection(collar: DataFrame, survey: DataFrame, collar_id: str, survey_id: str,
                              x: str, y: str, z: str, depth: str, azimuth: str, dip: str,
                              max_depth_col: str | None = None, collections: Sequence[IntervalConfig] = (),
                              name: str = "downhole-collection", description: str = "", tags: dict | None = None,
                              crs: str = "unspecified", invert_z: bool = False,
                              collar_tie: Sequence[str] = (), survey_tie: Sequence[str] = (),
                              collar_pos: str | None = None, survey_pos: str | None = None,
                              extra_errors: Sequence[str] = ()) -> BuiltObject:
    """OBJ-3: one hole lookup shared by the location and every interval collection. A collection that lacks a
    column is an error of the gate and is left out; the others and the collars are still summarised."""
    errors = []
    mc = missing_columns(collar, [collar_id, x, y, z, collar_pos])
    if mc:
        errors.append(f"columns not in the collars: {mc}")
    if max_depth_col and max_depth_col not in collar.columns:
        errors.append(f"the collars have no column '{max_depth_col}' for the greatest depth")
    ms = missing_columns(survey, [survey_id, depth, azimuth, dip, survey_pos])
    if ms:
        errors.append(f"columns not in the survey: {ms}")
    if errors:
        return _failed("downhole-collection", errors, [], collar.sparkSession)
    errors = list(extra_errors) + _not_numbers(collar, [x, y, z]) + _not_numbers(survey, [depth, azimuth, dip])
    usable = []
    for i, c in enumerate(collections):
        c = c if c.name else replace(c, name=f"collection_{i}")  # SCL-2 default names
        m = missing_columns(c.df, [c.id_col, c.from_col, c.to_col, c.pos_col])
        if m:
            errors.append(f"columns not in the intervals '{c.name}': {m}")
        else:
            usable.append(c)
            errors += _not_numbers(c.df, [c.from_col, c.to_col])
    collections = usable
    if invert_z and dip not in not_numeric(survey, [dip]):  # PRJ-9
        survey = survey.withColumn(dip, invert(F.col(f"`{dip}`"), True))
    built = BuiltObject("downhole-collection", report=None)  # type: ignore[arg-type]
    # One ranked pass, on first use, gives the hole lookup and the index of the survey and of every collection.
    indexes = _once(lambda: hole_indexes(collar, collar_id, {
        "survey": (survey, survey_id), **{f"c{i}": (c.df, c.id_col) for i, c in enumerate(collections)}}))
    lookup = lambda: indexes()[0]
    built.lookups[collar_id] = lookup
    crows_f = _once(lambda: sorted_rows(collar, collar_id, None, collar_tie, collar_pos, POS))
    srows = _once(lambda: sorted_rows(survey, survey_id, depth, survey_tie, survey_pos, POS))
    built.rows = crows_f

    uniq = collar.agg(F.count_distinct(hole_text(collar, collar_id)).alias("unique_holes"))
    dup_warn = F.when(F.col("rows") != F.col("unique_holes"), F.array(F.concat(
        F.col("rows").cast("string"), F.lit(" collars share "), F.col("unique_holes").cast("string"),
        F.lit(" hole ids")))).otherwise(_no_errors())
    head = attach_row(gate_status(coordinate_summary(collar, x, y, z), "collar rows"), uniq)
    specs_of = []
    for c in collections:
        roles = [k for k in (c.id_col, c.from_col, c.to_col, c.pos_col) if k]
        specs, w = plan_attributes(c.df, attribute_columns(c.df, c.attribute_cols, [*roles, *c.tie_cols]), roles)
        specs_of.append(specs)
        built.warnings += w
    head = _gated(head.withColumn("warnings", F.concat("warnings", dup_warn)), errors, built.warnings)
    built.report = head.select(F.lit("downhole-collection").alias("object_type"), "status", "errors",
                               "warnings", "rows", "unique_holes", "valid_rows",
                               *[f"{b}_{a}" for a in "xyz" for b in ("min", "max")])
    ids = {r: _aid(r) for r in ("coordinates", "distances", "lookup", "codes", "holes", "path")}
    built.arrays[ids["coordinates"]] = lambda: A.coordinates(crows_f(), x, y, z, POS)
    built.arrays[ids["distances"]] = lambda: A.project_array(
        hole_distances(crows_f(), survey, collar_id, survey_id, depth, max_depth_col, keep=(POS,)),
        "distances", ["final", "target", "current"], POS)
    built.arrays[ids["lookup"]] = lookup
    built.arrays[ids["codes"]] = lambda: collar_keys(crows_f(), collar_id, lookup(), keep=(POS,)).select(
        F.col(POS).alias("pos"), F.col("key").alias("data"))
    # The index counts rows per hole; it does not need the sorted rows.
    built.arrays[ids["holes"]] = lambda: indexes()[1]["survey"]
    built.arrays[ids["path"]] = lambda: A.path(srows(), depth, azimuth, dip, POS)
    for role, aid in ids.items():
        built.array_roles[aid] = role
    coll_docs = []
    for ci, (c, specs) in enumerate(zip(collections, specs_of)):
        ft_id, h_id = _aid("from_to"), _aid("holes")
        crows_c = _once(lambda c=c: sorted_rows(c.df, c.id_col, c.from_col, c.tie_cols, c.pos_col, POS))
        built.arrays[ft_id], built.array_roles[ft_id] = (lambda f=crows_c, c=c: A.from_to(f(), c.from_col, c.to_col, POS)), "from_to"
        built.arrays[h_id], built.array_roles[h_id] = (lambda ci=ci: indexes()[1][f"c{ci}"]), "holes"
        built.collections[c.name] = {"from_to": ft_id, "holes": h_id}
        before = set(built.arrays)
        attrs = _attributes(built, crows_c, specs, POS, c.name, F.lit(None))
        built.collections[c.name]["attributes"] = [k for k in built.arrays if k not in before]
        coll_docs.append(F.struct(F.lit(c.name).alias("name"),
                                  F.struct(F.struct(_ref(ft_id, F.lit(None)).alias("start_and_end")).alias("intervals"),
                                           attrs.alias("attributes")).alias("from_to"),
                                  _ref(h_id, F.lit(None)).alias("holes")))
    built.document = head.select(document_json(F.struct(
        *_header(name, description, tags, crs, "downhole-collection"), _bbox().alias("bounding_box"),
        F.struct(*[_ref(ids[r], F.col("rows") if r in ("coordinates", "distances") else F.lit(None)).alias(r)
                   for r in ("coordinates", "distances", "path")],
                 F.struct(_ref(ids["lookup"], F.col("unique_holes")).alias("table"),
                          _ref(ids["codes"], F.col("rows")).alias("values")).alias("hole_id"),
                 _ref(ids["holes"], F.col("unique_holes")).alias("holes")).alias("location"),
        (F.array(*coll_docs) if coll_docs else F.lit(None).cast("array<string>")).alias("collections"),
    )).alias("document"))
    return built


def build_downhole_intervals(df: DataFrame, hole_id: str, from_col: str, to_col: str,
                             start: Sequence[str], end: Sequence[str], mid: Sequence[str],
                             attribute_cols: Sequence[str] | None = None, is_composited: bool = False,
                             name: str = "downhole-intervals", description: str = "", tags: dict | None = None,
                             crs: str = "unspecified", order_cols: Sequence | None = None,
                             pos_col: str | None = None, check_pos: bool = True) -> BuiltObject:
    """OBJ-4: start/end/mid points, from/to, hole-id category in first-appearance order,
    attributes; box from the midpoints."""
    required = [c for c in (hole_id, from_col, to_col, *start, *end, *mid, pos_col) if c]
    m = missing_columns(df, required)
    if m:
        return _failed("downhole-intervals", [f"columns not in the table: {m}"], [], df.sparkSession)
    rows_f = _once(lambda: _positioned(df, order_cols, pos_col))
    specs, warns = plan_attributes(df, attribute_columns(df, attribute_cols, required), required)
    built = BuiltObject("downhole-intervals", report=None, warnings=warns, rows=rows_f)  # type: ignore[arg-type]
    uniq = df.agg(F.count_distinct(hole_text(df, hole_id)).alias("unique_holes"))
    head = _gated(attach_row(gate_status(coordinate_summary(df, *mid), "rows"), uniq),
                  _not_numbers(df, [from_col, to_col, *start, *end, *mid]), warns, *_order_checks((df, pos_col, check_pos)))
    built.report = head.select(F.lit("downhole-intervals").alias("object_type"), "status", "errors", "warnings",
                               "rows", "valid_rows", "unique_holes", *[f"{b}_{a}" for a in "xyz" for b in ("min", "max")])
    ids = {r: _aid(r) for r in ("start", "end", "mid_points", "from_to", "lookup", "codes")}
    built.arrays[ids["start"]] = lambda: A.coordinates(rows_f(), *start, POS)
    built.arrays[ids["end"]] = lambda: A.coordinates(rows_f(), *end, POS)
    built.arrays[ids["mid_points"]] = lambda: A.coordinates(rows_f(), *mid, POS)
    built.arrays[ids["from_to"]] = lambda: A.from_to(rows_f(), from_col, to_col, POS)
    lookup = _once(lambda: category_lookup(rows_f(), hole_id, POS))
    built.lookups[hole_id] = lookup
    built.arrays[ids["lookup"]] = lookup
    built.arrays[ids["codes"]] = lambda: category_codes(
        rows_f(), hole_id, lookup(), keep=[POS], name="data").withColumnRenamed(POS, "pos")
    for r, aid in ids.items():
        built.array_roles[aid] = "coordinates" if r in ("start", "end", "mid_points") else r
    attrs = _attributes(built, rows_f, specs, POS, "intervals", F.col("rows"))
    built.document = head.select(document_json(F.struct(
        *_header(name, description, tags, crs, "downhole-intervals"), _bbox().alias("bounding_box"),
        F.lit(is_composited).alias("is_composited"),
        *[F.struct(_ref(ids[r], F.col("rows")).alias("coordinates")).alias(r) for r in ("start", "end", "mid_points")],
        F.struct(F.struct(_ref(ids["from_to"], F.col("rows")).alias("start_and_end")).alias("intervals")).alias("from_to"),
        F.struct(_ref(ids["lookup"], F.lit(None)).alias("table"), _ref(ids["codes"], F.col("rows")).alias("values")).alias("hole_id"),
        attrs.alias("attributes"),
    )).alias("document"))
    return built


def write_object(built: BuiltObject, base_path: str, request: str | None = None) -> DataFrame:
    """Write every array of ``built`` under ``base_path`` and return the document row, in which every array
    reference has the length that was written.

    A ``request`` (one text for one creation, whatever the number of attempts) makes the write safe to repeat: array ids
    follow from it, what an attempt left half-written is replaced, and once the arrays are in the manifest
    (``arrays.stored_arrays``), which is written last, a further attempt writes nothing."""
    spark, names = built.report.sparkSession, {aid: aid for aid in built.arrays}
    if request is not None:
        names = {aid: f"{built.array_roles[aid]}-{hashlib.sha256(f'{request}/{i}'.encode()).hexdigest()[:32]}"
                 for i, aid in enumerate(built.arrays)}
    done = {} if request is None else {r["array_id"]: r["length"] for r in A.stored_arrays(spark, base_path).filter(
        F.col("request") == request).collect()}  # the few arrays of one object
    lengths = {}
    for aid, name in names.items():
        lengths[aid] = done[name] if name in done else A.write_array(
            built.array(aid), base_path, built.array_roles[aid], name, "errorifexists" if request is None else "overwrite")["length"]
    if set(names.values()) - set(done):
        A.record_arrays(spark, base_path, request or _uuid.uuid4().hex, [(names[a], built.array_roles[a], lengths[a]) for a in names])

    def fill(node):
        if isinstance(node, dict):
            if node.get("data") in lengths:
                node["length"], node["data"] = lengths[node["data"]], names[node["data"]]
            for v in node.values():
                fill(v)
        elif isinstance(node, list):
            for v in node:
                fill(v)

    document = json.loads(built.document.first()["document"])  # one row: names, box and references
    fill(document)
    return spark.createDataFrame([(json.dumps(document),)], "document string")


def create_object(built: BuiltObject, arrays_path: str, objects_path: str, workspace_id: str, object_path: str,
                  dry_run: bool = True, request: str | None = None) -> dict:
    """OBJ-5/9 + SNK-10: the build-and-create flow as one report. With a ``request`` it can be repeated after a failure
    (``write_object``): the same arrays, one object, one version.

    * ``dry_run`` (default): the gate aggregate only, status ``validation_passed`` or
      ``validation_failed``; no sink is touched.
    * otherwise a failed gate stops here; the document is checked against the object catalog
      and the schema of its type at every depth (``schema_validation_failed`` with the faults found); then every array is
      written and the document appended (``created``), or ``creation_failed`` with the error.

    Only the one-row report and the one-row conformance result reach the driver.
    """
    from lithos.operators.catalog import append_objects
    from lithos.plans.schemas import conformance, document_problems

    try:
        report = built.report.first().asDict(recursive=True)
    except Exception as e:  # noqa: BLE001 - a gate that cannot run is a failed gate
        return {"status": "validation_failed", "error": str(e), "warnings": list(built.warnings)}
    result = {"status": report["status"], "validation": report, "warnings": list(built.warnings)}
    if dry_run or report["status"] != "validation_passed" or built.document is None:
        return result
    doc = built.document.select(
        F.lit("new").alias("id"), F.lit("new").alias("version_id"),
        F.lit(built.object_type).alias("schema_id"), "document")
    missing = [r["missing_field"] for r in conformance(doc).filter(F.col("missing_field") != "uuid").collect()]
    if missing:
        return {**result, "status": "schema_validation_failed", "error": f"missing fields: {missing}"}
    faults = [f"{r['problem']} at {r['at']}: {r['found']}" for r in document_problems(doc).collect()]  # of one document
    if faults:
        return {**result, "status": "schema_validation_failed", "error": f"document: {faults}"}
    try:
        document = write_object(built, arrays_path, request)
        name = F.get_json_object("document", "$.name")
        meta = append_objects(document.select(
            F.lit(workspace_id).alias("workspace_id"), name.alias("name"), F.lit(object_path).alias("path"),
            F.lit(built.object_type).alias("schema_id"), "document"), objects_path).first()
        return {**result, "status": "created", "object_id": meta["id"], "version_id": meta["version_id"],
                "path": meta["path"]}
    except Exception as e:  # noqa: BLE001 - reported, as the original tool does
        return {**result, "status": "creation_failed", "error": str(e)}
