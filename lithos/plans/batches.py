"""Many objects in one plan (OBJ-1..5 for whole tables of objects).

The single-object builders take the tables of one object; these take the tables of all of them with a key column and
build every object at once: one grouped gate, one ranking a table, one write a role. The parts are those of
``operators.segmented``. A batch holds

* ``report``: one row an object with status, errors, warnings, counts and box,
* ``arrays``: name -> DataFrame (object, pos, fields of the array's role) of all objects,
* ``documents(lengths)``: one row an object, its JSON referring to arrays by id.

``write_batch`` writes the arrays of the objects that passed the gate, each role as one table cut on ranges of (array,
position), and returns the documents with the lengths that were written. Array ids are derived from build, object and
array, so that a document and its arrays agree without any list in the driver. They begin with what the rows of the
objects are dealt by, so that arrays are written in the order in which their rows were placed, without a further sort
of all rows. Hot objects (``segmented.HOT_ROWS``) are placed and written by ranges of their rows, beside the others.
"""

from __future__ import annotations

import hashlib
import uuid as _uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.jsondoc import document_json
from lithos.functions.numeric import coerce_double, invert
from lithos.operators import arrays as A
from lithos.operators import segmented as S
from lithos.operators.encode import AttributeSpec, attribute_columns, plan_attributes
from lithos.operators.holes import hole_text
from lithos.operators.position import materialize
from lithos.operators.quality import coordinate_summary, gate_status, missing_columns, not_numeric
from lithos.operators.segmented import ID, OBJECT
from lithos.plans.builders import POS, SCHEMA_IDS

_BOX = [f"{b}_{a}" for a in "xyz" for b in ("min", "max")]


@dataclass
class Batch:
    object_type: str
    report: DataFrame
    build: str = ""
    warnings: list[str] = field(default_factory=list)
    arrays: dict[str, Callable[[bool], DataFrame]] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    body: Callable[[Callable[[str], Column]], Column] | None = None
    hot: Callable[[], list[str]] = list
    memo: dict[str, DataFrame] = field(default_factory=dict)

    def array(self, name: str) -> DataFrame:
        """(object, pos, fields) of one array of every object; lookups have their key, hole indexes their hole as
        position."""
        if name not in self.memo:
            out = self.arrays[name](False)
            self.memo[name] = (out.unionByName(self.arrays[name](True)) if self.hot() else out).drop(ID)
        return self.memo[name]

    def failed(self) -> DataFrame:
        """Keys of the objects that may not be built."""
        return self.report.filter(F.col("status") != "validation_passed").select(OBJECT)

    def add(self, name: str, role: str, make: Callable[[bool], DataFrame]) -> None:
        """``make(hot)``: the array's rows, with their ``ID``, of hot objects or of the others."""
        self.arrays[name], self.roles[name] = make, role

    def array_id(self, name: str, object_id: Column | None = None) -> Column:
        rest = hashlib.sha256(f"{self.build}\n{name}".encode()).hexdigest()[:16]
        return F.concat(F.lit(f"{self.roles[name]}-"), S.object_id() if object_id is None else object_id, F.lit(rest))

    def documents(self, lengths: DataFrame | None = None) -> DataFrame:
        """(object, document) of the objects that passed. ``lengths`` (object, array, length), as written; an array
        without rows has length 0, and without ``lengths`` all are absent."""
        rows = self.report.filter(F.col("status") == "validation_passed")
        if lengths is not None:
            # a map of an object's few arrays, whatever their rows
            of = lengths.groupBy(OBJECT).agg(F.map_from_entries(F.collect_list(F.struct("array", "length"))).alias("__len"))
            rows = rows.join(of, OBJECT, "left")

        def ref(name: str) -> Column:
            n = F.lit(None).cast("long") if lengths is None else F.coalesce(F.col("__len")[name], F.lit(0)).cast("long")
            return F.struct(self.array_id(name).alias("data"), n.alias("length"))

        return rows.select(OBJECT, document_json(self.body(ref)).alias("document"))


def _once(fn):
    memo: dict = {}

    def get(*args):
        if args not in memo:
            memo[args] = fn(*args)
        return memo[args]

    return get


def _errors(report: DataFrame, errors: Sequence[str], *conditions: tuple[Column, Column]) -> DataFrame:
    """The grouped gate with errors of the schema (for every object) and of further conditions (condition, text)."""
    more = F.filter(F.array(*[F.lit(e) for e in errors], *[F.when(c, t) for c, t in conditions], F.lit(None).cast("string")),
                    lambda e: e.isNotNull())
    out = report.withColumn("errors", F.concat("errors", more))
    return out.withColumn("status", F.when(F.size("errors") > 0, "validation_failed").otherwise("validation_passed"))


def _required(what: str, df: DataFrame, columns: Sequence[str]) -> None:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"columns not in the {what}: {missing}")


def _text(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"column '{c}' holds text, not numbers" for c in not_numeric(df, columns)]


def _warned(report: DataFrame, warnings: Sequence[str]) -> DataFrame:
    return report.withColumn("warnings", F.concat("warnings", F.array(*[F.lit(w) for w in warnings]).cast("array<string>")))


def _box() -> Column:
    return F.struct(*[F.col(c) for c in _BOX])


def _header(object_type: str, crs: str) -> list[Column]:
    return [F.col(OBJECT).alias("name"), F.lit(SCHEMA_IDS[object_type]).alias("schema"),
            F.lit(crs).alias("coordinate_reference_system"), _box().alias("bounding_box")]


def _attributes(batch: Batch, rows: Callable[[bool], DataFrame], specs: list[AttributeSpec], scope: str = "") -> Callable:
    """Add the arrays of the attributes of one table of all objects; the returned function gives their document part."""
    cats = [s.name for s in specs if s.kind == "category"]
    found = _once(lambda hot: S.lookups(rows(hot), cats, POS, hot))
    names = {}
    for s in specs:
        n = f"{scope}{s.key}"
        if s.kind == "category":
            batch.add(f"lookup:{n}", "lookup", lambda hot, s=s: found(hot).filter(F.col("attribute") == s.name).select(
                ID, OBJECT, F.col("key").cast("long").alias("pos"), "key", "value"))
            batch.add(f"codes:{n}", "codes", lambda hot, s=s: S.codes(rows(hot), s.name, found(hot), POS, hot))
            names[s.name] = (f"lookup:{n}", f"codes:{n}")
        else:
            batch.add(f"values:{n}", "values", lambda hot, s=s: rows(hot).select(
                ID, OBJECT, F.col(POS).alias("pos"), coerce_double(F.col(f"`{s.name}`"), s.dtype).alias("data")))
            names[s.name] = (None, f"values:{n}")

    def part(ref) -> Column:
        docs = []
        for s in specs:
            table, values = names[s.name]
            docs.append(F.struct(
                F.lit(s.name).alias("name"), F.lit(s.key).alias("key"), F.lit(s.kind).alias("attribute_type"),
                F.struct(F.array().cast("array<double>").alias("values")).alias("nan_description"),
                (ref(table) if table else F.lit(None).cast("struct<data:string,length:bigint>")).alias("table"),
                ref(values).alias("values")))
        return F.array(*docs) if docs else F.array().cast("array<string>")

    return part


def _project(rows: Callable[[bool], DataFrame], role: str, sources: Sequence) -> Callable[[bool], DataFrame]:
    def make(hot: bool) -> DataFrame:
        cols = [(F.col(f"`{s}`") if isinstance(s, str) else s).cast(t).alias(n) for (n, t), s in zip(A.ARRAY_FIELDS[role], sources, strict=True)]
        return rows(hot).select(ID, OBJECT, F.col(POS).alias("pos"), *cols)

    return make


def _placed(df: DataFrame, order: Sequence, used: Sequence[str], hot: Callable[[], list[str]],
            among: DataFrame | None = None) -> Callable[[bool], DataFrame]:
    """Rows (of the objects ``among``) with their position, of hot objects or of the others, written once with the columns
    ``used`` by the arrays, which all read them."""
    keep = [c for c in df.columns if c in {OBJECT, *used}]

    def make(is_hot: bool) -> DataFrame:
        names = F.col(OBJECT).isin(hot())
        return S.placed(df.filter(names if is_hot else ~names) if hot() else df, order, POS, keep, among, is_hot)

    return _once(make)


def build_pointsets(df: DataFrame, object_col: str, x: str, y: str, z: str, order_cols: Sequence[str],
                    attribute_cols: Sequence[str] | None = None, crs: str = "unspecified", build: str | None = None) -> Batch:
    """OBJ-1 for every value of ``object_col``: rows along ``order_cols`` (a total order inside an object)."""
    _required("table", df, [object_col, x, y, z, *order_cols])
    roles = [object_col, x, y, z]
    specs, warnings = plan_attributes(df, attribute_columns(df, attribute_cols, roles), exclude=roles)
    df = S.keyed(df, object_col)
    hot = _once(lambda: S.hot_objects([df]))
    rows = _placed(df, order_cols, [x, y, z, *(a.name for a in specs)], hot)
    gate = gate_status(coordinate_summary(df, x, y, z, [OBJECT]), "rows")
    batch = Batch("pointset", _warned(_errors(gate, _text(df, [x, y, z])), warnings).select(
        OBJECT, "status", "errors", "warnings", "rows", "valid_rows", "missing_rows", *_BOX), build or _uuid.uuid4().hex, warnings, hot=hot)
    batch.add("coordinates", "coordinates", _project(rows, "coordinates", [x, y, z]))
    attrs = _attributes(batch, rows, specs)
    batch.body = lambda ref: F.struct(*_header("pointset", crs), F.struct(
        ref("coordinates").alias("coordinates"), attrs(ref).alias("attributes")).alias("locations"))
    return batch


def build_line_segments(vertices: DataFrame, segments: DataFrame, vertex_object: str, segment_object: str, x: str, y: str, z: str,
                        start: str, end: str, vertex_order: Sequence[str], segment_order: Sequence[str],
                        vertex_attribute_cols: Sequence[str] | None = None, segment_attribute_cols: Sequence[str] | None = None,
                        crs: str = "unspecified", build: str | None = None) -> Batch:
    """OBJ-2 for every object: vertex i is the object's i-th along ``vertex_order``; each object's segment ends are
    held against its own vertices. Segments of an object without vertices fail it."""
    _required("vertices", vertices, [vertex_object, x, y, z, *vertex_order])
    _required("segments", segments, [segment_object, start, end, *segment_order])
    text = _text(vertices, [x, y, z]) + _text(segments, [start, end])
    vroles, sroles = [vertex_object, x, y, z], [segment_object, start, end]
    vspecs, vw = plan_attributes(vertices, attribute_columns(vertices, vertex_attribute_cols, vroles), vroles)
    sspecs, sw = plan_attributes(segments, attribute_columns(segments, segment_attribute_cols, sroles), sroles)
    v, s = S.keyed(vertices, vertex_object), S.keyed(segments, segment_object)
    hot = _once(lambda: S.hot_objects([v, s]))
    vrows = _placed(v, vertex_order, [x, y, z, *(a.name for a in vspecs)], hot)
    srows = _placed(s, segment_order, [start, end, *(a.name for a in sspecs)], hot)
    box = coordinate_summary(v, x, y, z, [OBJECT])
    check = S.segment_index_check(v, s, start, end)
    joined = check.join(box.drop("rows"), OBJECT, "left").withColumn("rows", F.col("vertices"))
    joined = joined.fillna(0, ["valid_rows", "missing_rows"]).fillna(False, ["finite"])
    gate = _errors(gate_status(joined, "vertices"), text, (F.col("bad_start") + F.col("bad_end") > 0,
                                                          F.lit("segments have ends that are no vertex number")))
    batch = Batch("line-segments", _warned(gate, vw + sw).select(
        OBJECT, "status", "errors", "warnings", "vertices", "segments", "max_start", "max_end", "bad_start", "bad_end", *_BOX),
        build or _uuid.uuid4().hex, vw + sw, hot=hot)
    batch.add("coordinates", "coordinates", _project(vrows, "coordinates", [x, y, z]))
    batch.add("indices", "indices", lambda hot: A.index_pairs(srows(hot), start, end, POS, keep=(ID, OBJECT)))
    vattrs, sattrs = _attributes(batch, vrows, vspecs, "vertices."), _attributes(batch, srows, sspecs, "segments.")

    def table(ref, name: str, attrs) -> Column:
        r = ref(name)
        return F.struct(r["data"].alias("data"), r["length"].alias("length"), attrs(ref).alias("attributes"))

    batch.body = lambda ref: F.struct(*_header("line-segments", crs), F.struct(
        table(ref, "coordinates", vattrs).alias("vertices"), table(ref, "indices", sattrs).alias("indices")).alias("segments"))
    return batch


@dataclass
class Intervals:
    """The interval tables of one collection name, of all objects."""

    name: str
    df: DataFrame
    object_col: str
    id_col: str
    from_col: str
    to_col: str
    order_cols: Sequence[str]
    attribute_cols: Sequence[str] | None = None


def build_downhole_collections(collar: DataFrame, survey: DataFrame, collar_object: str, survey_object: str, collar_id: str,
                               survey_id: str, x: str, y: str, z: str, depth: str, azimuth: str, dip: str,
                               collar_order: Sequence[str], survey_order: Sequence[str], collections: Sequence[Intervals] = (),
                               invert_z: bool = False, crs: str = "unspecified", build: str | None = None) -> Batch:
    """OBJ-3 for every object that has collars: a hole id names a hole of its own object only. Survey and interval rows
    of objects without collars are left out."""
    _required("collars", collar, [collar_object, collar_id, x, y, z, *collar_order])
    _required("survey", survey, [survey_object, survey_id, depth, azimuth, dip, *survey_order])
    text = _text(collar, [x, y, z]) + _text(survey, [depth, azimuth, dip])
    inverted = F.col(f"`{dip}`")
    if invert_z and not not_numeric(survey, [dip]):
        if dip in {survey_object, survey_id, depth, azimuth, *survey_order}:  # it is read elsewhere too
            survey = survey.withColumn(dip, invert(inverted, True))
        else:
            inverted = invert(inverted, True)
    c, s = S.keyed(collar, collar_object), S.keyed(survey, survey_object)
    known = c.select(OBJECT).distinct()
    tables, specs_of, warnings, used = {}, [], [], [survey_id, depth, azimuth, dip]
    for t in collections:
        _required(f"intervals '{t.name}'", t.df, [t.object_col, t.id_col, t.from_col, t.to_col, *t.order_cols])
        text += _text(t.df, [t.from_col, t.to_col])
        roles = [t.object_col, t.id_col, t.from_col, t.to_col]
        specs, w = plan_attributes(t.df, attribute_columns(t.df, t.attribute_cols, roles), roles)
        specs_of.append(specs)
        warnings += w
        mine = [t.id_col, t.from_col, t.to_col, *(a.name for a in specs)]
        if t.df is survey and (t.object_col, t.id_col, t.from_col, *t.order_cols) == (survey_object, survey_id, depth, *survey_order):
            tables[t.name] = None  # the survey's rows in their order: placed once for both
            used += mine
        else:
            tables[t.name] = (S.keyed(t.df, t.object_col), mine)
    gate = coordinate_summary(c, x, y, z, [OBJECT]).join(
        c.groupBy(OBJECT).agg(F.count_distinct(hole_text(c, collar_id)).alias("unique_holes")), OBJECT)
    shared = F.when(F.col("rows") != F.col("unique_holes"), F.array(F.concat(
        F.col("rows").cast("string"), F.lit(" collars share "), F.col("unique_holes").cast("string"), F.lit(" hole ids")))).otherwise(
        F.array().cast("array<string>"))
    report = _errors(gate_status(gate, "collar rows"), text).withColumn("warnings", F.concat("warnings", shared))
    hot = _once(lambda: S.hot_objects([c, s, *(t[0] for t in tables.values() if t)]))
    batch = Batch("downhole-collection", _warned(report, warnings).select(
        OBJECT, "status", "errors", "warnings", "rows", "unique_holes", "valid_rows", *_BOX), build or _uuid.uuid4().hex, warnings, hot=hot)
    crows = _placed(c, [hole_text(c, collar_id), *collar_order], [collar_id, x, y, z], hot)
    srows = _placed(s, [hole_text(s, survey_id), F.col(f"`{depth}`"), *survey_order], used, hot, known)
    trows = {t.name: _placed(tables[t.name][0], [hole_text(t.df, t.id_col), F.col(f"`{t.from_col}`"), *t.order_cols], tables[t.name][1], hot, known)
             if tables[t.name] else srows for t in collections}
    index = _once(lambda hot: S.hole_indexes(crows(hot), collar_id, {"": (srows(hot), survey_id), **{
        t.name: (trows[t.name](hot), t.id_col) for t in collections}}, hot))

    def holes(name: str) -> Callable[[bool], DataFrame]:
        return lambda hot: index(hot)[1][name].select(ID, OBJECT, F.col("hole_index").cast("long").alias("pos"), "hole_index", "offset", "count")

    batch.add("coordinates", "coordinates", _project(crows, "coordinates", [x, y, z]))
    batch.add("distances", "distances", lambda hot: S.distances(crows(hot), srows(hot), collar_id, survey_id, depth, POS, hot))
    batch.add("lookup", "lookup", lambda hot: index(hot)[0].select(ID, OBJECT, F.col("key").cast("long").alias("pos"), "key", "value"))
    batch.add("codes", "codes", lambda hot: S.collar_keys(crows(hot), collar_id, index(hot)[0], POS, hot))
    batch.add("holes", "holes", holes(""))
    batch.add("path", "path", _project(srows, "path", [depth, azimuth, inverted]))
    parts = []
    for t, specs in zip(collections, specs_of, strict=True):
        rows = trows[t.name]
        batch.add(f"from_to:{t.name}", "from_to", _project(rows, "from_to", [t.from_col, t.to_col]))
        batch.add(f"holes:{t.name}", "holes", holes(t.name))
        parts.append((t.name, _attributes(batch, rows, specs, f"{t.name}.")))

    def body(ref) -> Column:
        colls = [F.struct(F.lit(n).alias("name"), F.struct(
            F.struct(ref(f"from_to:{n}").alias("start_and_end")).alias("intervals"), attrs(ref).alias("attributes")).alias("from_to"),
            ref(f"holes:{n}").alias("holes")) for n, attrs in parts]
        return F.struct(*_header("downhole-collection", crs), F.struct(
            *[ref(n).alias(n) for n in ("coordinates", "distances", "path")],
            F.struct(ref("lookup").alias("table"), ref("codes").alias("values")).alias("hole_id"), ref("holes").alias("holes")).alias("location"),
            *([F.array(*colls).alias("collections")] if colls else []))

    batch.body = body
    return batch


def build_downhole_intervals(df: DataFrame, object_col: str, hole_id: str, from_col: str, to_col: str, start: Sequence[str],
                             end: Sequence[str], mid: Sequence[str], order_cols: Sequence[str],
                             attribute_cols: Sequence[str] | None = None, is_composited: bool = False, crs: str = "unspecified",
                             build: str | None = None) -> Batch:
    """OBJ-4 for every value of ``object_col``; hole ids are coded in order of first appearance in their object."""
    roles = [object_col, hole_id, from_col, to_col, *start, *end, *mid]
    _required("table", df, [*roles, *order_cols])
    specs, warnings = plan_attributes(df, attribute_columns(df, attribute_cols, roles), roles)
    text = _text(df, [from_col, to_col, *start, *end, *mid])
    df = S.keyed(df, object_col)
    hot = _once(lambda: S.hot_objects([df]))
    rows = _placed(df, order_cols, [*roles, *(a.name for a in specs)], hot)
    gate = coordinate_summary(df, *mid, [OBJECT]).join(
        df.groupBy(OBJECT).agg(F.count_distinct(hole_text(df, hole_id)).alias("unique_holes")), OBJECT)
    batch = Batch("downhole-intervals", _warned(_errors(gate_status(gate, "rows"), text), warnings).select(
        OBJECT, "status", "errors", "warnings", "rows", "valid_rows", "unique_holes", *_BOX), build or _uuid.uuid4().hex, warnings, hot=hot)
    for name, axes in (("start", start), ("end", end), ("mid_points", mid)):
        batch.add(name, "coordinates", _project(rows, "coordinates", axes))
    batch.add("from_to", "from_to", _project(rows, "from_to", [from_col, to_col]))
    found = _once(lambda hot: S.lookups(rows(hot), [hole_id], POS, hot))
    batch.add("lookup", "lookup", lambda hot: found(hot).select(ID, OBJECT, F.col("key").cast("long").alias("pos"), "key", "value"))
    batch.add("codes", "codes", lambda hot: S.codes(rows(hot), hole_id, found(hot), POS, hot))
    attrs = _attributes(batch, rows, specs, "intervals.")
    batch.body = lambda ref: F.struct(
        *_header("downhole-intervals", crs), F.lit(is_composited).alias("is_composited"),
        *[F.struct(ref(n).alias("coordinates")).alias(n) for n in ("start", "end", "mid_points")],
        F.struct(F.struct(ref("from_to").alias("start_and_end")).alias("intervals")).alias("from_to"),
        F.struct(ref("lookup").alias("table"), ref("codes").alias("values")).alias("hole_id"), attrs(ref).alias("attributes"))
    return batch


#: Failed objects that are held in every task; where there are more, arrays meet them in a shuffle and are dealt anew.
_FEW = 100_000


def write_batch(batch: Batch, base_path: str) -> DataFrame:
    """Write the arrays of every object that passed, one table a role, and return (object, document) with the lengths
    that were written. Objects that failed the gate have no arrays and no document."""
    base, spark = base_path.rstrip("/"), batch.report.sparkSession
    failed = materialize(batch.failed())
    few = failed.count() <= _FEW
    by_role: dict[str, list[str]] = {}
    for name, role in batch.roles.items():
        by_role.setdefault(role, []).append(name)
    lengths = None
    for role, names in by_role.items():
        target, mode, ranged = f"{base}/{role}", "errorifexists", None
        for name in names:
            for hot in (False, True) if batch.hot() else (False,):
                ordered = few and not hot
                rows = batch.arrays[name](hot).join(F.broadcast(failed) if few else failed, OBJECT, "left_anti")
                if ordered:  # the ids of one array name begin alike and go on with what is sorted by
                    rows = rows.sortWithinPartitions(ID, "pos")
                one = rows.select(batch.array_id(name, F.col(ID)).alias("array_id"), OBJECT, F.lit(name).alias("array"), "pos",
                                  *[n for n, _ in A.ARRAY_FIELDS[role]])
                if ordered:
                    A.write_rows(one, target, role, mode, ordered=True)
                    mode = "append"
                else:
                    ranged = one if ranged is None else ranged.unionByName(one)
        if ranged is not None:
            A.write_rows(ranged, target, role, mode)
        written = spark.read.schema(one.schema).parquet(target)
        A.write_ranges(written, target)
        counted = written.groupBy(OBJECT, "array").agg(F.count(F.lit(1)).alias("length"))
        lengths = counted if lengths is None else lengths.unionByName(counted)
    return batch.documents(lengths)
