"""Object-type catalog as data (OBJ-8) and document conformance (OBJ-7), top-level and at every depth.

The catalog is a small static dimension ``(object_type, parameter, required)``. For the four
types built here the fields are the ones the builders write (the prose catalog of the
original disagrees with its own code for three of them; the code wins).

Conformance joins every document with the required fields of its type (broadcast of the
small catalog, no shuffle of the documents) and reports the fields the document lacks, using
the top-level keys of the JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.jsondoc import document_keys
from lithos.operators.documents import fields, nodes

# Base fields of every object document.
BASE_REQUIRED = ("name", "uuid", "bounding_box", "coordinate_reference_system", "schema")
BASE_OPTIONAL = ("description", "extensions", "tags", "lineage")

# Top-level fields the builders write, per object type (required, optional).
TYPE_FIELDS = {
    "pointset": (("locations",), ()),
    "line-segments": (("segments",), ()),
    "downhole-collection": (("location",), ("collections",)),
    "downhole-intervals": (("start", "end", "mid_points", "from_to", "hole_id", "is_composited"), ("attributes",)),
}


# Object-specific parameters (required, optional) of the documented object types that are not
# built here.
DOCUMENTED_FIELDS = {
    "design-geometry": (("geometry",), ("attributes",)),
    "drilling-campaign": (("planned_holes",), ("prognoses", "interim_results",)),
    "frequency-domain-electromagnetic": (("survey_type", "data_type", "channels", "line_list",), ("survey_information",)),
    "geological-model-meshes": (("folders", "mesh",), ("materials", "volumes", "surfaces",)),
    "geological-sections": (("definition", "evaluations",), ("flatten_to_2d",)),
    "geophysical-records-1d": (("number_of_layers", "locations", "depths",), ("line_numbers",)),
    "global-ellipsoid": (("ellipsoid_ranges", "rotation",), ("domain", "attribute",)),
    "gravity": (("type", "survey_type", "base_stations", "gravity_line_list",), ("survey_information",)),
    "lineations-data-pointset": (("locations",), ()),
    "local-ellipsoids": (("locations", "ellipsoids", "domain", "attribute",), ()),
    "magnetics": (("type", "survey_type", "line_list",), ("base_stations", "gradient_details", "qa_qc_lists",)),
    "non-parametric-continuous-cumulative-distribution": (("distribution_data",), ("tail_extrapolations",)),
    "planar-data-pointset": (("locations",), ()),
    "radiometric": (("survey_type", "dead_time", "live_time", "idle_time", "array_dimension", "energy_level", "line_list",), ("survey_information",)),
    "regular-2d-grid": (("origin", "size", "cell_size",), ("rotation", "cell_attributes", "vertex_attributes",)),
    "regular-3d-grid": (("origin", "size", "cell_size",), ("rotation", "cell_attributes", "vertex_attributes",)),
    "regular-masked-3d-grid": (("origin", "size", "cell_size", "mask", "number_of_active_cells",), ("rotation", "cell_attributes",)),
    "resistivity-ip": (("number_of_dimensions", "number_contributing_electrodes", "survey_type", "configuration", "line_list",), ("survey_information",)),
    "tensor-2d-grid": (("origin", "size", "grid_cells_2d",), ("rotation", "cell_attributes", "vertex_attributes",)),
    "tensor-3d-grid": (("origin", "size", "grid_cells_3d",), ("rotation", "cell_attributes", "vertex_attributes",)),
    "time-domain-electromagnetic": (("survey_type", "channels", "line_list",), ("geometry_category", "gps_location",)),
    "triangle-mesh": (("triangles",), ("parts", "edges",)),
    "unstructured-grid": (("geometry",), ("cell_attributes", "vertex_attributes",)),
    "unstructured-hex-grid": (("hexahedrons",), ("cell_attributes", "vertex_attributes",)),
    "unstructured-quad-grid": (("quadrilaterals",), ("cell_attributes", "vertex_attributes",)),
    "unstructured-tet-grid": (("tetrahedrons",), ("cell_attributes", "vertex_attributes",)),
    "variogram": (("model_type", "structures", "rotation",), ("nugget",)),
}


# Nested fields of the documents of the four built types, as (path below the parent, kinds, required).
# An array's items are the step [].
_REFERENCE = (("/data", "string", True), ("/length", "integer", False))
_ATTRIBUTES = (("", "array", False), ("/[]", "object", False), ("/[]/name", "string", True), ("/[]/key", "string", True),
               ("/[]/attribute_type", "string", True), ("/[]/nan_description", "object", False),
               ("/[]/nan_description/values", "array", False), ("/[]/nan_description/values/[]", "number integer", False),
               *((f"/[]/{t}{p}", k, r) for t, q in (("table", False), ("values", True))
                 for p, k, r in (("", "object", q), *_REFERENCE)))
_BOX = ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z")
_BASE_NODES = (
    ("/name", "string", True), ("/uuid", "string", False), ("/description", "string", False), ("/schema", "string", True),
    ("/tags", "object *", False), ("/extensions", "object *", False), ("/lineage", "object *", False),
    ("/coordinate_reference_system", "string object *", True), ("/bounding_box", "object", True),
    *((f"/bounding_box/{b}", "number integer", True) for b in _BOX))


def _under(parent: str, nodes, required: bool | None = None):
    """``nodes`` below ``parent``; ``required`` overrides that of the first."""
    return tuple((parent + p, k, r if required is None or i else required) for i, (p, k, r) in enumerate(nodes))


def _ref(parent: str, required: bool = True):
    return _under(parent, (("", "object", required), *_REFERENCE))


_HOLE_ID = lambda parent: ((parent, "object", True), *_ref(f"{parent}/table"), *_ref(f"{parent}/values"))
_INTERVALS = lambda parent: ((f"{parent}/intervals", "object", True), *_ref(f"{parent}/intervals/start_and_end"))

TYPE_NODES = {
    "pointset": (("/locations", "object", True), *_ref("/locations/coordinates"), *_under("/locations/attributes", _ATTRIBUTES)),
    "line-segments": (("/segments", "object", True), *(n for t in ("vertices", "indices") for n in (
        *_ref(f"/segments/{t}"), *_under(f"/segments/{t}/attributes", _ATTRIBUTES)))),
    "downhole-collection": (
        ("/location", "object", True), *(n for t in ("coordinates", "distances", "path", "holes") for n in _ref(f"/location/{t}")),
        *_HOLE_ID("/location/hole_id"), ("/collections", "array", False), ("/collections/[]", "object", False),
        ("/collections/[]/name", "string", True), ("/collections/[]/from_to", "object", True), *_INTERVALS("/collections/[]/from_to"),
        *_under("/collections/[]/from_to/attributes", _ATTRIBUTES), *_under("/collections/[]/attributes", _ATTRIBUTES),
        *_ref("/collections/[]/holes")),
    "downhole-intervals": (
        *(n for t in ("start", "end", "mid_points") for n in ((f"/{t}", "object", True), *_ref(f"/{t}/coordinates"))),
        ("/from_to", "object", True), *_INTERVALS("/from_to"), *_HOLE_ID("/hole_id"), ("/is_composited", "boolean", True),
        *_under("/attributes", _ATTRIBUTES)),
}


def schema_rows() -> list[tuple[str, str, str, list[str], bool, bool]]:
    """(object_type, path, parent, kinds, required, open) of every field of the built types, at any depth. ``open``:
    an object whose keys are free."""
    rows = []
    for t, own in TYPE_NODES.items():
        rows.append((t, "", None, ["object"], True, False))
        for path, kinds, required in _BASE_NODES + own:
            words = kinds.split()
            rows.append((t, path, path.rpartition("/")[0], [w for w in words if w != "*"], required, "*" in words))
    return rows


def schema_table(spark: SparkSession) -> DataFrame:
    """``schema_rows`` as a DataFrame; a static dimension of some 200 rows."""
    return spark.createDataFrame(schema_rows(), "object_type string, path string, parent string, kinds array<string>, "
                                                "required boolean, open boolean")


def catalog_rows() -> list[tuple[str, str, bool, str]]:
    """(object_type, parameter, required, source) for every documented type; the four built
    types use the fields their builders write (source 'builder')."""
    rows = []
    for t, (req, opt) in {**DOCUMENTED_FIELDS, **TYPE_FIELDS}.items():
        src = "builder" if t in TYPE_FIELDS else "documented"
        rows += [(t, p, True, src) for p in BASE_REQUIRED + req]
        rows += [(t, p, False, src) for p in BASE_OPTIONAL + opt]
    return rows


def object_catalog(spark: SparkSession) -> DataFrame:
    """OBJ-8: (object_type, parameter, required, source), a static dimension of 31 types."""
    return spark.createDataFrame(catalog_rows(), "object_type string, parameter string, required boolean, source string")


def document_problems(objects: DataFrame, type_col: str = "schema_id") -> DataFrame:
    """OBJ-7 at every depth: (id, version_id, object_type, problem, at, expected, found) for every fault of a document.

    * ``missing``: a required field that its object lacks, in every item of an array; a null counts as absent
    * ``wrong type``: a value of another kind than the schema's (``at`` names the value)
    * ``unknown``: a field that the schema does not have there, once, at its top
    * ``invalid``: a text that is no JSON; ``unknown type``: an object type without a schema

    The schema is a table of (type, path, kinds, required); the documents are flattened to its depth (those that repeat
    a key as text, all others through VARIANT) and meet it in broadcast joins of that table, so that no document is
    shuffled."""
    schema = schema_rows()
    depth = 1 + max(path.count("/") for _, path, *_ in schema)
    table = schema_table(objects.sparkSession)
    known = sorted({r[0] for r in schema})
    docs = objects.select("id", "version_id", F.col(type_col).alias("object_type"), "document")
    keep, typed = ["id", "version_id", "object_type"], docs.where(F.col("object_type").isin(*known))
    whole = F.try_parse_json("document").isNotNull()
    rows = fields(typed.where(whole), depth, keep).unionByName(nodes(typed.where(~whole), depth, keep).drop("text", "ord"))
    # the schema's word for every node and for its parent; the children an object must have
    own = table.select("object_type", "path", F.col("kinds").alias("__kinds"), F.col("open").alias("__open"), F.col("required").alias("__required"))
    above = table.select("object_type", F.col("path").alias("parent"), F.col("kinds").alias("__above"), F.col("open").alias("__above_open"))
    must = table.filter("required and parent is not null").groupBy("object_type", F.col("parent").alias("path")).agg(
        F.collect_list(F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "kinds")).alias("__must"))
    own = own.join(F.broadcast(must), ["object_type", "path"], "left").withColumn("__names", F.col("__must.name"))
    rows = rows.join(F.broadcast(own), ["object_type", "path"], "left").join(F.broadcast(above), ["object_type", "parent"], "left")
    kind, none = F.col("kind"), F.lit(None).cast("string")

    def fault(problem: str, at, expected, found):
        return F.struct(F.lit(problem).alias("problem"), at.alias("at"), expected.alias("expected"), found.alias("found"))

    is_wrong = F.col("__kinds").isNotNull() & ~F.array_contains("__kinds", kind) & ~kind.isin("null", "invalid")
    is_empty = F.col("__required") & (kind == "null")
    # below an open object, an unknown field or a value of the wrong kind nothing is unknown any more
    is_unknown = F.col("__kinds").isNull() & F.col("__above").isNotNull() & ~F.col("__above_open") & F.array_contains(
        "__above", F.when(F.col("path").endswith("/[]"), "array").otherwise("object"))
    lacks = (kind == "object") & (F.size(F.array_except("__names", "keys")) > 0)
    # few values have a fault; only theirs are put together
    rows = rows.where(is_wrong | is_empty | is_unknown | (kind == "invalid") | lacks)
    wrong = F.when(is_wrong, fault("wrong type", F.col("at"), F.array_join("__kinds", " or "), kind))
    empty = F.when(is_empty, fault("missing", F.col("at"), F.array_join("__kinds", " or "), kind))
    unknown = F.when(is_unknown, fault("unknown", F.col("at"), none, kind))
    broken = F.when(kind == "invalid", fault("invalid", F.col("at"), F.lit("object"), none))
    absent = F.when(kind == "object", F.transform(
        F.filter("__must", lambda m: ~F.array_contains(F.col("keys"), m["name"])),
        lambda m: F.struct(F.lit("missing").alias("problem"), F.concat(F.col("at"), F.lit("/"), m["name"]).alias("at"),
                           F.array_join(m["kinds"], " or ").alias("expected"), none.alias("found"))))
    found = F.concat(F.filter(F.array(wrong, empty, unknown, broken), lambda f: f.isNotNull()), F.coalesce(absent, F.array()))
    out = rows.select("id", "version_id", "object_type", F.explode(found).alias("f")).select(
        "id", "version_id", "object_type", "f.problem", "f.at", "f.expected", "f.found")
    other = docs.where(F.col("object_type").isNull() | ~F.col("object_type").isin(*known)).select(
        "id", "version_id", "object_type", F.lit("unknown type").alias("problem"), F.lit("").alias("at"), none.alias("expected"), none.alias("found"))
    return out.unionByName(other)


def conformance(objects: DataFrame, type_col: str = "schema_id") -> DataFrame:
    """(id, version_id, object_type, missing_field): required fields absent from a document.

    A document that is not a JSON object has no keys, so all its required fields are reported;
    an unknown object type has no catalog row and is reported as ``<unknown type>``.
    """
    cat = object_catalog(objects.sparkSession).filter("required").groupBy("object_type").agg(
        F.collect_set("parameter").alias("__req"))  # bounded: one small set per type
    keys = F.coalesce(document_keys("document"), F.array().cast("array<string>"))
    docs = objects.select("id", "version_id", F.col(type_col).alias("object_type"), keys.alias("__keys"))
    joined = docs.join(F.broadcast(cat), "object_type", "left")
    missing = F.when(F.col("__req").isNull(), F.array(F.lit("<unknown type>"))).otherwise(
        F.array_except("__req", "__keys"))
    return joined.select("id", "version_id", "object_type", F.explode(missing).alias("missing_field"))
