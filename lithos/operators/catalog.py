"""Catalog relations over many versioned object documents (FLT-5..9, ORD-4, AGG-7/9/10,
SET-3, SCL-6, JN-6, CAT-1..6).

Inputs are three DataFrames:

* ``workspaces``: id, name, description, user_role, created_at, updated_at, created_by,
  default_coordinate_system, labels, deleted
* ``objects`` (one row per object version): workspace_id, id, name, path, schema_id,
  version_id, created_at, created_by, deleted, document (JSON text)
* ``references`` (one row per data reference of a version): workspace_id, id, version_id,
  ordinal, blob_id. It is flat at every size, so that no version gathers its references in one
  value. Where a function is given none, the references are extracted from the documents.
* ``blobs``: workspace_id, blob_id, length

An object whose current version is flagged deleted is gone: listings, summaries, snapshots and
copies leave it out unless they are asked for deleted objects.

Where the original lists everything and loops over objects with one request each, these are
filters (pushed to the scan), one aggregate for the latest version, and joins.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.jsondoc import nesting
from lithos.functions.refs import data_references
from lithos.functions.timefmt import iso_timestamp
from lithos.operators.documents import nodes
from lithos.operators.position import materialize

OBJECT_META = ("workspace_id", "id", "name", "path", "schema_id", "version_id", "created_at")


def current_versions(objects: DataFrame) -> DataFrame:
    """ORD-4: the latest version of every object (created_at, then version_id, descending).

    The latest key per object is a max over a narrow struct (partial aggregation map-side, so
    an object with a third of all versions is combined before the shuffle); the version rows
    are then kept by a semi join on (workspace, id, version). That key is unique per version,
    so the join spreads a hot object's versions over many tasks, and columns the caller does
    not use (the document) are pruned from the scan instead of travelling through a sort.
    """
    latest = objects.groupBy("workspace_id", "id").agg(
        F.max(F.struct("created_at", "version_id")).alias("__v")).select(
        "workspace_id", "id", F.col("__v.version_id").alias("version_id"))
    return objects.join(latest, ["workspace_id", "id", "version_id"], "left_semi")


def object_listing(objects: DataFrame) -> DataFrame:
    """The listing projection (ids, names, paths, schema, version, ISO time)."""
    return objects.select("id", "name", "path", "schema_id", "version_id", iso_timestamp("created_at").alias("created_at"))


def list_workspaces(workspaces: DataFrame, name: str = "", deleted: bool = False, limit: int = 50) -> DataFrame:
    """FLT-5 + LIM-2: name filter, deleted flag, explicit order, limit."""
    df = workspaces.filter(F.col("deleted") == F.lit(deleted))
    if name:
        df = df.filter(F.col("name") == F.lit(name))
    return df.orderBy("name", "id").limit(limit).select(
        "id", "name", "description", "user_role",
        iso_timestamp("created_at").alias("created_at"), iso_timestamp("updated_at").alias("updated_at"))


def get_workspace(workspaces: DataFrame, workspace_id: str = "", workspace_name: str = "") -> DataFrame:
    """FLT-7: one workspace by id, else the first (by creation time) with exactly that name."""
    if workspace_id:
        df = workspaces.filter(F.col("id") == F.lit(workspace_id))
    elif workspace_name:
        df = workspaces.filter(F.col("name") == F.lit(workspace_name)).orderBy("created_at", "id").limit(1)
    else:
        raise ValueError("get_workspace needs an id or a name")
    return df.select(
        "id", "name", "description", "user_role", iso_timestamp("created_at").alias("created_at"),
        iso_timestamp("updated_at").alias("updated_at"), "created_by", "default_coordinate_system", "labels")


def list_objects(objects: DataFrame, workspace_id: str, schema_id: str = "", deleted: bool = False,
                 limit: int = 100) -> DataFrame:
    """FLT-6 + LIM-2 on current versions. The schema filter is honoured (the original accepts
    and ignores it; deviation)."""
    cur = current_versions(objects.filter(F.col("workspace_id") == F.lit(workspace_id)))
    if schema_id:
        cur = cur.filter(F.col("schema_id") == F.lit(schema_id))
    cur = cur.filter(F.col("deleted") == F.lit(deleted))
    return object_listing(cur.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit))


def _in(objects: DataFrame, workspace_id) -> DataFrame:
    """Objects of one workspace, given as text or as a column (e.g. a scalar subquery)."""
    return objects.filter(F.col("workspace_id") == (F.lit(workspace_id) if isinstance(workspace_id, str) else workspace_id))


def _one(objects: DataFrame, workspace_id, object_id: str, object_path) -> DataFrame:
    """Versions of the object with this id, else with exactly this path."""
    df = _in(objects, workspace_id)
    if object_id:
        return df.filter(F.col("id") == F.lit(object_id))
    if isinstance(object_path, str) and not object_path:
        raise ValueError("an object is looked up by its id or its path; both are empty")
    return df.filter(F.col("path") == (F.lit(object_path) if isinstance(object_path, str) else object_path))


def _alive(current: DataFrame, include_deleted: bool) -> DataFrame:
    return current if include_deleted else current.filter(~F.col("deleted"))


def _pin(objects: DataFrame, version) -> DataFrame:
    """FLT-9: a version id (text or column) pins that version; empty or None means the latest."""
    if isinstance(version, str) or version is None:
        if not version:
            return current_versions(objects)
        version = F.lit(version)
    return objects.filter(F.col("version_id") == version)


def get_object(objects: DataFrame, workspace_id, object_id: str = "", object_path="",
               version="") -> DataFrame:
    """FLT-7: by id, else by exact path; an empty result means not found."""
    df = _one(objects, workspace_id, object_id, object_path)
    return object_listing(_pin(df, version))


def object_content(objects: DataFrame, workspace_id, object_id: str = "", object_path="",
                   version: str = "") -> DataFrame:
    """SRC-5: metadata + the document (JSON text), optional version pin."""
    df = _one(objects, workspace_id, object_id, object_path)
    return _pin(df, version).select("id", "name", "path", "schema_id", "version_id", "document")


def object_versions(objects: DataFrame, workspace_id, object_id: str = "", object_path="") -> DataFrame:
    """CAT-5: version history, newest first."""
    df = _one(objects, workspace_id, object_id, object_path)
    return df.select("version_id", iso_timestamp("created_at").alias("created_at"), "created_by").orderBy(
        F.col("created_at").desc(), F.col("version_id").desc())


#: Names in one IN predicate; a longer list is joined.
SHORT_LIST = 200


def _matching(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose ``column`` is one of ``wanted``: names, or a DataFrame with one column of them."""
    if isinstance(wanted, DataFrame):
        names = wanted.select(F.col(f"`{wanted.columns[0]}`").cast("string").alias(column))
    elif not wanted:
        return df
    elif len(wanted) <= SHORT_LIST:
        return df.filter(F.col(column).isin(*wanted))
    else:
        names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} string")
    # Every text is >= ''; the comparison marks the list as the thinning side, for which Spark puts a Bloom filter of its
    # names (of bounded size) on a large scan, so that few rows reach the join's shuffle.
    return df.join(names.filter(F.col(column) >= ""), column, "left_semi")


def filter_objects(objects: DataFrame, schema_filter: Sequence[str] | DataFrame = (),
                   name_filter: Sequence[str] | DataFrame = ()) -> DataFrame:
    """FLT-8: list filters; an empty list means no filter, an empty DataFrame matches nothing. Short lists become ``In``
    predicates pushed to the scan; a longer one, or a DataFrame of any size, is a semi join."""
    return _matching(_matching(objects, "schema_id", schema_filter), "name", name_filter)


def workspace_summary(objects: DataFrame, include_deleted: bool = False) -> DataFrame:
    """AGG-7 / CAT-1: current objects per workspace and schema, plus a total row per
    workspace (schema_id NULL) from the same rollup."""
    cur = _alive(current_versions(objects), include_deleted)
    return cur.rollup("workspace_id", "schema_id").agg(F.count(F.lit(1)).alias("objects")).filter(
        F.col("workspace_id").isNotNull())


_VERSION = ("workspace_id", "id", "version_id")


def document_references(objects: DataFrame) -> DataFrame:
    """SCL-6: the flat reference rows of documents, document order, repeats kept.

    Documents whose objects repeat no key are read in sequence. One that does is no VARIANT (which takes a key once),
    and is descended level by level, as deep as the deepest of them; there the last value of a key counts, with all
    that lies in it, at the place of the first. A text that is no JSON has no references."""
    docs = objects.select(*_VERSION, "document").filter(F.col("document").isNotNull())
    if str(objects.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys", "false")).lower() == "true":
        plain, rest = docs.limit(0), docs  # a session in which a VARIANT does not tell
    else:
        whole = F.try_parse_json("document").isNotNull()
        plain, rest = docs.filter(whole), docs.filter(~whole)
    out = plain.select(*_VERSION, F.posexplode(data_references("document")).alias("ordinal", "blob_id"))
    depth = rest.agg(F.max(nesting("document"))).first()[0]
    if not depth:
        return out
    # few documents with much work each: dealt to tasks by version, not by bytes
    rest = rest.repartition(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_VERSION)
    found = nodes(rest, depth, _VERSION, key="data").filter(F.col("kind") == "string")
    # the references of one document, whose text is one value
    place = F.row_number().over(Window.partitionBy(*_VERSION).orderBy("ord")) - 1
    return out.unionByName(found.select(*_VERSION, place.alias("ordinal"), F.substring("text", F.lit(2), F.length("text")).alias("blob_id")))


def object_references(objects: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """SCL-6 / CAT-6: (workspace_id, id, version_id, ordinal, blob_id) of the given versions."""
    if references is None:
        return document_references(objects)
    return references.join(objects.select(*_VERSION), list(_VERSION), "left_semi").select(*_VERSION, "ordinal", "blob_id")


def default_snapshot_name(now: _dt.datetime | None = None) -> tuple[str, str]:
    """SCL-2: (``snapshot_<utc iso>``, the iso time) for a snapshot without a name."""
    ts = (now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)).isoformat()
    return f"snapshot_{ts}", ts


def workspace_snapshot(objects: DataFrame, workspaces: DataFrame, workspace_id: str, snapshot_name: str = "",
                       snapshot_time: str | None = None, include_data_blobs: bool = False,
                       references: DataFrame | None = None, include_deleted: bool = False) -> DataFrame:
    """AGG-10 / CAT-2: the flat snapshot table, one row per current object.

    ``snapshot_time`` is an ISO text fixed once by the caller (default: now, UTC), and an empty
    name defaults to ``snapshot_<time>``. With ``include_data_blobs`` each row carries the
    number of references of its document (``n_blobs``, 0 when none); the references
    themselves are the flat :func:`snapshot_references` table, never one array per object.
    """
    if not snapshot_name or snapshot_time is None:
        default_name, now = default_snapshot_name()
        snapshot_time = snapshot_time or now
        snapshot_name = snapshot_name or default_name
    cur = _alive(current_versions(_in(objects, workspace_id)), include_deleted)
    ws = workspaces.filter(F.col("id") == F.lit(workspace_id)).select(
        F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"),
        F.col("description").alias("workspace_description"))
    rows = cur.join(F.broadcast(ws.limit(1)), "workspace_id", "left")  # one workspace row
    cols = [
        F.lit(snapshot_name).alias("snapshot_name"), F.lit(snapshot_time).alias("snapshot_timestamp"),
        "workspace_id", "workspace_name", "workspace_description",
        F.col("id").alias("object_id"), "name", "path", "schema_id", "version_id",
        iso_timestamp("created_at").alias("created_at"),
    ]
    if include_data_blobs:
        counts = object_references(cur, references).groupBy(*_VERSION).agg(F.count(F.lit(1)).cast("int").alias("n_blobs"))
        rows = rows.join(counts, list(_VERSION), "left")
        cols.append(F.coalesce(F.col("n_blobs"), F.lit(0)).alias("n_blobs"))
    return rows.select(*cols)


def snapshot_references(objects: DataFrame, workspace_id: str, snapshot_name: str, references: DataFrame | None = None,
                        include_deleted: bool = False) -> DataFrame:
    """The data blobs of a snapshot as a flat table: (snapshot_name, object_id, version_id,
    ordinal, blob_id)."""
    cur = _alive(current_versions(_in(objects, workspace_id)), include_deleted)
    return object_references(cur, references).select(F.lit(snapshot_name).alias("snapshot_name"),
                                                     F.col("id").alias("object_id"), "version_id", "ordinal", "blob_id")


def write_snapshot(snapshot: DataFrame, snapshots_path: str) -> None:
    """CAT-2: store a snapshot in the ``snapshots`` table, one folder per snapshot name.
    Writing the same name again replaces that snapshot only (dynamic partition overwrite)."""
    (snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_name").parquet(snapshots_path))


def checked_references(objects: DataFrame, blobs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """JN-6: every reference of the given versions with the ``length`` of its blob in the version's own
    workspace, NULL where that workspace does not hold it. Written once; all that follows reads it."""
    store = blobs.groupBy("workspace_id", "blob_id").agg(F.max("length").alias("length"), F.lit(True).alias("held"))
    return materialize(object_references(objects, references).join(store, ["workspace_id", "blob_id"], "left"))


def object_blobs(objects: DataFrame, blobs: DataFrame, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JN-6: (matched references, objects with a reference their workspace's blob store lacks)."""
    checked = checked_references(objects, blobs, references)
    return (checked.filter("held").drop("held"),
            checked.filter("held is null").select(*_VERSION).distinct())


def _copied(src: DataFrame, blobs: DataFrame, references: DataFrame | None, target_workspace_id: str,
            repeats: bool) -> dict[str, DataFrame]:
    """Copy the versions ``src`` with their blobs. One pass over the references decides what fails."""
    checked = checked_references(src, blobs, references)
    # per version: its references, and whether one of them has no blob
    state = checked.groupBy(*_VERSION).agg(F.max(F.col("held").isNull()).alias("lacks"), F.count(F.lit(1)).alias("n"))
    marked = src.join(state, list(_VERSION), "left").withColumn("failed", F.coalesce("lacks", F.lit(False)))
    whole = checked.join(state.filter("not lacks"), list(_VERSION), "left_semi")
    stored = whole.groupBy("blob_id").agg(F.max("length").alias("length"))
    target = blobs.filter(F.col("workspace_id") == F.lit(target_workspace_id)).select("blob_id")
    new_blobs = stored.join(target, "blob_id", "left_anti").select(
        F.lit(target_workspace_id).alias("workspace_id"), "blob_id", "length")
    new_objects = marked.filter(~F.col("failed")).select(
        F.lit(target_workspace_id).alias("workspace_id"), F.lit(None).cast("string").alias("uuid"),
        F.col("id").alias("source_id"), "name", "path", "schema_id", F.col("version_id").alias("source_version_id"), "document")
    blobs_copied = (state.filter("not lacks").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")) if repeats
                    else stored.agg(F.count(F.lit(1))))
    counts = marked.agg(F.count_if(~F.col("failed")).alias("objects_copied"), F.count_if("failed").alias("objects_failed")).select(
        "objects_copied", "objects_failed", blobs_copied.scalar().alias("data_blobs_copied"))
    return {"new_objects": new_objects, "new_blobs": new_blobs, "counts": counts,
            "new_references": whole.select(F.col("id").alias("source_id"), F.col("version_id").alias("source_version_id"),
                                           "ordinal", "blob_id")}


def duplicate_workspace(objects: DataFrame, blobs: DataFrame, source_workspace_id: str, target_workspace_id: str,
                        schema_filter: Sequence[str] = (), name_filter: Sequence[str] = (),
                        references: DataFrame | None = None, include_deleted: bool = False) -> dict[str, DataFrame]:
    """CAT-4: copy the current version of every selected object with its blobs.

    * objects with a reference missing from the source workspace's blob store fail and are skipped (counted);
    * blobs are copied once (distinct over all copied objects) and only when the target does
      not hold them yet (anti join);
    * new object rows keep path, name, schema and document, get the target workspace id and a
      NULL uuid; their ids are assigned by the store on append.

    Returns ``new_objects``, ``new_references``, ``new_blobs``, ``counts`` (one row).
    """
    cur = _alive(current_versions(_in(objects, source_workspace_id)), include_deleted)
    return _copied(filter_objects(cur, schema_filter, name_filter), blobs, references, target_workspace_id, repeats=False)


def copy_object(objects: DataFrame, blobs: DataFrame, source_workspace_id, target_workspace_id: str,
                object_id: str, version: str = "", references: DataFrame | None = None) -> dict[str, DataFrame]:
    """CAT-3: copy one object (a version pin, else the latest) with its blobs.

    An object with a reference whose blob the source workspace does not hold is not copied. Unlike the
    workspace duplicate, ``data_blobs_copied`` counts the copied references with repeats. Returns the same
    four DataFrames.
    """
    src = _pin(_in(objects, source_workspace_id).filter(F.col("id") == F.lit(object_id)), version)
    return _copied(src, blobs, references, target_workspace_id, repeats=True)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose ``keys`` the stored table lacks; the rows appended are returned. The table is partitioned
    by workspace, and only the partitions the rows belong to are looked at. The new rows are fixed in the checkpoint
    folder before the table is touched, so a second run, or a retry after a failure, adds nothing twice; one of rows with
    equal keys is kept."""
    rows = rows.dropDuplicates(list(keys))
    stored = stored_table(rows.sparkSession, path, rows.schema)
    if stored is not None:
        wanted = rows.select("workspace_id").distinct()
        held = stored.join(wanted, "workspace_id", "left_semi").select(*keys)
        rows = rows.join(held, list(keys), "left_anti")
    rows = materialize(rows)
    rows.write.mode("append").partitionBy("workspace_id").parquet(path)
    return rows


def stored_table(spark, path: str, schema) -> DataFrame | None:
    """A table written by ``append_new``; None where there is none yet. Its types are given, as those of partition
    folders would be guessed."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema  # noqa: B018 - listing only
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return spark.read.schema(schema).parquet(path)


def object_key(*parts: Column) -> Column:
    """An object's id from what names it: the same parts give the same id, in any run."""
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)


def append_objects(new_objects: DataFrame, objects_path: str, created_by: str = "lithos") -> DataFrame:
    """SNK-10: append object versions to the stored ``objects`` table; safe to repeat.

    An object is named by its workspace and path, which give its id; a version by the SHA-256 of its document. What
    the table holds already is not appended again, so a retry leaves one object, and another document at the same path
    is a further version of it. ``uuid`` inside the document stays unset (the store assigns identity). The table is
    partitioned by workspace, so listings prune to one folder. Returns the metadata rows of all given versions (id,
    name, path, version_id, created_at), whether appended now or before.
    """
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = new_objects.select(
        "workspace_id", object_key(F.col("workspace_id"), F.col("path")).alias("id"), "name", "path", "schema_id",
        F.sha2("document", 256).alias("version_id"), F.lit(now).alias("created_at"),
        F.lit(created_by).alias("created_by"), F.lit(False).alias("deleted"), "document")
    append_new(rows, objects_path, _VERSION)
    stored = stored_table(rows.sparkSession, objects_path, rows.schema)
    return stored.join(rows.select(*_VERSION).distinct(), list(_VERSION), "left_semi").select(
        "workspace_id", "id", "name", "path", "version_id", iso_timestamp("created_at").alias("created_at"))


def store_copies(copied: dict[str, DataFrame], base_path: str, source_workspace_id, created_at: _dt.datetime,
                 created_by: str = "lithos") -> dict[str, DataFrame]:
    """CAT-3/CAT-4: put what ``copy_object`` or ``duplicate_workspace`` found into the target's stored tables.

    A copy's id is derived from (source workspace, source id, target workspace), its version from the source version,
    so every run names it alike. References are given the copy's id through the map from source to target. Blobs are
    written first, then references, then the objects, each without what its table holds: an object is listed only when
    all it refers to is there, and a second run adds nothing. Returns the rows added: objects, references, blobs."""
    base = base_path.rstrip("/")
    src = F.lit(source_workspace_id) if isinstance(source_workspace_id, str) else source_workspace_id
    rows = copied["new_objects"]
    target = object_key(src, F.col("source_id"), F.col("workspace_id"))
    version = F.substring(F.sha2(F.to_json(F.array(target, F.col("source_version_id"))), 256), 1, 32)
    ids = materialize(rows.select("workspace_id", "source_id", "source_version_id", target.alias("id"), version.alias("version_id")))
    blobs = append_new(copied["new_blobs"], f"{base}/blobs", ["workspace_id", "blob_id"])
    references = append_new(copied["new_references"].join(ids, ["source_id", "source_version_id"]).select(
        *_VERSION, "ordinal", "blob_id"), f"{base}/references", [*_VERSION, "ordinal"])
    objects = append_new(rows.join(ids, ["workspace_id", "source_id", "source_version_id"]).select(
        "workspace_id", "id", "name", "path", "schema_id", "version_id", F.lit(created_at).alias("created_at"),
        F.lit(created_by).alias("created_by"), F.lit(False).alias("deleted"), "document"), f"{base}/objects", _VERSION)
    return {"objects": objects, "references": references, "blobs": blobs}
