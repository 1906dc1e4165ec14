"""Typed arrays (SNK-1..9): fixed schemas, projections to them, and one writer.

An array is a DataFrame with a dense ``pos`` column and the role's fields. Arrays of one
role live in one parquet dataset, one folder per array id, rows ordered by ``pos``; the object
document stores only ``{"data": array_id, "length": n}``. One dataset per role replaces many
small files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lithos.operators.position import a_file_a_task, input_partitions

# Field names and types of the typed arrays the object documents refer to.
ARRAY_FIELDS: dict[str, list[tuple[str, str]]] = {
    "lookup": [("key", "int"), ("value", "string")],
    "codes": [("data", "int")],
    "values": [("data", "double")],
    "from_to": [("data1", "double"), ("data2", "double")],
    "coordinates": [("x", "double"), ("y", "double"), ("z", "double")],
    "indices": [("data1", "bigint"), ("data2", "bigint")],
    "path": [("distance", "double"), ("azimuth", "double"), ("dip", "double")],
    "holes": [("hole_index", "int"), ("offset", "bigint"), ("count", "bigint")],
    "distances": [("final", "double"), ("target", "double"), ("current", "double")],
}


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def project_array(df: DataFrame, role: str, sources: list, pos_col: str | None = "pos", keep: tuple = ()) -> DataFrame:
    """PRJ-1: select + rename + cast the source columns to the role's schema."""
    fields = ARRAY_FIELDS[role]
    if len(sources) != len(fields):
        raise ValueError(f"array '{role}' takes {len(fields)} columns, got {len(sources)}")
    cols = [_c(s).cast(t).alias(n) for (n, t), s in zip(fields, sources)]
    if pos_col:
        cols.insert(0, F.col(f"`{pos_col}`").cast("long").alias("pos"))
    return df.select(*[F.col(f"`{k}`") for k in keep], *cols)


def coordinates(df: DataFrame, x, y, z, pos_col: str | None = "pos") -> DataFrame:
    """SNK-5: (x, y, z) float64."""
    return project_array(df, "coordinates", [x, y, z], pos_col)


def from_to(df: DataFrame, a, b, pos_col: str | None = "pos") -> DataFrame:
    """SNK-4: (data1, data2) float64."""
    return project_array(df, "from_to", [a, b], pos_col)


def path(df: DataFrame, depth, azimuth, dip, pos_col: str | None = "pos") -> DataFrame:
    """SNK-7: (distance, azimuth, dip) float64."""
    return project_array(df, "path", [depth, azimuth, dip], pos_col)


def index_pairs(df: DataFrame, start, end, pos_col: str | None = "pos", keep: tuple = ()) -> DataFrame:
    """SNK-6: (data1, data2) as non-negative 64-bit integers, after the columns of ``keep``.

    Spark has no unsigned type: values are ``bigint``. A fractional index becomes NULL here, and
    ``write_array`` refuses NULL and negative ones.
    """
    def whole(c) -> Column:
        v = _c(c)
        return F.when(v.cast("double") == F.floor(v.cast("double")), v.cast("long"))

    return project_array(df, "indices", [whole(start), whole(end)], pos_col, keep)


def _bad_pair() -> Column:
    return F.col("data1").isNull() | F.col("data2").isNull() | (F.col("data1") < 0) | (F.col("data2") < 0)


def _checked(array_id: Column) -> Column:
    """``data1``; a bad pair ends the write."""
    text = F.concat(F.lit("index array "), array_id, F.lit(": an end is missing, fractional or negative"))
    return F.when(_bad_pair(), F.raise_error(text).cast("long")).otherwise(F.col("data1"))


def check_index_pairs(pairs: DataFrame) -> DataFrame:
    """Rows of an index array that are not valid unsigned integers (should be empty)."""
    return pairs.filter(_bad_pair())


_MANIFEST = "request string, array_id string, role string, length bigint"


def _manifest(base_path: str) -> str:
    return f"{base_path.rstrip('/')}/manifest"


def record_arrays(spark, base_path: str, request: str, arrays: list[tuple[str, str, int]]) -> None:
    """Make the arrays of a finished write visible: one manifest row each (array id, role, length), in one file that is
    there as a whole or not at all."""
    rows = [(request, *a) for a in arrays]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(_manifest(base_path))


def stored_arrays(spark, base_path: str) -> DataFrame:
    """(request, array_id, role, length) of the arrays whose write was finished; others are not listed."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_MANIFEST).parquet(_manifest(base_path)).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def ranges_path(target: str) -> str:
    """Where the ranges of a table that ``write_ranged`` wrote are kept."""
    head, _, name = target.rstrip("/").rpartition("/")
    return f"{head}/ranges/{name}"


def write_ranged(arrays: DataFrame, target: str, role: str) -> str:
    """Write many arrays of one role, (array_id, pos, fields), as one table whose files are cut on ranges of
    (array, position), so that a hot array is many files and small arrays share one. The first and last row of every
    file are kept beside the table: a reader of rows [a, b) of an array opens the files that hold them."""
    write_rows(arrays, target, role, "errorifexists")
    write_ranges(arrays, target)
    return target


def write_rows(arrays: DataFrame, target: str, role: str, mode: str, ordered: bool = False) -> None:
    """The rows of ``write_ranged``; ``write_ranges`` follows when all are there. ``ordered``: they are in tasks by
    ranges of ``array_id`` already, or in files of one range each, and in order there; they are not dealt anew."""
    if role == "indices":
        arrays = arrays.withColumn("data1", _checked(F.col("array_id")))
    if ordered:
        with a_file_a_task(arrays.sparkSession):
            arrays.write.mode(mode).parquet(target)
        return
    many = input_partitions(arrays)
    dealt = arrays.repartitionByRange(*([many] if many else []), "array_id", "pos")
    dealt.sortWithinPartitions("array_id", "pos").write.mode(mode).parquet(target)


def write_ranges(arrays: DataFrame, target: str) -> None:
    """Keep (file, first, last, rows) of the table's files. Their rows are in order: the first and last are found by
    number, so that no text is compared."""
    written = arrays.sparkSession.read.schema(arrays.schema).parquet(target).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.struct("array_id", "pos").alias("key"))
    ends = written.groupBy("file").agg(F.max("row").alias("end"))
    edges = written.join(F.broadcast(ends), "file").filter((F.col("row") == 0) | (F.col("row") == F.col("end")))  # a row a file
    edges.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), (F.max("end") + 1).alias("rows")).write.mode(
        "errorifexists").parquet(ranges_path(target))


def range_files(spark, target: str, array_id: str, start: int, end: int) -> list[str]:
    """Files of the table that may hold rows [start, end) of the array: those of the slice, found in the ranges."""
    def at(pos: int) -> Column:
        return F.struct(F.lit(array_id).alias("array_id"), F.lit(pos).cast("long").alias("pos"))

    rows = spark.read.parquet(ranges_path(target)).where((F.col("last") >= at(start)) & (F.col("first") < at(end)))
    return [f"{target.rstrip('/')}/{r['file']}" for r in rows.select("file").collect()]


def read_range(spark, target: str, role: str, array_id: str, start: int, end: int) -> DataFrame:
    """Rows [start, end) of one array, in the role's fields: only the files that hold them are listed and opened, and
    the filters on array and position reach their row groups."""
    if end <= start:
        raise ValueError("a range ends after it starts")
    fields = ARRAY_FIELDS[role]
    schema = ", ".join(["array_id string", "pos bigint", *[f"`{n}` {t}" for n, t in fields]])
    files = range_files(spark, target, array_id, start, end)
    if not files:
        return spark.createDataFrame([], schema).drop("array_id")
    rows = spark.read.schema(schema).parquet(*files)
    return rows.where((F.col("array_id") == array_id) & (F.col("pos") >= start) & (F.col("pos") < end)).drop("array_id")


def new_array_id(role: str) -> str:
    return f"{role}-{uuid.uuid4().hex}"


def write_array(df: DataFrame, base_path: str, role: str, array_id: str | None = None, mode: str = "errorifexists") -> dict:
    """Write one array and return its reference ``{data, length}``.

    Rows are sorted inside each file by the array's order: position, a hole index by offset then hole
    (ORD-3; the order among empty holes is otherwise undefined), a lookup by key. Positions are values of
    the array, so no shuffle puts the files themselves in order. The length is counted by the write. An
    index array with a missing, fractional or negative end fails the write.
    """
    array_id = array_id or new_array_id(role)
    target = f"{base_path.rstrip('/')}/{role}/{array_id}"
    cols = ["pos"] + [n for n, _ in ARRAY_FIELDS[role]] if "pos" in df.columns else [n for n, _ in ARRAY_FIELDS[role]]
    out = df.select(*cols)
    if role == "indices":
        out = out.withColumn("data1", _checked(F.lit(array_id)))
    order = ["pos"] if "pos" in out.columns else {"holes": ["offset", "hole_index"], "lookup": ["key"]}.get(role)
    if order:
        out = out.sortWithinPartitions(*order)
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(target)
    return {"data": array_id, "length": seen.get["n"], "path": target}
