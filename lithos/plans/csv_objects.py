"""CSV files to objects (OBJ-1..4 from paths): file status, typed scan, file order, gate, builder.

Every function takes paths and column names and returns a :class:`BuiltObject`. A file that is missing,
unreadable or has rows that do not fit its header gives the status ``error``; interval files are reported one
by one without stopping the others, as errors of the gate. Row i of a file is row i of the object. Id columns
are read as text, so ``001`` and ``1`` are two holes and a blank id does not change the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from lithos.plans.builders import (
    BuiltObject, IntervalConfig, _failed, build_downhole_collection, build_downhole_intervals, build_line_segments,
    build_pointset,
)
from lithos.sources.csv_scan import CsvParseError, read_typed_csv, source_status


@dataclass(frozen=True)
class IntervalFile:
    """One interval collection given as a file (SRC-3)."""

    file: str
    name: str
    id_column: str
    from_column: str
    to_column: str
    attribute_columns: Sequence[str] | None = None


class SourceError(Exception):
    """A file that cannot be used, and why."""


def load(spark: SparkSession, path: str, what: str, text_columns: Sequence[str] = (),
         multi_line: bool = False, ordered: bool = True) -> tuple[DataFrame, str]:
    """(typed rows, name of the added file-order column, left out unless ``ordered``); SourceError if there are none to
    be had."""
    status = source_status(spark, path)
    if status.status != "ok":
        raise SourceError(f"{what}: {status.error}")
    try:
        names = spark.read.option("header", True).csv(path).columns
        pos = next(p for p in ("row", *(f"row_{i}" for i in range(len(names) + 1))) if p not in names)
        return read_typed_csv(spark, path, with_position=ordered, pos_name=pos, text_columns=text_columns, multi_line=multi_line), pos
    except (CsvParseError, PySparkException) as e:
        raise SourceError(f"{what}: {e}") from e


def _error(spark: SparkSession, object_type: str, e: SourceError) -> BuiltObject:
    return _failed(object_type, [str(e)], [], spark, status="error")


def pointset_from_csv(spark: SparkSession, path: str, x: str, y: str, z: str, **options) -> BuiltObject:
    """OBJ-1 from a file; ``options`` as for ``build_pointset``."""
    try:
        df, pos = load(spark, path, "points")
    except SourceError as e:
        return _error(spark, "pointset", e)
    return build_pointset(df, x, y, z, pos_col=pos, check_pos=False, **options)


def line_segments_from_csv(spark: SparkSession, vertices: str, segments: str, x: str, y: str, z: str, start: str,
                           end: str, **options) -> BuiltObject:
    """OBJ-2 from two files; row i of the vertices is vertex i."""
    try:
        v, vpos = load(spark, vertices, "vertices")
        s, spos = load(spark, segments, "segments")
    except SourceError as e:
        return _error(spark, "line-segments", e)
    return build_line_segments(v, s, x, y, z, start, end, vertex_pos=vpos, segment_pos=spos, check_pos=False, **options)


def downhole_collection_from_csv(spark: SparkSession, collar: str, survey: str, intervals: Sequence[IntervalFile],
                                 collar_id: str, survey_id: str, x: str, y: str, z: str, depth: str, azimuth: str,
                                 dip: str, **options) -> BuiltObject:
    """OBJ-3 from a collar file, a survey file and any number of interval files."""
    try:
        c, cpos = load(spark, collar, "collars", [collar_id])
        s, spos = load(spark, survey, "survey", [survey_id])
    except SourceError as e:
        return _error(spark, "downhole-collection", e)
    configs, errors = [], []
    for i, f in enumerate(intervals):
        name = f.name or f"collection_{i}"
        try:
            df, pos = load(spark, f.file, f"intervals '{name}'", [f.id_column])
            configs.append(IntervalConfig(name, df, f.id_column, f.from_column, f.to_column, f.attribute_columns, pos_col=pos))
        except SourceError as e:
            errors.append(str(e))
    return build_downhole_collection(c, s, collar_id, survey_id, x, y, z, depth, azimuth, dip, collections=configs,
                                     collar_pos=cpos, survey_pos=spos, extra_errors=errors, **options)


def downhole_intervals_from_csv(spark: SparkSession, path: str, hole_id: str, from_col: str, to_col: str,
                                start: Sequence[str], end: Sequence[str], mid: Sequence[str], **options) -> BuiltObject:
    """OBJ-4 from a file."""
    try:
        df, pos = load(spark, path, "intervals", [hole_id])
    except SourceError as e:
        return _error(spark, "downhole-intervals", e)
    return build_downhole_intervals(df, hole_id, from_col, to_col, start, end, mid, pos_col=pos, check_pos=False, **options)
