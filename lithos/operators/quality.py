"""Quality gate: required columns, valid coordinates, bounding box, ids, index ranges.

Driver-side checks touch only the schema (column names). Everything that reads rows is one
aggregate per table (grouped by object when many objects are gated at once); the result is
a small DataFrame, so nothing but the final one-row report is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from lithos.functions.numeric import coerce_double, is_finite, not_missing

AXES = ("x", "y", "z")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """PRJ-2/3: names in ``required`` that the schema lacks (schema only, no job)."""
    have = set(df.columns)
    return [c for c in required if c and c not in have]


def numeric(df: DataFrame, column: str) -> Column:
    """A coordinate as double, by its type in the schema: text that is no number is missing."""
    return coerce_double(F.col(f"`{column}`"), df.schema[column].dataType)


def not_numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose type is no number (schema only, no job)."""
    return [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]


def valid_mask(df: DataFrame, x: str, y: str, z: str) -> Column:
    return not_missing(numeric(df, x)) & not_missing(numeric(df, y)) & not_missing(numeric(df, z))


def valid_points(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """FLT-1: rows whose three coordinates are present (NaN counts as missing)."""
    return df.filter(valid_mask(df, x, y, z))


def coordinate_summary(df: DataFrame, x: str, y: str, z: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG-1/2 + FLT-2 in one aggregate: rows, rows with a missing coordinate, valid rows,
    min/max per axis over valid rows, and whether all six bounds are finite."""
    valid = valid_mask(df, x, y, z)
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~valid).alias("missing_rows"),
        F.count_if(valid).alias("valid_rows"),
    ]
    for axis, c in zip(AXES, (x, y, z)):
        vc = F.when(valid, numeric(df, c))
        aggs += [F.min(vc).alias(f"min_{axis}"), F.max(vc).alias(f"max_{axis}")]
    out = df.groupBy(*group_cols).agg(*aggs)
    finite = F.lit(True)
    for axis in AXES:
        finite = finite & is_finite(f"min_{axis}") & is_finite(f"max_{axis}")
    return out.withColumn("finite", finite & (F.col("valid_rows") > 0))


def bounding_box(df: DataFrame, x: str, y: str, z: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG-1: 3D box over valid rows (one row, or one per group)."""
    s = coordinate_summary(df, x, y, z, group_cols)
    return s.select(*group_cols, *[f"{b}_{a}" for a in AXES for b in ("min", "max")], "valid_rows", "finite")


def gate_status(summary: DataFrame, what: str = "rows") -> DataFrame:
    """Status, errors and warnings of a coordinate gate as columns (OBJ-5/9).

    Deviation (documented): the finite test applies in the dry run too, not only in the build.
    """
    errors = F.filter(
        F.array(
            F.when(F.col("rows") == 0, F.lit(f"the input has no {what}")),
            F.when((F.col("rows") > 0) & (F.col("valid_rows") == 0), F.lit(f"none of the {what} has all three coordinates")),
            F.when((F.col("valid_rows") > 0) & ~F.col("finite"), F.lit("the bounding box is not finite")),
        ),
        lambda m: m.isNotNull(),
    )
    warnings = F.filter(
        F.array(
            F.when(F.col("missing_rows") > 0,
                   F.concat(F.col("missing_rows").cast("string"), F.lit(f" {what} lack a coordinate"))),
        ),
        lambda m: m.isNotNull(),
    )
    return (
        summary.withColumn("errors", errors)
        .withColumn("warnings", warnings)
        .withColumn("status", F.when(F.size("errors") > 0, F.lit("validation_failed")).otherwise(F.lit("validation_passed")))
    )


def unique_count(df: DataFrame, id_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG-3: rows and exact distinct non-null ids."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(id_col)).alias("unique_ids")
    )


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """AGG-4: ids that occur more than once, with their count (partial aggregation first)."""
    return (
        df.groupBy(F.col(id_col).alias("id"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def segment_index_check(vertices: DataFrame, segments: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """FLT-3: segment ends must be whole numbers in [0, vertices).

    The upper-bound test of the original (max against the vertex count) is kept for parity
    (``max_start``/``max_end``); negative, NULL and fractional ends are also rejected, where
    the original wraps -1 to 2^64-1, fails late on NULL and truncates 1.5 (deviation).
    The vertex count enters as a scalar subquery, evaluated once.
    """
    n = vertices.select(F.count(F.lit(1))).scalar()

    def bad(c: str) -> Column:
        v = F.col(f"`{c}`").cast("double")
        return v.isNull() | F.isnan(v) | (v < 0) | (v >= n) | (v != F.floor(v))

    out = segments.agg(
        F.count(F.lit(1)).alias("segments"),
        F.max(F.col(f"`{start_col}`")).cast("double").alias("max_start"),
        F.max(F.col(f"`{end_col}`")).cast("double").alias("max_end"),
        F.count_if(bad(start_col)).alias("bad_start"),
        F.count_if(bad(end_col)).alias("bad_end"),
    )
    out = out.select(n.alias("vertices"), "*")
    return out.withColumn(
        "status",
        F.when((F.col("bad_start") + F.col("bad_end")) > 0, F.lit("validation_failed")).otherwise(F.lit("validation_passed")),
    )


def dangling_segment_ends(vertices_pos: DataFrame, segments: DataFrame, start_col: str, end_col: str,
                          pos_col: str = "pos") -> DataFrame:
    """JN-5: segment ends that name no vertex, by anti join against the vertex positions.
    Used when vertex positions are not known to be dense."""
    ends = segments.select(
        F.explode(F.array(
            F.struct(F.lit("start").alias("end"), F.col(f"`{start_col}`").cast("double").alias("idx")),
            F.struct(F.lit("end").alias("end"), F.col(f"`{end_col}`").cast("double").alias("idx")),
        )).alias("e")
    ).select("e.*")
    # whole numbers are matched as such; what is none (or missing) names no vertex
    whole = F.when(F.col("idx") == F.floor("idx"), F.floor("idx"))
    known = vertices_pos.select(F.col(pos_col).cast("long").alias("__idx"))
    return ends.withColumn("__idx", whole).join(known, "__idx", "left_anti").drop("__idx")


def position_problems(df: DataFrame, pos_col: str) -> DataFrame:
    """One row with ``errors``: why a given position column does not number the rows 0, 1, 2, ..."""
    p = F.col(f"`{pos_col}`").cast("double")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi"),
                 F.count_distinct(p).alias("u"), F.count_if(p != F.floor(p)).alias("fractions"))
    good = (F.col("n") == 0) | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("u") == F.col("n"))
                                & (F.col("fractions") == 0))
    return out.select(F.when(F.coalesce(good, F.lit(False)), F.array().cast("array<string>")).otherwise(
        F.array(F.lit(f"'{pos_col}' does not number the rows from 0 without gaps or repeats"))).alias("errors"))
