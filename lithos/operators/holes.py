"""Drillhole indexes: hole lookup, collar keys, max depth, distances, run indexes.

Hole ids are text everywhere (N9: an int id never equals its text in the original's
dictionary lookups, and Spark would coerce ``1 = '1'``). NULL ids become ``''``, a hole of its
own, so no NULL key reaches a join (N7).

The index of a collection (SEQ-3) counts rows per hole (partial aggregation, so a hole with a
third of all rows is combined map-side) and turns the counts into offsets with an exclusive
prefix sum over holes, never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.text import clean_text
from lithos.operators.position import LOCAL, PID, ranged, with_exclusive_prefix_sum, with_ordered_index


def hole_text(df: DataFrame, column: str) -> Column:
    return clean_text(F.col(f"`{column}`"), df.schema[column].dataType)


def hole_lookup(collar: DataFrame, id_col: str) -> DataFrame:
    """SEQ-2: (key int, value string), distinct ids in sorted text order, keys from 1."""
    ids = collar.select(hole_text(collar, id_col).alias("value")).distinct()
    ranked = with_ordered_index(ids, ["value"], name="k", start=1)
    return ranked.select(F.col("k").cast("int").alias("key"), "value")


def collar_keys(collar: DataFrame, id_col: str, lookup: DataFrame, keep: tuple = ()) -> DataFrame:
    """JN-2: each collar row with the key of its hole (duplicates share the key)."""
    rows = collar.select(*[F.col(k) for k in keep], hole_text(collar, id_col).alias("hole_id"))
    return rows.join(lookup.select(F.col("value").alias("hole_id"), "key"), "hole_id", "left")


def max_depth(survey: DataFrame, id_col: str, depth_col: str) -> DataFrame:
    """AGG-5: (hole_id, max_depth); partial + final aggregate."""
    return survey.groupBy(hole_text(survey, id_col).alias("hole_id")).agg(F.max(F.col(f"`{depth_col}`")).cast("double").alias("max_depth"))


def hole_distances(collar: DataFrame, survey: DataFrame, collar_id: str, survey_id: str, depth_col: str,
                   max_depth_col: str | None = None, keep: tuple = ()) -> DataFrame:
    """JN-3 + SNK-9: (final, target, current) per collar row.

    With a max-depth column in the collar the three are that column (NULL kept); otherwise
    the survey's max depth per hole by a left join, missing -> 0.0.
    """
    base = collar.select(*[F.col(k) for k in keep], hole_text(collar, collar_id).alias("hole_id"),
                         *([F.col(f"`{max_depth_col}`").cast("double").alias("__d")] if max_depth_col else []))
    if not max_depth_col:
        base = base.join(max_depth(survey, survey_id, depth_col), "hole_id", "left").select(
            *keep, "hole_id", F.coalesce(F.col("max_depth"), F.lit(0.0)).alias("__d"))
    return base.select(*keep, "hole_id", F.col("__d").alias("final"), F.col("__d").alias("target"), F.col("__d").alias("current"))


def hole_counts(data: DataFrame, id_col: str) -> DataFrame:
    """AGG-8: rows per hole (all holes in the data, orphans included)."""
    return data.groupBy(hole_text(data, id_col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def hole_index_map(data: DataFrame, id_col: str, lookup: DataFrame) -> DataFrame:
    """SEQ-3: (hole_index int, offset long, count long) for rows sorted by hole id.

    Offsets are the exclusive prefix sum of counts over every hole present in the data,
    orphans too (their rows stay in the array and advance the offset, JN-4); lookup holes
    without rows get (offset 0, count 0). Ordered by offset, then hole_index (ORD-3).
    """
    counts = with_exclusive_prefix_sum(hole_counts(data, id_col), ["value"], "count", "offset")
    return (
        lookup.join(counts, "value", "left")
        .select(
            F.col("key").cast("int").alias("hole_index"),
            F.coalesce(F.col("offset"), F.lit(0)).cast("long").alias("offset"),
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        )
    )


def hole_indexes(collar: DataFrame, collar_id: str, data: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """SEQ-2 + SEQ-3 for one collar and many row tables in a single ranked pass.

    The lookup keys (rank among collar holes) and each table's offsets (rows of every hole
    before, orphans included) are all exclusive prefix sums along the same hole order. The
    collar ids and every table's rows are unioned and aggregated per hole in one shuffle (partial
    aggregation, so a hot hole is combined map-side), then ranked once.
    Returns (lookup, {name: index map}) with the shapes of :func:`hole_lookup` and
    :func:`hole_index_map`.
    """
    names = list(data)
    zero = F.lit(0).cast("long")
    parts = [collar.select(hole_text(collar, collar_id).alias("value"), F.lit(1).cast("long").alias("__in"),
                           *[zero.alias(f"__n{i}") for i in range(len(names))])]
    for i, name in enumerate(names):
        df, col = data[name]
        parts.append(df.select(hole_text(df, col).alias("value"), zero.alias("__in"),
                               *[(F.lit(1) if j == i else F.lit(0)).cast("long").alias(f"__n{j}") for j in range(len(names))]))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    per_hole = union.groupBy("value").agg(F.max("__in").alias("__in"),
                                          *[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(names))])
    ranked = with_exclusive_prefix_sum(per_hole, ["value"], ["__in"] + [f"__n{i}" for i in range(len(names))],
                                       ["__k"] + [f"__o{i}" for i in range(len(names))])
    holes = ranked.filter(F.col("__in") == 1)
    lookup = holes.select((F.col("__k") + 1).cast("int").alias("key"), "value")
    maps = {
        name: holes.select(
            (F.col("__k") + 1).cast("int").alias("hole_index"),
            F.when(F.col(f"__n{i}") > 0, F.col(f"__o{i}")).otherwise(F.lit(0)).cast("long").alias("offset"),
            F.col(f"__n{i}").cast("long").alias("count"))
        for i, name in enumerate(names)
    }
    return lookup, maps


def run_length_index(data: DataFrame, id_col: str, pos_col: str, lookup: DataFrame) -> DataFrame:
    """SEQ-4: one (hole_index, offset, count) row per run of equal ids along a dense position.

    The rows are range partitioned and sorted by position once. Inside a partition the previous row's id
    comes from ``lag``; the first row of each partition (one a partition) takes it from the last row of
    the partition before. Run starts are few and ranked; a run ends where the next one starts, or at the
    end of the data. Runs of ids absent from the lookup are dropped; lookup ids without any run get (0, 0).
    """
    d = data.select(hole_text(data, id_col).alias("value"), F.col(pos_col).cast("long").alias("p"))
    rows = ranged(d, ["p"])
    inside = Window.partitionBy(PID).orderBy(LOCAL)
    marked = rows.select(PID, LOCAL, "p", "value", F.lag("value").over(inside).alias("prev"))
    # last id of each partition, carried to the next partition that has rows: one row a partition
    last = rows.groupBy(PID).agg(F.max_by("value", LOCAL).alias("tail"))
    edge = last.select(F.col(PID), F.lag("tail").over(Window.orderBy(PID)).alias("edge"))
    starts = marked.join(edge, PID, "left").select(
        "p", "value", F.when(F.col(LOCAL) == 0, F.col("edge")).otherwise(F.col("prev")).alias("prev")).filter(
        F.col("prev").isNull() | (F.col("prev") != F.col("value"))).select("p", "value")
    ranked = with_ordered_index(starts, ["p"], name="r")
    nxt = ranked.select((F.col("r") - 1).alias("r"), F.col("p").alias("next_p"))
    total = d.select(F.max("p") + 1).scalar()
    runs = ranked.join(nxt, "r", "left").select(
        "value", F.col("p").alias("offset"),
        (F.coalesce(F.col("next_p"), total) - F.col("p")).alias("count"),
    )
    known = runs.join(lookup, "value", "inner").select(F.col("key").cast("int").alias("hole_index"), "offset", "count")
    empty = lookup.join(runs.select("value").distinct(), "value", "left_anti").select(
        F.col("key").cast("int").alias("hole_index"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("count"))
    return known.unionByName(empty)


def empty_holes(lookup: DataFrame, data: DataFrame, id_col: str) -> DataFrame:
    """SET-1: lookup holes without rows in the data."""
    present = data.select(hole_text(data, id_col).alias("value")).distinct()
    return lookup.join(present, "value", "left_anti").select("key", F.col("value").alias("hole_id"))


def orphan_rows(data: DataFrame, id_col: str, lookup: DataFrame) -> DataFrame:
    """JN-4 report: holes of the data that the lookup lacks, with their row counts."""
    return hole_counts(data, id_col).join(lookup, "value", "left_anti").select(
        F.col("value").alias("hole_id"), F.col("count").alias("rows"))
