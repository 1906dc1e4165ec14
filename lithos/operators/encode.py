"""Attributes: type dispatch, dictionary encoding in first-appearance order, codes, values.

Dictionary encoding (SEQ-1) never orders rows: each distinct value keeps the smallest row
position it occurs at (a partial aggregate, so a value that fills a third of the table is
combined map-side), and only the distinct values are ranked. Codes are an equi join of the
rows with the lookup; the lookup is distinct values, and AQE turns the join into a broadcast
once the materialised lookup is measured small, else it stays a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.functions.numeric import coerce_double
from lithos.functions.text import attribute_key_of, clean_text
from lithos.operators.position import with_ordered_index

CONTINUOUS_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.DecimalType)


@dataclass(frozen=True)
class AttributeSpec:
    name: str
    key: str
    kind: str  # "continuous" | "category"
    dtype: T.DataType
    warning: str | None = None


def attribute_columns(df: DataFrame, explicit: Sequence[str] | None, role_cols: Sequence[str]) -> list[str]:
    """PRJ-4: an explicit, non-empty list wins; otherwise every column that is not a role column."""
    if explicit:
        return list(explicit)
    role = set(role_cols)
    return [c for c in df.columns if c not in role]


def plan_attributes(df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = ()) -> tuple[list[AttributeSpec], list[str]]:
    """PRJ-5/6 + SCL-1: decide kind and key for each attribute from the schema alone.

    Returns (specs, warnings). Unknown or excluded names are skipped with a warning, and keys
    that collide after normalisation are reported (both deviations are additions: the original
    skips silently and does not detect collisions).
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    excl = set(exclude)
    specs, warnings, seen = [], [], {}
    for name in columns:
        if name not in fields:
            warnings.append(f"no column '{name}' for an attribute; left out")
            continue
        if name in excl:
            warnings.append(f"column '{name}' has a role already; left out as attribute")
            continue
        dt = fields[name]
        key = attribute_key_of(name)
        if isinstance(dt, T.StringType):
            spec = AttributeSpec(name, key, "category", dt)
        elif isinstance(dt, CONTINUOUS_TYPES):
            spec = AttributeSpec(name, key, "continuous", dt)
        else:
            spec = AttributeSpec(name, key, "category", dt, f"column {name} of type {dt.simpleString()} is stored as text categories")
            warnings.append(spec.warning)
        if key in seen:
            warnings.append(f"columns '{seen[key]}' and '{name}' share the attribute key '{key}'")
        seen.setdefault(key, name)
        specs.append(spec)
    return specs, warnings


def category_text(df: DataFrame, column: str):
    dt = df.schema[column].dataType
    return clean_text(F.col(f"`{column}`"), dt)


def category_lookup(df: DataFrame, column: str, order_col: str) -> DataFrame:
    """SEQ-1: (key int, value string), keys 1..n in order of first appearance along
    ``order_col`` (a row position or unique key). NULL is the real category ''."""
    firsts = df.groupBy(category_text(df, column).alias("value")).agg(F.min(order_col).alias("first"))
    ranked = with_ordered_index(firsts, ["first", "value"], name="k", start=1)
    return ranked.select(F.col("k").cast("int").alias("key"), "value")


def category_lookups(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """SEQ-1 for many columns in one shuffle (§4.3.3): (attribute, key, value).

    The category columns are unpivoted to (attribute, value, position); all lookups are ranked
    in one ordered index over (attribute, first appearance); a per-attribute start offset (one
    row per attribute) turns the global rank into keys 1..n per attribute.
    """
    long = df.select(
        F.col(order_col).alias("__o"),
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("attribute"), category_text(df, c).alias("value")) for c in columns
        ])).alias("a"),
    ).select("a.attribute", "a.value", "__o")
    firsts = long.groupBy("attribute", "value").agg(F.min("__o").alias("first"))
    ranked = with_ordered_index(firsts, ["attribute", "first", "value"], name="g")
    starts = ranked.groupBy("attribute").agg(F.min("g").alias("g0"))
    return (
        ranked.join(F.broadcast(starts), "attribute")  # one row per attribute
        .select("attribute", (F.col("g") - F.col("g0") + 1).cast("int").alias("key"), "value")
    )


def category_codes(df: DataFrame, column: str, lookup: DataFrame, keep: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """JN-1: int code of every row's category value (equi join on the cleaned text)."""
    rows = df.select(*[F.col(k) for k in keep], category_text(df, column).alias("__v"))
    lk = lookup.select(F.col("value").alias("__v"), F.col("key").alias(name or column))
    return rows.join(lk, "__v", "left").drop("__v")


def continuous_values(df: DataFrame, column: str, keep: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """OBJ-6 + PRJ-8: float64 values; text that is not a number becomes NULL."""
    dt = df.schema[column].dataType
    return df.select(*[F.col(k) for k in keep], coerce_double(F.col(f"`{column}`"), dt).alias(name or column))
