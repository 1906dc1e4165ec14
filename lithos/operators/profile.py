"""Column profile and head sample (AGG-6, LIM-1).

One unpivoted aggregate computes the non-null and null counts, the distinct count and (numeric columns) min and max.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)


def pandas_dtype(dt: T.DataType) -> str:
    """Name of the dtype a pandas reader would report for a Spark type."""
    mapping = [
        (T.DoubleType, "float64"), (T.FloatType, "float32"), (T.LongType, "int64"), (T.IntegerType, "int32"),
        (T.ShortType, "int16"), (T.ByteType, "int8"), (T.BooleanType, "bool"),
        (T.TimestampNTZType, "datetime64[us]"), (T.TimestampType, "datetime64[us, UTC]"), (T.DateType, "object"),
    ]
    for cls, name in mapping:
        if isinstance(dt, cls):
            return name
    return "object"


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: column, dtype, non_null_count, null_count, unique_count, min, max.

    NaN counts as null (pandas semantics); min/max of an all-null column are NULL (deviation N10).

    One scan, one shuffle of rows. Every value becomes (column number, 128-bit digest) with its number as a double, and
    rows with equal digests are combined in the task that reads them: a text enters the shuffle as 16 bytes, once a task
    and distinct value. The distinct values are then counted column by column. Two different values of a column share
    a digest with a probability of some 10^-21 for a billion distinct ones."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        raise ValueError("no column to profile")
    cells = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0).cast(f.dataType))  # -0.0 is 0.0
        number = c.cast("double") if isinstance(f.dataType, _NUMERIC) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("i"), c.isNull().alias("gone"), F.xxhash64(c).alias("h1"),
                              F.xxhash64(F.lit(i), c).alias("h2"), number.alias("x")))
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    # one row for each distinct value of a column, and one for its missing values
    values = long.groupBy("i", "gone", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    counted = values.groupBy("i").agg(
        F.coalesce(F.sum(F.when(~F.col("gone"), F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(~F.col("gone")).alias("unique_count"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    # a table without rows still has its columns
    names = df.sparkSession.createDataFrame([(i, f.name, pandas_dtype(f.dataType)) for i, f in enumerate(fields)], "i int, column string, dtype string")
    zero = F.lit(0).cast("long")
    return names.join(counted, "i", "left").select("column", "dtype", *[F.coalesce(c, zero).alias(c) for c in (
        "non_null_count", "null_count", "unique_count")], "min", "max")


def table_shape(df: DataFrame) -> DataFrame:
    """total_rows, total_columns."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)))


def sample_rows(df: DataFrame, order_cols: list, n: int = 10) -> DataFrame:
    """LIM-1: the first ``n`` rows along an order (TakeOrderedAndProject; the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)
