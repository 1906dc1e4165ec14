"""Row positions, dense keys and prefix sums without pulling rows into one task (§4.3).

Three shapes share one technique:

* ``with_file_position``: the row order of the files themselves (N5). Parquet exposes
  ``_metadata.row_index``; other formats use the split start and the per-task row counter.
  One row per file (or per split) is aggregated, ranked like any other rows, and joined back.
* ``with_ordered_index``: a dense 0..n-1 index along a total order. The data is range
  partitioned on the full order (Spark's sampler splits a hot leading key across tasks when
  the tie-breakers differ), sorted inside each partition and checkpointed, so the per-partition
  counts and the rows are read from the same materialised partitions. The offsets table has
  one row per partition, which bounds the broadcast.
* ``with_exclusive_prefix_sum``: the same over a weight column (row counts per hole).
* ``with_segmented_index`` and ``with_segmented_prefix_sum``: both, starting anew in every group (an object of
  many). The rows are ranked once along (group, order); a group's first rank, one row a group, is taken off.
  No window runs over a group, so a group with a third of all rows is spread over tasks like any other rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.session import ensure_checkpoint_dir

PID = "__pid"
LOCAL = "__local"
_OFF = "__off"


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ranged(df: DataFrame, order_cols: Sequence, keep: Sequence[str] | None = None) -> DataFrame:
    """Range partition + local sort + partition id + local row number, materialised. ``keep``: the columns that are
    written; the others only order the rows."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = _cols(order_cols)
    many = input_partitions(df)
    # Up to the session's shuffle partition number AQE merges neighbouring ranges to the advisory size, and
    # every partition stays a contiguous range; an input too large for that number gets its own.
    by_range = df.repartitionByRange(many, *cols) if many else df.repartitionByRange(*cols)
    out = (
        by_range
        .sortWithinPartitions(*cols)
        .select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
        .withColumn(PID, F.spark_partition_id())
        .withColumn(LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(PID).cast("long"), 33))
    )
    # The partition ids, local numbers and the range bounds they came from are fixed once by
    # writing them as a parquet table in the shared checkpoint folder: lineage is cut, a lost
    # executor re-reads the same files, and later reads prune to the columns they need.
    return materialize(out)


#: Bytes of input files behind one range partition. Packed columns open to many times that when they are sorted, and
#: what a task cannot hold is spilled and read again.
RANGE_BYTES = 16 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of ``df``'s source files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def input_partitions(df: DataFrame) -> int | None:
    """Range partitions for ``df``'s source files at RANGE_BYTES each, where that is more than the session's
    shuffle partition number; else None. Sizes of the sources are known from their listing; estimates of joins
    above them are not used."""
    n = -(-input_bytes(df) // RANGE_BYTES)
    return n if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1 << 20 else None


_SCOPES: list[list[str]] = []


@contextmanager
def intermediates_removed(spark) -> Iterator[None]:
    """Folders that are written as intermediates inside are deleted on leaving. Only for work that has been
    executed or written elsewhere by then: DataFrames read from those folders are not to be used after."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        jvm = spark._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def registered(path: str) -> str:
    """``path``, a folder of intermediates, which goes when the ``intermediates_removed`` around the call is left."""
    for made in _SCOPES:
        made.append(path)
    return path


def materialize_path(df: DataFrame) -> str:
    """Write ``df`` as parquet under the session's checkpoint folder; return the path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/lithos-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return registered(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet under the session's checkpoint folder and read it back
    (with the known schema, so no footer inference pass)."""
    return df.sparkSession.read.schema(df.schema).parquet(materialize_path(df))


@contextmanager
def a_file_a_task(spark) -> Iterator[None]:
    """Scans that run inside read one file, or split of one, in a task: rows of ordered files keep their order, and
    what is written from them the files' ranges."""
    cost = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(cost, None)
    spark.conf.set(cost, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(cost, was) if was is not None else spark.conf.unset(cost)


def _partition_offsets(sizes: DataFrame, weight: str) -> DataFrame:
    # One row per partition: an unpartitioned window here is bounded by the partition count.
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(PID, F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("long").alias(_OFF))


def with_ordered_index(df: DataFrame, order_cols: Sequence, name: str = "pos", start: int = 0,
                       keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = start + rank along ``order_cols`` (must be a total order for a
    deterministic result; ties get distinct consecutive numbers). ``keep``: columns of the result, all unless given."""
    rows = ranged(df, order_cols, keep)
    sizes = rows.groupBy(PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _partition_offsets(sizes, "__n")
    out = rows.join(F.broadcast(offsets), PID)
    columns = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return out.select(*columns, (F.col(_OFF) + F.col(LOCAL) + F.lit(start)).cast("long").alias(name))


def with_exclusive_prefix_sum(df: DataFrame, order_cols: Sequence, weight, name) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows strictly before, along ``order_cols``.

    ``weight`` and ``name`` may be lists: several prefix sums along the same order then share
    one ranked pass."""
    weights = [weight] if isinstance(weight, str) else list(weight)
    names = [name] if isinstance(name, str) else list(name)
    ranked = ranged(df, order_cols)
    ranged_sizes = ranked.groupBy(PID).agg(*[F.sum(w).alias(f"__w{i}") for i, w in enumerate(weights)])
    # per-partition offsets of every weight (one row per partition)
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged_sizes.select(PID, *[F.coalesce(F.sum(f"__w{i}").over(w), F.lit(0)).cast("long").alias(f"__o{i}")
                                         for i in range(len(weights))])
    # Inside a partition: a running sum partitioned by the partition id (one range each).
    wl = Window.partitionBy(PID).orderBy(F.col(LOCAL)).rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.select("*", *[F.coalesce(F.sum(wt).over(wl), F.lit(0)).alias(f"__l{i}") for i, wt in enumerate(weights)])
    out = local.join(F.broadcast(offsets), PID)
    return out.select(*df.columns, *[(F.col(f"__o{i}") + F.col(f"__l{i}")).cast("long").alias(n) for i, n in enumerate(names)])


def with_segmented_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, name: str = "pos",
                         start: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = start + rank along ``order_cols`` inside the row's group. Groups are not NULL. ``keep``: columns
    of the result (the groups among them), all unless given; the others are sorted by but not written."""
    ranked = with_ordered_index(df, [*group_cols, *order_cols], name="__rank", keep=keep)
    starts = ranked.groupBy(*group_cols).agg(F.min("__rank").alias("__start"))
    return ranked.join(starts, list(group_cols)).select(
        *[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)], (F.col("__rank") - F.col("__start") + F.lit(start)).cast("long").alias(name))


def with_segmented_prefix_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, weights: Sequence[str],
                              names: Sequence[str]) -> DataFrame:
    """Add ``names`` = sums of ``weights`` (not negative) over the rows strictly before in the row's group."""
    tmp = [f"__s{i}" for i in range(len(weights))]
    ranked = with_exclusive_prefix_sum(df, [*group_cols, *order_cols], list(weights), tmp)
    starts = ranked.groupBy(*group_cols).agg(*[F.min(t).alias(f"{t}0") for t in tmp])
    return ranked.join(starts, list(group_cols)).select(
        *df.columns, *[(F.col(t) - F.col(f"{t}0")).cast("long").alias(n) for t, n in zip(tmp, names, strict=True)])


def with_file_position(df: DataFrame, name: str = "pos", parquet: bool = True) -> DataFrame:
    """Add ``name`` = position of the row in file order (files ordered by path).

    ``df`` must come straight from a file scan (the hidden ``_metadata`` column).
    """
    if parquet:
        base = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", F.col("_metadata.row_index"))
        per_file = base.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
        offsets = with_exclusive_prefix_sum(per_file, ["__file"], "__n", _OFF).select("__file", _OFF)
        out = base.join(offsets, "__file")
        return out.select(*df.columns, (F.col(_OFF) + F.col("__row")).cast("long").alias(name))
    # Text formats: a split is read by one task in order, and the per-task counter of
    # monotonically_increasing_id is consecutive inside it. The counter is fixed by writing the rows.
    return with_split_position(materialize(with_split(df)), name)


#: Columns that ``with_split`` adds: file, start of the split, place in it.
SPLIT = ("__file", "__block", "__mid")


def with_split(df: DataFrame) -> DataFrame:
    """A text scan with the hidden ``_metadata`` column, with ``SPLIT`` in its stead. To be written before use."""
    return (df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__block", F.col("_metadata.file_block_start"))
            .withColumn("__mid", F.monotonically_increasing_id()).drop("_metadata"))


def with_split_position(written: DataFrame, name: str = "pos") -> DataFrame:
    """Add ``name`` = position in file order (files by path) to written rows with ``SPLIT``, whose places are
    consecutive inside a split; ``SPLIT`` goes."""
    per_split = written.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    offsets = with_exclusive_prefix_sum(per_split, ["__file", "__block"], "__n", _OFF).select(
        "__file", "__block", "__first", _OFF)
    out = written.join(offsets, ["__file", "__block"])
    keep = [F.col(f"`{c}`") for c in written.columns if c not in SPLIT]
    return out.select(*keep, (F.col(_OFF) + F.col("__mid") - F.col("__first")).cast("long").alias(name))
