"""Written intermediates and connected components, both in the shared checkpoint folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lithos.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: the lineage ends
    here, so that a lost executor costs one read and not the work above."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to sizes that suit long texts: at the default of 10,000 rows or 64 MB a
    task holds several copies of such a batch, in the JVM and in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Forest:
    """Union-find over the indexes 0..n-1, vectorised: hooks whole edge arrays by pointer jumping."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            live = x != y
            a, b, x, y = a[live], b[live], x[live], y[live]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
        self.label = label


def star(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest id of its group) of every group of more than one."""
    least = np.full(len(ids), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, label, ids)
    root = least[label]
    keep = root != ids
    return ids[keep], root[keep]


#: Edges (16 bytes each) that one task joins into components; more take the distributed rounds.
ONE_TASK = 2_000_000
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _spanning(batches):
    """Replace edges by a spanning star forest of their nodes, ``ONE_TASK`` edges at most at a time."""
    held: list[pa.RecordBatch] = []

    def reduced():
        table = pa.Table.from_batches(held)
        src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        forest = Forest(len(ids))
        forest.union(at[:len(src)], at[len(src):])
        return pa.record_batch([*star(ids, forest.label)], schema=_EDGES)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ONE_TASK:
            yield reduced()
            held.clear()
    if held:
        yield reduced()


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of the undirected ``edges`` (src, dst): (node, component) with component
    the smallest node id, for all nodes that have an edge.

    Each task first replaces its edges by a spanning forest. While the forests' edges number ``one_task``
    at most (counted), one task joins them. Beyond that large-star and small-star steps alternate: every
    step is a grouped minimum (combined before its shuffle, so a hub costs one row a task) and a join,
    whose skewed side Spark splits; each round is written to the checkpoint folder.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    now = written(edges.mapInArrow(_spanning, "src long, dst long"), "edges")
    if now.count() <= one_task:
        now = written(now.repartition(1).mapInArrow(_spanning, "src long, dst long"), "edges")
    else:
        now = _rounds(now, rounds)
    roots = now.select(F.col("dst").alias("node")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _rounds(now: DataFrame, rounds: int) -> DataFrame:
    """Star edges (member, root) of the components, by alternating large-star and small-star steps."""
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select("src", "dst", "m")
        small = small.select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")),
                                               F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        now = written(small.select("e.src", "e.dst").where("src <> dst").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long"))).first()
        if state == seen:
            return now
        seen = state
    raise RuntimeError("components did not settle")
