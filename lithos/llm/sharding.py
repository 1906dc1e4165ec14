"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. Groups are counted (combined before the
shuffle, so a huge group costs one row a task) and dealt by hash into buckets of bounded size; each
bucket's groups are differenced: the two partial partitions of largest spread are repeatedly combined,
the fullest part of one with the emptiest of the other. What a bucket hands on is one partial
partition, ``n_shards`` sums. These are differenced in the same way in rounds, at most ``FAN`` buckets a group,
until one is left; each round is a table of where a bucket's parts went, and the driver sees none of
them. Rows then take their group's shard by a join (Spark splits its skewed side), are written once, and
are numbered within each shard from per-partition counts, so that no shard's rows meet in one task.

Defined results: null text counts as the empty text (size ``overhead``); rows that repeat are rows of
one group; ties are broken by the group's hash; ids may be null or repeat; other columns are ignored;
an empty table gives an empty result. A group larger than a fair share stays whole.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lithos.llm.store import written

#: Groups that one task differences; the number of buckets follows from it.
BUCKET_GROUPS = 100_000
#: Buckets whose partial partitions one task differences in a round.
FAN = 1_000


def difference(partials: list[list[tuple[int, object]]]) -> list[tuple[int, object]]:
    """Combine partial partitions (lists of (sum, content), all of one length) into one. Content of a
    combined part is a pair of contents."""
    heap = []
    for k, parts in enumerate(partials):
        parts = sorted(parts, key=lambda p: p[0])
        heap.append((parts[0][0] - parts[-1][0], k, parts))
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [(x[0] + y[0], (x[1], y[1]) if x[1] is not None and y[1] is not None else x[1] if y[1] is None else y[1])
                 for x, y in zip(a, reversed(b))]
        parts.sort(key=lambda p: p[0])
        k += 1
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], k, parts))
    return heap[0][2] if heap else []


def leaves(content) -> list:
    """The single contents of a nest of pairs."""
    out, todo = [], [content]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        elif x is not None:
            out.append(x)
    return out


def split(weights: list[int], n: int) -> list[list[int]]:
    """Indexes of ``weights`` in ``n`` parts of near equal sums."""
    parts = difference([[(0, None)] * (n - 1) + [(w, i)] for i, w in enumerate(weights)])
    return [leaves(c) for _, c in parts] if parts else [[] for _ in range(n)]


def _in_rounds(sums: DataFrame, buckets: int, n: int) -> DataFrame:
    """(bucket, part, shard) from the (bucket, part, weight) of ``buckets`` partial partitions."""
    def combine(table: pa.Table) -> pa.Table:
        # a (bucket, part) is wrapped in a list so that ``leaves`` keeps it whole
        parts: dict[int, list] = {}
        for b, p, w in zip(*(table[c].to_pylist() for c in ("bucket", "part", "weight")), strict=True):
            parts.setdefault(b, [(0, None)] * n)[p] = (w, [(b, p)])
        done = difference([parts[b] for b in sorted(parts)])
        group = table["group"][0].as_py()
        moved = [(b, p, to, w, group) for to, (w, c) in enumerate(done) for ((b, p),) in leaves(c)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array(v, t) for v, t in zip(zip(*moved), kinds, strict=True)],
                        names=["bucket", "part", "to", "total", "group"])

    rounds = []
    while True:
        buckets = -(-buckets // FAN)
        # dealt round, so that no group is left with few buckets and nothing to balance with
        grouped = sums.withColumn("group", F.pmod("bucket", F.lit(buckets)).cast("int"))
        rounds.append(written(grouped.groupBy("group").applyInArrow(
            combine, "bucket int, part int, to int, total long, group int"), "differences"))
        if buckets == 1:
            break
        sums = rounds[-1].groupBy(F.col("group").alias("bucket"), F.col("to").alias("part")).agg(F.max("total").alias("weight"))
    where = rounds.pop().select("bucket", "part", F.col("to").alias("shard"))
    while rounds:
        above = where.select(F.col("bucket").alias("group"), F.col("part").alias("to"), "shard")
        where = rounds.pop().join(above, ["group", "to"]).select("bucket", "part", "shard")
    return where


def shards(docs: DataFrame, id_col: str, text_col: str, n_shards: int, overhead: int = 8) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row; see the module's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, (F.octet_length(text) + overhead).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"),
                       F.xxhash64(text, F.lit(1)).alias("h2"))
    key = ["h1", "h2", "size"]
    groups = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "groups")
    buckets = 1 + groups.count() // BUCKET_GROUPS

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in key])
        weight = [s * n for s, n in zip(table["size"].to_pylist(), table["n"].to_pylist(), strict=True)]
        part = [0] * len(weight)
        for p, members in enumerate(split(weight, n_shards)):
            for i in members:
                part[i] = p
        return table.select([*key, "bucket"]).append_column(
            "part", pa.array(part, pa.int32())).append_column("weight", pa.array(weight, pa.int64()))

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("h2"), F.lit(buckets)).cast("int"))
    dealt = written(dealt.groupBy("bucket").applyInArrow(
        deal, "h1 long, h2 long, size long, bucket int, part int, weight long"), "parts")
    where = _in_rounds(dealt.groupBy("bucket", "part").agg(F.sum("weight").alias("weight")), buckets, n_shards)
    found = rows.join(dealt.join(where, ["bucket", "part"]).select(*key, "shard"), key)

    def count_off(batches):
        pid, seen = TaskContext.get().partitionId(), [0] * n_shards
        for batch in batches:
            local = []
            for s in batch.column("shard").to_pylist():
                local.append(seen[s])
                seen[s] += 1
            yield batch.append_column("pid", pa.array([pid] * batch.num_rows, pa.int32())).append_column(
                "local", pa.array(local, pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    found = written(found.select(id_col, "size", "text_crc32", "shard").mapInArrow(
        count_off, f"`{id_col}` {kind}, size long, text_crc32 long, shard int, pid int, local long"), "shards")
    counts = found.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return found.join(starts, ["pid", "shard"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("start") + F.col("local")).alias("slot"))
