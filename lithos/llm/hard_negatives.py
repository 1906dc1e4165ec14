"""Hard-negative mining by vertical scans of columnar blocks (BOND).

Components are floor(scale * c) as whole numbers, a score is the inner product with the anchor. Rows are packed
into blocks of bounded size, stored dimension by dimension; anchors are rows of a stated query set, in blocks of
their own. For a pair of blocks each anchor reads the columns in the order of its own falling magnitudes. What
the unread columns can still add lies between the sums of the anchor's components times the columns' least and
greatest values, so every candidate has a lower and an upper bound; those that can reach nothing any more leave
the bitmap. What is left after the last column has its exact score.

Two scans: the first finds each anchor's best rows of its own label (a candidate leaves when its upper bound is
below the k-th best lower bound seen so far), the second the best rows of other labels in the score window of
each positive (a candidate leaves when its bounds miss every window, or when a window already has k candidates
that are surely inside and surely better). A task carries its best lists from block to block, so that later
blocks start with tight bounds; tasks hand on lists, and Spark merges them by rank.

Defined results: rows with a null id, a null label, a null or empty vector, or null or non-finite components
take no part. Vectors of different lengths never meet. Rows that repeat an id are candidates one by one; a row
with the anchor's own id is never its positive or negative, and an anchor id given more than once anchors once
for each distinct row. Scores are exact whatever their size (beyond 2**52 in whole numbers of any size); one that
no long holds is returned as the nearest long. Components beyond 2**62 after scaling count as that value. Anchors without positives, and positives
without negatives, give no rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lithos.llm.store import written
from lithos.llm.text import tidy
from lithos.operators.position import with_ordered_index

#: Rows of a candidate block, anchors of an anchor block; columns read between two prunings; candidate blocks
#: that one task of a salted join meets; bytes of anchor blocks that are broadcast at most.
ROWS, ANCHORS, STEP, TOGETHER, BROADCAST_BYTES = 8192, 4096, 8, 16, 32 << 20
_LONG = (1 << 63) - 1


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as doubles (whole numbers, so exact); beyond 2**62 that value counts."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -float(1 << 62), float(1 << 62))


class Columns:
    """Candidate rows stored column by column, with each column's least and greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        self.x = np.ascontiguousarray(x.T)
        self.low, self.high = self.x.min(1), self.x.max(1)


def rests(anchor: np.ndarray, block: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reading order, least and greatest sum that the columns from each place of that order on can add)."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a, b = anchor[order] * block.low[order], anchor[order] * block.high[order]
    zero = np.zeros(1, a.dtype)
    low = np.concatenate([np.cumsum(np.minimum(a, b)[::-1])[::-1], zero])
    high = np.concatenate([np.cumsum(np.maximum(a, b)[::-1])[::-1], zero])
    return order, low, high


def best(anchor: np.ndarray, block: Columns, among: np.ndarray, k: int, floor=None) -> tuple[np.ndarray, np.ndarray]:
    """(score, index) of the rows of ``among`` that may be in the first k, ties included; rows below ``floor``,
    the k-th best score known from elsewhere, are not."""
    order, low, high = rests(anchor, block)
    at, score = among, np.zeros(len(among), block.x.dtype)
    for lo in range(0, len(order), STEP):
        if not len(at):
            break
        hi = min(lo + STEP, len(order))
        for d in order[lo:hi]:
            score = score + anchor[d] * block.x[d][at]
        line = floor
        if len(at) >= k:
            kth = np.partition(score, len(score) - k)[len(score) - k] + low[hi]
            line = kth if line is None or kth > line else line
        if line is not None:
            live = score + high[hi] >= line
            if not live.all():
                at, score = at[live], score[live]
    return score, at


def in_windows(anchor: np.ndarray, block: Columns, among: np.ndarray, windows: list[tuple], k: int,
               floors: list) -> tuple[np.ndarray, np.ndarray]:
    """(score, index) of the rows of ``among`` that may be in the first k of one of the ``windows`` (least and
    greatest score); ``floors`` holds the k-th best score known in each window, or None."""
    order, low, high = rests(anchor, block)
    at, score = among, np.zeros(len(among), block.x.dtype)
    for lo in range(0, len(order), STEP):
        if not len(at):
            break
        hi = min(lo + STEP, len(order))
        for d in order[lo:hi]:
            score = score + anchor[d] * block.x[d][at]
        under, over = score + low[hi], score + high[hi]
        live = np.zeros(len(at), bool)
        for (least, most), floor in zip(windows, floors, strict=True):
            sure = under[(under >= least) & (over <= most)]
            line = least
            if len(sure) >= k:
                line = max(line, np.partition(sure, len(sure) - k)[len(sure) - k])
            if floor is not None:
                line = max(line, floor)
            live |= (over >= line) & (under <= most)
        if not live.all():
            at, score = at[live], score[live]
    return score, at


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


class First:
    """The first k (score, id) pairs seen: higher scores first, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            entry = (int(s), -i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)

    @property
    def floor(self):
        return self.heap[0][0] if len(self.heap) == self.k else None

    def pairs(self) -> list[tuple[int, int]]:
        return [(s, -i) for s, i in sorted(self.heap, reverse=True)]


def _sent(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, in the shortest of three widths that holds them."""
    most = np.abs(x).max(initial=0)
    kind, code = (np.int16, b"h") if most < 1 << 15 else (np.int32, b"i") if most < 1 << 31 else (np.float64, b"d")
    return code + x.astype(kind).tobytes()


def _received(data: bytes, rows: int) -> np.ndarray:
    kind = {b"h": np.int16, b"i": np.int32, b"d": np.float64}[data[:1]]
    return np.frombuffer(data[1:], kind).astype(np.float64).reshape(rows, -1)


def _shared(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles if every inner product and its bounds are exact there, else both as whole numbers of any size."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 1 << 52:
        return a, x
    return tuple(np.array([int(v) for v in m.ravel().tolist()], object).reshape(m.shape) for m in (a, x))


#: Scores travel as bytes that sort like the numbers, so that no width bounds them.
_ZERO, _WIDE = 1 << 167, 21


def _key(score: int) -> bytes:
    return (score + _ZERO).to_bytes(_WIDE, "big")


def _score(key: bytes) -> int:
    return int.from_bytes(key, "big") - _ZERO


def _long(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _packed(placed: DataFrame, size: int, scale: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a ``place``, in blocks of ``size`` places and one vector length: (w, block, id, label, x), and
    ``more`` as lists."""
    placed = placed.select("w", F.floor(F.col("place") / size).alias("block"), "place", "id", "label", "v", *more)
    kinds = dict(placed.dtypes)
    names = ("place", "id", "label", *more)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = {n: table[n].slice(0, 1) for n in ("w", "block")}
        for n in names:
            out[n] = pa.array([table[n].to_pylist()], pa.list_(table.schema.field(n).type))
        return pa.table(out | {"x": pa.array([_sent(whole(v, scale))], pa.binary())})

    lists = ", ".join(f"{n} array<{kinds[n]}>" for n in names)
    return written(placed.groupBy("w", "block").applyInArrow(pack, f"w int, block long, {lists}, x binary"), "blocks")


def _pairs(blocks: DataFrame, anchors: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Every block of rows beside every block of anchors of its vector length, as one row of packed columns.

    The anchors are a stated query set. Their blocks are broadcast where they have ``BROADCAST_BYTES`` at most
    (summed up), and blocks of rows stay in their tasks. Beyond that both sides are dealt by (anchor block, group
    of ``TOGETHER`` blocks of rows), so that no anchor block brings all rows to one task."""
    a = anchors.select("w", F.col("block").alias("ablock"), F.col("place").alias("aplace"), F.col("id").alias("aid"),
                       F.col("label").alias("alabel"), F.col("x").alias("ax"), *more)
    size = anchors.agg(F.sum(F.length("x") + 100 * F.size("id")).alias("n")).first()["n"] or 0
    n = blocks.count()
    parts = min(n, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TOGETHER))
    rows = blocks.select("w", "block", "id", "label", "x")
    if size <= BROADCAST_BYTES:
        # a few blocks a task: the work of a block is far above its bytes
        return (rows.repartitionByRange(parts, "block") if n else rows).drop("block").join(F.broadcast(a), "w")
    wanted = anchors.groupBy("w").agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    groups = blocks.groupBy("w").agg((F.min("block") / TOGETHER).cast("long").alias("g0"),
                                     (F.max("block") / TOGETHER).cast("long").alias("g1"))
    each = rows.join(F.broadcast(wanted), "w").select(  # one row a vector length
        "w", "id", "label", "x", (F.col("block") / TOGETHER).cast("long").alias("group"),
        F.explode(F.sequence("b0", "b1")).alias("ablock"))
    a = a.join(F.broadcast(groups), "w").withColumn("group", F.explode(F.sequence("g0", "g1"))).drop("g0", "g1")
    return each.join(a, ["w", "ablock", "group"]).drop("group")


def _numbers(values: pa.Scalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


def _opened(batches):
    """(columns of the pair, anchors' matrix, candidate block) of every pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            ids = _numbers(row["id"])
            a, x = _shared(_received(row["ax"].as_py(), len(row["aid"].values)), _received(row["x"].as_py(), len(ids)))
            yield row, a, Columns(ids, _numbers(row["label"]), x)


def _first(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of every key by falling score, then id, with their ``rank``; Spark cuts each task's rows
    by that rank before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("key").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sound_rows(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, v, w) of the rows that take part."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).withColumn("w", F.size("v"))


def mine(rows: DataFrame, id_col: str, vec_col: str, label: Column, is_anchor: Column, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's text.
    ``label`` and ``is_anchor`` are expressions over ``rows``; scores of negatives lie between ``low`` and
    ``high`` hundredths of the positive's."""
    # rows of one label share blocks, so that a scan for positives reads few others
    blocks = _packed(with_ordered_index(sound_rows(rows, id_col, vec_col, label), ["w", "label", "id"], name="place"),
                     ROWS, scale)
    anchors = sound_rows(rows.where(is_anchor), id_col, vec_col, label).distinct()
    anchors = with_ordered_index(anchors, ["w", "label", "id", F.xxhash64("v")], name="place")

    def own_label(batches):
        held: dict[int, tuple[int, First]] = {}
        for row, a, block in _opened(batches):
            places, aids, labels = (_numbers(row[n]) for n in ("aplace", "aid", "alabel"))
            for value in np.unique(labels):
                same = np.flatnonzero(block.labels == value)
                for j in np.flatnonzero(labels == value) if len(same) else ():
                    _, found = held.setdefault(int(places[j]), (int(aids[j]), First(positives)))
                    score, at = best(a[j], block, same[block.ids[same] != aids[j]], positives, found.floor)
                    found.add(score, block.ids[at])
        for place, (aid, found) in held.items():
            rows_of = found.pairs()
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * len(rows_of), pa.int64()), pa.array([i for _, i in rows_of], pa.int64()),
                 pa.array([_key(s) for s, _ in rows_of], pa.binary())], names=["place", "id", "key"])

    found = _pairs(blocks, _packed(anchors, ANCHORS, scale)).mapInArrow(tidy(own_label), "place long, id long, key binary")
    found = written(_first(found, ["place"], positives), "positives")
    given = found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "key"))).alias("p")).select(
        "place", F.col("p.id").alias("pids"), F.col("p.key").alias("pkeys"))
    wanted = _packed(anchors.join(given, "place"), ANCHORS, scale, ("pids", "pkeys"))

    def other_labels(batches):
        held: dict[int, tuple] = {}
        for row, a, block in _opened(batches):
            places, aids, labels = (_numbers(row[n]) for n in ("aplace", "aid", "alabel"))
            pids, pkeys = row["pids"].as_py(), row["pkeys"].as_py()
            for value in np.unique(labels):
                other = np.flatnonzero(block.labels != value)
                for j in np.flatnonzero(labels == value) if len(other) else ():
                    place = int(places[j])
                    if place not in held:
                        scores = [_score(k) for k in pkeys[j]]
                        # positives of one score have one window
                        spans = {window(s, low, high) for s in scores}
                        held[place] = (int(aids[j]), list(zip(pids[j], scores, strict=True)),
                                       {w: First(negatives) for w in sorted(spans) if w[0] <= w[1]})
                    lists = held[place][2]
                    if not lists:
                        continue
                    score, at = in_windows(a[j], block, other[block.ids[other] != aids[j]], list(lists), negatives,
                                           [f.floor for f in lists.values()])
                    ids = block.ids[at]
                    for (least, most), f in lists.items():
                        inside = (score >= least) & (score <= most)
                        f.add(score[inside], ids[inside])
        for place, (aid, positive, lists) in held.items():
            out = [(place, nth, aid, p, _long(s), n, _long(x), _key(x)) for nth, (p, s) in enumerate(positive)
                   if window(s, low, high) in lists for x, n in lists[window(s, low, high)].pairs()]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=names)

    names = ["place", "nth", "anchor_id", "positive_id", "positive_score", "id", "negative_score", "key"]
    mined = _pairs(blocks, wanted, ("pids", "pkeys")).mapInArrow(
        tidy(other_labels), "place long, nth int, anchor_id long, positive_id long, positive_score long, id long, "
                            "negative_score long, key binary")
    return _first(mined, ["place", "nth"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
