"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are scaled to length one and rotated onto the principal axes of all rows (the second moments are
summed by Spark, so only a matrix of the vectors' width reaches the driver). Equal vectors are merged and
keep their number of copies. Ordered by their first principal coordinates, vectors are packed into tiles of
bounded size. Linked vectors lie within sqrt(2 - 2 * cosine) of each other in every coordinate, so tiles are
paired by an equi-join on strips of that width, and pairs whose boxes lie too far apart go. A pair of tiles
is compared leading coordinates first: the product so far plus the product of the norms of the rest bounds
the cosine, and only pairs whose bound still reaches the threshold are carried on, block of coordinates by
block. The survivors' cosines are computed from the vectors as given, in double precision. A tile pair hands
on link counts per vector and a spanning forest, never all pairs.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with
nothing; vectors of different lengths never link; the id breaks ties, and rows that repeat an id count as
vectors of their own that share its component; a null id gets a row with its links and no component id of
its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithos.llm.store import Forest, components, star, written
from lithos.llm.text import tidy
from lithos.operators.position import with_ordered_index

#: Vectors of a tile; coordinates of a block; coordinates whose box is kept for tiles.
TILE, STEP, BOX = 4096, 16, 8
_SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    """Rows of a list array without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length, without overflow or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to one or so: no digit changes, and squares
    neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def axes(vectors: DataFrame, vec_col: str, width: int) -> np.ndarray:
    """Principal axes (columns, largest first) of the unit vectors of ``width`` components."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["m"])

    parts = vectors.where(F.size(vec_col) == width).select(vec_col).mapInArrow(run, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    m = np.zeros(width * width)
    for r in sums:
        m[r["k"]] = r["x"]
    m = m.reshape(width, width)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of a, of b) whose cosine reaches the threshold. a, b: rotated unit vectors; va, vb: the
    vectors as given, which decide."""
    width = a.shape[1]
    left, right = [], []
    rest_a = np.sqrt(np.cumsum((a * a)[:, ::-1], 1)[:, ::-1])
    rest_b = np.sqrt(np.cumsum((b * b)[:, ::-1], 1)[:, ::-1])
    for lo in range(0, len(a), 512):
        rows = slice(lo, lo + 512)
        first = min(STEP, width)
        product = a[rows, :first] @ b[:, :first].T
        if first < width:
            bound = product + rest_a[rows, first, None] * rest_b[None, :, first]
        else:
            bound = product
        i, j = np.nonzero(bound >= cosine - _SLACK)
        p = product[i, j]
        i += lo
        for at in range(first, width, STEP):  # coordinates block by block, for the pairs still possible
            to = min(at + STEP, width)
            p = p + np.einsum("nd,nd->n", a[i, at:to], b[j, at:to])
            bound = p + rest_a[i, to] * rest_b[j, to] if to < width else p
            live = bound >= cosine - _SLACK
            i, j, p = i[live], j[live], p[live]
        x, y = _scaled(va[i]), _scaled(vb[j])
        exact = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
        live = exact >= cosine
        left.append(i[live])
        right.append(j[live])
    return np.concatenate(left), np.concatenate(right)


def _packed(v: np.ndarray) -> bytes:
    """Vectors as bytes, in single precision where that holds every value exactly."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"s" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    kind = np.float32 if data[:1] == b"s" else np.float64
    return np.frombuffer(data[1:], kind).astype(np.float64).reshape(-1, width)


def _pair(na, ia, ba, nb, ib, bb, same: bool, rotation: np.ndarray, cosine: float, width: int):
    """(index, links) and spanning edges of one pair of tiles; ids and copies as arrays, vectors as bytes."""
    va = _unpacked(ba, width)
    vb = va if same else _unpacked(bb, width)
    a = _unit(va) @ rotation
    b = a if same else _unit(vb) @ rotation
    i, j = compare(a, b, va, vb, cosine)
    keep = i < j if same else slice(None)
    i, j = i[keep], j[keep]
    ids = ia if same else np.concatenate([ia, ib])
    copies = na if same else np.concatenate([na, nb])
    j = j if same else j + len(ia)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    forest = Forest(len(ids))
    forest.union(i, j)
    src, dst = star(ids, forest.label)
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], src, dst


def near_duplicates(rows: DataFrame, id_col: str, vec_col: str, cosine: float) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row; see the module's text."""
    x = F.col("v").cast("array<double>")
    sound = (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) \
        & F.exists("v", lambda e: e != 0)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).select("id", x.alias("v"))
    rows = rows.select("id", F.when(sound, F.col("v")).alias("v"))
    # -0.0 and 0.0 are one value: a vector's key is a hash of its components plus zero
    plain = F.transform("v", lambda e: e + F.lit(0.0))
    named = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(plain)).alias("h1"),
                        F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), plain)).alias("h2"))
    named = written(named, "vectors")
    sound_rows = named.where("v is not null")
    distinct = written(sound_rows.groupBy("h1", "h2").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
        .withColumn("node", F.col("h1")), "distinct_vectors")
    widths = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]
    tables = [_links_of(distinct.where(F.size("v") == w), w, cosine) for w in sorted(widths)]
    spark = rows.sparkSession
    if not tables:
        pairs = spark.createDataFrame([], "kind int, a long, b long")
    else:
        pairs = tables[0]
        for t in tables[1:]:
            pairs = pairs.union(t)
    pairs = written(pairs, "pairs")
    links = pairs.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    found = components(pairs.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = distinct.select("h1", "h2", "node", "least", "copies").join(links, "node", "left").join(found, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = named.select("id", "h1", "h2").where("h1 is not null").join(nodes, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = named.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links_of(distinct: DataFrame, width: int, cosine: float) -> DataFrame:
    """(0, node, links) and (1, node, node) rows for the distinct vectors of one width."""
    rotation = axes(distinct, "v", width)
    box = min(BOX, width)
    strip = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    lead = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, rotation[:, k].tolist())), lambda p, q: p * q), F.lit(0.0),
                        lambda s, p: s + p) for k in range(1)]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, p: s + p * p))
    ordered = distinct.select("node", "copies", "v", (lead[0] / norm).alias("pc"))
    # tiles are runs of TILE places in the order of the first coordinate, whatever the partitions
    ordered = with_ordered_index(ordered, ["pc", "node"], name="place")
    ordered = ordered.withColumn("tile", F.floor(F.col("place") / TILE))

    def pack(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"].combine_chunks())
        u = _unit(v) @ rotation[:, :box]
        return pa.table({
            "tile": pa.array([table["tile"][0].as_py()], pa.int64()), "nodes": pa.array([table["node"].to_numpy()]),
            "copies": pa.array([table["copies"].to_numpy()]), "bytes": pa.array([_packed(v)], pa.binary()),
            "low": pa.array([u.min(0)]), "high": pa.array([u.max(0)])})

    tiles = written(ordered.select("tile", "node", "copies", "v").groupBy("tile").applyInArrow(
        pack, "tile long, nodes array<long>, copies array<long>, bytes binary, low array<double>, high array<double>"),
        "tiles")
    # strips of the first coordinate: a tile lies in all strips its range touches, and looks one to either side
    flat = tiles.select("tile", "low", "high", F.floor(F.col("low")[0] / strip).alias("s0"), F.floor(F.col("high")[0] / strip).alias("s1"))
    here = flat.select("tile", "low", "high", F.explode(F.sequence("s0", "s1")).alias("strip"))
    near = flat.select(F.col("tile").alias("other"), F.col("low").alias("olow"), F.col("high").alias("ohigh"),
                       F.explode(F.sequence(F.col("s0") - 1, F.col("s1") + 1)).alias("strip"))
    gap = F.zip_with(F.zip_with("low", "ohigh", lambda p, q: p - q), F.zip_with("olow", "high", lambda p, q: p - q),
                     lambda p, q: F.greatest(p, q, F.lit(0.0)))
    apart = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))
    paired = here.join(near, "strip").where(F.col("tile") <= F.col("other")).where(apart <= strip)
    paired = paired.select("tile", "other").distinct()
    one = tiles.select("tile", F.col("nodes").alias("ia"), F.col("copies").alias("na"), F.col("bytes").alias("ba"))
    two = tiles.select(F.col("tile").alias("other"), F.col("nodes").alias("ib"), F.col("copies").alias("nb"), F.col("bytes").alias("bb"))
    work = paired.join(one, "tile").join(two, "other").select("tile", "other", "ia", "na", "ba", "ib", "nb", "bb")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile, other, ia, na, ba, ib, nb, bb = (batch.column(c)[k] for c in range(8))
                ids, links, src, dst = _pair(
                    na.values.to_numpy(), ia.values.to_numpy(), ba.as_py(), nb.values.to_numpy(), ib.values.to_numpy(),
                    bb.as_py(), tile.as_py() == other.as_py(), rotation, cosine, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([0, 1], np.int32), [len(ids), len(src)])),
                     pa.array(np.concatenate([ids, src])), pa.array(np.concatenate([links, dst]))], names=["kind", "a", "b"])

    return work.mapInArrow(tidy(run), "kind int, a long, b long")
