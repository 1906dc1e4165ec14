"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: majority of the bits of the XXH64 (seed 42) of all word shingles of the lower-cased text,
repeats included. Two fingerprints link if ``distance`` bits at most differ.

Search. Equal fingerprints are merged first. The 64 bits are cut into distance + 2 blocks; of two linked
fingerprints at least two blocks agree, so each fingerprint goes to one group per pair of blocks, keyed by
those bits. A group is sorted by Gray rank and indexed: runs of neighbours form nodes, whose mask and
pattern are the bits all members share, and runs of nodes form upper nodes. Pairs of nodes are walked
from the top; a pair goes when the bits that both fix already differ in more than ``distance`` places,
and when all of both already hang together. What remains is compared bit by bit. A group above ``part``
members is cut into parts, and each pair of parts is a group of its own, so that no task holds a whole
large group. Tasks hand on a spanning forest and not all pairs; components come from
``store.components``.

Defined results: null text counts as empty; fingerprint zero (no words) links like any other; rows that
repeat each get a row; ids may be null (then component_id is the smallest other id reachable, or null);
other columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithos.llm.store import Forest, components, star, written
from lithos.llm.text import Words, blocks, lowered, tidy

#: Members of an index node.
FAN = 16
#: Members of a group that one task indexes as a whole; larger groups are cut.
PART = 2048
#: Rows that a task holds before it links those of whole groups; a group has twice ``PART`` at most.
HELD_ROWS = 1 << 19
_PAIRS = 1 << 14


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints (uint64) of the rows of a block."""
    from xxhash import xxh64_intdigest

    low = lowered(raw)
    words = Words(low, offsets)
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    if not len(words):
        return out
    # one space after each word: shingles are then slices of one buffer
    length = words.end - words.start
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(length + 1, out=begin[1:])
    flat = np.full(begin[-1], 32, np.uint8)
    at = np.repeat(words.start - begin[:-1], length + 1) + np.arange(begin[-1])
    at[begin[1:] - 1] = 0
    flat[:] = low[at]
    flat[begin[1:] - 1] = 32
    count = np.diff(words.first)
    made = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    first = np.repeat(words.first[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(first + shingle, np.repeat(words.first[1:], made)) - 1
    view = memoryview(flat)
    h = np.fromiter((xxh64_intdigest(view[a:b], 42) for a, b in zip(begin[first].tolist(), (begin[last + 1] - 1).tolist())),
                    np.uint64, len(first))
    full = np.flatnonzero(made)
    cuts = (np.cumsum(made) - made)[full]
    ends = np.append(cuts[1:], len(h))
    ones = np.empty((len(full), 64), np.int64)
    step = 1 << 16
    lo = 0
    while lo < len(full):  # whole rows, about ``step`` shingles at a time
        hi = max(lo + 1, int(np.searchsorted(ends, cuts[lo] + step, "right")))
        bits = np.unpackbits(h[cuts[lo]:ends[hi - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[lo:hi] = np.add.reduceat(bits, cuts[lo:hi] - cuts[lo], axis=0, dtype=np.int64)
        lo = hi
    major = (2 * ones > made[full, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, keys: list[str], text_col: str, shingle: int) -> DataFrame:
    """The key columns and ``fp`` (the fingerprint's bits as a long) of every row."""
    kept = docs.select(*keys, F.col(text_col).alias("_text"))
    names = [*keys, "fp"]

    def run(batches):
        for batch in batches:
            column = batch.column(len(keys))
            for b in blocks(column):
                fp = fingerprints_of(b.raw, b.offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(b.lo, b.rows) for k in range(len(keys))), pa.array(fp)], names=names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(tidy(run), f"{types}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of ``x`` in the reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _levels(x: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index levels over entries sorted by (group, Gray rank), leaves first: (begin, pattern, mask).
    ``begin`` holds each node's first child and ends with the number of children; the nodes of one
    group are neighbours, and on the last level every group is one node."""
    levels, pattern, mask, owner = [], x, np.full(len(x), ~np.uint64(0)), group
    while True:
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        begin = np.flatnonzero(place % FAN == 0)
        size = np.diff(np.append(begin, len(owner)))
        lead = np.repeat(pattern[begin], size)
        mask = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), begin)
        pattern = pattern[begin]
        levels.append((np.append(begin, len(owner)), pattern, mask))
        owner = owner[begin]
        if len(begin) == len(head):
            return levels


def _children(begin: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of u and a child of v, each unordered pair once if u is v."""
    nu, nv = begin[u + 1] - begin[u], begin[v + 1] - begin[v]
    n = nu * nv
    which = np.repeat(np.arange(len(u)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = begin[u][which] + k // nv[which], begin[v][which] + k % nv[which]
    keep = (u != v)[which] | (a <= b)
    return a[keep], b[keep]


def link(x: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the entries of each group: arrays (member, smallest linked fingerprint)."""
    ids, entry = np.unique(x.view(np.int64), return_inverse=True)
    order = np.lexsort((gray_rank(x), group))
    x, group, entry = x[order], group[order], entry[order]
    levels, forest = _levels(x, group), Forest(len(ids))

    def single(begin):
        """Component of each leaf whose members all hang together, else -1 and below, each its own."""
        label = forest.label[entry]
        low, high = np.minimum.reduceat(label, begin[:-1]), np.maximum.reduceat(label, begin[:-1])
        return np.where(low == high, low, -1 - np.arange(len(low)))

    tops = np.arange(len(levels[-1][1]))
    todo = [(len(levels) - 1, tops[lo:lo + _PAIRS], tops[lo:lo + _PAIRS]) for lo in range(0, len(tops), _PAIRS)]
    while todo:
        level, u, v = todo.pop()
        begin = levels[level][0]
        if level == 0:
            own = single(begin)
            live = own[u] != own[v]
            live |= (u == v) & (own[u] < 0)
            u, v = u[live], v[live]
            if not len(u):
                continue
        a, b = _children(begin, u, v)
        if level:
            _, pattern, mask = levels[level - 1]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            a, b = a[near], b[near]
            todo += [(level - 1, a[lo:lo + _PAIRS], b[lo:lo + _PAIRS]) for lo in range(0, len(a), _PAIRS)]
        else:
            near = (a != b) & (np.bitwise_count(x[a] ^ x[b]) <= distance)
            forest.union(entry[a[near]], entry[b[near]])
    return star(ids, forest.label)


def links(distinct: DataFrame, distance: int, part: int = PART) -> DataFrame:
    """Spanning links (src, dst) among the distinct fingerprints of column ``fp``."""
    n = distance + 2
    edges = [64 * k // n for k in range(n + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(n)]
    both = [masks[i] | masks[j] for i, j in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in both]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed)))
                            .alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    sizes = sizes.select("t", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    cut = keyed.join(sizes, ["t", "key"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    tasks = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(others, lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o)))
    cut = cut.select("t", "key", "fp", F.explode(tasks).alias("task"))

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def linked(keep_last: bool):
            """Links among the owners held, but for the last one, which may have more rows to come."""
            fp, owner = (np.concatenate(c) for c in zip(*held))
            end = int(np.searchsorted(owner, owner[-1])) if keep_last else len(owner)
            held[:] = [(fp[end:], owner[end:])] if end < len(owner) else []
            a, b = link(fp[:end].view(np.uint64), owner[:end], distance) if end else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)))
                if sum(len(fp) for fp, _ in held) >= HELD_ROWS:
                    yield linked(True)
        if held:
            yield linked(False)

    dealt = cut.select("fp", F.xxhash64("t", "key", "task").alias("owner"))
    return dealt.repartition("owner").sortWithinPartitions("owner").mapInArrow(tidy(run), "src long, dst long")


def cluster(docs: DataFrame, keys: list[str], id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """The key columns (``id_col`` among them), ``fp``, ``component`` (a long that names the group) and
    ``component_id`` (the smallest id of the group) of every row."""
    rows = written(fingerprints(docs, keys, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    found = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    named = distinct.join(found, "fp", "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component"), "fp")


def one_of_each(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """``docs``, all columns, with one row of each group: the smallest id (a null id only in a group
    without others), among rows of that id the smallest hash of all columns; of equal rows one."""
    columns = docs.columns
    row = F.xxhash64(*columns)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    found = cluster(keyed, ["id", "row"], "id", "text", shingle, distance)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    best = best.select(F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row")).distinct()
    mark = next(f"row_{k}" for k in range(len(columns) + 1) if f"row_{k}" not in columns)
    marked = docs.withColumn(mark, row)
    kept = marked.join(best, marked[id_col].eqNullSafe(best["best_id"]) & (marked[mark] == best["best_row"]), "left_semi")
    return kept.dropDuplicates([id_col, mark]).select(*columns)
