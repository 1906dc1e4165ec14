"""Operators over many objects at once: every result carries the object's key and starts anew in each object.

The tables of all objects come as one DataFrame with a key column. Rows are dealt to tasks by ranges of the object's
hash (``deal``), so that all rows of an object meet in one task: dictionary keys, hole keys, positions and offsets are
windows inside the object, and tables dealt alike join without a further shuffle. Objects with more than ``HOT_ROWS``
rows in a table are kept apart (``hot``): theirs are ranks along (object, ...) less the object's first rank
(``position.with_segmented_index``), which spreads them over tasks. The gate is one aggregate grouped by object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators.encode import category_text
from lithos.operators.holes import hole_text
from lithos.operators.position import RANGE_BYTES, input_bytes, materialize, with_segmented_index, with_segmented_prefix_sum

#: Name of the object key in every result.
OBJECT = "object"
#: Name of the object's part of its array ids, which sorts as the objects are dealt.
ID = "__id"
_HASH, _PART = "__hash", "__part"
#: What rows dealt by object are grouped by.
_GROUP = [_HASH, OBJECT, _PART]
_HASH_BITS = 62

#: Rows of an object in one table beyond which the object is spread over tasks.
HOT_ROWS = 1 << 17
#: Bytes of input files behind one part of a small table.
_LEAST_BYTES = 2 << 20


def _hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64(OBJECT), 64 - _HASH_BITS)


def object_id() -> Column:
    """32 digits of an object, in the order in which ``deal`` puts objects; the first keeps the hash at 16 digits."""
    return F.concat(F.hex(_hash() + F.lit(1 << _HASH_BITS)), F.substring(F.sha2(OBJECT, 256), 1, 16))


def parts(df: DataFrame) -> int:
    """Tasks that ``df`` is dealt to: RANGE_BYTES of its source files each, fewer bytes up to the session's shuffle
    partition number, which also holds for a source of unknown size."""
    size, few = input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = -(-size // RANGE_BYTES)
    return max(1, min(few, -(-size // _LEAST_BYTES)), many if many < 1 << 20 else few)


def deal(df: DataFrame, n: int) -> DataFrame:
    """Rows in ``n`` tasks, each with a range of the objects' hashes. Hashes spread evenly, so no row is sampled for it."""
    width = -(-(1 << _HASH_BITS) // n)
    # the planner would drop a constant from a window's key: where a table's one object is given by name, the key is this
    open_part = F.expr(f"cast({_HASH} div {width} as int)").bitwiseOR(F.spark_partition_id().bitwiseAND(F.lit(0)))
    return df.withColumn(_HASH, _hash()).withColumn(_PART, open_part).repartitionById(n, F.col(_PART))


def hot_objects(tables: Sequence[DataFrame]) -> list[str]:
    """Objects with more than HOT_ROWS rows in one of the tables: so many rows for each name that comes here."""
    names = None
    for df in tables:
        one = df.groupBy(OBJECT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select(OBJECT)
        names = one if names is None else names.unionByName(one)
    return sorted({r[0] for r in names.collect()})


def placed(df: DataFrame, order: Sequence, name: str, keep: Sequence[str], among: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """Rows with ``ID``, ``keep`` (OBJECT among them) and ``name`` = their position along ``order`` in their object,
    written once; not hot ones in files that each hold a range of ids in order. ``among``: distinct objects, rows of
    others are left out."""
    columns = [F.col(f"`{c}`") for c in (ID, *keep, name)]
    if hot:
        df = df if among is None else df.join(among, OBJECT, "left_semi")
        ranked = with_segmented_index(df, [OBJECT], list(order), name=name, keep=list(keep))
        return materialize(ranked.withColumn(ID, object_id()).select(*columns))
    texts = {f"__o{i}": c for i, c in enumerate(order) if isinstance(c, Column)}
    by = [f"__o{i}" if isinstance(c, Column) else c for i, c in enumerate(order)]
    n = parts(df)
    rows = deal(df.withColumns(texts) if texts else df, n)
    if among is None:
        rows = rows.withColumn(ID, object_id())
    else:  # a task's objects, each once; a semi join would be made before the rows are dealt, with a shuffle of its own
        rows = rows.join(deal(among.select(OBJECT, object_id().alias(ID)), n).hint("shuffle_hash"), _GROUP)
    at = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*by)).cast("long") - 1
    return materialize(rows.withColumn(name, at).select(*columns))


def _keys(rows: DataFrame) -> list[str]:
    """The columns of ``rows`` that name its objects."""
    return [c for c in (ID, OBJECT) if c in rows.columns]


def _met(left: DataFrame, right: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    """``left`` and ``right`` joined on (object, value), dealt alike."""
    n = max(parts(left), parts(right))
    right = deal(right, n)
    return deal(left, n).join(right.hint(hint) if hint else right, [*_GROUP, "value"], how)


def keyed(df: DataFrame, object_col: str) -> DataFrame:
    """``df`` with its object key as text under ``OBJECT``; a NULL key is the object ''."""
    key = F.coalesce(F.col(f"`{object_col}`").cast("string"), F.lit(""))
    if object_col == OBJECT:
        return df.withColumn(OBJECT, key)
    if OBJECT in df.columns:
        raise ValueError(f"the table has a column '{OBJECT}' that is not its object key")
    return df.withColumn(OBJECT, key)


def lookups(rows: DataFrame, columns: Sequence[str], order_col: str, hot: bool = False) -> DataFrame:
    """SEQ-1 for every category column of every object: (id, object, attribute, key, value), keys from 1 in order of
    first appearance in the object. One unpivoted aggregate, one ranking, written once."""
    each = [F.struct(F.lit(c).alias("attribute"), category_text(rows, c).alias("value")) for c in columns]
    long = rows.select(OBJECT, F.col(order_col).alias("__o"), (F.explode(F.array(*each)) if len(each) > 1 else each[0]).alias("a"))
    firsts = long.groupBy(OBJECT, "a.attribute", "a.value").agg(F.min("__o").alias("first"))
    if hot:
        ranked = with_segmented_index(firsts, [OBJECT, "attribute"], ["first", "value"], name="k", start=1)
    else:
        ranked = deal(firsts, parts(rows)).withColumn("k", F.row_number().over(
            Window.partitionBy(*_GROUP, "attribute").orderBy("first", "value")))
    return materialize(ranked.select(object_id().alias(ID), OBJECT, "attribute", F.col("k").cast("int").alias("key"), "value"))


def codes(rows: DataFrame, column: str, lookup: DataFrame, pos_col: str, hot: bool = False) -> DataFrame:
    """JN-1: (object, pos, data) of one category column."""
    v = rows.select(*_keys(rows), F.col(pos_col).alias("pos"), category_text(rows, column).alias("value"))
    mine = lookup.filter(F.col("attribute") == column).select(OBJECT, "value", F.col("key").alias("data"))
    # a task's part of the lookup has no more rows than its part of the table
    both = v.join(mine, [OBJECT, "value"]) if hot else _met(v, mine, hint="shuffle_hash")
    return both.select(*_keys(rows), "pos", "data")


def hole_indexes(collar: DataFrame, collar_id: str, tables: dict[str, tuple[DataFrame, str]],
                 hot: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """SEQ-2 + SEQ-3 of every object in one ranked pass: (lookup, {name: index}).

    Lookup: (id, object, key, value), the object's collar holes in text order. Index: (id, object, hole_index, offset, count)
    of the object's rows sorted by hole; rows of holes without a collar keep their place (JN-4). A table that stands
    under several names is read once."""
    names, zero = list(tables), F.lit(0).cast("long")
    sides = [collar.select(OBJECT, hole_text(collar, collar_id).alias("value"), F.lit(1).cast("long").alias("__in"),
                           *[zero.alias(f"__n{i}") for i in range(len(names))])]
    for i, name in enumerate(names):
        df, col = tables[name]
        same = [tables[n][0] is df and tables[n][1] == col for n in names]
        if same.index(True) == i:
            sides.append(df.select(OBJECT, hole_text(df, col).alias("value"), zero.alias("__in"),
                                   *[F.lit(int(x)).cast("long").alias(f"__n{j}") for j, x in enumerate(same)]))
    union = sides[0]
    for p in sides[1:]:
        union = union.unionByName(p)
    sums, before = [f"__n{i}" for i in range(len(names))], ["__k", *[f"__o{i}" for i in range(len(names))]]
    holes = union.groupBy(OBJECT, "value").agg(F.max("__in").alias("__in"), *[F.sum(s).alias(s) for s in sums])
    if hot:
        ranked = with_segmented_prefix_sum(holes, [OBJECT], ["value"], ["__in", *sums], before)
    else:
        w = Window.partitionBy(*_GROUP).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ranked = deal(holes, parts(union)).select(OBJECT, "value", "__in", *sums, *[
            F.coalesce(F.sum(s).over(w), zero).alias(b) for s, b in zip(["__in", *sums], before, strict=True)])
    known = materialize(ranked.filter(F.col("__in") == 1).withColumn(ID, object_id()))
    key = (F.col("__k") + 1).cast("int")
    index = {name: known.select(
        ID, OBJECT, key.alias("hole_index"), F.when(F.col(f"__n{i}") > 0, F.col(f"__o{i}")).otherwise(F.lit(0)).cast("long").alias("offset"),
        F.col(f"__n{i}").cast("long").alias("count")) for i, name in enumerate(names)}
    return known.select(ID, OBJECT, key.alias("key"), "value"), index


def collar_keys(collar: DataFrame, collar_id: str, lookup: DataFrame, pos_col: str, hot: bool = False) -> DataFrame:
    """JN-2: (object, pos, data) of every collar."""
    rows = collar.select(*_keys(collar), F.col(pos_col).alias("pos"), hole_text(collar, collar_id).alias("value"))
    mine = lookup.select(OBJECT, "value", F.col("key").alias("data"))
    return (rows.join(mine, [OBJECT, "value"]) if hot else _met(rows, mine)).select(*_keys(collar), "pos", "data")


def distances(collar: DataFrame, survey: DataFrame, collar_id: str, survey_id: str, depth_col: str, pos_col: str,
              hot: bool = False) -> DataFrame:
    """JN-3 + SNK-9: (object, pos, final, target, current); a hole without survey rows has 0."""
    deepest = survey.groupBy(OBJECT, hole_text(survey, survey_id).alias("value")).agg(
        F.max(F.col(f"`{depth_col}`")).cast("double").alias("d"))
    rows = collar.select(*_keys(collar), F.col(pos_col).alias("pos"), hole_text(collar, collar_id).alias("value"))
    d = F.coalesce(F.col("d"), F.lit(0.0))
    return (rows.join(deepest, [OBJECT, "value"], "left") if hot else _met(rows, deepest, "left")).select(
        *_keys(collar), "pos", d.alias("final"), d.alias("target"), d.alias("current"))


def bad_end(column: str, vertices: Column) -> Column:
    """Whether a segment end is no whole number in [0, vertices)."""
    v = F.col(f"`{column}`").cast("double")
    return v.isNull() | F.isnan(v) | (v < 0) | (v >= vertices) | (v != F.floor(v))


def segment_index_check(vertices: DataFrame, segments: DataFrame, start: str, end: str) -> DataFrame:
    """FLT-3 for every object against its own vertices: (object, vertices, segments, max_start, max_end, bad_start,
    bad_end) of every object that has vertices or segments. The segments meet one row an object."""
    n = vertices.groupBy(OBJECT).agg(F.count(F.lit(1)).alias("vertices"))
    s = segments.select(OBJECT, F.col(f"`{start}`").alias("__s"), F.col(f"`{end}`").alias("__e")).join(n, OBJECT, "left")
    s = s.withColumn("__n", F.coalesce("vertices", F.lit(0)))
    per = s.groupBy(OBJECT).agg(
        F.count(F.lit(1)).alias("segments"), F.max("__s").cast("double").alias("max_start"), F.max("__e").cast("double").alias("max_end"),
        F.count_if(bad_end("__s", F.col("__n"))).alias("bad_start"), F.count_if(bad_end("__e", F.col("__n"))).alias("bad_end"))
    zero = F.lit(0).cast("long")
    return n.join(per, OBJECT, "full").select(
        OBJECT, F.coalesce("vertices", zero).alias("vertices"), F.coalesce("segments", zero).alias("segments"), "max_start", "max_end",
        F.coalesce("bad_start", zero).alias("bad_start"), F.coalesce("bad_end", zero).alias("bad_end"))
