"""Object documents as rows: every value of a JSON text with its path and kind.

Two ways down, both inside one plan and without a shuffle:

* ``fields`` parses a document into a VARIANT once. That is quick, but a VARIANT sorts the keys of an object and refuses
  one that repeats a key.
* ``nodes`` reads nested values as text, which keeps the order of keys and repeated keys (the last value counts). It
  takes documents of any kind.

Both open a document level by level while it is one row, an array of values a level, and make rows of its values once,
at the end: a value is handled twice (as a value, as a parent), however deep the documents are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.jsondoc import marked, marked_children, marked_kind


_COLUMNS = ("at", "path", "parent", "key", "kind", "keys")


def _kind_of(name) -> Column:
    """Kind of a VARIANT value by its type's name."""
    return (F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "VOID", "null").when(name == "BOOLEAN", "boolean")
            .when((name == "BIGINT") | name.endswith(",0)"), "integer").otherwise("number"))


def variant_kind(v) -> Column:
    """Kind of a VARIANT value: object, array, string, number, integer, boolean, null."""
    return _kind_of(F.schema_of_variant(v))


def _opened(documents: DataFrame, keep: Sequence[str], root: Column, depth: int, children: Callable[[Column], Column],
            row: Callable[[Column], Column], want: Callable[[Column], Column] | None = None) -> DataFrame:
    """``keep`` and ``n``: ``row`` of ``root`` and of every value (that ``want`` takes) down to ``depth`` levels below it.

    Each level is a projection of its own: its array is read twice, and one projection would compute it anew each time."""
    level, done = documents.select(*keep, F.array(root).alias("__level")), []
    for i in range(depth + 1):
        these = F.filter("__level", want) if want else F.col("__level")
        below = [F.flatten(F.transform("__level", children)).alias("__level")] if i < depth else []
        level = level.select(*keep, *done, F.transform(these, row).alias(f"__d{i}"), *below)
        done.append(f"__d{i}")
    # exploded as an expression: of a column, Spark would ask beforehand whether it is empty, and compute it for that too
    return level.select(*keep, F.explode(F.concat(*done)).alias("n"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def fields(documents: DataFrame, depth: int, keep: Sequence[str] = ("id", "version_id"), doc_col: str = "document") -> DataFrame:
    """``keep`` and ``at``, ``path``, ``parent``, ``key``, ``kind``, ``keys`` (as of :func:`nodes`) of every value down to
    ``depth`` levels, for documents that repeat no key; in no order."""
    none = F.lit(None).cast("string")

    def value(at, path, parent, key, v):
        return F.struct(at.alias("at"), path.alias("path"), parent.alias("parent"), key.alias("key"), v.alias("v"))

    def below(n, key, step, v):
        return value(F.concat(n["at"], F.lit("/"), step), F.concat(n["path"], F.lit("/"), F.lit("[]") if key is none else step), n["path"], key, v)

    def children(n):
        items = F.transform(n["v"].try_cast("array<variant>"), lambda x, i: below(n, none, i.cast("string"), x))
        return F.coalesce(_let(n["v"].try_cast("map<string,variant>"), lambda m: F.transform(
            F.map_entries(m), lambda e: below(n, e["key"], _escaped(e["key"]), e["value"]))), items, F.array())

    def row(n):
        # the type of an object or array would be put together from all that lies in it
        return _let(F.map_keys(n["v"].try_cast("map<string,variant>")), lambda keys: F.struct(
            n["at"].alias("at"), n["path"].alias("path"), n["parent"].alias("parent"), n["key"].alias("key"), keys.alias("keys"),
            F.when(keys.isNotNull(), "OBJECT").when(n["v"].try_cast("array<variant>").isNotNull(), "ARRAY")
            .otherwise(F.schema_of_variant(n["v"])).alias("name")))

    root = value(F.lit(""), F.lit(""), none, none, F.try_parse_json(doc_col))
    return _opened(documents, keep, root, depth, children, row).select(
        *keep, "n.at", "n.path", "n.parent", "n.key", _kind_of(F.col("n.name")).alias("kind"), "n.keys")


# What a JSON text can be: an object, an array or a string, or one of the short values as a whole.
_START = r"""^\s*(?:[\[{"]|(?:true|false|null|-?[0-9][0-9.eE+-]*)\s*$)"""


def _escaped(key: Column) -> Column:
    """A key as a path step (``~`` and ``/`` written as JSON pointers do)."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def nodes(documents: DataFrame, depth: int, keep: Sequence[str] = ("id", "version_id"), doc_col: str = "document",
          key: str | None = None) -> DataFrame:
    """One row for every value down to ``depth`` levels below the root: ``keep``, ``at`` (path with array positions),
    ``path`` (array steps as ``[]``), ``parent`` (path of the value it lies in, NULL for the root), ``key``, ``kind``,
    ``text`` (strings with a leading ``s``), ``keys`` (of an object), ``ord`` (sorts in document order). A text that is
    no JSON has one row of kind ``invalid``. With ``key`` only the values under that key, at any depth, become rows."""
    text = marked(F.col(doc_col))
    broken = F.col(doc_col).isNull() | ~F.col(doc_col).rlike(_START) | (
        marked_kind(F.col("m")).isin("object", "array") & marked_children(F.col("m")).isNull())
    none = F.lit(None).cast("string")
    texts = documents.select(*keep, doc_col).withColumn("m", text).select(*keep, "m", broken.alias("__broken"))
    root = F.struct(
        F.lit("").alias("at"), F.lit("").alias("path"), none.alias("parent"), none.alias("key"), F.col("m").alias("text"),
        F.array().cast("array<int>").alias("ord"), F.col("__broken").alias("broken"))

    def children(n):
        below = F.transform(marked_children(n["text"]), lambda c, i: F.struct(
            F.concat(n["at"], F.lit("/"), F.coalesce(_escaped(c["key"]), i.cast("string"))).alias("at"),
            F.concat(n["path"], F.lit("/"), F.coalesce(_escaped(c["key"]), F.lit("[]"))).alias("path"),
            n["path"].alias("parent"), c["key"].alias("key"), c["text"].alias("text"),
            F.array_append(n["ord"], i).alias("ord"), F.lit(False).alias("broken")))
        return F.coalesce(F.when(~n["broken"], below), F.array())

    rows = _opened(texts, keep, root, depth, children, lambda n: n, (lambda n: n["key"] == key) if key is not None else None)
    kind = F.when(F.col("n.broken"), "invalid").otherwise(marked_kind(F.col("n.text")))
    return rows.select(*keep, "n.at", "n.path", "n.parent", "n.key", kind.alias("kind"), "n.text", F.when(
        kind == "object", F.map_keys(F.from_json("n.text", "map<string,string>"))).alias("keys"), "n.ord")
