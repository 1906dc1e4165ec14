"""Object <-> JSON (SCL-7): documents are JSON text in the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document_json(struct_col) -> Column:
    """Nested struct -> JSON text; NULL fields are left out (an unset uuid is absent)."""
    return F.to_json(_col(struct_col))


def document_keys(doc) -> Column:
    """Top-level keys of a JSON document (NULL when the text is not a JSON object)."""
    return F.json_object_keys(_col(doc))


def parse_document(doc, schema: str | None = None) -> Column:
    """JSON text -> a struct of a known schema, or a VARIANT when no schema is given."""
    return F.from_json(_col(doc), schema) if schema else F.parse_json(_col(doc))


# A string with the colon that makes it a key, a string that is a value, or what lies between strings. The runs are
# possessive, so the JVM matches a string of any length without recursion.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKENS = rf'(?s){_STRING}\s*+:|{_STRING}|[^"]++'


def _tokens(doc: Column) -> Column:
    return F.regexp_extract_all(doc, F.lit(_TOKENS), F.lit(0))


def marked(doc) -> Column:
    """The JSON text with an ``s`` before the content of every string value. Nested values that are read as text keep
    their document order and repeated keys; the mark tells a string from the object, number or word it may look like."""
    return F.array_join(F.transform(_tokens(_col(doc)), lambda t: F.when(
        t.startswith('"') & t.endswith('"'), F.concat(F.lit('"s'), F.substring(t, F.lit(2), F.length(t)))).otherwise(t)), "")


def nesting(doc) -> Column:
    """Greatest depth of objects and arrays in a JSON text."""
    plain = F.array_join(F.filter(_tokens(_col(doc)), lambda t: ~t.startswith('"')), "")
    brackets = F.regexp_extract_all(plain, F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda b: F.when(b.isin("{", "["), F.lit(1)).otherwise(F.lit(-1))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, b: F.struct(
        (s["now"] + step(b)).alias("now"), F.greatest(s["most"], s["now"] + step(b)).alias("most")))["most"]


def marked_kind(text) -> Column:
    """Kind of a value in marked text: object, array, string, number, integer, boolean, null."""
    t = _col(text)
    first = F.substring(F.ltrim(t), 1, 1)
    return (F.when(t.isNull() | (F.trim(t) == "null"), "null").when(first == "{", "object").when(first == "[", "array")
            .when(first.isin("s", '"'), "string").when(F.trim(t).isin("true", "false"), "boolean")
            .when(F.trim(t).rlike(r"^-?[0-9]+$"), "integer").otherwise("number"))


def marked_children(text) -> Column:
    """array<struct<key, text>> of a marked object or array in document order (key NULL in an array); NULL for other
    values. Of a key that an object repeats the last value counts, at the place of the first."""
    t = _col(text)

    def of(entries):
        keys, values = F.map_keys(entries), F.map_values(entries)
        each = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
        last = F.transform(F.array_distinct(keys), lambda k: F.struct(
            k.alias("key"), F.get(values, (F.size(keys) - F.array_position(F.reverse(keys), k)).cast("int")).alias("text")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), each).otherwise(last)

    # the array of one keeps the parsed entries for all that is asked of them
    fields = F.get(F.transform(F.array(F.from_json(t, "map<string,string>")), of), 0)
    items = F.transform(F.from_json(t, "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("text")))
    first = F.substring(F.ltrim(t), 1, 1)
    return F.when(first == "{", fields).when(first == "[", items)
