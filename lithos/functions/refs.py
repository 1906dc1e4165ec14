"""Blob references inside object documents (SCL-6).

Every string value under a key named ``data``, at any depth, in document order, repeats kept. The text is read string
by string from its start, a key together with the string that follows it, so a quote never opens in the middle of a
string; a key is compared after its escapes are undone, so ``"d\\u0061ta"`` counts. Non-string ``data`` values are
objects or arrays whose inner keys are read like any others, which is the descent the definition asks for.

The one thing that reading in sequence cannot decide is a key that an object repeats, of which the last value counts:
``operators.catalog.document_references`` sends such documents through ``operators.documents.nodes``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive runs of plain characters and escapes: the JVM matches them without recursion, so a
# value may be of any length.
_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
# A string, with the string after its colon where there is one.
_PAIRS = rf'(?s)"{_BODY}"(?:\s*+:\s*+"{_BODY}")?+'
# The same with the two bodies apart; the key is ``data`` or has an escape.
_PAIR = rf'(?s)^"(data|(?=[^"]*\\){_BODY})"\s*+:\s*+"({_BODY})"$'


def unescaped(text: Column) -> Column:
    """The value of a JSON string body (between its quotes): escapes undone. A body that is no valid
    JSON string stays as it is."""
    plain = F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string")["v"]
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.coalesce(plain, text))


def data_references(doc) -> Column:
    """array<string> of referenced blob ids, in document order."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    pairs = F.filter(F.regexp_extract_all(doc, F.lit(_PAIRS), F.lit(0)), lambda t: t.rlike(_PAIR))
    named = F.filter(pairs, lambda t: unescaped(F.regexp_extract(t, _PAIR, 1)) == "data")
    return F.transform(named, lambda t: unescaped(F.regexp_extract(t, _PAIR, 2)))
