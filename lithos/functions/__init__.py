"""Column expressions. Every function returns a ``Column`` built from built-in
Spark functions, so it stays inside whole-stage codegen; nothing here is a UDF."""

from lithos.functions.jsondoc import document_json, document_keys, parse_document
from lithos.functions.numeric import coerce_double, is_finite, is_missing, not_missing
from lithos.functions.refs import data_references
from lithos.functions.text import NA_WORDS, attribute_key, attribute_key_of, clean_text, na_to_null
from lithos.functions.timefmt import iso_timestamp

__all__ = [
    "NA_WORDS", "attribute_key", "attribute_key_of", "clean_text", "coerce_double",
    "data_references", "document_json", "document_keys", "parse_document", "is_finite", "is_missing", "iso_timestamp", "na_to_null", "not_missing",
]
