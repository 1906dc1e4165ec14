"""Byte-level BPE encoding and decoding through a sentencepiece model made from the rank file.

The vocabulary (base64 token, rank) becomes a serialised sentencepiece ``ModelProto``: every token's
bytes are mapped one to one to printable code points, each piece is scored by its negative rank, and
the normaliser is the identity, so sentencepiece's best-scored merge is the lowest-ranked merge.
Texts are cut by the pre-token pattern and each pre-token is encoded on its own; ids are decoded by
the inverse byte mapping.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows each get
their own result; other columns of the input may have any name, they are passed through untouched;
an empty table gives an empty result. Nothing is truncated. A pre-token that is a vocabulary entry
as a whole takes that entry's id, as rank-based encoders do.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithos.llm.text import blocks, tidy

#: Distinct pre-tokens that a task remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 200_000


def byte_alphabet() -> list[str]:
    """One visible code point for every byte: printable Latin-1 stays, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    code = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(code[b]) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (``base64 rank`` a line); ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens) or len(set(tokens)) != len(tokens):
        raise ValueError(f"{path}: ranks are not 0..n-1, or a token is empty or repeated")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """A protobuf field: int as varint, float as fixed32, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece BPE model of ``tokens``: piece i has id i; one unknown piece follows."""
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    unknown = chr(0xE000).encode()
    out += _field(1, _field(1, unknown) + _field(2, 0.0) + _field(3, 2))
    #: trainer_spec: model type 2 is BPE, vocabulary size, unknown id and surface; no other control ids.
    none = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, none)
                  + _field(42, none) + _field(43, none) + _field(45, unknown))
    #: normalizer_spec: identity; no dummy prefix, no space removal, no space escape.
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec(dict):
    """Encoder and decoder of one task: a memory of pre-token -> ids, filled as pre-tokens are met."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        alphabet = byte_alphabet()
        self.space, self.mapped = alphabet[32], dict(enumerate(alphabet))

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        elif word.isascii() and word.isprintable():
            ids = self.model.EncodeAsIds(word.replace(" ", self.space))
        else:
            ids = self.model.EncodeAsIds(raw.decode("latin-1").translate(self.mapped))
        packed = self[word] = array("I", ids).tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, id_col: str, text_col: str, tokens: list[bytes], pattern: str,
                  ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row; with ``ids`` also the id array and
    the decoded text. ``tokens`` is the vocabulary in rank order: its size is that of a tokenizer and
    not of the data, and it travels with the task."""
    model = model_bytes(tokens)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if ids else ""

    def run(batches):
        codec = Codec(tokens, model, pattern)
        for batch in batches:
            key, column = batch.column(0), batch.column(1).fill_null("")
            for b in blocks(column):
                out = [codec.encode(x) for x in column.slice(b.lo, b.rows).to_pylist()]
                back = [codec.decode(x) for x in out]
                cols = [key.slice(b.lo, b.rows), pa.array([len(x) // 4 for x in out], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array([np.frombuffer(x, "<i4") for x in out], pa.list_(pa.int32())),
                             pa.array([x.decode() for x in back], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(id_col, text_col).mapInArrow(
        tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
