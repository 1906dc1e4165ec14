"""Repeated passages by a sparse suffix array.

Of all word positions only minimiser positions keep their suffix: of every ``SPREAD`` neighbouring ``GRAM``-word
hashes the smallest one marks its place, so any two copies of a passage of ``least`` words keep the same
positions, the first at most SPREAD - 1 words in. The kept suffixes are sorted by their first ``prefix`` words
(all that a passage of ``least`` words has to offer behind its first kept position) over the whole corpus and
compared with their neighbours. Suffixes equal to a neighbour are extended to the left and right: every stretch
of ``least`` words around them is sorted and compared in the same way, and neighbouring stretches that repeat
join to maximal passages.

First places are decided stretch by stretch. Stretches in a row that one document holds first are a passage's
origin, labelled by their smallest hash, and a third turn over the shards tells every other place of these stretches
that label. A maximal passage is told with its parts, one for each origin it runs through, so that all places of a
stretch share a label however their passages overlap.

Documents are dealt by hash into chunks of bounded size, which send each shard of the sorted order their
distinct keys once a turn; a passage in a third of all documents costs one entry a chunk. The order is that of 64-bit
hashes of the words, cut into equal ranges, the shards; keys travel Elias-Fano coded and the answers as one byte
each, labels as eight. The text is shuffled once, by chunk, and read four times from there.

Defined results: words are runs of bytes outside white space, case counts; null and empty texts and documents
shorter than ``least`` words have no row; of the occurrences of a stretch the first (by chunk, then id, nulls
last, then text) is marked; rows that repeat each get their rows; other columns are ignored; an empty table
gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithos.llm.eliasfano import EliasFano
from lithos.llm.text import SpanHash, Words, blocks, window_hash

GRAM, SPREAD = 8, 18
#: Text bytes of a chunk; a shard holds the share of one chunk of all keys.
CHUNK_BYTES = 6 << 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each row's first word)."""
    parts, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in blocks(column):
        words = Words(b.raw, b.offsets)
        if len(words):
            parts.append(SpanHash(b.raw)(words.start, words.end))
        lengths.append(np.diff(words.first))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


class Suffixes:
    """Kept suffixes of a chunk, and later the stretches around those that repeat."""

    def __init__(self, h: np.ndarray, first: np.ndarray, least: int, within: bool):
        self.h, self.first, self.least, self.within = h, first, least, within
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[self.row + 1]
        prefix = least - SPREAD + 1
        gram = window_hash(h, GRAM)
        self.kept = np.zeros(0, np.int64)
        #: for every place the minimiser of the SPREAD hashes from there on; it depends on these words alone
        self.minimiser = np.full(len(h), len(h), np.int64)
        if len(gram) >= SPREAD:
            view = np.lib.stride_tricks.sliding_window_view(gram, SPREAD)
            at = np.arange(len(view)) + view.argmin(1)
            inside = self.row[:len(view)] == self.row[SPREAD + GRAM - 2:]
            self.minimiser[:len(view)][inside] = at[inside]
            mark = np.zeros(len(h), bool)
            mark[at[inside]] = True
            mark &= np.arange(len(h)) + prefix <= self.end
            self.kept = np.flatnonzero(mark)
        self.keys, self.key, self.times = self._counted(window_hash(h, prefix)[self.kept], self.kept)

    def _counted(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, number of each place's hash, how often each occurs): places, or documents
        that hold it where repeats within a document do not count."""
        keys, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
        if not self.within and len(keys):
            pairs = np.unique(number * np.int64(len(self.first)) + self.row[at])
            times = np.bincount(pairs // len(self.first), minlength=len(keys))
        return keys, number, times

    def stretches(self, codes: np.ndarray) -> None:
        """Set ``begin``: the stretches of ``least`` words whose own kept suffix repeats."""
        h = self.h
        repeats = np.zeros(len(h) + 1, bool)
        repeats[self.kept] = codes[self.key] > 0
        self.begin = np.flatnonzero((np.arange(len(h)) + self.least <= self.end) & repeats[self.minimiser])
        self.windows, self.window, self.window_times = self._counted(window_hash(h, self.least)[self.begin], self.begin)

    def origins(self, codes: np.ndarray) -> None:
        """Set, by the windows' codes, ``live``: the stretches that repeat, ``own``: which of them stand at their
        first place, ``label``: of each window with its first place here the smallest hash of its run of such
        stretches, and ``sure``: which windows have one."""
        self.live = np.flatnonzero(codes[self.window] > 0)
        begin, window = self.begin[self.live], self.window[self.live]
        place = np.full(len(self.windows), len(self.h), np.int64)
        np.minimum.at(place, window, begin)
        self.own = (codes[window] == 1) & (begin == place[window])
        self.sure = codes == 1
        self.label = np.zeros(len(self.windows), np.uint64)
        mine = np.flatnonzero(self.own)
        if len(mine):
            head = self.heads(begin[mine])
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(mine))))
            self.label[window[mine]] = self.windows[np.minimum.reduceat(window[mine], head)][run]

    def heads(self, begin: np.ndarray, *same: np.ndarray) -> np.ndarray:
        """Where runs of neighbouring stretches of a document start that also agree in ``same``."""
        if not len(begin):
            return np.zeros(0, np.int64)
        row = self.row[begin]
        new = (begin[1:] != begin[:-1] + 1) | (row[1:] != row[:-1])
        for x in same:
            new |= x[1:] != x[:-1]
        return np.flatnonzero(np.append(True, new))


def shares(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in the sorted keys."""
    edges = [(s << 64) // shards for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _sent(chunk: int, keys: np.ndarray, shards: int, **extra) -> pa.Table:
    """A row for each shard with its share of the keys; ``extra``: columns of binary, each from a share's slice."""
    cut = shares(keys, shards)
    some = np.flatnonzero(np.diff(cut))
    top = (1 << 64) // shards + 1
    low = [(int(s) << 64) // shards for s in some]
    part = [slice(cut[s], cut[s + 1]) for s in some]
    return pa.table({
        "chunk": pa.array(np.full(len(some), chunk, np.int32)), "shard": pa.array(some.astype(np.int32)),
        "n": pa.array(np.diff(cut)[some]),
        "keys": pa.array([EliasFano.encode(keys[p] - np.uint64(x), top).data.tobytes() for p, x in zip(part, low)], pa.binary()),
        **{name: pa.array([of(p).tobytes() for p in part], pa.binary()) for name, of in extra.items()}})


def _asked(chunk: int, keys: np.ndarray, times: np.ndarray, shards: int) -> pa.Table:
    return _sent(chunk, keys, shards, twice=lambda p: np.packbits(times[p] > 1))


def compare_neighbours(chunk: np.ndarray, keys: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's keys of one shard: 0 met once, 1 repeated and this chunk is the first, 2 repeated."""
    every = np.concatenate(keys)
    source = np.repeat(chunk, [len(k) for k in keys])
    order = np.lexsort((source, every))
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    before, after = np.append(False, same), np.append(same, False)
    code = np.zeros(len(every), np.uint8)
    code[order] = np.where(before, 2, np.where(after | np.concatenate(twice)[order], 1, 0))
    return np.split(code, np.cumsum([len(k) for k in keys])[:-1])


def look_up(keys: list[np.ndarray], sure: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's keys of one shard the labels of those that are not ``sure``: ``labels`` has each chunk's
    labels of those that are, and each key is sure in one chunk."""
    known, label = np.concatenate([k[x] for k, x in zip(keys, sure, strict=True)]), np.concatenate(labels)
    order = np.argsort(known, kind="stable")
    known, label = known[order], label[order]
    return [label[np.searchsorted(known, k[~x])] for k, x in zip(keys, sure, strict=True)]


def repeated(docs: DataFrame, id_col: str, text_col: str, least: int = 50, within: bool = True) -> DataFrame:
    """(id_col, word_begin, word_end, n_words, passage, is_first, parts): a row for every maximal run of ``least``
    words or more all of whose stretches of ``least`` words occur elsewhere too: in another document or, with
    ``within``, again in the same.

    ``parts`` lists, ascending, the row's longest runs of stretches that have one origin, as (word_begin, word_end,
    passage, is_first): ``is_first`` if these are the first places of the stretches, ``passage``: the origin's label,
    its smallest hash, the same at all places of a stretch. Parts overlap by up to ``least`` - 1 words. Every stretch
    has one first place; words outside all first parts can go without any stretch being lost.

    The row's ``is_first``: some part is the first; rows where it is false can go as a whole. The row's ``passage``:
    the smallest hash of its stretches, of those at their first place if there are any."""
    if least < SPREAD + GRAM - 1:
        raise ValueError(f"least must be {SPREAD + GRAM - 1} words at least")
    text = F.col(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = 1 + int(size) // CHUNK_BYTES
    chunked = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.octet_length("text") > 0)
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        s = Suffixes(*word_hashes(table["text"]), least, within)
        return _asked(table["chunk"][0].as_py(), s.keys, s.times, shards)

    def ordered(chunk: pa.Table) -> pa.Table:
        return chunk.sort_by([("id", "ascending"), ("text", "ascending")])

    def keys_of(table: pa.Table) -> list[np.ndarray]:
        shard = table["shard"][0].as_py()
        top, low = (1 << 64) // shards + 1, np.uint64((shard << 64) // shards)
        return [EliasFano(k, top, np.frombuffer(x.as_py(), np.uint8)).values() + low
                for k, x in zip(table["n"].to_pylist(), table["keys"])]

    def reply(table: pa.Table) -> pa.Table:
        keys, n = keys_of(table), table["n"].to_pylist()
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k).astype(bool) for k, x in zip(n, table["twice"])]
        codes = compare_neighbours(table["chunk"].to_numpy(), keys, twice)
        return pa.table({"chunk": table["chunk"], "shard": table["shard"],
                         "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    def codes_of(right: pa.Table, keys: np.ndarray, turn: int) -> np.ndarray:
        cut, out = shares(keys, shards), np.zeros(len(keys), np.uint8)
        for s, t, c in zip(right["shard"].to_pylist(), right["turn"].to_pylist(), right["codes"].to_pylist(), strict=True):
            if t == turn:
                out[cut[s]:cut[s + 1]] = np.frombuffer(c, np.uint8)
        return out

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _asked(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), shards)
        s = Suffixes(*word_hashes(left["text"]), least, within)
        s.stretches(codes_of(right, s.keys, 1))
        return _asked(left["chunk"][0].as_py(), s.windows, s.window_times, shards)

    def label(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            none = np.zeros(0, np.uint64)
            return _sent(0, none, shards, sure=lambda p: none, labels=lambda p: none)
        s, code = settled(left, right)
        some = np.flatnonzero(code > 0)
        sure, label = s.sure[some], s.label[some]
        return _sent(left["chunk"][0].as_py(), s.windows[some], shards, sure=lambda p: np.packbits(sure[p]),
                     labels=lambda p: label[p][sure[p]])

    def reply_labels(table: pa.Table) -> pa.Table:
        keys, n = keys_of(table), table["n"].to_pylist()
        sure = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k).astype(bool) for k, x in zip(n, table["sure"])]
        told = look_up(keys, sure, [np.frombuffer(x.as_py(), np.uint64) for x in table["labels"]])
        return pa.table({"chunk": table["chunk"], "shard": table["shard"],
                         "codes": pa.array([x.tobytes() for x in told], pa.binary())})

    def settled(left: pa.Table, right: pa.Table) -> tuple[Suffixes, np.ndarray]:
        """The chunk in the order of first places, and its windows' codes."""
        s = Suffixes(*word_hashes(left["text"]), least, within)
        s.stretches(codes_of(right, s.keys, 1))
        code = codes_of(right, s.windows, 2)
        s.origins(code)
        return s, code

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = ordered(left)
        s, code = settled(left, right)
        asked = np.flatnonzero((code > 0) & ~s.sure)
        cut = shares(s.windows[asked], shards)
        for shard, t, c in zip(right["shard"].to_pylist(), right["turn"].to_pylist(), right["codes"].to_pylist(), strict=True):
            if t == 3:
                s.label[asked[cut[shard]:cut[shard + 1]]] = np.frombuffer(c, np.uint64)
        begin, window, own = s.begin[s.live], s.window[s.live], s.own
        origin = s.label[window]
        start = s.first[s.row[begin]] if len(begin) else begin
        part, head = s.heads(begin, origin, own), s.heads(begin)
        end = np.append(part[1:], len(begin)) - 1 if len(begin) else begin
        last = np.append(head[1:], len(begin)) - 1 if len(begin) else begin
        parts = pa.ListArray.from_arrays(
            pa.array(np.append(np.searchsorted(part, head), len(part)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array((begin[part] - start[part]).astype(np.int64)),
                 pa.array((begin[end] + least - start[part]).astype(np.int64)),
                 pa.array(origin[part].view(np.int64)), pa.array(own[part])],
                names=["word_begin", "word_end", "passage", "is_first"]))
        first = np.logical_or.reduceat(own, head) if len(begin) else own
        # windows are numbered in the order of their hashes; those at their first place come before all others
        smallest = np.minimum.reduceat(window + np.where(own, 0, len(s.windows)), head) % len(s.windows) if len(begin) else begin
        return pa.table({
            "id": left["id"].take(pa.array(s.row[begin[head]] if len(begin) else begin)),
            "word_begin": pa.array((begin[head] - start[head]).astype(np.int64)),
            "word_end": pa.array((begin[last] + least - start[head]).astype(np.int64)),
            "n_words": pa.array((begin[last] + least - begin[head]).astype(np.int64)),
            "passage": pa.array(s.windows[smallest].view(np.int64)), "is_first": pa.array(first), "parts": parts})

    asking, answer = "chunk int, shard int, n long, keys binary, twice binary", "chunk int, shard int, codes binary"
    one = chunked.groupBy("chunk").applyInArrow(ask, asking).groupBy("shard").applyInArrow(reply, answer)
    one = one.withColumn("turn", F.lit(1))
    two = chunked.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(extend, asking)
    two = one.union(two.groupBy("shard").applyInArrow(reply, answer).withColumn("turn", F.lit(2)))
    three = chunked.groupBy("chunk").cogroup(two.groupBy("chunk")).applyInArrow(
        lambda left, right: label(ordered(left), right), "chunk int, shard int, n long, keys binary, sure binary, labels binary")
    three = two.union(three.groupBy("shard").applyInArrow(reply_labels, answer).withColumn("turn", F.lit(3)))
    kind = docs.schema[id_col].dataType.simpleString()
    out = chunked.groupBy("chunk").cogroup(three.groupBy("chunk")).applyInArrow(
        finish, f"id {kind}, word_begin long, word_end long, n_words long, passage long, is_first boolean, "
                "parts array<struct<word_begin: long, word_end: long, passage: long, is_first: boolean>>")
    return out.withColumnRenamed("id", id_col)
