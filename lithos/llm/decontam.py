"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Symbols are hashed words (letters, digits and non-ASCII bytes, lower case); a code point of a script that is
written without spaces is a symbol of its own. Windows start at content-
selected anchors, the smallest word hash of every ``SPAN`` consecutive words, so that a copied passage
has the anchors of its item. A window's size is its item's size class: the largest power of two of at
most half the item, and small enough that every item has an anchor with a whole window behind it. The
CGK random walk reads a window: each step puts out the symbol it stands on, and a hash of step and
symbol says whether it moves on; few edits change few outputs. Bands of sampled outputs, the first one
(the anchor's word) in all, over several walks are the LSH keys. Items under ``FEW`` words have too few anchors, and
windows too short to sample: all outputs of windows of ``GRAM`` words are their key, at every word. Of n words with
floor(0.2 n) edits some ``GRAM`` in a row stay, and at least n - GRAM + 1 - GRAM * edits such windows in all, near
one diagonal; fewer make no candidate, so none is lost. Items under ``least`` words are looked up whole. Each candidate is verified by the exact
edit distance in words between the whole item and the best stretch of the document around the window.

The benchmark is read in blocks of bounded size, each broadcast for one pass over the documents; nothing
is shuffled. Walks and bands are set for a recall of 0.9 or more at similarity 0.8; tests measure it by size.

Defined results: null text counts as empty; items of under ``least`` words match verbatim only; items without a word
match nothing; equal items each give a row; repeated documents each give their rows; an item that a
document holds twice gives one row, the closest and then the first stretch; ids may be null; other
columns are ignored; empty tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lithos.llm.text import SpanHash, Words, blocks, lowered_latin, mix, tidy, window_hash

#: Every SPAN consecutive words hold an anchor.
SPAN = 8
#: Longest window, in words; longer items have more windows.
LONGEST = 32
WALKS, BANDS, SAMPLED = 3, 4, 5
#: Words of a window that is read whole, and of the shortest item that is found by anchors. Any item of 8 words or
#: more keeps GRAM words in a row under floor(0.2 n) edits: (n - edits) / (edits + 1) is above 2 for all n.
GRAM, FEW = 3, 24
#: Bounds of a benchmark block.
BLOCK_ITEMS, BLOCK_TEXT = 5_000, 8 << 20
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_NONE = np.uint64(0x5851F42D4C957F2D)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _unspaced(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the code points of scripts written without spaces: kana and Han (U+3040 to U+9FFF, U+20000
    to U+3FFFF), Thai and Lao, Myanmar, Khmer."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = raw[:-2], raw[1:-1]
    three = ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xE3) & (b >= 0x81)) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | (
        (a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F)))
    four = (a == 0xF0) & (b >= 0xA0)
    at = np.flatnonzero(three | four)
    return at, np.where(four[at], 4, 3)


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each row's first word) of a block."""
    low = lowered_latin(raw) if len(raw) else raw
    words = Words(low, offsets, _SOLID[low])
    start, end, first = words.start, words.end, words.first
    at, size = _unspaced(low)
    if len(at):
        after = at + size
        after = after[after < len(low)]
        run = np.searchsorted(start, after, "right") - 1  # what follows begins a word where its run goes on
        start = np.unique(np.concatenate([start, at, after[(run >= 0) & (after < end[np.maximum(run, 0)])]]))
        end = np.minimum(end[np.searchsorted(end, start, "right")], np.append(start[1:], len(low)))
        first = np.searchsorted(start, offsets)
        first[-1] = len(start)
    return SpanHash(low)(start, end), first


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places that hold the smallest hash (the last of ties) of some SPAN consecutive words of a row."""
    if len(h) < SPAN:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, SPAN)
    at = np.arange(len(view)) + SPAN - 1 - view[:, ::-1].argmin(1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mark = np.zeros(len(h), bool)
    mark[at[row[:len(view)] == row[SPAN - 1:]]] = True
    return np.flatnonzero(mark)


def window_of(n: int) -> int:
    """Window size for an item of ``n`` words (0: none)."""
    most = min(n - SPAN + 1, n // 2, LONGEST)
    return 1 << (most.bit_length() - 1) if most > 0 else 0


def _samples(size: int) -> list[list[np.ndarray]]:
    """Sampled steps for each walk and band of windows of ``size``."""
    rng = np.random.default_rng([20016, size])
    steps = max(2, 3 * size // 2)  # at one word in two steps, the walk is then still within the window
    return [[np.sort(rng.choice(np.arange(1, steps), min(SAMPLED, steps - 1), replace=False)) for _ in range(BANDS)]
            for _ in range(WALKS)]


def band_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each walk and band the key of the window of ``size`` words at each ``start``; ``end`` is the
    end of the window's row. Outputs past the window are a symbol of their own."""
    stop = np.minimum(start + size, end)
    for walk, bands in enumerate(_samples(size)):
        keys = [h[start] + np.uint64(1 + walk * BANDS + k + (size << 8)) for k in range(len(bands))]
        at = start.copy()
        last = max(int(b[-1]) for b in bands if len(b)) if size else 0
        for step in range(last + 1):
            live = at < stop
            out = np.where(live, h[np.minimum(at, len(h) - 1)], _NONE)
            for k, b in enumerate(bands):
                if step in b:
                    keys[k] = (keys[k] ^ (out + np.uint64(step))) * _FOLD
            move = mix(out + np.uint64(step * 1_000_003 + walk * 7_919)) >> np.uint64(63)
            at += (move.astype(np.int64)) & live
        yield from (mix(k) for k in keys)


class Benchmark:
    """One block of items: their symbols, and their LSH keys by window size."""

    def __init__(self, ids: list, texts: list[str], least: int, similarity: float = 0.8):
        h, first = [], [0]
        for b in blocks(pa.array(texts, pa.string())):
            part, cut = symbols(b.raw, b.offsets)
            h.append(part)
            first += (cut[1:] + first[-1]).tolist()
        self.least = least
        self.ids, self.h, self.first = ids, np.concatenate(h), np.array(first)
        count = np.diff(self.first)
        self.whole = {}
        for n in np.unique(count[(count > 0) & (count < least)]).tolist():
            mine = np.flatnonzero(count == n)
            self.whole[n] = _table(window_hash(self.h, n)[self.first[mine]], mine, np.zeros(len(mine), np.int64))
        few = (count >= max(least, GRAM)) & (count < FEW)
        at = np.flatnonzero(np.repeat(few, count))
        owner = np.repeat(np.arange(len(count)), count)[at]
        inside = at + GRAM <= self.first[owner + 1]
        at, owner = at[inside], owner[inside]
        self.grams = _table(window_hash(self.h, GRAM)[at], owner, at - self.first[owner]) if len(at) else None
        edits = ((1 - similarity) * count + 1e-9).astype(int)
        self.edits, self.shared = edits, np.maximum(1, count - GRAM + 1 - GRAM * edits)
        place = anchors(self.h, self.first)
        item = np.searchsorted(self.first, place, "right") - 1
        size = np.array([window_of(n) if n >= max(least, FEW) else 0 for n in count.tolist()], int)
        fits = (size[item] > 0) & (place + size[item] <= self.first[item + 1])
        place, item = place[fits], item[fits]
        self.start_words = np.unique(self.h[place])
        self.tables = {}
        for s in np.unique(size[item]).tolist():
            mine = size[item] == s
            p, it = place[mine], item[mine]
            keys = np.stack(list(band_keys(self.h, p, self.first[it + 1], s)), 1)
            flat, at = keys.ravel(), np.repeat(np.arange(len(p)), keys.shape[1])
            self.tables[s] = _table(flat, it[at], (p - self.first[it])[at])

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (row, item, word at which the item would begin), each once."""
        found = []
        for n, table in self.whole.items():
            found.append(_in_rows(_looked_up(table, window_hash(h, n)), n, first))
        if self.grams is not None:
            found.append(self._close(_in_rows(_looked_up(self.grams, window_hash(h, GRAM)), GRAM, first)))
        place = anchors(h, first)
        place = place[np.isin(h[place], self.start_words)]
        if len(place):
            row = np.searchsorted(first, place, "right") - 1
            for s, table in self.tables.items():
                for key in band_keys(h, place, first[row + 1], s):
                    which, item, ahead = _looked_up(table, key)
                    found.append(np.stack([row[which], item, place[which] - ahead], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _close(self, hits: np.ndarray) -> np.ndarray:
        """Of the hits of single windows those that begin as many as an edited item keeps: so many windows of the item
        whose diagonals differ by no more than its edits."""
        if not len(hits):
            return hits
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        item = hits[:, 1]
        last = np.arange(len(hits)) + self.shared[item] - 1
        inside = last < len(hits)
        end = hits[np.minimum(last, len(hits) - 1)]
        return hits[inside & (end[:, 0] == hits[:, 0]) & (end[:, 1] == item) & (end[:, 2] - hits[:, 2] <= self.edits[item])]


def _table(keys: np.ndarray, item: np.ndarray, ahead: np.ndarray) -> tuple:
    """Sorted keys with the item of each and its place in it, and a bitmap of the keys' first bits."""
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(1 << 20, bool)
    seen[keys >> np.uint64(44)] = True
    return keys[order], item[order], ahead[order], seen


def _looked_up(table: tuple, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of key, item, place in the item) of every entry of the table that has one of the keys."""
    keys, item, ahead, seen = table
    hit = np.flatnonzero(seen[key >> np.uint64(44)])
    lo, hi = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], "right")
    n = hi - lo
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(hit, n), item[k], ahead[k]


def _in_rows(found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, first: np.ndarray) -> np.ndarray:
    """(row, item, begin) of windows of ``n`` words that lie in one row."""
    at, item, ahead = found
    row = np.searchsorted(first, at, "right") - 1
    inside = at + n <= first[np.minimum(row + 1, len(first) - 1)]
    return np.stack([row[inside], item[inside], (at - ahead)[inside]], 1)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, begin, end) of the stretch of ``text`` closest to ``item``: the fewest inserted,
    deleted and replaced words; the first end and the longest stretch among equals."""
    width = len(text) + 1
    cost, begin = np.zeros(width, np.int64), np.arange(width)
    column = np.arange(width)
    scale = width + 1  # cost and begin in one number, so that ties take the earliest begin
    state = cost * scale + begin
    for k, word in enumerate(item.tolist()):
        step = np.empty(width, np.int64)
        step[0] = (k + 1) * scale
        step[1:] = np.minimum(state[1:] + scale, state[:-1] + scale * (text != np.uint64(word)))
        state = np.minimum.accumulate(step - column * scale) + column * scale
    cost, begin = np.divmod(state, scale)
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def matches(b: Benchmark, h: np.ndarray, first: np.ndarray, similarity: float) -> list[tuple]:
    """(row, item, distance, begin, end) of the verified candidates; begin and end count words."""
    best: dict[tuple[int, int], tuple] = {}
    done: dict[tuple[int, int], int] = {}
    for row, item, at in b.candidates(h, first).tolist():
        words = b.h[b.first[item]:b.first[item + 1]]
        n = len(words)
        most = int((1 - similarity) * n + 1e-9) if n >= b.least else 0
        lo, hi = first[row], first[row + 1]
        a = max(lo, at)
        if (row, item) in best and best[row, item][0] == 0:
            continue
        if at >= lo and at + n <= hi and np.array_equal(h[at:at + n], words):
            best[row, item] = (0, at - lo, at - lo + n)
            continue
        if (row, item) in done and a < done[row, item]:
            continue  # within a stretch that was compared already
        a, z = max(lo, at - 2 * most - 1), min(hi, at + n + 2 * most + 1)
        done[row, item] = at + most
        if np.count_nonzero(~np.isin(words, h[a:z])) > most:
            continue  # each word that the stretch lacks is an edit
        d, begin, end = best_stretch(words, h[a:z])
        hit = (d, int(a - lo + begin), int(a - lo + end))
        if d <= most and hit < best.get((row, item), (n + 1,)):
            best[row, item] = hit
    return [(row, item, *x) for (row, item), x in sorted(best.items())]


def _benchmark_blocks(items: DataFrame, id_col: str, text_col: str, least: int, similarity: float) -> Iterator[Benchmark]:
    ids, texts, size = [], [], 0
    for r in items.select(id_col, F.coalesce(text_col, F.lit(""))).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_TEXT:
            yield Benchmark(ids, texts, least, similarity)
            ids, texts, size = [], [], 0
    if ids:
        yield Benchmark(ids, texts, least, similarity)


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str,
          similarity: float = 0.8, least: int = SPAN, keys: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keys, item_id, n_words, edit_distance, similarity, word_begin, word_end): a row for each
    document and item it holds."""
    spark = docs.sparkSession
    source = docs.select(id_col, *keys, F.col(text_col).alias("_text"))
    lead = source.columns[:-1]
    item_type = items.schema[item_col].dataType
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = (f"{types}, item_id {item_type.simpleString()}, n_words int, edit_distance int, similarity double, "
              "word_begin int, word_end int")

    def scan(sent):
        def run(batches):
            b = sent.value
            for batch in batches:
                for part in blocks(batch.column(len(lead))):
                    h, first = symbols(part.raw, part.offsets)
                    hits = matches(b, h, first, similarity)
                    if not hits:
                        continue
                    row, item, d, begin, end = (np.array(x) for x in zip(*hits))
                    n = np.diff(b.first)[item]
                    at = pa.array(row + part.lo)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(at) for k in range(len(lead))),
                         pa.array([b.ids[i] for i in item.tolist()], id_type), pa.array(n.astype(np.int32)),
                         pa.array(d.astype(np.int32)), pa.array(1 - d / n), pa.array(begin.astype(np.int32)),
                         pa.array(end.astype(np.int32))],
                        names=[*lead, "item_id", "n_words", "edit_distance", "similarity", "word_begin", "word_end"])
        return source.mapInArrow(tidy(run), schema)

    id_type = to_arrow_type(item_type)
    parts = [scan(spark.sparkContext.broadcast(b)) for b in _benchmark_blocks(items, item_col, item_text, least, similarity)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str,
                  similarity: float = 0.8, least: int = SPAN) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item of the benchmark."""
    at = docs.columns.index(text_col)

    def drop(sent):
        def run(batches):
            b = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for part in blocks(batch.column(at)):
                    for row, *_ in matches(b, *symbols(part.raw, part.offsets), similarity):
                        keep[part.lo + row] = False
                yield batch.filter(pa.array(keep))
        return run

    for b in _benchmark_blocks(items, item_col, item_text, least, similarity):
        docs = docs.mapInArrow(tidy(drop(docs.sparkSession.sparkContext.broadcast(b))), docs.schema)
    return docs
