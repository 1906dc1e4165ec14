"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is a bigram model, interpolated: p(w | v) = weight * c(v w) / c(v) + (1 - weight) * u(w) with
u(w) = (c(w) + 1) / (N + V + 1), and u(w) alone after a context that training has not met. Every text ends
with one end token; its first word follows a begin token.

Documents are dealt by hash into chunks of bounded size. A chunk sends each shard its distinct words and
bigrams once, with their training counts, so that a very common word costs one entry a chunk and not one a
row. A shard (by context; contexts that are common in the whole corpus are spread by bigram, their counts
broadcast) builds its part of the trie: the sorted words, monotone pointers to their successors, the
successors as one monotone sequence, all Elias-Fano coded, and the smoothed bigram term as an 8-bit
logarithm. It then answers the chunks' queries by successor search within the context's range, and each
chunk scores its texts from the answers. All words and bigrams of the training documents are counted; there
is no pruning. The trie's levels are flat buffers that memory-mapping serves as they are; they are read where
the shuffle delivers them.

Defined results: null text counts as empty (one end token); ids may be null or repeat; a row whose ``held``
is null is held out; with no training rows N = V = 0; other columns are ignored; an empty table gives an
empty result. Words are told apart by 64-bit hashes, successors within a context by 40 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithos.llm.eliasfano import EliasFano, pack_counts, unpack_counts
from lithos.llm.text import SpanHash, Words, blocks, lowered, mix, tidy

#: Text bytes of a chunk; a shard holds the share of one chunk of all n-grams.
CHUNK_BYTES = 8 << 20
#: Weight of the bigram term.
WEIGHT = 0.3
#: A context is spread over all shards from this share of a shard's tokens.
COMMON = 1 / 16
END, BEGIN = np.uint64(0x1D872B41A5C3E90F), np.uint64(0x7A3C5E19D4B8F062)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_SUCC = 40
#: The 8-bit code of a bigram term: 0 for none, else log10 from -12 to 0 in 254 steps.
_RANGE, _STEPS = 12.0, 254


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, index of each row's first token); every row ends with END."""
    parts, lengths = [], []
    for b in blocks(column):
        low = lowered(b.raw)
        words = Words(low, b.offsets)
        h = SpanHash(low)(words.start, words.end) if len(words) else np.zeros(0, np.uint64)
        parts.append(np.insert(h, words.first[1:], END))
        lengths.append(np.diff(words.first) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def encode_log(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((np.log10(p) + _RANGE) / _RANGE * _STEPS) + 1, 1, 255).astype(np.uint8)


#: The value of each code.
TERM = np.concatenate([[0.0], 10.0 ** (np.arange(_STEPS + 1) / _STEPS * _RANGE - _RANGE)])


class Layout:
    """A chunk's distinct words and bigrams, and their order within each shard. It depends on the chunk's
    tokens alone, so that the pass that asks and the pass that scores agree."""

    def __init__(self, h: np.ndarray, first: np.ndarray, shards: int, common: np.ndarray):
        self.words, self.word = np.unique(h, return_inverse=True)
        n = len(self.words)
        before = np.empty(len(h), np.int64)
        before[1:] = self.word[:-1]
        before[first[:-1]] = n  # BEGIN
        key, self.bigram = np.unique(before.astype(np.uint64) << np.uint64(32) | self.word.astype(np.uint64),
                                     return_inverse=True)
        self.context = (key >> np.uint64(32)).astype(np.int64)
        self.successor = self.words[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] >> np.uint64(64 - _SUCC)
        names = np.append(self.words, BEGIN)
        at = np.minimum(np.searchsorted(common, names), max(len(common) - 1, 0))
        spread = common[at] == names if len(common) else np.zeros(n + 1, bool)
        home = (mix(names) % np.uint64(shards)).astype(np.int64)
        self.home = home[:n]
        spread_of = (mix(names[self.context] * _FOLD ^ self.successor) % np.uint64(shards)).astype(np.int64)
        to = np.where(spread[self.context], spread_of, home[self.context])
        self.word_order = np.argsort(self.home, kind="stable")
        self.word_cut = np.searchsorted(self.home[self.word_order], np.arange(shards + 1))
        self.bigram_order = np.argsort(to, kind="stable")
        self.bigram_cut = np.searchsorted(to[self.bigram_order], np.arange(shards + 1))
        self.names, self.spread, self.common_at = names, spread, at

    def messages(self, train: np.ndarray):
        """(shard, message) for every shard that the chunk has words or bigrams for. ``train`` marks the
        tokens of training rows. A message: counts of entries, then the columns as bytes."""
        words = np.bincount(self.word[train], minlength=len(self.words))
        bigrams = np.bincount(self.bigram[train], minlength=len(self.context))
        place = np.empty(len(self.words) + 1, np.int64)
        for s in range(len(self.word_cut) - 1):
            mine = self.word_order[self.word_cut[s]:self.word_cut[s + 1]]
            pairs = self.bigram_order[self.bigram_cut[s]:self.bigram_cut[s + 1]]
            if not len(mine) and not len(pairs):
                continue
            place[mine] = np.arange(len(mine))
            context = self.context[pairs]
            head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(pairs) else np.zeros(0, np.int64)
            lead = context[head]
            # even: a word of this message; odd: a common context
            name = np.where(self.spread[lead], 2 * self.common_at[lead] + 1, 2 * place[lead])
            size = np.diff(np.append(head, len(pairs)))
            low = self.successor[pairs].view(np.uint8).reshape(-1, 8)[:, :5]
            parts = [EliasFano.encode(self.words[mine], _ALL).data.tobytes(), pack_counts(words[mine]),
                     name.astype("<u4").tobytes(), pack_counts(size), low.tobytes(), pack_counts(bigrams[pairs])]
            sizes = np.array([len(mine), len(head), len(pairs), *map(len, parts)], "<i8")
            yield s, sizes.tobytes() + b"".join(parts)


class Message:
    """What ``Layout.messages`` wrote."""

    def __init__(self, data: bytes):
        sizes = np.frombuffer(data, "<i8", 9)
        cut = 72 + np.concatenate([[0], np.cumsum(sizes[3:])])
        part = [data[a:b] for a, b in zip(cut[:-1], cut[1:])]
        n, groups, pairs = sizes[:3].tolist()
        self.words = EliasFano(n, _ALL, np.frombuffer(part[0], np.uint8)).values()
        self.counts = unpack_counts(part[1], n)
        self.name = np.frombuffer(part[2], "<u4").astype(np.int64)
        self.size = unpack_counts(part[3], groups)
        low = np.zeros((pairs, 8), np.uint8)
        low[:, :5] = np.frombuffer(part[4], np.uint8).reshape(-1, 5)
        self.successor = low.view("<u8").ravel()
        self.bigrams = unpack_counts(part[5], pairs)


class Trie:
    """One shard of the trie. Level 1: contexts with monotone pointers; level 2: successors as one monotone
    sequence (context number above successor) and the coded bigram terms."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, total: np.ndarray):
        """Entries sorted by (context, successor); ``total``: training count of every context."""
        self.contexts = len(total)
        pointers = np.searchsorted(context, np.arange(self.contexts + 1))
        self.pointers = EliasFano.encode(pointers, max(len(context), 1))
        value = context.astype(np.uint64) << np.uint64(_SUCC) | successor
        self.successors = EliasFano.encode(value, max(self.contexts, 1) << _SUCC)
        self.codes = encode_log(WEIGHT * count / total[context]) if len(count) else np.zeros(0, np.uint8)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each bigram, 0 if the trie has it not."""
        if not len(self.codes):
            return np.zeros(len(context), np.uint8)
        begin = self.pointers.values().astype(np.int64)
        lo, hi = begin[context], begin[context + 1]
        value = context.astype(np.uint64) << np.uint64(_SUCC) | successor
        at = self.successors.successor(value, lo, hi)
        here = np.flatnonzero(at < hi)
        same = self.successors.low(at[here]) == value[here] & np.uint64((1 << self.successors.bits) - 1)
        # the successor found may lie under a later high part: compare that too
        part = (value[here] >> np.uint64(self.successors.bits)).astype(np.int64)
        same &= at[here] < self.successors.starts()[part + 1]
        out = np.zeros(len(context), np.uint8)
        out[here[same]] = self.codes[at[here[same]]]
        return out


def answer(messages: list[Message], common_counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Build the shard's trie from all its messages and answer each: (counts of its words, bigram codes)."""
    words, at = np.unique(np.concatenate([m.words for m in messages]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([m.counts for m in messages]), len(words)).astype(np.int64)
    cut = np.cumsum([0, *(len(m.words) for m in messages)])
    total = np.concatenate([counts, common_counts])
    contexts, successors = [], []
    for k, m in enumerate(messages):
        mine = at[cut[k]:cut[k + 1]]
        odd = (m.name & 1) == 1
        name = np.where(odd, len(words) + (m.name >> 1), 0)
        name[~odd] = mine[m.name[~odd] >> 1]
        contexts.append(np.repeat(name, m.size))
        successors.append(m.successor)
    key = np.concatenate([c.astype(np.uint64) << np.uint64(_SUCC) | s for c, s in zip(contexts, successors)])
    n = np.concatenate([m.bigrams for m in messages])
    seen = np.flatnonzero(n)
    if len(seen):
        distinct, where = np.unique(key[seen], return_inverse=True)
        n = np.bincount(where, n[seen], len(distinct))
        trie = Trie((distinct >> np.uint64(_SUCC)).astype(np.int64), distinct & np.uint64((1 << _SUCC) - 1), n, total)
    else:
        trie = Trie(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), total)
    return [(pack_counts(counts[at[cut[k]:cut[k + 1]]]), trie.find(contexts[k], successors[k]).tobytes())
            for k in range(len(messages))]


def totals(docs: DataFrame, text_col: str, train_col: str, shards: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(N, V, common contexts ascending, their counts) over the training rows; BEGIN is always common."""
    def words(batches):
        held: list[np.ndarray] = []

        def flush():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            to = (mix(w) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            parts = [order[cut[s]:cut[s + 1]] for s in some]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([EliasFano.encode(w[p], _ALL).data.tobytes() for p in parts]),
                 pa.array([pack_counts(n[p]) for p in parts]), pa.array([len(p) for p in parts], pa.int64())],
                names=["shard", "words", "counts", "n"])

        for batch in batches:
            column = batch.column(0).filter(batch.column(1))
            for lo in range(0, len(column), 2_000):
                held.append(token_hashes(column.slice(lo, 2_000))[0])
                if sum(map(len, held)) > 4_000_000:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        rows = list(zip(table["words"].to_pylist(), table["counts"].to_pylist(), table["n"].to_pylist(), strict=True))
        w, at = np.unique(np.concatenate([EliasFano(n, _ALL, np.frombuffer(x, np.uint8)).values() for x, _, n in rows]),
                          return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack_counts(y, n) for _, y, n in rows]), len(w)).astype(np.int64)
        # what is common in the corpus holds at least its shard's share here
        top = np.flatnonzero(c >= max(2, COMMON * c.sum()))
        return pa.table({"n": [int(c.sum())], "v": [len(w)], "words": [w[top].view(np.int64)], "counts": [c[top]]})

    source = docs.select(text_col, F.coalesce(train_col, F.lit(False)))
    sent = source.mapInArrow(tidy(words), "shard int, words binary, counts binary, n long")
    found = sent.groupBy("shard").applyInArrow(count, "n long, v long, words array<long>, counts array<long>").collect()
    n, v = sum(r["n"] for r in found), sum(r["v"] for r in found)
    top = {int(w) & _ALL: c for r in found for w, c in zip(r["words"], r["counts"]) if c >= COMMON * n / shards}
    rows = source.where(source.columns[1]).count() if n else 0
    top[int(BEGIN)] = rows
    names = sorted(top)
    return n, v, np.array(names, np.uint64), np.array([top[k] for k in names], np.int64)


def score(docs: DataFrame, id_col: str, text_col: str, held: object) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``held`` is a
    boolean column expression, rows where it is false are the training rows."""
    text = F.col(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = 1 + int(size) // CHUNK_BYTES
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(held, F.lit(True)).alias("held"))
    source = source.withColumn("train", ~F.col("held"))
    n, v, common, common_counts = totals(source, "text", "train", shards)
    rest = float(n + v + 1)
    begin = int(common_counts[np.searchsorted(common, BEGIN)])
    chunked = source.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        h, first = token_hashes(table["text"])
        train = np.repeat(table["train"].to_numpy(), np.diff(first))
        told = list(Layout(h, first, shards, common).messages(train))
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(told), pa.int32()),
                         "shard": pa.array([s for s, _ in told], pa.int32()),
                         "message": pa.array([m for _, m in told], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        told = answer([Message(m.as_py()) for m in table["message"]], common_counts)
        return pa.table({"chunk": table["chunk"], "shard": table["shard"],
                         "counts": pa.array([a for a, _ in told], pa.binary()),
                         "codes": pa.array([b for _, b in told], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        h, first = token_hashes(left["text"])
        layout = Layout(h, first, shards, common)
        counts, codes = np.zeros(len(layout.words) + 1, np.int64), np.zeros(len(layout.context), np.uint8)
        counts[-1] = begin
        for s, a, b in zip(right["shard"].to_pylist(), right["counts"].to_pylist(), right["codes"].to_pylist(), strict=True):
            mine = layout.word_order[layout.word_cut[s]:layout.word_cut[s + 1]]
            counts[mine] = unpack_counts(a, len(mine))
            codes[layout.bigram_order[layout.bigram_cut[s]:layout.bigram_cut[s + 1]]] = np.frombuffer(b, np.uint8)
        c = counts[layout.word]
        unigram = (c + 1) / rest
        back = np.where(counts[layout.context] > 0, 1 - WEIGHT, 1.0)[layout.bigram]
        p = TERM[codes][layout.bigram] + back * unigram
        cut = first[:-1]
        return pa.table({
            "id": left["id"], "held_out": left["held"], "n_tokens": pa.array(np.diff(first)),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), cut)),
            "train_tokens": pa.array(np.full(left.num_rows, n)),
            "base_score": pa.array(np.add.reduceat(np.log10(unigram), cut)),
            "score": pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), cut))})

    asked = chunked.groupBy("chunk").applyInArrow(ask, "chunk int, shard int, message binary")
    replies = asked.groupBy("shard").applyInArrow(reply, "chunk int, shard int, counts binary, codes binary")
    kind = docs.schema[id_col].dataType.simpleString()
    out = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
