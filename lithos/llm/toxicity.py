"""Toxicity: a convolutional text classifier over hashed word embeddings, trained over Spark partitions.

A word (letters, digits and non-ASCII bytes, lower case) is embedded as the sum of the hashed vectors
of itself and of its prefixes. Filters of several widths run over the word vectors, the largest
response of each filter over the whole text is kept, and a logistic layer reads them. For every
language, told from the text's own letters, a threshold is calibrated on training rows that the
filters were not fitted on; the score is the logistic of the logit less that threshold, so that 0.5
is the threshold in every language.

Fitting uses all labelled rows: counts, passes of the training and the calibration each are Spark jobs over them, and
only the model comes to the driver. Parts of the rows are trained side by side and averaged; for equal rows the model is
the same however they are stored. Scoring is one pass without a shuffle.

Defined results: null and empty texts have the score of a text without words; rows with a null id
are never learned from; null labels are ignored, and of several labels of one id the largest holds;
repeated rows each get their own score; other columns are ignored; with no labels of both classes
every score is 0; an empty table gives an empty result. Whole texts are scored, in bounded blocks.
"""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithos.llm.store import written
from lithos.llm.text import SpanHash, Words, blocks, lowered_latin, tidy

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: Second UTF-8 bytes (after C3) of letters that tell a language from the text itself.
MARKS = {"de": (0xA4, 0xB6, 0xBC, 0x9F), "fr": (0xA9, 0xA8, 0xAA, 0xA7), "es": (0xB1, 0xB3, 0xAD, 0xA1)}
LANGUAGES = ("other", *MARKS)

#: Weight of the share of clean rows left alone against the share of toxic rows found, in calibration.
CLEAN_WEIGHT = 4.0


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training."""

    buckets: int = 1 << 18
    width: int = 16
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    windows: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    part_rows: int = 5_000
    least_rows: int = 10_000
    epochs: int = 3
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    """Parameters; ``thresholds`` is indexed like LANGUAGES."""

    settings: Settings
    embed: np.ndarray
    conv: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    trained: bool = True


def features(raw: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, first): bucket numbers of each word and its prefixes (0 if the word is shorter), and
    the index of each row's first word."""
    low = lowered_latin(raw) if len(raw) else raw
    words = Words(low, offsets, _WORD[low])
    span = SpanHash(low)
    pieces = np.zeros((len(words), 1 + len(s.prefixes)), np.int32)
    limit = np.uint64(s.buckets - 1)
    pieces[:, 0] = span(words.start, words.end) % limit + np.uint64(1)
    length = words.end - words.start
    for k, n in enumerate(s.prefixes):
        has = np.flatnonzero(length >= n)
        at = words.start[has]
        pieces[has, 1 + k] = (span(at, at + n) ^ np.uint64(n)) % limit + np.uint64(1)
    return pieces, words.first


def languages(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES for each row, from the share of marking letters in its bytes."""
    counts = np.zeros((len(LANGUAGES), len(offsets) - 1))
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    row, second = np.searchsorted(offsets, at, "right") - 1, raw[at]
    for k, marks in enumerate(MARKS.values(), 1):
        hit = np.isin(second, marks)
        counts[k] = np.bincount(row[hit], minlength=len(offsets) - 1)
    counts[0] = np.maximum(1.0, 0.004 * np.diff(offsets))
    return counts.argmax(0)


def _vectors(pieces: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors with zero rows after each text, so that no window crosses texts; and the place of
    each text's first word."""
    gap = max(m.settings.windows) - 1
    rows = len(first) - 1
    x = np.zeros((len(pieces) + gap * rows, m.settings.width), np.float32)
    at = np.arange(len(pieces)) + gap * np.repeat(np.arange(rows), np.diff(first))
    total = m.embed[pieces[:, 0]]
    for k in range(1, pieces.shape[1]):
        total += m.embed[pieces[:, k]]
    x[at] = total
    return x, first + gap * np.arange(len(first))


def _responses(x: np.ndarray, m: Model) -> np.ndarray:
    """Filter responses at every place (columns: window by filter)."""
    s = m.settings
    out = np.empty((len(x), len(s.windows) * s.filters), np.float32)
    for k, n in enumerate(s.windows):
        cols = slice(k * s.filters, (k + 1) * s.filters)
        out[:, cols] = m.offset[cols]
        for o in range(n):
            out[:len(x) - o, cols] += x[o:] @ m.conv[k, o]
    return out


def logits(pieces: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    rows = len(first) - 1
    pooled = np.zeros((rows, len(m.out)), np.float32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        x, begin = _vectors(pieces, first, m)
        r = _responses(x, m)
        # a window that starts behind a text's last word would reach into the next text
        for o in range(begin[1] - begin[0] - (first[1] - first[0])):
            r[begin[1:] - 1 - o] = 0
        pooled[full] = np.maximum(np.maximum.reduceat(r, begin[full], axis=0), 0)
    return pooled @ m.out + m.bias


@dataclass
class Training:
    """A model under way: ``dense`` are its parameters but the embedding, with Adam's moments; ``scale`` is Adagrad's for
    the embedding; ``step`` counts batches."""

    model: Model
    dense: dict[str, np.ndarray]
    moments: dict[str, list[np.ndarray]]
    scale: np.ndarray
    step: float = 0.0


def _counted(rows, labels, s: Settings) -> np.ndarray:
    """(label, bucket) -> rows of that label with the bucket, from the pieces of each row."""
    counts = np.zeros((2, s.buckets))
    for pieces, y in zip(rows, labels, strict=True):
        counts[y][np.unique(pieces)] += 1
    return counts


def _started(s: Settings) -> tuple[Training, np.random.Generator]:
    """A random network, and the generator that it came from."""
    rng = np.random.default_rng(s.seed)
    n_filters = len(s.windows) * s.filters
    embed = rng.normal(0, 0.05, (s.buckets, s.width)).astype(np.float32)
    conv = rng.normal(0, 0.3, (len(s.windows), max(s.windows), s.width, s.filters)).astype(np.float32)
    embed[0] = 0
    m = Model(s, embed, conv, np.zeros(n_filters, np.float32), np.full(n_filters, 0.2, np.float32), 0.0, trained=False)
    dense = {"conv": conv, "offset": m.offset, "out": m.out, "bias": np.array(-2.0, np.float32)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in dense.items()}
    return Training(m, dense, moments, np.zeros(s.buckets, np.float32)), rng


def _prime(t: Training, counts: np.ndarray, sizes: np.ndarray) -> None:
    """The embedding's first dimension becomes the words' log odds."""
    seen = counts.sum(0)
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    m = t.model
    m.embed[1:, 0] = (odds * seen / (seen + 4.0) / 2)[1:]
    m.conv[:, :, 0, :] = np.abs(m.conv[:, :, 0, :])
    m.bias, m.trained = -2.0, True


def _learn(t: Training, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """One step of Adam (the embedding: Adagrad) on a batch of rows with words."""
    m, s, dense = t.model, t.model.settings, t.dense
    pieces = np.concatenate(rows)
    first = np.cumsum([0, *map(len, rows)])
    x, begin = _vectors(pieces, first, m)
    r = _responses(x, m)
    best = np.stack([r[a:a + n].argmax(0) + a for a, n in zip(begin[:-1], np.diff(first), strict=True)])
    peak = np.take_along_axis(r, best, 0)
    pooled = np.maximum(peak, 0)
    z = pooled @ dense["out"] + dense["bias"]
    err = (1 / (1 + np.exp(-z)) - labels) / len(rows)
    back = err[:, None] * dense["out"] * (peak > 0)
    grads = {"out": pooled.T @ err, "bias": err.sum(), "offset": back.sum(0), "conv": np.zeros_like(m.conv)}
    gap = (begin[:-1] - first[:-1])[:, None]
    touched, pulls = [], []
    for k, n in enumerate(s.windows):
        cols = slice(k * s.filters, (k + 1) * s.filters)
        pull = back[:, cols]
        for o in range(n):
            at = best[:, cols] + o
            grads["conv"][k, o] = np.einsum("rf,rfw->wf", pull, x[at])
            word = at - gap
            row, f = np.nonzero((word < first[1:, None]) & (pull != 0))
            touched.append(pieces[word[row, f]])
            pulls.append(pull[row, f, None] * m.conv[k, o, :, f])
    touched, pulls = np.concatenate(touched), np.concatenate(pulls)
    ids, where = np.unique(touched, return_inverse=True)
    where, every = where.ravel(), np.repeat(pulls, touched.shape[1], axis=0)
    g = np.stack([np.bincount(where, every[:, w], len(ids)) for w in range(s.width)], 1).astype(np.float32)
    t.scale[ids] += (g * g).mean(1)
    m.embed[ids] -= s.rate * g / (np.sqrt(t.scale[ids])[:, None] + 1e-6)
    m.embed[0] = 0
    t.step += 1
    for name, p in dense.items():
        a, b = t.moments[name]
        a += 0.1 * (grads[name] - a)
        b += 0.01 * (grads[name] ** 2 - b)
        p -= s.rate * (a / (1 - 0.9**t.step)) / (np.sqrt(b / (1 - 0.99**t.step)) + 1e-8)
    m.bias = float(dense["bias"])


def train(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """The training on one machine: ``epochs`` passes over four fifths of the rows, the thresholds from the others."""
    t, rng = _started(s)
    if len(set(labels.tolist())) < 2:
        return t.model
    data, langs = [], []
    for b in blocks(pa.array(texts, pa.string())):
        pieces, first = features(b.raw, b.offsets, s)
        langs.append(languages(b.raw, b.offsets))
        data += [pieces[first[i]:first[i + 1]] for i in range(b.rows)]
    langs = np.concatenate(langs)
    order = rng.permutation(len(data))
    fold = order[: max(1, len(order) // 5)]
    fit = order[len(fold):]
    _prime(t, _counted([data[i] for i in fit], labels[fit], s), np.bincount(labels[fit], minlength=2))
    for _ in range(s.epochs):
        shuffled = rng.permutation(fit)
        for lo in range(0, len(fit), s.batch):
            take = [i for i in shuffled[lo:lo + s.batch] if len(data[i])]
            if take:
                _learn(t, [data[i] for i in take], labels[take])
    z = logits(np.concatenate([data[i] for i in fold]), np.cumsum([0, *(len(data[i]) for i in fold)]), t.model)
    t.model.thresholds = _calibrated(z, langs[fold], labels[fold], np.ones(len(fold)))
    return t.model


def _calibrated(z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The thresholds, indexed like LANGUAGES, from logits that stand for ``n`` rows each; the one of all rows for a
    language with too few."""
    common = _threshold(z, y, n, 0.0)
    return np.array([_threshold(z[lang == k], y[lang == k], n[lang == k], common) for k in range(len(LANGUAGES))])


def _threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray, fallback: float, least: int = 10) -> float:
    """The middle of the gap between logits that gives the best weighted accuracy; ``fallback`` with
    fewer than ``least`` rows of either label."""
    toxic, clean = n * y, n * (1 - y)
    if min(toxic.sum(), clean.sum()) < least:
        return fallback
    z, at = np.unique(z, return_inverse=True)
    toxic, clean = np.bincount(at, toxic), np.bincount(at, clean)
    right = CLEAN_WEIGHT * np.concatenate([[0.0], np.cumsum(clean)]) / clean.sum() + 1 - np.concatenate([[0.0], np.cumsum(toxic)]) / toxic.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = best[len(best) // 2]
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(edges[k])


def _pieces(batches, s: Settings):
    """(pieces, label, language) of each row of (text, label) batches."""
    for batch in batches:
        for b in blocks(batch.column(0)):
            pieces, first = features(b.raw, b.offsets, s)
            lang = languages(b.raw, b.offsets)
            labels = batch.column(1).slice(b.lo, b.rows).to_numpy(zero_copy_only=False)
            for i in range(b.rows):
                yield pieces[first[i]:first[i + 1]], int(labels[i]), int(lang[i])


def _odds(rows: DataFrame, s: Settings) -> np.ndarray:
    """``_counted`` of all (text, label) rows; what comes to the driver is one row a bucket."""
    def run(batches):
        counts = np.zeros((2, s.buckets), np.int64)
        for pieces, y, _ in _pieces(batches, s):
            counts[y][np.unique(pieces)] += 1
        at = np.flatnonzero(counts.any(0))
        for lo in range(0, len(at), 10_000):
            ids = at[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, counts[:, ids])], names=["bucket", "clean", "toxic"])

    found = rows.mapInArrow(tidy(run), "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, s.buckets))
    for k, name in enumerate(("clean", "toxic")):
        counts[k, found["bucket"].to_numpy()] = found[name].to_numpy()
    return counts


#: What a part has learned is added as whole multiples of this, so that the sum does not depend on its order.
QUANTUM = 2.0**-32
#: Words of a batch; a batch of longer texts has fewer rows.
BATCH_WORDS = 1 << 17


def _dense(t: Training) -> list[np.ndarray]:
    return [v for name, p in t.dense.items() for v in (p, *t.moments[name])]


def _round(rows: DataFrame, t: Training) -> None:
    """One pass over all (text, label) rows, in their partitions: each part learns from ``t`` on, and the mean of what
    they have learned is added to it, for a bucket over the parts that met it."""
    s = t.model.settings
    sent = rows.sparkSession.sparkContext.broadcast(t)
    names = ["n", *(f"v{i}" for i in range(s.width + 1))]

    def run(batches):
        start = sent.value
        own, held, ys, words = deepcopy(start), [], [], 0
        for pieces, y, _ in _pieces(batches, s):
            if not len(pieces):
                continue
            if held and (len(held) == s.batch or words + len(pieces) > BATCH_WORDS):
                _learn(own, held, np.array(ys))
                held, ys, words = [], [], 0
            held.append(pieces)
            ys.append(y)
            words += len(pieces)
        if held:
            _learn(own, held, np.array(ys))
        if own.step == start.step:
            return
        change = np.column_stack([own.model.embed - start.model.embed, own.scale - start.scale])
        met = np.flatnonzero(change.any(1))
        flat = np.concatenate([(a - b).ravel() for a, b in zip(_dense(own), _dense(start), strict=True)] + [[own.step - start.step]])
        flat = np.pad(flat, (0, -len(flat) % (s.width + 1))).reshape(-1, s.width + 1)
        ids = np.concatenate([-1 - np.arange(len(flat)), met])
        values = np.rint(np.concatenate([flat, change[met]]) / QUANTUM).astype(np.int64)
        for lo in range(0, len(ids), 10_000):
            part = slice(lo, lo + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[part]), pa.array(np.ones(len(ids[part]), np.int64)), *map(pa.array, values[part].T.copy())],
                names=["bucket", *names])

    found = rows.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in ["bucket", *names])).groupBy("bucket").agg(
        *(F.sum(n).alias(n) for n in names)).toArrow()
    sent.destroy()
    ids = found["bucket"].to_numpy()
    values = np.column_stack([found[n].to_numpy() for n in names[1:]]) * QUANTUM / found["n"].to_numpy()[:, None]
    met, rest = ids >= 0, np.flatnonzero(ids < 0)
    t.model.embed[ids[met]] += values[met, :-1].astype(np.float32)
    t.scale[ids[met]] += values[met, -1].astype(np.float32)
    flat = values[rest[np.argsort(-ids[rest])]].ravel()
    for p in _dense(t) if len(rest) else ():
        p += flat[:p.size].reshape(p.shape).astype(np.float32)
        flat = flat[p.size:]
    t.step += float(flat[0]) if len(rest) else 0.0
    t.model.bias = float(t.dense["bias"])


#: Logits are told apart by this many parts of one in calibration, which bounds the rows that it brings to the driver.
GRAIN = 1024


def _logits(rows: DataFrame, m: Model) -> tuple[np.ndarray, ...]:
    """(logit, language, label, rows) of all (text, label) rows, counted."""
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(0)):
                z = logits(*features(b.raw, b.offsets, sent.value.settings), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.floor(z.astype(float) * GRAIN).astype(np.int64)), pa.array(languages(b.raw, b.offsets)),
                     batch.column(1).slice(b.lo, b.rows).cast(pa.int64())], names=["z", "lang", "y"])

    found = rows.mapInArrow(tidy(run), "z long, lang long, y long").groupBy("z", "lang", "y").agg(
        F.count(F.lit(1)).alias("n")).toArrow()
    sent.destroy()
    z, lang, y, n = (found[c].to_numpy() for c in ("z", "lang", "y", "n"))
    return (z + 0.5) / GRAIN, lang, y, n


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
        s: Settings = Settings()) -> Model:
    """Train on all labelled rows. A fifth of them, by hash, calibrates the thresholds; the others give the counted start
    and are dealt to parts of some ``part_rows`` rows, which learn side by side and are averaged after each pass. There
    are ``epochs`` passes, fewer (one at least) once they make ``least_rows`` rows."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known.hint("merge"), "id")
    key = F.xxhash64(F.lit(s.seed), "id", "text")
    rows = written(texts.select("text", "y", key.alias("key"), (F.pmod(key, F.lit(5)) == 0).alias("fold")), "labelled")
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("fold", "y").count().collect():
        sizes[int(r["fold"]), r["y"]] = r["count"]
    t, _ = _started(s)
    if not sizes.sum(0).all():
        return t.model
    learned, fold = rows.where("not fold"), rows.where("fold").select("text", "y")
    n = int(sizes[0].sum())
    _prime(t, _odds(learned.select("text", "y"), s), sizes[0])
    dealt = learned.repartition(max(1, -(-n // s.part_rows)), "key").sortWithinPartitions("key", "y").select("text", "y")
    for _ in range(min(s.epochs, max(1, -(-s.least_rows // max(1, n))))):
        _round(dealt, t)
    t.model.thresholds = _calibrated(*_logits(fold, t.model))
    return t.model


def _scores(b, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, language, logit) of the rows of a block."""
    lang = languages(b.raw, b.offsets)
    if not m.trained:
        return np.zeros(b.rows), lang, np.zeros(b.rows)
    z = logits(*features(b.raw, b.offsets, m.settings), m).astype(float)
    return 1 / (1 + np.exp(-np.clip(z - m.thresholds[lang], -500, 500))), lang, z


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id_col, score, predicted, language, logit) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = sent.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                p, lang, z = _scores(b, m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.rows), pa.array(p, pa.float64()),
                     pa.array((p >= 0.5).astype(np.int32)), pa.array([LANGUAGES[k] for k in lang], pa.string()),
                     pa.array(z, pa.float64())], names=[id_col, "score", "predicted", "language", "logit"])

    return docs.select(id_col, text_col).mapInArrow(
        tidy(run), f"`{id_col}` {kind}, score double, predicted int, language string, logit double")


def without_toxic(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows predicted toxic."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        for batch in batches:
            keep = [_scores(b, m)[0] < 0.5 for b in blocks(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), docs.schema)
