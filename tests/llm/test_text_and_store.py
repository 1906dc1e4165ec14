import numpy as np
import pyarrow as pa

from lithos.llm import store, text
from lithos.llm.eliasfano import EliasFano, pack_counts, unpack_counts

from .helpers import ODD_ROWS, groups, words


def test_words_and_hashes():
    column = pa.array([t for _, t in ODD_ROWS], pa.string()).slice(1)
    texts = column.to_pylist()
    for limit in (1, 30, 1 << 20):
        seen = {}
        for b in text.blocks(column, limit):
            w = text.Words(b.raw, b.offsets)
            h = text.SpanHash(b.raw)(w.start, w.end)
            for row in range(b.rows):
                span = slice(w.first[row], w.first[row + 1])
                got = [bytes(b.raw[s:e]).decode() for s, e in zip(w.start[span], w.end[span])]
                assert got == words(texts[b.lo + row])
                for k, v in zip(got, h[span].tolist()):
                    assert seen.setdefault(k, v) == v
        assert len(set(seen.values())) == len(seen)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 5), (1000, (1 << 64) - 1), (5000, 6000), (300, 1 << 50)):
        v = np.sort(rng.integers(0, min(top, (1 << 63) - 1), n).astype(np.uint64))
        e = EliasFano(n, top, EliasFano.encode(v, top).data)
        assert (e.values() == v).all()
        q = np.append(rng.integers(0, min(top, (1 << 63) - 1), 200).astype(np.uint64), v[:200])
        lo, hi = np.zeros(len(q), int), np.full(len(q), n)
        assert (e.successor(q, lo, hi) == np.searchsorted(v, q)).all()
        lo, hi = lo + n // 3, hi - n // 4
        assert (e.successor(q, lo, hi) == np.clip(np.searchsorted(v, q), lo, np.maximum(lo, hi))).all()
    c = np.array([0, 1, 254, 255, 256, 10**12])
    assert (unpack_counts(pack_counts(c), 6) == c).all()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))]
    edges += [(i, i + 1) for i in range(1000, 1030)] + [(5000, 5000 + i) for i in range(1, 20)] + [(-5, 7000)]
    edges = [(a, b) for a, b in edges if a != b]
    want = groups(edges, {x for e in edges for x in e})
    df = spark.createDataFrame(edges + [(9, 9)], "src long, dst long").repartition(3)
    for one_task in (10**6, 0):
        assert {r[0]: r[1] for r in store.components(df, one_task=one_task).collect()} == want
    assert store.components(df.limit(0)).count() == 0
