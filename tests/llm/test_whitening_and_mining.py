"""Embedding whitening and hard-negative mining against plain versions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lithos.llm import hard_negatives as hn
from lithos.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, w int, place long"


def vectors(spark, rows):
    """Rows (id, vector, label) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, l, 7, 7) for i, v, l in rows], SCHEMA)


# ---- whitening

@pytest.mark.parametrize("name", ["random", "few rows", "identity", "near identity", "repeated values", "zero columns", "one", "wide"])
def test_solver_against_svd(name):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    a = {"random": rng.standard_normal((300, 48)), "few rows": rng.standard_normal((10, 48)), "identity": np.eye(48),
         "near identity": np.eye(48) + 1e-7 * rng.standard_normal((48, 48)),
         "repeated values": q * np.repeat([5, 3, 3, 1], 12) @ q.T,
         "zero columns": np.hstack([rng.standard_normal((100, 5)), np.zeros((100, 3)), np.ones((100, 1))]),
         "one": np.ones((5, 1)), "wide": rng.standard_normal((300, 160))}[name]
    w = a.shape[1]
    r = np.vstack([np.linalg.qr(a, mode="r"), np.zeros((max(0, w - len(a)), w))])
    d, u, v = wh.bidiagonal(r)
    values, z = wh.directions(d, u)
    expected = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(np.maximum(values, 0)), expected, rtol=1e-12, atol=1e-13 * expected[0])
    real = np.sqrt(np.maximum(values, 0)) > 1e-10 * expected[0]
    x = (v @ z)[:, real]
    assert np.abs(x.T @ x - np.eye(x.shape[1])).max() < 1e-10
    assert np.abs(r.T @ (r @ x) - x * values[real]).max() < 1e-10 * values[0]


def test_dqds_is_accurate_for_tiny_values():
    """Products of the values of a graded bidiagonal matrix, which rounding against the largest would lose."""
    d, u = np.array([1.0, 1e-6, 1e-12, 1e-18]), np.array([1e-3, 1e-9, 1e-15])
    values = wh.dqds(d, u)
    product = math.prod(Fraction(float(x)) ** 2 for x in d)
    assert abs(math.prod(Fraction(float(v)) for v in values) / product - 1) < 1e-12
    assert values[-1] > 0


def plain_whitening(rows, components):
    good = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, w = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(w)]
    d = [[n * c - t for c, t in zip(r, s)] for r in x]
    y = np.array([[float(Fraction(c, n)) for c in r] for r in d])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return {i: (n, sum(c * c for c in r), p @ q[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum())
            for (i, _), r, p in zip(good, d, y)}


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist(), 1) for i in range(500)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 11 + [None], 1), (903, [float("nan")] * 12, 1),
             (904, [float("inf")] * 12, 1), (905, rows[0][1], None)]
    expected = plain_whitening(rows, 8)
    got = {}
    for r in wh.whiten(vectors(spark, rows).repartition(7), "vec_id", "embedding", 8).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(expected) == {*range(500), 905}
    signs = np.sign([got[0][k + 1]["whitened"] * expected[0][2][k] for k in range(8)])
    for i, (n, deviation, white, share) in expected.items():
        assert sorted(got[i]) == list(range(1, 9))
        for k in range(8):
            r = got[i][k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["whitened"] - signs[k] * white[k]) < 1e-9 and abs(r["explained"] / share[k] - 1) < 1e-10
    errors = {r["identity_error"] for i in got for r in got[i].values()}
    assert len(errors) == 1 and errors.pop() < 1e-10


def test_whitening_odd_tables(spark):
    assert wh.whiten(vectors(spark, []), "vec_id", "embedding").count() == 0
    assert wh.whiten(vectors(spark, [(1, [1.0, 2.0], 1)]), "vec_id", "embedding").count() == 0
    assert wh.whiten(vectors(spark, [(1, [1.0, 2.0], 1)] * 5), "vec_id", "embedding").count() == 0
    rng = np.random.default_rng(8)
    mixed = [(i, rng.standard_normal(3 + 2 * (i % 2)).tolist(), 1) for i in range(60)] + [(None, [0.5, 0.25, -1.0], 1)]
    out = wh.whiten(vectors(spark, mixed), "vec_id", "embedding").collect()
    assert {(r["vec_id"] % 2, r["n"]) for r in out if r["vec_id"] is not None} == {(0, 31), (1, 30)}
    assert len(out) == 31 * 3 + 30 * 5 and sum(r["vec_id"] is None for r in out) == 3
    # a constant dimension has no variance; entries beyond any long count as the greatest
    flat = [(i, [float(i), 3.0, 1e300 if i == 4 else 0.0], 1) for i in range(5)]
    out = wh.whiten(vectors(spark, flat), "vec_id", "embedding").collect()
    assert {r["component"] for r in out} == {1} and max(r["deviation"] for r in out) == (1 << 63) - 1
    assert wh.deviations(wh.centred(np.array([[1 << 40], [0]]), 2, (1 << 40,))).tolist() == [(1 << 63) - 1] * 2


def test_whitening_parts_are_merged_in_levels(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(4).tolist(), 1) for i in range(600)]
    out = wh.whiten(vectors(spark, rows).repartition(wh.FAN_IN * 2 + 3), "vec_id", "embedding").collect()
    assert len(out) == 2400 and out[0]["identity_error"] < 1e-10


# ---- hard negatives

def plain_mining(rows, k=5):
    good = []
    for i, v, label in rows:
        if i is None or label is None or not v or not all(x is not None and math.isfinite(x) for x in v):
            continue
        good.append((i, [max(-1 << 62, min(1 << 62, math.floor(Fraction(x) * 256))) for x in v],
                     (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, la in {(i, tuple(x), l) for i, x, l in good if i % 100 == 0}:
        seen = sorted(((-sum(p * q for p, q in zip(x, y)), i, l) for i, y, l in good if i != a and len(y) == len(x)))
        for s, p, _ in [t for t in seen if t[2] == la][:k]:
            s = -s
            found = [t for t in seen if t[2] != la and 80 * s <= -100 * t[0] <= 100 * s][:k]
            out += [(a, p, r + 1, i, s, -t) for r, (t, i, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, parts=3):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hn.mine(vectors(spark, rows).repartition(parts), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("rows,anchors,broadcast", [(8192, 4096, 1 << 25), (64, 2, 1 << 25), (32, 2, 0)])
def test_mining_against_plain(spark, monkeypatch, rows, anchors, broadcast):
    """In one block, in many, and with anchors that are too many to broadcast."""
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(hn, "TOGETHER", 4)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 24))
    data = [(i, (centres[i % 6] + 0.8 * rng.standard_normal(24)).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    data += [(10_000 + i, data[i][1], data[i][2]) for i in range(0, 40)]  # ties
    data += [(800, None, 1), (900, data[5][1], None), (None, data[6][1], 1), (1000, [float("nan")] * 24, 2),
             (1100, [1.0, 2.0], 2), (1200, [], 1), (300, data[300][1], data[300][2])]
    got = mined(spark, data)
    assert got == plain_mining(data) and len(got) > 100


def test_mining_zero_negative_and_huge_scores(spark):
    data = [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [3.0, 0.0], 2), (3, [0.0, 1.0], 3),  # all scores zero
            (100, [-1.0, -1.0], 4), (101, [1.0, 0.5], 4), (102, [0.5, 0.5], 5),  # negative positives: no window
            (200, [1e10, 1.0], 6), (201, [1e10, 2.0], 6), (202, [0.9e10, 2.0], 8), (204, [1e300, 2.0], 8), (205, [1e-3, 0.0], 8),
            (400, [1e300, 1e300], 3), (401, [1e300, 1e299], 3), (402, [1e299, 1e300], 2)]
    assert mined(spark, data) == [tuple(max(-1 << 63, min((1 << 63) - 1, x)) for x in r) for r in plain_mining(data)]


def test_mining_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (100, [1.0], 1), (101, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [1.0], 2)]) == []


def test_mining_query_matches_sql(spark, sf_dir):
    import __spark_entry__ as E
    from tests.oracle_harness import compare, duck

    name = "op12_hard_negatives"
    ok, message = compare(spark, duck(sf_dir), sf_dir, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, message


def test_whitening_query(spark, sf_dir):
    import __spark_entry__ as E

    out = E.queries()["op11_embedding_whitening"](spark, sf_dir)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert out.count() == 32 * n and out.first()["identity_error"] < 1e-10


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((4000, 32)) * 100 / np.arange(1, 33))
    block = hn.Columns(np.arange(4000), np.zeros(4000, int), x)
    a = np.floor(rng.standard_normal(32) * 100 / np.arange(1, 33))
    exact = x @ a
    score, at = hn.best(a, block, np.arange(4000), 5)
    assert len(at) < 400 and (score == exact[at]).all()
    assert set(np.argsort(-exact)[:5]) <= set(at.tolist())
    windows = [(int(exact.max()) // 2, int(exact.max()) // 2 + 500)]
    score, at = hn.in_windows(a, block, np.arange(4000), windows, 5, [None])
    inside = np.flatnonzero((exact >= windows[0][0]) & (exact <= windows[0][1]))
    want = sorted(inside, key=lambda i: (-exact[i], i))[:5]
    assert set(want) <= set(at.tolist()) and len(at) < 2000
