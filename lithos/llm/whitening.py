"""Embedding whitening by a bidiagonal qd solver.

Components x are floor(scale * c) + shift, as whole numbers. One pass sums them (exactly, in Spark), a second
centres every row as (n * x - S) / n, whose numerator is exact, and reduces blocks of rows by QR to a triangle
each; triangles are stacked and reduced again in a tree of bounded fan-in, so that one of the vectors' width is
left. Householder reflections make that R bidiagonal, dqds finds its squared singular values to high relative
accuracy, and twisted factorisations of the shifted tridiagonal give one direction each; directions of values
that lie close together are made orthogonal by inverse iteration from there. Rows are projected
on the directions and divided by the deviations. A last pass sums the covariance of what comes out and reports
its distance from the identity.

Defined results: rows with a null vector, an empty one, or null or non-finite components are left out. Vectors
of different lengths are fitted apart, each length by itself. A direction without variance (a singular value
below 1e-10 of the largest) has no whitening and gives no rows: a single row, or equal rows, give none. Entries
beyond 2**62 after scaling count as that value; a deviation beyond a long is the largest long. Rows that repeat
an id count one by one, a null id stays null, other columns are ignored, an empty table gives no rows. A
direction's sign is such that its largest entry is positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lithos.llm.store import written
from lithos.llm.text import tidy

#: Rows of a block that is reduced at once; partial results that one task merges.
BLOCK_ROWS, FAN_IN = 4096, 16
_EPS = np.finfo(float).eps
#: Share of the largest singular value below which one counts as zero: QR leaves errors of some 1e-15 of the
#: largest, and a direction's unit variance shall hold to 1e-4.
_NOISE = 1e-10
_CAP = 1 << 62
_PARTS = "width int, part int, data binary"


# ---- the bidiagonal solver -------------------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of U.T @ r @ V for a square ``r``, by Householder reflections."""
    a, n = r.astype(float).copy(), len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray):
        norm = np.linalg.norm(x)
        if not norm:
            return None
        u = x.copy()
        u[0] += math.copysign(norm, x[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < n:
            u = reflector(a[k, k + 1:])
            if u is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: list, e: list, tau: float):
    """One differential qd transform shifted by ``tau``; (q, e, least d), or None if a pivot turns negative."""
    n, d = len(q), q[0] - tau
    least, qq, ee = d, [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] == 0.0:
            ee[i], d = 0.0, q[i + 1] - tau
        else:
            t = q[i + 1] / qq[i]
            ee[i] = e[i] * t
            d = d * t - tau
        least = min(least, d)
    if d < 0:
        return None
    qq[-1] = d
    return qq, ee, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal matrix, to high relative accuracy."""
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if not scale:
        return np.zeros(len(diagonal))
    out: list[float] = []
    todo = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0, 0.0)]
    tol = (10 * _EPS) ** 2
    while todo:
        q, e, sigma, carry = todo.pop()
        tau = 0.0
        for _ in range(60 * len(q) + 60):
            # values that have split off at the end are final
            while len(q) > 1 and e[-1] <= tol * (sigma + q[-1]):
                out.append(q.pop() + sigma + carry)
                e.pop()
            if len(q) == 1:
                out.append(q[0] + sigma + carry)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tol * min(sigma + q[i], sigma + q[i + 1])), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut + 1][:-1], sigma, carry))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end belongs at the end
                q.reverse()
                e.reverse()
            # least value of the last two by two block, a little less
            b, c = q[-2] + e[-1], q[-1]
            half, rest = (b + c) / 2, q[-2] * q[-1]
            low = rest / (half + math.sqrt(max(half * half - rest, 0.0))) if half else 0.0
            tau = low * (1 - 4 * _EPS) if e[-1] < 1e-3 * q[-1] else 0.5 * low
            step = None
            for attempt in (tau, 0.75 * tau, 0.25 * tau, 0.0):
                step = _dqds_step(q, e, attempt)
                if step:
                    tau = attempt
                    break
            q, e, _ = step
            # the shifts are summed with their rounding error
            total = sigma + tau
            carry += (sigma - total) + tau if sigma >= tau else (tau - total) + sigma
            sigma = total
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(out))[::-1] * scale * scale


class Twisted:
    """Twisted factors N diag(p) N.T of L D L.T - value, for the tridiagonal B.T @ B of a bidiagonal B."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        d = diagonal * diagonal
        low = above / diagonal[:-1]
        n, tiny = len(d), max(float(d.max()) * _EPS * _EPS, 1e-290)

        def pivot(x: float) -> float:
            return x if abs(x) > tiny else math.copysign(tiny, x)

        self.down, s_all, top = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        s = -value
        for i in range(n - 1):
            s_all[i] = s
            top[i] = pivot(s + d[i])
            self.down[i] = d[i] * low[i] / top[i]
            s = self.down[i] * low[i] * s - value
        s_all[-1] = s
        top[-1] = pivot(s + d[-1])
        self.up, p_all, bottom = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        p = d[-1] - value
        p_all[-1] = p
        for i in range(n - 2, -1, -1):
            bottom[i + 1] = pivot(d[i] * low[i] * low[i] + p)
            t = d[i] / bottom[i + 1]
            self.up[i] = low[i] * t
            p = p * t - value
            p_all[i] = p
        gamma = s_all + p_all + value
        self.r = int(np.argmin(np.abs(gamma)))
        self.n = n

    def vector(self) -> np.ndarray:
        """The solution of the factors that is one at the twist: the direction, to rounding."""
        x = np.zeros(self.n)
        x[self.r] = 1.0
        for i in range(self.r - 1, -1, -1):
            x[i] = -self.down[i] * x[i + 1]
        for i in range(self.r, self.n - 1):
            x[i + 1] = -self.up[i] * x[i]
        return x / np.linalg.norm(x)


def _refined(t: np.ndarray, value: float, z: np.ndarray, w: np.ndarray, random) -> np.ndarray:
    """A direction of ``value`` orthogonal to the rows of ``w``, which hold directions of values close to it:
    inverse iteration with the tridiagonal ``t``, each time without what the neighbours hold already."""
    # values of a cluster are told apart by some roundings of the matrix, so that the system is regular
    shifted = t - np.eye(len(t)) * (value + 4 * _EPS * (len(w) + 1) * np.abs(t).max())
    for _ in range(4):
        rest = z - w.T @ (w @ z)
        if np.linalg.norm(rest) < 1e-3:
            rest = random.standard_normal(len(t))
        rest -= w.T @ (w @ rest)
        z = np.linalg.solve(shifted, rest / np.linalg.norm(rest))
        z /= np.linalg.norm(z)
        z -= w.T @ (w @ z)
        left = np.linalg.norm(z)
        z -= w.T @ (w @ z)
        z /= np.linalg.norm(z)
        if left > 0.5:
            break
    return z


def directions(diagonal: np.ndarray, above: np.ndarray, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values falling, right singular vectors as columns) of an upper bidiagonal matrix."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not norm:
        return np.zeros(n), np.eye(n)
    # entries within the rounding of the matrix: a zero pivot gets a value there, a zero link splits
    diagonal = np.where(np.abs(diagonal) < norm * _EPS * 1e-3, norm * _EPS * 1e-3, diagonal)
    weak = np.abs(above) <= _EPS * 1e-1 * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    cuts = [0, *(np.flatnonzero(weak) + 1).tolist(), n]
    values, vectors = [], []
    random = np.random.default_rng(1)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        d, u = diagonal[lo:hi], above[lo:hi - 1]
        t = np.diag(d * d) + np.diag(d[:-1] * u, 1) + np.diag(d[:-1] * u, -1)
        t[np.arange(1, hi - lo), np.arange(1, hi - lo)] += u * u
        found: list[tuple[float, np.ndarray]] = []
        for value in dqds(d, u):
            factors = Twisted(d, u, float(value))
            z = factors.vector()
            near = [w for other, w in found if abs(other - value) <= close * abs(other)]
            if near:
                z = _refined(t, float(value), z, np.array(near), random)
            found.append((float(value), z))
        for value, z in found:
            whole = np.zeros(n)
            whole[lo:hi] = z
            values.append(value)
            vectors.append(whole)
    order = np.argsort(np.array(values), kind="stable")[::-1]
    return np.array(values)[order], np.array(vectors)[order].T


# ---- fit and projection ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    """Whitening of the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # columns, by falling variance
    variances: np.ndarray
    trace: float

    @property
    def kept(self) -> int:
        return len(self.variances)


def whole_numbers(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as long; beyond 2**62 that value counts."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * c)
    out = np.clip(x, -float(_CAP), float(_CAP) - 1024).astype(np.int64)
    return out + np.int64(shift)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: longs where they suffice, whole numbers of any size elsewhere."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max((abs(s) for s in sums), default=0)
    if most < _CAP:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> np.ndarray:
    """Sum of squares of every row of ``d``, exact; beyond a long the largest long."""
    top = max(abs(int(d.min(initial=0))), abs(int(d.max(initial=0))))
    if top * top * max(d.shape[1], 1) < _CAP:
        d = d.astype(np.int64)
        return np.einsum("nd,nd->n", d, d)
    d = d.astype(object)
    return np.array([min(int(s), (1 << 63) - 1) for s in (d * d).sum(1)], np.int64)


def _matrix(column, scale: int, shift: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole_numbers(flat.reshape(len(column), -1), scale, shift)


def _by_width(batch: pa.RecordBatch):
    """(width, rows of the batch of that width)."""
    sizes = np.asarray(batch.column("w"))
    for w in np.unique(sizes):
        yield int(w), batch.filter(pa.array(sizes == w))


def _reduced(parts: DataFrame, merge: Callable[[list[bytes], int], bytes]) -> dict[int, bytes]:
    """The merged data of every width: groups of FAN_IN parts are merged level by level in tasks, and one
    result a width reaches the driver."""
    most = parts.agg(F.max("part")).first()[0]

    def run(table: pa.Table) -> pa.Table:
        width, part = table["width"][0].as_py(), table["part"][0].as_py() // FAN_IN
        table = table.sort_by("part")
        return pa.table({"width": pa.array([width], pa.int32()), "part": pa.array([part], pa.int32()),
                         "data": pa.array([merge(table["data"].to_pylist(), width)], pa.binary())})

    while most:
        parts = parts.groupBy("width", F.floor(F.col("part") / FAN_IN)).applyInArrow(run, _PARTS)
        most //= FAN_IN
    return {r["width"]: r["data"] for r in parts.collect()}


def _partial(rows: DataFrame, state: Callable, add: Callable, name: str) -> DataFrame:
    """One (width, part, data) row a task and width: ``add(state, width, vectors)`` over the task's rows."""
    def run(batches):
        held: dict[int, object] = {}
        for batch in batches:
            for w, some in _by_width(batch):
                for lo in range(0, some.num_rows, BLOCK_ROWS):
                    held[w] = add(held.get(w, state(w)), w, some.column("v").slice(lo, BLOCK_ROWS))
        part = TaskContext.get().partitionId()
        for w, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([part], pa.int32()),
                                              pa.array([s.tobytes()], pa.binary())], names=["width", "part", "data"])

    return written(rows.mapInArrow(tidy(run), _PARTS), name)


def sound_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as doubles, w its length) of the rows whose vector has finite components only."""
    v = F.col(vec_col)
    rows = rows.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))) \
        .withColumn("w", F.size("v"))


def fit(vectors: DataFrame, components: int, scale: int, shift: int) -> dict[int, Fit]:
    """The whitening of every vector length (``vectors`` as from ``sound_vectors``)."""
    def sums(batches):
        for batch in batches:
            for w, some in _by_width(batch):
                x = _matrix(some.column("v"), scale, shift)
                fits = int(np.abs(x).max()) * len(x) < _CAP
                s = x.sum(0) if fits else x.astype(object).sum(0)
                k = len(s) + 1
                # entry -1 counts the rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w] * k, pa.int32()), pa.array(range(-1, k - 1), pa.int32()),
                     pa.array([len(x), *map(int, s)], pa.decimal128(38))], names=["w", "k", "s"])

    total = vectors.mapInArrow(tidy(sums), "w int, k int, s decimal(38,0)").groupBy("w", "k").agg(F.sum("s").alias("s"))
    by_width: dict[int, dict[int, int]] = {}
    for r in total.collect():  # one number for each dimension of a vector length
        by_width.setdefault(r["w"], {})[r["k"]] = int(r["s"])
    centre = {w: (s[-1], tuple(s[k] for k in range(w))) for w, s in by_width.items()}
    if not centre:
        return {}

    def triangle(stack: np.ndarray, w: int) -> np.ndarray:
        r = np.linalg.qr(stack, mode="r")
        return r if len(r) == w else np.vstack([r, np.zeros((w - len(r), w))])

    def add(r: np.ndarray, w: int, column) -> np.ndarray:
        n, s = centre[w]
        y = centred(_matrix(column, scale, shift), n, s).astype(float) / n
        return triangle(np.vstack([r, y]), w)

    def merge(parts: list[bytes], w: int) -> bytes:
        r = np.zeros((0, w))
        for p in parts:
            r = triangle(np.vstack([r, np.frombuffer(p).reshape(-1, w)]), w)
        return r.tobytes()

    triangles = _reduced(_partial(vectors, lambda w: np.zeros((0, w)), add, "triangles"), merge)
    out = {}
    for w, data in triangles.items():
        n, s = centre[w]
        diagonal, above, v = bidiagonal(np.frombuffer(data).reshape(w, w))
        values, z = directions(diagonal, above)
        real = np.sqrt(np.maximum(values, 0)) > _NOISE * math.sqrt(max(values[0], 0.0))
        k = min(int(np.count_nonzero(real)), components)
        d = v @ z[:, :k]
        d *= np.sign(d[np.abs(d).argmax(0), np.arange(k)]) if k else 1.0
        out[w] = Fit(n, s, d, values[:k] / n, float(values.sum()) / n)
    return out


def whitened(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(exact deviations, whitened coordinates) of rows of whole numbers."""
    d = centred(x, model.n, model.sums)
    y = d.astype(float) / model.n
    return deviations(d), (y @ model.directions) / np.sqrt(model.variances)


def identity_errors(vectors: DataFrame, model: dict[int, Fit], scale: int, shift: int) -> dict[int, float]:
    """Largest entry of (covariance of the whitened rows - identity) for every vector length: counts, means and
    centred products of blocks are merged pair by pair."""
    def pack(n: float, mean: np.ndarray, m2: np.ndarray) -> np.ndarray:
        return np.concatenate([[n], mean, m2.ravel()])

    def unpack(s: np.ndarray, k: int):
        return s[0], s[1:k + 1], s[k + 1:].reshape(k, k)

    def joined(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        (na, ma, qa), (nb, mb, qb) = unpack(a, k), unpack(b, k)
        if not na:
            return b
        d, n = mb - ma, na + nb
        return pack(n, ma + d * (nb / n), qa + qb + np.outer(d, d) * (na * nb / n))

    def empty(w: int) -> np.ndarray:
        k = model[w].kept
        return np.zeros(1 + k + k * k)

    def add(s: np.ndarray, w: int, column) -> np.ndarray:
        _, z = whitened(_matrix(column, scale, shift), model[w])
        mean = z.mean(0)
        return joined(s, pack(len(z), mean, (z - mean).T @ (z - mean)), model[w].kept)

    def merge(parts: list[bytes], w: int) -> bytes:
        s = empty(w)
        for p in parts:
            s = joined(s, np.frombuffer(p), model[w].kept)
        return s.tobytes()

    out = {}
    for w, data in _reduced(_partial(vectors, empty, add, "covariances"), merge).items():
        n, _, q = unpack(np.frombuffer(data), model[w].kept)
        out[w] = float(np.abs(q / n - np.eye(model[w].kept)).max(initial=0.0))
    return out


def whiten(rows: DataFrame, id_col: str, vec_col: str, components: int = 32, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for every sound row and component
    with variance, ``components`` at most; see the module's text."""
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = sound_vectors(rows, id_col, vec_col)
    model = fit(vectors, components, scale, shift)
    model = {w: m for w, m in model.items() if m.kept}
    schema = (f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not model:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(F.col("w").isin(*model))
    error = identity_errors(vectors, model, scale, shift)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for w, some in _by_width(batch):
                m = model[w]
                for lo in range(0, some.num_rows, BLOCK_ROWS):
                    part = some.slice(lo, BLOCK_ROWS)
                    deviation, z = whitened(_matrix(part.column("v"), scale, shift), m)
                    n, k = z.shape
                    ids = part.column("id").take(pa.array(np.repeat(np.arange(n), k)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)),
                         pa.array(np.repeat(deviation, k)), pa.array(z.ravel()),
                         pa.array(np.tile(m.variances / m.trace, n)), pa.array(np.full(n * k, error[w]))], names=names)

    return vectors.mapInArrow(tidy(run), schema)
