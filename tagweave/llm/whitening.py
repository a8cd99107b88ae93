"""Embedding whitening by a bidiagonal qd solver.

Entries become fixed-point longs, so counts, sums and deviations are exact. The centred rows
of every task are reduced block by block to a triangle R with the same R'R, and triangles are
reduced in turn until one is left, whose size is the dimension's. Householder reflections
from both sides make it bidiagonal. The dqds algorithm finds the squares of its singular
values to high relative accuracy: each step is a qd transform with a shift below the smallest
value that is left, taken from the trace of the inverse. For every wanted value a stationary and
a progressive transform of the shifted matrix meet in a twisted factorisation, at the place
where the remainder is least; its solution is the singular vector, mended by Rayleigh
correction and, among close values, by orthogonalisation. The covariance is never formed.

Defined cases: vectors that are null, hold null or non-finite entries, or entries of 2^30 and
more (no exact fixed point in a sum) are dropped; so are vectors whose length is not the most
frequent one (of equally frequent ones the longest). Ids may be null or repeated, each row is
its own. Directions without variance, to double precision, give no component: a table with
equal vectors, or one, or none, gives no rows.
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import saved

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 30)
COMPONENTS = 8
BLOCK_ROWS = 4096
# Triangles that one task, or the driver at the end, reduces in turn.
FAN_IN = 16
EPS = np.finfo(np.float64).eps
TINY = 1e-150


def fixed_point(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the usable rows, and their dimension."""
    usable = embeddings.filter(F.col(vector).isNotNull()).select(
        "vec_id", F.transform(vector, lambda c: c.cast("double")).alias("c"))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    usable = usable.filter(F.coalesce(fine, F.lit(False)))
    lengths = usable.groupBy(F.size("c").alias("dims")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    dims = top["dims"] if top else 0
    x = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return usable.filter(F.size("c") == dims).select("vec_id", x.alias("x")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def sums(rows: DataFrame, dims: int) -> tuple[int, list]:
    """Number of rows and exact sum of every dimension; one row per task and dimension is shuffled."""
    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                 pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    found = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_place = {r["i"]: r for r in found.collect()}
    return (by_place[0]["n"], [int(by_place[i]["s"]) for i in range(dims)]) if by_place else (0, [0] * dims)


class Centre:
    """The mean as an integer and a remainder per dimension: S = n * whole + rest."""

    def __init__(self, n: int, total: list):
        self.n = n
        self.whole = np.array([s // n for s in total], dtype=np.int64)
        self.rest = [s % n for s in total]
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Centred rows, each entry rounded once."""
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n * x - S)^2 as exact integers, from y = x - whole."""
        y, rest = x - self.whole, np.array(self.rest, dtype=object)
        largest, dims = int(np.abs(y).max(initial=0)), max(1, y.shape[1])
        if largest ** 2 * dims < 1 << 62 and self.n * max(1, largest) * dims < 1 << 62:
            squares, mixed = (y * y).sum(axis=1).tolist(), (y @ rest.astype(np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, mixed = (wide * wide).sum(axis=1).tolist(), (wide @ rest).tolist()
        fixed = sum(r * r for r in self.rest)
        return [self.n * self.n * a - 2 * self.n * b + fixed for a, b in zip(squares, mixed)]


def stacked(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangle of all rows seen so far."""
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def triangle(rows: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """R of the centred rows: per task, then FAN_IN at a time until so many are left."""
    def first(batches):
        found = None
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            for at in range(0, len(x), BLOCK_ROWS):
                found = stacked(found, centre.rows(x[at:at + BLOCK_ROWS]))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["r"])

    def further(batches):
        found = None
        for batch in batches:
            for data in batch.column("r").to_pylist():
                found = stacked(found, np.frombuffer(data).reshape(-1, dims))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["r"])

    parts = saved(rows.select("x").mapInArrow(first, "r binary"), "triangles")
    while (left := parts.count()) > FAN_IN:
        parts = saved(parts.repartition(math.ceil(left / FAN_IN)).mapInArrow(further, "r binary"), "triangles")
    found = None
    for row in parts.toLocalIterator():
        found = stacked(found, np.frombuffer(bytes(row["r"])).reshape(-1, dims))
    whole = np.zeros((dims, dims))
    whole[:len(found)] = found
    return whole


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector u such that x - 2u(u'x) has only a first entry, and that entry."""
    size = np.linalg.norm(x)
    u = x.copy()
    if size == 0:
        return u, 0.0
    first = -math.copysign(size, x[0])
    u[0] -= first
    return u / np.linalg.norm(u), first


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of U'RV: Householder reflections from both sides."""
    a, dims = r.copy(), len(r)
    v, diagonal, above = np.eye(dims), np.zeros(dims), np.zeros(max(0, dims - 1))
    for k in range(dims):
        u, diagonal[k] = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < dims:
            u, above[k] = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return diagonal, above, v


def qd_step(q: list, e: list, shift: float):
    """One dqds transform; None if the shift was above the smallest value."""
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        total = max(d + e[i], TINY)
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    return (new_q + [d], new_e) if d >= 0 else None


def lower_bound(q: list, e: list) -> float:
    """One over the trace of the inverse of B'B: at most its smallest eigenvalue."""
    row = total = 0.0
    for i in range(len(q) - 1, -1, -1):
        row = (1 + (e[i] * row if i < len(e) else 0.0)) / q[i] if q[i] > 0 else math.inf
        total += row
    return 1 / total


def qd_values(q: list, e: list) -> list:
    """All eigenvalues of B'B, given the squares of B's diagonal and superdiagonal."""
    q, e, found, moved = list(q), list(e), [], 0.0
    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (moved + q[-1]):
            found.append(moved + q.pop())
            if e:
                e.pop()
            continue
        bound = lower_bound(q, e)
        for shift in (bound, bound * (1 - 1e-8), bound / 2, 0.0):  # rounding may lift the bound over the value
            if stepped := qd_step(q, e, shift):
                break
        q, e = stepped
        moved += shift
    return found


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, skip=()) -> tuple[np.ndarray, float, int]:
    """Solution of a twisted factorisation of B'B - value, its remainder and its place."""
    size = len(diagonal)
    d, low = diagonal ** 2, above / diagonal[:-1]

    def safe(x):
        return x if abs(x) > TINY else math.copysign(TINY, x)

    down, s = np.zeros(size), np.empty(size)
    s[0] = -value
    for i in range(size - 1):  # stationary: from the top
        down[i] = d[i] * low[i] / safe(s[i] + d[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(size), np.empty(size)
    p[-1] = d[-1] - value
    for i in range(size - 2, -1, -1):  # progressive: from the bottom
        ratio = d[i] / safe(d[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    rest = np.abs(s + p + value)
    for place in skip:
        rest[place] = np.inf
    place = int(np.argmin(rest))
    z = np.zeros(size)
    z[place] = 1.0
    for i in range(place - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(place, size - 1):
        z[i + 1] = -up[i] * z[i]
    return z, float((s + p + value)[place]), place


def vector_of(diagonal: np.ndarray, above: np.ndarray, value: float, close: list) -> np.ndarray:
    """Unit right singular vector for a value, orthogonal to those of close values."""
    skip = []
    while True:
        near, z = value, None
        for _ in range(3):
            z, rest, place = twisted(diagonal, above, near, skip)
            size = np.linalg.norm(z)
            step = rest / (size * size)
            z /= size
            if not 1e-3 * EPS * value < abs(step) < 1e-8 * value:
                break
            near += step
        first = z
        for _ in range(2):
            for other in close:
                z = z - other * (other @ z)
        if np.linalg.norm(z) > 0.5 * np.linalg.norm(first) or len(skip) == len(diagonal) - 1:
            return z / np.linalg.norm(z)
        skip.append(place)


def components(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest squared singular values of R, falling, and their right singular vectors as columns."""
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((len(r), 0))
    diagonal, above, v = bidiagonal(r / size)
    whole = np.sqrt((diagonal ** 2).sum() + (above ** 2).sum())
    # A diagonal of zero is a value far below rounding; a superdiagonal below rounding splits B.
    diagonal = np.where(np.abs(diagonal) < 1e-20 * whole, np.copysign(1e-20 * whole, diagonal), diagonal)
    above = np.where(np.abs(above) <= 0.5 * EPS * whole, 0.0, above)
    bounds = [0, *(np.nonzero(above == 0)[0] + 1), len(diagonal)]
    found = []
    for start, end in zip(bounds, bounds[1:]):
        values = qd_values((diagonal[start:end] ** 2).tolist(), (above[start:end - 1] ** 2).tolist())
        found += [(value, start, end) for value in values]
    found = sorted(found, reverse=True)[:k]
    limit = (len(r) * EPS) ** 2 * found[0][0]
    found = [f for f in found if f[0] > limit]
    inner = []
    for at, (value, start, end) in enumerate(found):
        close = [z[start:end] for (other, s, _), z in zip(found[:at], inner) if s == start and other - value < 1e-3 * other]
        z = np.zeros(len(r))
        z[start:end] = vector_of(diagonal[start:end], above[start:end - 1], value, close)
        inner.append(z)
    return np.array([f[0] for f in found]) * size * size, v @ np.array(inner).T


def whitened(embeddings: DataFrame, k: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row
    and component; ``deviation`` is a decimal, exact at any size."""
    rows, dims = fixed_point(embeddings, vector)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    spark = embeddings.sparkSession
    n, total = sums(rows, dims) if dims else (0, [])
    squares, directions, trace = np.zeros(0), None, 0.0
    if n:
        centre = Centre(n, total)
        r = triangle(rows, dims, centre)
        squares, directions = components(r, k)
        trace = float((r * r).sum()) / n
    if not len(squares):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                         "explained double, identity_error double")
    values = squares / n
    scaled = directions / np.sqrt(values)

    def project(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            w = centre.rows(x) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([Decimal(d) for d in centre.deviations(x)], pa.decimal128(38, 0)),
                 pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    scores = saved(rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    count = len(values)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    means = scores.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(count)]).first()
    shifted = [F.col("w")[i] - F.lit(means[i]) for i in range(count)]
    gram = scores.agg(*[F.avg(shifted[i] * shifted[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    error = max(abs(g - (i == j)) for g, (i, j) in zip(gram, pairs))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return scores.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
