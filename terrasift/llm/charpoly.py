"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so counts, sums and sums of products over all rows are exact, and
so is the scatter ``M = sum((n x - S)(n x - S)^T) / n = n sum(x x^T) - S S^T``, an integer
matrix with ``M = n^2 V`` for the covariance V. Its characteristic polynomial is found
modulo many primes by reduction to Hessenberg form (a Spark task for each few primes) and
put together by Chinese remaindering. All its roots are real, so the sign changes of the
polynomial shifted by c count the roots above c exactly; the largest roots are separated
and refined to 128 bits after the point. Each component is the null space of M minus its
root, found by inverse iteration in decimals of many digits (a Spark task per root).

Only the scatter (dimensions squared) and the polynomial pass through the driver, nothing
that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import reduce
from math import gcd, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import step

FRACTION = 128  # bits of a root after the point
LIMB = 60  # bits of the lower part of a partial sum


# --- integers and their exact sums ---------------------------------------------------------------


def usable(vectors: DataFrame, vector: str, scale: float) -> DataFrame:
    """Rows whose vector is not null, not empty, and holds only finite entries that stay within a long when scaled."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < float(1 << 62)), F.lit(False)))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _matrix(column: pa.Array, d: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * entry) as doubles that are whole numbers."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, d)


class Sums:
    """Exact count, sums and sums of products."""

    def __init__(self, d: int):
        self.n, self.total, self.products = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        at = 0
        while at < len(x):
            top = max(float(np.abs(x[at : at + 65536]).max()), 1.0)
            if top < 1 << 20:  # doubles add such products exactly
                rows = min(65536, int((1 << 53) / (top * top)))
                part = x[at : at + rows]
                self.products += (part.T @ part).astype(np.int64).astype(object)
                self.total += part.sum(0).astype(np.int64).astype(object)
            else:
                rows = 4096
                whole = x[at : at + rows].astype(np.int64).astype(object)
                self.products += whole.T @ whole
                self.total += whole.sum(0)
            self.n += len(x[at : at + rows])
            at += rows


def scatter_sums(rows: DataFrame, vector: str, d: int, scale: float) -> Sums:
    """Sums over all rows: each task's own, added up by Spark; dimensions squared numbers come to the driver."""
    places = [(-1, -1)] + [(i, -1) for i in range(d)] + [(i, j) for i in range(d) for j in range(i, d)]
    number = pa.decimal128(38, 0)
    schema = "i int, j int, high decimal(38,0), low decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sums(d)
        for batch in batches:
            own.add(_matrix(batch.column(0), d, scale))
        if own.n:
            values = [int(own.n if i < 0 else own.total[i] if j < 0 else own.products[i, j]) for i, j in places]
            columns = [pa.array(c, pa.int32()) for c in zip(*places, strict=True)]
            limbs = [v >> LIMB for v in values], [v & ((1 << LIMB) - 1) for v in values]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([Decimal(v) for v in c], number) for c in limbs)], names=["i", "j", "high", "low"])

    out = Sums(d)
    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, schema)
    for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        value = (int(r.high) << LIMB) + int(r.low)
        if r.i < 0:
            out.n = value
        elif r.j < 0:
            out.total[r.i] = value
        else:
            out.products[r.i, r.j] = out.products[r.j, r.i] = value
    return out


# --- characteristic polynomial -------------------------------------------------------------------


def primes_below(top: int, bits: float) -> list[int]:
    """Primes below ``top``, largest first, whose product has more than ``bits`` bits."""
    small = np.ones(int(top**0.5) + 2, bool)
    small[:2] = False
    for k in range(2, int(len(small) ** 0.5) + 1):
        if small[k]:
            small[k * k :: k] = False
    divisors = np.flatnonzero(small)
    out, have, high = [], 0.0, top
    while have <= bits:
        low = max(high - (1 << 17), 2)
        free = np.ones(high - low, bool)
        for p in divisors[divisors * divisors < high]:
            free[max(p * p, -(-low // p) * p) - low :: p] = False
        for p in (np.flatnonzero(free)[::-1] + low).tolist():
            out.append(p)
            have += log2(p)
            if have > bits:
                break
        high = low
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x I - matrix) modulo a prime below 2^31."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        m = k + 1 + int(below[0])
        if m != k + 1:
            h[[k + 1, m]] = h[[m, k + 1]]
            h[:, [k + 1, m]] = h[:, [m, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading minors
    poly[0, 0] = 1
    for k in range(d):
        poly[k + 1, 1:] = poly[k, :-1]
        factor, weights = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            weights[i] = h[i, k] * factor % p
            if i:
                factor = factor * int(h[i, i - 1]) % p
        poly[k + 1] = (poly[k + 1] - (weights[:, None] * poly[: k + 1] % p).sum(0)) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first, of det(x I - matrix) for a positive semidefinite integer matrix."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # elementary symmetric functions of roots >= 0 are at most those of equal roots: (1 + trace / d)^d bounds them all
    bits = d * log2(1 + -(-trace // d)) + 2
    primes = primes_below(1 << 31, bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["p"].tolist():
                residues = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pd.DataFrame({"p": [p], "poly": [polynomial_mod(residues, p).tolist()]})

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    found = dealt.mapInPandas(run, "p long, poly array<long>").collect()
    product = reduce(lambda a, b: a * b, primes, 1)
    total = [0] * (d + 1)
    for r in found:
        rest = product // r.p
        unit = rest * pow(rest % r.p, -1, r.p)
        total = [t + c * unit for t, c in zip(total, r.poly, strict=True)]
    # the coefficient of x^k has the sign of (-1)^(d - k)
    return [(t if (d - k) % 2 == 0 else t - product * (t > 0)) for k, t in enumerate(t % product for t in total)]


# --- real roots ----------------------------------------------------------------------------------


def _shifted(poly: list[int], c: int) -> list[int]:
    """Coefficients of poly(x + c)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += c * out[k + 1]
    return out


def _above(poly: list[int], c: int) -> int:
    """How many roots exceed c, of a polynomial with real roots only: the sign changes of poly(x + c)."""
    signs = [v > 0 for v in _shifted(poly, c) if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], y: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * y + c
    return out


def largest_roots(poly: list[int], count: int, fraction: int = FRACTION) -> list[tuple[Fraction, int]]:
    """The ``count`` largest positive roots, with multiplicity: (root, how many lie there), falling.

    ``poly`` has real roots >= 0 only. Roots nearer to each other than the last bit count as one.
    """
    while poly and not poly[0]:
        poly = poly[1:]  # roots at zero
    d = len(poly) - 1
    if d < 1:
        return []
    poly = [c << (fraction * (d - k)) for k, c in enumerate(poly)]  # roots in units of the last bit
    top = 1 << max(abs(poly[d - 1]).bit_length(), 1)  # above the sum of the roots
    out, left = [], min(count, d)
    todo = [(0, top, d, 0)]  # (low, high, roots above low, roots above high)
    while todo and left > 0:
        low, high, n_low, n_high = todo.pop()
        n = n_low - n_high
        if not n:
            continue
        if n == 1 or high - low == 1:
            if n == 1:
                sign = 1 if n_high % 2 == 0 else -1  # of the polynomial just above the root
                while high - low > 1:
                    mid = (low + high) // 2
                    v = _value(poly, mid)
                    if v == 0:
                        low, high = mid - 1, mid
                    elif (v > 0) == (sign > 0):
                        high = mid
                    else:
                        low = mid
            n = min(n, left)
            out.append((Fraction(high, 1 << fraction), n))
            left -= n
            continue
        mid = (low + high) // 2
        n_mid = _above(poly, mid)
        todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
    return out


# --- components ----------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: Fraction, many: int, digits: int | None = None) -> list[list[float]]:
    """``many`` orthonormal vectors of the null space of matrix - root, by inverse iteration in decimals.

    The entry of largest size is positive; doubles of the result are exact to rounding.
    """
    d = len(matrix)
    size = max(abs(v) for row in matrix for v in row)
    digits = digits or 80 + len(str(size))
    with localcontext() as context:
        context.prec = digits
        context.Emax, context.Emin = 999_999_999, -999_999_999
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[range(d), range(d)] -= value
        tiny = Decimal(size) * Decimal(10) ** (10 - digits)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b):
            b = b[order]
            for k in range(1, d):
                b[k] -= a[k, :k].dot(b[:k])
            for k in range(d - 1, -1, -1):
                rest = a[k, k + 1 :].dot(b[k + 1 :]) if k + 1 < d else 0
                b[k] = (b[k] - rest) / a[k, k]
            return b

        found: list[np.ndarray] = []
        for m in range(many):
            v = np.array([Decimal(1 + (i * (2 * m + 7) + m * m) % 101) for i in range(d)], object)
            for _ in range(4):
                v = solve(v)
                v = v / max(abs(x) for x in v)
                for w in found:
                    v = v - w * w.dot(v)
                v = v / v.dot(v).sqrt()
            found.append(v if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -v)
        return [[float(x) for x in v] for v in found]


@dataclass
class Whitening:
    """What the rows are projected with; ``size`` is the dimension, ``sums`` are of the scaled entries without offset."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components
    eigenvalues: list[float]
    explained: list[float]

    @property
    def size(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, vector: str, d: int, scale: float, components: int) -> Whitening:
    """The largest ``components`` of the covariance of the scaled entries; fewer where its rank is lower."""
    spark = rows.sparkSession
    found = scatter_sums(rows, vector, d, scale)
    n, s = found.n, [int(v) for v in found.total]
    m = [[int(n * found.products[i, j] - s[i] * s[j]) for j in range(d)] for i in range(d)]
    shared = reduce(gcd, (v for row in m for v in row), 0)
    if not shared:  # no rows, or no two that differ
        return Whitening(n, s, np.zeros((d, 0)), [], [])
    m = [[v // shared for v in row] for row in m]
    trace = sum(m[i][i] for i in range(d))
    roots = largest_roots(characteristic_polynomial(spark, m), components)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, root, many in frame.itertuples(index=False):
                for v in null_vectors(m, Fraction(root), int(many)):
                    yield pd.DataFrame({"k": [k], "v": [v]})

    dealt = spark.createDataFrame([(k, str(r), many) for k, (r, many) in enumerate(roots)], "k int, root string, many int").repartition(len(roots))
    vectors = sorted(dealt.mapInPandas(run, "k int, v array<double>").collect(), key=lambda r: (r.k, r.v))
    each = [r for r, many in roots for _ in range(many)]
    return Whitening(n, s, np.array([r.v for r in vectors]).T, [float(r * shared / (n * n)) for r in each], [float(r / trace) for r in each])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    d = len(sums)
    top = n * max(int(np.abs(x).max()) if x.size else 0, 1) + max(abs(v) for v in sums)
    if top * top * d < 1 << 62:
        t = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (t * t).sum(1).tolist()
    whole = x.astype(np.int64).astype(object)
    t = n * whole - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (t * t).sum(1)]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024.0) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    An entry c becomes floor(scale * c); an added constant would change nothing returned.
    Vectors that are null or empty, or hold null or non-finite entries or some whose integer
    is beyond 2^62, take no part. Vectors of another size than the commonest (the larger of
    equally common ones) take none either. Components with eigenvalue 0 are not returned, so a
    table without two different vectors gives no rows. A deviation beyond a long is null.
    Repeated rows and keys, and rows without a key, are all returned; other columns are ignored.
    """
    rows = usable(vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")), "__vector", scale)
    sizes = rows.groupBy(F.size("__vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 1
    rows = rows.where(F.size("__vector") == d)
    model = fit(rows, "__vector", d, scale, components)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    mean = np.array([float(Fraction(v, model.n)) for v in model.sums]) if model.n else np.zeros(d)
    basis = model.components / np.sqrt(np.array(model.eigenvalues)) if model.eigenvalues else model.components
    n, sums, k = model.n, model.sums, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d, scale)
            w = (x - mean) @ basis
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(x, n, sums), pa.int64()), lists], names=schema.names)

    if not k:
        projected = rows.sparkSession.createDataFrame([], schema)
        error = 0.0
    else:
        projected = step(rows.select(F.col("__key"), F.col("__vector").cast("array<double>")).mapInArrow(run, schema), "whitened")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        cov = projected.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(v) for v in model.explained]) if k else F.array(F.lit(0.0))
    long = projected.select(key, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return long.select(
        key,
        (F.col("__at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("__at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
