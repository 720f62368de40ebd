"""Two-parameter fits of all hold-out folds at once, from sums at shared nodes.

An objective that is a sum over cases is evaluated for every case at the same few nodes
of a small box around the optimum of all cases. A fold's objective at the nodes is the
total minus the terms of its withheld cases, so a thousand folds (one a case, for
leave-one-out) cost one pass over the cases, not one a fold. Each fold's optimum is that
of the polynomial through its node values; the box shrinks around the optima until the
polynomial is exact to rounding, and grows or moves while one of them lies at its edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import cut_lineage, fan_out

NODES = 9  # per parameter
WIDE = 17  # per parameter while the whole domain is searched


@dataclass(frozen=True)
class Box:
    """A rectangle of the two parameters."""

    low: tuple[float, float]
    high: tuple[float, float]

    def axis(self, k: int, m: int = NODES) -> np.ndarray:
        """Chebyshev-Lobatto nodes of one side, rising."""
        unit = -np.cos(np.pi * np.arange(m) / (m - 1))
        return (self.low[k] + self.high[k]) / 2 + (self.high[k] - self.low[k]) / 2 * unit

    def nodes(self, m: int = NODES) -> list[tuple[float, float]]:
        return [(float(a), float(b)) for a in self.axis(0, m) for b in self.axis(1, m)]

    def size(self) -> np.ndarray:
        return np.subtract(self.high, self.low)

    def around(self, points: np.ndarray, half: np.ndarray, bounds: Box) -> Box:
        """The smallest box that holds the points with ``half`` on every side, within the bounds."""
        return Box(tuple(np.maximum(points.min(0) - half, bounds.low).tolist()), tuple(np.minimum(points.max(0) + half, bounds.high).tolist()))


def minimise(values: np.ndarray, box: Box, m: int = NODES, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minima over the box of the polynomials through node values (rows x m * m): places, values, Hessian determinants.

    Newton steps from the best node, kept inside the box; a coordinate at the edge leaves the
    step while its slope points out, and a step that does not lower the value is halved. A row
    that has settled takes no further part.
    """
    unit = -np.cos(np.pi * np.arange(m) / (m - 1))
    inverse = np.linalg.inv(chebyshev.chebvander(unit, m - 1))
    grid = values.reshape(-1, m, m)
    coef = inverse @ grid @ inverse.T
    slope = np.zeros((m, m))  # coefficients of the derivative
    for k in range(m):
        one = np.zeros(m)
        one[k] = 1.0
        d = chebyshev.chebder(one) if m > 1 else np.zeros(1)
        slope[: len(d), k] = d

    def basis(x):
        v = chebyshev.chebvander(x, m - 1)
        return np.stack([v, v @ slope, v @ slope @ slope], 1)  # rows x (value, slope, curvature) x m

    def at(c, x, y):
        return ((c @ chebyshev.chebvander(y, m - 1)[:, :, None])[:, :, 0] * chebyshev.chebvander(x, m - 1)).sum(1)

    best = grid.reshape(len(grid), -1).argmin(1)
    x, y = unit[best // m].copy(), unit[best % m].copy()
    here = at(coef, x, y)
    curve = np.zeros(len(grid))
    live = np.arange(len(grid))
    for _ in range(steps):
        if not len(live):
            break
        c, px, py = coef[live], x[live], y[live]
        d = basis(px) @ c @ basis(py).transpose(0, 2, 1)
        gx, gy, hxx, hyy, hxy = d[:, 1, 0], d[:, 0, 1], d[:, 2, 0], d[:, 0, 2], d[:, 1, 1]
        curve[live] = bend = hxx * hyy - hxy * hxy
        free_x, free_y = ~((np.abs(px) >= 1) & (px * gx < 0)), ~((np.abs(py) >= 1) & (py * gy < 0))
        both = free_x & free_y & (bend > 0) & (hxx > 0)
        safe = np.where(both, bend, 1.0)
        dx = np.where(both, (hyy * gx - hxy * gy) / safe, np.where(free_x, gx / np.where(hxx > 0, hxx, np.abs(gx) + 1e-300), 0.0))
        dy = np.where(both, (hxx * gy - hxy * gx) / safe, np.where(free_y, gy / np.where(hyy > 0, hyy, np.abs(gy) + 1e-300), 0.0))
        part, todo = 1.0, np.arange(len(live))
        for _ in range(30):
            nx, ny = np.clip(px[todo] - part * dx[todo], -1, 1), np.clip(py[todo] - part * dy[todo], -1, 1)
            value, old = at(c[todo], nx, ny), here[live[todo]]
            better = value <= old + 4e-16 * np.abs(old)  # a step at the bottom may round up
            rows = live[todo[better]]
            x[rows], y[rows], here[rows] = nx[better], ny[better], value[better]
            todo, part = todo[~better], part / 2
            if not len(todo):
                break
        going = np.maximum(np.abs(dx), np.abs(dy)) >= 1e-10  # a Newton step leaves about its square
        going[todo] = False
        live = live[going]
    place = np.column_stack([x, y]) * box.size() / 2 + np.add(box.low, box.high) / 2
    return place, here, curve


def at_edge(places: np.ndarray, box: Box, bounds: Box) -> np.ndarray:
    """By coordinate: within a twentieth of an edge of the box that is not one of the bounds."""
    near = 0.05 * box.size()
    low = (places < np.add(box.low, near)) & (np.array(box.low) > np.array(bounds.low))
    return low | ((places > np.subtract(box.high, near)) & (np.array(box.high) < np.array(bounds.high)))


#: Values of cases (record batches of their columns) at the nodes: rows x nodes, to be minimised.
Terms = Callable[[pa.RecordBatch, Sequence[tuple[float, float]]], np.ndarray]


def node_values(cases: DataFrame, keep: Sequence[str], terms: Terms, nodes: Sequence[tuple[float, float]], rows: int = 1024) -> DataFrame:
    """The columns named and ``values`` array<double>, a value a node; row-local, ``rows`` cases at a time."""
    schema = T.StructType([cases.schema[c] for c in keep] + [T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = lists(np.asarray(terms(batch, nodes), np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), made], names=schema.names)

    return cases.mapInArrow(run, schema)


def sum_values(values: DataFrame, keys: Sequence[str], limit: int = 256) -> DataFrame:
    """Element-wise sums of ``values`` and the number of rows ``n`` by key, added up in the task before the shuffle.

    A task holds at most ``limit`` sums at a time.
    """
    return _add_up(values.select(*keys, "values"), keys, lambda batch: column(batch, "values"), None, limit)


def sum_terms(cases: DataFrame, keys: Sequence[str], terms: Terms, nodes: Sequence[tuple[float, float]], weight: str | None = None, rows: int = 1024, limit: int = 256) -> DataFrame:
    """:func:`sum_values` of :func:`node_values`, without a row a case in between; a case counts ``weight`` times."""
    return _add_up(cases, keys, lambda batch: np.asarray(terms(batch, nodes), np.float64), weight, limit, rows)


def _add_up(cases: DataFrame, keys: Sequence[str], values: Callable[[pa.RecordBatch], np.ndarray], weight: str | None, limit: int, size: int = 1 << 14) -> DataFrame:
    fields = [cases.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out():
            rows = [(*k, n, v.tolist()) for k, (n, v) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow)

        for batch in slices(batches, size):
            if not batch.num_rows:
                continue
            flat = values(batch)
            times = np.ones(len(flat), np.int64) if weight is None else column(batch, weight)
            names = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True)) if keys else [()] * len(flat)
            place: dict = {}
            for i, k in enumerate(names):
                place.setdefault(k, []).append(i)
            for k, at in place.items():
                n, v = held.get(k, (0, 0.0))
                held[k] = n + int(times[at].sum()), v + times[at] @ flat[at]
                if len(held) > limit:
                    yield out()
        if held:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    parts = cases.mapInArrow(run, schema)
    long = parts.select(*keys, "n", F.posexplode("values").alias("__at", "__v"))
    sums = long.groupBy(*keys, "__at").agg(F.sum("__v").alias("__v"), F.sum("n").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"])  # a value a node
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), in_order.alias("values"))


def _whole(cases: DataFrame, terms: Terms, box: Box, m: int, weight: str | None = None) -> tuple[int, np.ndarray]:
    """Number of cases and their mean values at the nodes of a box."""
    r = sum_terms(cases, [], terms, box.nodes(m), weight).first()
    return (0, np.zeros(m * m)) if r is None else (r["n"], np.array(r["values"]) / r["n"])


def settle(cases: DataFrame, terms: Terms, bounds: Box, penalty: Callable[[np.ndarray], np.ndarray], half: float, wide: int = WIDE, weight: str | None = None, start: Box | None = None, fine: int = NODES) -> tuple[int, np.ndarray]:
    """Number of cases and the optimum of all of them, by boxes that shrink to ``half`` on every side.

    The search begins with ``start``, or with the whole domain in ``wide`` nodes a side; later boxes have ``fine``. A
    start that does not hold the optimum costs rounds only.
    """
    box, m = (bounds, wide) if start is None else (start, fine)
    while True:
        n, mean = _whole(cases, terms, box, m, weight)
        place, _, _ = minimise((mean + penalty(np.array(box.nodes(m))))[None], box, m)
        edge = at_edge(place, box, bounds)[0]
        if not edge.any() and (box.size() <= 2 * half * 1.001).all():
            return n, place[0]
        # a side is cut to a quarter, but moves on with its size while the optimum is at its edge
        box, m = box.around(place, np.maximum(np.where(edge, box.size() / 2, box.size() / 8), half * 0.999), bounds), fine


# ---------------------------------------------------------------- interval-censored distances


def _tail_polynomial(centre: float = 3.0, degree: int = 24) -> np.ndarray:
    """Coefficients, highest first, of log(exp(y^2) erfc(y) (centre + y)) in u = (centre - y) / (centre + y), y >= 0.

    Within 1e-14 everywhere: the function is smooth in u, from y = 0 to infinity.
    """

    def exact(y: float) -> float:
        if y < 5:
            return math.log(math.erfc(y)) + y * y
        rest = 0.0  # continued fraction
        for k in range(60, 0, -1):
            rest = k / 2 / (y + rest)
        return -math.log(math.pi) / 2 - math.log(y + rest)

    u = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    places = (centre * (1 - u) / (1 + u)).tolist()
    wanted = [exact(y) + math.log(centre + y) for y in places]
    return chebyshev.cheb2poly(np.linalg.solve(chebyshev.chebvander(u, degree), wanted))[::-1].copy()


_TAIL = _tail_polynomial()


def log_ndtr(z: np.ndarray) -> np.ndarray:
    """Log of the standard normal CDF."""
    y = np.minimum(np.abs(z) * math.sqrt(0.5), 1e150)
    u = (3.0 - y) / (3.0 + y)
    out = np.full_like(u, _TAIL[0])
    for c in _TAIL[1:].tolist():
        out *= u
        out += c
    out -= np.log(6.0 + 2.0 * y)  # half of erfc
    out -= y * y
    up = z >= 0
    out[up] = np.log1p(-np.exp(out[up]))
    return out


def interval_loss(lower: np.ndarray, upper: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Negative log mass of a lognormal (mu, sigma) in (lower, upper]; lower may be 0."""
    open_ = lower > 0
    zl = np.where(open_, (np.log(np.where(open_, lower, 1.0)) - mu) / sigma, -1e6)
    zu = (np.log(upper) - mu) / sigma
    a, b = log_ndtr(np.where(zl > 0, -zl, zu)), np.where(open_, log_ndtr(np.where(zl > 0, -zu, zl)), -1e300)
    return -(a + np.log(-np.expm1(np.minimum(b - a, -1e-300))))


def interval_terms(batch: pa.RecordBatch, nodes: Sequence[tuple[float, float]]) -> np.ndarray:
    """:func:`interval_loss` of every row at every node."""
    mu, sigma = np.array(nodes).T[:, None]
    return interval_loss(column(batch, "lower")[:, None], column(batch, "upper")[:, None], mu, sigma)


def score_intervals(rows: DataFrame, baseline: tuple[float, float]) -> DataFrame:
    """The rows with ``nll`` of their own (mu, sigma) and ``baseline_nll``; null where a bound or the fit is."""
    schema = T.StructType(rows.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("nll", "baseline_nll")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower, upper, mu, sigma = (column(batch, c) for c in ("lower", "upper", "mu", "sigma"))
            made = interval_loss(lower, upper, mu, sigma), interval_loss(lower, upper, *(np.full(len(lower), v) for v in baseline))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, from_pandas=True) for v in made)], names=schema.names)

    return rows.mapInArrow(run, schema)


INTERVAL_BOUNDS = Box((math.log(10), 0.15), (math.log(100000), 3.0))


def _settle_intervals(rows: DataFrame, half: float, weight: str | None = None) -> tuple[int, np.ndarray]:
    """:func:`settle` for intervals, begun where the logs of their middles lie."""
    n, middle = F.lit(1) if weight is None else F.col(weight), F.log((F.greatest(F.lit(1.0), "lower") + F.col("upper")) / 2)
    r = rows.select(n.alias("n"), middle.alias("d")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("q")).first()
    start = None
    if r["s"] is not None and math.isfinite(r["s"]):
        mean = r["s"] / r["n"]
        point = np.clip([mean, math.sqrt(max(r["q"] / r["n"] - mean * mean, 0.0))], INTERVAL_BOUNDS.low, INTERVAL_BOUNDS.high)
        start = INTERVAL_BOUNDS.around(point[None], np.array([0.4, 0.3]), INTERVAL_BOUNDS)
    return settle(rows, interval_terms, INTERVAL_BOUNDS, lambda p: np.zeros(len(p)), half, weight=weight, start=start, fine=5)


def fit_interval_folds(rows: DataFrame, folds: Sequence[int], half: float = 0.04) -> list[tuple[int, float, float, float]]:
    """Lognormal (fold, mu, sigma, mean negative log mass) of each fold from the rows that are not its own.

    ``rows`` has ``own`` (a fold, or a number that is none), ``lower``, ``upper`` and their number ``n``. Every row is
    evaluated at the same nodes for all folds: a fold is the total minus its own rows.
    """
    n, centre = _settle_intervals(rows, half, "n")
    points, half, last = centre[None], np.full(2, half), False
    while n:
        box = INTERVAL_BOUNDS.around(points, half, INTERVAL_BOUNDS)
        own = {r["own"]: (r["n"], np.array(r["values"])) for r in sum_terms(rows, ["own"], interval_terms, box.nodes(), "n").collect()}
        total = np.sum([v for _, v in own.values()], axis=0)
        trained = [f for f in folds if n > own.get(f, (0, 0))[0]]
        left = np.array([(total - own.get(f, (0, 0.0))[1]) / (n - own.get(f, (0, 0))[0]) for f in trained])
        points, value, _ = minimise(left, box)
        if at_edge(points, box, INTERVAL_BOUNDS).any():
            half, last = half * 2, False
            continue
        if last:
            return [(f, *p, v) for f, p, v in zip(trained, points.tolist(), value.tolist(), strict=True)]
        # once more in the box of the optima, so that the polynomial is exact to rounding
        half, last = np.maximum((points.max(0) - points.min(0)) * 0.25, 5e-3), True
    return []


def leave_one_out_intervals(cases: DataFrame, case: str = "case_id", half: float = 0.04) -> DataFrame:
    """Lognormal (mu, sigma) of every case from all other cases: case, lower, upper, mu, sigma, train_nll, at_boundary.

    ``cases`` has ``lower`` and ``upper`` bounds of the distance. The optimum of all cases but one
    lies near that of all cases, so one box serves every case; should an optimum reach the edge of
    the box, the box is doubled and all fits are made again.
    """
    rows = cut_lineage(fan_out(cases.select(case, "lower", "upper"), case), "intervals")
    n, centre = _settle_intervals(rows, half)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("mu", "sigma", "train_nll", "edge")), T.StructField("at_boundary", T.BooleanType())])
    while True:
        box = INTERVAL_BOUNDS.around(centre[None], np.full(2, half), INTERVAL_BOUNDS)
        total = np.array(sum_terms(rows, [], interval_terms, box.nodes()).first()["values"]) if n else np.zeros(NODES * NODES)
        fitted = cut_lineage(rows.mapInArrow(_leave_out(total, n, box, schema.names), schema), "interval-fits")
        if (fitted.agg(F.max("edge")).first()[0] or 0.0) == 0.0:
            return fitted.drop("edge")
        half *= 2


def _leave_out(total: np.ndarray, n: int, box: Box, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            place, value, _ = minimise((total - interval_terms(batch, box.nodes())) / max(n - 1, 1), box)
            edge = at_edge(place, box, INTERVAL_BOUNDS).any(1)
            bound = ((np.abs(place - INTERVAL_BOUNDS.low) < 1e-5) | (np.abs(place - INTERVAL_BOUNDS.high) < 1e-5)).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place[:, 0].copy()), pa.array(place[:, 1].copy()), pa.array(value), pa.array(edge.astype(float)), pa.array(bound)], names=list(names))

    return run


# ---------------------------------------------------------------- terrain tilt


def ring_masses(mu, sigma):
    """Lognormal mass of a cell of each ring, and the mass outside; for arrays of models a row each."""
    mu, sigma = np.asarray(mu, float)[..., None], np.asarray(sigma, float)[..., None]
    edge = (np.log(np.arange(1, geo.RINGS + 1) * geo.RING_M) - mu) / sigma
    return np.diff(np.exp(log_ndtr(edge)), prepend=0.0) / geo.SECTORS, np.exp(log_ndtr(-edge[..., -1:]))[..., 0]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as an array; one of lists of equal length with a row a list."""
    c = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
        return c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return c.to_numpy(zero_copy_only=False)


def lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(np.ascontiguousarray(values).ravel()))


SLICE = 16  # cases whose cells are in memory at a time; larger arrays are given back to the system and faulted in again each time


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each; each case has 5,760 cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: The two features of the cells of cases (record batches of their columns): rows x 5,760 each.
Features = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def packed_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features that the cases carry as arrays."""
    return column(batch, "rise"), column(batch, "steep")


def pack_cells(features: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows of (case, cell_idx, rise, steep) as two arrays a case: 5,760 cells each."""
    rows = features.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("cell_idx", "rise", "steep"))).alias("x"))
    return rows.select(case, F.transform("x", lambda c: c["rise"].cast("double")).alias("rise"), F.transform("x", lambda c: c["steep"].cast("double")).alias("steep"))


def _ring_sums(rise: np.ndarray, steep: np.ndarray, tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by ring of a case's exponential scores, shifted by their ``top``, for every pair of tilts: nodes x rings, nodes.

    On a grid of tilts the exponential is a product of one factor a side, and the sums over the
    sectors of a ring are a product of two small matrices.
    """
    m = math.isqrt(tilt.shape[1])
    one, two = tilt[0, ::m], tilt[1, :m]
    grid = m * m == tilt.shape[1] and np.array_equal(tilt[0], np.repeat(one, m)) and np.array_equal(tilt[1], np.tile(two, m))
    if grid:
        a, b = one[:, None] * rise, two[:, None] * steep
        top_a, top_b = a.max(1), b.max(1)
        a -= top_a[:, None]
        b -= top_b[:, None]
        if a.min() + b.min() > -600:  # no product is lost
            cells = (-1, geo.RINGS, geo.SECTORS)
            left, right = np.exp(a).reshape(cells).transpose(1, 0, 2), np.exp(b).reshape(cells).transpose(1, 2, 0)
            return (left @ right).reshape(geo.RINGS, -1).T, (top_a[:, None] + top_b).ravel()
    score = tilt[0][:, None] * rise + tilt[1][:, None] * steep
    top = score.max(1)
    return np.exp(score - top[:, None]).reshape(-1, geo.RINGS, geo.SECTORS).sum(2), top


def tilt_terms(radials: Sequence[tuple[float, float]], features: Features = packed_features) -> Terms:
    """Negative log mass of each case's cell, for every radial model and then every pair of tilts."""
    models = [ring_masses(*r) for r in radials]
    base = np.array([m for m, _ in models])  # radials x rings
    outside = np.array([o for _, o in models])

    def terms(batch: pa.RecordBatch, nodes: Sequence[tuple[float, float]]) -> np.ndarray:
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.int64)
        rise, steep = features(batch)
        tilt = np.array(nodes).T  # 2 x nodes
        out = np.empty((len(label), len(models), len(nodes)))
        for i, cell in enumerate(label.tolist()):
            if cell >= geo.POLAR_CELLS:
                out[i] = -np.log(outside)[:, None]
                continue
            rings, top = _ring_sums(rise[i], steep[i], tilt)
            lse = np.log(base @ rings.T) + top
            out[i] = lse - (tilt[0] * rise[i, cell] + tilt[1] * steep[i, cell]) - np.log(base[:, cell // geo.SECTORS])[:, None] - np.log1p(-outside)[:, None]
        return out.reshape(len(label), -1)

    return terms


def tilt_slopes(radial: tuple[float, float], features: Features = packed_features) -> Terms:
    """Each case's loss at every pair of tilts but for a constant, its slopes (2) and curvatures (3): 6 numbers a node."""
    cells = np.repeat(ring_masses(*radial)[0], geo.SECTORS)

    def terms(batch: pa.RecordBatch, nodes: Sequence[tuple[float, float]]) -> np.ndarray:
        label = column(batch, "label").astype(np.int64)
        rise, steep = features(batch)
        out = np.zeros((len(label), len(nodes), 6))
        for i in np.flatnonzero(label < geo.POLAR_CELLS).tolist():
            r, s, cell = rise[i], steep[i], label[i]
            for j, (one, two) in enumerate(nodes):
                score = one * r + two * s
                top = score.max()
                e = cells * np.exp(score - top)
                z, er, es = e.sum(), e * r, e * s
                mr, ms, rr, rs, ss = er.sum() / z, es.sum() / z, er @ r / z, er @ s / z, es @ s / z
                out[i, j] = math.log(z) + top - score[cell], mr - r[cell], ms - s[cell], rr - mr * mr, rs - mr * ms, ss - ms * ms
        return out.reshape(len(label), -1)

    return terms


TILT_BOUND = 3.0
SMALL = 5e-3  # half width of a box of tilts in which the polynomial is exact to rounding


def tilt_centre(cases: DataFrame, radial: tuple[float, float], penalty: float, features: Features = packed_features, close: float = 1e-3) -> np.ndarray:
    """Tilts of all cases together, to less than ``close``: Newton steps, each one pass with one exponential a cell.

    The loss is convex; a step that does not lower it is halved, and a tilt at its bound stays while its slope points out.
    """
    terms = tilt_slopes(radial, features)
    place, at, best = np.zeros(2), np.zeros(2), math.inf
    for _ in range(60):
        r = sum_terms(cases, [], terms, [tuple(at.tolist())], rows=SLICE).first()
        if r is None:
            break
        mean = np.array(r["values"]) / r["n"]
        value = mean[0] + penalty / 2 * (at @ at)
        if value > best + 1e-13 * abs(best):
            at = (at + place) / 2
        else:
            place, best = at, value
            slope, bend = mean[1:3] + penalty * place, mean[[3, 4, 4, 5]].reshape(2, 2) + penalty * np.eye(2)
            free = np.flatnonzero(~((np.abs(place) >= TILT_BOUND) & (place * slope < 0)))
            step = np.zeros(2)
            step[free] = np.linalg.lstsq(bend[np.ix_(free, free)], slope[free])[0]
            at = np.clip(place - step, -TILT_BOUND, TILT_BOUND)
        if np.abs(at - place).max() < close:
            return at
    return place


@dataclass(frozen=True)
class TiltFit:
    """Penalty on the squared tilts, nodes a side for tilts and for the radial models, and the first half width of the box.

    A side of few thousandths needs fewer nodes for the same digits.
    """

    penalty: float = 0.1
    tilt_nodes: int = 6
    radial_nodes: int = 5
    half: float = 0.12

    def nodes(self, models: Box, box: Box) -> tuple[int, int]:
        """Nodes a side for the radial models and for the tilts."""
        return 3 if models.size().max() < 0.006 else self.radial_nodes, 5 if box.size().max() < 0.012 else self.tilt_nodes


def fit_tilt_folds(cases: DataFrame, folds: DataFrame, excluded: DataFrame | None, radial: tuple[float, float], how: TiltFit = TiltFit(), features: Features = packed_features) -> DataFrame:
    """Tilts of every fold from the cases that it does not exclude: fold, train_n, mu, sigma, b1, b2, objective.

    ``cases`` has case_id, label (cell of the end point, 5,760 outside) and what ``features`` takes,
    the arrays rise and steep unless it says otherwise; ``folds`` has fold, train_n, mu and sigma of its own radial fit; ``excluded`` has
    (fold, case_id) pairs, None where every case is a fold and excludes itself. ``radial`` is the
    fit to all cases. A fold's objective is the mean of its cases plus half the penalty times the
    squared tilts, each tilt within 3 of 0.
    """
    bounds = Box((-TILT_BOUND, -TILT_BOUND), (TILT_BOUND, TILT_BOUND))
    penalty = lambda p: how.penalty / 2 * (p * p).sum(1)
    r = folds.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("mu", "sigma")]).first()
    if r["min_mu"] is None:
        return folds.select("fold", "train_n", "mu", "sigma", *[F.lit(0.0).alias(c) for c in ("b1", "b2", "objective")])
    margin = 1e-3
    models = Box((r["min_mu"] - margin, max(r["min_sigma"] - margin, r["min_sigma"] / 2)), (r["max_mu"] + margin, r["max_sigma"] + margin))
    n_all = cases.count()
    points, half, last = tilt_centre(cases, radial, how.penalty, features)[None], np.full(2, how.half), False
    if excluded is None:  # one case of many moves the optimum little; a box that is too small costs a round
        half = np.full(2, min(how.half, max(SMALL, 50 / max(n_all, 1))))
        joined = cases.join(folds.select(F.col("fold").alias("case_id"), "train_n", "mu", "sigma"), "case_id", "left")
        cases = cut_lineage(fan_out(joined.withColumn("__deal", F.xxhash64("case_id")), "__deal").drop("__deal"), "tilt-folds")  # dealt by case_id alone, small rows would stay in one task
    schema = T.StructType([folds.schema["fold"], folds.schema["train_n"]] + [T.StructField(c, T.DoubleType()) for c in ("mu", "sigma", "b1", "b2", "objective", "edge")])
    while True:
        box = bounds.around(points, half, bounds)
        k, m = how.nodes(models, box)
        terms = tilt_terms(models.nodes(k), features)
        if excluded is None:  # a case's own values are made again where it is fitted, not stored
            rows, total = cases.where("mu is not null"), sum_terms(cases, [], terms, box.nodes(m), rows=SLICE).first()
            total = np.array(total["values"])
            solve = _solve_folds(total, n_all, models, k, box, m, penalty, bounds)
            fitted = rows.mapInArrow(_fit_cases(solve, lambda b, t=terms, v=box.nodes(m): t(b, v), schema.names), schema)
        else:
            values = cut_lineage(node_values(cases, ["case_id"], terms, box.nodes(m), SLICE), "tilt-values")
            total = np.array(sum_values(values, []).first()["values"])
            out = sum_values(excluded.join(values, "case_id"), ["fold"])
            joined = folds.select("fold", "train_n", "mu", "sigma").join(out, "fold", "left")
            fitted = joined.mapInArrow(_fit_folds(_solve_folds(total, n_all, models, k, box, m, penalty, bounds), len(total), schema.names), schema)
        fitted = cut_lineage(fitted, "tilt-fits")
        s = fitted.agg(F.max("edge").alias("edge"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("b1", "b2")]).first()
        points = np.array([[s["min_b1"], s["min_b2"]], [s["max_b1"], s["max_b2"]]])
        if s["edge"]:
            half, last = half * 2, False
            continue
        # once more in the box of the optima, so that the polynomial is exact to rounding
        fine = np.maximum((points[1] - points[0]) * 0.25, SMALL)
        if last or (half <= fine).all():
            return fitted.drop("edge")
        half, last = fine, True


def _solve_folds(total: np.ndarray, n_all: int, models: Box, k: int, box: Box, m: int, penalty, bounds: Box):
    """Fitted columns (b1, b2, objective, edge) of folds from the values and the number of the cases that they leave out."""
    nodes = np.array(box.nodes(m))

    def weights(x, axis):
        """Lagrange weights of the radial nodes at the folds' own parameters."""
        unit = (2 * x - models.low[axis] - models.high[axis]) / (models.high[axis] - models.low[axis])
        inverse = np.linalg.inv(chebyshev.chebvander(-np.cos(np.pi * np.arange(k) / (k - 1)), k - 1))
        return chebyshev.chebvander(unit, k - 1) @ inverse

    def solve(own: np.ndarray, count, mu: np.ndarray, sigma: np.ndarray) -> list[pa.Array]:
        left = (total - own).reshape(len(own), k, k, m * m) / np.reshape(np.maximum(n_all - count, 1), (-1, 1, 1, 1))
        at = np.einsum("fa,fb,fabt->ft", weights(mu, 0), weights(sigma, 1), left) + penalty(nodes)
        place, value, _ = minimise(at, box, m)
        return [pa.array(v) for v in (place[:, 0].copy(), place[:, 1].copy(), value, at_edge(place, box, bounds).any(1).astype(float))]

    return solve


def _fit_folds(solve, width: int, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, count = batch.column(5), batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            own = np.zeros((batch.num_rows, width))
            has = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                own[has] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(has), -1)
            mu, sigma = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *solve(own, count, mu, sigma)], names=list(names))

    return run


def _fit_cases(solve, own: Callable[[pa.RecordBatch], np.ndarray], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            if batch.num_rows:
                left = np.concatenate([own(part) for part in slices([batch])])
                kept = [batch.column(batch.schema.get_field_index(c)) for c in ("case_id", "train_n", "mu", "sigma")]
                yield pa.RecordBatch.from_arrays([*kept, *solve(left, 1, column(batch, "mu"), column(batch, "sigma"))], names=list(names))

    return run


def score_held_out(cases: DataFrame, fitted: DataFrame, group: str, shares: Sequence[float] = (0.1, 0.2, 0.3), features: Features = packed_features) -> DataFrame:
    """Each case under its own fold's radial model and its tilted one: log losses and area hits of both.

    ``cases`` as in :func:`fit_tilt_folds` with the column ``group``; cases whose fold has no fit are left out.
    A hit is a case whose cell is among the densest cells (by mass an area, then by number) that
    cover the share of the disc.
    """
    names = [f"{kind}_hit{round(s * 100)}" for kind in ("base", "tilted") for s in shares]
    schema = T.StructType([cases.schema["case_id"], T.StructField("fold", fitted.schema["fold"].dataType)] + [T.StructField(c, T.DoubleType()) for c in ("base_nll", "nll")] + [T.StructField(c, T.BooleanType()) for c in names])
    ring_units = 2 * np.arange(geo.RINGS) + 1
    units = np.repeat(ring_units, geo.SECTORS)
    limits = [round(s * geo.TOTAL_UNITS) for s in shares]

    def plain(cell, base, outside):
        """Without tilts all cells of a ring are alike."""
        ring, density = cell // geo.SECTORS, base / ring_units
        before = (density > density[ring]) | ((density == density[ring]) & (np.arange(geo.RINGS) < ring))
        covered = int(ring_units[before].sum() * geo.SECTORS + (cell % geo.SECTORS + 1) * ring_units[ring])
        return -math.log(base[ring] / (base.sum() * geo.SECTORS)) - math.log1p(-outside), [covered <= v for v in limits]

    def tilted(cell, base, outside, score):
        e = (base[:, None] * np.exp(score - score.max()).reshape(geo.RINGS, -1)).ravel()
        density = e / units
        before = density > density[cell]
        before[:cell] |= density[:cell] == density[cell]
        covered = int(before @ units + units[cell])
        return -math.log(e[cell] / e.sum()) - math.log1p(-outside), [covered <= v for v in limits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            label, mu, sigma, b1, b2 = (column(batch, c) for c in ("label", "mu", "sigma", "b1", "b2"))
            rise, steep = features(batch)
            base, outside = ring_masses(mu, sigma)
            rows = []
            for i, cell in enumerate(label.astype(np.int64).tolist()):
                if cell >= geo.POLAR_CELLS:
                    rows.append((-math.log(outside[i]),) * 2 + (False,) * len(names))
                    continue
                old, old_hits = plain(cell, base[i], outside[i])
                new, hits = tilted(cell, base[i], outside[i], b1[i] * rise[i] + b2[i] * steep[i])
                rows.append((old, new, *old_hits, *hits))
            columns = list(zip(*rows, strict=True)) or [()] * (2 + len(names))
            kinds = [pa.float64()] * 2 + [pa.bool_()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    carried = [c for c in ("rise", "steep") if c in cases.columns]
    own = cases.select("case_id", F.col(group).alias("fold"), "label", *carried)
    return own.join(fitted.select("fold", "mu", "sigma", "b1", "b2"), "fold").select("case_id", "fold", "label", "mu", "sigma", "b1", "b2", *carried).mapInArrow(run, schema)
