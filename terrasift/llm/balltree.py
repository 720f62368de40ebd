"""Exact top-k inner products by ball trees with branch and bound.

Candidates are dealt into shards; each shard is a ball tree. A node with centre c and
radius r holds no vector whose inner product with q exceeds q.c + |q| r. A block of
queries descends a tree together, children with the larger bounds first, and a query
leaves a branch whose bound is below its current k-th score. That score is shared: it
starts from a pilot (a bounded sample of the candidates) and passes from shard to shard
of the same query block in a task.

Scores are integer inner products of components floor(scale * x), exact in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .steps import step

LEAF = 64
_LOW = -(1 << 62)
_NO_ID = (1 << 63) - 1


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Row order, nodes (start, end, left, right; -1 at leaves), centres and radii of a ball tree."""
    order = np.arange(len(x))
    nodes, centres, radii = [], [], []

    def make(a: int, b: int) -> int:
        own = x[order[a:b]]
        centre = own.mean(0)
        at = len(nodes)
        nodes.append((a, b, -1, -1))
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
        if b - a > leaf:
            far = own[((own - centre) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            mid = (a + b) // 2
            nodes[at] = (a, b, make(a, mid), make(mid, b))
        return at

    make(0, len(x))
    return order, nodes, np.array(centres), np.array(radii)


class TopK:
    """The current k best (score, id) of a block of queries; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOW, np.int64)
        self.id = np.full((n, k), _NO_ID, np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], ids], axis=1)
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers: by doubles where no sum can pass 2^53, else by 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 1 << 53:
        return np.rint(q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(q: np.ndarray, qid: np.ndarray, top: TopK, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, nodes, centres, radii) -> None:
    """Adds to ``top`` what the tree over rows ``x`` (in tree order) holds; scores below ``floor`` need not be found."""
    length = np.sqrt((q**2).sum(1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        slack = 1e-12 * length[rows] * (np.sqrt((centres[node] ** 2).sum()) + radii[node])  # of rounding
        return q[rows] @ centres[node] + length[rows] * radii[node] + slack

    def visit(node: int, rows: np.ndarray, upper: np.ndarray) -> None:
        kth = np.maximum(top.score[rows, -1], floor[rows])
        rows = rows[upper * (1 + 1e-9) + 1e-3 * (1 + np.abs(upper) * 1e-6) >= kth]  # rounding of the bound never prunes
        if not len(rows):
            return
        a, b, left, right = nodes[node]
        if left < 0:
            score = inner_products(q[rows], x[a:b])
            own = ids[a:b][None, :] == qid[rows][:, None]
            score[own] = _LOW
            top.add(rows, score, np.where(own, _NO_ID, ids[a:b][None, :]))
            return
        bounds = {c: bound(c, rows) for c in (left, right)}
        for c in sorted(bounds, key=lambda c: -bounds[c].sum()):
            visit(c, rows, bounds[c])

    rows = np.arange(len(q))
    visit(0, rows, bound(0, rows))


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) as array<long>; rows with null vectors, null or non-finite components go."""
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (width, n, ids, x, nodes, centres, radii): ball trees over up to ``size`` vectors of one length. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def out(width):
            ids, x = held.pop(width)
            ids, x = np.array(ids, np.int64), np.array(x, np.float64)
            order, nodes, centres, radii = build(x)
            return pd.DataFrame({"width": [width], "n": [len(ids)], "ids": [ids[order].tobytes()], "x": [x[order].tobytes()], "nodes": [np.array(nodes, np.int64).tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["x"], strict=True):
                if not len(v):
                    continue
                ids, x = held.setdefault(len(v), ([], []))
                ids.append(i)
                x.append(v)
                if len(ids) == size:
                    yield out(len(v))
        for width in list(held):
            yield out(width)

    return rows.mapInPandas(run, "width int, n int, ids binary, x binary, nodes binary, centres binary, radii binary")


def numbered(table: DataFrame, name: str) -> DataFrame:
    """Packed rows with a number; few rows, as each stands for thousands."""
    return step(table.withColumn(name, F.monotonically_increasing_id()), f"top-{name}")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = 4096, block: int = 1024, pilot: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another vec_id and a vector of the same length. Rows that repeat a vec_id are
    candidates of their own; a repeated query id counts once. ``pilot`` bounds the sample
    that starts the k-th scores; it changes the work, never the result.
    """
    vectors = step(quantised(rows, scale), "top-vectors")
    # dealt by size, not by file: shards are full and even
    n = vectors.count()
    dealt = vectors.repartition(max(1, -(-n // shard)), F.xxhash64("vec_id", "x"))
    shards = numbered(packed(dealt, shard), "shard")
    asked = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = numbered(packed(asked.repartition(max(1, -(-n // (every * block))), "vec_id"), block), "query")
    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pilot).collect()  # a bounded number of rows
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r["x"]) for r in first if len(r["x"])}:
        own = [r for r in first if len(r["x"]) == width]
        by_width[width] = (np.array([r["vec_id"] for r in own], np.int64), np.array([r["x"] for r in own], np.float64))

    def floors(q, qid, width):
        """The k-th score over the pilot; a bound from below, as the pilot is part of the candidates."""
        ids, x = by_width.get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
        if len(ids) <= k:
            return np.full(len(q), _LOW, np.int64)
        score = inner_products(q, x)
        score[ids[None, :] == qid[:, None]] = _LOW
        return -np.partition(-score, k - 1, axis=1)[:, k - 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, q, qid, top, floor = None, None, None, None, None

        def done():
            r, c = np.nonzero(top.id != _NO_ID)
            return pd.DataFrame({"query_id": qid[r], "vec_id": top.id[r, c], "score": top.score[r, c]})

        for batch in batches:
            for row in batch.itertuples():
                if now != row.query:
                    if now is not None:
                        yield done()
                    now, qid = row.query, np.frombuffer(row.qids, np.int64)
                    q = np.frombuffer(row.qx).reshape(-1, row.width)
                    top, floor = TopK(len(q), k), floors(q, qid, row.width)
                x, ids = np.frombuffer(row.x).reshape(-1, row.width), np.frombuffer(row.ids, np.int64)
                nodes = np.frombuffer(row.nodes, np.int64).reshape(-1, 4).tolist()
                search(q, qid, top, floor, x, ids, nodes, np.frombuffer(row.centres).reshape(-1, row.width), np.frombuffer(row.radii))
        if now is not None:
            yield done()

    # every query block meets the shards of every lane; a lane holds a few shards
    lanes = max(1, -(-n // (shard * 8)))
    own = shards.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)))
    sent = queries.select("query", "width", F.col("ids").alias("qids"), F.col("x").alias("qx")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    both = sent.hint("merge").join(own, ["lane", "width"])  # streams the queries: rows of a query follow each other
    found = both.select("query", "width", "qids", "qx", "ids", "x", "nodes", "centres", "radii").mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
