"""Connected components of edge tables by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import step


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the given edges, roots left out."""
    nodes, index = np.unique(np.r_[a, b], return_inverse=True)
    root = np.arange(len(nodes))
    x, y = index[: len(a)], index[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, low)
        np.minimum.at(new, ry, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def contract(edges: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """The same components with at most one edge a node in each task; ``rows`` bounds what is held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.r_[a, batch["a"].to_numpy()], np.r_[b, batch["b"].to_numpy()]
            if len(a) > rows:
                a, b = forest(a, b)
                if len(a) > rows // 2:  # hardly any edge can go: pass them on
                    yield pd.DataFrame({"a": a, "b": b})
                    a = b = np.zeros(0, np.int64)
        a, b = forest(a, b)
        yield pd.DataFrame({"a": a, "b": b})

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _finished(edges: DataFrame) -> DataFrame:
    """The components of a bounded number of edges, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            all_ = pd.concat(rows)
            node, root = forest(all_["a"].to_numpy(), all_["b"].to_numpy())
            yield pd.DataFrame({"node": node, "component": root})

    return edges.coalesce(1).mapInPandas(run, "node long, component long")


def components(edges: DataFrame, bounded: int = 1 << 21) -> DataFrame:
    """(node, component): the smallest node reachable from every node with an edge, itself left out if it is the smallest.

    ``edges`` holds longs a and b; self-loops and repeated edges do no harm. Edges are first
    contracted inside the tasks that hold them. While more than ``bounded`` edges are left
    (32 MB at 16 bytes each), rounds of large and small stars shrink them, each a written
    step; what fits the bound is finished in one task. A hub's rows are never gathered in
    the rounds: minima are taken map-side and the joins back to the edges are plain equi
    joins, which AQE may split.
    """
    now = step(contract(edges.where("a <> b")), "components")
    rows = now.count()
    mark = None
    while rows > bounded:
        ordered = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = ordered.unionByName(ordered.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = step(large, "components-large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = step(small, "components-small")
        then = _mark(now)
        if then == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        rows, mark = then[0], then
    return step(_finished(now), "components-finished")
