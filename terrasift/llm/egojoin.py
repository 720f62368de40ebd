"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors reach a cosine exactly when their distance is at most epsilon. Vectors are
rotated to principal dimensions, sorted by label and then by their cells in a grid of
side epsilon over the leading dimensions, and cut into blocks of consecutive rows. The
sequence is joined with itself recursively: an interval of blocks is a number shifted by
a few bits, each level keeps the bounding box of its intervals, and pairs of intervals
whose boxes lie further apart than epsilon, or whose labels differ, are not divided any
further. Only block pairs that survive are multiplied out.

Equal vectors of a label form a class and are compared once. A block pair reports sums
of links and a spanning forest of them, never the pairs, so large groups of near copies
cost no more rows than small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .steps import parts, step

BITS = 4  # an interval has up to 2 ** BITS children


def principal_basis(classes: DataFrame, width: int, sample: int) -> np.ndarray:
    """Principal directions of at most ``sample`` class vectors, those with the smallest hashes, largest variance first.

    The basis only steers the order: any orthonormal basis gives the same links.
    """
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("embedding").collect()
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r[0])] = r[0]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    _, vectors = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)) if len(x) else np.eye(width))
    return np.ascontiguousarray(vectors[:, ::-1])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def grid_cells(classes: DataFrame, basis: np.ndarray, eps: float, order_dims: int) -> DataFrame:
    """Adds the grid cells on the leading dimensions, the key of the sequence after the label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["embedding"], len(basis))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cells = np.floor(x @ basis[:, :order_dims] / eps).astype(np.int64)
            yield batch.assign(cells=list(cells))

    return classes.mapInPandas(run, "cls long, copies long, part long, embedding array<float>, cells array<long>")


def blocks(ordered: DataFrame, basis: np.ndarray, size: int, box_dims: int) -> DataFrame:
    """Blocks of at most ``size`` consecutive rows of one label: (chunk, seq, part, box, packed rows)."""
    width = len(basis)

    def pack(pid: int, seq: int, pdf: pd.DataFrame) -> dict:
        x = _matrix(pdf["embedding"], width)
        y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis[:, :box_dims]
        return {"chunk": pid, "seq": seq, "part": int(pdf["part"].iloc[0]), "lo": y.min(0), "hi": y.max(0), "cls": pdf["cls"].to_numpy(np.int64).tobytes(), "copies": pdf["copies"].to_numpy(np.int64).tobytes(), "x": x.tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, seq, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            out = []
            while len(rest):
                same = (rest["part"] != rest["part"].iloc[0]).to_numpy()
                run_end = int(same.argmax()) if same.any() else len(rest)
                if run_end == len(rest) and run_end < size:
                    break  # the block may go on in the next batch
                take = min(run_end, size)
                out.append(pack(pid, seq, rest.iloc[:take]))
                rest, seq = rest.iloc[take:], seq + 1
            if out:
                yield pd.DataFrame(out)
        if rest is not None and len(rest):
            yield pd.DataFrame([pack(pid, seq, rest)])

    return ordered.mapInPandas(run, "chunk long, seq long, part long, lo array<double>, hi array<double>, cls binary, copies binary, x binary")


def interval_pairs(packed: DataFrame, eps: float) -> DataFrame:
    """Pairs (l, r) of block ids, l <= r, that may hold links: the recursive join of sequence intervals."""
    top = packed.agg(F.max("id")).first()[0]
    if top is None:
        return packed.select(F.col("id").alias("l"), F.col("id").alias("r"))
    levels = max(1, -(-int(top).bit_length() // BITS))
    dims = range(len(packed.select("lo").first()[0]))

    def nodes(level):
        """Boxes of the intervals of a level, with their parent."""
        at = F.shiftright("id", BITS * level)
        bounds = [F.min(F.col("lo")[d]).alias(f"lo{d}") for d in dims] + [F.max(F.col("hi")[d]).alias(f"hi{d}") for d in dims]
        rows = packed.select("id", "part", "lo", "hi").groupBy(at.alias("node")).agg(F.min("part").alias("p0"), F.max("part").alias("p1"), *bounds)
        return rows.withColumn("up", F.shiftright("node", BITS))

    gap = sum((F.pow(F.greatest(F.col(f"b.lo{d}") - F.col(f"a.hi{d}"), F.col(f"a.lo{d}") - F.col(f"b.hi{d}"), F.lit(0.0)), 2) for d in dims), F.lit(0.0))
    near = (gap <= eps * eps * (1 + 1e-9) + 1e-12) & F.expr("a.p0 <= b.p1 and b.p0 <= a.p1 and a.node <= b.node")
    pairs = packed.sparkSession.createDataFrame([(0, 0)], "l long, r long")
    for level in range(levels - 1, -1, -1):
        n = nodes(level)
        pairs = step(pairs.join(n.alias("a"), F.expr("l = a.up")).join(n.alias("b"), F.expr("r = b.up")).where(near).select(F.col("a.node").alias("l"), F.col("b.node").alias("r")), "ego-pairs")
    return pairs


def block_links(a, b, same: bool, width: int, least: float):
    """Links of two packed blocks: (class, links to it) sums and forest edges."""
    ca, na, xa = np.frombuffer(a[0], np.int64), np.frombuffer(a[1], np.int64), np.frombuffer(a[2]).reshape(-1, width)
    cb, nb, xb = np.frombuffer(b[0], np.int64), np.frombuffer(b[1], np.int64), np.frombuffer(b[2]).reshape(-1, width)
    la, lb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    cos = (xa / la[:, None]) @ (xb / lb[:, None]).T
    hit = cos >= least
    for i, j in np.argwhere(np.abs(cos - least) < 1e-12):  # as the plain formula rounds
        hit[i, j] = float(xa[i] @ xb[j]) / (float(la[i]) * float(lb[j])) >= least
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    f, g = forest(ca[i], cb[j])
    return np.r_[ca, cb], np.r_[hit @ nb, hit.T @ na], f, g


def link(pairs: DataFrame, packed: DataFrame, width: int, least: float) -> DataFrame:
    """Rows (a, n): n more vectors linked with those of class a; and (a, b): an edge of the forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                cls, n, f, g = block_links((r.c1, r.k1, r.x1), (r.c2, r.k2, r.x2), r.l == r.r, width, least)
                some = n > 0
                yield pd.DataFrame({"a": np.r_[cls[some], f], "b": pd.array(np.r_[np.zeros(some.sum(), np.int64), g], "Int64").copy(), "n": np.r_[n[some], np.zeros(len(f), np.int64)]})

    side = lambda k: packed.select(F.col("id").alias("lr"[k - 1]), "part", F.col("cls").alias(f"c{k}"), F.col("copies").alias(f"k{k}"), F.col("x").alias(f"x{k}"))
    both = pairs.join(side(1), "l").join(side(2).withColumnRenamed("part", "part2"), "r").where("part = part2")
    return both.select("l", "r", "c1", "k1", "x1", "c2", "k2", "x2").mapInPandas(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, least: float = 0.93, block: int = 512, order_dims: int = 6, box_dims: int = 16, sample: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors link when labels are equal and not null, lengths are equal and the cosine is
    at least ``least``. Null, empty and zero vectors, and those with null or non-finite
    components, link with nothing. Rows that repeat a vec_id are rows of their own.
    """
    n = F.size("embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fit = F.col("label").isNotNull() & (n > 0) & finite & F.exists("embedding", lambda v: v != 0)
    own = rows.select("vec_id", "label", F.when(F.coalesce(fit, F.lit(False)), F.col("embedding").cast("array<float>")).alias("embedding"))
    own = own.withColumn("part", F.col("label").cast("long") * 65536 + F.size("embedding")).withColumn("cls", F.when(F.col("embedding").isNotNull(), F.xxhash64("part", "embedding")))
    classes = own.where("cls is not null").groupBy("cls", "part", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = step(classes, "ego-classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    eps = float(np.sqrt(2 - 2 * least))
    basis = principal_basis(classes, width, sample)
    cells = grid_cells(classes.select("cls", "copies", "part", "embedding"), basis, eps, min(order_dims, width))
    ordered = cells.repartitionByRange(parts(rows), "part", "cells", "cls").sortWithinPartitions("part", "cells", "cls").drop("cells")
    packed = step(blocks(ordered, basis, block, min(box_dims, width)), "ego-blocks")
    most = packed.agg(F.max("seq")).first()[0]
    packed = packed.withColumn("id", F.col("chunk") * (1 << int(most).bit_length()) + F.col("seq"))
    found = step(link(interval_pairs(packed, eps), packed, width, least), "ego-links")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    part = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "first", "copies").join(part, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    result = named.join(lowest, "component").join(counts, "cls", "left").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = own.select("vec_id", "cls").join(result, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
