"""Travel time over whole cell graphs, tile by tile.

A tile's arcs lie packed in one row. A task settles all cells of a tile that a better time
has entered, and only times of cells that an arc leads out of the tile from are sent on.
A round is one exchange of such border times, so there are about as many rounds as tiles
across and not as many as cells; tiles that nothing new enters are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions.geo import floor_long
from ..session import cut_lineage

SIDE = 64  # cells a side of a tile

_LISTS = ("arc_from", "arc_to", "arc_s", "cells", "seconds", "in_cells", "in_s")
_SETTLED = "window_id bigint, tile bigint, cells array<bigint>, seconds array<double>, out_tiles array<bigint>, out_cells array<bigint>, out_s array<double>"


def tile_of(cell: str, side: int) -> Column:
    """Number of the tile that a cell number (row * 512 + column) lies in."""
    across = -(-G.N // side)
    return (floor_long(floor_long(F.col(cell) / G.N) / side) * across + floor_long(F.pmod(F.col(cell), F.lit(G.N)) / side)).cast("bigint")


def relax(start: np.ndarray, end: np.ndarray, seconds: np.ndarray, dist: np.ndarray) -> None:
    """Lowers ``dist`` along arcs start -> end (``end`` ascends) until nothing changes."""
    if not len(end):
        return
    first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    into = end[first]
    while True:
        best = np.minimum.reduceat(dist[start] + seconds, first)
        better = best < dist[into]
        if not better.any():
            return
        dist[into[better]] = best[better]


def _settle(arc_from, arc_to, arc_s, cells, seconds, in_cells, in_s, tile: int, side: int, cutoff: float):
    """One tile: its cells and times after the incoming times, and the times that leave it."""
    across = -(-G.N // side)
    of = lambda c: c // G.N // side * across + c % G.N // side
    arc_from, arc_to, cells, in_cells = (np.asarray(x, np.int64) for x in (arc_from, arc_to, cells, in_cells))
    arc_s = np.asarray(arc_s, float)
    inside = of(arc_to) == tile
    known = np.sort(np.concatenate([arc_from, arc_to[inside], cells, in_cells]))
    known = known[np.r_[True, known[1:] != known[:-1]]]
    dist = np.full(len(known), np.inf)
    dist[np.searchsorted(known, cells)] = seconds
    before = dist.copy()
    np.minimum.at(dist, np.searchsorted(known, in_cells), in_s)
    order = np.argsort(arc_to[inside], kind="stable")
    start, end = np.searchsorted(known, arc_from[inside][order]), np.searchsorted(known, arc_to[inside][order])
    relax(start, end, arc_s[inside][order], dist)
    dist[dist > cutoff] = np.inf
    start = np.searchsorted(known, arc_from[~inside])
    leave = dist[start] < before[start]
    out_cells, out_s = arc_to[~inside][leave], dist[start][leave] + arc_s[~inside][leave]
    near = out_s <= cutoff
    reached = np.isfinite(dist)
    return known[reached], dist[reached], of(out_cells[near]), out_cells[near], out_s[near]


def travel_time(edges: DataFrame, seeds: DataFrame, cutoff_s: float | None = None, side: int = SIDE) -> DataFrame:
    """Seconds from every cell to its nearest seed along directed edges, for times up to the cutoff if there is one.

    ``edges`` has window_id, src, dst (cell numbers) and seconds; ``seeds`` has window_id and cell.
    Cells that reach no seed have no row. A tile has side x side cells and eight arcs a cell, which
    bounds its row. Every round is written to shared storage.
    """
    spark = edges.sparkSession
    arcs = edges.select("window_id", tile_of("dst", side).alias("tile"), F.struct(F.col("dst").alias("f"), F.col("src").alias("t"), F.col("seconds").alias("s")).alias("arc"))
    arcs = arcs.groupBy("window_id", "tile").agg(F.collect_list("arc").alias("arcs"))
    part = lambda name: F.transform("arcs", lambda a: a[name])
    arcs = cut_lineage(arcs.select("window_id", "tile", part("f").alias("arc_from"), part("t").alias("arc_to"), part("s").alias("arc_s")), "tile-arcs")
    sent = seeds.select("window_id", tile_of("cell", side).alias("tile"), F.col("cell").cast("bigint").alias("cell"), F.lit(0.0).alias("s"))
    state = spark.createDataFrame([], "window_id bigint, tile bigint, cells array<bigint>, seconds array<double>")
    cutoff = float("inf") if cutoff_s is None else float(cutoff_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in _LISTS]
            tiles = batch.column(batch.schema.get_field_index("tile"))
            rows = [_settle(*[v[k].values.to_numpy(zero_copy_only=False) if v[k].is_valid else [] for v in lists], tile=tiles[k].as_py(), side=side, cutoff=cutoff) for k in range(batch.num_rows)]
            columns = [pa.array([r[i] for r in rows], pa.list_(t)) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("window_id")), tiles, *columns], names=["window_id", "tile", "cells", "seconds", "out_tiles", "out_cells", "out_s"])

    while True:
        best = sent.groupBy("window_id", "tile", "cell").agg(F.min("s").alias("s")).groupBy("window_id", "tile").agg(F.collect_list(F.struct("cell", "s")).alias("x"))  # cells of one tile
        came = best.select("window_id", "tile", F.transform("x", lambda v: v["cell"]).alias("in_cells"), F.transform("x", lambda v: v["s"]).alias("in_s"))
        active = came.join(arcs, ["window_id", "tile"], "left").join(state, ["window_id", "tile"], "left")
        settled = cut_lineage(active.mapInArrow(run, _SETTLED), "tile-times")
        new = settled.select("window_id", "tile", "cells", "seconds")
        state = cut_lineage(state.join(new.select("window_id", "tile"), ["window_id", "tile"], "left_anti").unionByName(new), "tile-state")
        sent = settled.select("window_id", F.explode(F.arrays_zip("out_tiles", "out_cells", "out_s")).alias("x")).select("window_id", F.col("x.out_tiles").alias("tile"), F.col("x.out_cells").alias("cell"), F.col("x.out_s").alias("s"))
        if sent.isEmpty():
            return state.select("window_id", F.explode(F.arrays_zip("cells", "seconds")).alias("x")).select("window_id", F.col("x.cells").alias("cell"), F.col("x.seconds").alias("seconds"))
