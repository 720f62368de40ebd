"""Search effort on the cell grid: sweep edges to effort, and its spread over GPS and band width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import movement
from ..functions.geo import floor_long


def sweep_effort(edges: DataFrame, keys: Sequence[str], step_m: float = 5.0) -> DataFrame:
    """Effort per cell from admitted edges.

    An edge is cut into steps of at most ``step_m``; each step's midpoint splits its length bilinearly
    over four cells. Steps are generated inside the row, and the sums combine before the shuffle.
    Effort outside the window is dropped, as the grid ends there.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step_m)).cast("int")
    e = edges.where("status = 'admitted'").withColumn("steps", n)
    e = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    a = (F.col("i") + 0.5) / F.col("steps")
    rr = F.col("prev_row") + a * (F.col("row") - F.col("prev_row")) - 0.5
    cc = F.col("prev_col") + a * (F.col("col") - F.col("prev_col")) - 0.5
    e = e.select(*keys, rr.alias("rr"), cc.alias("cc"), (F.col("length") / F.col("steps") / G.CELL**2).alias("unit"))
    e = e.withColumn("r0", floor_long("rr")).withColumn("c0", floor_long("cc"))
    corners = []
    for dr in (0, 1):
        for dc in (0, 1):
            r, c = F.col("r0") + dr, F.col("c0") + dc
            share = (1 - F.abs(F.col("rr") - r)) * (1 - F.abs(F.col("cc") - c)) * F.col("unit")
            corners.append(F.struct(r.alias("row"), c.alias("col"), share.alias("effort")))
    cells = e.select(*keys, F.inline(F.array(*corners)))
    inside = F.col("row").between(0, G.N - 1) & F.col("col").between(0, G.N - 1)
    return cells.where(inside).groupBy(*keys, "row", "col").agg(F.sum("effort").alias("effort"))


def spread(effort: DataFrame, keys: Sequence[str], sigma: str = "sigma") -> DataFrame:
    """Gaussian spread of effort, ``sigma`` in cells: one pass over rows, one over columns.

    The kernel ends at int(3 sigma + .5) cells and sums to one; what falls off the grid is lost.
    """

    def one_axis(df, axis):
        r = F.floor(3 * F.col(sigma) + 0.5).cast("int")
        ks = F.sequence(-r, r)
        weights = F.transform(ks, lambda k: F.exp(-0.5 * F.pow(k / F.col(sigma), 2)))
        total = F.aggregate("__w", F.lit(0.0), lambda acc, x: acc + x)
        d = df.withColumn("__k", ks).withColumn("__w", weights).withColumn("__t", total)
        d = d.select(*keys, sigma, "row", "col", "effort", "__t", F.explode(F.arrays_zip("__k", "__w")).alias("__z"))
        d = d.withColumn(axis, F.col(axis) + F.col("__z.__k")).withColumn("effort", F.col("effort") * F.col("__z.__w") / F.col("__t"))
        return d.where(F.col(axis).between(0, G.N - 1)).groupBy(*keys, sigma, "row", "col").agg(F.sum("effort").alias("effort"))

    return one_axis(one_axis(effort, "row"), "col")


def team_coverage(edges: DataFrame, keys: Sequence[str], team_size: str = "team_size", spacing: str = "spacing_m") -> DataFrame:
    """Spread effort of searcher lines, summed over teams: keys, row, col, effort.

    Multiply by a detection width for the intensity of that width.
    """
    e = sweep_effort(edges, [*keys, team_size, spacing])
    band = movement.team_band(team_size, spacing)
    e = e.withColumn("__b", band).where("__b is not null")
    e = e.withColumn("effort", F.col("effort") * F.col("__b.mult")).withColumn("sigma", movement.band_sigma("__b.width")).drop("__b")
    s = spread(e, [*keys, team_size, spacing])
    return s.groupBy(*keys, "row", "col").agg(F.sum("effort").alias("effort"))
