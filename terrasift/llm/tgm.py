"""N-gram Jaccard self-join with a token-group matrix.

Similar documents are put into groups; the matrix says which tokens (word shingles) a
group holds. A query can only reach the threshold with a member of a group if the
group's token union covers enough of the query, so most groups are never opened.

1. Documents with equal shingle sets form a class; one unit stands for it from here on.
2. Shingles are ordered by a coarse frequency (a count sketch of fixed size), then hash.
   Two units at the threshold share at least ``need`` of their first tokens in that order
   (``need`` grows with the set), so only those enter the matrix, and passages that many
   documents repeat come last and rarely do.
3. Each unit is compared with the one leader that shares most matrix tokens with it; the
   leader of a token is the unit whose whole set is most frequent, in a family of near
   copies the one closest to the rest. That is one pair a unit however large the family.
4. Groups hold about ``group_size`` similar units: pieces of the components of the links
   found, and small components that share a leader. Matrix rows (token, group) meet on the
   token; pairs of groups with too few common tokens, or of one component, are dropped.
5. In the other pairs each query is bounded against the token union of the other group,
   and only then its members are compared exactly. Pairs inside a component cannot change
   it and are left out.

Every pair of units at the threshold is therefore either compared or already connected.
A link needs 100 * |intersection| >= percent * |union| on the 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .components import components, forest
from .flat import mix, ragged_take, row_sums, spread, text_blocks
from .shingles import shingle_sets
from .steps import step

SKETCH = 1 << 18  # counters of the frequency sketch, whatever the input
_PIECE = 1 << 12
_SALT = np.uint64(0x5851F42D4C957F2D)


def need(n, percent: int = 80):
    """Common first tokens that a pair at the threshold must have, for sets of n tokens."""
    return 1 + n // 10


def first_tokens(n, percent: int = 80):
    """How many first tokens of a set of n enter the matrix."""
    return np.minimum(n, n + (-n * percent) // 100 + need(n, percent))


def _units(keys: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from order-free sums over its tokens."""
    total = np.zeros((2, len(keys) + 1), np.uint64)
    np.cumsum(mix(keys ^ _SALT), out=total[0, 1:])
    np.cumsum(mix(keys + _SALT), out=total[1, 1:])
    sums = total[:, bound[1:]] - total[:, bound[:-1]]
    return mix(sums[0] + mix(sums[1] + np.diff(bound).astype(np.uint64))).view(np.int64)


def scan_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, n_shingles, unit) and, from each task, pieces of the frequency sketch (piece, counts)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("unit", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in text_blocks(batch.column(1)):
                keys, bound = shingle_sets(data, offsets, width)
                sketch += np.bincount((keys & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                n = np.diff(bound)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(_units(keys, bound), mask=n == 0), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names)
        for k in range(SKETCH // _PIECE):
            piece = sketch[k * _PIECE : (k + 1) * _PIECE]
            if piece.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k], pa.int32()), pa.array([piece.astype(np.uint64).tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequency_levels(scanned: DataFrame) -> np.ndarray:
    """Eighth-octave level of each sketch counter (SKETCH bytes): sums by piece, then one row a piece."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch["piece"], batch["counts"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c, np.uint64)
        yield pd.DataFrame({"piece": list(total), "counts": [t.tobytes() for t in total.values()]})

    pieces = scanned.where("piece is not null").select("piece", "counts").repartition("piece").mapInPandas(add, "piece int, counts binary")
    out = np.zeros(SKETCH, np.float64)
    for r in pieces.collect():  # at most SKETCH / _PIECE rows
        out[r["piece"] * _PIECE : (r["piece"] + 1) * _PIECE] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(255, np.round(8 * np.log2(out + 1))).astype(np.uint8)


def matrix_tokens(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, unit, n, common) for the first tokens of every set; a task gives each unit once.

    ``common`` is the mean frequency level of the unit's whole set. In a family of near
    copies it is highest where least was changed, so it finds the text closest to the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                keys, bound = shingle_sets(data, offsets, width)
                unit, n = _units(keys, bound), np.diff(bound)
                new = n > 0
                for i in np.flatnonzero(new):
                    u = int(unit[i])
                    new[i] = u not in seen
                    seen.add(u)
                if len(seen) > 1 << 20:
                    seen.clear()
                keys, unit, n = ragged_take(keys, bound[:-1][new], n[new]), unit[new], n[new]
                row, place = spread(n)
                level = levels[(keys & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((keys, level, row))
                common = (64 * row_sums(level.astype(np.int64), np.r_[0, np.cumsum(n)]) // np.maximum(n, 1)).astype(np.int32)
                keep = place < first_tokens(n, percent)[row]  # lexsort keeps rows together, so places still hold
                row = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys[order][keep].view(np.int64)), pa.array(unit[row]), pa.array(n[row].astype(np.int32)), pa.array(common[row])], names=["token", "unit", "n", "common"])

    return docs.select("text").mapInArrow(run, "token long, unit long, n int, common int")


def token_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(unit, n, tokens) of the wanted units, from the documents (doc_id) that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(0)):
                keys, bound = shingle_sets(data, offsets, width)
                unit, raw = _units(keys, bound), keys.tobytes()
                same = pa.array(unit == batch.column(1).slice(i, j - i).to_numpy())  # rows may share an id
                out = pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.diff(bound).astype(np.int32)), pa.array([raw[8 * a : 8 * b] for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary())], names=["unit", "n", "tokens"])
                yield out.filter(same)

    rows = docs.select("doc_id", "text").join(wanted.select("doc_id", "unit"), "doc_id").select("doc_id", "text", "unit").distinct()  # still dealt by doc_id
    return rows.select("text", "unit").mapInArrow(run, "unit long, n int, tokens binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    common = _overlap(a, b)
    return 100 * common >= percent * (low + high - common)


def check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of units that reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[ok, ["a", "b"]]

    left = sets.select(F.col("unit").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("unit").alias("b"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def open_group(side: np.ndarray, unit: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components of the two sides of a pair of groups, as a forest.

    Side 0 queries side 1 (side 2: one group with itself). A query whose overlap with the
    other side's token union is too small is dropped; the rest meet the members as rows of
    a token matrix.
    """
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none
    union = np.unique(np.concatenate([sets[j] for j in right]))
    size = np.array([len(s) for s in sets])
    left = left[[100 * _overlap(sets[i], union) >= percent * size[i] for i in left]]
    if not len(left):
        return none, none

    def rows(which):
        out = np.zeros((len(which), len(union)), np.float32)
        for r, i in enumerate(which):
            at = np.minimum(np.searchsorted(union, sets[i]), len(union) - 1)
            out[r, at[union[at] == sets[i]]] = 1
        return out

    common = np.rint(rows(left) @ rows(right).T).astype(np.int64)
    hit = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    hit &= part[left][:, None] != part[right][None, :]
    i, j = np.nonzero(hit)
    return forest(unit[left[i]], unit[right[j]])


def open_groups(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in pairs (g1, g2) of groups; a task holds one pair, at most two groups, at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = open_group(pdf["side"].to_numpy(), pdf["unit"].to_numpy(), pdf["component"].to_numpy(), [np.frombuffer(t, np.uint64) for t in pdf["tokens"]], percent)
        return pd.DataFrame({"a": a, "b": b})

    own = members.select("group", "unit", "component").join(sets.select("unit", "tokens"), "unit")
    side = lambda k, g: F.struct(F.lit(k).alias("side"), F.col(g).alias("group"))
    sides = F.when(F.col("g1") == F.col("g2"), F.array(side(2, "g1"))).otherwise(F.array(side(0, "g1"), side(1, "g2")))
    return pairs.select("g1", "g2", F.explode(sides).alias("x")).select("g1", "g2", "x.side", "x.group").join(own, "group").groupBy("g1", "g2").applyInPandas(run, "a long, b long")


def grouped(units: DataFrame, stars: DataFrame, size: int) -> DataFrame:
    """(unit, component, bundle, group): groups of about ``size`` similar units.

    A component of more units is a bundle of groups. Smaller ones are put together with
    those that share a leader, linked or not; each such group is a bundle of its own.
    """
    family = components(stars).select(F.col("node").alias("unit"), F.col("component").alias("family"))
    sizes = units.groupBy("component").agg(F.count("*").alias("in_component"))
    rows = units.join(sizes, "component").join(family, "unit", "left").withColumn("family", F.when(F.col("in_component") > size, F.col("component")).otherwise(F.coalesce("family", "unit")))
    rows = rows.withColumn("big", F.col("in_component") > size)
    counts = rows.groupBy("family", "big").agg(F.count("*").alias("in_family"))
    rows = rows.join(counts, ["family", "big"])
    piece = F.pmod(F.when(F.col("big"), F.xxhash64("unit")).otherwise(F.xxhash64("component")), F.ceil(F.col("in_family") / size))
    rows = rows.withColumn("group", F.xxhash64("family", "big", piece))
    return rows.select("unit", "component", F.when(F.col("big"), F.xxhash64("component", F.lit(True))).otherwise(F.col("group")).alias("bundle"), "group")


def group_pairs(matrix: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (g1, g2), g1 = g2 included, that share enough matrix tokens for a link between two components.

    Bundles meet first, so a large component costs one row a token and its groups are
    looked at only where another component has the token.
    """
    agg = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("c0").alias("c0"), F.max("c1").alias("c1")]
    cells = matrix.select("token", "unit", F.col("n").alias("low"), F.col("n").alias("high")).join(members.withColumn("c0", F.col("component")).withColumn("c1", F.col("component")), "unit").groupBy("token", "bundle", "group").agg(*agg)
    cells = step(cells, "jaccard-cells")
    bundles = cells.groupBy("token", "bundle").agg(*agg)
    named = lambda df, pre, key: df.select("token", *[F.col(c).alias(pre + c) for c in (*key, "low", "high", "c0", "c1")])
    apart = f"100 * y_high >= {percent} * x_low and 100 * x_high >= {percent} * y_low and not (x_c0 = x_c1 and y_c0 = y_c1 and x_c0 = y_c0)"
    met = named(bundles, "x_", ["bundle"]).join(named(bundles, "y_", ["bundle"]), "token").where(f"x_bundle <= y_bundle and {apart}").select("token", "x_bundle", "y_bundle")
    both = met.join(named(cells, "x_", ["bundle", "group"]), ["token", "x_bundle"]).join(named(cells, "y_", ["bundle", "group"]), ["token", "y_bundle"]).where(f"(x_bundle < y_bundle or x_group <= y_group) and {apart}")
    found = both.groupBy(F.col("x_group").alias("g1"), F.col("y_group").alias("g2")).agg(F.count("*").alias("c"), F.min(F.least("x_low", "y_low")).alias("low"))
    return found.where("c >= 1 + low div 10").select("g1", "g2")


def join_classes(docs: DataFrame, width: int = 5, percent: int = 80, group_size: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; other columns do not matter).

    component_id is the smallest doc_id linked directly or through others, the row itself
    included. Texts without words (null, empty, blank) have no shingles and no links. Rows
    that repeat an id are rows of their own; equal texts always link.
    """
    scanned = step(scan_sets(docs, width), "jaccard-sets")
    rows = scanned.where("piece is null").select("doc_id", "n_shingles", "unit")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.min("doc_id").alias("doc_id"))
    levels = frequency_levels(scanned)

    # the matrix: tokens that at least two units share
    at = Window.partitionBy("token")
    tokens = matrix_tokens(docs, levels, width, percent).repartition("token").dropDuplicates(["token", "unit"])
    lead = F.max(F.struct("common", "unit", "n")).over(at)
    matrix = tokens.withColumn("lead", lead).withColumn("least", F.min("unit").over(at)).withColumn("last", F.max("unit").over(at)).where("least < last")
    matrix = step(matrix.select("token", "unit", "n", F.col("lead.unit").alias("lead"), F.col("lead.n").alias("lead_n")), "jaccard-matrix")

    # one leader a unit: the one with most common tokens
    near = matrix.where("unit <> lead").where(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)").groupBy("unit", "lead").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("lead_n").alias("lead_n"))
    near = near.where("c >= 1 + least(n, lead_n) div 10").groupBy("unit").agg(F.max(F.struct("c", "lead")).alias("best"))
    stars = step(near.select(F.col("unit").alias("a"), F.col("best.lead").alias("b")), "jaccard-stars")

    def sets_of(units, purpose):
        return step(token_sets(docs, units.distinct().join(classes, "unit"), width), purpose)

    sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("unit")), "jaccard-star-sets")
    links = step(check_pairs(stars, sets, percent), "jaccard-star-links")
    part = components(links)

    units = matrix.select("unit").distinct().join(part.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    members = step(grouped(units, stars, group_size), "jaccard-groups")
    pairs = step(group_pairs(matrix, members, percent), "jaccard-group-pairs")
    met_groups = pairs.select(F.explode(F.array("g1", "g2")).alias("group")).distinct()
    sets = sets_of(members.join(met_groups, "group", "left_semi").select("unit"), "jaccard-group-sets")
    more = step(open_groups(pairs, members, sets, percent), "jaccard-group-links")
    full = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # back to documents: the smallest id of a component
    named = classes.join(full, classes["unit"] == full["node"], "left").select("unit", "doc_id", F.coalesce("component", "unit").alias("component"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(lowest, "component").select("unit", "component_id")
    return rows.join(labels, "unit", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
