"""Mixing sources to target weights by drawn blocks.

The words of a source, document after document, are one stream cut into blocks of a
fixed number of words. A source's target is its weighted share of all words, stopped
at a multiple of its size; what is over goes to the others by weight. Targets give
every source a number of slots. Each output shard draws how many of its slots each
source gets: a multinomial draw conditioned on the totals, by halving the range of
shards with hypergeometric draws seeded by the range, so any task works out its shard
alone and reruns agree. A source's k-th slot takes the block that a seeded permutation
of its block numbers gives to k; each pass over the source has a permutation of its
own. Slots and documents then meet in a join on (source, block).

Only one row a source comes to the driver. Running word offsets inside a source are
sums inside hashed buckets plus sums of earlier buckets, so a source with most of the
rows is spread over about sqrt(rows) buckets and no task holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .flat import mix, mix_int, text_buffer, word_bounds
from .steps import parts, step

WORD = "[^\\x20\\x09-\\x0D]+"
_EXACT = 1_000_000_000  # numpy's hypergeometric draws go up to here


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Weighted shares of the sum, none above ``most`` times its size; what is over is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) by a keyed Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(mix_int(key + r)) for r in range(4)]
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def split(quota: np.ndarray, part: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``part`` slots drawn without return from ``quota`` each source gets."""
    total = int(quota.sum())
    if total < _EXACT:
        return rng.multivariate_hypergeometric(quota, part, method="marginals")
    # far above the range of exact draws a draw differs from its mean by a vanishing share
    exact = quota.astype(object) * part
    out = np.array([int(x // total) for x in exact], np.int64)
    order = np.argsort([-(int(x) % total) for x in exact], kind="stable")
    out[order[: part - int(out.sum())]] += 1
    return out


def shard_draw(shard: int, shards: int, per_shard: int, quota: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before this shard, and in it."""
    before, lo, hi = np.zeros(len(quota), np.int64), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(quota, min((mid - lo) * per_shard, int(quota.sum())), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            quota, hi = left, mid
        else:
            before, quota, lo = before + left, quota - left, mid
    return before, quota


@dataclass
class MixPlan:
    """Sources by code point with null last: sizes, targets, blocks, slots."""

    names: list[str | None]
    size: list[int]
    target: list[float]
    rows: int
    block: int
    per_shard: int
    seed: int

    @property
    def blocks(self) -> np.ndarray:
        return np.array([-(-s // self.block) for s in self.size], np.int64)

    @property
    def slots(self) -> np.ndarray:
        """Targets in blocks of the source's mean length (its last block may be short): whole turns give exactly its size."""
        return np.array([math.floor(t * b / s + 0.5) if s else 0 for t, b, s in zip(self.target, self.blocks.tolist(), self.size, strict=True)], np.int64)

    @property
    def shards(self) -> int:
        return max(1, -(-int(self.slots.sum()) // self.per_shard))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, s, t) for i, (n, s, t) in enumerate(zip(self.names, self.size, self.target, strict=True))]
        return spark.createDataFrame(rows, "source_no int, __source string, source_size long, target double")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def plan(sizes: DataFrame, weights=None, most: float = 3.0, block: int = 32, per_shard: int = 4096, seed: int = 7) -> MixPlan:
    """Targets from rows (source, size). ``weights``: source -> weight; 1, 2, 3 repeating by default."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, size = [r["source"] for r in found], [int(r["size"]) for r in found]
    w = [float(weights[n]) for n in names] if weights else [1.0 + i % 3 for i in range(len(names))]
    return MixPlan(names, size, targets(size, w, most), sum(r["rows"] for r in found), block, per_shard, seed)


def placed(docs: DataFrame, mix_plan: MixPlan) -> DataFrame:
    """Adds source_no, source_size, target and ``start``, the words of the source before the document.

    Order inside a source: hashed bucket, doc_id, text hash. Rows that tie in all of these
    are equal, so which of them comes first makes no difference. Needs ``size`` and ``text_key``.
    """
    buckets = max(1, math.isqrt(mix_plan.rows))
    rows = docs.join(F.broadcast(mix_plan.table(docs.sparkSession)), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")  # a row a source
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))
    own = Window.partitionBy("source_no", "__bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source_no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_no", "__bucket").agg(F.sum("size").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = rows.withColumn("__inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inside.join(totals, ["source_no", "__bucket"]).withColumn("start", F.col("__before") + F.col("__inside")).drop("__before", "__inside", "__bucket")


def draw(spark: SparkSession, mix_plan: MixPlan) -> DataFrame:
    """The mix as (shard, slot, source_no, block, pass): one row a slot."""
    quota, blocks, per, seed, shards = mix_plan.slots, mix_plan.blocks, mix_plan.per_shard, mix_plan.seed, mix_plan.shards

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                before, count = shard_draw(int(shard), shards, per, quota, seed)
                source = np.repeat(np.arange(len(count)), count)
                number = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + before[source]
                turn, block = number // blocks[source], np.empty(len(source), np.int64)
                for s, t in {(s, t) for s, t in zip(source.tolist(), turn.tolist(), strict=True)}:
                    at = (source == s) & (turn == t)
                    block[at] = permute(number[at] % blocks[s], int(blocks[s]), mix_int(seed << 40 | s << 8 | t))
                slot = np.random.default_rng([seed, shards, int(shard), 1]).permutation(len(source))
                yield pd.DataFrame({"shard": shard, "slot": slot, "source_no": source.astype(np.int32), "block": block, "turn": turn.astype(np.int32)})

    ids = spark.range(0, shards, 1, min(shards, 4 * parts(spark.range(1))))
    return ids.mapInPandas(run, "shard long, slot long, source_no int, block long, turn int")


def block_counts(spark: SparkSession, mix_plan: MixPlan) -> DataFrame:
    # the hint: a generated table looks as small as its list of shards, and would be broadcast at any size
    return draw(spark, mix_plan).groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")


def document_blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row for each document and block that share words: ``block``, ``words``; none for documents without words."""
    out = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("start"), F.col("block") * block)
    return out.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - first)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, and the words that the mix takes of each document, repeats counted.

    Null and empty texts have size 0 and give nothing. A null source is a source. Rows
    with equal ids stay separate rows.
    """
    rows = sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", F.xxhash64("text").alias("text_key"))
    rows = step(rows, "mix-sizes")
    p = plan(rows.select("source", "size"), **options)
    at = placed(rows, p)
    hits = document_blocks(at, p.block).join(block_counts(docs.sparkSession, p), ["source_no", "block"], "left")
    full = hits.groupBy("source_no", "start", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*out).unionByName(at.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: for each turn in which blocks of a document are taken, a row with the taken words.

    Runs of neighbouring taken blocks keep their text as it was; a line break joins runs.
    All columns of ``docs`` stay, ``text`` and ``n_chars`` are those of the taken words.
    """
    spark = docs.sparkSession
    names = docs.columns
    own = [docs[c].alias(f"_{i}") for i, c in enumerate(names)]  # other columns may have any names
    plain = sized(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key"), F.struct(*own).alias("__row"))).drop("text")
    p = plan(sized(docs.select("source", "text")), **options)
    rows = step(placed(plain, p).where("size > 0").select("source_no", "start", "size", "__row"), "mix-texts")
    hits = document_blocks(rows.select("source_no", "start", "size"), p.block).join(block_counts(spark, p), ["source_no", "block"])
    found = hits.groupBy("source_no", "start").agg(F.collect_list(F.struct("block", "times")).alias("__blocks"))  # the blocks of one document
    both = rows.join(found, ["source_no", "start"]).select(*[F.col(f"__row._{i}").alias(c) for i, c in enumerate(names)], F.col("start").alias("__start"), "__blocks")
    schema = T.StructType([docs.schema[c] for c in names])
    block = p.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            begin = batch.column(batch.schema.get_field_index("__start")).to_pylist()
            lists = batch.column(batch.schema.get_field_index("__blocks")).to_pylist()
            of, texts = [], []
            for i, (at, pairs) in enumerate(zip(begin, lists, strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                s, e, _ = word_bounds(own, np.array([0, len(own)]))
                times = np.zeros((at + len(s) - 1) // block - at // block + 1, np.int64)
                for b in pairs:
                    times[b["block"] - at // block] = b["times"]
                per_word = times[(at + np.arange(len(s))) // block - at // block]
                raw = own.tobytes()
                for turn in range(1, int(per_word.max(initial=0)) + 1):
                    on = np.r_[False, per_word >= turn, False]
                    a, z = np.flatnonzero(on[1:-1] & ~on[:-2]), np.flatnonzero(on[1:-1] & ~on[2:])
                    of.append(i)
                    texts.append(b"\n".join(raw[s[x] : e[y]] for x, y in zip(a, z, strict=True)).decode())
            picked = batch.take(pa.array(of, pa.int64()))
            new = pa.array(texts, pa.string())
            swap = {"text": new, "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([swap[c].cast(picked.schema.field(c).type) if c in swap else picked.column(picked.schema.get_field_index(c)) for c in names], names=names)

    return both.mapInArrow(run, schema)
