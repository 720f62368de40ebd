"""Removal of repeated byte strings with a column-wise multi-document suffix order.

A byte goes when it lies in a string of ``width`` bytes that also starts in a document
with a smaller id. Equal texts are one unit, named by the smallest id that has them.

1. Anchors. Every window of ``width`` bytes holds a minimiser, the k-mer of smallest hash;
   equal windows hold equal minimisers. Minimisers that only one unit holds belong to
   windows that nothing repeats, so only shared ones go on.
2. Segments. The windows around one occurrence of a shared minimiser are one short string
   of at most 2 * width - k bytes. Equal segments are one, with the smallest unit.
   Segments of one minimiser meet in one task.
3. Order. In a task the Burrows-Wheeler transform and the longest common prefixes of a
   batch of segments are built column by column: each round inserts one symbol of every
   segment, from the right. A new suffix goes where a stable sort of the transform by
   symbol puts it, and its common prefix is one more than the least between it and the
   occurrence of its symbol before it. Windows are suffixes of at least ``width`` bytes,
   and equal ones are neighbours with a common prefix of ``width`` or more.
4. Each window's smallest unit goes back to the segment's occurrences, whose windows with
   a smaller owner are merged into spans of the document.
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

from .flat import SegmentHash, mix, ragged_take, text_blocks
from .steps import step

_END = 255  # not a byte of UTF-8


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i : i + width]; shorter at the end."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:]) if len(out) > have else out
        have *= 2
    if have < width and len(out) > width - have:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out


class Minimisers:
    """k-mer hashes of a block of texts and the positions that are minimal in some window of ``width`` bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, k: int):
        self.width, self.span = width, width - k + 1
        self.offsets = offsets
        n = len(data)
        self.windows = max(0, n - width + 1)
        if not self.windows:
            self.key, self.level, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
            return
        self.key = mix(SegmentHash(data).fixed(k))
        self.level = (self.key >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        least = sliding(self.level, self.span, np.minimum)[: self.windows]
        start = np.arange(self.windows)
        text = np.searchsorted(offsets, start, "right") - 1
        inside = start + width <= offsets[text + 1]
        self.row_of_window = text
        held = np.where(inside, least, np.uint32(0))
        padded = np.r_[np.zeros(self.span - 1, np.uint32), held, np.zeros(self.span - 1, np.uint32)]
        best = sliding(padded, self.span, np.maximum)[: len(self.level)]  # over the windows that hold the k-mer
        self.place = np.flatnonzero(best == self.level)

    def rows(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, "right") - 1

    def window_range(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start for which the k-mer at ``place`` is minimal."""
        reach = np.arange(1, self.span)
        row = self.rows(place)
        own = self.level[place]
        first, last = np.maximum(place - self.span + 1, self.offsets[row]), np.minimum(place, self.offsets[row + 1] - self.width)
        for part in range(0, len(place), 1 << 15):
            p, h = place[part : part + (1 << 15)], own[part : part + (1 << 15)]
            left, right = p[:, None] - reach, p[:, None] + reach
            below = (left >= 0) & (self.level[np.maximum(left, 0)] < h[:, None])
            near = np.where(below.any(1), below.argmax(1), self.span)  # distance - 1 of the nearest smaller one
            first[part : part + len(p)] = np.maximum(first[part : part + len(p)], p - near)
            below = (right < len(self.level)) & (self.level[np.minimum(right, len(self.level) - 1)] < h[:, None])
            near = np.where(below.any(1), below.argmax(1), self.span)
            last[part : part + len(p)] = np.minimum(last[part : part + len(p)], p + near + 1 - self.span)
        return first, last


def anchors(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(anchor, unit): the minimisers of every text, each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            units = batch.column(1).to_numpy()
            for i, _, data, offsets in text_blocks(batch.column(0)):
                m = Minimisers(data, offsets, width, k)
                row = m.rows(m.place)
                new = np.zeros(len(offsets) - 1, bool)
                for r, u in enumerate(units[i : i + len(new)].tolist()):
                    new[r] = u not in seen
                    seen.add(u)
                if len(seen) > 1 << 20:
                    seen.clear()
                row, key = row[new[row]], m.key[m.place][new[row]]
                _, once = np.unique(mix(key ^ mix(row.astype(np.uint64))), return_index=True)  # a text repeats its own lines
                yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(units[i + row[once]])], names=["anchor", "unit"])

    return docs.select("text", "unit").mapInArrow(run, "anchor long, unit long")


def segments(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(unit, place, anchor, seg, bytes) around the anchors listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, wanted = batch.column(1).to_numpy(), batch.column(2)
            for i, j, data, offsets in text_blocks(batch.column(0), 1 << 20):
                m = Minimisers(data, offsets, width, k)
                key, row = m.key[m.place].view(np.int64), m.rows(m.place)
                lists = wanted.slice(i, j - i)
                have = np.sort(mix(lists.flatten().to_numpy().view(np.uint64) ^ mix(np.repeat(np.arange(j - i), lists.value_lengths().to_numpy()).astype(np.uint64))))
                own = mix(key.view(np.uint64) ^ mix(row.astype(np.uint64)))
                hit = have[np.minimum(np.searchsorted(have, own), len(have) - 1)] == own if len(have) else np.zeros(len(own), bool)
                place = m.place[hit]
                if not len(place):
                    continue
                first, last = m.window_range(place)
                length = last - first + width
                some = last >= first
                place, first, length, row, key = place[some], first[some], length[some], row[hit][some], key[hit][some]
                out = ragged_take(data, first, length)
                bounds = np.r_[0, np.cumsum(length)].astype(np.int32)
                name = SegmentHash(data).of(first, first + length)
                texts = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(units[i + row]), pa.array(first - offsets[row]), pa.array(key), pa.array(name.view(np.int64)), texts], names=["unit", "place", "anchor", "seg", "bytes"])

    return docs.select("text", "unit", "anchors").mapInArrow(run, "unit long, place long, anchor long, seg long, bytes binary")


def build_order(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection of strings (shorter than 256 bytes, without byte 255): string and start of each suffix, and common prefixes.

    Rounds insert one symbol of each string from its right end, keeping the transform, the
    common prefixes and the suffix names in sorted order.
    """
    m = len(bounds) - 1
    length = np.diff(bounds)
    at = bounds[1:] - 1
    kind = np.int32 if m < 1 << 22 else np.int64
    name = np.arange(m, dtype=kind) << 8 | length.astype(kind)  # string and start, the empty suffixes first
    bwt = np.where(length > 0, data[np.maximum(at, 0)] if len(data) else _END, _END).astype(np.uint8)
    lcp = np.zeros(m, np.uint8)
    fresh = np.flatnonzero(length > 0)  # places of suffixes whose next symbol has not been inserted
    while len(fresh):
        order = np.argsort(bwt, kind="stable")
        rank_of = np.empty(len(order), np.int32)
        rank_of[order] = np.arange(len(order), dtype=np.int32)
        rank = np.sort(rank_of[fresh])
        source = order[rank]
        # common prefixes of the new suffixes and of those right after them
        asked = np.zeros(len(order) + 1, bool)
        asked[rank] = asked[rank + 1] = True
        ask = np.flatnonzero(asked[:-1])
        high, low = order[ask], order[np.maximum(ask - 1, 0)]
        symbol = bwt[high]
        same = (ask > 0) & (symbol == bwt[low]) & (symbol != _END)
        value = np.zeros(len(ask), np.uint8)
        if same.any():
            pairs = np.empty(2 * int(same.sum()), np.int64)
            pairs[::2], pairs[1::2] = low[same] + 1, high[same] + 1
            value[same] = np.minimum.reduceat(np.r_[lcp, np.uint8(0)], pairs)[::2] + 1
        # insertion in one sequential pass over the three arrays
        new_name = name[source] - 1
        string, start = new_name >> 8, new_name & 255
        place = m + rank
        source = np.ones(len(bwt) + len(rank), np.int32)
        source[place] = 0
        np.cumsum(source, out=source)
        source -= 1  # of the old entries; the new ones follow all of them
        source[place] = len(bwt) + np.arange(len(rank), dtype=np.int32)
        more = start > 0
        real = symbol != _END
        lcp = np.concatenate([lcp, np.zeros(len(rank), np.uint8)])[source]
        lcp[m + ask[real]] = value[real]
        fresh_symbol = np.where(more, data[np.maximum(bounds[string] + start - 1, 0)], _END).astype(np.uint8)
        bwt, name = np.concatenate([bwt, fresh_symbol])[source], np.concatenate([name, new_name])[source]
        fresh = place[more]
    return (name >> 8).astype(np.int64), (name & 255).astype(np.int64), lcp


def window_owners(data: np.ndarray, bounds: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and smallest owner of every window of ``width`` bytes, by string and start."""
    string, start, lcp = build_order(data, bounds)
    group = np.cumsum(lcp < width) - 1
    full = np.diff(bounds)[string] - start >= width
    string, start, group = string[full], start[full], group[full]
    if not len(string):
        return string, start, owner[:0]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(owner[string], first)[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
    back = np.lexsort((start, string))
    return string[back], start[back], least[back]


def owners(distinct: DataFrame, width: int, batch_rows: int) -> DataFrame:
    """(seg, first, last, owner): runs of windows of a segment with one smallest owner, other than the segment's own."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor = pdf["anchor"].to_numpy()
        opens = np.r_[True, anchor[1:] != anchor[:-1]]
        alone = opens & np.r_[opens[1:], True]  # a string without another to be ordered with: all its windows are its owner's
        one = pdf[alone]
        last = np.array([len(b) - width for b in one["bytes"]], np.int64)
        single = pd.DataFrame({"seg": one["seg"], "first": np.zeros(len(one), np.int64), "last": last, "owner": one["owner"]})
        return pd.concat([single, ordered(pdf[~alone])]) if not alone.all() else single

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf["bytes"].tolist()
        bounds = np.r_[0, np.cumsum([len(b) for b in raw])]
        own = pdf["owner"].to_numpy(np.int64)
        string, start, least = window_owners(np.frombuffer(b"".join(raw), np.uint8), bounds, own, width)
        opens = np.ones(len(string), bool)
        opens[1:] = (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])
        a = np.flatnonzero(opens)
        z = np.r_[a[1:], len(string)] - 1
        return pd.DataFrame({"seg": pdf["seg"].to_numpy()[string[a]], "first": start[a], "last": start[z], "owner": least[a]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of an anchor stay in one batch
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            anchor = rest["anchor"].to_numpy()
            opens = np.r_[np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]
            begin = 0
            while len(rest) - begin >= batch_rows:  # the first anchor that begins beyond the batch, or the last one that begins
                later = opens[opens > begin]
                if not len(later):
                    break
                cut = int(later[min(np.searchsorted(later, begin + batch_rows), len(later) - 1)])
                yield solve(rest.iloc[begin:cut])
                begin = cut
            rest = rest.iloc[begin:]
        if rest is not None and len(rest):
            yield solve(rest)

    return distinct.sortWithinPartitions("anchor").mapInPandas(run, "seg long, first long, last long, owner long")


def removed_spans(docs: DataFrame, width: int = 50, k: int = 20, batch_rows: int = 1 << 11) -> DataFrame:
    """(unit, doc_id of the unit's first document, spans): merged byte spans to remove from that document, and ``unit`` for all others.

    Needs columns doc_id, text (not null) and unit, a hash of the text.
    """
    first = docs.groupBy("unit").agg(F.min("doc_id").alias("owner"))
    at = Window.partitionBy("anchor")
    shared = anchors(docs, width, k).repartition("anchor").withColumn("lo", F.min("unit").over(at)).withColumn("hi", F.max("unit").over(at)).where("lo < hi")
    shared = step(shared.select("unit", "anchor"), "repeat-anchors")
    lists = shared.groupBy("unit").agg(F.collect_set("anchor").alias("anchors")).join(first, "unit")  # the anchors of one text
    own = docs.select(F.col("doc_id").alias("owner"), "unit", "text").join(lists, ["unit", "owner"])
    found = step(segments(own, width, k).join(first, "unit"), "repeat-segments")
    distinct = found.groupBy("anchor", "seg", "bytes").agg(F.min("owner").alias("owner"))
    runs = step(owners(distinct.repartition("anchor"), width, batch_rows), "repeat-owners")
    hits = found.select("seg", "unit", "owner", "place").join(runs.withColumnRenamed("owner", "least"), "seg").where("least < owner")
    return hits.select("unit", (F.col("place") + F.col("first")).alias("a"), (F.col("place") + F.col("last") + width).alias("b"))


def merge_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def remove_repeats(docs: DataFrame, width: int = 50, k: int = 20) -> DataFrame:
    """doc_id, spans (array of start, end: removed bytes), kept (binary: the remaining bytes) for every row of (doc_id, text).

    Null is empty. Matches never cross documents and are judged on the input. Rows with
    equal ids are not smaller than each other.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("unit", F.xxhash64("text"))
    spans = removed_spans(rows, width, k)
    lists = spans.groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # spans of one text
    first = rows.groupBy("unit").agg(F.min("doc_id").alias("owner"))
    facts = step(first.join(lists, "unit", "left"), "repeat-spans")
    both = rows.join(facts, "unit").select("doc_id", "text", (F.col("owner") < F.col("doc_id")).alias("copy"), F.transform("spans", lambda s: s["a"]).alias("a"), F.transform("spans", lambda s: s["b"]).alias("b"))
    span_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies, aa, bb = (batch.column(c).to_pylist() for c in (1, 2, 3, 4))
            size, out, kept = [], [], []
            for text, copy, a, b in zip(texts, copies, aa, bb, strict=True):
                raw = text.encode()
                gone = [(0, len(raw))] if copy and len(raw) >= width else merge_spans(np.array(a), np.array(b)) if a and not copy else []
                size.append(len(raw))
                out.append([{"start": x, "end": y} for x, y in gone])
                edges = [0, *[e for g in gone for e in g], len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(out, span_t), pa.array(kept, pa.binary())], names=schema.names)

    return both.mapInArrow(run, schema)


def report(docs: DataFrame, width: int = 50) -> DataFrame:
    """Removed bytes, spans and the digest of what is kept."""
    out = remove_repeats(docs, width)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
