"""Alignment of two tokenizers over a corpus: byte-level BPE against SentencePiece BPE.

Equal texts are brought together by one shuffle on the full text, and each distinct text
is tokenised and aligned once. Both token sequences spell the same bytes (a space and the
text), so the union of their token ends cuts the bytes into pieces, and each piece is one
overlapping pair of tokens (a link); ends that both share close a group.

A pair of ids counts in as many documents as the texts that hold it have copies. Counts
are summed and looked up per block of texts: a block names each of its pairs once, so
what is shuffled are distinct pairs of blocks and not links, and a text keeps its links as
differences of places in its block's list. Measures of texts return to the documents by
the text's SHA-256 and a salt, so the copies of one text are spread over many tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import blocks, ragged_take, row_sums, spread
from .steps import step

BLOCK = 8 << 20  # bytes of text that share a list of pairs; a longer text is a block of its own
PART = 1 << 20  # bytes of text tokenised at once
SALTS = 64  # bits of a long: tasks over which the copies of one text can be spread
MARK = "▁"
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write the printable Latin-1 bytes as themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class _Bytes:
    """The byte strings of a vocabulary, and its ids in decimal, each followed by a comma."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(e) for e in entries], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.decimal = pa.array([f"{i}," for i in range(len(entries))], pa.large_string())

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return ragged_take(self.data, self.at[ids], self.length[ids])


class Aligned:
    """Flat alignment of some texts: token ids and links with the number of each per text, and the group strings."""

    def __init__(self, a, b, a_ids, b_ids, a_count, b_count):
        self.a_ids, self.b_ids, self.n_a, self.n_b = a_ids, b_ids, a_count, b_count
        a_end, b_end = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
        total = int(a_end[-1]) if len(a_end) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[a_end], in_b[b_end] = True, True
        cuts = np.flatnonzero(in_a | in_b)
        # the token that covers the bytes before a cut: as many tokens as end earlier
        self.link_a = (np.cumsum(in_a[cuts]) - in_a[cuts]).astype(np.int64)
        self.link_b = (np.cumsum(in_b[cuts]) - in_b[cuts]).astype(np.int64)
        shared = in_a[cuts] & in_b[cuts]
        row_end = np.r_[0, np.cumsum(row_sums(a.length[a_ids], np.r_[0, np.cumsum(a_count)]))]
        bound = np.searchsorted(cuts, row_end, "right")
        self.n_links = np.diff(bound)
        self.n_groups = row_sums(shared.astype(np.int64), bound)
        self._group_a = np.searchsorted(cuts[shared], a_end)
        self._group_b = np.searchsorted(cuts[shared], b_end)
        self._decimal = a.decimal, b.decimal

    def group_strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text: ids in decimal, groups in order."""
        n_groups = int(self.n_groups.sum())
        per_a, per_b = np.bincount(self._group_a, minlength=n_groups), np.bincount(self._group_b, minlength=n_groups)
        shift = len(self._decimal[0])
        ids = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        before_b = np.cumsum(per_b) - per_b
        upto_a = np.cumsum(per_a)
        ids[np.arange(len(self.a_ids)) + before_b[self._group_a]] = self.a_ids
        ids[np.arange(len(self.b_ids)) + upto_a[self._group_b]] = self.b_ids + shift
        texts = pa.chunked_array(self._decimal).combine_chunks().take(pa.array(ids))
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
        out = np.frombuffer(data, np.uint8)[: ends[-1]].copy() if len(ids) else np.zeros(0, np.uint8)
        out[ends[upto_a + before_b] - 1] = ord("|")
        out[ends[upto_a + before_b + per_b] - 1] = ord(";")
        bound = ends[np.r_[0, np.cumsum(self.n_a + self.n_b)]]
        flat = out.tobytes()
        return [flat[i : j - 1] if j > i else b"" for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


class Aligner:
    """Two tokenizers as libraries load them, and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("the first tokenizer must be byte-level BPE without a normaliser")
        self.first = Tokenizer.from_file(a_path)
        self.first.encode_special_tokens = True  # their strings inside texts are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        raw = _byte_of_char()
        vocab = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        entries = [vocab.get(i, "") for i in range(max(vocab) + 1)]
        self.a = _Bytes([bytes(raw[c] for c in t) if set(t) <= raw.keys() else t.encode() for t in entries])
        sp = self.second
        self.b = _Bytes([bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())])
        self.b_bits = int(len(self.b.length) - 1).bit_length()
        if int(len(self.a.length) - 1).bit_length() + self.b_bits > 40:
            raise ValueError("a pair of ids takes more than 40 bits")

    def align(self, texts: list[str]) -> tuple[Aligned, np.ndarray]:
        """The alignment of the texts, and which of them have one: others are empty or spelt differently by a tokenizer."""
        want = [b" " + t.encode() if t else b"" for t in texts]
        first = self.first.encode_batch_fast([" " + t if t else "" for t in texts], add_special_tokens=False)
        ids = [e.ids for e in first], self.second.encode(texts, num_threads=1) if texts else []
        flat, count, good = [], [], np.array([len(w) > 0 for w in want], bool)
        size = np.array([len(w) for w in want], np.int64)
        for vocabulary, lists in zip((self.a, self.b), ids, strict=True):
            n = np.array([len(x) for x in lists], np.int64)
            flat.append(np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())))
            count.append(n)
            spelt = vocabulary.spell(flat[-1]).tobytes()
            if spelt != b"".join(want):
                bound = np.r_[0, np.cumsum(row_sums(vocabulary.length[flat[-1]], np.r_[0, np.cumsum(n)]))]
                good &= np.array([spelt[i:j] == w for i, j, w in zip(bound[:-1], bound[1:], want, strict=True)], bool)
            else:
                good &= size > 0
        if not good.all():
            for k in (0, 1):
                flat[k] = flat[k][np.repeat(good, count[k])]
                count[k] = np.where(good, count[k], 0)
        return Aligned(self.a, self.b, *flat, *count), good

    def pairs(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair and number of links of every distinct pair of every text, ascending."""
        pair = found.a_ids[found.link_a] << self.b_bits | found.b_ids[found.link_b]
        row = np.repeat(np.arange(len(found.n_links)), found.n_links)
        bits = len(self.a.length).bit_length() + self.b_bits
        if len(found.n_links) >> (62 - bits):
            raise ValueError("too many texts at once")
        code = np.sort(row << bits | pair)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(code)])
        code = code[first]
        return code >> bits, code & ((1 << bits) - 1), times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers >= 0 as seven bits a byte, the low bits first and the top bit set on all bytes but a number's last; bytes of each."""
    width = np.ones(len(values), np.int64)
    for k in range(1, 9):
        if not (more := values >= (1 << (7 * k))).any():
            break
        width += more
    of, place = spread(width)
    out = (values[of] >> (7 * place)) & 127
    out[place < width[of] - 1] |= 128
    return out.astype(np.uint8), width


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    of, place = spread(np.diff(np.r_[-1, last]))
    if not len(of):
        return np.zeros(0, np.int64)
    return np.add.reduceat((data[: len(of)].astype(np.int64) & 127) << (7 * place), np.r_[0, last[:-1] + 1])


def pack_rows(values: np.ndarray, bound: np.ndarray) -> list[bytes]:
    """``pack`` of values[bound[i] : bound[i + 1]] for every i."""
    data, width = pack(values)
    ends = np.r_[0, np.cumsum(width)][bound].tolist()
    flat = data.tobytes()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


_ALIGNED = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("text_key", T.BinaryType())]
    + [T.StructField(c, T.LongType()) for c in ("salts", *MEASURES)]
    + [T.StructField("groups_sha256", T.StringType())]
    # links of a text: differences of its places in the block's list, doubled, plus one where its number of links is in ``times``
    + [T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType())]
    # one row a block: its distinct pairs, ascending, and in how many documents of the block each is linked
    + [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("n_docs", T.ArrayType(T.LongType()))]
)


def _align_texts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of distinct texts (text, copies, salts) -> their alignments and the lists of pairs of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32

        def finished(kept):
            """The rows of a block."""
            nonlocal number
            pair = np.concatenate([k[1] for k in kept])
            listed = np.sort(pair)
            listed = listed[np.r_[True, listed[1:] != listed[:-1]]] if len(listed) else listed
            total = np.zeros(len(listed), np.int64)
            columns = {f.name: [] for f in _ALIGNED}
            for row, pair, times, copies, fixed in kept:
                place = np.searchsorted(listed, pair)
                np.add.at(total, place, copies[row])
                opens = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                gap = np.where(opens, place, np.r_[0, np.diff(place)]) if len(row) else place
                several = times > 1
                bound = np.searchsorted(row, np.arange(len(copies) + 1))
                columns["places"] += pack_rows(gap << 1 | several, bound)
                columns["times"] += pack_rows(times[several], np.r_[0, np.cumsum(several)][bound])
                for name, values in fixed.items():
                    columns[name] += values
            n = len(columns["places"])
            for name in ("pairs", "n_docs"):
                columns[name] = [None] * n
            columns["block"] = [number] * (n + 1)
            arrays = [pa.array(columns[f.name] if f.name == "block" else [*columns[f.name], {"pairs": listed, "n_docs": total}.get(f.name)], out_types[f.name]) for f in _ALIGNED]
            number += 1
            return pa.RecordBatch.from_arrays(arrays, names=_ALIGNED.names)

        kept, held = [], 0
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            size = np.r_[0, np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))]
            for i, j in blocks(size, PART):
                if kept and held + size[j] - size[i] > BLOCK:
                    yield finished(kept)
                    kept, held = [], 0
                held += size[j] - size[i]
                part = batch.slice(i, j - i).to_pydict()
                found, _ = tool.align(part["text"])
                fixed = {
                    "text_key": part["text_key"], "salts": part["salts"], "n_a": found.n_a.tolist(), "n_b": found.n_b.tolist(), "n_groups": found.n_groups.tolist(), "n_links": found.n_links.tolist(),
                    "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in found.group_strings()],
                }
                kept.append((*tool.pairs(found), np.array(part["copies"], np.int64), fixed))
        if kept:
            yield finished(kept)

    out_types = {"block": pa.int64(), "text_key": pa.binary(), "salts": pa.int64(), **dict.fromkeys(MEASURES, pa.int64()), "groups_sha256": pa.string(), "places": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int64())}
    return texts.mapInArrow(run, _ALIGNED)


def _measured(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of one block with what the counts of its pairs, in the order of its list, say about their links."""
    place = counts.column("place").to_numpy()
    value, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    value[place], best[place] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    total, n_best = [], []
    for places, times in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist(), strict=True):
        gap = unpack(np.frombuffer(places, np.uint8))
        at, n = np.cumsum(gap >> 1), np.ones(len(gap), np.int64)
        n[(gap & 1).astype(bool)] = unpack(np.frombuffer(times, np.uint8))
        total.append(int((n * value[at]).sum()))
        n_best.append(int(n[best[at]].sum()))
    return texts.drop_columns(["block", "places", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def distinct_texts(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Each text that is neither null nor empty once: text, its SHA-256, its number of rows, and the salts of its rows as bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _salt(keep))
    rows = docs.where(F.length(text) > 0).select(F.col(text).alias("text"), bit.alias("bit"))
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.bit_or("bit").alias("salts"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("text_key"), "text", "copies", "salts")


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (both ids in one long), n_docs: in how many documents a pair of ids is linked."""
    rows = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x"))
    return rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n_docs"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Null and empty texts, and texts that a tokenizer does not spell byte for byte, have no
    tokens: zeros and an empty string. Repeated rows and copies count as documents and are
    all returned; rows may repeat a key or have none. Other columns are ignored. Both paths
    must name the tokenizers on every machine.
    """
    tool = aligner(a_path, b_path)
    b_bits, n_first = tool.b_bits, len(tool.a.length)
    aligned = step(_align_texts(distinct_texts(docs, text, key), a_path, b_path), "crosstok-aligned")
    counts = step(pair_counts(aligned), "crosstok-counts")
    first = F.shiftright("pair", b_bits)
    highest = counts.groupBy(first.alias("first")).agg(F.max("n_docs").alias("highest"))
    if n_first <= 1 << 20:  # one row an id of the first vocabulary
        highest = F.broadcast(highest)
    counts = counts.join(highest, first == F.col("first")).select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    listed = aligned.where(F.col("pairs").isNotNull()).select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    looked_up = listed.join(counts, "pair").select("of_block", "place", "n_docs", "best")
    texts = aligned.where(F.col("text_key").isNotNull()).drop("pairs", "n_docs")
    schema = T.StructType([texts.schema[c] for c in texts.columns if c not in ("block", "places", "times")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    measured = texts.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(_measured, schema)
    measured = measured.select("text_key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)).alias("salt"), *out)
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    keyed = rows.where(F.length("text") > 0).select(F.col(key), F.unhex(F.sha2("text", 256)).alias("text_key"), _salt(key).alias("salt"))
    empty = rows.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select(F.col(key), *[F.lit(0).cast("long").alias(c) for c in out[:-1]], F.lit("").alias(out[-1]))
    return keyed.join(measured, ["text_key", "salt"]).select(F.col(key), *out).unionByName(empty)


def token_alignments(docs: DataFrame, a_path: str, b_path: str, text: str = "text", out: str = "alignment") -> DataFrame:
    """Adds the alignment itself: an array of (a array<int>, b array<int>), the ids of each group in order.

    Row-local. Null, empty and differently spelt texts give an empty array. Other columns pass through; ``out`` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    group = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(group))])
    ids = lambda s: [int(i) for i in s.split(b",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            size = np.r_[0, np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))]
            for i, j in blocks(size, PART):
                found, _ = tool.align(col.slice(i, j - i).to_pylist())
                rows = [[dict(zip("ab", map(ids, g.split(b"|")), strict=True)) for g in s.split(b";")] if s else [] for s in found.group_strings()]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
