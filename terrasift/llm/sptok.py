"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a block of texts lie in one flat symbol array. Each round finds
the best pair of every word with a segmented minimum, merges its leftmost
non-overlapping occurrences in all words at once, and compacts the array, until no
word holds a pair that the vocabulary knows. Words are independent because no piece
holds a word mark after another character; the constructor checks that.

Pieces may tie in score, and a merge may open a pair that is as good as the one just
taken. The library then takes the leftmost or the new pair first, so a word in which
that could happen merges only its leftmost occurrence in that round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import HashCache, OpenTable, SegmentHash, ragged_take, row_sums, text_blocks

MARK = "▁"
_NONE = np.int64(1 << 40)
_PLAIN, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values of the model format


class PieceModel:
    """A SentencePiece BPE model (identity normaliser, dummy prefix, byte fallback) as numpy tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a dummy prefix and escaped spaces is supported")
        if train.model_type != 2 or not train.byte_fallback or {p.type for p in model.pieces} - {_PLAIN, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE with byte fallback and plain pieces is supported")
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _PLAIN}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("pieces with an inner word mark are not supported")
        self.size = len(model.pieces)
        self.eos = next(i for i, p in enumerate(model.pieces) if p.type == _CONTROL and p.piece == "</s>")
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        # characters that occur in pieces without being pieces get ids after the vocabulary
        symbols = dict(plain)
        for p in plain:
            for ch in p:
                symbols.setdefault(ch, self.size + len(symbols) - len(plain))
        self.n_symbols = self.size + len(symbols) - len(plain)
        levels = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in plain.values()}, reverse=True))}
        keys, merged = [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    keys.append(symbols[p[:k]] << 32 | symbols[p[k:]])
                    merged.append(i)
        self.pairs = OpenTable((len(keys) * 8).bit_length())
        self.pairs.put(np.array(keys, np.int64), np.array([levels[model.pieces[i].score] << 32 | i for i in merged], np.int64))
        single = {ord(s): i for s, i in symbols.items() if len(s) == 1}
        self.char_id = np.full(0x110000, -1, np.int32)
        self.char_id[list(single)] = list(single.values())
        self.char_id[32] = self.char_id[ord(MARK)]
        # what a symbol decodes to: bytes of pieces, raw bytes, nothing for control pieces
        texts = []
        for p in model.pieces:
            texts.append({_PLAIN: p.piece.replace(MARK, " ").encode(), _BYTE: bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"", _CONTROL: b""}.get(p.type, b" \xe2\x81\x87 "))
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.seen = HashCache()
        self._forget()

    def _forget(self) -> None:
        self.seen.clear()
        self.ids = np.zeros(0, np.int32)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a remembered word: where its ids begin, how many

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair of symbols makes; _NONE where there is none."""
        value = self.pairs.get(left << 32 | right)
        return np.where(value < 0, _NONE, value >> 32), value & 0xFFFFFFFF

    def merge_words(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words; ``word`` ascends."""
        done_s, done_w = [], []
        rank, made = self._ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            open_ = best < _NONE
            if not open_.all():
                keep = np.repeat(open_, length)
                done_s.append(sym[~keep])
                done_w.append(word[~keep])
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                best, length = best[open_], length[open_]
                if not len(sym):
                    break
            best_of = np.repeat(best, length)
            pick = self._leftmost(np.flatnonzero(rank == best_of))
            pick = self._safe(pick, sym, word, rank, made)
            sym[pick] = made[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = place[pick]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            self._ranks_at(np.flatnonzero(touched), sym, word, rank, made)
        if not done_s:
            return sym, word
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _ranks(self, sym, word):
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        self._ranks_at(np.arange(len(sym)), sym, word, rank, made)
        return rank, made

    def _ranks_at(self, at, sym, word, rank, made):
        rank[at] = _NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        rank[at], made[at] = self.pair(sym[at], sym[at + 1])

    @staticmethod
    def _leftmost(pick: np.ndarray) -> np.ndarray:
        """Every second of each run of neighbouring pairs, from the left: pairs that share a symbol exclude each other."""
        if len(pick) < 2:
            return pick
        opens = np.r_[True, np.diff(pick) > 1]
        run_first = np.flatnonzero(opens)
        place = np.arange(len(pick)) - run_first[np.cumsum(opens) - 1]
        return pick[place % 2 == 0]

    def _safe(self, pick, sym, word, rank, made):
        """Leaves only the leftmost pick of a word where merging it opens a pair at least as good."""
        w = word[pick]
        opens = np.r_[True, w[1:] != w[:-1]]
        group = np.cumsum(opens) - 1
        several = np.bincount(group)[group] > 1
        if not several.any():
            return pick
        p = pick[several]
        new, level = made[p], rank[p]
        left = np.where((p > 0) & (word[np.maximum(p - 1, 0)] == word[p]), p - 1, -1)
        joined = np.zeros(len(sym), bool)
        joined[pick] = True
        left_sym = np.where(left > 0, np.where(joined[np.maximum(left - 1, 0)] & (word[np.maximum(left - 1, 0)] == word[p]), made[np.maximum(left - 1, 0)], sym[np.maximum(left, 0)]), sym[np.maximum(left, 0)])
        right = np.minimum(p + 2, len(sym) - 1)
        has_right = (p + 2 < len(sym)) & (word[right] == word[p])
        bad = (left >= 0) & (self.pair(left_sym, new)[0] <= level)
        bad |= has_right & (self.pair(new, sym[right])[0] <= level)
        if not bad.any():
            return pick
        bad_groups = np.zeros(group[-1] + 1, bool)
        bad_groups[group[several][bad]] = True
        return pick[opens | ~bad_groups[group]]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in one flat array, and how many each text has; without an end id."""
        texts = bytes(data)
        if b"\xe2\x96\x81" in texts:  # a literal mark and an escaped space are the same symbol
            rows = [texts[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data = np.frombuffer(b"".join(rows), np.uint8)
            offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
        filled = np.diff(offsets) > 0
        if not filled.any():
            return np.zeros(0, np.int64), np.zeros(len(filled), np.int64)
        data = np.insert(data, offsets[:-1][filled], 32)  # the dummy prefix
        offsets = np.r_[0, np.cumsum(np.diff(offsets) + filled)]
        space = data == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][filled]] = True
        start = np.flatnonzero(opens)
        end = np.r_[start[1:], len(data)]
        hashes, first, inverse = np.unique(SegmentHash(data).of(start, end), return_index=True, return_inverse=True)
        word = self._remember(hashes, data, start[first], end[first])[inverse]
        per_word = self.count[word]
        return ragged_take(self.ids, self.at[word], per_word), row_sums(per_word, np.searchsorted(start, offsets))

    def _remember(self, hashes, data, start, end):
        """The number of each distinct word among those remembered; words may have any number of symbols."""
        if len(self.seen.keys) + len(hashes) > self.seen.limit or len(self.ids) > 16 * self.seen.limit:
            self._forget()
        word = self.seen.get(hashes)
        new = word < 0
        if new.any():
            ids, count = self._encode_words(data, start[new], end[new])
            word[new] = len(self.at) + np.arange(len(count))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.seen.put(hashes[new], word[new])
        return word

    def _encode_words(self, data, start, end):
        length = end - start
        flat = ragged_take(data, start, length)
        word_of_byte = np.repeat(np.arange(len(start)), length)
        lead = (flat & 0xC0) != 0x80
        word = word_of_byte[lead]
        code = np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char_id[code].astype(np.int64)
        strange = sym < 0
        sym[strange] = self.n_symbols + code[strange]
        sym, word = self.merge_words(sym, word)
        # symbols without a piece fall back to the bytes of their character
        raw = sym >= self.size
        if raw.any():
            known = {int(i): c for c, i in enumerate(self.char_id) if i >= self.size} if self.n_symbols > self.size else {}
            chars = [chr(known[s]) if s < self.n_symbols else chr(s - self.n_symbols) for s in sym[raw].tolist()]
            coded = [c.encode("utf-8", "surrogatepass") for c in chars]
            width = np.ones(len(sym), np.int64)
            width[raw] = [len(c) for c in coded]
            spot = np.repeat(raw, width)
            out = np.repeat(sym, width)
            out[spot] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
            sym, word = out, np.repeat(word, width)
        return sym, np.bincount(word, minlength=len(start))

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; the dummy prefix goes, bytes that are not UTF-8 become U+FFFD."""
        flat = ragged_take(self.text, self.text_at[ids], self.text_len[ids]).tobytes()
        bound = np.r_[0, np.cumsum(row_sums(self.text_len[ids], np.r_[0, np.cumsum(counts)]))]
        rows = (flat[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True))
        return [(r[1:] if r[:1] == b" " else r).decode("utf-8", "replace") for r in rows]


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, eos: bool = True) -> DataFrame:
    """Adds ``ids`` (array<int>) and, where ``decoded`` names a column, the text decoded from those ids.

    Row-local: no shuffle, whole texts, null and empty texts give the end id alone (or
    nothing without ``eos``). Columns of these names in the input are replaced; all
    others pass through. ``path`` must name the model on every machine.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    fields = [docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            for i, j, data, offsets in text_blocks(col):
                flat, counts = model.encode_block(data, offsets)
                back = model.decode_block(flat, counts) if decoded else None
                if eos:
                    flat = np.insert(flat, np.cumsum(counts), model.eos)
                    counts = counts + 1
                out = batch.slice(i, j - i)
                arrays = [out.column(out.schema.get_field_index(c)) for c in keep]
                arrays.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(flat.astype(np.int32))))
                if decoded:
                    arrays.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text`` decoded from ``ids`` (null ids: null text). Ids outside the vocabulary raise."""
    keep = [c for c in rows.columns if c != text]
    fields = [rows.schema[c] for c in keep] + [T.StructField(text, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            flat = np.array([x for r in lists for x in (r or [])], np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= model.size):
                raise ValueError("an id lies outside the vocabulary")
            back = model.decode_block(flat, np.array([len(r or []) for r in lists], np.int64)) if lists else []
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([None if r is None else t for r, t in zip(lists, back, strict=True)], pa.string())], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
