"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic transducers, both compiled from the tokenizer's file:

* The *splitter* reads character classes and marks where pre-tokens begin, with a delay
  of at most two characters. A block of texts is cut into chunks; every chunk yields a
  map from each start state to its end state, all chunks and states at once; the maps
  compose through a parallel prefix scan; a second sweep from the now known start
  states emits the marks.
* The *counter* reads the bytes of a pre-token. Each transition carries the change in
  the number of tokens of the prefix read so far. A state keeps what later bytes can
  depend on: the longest suffix that still begins some token and, for every place in
  it, the last token of the prefix that ends there and its count. The last token is
  unique because a token sequence is an encoding exactly when every two neighbours are
  one, so states are found by extending with every token that ends at the new byte.
  States and transitions are built when first met and kept in the worker.

Distinct pre-tokens of a block run through the counter together, one byte a step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import HashCache, OpenTable, SegmentHash, blocks, row_sums

# Splitter. Character classes; END stands after every text and in place of special tokens.
SPACE, BLANK, STMD, R, V, E, LL, LETTER, NUMBER, QUOTE, OTHER, END = range(12)
# States: what has been read of the open pre-token. ONE_*/RUN_*: one or more white spaces, the last a space or not.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, APOS, APOS_R, APOS_V, APOS_L, SUFFIX = range(13)
CHUNK = 256


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by [state, class]. Mark bit k: a pre-token begins k characters back."""
    step, marks = np.zeros((13, 12), np.int32), np.zeros((13, 12), np.uint8)

    def fresh(c):
        if c in (SPACE, BLANK):
            return ONE_SPACE if c == SPACE else ONE_BLANK
        return {NUMBER: DIGITS, QUOTE: APOS, OTHER: SIGNS}.get(c, WORD)

    def solid(c):
        return {NUMBER: DIGITS, QUOTE: SIGNS, OTHER: SIGNS}.get(c, WORD)

    def run(state, c):
        """(next state, marks)"""
        if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
            if c in (SPACE, BLANK):
                return (RUN_SPACE if c == SPACE else RUN_BLANK), 0
            split = 2 * (state in (RUN_SPACE, RUN_BLANK))  # the last white space leaves its run
            return (solid(c), split) if state in (ONE_SPACE, RUN_SPACE) else (fresh(c), split | 1)
        if state in (WORD, DIGITS):
            return (state, 0) if solid(c) == state and c not in (SPACE, BLANK) else (fresh(c), 1)
        if state == SIGNS:
            return (SIGNS, 0) if c in (QUOTE, OTHER) else (fresh(c), 1)
        if state == APOS:
            if c == STMD:
                return SUFFIX, 0
            if c in (R, V, LL):
                return {R: APOS_R, V: APOS_V, LL: APOS_L}[c], 0
            return run(SIGNS, c)
        if state in (APOS_R, APOS_V, APOS_L):
            if c == (LL if state == APOS_L else E):
                return SUFFIX, 0
            then, m = run(WORD, c)  # no suffix after all: the letter began a word
            return then, m | 2
        return fresh(c), 1  # START and after a suffix

    for s in range(13):
        for c in range(12):
            if c == END:
                step[s, c], marks[s, c] = START, 2 * (s in (APOS_R, APOS_V, APOS_L))
            else:
                step[s, c], marks[s, c] = run(s, c)
    return step, marks


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (rows of end states by start state): ``first``, then ``then``."""
    return np.take_along_axis(then, first, axis=-1)


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps in log2(n) rounds."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = compose(maps[:-gap], maps[gap:])
        gap *= 2
    return maps


class Splitter:
    def __init__(self, class_runs: list[tuple[int, int]]):
        self.step, self.marks = splitter()
        self.classes = np.repeat([c for c, _ in class_runs], [n for _, n in class_runs]).astype(np.uint8)

    @staticmethod
    @cache
    def class_runs() -> list[tuple[int, int]]:
        """Classes of all code points as (class, run length), by the tokenizer library's own Unicode tables.

        The driver asks the library once; tasks get the runs, a list of fixed size.
        """
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        out = np.full(0x110000, OTHER, np.uint8)
        for pattern, cls in ((r"\s+", BLANK), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            place = np.array(points)
            for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                out[place[a:b]] = cls
        for chars, cls in ((" ", SPACE), ("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", LL), ("'", QUOTE)):
            for ch in chars:
                out[ord(ch)] = cls
        first = np.flatnonzero(np.r_[True, out[1:] != out[:-1]])
        return list(zip(out[first].tolist(), np.diff(np.r_[first, len(out)]).tolist(), strict=True))

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin; END characters begin none. ``cls`` ends with END."""
        n = len(cls)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        flat_step, flat_marks = self.step.ravel(), self.marks.ravel()
        maps = np.tile(np.arange(13, dtype=np.int32), (rows, 1))
        for column in grid:
            maps = flat_step[maps * 12 + column[:, None]]
        state = np.zeros(rows, np.int32)
        state[1:] = prefix_maps(maps)[:-1, START]
        marks = np.empty((CHUNK, rows), np.uint8)
        for k, column in enumerate(grid):
            at = state * 12 + column
            marks[k] = flat_marks[at]
            state = flat_step[at]
        marks = marks.T.ravel()[:n]
        begins = (marks & 1).astype(bool)
        begins[:-1] |= (marks[1:] & 2).astype(bool)
        return np.flatnonzero(begins)


class Counter:
    """The counting transducer of one BPE vocabulary, built as it is used."""

    # bounds of memory: beyond them all states but those of the strings being read are dropped and built anew
    MAX_STATES, MAX_EDGES = 1 << 18, 1 << 21

    def __init__(self, merges: list[tuple[bytes, bytes]], units: list[bytes]):
        self.tokens = {u: i for i, u in enumerate(units)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank[a, b] = r
            self.tokens.setdefault(a + b, len(self.tokens))
        self.openings = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.seen = HashCache()
        self.reset()

    def reset(self) -> None:
        # a state: (open suffix, ((last token, tokens since) for every place from before it to its end));
        # None where no token can begin. Transitions: state and byte -> next state and change in tokens.
        root = (b"", ((b"", 0),))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.states = [root]
        self.number = {root: 0}
        self.edges, self.n_edges = OpenTable(22), 0

    def encode(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short string: lowest rank first, leftmost among equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, last: bytes, token: bytes) -> bool:
        key = (last, token)
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self.encode(last + token) == [t for t in key if t]
        return ok

    def _edge(self, state: int, byte: int) -> int:
        """The transition as next state << 8 | change + 128; adds the next state if it is new."""
        suffix, places = self.states[state]
        suffix += bytes([byte])
        for k in range(len(places)):  # longest token first
            token = suffix[k:]
            if places[k] and token in self.tokens and self._follows(places[k][0], token):
                delta = 1 - places[k][1]
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        places = [p and suffix[k:] in self.openings and (p[0], p[1] + delta) or None for k, p in enumerate(places)] + [(token, 0)]
        cut = next(k for k, p in enumerate(places) if p)
        new = (suffix[cut:], tuple(places[cut:]))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number << 8 | delta + 128

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each byte string data[start:end]."""
        order = np.argsort(start - end, kind="stable")  # longest first: the open ones stay in front
        at, length = start[order], (end - start)[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k))
            byte = data[at[:n] + k]
            edge = self.edges.get(state[:n] << 8 | byte)
            missing = np.flatnonzero(edge < 0)
            if len(missing):
                if not self._room(len(np.unique(state[missing] << 8 | byte[missing]))):
                    state[:n] = self._carried(state[:n])
                    missing = np.arange(n)
                key = state[:n] << 8 | byte
                new = np.unique(key[missing])
                self.edges.put(new, np.array([self._edge(e >> 8, e & 255) for e in new.tolist()], np.int64))
                self.n_edges += len(new)
                edge[missing] = self.edges.get(key[missing])
            total[:n] += (edge & 255) - 128
            state[:n] = edge >> 8
        out = np.empty_like(total)
        out[order] = total
        return out

    def _room(self, more: int) -> bool:
        return len(self.states) + more <= self.MAX_STATES and self.n_edges + more <= self.MAX_EDGES

    def _carried(self, state: np.ndarray) -> np.ndarray:
        """The numbers of the same states in a fresh table, which has them and the root only.

        States of the strings still open are at most one a string, so what is kept is bounded
        by the block and no string is too long.
        """
        old, inverse = np.unique(state, return_inverse=True)
        kept = [self.states[s] for s in old.tolist()]
        self.reset()
        number = np.empty(len(kept), np.int64)
        for i, s in enumerate(kept):
            if s not in self.number:
                self.number[s] = len(self.states)
                self.states.append(s)
            number[i] = self.number[s]
        return number[inverse]


class TokenCounter:
    """Counts of a byte-level BPE tokenizer (``tokenizers`` JSON: no normaliser, ByteLevel splitting, plain BPE)."""

    def __init__(self, path: str, class_runs: list[tuple[int, int]]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normaliser or prefix space is supported")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must match literally")
        raw = self._byte_chars()
        bytes_of = lambda s: bytes(raw[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.counter = Counter([(bytes_of(a), bytes_of(b)) for a, b in merges], [bytes([i]) for i in range(256)])
        self.splitter = Splitter(class_runs)

    @staticmethod
    def _byte_chars() -> dict[str, int]:
        """Byte-level files write printable Latin-1 bytes as themselves and the rest from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def count_block(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        rows = []
        for i, t in enumerate(texts):
            t = t or ""
            for s in self.special:
                if s in t:
                    extra[i] += t.count(s)
                    t = t.replace(s, "\ud800")  # not a character of any text
            rows.append(t)
        code = np.frombuffer("\ud800".join([*rows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(r) + 1 for r in rows]) - 1
        cls = self.splitter.classes[code]
        cls[code == 0xD800] = END
        start = self.splitter.starts(cls)
        if not len(start):
            return extra
        stops = np.flatnonzero(cls == END)
        end = np.minimum(np.r_[start[1:], len(code)], stops[np.searchsorted(stops, start)])
        hashes, first, inverse = np.unique(SegmentHash(code).of(start, end), return_index=True, return_inverse=True)
        count = self._counts(hashes, code, start[first], end[first])[inverse]
        return extra + row_sums(count, np.searchsorted(start, np.r_[0, ends + 1]))

    def _counts(self, hashes, code, start, end):
        seen = self.counter.seen
        if len(seen.keys) + len(hashes) > seen.limit:
            seen.clear()
        count = seen.get(hashes)
        new = count < 0
        if new.any():
            words = [code[a:b].tobytes().decode("utf-32-le").encode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            bounds = np.r_[0, np.cumsum([len(w) for w in words])]
            count[new] = self.counter.counts(np.frombuffer(b"".join(words), np.uint8), bounds[:-1], bounds[1:])
            self.counter.seen.put(hashes[new], count[new])
        return count


_COUNTERS: dict[str, TokenCounter] = {}


def token_counter(path: str, class_runs: list[tuple[int, int]] | None = None) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, class_runs or Splitter.class_runs())
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of the whole text; null and empty texts have none.

    Special tokens inside a text count as one token each, as the library does by default;
    none is added. Row-local: no shuffle. Other columns pass through; ``out`` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())])
    runs = Splitter.class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path, runs)
        for batch in batches:
            col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            size = np.r_[0, np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))]
            found = [counter.count_block(col.slice(i, j - i).to_pylist()) for i, j in blocks(size, 1 << 20)]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = count_tokens(rows, path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
