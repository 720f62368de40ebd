"""Cases at the edges of number ranges and sizes: whole-number products, long alignments, words without end."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terrasift.llm import balltree, chaining, flat, sptok
from terrasift.llm.queries import tokenizer


def test_top_k_of_products_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(2**18), 2**18)) * 8 + rng.randrange(8) for _ in range(6)]) for i in range(90)]
    rows += [(90 + i, [float(2**21 + i)] * 6) for i in range(10)]  # scores that doubles cannot tell apart
    x = {i: [int(256 * c) for c in v] for i, v in rows}
    want = []
    for q in (i for i in x if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[j], strict=True)), j) for j in x if j != q)[:5]
        want += [(q, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert max(abs(w[3]) for w in want) > 2**53
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, balltree.top_k(table, every=10, shard=16, block=7, pilot=20).collect())) == sorted(want)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_with_and_without_a_limit():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(40))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        d = plain_distance(a.tolist(), b.tolist())
        assert chaining.edit_distance(a, b) == d
        for limit in (0, 1, 3, 8):
            assert chaining.edit_distance(a, b, limit) == min(d, limit + 1)


def test_long_near_copies_are_aligned_in_time():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 40, 200_000).astype(np.uint64)
    b = np.delete(a, np.arange(100, 199_900, 997))
    b[np.arange(7, len(b) - 9, 1009)] = 1
    got = chaining.edit_distance(a, b, 40_000)
    assert 380 < got <= len(a) - len(b) + len(np.arange(7, len(b) - 9, 1009))


def plain_reach(a, i, b, j, n, by):
    good = miss = k = 0
    while k < n and miss < 2:
        miss = 0 if a[i + by * k] == b[j + by * k] else miss + 1
        k += 1
        good = k if miss == 0 else good
    return good


def test_rows_are_extended_and_counted_as_one_by_one():
    rng = random.Random(5)
    rows, want = [], []
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(rng.randint(4, 60))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b))] = 9
        if rng.random() < 0.5:
            del b[rng.randrange(len(b))]
        x0 = rng.randrange(len(a) - 2)
        y0 = rng.randrange(len(b) - 1)
        x1, y1 = rng.randint(x0 + 1, len(a)), rng.randint(y0 + 1, len(b))
        left = plain_reach(a, x0 - 1, b, y0 - 1, min(x0, y0), -1)
        right = plain_reach(a, x1, b, y1, min(len(a) - x1, len(b) - y1), 1)
        c = (x0 - left, x1 + right, y0 - left, y1 + right)
        d = plain_distance(a[c[0] : c[1]], b[c[2] : c[3]])
        rows.append((np.array(a, np.uint64).tobytes(), np.array(b, np.uint64).tobytes(), x0, x1, y0, y1))
        want.append((*c, min(d, max(c[1] - c[0], c[3] - c[2]) * 20 // 100 + 1) if c[1] - c[0] != c[3] - c[2] or d > 2 else d))
    wa, wb, *at = zip(*rows, strict=True)
    got = chaining.align_rows(list(wa), list(wb), *(np.array(v, np.int64) for v in at), 80)
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want


@pytest.fixture(scope="module")
def model():
    return sptok.PieceModel(tokenizer("piece_bpe_32k.model"))


def test_words_are_remembered_and_forgotten(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ["x" * 70_000, "a b a b", "".join(rng.choice("abcé中") for _ in range(3000)), "", "a b"]
    model.seen.limit = 3  # emptied again and again
    for _ in range(2):
        for block in (texts, texts[::-1]):
            data, offsets = flat.text_buffer(pa.array(block))
            ids, counts = model.encode_block(data, offsets)
            assert counts.tolist() == [len(lib.encode(t)) for t in block]
            assert ids.tolist() == [i for t in block for i in lib.encode(t)]
