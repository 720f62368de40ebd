"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from terrasift.llm import crosstok
from terrasift.llm.queries import tokenizer

from .conftest import DOCS, clashing

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def walk(libraries, text):
    """ids of both, links and groups of one text."""
    first, second = libraries
    raw = crosstok._byte_of_char()
    spell_a = lambda i: bytes(raw[c] for c in first.id_to_token(i))
    spell_b = lambda i: bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    if not text:
        return [], [], [], []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    want = (" " + text).encode()
    if b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
        return [], [], [], []
    owner = [(i, n) for n, i in enumerate(a) for _ in spell_a(i)], [(i, n) for n, i in enumerate(b) for _ in spell_b(i)]
    links = list(dict.fromkeys((x[1], y[1]) for x, y in zip(*owner, strict=True)))
    groups, i, j = [], 0, 0
    end_a, end_b = np.cumsum([len(spell_a(t)) for t in a]).tolist(), np.cumsum([len(spell_b(t)) for t in b]).tolist()
    for cut in sorted(set(end_a) & set(end_b)):
        p, q = end_a.index(cut) + 1, end_b.index(cut) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, [(a[x], b[y]) for x, y in links], groups


def brute_force(libraries, rows):
    found = [(i, *walk(libraries, t)) for i, t in rows]
    count = Counter(p for *_, links, _ in found for p in set(links))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted(((i, len(a), len(b), len(g), len(k), sum(count[p] == highest[p[0]] for p in k), sum(count[p] for p in k), digest(g)) for i, a, b, k, g in found), key=repr)


def by_rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_measures_are_those_of_the_plain_walk(spark, libraries, hard_docs, hard_texts, no_docs):
    want = brute_force(libraries, hard_texts)
    for docs in (hard_docs, clashing(hard_docs)):
        assert by_rows(crosstok.align(docs, A, B)) == want
    assert crosstok.align(no_docs, A, B).collect() == []


def test_copies_of_one_text_null_ids_and_texts_beyond_a_block(spark, libraries):
    long = " ".join(f"w{k % 977}" for k in range(600_000))  # 2.7 MB: a part, and with the block below a block, of its own
    rows = [(100 + k, "a shared text of many copies") for k in range(300)] + [(None, "a shared text of many copies"), (None, None), (7, "▁ mark"), (8, "another text"), (9, "x" * 70_000), (10, long)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)
    got = by_rows(crosstok.align(docs, A, B))
    short = [r for r in rows if r[0] != 10 and r[0] != 9]
    # the long texts share no pair with the others
    assert [r for r in got if r[0] not in (9, 10)] == brute_force(libraries, short)
    first, second = libraries
    whole = next(r for r in got if r[0] == 10)
    assert whole[1:3] == (len(first.encode(" " + long).ids), len(second.encode(long))) and whole[4] == whole[1] + whole[2] - whole[3]
    assert next(r for r in got if r[0] == 7)[1:] == (0, 0, 0, 0, 0, 0, "")


def test_blocks_of_any_size_give_the_same(spark, libraries, hard_texts):
    tool = crosstok.aligner(A, B)
    texts = [t for _, t in hard_texts if t]
    whole, _ = tool.align(texts)
    parts = [tool.align([t])[0] for t in texts]
    assert whole.group_strings() == [p.group_strings()[0] for p in parts]
    assert whole.n_links.tolist() == [int(p.n_links[0]) for p in parts]


def test_alignment_itself(spark, libraries):
    docs = spark.createDataFrame([(1, "Unbelievable naïve 中文 text", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, alignment int")
    out = {r.doc_id: r.alignment for r in crosstok.token_alignments(docs, A, B).collect()}
    groups = walk(libraries, "Unbelievable naïve 中文 text")[3]
    assert [(list(g.a), list(g.b)) for g in out[1]] == groups and out[2] == [] and out[3] == []


def test_numbers_pack_and_unpack():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**40, 2**55, 5], np.int64)
    data, width = crosstok.pack(values)
    assert crosstok.unpack(data).tolist() == values.tolist() and int(width.sum()) == len(data)
    assert crosstok.unpack(np.zeros(0, np.uint8)).tolist() == []
