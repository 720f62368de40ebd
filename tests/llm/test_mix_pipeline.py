"""Mixing, and the pipeline against a plain version of its stages."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from terrasift.llm import mixing
from terrasift.llm.steps import step, table

from .conftest import clashing
from .test_joins import jaccard_want
from .test_texts import base_spans


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 10, 280], [3, 2, 1], 3) == pytest.approx([30, 30, 240])
    assert mixing.targets([0, 5], [1, 1], 3) == pytest.approx([0, 5])
    assert mixing.targets([], [], 3) == []


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 11).tolist()) == list(range(n))
    assert mixing.permute(np.arange(50), 50, 1).tolist() != mixing.permute(np.arange(50), 50, 2).tolist()


def test_shard_draws_add_up_and_repeat():
    quota = np.array([1000, 0, 37, 5000], np.int64)
    shards = -(-int(quota.sum()) // 100)
    draws = [mixing.shard_draw(k, shards, 100, quota, 3) for k in range(shards)]
    run = np.zeros(4, np.int64)
    for k, (before, count) in enumerate(draws):
        assert before.tolist() == run.tolist() and count.sum() == min(100, quota.sum() - 100 * k)
        run = run + count
    assert run.tolist() == quota.tolist()
    big = mixing.split(np.array([3_000_000_000, 1_000_000_001], np.int64), 2_000_000_000, np.random.default_rng(1))
    assert big.sum() == 2_000_000_000


def test_taken_words(hard_docs, hard_texts, no_docs):
    rows = mixing.taken(clashing(hard_docs), block=4, per_shard=64).collect()
    again = mixing.taken(hard_docs.repartition(5), block=4, per_shard=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert len(rows) == len(hard_texts)
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in hard_texts)
    per = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source_size"], r["target"]] += r["taken"]
    assert sum(t for _, t in per) == pytest.approx(sum(r["size"] for r in rows))
    for (_, target), got in per.items():
        assert abs(got - target) <= 8
    assert mixing.taken(no_docs).collect() == []


def test_mixed_documents_hold_the_taken_words(hard_docs, no_docs):
    want = Counter()
    for r in mixing.taken(hard_docs, block=4, per_shard=64).collect():
        want[r["doc_id"]] += r["taken"]
    wide = clashing(hard_docs)
    out = mixing.mixed_documents(wide, block=4, per_shard=64)
    assert out.schema == wide.schema
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["unit"] == "?"
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed_documents(no_docs).collect() == []


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(step(stage(spark, kept[-1], sf), "test"))
        if name != "tokens":
            assert kept[-1].columns == docs.columns
    rows = [sorted((r.asDict() for r in k.collect()), key=lambda r: (r["doc_id"], r["text"])) for k in kept]
    # quality: labelled clean documents stay, labelled junk goes; rows are untouched
    stay = {r["doc_id"] for r in rows[1]}
    assert all(r in rows[0] for r in rows[1])
    assert sum(q == 1 and i not in stay for i, q in labels.items()) <= 1 and sum(q == 0 and i in stay for i, q in labels.items()) <= 1
    # near duplicates: the smallest id of each group
    assert [r["doc_id"] for r in rows[2]] == sorted({c for _, _, c in jaccard_want([(r["doc_id"], r["text"]) for r in rows[1]])})
    # personal data: none left, other text as it was
    assert len(rows[3]) == len(rows[2]) and not any(base_spans(r["text"]) for r in rows[3])
    for a, b in zip(rows[2], rows[3], strict=True):
        text = a["text"]
        for _, x, y in sorted(base_spans(text), key=lambda s: -s[1]):
            assert text[x:y] not in b["text"] or text.count(text[x:y]) > 1
        assert base_spans(text) or a == b
        assert b["n_chars"] == len(b["text"])
    # mixing: words come from the document, in order; no document above three times its words
    words = {r["doc_id"]: r["text"].split() for r in rows[3]}
    out = Counter()
    for r in rows[4]:
        it = iter(words[r["doc_id"]])
        assert all(w in it for w in r["text"].split())
        out[r["doc_id"]] += len(r["text"].split())
    assert all(n <= 3 * len(words[i]) for i, n in out.items())
    # tokens
    import sentencepiece

    from terrasift.llm.queries import tokenizer

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert len(rows[5]) == len(rows[4]) and all(r["ids"] == [*lib.encode(r["text"]), 2] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows[5])
    # run() is the stages in turn
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(r["doc_id"], r["text"]) for r in rows[5]]


def test_pipeline_on_odd_rows(spark, hard_docs):
    sf = "/root/testdata/sf0.001"
    docs = hard_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = step(stage(spark, docs, sf), "test")
    assert docs.count() > 0
