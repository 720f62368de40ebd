"""Toxicity classifier: features and learner against plain versions, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from terrasift.llm import flat, ftrl

from .conftest import DOCS, clashing


def sets(texts, piece=None):
    data, offsets = flat.text_buffer(pa.array(texts, pa.string()))
    if piece is None:
        return [set(s.tolist()) for s in ftrl.bucket_sets(data, offsets)]
    out = []
    for i in range(len(texts)):
        own = data[offsets[i] : offsets[i + 1]]
        out.append({b for index, _ in ftrl.buckets(own, np.array([0, len(own)]), piece=piece) for b in index.tolist()})
    return out


def test_a_long_text_in_pieces_has_the_buckets_of_the_whole():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "Cde", "é1f", "x" * 50]) + rng.choice(["", ",", "3"]) for _ in range(400)), "one", "", None, "y" * 900, "a b"]
    assert sets(texts) == sets(texts, piece=64) == [s for t in texts for s in sets([t])]


def test_case_and_signs_do_not_count_but_order_and_gaps_do():
    a, b, c, d, e = sets(["You are great", "you, ARE\n*great*!", "are you great", "you x great", "great"])
    assert a == b and a != c and e < a and a & d > e  # the pair with a gap is shared


def test_updates_are_the_published_ones():
    rates = ftrl.Rates(alpha=0.5, beta=1.0, l1=0.2, l2=0.3)
    state = ftrl.State(rates, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), bits=4)
    z, n = [0.0] * 17, [0.0] * 17
    rng = random.Random(3)
    for _ in range(60):
        at, label = sorted(rng.sample(range(16), 4)), rng.randint(0, 1)
        w = {}
        for i in [*at, 16]:
            l1 = 0.0 if i == 16 else rates.l1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((rates.beta + n[i] ** 0.5) / rates.alpha + rates.l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i, wi in w.items():
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rates.alpha
            z[i] += g - sigma * wi
            n[i] += g * g
        state.learn(np.array(at), label)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["vile", "creep"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(pool) for _ in range(rng.randint(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "vile creep", None, None, None), (0, rows[0][1], None, None, None)]
    labels += [(900, None), (None, 1), (901, 0), (3, 0), (3, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


RATES = ftrl.Rates(l1=1.0, rounds=6)


def test_held_out_documents_are_told_apart(corpus):
    docs, labels, rows = corpus
    got = ftrl.classify(docs, labels, rates=RATES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out for r in held) and sum(r.held_out for r in got if r.doc_id is not None and r.doc_id < 900) == len(held)
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    blank = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(blank) == 1 and blank.pop() < 0.3


def test_partitions_extra_columns_and_held_out_labels_do_not_change_scores(corpus, spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    score = lambda d, k: sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in ftrl.classify(d, k, rates=RATES).collect()))
    want = score(docs, labels)
    turned = labels.withColumn("toxic", F.when(ftrl.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert score(docs.repartition(7), labels.repartition(3)) == want
    assert score(clashing(docs), clashing(turned)) == want


def test_empty_tables_and_no_labels(spark, corpus, no_docs):
    docs, labels, _ = corpus
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in ftrl.classify(docs, none).collect()} == {0.0}
    assert ftrl.classify(no_docs, labels).collect() == []


def test_the_sample_is_bounded_and_by_hash(corpus):
    docs, labels, _ = corpus
    few, all_ = (ftrl.training_rows(docs, labels, bound=b).select("doc_id", "place").collect() for b in (50, 10_000))
    assert len(few) == 50 and {r.doc_id for r in few} == {r.doc_id for r in sorted(all_, key=lambda r: r.place)[:50]}
