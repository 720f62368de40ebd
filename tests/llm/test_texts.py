"""Row-local operators against the libraries or plain brute force."""

import hashlib
import re

import pytest

from terrasift.llm import pii, qda, sptok, tokcount
from terrasift.llm.queries import tokenizer

from .conftest import clashing


def by_rows(df, *cols):
    return sorted((tuple(r) for r in df.select("doc_id", *cols).collect()), key=repr)


def test_token_counts_are_the_librarys(hard_docs, hard_texts, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted([(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in hard_texts], key=repr)
    for docs in (hard_docs, clashing(hard_docs)):
        assert by_rows(tokcount.report(docs, path), "n_bytes", "n_tokens", "over_limit") == want
    assert tokcount.report(no_docs, path).collect() == []


def test_counter_rebuilds_its_states_within_its_bound():
    path = tokenizer("byte_bpe_50k.json")
    counter = tokcount.TokenCounter(path, tokcount.Splitter.class_runs())
    texts = ["the cat sat on mats", "unbelievably long wording", "zzzz qqqq ####"]
    want = counter.count_block(texts).tolist()
    counter.counter.MAX_STATES = 40
    counter.counter.seen.clear()
    counter.counter.reset()
    assert counter.count_block(texts).tolist() == want


def test_one_word_needs_more_states_than_the_bound():
    import random

    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(rng.choice("abcdefghiklmnoprstuvwé中") for _ in range(150)), "cat", "".join(rng.choice("etaoin") for _ in range(60)), "mat"]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    for states, edges in ((40, 1 << 21), (1 << 18, 40), (3, 3)):
        counter = tokcount.TokenCounter(path, tokcount.Splitter.class_runs())
        counter.counter.MAX_STATES, counter.counter.MAX_EDGES = states, edges
        assert counter.count_block(texts).tolist() == want
        counter.counter.seen.clear()
        assert [int(counter.count_block([t])[0]) for t in texts] == want  # a full table and one word more


def test_split_maps_compose_to_the_serial_run():
    import numpy as np

    step, _ = tokcount.splitter()
    cls = np.random.default_rng(1).integers(0, 12, 40)
    maps = tokcount.prefix_maps(step[:, cls].T)
    for s in range(13):
        at = s
        for k, c in enumerate(cls):
            at = step[at, c]
            assert maps[k, s] == at


def test_pieces_round_trip_as_the_library(spark, hard_docs, hard_texts, no_docs):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in hard_texts:
        ids = [*lib.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    for docs in (hard_docs, clashing(hard_docs)):
        assert by_rows(sptok.digests(docs, path), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert sptok.digests(no_docs, path).collect() == []
    odd = spark.createDataFrame([(1, [5, 300, 2, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in sptok.decode(odd, path).collect()}
    assert got == {1: lib.decode([5, 300, 2, 0]), 2: None, 3: ""}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m.group())]


def test_base_spans_are_those_of_the_patterns(hard_docs, hard_texts, no_docs):
    want = []
    for i, t in hard_texts:
        spans = base_spans(t or "")
        want.append((i, *[sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    for docs in (hard_docs, clashing(hard_docs)):
        assert by_rows(pii.digests(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert pii.digests(no_docs).collect() == []


@pytest.mark.parametrize("text", ["a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.999.1.1.1", "4111-1111 1111-1111 0", "+1+12345678 9)", "a@b..c", "٣٤@x.y", "300.1.1.1.1.1.1.1", "00000255.0.0.1"])
def test_overlapping_candidates(text):
    assert [s for s in pii.PiiFinder().spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_added_kinds_and_redaction():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, see https://a.b/c?d. Acct no 12345678, SSN 123-45-6789, u@v.w"
    spans = pii.PiiFinder().spans(text)
    assert [s[0] for s in spans] == ["email", "url", "iban", "ssn", "account"]
    assert pii.redacted(text, spans) == "IBAN: [IBAN], see [URL]. Acct no [ACCOUNT], SSN [SSN], [EMAIL]"


def test_iban_before_a_capital_word():
    for text, want in (
        ("IBAN: DE89370400440532013000 BIC: COBADEFFXXX", "IBAN: [IBAN] BIC: COBADEFFXXX"),
        ("IBAN GB29 NWBK 6016 1331 9268 19 SWIFT NWBKGB2L", "IBAN [IBAN] SWIFT NWBKGB2L"),
        ("IBAN DE89370400440532013001 BIC X", "IBAN DE89370400440532013001 BIC X"),
    ):
        assert pii.redacted(text, [s for s in pii.PiiFinder().spans(text) if s[0] == "iban"]) == want


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = qda.classify(docs, labels).join(labels, "doc_id").where("held_out").groupBy("quality", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    assert n.get((1, 1), 0) >= 0.99 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, 0), 0) >= 0.95 * sum(v for k, v in n.items() if k[0] == 0)


def test_quality_of_odd_input(spark, hard_docs, hard_texts, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (13, 0), (None, 1), (14, None)], "doc_id long, quality int")
    rows = qda.classify(clashing(hard_docs), labels).collect()
    assert len(rows) == len(hard_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len(qda.classify(hard_docs, labels.limit(0)).collect()) == len(hard_texts)
    assert qda.classify(no_docs, labels).collect() == []


def test_scores_are_gaussian_log_density_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    d = len(qda.STATS)
    x = {k: rng.normal(k, 1 + k, (500, d)) for k in (0, 1)}
    model = qda.fit({k: (500.0, v.sum(0), v.T @ v) for k, v in x.items()}, pooled=0.0, ridge=0.0)
    cov = {k: np.cov(v.T, bias=True) + 1e-9 * np.eye(d) for k, v in x.items()}

    def density(k, p):
        diff = p - x[k].mean(0)
        return -0.5 * diff @ np.linalg.solve(cov[k], diff) - 0.5 * np.linalg.slogdet(cov[k])[1]

    p = rng.normal(0.5, 0.2, (20, d))
    want = [1 / (1 + np.exp(-np.clip(density(1, q) - density(0, q), -50, 50))) for q in p]
    assert np.allclose(model.score(p), want, atol=1e-6)
