"""Operators on pairs of rows against brute force."""

import hashlib
import random

import numpy as np
import pytest

from terrasift.llm import balltree, chaining, components, egojoin, sufdedup, tgm

from .conftest import clashing


def smallest_reachable(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_want(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = smallest_reachable(len(rows), links)
    low = {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, 1 << 60), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[comp[i]]) for i in range(len(rows)))


def test_jaccard_classes(hard_docs, hard_texts, no_docs):
    want = jaccard_want(hard_texts)
    assert sorted(map(tuple, tgm.join_classes(clashing(hard_docs)).collect())) == want
    assert tgm.join_classes(no_docs).collect() == []


def test_jaccard_at_the_threshold_and_across_groups(spark):
    """Families of near copies with sizes around 4/5, groups smaller than the families."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([9, 12, 24, 60, 130]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            cut = rng.randint(0, len(w) // 4)
            rows.append((len(rows), " ".join(w[: len(w) - cut])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, tgm.join_classes(docs, group_size=3).collect())) == jaccard_want(rows)


def test_opening_a_pair_of_groups():
    sets = [np.arange(0, 50, dtype=np.uint64), np.arange(100, 150, dtype=np.uint64), np.arange(2, 52, dtype=np.uint64)]
    go = lambda side, which, part: [x.tolist() for x in tgm.open_group(np.array(side), np.array(which), np.array(part), [sets[i] for i in which], 80)]
    assert go([0, 1], [0, 1], [0, 1]) == [[], []]  # the union bound
    assert go([0, 1], [0, 2], [0, 2]) == [[2], [0]]
    assert go([0, 1], [0, 2], [7, 7]) == [[], []]  # one component already
    assert go([2, 2, 2], [0, 1, 2], [0, 1, 2]) == [[2], [0]]  # a group with itself


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500)]
    want = smallest_reachable(600, edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for bounded in (0, 40, 1 << 20):  # all in star rounds, some, none
        got = {r["node"]: r["component"] for r in components.components(table, bounded).collect()}
        assert got == {i: c for i, c in enumerate(want) if c != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


VEC = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = [base[i % 12] + rng.normal(size=16) * (0.05 + 0.1 * (i % 4)) for i in range(240)]
    rows = [(i, [float(np.float32(v)) for v in x[i]], [0, 0, 0, 1, None][i % 5], "?") for i in range(240)]
    rows += [(400 + i, rows[0][1], 0, "?") for i in range(30)]
    nan = float("nan")
    rows += [(500, None, 0, "?"), (501, [], 0, "?"), (502, [0.0] * 16, 0, "?"), (503, [1.0, None], 0, "?"), (504, [nan] * 16, 0, "?"), (505, [float("inf")] + [0.0] * 15, 0, "?"), (506, [1.0, 2.0], 0, "?"), (507, [2.0, 4.0], 0, "?"), (0, rows[0][1], 0, "?"), (508, rows[3][1], None, "?")]
    return rows


def test_embedding_links(spark, vectors):
    fit = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab, _ in vectors]
    cos = lambda a, b: float(np.dot(a, b)) / (float(np.linalg.norm(a)) * float(np.linalg.norm(b)))
    links = [(i, j) for i in range(len(vectors)) for j in range(len(vectors)) if i != j and fit[i] and fit[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]) and cos(vectors[i][1], vectors[j][1]) >= 0.93]
    comp = smallest_reachable(len(vectors), links)
    low, n = {}, [0] * len(vectors)
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, 1 << 60), vectors[i][0])
    for i, _ in links:
        n[i] += 1
    want = sorted((v[0], n[i], low[comp[i]], low[comp[i]] == v[0]) for i, v in enumerate(vectors))
    rows = spark.createDataFrame(vectors, VEC).repartition(3)
    got = egojoin.near_duplicates(rows, block=8)
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert sum(n) > 500
    assert egojoin.near_duplicates(rows.limit(0)).collect() == []


def test_top_k(spark, vectors):
    rows = [r for r in vectors if r[0] != 0 or r is vectors[0]]
    q = {v[0]: [int(np.floor(256 * float(c))) for c in v[1]] for v in rows if v[1] and all(c is not None and np.isfinite(c) for c in v[1])}
    want = []
    for i in q:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    table = spark.createDataFrame(rows, VEC).repartition(3)
    got = balltree.top_k(table, every=10, shard=40, block=7, pilot=20)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert balltree.top_k(table.limit(0)).collect() == []


def test_suffix_order_by_columns():
    rng = random.Random(1)
    for _ in range(60):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        which, start, lcp = sufdedup.build_order(np.frombuffer("".join(strings).encode(), np.uint8), np.r_[0, np.cumsum([len(s) for s in strings])])
        found = [strings[i][j:] for i, j in zip(which, start, strict=True)]
        assert found == sorted(strings[i][j:] for i in range(len(strings)) for j in range(len(strings[i]) + 1))
        for t in range(1, len(found)):
            n = 0
            while n < min(len(found[t]), len(found[t - 1])) and found[t][n] == found[t - 1][n]:
                n += 1
            assert lcp[t] == n


def test_removed_bytes(hard_docs, hard_texts, no_docs):
    rows = [(i, (t or "").encode()) for i, t in hard_texts]
    first = {}
    for i, t in rows:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], 1 << 60), i)
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    assert sum(w[2] for w in want) > 2000
    for docs in (hard_docs, clashing(hard_docs)):
        assert sorted(map(tuple, sufdedup.report(docs).collect())) == sorted(want)
    assert sufdedup.report(no_docs).collect() == []


def test_passages(hard_docs, hard_texts, no_docs):
    got = {}
    for r in chaining.repeated_passages(clashing(hard_docs)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    one = {i: rs[0] for i, rs in got.items()}
    assert sum(map(len, got.values())) == len(hard_texts)
    words = {i: (t or "").lower().split() for i, t in hard_texts}
    for i in (8, 9, 10, 11, 12, 14, 15, 19):  # copies, case copies, near copies, shared passages, periodic texts
        assert one[i]["n_passages"] > 0 and one[i]["component_id"] < i, i
    for i in (1, 2, 3, 4, 5, 6, 7, 13, 16, 17, 22, *range(100, 140)):
        assert one[i]["n_passages"] == 0, i
    assert one[14]["component_id"] == 13 and one[15]["component_id"] == 13
    for i in (14, 15):
        p = one[i]["passages"][0]
        assert p["end"] - p["start"] >= 60 and words[i][p["start"] : p["end"]] == words[p["ref_doc_id"]][p["ref_start"] : p["ref_end"]] and p["edits"] == 0
    assert chaining.repeated_passages(no_docs).collect() == []


def test_passages_behind_overlapping_fragments(spark):
    rng = random.Random(11)
    fresh = iter(range(10**6))
    junk = lambda n: [f"j{next(fresh)}" for _ in range(n)]
    shared, other, third = ([f"{c}{i}" for i in range(n)] for c, n in (("s", 60), ("o", 60), ("t", 33)))
    docs = {}
    for i in range(0, 60, 4):  # pieces under 30 words before, between
        docs[i] = junk(9) + shared[i : i + 26] + junk(9)
        docs[200 + i] = junk(7) + shared[max(0, i - 5) : i + 20] + junk(9)
    docs[100] = junk(40) + shared + junk(20)
    docs[300] = junk(11) + shared + junk(5)
    # the earlier document holds the seeds singly before it holds them in a row
    docs[110] = [w for i in range(0, 60, 3) for w in other[i : i + 14] + junk(30)] + other
    docs[310] = junk(12) + other + junk(12)
    # a stretch of little more than 30 words beside a short common one
    docs[120], docs[320] = other[:12] + junk(15) + third, other[:12] + junk(22) + third + junk(3)
    for i in range(400, 430):  # pieces of any length of a common text
        a = rng.randrange(60)
        docs[i] = junk(8) + (shared + other)[a : a + rng.randint(12, 50)] + junk(8)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in chaining.repeated_passages(df).collect()}
    want, seen = {}, {}
    for d in sorted(docs):
        w = docs[d]
        want[d] = [s for s in range(len(w) - 29) if tuple(w[s : s + 30]) in seen]
        for s in range(len(w) - 29):
            seen.setdefault(tuple(w[s : s + 30]), d)
    assert want[300] and want[310] and want[320] and sum(map(len, want.values())) > 200
    for d in docs:
        held = {i for p in got[d]["passages"] for i in range(p["start"], p["end"])}
        missing = [s for s in want[d] if not held.issuperset(range(s, s + 30))]
        assert not missing, (d, missing)
        for p in got[d]["passages"]:
            if p["edits"] == 0:
                assert docs[d][p["start"] : p["end"]] == docs[p["ref_doc_id"]][p["ref_start"] : p["ref_end"]]
        if not want[d] and d < 400:
            assert got[d]["n_passages"] == 0, d
    assert (300, 100, 60) in {(300, p["ref_doc_id"], p["end"] - p["start"]) for p in got[300]["passages"]}


def test_changed_passages_behind_overlapping_fragments(spark):
    """No 30 words in a row are equal, and every seed has other holders before and between the two documents."""
    fresh = iter(range(10**6))
    junk = lambda n: [f"j{next(fresh)}" for _ in range(n)]
    shared = [f"s{i}" for i in range(60)]
    docs = {}
    for i in range(0, 60, 4):  # pieces under 30 words before, between
        docs[i] = junk(9) + shared[i : i + 26] + junk(9)
        docs[200 + i] = junk(7) + shared[max(0, i - 5) : i + 20] + junk(9)
    docs[100] = junk(40) + shared + junk(20)
    docs[300] = junk(11) + [f"c{i}" if i % 12 == 10 else w for i, w in enumerate(shared)] + junk(5)
    # a line of 11 words that many hold, alone or twice, links nobody
    line = [f"l{i}" for i in range(11)]
    for i in range(400, 420):
        docs[i] = junk(20) + line + junk(20) + (line if i % 5 == 0 else [])
    # the earlier document holds the phrase in other places, too
    third = [f"t{i}" for i in range(40)]
    docs[500] = [w for i in range(0, 40, 3) for w in third[i : i + 11] + junk(30)] + third + junk(9)
    docs[510] = junk(12) + [f"d{i}" if i % 13 == 9 else w for i, w in enumerate(third)] + junk(12)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in chaining.repeated_passages(df).collect()}
    for d, ref, n in ((300, 100, 60), (510, 500, 40)):
        assert got[d]["component_id"] == ref
        assert any(p["ref_doc_id"] == ref and p["end"] - p["start"] >= n - 4 and 0 < p["edits"] <= 5 for p in got[d]["passages"]), got[d]
    for d in docs:
        assert d in (300, 510) or got[d]["n_passages"] == 0 and got[d]["component_id"] == d, d


def test_places_of_a_seed_against_all_shifts():
    assert chaining.periods([3, 4, 5, 6, 20, 22, 24, 90], 6) == [[3, 4, 5, 6], [20, 22, 24], [90]]
    assert chaining.place_matches([1, 50], [7, 90], 6) == {(1, 7), (1, 90), (50, 7), (50, 90)}
    got = chaining.place_matches(list(range(10, 40)), [2, 3, 4], 6)
    assert got == {(10, 2), (11, 3), (12, 4), (37, 2), (38, 3), (39, 4)}


def test_chains_against_all_predecessors():
    rng = random.Random(7)
    for _ in range(60):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))}, key=lambda p: (p[1], -p[0]))
        x, y = [p[0] for p in points], [p[1] for p in points]
        best = []
        for i in range(len(x)):
            before = [best[j] - chaining.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(1 + max([0.0, *before]))
        chains = chaining.chain(x, y)
        assert sorted(i for c in chains for i in c) == list(range(len(x)))
        top = chains[0]
        score = len(top) - chaining.GAP_COST * (x[top[-1]] - x[top[0]] + y[top[-1]] - y[top[0]])
        assert abs(score - max(best)) < 1e-9


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(50):
        a, b = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        row = list(range(len(b) + 1))
        for i, u in enumerate(a, 1):
            new = [i]
            for j, v in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
            row = new
        assert chaining.edit_distance(np.array(a), np.array(b)) == row[-1]
