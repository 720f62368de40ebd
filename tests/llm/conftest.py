import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def _words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """(doc_id, text): null, empty, blank, long, copies, near copies, shared passages, repeated ids, odd characters."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    base = _words(rng, 120, pool)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 50, 90)]
    shared = _words(rng, 70, pool)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "a b c d"), (7, base), (8, base), (9, base.upper()),
        *[(10 + i, t) for i, t in enumerate(near)],
        (13, _words(rng, 40, pool) + "\n" + shared + " " + _words(rng, 30, pool)), (14, _words(rng, 60, pool) + " " + shared), (15, shared + " " + _words(rng, 200, pool)),
        (16, _words(rng, 3000, pool)), (17, "x" * 5000), (18, "ab " * 400), (19, "ab " * 300), (20, "é中文🙂 " * 30 + "tail"), (20, "another text of a repeated id"), (21, base), (21, base),
        (22, "mail a.b@c.de or +1 (555) 010-9999 at 10.0.0.1 card 4111 1111 1111 1111"), (23, "it's 'll <|endoftext|> x▁y  z   "), (24, "\u0000 ퟿ ￿"),
    ]
    return rows + [(100 + i, _words(rng, rng.randint(1, 150), pool)) for i in range(40)]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    rows = [(i, t, "en", [None, "s1", "s2", "S"][k % 4], len(t or "")) for k, (i, t) in enumerate(hard_texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("?") for c in ("unit", "size", "block", "score", "ids", "pii", "tokens", "start", "anchor", "component", "a", "b", "n", "text_key", "spans", "label2")})
