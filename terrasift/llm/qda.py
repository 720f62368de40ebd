"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of whole texts (shares of character classes, word shapes, repetition) are
variance-stabilised, so short texts stay near the middle. Each class is a Gaussian
whose covariance is shrunk towards the pooled covariance and a multiple of the
identity; a text's score is the logistic of the difference of its Mahalanobis
log-densities, from Cholesky factors computed once.

Statistics are computed once a document. The fit needs only class counts, sums and
sums of products, added up by Spark over all labelled training rows: one row a class
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import SegmentHash, mix, row_sums, text_blocks, word_bounds
from .steps import step

STATS = (
    "log_words", "upper", "digit", "stop", "symbol", "space", "wide",
    "word_len", "word_dev", "short", "long", "distinct", "repeat3", "line_len", "edge_sign", "capital_words",
)


def _class_table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class_table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class_table("0123456789")
_STOP = _class_table(".,;:?")
_SYMBOL = _class_table("!\"#$%&'()*+-/<=>@[\\]^_`{|}~")
_SPACE = _class_table(" \t\n\v\f\r")


#: Pseudo-counts: so many usual characters and words are added to every text.
CHARS, WORDS = 60.0, 12.0


def _share(part: np.ndarray, whole: np.ndarray, usual: float, added: float) -> np.ndarray:
    """Angle of a share after adding pseudo-counts at its usual value: near-constant variance, defined for 0 of 0."""
    return np.arcsin(np.sqrt((part + added * usual) / (whole + added)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(STATS) numbers a text; an empty text has the values of zero counts."""
    size = np.diff(offsets).astype(float)
    chars = lambda t: row_sums(t[data].astype(np.int64), offsets).astype(float)
    start, end, bound = word_bounds(data, offsets)
    length = (end - start).astype(float)
    n = np.diff(bound).astype(float)
    words = lambda v: row_sums(np.asarray(v, np.float64), bound)
    upper, lower, wide = chars(_UPPER), chars(_LOWER), row_sums((data >= 128).astype(np.int64), offsets).astype(float)
    letters = upper + lower + wide
    mean = (words(length) + WORDS * 5.0) / (n + WORDS)
    dev = np.sqrt(np.maximum((words(length**2) + WORDS * 34.0) / (n + WORDS) - mean**2, 0.0))
    h = SegmentHash(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), np.diff(bound))

    def different(keys, rows, bounds):
        """Distinct keys in each row."""
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        fresh = np.ones(len(k), np.int64)
        fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        return row_sums(fresh, bounds).astype(float)

    distinct = different(h, row, bound)
    three = np.zeros(len(n))
    if len(h) > 2:
        inside = np.flatnonzero(row[2:] == row[:-2])
        key = mix(h[inside] * np.uint64(3) + mix(h[inside + 1] * np.uint64(5) + h[inside + 2]))
        three = different(key, row[inside], np.searchsorted(inside, bound))
    triples = np.maximum(n - 2, 0)
    lines = row_sums((data == 10).astype(np.int64), offsets) + 1.0
    last_sign = _SYMBOL[data[end - 1]] if len(end) else np.zeros(0)
    first_upper = _UPPER[data[start]] if len(start) else np.zeros(0)
    of_chars = lambda part, whole, usual: _share(part, whole, usual, CHARS)
    of_words = lambda part, whole, usual: _share(part, whole, usual, WORDS)
    return np.column_stack([
        np.log(n + WORDS), of_chars(upper, letters, 0.03), of_chars(chars(_DIGIT), size, 0.001), of_chars(chars(_STOP), size, 0.03), of_chars(chars(_SYMBOL), size, 0.0005),
        of_chars(chars(_SPACE), size, 0.17), of_chars(wide, letters, 0.02), np.log(mean), np.log1p(dev), of_words(words(length <= 3), n, 0.4), of_words(words(length >= 14), n, 0.03),
        of_words(distinct, n, 0.7), of_words(triples - three, triples, 0.005), np.log((n + WORDS) / (lines + 1.0)), of_words(words(last_sign), n, 0.002), of_words(words(first_upper), n, 0.1),
    ])


def document_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Row-local: the columns named (all but the text by default) and one double for each of STATS."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*STATS, text)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(s, T.DoubleType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
                stats = statistics(data, offsets)
                part = batch.slice(i, j - i)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(np.ascontiguousarray(s)) for s in stats.T]], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    """Two Gaussians: prior log-odds, means, inverse Cholesky factors, log-determinants."""

    log_odds: float
    mean: np.ndarray
    whiten: np.ndarray
    half_log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        gauss = [-0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) - self.half_log_det[k] for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds + gauss[1] - gauss[0], -50, 50)))


def moments(rows: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of STATS by label: one aggregation with map-side sums."""
    d = len(STATS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = F.array(*[F.col(s) for s in STATS])
    sums = [F.sum(F.lit(1.0)).alias("n")] + [F.sum(row[i]).alias(f"s{i}") for i in range(d)] + [F.sum(row[i] * row[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy(label).agg(*sums).collect():
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[int(r[label])] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), second)
    return out


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.3, ridge: float = 0.05) -> Model:
    """The model of the class moments. A class without rows takes the other's Gaussian, so all scores are then equal."""
    d = len(STATS)
    if not found:
        found = {1: (1.0, np.zeros(d), np.eye(d))}
    have = {k: found.get(k) or found[1 - k] for k in (0, 1)}
    mean = np.array([have[k][1] / have[k][0] for k in (0, 1)])
    cov = [have[k][2] / have[k][0] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    n = [have[k][0] for k in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    whiten, half_log_det = [], []
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * both
        c = (1 - ridge) * c + ridge * np.diag(np.maximum(np.diag(both), 1e-6))
        low = np.linalg.cholesky(c + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(low))
        half_log_det.append(np.log(np.diag(low)).sum())
    odds = np.log((found[1][0] if 1 in found else 0.5) / (found[0][0] if 0 in found else 0.5))
    return Model(float(odds), mean, np.array(whiten), np.array(half_log_det))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on the rows of ``stats`` that ``labels`` (doc_id, label) covers.

    A document labelled more than once counts once, with its smallest label; null labels do not count.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("__label"))
    return fit(moments(stats.join(own, "doc_id"), "__label"))


def score(stats: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to rows of statistics; the statistics go."""
    keep = [c for c in stats.columns if c not in (*STATS, out)]
    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(s)).to_numpy() for s in STATS])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.score(x))], names=schema.names)

    return stats.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, as they are, whose text scores ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
                yield batch.slice(i, j - i).filter(pa.array(model.score(statistics(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Null and empty texts are scored like any other."""
    stats = step(document_statistics(docs.select("doc_id", "text")), "quality-statistics")
    model = train(stats.where(~held_out()), labels)
    out = score(stats, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
