"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import balltree, chaining, charpoly, crosstok, egojoin, ftrl, mixing, pii, qda, sptok, sufdedup, tgm, tokcount
from .steps import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(table(spark, sf, "documents"))


def op2_passages(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf, "documents"))


def op3_embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return egojoin.near_duplicates(table(spark, sf, "embeddings"))


def op6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return balltree.top_k(table(spark, sf, "embeddings"))


def op4_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents"))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokcount.report(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return sufdedup.report(table(spark, sf, "documents"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return qda.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return tgm.join_classes(table(spark, sf, "documents"))


def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sptok.digests(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Null, empty and differently spelt texts have zeros and an empty digest; copies and repeated rows each count."""
    return crosstok.align(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Null and empty texts have the score of the intercept; repeated rows are all scored."""
    return ftrl.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are null or hold null or non-finite entries have no rows; repeated rows are all returned."""
    return charpoly.whiten(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_passages": op2_passages,
    "op3_embedding_duplicates": op3_embedding_duplicates,
    "op4_mix": op4_mix,
    "op5_token_counts": op5_token_counts,
    "op6_top_k": op6_top_k,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op3_embedding_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e)>0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(e, lambda x: x<>0))>0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label=b.label AND len(a.e)=len(b.e) AND a.vec_id<>b.vec_id WHERE list_cosine_similarity(a.e, b.e)>=0.93),
 walk(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a=w.b)
 SELECT a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(b) AS component_id, a=min(b) AS kept FROM walk LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) USING (a) GROUP BY a, n""",
    "op6_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256*x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON len(v.x)=len(q.x) AND v.vec_id<>q.vec_id WHERE q.vec_id%50=0)
 SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank<=5""",
    "op9_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x<>'') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) END AS s FROM w),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t=b.t AND a.doc_id<>b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100*count(*)>=80*(a.n+b.n-count(*))),
 walk(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a=w.b)
 SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN walk ON a=s.doc_id GROUP BY s.doc_id, s.s""",
}
