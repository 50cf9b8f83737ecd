"""The operators of this subpackage over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, decontaminate, jaccard, katz, packing, secrets, suffix, token_counts, toxicity, warc
from .common import table
from .text import WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Classes and numbers of links from pairs p.
_CLASSES = """e AS MATERIALIZED (SELECT {a} AS a, {b} AS b FROM p UNION ALL SELECT {b}, {a} FROM p),
r(id, root) AS (SELECT DISTINCT {id}, {id} FROM {table} UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS {id}, min(root) AS class_id, coalesce(any_value(n), 0) AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) ON a = id GROUP BY 1"""


@_query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets(docs, secrets.train(docs))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=token_counts.VOCABULARY)


@_query
def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


SQL["op5_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT doc_a, doc_b FROM o JOIN s AS x ON x.doc_id = doc_a JOIN s AS y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= 0.5),
{_CLASSES.format(id="doc_id", table="documents", a="doc_a", b="doc_b")}"""


@_query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


SQL["op6_suffix_array_dedup"] = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '{WORD}') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
s AS (SELECT doc_id, r, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50),
p AS (SELECT doc_id, r, s, count(*) OVER (PARTITION BY array_to_string(w[s + 1 : s + 50], ' ')) AS n FROM s),
h AS (SELECT doc_id, r, s, CASE WHEN s <= 50 + lag(s) OVER (PARTITION BY r ORDER BY s) THEN 0 ELSE 1 END AS h FROM p WHERE n > 1),
i AS (SELECT doc_id, r, s, sum(h) OVER (PARTITION BY r ORDER BY s) AS i FROM h)
SELECT doc_id, min(s) AS start, max(s) + 50 AS "end", max(s) + 50 - min(s) AS n_words FROM i GROUP BY doc_id, r, i"""


@_query
def op4_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


@_query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_classes(table(spark, sf_dir, "embeddings"))


SQL["op8_embedding_near_dedup"] = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings AS a JOIN embeddings AS b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
{_CLASSES.format(id="vec_id", table="embeddings", a="id_a", b="id_b")}"""
