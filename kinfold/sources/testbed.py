"""Entities, snapshots and reviews derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One row for each entity: base rows from embeddings and part, and perturbed copies.
ENT = """
SELECT CONCAT('a', LPAD(CAST(k AS STRING), 7, '0')) AS id, 'src1' AS src, CONCAT(p_name, ' ', CAST(k AS STRING)) AS name, CONCAT('e', CAST(k % 211 AS STRING), '@mail', CAST(k % 13 AS STRING), '.example.org') AS email,
  CONCAT('555-', CAST(k % 97 AS STRING)) AS phone, n_name AS city, r_name AS state, CASE WHEN k % 7 = 0 THEN t ELSE CONCAT(t, '-', CAST(p_size % 5 AS STRING)) END AS code, vec
FROM base
UNION ALL
SELECT CONCAT('b', LPAD(CAST(k AS STRING), 7, '0')), 'src2', CASE WHEN k % 9 = 0 THEN CONCAT(p_name, ' ', CAST(k + 1 AS STRING)) WHEN k % 4 = 0 THEN CONCAT(p_name, ' ', CAST(k AS STRING), ' center') ELSE CONCAT(p_name, ' ', CAST(k AS STRING)) END,
  CASE WHEN k % 2 = 0 THEN CONCAT('e', CAST(k % 211 AS STRING), '@mail', CAST(k % 13 AS STRING), '.example.org') ELSE CONCAT('x', CAST(k AS STRING), '@mail', CAST(k % 13 AS STRING), '.example.org') END,
  CASE WHEN k % 3 = 0 THEN CONCAT('555-', CAST(k % 97 AS STRING)) ELSE CONCAT('777-', CAST(k AS STRING)) END, CASE WHEN k % 5 = 0 THEN 'elsewhere' ELSE n_name END, r_name,
  CASE WHEN k % 11 = 0 THEN 'zz-9' WHEN k % 7 = 0 THEN t ELSE CONCAT(t, '-', CAST(p_size % 5 AS STRING)) END, {moved}
FROM base WHERE k % 3 <> 1
UNION ALL
SELECT CONCAT('c', LPAD(CAST(k AS STRING), 7, '0')), 'src3', CONCAT(p_name, ' ', CAST(k AS STRING)), CONCAT('e', CAST(k % 211 AS STRING), '@mail', CAST(k % 13 AS STRING), '.example.org'), CONCAT('555-', CAST(k % 97 AS STRING)), n_name, r_name,
  CASE WHEN k % 7 = 0 THEN t ELSE CONCAT(t, '-', CAST(p_size % 5 AS STRING)) END, vec
FROM base WHERE k % 6 = 0"""

BASE = """
SELECT v.vec_id AS k, p.p_name, p.p_size, LOWER(SUBSTR(p.p_type, 1, 2)) AS t, LOWER(n.n_name) AS n_name, LOWER(r.r_name) AS r_name, v.embedding AS vec
FROM embeddings v JOIN part p ON p.p_partkey = v.vec_id % (SELECT COUNT(*) FROM part)
JOIN (SELECT l_partkey, MIN(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) m ON m.l_partkey = p.p_partkey
JOIN supplier s ON s.s_suppkey = m.s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""

#: Pairs that pass the gate, with what the signals of a service need: for DuckDB only.
PAIRS = """
SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS sim, a.name AS na, b.name AS nb, a.email = b.email AS same_email, a.phone = b.phone AS same_phone, a.city = b.city AND a.state = b.state AS same_place,
  split_part(a.email, '@', 2) = split_part(b.email, '@', 2) AS same_host,
  CASE WHEN a.code = b.code THEN 1.0 ELSE 0.7 END AS tax, CASE WHEN length(a.code) <= length(b.code) THEN a.code ELSE b.code END AS tax_value,
  a.email AS ea, b.email AS eb, a.phone AS pa, b.phone AS pb, a.code AS ca, b.code AS cb, replace(a.city, '_', ' ') || ', ' || replace(a.state, '_', ' ') AS la, replace(b.city, '_', ' ') || ', ' || replace(b.state, '_', ' ') AS lb
FROM ent a JOIN ent b ON a.id < b.id
WHERE (a.code = b.code OR (strpos(a.code, '-') = 0 AND split_part(b.code, '-', 1) = a.code) OR (strpos(b.code, '-') = 0 AND split_part(a.code, '-', 1) = b.code))
  AND (a.email = b.email OR a.phone = b.phone OR (a.city = b.city AND a.state = b.state)) AND list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= 0.75"""

WITH = f"WITH base AS MATERIALIZED ({BASE}), ent AS MATERIALIZED ({ENT.format(moved='list_transform(vec, lambda x: CAST(x + 0.02 AS FLOAT))')})"
WITH_PAIRS = f"{WITH}, pairs AS MATERIALIZED ({PAIRS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """query over those of the driver's tables that it names in braces."""
    return spark.sql(query, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in query})


def flat_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = BASE
    for t in ("embeddings", "part", "lineitem", "supplier", "nation", "region"):
        base = base.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return sql(spark, sf_dir, f"WITH base AS ({base}) {ENT.format(moved='transform(vec, x -> CAST(x + 0.02 AS FLOAT))')}")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entities in the input contract."""
    e = flat_entities(spark, sf_dir)
    null = F.lit(None).cast("string")
    place = F.array(F.struct(null.alias("address_1"), F.col("city").alias("city"), F.col("state").alias("state"), null.alias("postal_code"), null.alias("location_type")))
    return e.select(
        F.col("id").alias("entity_id"), F.col("src").alias("source_schema"), "name", F.array("email").alias("emails"), F.array("phone").alias("phones"), place.alias("locations"),
        F.array(F.struct(F.col("code").alias("code"), null.alias("name"))).alias("taxonomies"), F.col("vec").cast("array<double>").alias("embedding_vector"),
    )
