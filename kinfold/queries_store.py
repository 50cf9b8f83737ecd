"""Queries of the training store, of what a run leaves for reviewers, and of directory tables; rows are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features
from .operators import persist, training
from .registry import query
from .sources import directory
from .sources.testbed import TABLES, sql
from .storage import written

_s = lambda x: f"CAST({x} AS STRING)"
_d = lambda x: f"CAST({x} AS DOUBLE)"

FLATS = {
    "scores": f"""SELECT CONCAT('s', {_s('doc_id')}) AS score_id, CONCAT('p', {_s('doc_id')}) AS pair_id, CONCAT('run', {_s('doc_id % 5')}) AS run_id, CONCAT('t', {_s('doc_id % 2')}) AS team_id, CASE WHEN doc_id % 11 = 0 THEN 'organization' ELSE 'service' END AS entity_type,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic = 1 END AS is_duplicate, {_d('doc_id * 37 % 101')} / 202 AS deterministic_section_score, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE {_d('doc_id * 53 % 97')} / 194 END AS nlp_section_score, {_d('doc_id * 29 % 89')} / 89 AS confidence_score,
  {_d('doc_id * 13 % 83')} / 83 AS embedding_similarity, doc_id % 3 = 0 AS predicted_duplicate, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id * 7919 % 10007 END AS reviewed_at, doc_id * 31 % 1009 AS created_at FROM labels""",
    "pairs": f"SELECT CONCAT('p', {_s('doc_id')}) AS pair_id, CONCAT('e', {_s('doc_id % 60')}) AS entity_a_id, CONCAT('e', {_s('(doc_id * 7 + 1) % 60')}) AS entity_b_id FROM labels WHERE doc_id % 17 <> 0",
    "runs": f"SELECT DISTINCT CONCAT('run', {_s('doc_id % 5')}) AS run_id, CONCAT('job', {_s('doc_id % 5')}) AS job_name, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE {_d('0.82')} END AS duplicate_threshold, {_d('0.68')} AS maybe_threshold, CASE WHEN doc_id % 5 = 3 THEN {_d('0')} ELSE {_d('0.45')} END AS weight_deterministic_section, CASE WHEN doc_id % 5 = 3 THEN {_d('0')} ELSE {_d('0.35')} END AS weight_nlp_section FROM labels",
    "mitigated": f"SELECT CONCAT('p', {_s('doc_id')}) AS pair_id, CONCAT('run', {_s('doc_id % 5')}) AS run_id, 'low_evidence_override' AS mitigation_reason FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT CONCAT('p', {_s('doc_id')}), CONCAT('run', {_s('doc_id % 5')}), 'entity_deleted' FROM labels WHERE doc_id % 6 = 0",
    "cache": f"SELECT DISTINCT CONCAT('e', {_s('doc_id % 50')}) AS entity_id, CONCAT('h', {_s('doc_id % 50 % 9')}) AS content_hash, CONCAT('name ', {_s('doc_id % 50')}) AS name FROM documents",
    "known": f"SELECT CONCAT('s', {_s('doc_id')}) AS source_score_id, CONCAT('old', {_s('doc_id')}) AS training_pair_id FROM labels WHERE doc_id % 10 = 1",
    "reasons": f"SELECT CONCAT('s', {_s('doc_id')}) AS score_id, 'shared_phone' AS match_type, {_s('doc_id % 8')} AS matched_value, {_d('doc_id % 4')} / 4 AS raw_contribution FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT CONCAT('s', {_s('doc_id')}), 'shared_email', {_s('doc_id % 9')}, 0.5 FROM labels WHERE doc_id % 3 = 0",
    "reviews": f"SELECT {_s('event_id')} AS review_id, {_s('user_id % 400')} AS training_pair_id, CASE event_id % 11 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'UNSURE' WHEN 2 THEN NULL ELSE CASE WHEN user_id % 3 = 0 OR event_id % 5 > 0 THEN 'TRUE_DUPLICATE' ELSE 'FALSE_POSITIVE' END END AS review_decision, CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE NULL END AS reviewer_confidence, event_id % 9 = 0 AND user_id % 5 <> 0 AS is_active, event_id % 97 AS reviewed_at FROM events",
}


def flat(spark: SparkSession, d: str, name: str) -> DataFrame:
    q = FLATS[name]
    for t in TABLES:
        q = q.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql(spark, d, q)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({FLATS[n]})" for n in names)


# reviewed pairs


def _reviewed(spark, d, **options):
    return training.reviewed_pairs(*(flat(spark, d, n) for n in ("scores", "pairs", "runs", "mitigated", "cache", "known")), entity_type="service", **options)


def _reviewed_sql(where: str = "TRUE", latest: bool = True) -> str:
    run = "run_id = (SELECT run_id FROM latest)" if latest else "TRUE"
    return _with("scores", "pairs", "runs", "mitigated", "cache", "known") + f""", rs AS (SELECT * FROM scores WHERE entity_type = 'service' AND is_duplicate IS NOT NULL AND {where}),
latest AS (SELECT run_id FROM rs GROUP BY 1 ORDER BY max(coalesce(reviewed_at, created_at)) DESC, run_id DESC LIMIT 1), m AS (SELECT pair_id, run_id, max(mitigation_reason) AS mitigation_reason FROM mitigated GROUP BY ALL),
v AS MATERIALIZED (SELECT rs.*, entity_a_id, entity_b_id, least(entity_a_id, entity_b_id) || '|' || greatest(entity_a_id, entity_b_id) AS pair_canonical_key, job_name, duplicate_threshold, maybe_threshold, weight_deterministic_section, weight_nlp_section, mitigation_reason IS NOT NULL AS was_mitigated, mitigation_reason,
  a.content_hash AS hash_a, b.content_hash AS hash_b, a.name AS name_a, b.name AS name_b, training_pair_id AS existing_training_pair_id
  FROM rs JOIN pairs USING (pair_id) JOIN runs USING (run_id) LEFT JOIN m USING (pair_id, run_id) JOIN cache a ON a.entity_id = entity_a_id JOIN cache b ON b.entity_id = entity_b_id LEFT JOIN known ON source_score_id = score_id WHERE {run})"""


_REVIEWED = "score_id, run_id, team_id, is_duplicate, entity_a_id, entity_b_id, pair_canonical_key, job_name, was_mitigated, mitigation_reason, {}, existing_training_pair_id"


@query(_reviewed_sql() + " SELECT " + _REVIEWED.format("hash_a, hash_b, name_a, name_b") + " FROM v")
def reviewed_pairs(spark, d):
    return _reviewed(spark, d).selectExpr(*_REVIEWED.format("entity_a.content_hash AS hash_a, entity_b.content_hash AS hash_b, entity_a.name AS name_a, entity_b.name AS name_b").split(", "))


@query(_reviewed_sql("team_id = 't1'", latest=False) + " SELECT score_id, run_id, pair_canonical_key FROM v")
def reviewed_pairs_of_team(spark, d):
    return _reviewed(spark, d, team_id="t1", run_selection="all").select("score_id", "run_id", "pair_canonical_key")


@query(_with("mitigated") + " SELECT pair_id, run_id, max(mitigation_reason) AS mitigation_reason FROM mitigated GROUP BY ALL")
def mitigation_max(spark, d):
    return flat(spark, d, "mitigated").groupBy("pair_id", "run_id").agg(F.max("mitigation_reason").alias("mitigation_reason"))


@query(_with("scores", "reasons") + """ SELECT score_id, coalesce(string_agg(match_type || ':' || matched_value || ':' || raw_contribution, ',' ORDER BY match_type), '') AS signals, count(match_type) AS n FROM scores LEFT JOIN reasons USING (score_id) GROUP BY 1""")
def pair_reasons_list(spark, d):
    out = training.pipeline_signals(flat(spark, d, "scores"), flat(spark, d, "reasons"))
    return out.select("score_id", F.array_join(F.transform("pipeline_signals", lambda x: F.concat_ws(":", x["match_type"], x["matched_value"], x["raw_contribution"].cast("string"))), ",").alias("signals"), F.size("pipeline_signals").cast("long").alias("n"))


_BASE = "CASE WHEN weight_deterministic_section + weight_nlp_section > 0 THEN (deterministic_section_score + coalesce(nlp_section_score, 0)) / (weight_deterministic_section + weight_nlp_section) ELSE 0 END"


@query(_reviewed_sql(latest=False) + f""", t AS (SELECT *, {_BASE} AS base FROM v WHERE existing_training_pair_id IS NULL)
SELECT sha256('training_pair|' || score_id) AS training_pair_id, sha256(entity_a_id || '|' || hash_a) AS entity_a_snapshot_id, sha256(entity_b_id || '|' || hash_b) AS entity_b_snapshot_id, job_name AS scope_id, round(base, 9) AS baseline_confidence_score,
base >= coalesce(duplicate_threshold, 1) AS baseline_predicted_duplicate, base >= maybe_threshold AS baseline_predicted_maybe, confidence_score >= maybe_threshold AS predicted_maybe, round(coalesce(nlp_section_score, 0), 9) AS nlp_section_score, was_mitigated,
CASE WHEN base >= coalesce(duplicate_threshold, 1) THEN 'duplicate' WHEN base >= maybe_threshold THEN 'maybe' ELSE 'below_maybe' END AS baseline_score_band FROM t""")
def training_pairs(spark, d):
    t = training.training_pairs(_reviewed(spark, d, run_selection="all"))
    return t.select("training_pair_id", "entity_a_snapshot_id", "entity_b_snapshot_id", "scope_id", F.round("baseline_confidence_score", 9).alias("baseline_confidence_score"), "baseline_predicted_duplicate", "baseline_predicted_maybe", "predicted_maybe", F.round("nlp_section_score", 9).alias("nlp_section_score"), "was_mitigated", "baseline_score_band")


@query(_reviewed_sql(latest=False) + """, e AS (SELECT entity_a_id AS id, hash_a AS h, name_a AS name, run_id FROM v UNION ALL SELECT entity_b_id, hash_b, name_b, run_id FROM v)
SELECT sha256(id || '|' || h) AS snapshot_id, id AS entity_id, h AS content_hash, any_value(name) AS name, min(run_id) AS source_run_id FROM e WHERE (id, h) NOT IN (SELECT entity_id, content_hash FROM cache WHERE entity_id < 'e2') GROUP BY id, h""")
def entity_snapshots(spark, d):
    return training.snapshots(_reviewed(spark, d, run_selection="all"), flat(spark, d, "cache").where("entity_id < 'e2'")).select("snapshot_id", "entity_id", "content_hash", "name", "source_run_id")


@query(_reviewed_sql(latest=False) + f""", t AS (SELECT *, {_BASE} AS base FROM v WHERE existing_training_pair_id IS NULL)
SELECT sha256(sha256('training_pair|' || score_id) || '|{features.FEATURE_VERSION}') AS pair_feature_id, run_id AS source_run_id, round(base, 9) AS baseline_confidence_score, CASE WHEN hash_a = hash_b THEN 1.0 ELSE 0.0 END::DOUBLE AS same_hash FROM t WHERE score_id NOT LIKE '%7'""")
def feature_rows(spark, d):
    """Features of training pairs; those of scores that end in 7 are there already."""
    r = written(_reviewed(spark, d, run_selection="all"))
    t = training.training_pairs(r)
    f = r.groupBy(F.col("pair_canonical_key").alias("pair_key")).agg(F.max(F.when(F.col("entity_a.content_hash") == F.col("entity_b.content_hash"), 1.0).otherwise(0.0)).alias("same_hash"))
    store = t.where(F.col("source_score_id").like("%7")).select("training_pair_id", F.lit(features.FEATURE_VERSION).alias("feature_schema_version"))
    out = training.feature_rows(t, f, "service", features.FEATURE_VERSION, store)
    return out.select("pair_feature_id", "source_run_id", F.round("baseline_confidence_score", 9).alias("baseline_confidence_score"), "same_hash")


# labels


@query(_with("reviews") + """, o AS (SELECT * FROM reviews WHERE is_active AND review_decision NOT IN ('SKIP', 'UNSURE') AND reviewer_confidence IN ('MEDIUM', 'HIGH'))
SELECT training_pair_id, min(review_decision) AS label, CASE WHEN count(*) = 1 THEN 'SINGLE_REVIEW' ELSE 'CONSENSUS' END AS label_source, CASE WHEN count(*) = 1 THEN min(review_id) END AS review_id FROM o GROUP BY 1 HAVING count(DISTINCT review_decision) = 1""")
def resolved_labels(spark, d):
    return training.resolved_labels(flat(spark, d, "reviews"), "MEDIUM")


@query(_with("reviews") + " SELECT training_pair_id, review_id, review_decision FROM reviews WHERE is_active QUALIFY row_number() OVER (PARTITION BY training_pair_id ORDER BY reviewed_at DESC, review_id DESC) = 1")
def active_labels(spark, d):
    return training.active_labels(flat(spark, d, "reviews")).select("training_pair_id", "review_id", "review_decision")


@query(_with("reviews") + " SELECT training_pair_id, array_to_string(list_sort(list_distinct(list(review_decision))), '|') AS decisions, count(*) AS n_reviews FROM reviews WHERE is_active AND review_decision IS NOT NULL GROUP BY 1 HAVING count(DISTINCT review_decision) > 1")
def review_disagreements(spark, d):
    return training.disagreements(flat(spark, d, "reviews")).select("training_pair_id", F.array_join("decisions", "|").alias("decisions"), "n_reviews")


@query(_with("reviews") + " SELECT DISTINCT training_pair_id FROM reviews WHERE training_pair_id NOT IN (SELECT training_pair_id FROM reviews WHERE is_active)")
def unlabeled_pairs(spark, d):
    r = flat(spark, d, "reviews")
    return training.unlabeled(r.select("training_pair_id").distinct().withColumn("baseline_confidence_score", F.lit(0.5)), r).select("training_pair_id")


# what a run leaves

_RUN = persist.Run("run1", "t1", "service", "job", "2024-01-01")
_KEY = "entity_a_id || '__' || entity_b_id"


def _artifacts(spark, d):
    """Artifacts of a run over the derived pairs, every key once."""
    key = F.concat_ws("__", "entity_a_id", "entity_b_id")
    s = flat(spark, d, "scores").join(flat(spark, d, "pairs"), "pair_id").withColumn("pair_key", key)
    first = s.groupBy("pair_key").agg(F.min_by(F.struct(*[c for c in s.columns if c != "pair_key"]), "score_id").alias("x")).select("pair_key", "x.*")
    empty = ("legacy_confidence_score", "shadow_confidence_score", "shadow_log_odds", "ml_section_score")
    own = written(first.withColumn("final_score", F.col("confidence_score")).withColumns({c: F.lit(None).cast("double") for c in empty}).withColumns({c: F.lit(None).cast("string") for c in ("calibration_version", "source_schema_a", "source_schema_b")}))
    r = flat(spark, d, "reasons").join(own.select("score_id", "pair_key"), "score_id").select("pair_key", "match_type", "matched_value", F.col("matched_value").alias("entity_a_value"), F.lit(None).cast("string").alias("entity_b_value"), "raw_contribution", F.col("raw_contribution").alias("weighted_contribution"), F.lit(1.0).alias("signal_weight"), F.lit(None).cast("double").alias("similarity_score"))
    m = own.where(F.col("predicted_duplicate") & (F.col("confidence_score") < 0.3)).select("pair_key", F.lit("low_evidence_override").alias("mitigation_reason"), F.struct("embedding_similarity").alias("evidence"))
    cluster = F.concat(F.lit("c"), F.substring_index("pair_key", "__", 1))
    cp = own.where("confidence_score > 0.5").select("pair_key", cluster.alias("cluster_id"), (F.col("confidence_score") > 0.8).alias("is_reviewed"), F.lit(None).cast("boolean").alias("review_decision"), F.col("confidence_score").alias("assignment_score"), F.lit("x").alias("assignment_method"))
    zero = ("avg_confidence_score", "max_confidence_score", "min_confidence_score", "objective_score", "positive_edge_sum", "negative_edge_penalty", "cluster_risk_score")
    c = cp.groupBy("cluster_id").agg(F.count("*").alias("pair_count")).select("cluster_id", F.lit("service").alias("entity_type"), F.lit(2).cast("long").alias("cluster_size"), "pair_count", *[F.lit(0.0).alias(z) for z in zero], F.lit("x").alias("algorithm_version"))
    return {"finalized_pairs": own, "pair_reasons": r, "mitigation_events": m, "clusters": c, "cluster_pairs": cp}


_FIRST = _with("scores", "pairs", "reasons") + f""", s AS MATERIALIZED (SELECT {_KEY} AS k, *, sha256('pair|' || entity_type || '|' || {_KEY}) AS pid, sha256('score|run1|t1|' || entity_type || '|' || {_KEY}) AS sid FROM scores JOIN pairs USING (pair_id) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY score_id) = 1),
r AS MATERIALIZED (SELECT sha256('reason|' || sid || '|' || match_type || '|' || matched_value || '|' || matched_value || '|') AS id, sid, pid, k, match_type FROM reasons JOIN s USING (score_id))"""


@query(_FIRST + " SELECT id, sid AS duplicate_pair_score_id, pid AS duplicate_pair_id, match_type FROM r")
def reason_ids(spark, d):
    return persist.artifact_frames(_artifacts(spark, d), _RUN)["duplicate_reasons"].select("id", "duplicate_pair_score_id", "duplicate_pair_id", "match_type")


@query(_FIRST + """ SELECT 'duplicate_pairs' AS name, count(*) AS n, count(DISTINCT pid) AS n_ids, 9::BIGINT AS n_columns FROM s UNION ALL SELECT 'duplicate_pair_scores', count(*), count(DISTINCT sid), 22 FROM s UNION ALL SELECT 'duplicate_reasons', count(*), count(DISTINCT id), 14 FROM r
UNION ALL SELECT 'mitigated_pairs', count(*), count(*), 7 FROM s WHERE predicted_duplicate AND confidence_score < 0.3 UNION ALL SELECT 'duplicate_clusters', count(DISTINCT entity_a_id), count(DISTINCT entity_a_id), 22 FROM s WHERE confidence_score > 0.5
UNION ALL SELECT 'duplicate_cluster_pairs', count(*), count(*), 10 FROM s WHERE confidence_score > 0.5""")
def artifact_frames(spark, d):
    made = persist.artifact_frames(_artifacts(spark, d), _RUN)
    rows = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.lit(len(df.columns)).cast("long").alias("n_columns")) for n, df in made.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


@query(_FIRST + """ SELECT count(*) AS total_pairs, count(is_duplicate) AS reviewed_pairs FROM s WHERE entity_type = 'service' AND predicted_duplicate AND NOT (confidence_score < 0.3)""")
def review_progress(spark, d):
    a = _artifacts(spark, d)
    made = persist.artifact_frames(a, _RUN)
    decided = a["finalized_pairs"].select(persist.score_id(_RUN).alias("id"), "is_duplicate")
    scores = made["duplicate_pair_scores"].drop("is_duplicate").join(decided, "id")
    return persist.review_progress(persist.review_view(scores, made["duplicate_pairs"], made["mitigated_pairs"], _RUN))


@query(_FIRST + """, gone AS (SELECT pid FROM s WHERE score_id LIKE '%3'), p AS (SELECT *, CASE WHEN confidence_score > 0.5 THEN 'c' || entity_a_id END AS c FROM s WHERE pid NOT IN (FROM gone))
SELECT 'pairs' AS name, count(*) AS n, NULL::DOUBLE AS average FROM p UNION ALL SELECT 'reasons', count(*), NULL FROM r WHERE pid NOT IN (FROM gone) UNION ALL
SELECT 'cluster ' || c, count(*), round(avg(confidence_score), 9) FROM p WHERE c IS NOT NULL GROUP BY c UNION ALL SELECT 'reviewed', count(*) FILTER (confidence_score > 0.8), NULL FROM p WHERE c IS NOT NULL""")
def clean_up(spark, d):
    """Tables after pairs of scores that end in 3 have been removed."""
    a = _artifacts(spark, d)
    gone = a["finalized_pairs"].where(F.col("score_id").like("%3")).select("pair_key", "entity_type")
    made = persist.artifact_frames(a, _RUN)
    names = a["clusters"].select(persist.stable_id(F.lit("cluster"), F.lit("run1"), "cluster_id").alias("id"), "cluster_id")
    t = persist.clean_up(made, gone, _RUN)
    none = F.lit(None).cast("double").alias("average")
    rows = t["duplicate_pairs"].agg(F.lit("pairs").alias("name"), F.count("*").alias("n"), none).unionByName(t["duplicate_reasons"].agg(F.lit("reasons").alias("name"), F.count("*").alias("n"), none))
    clusters = t["duplicate_clusters"].join(names, "id")
    rows = rows.unionByName(clusters.select(F.concat(F.lit("cluster "), "cluster_id").alias("name"), F.col("pair_count").alias("n"), F.round("avg_confidence_score", 9).alias("average")))
    return rows.unionByName(clusters.agg(F.lit("reviewed").alias("name"), F.coalesce(F.sum("reviewed_pair_count"), F.lit(0)).alias("n"), none))


@query(_with("scores") + " SELECT score_id, CASE WHEN score_id LIKE '%4' THEN 'new' ELSE 'old' END AS v, is_duplicate FROM scores WHERE score_id NOT LIKE '%5' UNION ALL SELECT score_id, 'new', NULL FROM scores WHERE score_id LIKE '%5'")
def merged_scores(spark, d):
    """An upsert that keeps the decisions of the store."""
    s = flat(spark, d, "scores")
    store = s.where(~F.col("score_id").like("%5")).select("score_id", F.lit("old").alias("v"), "is_duplicate")
    rows = s.where(F.col("score_id").like("%4") | F.col("score_id").like("%5")).select("score_id", F.lit("new").alias("v"), F.lit(None).cast("boolean").alias("is_duplicate"))
    return persist.merge(store, rows, ["score_id"], ("is_duplicate",))


# directories


def _t(spark, d, q):
    for t in TABLES:
        q = q.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return sql(spark, d, q)


_PATHS = (
    f"SELECT c_custkey AS owner, CONCAT(' 555-', {_s('c_custkey % 7')}) AS number FROM customer",
    f"SELECT o_custkey AS owner, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CONCAT('555-', {_s('o_orderkey % 9')}) END AS number FROM orders",
    f"SELECT o_custkey AS owner, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE CONCAT('777-', {_s('l_linenumber')}) END AS number FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 3",
)


@query("SELECT owner, string_agg(DISTINCT trim(number), ',' ORDER BY trim(number)) AS phones FROM (" + " UNION ALL ".join(_PATHS) + ") WHERE trim(coalesce(number, '')) <> '' GROUP BY 1")
def rollup_phones(spark, d):
    return directory.phones("owner", *(_t(spark, d, p) for p in _PATHS)).select("owner", F.array_join("phones", ",").alias("phones"))


_PLACES = f"SELECT s_suppkey AS location_id, CASE WHEN s_suppkey % 4 = 0 THEN 'north' ELSE {_s('s_suppkey % 50')} END AS latitude, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '-8.5' END AS longitude, 'physical' AS location_type FROM supplier"
_ADDRESSES = "SELECT s_suppkey AS location_id, s_name AS address_1, n_name AS city, CAST(NULL AS STRING) AS state, '60601' AS postal_code FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0"
_AT = "SELECT l_partkey AS owner, l_suppkey AS location_id FROM lineitem"


@query(f"""WITH p AS ({_PLACES}), a AS ({_ADDRESSES}), l AS (SELECT DISTINCT * FROM ({_AT})) SELECT owner, string_agg(location_id || ':' || coalesce(address_1, '') || ':' || coalesce(city, '') || ':' || coalesce(round(try_cast(latitude AS DOUBLE), 1)::VARCHAR, '') || ':' || coalesce(longitude, ''), ',' ORDER BY location_id) AS locations
FROM l JOIN p USING (location_id) LEFT JOIN a USING (location_id) GROUP BY 1""")
def rollup_locations(spark, d):
    out = directory.locations(_t(spark, d, _PLACES), _t(spark, d, _ADDRESSES), "owner", _t(spark, d, _AT))
    shown = F.transform("locations", lambda x: F.concat_ws(":", x["location_id"].cast("string"), *[F.coalesce(x[c].cast("string"), F.lit("")) for c in ("address_1", "city", "latitude", "longitude")]))
    return out.select("owner", F.array_join(shown, ",").alias("locations"))


_LINKS = "SELECT l_orderkey AS owner, l_partkey AS taxonomy_id FROM lineitem"
_TERMS = f"SELECT p_partkey AS taxonomy_id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CONCAT('BD-', {_s('p_partkey % 40')}) END AS code, {_s('p_partkey % 40')} AS name FROM part"


@query(f"WITH l AS ({_LINKS}), t AS ({_TERMS}) SELECT owner, string_agg(DISTINCT lower(code), ',' ORDER BY lower(code)) AS codes FROM l JOIN t USING (taxonomy_id) WHERE code <> '' GROUP BY 1")
def rollup_taxonomies(spark, d):
    return directory.taxonomies(_t(spark, d, _LINKS), _t(spark, d, _TERMS), "owner").select("owner", F.array_join(F.transform("taxonomies", lambda x: x["code"]), ",").alias("codes"))


_OWN = f"SELECT o_custkey AS owner, o_orderkey AS service_id, CONCAT('service ', {_s('o_orderkey')}) AS name FROM orders"


@query(f"""WITH l AS ({_LINKS}), t AS ({_TERMS}), c AS (SELECT owner AS service_id, string_agg(DISTINCT lower(code), '+' ORDER BY lower(code)) AS codes FROM l JOIN t USING (taxonomy_id) WHERE code <> '' GROUP BY 1), o AS ({_OWN})
SELECT owner, string_agg(service_id || ':' || name || ':' || coalesce(codes, ''), ',' ORDER BY service_id) AS services FROM o LEFT JOIN c USING (service_id) GROUP BY 1""")
def rollup_services(spark, d):
    codes = directory.taxonomies(_t(spark, d, _LINKS), _t(spark, d, _TERMS), "owner").withColumnRenamed("owner", "service_id")
    out = directory.services(_t(spark, d, _OWN), codes, "owner")
    return out.select("owner", F.array_join(F.transform("services_rollup", lambda s: F.concat_ws(":", s["id"].cast("string"), s["name"], F.array_join(s["codes"], "+"))), ",").alias("services"))


_ENTITIES = f"SELECT {_s('doc_id')} AS entity_id, lang AS name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS description FROM documents"
_HASH = "sha256('SERVICE: ' || name || ' - ' || coalesce(description, ''))"


@query(f"""WITH e AS ({_ENTITIES}) SELECT entity_id, {_HASH} AS semantic_hash, CASE CAST(entity_id AS INT) % 8 WHEN 0 THEN 'entry_miss' WHEN 1 THEN 'hash_missing' WHEN 2 THEN 'hash_malformed' WHEN 3 THEN 'hash_case_only' WHEN 4 THEN 'hash_mismatch' WHEN 5 THEN 'invalid_vector' ELSE 'reused' END AS state,
CASE WHEN CAST(entity_id AS INT) % 8 > 5 THEN 1 END AS embedding FROM e""")
def embedding_states(spark, d):
    e = _t(spark, d, _ENTITIES)
    k, h = F.col("entity_id").cast("int") % 8, F.sha2(directory.embedding_text("service"), 256)
    cached = F.when(k == 1, F.lit(None)).when(k == 2, "stale").when(k == 3, F.upper(h)).when(k == 4, F.sha2(F.lit("x"), 256)).otherwise(h)
    cache = e.where(k != 0).select("entity_id", cached.alias("hash"), F.when(k != 5, F.array(F.lit(1.0))).alias("embedding"))
    return directory.embedding_states(e, cache, "service").select("entity_id", "semantic_hash", "state", F.col("embedding")[0].cast("int").alias("embedding"))


_ROWS = f"SELECT CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN NULL ELSE CONCAT('c', {_s('p_partkey')}) END AS code, CASE WHEN p_partkey % 4 = 0 THEN 'nonsense' WHEN p_partkey % 7 = 0 THEN '[]' ELSE CONCAT('[', {_s('p_partkey')}, ', 2.5]') END AS vector FROM part"


@query(f"WITH r AS ({_ROWS}) SELECT code, CAST(regexp_extract(vector, '\\d+') AS DOUBLE) AS v, 2::BIGINT AS n FROM r WHERE coalesce(code, '') <> '' AND vector LIKE '%2.5]'")
def taxonomy_vectors(spark, d):
    return directory.taxonomy_vectors(_t(spark, d, _ROWS)).select("code", F.col("vector")[0].alias("v"), F.size("vector").cast("long").alias("n"))
