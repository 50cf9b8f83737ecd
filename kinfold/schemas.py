"""Schemas of the artifacts; frames are conformed to them, empty or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_LOCATION = "array<struct<address_1:string,city:string,state:string,postal_code:string,location_type:string>>"
_TAXONOMY = "array<struct<code:string,name:string>>"

_DDL = {
    "entity": f"""entity_id string, entity_type string, source_schema string, name string, description string, emails array<string>, phones array<string>, websites array<string>, locations {_LOCATION},
        taxonomies {_TAXONOMY}, identifiers array<struct<system:string,value:string>>, services_rollup array<struct<name:string,taxonomies:{_TAXONOMY}>>, organization_name string, organization_id string,
        embedding_vector array<double>, active_flag boolean""",
    "entity_index": "entity_id string, entity_type string, content_hash string, active_flag boolean",
    "candidates": "pair_key string, entity_a_id string, entity_b_id string, entity_type string, embedding_similarity double, candidate_reason_codes array<string>, source_schema_a string, source_schema_b string",
    "scored": """pair_key string, entity_a_id string, entity_b_id string, source_schema_a string, source_schema_b string, entity_type string, policy_version string, model_version string, deterministic_section_score double,
        nlp_section_score double, ml_section_score double, final_score double, legacy_confidence_score double, shadow_confidence_score double, shadow_log_odds double, calibration_version string, predicted_duplicate boolean,
        pair_outcome string, review_eligible boolean, embedding_similarity double""",
    "reasons": "pair_key string, match_type string, raw_contribution double, weighted_contribution double, signal_weight double, matched_value string, entity_a_value string, entity_b_value string, similarity_score double",
    "mitigation_events": "pair_key string, mitigation_reason string, evidence struct<embedding_similarity:double,reason_count:bigint>, pre_mitigation_prediction boolean, post_mitigation_prediction boolean",
    "removed": "pair_key string, cleanup_reason string",
    "pair_id_remap": "old_pair_key string, new_pair_key string, entity_type string",
    "pair_state": "pair_key string, entity_a_id string, entity_b_id string, entity_type string, scope_id string, retained_flag boolean",
    "clusters": """cluster_id string, entity_type string, cluster_size bigint, pair_count bigint, avg_confidence_score double, max_confidence_score double, min_confidence_score double, objective_score double,
        positive_edge_sum double, negative_edge_penalty double, cluster_risk_score double, algorithm_version string""",
    "cluster_pairs": "cluster_id string, pair_key string, is_reviewed boolean, review_decision boolean, assignment_score double, assignment_method string",
    "review_queue": "pair_key string, entity_a_id string, entity_b_id string, final_score double, cluster_risk_score double, priority_score double, team_id string, scope_id string, entity_type string",
}
_DDL["finalized"] = _DDL["scored"] + ", reason_count bigint, mitigation_reason string"


def schema(name: str) -> StructType:
    return _parse_datatype_string(" ".join(_DDL[name].split()))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the columns of an artifact: what is missing is null, what is more is left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def ensure_frame(spark: SparkSession, value: object, name: str) -> DataFrame:
    """A DataFrame stays, a list of rows becomes one, None an empty one; all are conformed."""
    if value is None:
        return empty(spark, name)
    if isinstance(value, DataFrame):
        return conform(value, name)
    if isinstance(value, list):
        known = {f.name for f in schema(name)}
        return spark.createDataFrame([{k: v for k, v in r.items() if k in known} for r in value], schema(name))
    raise TypeError(f"neither a DataFrame nor a list of rows: {type(value).__name__}")
