"""Mitigation of weak predictions and reconciliation with the state of earlier runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..schemas import conform, empty
from ..storage import written
from .score import reason_counts


class Mitigated(NamedTuple):
    finalized: DataFrame
    events: DataFrame
    removed: DataFrame
    remap: DataFrame
    state: DataFrame


def prior_state(previous: DataFrame) -> DataFrame:
    """The previous pair state with cleaned ids and its keys made anew; scopes are dropped."""
    d = conform(previous, "pair_state")
    a, b = text.clean_text(F.col("entity_a_id")), text.clean_text(F.col("entity_b_id"))
    own = d.select(F.least(a, b).alias("entity_a_id"), F.greatest(a, b).alias("entity_b_id"), text.clean_text(F.col("entity_type")).alias("entity_type"), F.lit("").alias("scope_id"), F.coalesce("retained_flag", F.lit(False)).alias("retained_flag"))
    return conform(own.withColumn("pair_key", text.pair_key(F.col("entity_a_id"), F.col("entity_b_id"))), "pair_state")


def touched(pairs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Pairs with an end in ids (entity_id, and entity_type if there is one: an organization and a service may share an id); all of them where ids is None."""
    if ids is None:
        return pairs
    typed = [c for c in ("entity_type",) if c in ids.columns]
    ends = ids.select(F.col("entity_id").alias("__id"), *typed).distinct()
    hit = pairs.select("pair_key", "entity_type", F.explode(F.array("entity_a_id", "entity_b_id")).alias("__id")).join(ends, ["__id", *typed], "left_semi").select("pair_key", "entity_type").distinct()
    return pairs.join(hit, ["pair_key", "entity_type"], "left_semi").select(pairs.columns)


def untouched(pairs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The other pairs; none where ids is None."""
    return pairs.limit(0) if ids is None else pairs.join(touched(pairs, ids).select("pair_key", "entity_type"), ["pair_key", "entity_type"], "left_anti").select(pairs.columns)


def finalize(scored: DataFrame, reasons: DataFrame, removed_entities: DataFrame, config: Config) -> DataFrame:
    """Scored pairs with reason_count and mitigation_reason; either reason clears prediction and eligibility."""
    m = config.mitigation
    gone = touched(scored, removed_entities).select("pair_key", F.lit(True).alias("__gone"))
    own = scored.join(reason_counts(reasons), "pair_key", "left").withColumn("reason_count", F.coalesce("reason_count", F.lit(0))).join(gone, "pair_key", "left")
    weak = F.lit(m.enabled) & F.col("predicted_duplicate") & (F.col("embedding_similarity") < m.min_embedding_similarity)
    if m.require_reason:
        weak = weak & (F.col("reason_count") < m.min_reasons)
    reason = F.when(F.col("__gone"), "entity_deleted").when(weak, "low_evidence_override")
    own = own.withColumn("mitigation_reason", reason).withColumn("pre_mitigation_prediction", F.col("predicted_duplicate"))
    kept = F.col("mitigation_reason").isNull()
    return own.withColumn("predicted_duplicate", F.col("predicted_duplicate") & kept).withColumn("review_eligible", F.col("review_eligible") & kept).drop("__gone")


def reconcile(finalized: DataFrame, prior: DataFrame, removed_entities: DataFrame, impacted: DataFrame | None) -> DataFrame:
    """pair_key, cleanup_reason of mitigated pairs and of prior pairs among the impacted that aren't retained any more."""
    own = finalized.where("mitigation_reason is not null").select("pair_key", F.col("mitigation_reason").alias("cleanup_reason"))
    before = touched(prior.where("retained_flag"), impacted)
    lost = before.join(finalized.where("review_eligible").select("pair_key"), "pair_key", "left_anti").join(own.select("pair_key"), "pair_key", "left_anti")
    deleted = touched(lost, removed_entities).select("pair_key", F.lit(True).alias("deleted"))
    seen = finalized.select("pair_key", F.lit(True).alias("seen"), "mitigation_reason")
    why = F.when(F.col("deleted"), "entity_deleted").when(F.col("seen").isNull(), "candidate_lost").when(F.col("mitigation_reason").isNotNull(), "mitigated_removed").otherwise("score_dropped")
    old = lost.select("pair_key").join(deleted, "pair_key", "left").join(seen, "pair_key", "left").select("pair_key", why.alias("cleanup_reason"))
    return own.unionByName(old)


def next_state(finalized: DataFrame, prior: DataFrame, impacted: DataFrame | None, scope_id: str = "") -> DataFrame:
    """Retained pairs of this run and the untouched ones of the earlier state; this run's win."""
    now = finalized.where("review_eligible").select("pair_key", "entity_a_id", "entity_b_id", "entity_type", F.lit(scope_id).alias("scope_id"), F.lit(True).alias("retained_flag"))
    old = untouched(prior, impacted).join(now.select("pair_key"), "pair_key", "left_anti")
    return conform(now, "pair_state").unionByName(conform(old, "pair_state"))


def apply_mitigation(scored: DataFrame, reasons: DataFrame, removed_entities: DataFrame, previous: DataFrame, config: Config, impacted: DataFrame | None = None, scope_removed: bool = False, no_change: bool = False) -> Mitigated:
    """impacted: ids of entities that changed or went; None means all. A removed scope clears everything; a run without changes or scores keeps the state."""
    session, prior = scored.sparkSession, prior_state(previous)
    remap = empty(session, "pair_id_remap")
    if scope_removed:
        gone = prior.where("retained_flag").select("pair_key", F.lit("scope_removed").alias("cleanup_reason"))
        return Mitigated(empty(session, "finalized"), empty(session, "mitigation_events"), gone, remap, empty(session, "pair_state"))
    if no_change and scored.isEmpty():
        return Mitigated(empty(session, "finalized"), empty(session, "mitigation_events"), empty(session, "removed"), remap, prior)
    finalized, prior = written(finalize(scored, reasons, removed_entities, config), "finalized"), written(prior, "prior")
    events = finalized.where("mitigation_reason is not null").select(
        "pair_key", "mitigation_reason", F.struct("embedding_similarity", F.col("reason_count").cast("long").alias("reason_count")).alias("evidence"),
        "pre_mitigation_prediction", F.col("predicted_duplicate").alias("post_mitigation_prediction"),
    )
    removed = reconcile(finalized, prior, removed_entities, impacted)
    return Mitigated(conform(finalized, "finalized"), conform(events, "mitigation_events"), written(removed, "removed"), remap, next_state(finalized, prior, impacted, config.metadata.scope_id))


def cleanup_histogram(removed: DataFrame) -> DataFrame:
    return removed.groupBy("cleanup_reason").agg(F.count("*").alias("n"))
