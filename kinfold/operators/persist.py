"""What a run leaves in the tables that reviewers read: rows with stable ids, upserts, cleaning up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """A run as its rows name it; at: the time of the rows, any type."""

    run_id: str
    team_id: str
    entity_type: str
    job_name: str
    at: str
    target_schemas: tuple[str, ...] = ()


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts, null ones as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), "|"), 256)


def pair_id(key: Column | str = "pair_key", kind: Column | str = "entity_type") -> Column:
    """Of a pair, in all runs."""
    return stable_id(F.lit("pair"), kind, key)


def score_id(run: Run, key: Column | str = "pair_key", kind: Column | str = "entity_type") -> Column:
    """Of a pair in a run of a team."""
    return stable_id(F.lit("score"), F.lit(run.run_id), F.lit(run.team_id), kind, key)


def duplicate_pairs(scored: DataFrame, run: Run) -> DataFrame:
    none = F.lit(None).cast("boolean")
    return scored.select(pair_id().alias("id"), "entity_a_id", "entity_b_id", F.col("source_schema_a").alias("entity_a_source_schema"), F.col("source_schema_b").alias("entity_b_source_schema"), "entity_type", none.alias("is_duplicate"), F.lit(run.at).alias("created_at"), F.lit(run.at).alias("updated_at"))


def duplicate_pair_scores(scored: DataFrame, run: Run) -> DataFrame:
    """Raw scores are the section scores before their weights."""
    sections = ("deterministic", "nlp", "ml")
    return scored.select(
        score_id(run).alias("id"), pair_id().alias("duplicate_pair_id"), F.lit(run.run_id).alias("deduplication_run_id"), F.lit(run.team_id).alias("team_id"), "entity_type", "predicted_duplicate", F.col("final_score").alias("confidence_score"),
        "legacy_confidence_score", "shadow_confidence_score", "shadow_log_odds", "calibration_version", *[f"{s}_section_score" for s in sections], *[F.col(f"{s}_section_score").alias(f"raw_{s}_score") for s in sections],
        "embedding_similarity", F.lit(None).cast("boolean").alias("is_duplicate"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("reviewed_at"), F.lit(run.at).alias("created_at"),
    )


def duplicate_reasons(reasons: DataFrame, scored: DataFrame, run: Run) -> DataFrame:
    """An id is that of the score row, the signal and its values: it differs from run to run, and numbers that change leave it."""
    own = reasons.join(scored.select("pair_key", "entity_type"), "pair_key")
    score = score_id(run)
    values = ("matched_value", "entity_a_value", "entity_b_value")
    return own.select(
        stable_id(F.lit("reason"), score, "match_type", *values).alias("id"), score.alias("duplicate_pair_score_id"), pair_id().alias("duplicate_pair_id"), F.lit(run.run_id).alias("deduplication_run_id"), "entity_type",
        "match_type", *values, "raw_contribution", "weighted_contribution", "signal_weight", "similarity_score", F.lit(run.at).alias("created_at"),
    )


def mitigated_pairs(events: DataFrame, scored: DataFrame, run: Run) -> DataFrame:
    own = events.join(scored.select("pair_key", "entity_type"), "pair_key")
    return own.select(stable_id(F.lit("mitigated"), F.lit(run.run_id), "entity_type", "pair_key").alias("id"), pair_id().alias("duplicate_pair_id"), F.lit(run.run_id).alias("deduplication_run_id"), "entity_type", "mitigation_reason", F.to_json("evidence").alias("evidence"), F.lit(run.at).alias("created_at"))


def duplicate_clusters(clusters: DataFrame, run: Run) -> DataFrame:
    none = F.lit(None)
    return clusters.select(
        stable_id(F.lit("cluster"), F.lit(run.run_id), "cluster_id").alias("id"), F.lit(run.run_id).alias("deduplication_run_id"), F.lit(run.team_id).alias("team_id"), "entity_type", "cluster_size", "pair_count", F.col("pair_count").alias("pending_pair_count"),
        F.lit(0).cast("long").alias("reviewed_pair_count"), "avg_confidence_score", "max_confidence_score", "min_confidence_score", "objective_score", "positive_edge_sum", "negative_edge_penalty", "cluster_risk_score", "algorithm_version",
        F.lit(False).alias("bulk_reviewed"), none.cast("boolean").alias("bulk_is_duplicate"), none.cast("string").alias("bulk_reviewed_by"), none.cast("string").alias("bulk_reviewed_at"), F.lit(run.at).alias("created_at"), F.lit(run.at).alias("updated_at"),
    )


def duplicate_cluster_pairs(cluster_pairs: DataFrame, scored: DataFrame, run: Run) -> DataFrame:
    own = cluster_pairs.join(scored.select("pair_key", "entity_type"), "pair_key")
    cluster = stable_id(F.lit("cluster"), F.lit(run.run_id), "cluster_id")
    return own.select(
        stable_id(cluster, pair_id()).alias("id"), cluster.alias("duplicate_cluster_id"), pair_id().alias("duplicate_pair_id"), score_id(run).alias("duplicate_pair_score_id"), F.coalesce("is_reviewed", F.lit(False)).alias("is_reviewed"),
        "review_decision", "assignment_score", "assignment_method", F.lit(run.at).alias("created_at"), F.lit(run.at).alias("updated_at"),
    )


def artifact_frames(frames: dict[str, DataFrame], run: Run) -> dict[str, DataFrame]:
    """The rows of a run (its artifacts by name) for each of six tables."""
    scored = frames["finalized_pairs"]
    return {
        "duplicate_pairs": duplicate_pairs(scored, run), "duplicate_pair_scores": duplicate_pair_scores(scored, run), "duplicate_reasons": duplicate_reasons(frames["pair_reasons"], scored, run),
        "mitigated_pairs": mitigated_pairs(frames["mitigation_events"], scored, run), "duplicate_clusters": duplicate_clusters(frames["clusters"], run), "duplicate_cluster_pairs": duplicate_cluster_pairs(frames["cluster_pairs"], scored, run),
    }


def run_row(summary: DataFrame, run: Run) -> DataFrame:
    """One row of the run: what it found above the threshold are duplicates alone, though more is retained for review."""
    n = F.col("duplicate").cast("long")
    return summary.select(F.lit(run.run_id).alias("id"), F.lit(run.team_id).alias("team_id"), F.lit(run.entity_type).alias("entity_type"), F.lit(run.job_name).alias("job_name"), F.array(*[F.lit(s) for s in run.target_schemas]).cast("array<string>").alias("target_schemas"), n.alias("pairs_above_threshold"), n.alias("pairs_predicted_duplicate"))


def merge(store: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """store with rows put in place of those with the same keys; columns in ``keep``, such as decisions, keep what the store has."""
    old = store.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
    new = rows.join(old, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in rows.columns]) if keep else rows
    return store.join(rows.select(*keys), keys, "left_anti").select(store.columns).unionByName(new, allowMissingColumns=True)


def clean_up(tables: dict[str, DataFrame], removed: DataFrame, run: Run) -> dict[str, DataFrame]:
    """The tables after a run, in this order: removed pairs go with all that hangs on them; so do pairs of the run's type that no score has; clusters count
    the pairs they still have, and empty ones go; reasons without a score go. removed: pair_key and entity_type."""
    t, gone = dict(tables), removed.select(pair_id().alias("duplicate_pair_id")).distinct()
    for name in ("duplicate_pair_scores", "duplicate_reasons", "mitigated_pairs", "duplicate_cluster_pairs"):
        t[name] = t[name].join(gone, "duplicate_pair_id", "left_anti").select(t[name].columns)
    left = t["duplicate_pairs"].join(gone.withColumnRenamed("duplicate_pair_id", "id"), "id", "left_anti")
    scored = left.join(t["duplicate_pair_scores"].select(F.col("duplicate_pair_id").alias("id")).distinct(), "id", "left_semi")
    t["duplicate_pairs"] = left.where(F.col("entity_type") != run.entity_type).unionByName(scored.where(F.col("entity_type") == run.entity_type)).select(tables["duplicate_pairs"].columns)
    scores = t["duplicate_pair_scores"].select(F.col("id").alias("duplicate_pair_score_id"), "confidence_score")
    counts = t["duplicate_cluster_pairs"].join(scores, "duplicate_pair_score_id", "left").groupBy(F.col("duplicate_cluster_id").alias("id")).agg(
        F.count("*").alias("__pairs"), F.count_if("is_reviewed").alias("__reviewed"), F.avg("confidence_score").alias("__avg"), F.max("confidence_score").alias("__max"), F.min("confidence_score").alias("__min")
    )
    new = {"pair_count": F.col("__pairs"), "reviewed_pair_count": F.col("__reviewed"), "pending_pair_count": F.col("__pairs") - F.col("__reviewed"), "avg_confidence_score": F.col("__avg"), "max_confidence_score": F.col("__max"), "min_confidence_score": F.col("__min")}
    t["duplicate_clusters"] = t["duplicate_clusters"].join(counts, "id").select(*[new[c].alias(c) if c in new else F.col(c) for c in tables["duplicate_clusters"].columns])
    t["duplicate_reasons"] = t["duplicate_reasons"].join(scores.select("duplicate_pair_score_id"), "duplicate_pair_score_id", "left_semi").select(tables["duplicate_reasons"].columns)
    return t


def review_view(scores: DataFrame, pairs: DataFrame, mitigated: DataFrame, run: Run, unreviewed: bool = False) -> DataFrame:
    """Score rows that reviewers of the team see for the run: predicted duplicates that weren't mitigated; only those without a decision if asked for."""
    own = scores.where((F.col("team_id") == run.team_id) & (F.col("deduplication_run_id") == run.run_id) & (F.col("entity_type") == run.entity_type) & F.col("predicted_duplicate"))
    own = own.join(mitigated.select("duplicate_pair_id", "deduplication_run_id"), ["duplicate_pair_id", "deduplication_run_id"], "left_anti")
    if unreviewed:
        own = own.where("is_duplicate is null")
    return own.join(pairs.select(F.col("id").alias("duplicate_pair_id"), "entity_a_id", "entity_b_id"), "duplicate_pair_id")


def review_progress(view: DataFrame) -> DataFrame:
    """One row: pairs of a view and those with a decision, whichever."""
    return view.agg(F.count("*").alias("total_pairs"), F.count("is_duplicate").alias("reviewed_pairs"))


def requires_rescore(policy: str, model: str, previous_policy: str | None, previous_model: str | None) -> bool:
    """Whether earlier pairs must be scored anew: a version changed since a state that there is."""
    before = (previous_policy, previous_model)
    return before != (None, None) and before != (policy, model)
