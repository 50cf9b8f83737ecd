"""The whole run: clean, block, score, mitigate, cluster, queue, bundle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import block, clean, cluster, mitigate, score
from ..storage import written
from ..schemas import ensure_frame


def run_incremental(
    spark: SparkSession, organizations: Any = None, services: Any = None, previous_index: Any = None, previous_state: Any = None, config: Config | None = None, *,
    explicit_backfill: bool = False, force_rescore: bool = False, scope_removed: bool = False, scorer: score.Scorer | None = None, plan: str = "gate", progress: Callable[[str], None] = lambda _: None,
) -> dict[str, DataFrame]:
    """All artifacts of a run by name, with a one-row summary.

    Inputs are DataFrames, lists of rows or None. A full rescore compares all earlier pairs with the new scores; otherwise only
    pairs with an entity that was added, changed or removed are touched.
    """
    config = config or Config.default()
    progress("clean")
    orgs = clean.clean_entities(ensure_frame(spark, organizations, "entity"), "organization", config.strict)
    svcs = clean.clean_entities(ensure_frame(spark, services, "entity"), "service", config.strict)
    entities = written(orgs.unionByName(svcs, allowMissingColumns=True))
    index = clean.entity_index(entities)
    changed, removed_entities = clean.classify(index, ensure_frame(spark, previous_index, "entity_index"))
    changed, removed_entities = written(changed), written(removed_entities)
    delta = clean.delta_summary(changed, removed_entities)
    everything = explicit_backfill or force_rescore
    no_change = bool(delta.first().no_change)
    progress("block")
    candidates = written(block.candidates(entities, changed, config.blocking, everything, plan))
    progress("score")
    scored, reasons = score.score_candidates(candidates, entities, config, scorer)
    scored, reasons = written(scored), written(reasons)
    moved = changed.where("delta_class in ('added', 'changed')").select("entity_id", "entity_type").unionByName(removed_entities.select("entity_id", "entity_type"))
    progress("mitigate")
    m = mitigate.apply_mitigation(scored, reasons, removed_entities, ensure_frame(spark, previous_state, "pair_state"), config, None if everything else moved, scope_removed, no_change)
    finalized, removed = m.finalized, m.removed
    progress("cluster")
    clusters, pairs = (written(df) for df in cluster.cluster_pairs(finalized, removed, config))
    progress("queue")
    queue = cluster.review_queue(finalized, removed, clusters, pairs, config)
    frames = {
        "entities": entities, "entity_index": index, "delta": changed, "removed_entities": removed_entities, "candidates": candidates, "scored_pairs": scored, "pair_reasons": reasons,
        "finalized_pairs": finalized, "mitigation_events": m.events, "removed_pairs": removed, "pair_id_remap": m.remap, "pair_state": m.state, "clusters": clusters, "cluster_pairs": pairs, "review_queue": queue,
    }
    progress("bundle")
    return {**frames, "run_summary": run_summary(frames).crossJoin(delta).crossJoin(score.score_summary(scored))}


def run_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """One row: artifact_count and the rows of each artifact."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in frames.items()]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy().agg(F.count("*").alias("artifact_count"), *[F.max(F.when(F.col("artifact") == name, F.col("n"))).alias(f"rows__{name}") for name in frames])


def bundle(frames: dict[str, DataFrame], config: Config, path: str | None = None) -> dict[str, Any]:
    """Frames under dotted names with version, time and settings; written as Parquet where a path is given."""
    if path is not None:
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {"version": 1, "created_at": datetime.now(UTC).isoformat(), "config": config, "frames": {f"artifact.{k}": v for k, v in frames.items()}}
