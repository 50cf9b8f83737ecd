"""Correlation clustering of finalized pairs, and the review queue."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..schemas import conform
from ..storage import written

_EPSILON = 1e-12


def signed_weight(score: Column, threshold: float) -> Column:
    """From -1 at score 0 over 0 at the threshold to 1 at score 1."""
    up = (score - threshold) / max(1 - threshold, _EPSILON)
    down = (score - threshold) / max(threshold, _EPSILON)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(score >= threshold, up).otherwise(down)))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of undirected edges a, b, by alternating stars; each round is written to the shared folder."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = now


def solve(nodes: list[str], weights: dict[str, dict[str, float]], max_iter: int) -> dict[str, int]:
    """Greedy local search: in order, each node goes to the cluster with the best gain, the oldest of equals, or leaves to be alone."""
    at = {n: k for k, n in enumerate(nodes, 1)}
    size, fresh = {k: 1 for k in at.values()}, len(nodes) + 1
    for _ in range(max_iter):
        moved = False
        for n in nodes:
            gain: dict[int, float] = defaultdict(float)
            for other in sorted(weights.get(n, {})):
                gain[at[other]] += weights[n][other]
            here = gain.pop(at[n], 0.0)
            best, target = 0.0, at[n]
            # clusters without an edge to the node all gain 0: the oldest of them stands for all
            for k in sorted(gain.keys() | _oldest_other(size, gain, at[n])):
                if gain.get(k, 0.0) - here > best + _EPSILON:
                    best, target = gain.get(k, 0.0) - here, k
            if -here > best + _EPSILON:
                best, target = -here, -1
            if best <= _EPSILON:
                continue
            size[at[n]] -= 1
            if not size[at[n]]:
                del size[at[n]]
            if target == -1:
                target, fresh = fresh, fresh + 1
            size[target] = size.get(target, 0) + 1
            at[n] = target
            moved = True
        if not moved:
            break
    return at


def _oldest_other(size: dict[int, int], gain: dict[int, float], own: int) -> set[int]:
    return {next((k for k in size if k != own and k not in gain), own)} - {own}  # size has its clusters by age


def correlation_clusters(finalized: DataFrame, config: Config) -> DataFrame:
    """entity_type, node, cluster_id of nodes in clusters of the least size; edges below the threshold repel."""
    c, pivot = config.clustering, config.scoring.maybe_threshold
    key = lambda side: F.concat_ws("\x01", "entity_type", f"entity_{side}_id")
    edges = finalized.select(key("a").alias("a"), key("b").alias("b"), signed_weight(F.col("final_score"), pivot).alias("w"), "review_eligible")
    label = components(edges.where(F.col("review_eligible") & (F.col("w") >= c.min_edge_weight)).select("a", "b"))
    inside = edges.join(label.select(F.col("node").alias("a"), "component"), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("component", "a", "b", "w")

    def one(t: pa.Table) -> pa.Table:
        weights: dict[str, dict[str, float]] = defaultdict(dict)
        for a, b, w in zip(*(t.column(k).to_pylist() for k in ("a", "b", "w"))):
            weights[a][b] = weights[b][a] = w
        at = solve(sorted(weights), weights, c.max_iter)
        nodes = sorted(at)
        return pa.table({"node": nodes, "number": pa.array([at[n] for n in nodes], pa.int64()), "component": [t.column("component")[0].as_py()] * len(nodes)})

    solved = inside.groupBy("component").applyInArrow(one, "node string, number long, component string")
    parts = solved.select("component", "number", F.split("node", "\x01", 2).alias("n")).select("component", "number", F.col("n")[0].alias("entity_type"), F.col("n")[1].alias("node"))
    groups = parts.groupBy("component", "number", "entity_type").agg(F.array_sort(F.collect_list("node")).alias("members")).where(F.size("members") >= c.min_size)
    return groups.select("entity_type", F.concat(F.lit("ccv1::"), F.sha2(F.array_join("members", "|"), 256)).alias("cluster_id"), F.explode("members").alias("node"))


def cluster_stats(eligible: DataFrame, assignment: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(clusters, pairs with both ends in one cluster); weights pivot on the duplicate threshold."""
    a, b = (assignment.select("entity_type", F.col("node").alias(f"entity_{s}_id"), F.col("cluster_id").alias(f"c{s}")) for s in "ab")
    bridge = eligible.join(a, ["entity_type", "entity_a_id"]).join(b, ["entity_type", "entity_b_id"]).where("ca = cb").withColumn("cluster_id", F.col("ca"))
    w = signed_weight(F.col("final_score"), config.scoring.duplicate_threshold)
    stats = bridge.groupBy("cluster_id").agg(
        F.count("*").alias("pair_count"), F.avg("final_score").alias("avg_confidence_score"), F.max("final_score").alias("max_confidence_score"), F.min("final_score").alias("min_confidence_score"),
        F.sum(w).alias("objective_score"), F.sum(F.when(w > 0, w).otherwise(0.0)).alias("positive_edge_sum"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("negative_edge_penalty"),
    )
    own = assignment.groupBy("cluster_id", "entity_type").agg(F.count("*").alias("cluster_size")).join(stats, "cluster_id", "left").na.fill(0)
    own = own.withColumn("cluster_risk_score", F.col("negative_edge_penalty") / F.col("cluster_size")).withColumn("algorithm_version", F.lit(config.clustering.algorithm))
    assignment_score = signed_weight(F.col("final_score"), config.scoring.maybe_threshold)
    return conform(own, "clusters"), conform(bridge.withColumn("assignment_score", assignment_score).withColumn("assignment_method", F.lit(config.clustering.algorithm)), "cluster_pairs")


def cluster_pairs(finalized: DataFrame, removed: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    active = finalized.join(removed.select("pair_key"), "pair_key", "left_anti")
    return cluster_stats(active.where("review_eligible"), written(correlation_clusters(active, config)), config)


def eligible(finalized: DataFrame, config: Config) -> Column:
    """Whether a pair is reviewed, by the best column there is: eligibility, outcome, prediction or score."""
    have = finalized.columns
    if "review_eligible" in have:
        return F.coalesce("review_eligible", F.lit(False))
    if "pair_outcome" in have:
        return F.coalesce(F.col("pair_outcome").isin("duplicate", "maybe"), F.lit(False))
    if "predicted_duplicate" in have:
        return F.coalesce("predicted_duplicate", F.lit(False))
    return F.col("final_score") >= config.scoring.maybe_threshold


def review_queue(finalized: DataFrame, removed: DataFrame, clusters: DataFrame, pairs: DataFrame, config: Config) -> DataFrame:
    """Eligible pairs, the most urgent first: priority 0.55 score + 0.25 similarity + 0.20 risk of their cluster (0 without one); ties by key."""
    risk = pairs.select("pair_key", "cluster_id").join(clusters.select("cluster_id", "cluster_risk_score"), "cluster_id", "left")
    own = finalized.where(eligible(finalized, config)).join(removed.select("pair_key"), "pair_key", "left_anti").join(risk, "pair_key", "left")
    own = own.withColumn("cluster_risk_score", F.coalesce("cluster_risk_score", F.lit(0.0)))
    priority = 0.55 * F.col("final_score") + 0.25 * F.col("embedding_similarity") + 0.20 * F.col("cluster_risk_score")
    own = own.withColumn("priority_score", priority).withColumn("team_id", F.lit(config.metadata.team_id)).withColumn("scope_id", F.lit(config.metadata.scope_id))
    return conform(own, "review_queue").orderBy(F.desc("priority_score"), "pair_key")
