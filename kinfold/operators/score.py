"""Scores of candidate pairs: deterministic signals, names, an optional model, calibration and tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SIGNALS, Config
from ..functions import domain, fuzzy, taxonomy, text
from ..schemas import conform

#: Takes the gated pairs (pair_key, left and right structs), gives pair_key, is_duplicate and confidence.
Scorer = Callable[[DataFrame], DataFrame]


def prepared(entities: DataFrame) -> DataFrame:
    """What pairs compare of an entity, computed once for each entity."""
    return entities.select(
        "entity_id", "entity_type", "name", F.col("emails").alias("shared_email"), F.col("phones").alias("shared_phone"), domain.domain_tokens(F.col("emails"), F.col("websites")).alias("tokens"), domain.contact_domains(F.col("emails"), F.col("websites")).alias("domains"),
        taxonomy.code_set(F.col("taxonomies"), F.col("services_rollup")).alias("codes"), text.canonical_addresses(F.col("locations")).alias("shared_address"), text.canonical_identifiers(F.col("identifiers")).alias("shared_identifier"),
    )


def paired(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with the structs l and r of both entities."""
    own = prepared(entities)
    sides = own.select("entity_id", "entity_type", F.struct(*[c for c in own.columns if c not in ("entity_id", "entity_type")]).alias("s"))
    out = candidates
    for side, name in (("a", "l"), ("b", "r")):
        out = out.join(sides.select(F.col("entity_id").alias(f"entity_{side}_id"), "entity_type", F.col("s").alias(name)), [f"entity_{side}_id", "entity_type"])
    return out


def _signals(config: Config) -> list[tuple[str, float]]:
    return [(s, config.scoring.weights[s]) for s in SIGNALS if config.scoring.weights.get(s, 0) > 0]


def with_signals(pairs: DataFrame, config: Config) -> DataFrame:
    """signals: an array with the raw and weighted contribution and the values of each enabled signal; deterministic_section_score.

    Identifiers are a signal of organizations alone: what counts is the type of each pair, whichever the run is for.
    """
    best = taxonomy.best_overlap(F.col("l.codes"), F.col("r.codes"))
    pairs = pairs.withColumn("best", best).withColumn("domain_score", domain.domain_overlap(F.col("l.tokens"), F.col("r.tokens")))
    null = F.lit(None).cast("string")
    entries, total = [], F.lit(0.0)
    for signal, weight in _signals(config):
        applies = F.col("entity_type") == "organization" if signal == "shared_identifier" else F.lit(True)
        total = total + F.when(applies, F.lit(weight)).otherwise(0.0)
        similarity = null.cast("double")
        if signal == "shared_domain":
            raw, values = F.col("domain_score"), (F.array_min(F.array_intersect("l.domains", "r.domains")), *[text.reason_text(F.col(f"{s}.domains"), F.lit(signal)) for s in "lr"])
        elif signal == "shared_taxonomy":
            raw, values, similarity = F.col("best.score"), (F.col("best.ancestor"), *[text.reason_text(F.col(f"{s}.codes"), F.lit(signal)) for s in "lr"]), F.col("best.score")
        else:
            left, right = F.col(f"l.{signal}"), F.col(f"r.{signal}")
            matched = text.reason_text(F.array_compact(F.array(F.array_min(F.array_intersect(left, right)))), F.lit(signal))
            raw, values = text.overlap_ratio(left, right), (matched, text.reason_text(left, F.lit(signal)), text.reason_text(right, F.lit(signal)))
        raw = F.when(applies, raw).otherwise(0.0)
        entries.append(_reason(F.lit(signal), raw, raw * weight, F.lit(weight), *values, similarity))
    signals = F.array(*entries)
    score = F.least(F.aggregate(F.col("signals"), F.lit(0.0), lambda s, x: s + x["weighted_contribution"]) / F.when(total > 0, total).otherwise(1.0), F.lit(1.0))
    return pairs.withColumn("signals", signals).withColumn("deterministic_section_score", score)


def _reason(match_type: Column, raw: Column, weighted: Column, weight: Column, matched: Column, a: Column, b: Column, similarity: Column) -> Column:
    names = ("match_type", "raw_contribution", "weighted_contribution", "signal_weight", "matched_value", "entity_a_value", "entity_b_value", "similarity_score")
    kinds = ("string", "double", "double", "double", "string", "string", "string", "double")
    return F.struct(*[c.cast(k).alias(n) for c, k, n in zip((match_type, raw, weighted, weight, matched, a, b, similarity), kinds, names)])


def with_names(pairs: DataFrame, config: Config, safeguards: tuple[fuzzy.Safeguard, ...] | None = None) -> DataFrame:
    """name_similarity and nlp_section_score; safeguards veto or lower the similarity, in order."""
    a, b = F.col("l.name"), F.col("r.name")
    out = pairs.withColumn("name_similarity", fuzzy.algorithm(config.nlp.algorithm, config.strict)(a, b))
    guarded = F.col("name_similarity")
    for guard in safeguards if safeguards is not None else (fuzzy.number_veto,) if config.nlp.number_veto else ():
        guarded = F.greatest(guard(a, b, guarded), F.lit(0.0))
    return out.withColumn("nlp_section_score", fuzzy.nlp_score(guarded, F.col("deterministic_section_score"), config.nlp.fuzzy_threshold, config.nlp.standalone_threshold))


def composed(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that aren't null, 1 at most."""
    up = sum((F.coalesce(s * weights[k], F.lit(0.0)) for k, s in scores.items() if weights.get(k, 0) > 0), F.lit(0.0))
    down = sum((F.when(s.isNotNull(), weights[k]).otherwise(0.0) for k, s in scores.items() if weights.get(k, 0) > 0), F.lit(0.0))
    return F.when(down > 0, F.least(up / F.when(down > 0, down), F.lit(1.0))).otherwise(F.lit(0.0))


def tier(score: Column, duplicate: float, maybe: float) -> Column:
    return F.when(score >= duplicate, "duplicate").when(score >= maybe, "maybe").otherwise("below_maybe")


def score_candidates(candidates: DataFrame, entities: DataFrame, config: Config, scorer: Scorer | None = None, safeguards: tuple[fuzzy.Safeguard, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, reasons). The scorer sees only pairs whose score without a model reaches the gate; where it has none, the embedding similarity counts."""
    s, w = config.scoring, config.scoring.section_weights
    pairs = with_names(with_signals(paired(candidates, entities), config), config, safeguards)
    det, nlp, ml = F.col("deterministic_section_score"), F.col("nlp_section_score"), F.col("ml_section_score")
    if config.ml.enabled:
        pairs = pairs.withColumn("pre_ml", composed({"deterministic": det, "nlp": nlp}, w))
        if scorer is not None:
            gated = pairs.where(F.col("pre_ml") >= config.ml.gate).select("pair_key", "l", "r", "name_similarity", "embedding_similarity")
            confidence = F.when(F.col("is_duplicate"), F.col("confidence")).otherwise(1 - F.col("confidence"))
            model = scorer(gated).select("pair_key", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("model_score"))
            pairs = pairs.join(model, "pair_key", "left")
        else:
            pairs = pairs.withColumn("model_score", F.lit(None).cast("double"))
        pairs = pairs.withColumn("ml_section_score", F.when(F.col("pre_ml") >= config.ml.gate, F.coalesce("model_score", "embedding_similarity")))
    else:
        pairs = pairs.withColumn("ml_section_score", F.lit(None).cast("double"))
    final = composed({"deterministic": det, "nlp": nlp, "ml": ml}, w)
    odds = F.lit(s.prior) + F.aggregate("signals", F.lit(0.0), lambda x, y: x + y["weighted_contribution"]) + nlp * w["nlp"] + F.coalesce(ml * w["ml"], F.lit(0.0))
    pairs = pairs.withColumn("final_score", final).withColumn("shadow_log_odds", odds)
    scored = pairs.select(
        "*", F.col("final_score").alias("legacy_confidence_score"), (1 / (1 + F.exp(-F.col("shadow_log_odds"))) if s.calibration else F.col("final_score")).alias("shadow_confidence_score"),
        F.lit(s.calibration_version).alias("calibration_version"), F.lit(config.metadata.policy_version).alias("policy_version"), F.lit(config.metadata.model_version).alias("model_version"),
        tier(F.col("final_score"), s.duplicate_threshold, s.maybe_threshold).alias("pair_outcome"),
    ).withColumn("predicted_duplicate", F.col("pair_outcome") == "duplicate").withColumn("review_eligible", F.col("pair_outcome") != "below_maybe")
    name = _reason(F.lit("name_similarity"), nlp, nlp, F.lit(1.0), F.lit(None), F.col("l.name"), F.col("r.name"), nlp)
    model_reason = _reason(F.lit("ml_similarity"), ml, ml * w["ml"], F.lit(w["ml"]), F.lit(None), F.lit(None), F.lit(None), ml)
    every = F.filter(F.concat("signals", F.array(name, model_reason)), lambda x: x["weighted_contribution"] > 0)
    reasons = pairs.select("pair_key", F.explode(every).alias("x")).select("pair_key", "x.*")
    return conform(scored, "scored"), conform(reasons, "reasons")


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.where("weighted_contribution > 0").groupBy("pair_key").agg(F.count("*").alias("reason_count"))


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("scored"), F.count_if(F.col("ml_section_score").isNotNull()).alias("ml_scored"), F.count_if(F.col("pair_outcome") == "duplicate").alias("duplicate"),
        F.count_if(F.col("pair_outcome") == "maybe").alias("maybe"), F.count_if("review_eligible").alias("retained"),
    )


def reason_patterns(scored: DataFrame, reasons: DataFrame, least: float = 0.95, top: int = 5) -> DataFrame:
    """The most frequent sets of reasons among pairs with a high calibrated score: a report of ``top`` rows."""
    own = reasons.join(scored.where(F.col("shadow_confidence_score") >= least).select("pair_key"), "pair_key", "left_semi")
    return own.groupBy("pair_key").agg(F.array_join(F.array_sort(F.collect_set("match_type")), "|").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(top)


#: Signals that are evidence by themselves; taxonomy and the model are not.
STRONG = ("shared_email", "shared_phone", "shared_domain", "shared_address", "name_similarity", "shared_identifier")
_BANDS = ("duplicate", "maybe", "below_maybe")


def signal_bands(scored: DataFrame, reasons: DataFrame) -> DataFrame:
    """Of each strong signal, pairs by outcome and in total."""
    own = reasons.where(F.col("match_type").isin(*STRONG)).select("pair_key", "match_type").distinct().join(scored.select("pair_key", "pair_outcome"), "pair_key")
    return own.groupBy("match_type").agg(F.count("*").alias("total"), *[F.count_if(F.col("pair_outcome") == b).alias(b) for b in _BANDS])


def with_strong_signals(scored: DataFrame, reasons: DataFrame, config: Config) -> DataFrame:
    """pair_key, pair_outcome, signal_count (strong signals), pre_ml_score and ml_gate_pass of each pair."""
    strong = reasons.where(F.col("match_type").isin(*STRONG)).groupBy("pair_key").agg(F.countDistinct("match_type").alias("signal_count"))
    before = composed({"deterministic": F.col("deterministic_section_score"), "nlp": F.col("nlp_section_score")}, config.scoring.section_weights)
    own = scored.join(strong, "pair_key", "left").select("pair_key", "pair_outcome", F.coalesce("signal_count", F.lit(0)).alias("signal_count"), before.alias("pre_ml_score"))
    return own.withColumn("ml_gate_pass", F.col("pre_ml_score") >= config.ml.gate)


def signal_counts(scored: DataFrame, reasons: DataFrame, config: Config) -> DataFrame:
    """Of each number of strong signals: pairs by outcome and in total, and the percentage that passes the model's gate."""
    own = with_strong_signals(scored, reasons, config)
    passed = F.round(100 * F.count_if("ml_gate_pass") / F.count("*"), 1)
    return own.groupBy("signal_count").agg(F.count("*").alias("total"), *[F.count_if(F.col("pair_outcome") == b).alias(b) for b in _BANDS], passed.alias("gate_pass_percent"))


def gate_misses(scored: DataFrame, reasons: DataFrame, config: Config) -> DataFrame:
    """One row: pairs with two strong signals or more that the gate keeps from the model."""
    return with_strong_signals(scored, reasons, config).agg(F.count_if((F.col("signal_count") >= 2) & ~F.col("ml_gate_pass")).alias("missed"))


def confidence_report(scored: DataFrame) -> DataFrame:
    """One row: means of both confidences (0 without pairs), pairs at 0.999 or more and calibrated ones at 0.95 or more."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(
        mean("legacy_confidence_score").alias("legacy_mean"), mean("shadow_confidence_score").alias("shadow_mean"), F.count_if(F.col("legacy_confidence_score") >= 0.999).alias("legacy_perfect"),
        F.count_if(F.col("shadow_confidence_score") >= 0.95).alias("shadow_near_perfect"),
    )
