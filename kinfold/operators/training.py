"""Training data: reviewed pairs, append-only stores, labels and cuts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import MODEL_FEATURES
from ..storage import written

SHARES = {"high": 0.4, "mid": 0.4, "low": 0.2}


def latest_run(reviews: DataFrame, run: str = "run_id", reviewed: str = "reviewed_at", created: str = "created_at") -> DataFrame:
    """The run with the latest activity, ties by the greater run id."""
    activity = reviews.groupBy(run).agg(F.max(F.coalesce(reviewed, created)).alias("latest_activity"))
    return activity.orderBy(F.desc("latest_activity"), F.desc(run)).limit(1)


def label(decision: Column) -> Column:
    return F.when(decision, "TRUE_DUPLICATE").when(~decision, "FALSE_POSITIVE")


def append_new(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The store with those rows whose keys it hasn't; of rows that share keys the first in the order of all columns."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*(rest or keys)))).where("__n = 1").drop("__n")
    return store.unionByName(first.join(store.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def review_ledger(reviews: DataFrame, pair: str, decision: str, at: str, tie: str) -> DataFrame:
    """Reviews whose decision differs from the one before, with valid_to and is_active; the last of each pair is active."""
    w = W.partitionBy(pair).orderBy(at, tie)
    changed = reviews.withColumn("__before", F.lag(decision).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col("__before").eqNullSafe(F.col(decision))).drop("__before", "__n")
    return changed.withColumn("valid_to", F.lead(at).over(w)).withColumn("is_active", F.col("valid_to").isNull())


def consensus(reviews: DataFrame, pair: str, decision: str) -> DataFrame:
    """Of each pair: reviews, distinct decisions and the decision all agree on, null where they don't."""
    out = reviews.where(F.col(decision).isNotNull()).groupBy(pair).agg(F.count("*").alias("n_reviews"), F.countDistinct(decision).alias("n_decisions"), F.min(decision).alias("one"))
    return out.select(pair, "n_reviews", "n_decisions", F.when(F.col("n_decisions") == 1, F.col("one")).alias("consensus"))


def dataset_cut(pairs: DataFrame, negatives: int, key: str = "pair_id", is_positive: str = "label", band: str = "band") -> DataFrame:
    """All positives, and of the negatives a share of ``negatives`` for each band, chosen by hash: a sample by its nature."""
    quota = F.create_map(*[x for b, s in SHARES.items() for x in (F.lit(b), F.lit(int(round(negatives * s))))])
    w = W.partitionBy(band).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    low = pairs.where(~F.col(is_positive)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.coalesce(F.try_element_at(quota, F.col(band)), F.lit(0))).drop("__n")
    return pairs.where(F.col(is_positive)).unionByName(low)


def top_decile(scored: DataFrame, score: str, is_positive: str, key: str) -> DataFrame:
    """Share of positives in the top tenth by score (one row at least; ties by key), and the mean scores of both classes.

    Rows are parted by ranges of the score; those of ranges above the cut are counted whole and only the range of the cut is ranked.
    """
    spark = scored.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(scored.select(F.col(score).alias("s"), F.col(is_positive).alias("p"), F.col(key).alias("k")).repartitionByRange(parts, F.desc("s"), "k").withColumn("part", F.spark_partition_id()), "ranges")
    counts = sorted((r.part, r.n, r.hit) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("p").alias("hit")).collect())  # a row for each range
    total = sum(n for _, n, _ in counts)
    top, before, hits, at = max(total // 10, 1), 0, 0, -1
    for part, n, hit in counts:
        if before + n > top:
            at = part
            break
        before, hits = before + n, hits + hit
    rest = top - before
    edge = rows.where(F.col("part") == at).orderBy(F.desc("s"), "k").limit(max(rest, 0)).agg(F.count_if("p").alias("n"))
    means = rows.agg(F.avg(F.when(F.col("p"), F.col("s"))).alias("mean_positive"), F.avg(F.when(~F.col("p"), F.col("s"))).alias("mean_negative"), F.least(F.count("*"), F.lit(top)).alias("top_decile_rows"))
    return means.crossJoin(edge).where("top_decile_rows > 0").select("mean_positive", "mean_negative", ((F.col("n") + hits) / F.col("top_decile_rows")).alias("top_decile_positive_rate"), "top_decile_rows")


def reviewed_pairs(
    scores: DataFrame, pairs: DataFrame, runs: DataFrame, mitigated: DataFrame, cache: DataFrame, training_pairs: DataFrame | None = None, *,
    entity_type: str, team_id: str | None = None, run_selection: str = "latest", run_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Reviewed score rows of an entity type with their pair, run, mitigation, both cached entities and the training pair made of them before.

    ``run_selection`` is latest or all; ``run_id`` picks one run. Scores without a pair, run or cached entity are left out; of
    several mitigations of a pair in a run the greatest reason counts. pair_canonical_key joins both ids by ``|``; entity_a and entity_b
    are structs of the cache's columns. With ``limit``, the latest reviews.
    """
    if run_selection not in ("latest", "all"):
        raise ValueError(f"no such selection: {run_selection}")
    own = scores.where((F.col("entity_type") == entity_type) & F.col("is_duplicate").isNotNull())
    if team_id is not None:
        own = own.where(F.col("team_id") == team_id)
    if run_id is not None:
        own = own.where(F.col("run_id") == run_id)
    elif run_selection == "latest":
        own = own.join(F.broadcast(latest_run(own).select("run_id")), "run_id", "left_semi")  # one row
    reasons = mitigated.groupBy("pair_id", "run_id").agg(F.max("mitigation_reason").alias("mitigation_reason"))
    a, b = F.col("entity_a_id"), F.col("entity_b_id")
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    out = own.join(pairs.select("pair_id", a, b, key.alias("pair_canonical_key")), "pair_id").join(runs, "run_id").join(reasons, ["pair_id", "run_id"], "left")
    out = out.withColumn("was_mitigated", F.col("mitigation_reason").isNotNull())
    entity = F.struct(*cache.columns)
    for side in "ab":
        out = out.join(cache.select(F.col("entity_id").alias(f"entity_{side}_id"), entity.alias(f"entity_{side}")), f"entity_{side}_id")
    known = training_pairs.select("source_score_id", "training_pair_id") if training_pairs is not None else None
    none = F.lit(None).cast("string")
    out = out.join(known.select(F.col("source_score_id").alias("score_id"), F.col("training_pair_id").alias("existing_training_pair_id")), "score_id", "left") if known is not None else out.withColumn("existing_training_pair_id", none)
    return out.orderBy(F.desc("reviewed_at"), "score_id").limit(limit) if limit else out


def pipeline_signals(scores: DataFrame, reasons: DataFrame) -> DataFrame:
    """score_id and its reasons as an array of structs, ordered by type and value; empty where a score has none."""
    fields = [c for c in reasons.columns if c != "score_id"]
    ordered = sorted(fields, key=lambda c: (c != "match_type", c))
    own = reasons.join(scores.select("score_id"), "score_id", "left_semi").groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("pipeline_signals"))
    return scores.select("score_id").join(own, "score_id", "left").withColumn("pipeline_signals", F.coalesce("pipeline_signals", F.array().cast(own.schema["pipeline_signals"].dataType)))


def _number(c: str, default: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(default)), F.lit(default))


def baseline_score() -> Column:
    """The score without a model, of reviewed pairs: both section scores over the weights of both sections, 0 without weights."""
    weight = _number("weight_deterministic_section") + _number("weight_nlp_section")
    return F.when(weight > 0, (_number("deterministic_section_score") + _number("nlp_section_score")) / weight).otherwise(0.0)


def score_band() -> Column:
    """duplicate, maybe or below_maybe, by the baseline score and the thresholds of the run; a missing threshold is 1."""
    s = F.col("baseline_confidence_score")
    return F.when(s >= _number("duplicate_threshold", 1.0), "duplicate").when(s >= _number("maybe_threshold", 1.0), "maybe").otherwise("below_maybe")


def snapshot_id(entity: Column) -> Column:
    """Of an entity's state: the same for the same id and content, so a job that runs again adds nothing."""
    return F.sha2(F.concat_ws("|", entity["entity_id"], entity["content_hash"]), 256)


def snapshots(reviewed: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """A row for each entity state on either side of reviewed pairs that the store hasn't by (entity_id, content_hash); the first run that had it counts."""
    both = reviewed.select("run_id", F.explode(F.array("entity_a", "entity_b")).alias("e"))
    own = both.groupBy(snapshot_id(F.col("e")).alias("snapshot_id")).agg(F.min_by("e", "run_id").alias("e"), F.min("run_id").alias("source_run_id")).select("snapshot_id", "source_run_id", "e.*")
    return own if store is None else own.join(store.select("entity_id", "content_hash").distinct(), ["entity_id", "content_hash"], "left_anti").select(own.columns)


def training_pairs(reviewed: DataFrame, scope_id: str | None = None) -> DataFrame:
    """A training pair of each reviewed score row that none was made of before, with the baseline score, its predictions and the snapshots of both sides."""
    if not reviewed.where("score_id is null").isEmpty():
        raise ValueError("a reviewed score has no id")
    own = reviewed.where("existing_training_pair_id is null").withColumn("baseline_confidence_score", baseline_score())
    base, confidence = F.col("baseline_confidence_score"), _number("confidence_score")
    duplicate, maybe = _number("duplicate_threshold", 1.0), _number("maybe_threshold", 1.0)
    scores = ("deterministic_section_score", "nlp_section_score", "ml_section_score", "raw_deterministic_score", "raw_nlp_score", "raw_ml_score", "embedding_similarity")
    have = set(own.columns)
    return own.select(
        F.sha2(F.concat_ws("|", F.lit("training_pair"), "score_id"), 256).alias("training_pair_id"), snapshot_id(F.col("entity_a")).alias("entity_a_snapshot_id"), snapshot_id(F.col("entity_b")).alias("entity_b_snapshot_id"),
        "entity_a_id", "entity_b_id", "entity_type", "team_id", (F.lit(scope_id) if scope_id is not None else F.col("job_name")).alias("scope_id"), F.col("run_id").alias("source_run_id"), F.col("pair_id").alias("source_pair_id"),
        F.col("score_id").alias("source_score_id"), base, (base >= duplicate).alias("baseline_predicted_duplicate"), (base >= maybe).alias("baseline_predicted_maybe"), confidence.alias("confidence_score"),
        *[(_number(c) if c in have else F.lit(0.0)).alias(c) for c in scores], F.coalesce("predicted_duplicate", F.lit(False)).alias("predicted_duplicate"), (confidence >= maybe).alias("predicted_maybe"),
        "was_mitigated", "mitigation_reason", "pair_canonical_key", score_band().alias("baseline_score_band"),
    )


def feature_rows(pairs: DataFrame, features: DataFrame, entity_type: str, version: str, store: DataFrame | None = None) -> DataFrame:
    """Rows of training pairs with their model features (pair_canonical_key as pair_key) that the store hasn't by (pair, version)."""
    names = [c for c in features.columns if c != "pair_key"]
    own = pairs.join(features.withColumnRenamed("pair_key", "pair_canonical_key"), "pair_canonical_key").select(
        F.sha2(F.concat_ws("|", "training_pair_id", F.lit(version)), 256).alias("pair_feature_id"), "training_pair_id", F.lit(entity_type).alias("entity_type"), "team_id", "scope_id", "source_run_id", F.lit(version).alias("feature_schema_version"),
        "baseline_score_band", "baseline_confidence_score", *names,
    )
    return own if store is None else own.join(store.select("training_pair_id", "feature_schema_version"), ["training_pair_id", "feature_schema_version"], "left_anti").select(own.columns)


_CONFIDENCE = ("LOW", "MEDIUM", "HIGH")


def resolved_labels(reviews: DataFrame, min_confidence: str | None = None, include_unsure: bool = False) -> DataFrame:
    """training_pair_id, label, label_source and review_id of pairs whose active reviews agree.

    One review is SINGLE_REVIEW, several that agree are CONSENSUS without a review id; pairs with different decisions are left
    out, as are SKIP, UNSURE unless asked for, and reviews below the least confidence (one that isn't stated is the lowest).
    """
    own = reviews.where(F.col("is_active") & F.col("review_decision").isNotNull() & (F.col("review_decision") != "SKIP"))
    if not include_unsure:
        own = own.where("review_decision <> 'UNSURE'")
    if min_confidence is not None:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in _CONFIDENCE]), F.upper("reviewer_confidence")), F.lit(0))
        own = own.where(rank > _CONFIDENCE.index(min_confidence))
    n = own.groupBy("training_pair_id").agg(F.count("*").alias("n"), F.min("review_decision").alias("label"), F.max("review_decision").alias("other"), F.min("review_id").alias("review_id"))
    return n.where("label = other").select("training_pair_id", "label", F.when(F.col("n") == 1, "SINGLE_REVIEW").otherwise("CONSENSUS").alias("label_source"), F.when(F.col("n") == 1, F.col("review_id")).alias("review_id"))


def active_labels(reviews: DataFrame) -> DataFrame:
    """The latest active review of each pair, ties by the greater id."""
    w = W.partitionBy("training_pair_id").orderBy(F.desc("reviewed_at"), F.desc("review_id"))
    return reviews.where("is_active").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def disagreements(reviews: DataFrame) -> DataFrame:
    """Pairs whose active reviews differ, with all their decisions."""
    own = reviews.where(F.col("is_active") & F.col("review_decision").isNotNull()).groupBy("training_pair_id").agg(F.array_sort(F.collect_set("review_decision")).alias("decisions"), F.count("*").alias("n_reviews"))
    return own.where(F.size("decisions") > 1)


def unlabeled(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs without an active review, the highest baseline score first."""
    return pairs.join(reviews.where("is_active").select("training_pair_id"), "training_pair_id", "left_anti").orderBy(F.desc("baseline_confidence_score"), "training_pair_id")


_SNAPSHOT = "snapshot_id entity_id entity_type source_schema original_id content_hash captured_at source_run_id resource_writer_name assured_date assurer_email last_updated"
_TYPED = "snapshot_id name alternate_name description short_description email phones websites locations taxonomies identifiers services organization_id organization_name application_process fees_description eligibility_description embedding_vector embedding_model_version"
_FEATURES = "pair_feature_id training_pair_id entity_type team_id scope_id source_run_id feature_schema_version baseline_score_band baseline_confidence_score"
#: The columns of each table of the training store.
TABLES: dict[str, tuple[str, ...]] = {
    "entity_snapshot": tuple(_SNAPSHOT.split()), "organization_snapshot": tuple(_TYPED.split()), "service_snapshot": tuple(_TYPED.split()),
    "training_pair": tuple(
        """training_pair_id entity_a_snapshot_id entity_b_snapshot_id entity_a_id entity_b_id entity_type team_id scope_id source_run_id source_pair_id source_score_id baseline_confidence_score
        baseline_predicted_duplicate baseline_predicted_maybe confidence_score deterministic_section_score nlp_section_score ml_section_score raw_deterministic_score raw_nlp_score raw_ml_score
        embedding_similarity predicted_duplicate predicted_maybe was_mitigated mitigation_reason pipeline_signals pipeline_config_snapshot pipeline_policy_version pipeline_model_version
        pair_canonical_key created_at""".split()
    ),
    "pair_review": tuple("review_id training_pair_id source_score_id review_source reviewed_by review_session_id review_decision reviewer_confidence review_notes is_active superseded_by superseded_at reviewed_at".split()),
    "training_dataset": tuple("dataset_id dataset_name dataset_version description entity_type is_active created_at created_by total_pairs true_duplicate_count false_positive_count unsure_count".split()),
    "training_dataset_member": tuple("dataset_id training_pair_id label label_source review_id added_at added_by".split()),
    "organization_pair_features": (*_FEATURES.split(), *MODEL_FEATURES["organization"], "created_at"), "service_pair_features": (*_FEATURES.split(), *MODEL_FEATURES["service"], "created_at"),
}


def missing_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """What each table of the store lacks of its columns; a table that isn't there lacks all of them."""
    have = {n: {c.lower() for c in df.columns} for n, df in tables.items()}
    return {n: lost for n, columns in TABLES.items() if (lost := [c for c in columns if c not in have.get(n, set())])}


def _kind(column: str) -> str:
    if column.endswith(("_at", "_date")) or column == "last_updated":
        return "timestamp"
    if column.startswith(("is_", "was_", "predicted_", "baseline_predicted_")):
        return "boolean"
    if column in ("total_pairs",) or column.endswith("_count") and not column.startswith(("shared_", "token_", "total_t")):
        return "bigint"
    if column == "embedding_vector":
        return "array<double>"
    return "double" if column in {f for names in MODEL_FEATURES.values() for f in names} or column.endswith(("_score", "_similarity")) else "string"


def create_tables(spark: SparkSession, folder: str) -> list[str]:
    """Empty Parquet tables in folder for those of the store that aren't there; their names."""
    made = []
    for name, columns in TABLES.items():
        try:
            spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            spark.createDataFrame([], ", ".join(f"{c} {_kind(c)}" for c in columns)).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made
