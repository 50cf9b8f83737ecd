"""The operators over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import Config
from .functions import domain, fuzzy, taxonomy, text
from .operators import block, clean, cluster, mitigate, score, training
from .plans.incremental import run_incremental, run_summary
from .registry import QUERIES, SQL, query
from .schemas import empty
from .storage import written
from .sources.testbed import WITH, WITH_PAIRS, entities, flat_entities, table

_CLEAN = r"trim(regexp_replace(lower(coalesce({}, '')), '[\s\p{{Z}}]+', ' ', 'g'))"


def _c(x: str) -> str:
    return _CLEAN.format(x)


def _by_nation(customers, suppliers):
    """Customers with the suppliers of their nation: a product for each of few nations.

    Customers are spread over the cluster whatever their nation, and the fewer suppliers sent to each executor: by nation, a few tasks
    would make all pairs. Pairs are streamed; there are too many of them long before the suppliers are too many to send.
    """
    spread = customers.repartition(4 * customers.sparkSession.sparkContext.defaultParallelism, "c_custkey")
    return spread.join(F.broadcast(suppliers), F.col("c_nationkey") == F.col("s_nationkey"))


# text, hashes, identifiers


@query(f"SELECT doc_id, md5({_c('text')}) AS cleaned FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_brand), lower(p_type), lower(p_name), lower(p_brand)])), '|') AS listed FROM part")
def list_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.clean_list(F.array("p_brand", "p_type", "p_name", F.upper("p_brand"), F.lit(" "))), "|").alias("listed"))


@query(f"SELECT doc_id, sha256(concat_ws('||', {_c('lang')}, {_c('source')}, {_c('text')})) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.hash_values(F.col("lang"), F.col("source"), F.col("text")).alias("content_hash"))


@query("SELECT c_custkey, s_suppkey, CASE WHEN c_name < s_name THEN c_name || '__' || s_name ELSE s_name || '__' || c_name END AS pair_key FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal < s_acctbal")
def canonical_pairs(spark, d):
    pairs = _by_nation(table(spark, d, "customer"), table(spark, d, "supplier")).where("c_acctbal < s_acctbal")
    return pairs.select("c_custkey", "s_suppkey", text.pair_key(F.col("c_name"), F.col("s_name")).alias("pair_key"))


@query("""SELECT s_suppkey, array_to_string([x FOR x IN [CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ' north main street' ELSE s_suppkey || ' main avenue' END, replace(lower(n_name), '_', ' '), lower(r_name)] IF x <> ''], '|') AS address
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def address_canonical(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    street = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(" ", "s_suppkey", F.lit("N. Main St."))).otherwise(F.concat_ws(" ", "s_suppkey", F.lit("Main  AVE")))
    place = F.struct(street.alias("address_1"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.lit(None).cast("string").alias("postal_code"))
    return s.select("s_suppkey", F.array_join(text.canonical_addresses(F.array(place)), ";").alias("address"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'npi|' || lower(s_name) END AS identifiers FROM supplier")
def identifier_canonical(spark, d):
    own = F.struct(F.lit(" NPI ").alias("system"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("value"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(text.canonical_identifiers(F.array(own)), ";").alias("identifiers"))


@query("SELECT c_custkey, lower(n_name) || '/' || lower(r_name) AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def location_keys(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = text.location_keys(F.array(F.struct(F.col("n_name").alias("city"), F.col("r_name").alias("state"))))
    return c.select("c_custkey", F.replace(F.array_join(keys, ";"), F.lit("\x01"), F.lit("/")).alias("location"))


@query("""WITH s AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1)
SELECT a.k, round(len(list_intersect(a.p, b.p)) / greatest(len(a.p), len(b.p)), 6) AS ratio FROM s a JOIN s b ON b.k = a.k + 1""")
def overlap_ratio(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"))
    o = s.select((F.col("k") - 1).alias("k"), F.col("p").alias("q"))
    return s.join(o, "k").select("k", F.round(text.overlap_ratio(F.col("p"), F.col("q")), 6).alias("ratio"))


# deltas

_SNAPSHOTS = """WITH cur AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0),
prior AS (SELECT o_orderkey AS id, o_orderstatus AS h, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 11 <> 0 END AS active FROM orders WHERE o_orderkey % 4 <> 0),
act AS (SELECT * FROM prior WHERE coalesce(active, true)),
delta AS (SELECT cur.id, CASE WHEN act.id IS NULL THEN 'added' WHEN act.h <> lower(cur.h) AND lower(act.h) <> lower(cur.h) THEN 'changed' ELSE 'unchanged' END AS delta_class FROM cur LEFT JOIN act ON cur.id = act.id),
gone AS (SELECT id FROM act WHERE id NOT IN (SELECT id FROM cur))"""


def _snapshots(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entity_id"), F.lit("order").alias("entity_type"), F.col("o_orderkey").alias("k"), F.lower("o_orderstatus").alias("h"))
    current = o.where("k % 7 <> 0").withColumn("content_hash", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("h")))
    prior = o.where("k % 4 <> 0").withColumn("content_hash", F.upper("h")).withColumn("active_flag", F.when(F.col("k") % 3 != 0, F.col("k") % 11 != 0))
    return clean.classify(current, prior)


@query(_SNAPSHOTS + " SELECT id, delta_class FROM delta")
def delta_classify(spark, d):
    return _snapshots(spark, d)[0].select(F.col("entity_id").cast("long").alias("id"), "delta_class")


@query(_SNAPSHOTS + " SELECT id FROM gone")
def removed_entities(spark, d):
    return _snapshots(spark, d)[1].select(F.col("entity_id").cast("long").alias("id"))


@query(_SNAPSHOTS + """ SELECT count(*) FILTER (delta_class = 'added') AS added, count(*) FILTER (delta_class = 'changed') AS changed, count(*) FILTER (delta_class = 'unchanged') AS unchanged,
(SELECT count(*) FROM gone) AS removed, false AS no_change FROM delta""")
def delta_summary(spark, d):
    return clean.delta_summary(*_snapshots(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, count(*) FILTER (o_custkey IS NULL) AS n_missing FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT l_orderkey, NULL FROM lineitem)")
def union_relaxed(spark, d):
    o, x = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.unionByName(x, allowMissingColumns=True).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"), F.count_if(F.col("o_custkey").isNull()).alias("n_missing"))


# domains and taxonomies

_HOST = r"regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':\d*$', ''), '^www\.', '')"
_SITE = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def domain_extract(spark, d):
    return table(spark, d, "pages").select("page_id", domain.extract_domain(F.col("url")).alias("host"))


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_matches(lower(url), '^[a-z]+://[^/?#]*/[^?#]') AS path FROM pages), s AS (SELECT *, {_SITE} AS site FROM p)
SELECT a.page_id, CASE WHEN a.host = b.host AND NOT a.path AND NOT b.path THEN 1.0 WHEN a.host = b.host THEN 0.8 WHEN a.site = b.site THEN 0.4 ELSE 0.0 END::DOUBLE AS tier FROM s a JOIN s b ON b.page_id = a.page_id + 1""")
def domain_tiers(spark, d):
    p = table(spark, d, "pages").select("page_id", domain.domain_tokens(F.array().cast("array<string>"), F.array("url")).alias("t"))
    o = p.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("u"))
    return p.join(o, "page_id").select("page_id", domain.domain_overlap(F.col("t"), F.col("u")).cast("double").alias("tier"))


_CODE = "lower(substr(p_type, 1, 2)) || '-' || (p_size % 50 * 10) || '.' || (p_partkey % 3)"


def _codes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("-"), (F.col("p_size") % 50 * 10).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string")).alias("code"))


_LEVELS = "list_distinct([substr(c, 1, 1), substr(c, 1, 2), split_part(c, '.', 1), c])"


@query(f"WITH p AS (SELECT p_partkey, {_CODE} AS c FROM part) SELECT p_partkey, substr(c, 1, 1) || ' ' || substr(c, 1, 2) || ' ' || split_part(c, '.', 1) || ' ' || c AS levels, split_part(c, '.', 1) AS parent FROM p")
def taxonomy_levels(spark, d):
    return _codes(spark, d).select("p_partkey", F.array_join(taxonomy.levels(F.col("code")), " ").alias("levels"), taxonomy.parent(F.col("code")).alias("parent"))


@query(f"""WITH p AS (SELECT p_partkey AS k, {_CODE} AS c FROM part), x AS (SELECT a.k, {_LEVELS.replace('c,', 'a.c,').replace('c])', 'a.c])')} AS u, {_LEVELS.replace('c,', 'b.c,').replace('c])', 'b.c])')} AS v, a.c AS ca, b.c AS cb FROM p a JOIN p b ON b.k = a.k + 1)
SELECT k, CASE WHEN len(list_intersect(u, v)) > 0 THEN round(pow(0.7, greatest(len(u), len(v)) - len(list_intersect(u, v))), 6) ELSE 0.0 END AS score, ca = cb AS related FROM x""")
def taxonomy_score(spark, d):
    c = _codes(spark, d).withColumnRenamed("p_partkey", "k")
    o = c.select((F.col("k") - 1).alias("k"), F.col("code").alias("other"))
    return c.join(o, "k").select("k", F.round(taxonomy.pair_score(F.col("code"), F.col("other")), 6).alias("score"), taxonomy.related(F.col("code"), F.col("other")).alias("related"))


# names


def _neighbours(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("a"))
    return p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")


@query()
def name_ratios(spark, d):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, d).select("k", F.round(fuzzy.sequence_ratio(a, b), 6).alias("ratio"), F.round(fuzzy.token_sort_ratio(a, b), 6).alias("token_sort"), F.round(fuzzy.jaro_winkler_score(a, b), 6).alias("jaro_winkler"))


@query("""SELECT c_custkey, s_suppkey, list_sort(list_distinct(regexp_extract_all(c_name, '\\d+'))) <> list_sort(list_distinct(regexp_extract_all(s_name, '\\d+'))) AS veto
FROM customer JOIN supplier ON c_nationkey = s_nationkey""")
def number_veto(spark, d):
    c, s = table(spark, d, "customer").withColumn("x", fuzzy.numbers(F.col("c_name"))), table(spark, d, "supplier").withColumn("y", fuzzy.numbers(F.col("s_name")))
    return _by_nation(c, s).select("c_custkey", "s_suppkey", fuzzy.numbers_differ(F.col("x"), F.col("y")).alias("veto"))


fuzzy.ALGORITHMS["equal"] = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)

# blocking and scoring of the derived entities


def _config() -> Config:
    return Config.from_overrides({"nlp": {"algorithm": "equal", "number_veto": False}}, "service")


def _entities(spark, d):
    return clean.clean_entities(entities(spark, d), "service")


def _candidates(spark, d, plan="gate"):
    e = written(_entities(spark, d))
    return block.candidates(e, e.select("entity_id", "entity_type", F.lit("added").alias("delta_class")), _config().blocking, plan=plan), e


_CANDIDATES = WITH_PAIRS + " SELECT a, b, round(sim, 5) AS similarity FROM pairs"


@query(_CANDIDATES)
def gate_first_pairs(spark, d):
    return _candidates(spark, d)[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round("embedding_similarity", 5).alias("similarity"))


@query(_CANDIDATES)
def cosine_first_pairs(spark, d):
    return _candidates(spark, d, "cosine")[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round("embedding_similarity", 5).alias("similarity"))


@query(WITH + """, s AS (SELECT a.id AS anchor, b.id AS other, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS sim FROM ent a JOIN ent b ON a.id <> b.id WHERE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(sim, 6) DESC, other) AS rank FROM s) SELECT anchor, other, rank FROM r WHERE rank <= 1""")
def cosine_topk(spark, d):
    e = written(_entities(spark, d))
    near = block.cosine_first(e, e, 0.75, best=1).withColumn("similarity", F.round("similarity", 6))
    return block.top_k(near, 1).select("anchor", "other", F.col("rank").cast("long").alias("rank"))


_OVERVIEW = WITH + """, near AS MATERIALIZED (SELECT *, tax AND other_evidence AS passed FROM (SELECT a.id AS anchor, b.id AS other, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS sim,
  a.code = b.code OR (strpos(a.code, '-') = 0 AND split_part(b.code, '-', 1) = a.code) OR (strpos(b.code, '-') = 0 AND split_part(a.code, '-', 1) = b.code) AS tax, a.email = b.email OR a.phone = b.phone OR (a.city = b.city AND a.state = b.state) AS other_evidence
  FROM ent a JOIN ent b ON a.id <> b.id WHERE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= 0.75)),
r AS MATERIALIZED (SELECT *, coalesce(sum(passed::INT) OVER (PARTITION BY anchor ORDER BY sim DESC, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM near),
p AS (SELECT ent.id, coalesce(count(anchor) FILTER (before < 2), 0) AS examined, coalesce(count(*) FILTER (before < 2 AND passed), 0) AS kept, count(anchor) FILTER (before >= 2) AS truncated, min(sim) FILTER (before < 2 AND passed) AS last,
  count(*) FILTER (before < 2 AND NOT tax AND other_evidence) AS t, count(*) FILTER (before < 2 AND tax AND NOT other_evidence) AS o, count(*) FILTER (before < 2 AND NOT tax AND NOT other_evidence) AS b FROM ent LEFT JOIN r ON anchor = ent.id GROUP BY 1),
c AS (SELECT count(*) AS active_anchors, count(*) FILTER (examined > 0) AS anchors_with_above_threshold, count(*) FILTER (kept > 0) AS anchors_with_retained_candidates, count(*) FILTER (kept >= 2) AS anchors_at_candidate_cap, sum(examined)::BIGINT AS above_threshold_examined,
  sum(truncated)::BIGINT AS truncated_above_threshold, round(sum(last), 4) AS last_retained_similarity_sum, count(last) AS last_retained_similarity_count, sum(t)::BIGINT AS taxonomy_failed, sum(o)::BIGINT AS non_taxonomy_failed, sum(b)::BIGINT AS both_failed,
  (SELECT count(*) FROM (SELECT DISTINCT least(anchor, other), greatest(anchor, other) FROM r WHERE before < 2 AND passed)) AS pairs_kept, sum(t + o + b)::BIGINT AS overlap_blocked FROM p),
q AS (SELECT *, active_anchors - anchors_with_above_threshold AS no_above_threshold, anchors_with_above_threshold - anchors_with_retained_candidates AS above_threshold_but_no_retained, round(last_retained_similarity_sum / last_retained_similarity_count, 4) AS avg_last_retained_similarity,
  round(truncated_above_threshold / anchors_at_candidate_cap, 4) AS avg_truncated_per_capped, round(100 * anchors_at_candidate_cap / active_anchors, 1) AS percent_anchors_at_candidate_cap FROM c),
z AS (SELECT *, round(100 * no_above_threshold / active_anchors, 1) AS percent_no_above_threshold, round(100 * above_threshold_but_no_retained / active_anchors, 1) AS percent_above_threshold_but_no_retained FROM q)
SELECT kind AS entity_type, *, coalesce(nullif(concat_ws(',', CASE WHEN percent_no_above_threshold >= 20 THEN 'threshold_may_be_high' END, CASE WHEN percent_above_threshold_but_no_retained >= 20 THEN 'overlap_prefilter_may_be_strict' END,
  CASE WHEN percent_anchors_at_candidate_cap >= 20 THEN 'max_candidates_may_be_low' END), ''), 'no_obvious_blocking_pressure') AS heuristic FROM z, (VALUES ('service'), ('all')) AS v(kind)"""


@query(_OVERVIEW.replace("SELECT kind AS entity_type, *,", "SELECT kind AS entity_type, * EXCLUDE (kind),"))
def blocking_overview(spark, d):
    e = written(_entities(spark, d))
    settings = replace(_config().blocking, max_candidates=2)
    near = block.cosine_first(e, e, settings.similarity_threshold).withColumn("similarity", F.round("similarity", 6))
    out = block.overview(written(near), e, e, settings)
    rounded = ("last_retained_similarity_sum", "avg_last_retained_similarity", "avg_truncated_per_capped")
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query(WITH + """, f AS (SELECT list_transform(list_slice(vec, 1, 8), lambda x: round(x::DOUBLE, 3)) AS p FROM ent) SELECT 'service' AS entity_type, count(*) AS total, count(DISTINCT p) AS unique_embeddings, round(100 * (1 - count(DISTINCT p) / count(*)), 1) AS shared_percent FROM f""")
def embedding_uniqueness(spark, d):
    return block.embedding_uniqueness(_entities(spark, d))


_DET = "(0.16 * same_email::INT + 0.22 * same_phone::INT + 0.04 * same_host::INT + 0.12 * tax + 0.34 * same_place::INT) / 0.88"
_SCORED = WITH_PAIRS + f""", det AS (SELECT *, least(1.0, {_DET}) AS det, (na = nb)::INT AS nlp FROM pairs),
scored AS (SELECT *, (0.4 * det + 0.4 * nlp) / 0.8 AS final, -0.25 + det * 0.88 + 0.4 * nlp AS odds FROM det),
tiered AS MATERIALIZED (SELECT *, CASE WHEN final >= 0.7 THEN 'duplicate' WHEN final >= 0.62 THEN 'maybe' ELSE 'below_maybe' END AS outcome FROM scored)"""


def _scored(spark, d):
    c, e = _candidates(spark, d)
    s, r = score.score_candidates(written(c), e, _config())
    return written(s), written(r)


@query(_SCORED + " SELECT a, b, round(det, 9) AS det FROM tiered")
def deterministic_score(spark, d):
    return _scored(spark, d)[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round("deterministic_section_score", 9).alias("det"))


@query(_SCORED + " SELECT a, b, round(final, 9) AS final, outcome FROM tiered")
def final_score_tier(spark, d):
    return _scored(spark, d)[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round("final_score", 9).alias("final"), F.col("pair_outcome").alias("outcome"))


@query(_SCORED + " SELECT a, b, round(1 / (1 + exp(-odds)), 9) AS confidence FROM tiered")
def shadow_confidence(spark, d):
    return _scored(spark, d)[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round("shadow_confidence_score", 9).alias("confidence"))


_REASONS = _SCORED + """, reasons AS (SELECT a, b, outcome, odds, x.m AS match_type, x.w AS weighted FROM (SELECT a, b, outcome, odds, unnest([{'m': 'shared_email', 'w': 0.16 * same_email::INT}, {'m': 'shared_phone', 'w': 0.22 * same_phone::INT},
{'m': 'shared_domain', 'w': 0.04 * same_host::INT}, {'m': 'shared_taxonomy', 'w': 0.12 * tax}, {'m': 'shared_address', 'w': 0.34 * same_place::INT}, {'m': 'name_similarity', 'w': nlp::DOUBLE}]) AS x FROM tiered) WHERE x.w > 0)"""


@query(_SCORED + """, r AS (SELECT a, b, unnest([{'m': 'shared_email', 'raw': same_email::INT::DOUBLE, 'w': 0.16, 'v': ea, 'x': ea, 'y': eb, 's': NULL::DOUBLE}, {'m': 'shared_phone', 'raw': same_phone::INT::DOUBLE, 'w': 0.22, 'v': pa, 'x': pa, 'y': pb, 's': NULL},
{'m': 'shared_domain', 'raw': same_host::INT::DOUBLE, 'w': 0.04, 'v': split_part(ea, '@', 2), 'x': split_part(ea, '@', 2), 'y': split_part(eb, '@', 2), 's': NULL}, {'m': 'shared_taxonomy', 'raw': tax, 'w': 0.12, 'v': tax_value, 'x': ca, 'y': cb, 's': tax},
{'m': 'shared_address', 'raw': same_place::INT::DOUBLE, 'w': 0.34, 'v': la, 'x': la, 'y': lb, 's': NULL}, {'m': 'name_similarity', 'raw': nlp::DOUBLE, 'w': 1.0, 'v': NULL, 'x': na, 'y': nb, 's': nlp::DOUBLE}]) AS z FROM tiered)
SELECT a, b, z.m AS match_type, z.raw AS raw_contribution, round(z.raw * z.w, 9) AS weighted_contribution, z.w::DOUBLE AS signal_weight, z.v AS matched_value, z.x AS entity_a_value, z.y AS entity_b_value, z.s AS similarity_score FROM r WHERE z.raw > 0""")
def pair_reasons(spark, d):
    ids = F.split("pair_key", "__")
    r = _scored(spark, d)[1]
    return r.select(ids[0].alias("a"), ids[1].alias("b"), "match_type", "raw_contribution", F.round("weighted_contribution", 9).alias("weighted_contribution"), "signal_weight", "matched_value", "entity_a_value", "entity_b_value", "similarity_score")


@query(_REASONS + " SELECT a || '__' || b AS pair_key, count(*) AS reason_count FROM reasons GROUP BY a, b")
def reason_count(spark, d):
    return score.reason_counts(_scored(spark, d)[1])


@query(_REASONS + """ SELECT match_type, count(*) AS total, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'maybe') AS maybe, count(*) FILTER (outcome = 'below_maybe') AS below_maybe
FROM reasons WHERE match_type <> 'shared_taxonomy' GROUP BY 1""")
def signal_bands(spark, d):
    return score.signal_bands(*_scored(spark, d))


_COUNTED = _REASONS + """, n AS (SELECT a, b, count(*) FILTER (match_type <> 'shared_taxonomy') AS signal_count FROM reasons GROUP BY a, b), g AS (SELECT t.outcome, t.final >= 0.5 AS gated, coalesce(signal_count, 0) AS signal_count FROM tiered t LEFT JOIN n ON t.a = n.a AND t.b = n.b)"""


@query(_COUNTED + """ SELECT signal_count, count(*) AS total, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'maybe') AS maybe, count(*) FILTER (outcome = 'below_maybe') AS below_maybe,
round(100 * count(*) FILTER (gated) / count(*), 1) AS gate_pass_percent FROM g GROUP BY 1""")
def signal_counts(spark, d):
    return score.signal_counts(*_scored(spark, d), _config())


@query(_COUNTED + " SELECT count(*) FILTER (signal_count >= 2 AND NOT gated) AS missed FROM g")
def gate_misses(spark, d):
    return score.gate_misses(*_scored(spark, d), _config())


@query(_SCORED + """ SELECT round(avg(final), 6) AS legacy_mean, round(avg(1 / (1 + exp(-odds))), 6) AS shadow_mean, count(*) FILTER (final >= 0.999) AS legacy_perfect, count(*) FILTER (1 / (1 + exp(-odds)) >= 0.95) AS shadow_near_perfect FROM tiered""")
def confidence_report(spark, d):
    r = score.confidence_report(_scored(spark, d)[0])
    return r.select(F.round("legacy_mean", 6).alias("legacy_mean"), F.round("shadow_mean", 6).alias("shadow_mean"), "legacy_perfect", "shadow_near_perfect")


@query(_REASONS + """, p AS (SELECT a, b, string_agg(match_type, '|' ORDER BY match_type) AS pattern FROM reasons WHERE 1 / (1 + exp(-odds)) >= 0.7 GROUP BY a, b)
SELECT pattern, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, pattern LIMIT 5""")
def reason_patterns(spark, d):
    return score.reason_patterns(*_scored(spark, d), least=0.7)


@query(_SCORED + " SELECT count(*) AS scored, 0::BIGINT AS ml_scored, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'maybe') AS maybe, count(*) FILTER (outcome <> 'below_maybe') AS retained FROM tiered")
def score_summary(spark, d):
    return score.score_summary(_scored(spark, d)[0])


# mitigation and state: entities whose number is a multiple of 10 are gone, those of 3 changed, earlier pairs are all scored ones of even numbers and some invented ones

_STATE = _REASONS + """, gone AS MATERIALIZED (SELECT id FROM ent WHERE CAST(substr(id, 2) AS INT) % 10 = 0), hit AS MATERIALIZED (SELECT id FROM ent WHERE CAST(substr(id, 2) AS INT) % 3 = 0 OR CAST(substr(id, 2) AS INT) % 10 = 0),
n AS MATERIALIZED (SELECT a, b, count(*) AS reason_count FROM reasons GROUP BY a, b),
x AS MATERIALIZED (SELECT t.*, t.a IN (FROM gone) AS ga, t.b IN (FROM gone) AS gb, n.reason_count FROM tiered t JOIN n ON t.a = n.a AND t.b = n.b),
el AS MATERIALIZED (SELECT *, outcome <> 'below_maybe' AND why IS NULL AS eligible FROM (SELECT a, b, final, sim, outcome, CASE WHEN ga OR gb THEN 'entity_deleted' WHEN outcome = 'duplicate' AND sim < 0.9999 AND reason_count < 5 THEN 'low_evidence_override' END AS why FROM x)),
prior AS MATERIALIZED (SELECT a, b FROM tiered WHERE CAST(substr(a, 2) AS INT) % 2 = 0 UNION ALL SELECT id, 'z' || id FROM ent WHERE CAST(substr(id, 2) AS INT) % 13 = 0),
flagged AS MATERIALIZED (SELECT p.a, p.b, p.a IN (FROM gone) AS ga, p.b IN (FROM gone) AS gb, p.a IN (FROM hit) AS ha, p.b IN (FROM hit) AS hb FROM prior p), aff AS MATERIALIZED (SELECT * FROM flagged WHERE ha OR hb),
removed AS (SELECT a, b, why AS reason FROM el WHERE why IS NOT NULL UNION ALL
  SELECT p.a, p.b, CASE WHEN p.ga OR p.gb THEN 'entity_deleted' WHEN el.a IS NULL THEN 'candidate_lost' ELSE 'score_dropped' END FROM aff p LEFT JOIN el ON p.a = el.a AND p.b = el.b WHERE NOT coalesce(el.eligible, false) AND el.why IS NULL)"""


def _mitigated(spark, d, scope_removed=False):
    config = Config.from_overrides({"nlp": {"algorithm": "equal", "number_veto": False}, "mitigation": {"enabled": True, "min_embedding_similarity": 0.9999, "min_reasons": 5}}, "service")
    s, r = _scored(spark, d)
    n = F.substring("id", 2, 9).try_cast("int")  # the planner infers this on other ids, too
    ids = written(flat_entities(spark, d).select("id", n.alias("n")))
    gone, hit = ids.where("n % 10 = 0").select(F.col("id").alias("entity_id")), ids.where("n % 10 = 0 or n % 3 = 0").select(F.col("id").alias("entity_id"))
    prior = s.where(F.substring("entity_a_id", 2, 9).try_cast("int") % 2 == 0).select("entity_a_id", "entity_b_id").unionByName(ids.where("n % 13 = 0").select(F.col("id").alias("entity_a_id"), F.concat(F.lit("Z"), "id").alias("entity_b_id")))
    return mitigate.apply_mitigation(s, r, gone, prior.withColumn("retained_flag", F.lit(True)).withColumn("entity_type", F.lit("service")), config, hit, scope_removed)


@query(_STATE + " SELECT a || '__' || b AS pair_key, why AS mitigation_reason, eligible AS review_eligible FROM el")
def mitigation(spark, d):
    return _mitigated(spark, d).finalized.select("pair_key", "mitigation_reason", "review_eligible")


@query(_STATE + " SELECT a || '__' || b AS pair_key, reason AS cleanup_reason FROM removed")
def reconcile(spark, d):
    return _mitigated(spark, d).removed


@query(_STATE + " SELECT reason AS cleanup_reason, count(*) AS n FROM removed GROUP BY 1")
def cleanup_histogram(spark, d):
    return mitigate.cleanup_histogram(_mitigated(spark, d).removed)


@query(_STATE + " SELECT a || '__' || b AS pair_key FROM el WHERE eligible UNION SELECT a || '__' || b FROM flagged WHERE NOT (ha OR hb)")
def state_merge(spark, d):
    return _mitigated(spark, d).state.select("pair_key")


@query(_STATE + " SELECT a || '__' || b AS pair_key, 'scope_removed' AS cleanup_reason FROM prior")
def scope_removed(spark, d):
    return _mitigated(spark, d, True).removed


# graph and queue


@query(_SCORED + " SELECT a, b, round(CASE WHEN final >= 0.62 THEN (final - 0.62) / 0.38 ELSE (final - 0.62) / 0.62 END, 9) AS weight FROM tiered")
def signed_edges(spark, d):
    return _scored(spark, d)[0].select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.round(cluster.signed_weight(F.col("final_score"), 0.62), 9).alias("weight"))


_COMPONENTS = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + """, edge AS (SELECT a AS u, b AS v FROM tiered WHERE final > 0.62 UNION SELECT b, a FROM tiered WHERE final > 0.62),
walk AS (SELECT u AS node, u AS seen FROM edge UNION SELECT walk.node, edge.v FROM walk JOIN edge ON walk.seen = edge.u), comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1)"""


@query(_COMPONENTS + " SELECT node, component FROM comp")
def components(spark, d):
    s = _scored(spark, d)[0].where("final_score > 0.62")
    return cluster.components(s.select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")))


@query(_COMPONENTS + """, w AS (SELECT x.component, final, CASE WHEN final >= 0.7 THEN (final - 0.7) / 0.3 ELSE (final - 0.7) / 0.7 END AS w FROM tiered JOIN comp x ON x.node = a JOIN comp y ON y.node = b AND y.component = x.component WHERE outcome <> 'below_maybe'),
z AS (SELECT component, count(*) AS cluster_size FROM comp GROUP BY 1)
SELECT component, any_value(cluster_size) AS cluster_size, count(*) AS pair_count, round(avg(final), 6) AS avg_score, round(max(final), 6) AS max_score, round(min(final), 6) AS min_score, round(sum(w), 6) AS objective,
round(sum(greatest(w, 0)), 6) AS positive, round(sum(greatest(-w, 0)), 6) AS negative, round(sum(greatest(-w, 0)) / any_value(cluster_size), 6) AS risk FROM w JOIN z USING (component) GROUP BY component""")
def cluster_stats(spark, d):
    s = _scored(spark, d)[0]
    c = cluster.components(s.where("final_score > 0.62").select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")))
    own = c.select(F.lit("service").alias("entity_type"), F.col("component").alias("cluster_id"), "node")
    r = lambda c, n: F.round(c, 6).alias(n)
    stats = cluster.cluster_stats(s.where("review_eligible"), own, _config())[0]
    return stats.select(
        F.col("cluster_id").alias("component"), "cluster_size", "pair_count", r("avg_confidence_score", "avg_score"), r("max_confidence_score", "max_score"), r("min_confidence_score", "min_score"),
        r("objective_score", "objective"), r("positive_edge_sum", "positive"), r("negative_edge_penalty", "negative"), r("cluster_risk_score", "risk"),
    )


@query()
def correlation_clusters(spark, d):
    return cluster.correlation_clusters(_scored(spark, d)[0], _config())


def _clustered(spark, d):
    s = _scored(spark, d)[0]
    c = cluster.components(s.where("final_score > 0.62").select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")))
    own = c.select(F.lit("service").alias("entity_type"), F.col("component").alias("cluster_id"), "node")
    return s, *cluster.cluster_stats(s.where("review_eligible"), own, _config())


_QUEUE = _COMPONENTS + """, w AS (SELECT x.component, a, b, CASE WHEN final >= 0.7 THEN (final - 0.7) / 0.3 ELSE (final - 0.7) / 0.7 END AS w FROM tiered JOIN comp x ON x.node = a JOIN comp y ON y.node = b AND y.component = x.component WHERE outcome <> 'below_maybe'),
z AS (SELECT component, count(*) AS cluster_size FROM comp GROUP BY 1), risk AS (SELECT component, sum(greatest(-w, 0)) / any_value(cluster_size) AS risk FROM w JOIN z USING (component) GROUP BY 1)"""


@query(_QUEUE + """ SELECT t.a || '__' || t.b AS pair_key, t.a AS entity_a_id, t.b AS entity_b_id, round(final, 9) AS final_score, round(coalesce(risk, 0), 6) AS cluster_risk_score, round(0.55 * final + 0.25 * sim + 0.2 * coalesce(risk, 0), 5) AS priority_score,
'team' AS team_id, 'scope' AS scope_id, 'service' AS entity_type FROM tiered t LEFT JOIN w ON w.a = t.a AND w.b = t.b LEFT JOIN risk USING (component) WHERE outcome <> 'below_maybe' AND CAST(substr(t.a, 2) AS INT) % 5 <> 0""")
def review_queue(spark, d):
    """Pairs in clusters with risk; those of every fifth entity have been removed."""
    s, clusters, pairs = _clustered(spark, d)
    removed = s.where(F.substring("entity_a_id", 2, 9).try_cast("int") % 5 == 0).select("pair_key", F.lit("gone").alias("cleanup_reason"))
    q = cluster.review_queue(s, removed, clusters, pairs, _config())
    digits = {"final_score": 9, "cluster_risk_score": 6, "priority_score": 5}
    return q.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in q.columns])


@query(_QUEUE + """ SELECT component AS cluster_id, w.a || '__' || w.b AS pair_key, round(CASE WHEN final >= 0.62 THEN (final - 0.62) / 0.38 ELSE (final - 0.62) / 0.62 END, 9) AS assignment_score FROM w JOIN tiered t ON t.a = w.a AND t.b = w.b""")
def cluster_pairs(spark, d):
    return _clustered(spark, d)[2].select("cluster_id", "pair_key", F.round("assignment_score", 9).alias("assignment_score"))


@query()
def incremental_run(spark, d):
    """The whole run over the derived entities: its review queue."""
    return run_incremental(spark, services=entities(spark, d), config=Config.default("service"))["review_queue"]


# training data


def _reviews(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("pair_id"), F.col("event_type").isin("purchase", "click").alias("decision"), F.col("ts").alias("at"), "event_id", F.concat(F.lit("run"), (F.col("event_id") % 7).cast("string")).alias("run_id"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("reviewed_at"), F.col("ts").alias("created_at"))


@query("SELECT 'run' || (event_id % 7) AS run_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, run_id DESC LIMIT 1")
def latest_run(spark, d):
    return training.latest_run(_reviews(spark, d)).select("run_id")


@query("""WITH r AS (SELECT user_id AS pair_id, event_type IN ('purchase', 'click') AS decision, ts AS t, event_id FROM events),
c AS (SELECT *, lag(decision) OVER w AS b, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY pair_id ORDER BY t, event_id)), k AS (SELECT * FROM c WHERE n = 1 OR b IS DISTINCT FROM decision)
SELECT pair_id, event_id, decision, lead(t) OVER (PARTITION BY pair_id ORDER BY t, event_id) IS NULL AS is_active FROM k""")
def review_ledger(spark, d):
    return training.review_ledger(_reviews(spark, d).select("pair_id", "decision", "at", "event_id"), "pair_id", "decision", "at", "event_id").select("pair_id", "event_id", "decision", "is_active")


@query("""SELECT user_id AS pair_id, count(*) AS n_reviews, count(DISTINCT event_type IN ('purchase', 'click')) AS n_decisions,
CASE WHEN count(DISTINCT event_type IN ('purchase', 'click')) = 1 THEN min(event_type IN ('purchase', 'click')) END AS consensus FROM events GROUP BY 1""")
def label_consensus(spark, d):
    return training.consensus(_reviews(spark, d), "pair_id", "decision")


@query("""WITH l AS (SELECT doc_id AS pair_id, toxic = 1 AS label, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS band FROM labels),
n AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256(pair_id::VARCHAR), pair_id) AS n FROM l WHERE NOT label)
SELECT pair_id, label, band FROM l WHERE label UNION ALL SELECT pair_id, label, band FROM n WHERE n <= CASE band WHEN 'high' THEN 40 WHEN 'mid' THEN 40 ELSE 20 END""")
def dataset_cut(spark, d):
    x = F.col("doc_id") % 3
    pairs = table(spark, d, "labels").select(F.col("doc_id").alias("pair_id"), (F.col("toxic") == 1).alias("label"), F.when(x == 0, "high").when(x == 1, "mid").otherwise("low").alias("band"))
    return training.dataset_cut(pairs, 100)


@query("""WITH s AS (SELECT doc_id, toxic = 1 AS pos, (doc_id * 37 % 101) / 101 AS score FROM labels), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM s)
SELECT round(avg(pos::INT) FILTER (n <= greatest(c // 10, 1)), 6) AS rate, count(*) FILTER (n <= greatest(c // 10, 1)) AS n_rows, round(avg(score) FILTER (pos), 6) AS positive, round(avg(score) FILTER (NOT pos), 6) AS negative FROM r, (SELECT count(*) AS c FROM s)""")
def top_decile(spark, d):
    s = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("pos"), (F.col("doc_id") * 37 % 101 / 101).alias("score"))
    t = training.top_decile(s, "score", "pos", "doc_id")
    return t.select(F.round("top_decile_positive_rate", 6).alias("rate"), F.col("top_decile_rows").alias("n_rows"), F.round("mean_positive", 6).alias("positive"), F.round("mean_negative", 6).alias("negative"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'TRUE_DUPLICATE' ELSE 'FALSE_POSITIVE' END AS label FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def store_append(spark, d):
    store = table(spark, d, "labels").select("doc_id", training.label(F.col("toxic") == 1).alias("label"))
    return training.append_new(store, table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("label")), ["doc_id"])


# rollups and summaries


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || n, ',' ORDER BY o_orderkey) AS rolled FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def rollup_array_agg(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    rolled = F.array_sort(F.collect_list(F.struct("o_orderkey", "n")))
    return j.groupBy("o_custkey").agg(F.array_join(F.transform(rolled, lambda x: F.concat_ws(":", x["o_orderkey"], x["n"])), ",").alias("rolled"))


@query("SELECT 3::BIGINT AS artifact_count, (SELECT count(*) FROM orders) AS rows__orders, (SELECT count(*) FROM part) AS rows__part, (SELECT count(*) FROM pages) AS rows__pages")
def summary_of_frames(spark, d):
    return run_summary({t: table(spark, d, t) for t in ("orders", "part", "pages")})


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def conversation_rollup(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"))


from . import queries_features, queries_store  # noqa: E402, F401: they add theirs to the catalogue

__all__ = ["QUERIES", "SQL"]
