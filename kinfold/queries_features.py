"""Queries of the pair features: neighbours among entities derived from part, with empty and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features
from .registry import query
from .sources.testbed import sql, table

#: One row for each part, in SQL that both engines read.
FLAT = """SELECT p_partkey AS k,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN CONCAT(LOWER(p_name), ' café café') ELSE CONCAT(p_name, ' of ', CAST(p_partkey % 3 AS STRING)) END AS name,
  CASE WHEN p_partkey % 13 <= 1 THEN '' ELSE CONCAT(p_type, ' ', p_brand, ' ', p_name, ' a ', p_type) END AS description,
  p_partkey % 4 <> 0 AS mail, p_partkey % 3 <> 0 AS phone, p_partkey % 6 < 3 AS web, p_partkey % 10 <> 0 AS placed,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CONCAT('City ', CAST(p_partkey % 4 AS STRING)) END AS city, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CONCAT('s', CAST(p_size % 2 AS STRING)) END AS state,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE CONCAT('6060', CAST(p_partkey % 3 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '-1234' ELSE '' END) END AS zip,
  CASE WHEN p_partkey % 6 < 2 THEN 'Virtual' ELSE 'physical' END AS kind,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CONCAT('bd-', CAST(p_size % 3 AS STRING)) END AS code1, CASE WHEN p_partkey % 3 = 0 THEN 'bd-1.2' ELSE '' END AS code2,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CONCAT('food help ', CAST(p_size % 2 AS STRING)) END AS s1, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CONCAT('pn-', CAST(p_size % 4 AS STRING)) END AS s1code,
  CASE WHEN p_partkey % 3 = 0 THEN 'legal aid' ELSE NULL END AS s2, CASE WHEN p_partkey % 2 = 0 THEN 'bd-1' ELSE '' END AS s2code,
  CASE WHEN p_partkey % 5 = 1 THEN '' ELSE CONCAT('Org ', CAST(p_partkey % 2 AS STRING)) END AS org, CASE WHEN p_partkey % 7 = 1 THEN '' ELSE CONCAT('o', CAST(p_size % 2 AS STRING)) END AS org_id
FROM part"""

_LISTS = """SELECT *, list_filter([code1, code2], lambda x: x <> '') AS codes, list_filter([s1, s2], lambda x: x IS NOT NULL) AS services,
  list_filter([CASE WHEN s1 IS NULL THEN '' ELSE s1code END, CASE WHEN s2 IS NULL THEN '' ELSE s2code END], lambda x: x <> '') AS scodes,
  list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{M}\\p{N}_]+')) AS nw, list_distinct(regexp_extract_all(lower(description), '[\\p{L}\\p{M}\\p{N}_]+')) AS dw,
  regexp_extract_all(lower(name), '[\\p{L}\\p{M}\\p{N}_]+') AS ns FROM flat"""


def pair_sql(columns: str) -> str:
    """Columns of each row x and the next, y."""
    return f"WITH flat AS ({FLAT}), e AS ({_LISTS}) SELECT x.k, {columns} FROM e x JOIN e y ON y.k = x.k + 1"


def sides(spark: SparkSession, d: str) -> DataFrame:
    """k and the entity of each part, as cleaned entities are."""
    e = sql(spark, d, FLAT.replace("FROM part", "FROM {part}"))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    code = lambda c: F.struct(F.col(c).alias("code"), null.alias("name"))
    some = lambda *c: F.filter(F.array(*[code(x) for x in c]), lambda x: x["code"] != "")
    service = lambda n, c: F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("name"), some(c).alias("taxonomies")))
    place = F.struct(null.alias("address_1"), "city", "state", F.col("zip").alias("postal_code"), F.col("kind").alias("location_type"))
    lists = [F.when(F.col(c), F.array(F.lit("x"))).otherwise(none).alias(n) for c, n in (("mail", "emails"), ("phone", "phones"), ("web", "websites"))]
    entity = F.struct(
        "name", "description", *lists, F.when(F.col("placed"), F.array(place)).otherwise(F.filter(F.array(place), lambda x: F.lit(False))).alias("locations"), some("code1", "code2").alias("taxonomies"),
        F.filter(F.array(service("s1", "s1code"), service("s2", "s2code")), lambda x: x.isNotNull()).alias("services_rollup"), F.col("org").alias("organization_name"), F.col("org_id").alias("organization_id"),
    )
    return e.select("k", entity.alias("entity"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    e = sides(spark, d)
    return e.withColumnRenamed("entity", "l").join(e.select((F.col("k") - 1).alias("k"), F.col("entity").alias("r")), "k").withColumn("pair_key", F.col("k").cast("string")).withColumn("embedding_similarity", F.lit(0.5))


def _group(group):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = features.pair_features(pairs(spark, d), groups=(group,))
        return out.select("k", *[F.round(c, 6).alias(c) for c in group("l", "r") if c not in _NO_SQL])

    return run


_NO_SQL = {"shared_service_names", "org_name_jaro_winkler", "org_name_levenshtein", "org_name_token_sort", "same_org_name_fuzzy"}
_b = lambda c: f"({c})::INT::DOUBLE"
_jaccard = lambda a, b: f"round(coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0), 6)"
_present = lambda c: _b(f"x.placed AND y.placed AND coalesce(x.{c}, '') <> '' AND coalesce(y.{c}, '') <> ''")
_same = lambda c: _b(f"x.placed AND y.placed AND coalesce({c.format('x')}, '') <> '' AND coalesce({c.format('x')} = {c.format('y')}, false)")


def _four(name: str, x: str, y: str, least="min", most="max", diff="diff", ratio="ratio") -> str:
    return f"least({x}, {y})::DOUBLE AS {name.format(least)}, greatest({x}, {y})::DOUBLE AS {name.format(most)}, abs({x} - {y})::DOUBLE AS {name.format(diff)}, round(coalesce(least({x}, {y}) / nullif(greatest({x}, {y}), 0), 0), 6) AS {name.format(ratio)}"


@query(pair_sql(f"{_b('x.mail AND y.mail')} AS both_have_email, {_b('x.phone AND y.phone')} AS both_have_phone, {_b('x.web AND y.web')} AS both_have_website, {_present('city')} AS both_have_cities, {_present('state')} AS both_have_states, {_present('zip')} AS both_have_zip"))
def feat_completeness(spark, d):
    return _group(features.completeness)(spark, d)


@query(pair_sql(f"{_same('lower({}.city)')} AS same_city, {_same('{}.state')} AS same_state, {_same(chr(115) + 'plit_part({}.zip, chr(45), 1)')} AS same_zipcode"))
def feat_geo(spark, d):
    return _group(features.geography)(spark, d)


@query(pair_sql(f"{_jaccard('x.nw', 'y.nw')} AS token_jaccard, len(list_intersect(x.nw, y.nw))::DOUBLE AS token_overlap_count, len(list_distinct(list_concat(x.nw, y.nw)))::DOUBLE AS total_token_count, abs(len(x.nw) - len(y.nw))::DOUBLE AS name_length_diff_in_tokens"))
def feat_tokens(spark, d):
    return _group(features.tokens)(spark, d)


@query(pair_sql(f"{_four('name_complexity_{}', 'len(x.nw)', 'len(y.nw)')}, {_four('description_complexity_{}', 'len(x.dw)', 'len(y.dw)')}, {_four('num_services_{}', 'len(x.services)', 'len(y.services)')}"))
def feat_complexity(spark, d):
    return _group(features.complexity)(spark, d)


_GRAMS = "list_distinct(list_transform(range(1, len({0}.ns) - {1} + 2), lambda i: array_to_string({0}.ns[i : i + {1} - 1], ' ')))"


@query(pair_sql(", ".join(f"{_jaccard(_GRAMS.format('x', n), _GRAMS.format('y', n))} AS {name}_overlap" for name, n in (("bigram", 2), ("trigram", 3)))))
def feat_ngrams(spark, d):
    return _group(features.word_ngrams)(spark, d)


_SHARE = "coalesce(len(list_intersect(x.dw, y.dw)) / nullif(len({}.dw), 0), 0)"


@query(pair_sql(f"round(coalesce(least(length(x.description), length(y.description)) / nullif(greatest(length(x.description), length(y.description)), 0), 0), 6) AS description_length_ratio, round(abs({_SHARE.format('x')} - {_SHARE.format('y')}), 6) AS containment_asymmetry"))
def feat_statistics(spark, d):
    return _group(features.statistics)(spark, d)


_ALL = "list_distinct(list_concat({0}.codes, {0}.scodes))"
#: Prefixes of the codes here: both letters of the head, the part behind -, the whole.
_UP = "list_distinct(flatten(list_transform({}, lambda c: [substr(c, 1, 1), substr(c, 1, 2), split_part(c, '.', 1), c])))"


@query(
    pair_sql(
        f"len(list_intersect({_ALL.format('x')}, {_ALL.format('y')}))::DOUBLE AS shared_taxonomy_count, {_b('len(' + _ALL.format('x') + ') > 0 AND len(' + _ALL.format('y') + ') > 0')} AS both_have_taxonomies, "
        f"(len({_ALL.format('x')}) + len({_ALL.format('y')}))::DOUBLE AS total_taxonomy_count, abs(len({_ALL.format('x')}) - len({_ALL.format('y')}))::DOUBLE AS taxonomy_count_diff, "
        f"{_jaccard(_ALL.format('x'), _ALL.format('y'))} AS percent_shared_taxonomies, {_jaccard(_UP.format(_ALL.format('x')), _UP.format(_ALL.format('y')))} AS taxonomy_hierarchy_match_score"
    )
)
def feat_taxonomy(spark, d):
    return _group(features.taxonomies)(spark, d)


_VIRTUAL = "(NOT {0}.placed OR lower({0}.kind) = 'virtual')"


@query(pair_sql(f"{_b(_VIRTUAL.format('x') + ' <> ' + _VIRTUAL.format('y'))} AS is_virtual_service_diff, {_b(_VIRTUAL.format('x') + ' AND ' + _VIRTUAL.format('y'))} AS both_are_virtual_services"))
def feat_virtual(spark, d):
    return _group(features.virtual)(spark, d)


_AVG = "coalesce(len({0}.scodes) / nullif(len({0}.services), 0), 0)"
_WORDS = "flatten(list_transform(x.services, lambda s: list_transform(y.services, lambda t: [len(list_intersect(string_split(s, ' '), string_split(t, ' '))), len(list_distinct(list_concat(string_split(s, ' '), string_split(t, ' '))))])))"


@query(
    pair_sql(
        f"{_four('{}', 'len(x.services)', 'len(y.services)', 'min_services', 'max_services', 'service_count_diff', 'service_count_ratio')}, (len(x.services) + len(y.services))::DOUBLE AS total_services, {_b('len(x.services) > 0 AND len(y.services) > 0')} AS both_have_services, "
        f"round(coalesce(list_max(list_transform({_WORDS}, lambda p: p[1] / p[2])), 0), 6) AS max_service_name_jaccard, len(list_intersect(x.scodes, y.scodes))::DOUBLE AS shared_service_taxonomies, len(list_distinct(list_concat(x.scodes, y.scodes)))::DOUBLE AS total_unique_service_taxonomies, "
        f"round(least({_AVG.format('x')}, {_AVG.format('y')}), 6) AS min_avg_taxonomies_per_service, round(greatest({_AVG.format('x')}, {_AVG.format('y')}), 6) AS max_avg_taxonomies_per_service, round(abs({_AVG.format('x')} - {_AVG.format('y')}), 6) AS avg_taxonomies_per_service_diff"
    )
)
def feat_rollup(spark, d):
    return _group(features.rollup)(spark, d)


@query(pair_sql(_b("x.org <> '' AND y.org <> '' AND x.org_id <> '' AND x.org_id = y.org_id") + " AS same_organization_id"))
def feat_organization(spark, d):
    return _group(features.organization)(spark, d)


@query()
def feat_names(spark, d):
    """Names and names of organizations and services by similarity: no SQL has the ratios."""
    out = features.pair_features(pairs(spark, d), groups=(features.names, features.organization, features.rollup))
    return out.select("k", "name_jaro_winkler", "name_levenshtein", "name_token_sort", *sorted(_NO_SQL))


# weighted terms: every fourth word of the names has no weight

_MODEL = "SELECT w AS term, 1 + ln(count(*))::DOUBLE AS idf FROM (SELECT unnest(list_filter(nw, lambda x: length(x) > 1)) AS w FROM e) WHERE length(w) % 4 <> 3 GROUP BY 1"


def _terms(side: str) -> str:
    return f"SELECT k, t, count(*) * any_value(idf) AS w FROM (SELECT {side}.k, unnest(regexp_extract_all(lower({{}}.name || ' ' || {{}}.description), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS t FROM e x JOIN e y ON y.k = x.k + 1) JOIN model ON term = t GROUP BY 1, 2".replace("{}", "{0}")


def _tfidf_sql() -> str:
    a, b = (_terms("x").replace("{0}", s).replace("{{", "{").replace("}}", "}") for s in "xy")
    return f"""WITH flat AS ({FLAT}), e AS ({_LISTS}), model AS ({_MODEL}), a AS ({a}), b AS ({b}),
s AS (SELECT k, sum(a.w * b.w) AS dot, sum(a.w * a.w) AS aa, sum(b.w * b.w) AS bb, count(a.w) AS na, count(b.w) AS nb, count(*) FILTER (b.w IS NULL) AS xa, count(*) FILTER (a.w IS NULL) AS xb FROM a FULL JOIN b USING (k, t) GROUP BY k)
SELECT x.k, round(coalesce(dot / (sqrt(aa) * sqrt(bb)), 0), 6) AS tfidf_weighted_similarity, round(coalesce(greatest(coalesce(xa / nullif(na, 0), 0), coalesce(xb / nullif(nb, 0), 0)), 0), 6) AS max_distinctive_term_ratio
FROM e x JOIN e y ON y.k = x.k + 1 LEFT JOIN s ON s.k = x.k"""


def tfidf_model(spark: SparkSession, d: str) -> DataFrame:
    words = sides(spark, d).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("entity.name"), F.lit(r"(?U)\w+"), 0))).alias("term")).where("length(term) > 1 and length(term) % 4 <> 3")
    return words.groupBy("term").agg((1 + F.ln(F.count("*"))).alias("idf"))


@query(_tfidf_sql())
def feat_tfidf(spark, d):
    out = features.tfidf(pairs(spark, d), tfidf_model(spark, d))
    return out.select(F.col("pair_key").cast("long").alias("k"), F.round("tfidf_weighted_similarity", 6).alias("tfidf_weighted_similarity"), F.round("max_distinctive_term_ratio", 6).alias("max_distinctive_term_ratio"))


_VECTORS = "SELECT * FROM (VALUES ('bd-0', [1.0, 0.0, 0.2]), ('bd-1', [0.9, 0.3, 0.1]), ('bd-1.2', [0.7, 0.6, 0.0]), ('pn-0', [0.0, 1.0, 0.3]), ('pn-1', [0.1, 0.9, 0.5]), ('pn-3', [0.0, 0.0, 0.0])) AS v(code, vector)"
_ABOVE = "list_transform(flatten(list_transform({0}, lambda c: list_transform({1}, lambda u: [c, u]))), lambda p: p)"


def _near_sql() -> str:
    count = lambda b: f"count(*) FILTER (s > {b / 100})"
    cols = ", ".join(f"coalesce(any_value(n{b}), 0)::DOUBLE AS taxonomy_pairs_sim_gt_{b:03d}, round(coalesce(any_value(n{b}) / nullif(any_value(size), 0), 0), 6) AS taxonomy_pairs_sim_gt_{b:03d}_ratio" for b in (70, 75, 80, 85, 90))
    return f"""WITH flat AS ({FLAT}), e AS ({_LISTS}), v AS ({_VECTORS}), c AS (SELECT x.k, unnest({_ALL.format('x')}) AS a, {_ALL.format('y')} AS o FROM e x JOIN e y ON y.k = x.k + 1), p AS (SELECT k, a, unnest(o) AS b FROM c),
n AS (SELECT k, {", ".join(f"{count(b)} AS n{b}" for b in (70, 75, 80, 85, 90))} FROM (SELECT k, list_cosine_similarity(u.vector::DOUBLE[], w.vector::DOUBLE[]) AS s FROM p JOIN v u ON u.code = a JOIN v w ON w.code = b) WHERE NOT isnan(s) GROUP BY k),
z AS (SELECT x.k, len({_ALL.format('x')}) + len({_ALL.format('y')}) AS size FROM e x JOIN e y ON y.k = x.k + 1)
SELECT z.k, {cols} FROM z LEFT JOIN n USING (k) GROUP BY z.k"""


def code_vectors(spark: SparkSession) -> DataFrame:
    rows = [("bd-0", [1.0, 0.0, 0.2]), ("bd-1", [0.9, 0.3, 0.1]), ("bd-1.2", [0.7, 0.6, 0.0]), ("pn-0", [0.0, 1.0, 0.3]), ("pn-1", [0.1, 0.9, 0.5]), ("pn-3", [0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "code string, vector array<double>")


@query(_near_sql())
def feat_taxonomy_embedding(spark, d):
    out = features.taxonomy_embeddings(pairs(spark, d), code_vectors(spark))
    return out.select(F.col("pair_key").cast("long").alias("k"), *[F.round(c, 6).alias(c) for c in out.columns if c != "pair_key"])


# what models are fed


_REASONS = "SELECT k, CASE k % 3 WHEN 0 THEN 'shared_address' WHEN 1 THEN 'shared_phone' ELSE 'name_similarity' END AS m, CASE WHEN k % 7 = 0 THEN NULL ELSE (k % 10) / 10 END AS r FROM flat"


@query(f"""WITH flat AS ({FLAT}), e AS ({_LISTS}), q AS ({_REASONS})
SELECT x.k, {_b('x.mail AND y.mail')} AS both_have_email, {_present('city')} AS both_have_cities, len(x.services)::DOUBLE + len(y.services) AS total_services, CASE WHEN m = 'shared_address' THEN coalesce(r, 0) ELSE 0 END AS shared_address,
0.5::DOUBLE AS embedding_similarity, least(len(x.services), len(y.services))::DOUBLE AS num_services_min, 0::DOUBLE AS shared_identifier, 25::BIGINT AS n FROM e x JOIN e y ON y.k = x.k + 1 JOIN q ON q.k = x.k""")
def model_features_organization(spark, d):
    return _fed(spark, d, "organization").select("k", "both_have_email", "both_have_cities", "total_services", "shared_address", "embedding_similarity", "num_services_min", "shared_identifier", "n")


@query(f"""WITH flat AS ({FLAT}), e AS ({_LISTS}), q AS ({_REASONS})
SELECT x.k, {_b('x.phone AND y.phone')} AS both_have_phone, {_jaccard(_ALL.format('x'), _ALL.format('y'))} AS percent_shared_taxonomies, CASE WHEN m = 'name_similarity' THEN coalesce(r, 0) ELSE 0.25 END AS fuzzy_name, CASE WHEN m = 'shared_phone' THEN coalesce(r, 0) ELSE 0 END AS shared_phone,
{_jaccard(_GRAMS.format('x', 2), _GRAMS.format('y', 2))} AS bigram_overlap, 27::BIGINT AS n FROM e x JOIN e y ON y.k = x.k + 1 JOIN q ON q.k = x.k""")
def model_features_service(spark, d):
    out = _fed(spark, d, "service")
    return out.select("k", "both_have_phone", F.round("percent_shared_taxonomies", 6).alias("percent_shared_taxonomies"), "fuzzy_name", "shared_phone", F.round("bigram_overlap", 6).alias("bigram_overlap"), "n")


def _fed(spark: SparkSession, d: str, entity_type: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "shared_address").when(k % 3 == 1, "shared_phone").otherwise("name_similarity")
    own = table(spark, d, "part").select(k.cast("string").alias("pair_key"), kind.alias("match_type"), F.when(k % 7 != 0, (k % 10) / 10).alias("raw_contribution"))
    scores = own.select("pair_key", F.lit(0.25).alias("nlp_section_score"))
    fed = features.model_features(pairs(spark, d), entity_type, features.signal_overrides(own, scores), tfidf_model(spark, d), code_vectors(spark))
    return fed.withColumn("k", F.col("pair_key").cast("long")).withColumn("n", F.lit(len(fed.columns) - 1).cast("long"))
