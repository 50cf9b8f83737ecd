"""Features of a pair of entities, from the structs l and r of cleaned entities; native columns but for the name similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy, taxonomy, text


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    """The lesser over the greater, 0 where both are 0."""
    high = F.greatest(a, b)
    return F.when(high > 0, F.least(a, b) / high).otherwise(F.lit(0.0))


def _spread(name: str, a: Column, b: Column) -> dict[str, Column]:
    """Least, greatest, difference and ratio of two counts."""
    return {f"{name}_min": F.least(a, b).cast("double"), f"{name}_max": F.greatest(a, b).cast("double"), f"{name}_diff": F.abs(a - b).cast("double"), f"{name}_ratio": _ratio(a, b)}


def _both(a: Column, b: Column, value: Column) -> Column:
    """value where neither text is empty, else 0."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), value).otherwise(F.lit(0.0))


def _similar(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Jaro-Winkler, sequence ratio and ratio of the sorted words of two texts, whatever their case; 0 where one is empty."""
    x, y = F.lower(a), F.lower(b)
    sort = lambda c: fuzzy.sorted_tokens(c, r"(?U)\w+")
    return _both(a, b, fuzzy.jaro_winkler_score(x, y)), _both(a, b, fuzzy.sequence_ratio(x, y)), _both(a, b, fuzzy.sequence_ratio(sort(x), sort(y)))


def _word_ngrams(c: Column, n: int) -> Column:
    own = F.regexp_extract_all(text.clean_text(c), F.lit(r"(?U)\w+"), 0)
    none = F.array().cast("array<string>")

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(none)

    # the words are bound as a variable of an outer transform, else the inner one would make them again for each n-gram
    return F.array_distinct(F.element_at(F.transform(F.array(own), grams), 1))


def completeness(l: str, r: str) -> dict[str, Column]:
    first = lambda s, f: text.clean_text(F.try_element_at(F.col(f"{s}.locations"), F.lit(1))[f])
    both = lambda f: F.when((first(l, f) != "") & (first(r, f) != ""), 1.0).otherwise(0.0)
    out = {f"both_have_{n}": _flag((F.size(f"{l}.{c}") > 0) & (F.size(f"{r}.{c}") > 0)) for n, c in (("email", "emails"), ("phone", "phones"), ("website", "websites"))}
    return out | {"both_have_cities": both("city"), "both_have_states": both("state"), "both_have_zip": both("postal_code")}


def geography(l: str, r: str) -> dict[str, Column]:
    def part(s: str, f: str) -> Column:
        x = text.clean_text(F.try_element_at(F.col(f"{s}.locations"), F.lit(1))[f])
        return F.substring_index(x, "-", 1) if f == "postal_code" else x

    return {n: F.when((part(l, f) != "") & (part(l, f) == part(r, f)), 1.0).otherwise(0.0) for n, f in (("same_city", "city"), ("same_state", "state"), ("same_zipcode", "postal_code"))}


def tokens(l: str, r: str) -> dict[str, Column]:
    a, b = text.word_set(F.col(f"{l}.name")), text.word_set(F.col(f"{r}.name"))
    return {
        "token_jaccard": text.jaccard(a, b), "token_overlap_count": F.size(F.array_intersect(a, b)).cast("double"),
        "total_token_count": F.size(F.array_union(a, b)).cast("double"), "name_length_diff_in_tokens": F.abs(F.size(a) - F.size(b)).cast("double"),
    }


def names(l: str, r: str) -> dict[str, Column]:
    return dict(zip(("name_jaro_winkler", "name_levenshtein", "name_token_sort"), _similar(F.col(f"{l}.name"), F.col(f"{r}.name"))))


def _codes(side: str, ancestors: bool = False) -> Column:
    return taxonomy.code_set(F.col(f"{side}.taxonomies"), F.col(f"{side}.services_rollup"), ancestors)


def taxonomies(l: str, r: str) -> dict[str, Column]:
    a, b = _codes(l), _codes(r)
    return {
        "shared_taxonomy_count": F.size(F.array_intersect(a, b)).cast("double"), "both_have_taxonomies": _flag((F.size(a) > 0) & (F.size(b) > 0)), "total_taxonomy_count": (F.size(a) + F.size(b)).cast("double"),
        "taxonomy_count_diff": F.abs(F.size(a) - F.size(b)).cast("double"), "percent_shared_taxonomies": text.jaccard(a, b), "taxonomy_hierarchy_match_score": text.jaccard(_codes(l, True), _codes(r, True)),
    }


def complexity(l: str, r: str) -> dict[str, Column]:
    """Numbers of distinct words and of services."""
    words = lambda s, c: F.size(text.word_set(F.col(f"{s}.{c}")))
    services = lambda s: F.greatest(F.coalesce(F.size(f"{s}.services_rollup"), F.lit(0)), F.lit(0))
    return _spread("name_complexity", words(l, "name"), words(r, "name")) | _spread("description_complexity", words(l, "description"), words(r, "description")) | _spread("num_services", services(l), services(r))


def virtual(l: str, r: str) -> dict[str, Column]:
    def is_virtual(s: str) -> Column:
        return F.forall(F.coalesce(F.col(f"{s}.locations"), F.array().cast("array<struct<address_1:string,city:string,state:string,postal_code:string,location_type:string>>")), lambda x: text.clean_text(x["location_type"]) == "virtual")

    return {"is_virtual_service_diff": _flag(is_virtual(l) != is_virtual(r)), "both_are_virtual_services": _flag(is_virtual(l) & is_virtual(r))}


def rollup(l: str, r: str) -> dict[str, Column]:
    none = F.array().cast("array<struct<name:string,taxonomies:array<struct<code:string,name:string>>>>")
    lists = [F.coalesce(F.col(f"{s}.services_rollup"), none) for s in (l, r)]
    a, b = (F.size(x) for x in lists)
    codes = [F.array_distinct(F.filter(F.flatten(F.transform(x, lambda s: F.transform(F.coalesce(s["taxonomies"], F.array()), lambda t: t["code"]))), lambda c: c.isNotNull() & (c != ""))) for x in lists]
    names = [F.filter(F.transform(x, lambda s: text.clean_text(s["name"])), lambda n: n != "") for x in lists]
    each = [F.when(F.size(x) > 0, F.aggregate(x, F.lit(0), lambda t, s: t + F.coalesce(F.size(s["taxonomies"]), F.lit(0))) / F.size(x)).otherwise(F.lit(0.0)) for x in lists]
    pairs = F.flatten(F.transform(names[0], lambda x: F.transform(names[1], lambda y: text.jaccard(text.word_set(x), text.word_set(y)))))
    return {
        "min_services": F.least(a, b).cast("double"), "max_services": F.greatest(a, b).cast("double"), "total_services": (a + b).cast("double"), "service_count_diff": F.abs(a - b).cast("double"), "service_count_ratio": _ratio(a, b),
        "both_have_services": _flag((a > 0) & (b > 0)), "shared_service_names": fuzzy.greedy_name_matches(*names).cast("double"), "max_service_name_jaccard": F.coalesce(F.array_max(pairs), F.lit(0.0)),
        "shared_service_taxonomies": F.size(F.array_intersect(*codes)).cast("double"), "total_unique_service_taxonomies": F.size(F.array_union(*codes)).cast("double"),
        "min_avg_taxonomies_per_service": F.least(*each), "max_avg_taxonomies_per_service": F.greatest(*each), "avg_taxonomies_per_service_diff": F.abs(each[0] - each[1]),
    }


def organization(l: str, r: str) -> dict[str, Column]:
    """All 0 where one side has no organization name."""
    a, b = F.col(f"{l}.organization_name"), F.col(f"{r}.organization_name")
    x, y = F.col(f"{l}.organization_id"), F.col(f"{r}.organization_id")
    jw, ratio, tokens_sorted = _similar(a, b)
    return {
        "org_name_jaro_winkler": jw, "org_name_levenshtein": ratio, "org_name_token_sort": tokens_sorted, "same_org_name_fuzzy": F.when(jw > 0.85, 1.0).otherwise(0.0),
        "same_organization_id": _both(a, b, _both(x, y, F.when(x == y, 1.0).otherwise(0.0))),
    }


def word_ngrams(l: str, r: str) -> dict[str, Column]:
    """Jaccard of the word n-grams of the names, 0 where one has none."""
    return {f"{n}_overlap": text.jaccard(_word_ngrams(F.col(f"{l}.name"), k), _word_ngrams(F.col(f"{r}.name"), k)) for n, k in (("bigram", 2), ("trigram", 3))}


def statistics(l: str, r: str) -> dict[str, Column]:
    a, b = F.coalesce(F.length(f"{l}.description"), F.lit(0)), F.coalesce(F.length(f"{r}.description"), F.lit(0))
    x, y = text.word_set(F.col(f"{l}.description")), text.word_set(F.col(f"{r}.description"))
    shared = F.size(F.array_intersect(x, y))
    share = lambda z: F.when(F.size(z) > 0, shared / F.size(z)).otherwise(F.lit(0.0))
    return {"description_length_ratio": _ratio(a, b), "containment_asymmetry": F.abs(share(x) - share(y))}


def tfidf(pairs: DataFrame, model: DataFrame | None, l: str = "l", r: str = "r", key: str = "pair_key") -> DataFrame:
    """key, the cosine of both sides' weighted terms and the larger share of terms that the other side hasn't.

    Terms are the words of two characters or more of name and description that model (term, idf) has. Without a model, and
    where a side has no term, the cosine is 0; the share is 0 where neither has one.
    """
    if model is None:
        return pairs.select(key, F.lit(0.0).alias("tfidf_weighted_similarity"), F.lit(0.0).alias("max_distinctive_term_ratio"))
    sides = []
    for side, w in ((l, "a"), (r, "b")):
        own = F.concat_ws(" ", F.col(f"{side}.name"), F.col(f"{side}.description"))
        terms = pairs.select(key, F.explode(F.regexp_extract_all(F.lower(own), F.lit(r"(?U)\w{2,}"), 0)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        sides.append(terms.join(model.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias(w)))
    both = sides[0].join(sides[1], [key, "term"], "full")
    a, b = F.col("a"), F.col("b")
    sums = both.groupBy(key).agg(
        F.sum(a * b).alias("dot"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(b.isNull()).alias("only_a"), F.count_if(a.isNull()).alias("only_b")
    )
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.0))
    own = sums.select(key, F.coalesce(F.try_divide("dot", F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)).alias("tfidf_weighted_similarity"), F.greatest(share("only_a", "na"), share("only_b", "nb")).alias("max_distinctive_term_ratio"))
    return pairs.select(key).join(own, key, "left").na.fill(0.0, ["tfidf_weighted_similarity", "max_distinctive_term_ratio"])


def taxonomy_embeddings(pairs: DataFrame, vectors: DataFrame, l: str = "l", r: str = "r", key: str = "pair_key") -> DataFrame:
    """key, and for each of five cosines how many pairs of codes exceed it, as a count and over the codes of both sides; vectors has code and vector."""
    from ..operators.block import _cosines

    own = [pairs.select(key, F.explode(_codes(s)).alias("code")).join(vectors, "code").select(key, F.col("vector").alias(v)) for s, v in ((l, "va"), (r, "vb"))]
    sizes = pairs.select(key, (F.size(_codes(l)) + F.size(_codes(r))).alias("size"))
    kind = dict(pairs.dtypes)[key]
    near = own[0].join(own[1], key).mapInArrow(_cosines, f"{key} {kind}, similarity double")
    bands = (70, 75, 80, 85, 90)
    counts = near.groupBy(key).agg(*[F.count_if(F.col("similarity") > b / 100).cast("double").alias(f"taxonomy_pairs_sim_gt_{b:03d}") for b in bands])
    out = sizes.join(counts, key, "left").na.fill(0.0)
    return out.select(key, *[c for b in bands for c in (F.col(f"taxonomy_pairs_sim_gt_{b:03d}"), F.when(F.col("size") > 0, F.col(f"taxonomy_pairs_sim_gt_{b:03d}") / F.col("size")).otherwise(0.0).alias(f"taxonomy_pairs_sim_gt_{b:03d}_ratio"))])


GROUPS = (completeness, tokens, geography, names, taxonomies, complexity, virtual, rollup, organization, word_ngrams, statistics)


def pair_features(pairs: DataFrame, l: str = "l", r: str = "r", groups=GROUPS) -> DataFrame:
    """pairs with a column for each feature; embedding_similarity, where pairs has it, is a feature, too. Missing values are 0."""
    columns: dict[str, Column] = {}
    for g in groups:
        columns |= g(l, r)
    filled = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    if "embedding_similarity" in pairs.columns:
        pairs = pairs.withColumn("embedding_similarity", filled(F.col("embedding_similarity")))
    return pairs.select("*", *[filled(c).alias(n) for n, c in columns.items()])


#: What models of each entity type are fed, in order.
MODEL_FEATURES: dict[str, tuple[str, ...]] = {
    "organization": tuple(
        """both_have_email both_have_cities both_have_zip token_overlap_count total_token_count name_length_diff_in_tokens same_state same_zipcode name_levenshtein min_services max_services
        total_services both_have_services shared_service_names max_service_name_jaccard shared_service_taxonomies total_unique_service_taxonomies shared_address embedding_similarity
        name_complexity_diff name_complexity_ratio num_services_min tfidf_weighted_similarity shared_identifier shared_identifier_similarity""".split()
    ),
    "service": tuple(
        """both_have_email both_have_phone both_have_website both_have_zip same_city name_token_sort shared_taxonomy_count both_have_taxonomies total_taxonomy_count name_complexity_max
        description_complexity_ratio num_services_max num_services_diff percent_shared_taxonomies taxonomy_hierarchy_match_score taxonomy_pairs_sim_gt_085 taxonomy_pairs_sim_gt_085_ratio
        is_virtual_service_diff both_are_virtual_services same_org_name_fuzzy fuzzy_name shared_address shared_phone embedding_similarity bigram_overlap description_length_ratio containment_asymmetry""".split()
    ),
}
FEATURE_VERSION = "ml-features-v1"
#: Groups that organization models don't have.
_SERVICE_ONLY = (taxonomies, virtual, organization)


def signal_overrides(reasons: DataFrame, nlp_scores: DataFrame | None = None) -> DataFrame:
    """pair_key, shared_address, shared_phone and fuzzy_name of the reasons of each pair; null where a pair has no such reason.

    fuzzy_name falls back on nlp_section_score of nlp_scores, which may have pairs without a reason.
    """
    of = lambda m: F.max(F.when(F.col("match_type") == m, F.coalesce(F.nanvl("raw_contribution", F.lit(0.0)), F.lit(0.0))))
    own = reasons.groupBy("pair_key").agg(of("shared_address").alias("shared_address"), of("shared_phone").alias("shared_phone"), of("name_similarity").alias("fuzzy_name"))
    if nlp_scores is None:
        return own
    score = nlp_scores.select("pair_key", F.coalesce(F.nanvl("nlp_section_score", F.lit(0.0)), F.lit(0.0)).alias("__nlp"))
    return score.join(own, "pair_key", "left").select("pair_key", "shared_address", "shared_phone", F.coalesce("fuzzy_name", "__nlp").alias("fuzzy_name"))


def model_features(pairs: DataFrame, entity_type: str, overrides: DataFrame | None = None, tfidf_model: DataFrame | None = None, code_vectors: DataFrame | None = None) -> DataFrame:
    """pair_key and the features of the model of an entity type, in its order; pairs has pair_key, l, r and embedding_similarity.

    Overrides (see :func:`signal_overrides`) come before features of the same name; whatever is missing, null or not a number is 0.
    """
    wanted = MODEL_FEATURES[entity_type]
    groups = tuple(g for g in GROUPS if entity_type != "organization" or g not in _SERVICE_ONLY)
    columns: dict[str, Column] = {}
    for g in groups:
        columns |= {n: c for n, c in g("l", "r").items() if n in wanted}
    out = pairs.select("pair_key", F.col("embedding_similarity").cast("double").alias("embedding_similarity"), *[c.cast("double").alias(n) for n, c in columns.items()])
    if set(wanted) & {"tfidf_weighted_similarity"}:
        out = out.join(tfidf(pairs, tfidf_model), "pair_key", "left")
    if code_vectors is not None and entity_type != "organization":
        out = out.join(taxonomy_embeddings(pairs, code_vectors), "pair_key", "left")
    if overrides is not None:
        names_ = [c for c in overrides.columns if c != "pair_key"]
        out = out.join(overrides.select("pair_key", *[F.col(c).alias(f"__{c}") for c in names_]), "pair_key", "left")
        for c in names_:
            out = out.withColumn(c, F.coalesce(f"__{c}", c) if c in out.columns else F.col(f"__{c}"))
    have = set(out.columns)
    zero = F.lit(0.0)
    return out.select("pair_key", *[(F.coalesce(F.nanvl(F.col(n).cast("double"), zero), zero) if n in have else zero).alias(n) for n in wanted])
