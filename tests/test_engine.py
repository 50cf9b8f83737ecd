"""The entity-resolution operators: truth tables, stages, and whole runs."""

import dataclasses
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold import schemas
from kinfold.config import Config
from kinfold.functions import domain, features, fuzzy, taxonomy, text
from kinfold.operators import block, clean, cluster, mitigate, training
from kinfold.plans.incremental import bundle, run_incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    assert one(spark, text.clean_text(F.lit(" A \t b\n"))) == "a b"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.clean_list(F.array(F.lit("B "), F.lit("a"), F.lit(None), F.lit(""), F.lit("b")))) == ["a", "b"]
    assert one(spark, text.display_text(F.lit("  A  b "))) == "A b" and one(spark, text.display_text(F.lit(" "))) is None
    assert one(spark, text.pair_key(F.lit("b"), F.lit("a"))) == "a__b"
    assert one(spark, text.address_component(F.lit("12 N. Main St, Ct"))) == "12 north main street court"
    assert one(spark, text.overlap_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5


@pytest.mark.parametrize("value,want", [("Mailto:Me@Mail.Example.org", "mail.example.org"), ("https://www.Example.org:80/a?b", "example.org"), ("example.org/x", "example.org"), ("@x", None)])
def test_domains(spark, value, want):
    assert one(spark, domain.extract_domain(F.lit(value))) == want


@pytest.mark.parametrize("left,right,want", [("http://a.org", "a.org", 1.0), ("http://a.org/x", "a.org", 0.8), ("http://b.a.org", "a.org", 0.4), ("http://b.org", "a.org", 0.0), ("http://x.co.uk", "http://y.co.uk", 0.0)])
def test_domain_tiers(spark, left, right, want):
    t = lambda x: domain.domain_tokens(F.array().cast("array<string>"), F.array(F.lit(x)))
    assert one(spark, domain.domain_overlap(t(left), t(right))) == want


def test_taxonomy(spark):
    assert one(spark, taxonomy.levels(F.lit("BD-1800.1400-800"))) == ["b", "bd", "bd-1800", "bd-1800.1400", "bd-1800.1400-800"]
    assert one(spark, taxonomy.levels(F.lit(""))) == [] and one(spark, taxonomy.parents(F.lit("bd-1"))) == ["b", "bd"]
    score = lambda a, b: one(spark, taxonomy.pair_score(F.lit(a), F.lit(b)))
    assert [round(score("bd-1800", x), 6) for x in ("bd-1800", "bd", "b", "x")] == [1.0, 0.7, 0.49, 0.0]
    related = lambda a, b: one(spark, taxonomy.related(F.lit(a), F.lit(b)))
    assert related("bd-1", "BD-1") and related("bd", "bd-1") and not related("bd-1", "bd-2") and not related("b", "bd-1")


def test_fuzzy(spark):
    assert fuzzy.ratio("tide", "diet") == 0.25 and fuzzy.ratio("diet", "tide") == 0.5 and fuzzy.ratio("", "") == 1.0
    assert round(fuzzy.jaro_winkler("martha", "marhta"), 4) == 0.9611 and fuzzy.jaro_winkler("", "x") == 0.0
    assert one(spark, fuzzy.number_mismatch(F.lit("post 12"), F.lit("post 13"))) and not one(spark, fuzzy.number_mismatch(F.lit("post"), F.lit("post 13")))
    assert one(spark, fuzzy.nlp_score(F.lit(0.9), F.lit(0.0), 0.88, 0.94)) == 0.0 and one(spark, fuzzy.nlp_score(F.lit(0.9), F.lit(0.1), 0.88, 0.94)) == 0.9
    with pytest.raises(ValueError):
        fuzzy.algorithm("unknown")


def test_config():
    c = Config.from_overrides({"scoring": {"weights": {"shared_email": 0.3}}, "blocking": {"channels": ["email", "taxonomy"]}})
    assert c.scoring.weights["shared_email"] == 0.3 and c.scoring.weights["shared_phone"] == 0.2 and c.blocking.channels == ("email", "taxonomy")
    for bad in ({"nonsense": 1}, {"blocking": {"channels": ["x"]}}, {"scoring": {"duplicate_threshold": 0.1}}, {"scoring": {"weights": {"shared_email": 0.7}}}, {"scoring": {"section_weights": {"ml": 0.9}}}):
        with pytest.raises(ValueError):
            Config.from_overrides(bad)


def service(i, name="North Clinic", **more):
    base = dict(entity_id=i, source_schema="s", name=name, description="d", emails=["hello@north.org"], phones=["1"], websites=["north.org"], taxonomies=[{"code": "BD-1800"}], locations=[{"city": "Chicago", "state": "IL"}], embedding_vector=[0.9, 0.1])
    return {**base, **more}


def test_golden_pair(spark):
    rows = [service("A", phones=["1", "2"], locations=[{"address_1": "1 N Main St", "city": "Chicago", "state": "IL"}]), service("B", phones=["1", "3"], locations=[{"city": "Peoria", "state": "IL"}])]
    config = Config.default("service")
    r = run_incremental(spark, None, rows, config=config)
    s = r["scored_pairs"].first()
    assert [round(x, 9) for x in (s.deterministic_section_score, s.final_score, s.shadow_confidence_score)] == [0.488636364, 0.744318182, 0.641067406]
    assert r["pair_reasons"].count() == 5 and r["clusters"].first().cluster_size == 2 and r["review_queue"].count() == 1
    assert r["run_summary"].first().artifact_count == 15 and len(bundle(r, config)["frames"]) == 16
    again = run_incremental(spark, None, rows, r["entity_index"], r["pair_state"], config)
    assert again["run_summary"].first().no_change and again["candidates"].count() == 0 and again["pair_state"].count() == 1
    gone = run_incremental(spark, None, rows[:1], r["entity_index"], r["pair_state"], config)
    assert [tuple(x) for x in gone["removed_pairs"].collect()] == [("a__b", "entity_deleted")] and gone["pair_state"].count() == 0
    changed = [rows[0], service("B", emails=["other@else.net"], phones=["9"], websites=[], taxonomies=[{"code": "ZZ"}], locations=[])]
    lost = run_incremental(spark, None, changed, r["entity_index"], r["pair_state"], config)
    assert [tuple(x) for x in lost["removed_pairs"].collect()] == [("a__b", "candidate_lost")]
    scope = run_incremental(spark, None, rows, r["entity_index"], r["pair_state"], config, scope_removed=True)
    assert [x.cleanup_reason for x in scope["removed_pairs"].collect()] == ["scope_removed"] and scope["pair_state"].count() == 0


def test_model_scores(spark):
    rows = [service("A"), service("B")]
    ml = Config.from_overrides({"ml": {"enabled": True}}, "service")
    scorer = lambda gated: gated.select("pair_key", F.lit(False).alias("is_duplicate"), F.lit(0.9).alias("confidence"))
    assert round(run_incremental(spark, None, rows, config=ml, scorer=scorer)["scored_pairs"].first().ml_section_score, 6) == 0.1
    assert run_incremental(spark, None, rows, config=ml)["scored_pairs"].first().ml_section_score == pytest.approx(1.0)


def test_gate_and_plans_agree(spark):
    rows = [service("a"), service("b"), service("c", taxonomies=[{"code": "BD"}], emails=[], phones=[], websites=[]), service("d", taxonomies=[{"code": "BD-1900"}]), service("e", emails=[], phones=["7"], websites=[], locations=[]), service("f", embedding_vector=[0.0, 1.0])]
    e = clean.clean_entities(schemas.ensure_frame(spark, rows, "entity"), "service")
    everything = e.select("entity_id", "entity_type", F.lit("added").alias("delta_class"))
    settings = Config.default("service").blocking
    got = [{r.pair_key for r in block.candidates(e, everything, settings, plan=p).collect()} for p in ("gate", "cosine")]
    assert got[0] == got[1] and {"a__b", "a__c", "b__c"} <= got[0] and not any("e" in k or "f" in k or k in ("a__d", "b__d") for k in got[0])
    only = Config.from_overrides({"blocking": {"channels": ["email"]}}).blocking
    assert block.candidates(e, everything, only).count() == 0


def test_hash_and_strictness(spark):
    h = lambda **m: clean.clean_entities(schemas.ensure_frame(spark, [service("a", **m)], "entity"), "service").first().content_hash
    assert h() == h(name=" north  CLINIC ") == h(embedding_vector=[1.0, 2.0]) == h(taxonomies=[{"code": "bd-1800"}, {"code": "BD-1800"}]) != h(name="South")
    two = [service("a"), service("b", embedding_vector=[1.0])]
    with pytest.raises(Exception, match="another length"):
        clean.clean_entities(schemas.ensure_frame(spark, two, "entity"), "service").collect()
    assert [len(r.embedding_vector) for r in clean.clean_entities(schemas.ensure_frame(spark, two, "entity"), "service", strict=False).collect()] == [2, 2]
    with pytest.raises(TypeError):
        schemas.ensure_frame(spark, 3, "entity")
    assert schemas.ensure_frame(spark, None, "scored").columns == [f.name for f in schemas.schema("scored")]


def test_conflict_triangle(spark):
    rows = [("a__b", "a", "b", 0.95, True), ("a__c", "a", "c", 0.94, True), ("b__c", "b", "c", 0.10, False)]
    pairs = spark.createDataFrame([(*r, "service") for r in rows], "pair_key string, entity_a_id string, entity_b_id string, final_score double, review_eligible boolean, entity_type string")
    clusters, bridge = cluster.cluster_pairs(pairs, schemas.empty(spark, "removed"), Config.default())
    assert [r.pair_key for r in bridge.collect()] == ["a__b"] and clusters.count() == 1


def test_mitigation_without_state(spark):
    pairs = schemas.empty(spark, "scored")
    m = mitigate.apply_mitigation(pairs, schemas.empty(spark, "reasons"), spark.createDataFrame([], "entity_id string"), schemas.empty(spark, "pair_state"), Config.default(), no_change=True)
    assert m.finalized.count() == m.state.count() == 0 and m.finalized.columns == [f.name for f in schemas.schema("finalized")]


def test_training(spark):
    reviews = spark.createDataFrame([("p", True, 1), ("p", True, 2), ("p", False, 3), ("q", None, 1)], "pair string, decision boolean, at int")
    got = {(r["pair"], r["at"], r["is_active"]) for r in training.review_ledger(reviews, "pair", "decision", "at", "at").collect()}
    assert got == {("p", 1, False), ("p", 3, True), ("q", 1, True)}
    store = spark.createDataFrame([(1, "a")], "k int, v string")
    assert training.append_new(store, spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string"), ["k"]).count() == 2


def test_features(spark):
    rows = [service("a", services_rollup=[{"name": "Case Management", "taxonomies": [{"code": "t1"}]}]), service("b", name="North Clinics", services_rollup=[{"name": "Case Managment", "taxonomies": [{"code": "t1"}]}])]
    e = clean.clean_entities(schemas.ensure_frame(spark, rows, "entity"), "service")
    s = F.struct(*[F.col(c) for c in e.columns])
    pairs = e.where("entity_id = 'a'").select(F.lit("k").alias("pair_key"), s.alias("l")).crossJoin(e.where("entity_id = 'b'").select(s.alias("r")))
    f = features.pair_features(pairs).first()
    assert f.both_have_email == f.same_city == f.shared_service_names == f.percent_shared_taxonomies == 1.0 and f.shared_taxonomy_count == 2.0
    assert round(f.token_jaccard, 6) == 0.333333 and f.service_count_ratio == 1.0 and f.name_length_diff_in_tokens == 0.0
    assert features.tfidf(pairs, None).first().tfidf_weighted_similarity == 0.0
    model = spark.createDataFrame([("north", 2.0), ("clinic", 1.0)], "term string, idf double")
    t = features.tfidf(pairs, model).first()
    assert t.tfidf_weighted_similarity == pytest.approx(2 / 5**0.5) and t.max_distinctive_term_ratio == 0.5
    v = spark.createDataFrame([("bd-1800", [1.0, 0.0])], "code string, vector array<double>")
    assert features.taxonomy_embeddings(pairs, v).first().taxonomy_pairs_sim_gt_090_ratio == 0.25


def test_features_of_nothing(spark):
    """Empty and missing values give 0 and never null."""
    rows = [service("a", name="", description=None, emails=[], phones=[], websites=[], taxonomies=[], locations=[]), service("b", name="x", description="", organization_name="Org")]
    e = schemas.ensure_frame(spark, rows, "entity")
    s = F.struct(*[F.col(c) for c in e.columns])
    pairs = e.where("entity_id = 'a'").select(F.lit("k").alias("pair_key"), s.alias("l"), F.lit(None).cast("double").alias("embedding_similarity")).crossJoin(e.where("entity_id = 'b'").select(s.alias("r")))
    f = features.pair_features(pairs).first().asDict()
    zero = "name_jaro_winkler name_levenshtein name_token_sort name_complexity_ratio description_complexity_ratio num_services_ratio service_count_ratio description_length_ratio bigram_overlap org_name_levenshtein same_organization_id min_services".split()
    assert not any(f[z] for z in zero) and all(v is not None for v in f.values())
    for kind, n in (("organization", 25), ("service", 27)):
        fed = features.model_features(pairs, kind).first()
        assert len(fed) == n + 1 and fed.embedding_similarity == 0.0 and None not in tuple(fed)


@pytest.mark.parametrize("a,b", [("North Clinic", "north clinik"), ("MARTHA", "marhta"), ("a b c", "c b a")])
def test_name_features_against_difflib(spark, a, b):
    from difflib import SequenceMatcher

    row = spark.range(1).select(F.struct(F.lit(a).alias("name")).alias("l"), F.struct(F.lit(b).alias("name")).alias("r"))
    f = features.pair_features(row, groups=(features.names,)).first()
    x, y = a.lower(), b.lower()
    assert f.name_levenshtein == pytest.approx(SequenceMatcher(None, x, y).ratio())
    assert f.name_token_sort == pytest.approx(SequenceMatcher(None, " ".join(sorted(x.split())), " ".join(sorted(y.split()))).ratio())
    assert f.name_jaro_winkler == pytest.approx(fuzzy.jaro_winkler(x, y))


def test_signals_follow_the_type_of_each_pair(spark):
    same = dict(identifiers=[{"system": "npi", "value": "7"}], taxonomies=[{"code": "BD-1800"}])
    orgs, services = [service("x", **same), service("y", **same)], [service("x", **same), service("y", **same)]
    config = Config.default("organization")
    r = run_incremental(spark, orgs, services, config=config)
    kinds = {(x.entity_type, m.match_type) for x in r["scored_pairs"].collect() for m in r["pair_reasons"].where(F.col("pair_key") == x.pair_key).collect()}
    assert ("organization", "shared_identifier") in kinds
    weights = config.scoring.weights
    scores = {x.entity_type: x.deterministic_section_score for x in r["scored_pairs"].collect()}
    own = sum(weights[s] for s in ("shared_email", "shared_phone", "shared_domain", "shared_taxonomy"))
    place = weights["shared_address"]
    assert scores["organization"] == pytest.approx(min(1, (own + place + weights["shared_identifier"]) / sum(weights.values())))
    assert scores["service"] == pytest.approx((own + place) / (own + place))
    # an organization that goes takes no service of the same id with it
    again = run_incremental(spark, orgs[:1], services, r["entity_index"], r["pair_state"], config)
    assert {(x.entity_type) for x in again["pair_state"].collect()} == {"service"}


def test_queue_is_sorted_and_reasons_are_for_display(spark):
    rows = [service(k, locations=[{"address_1": "1 N Main St", "city": "Chicago", "state": "IL"}], name=n) for k, n in (("a", "North Clinic"), ("b", "North Clinic"), ("c", "Other Name Entirely"))]
    r = run_incremental(spark, None, rows, config=Config.default("service"))
    queue = r["review_queue"].collect()
    assert [f.name for f in schemas.schema("review_queue")] == r["review_queue"].columns and r["cluster_pairs"].columns == [f.name for f in schemas.schema("cluster_pairs")]
    assert [q.priority_score for q in queue] == sorted((q.priority_score for q in queue), reverse=True) and queue[0].pair_key == "a__b" and queue[0].team_id == "team"
    said = {x.match_type: x for x in r["pair_reasons"].where("pair_key = 'a__b'").collect()}
    assert said["shared_address"].matched_value == "1 north main street, chicago, il" and said["shared_taxonomy"].similarity_score == 1.0 and said["shared_email"].similarity_score is None
    assert said["shared_domain"].entity_a_value == "north.org" == said["shared_domain"].matched_value


SMALL = "text_clean content_hash delta_classify delta_summary removed_entities domain_extract domain_tiers taxonomy_levels taxonomy_score number_veto gate_first_pairs final_score_tier review_ledger label_consensus dataset_cut top_decile feat_completeness feat_tfidf feat_taxonomy_embedding model_features_service pair_reasons blocking_overview review_queue rollup_array_agg".split()


@pytest.mark.parametrize("name", SMALL)
def test_catalogue(spark, name):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, path)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["canonical_pairs", "number_veto"])
def test_products_by_nation_are_spread(spark, name):
    """Few nations and one file: all tasks of the cluster make pairs, and what concerns a single name is not worked out for each pair."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    above = df._jdf.queryExecution().optimizedPlan().toString().partition("Join ")[0]
    assert "regexp_extract_all" not in above


@pytest.mark.parametrize("small", [False, True])
def test_blocking_against_brute_force(spark, monkeypatch, small):
    """Both plans, with groups in one task or in blocks, for some anchors and a cap that cuts; only similar pairs leave a group."""
    if small:
        for name, value in (("_BLOCK", 5), ("_WIDE", 7), ("_CHUNK", 40)):
            monkeypatch.setattr(block, name, value)
    r = random.Random(3)
    codes = ["bd", "bd-1", "bd-2", "x"]
    pool = [[r.gauss(0.5, 1.0) for _ in range(3)] for _ in range(14)]
    own = {}
    for k in range(60):
        v = r.choice(pool)
        own[f"e{k:02d}"] = ({r.choice(codes), r.choice(codes)}, r.choice("123"), r.choice("pq"), v)
    rows = [service(i, taxonomies=[{"code": c} for c in sorted(cs)], emails=[f"{m}@h.org"], phones=[p], websites=[], locations=[], embedding_vector=v) for i, (cs, m, p, v) in own.items()]
    e = clean.clean_entities(schemas.ensure_frame(spark, rows, "entity"), "service")
    anchors = {i for i in own if int(i[1:]) % 3}
    changed = e.select("entity_id", "entity_type", F.when(F.col("entity_id").isin(*anchors), "changed").otherwise("unchanged").alias("delta_class"))
    up = lambda c: {c.rpartition("-")[0]} if "-" in c else {c[:-1]} - {""}

    def cosine(v, w):
        return sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5

    def reasons(a, b):
        related = any(x == y or x in up(y) or y in up(x) for x in a[0] for y in b[0])
        other = {"shared_email": a[1] == b[1], "shared_phone": a[2] == b[2]}
        return {k for k, x in other.items() if x} if related and cosine(a[3], b[3]) >= 0.75 else set()

    gated = {(a, b): reasons(own[a], own[b]) for a in anchors for b in own if a != b and reasons(own[a], own[b])}
    want = {}
    for a in anchors:
        for _, b in sorted((-round(cosine(own[a][3], own[b][3]), 9), b) for x, b in gated if x == a)[:4]:
            want["__".join(sorted((a, b)))] = {"embedding_threshold", "shared_taxonomy", *gated[a, b]}
    settings = dataclasses.replace(Config.default("service").blocking, max_candidates=4)
    for plan in ("gate", "cosine"):
        got = {x.pair_key: set(x.candidate_reason_codes) for x in block.candidates(e, changed, settings, plan=plan).collect()}
        assert len(want) > 60 and got.keys() == want.keys() and got == want
    wide = dataclasses.replace(settings, max_candidates=100)
    some = changed.where("delta_class = 'changed'")
    assert {(x.anchor, x.other) for x in block.gate_first(e, some, wide).collect()} == gated.keys()
    near = {(a, b) for a in anchors for b in own if a != b and cosine(own[a][3], own[b][3]) >= 0.75}
    assert {(x.anchor, x.other) for x in block.cosine_first(e, some, 0.75).collect()} == near
    first = {(x.anchor, x.other) for x in block.top_k(block.cosine_first(e, some, 0.75, best=1).withColumn("similarity", F.round("similarity", 6)), 1).collect()}
    assert first == {(a, min((-round(cosine(own[a][3], own[b][3]), 6), b) for x, b in near if x == a)[1]) for a in {a for a, _ in near}}
