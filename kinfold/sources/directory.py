"""Entities of a directory from its normalised tables, their embeddings and taxonomy vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def rolled(df: DataFrame, owner: str, value: Column, name: str) -> DataFrame:
    """owner and a sorted array of the distinct values of its rows that aren't null."""
    return df.select(F.col(owner).alias(owner), value.alias("__v")).where("__v is not null").groupBy(owner).agg(F.array_sort(F.collect_set("__v")).alias(name))


def taxonomies(links: DataFrame, terms: DataFrame, owner: str) -> DataFrame:
    """owner and its taxonomies (code, name) by links (owner, taxonomy_id) and terms (taxonomy_id, code, name); terms without a code are none."""
    own = links.join(terms, "taxonomy_id").where("coalesce(code, '') <> ''")
    return rolled(own, owner, F.struct(F.lower("code").alias("code"), "name"), "taxonomies")


def locations(places: DataFrame, addresses: DataFrame, owner: str, at: DataFrame | None = None) -> DataFrame:
    """owner and its locations. places (location_id, latitude, longitude, location_type) have the owner themselves or through ``at`` (owner, location_id); one
    without an address (location_id, address_1, city, state, postal_code) has nulls. Coordinates that aren't numbers are null."""
    own = at.select(owner, "location_id").distinct().join(places.drop(owner), "location_id") if at is not None else places
    full = own.join(addresses, "location_id", "left")
    place = F.struct("location_id", "address_1", "city", "state", "postal_code", coordinate(F.col("latitude")).alias("latitude"), coordinate(F.col("longitude")).alias("longitude"), "location_type")
    return rolled(full, owner, place, "locations")


def coordinate(c: Column) -> Column:
    """A number, however it is stored; anything else is null."""
    number = c.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def phones(owner: str, *paths: DataFrame) -> DataFrame:
    """owner and the distinct cleaned numbers of all paths (owner, number): its own, those of its locations, of its services and so on."""
    every = reduce(DataFrame.unionByName, [p.select(owner, "number") for p in paths])
    return rolled(every, owner, F.nullif(text.clean_text(F.col("number")), F.lit("")), "phones")


def services(own: DataFrame, codes: DataFrame, owner: str) -> DataFrame:
    """owner and its services (id, name, codes) by own (owner, service_id, name) and codes (service_id, taxonomies)."""
    full = own.join(codes, "service_id", "left")
    listed = F.transform(F.coalesce("taxonomies", F.array()), lambda t: t["code"])
    return rolled(full, owner, F.struct(F.col("service_id").alias("id"), "name", listed.alias("codes")), "services_rollup")


def embedding_text(entity_type: str) -> Column:
    """What is embedded of an entity."""
    return F.concat(F.lit(entity_type.upper() + ": "), F.coalesce("name", F.lit("")), F.lit(" - "), F.coalesce("description", F.lit("")))


STATES = ("reused", "entry_miss", "hash_missing", "hash_malformed", "hash_case_only", "hash_mismatch", "invalid_vector")


def embedding_states(entities: DataFrame, cache: DataFrame, entity_type: str) -> DataFrame:
    """entity_id, embed_text, semantic_hash, state and embedding of each entity: the cache's vector where its hash is that of the text, else null and why.

    cache has entity_id, hash and embedding.
    """
    own = entities.withColumn("embed_text", embedding_text(entity_type)).withColumn("semantic_hash", F.sha2("embed_text", 256))
    both = own.join(cache.select("entity_id", F.col("hash").alias("__hash"), F.col("embedding").alias("__v"), F.lit(True).alias("__hit")), "entity_id", "left")
    h, v = F.col("__hash"), F.col("__v")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    state = (
        F.when(F.col("__hit").isNull(), "entry_miss").when(h.isNull() | (h == ""), "hash_missing").when((h == F.col("semantic_hash")) & bad, "invalid_vector").when(h == F.col("semantic_hash"), "reused")
        .when(F.lower(h) == F.col("semantic_hash"), "hash_case_only").when(~F.regexp_like(h, F.lit("^[0-9a-fA-F]{64}$")), "hash_malformed").otherwise("hash_mismatch")
    )
    return both.withColumn("state", state).select("entity_id", "embed_text", "semantic_hash", "state", F.when(F.col("state") == "reused", v).alias("embedding"))


def ensure_embeddings(entities: DataFrame, cache: DataFrame, entity_type: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entity_id, embedding of every entity; entity_id, hash, embedding to put into the cache). embed takes entity_id and embed_text of what isn't fresh and gives entity_id and embedding."""
    states = embedding_states(entities, cache, entity_type)
    stale = states.where("state <> 'reused'")
    made = embed(stale.select("entity_id", "embed_text")).select("entity_id", "embedding")
    fresh = states.where("state = 'reused'").select("entity_id", "embedding")
    return fresh.unionByName(made), stale.select("entity_id", F.col("semantic_hash").alias("hash")).join(made, "entity_id")


def taxonomy_vectors(rows: DataFrame, code: str = "code", vector: str = "vector") -> DataFrame:
    """code and vector of rows whose vector is an array or JSON of one; rows without a code or with anything else are left out, of equal codes the first vector counts."""
    v = F.from_json(F.col(vector), "array<double>") if dict(rows.dtypes)[vector] == "string" else F.col(vector).cast("array<double>")
    own = rows.select(F.col(code).alias("code"), v.alias("vector")).where("coalesce(code, '') <> '' and size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull()))
    return own.groupBy("code").agg(F.min("vector").alias("vector"))


def tfidf_model(spark, folders: tuple[str | None, ...], entity_type: str) -> DataFrame | None:
    """term and idf from tfidf_<type>.parquet of the first folder that has it: an override first, then the usual one; None where none has."""
    from pyspark.errors import AnalysisException

    for folder in folders:
        if folder:
            try:
                return spark.read.parquet(f"{folder}/tfidf_{entity_type}.parquet").select("term", F.col("idf").cast("double").alias("idf"))
            except AnalysisException:
                continue
    return None
