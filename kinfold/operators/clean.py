"""Cleaning, content hashes and classification against the previous snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import conform


def clean_entities(raw: DataFrame, entity_type: str, strict: bool = True) -> DataFrame:
    """Normalised entities of one type with their content hashes; embeddings and display fields don't enter the hash.

    Strict: an empty embedding, or one of another length, is an error, raised when the rows are computed; otherwise they are padded with zeros.
    """
    d = conform(raw, "entity")
    out = d.select(
        text.clean_text(F.col("entity_id")).alias("entity_id"),
        F.lit(entity_type).alias("entity_type"),
        text.clean_text(F.col("source_schema")).alias("source_schema"),
        text.clean_text(F.col("name")).alias("name"),
        text.clean_text(F.col("description")).alias("description"),
        *[text.clean_list(F.col(c)).alias(c) for c in ("emails", "phones", "websites")],
        F.coalesce("locations", F.array().cast(d.schema["locations"].dataType)).alias("locations"),
        clean_taxonomies(F.col("taxonomies")).alias("taxonomies"),
        F.coalesce("identifiers", F.array().cast(d.schema["identifiers"].dataType)).alias("identifiers"),
        F.transform(F.coalesce("services_rollup", F.array().cast(d.schema["services_rollup"].dataType)), lambda s: F.struct(s["name"].alias("name"), clean_taxonomies(s["taxonomies"]).alias("taxonomies"))).alias("services_rollup"),
        text.clean_text(F.col("organization_name")).alias("organization_name"),
        text.clean_text(F.col("organization_id")).alias("organization_id"),
        F.coalesce("embedding_vector", F.array().cast("array<double>")).alias("embedding_vector"),
        text.display_text(F.col("name")).alias("display_name"),
        text.display_text(F.col("organization_name")).alias("display_organization_name"),
    )
    tokens = [F.concat(F.lit(f"{c}="), v) for c, v in (
        ("name", F.col("name")), ("description", F.col("description")), *((c, F.to_json(F.col(c))) for c in ("emails", "phones", "websites")),
        *((c, text.sorted_json(F.col(c))) for c in ("locations", "taxonomies", "identifiers", "services_rollup")), ("organization_name", F.col("organization_name")), ("organization_id", F.col("organization_id")),
    )]
    out = out.withColumn("content_hash", text.hash_values(F.col("entity_id"), F.col("entity_type"), F.col("source_schema"), *tokens))
    widest = F.broadcast(out.agg(F.coalesce(F.max(F.size("embedding_vector")), F.lit(0)).alias("__widest")))
    out = out.crossJoin(widest)
    size = F.size("embedding_vector")
    if strict:
        fault = F.raise_error(F.concat(F.lit("embedding of "), F.col("entity_id"), F.lit(" is empty or of another length"))).cast("array<double>")
        vector = F.when((size == 0) | (size != F.col("__widest")), fault).otherwise(F.col("embedding_vector"))
    else:
        vector = F.concat("embedding_vector", F.array_repeat(F.lit(0.0), (F.col("__widest") - size).cast("int")))
    return out.withColumn("embedding_vector", vector).drop("__widest")


def clean_taxonomies(c):
    """Taxonomies with lower-case codes, the first of each code, sorted by code; those without a code are left out."""
    own = F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<code:string,name:string>>")), lambda x: F.struct(text.clean_text(x["code"]).alias("code"), x["name"].alias("name"))), lambda x: x["code"] != "")
    first = F.filter(own, lambda x, i: ~F.exists(F.slice(own, F.lit(1), i), lambda y: y["code"] == x["code"]))
    return F.array_sort(first, lambda x, y: F.when(x["code"] < y["code"], -1).when(x["code"] > y["code"], 1).otherwise(0))


def entity_index(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", "entity_type", "content_hash", F.lit(True).alias("active_flag"))


def prior_index(previous: DataFrame) -> DataFrame:
    """The previous index, normalised; rows without a flag are active."""
    d = conform(previous, "entity_index")
    return d.select(*[text.clean_text(F.col(c)).alias(c) for c in ("entity_id", "entity_type", "content_hash")], F.coalesce("active_flag", F.lit(True)).alias("active_flag"))


def classify(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current ids with delta_class added, changed or unchanged; ids of the previous snapshot that are gone)."""
    prior = prior_index(previous).where("active_flag").select("entity_id", "entity_type", F.col("content_hash").alias("prior_hash"))
    both = current.select("entity_id", "entity_type", "content_hash").join(prior, ["entity_id", "entity_type"], "left")
    delta = F.when(F.col("prior_hash").isNull(), "added").when(F.col("prior_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    gone = prior.join(current.select("entity_id", "entity_type"), ["entity_id", "entity_type"], "left_anti").select("entity_id", "entity_type")
    return both.select("entity_id", "entity_type", delta.alias("delta_class")), gone


def delta_summary(classified: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: added, changed, unchanged, removed and no_change."""
    counts = classified.agg(*[F.count_if(F.col("delta_class") == c).alias(c) for c in ("added", "changed", "unchanged")])
    return counts.crossJoin(removed.agg(F.count("*").alias("removed"))).withColumn("no_change", (F.col("added") == 0) & (F.col("changed") == 0) & (F.col("removed") == 0))
