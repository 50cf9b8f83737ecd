"""Text, hash, address and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPANSIONS = tuple(p.split(":") for p in "n:north s:south e:east w:west st:street ave:avenue blvd:boulevard rd:road dr:drive ln:lane ct:court".split())


def clean_text(c: Column) -> Column:
    """Lower case, Unicode white space collapsed and trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)\s+", " "))


def clean_list(c: Column) -> Column:
    """Cleaned, non-empty, distinct and sorted strings; null becomes an empty array."""
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_text)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def display_text(c: Column) -> Column:
    """White space collapsed with case kept; the empty string becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), F.lit(""))


def hash_values(*values: Column) -> Column:
    """SHA-256 of the cleaned values joined by two bars."""
    return F.sha2(F.concat_ws("||", *[clean_text(v) for v in values]), 256)


def sorted_json(c: Column) -> Column:
    """An array of structs as JSON, whatever the order of its elements; nulls are left out."""
    return F.to_json(F.array_sort(F.transform(F.coalesce(c, F.array()), lambda x: F.lower(F.to_json(x)))))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("__"), F.greatest(a, b))


def first_present(*values: Column) -> Column:
    """The first of the aliases of a field that isn't empty."""
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values])


def address_component(c: Column, expansions=EXPANSIONS) -> Column:
    """Cleaned text of letters and digits with street words spelled out, one after another; of adjacent equal ones only the first."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(clean_text(c), r"[^a-z0-9\s]", " "), r"\s+", " ")), F.lit(" "))
    for short, long in expansions:
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {long} "))
    return F.trim(out)


def canonical_addresses(locations: Column) -> Column:
    """street|city|state|postal of each location, empty parts left out, as a clean list."""

    def one(x: Column) -> Column:
        parts = F.array(*[address_component(x[k]) for k in ("address_1", "city", "state", "postal_code")])
        return F.array_join(F.filter(parts, lambda p: p != ""), "|")

    return clean_list(F.transform(F.coalesce(locations, F.array()), one))


def canonical_identifiers(identifiers: Column) -> Column:
    """system|value of identifiers that have both."""
    both = F.filter(F.coalesce(identifiers, F.array()), lambda x: (clean_text(x["system"]) != "") & (clean_text(x["value"]) != ""))
    return clean_list(F.transform(both, lambda x: F.concat(clean_text(x["system"]), F.lit("|"), clean_text(x["value"]))))


def location_keys(locations: Column) -> Column:
    """city and state of locations that have both, joined by the unit separator."""
    both = F.filter(F.coalesce(locations, F.array()), lambda x: (clean_text(x["city"]) != "") & (clean_text(x["state"]) != ""))
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: F.concat(clean_text(x["city"]), F.lit("\x01"), clean_text(x["state"])))))


def reason_text(values: Column, match_type: Column) -> Column:
    """Values of a reason for display: addresses with commas and semicolons, all else with commas; none is null."""
    address = F.replace(F.array_join(values, "; "), F.lit("|"), F.lit(", "))
    return F.nullif(F.when(match_type == "shared_address", address).otherwise(F.array_join(values, ", ")), F.lit(""))


def coerced_json(c: Column) -> Column:
    """A string as a JSON variant: null is an empty array, text that isn't JSON is a string."""
    return F.coalesce(F.try_parse_json(F.coalesce(c, F.lit("[]"))), F.parse_json(F.to_json(F.array(c))))


def word_set(c: Column) -> Column:
    """Distinct words (letters, digits and underscores) of the cleaned text."""
    return F.array_distinct(F.regexp_extract_all(clean_text(c), F.lit(r"(?U)\w+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared values over the longer list; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))
