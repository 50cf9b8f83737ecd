"""Taxonomy codes: levels, parents, matches and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECAY = 0.7


def levels(code: Column) -> Column:
    """Cumulative prefixes of a code: letter by letter of an alphabetic head, then by each part after - or ."""
    own = F.lower(F.trim(code))
    head = F.regexp_extract(own, r"^[^-.]*", 0)
    by_letter = F.when(F.regexp_like(head, F.lit("^[a-z]+$")), F.transform(F.sequence(F.lit(1), F.greatest(F.length(head), F.lit(1))), lambda i: F.substring(head, F.lit(1), i))).otherwise(F.array(head))
    tails = F.regexp_extract_all(F.substring(own, F.length(head) + 1, F.length(own)), F.lit("[-.]+[^-.]+"), 0)
    joined = F.transform(F.sequence(F.lit(0), F.size(tails)), lambda n: F.concat(head, F.array_join(F.slice(tails, F.lit(1), n), "")))
    return F.when(F.coalesce(own, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(by_letter, F.slice(joined, F.lit(2), F.greatest(F.size(tails), F.lit(0))))))


def parents(code: Column) -> Column:
    own = levels(code)
    return F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))


def parent(code: Column) -> Column:
    """The level above, null at the top."""
    own = levels(code)
    return F.try_element_at(own, F.greatest(F.size(own) - 1, F.lit(1))).substr(F.lit(1), F.when(F.size(own) > 1, F.length(code)).otherwise(F.lit(None).cast("int")))


def related(a: Column, b: Column) -> Column:
    """Equal, or one the direct parent of the other; siblings and grandparents are not."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x == y) | (x == parent(b)) | (parent(a) == y), F.lit(False))


def pair_score(a: Column, b: Column) -> Column:
    """0.7 for each level between the deepest common ancestor and the deeper code; 0 without an ancestor."""
    x, y = levels(a), levels(b)
    common = F.size(F.array_intersect(x, y))
    return F.when(common > 0, F.pow(F.lit(DECAY), F.greatest(F.size(x), F.size(y)) - common)).otherwise(F.lit(0.0))


def best_overlap(left: Column, right: Column) -> Column:
    """(score, ancestor) of the best pair of codes; the first in sorted order of equals, null without any."""

    def one(a: Column, b: Column) -> Column:
        shared = F.array_intersect(levels(a), levels(b))
        return F.struct(pair_score(a, b).alias("score"), F.try_element_at(shared, F.lit(-1)).alias("ancestor"))

    every = F.flatten(F.transform(F.array_sort(left), lambda a: F.transform(F.array_sort(right), lambda b: one(a, b))))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("ancestor"))
    return F.aggregate(every, none, lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))


def code_set(direct: Column, services: Column | None = None, ancestors: bool = False) -> Column:
    """Codes of an entity, with those of its services and, if asked for, all levels above."""
    own = F.transform(F.coalesce(direct, F.array()), lambda x: F.lower(F.trim(x["code"])))
    if services is not None:
        own = F.array_union(own, F.flatten(F.transform(F.coalesce(services, F.array()), lambda s: F.transform(F.coalesce(s["taxonomies"], F.array()), lambda x: F.lower(F.trim(x["code"]))))))
    own = F.filter(F.array_distinct(own), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(own, levels))) if ancestors else own)
