"""Fuzzy comparison of names: pandas UDFs where Spark has no such function, columns elsewhere."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp; depends on the order of its arguments, two empty strings give 1."""
    return SequenceMatcher(None, a, b).ratio()


def jaro_winkler(a: str, b: str) -> float:
    """Prefix of 4 at most with scale 0.1, half transpositions count; an empty string gives 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _each(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """f over pairs of strings in Arrow batches, each distinct pair of a batch once; null for nulls."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}

        def one(x: str | None, y: str | None) -> float | None:
            if x is None or y is None:
                return None
            if (x, y) not in known:
                known[x, y] = f(x, y)
            return known[x, y]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(over, DoubleType())


sequence_ratio = _each(ratio)
jaro_winkler_score = _each(jaro_winkler)


def sorted_tokens(c: Column, pattern: str | None = None) -> Column:
    tokens = F.filter(F.split(c, r"\s+"), lambda x: x != "") if pattern is None else F.regexp_extract_all(c, F.lit(pattern), 0)
    return F.array_join(F.array_sort(tokens), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return sequence_ratio(sorted_tokens(a), sorted_tokens(b))


#: Algorithms by name; all take two columns.
ALGORITHMS: dict[str, Callable[[Column, Column], Column]] = {"sequence_matcher": sequence_ratio, "token_sort_ratio": token_sort_ratio, "jaro_winkler": jaro_winkler_score}


def algorithm(name: str, strict: bool = True) -> Callable[[Column, Column], Column]:
    if name not in ALGORITHMS and strict:
        raise ValueError(f"unknown fuzzy algorithm: {name}")
    return ALGORITHMS.get(name, sequence_ratio)


def numbers(c: Column) -> Column:
    """The distinct numbers of a name, sorted and joined; empty without any."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), 0))), " ")


def numbers_differ(x: Column, y: Column) -> Column:
    """Of :func:`numbers` of two names, worked out once for each name where it is in many pairs: both have some and they differ."""
    return (x != "") & (y != "") & (x != y)


def number_mismatch(a: Column, b: Column) -> Column:
    """Both names have digits and their sets of numbers differ."""
    return numbers_differ(numbers(a), numbers(b))


#: Safeguards in order: (left name, right name, similarity) -> similarity, not below 0.
Safeguard = Callable[[Column, Column, Column], Column]


def number_veto(a: Column, b: Column, similarity: Column) -> Column:
    return F.when(number_mismatch(a, b), F.lit(0.0)).otherwise(similarity)


def nlp_score(similarity: Column, deterministic: Column, fuzzy_threshold: float, standalone_threshold: float) -> Column:
    """The similarity from the threshold on; without other evidence from the standalone threshold on."""
    kept = F.when(similarity >= fuzzy_threshold, similarity).otherwise(F.lit(0.0))
    return F.when((deterministic <= 0) & (kept < standalone_threshold), F.lit(0.0)).otherwise(kept)


def _greedy(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many names of a find a name of b, not taken before, with Jaro-Winkler above 0.85."""

    def count(x, y) -> int:
        left, n = list(y if y is not None else []), 0
        for name in x if x is not None else []:
            k = next((k for k, other in enumerate(left) if jaro_winkler(name, other) > 0.85), None)
            if k is not None:
                left.pop(k)
                n += 1
        return n

    return pd.Series([count(x, y) for x, y in zip(a, b)], dtype="int64")


greedy_name_matches = F.pandas_udf(_greedy, LongType())


def ngrams(text: str, n: int) -> set[tuple[str, ...]]:
    tokens = re.findall(r"\w+", text.lower())
    return set(zip(*(tokens[k:] for k in range(n))))
