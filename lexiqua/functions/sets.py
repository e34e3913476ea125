"""Set and multiset similarity of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiqua.functions import text

#: Weights of nouns, predicates, participles and connectives.
WEIGHTS = (0.50, 0.30, 0.15, 0.05)


def jaccard(a: Column, b: Column) -> Column:
    """1.0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def inclusion(broad: Column, narrow: Column) -> Column:
    """Part of ``narrow``'s tokens, repeats counted, that are in ``broad``."""
    return F.size(F.filter(narrow, lambda t: F.array_contains(broad, t))) / F.greatest(F.size(narrow), F.lit(1))


def profile(c: Column) -> Column:
    """A text's four word sets, computed once and compared often."""
    return text.word_classes(c)


def percent_similarity(a: Column, b: Column) -> Column:
    parts = (jaccard(a[k], b[k]) * w for k, w in zip(("nouns", "predicates", "participles", "connectives"), WEIGHTS, strict=True))
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total * 100
