"""Array and set scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

EPS = 1e-9


def split_attributes(col) -> Column:
    """Parts of an attribute text, stripped, empty ones dropped; null gives none."""
    parts = F.transform(F.split(F.coalesce(T.c_(col), F.lit("")), T.ATTRIBUTE_SEPARATORS), T.strip)
    return F.filter(parts, lambda x: x != "")


def coerce_attributes(col) -> Column:
    """A list as it is; a text split at comma, Arabic comma, full-width semicolon and newline; null as no attribute."""
    parts = F.transform(F.split(F.coalesce(T.c_(col), F.lit("")), "[,،；\\n]"), T.strip)
    return F.filter(parts, lambda x: x != "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as sets."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def overlap_ratio(query: Column, other: Column) -> Column:
    return overlap(query, other) / (F.size(F.array_distinct(query)) + F.lit(EPS))


def share_present(query: Column, other: Column) -> Column:
    """Share of the query's members, repeats counted, that the other array holds."""
    return F.when(F.size(query) > 0, F.size(F.filter(query, lambda x: F.array_contains(other, x))) / F.size(query)).otherwise(F.lit(0.0))


def attribute_matches(attributes: Column, query_text: Column, query_tokens: Column) -> Column:
    """Number of attributes that occur in the query or share a token with it."""
    return F.size(F.filter(attributes, lambda a: T.contains(query_text, a) | F.arrays_overlap(T.tokens(a), query_tokens)))


def ratio_of(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def attribute_tokens(attributes: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(attributes, T.tokens_split)))


def top_k(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def padded(values: Column, k: int, fill: str = "") -> list[Column]:
    """k columns of the first k values, `fill` where there are fewer."""
    return [F.coalesce(F.try_element_at(values, F.lit(i)), F.lit(fill)) for i in range(1, k + 1)]
