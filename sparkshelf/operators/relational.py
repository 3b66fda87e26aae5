"""Joins, set operations, sorts, limits and samples that the pipeline is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import keep_first

ASKED, CELLS = 200_000, 8


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is among keys. Spark makes Python columns before a semi-join, so up to ASKED keys first filter by a
    table of hashes (CELLS bytes a key), a condition that does go below them: texts of other rows aren't normalised."""
    keys = keys.select(key).distinct()
    n = keys.count()
    if n > ASKED:
        return df.join(keys, key, "left_semi")
    cells = bytearray(max(64, CELLS * n))
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(len(cells))).cast("int")
    for r in keys.where(F.col(key).isNotNull()).select(at.alias("at")).collect():  # ASKED at most
        cells[r["at"]] = 1
    return df.where(F.substring(F.lit(bytes(cells)), at + 1, 1) == F.lit(b"\x01")).join(F.broadcast(keys), key, "left_semi")

def lookup(left: DataFrame, right: DataFrame, key: str, value: str, default=None, last: bool = True) -> DataFrame:
    """left with `value` of the last (or first) row of right for its key; `default` where there is none."""
    out = left.join(keep_first(right, key, last=last).select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def attach_query_id(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs with the id of their query text (the last of equal texts); others go."""
    return pairs.join(keep_first(queries, "query", last=True).select("query", "query_id"), "query")


def raw_query_text(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates whose query is the raw text of its id, else what they had, else empty."""
    names = keep_first(queries, "query_id").select("query_id", F.col("query_raw").alias("_raw"))
    return candidates.join(names, "query_id", "left").withColumn("query", F.coalesce("_raw", "query", F.lit(""))).drop("_raw")


def in_rank_order(products: DataFrame, ranked: DataFrame) -> DataFrame:
    """Products of a ranked list, with their rank."""
    return ranked.join(keep_first(products, "p_id"), "p_id")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return difference(a, b, key).isEmpty()


def top_per_group(df: DataFrame, group: str, score: str, k: int, tie: str = "ord") -> DataFrame:
    """The k best rows of each group with their rank from 1; scores equal to nine decimals tie. row_number() <= k lets Spark limit groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_common(df: DataFrame, key: str, k: int, order: str = "ord") -> DataFrame:
    """The k most frequent values, ties by first appearance."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).orderBy(F.col("n").desc(), "first_ord").limit(k)


def head(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(n)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of md5(seed, key): the same rows however the table is partitioned. The keys are drawn first, so that
    only the rows of n keys are read whole and sorted."""
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    if df.columns == [key]:
        return df.orderBy(*order).limit(n)
    drawn = df.select(key).orderBy(*order).limit(n).collect()  # n keys
    if any(r[0] is None for r in drawn):
        return df.orderBy(*order).limit(n)
    keys = df.sparkSession.createDataFrame(list({r[0]: r for r in drawn}.values()), df.select(key).schema)
    return only(df, keys, key).orderBy(*order).limit(n)
