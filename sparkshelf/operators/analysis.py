"""Corpus analytics: summaries, frequencies, distributions, overlap, coverage, report."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import relational as R
from . import scan as S

SAMPLE = 5000


def _token_count(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else len(S._WORD(x)) for x in texts], dtype=object)


def catalog_summary(products: DataFrame, text: str = "text_norm", sample: int = SAMPLE) -> DataFrame:
    """One row: n_products, avg_tokens, median_tokens, avg_chars, pct_with_attributes, vocab_size_sample."""
    n = F.pandas_udf(_token_count, "int")(text)  # where the normaliser runs, so no text comes back from it
    chars = F.avg(F.length("text" if "text" in products.columns else text))
    attrs = F.avg((F.size("attributes_list") > 0).cast("int")) if "attributes_list" in products.columns else F.lit(None).cast("double")
    base = products.agg(F.count("*").alias("n_products"), F.avg(n).alias("avg_tokens"), F.percentile(n, 0.5).alias("median_tokens"), chars.alias("avg_chars"), attrs.alias("pct_with_attributes"))
    words = R.sample(products.select("p_id", text), sample, "p_id").select(F.explode(T.tokens(text)).alias("t"))
    return base.crossJoin(words.agg(F.count_distinct("t").alias("vocab_size_sample")))  # one row each


def token_frequency(products: DataFrame, k: int = 50, text: str = "text_norm") -> DataFrame:
    """(token, n): the k most frequent, ties by first appearance (row, then place). Tasks count in dictionaries of
    `scan.HELD_TERMS` tokens or so; sums and first places are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, last = Counter(), {}, -(1 << 63)

        def out() -> pa.RecordBatch:
            places = [first[t] for t in total]
            got = pa.RecordBatch.from_pydict({"token": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64()), "ord": pa.array([x[0] for x in places], pa.int64()), "pos": pa.array([x[1] for x in places], pa.int64())})
            total.clear()
            first.clear()
            return got

        for b in S._slices(batches, 1000):
            for place, x in zip(b.column("_ord").to_pylist(), b.column("_text").to_pylist()):
                if x is None:
                    continue
                words = S._WORD(x)
                total.update(words)
                # In rows of rising place only tokens not met before have their first one here.
                for t in set(words).difference(first) if place > last else set(words):
                    first[t] = min(first.get(t, (place, len(words))), (place, words.index(t)))
                last = max(last, place)
                if len(total) > S.HELD_TERMS:
                    yield out()
        yield out()

    parts = products.select(F.col("ord").cast("bigint").alias("_ord"), F.col(text).alias("_text")).mapInArrow(count, "token string, n bigint, ord bigint, pos bigint")
    counted = parts.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    return counted.orderBy(F.col("n").desc(), "first").limit(k).select("token", "n")


def value_frequency(products: DataFrame, column: str, k: int = 30) -> DataFrame:
    """(value, n) of the stripped raw values of a column, null as empty."""
    values = products.select("ord", T.strip(F.coalesce(F.col(column), F.lit(""))).alias("value"))
    return R.most_common(values, "value", k).select("value", "n")


def attribute_frequency(products: DataFrame, k: int = 50) -> DataFrame:
    parts = products.select("ord", F.posexplode("attributes_list").alias("pos", "value"))
    counted = parts.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    return counted.orderBy(F.col("n").desc(), "first").limit(k).select("value", "n")


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct("query").alias("unique_queries"), F.count_distinct("p_id").alias("unique_pids"))


def queries_by_products(pairs: DataFrame, k: int = 20) -> DataFrame:
    """(query, n): queries of the most distinct products."""
    return pairs.groupBy("query").agg(F.count_distinct("p_id").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.col("n").desc(), "first_ord").limit(k).select("query", "n")


def query_length_distribution(queries: DataFrame, column: str = "query") -> DataFrame:
    n = F.size(T.tokens(column))
    return queries.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.9).alias("p90"), F.percentile(n, 0.95).alias("p95"))


def lexical_overlap(pairs: DataFrame, products: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Share of the raw query's distinct tokens in the product's normalised text, over a sample of pairs: mean, median, population deviation, p90."""
    some = R.sample(pairs, sample, "ord")
    joined = R.lookup(some, R.only(products, some, "p_id"), "p_id", "text_norm", "")
    q, p = F.array_distinct(T.tokens("query")), T.tokens("text_norm")
    share = F.when(F.size(q) > 0, A.overlap(q, p) / F.size(q)).otherwise(F.lit(0.0))
    return joined.select(share.alias("o")).agg(F.avg("o").alias("mean"), F.percentile("o", 0.5).alias("median"), F.stddev_pop("o").alias("std"), F.percentile("o", 0.9).alias("p90"))


def coverage(pairs: DataFrame, products: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts of distinct and missing train products, the first k missing ids in order)."""
    missing = R.difference(pairs, products, "p_id")
    counts = pairs.agg(F.count_distinct("p_id").alias("n_train_pids")).crossJoin(missing.agg(F.count("*").alias("n_missing")))  # one row each
    return counts, missing.orderBy("p_id").limit(k)


def histogram(df: DataFrame, value, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the range of value; the last bin is closed."""
    values = df.select(T.c_(value).cast("double").alias("v")).where("v is not null")
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    wide = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col("v") - lo) / wide), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * wide).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * wide).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def report(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """The analysis report as one row of nested columns, ready for write.json. Each part is one row or a top-k list."""
    as_list = lambda df, a: df.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(a).alias("k"), "n"))), lambda x: F.struct(x["k"].alias("value"), x["n"].alias("n"))).alias("x"))
    parts = {
        "products_summary": catalog_summary(products).select(F.struct("*").alias("x")),
        "top_product_tokens_50": as_list(token_frequency(products, 50), "token"),
        "brands_top_30": as_list(value_frequency(products, "brand", 30), "value"),
        "train_summary": pair_summary(pairs).select(F.struct("*").alias("x")),
        "query_len_dist": query_length_distribution(pairs).select(F.struct("*").alias("x")),
        "lexical_overlap_sample": lexical_overlap(pairs, products).select(F.struct("*").alias("x")),
        "coverage": coverage(pairs, products)[0].select(F.struct("*").alias("x")),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("x", name)
        out = part if out is None else out.crossJoin(part)  # one row each
    return out
