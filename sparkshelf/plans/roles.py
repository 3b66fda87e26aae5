"""Views of the supplied tables in the roles of the engine: products, queries, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as products: ord, p_id, title, category, brand, attributes, text. A document has no title, so its first 80
    characters stand for one, and its first line for attributes: a fixture's shape, beside the whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("p_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("lang").alias("category"),
        F.col("source").alias("brand"),
        F.substring_index("text", "\n", 1).alias("attributes"),
        F.col("text"),
    )


def products_norm(spark: SparkSession, sf_dir: str, how: C.Preparation = C.Preparation()) -> DataFrame:
    """products with the normalised columns of indexes and features; only those asked for are computed."""
    p = products(spark, sf_dir)
    return p.withColumns({"text_norm": how.norm("text"), "title_norm": how.norm("title"), "brand_norm": how.norm("brand"), "attributes_norm": how.norm("attributes"), "attributes_list": C.A.split_attributes("attributes")})


def products_text(spark: SparkSession, sf_dir: str, how: C.Preparation = C.Preparation()) -> DataFrame:
    """ord, p_id and text_norm of products; each scan normalises anew, which costs less than keeping the texts."""
    return products(spark, sf_dir).select("ord", "p_id", how.norm("text").alias("text_norm"))


def queries(spark: SparkSession, sf_dir: str, how: C.Preparation = C.Preparation()) -> DataFrame:
    """benchmark items as queries: ord, query_id, query, query_raw, query_norm."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("query_raw"), how.norm("text").alias("query_norm"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, query, p_id) of orders: the customer as query, the part as product."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("query"), F.col("l_partkey").cast("string").alias("p_id"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, p_id): documents of quality label 1, dealt to 40 queries by number: a fixed relevance for tests."""
    lab = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return lab.select((F.col("doc_id") % 40).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("p_id"))
