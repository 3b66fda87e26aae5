"""Pair features, batched over all (query, product) pairs: set A (16, train and serve rules) and set B (16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import index as I
from . import relational as R
from . import retrieval as V
from .catalog import keep_first

SET_A = [
    "tfidf_cosine", "bm25", "jaccard_tokens", "overlap_count", "query_len", "prod_len", "title_fuzzy", "brand_exact",
    "category_exact", "attr_overlap_count", "attr_overlap_ratio", "digit_overlap_ratio", "num_query_digits",
    "model_token_match", "num_q_model_tokens", "train_product_freq",
]
SET_B = [
    "bm25_score", "tfidf_score", "brand_match", "category_match", "model_match", "numeric_match", "token_overlap",
    "token_overlap_ratio", "attr_overlap", "title_contains_query", "title_prefix_match", "popularity",
    "num_query_tokens", "num_title_tokens", "len_query", "len_title",
]


def _flag(condition):
    return F.coalesce(condition, F.lit(False)).cast("int")


def _score_of(pairs: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    return pairs.join(scores, ["query_id", "p_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _with_products(candidates: DataFrame, products: DataFrame) -> DataFrame:
    names = [n for n in ("title", "brand", "category", "title_norm", "brand_norm", "attributes_norm", "attributes_list", "text_norm") if n in products.columns]
    asked = R.only(products, candidates, "p_id")
    return candidates.join(keep_first(asked, "p_id").select("p_id", *names), "p_id", "left")


def _frequency(pairs: DataFrame, train_pairs: DataFrame, name: str) -> DataFrame:
    popular = I.popularity(train_pairs).withColumnRenamed("n", name)
    return pairs.join(popular, "p_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def train_features(candidates: DataFrame, queries: DataFrame, products: DataFrame, train_pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(query_id, query, p_id) + set A by the training rules, for candidates (query_id, p_id). Query text is the normalised one."""
    q = queries.select("query_id", F.col("query_norm").alias("q"), F.col("query_norm").alias("query"))
    base = _with_products(candidates.select("query_id", "p_id").join(q, "query_id"), products)
    base = _score_of(base, I.tfidf_scores(queries, products, I.TFIDF_TRAIN, pairs=base).withColumnRenamed("tfidf", "tfidf_cosine"), "tfidf_cosine")
    base = _score_of(base, I.bm25_scores(queries, products, I.TRAIN, pairs=base), "bm25")
    base = _frequency(base, train_pairs, "train_product_freq")
    base = base.withColumns({"qt": T.tokens("q"), "pt": T.tokens(F.coalesce("text_norm", F.lit(""))), "qd": T.digit_runs("q"), "pd": T.digit_runs(F.coalesce("text_norm", F.lit("")))})
    base = base.withColumns({"qm": F.array_distinct(T.model_tokens_loose(F.col("qt"))), "pm": T.model_tokens_loose(F.col("pt")), "attrs": F.coalesce("attributes_list", F.array().cast("array<string>"))})
    matches = A.attribute_matches(F.col("attrs"), F.col("q"), F.col("qt"))
    return base.select(
        "query_id", "query", "p_id", "tfidf_cosine", "bm25",
        A.jaccard(F.col("qt"), F.col("pt")).alias("jaccard_tokens"),
        A.overlap(F.col("qt"), F.col("pt")).alias("overlap_count"),
        F.size("qt").alias("query_len"),
        F.size("pt").alias("prod_len"),
        (T.fuzzy_ratio(F.col("q"), F.coalesce("title", F.lit(""))) if fuzzy else F.lit(0.0)).alias("title_fuzzy"),
        _flag(T.contains("q", T.strip("brand"))).alias("brand_exact"),
        _flag(T.contains("q", T.strip("category"))).alias("category_exact"),
        matches.alias("attr_overlap_count"),
        A.ratio_of(matches, F.size("attrs")).alias("attr_overlap_ratio"),
        A.share_present(F.col("qd"), F.col("pd")).alias("digit_overlap_ratio"),
        F.size("qd").alias("num_query_digits"),
        A.overlap(F.col("qm"), F.col("pm")).alias("model_token_match"),
        F.size("qm").alias("num_q_model_tokens"),
        "train_product_freq",
    )


def serve_features(candidates: DataFrame, queries: DataFrame, products: DataFrame, train_pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(query_id, query, p_id) + set A by the serving rules: raw queries, white-space tokens, digit characters, no model tokens."""
    q = queries.select("query_id", T.strip("query").alias("query"))
    base = _with_products(candidates.select("query_id", "p_id").join(q, "query_id"), products)
    text = F.coalesce("text_norm", F.lit(""))
    base = _score_of(base, I.tfidf_scores(q.withColumnRenamed("query", "query_norm"), products, I.TFIDF_SERVE, pairs=base).withColumnRenamed("tfidf", "tfidf_cosine"), "tfidf_cosine")
    base = _score_of(base, I.bm25_scores(q, products, I.SERVE, "query", pairs=base), "bm25")
    base = _frequency(base, train_pairs, "train_product_freq")
    base = base.withColumns({"qt": T.tokens_split("query"), "pt": T.tokens_split(text), "qd": T.digit_chars("query"), "pd": T.digit_chars(text), "at": A.attribute_tokens(F.coalesce("attributes_list", F.array().cast("array<string>")))})
    return base.select(
        "query_id", "query", "p_id", "tfidf_cosine", "bm25",
        A.jaccard(F.col("qt"), F.col("pt")).alias("jaccard_tokens"),
        A.overlap(F.col("qt"), F.col("pt")).alias("overlap_count"),
        F.size("qt").alias("query_len"),
        F.size("pt").alias("prod_len"),
        (T.fuzzy_ratio(F.col("query"), text) if fuzzy else F.lit(0.0)).alias("title_fuzzy"),
        _flag((F.col("brand_norm") != "") & F.array_contains("qt", F.col("brand_norm"))).alias("brand_exact"),
        _flag((F.col("category") != "") & F.array_contains("qt", F.lower("category"))).alias("category_exact"),
        A.overlap(F.col("qt"), F.col("at")).alias("attr_overlap_count"),
        A.ratio_of(A.overlap(F.col("qt"), F.col("at")), F.size("at")).alias("attr_overlap_ratio"),
        A.ratio_of(A.overlap(F.col("qd"), F.col("pd")), F.size("qd")).alias("digit_overlap_ratio"),
        F.size("qd").alias("num_query_digits"),
        F.lit(0).alias("model_token_match"),
        F.lit(0).alias("num_q_model_tokens"),
        "train_product_freq",
    )


def pair_features(ranked: DataFrame, queries: DataFrame, products: DataFrame, train_pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, p_id, rank) + set B for ranked (query_id, p_id, rank)."""
    q = queries.select("query_id", F.col("query_norm").alias("q"), F.lower("query").alias("ql"))
    base = _with_products(ranked.select("query_id", "p_id", "rank").join(q, "query_id"), products)
    base = _score_of(base, I.bm25_scores(queries, products, I.INDEX, pairs=base).withColumnRenamed("bm25", "bm25_score"), "bm25_score")
    base = _score_of(base, I.tfidf_scores(queries, products, pairs=base).withColumnRenamed("tfidf", "tfidf_score"), "tfidf_score")
    base = _frequency(base, train_pairs, "popularity") if train_pairs is not None else base.withColumn("popularity", F.lit(0))
    text = F.coalesce("text_norm", F.lit(""))
    title = F.coalesce("title_norm", text)
    base = base.withColumns({"tn": title, "qt": F.array_distinct(T.tokens("q")), "qs": T.tokens("q")})
    base = base.withColumns({"ts": T.tokens("tn"), "qm": T.model_tokens("q"), "pm": F.array_union(T.model_tokens("tn"), T.model_tokens(text))})
    named = lambda n: (lambda x: T.contains("q", x) | T.contains("ql", x))(F.lower(T.strip(n)))
    return base.select(
        "query_id", "p_id", "rank", "bm25_score", "tfidf_score",
        _flag(named("brand")).alias("brand_match"),
        _flag(named("category")).alias("category_match"),
        _flag(F.arrays_overlap("qm", "pm")).alias("model_match"),
        _flag(F.arrays_overlap(T.numeric_tokens(F.col("qs")), T.numeric_tokens(F.col("ts")))).alias("numeric_match"),
        A.overlap(F.col("qt"), F.col("ts")).alias("token_overlap"),
        A.overlap_ratio(F.col("qt"), F.col("ts")).alias("token_overlap_ratio"),
        A.overlap(F.col("qt"), T.tokens(F.coalesce("attributes_norm", F.lit("")))).alias("attr_overlap"),
        _flag(T.contains("tn", "q")).alias("title_contains_query"),
        _flag(T.same_first(F.col("qs"), F.col("ts"))).alias("title_prefix_match"),
        "popularity",
        F.size("qt").alias("num_query_tokens"),
        F.size(F.array_distinct("ts")).alias("num_title_tokens"),
        F.length("q").alias("len_query"),
        F.length("tn").alias("len_title"),
    )


def features_for_queries(queries: DataFrame, products: DataFrame, train_pairs: DataFrame | None = None, topk_candidates: int = 100, final_k: int = 50) -> DataFrame:
    """Hybrid retrieval for every query, then set B for its candidates."""
    ranked = V.hybrid(queries, products, topk_candidates, final_k)
    return pair_features(ranked, queries, products, train_pairs)


def topk_pids(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, pids): the first k products of each ranked list."""
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_id"))), lambda x: x["p_id"]).alias("pids"))


def numeric_features(df: DataFrame, exclude=("query_id", "query", "p_id", "label")) -> list[str]:
    return [n for n in df.columns if n not in exclude]
