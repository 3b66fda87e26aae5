"""Candidate retrieval for all queries in one plan: BM25, TF-IDF rerank, hybrid, padded top lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import index as I
from . import relational as R
from . import scan as S

EPS = 1e-9
FREQUENT = 200_000


def with_place(scores: DataFrame, products: DataFrame) -> DataFrame:
    """Scores with the product's row number, the tie-break of every ranking."""
    return scores.join(products.select("p_id", "ord"), "p_id")


def bm25_candidates(queries: DataFrame, products: DataFrame, k: int = 200, preset: I.BM25 = I.INDEX, query_text: str = "query_norm") -> DataFrame:
    """(query_id, p_id, ord, bm25, rank): the k best hits of each query. Products without a hit never appear."""
    return R.top_per_group(I.bm25_scores(queries, products, preset, query_text, k=k), "query_id", "bm25", k).persist()  # k rows a query, read by every later step


def tfidf_rerank(candidates: DataFrame, queries: DataFrame, products: DataFrame, k: int = 50, preset: I.TfIdf = I.TFIDF_INDEX) -> DataFrame:
    """The k best of the candidates by cosine (0 where no term is shared), ties in their old order."""
    scores = I.tfidf_scores(queries, products, preset, pairs=candidates)
    joined = candidates.drop("tfidf").join(scores, ["query_id", "p_id"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    return R.top_per_group(joined.withColumnRenamed("rank", "old_rank"), "query_id", "tfidf", k, tie="old_rank").drop("old_rank")


def min_max(df: DataFrame, column: str, out: str, group: str = "query_id") -> DataFrame:
    """column scaled to 0..1 within each group; 0 where its range is below 1e-9."""
    w = Window.partitionBy(group)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(hi - lo < EPS, F.lit(0.0)).otherwise((F.col(column) - lo) / (hi - lo)))


def hybrid(queries: DataFrame, products: DataFrame, bm25_k: int = 500, final_k: int = 50, w_bm25: float = 0.6, w_tfidf: float = 0.4) -> DataFrame:
    """(query_id, p_id, bm25, tfidf, score, rank): BM25 hits, cosine, both scaled over the hits, weighted, top k."""
    hits = bm25_candidates(queries, products, bm25_k).drop("rank")
    both = hits.join(I.tfidf_scores(queries, products, pairs=hits), ["query_id", "p_id"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    scaled = min_max(min_max(both, "bm25", "_b"), "tfidf", "_t")
    scored = scaled.withColumn("score", w_bm25 * F.col("_b") + w_tfidf * F.col("_t")).drop("_b", "_t")
    return R.top_per_group(scored, "query_id", "score", final_k)


def pad(hits: DataFrame, queries: DataFrame, products: DataFrame, k: int, score: str) -> DataFrame:
    """hits (query_id, p_id, ord, score; at most k a query) filled up to k with products that have no hit, score 0, first rows first.

    A query with h < k hits needs k - h others, all of which lie among the first k products: only those are paired."""
    first = [F.struct(F.lit(r[0]).alias("p_id"), F.lit(r[1]).alias("ord")) for r in products.orderBy("ord").limit(k).select("p_id", "ord").collect()]  # k rows
    if not first:
        return hits
    count = hits.groupBy("query_id").agg(F.count("*").alias("_h"))
    short = queries.select("query_id").distinct().join(count, "query_id", "left").where(F.coalesce("_h", F.lit(0)) < k).select("query_id", F.coalesce("_h", F.lit(0)).alias("_h"))
    filler = short.select("query_id", "_h", F.inline(F.array(*first))).join(hits.select("query_id", "p_id"), ["query_id", "p_id"], "left_anti")
    ranked = filler.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where(F.col("_k") + F.col("_h") <= k)
    rest = [F.lit(0.0).alias(c) for c in hits.columns if c not in ("query_id", "p_id", "ord")]
    return hits.unionByName(ranked.select("query_id", "p_id", "ord", *rest))


def serve_candidates(queries: DataFrame, products: DataFrame, k: int = 50, w_tfidf: float = 0.6, w_bm25: float = 0.4, query_text: str = "query") -> DataFrame:
    """0.6 cosine + 0.4 scaled BM25 over all products, those without a hit included.

    BM25 is scaled over the whole catalog: the minimum is 0 where some product has no hit; without a range the raw score counts."""
    preset, kind, n = I.TFIDF_SERVE, products.schema["p_id"].dataType.simpleString(), products.count()
    words, terms_of = S.reader(I.SERVE.tokenizer, "text_norm")[1], S.reader(preset.tokenizer, "text_norm")[1]
    rows, parts = S.by_product(products, F.col("text_norm"), "p_id"), []
    # Terms of part of the products, the most frequent first: their weights are summed where a product lies. Which terms these
    # are changes no result; frequencies are counted over all products.
    frequent = [r["term"] for r in S.term_stats(rows.sample(0.02, seed=42), terms_of).orderBy(F.col("df").desc(), "term").limit(FREQUENT).select("term").toLocalIterator()]
    grams = lambda x: S.grams(terms_of(x))
    for block in S.blocks(queries, I.SERVE.tokenizer, query_text, lambda c: {t: float(x) for t, x in c.items()}):
        rows_n, avgdl, df = S.bm25_stats(rows, words, block.terms)
        bm25 = S.BM25Maker(I.SERVE, words, block.terms, block.weights(), np.log(1 + (rows_n - df + 0.5) / (df + 0.5)), avgdl)
        count, lo, hi = (np.array(x, np.float64) for x in zip(*S.extents(rows, bm25, len(block.ids), len(block.terms))))
        lo, hi = np.where(count < n, np.minimum(lo, 0.0), lo), np.where(count < n, np.maximum(hi, 0.0), hi)
        own = next(S.blocks(queries.where(F.col("query_id").isin(block.ids)), preset.tokenizer, query_text, lambda c: {t: float(x) for t, x in c.items()}, ngrams=True, whole=True), S.Block())
        terms = dict(own.terms)
        for t in frequent:
            terms.setdefault(t, len(terms))
        df = S.bm25_stats(rows, grams, terms)[2]
        idf = np.where((df >= preset.min_df) & (df <= preset.max_df * n), np.log((1.0 + n) / (1.0 + df)) + 1.0, 0.0)
        cosine = S.CosineMaker(terms_of, terms, idf, own.weights().unit(idf))
        at = {x: i for i, x in enumerate(block.ids)}
        make = S.ServeMaker(bm25, cosine, np.array([at[x] for x in own.ids], np.int64), lo, hi, w_tfidf, w_bm25)
        rare = S.rare_norms(rows, "p_id", kind, terms_of, set(terms), n, preset.min_df, preset.max_df)
        parts.append(S.scan(rows, "p_id", kind, block, make, "score", k, more_names=("tfidf", "bm25"), aux=rare).withColumnRenamed("_ord", "ord"))
    if not parts:
        none = F.lit(None).cast("double")
        scored = I._no_pairs(products, "score").withColumns({"tfidf": none, "bm25": none})
    else:
        scored = S.union(parts, None)
    hits = R.top_per_group(scored, "query_id", "score", k).drop("rank").persist()  # k rows a query, read three times
    return R.top_per_group(pad(hits, queries, products, k, "score"), "query_id", "score", k)


def train_candidates(queries: DataFrame, products: DataFrame, k: int = 50) -> DataFrame:
    """The k best products by cosine, zero scores included."""
    hits = R.top_per_group(I.tfidf_scores(queries, products, I.TFIDF_TRAIN, k=k), "query_id", "tfidf", k).drop("rank").persist()  # k rows a query, read three times
    return R.top_per_group(pad(hits, queries, products, k, "tfidf"), "query_id", "tfidf", k)
