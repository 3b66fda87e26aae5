"""The end-to-end flows: preprocess, train, serve, analyse, check a submission. Stages meet as Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as G
from ..operators import catalog as C
from ..operators import features as X
from ..operators import ltr as M
from ..operators import retrieval as V
from ..operators import submission as Q
from ..sources import io as S


@dataclass(frozen=True)
class Paths:
    """Inputs (CSV) and the folder of everything that is made."""

    products: str
    pairs: str
    queries: str
    out: str

    def table(self, name: str) -> str:
        return f"{self.out}/{name}"


def preprocess(spark: SparkSession, paths: Paths, how: C.Preparation = C.Preparation()) -> dict[str, DataFrame]:
    """Clean catalog (full and without exact duplicates), queries, pairs with their product's text."""
    S.require_files(spark, [paths.products, paths.pairs, paths.queries])
    raw = S.read_csv(spark, paths.products, "default", ordered=True)
    S.save_table(C.clean_products(raw, how), paths.table("products_clean_full"))
    full = S.load_table(spark, paths.table("products_clean_full"))
    unique, stats = C.remove_exact_duplicates(full)
    S.save_table(unique, paths.table("products_clean_dedup"))
    S.save_table(stats, paths.table("dedup_stats"))
    queries = C.preprocess_queries(S.read_csv(spark, paths.queries, "strict", ordered=True), how)
    pairs = C.pairs_with_text(S.load_train_pairs(S.read_csv(spark, paths.pairs, "strict", ordered=True)), full, how)
    S.save_table(queries, paths.table("queries"))
    S.save_table(pairs, paths.table("pairs"))
    return {n: S.load_table(spark, paths.table(n)) for n in ("products_clean_full", "products_clean_dedup", "queries", "pairs")}


def train(spark: SparkSession, paths: Paths, how: C.Preparation = C.Preparation(), k: int = 50, kind: str = "pairwise", fuzzy: bool = True):
    """(model, metrics row): features of the top candidates of train queries, labels, split, ranker, P@1, P@10, NDCG@10 on held-out queries."""
    products, pairs = S.load_table(spark, paths.table("products_clean_full")), S.load_table(spark, paths.table("pairs"))
    products = C.keep_first(products, "p_id")
    queries = C.preprocess_queries(C.keep_first(pairs.select("ord", "query"), "query"), how)
    S.save_table(X.train_features(V.train_candidates(queries, products, k), queries, products, pairs, fuzzy), paths.table("features_train"))
    features = S.load_table(spark, paths.table("features_train"))
    pos = M.positives(pairs.drop("query_id"), queries)
    names = X.SET_A
    fit_rows, val = M.split_by_query(M.prepare_training_data(M.normalize_features(features, names), pos))
    model = M.train_ranker(fit_rows, names, kind)
    every = M.normalize_features(features, names).join(val.select("query_id").distinct(), "query_id", "left_semi")
    metrics = M.ranking_metrics(M.predict_and_rank(model, every, names), pos)
    M.save_model(model, paths.table("model"))
    S.write_json(metrics, paths.table("metrics"))
    return model, metrics


def serve(spark: SparkSession, paths: Paths, model=None, k: int = 50, fuzzy: bool = True) -> DataFrame:
    """Wide predictions of the test queries, in their order, as table and CSV."""
    products = C.keep_first(S.load_table(spark, paths.table("products_clean_full")), "p_id")
    queries, pairs = S.load_table(spark, paths.table("queries")), S.load_table(spark, paths.table("pairs"))
    model = model or M.load_model(paths.table("model"))
    S.save_table(X.serve_features(V.serve_candidates(queries, products, k), queries, products, pairs, fuzzy), paths.table("features_test"))
    features = M.normalize_features(S.load_table(spark, paths.table("features_test")), X.SET_A)
    wide = Q.export_wide(M.predict_and_rank(model, features, X.SET_A), queries)
    S.save_table(wide, paths.table("predictions_top10"))
    wide = S.load_table(spark, paths.table("predictions_top10"))
    S.write_csv(wide, paths.table("predictions_top10_csv"))
    return wide


def analyse(spark: SparkSession, paths: Paths) -> DataFrame:
    report = G.report(S.load_table(spark, paths.table("products_clean_full")), S.load_table(spark, paths.table("pairs")))
    S.write_json(report, paths.table("analysis_report"))
    return report


def check_submission(spark: SparkSession, preds: DataFrame, sample: DataFrame, paths: Paths) -> DataFrame:
    """Aligned predictions with popular products where none fit; the report goes beside them."""
    aligned = Q.align(preds, sample)
    S.save_table(aligned, paths.table("predictions_aligned"))
    aligned = S.load_table(spark, paths.table("predictions_aligned"))
    S.write_text(Q.alignment_report(aligned, preds.count()), paths.table("alignment_report"))
    S.write_csv(aligned.select("ord", "query", *Q.PIDS), paths.table("predictions_aligned_csv"))
    matched = aligned.where(F.col("strategy").isNotNull()).select("ord", "query", *Q.PIDS)
    return Q.fill_with_popular(matched, aligned.select("ord", "query"))
