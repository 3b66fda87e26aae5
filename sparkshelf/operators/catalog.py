"""Catalog, query and pair preparation: one projection each, and deduplication by window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..sources.io import require_columns, with_ord

FIELDS = ("title", "brand", "category", "attributes")


@dataclass(frozen=True)
class Preparation:
    """Options of catalog and query preparation. `null_text`: what a null field reads as ('nan' reproduces files read untyped)."""

    normalizer: T.Normalizer = T.Normalizer()
    map_digits: bool = True
    max_text_chars: int | None = 1024
    preserve_attribute_commas: bool = False
    null_text: str = ""

    def norm(self, col, remove_punct: bool | None = None):
        return T.normalize_text(F.coalesce(T.c_(col), F.lit(self.null_text)), self.normalizer, self.map_digits, remove_punct=remove_punct)


def clean_products(df: DataFrame, how: Preparation = Preparation(), fields=FIELDS) -> DataFrame:
    """Products with text and normalised columns: text, text_norm, title_norm, category_norm, brand_norm, attributes_norm, attributes_list."""
    require_columns(df, ["p_id"], "products")
    there = [n for n in fields if n in df.columns]
    if not there:
        raise ValueError(f"products have none of {list(fields)}")
    text = T.concat_parts(*there, keep_empty=True)
    if how.max_text_chars:
        text = T.truncate(text, how.max_text_chars)
    field = lambda n: F.coalesce(F.col(n), F.lit(how.null_text)) if n in df.columns else F.lit("")
    out = df.withColumn("p_id", T.canonical_id("p_id")).withColumn("text", text)
    return out.withColumns(
        {
            "text_norm": how.norm("text"),
            **{f"{n}_norm": how.norm(field(n)) for n in ("title", "category", "brand")},
            "attributes_norm": how.norm(field("attributes"), False if how.preserve_attribute_commas else None),
            "attributes_list": A.split_attributes(field("attributes")),
        }
    )


def keep_first(df: DataFrame, keys, order: str = "ord", last: bool = False) -> DataFrame:
    """The first (or last) row by `order` for each key. A window, as dropDuplicates picks any; a partial limit runs map-side."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = F.col(order).desc() if last else F.col(order).asc()
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_k = 1").drop("_k")


def remove_exact_duplicates(df: DataFrame, subset: str = "text_norm", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(first row of each value, one row of n_original, n_after, n_removed)."""
    require_columns(df, [subset], "products")
    stats = df.agg(F.count("*").alias("n_original"), (F.count_distinct(subset) + F.max(F.col(subset).isNull().cast("int"))).alias("n_after"))
    return keep_first(df, subset, order), stats.withColumn("n_removed", F.col("n_original") - F.col("n_after"))


def preprocess_queries(df: DataFrame, how: Preparation = Preparation(), query_col: str = "query", id_col: str = "query_id", keep_duplicates: bool = True, strip_zwnj: bool = False) -> DataFrame:
    """(query_id, query, query_raw, query_norm, ord); ids are row numbers where there are none; without duplicates the first raw text counts."""
    require_columns(df, [query_col], "queries")
    df = with_ord(df)
    if not keep_duplicates:
        df = keep_first(df, query_col)
    ident = F.col(id_col).cast("string") if id_col in df.columns else F.col("ord").cast("string")
    raw = F.coalesce(F.col(query_col), F.lit(how.null_text))
    norm = T.normalize_text(raw, how.normalizer, how.map_digits, strip_zwnj=strip_zwnj)
    return df.select("ord", ident.alias("query_id"), raw.alias("query"), raw.alias("query_raw"), norm.alias("query_norm"))


def ensure_text_norm(df: DataFrame, how: Preparation = Preparation(), fields=FIELDS) -> DataFrame:
    """df with text_norm: as it is, else from text, else from the fields there are, else empty."""
    if "text_norm" in df.columns and df.select(F.count("text_norm") > 0).first()[0]:
        return df.withColumn("text_norm", F.coalesce("text_norm", F.lit("")))
    there = [n for n in fields if n in df.columns]
    source = F.col("text") if "text" in df.columns else F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in there]) if there else F.lit("")
    return df.withColumn("text_norm", how.norm(source))


def pairs_with_text(pairs: DataFrame, products: DataFrame, how: Preparation = Preparation()) -> DataFrame:
    """Pairs with query_norm and the text_norm of their product (of the last row of its id); unmatched ones are null."""
    lookup = keep_first(products, "p_id", last=True).select("p_id", F.col("text_norm").alias("product_text"))
    return pairs.withColumn("query_norm", how.norm("query")).join(lookup, "p_id", "left")
