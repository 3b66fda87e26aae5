"""One query for each operator, on the supplied tables, with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import analysis as G
from ..operators import catalog as C
from ..operators import features as X
from ..operators import index as I
from ..operators import ltr as M
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import submission as Q
from ..sources import io as S
from . import roles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06ED}\x{08D4}-\x{08E1}]"
_LETTERS = T.ALEF_FORMS + T.YEH_FORMS + T.KAF_FORMS + T.WAW_FORMS + T.HAMZA + T.TATWEEL, T.ALEF * len(T.ALEF_FORMS) + T.YEH * len(T.YEH_FORMS) + T.KAF + T.WAW


def strip_(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def digits_(x: str) -> str:
    return f"translate({x}, '{T.PERSIAN_DIGITS}{T.ARABIC_DIGITS}', '01234567890123456789')"


def norm_(x: str, digits: bool = True) -> str:
    x = f"coalesce({x}, '')"
    x = digits_(x) if digits else x
    x = f"translate(nfc_normalize({x}), '{_LETTERS[0]}', '{_LETTERS[1]}')"
    x = f"translate(regexp_replace({x}, '{_MARKS}', '', 'g'), '‌‍', '')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}\\x{{0600}}-\\x{{06FF}}]', ' ', 'g')"
    x = f"lower(replace({x}, 'ß', 'ss'))"
    return f"trim(regexp_replace({x}, '{WHITE}+', ' ', 'g'))"


def tokens_(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def split_tokens_(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WHITE}+'), lambda t: t <> '')"


def vec_tokens_(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def attributes_(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,،؛\\n]'), lambda a: {strip_('a')}), lambda a: a <> '')"


def models_(x: str) -> str:
    pattern = r"(?i)([A-Za-z]{1,4}[\s\-_/]?\p{Nd}{2,6}|\p{Nd}{2,6}[A-Za-z]{0,4}|[A-Za-z0-9]+[\-_/]\p{Nd}+)"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda m: lower(regexp_replace(m, '{WHITE}+', '', 'g'))), lambda m: length(m) >= 2))"


def loose_(x: str) -> str:
    return rf"list_filter({x}, lambda m: regexp_matches(m, '\p{{Nd}}') and regexp_matches(m, '\p{{L}}'))"


def overlap_(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


PRODUCTS = "products as (select doc_id as ord, cast(doc_id as varchar) as p_id, substr(text, 1, 80) as title, lang as category, source as brand, split_part(text, chr(10), 1) as attributes, text from documents)"
PN = f"{PRODUCTS}, pn as materialized (select *, {norm_('text')} as text_norm, {norm_('title')} as title_norm, {norm_('brand')} as brand_norm, {norm_('attributes')} as attributes_norm, {attributes_('attributes')} as attributes_list from products)"
QN = f"q as materialized (select item_id as ord, cast(item_id as varchar) as query_id, text as query, {norm_('text')} as query_norm from benchmark)"
PAIRS = "pairs as (select l_orderkey * 10 + l_linenumber as ord, 'customer ' || o_custkey as query, cast(l_partkey as varchar) as p_id from lineitem join orders on l_orderkey = o_orderkey)"
JUDGED = "pos as (select distinct cast(doc_id % 40 as varchar) as query_id, cast(doc_id as varchar) as p_id from labels where quality = 1)"


def bm25_(preset: I.BM25, name: str, q_text: str = "query_norm") -> str:
    """CTE `name`(query_id, p_id, bm25)."""
    tok = split_tokens_ if preset.tokenizer is T.tokens_split else tokens_
    odds = "(n - df + 0.5) / (df + 0.5)"
    idf = f"ln({odds} + {preset.idf_eps})" if preset.idf == "plain" else f"ln(1 + {odds})"
    return f"""{name}_t as materialized (select p_id, {tok('text_norm')} as t from pn),
 {name}_p as materialized (select p_id, token, count(*) as tf, any_value(dl) as dl from (select p_id, len(t) as dl, unnest(t) as token from {name}_t) group by all),
 {name}_s as (select count(*) as n, avg(len(t)) as avgdl from {name}_t),
 {name}_d as (select token, count(*) as df from {name}_p group by all),
 {name}_q as (select query_id, token, {'count(*)' if preset.repeats else '1'} as qtf from (select query_id, unnest({tok(q_text)}) as token from q) group by query_id, token),
 {name} as materialized (select query_id, p_id, sum(qtf * {idf} * tf * ({preset.k1} + 1) / (tf + {preset.k1} * (1 - {preset.b} + {preset.b} * dl / avgdl) + {preset.eps})) as bm25
   from {name}_q join {name}_p using (token) join {name}_d using (token), {name}_s group by all)"""


def tfidf_(preset: I.TfIdf, name: str, q_text: str = "query_norm") -> str:
    """CTEs `name`_v(p_id, term, w), `name`(query_id, p_id, tfidf)."""
    tok = vec_tokens_ if preset.tokenizer is T.tokens_vectorizer else tokens_
    grams = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    top = f"order by total desc, term limit {preset.max_features}" if preset.max_features else ""
    unit = lambda key, src: f"(select {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by {key})) as w from {src} join {name}_i using (term))"
    return f"""{name}_c as materialized (select p_id, term, count(*) as tf from (select p_id, unnest({grams}) as term from (select p_id, {tok('text_norm')} as t from pn)) group by all),
 {name}_n as (select count(*) as n from pn),
 {name}_i as materialized (select term, df, ln((1.0 + n) / (1.0 + df)) + 1 as idf from (select * from (select term, count(*) as df, sum(tf) as total, any_value(n) as n from {name}_c, {name}_n group by term) where df >= {preset.min_df} and df <= {preset.max_df} * n {top})),
 {name}_v as materialized {unit('p_id', name + '_c')},
 {name}_k as (select query_id, term, count(*) as tf from (select query_id, unnest({grams}) as term from (select query_id, {tok(q_text)} as t from q)) group by all),
 {name}_u as {unit('query_id', name + '_k')},
 {name} as materialized (select query_id, p_id, sum({name}_u.w * {name}_v.w) as tfidf from {name}_u join {name}_v using (term) group by all)"""


def top_(src: str, score: str, k: int, group: str = "query_id", tie: str = "ord") -> str:
    return f"(select * from (select *, row_number() over (partition by {group} order by round({score}, 9) desc, {tie}) as rank from {src}) where rank <= {k})"


PLACED = "(select s.*, pn.ord from {} s join pn using (p_id))"


def docs(spark, sf):
    return roles.table(spark, sf, "documents")


def pn(spark, sf):
    return roles.products_norm(spark, sf)


def pt(spark, sf):
    return roles.products_text(spark, sf)


def qn(spark, sf):
    return roles.queries(spark, sf)


# Sources

_MESSY = "case when doc_id % 5 = 0 then 'NA' when doc_id % 5 = 1 then '' when doc_id % 5 = 2 then 'null' else source end"
_NA = ", ".join(f"'{x}'" for x in T.NA_LITERALS)


def _messy(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(_MESSY).alias("v"))


@query(f"select doc_id, nullif(v, '') as v from (select doc_id, {_MESSY} as v from documents)")
def s1_strict_nulls(spark, sf):
    return S.apply_nulls(_messy(spark, sf), "strict")


@query(f"select doc_id, case when v in ({_NA}) then null else v end as v from (select doc_id, {_MESSY} as v from documents)")
def s3_default_nulls(spark, sf):
    return S.apply_nulls(_messy(spark, sf), "default")


@query(f"select doc_id, coalesce(nullif(v, ''), '') as v from (select doc_id, {_MESSY} as v from documents)")
def s4_nulls_as_empty(spark, sf):
    return S.apply_nulls(_messy(spark, sf), "empty")


_HARD = "select row_number() over (order by doc_id) - 1 as ord, doc_id, v, w from (select doc_id, case doc_id % 6 when 0 then 'NA' when 1 then '' when 2 then 'a \"quoted\", part' when 3 then 'null' when 4 then 'two' || chr(10) || 'lines' else ' ' || source || ' ' end as v, lang || ';' || source as w from documents)"


def _csv(spark, sf, regime: str):
    """documents' ids with values that are hard for CSV, written as CSV by the sink and read again under a null regime."""
    v = F.expr("case doc_id % 6 when 0 then 'NA' when 1 then '' when 2 then 'a \"quoted\", part' when 3 then 'null' when 4 then 'two\\nlines' else concat(' ', source, ' ') end")
    path = S.scratch(spark)
    S.write_csv(docs(spark, sf).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"), v.alias("v"), F.concat("lang", F.lit(";"), "source").alias("w")), path)
    return S.read_csv(spark, path, regime, ordered=True).select("ord", "doc_id", "v", "w")


def _read(null: str) -> str:
    return f"select ord, cast(doc_id as varchar) as doc_id, {null} as v, w from ({_HARD})"


@query(_read("nullif(v, '')"))
def s1_csv_strict(spark, sf):
    return _csv(spark, sf, "strict")


@query(_read(f"case when v in ({_NA}) then null else v end"))
def s3_csv_default(spark, sf):
    return _csv(spark, sf, "default")


@query(_read("v"))
def s4_csv_empty(spark, sf):
    return _csv(spark, sf, "empty")


@query(f"with {PRODUCTS}, t as (select p_id, concat_ws(' ', nullif(title, ''), nullif(brand, ''), nullif(category, ''), nullif(attributes, '')) as text from products) select p_id, text, {norm_('text', False)} as text_norm from t")
def s5_load_products(spark, sf):
    return S.load_products(roles.products(spark, sf).drop("ord"))


@query(f"with {PAIRS} select query, p_id from pairs where length({strip_('query')}) > 0")
def s6_load_train_pairs(spark, sf):
    return S.load_train_pairs(roles.pairs(spark, sf).drop("ord"))


@query(f"select cast(item_id as varchar) as query_id, text as query_raw, text as query, {norm_('text', False)} as query_norm from benchmark")
def s7_load_test_queries(spark, sf):
    return S.load_test_queries(roles.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query(None)
def s16_bytes_checks(spark, sf):
    path = f"{sf}/documents.parquet"
    return spark.createDataFrame([(str(S.detect_bom(spark, path)), S.exists(spark, path))], "boms string, there boolean")


# Rows


@query(f"select l_orderkey, l_linenumber, regexp_replace({strip_('cast(l_quantity as varchar)')}, '\\.0$', '') as id from lineitem")
def p2_canonical_id(spark, sf):
    return roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.canonical_id("l_quantity").alias("id"))


@query("select doc_id, concat_ws(' ', nullif(lang, ''), nullif(source, '')) as skipped, concat_ws(' ', lang, source) as kept, substr(text, 1, 100) as cut, length(text) > 0 as there from documents")
def p3_concat_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", T.concat_parts("lang", "source").alias("skipped"), T.concat_parts("lang", "source", keep_empty=True).alias("kept"), T.truncate("text", 100).alias("cut"), (F.length("text") > 0).alias("there"))


@query("select event_id, coalesce(try_cast(event_type as double), 0) as a, coalesce(try_cast(cast(value as varchar) as double), 0) as b from events")
def p11_numeric_coercion(spark, sf):
    return roles.table(spark, sf, "events").select("event_id", T.coerce_number("event_type").alias("a"), T.coerce_number(F.col("value").cast("string")).alias("b"))


@query(f"select cast(conv_id * 100000 + turn as varchar) as query_id, text as query, text as query_raw, {norm_('text')} as query_norm from conversations where role = 'user'")
def p12_preprocess_queries(spark, sf):
    c = roles.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("ord"), F.col("text").alias("query"))
    return C.preprocess_queries(c.withColumn("query_id", F.col("ord"))).drop("ord")


@query(f"""with {PRODUCTS}, t as (select *, substr(concat_ws(' ', title, brand, category, attributes), 1, 1024) as full_text from products)
select ord, p_id, title, category, brand, attributes, full_text as text, {norm_('full_text')} as text_norm, {norm_('title')} as title_norm, {norm_('category')} as category_norm, {norm_('brand')} as brand_norm, {norm_('attributes')} as attributes_norm, array_to_string({attributes_('attributes')}, '|') as attributes_list from t""")
def p13_clean_products(spark, sf):
    return C.clean_products(roles.products(spark, sf)).withColumn("attributes_list", F.array_join("attributes_list", "|"))


@query(f"with {PN} select ord, p_id from (select *, row_number() over (partition by text_norm order by ord) as k from pn) where k = 1")
def p14_keep_first(spark, sf):
    return C.remove_exact_duplicates(pn(spark, sf))[0].select("ord", "p_id")


@query(f"with {PN} select count(*) as n_original, count(distinct text_norm) as n_after, count(*) - count(distinct text_norm) as n_removed from pn")
def p14_duplicate_stats(spark, sf):
    return C.remove_exact_duplicates(pn(spark, sf))[1]


@query(f"with {PRODUCTS} select p_id, {norm_("title || ' ' || brand || ' ' || category || ' ' || attributes")} as text_norm from products")
def p15_fallback_text_norm(spark, sf):
    return C.ensure_text_norm(roles.products(spark, sf).drop("text")).select("p_id", "text_norm")


# Text scalars

_PAGE = "select page_id, html from pages"


@query(f"select doc_id, {norm_('text', False)} as norm from documents")
def t2_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize("text").alias("norm"))


@query(f"select page_id, {norm_("replace(html, '‌', '')")} as norm from pages")
def t5_strip_zwnj(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.normalize_text(F.concat(F.lit("‌"), "html"), strip_zwnj=True).alias("norm"))


@query(f"select page_id, {norm_('url', False).replace('[^', '[^/.')} as norm from pages")
def t2g_keep_punctuation(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.normalize("url", T.Normalizer(keep_punct="/.")).alias("norm"))


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[,،；\\n]'), lambda a: {strip_('a')}), lambda a: a <> ''), '|') as parts from documents")
def a2_coerce_attributes(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(A.coerce_attributes("text"), "|").alias("parts"))


@query(f"select page_id, {norm_('html')} as norm from pages")
def t1_normalize_text(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.normalize_text("html").alias("norm"))


@query(f"select page_id, {digits_('url')} as url, translate(html, '{_LETTERS[0]}', '{_LETTERS[1]}') as letters from pages")
def t3_maps(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.map_digits("url").alias("url"), T.map_letters("html").alias("letters"))


@query(rf"select doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'يك', 'یک'), '{_MARKS}', ' ', 'g'), '[\x{{200C}}\x{{200D}}]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}\x{{0600}}-\x{{06FF}}]', ' ', 'g')), '{WHITE}+', ' ', 'g')) as norm from documents")
def t4_normalize_legacy(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_legacy("text").alias("norm"))


@query(f"select doc_id, array_to_string({tokens_('text')}, ' ') as ir, array_to_string({split_tokens_('text')}, ' ') as split, array_to_string({vec_tokens_('text')}, ' ') as vec from documents")
def t6_tokenizers(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.tokens("text"), " ").alias("ir"), F.array_join(T.tokens_split("text"), " ").alias("split"), F.array_join(T.tokens_vectorizer("text"), " ").alias("vec"))


@query(f"with w as (select doc_id, {vec_tokens_('text')} as t from documents) select doc_id, array_to_string(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), '|') as grams from w")
def t9_ngrams(spark, sf):
    return docs(spark, sf).select("doc_id", T.tokens_vectorizer("text").alias("t")).select("doc_id", F.array_join(T.ngrams(F.col("t")), "|").alias("grams"))


@query(rf"""with d as (select page_id, regexp_extract_all(url, '(?i)([A-Za-z]{{1,4}}[\s\-_/]?\p{{Nd}}{{2,6}}|\p{{Nd}}{{2,6}}[A-Za-z]{{0,4}}|[A-Za-z0-9]+[\-_/]\p{{Nd}}+)', 1) as m, {tokens_('url')} as t, url from pages)
select page_id, len(list_distinct(list_filter(list_transform(m, lambda x: lower(regexp_replace(x, '{WHITE}+', '', 'g'))), lambda x: length(x) >= 2))) as n_models,
 array_to_string(list_filter(t, lambda x: regexp_matches(x, '\p{{Nd}}') and regexp_matches(x, '\p{{L}}')), ' ') as loose,
 array_to_string(list_filter(t, lambda x: regexp_full_match(x, '\p{{Nd}}+')), ' ') as numbers,
 array_to_string(regexp_extract_all(url, '\p{{Nd}}+'), ' ') as runs,
 len(list_distinct(regexp_extract_all(url, '\p{{Nd}}'))) as n_digits from d""")
def t10_models_and_numbers(spark, sf):
    p = roles.table(spark, sf, "pages").select("page_id", "url", T.tokens("url").alias("t"))
    return p.select("page_id", F.size(T.model_tokens("url")).alias("n_models"), F.array_join(T.model_tokens_loose(F.col("t")), " ").alias("loose"), F.array_join(T.numeric_tokens(F.col("t")), " ").alias("numbers"), F.array_join(T.digit_runs("url"), " ").alias("runs"), F.size(T.digit_chars("url")).alias("n_digits"))


@query(None)
def t15_fuzzy_ratio(spark, sf):
    """Whole part names against whole part types; tests hold the ratio against the library it is defined by."""
    return roles.table(spark, sf, "part").select("p_partkey", T.fuzzy_ratio("p_name", "p_type").alias("ratio"))


@query("select o_orderkey, round(cast(o_totalprice as double), 6) as n, 0.0 as none from orders")
def t17_parse_number(spark, sf):
    o = roles.table(spark, sf, "orders")
    return o.select("o_orderkey", F.round(T.parse_number(F.concat(F.lit(" "), F.format_number("o_totalprice", 2))), 6).alias("n"), T.parse_number("o_orderstatus").alias("none"))


@query("select sum(case when try_cast(event_type as double) is null then 1 else 0 end) as bad_type, sum(case when try_cast(cast(value as varchar) as double) is null then 1 else 0 end) as bad_value from (select * from events order by event_id limit 10)")
def t18_parse_audit(spark, sf):
    e = R.head(roles.table(spark, sf, "events"), 10, "event_id")
    bad = lambda c: F.sum(T.parse_number_audit(F.col(c).cast("string")).isNull().cast("int"))
    return e.agg(bad("event_type").alias("bad_type"), bad("value").alias("bad_value"))


@query(f"select page_id, length(url) > 0 and contains(html, 'the') as has, coalesce({tokens_('url')}[1] = {tokens_('html')}[1], false) as same from pages")
def t19_contains_prefix(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.contains("html", F.lit("the")).alias("has"), T.same_first(T.tokens("url"), T.tokens("html")).alias("same"))


@query(f"""with k as (select doc_id, {strip_("nfc_normalize(coalesce(text, ''))")} as exact from documents)
select doc_id, exact, replace(exact, '‌', '') as no_zwnj, lower(replace(exact, 'ß', 'ss')) as casefold, lower(replace(replace(exact, '‌', ''), 'ß', 'ss')) as casefold_no_zwnj from k""")
def t22_match_keys(spark, sf):
    return docs(spark, sf).select("doc_id", *[x.alias(n) for n, x in T.match_keys("text").items()])


@query(r"select page_id, regexp_matches(html, '[\p{Cc}\p{Cf}\p{Co}]') as odd, len(regexp_extract_all(html, '[\p{Cc}\p{Cf}\p{Co}]')) as n from pages")
def t23_invisible(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.has_invisible("html").alias("odd"), F.size(T.invisible_positions("html")).alias("n"))


# Arrays


@query(f"""with d as (select doc_id, {attributes_('text')} as attrs, {tokens_('text')} as t, {tokens_("split_part(text, chr(10), 1)")} as h, {tokens_("source || ' ' || lang")} as s from documents)
select doc_id, array_to_string(attrs, '|') as attrs, round(len(list_intersect(h, t)) / len(list_distinct(list_concat(h, t))), 6) as jaccard, {overlap_('t', 's')} as n, round({overlap_('h', 't')} / (len(list_distinct(h)) + 1e-9), 6) as ratio, array_to_string(list_slice(attrs, 1, 3), '|') as top from d""")
def a1_arrays(spark, sf):
    d = docs(spark, sf).select("doc_id", A.split_attributes("text").alias("attrs"), T.tokens("text").alias("t"), T.tokens(F.substring_index("text", "\n", 1)).alias("h"), T.tokens(F.concat_ws(" ", "source", "lang")).alias("s"))
    return d.select("doc_id", F.array_join("attrs", "|").alias("attrs"), F.round(A.jaccard(F.col("h"), F.col("t")), 6).alias("jaccard"), A.overlap(F.col("t"), F.col("s")).alias("n"), F.round(A.overlap_ratio(F.col("h"), F.col("t")), 6).alias("ratio"), F.array_join(A.top_k(F.col("attrs"), 3), "|").alias("top"))


# Joins, sets, sorts

# All customers and parts; each third (fourth) has a text (key) of its own that no pair has, so that some pairs stay unmatched.
_CUST = "c as (select case when c_custkey % 3 = 0 then 'guest ' else 'customer ' end || c_custkey as query, cast(c_custkey as varchar) as query_id from customer)"


def _customers(spark, sf):
    who = F.when(F.col("c_custkey") % 3 == 0, "guest ").otherwise("customer ")
    return roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.concat(who, F.col("c_custkey")).alias("query"), F.col("c_custkey").cast("string").alias("query_id"))


def _parts(spark, sf):
    key = F.concat(F.when(F.col("p_partkey") % 4 == 0, "old ").otherwise(""), F.col("p_partkey"))
    return roles.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), key.alias("p_id"), F.col("p_name").alias("text_norm"))


_PARTS = "parts as (select p_partkey as ord, case when p_partkey % 4 = 0 then 'old ' else '' end || p_partkey as p_id, p_name as text_norm from part)"


@query(f"with {PAIRS}, {_PARTS} select pairs.ord, query, pairs.p_id, coalesce(text_norm, '') as text_norm from pairs left join parts using (p_id)")
def j1_lookup_join(spark, sf):
    return R.lookup(roles.pairs(spark, sf), _parts(spark, sf), "p_id", "text_norm", "").select("ord", "query", "p_id", "text_norm")


@query(f"with {PAIRS}, {_CUST} select pairs.ord, p_id, query_id from pairs join c using (query)")
def j4_query_ids(spark, sf):
    return R.attach_query_id(roles.pairs(spark, sf), _customers(spark, sf)).select("ord", "p_id", "query_id")


@query(f"with {PAIRS}, {_PARTS} select p_id from pairs except select p_id from parts")
def so1_difference(spark, sf):
    return R.difference(roles.pairs(spark, sf), _parts(spark, sf), "p_id")


@query(f"with {PAIRS}, {_PARTS} select p_id from pairs intersect select p_id from parts")
def so2_intersection(spark, sf):
    return R.intersection(roles.pairs(spark, sf), _parts(spark, sf), "p_id")


@query(f"with {PAIRS} select query, count(*) as n from pairs group by query order by n desc, min(ord) limit 20")
def o3_most_common(spark, sf):
    return R.most_common(roles.pairs(spark, sf), "query", 20).select("query", "n")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by round(o_totalprice, 9) desc, o_orderkey) as rank from orders) where rank <= 3")
def o2_top_per_group(spark, sf):
    return R.top_per_group(roles.table(spark, sf, "orders"), "o_custkey", "o_totalprice", 3, tie="o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 200")
def o6_sample(spark, sf):
    return R.sample(docs(spark, sf).select("doc_id"), 200, "doc_id")


@query(f"with {PRODUCTS}, j as (select p_id, ord % 40 as q from products) select j.p_id, cast(q as varchar) as query_id, coalesce(text, '') as query from j left join benchmark on item_id = q")
def j7_raw_query_text(spark, sf):
    c = roles.products(spark, sf).select("p_id", (F.col("ord") % 40).cast("string").alias("query_id"), F.lit(None).cast("string").alias("query"))
    return R.raw_query_text(c, qn(spark, sf)).select("p_id", "query_id", "query")


@query(f"with {PRODUCTS}, r as (select o_custkey, cast(o_orderkey % 500 as varchar) as p_id, row_number() over (partition by o_custkey order by round(o_totalprice, 9) desc, o_orderkey) as rank from orders) select o_custkey, p_id, rank, category, brand from r join products using (p_id) where rank <= 3")
def j8_rank_order(spark, sf):
    r = R.top_per_group(roles.table(spark, sf, "orders"), "o_custkey", "o_totalprice", 3, tie="o_orderkey").select("o_custkey", (F.col("o_orderkey") % 500).cast("string").alias("p_id"), "rank")
    return R.in_rank_order(roles.products(spark, sf), r).select("o_custkey", "p_id", "rank", "category", "brand")


@query(f"with {PAIRS}, {_PARTS} select (select count(*) from (select p_id from pairs except select p_id from parts)) = 0 as pairs_in_parts, (select count(*) from (select cast(l_partkey as varchar) from lineitem except select p_id from pairs)) = 0 as lines_in_pairs")
def so3_subset(spark, sf):
    pairs, lines = roles.pairs(spark, sf), roles.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("p_id"))
    return spark.createDataFrame([(R.is_subset(pairs, _parts(spark, sf), "p_id"), R.is_subset(lines, pairs, "p_id"))], "pairs_in_parts boolean, lines_in_pairs boolean")


# Analytics

_R6 = "round({}, 6)".format


@query(f"""with {PN}, s as (select count(distinct t) as v from (select unnest({tokens_('text_norm')}) as t from (select * from pn order by md5('42:' || p_id), p_id limit 5000)))
select count(*) as n_products, round(avg(len({tokens_('text_norm')})), 6) as avg_tokens, median(len({tokens_('text_norm')})) as median_tokens, round(avg(length(text)), 6) as avg_chars, round(avg(case when len(attributes_list) > 0 then 1 else 0 end), 6) as pct_with_attributes, any_value(v) as vocab_size_sample from pn, s""")
def g1_catalog_summary(spark, sf):
    g = G.catalog_summary(pn(spark, sf))
    return g.withColumns({n: F.round(n, 6) for n in ("avg_tokens", "avg_chars", "pct_with_attributes")})


@query(f"with {PN}, w as (select ord, unnest({tokens_('text_norm')}) as token, generate_subscripts({tokens_('text_norm')}, 1) as pos from pn) select token, count(*) as n from w group by token order by n desc, min({{'o': ord, 'p': pos}}) limit 50")
def g2_token_frequency(spark, sf):
    return G.token_frequency(pn(spark, sf), 50)


@query(f"with {PRODUCTS} select {strip_('brand')} as value, count(*) as n from products group by 1 order by n desc, min(ord) limit 30")
def g3_value_frequency(spark, sf):
    return G.value_frequency(roles.products(spark, sf), "brand", 30)


@query(f"with {PN}, w as (select ord, unnest(attributes_list) as value, generate_subscripts(attributes_list, 1) as pos from pn) select value, count(*) as n from w group by value order by n desc, min({{'o': ord, 'p': pos}}) limit 50")
def g4_attribute_frequency(spark, sf):
    return G.attribute_frequency(pn(spark, sf), 50)


@query(f"with {PAIRS} select count(*) as n_pairs, count(distinct query) as unique_queries, count(distinct p_id) as unique_pids from pairs")
def g5_pair_summary(spark, sf):
    return G.pair_summary(roles.pairs(spark, sf))


@query(f"with {PAIRS} select query, count(distinct p_id) as n from pairs group by query order by n desc, min(ord) limit 20")
def g5_queries_by_products(spark, sf):
    return G.queries_by_products(roles.pairs(spark, sf))


@query(f"with t as (select len({tokens_('text')}) as n from conversations) select min(n) as min, max(n) as max, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.95), 6) as p95 from t")
def g6_query_lengths(spark, sf):
    g = G.query_length_distribution(roles.table(spark, sf, "conversations"), "text")
    return g.withColumns({n: F.round(n, 6) for n in ("mean", "p90", "p95")})


def _text_pairs(spark, sf):
    """Turns of conversations as pairs of a raw query and the product of the conversation's number."""
    t = roles.table(spark, sf, "conversations")
    return t.select((F.col("conv_id") * 100000 + F.col("turn")).alias("ord"), F.col("text").alias("query"), F.col("conv_id").cast("string").alias("p_id"))


_TEXT_PAIRS = "tp as (select conv_id * 100000 + turn as ord, text as query, cast(conv_id as varchar) as p_id from conversations)"


@query(f"""with {PN}, {_TEXT_PAIRS}, o as (select list_distinct({tokens_('query')}) as q, {tokens_('coalesce(text_norm, chr(32))')} as p from (select * from tp order by md5('42:' || ord), ord limit 5000) left join pn using (p_id)),
 s as (select case when len(q) > 0 then {overlap_('q', 'p')} / len(q) else 0 end as o from o)
select round(avg(o), 6) as mean, round(quantile_cont(o, 0.5), 6) as median, round(stddev_pop(o), 6) as std, round(quantile_cont(o, 0.9), 6) as p90 from s""")
def g7_lexical_overlap(spark, sf):
    g = G.lexical_overlap(_text_pairs(spark, sf), pn(spark, sf))
    return g.select(*[F.round(n, 6).alias(n) for n in g.columns])


@query(f"with {PAIRS}, {_PARTS}, m as (select p_id from pairs except select p_id from parts) select (select count(distinct p_id) from pairs) as n_train_pids, (select count(*) from m) as n_missing")
def g8_coverage(spark, sf):
    return G.coverage(roles.pairs(spark, sf), _parts(spark, sf))[0]


@query(f"with {PAIRS}, {_PARTS}, m as (select p_id from pairs except select p_id from parts) select p_id from m order by p_id limit 20")
def g8_missing(spark, sf):
    return G.coverage(roles.pairs(spark, sf), _parts(spark, sf))[1]


@query(f"""with t as (select cast(len({tokens_('text')}) as double) as v from documents), r as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / 20 as w from t),
 c as (select least(floor((v - lo) / w), 19)::int as bin, count(*) as n from t, r group by 1), b as (select unnest(range(20))::int as bin)
select bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, coalesce(n, 0) as n from b left join c using (bin), r""")
def g9_histogram(spark, sf):
    return G.histogram(docs(spark, sf), F.size(T.tokens("text"))).withColumns({n: F.round(n, 6) for n in ("low", "high")})


@query(f"with {PAIRS} select p_id, count(*) as n from pairs group by p_id")
def g10_popularity(spark, sf):
    return I.popularity(roles.pairs(spark, sf))


@query("select count(*) as n, count(distinct o_custkey) as customers, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) filter (o_totalprice > 0) as nonzero from orders")
def g12_describe(spark, sf):
    return roles.table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.sum((F.col("o_totalprice") > 0).cast("int")).alias("nonzero"))


# Retrieval


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')} select token, p_id, tf, dl from b_p")
def g13_postings(spark, sf):
    return I.postings(pt(spark, sf))


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')} select n, round(avgdl, 6) as avgdl from b_s")
def g13_stats(spark, sf):
    return I.corpus_stats(pt(spark, sf)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')} select query_id, p_id, round(bm25, 6) as bm25 from b")
def g14a_bm25_index(spark, sf):
    return I.bm25_scores(qn(spark, sf), pt(spark, sf), digits=6)


@query(f"with {PN}, {QN}, {bm25_(I.SERVE, 'b', 'query')} select query_id, p_id, round(bm25, 6) as bm25 from b")
def g14b_bm25_serve(spark, sf):
    return I.bm25_scores(qn(spark, sf), pt(spark, sf), I.SERVE, "query", digits=6)


@query(f"with {PN}, {QN}, {bm25_(I.TRAIN, 'b')} select query_id, p_id, round(bm25, 6) as bm25 from b")
def g14c_bm25_train(spark, sf):
    return I.bm25_scores(qn(spark, sf), pt(spark, sf), I.TRAIN, digits=6)


@query(f"with {PN}, {QN}, {tfidf_(I.TFIDF_INDEX, 't')} select p_id, term, round(w, 6) as w from t_v")
def g15_tfidf_vectors(spark, sf):
    return I.tfidf_fit(pt(spark, sf))[1].withColumn("w", F.round("w", 6))


@query(f"with {PN}, {QN}, {tfidf_(I.TFIDF_INDEX, 't')} select query_id, p_id, round(tfidf, 6) as tfidf from t")
def g16_cosine(spark, sf):
    return I.tfidf_scores(qn(spark, sf), pt(spark, sf)).withColumn("tfidf", F.round("tfidf", 6))


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')} select query_id, p_id, rank, round(bm25, 6) as bm25 from {top_(PLACED.format('b'), 'bm25', 200)}")
def g17_bm25_top_k(spark, sf):
    return V.bm25_candidates(qn(spark, sf), pt(spark, sf), 200).select("query_id", "p_id", "rank", F.round("bm25", 6).alias("bm25"))


@query(f"""with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, {tfidf_(I.TFIDF_INDEX, 't')}, h as (select query_id, p_id, rank as old_rank from {top_(PLACED.format('b'), 'bm25', 200)}),
 j as (select h.*, coalesce(tfidf, 0) as tfidf from h left join t using (query_id, p_id)) select query_id, p_id, rank, round(tfidf, 6) as tfidf from {top_('j', 'tfidf', 50, tie='old_rank')}""")
def g18_tfidf_rerank(spark, sf):
    q, p = qn(spark, sf), pt(spark, sf)
    return V.tfidf_rerank(V.bm25_candidates(q, p, 200), q, p, 50).select("query_id", "p_id", "rank", F.round("tfidf", 6).alias("tfidf"))


_SCALE = "case when max({0}) over w - min({0}) over w < 1e-9 then 0 else ({0} - min({0}) over w) / (max({0}) over w - min({0}) over w) end"
_HYBRID = f"""{bm25_(I.INDEX, 'b')}, {tfidf_(I.TFIDF_INDEX, 't')}, h as (select query_id, p_id, ord, bm25 from {top_(PLACED.format('b'), 'bm25', 500)}),
 j as (select h.*, coalesce(tfidf, 0) as tfidf from h left join t using (query_id, p_id)),
 s as (select *, 0.6 * {_SCALE.format('bm25')} + 0.4 * {_SCALE.format('tfidf')} as score from j window w as (partition by query_id)),
 hybrid as materialized {top_('s', 'score', 50)}"""


@query(f"with {PN}, {QN}, {_HYBRID} select query_id, p_id, rank, round(bm25, 6) as bm25, round(tfidf, 6) as tfidf, round(score, 6) as score from hybrid")
def g21_hybrid(spark, sf):
    h = V.hybrid(qn(spark, sf), pt(spark, sf))
    return h.select("query_id", "p_id", "rank", *[F.round(n, 6).alias(n) for n in ("bm25", "tfidf", "score")])


def _padded(src: str, score: str, k: int) -> str:
    """CTE padded(query_id, p_id, ord, score...) from hits `src`, then ranked."""
    return f"""hits as materialized (select query_id, p_id, ord, {score} from {top_(src, score, k)}),
 allp as (select q.query_id, pn.p_id, pn.ord from q, (select * from pn order by ord limit {k}) pn),
 fill as (select a.*, row_number() over (partition by a.query_id order by a.ord) as f from allp a anti join hits h on a.query_id = h.query_id and a.p_id = h.p_id),
 hc as (select query_id, count(*) as n from hits group by 1),
 padded as (select * from hits union all select f.query_id, f.p_id, f.ord, 0.0 from fill f left join hc using (query_id) where f + coalesce(n, 0) <= {k})"""


_SERVE = f"""{bm25_(I.SERVE, 'b', 'query')}, {tfidf_(I.TFIDF_SERVE, 't', 'query')}, np as (select count(*) as np from pn),
 r as (select *, count(*) over w as c, min(bm25) over w as lo0, max(bm25) over w as hi0 from b window w as (partition by query_id)),
 bn as (select query_id, p_id, case when hi > lo then (bm25 - lo) / (hi - lo) else bm25 end as bn from (select *, case when c < np then least(lo0, 0) else lo0 end as lo, case when c < np then greatest(hi0, 0) else hi0 end as hi from r, np)),
 sc as (select query_id, p_id, 0.6 * coalesce(tfidf, 0) + 0.4 * coalesce(bn, 0) as score from t full join bn using (query_id, p_id)), {_padded(PLACED.format('sc'), 'score', 50)}"""


@query(f"with {PN}, {QN}, {_SERVE} select query_id, p_id, rank, round(score, 6) as score from {top_('padded', 'score', 50)}")
def g22_serve_candidates(spark, sf):
    return V.serve_candidates(qn(spark, sf), pt(spark, sf)).select("query_id", "p_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {PN}, {QN}, {tfidf_(I.TFIDF_TRAIN, 't')}, {_padded(PLACED.format('t'), 'tfidf', 50)} select query_id, p_id, rank, round(tfidf, 6) as tfidf from {top_('padded', 'tfidf', 50)}")
def g23_train_candidates(spark, sf):
    return V.train_candidates(qn(spark, sf), pt(spark, sf)).select("query_id", "p_id", "rank", F.round("tfidf", 6).alias("tfidf"))


# Features

_FREQ = "tf_pairs as (select cast(l_partkey as varchar) as p_id, count(*) as freq from lineitem group by 1)"


def _candidates(spark, sf):
    return V.bm25_candidates(qn(spark, sf), pt(spark, sf), 20)


_CAND = f"cand as materialized (select query_id, p_id, rank from {top_(PLACED.format('b'), 'bm25', 20)})"


@query(f"""with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, {tfidf_(I.TFIDF_INDEX, 't')}, {_FREQ}, {_CAND},
 x as (select cand.*, q.query_norm as qn, lower(q.query) as ql, pn.*, {tokens_('q.query_norm')} as qs, {tokens_('title_norm')} as ts from cand join q using (query_id) join pn on pn.p_id = cand.p_id)
select x.query_id, x.p_id, x.rank, round(coalesce(bm25, 0), 6) as bm25_score, round(coalesce(tfidf, 0), 6) as tfidf_score,
 cast(length(trim(brand)) > 0 and (contains(qn, lower(trim(brand))) or contains(ql, lower(trim(brand)))) as int) as brand_match,
 cast(length(trim(category)) > 0 and (contains(qn, lower(trim(category))) or contains(ql, lower(trim(category)))) as int) as category_match,
 cast(len(list_intersect({models_('qn')}, list_concat({models_('title_norm')}, {models_('text_norm')}))) > 0 as int) as model_match,
 cast(len(list_intersect(list_filter(qs, lambda k: regexp_full_match(k, '\\p{{Nd}}+')), list_filter(ts, lambda k: regexp_full_match(k, '\\p{{Nd}}+')))) > 0 as int) as numeric_match,
 {overlap_('qs', 'ts')} as token_overlap, round({overlap_('qs', 'ts')} / (len(list_distinct(qs)) + 1e-9), 6) as token_overlap_ratio,
 {overlap_('qs', tokens_('attributes_norm'))} as attr_overlap, cast(length(qn) > 0 and contains(title_norm, qn) as int) as title_contains_query,
 cast(coalesce(qs[1] = ts[1], false) as int) as title_prefix_match, coalesce(freq, 0) as popularity, len(list_distinct(qs)) as num_query_tokens, len(list_distinct(ts)) as num_title_tokens, length(qn) as len_query, length(title_norm) as len_title
from x left join b on b.query_id = x.query_id and b.p_id = x.p_id left join t on t.query_id = x.query_id and t.p_id = x.p_id left join tf_pairs f on f.p_id = x.p_id""")
def f1_features_b(spark, sf):
    x = X.pair_features(_candidates(spark, sf), qn(spark, sf), pn(spark, sf), roles.pairs(spark, sf))
    return x.withColumns({n: F.round(n, 6) for n in ("bm25_score", "tfidf_score", "token_overlap_ratio")})


def _set_a(tok, q_text: str, bm25: str, tfidf: str, rest: str) -> str:
    return f"""x as (select cand.query_id, cand.p_id, {q_text} as qt_, pn.* exclude (p_id), {tok(q_text)} as qs, {tok('text_norm')} as ps from cand join q using (query_id) join pn on pn.p_id = cand.p_id)
select x.query_id, x.p_id, round(coalesce({tfidf}.tfidf, 0), 6) as tfidf_cosine, round(coalesce({bm25}.bm25, 0), 6) as bm25,
 round(case when len(qs) + len(ps) > 0 then {overlap_('qs', 'ps')} / len(list_distinct(list_concat(qs, ps))) else 0 end, 6) as jaccard_tokens, {overlap_('qs', 'ps')} as overlap_count, len(qs) as query_len, len(ps) as prod_len, {rest}, coalesce(freq, 0) as train_product_freq
from x left join {bm25} on {bm25}.query_id = x.query_id and {bm25}.p_id = x.p_id left join {tfidf} on {tfidf}.query_id = x.query_id and {tfidf}.p_id = x.p_id left join tf_pairs f on f.p_id = x.p_id"""


_RUNS = r"regexp_extract_all({}, '\p{{Nd}}+')".format
_DIGITS = r"list_distinct(regexp_extract_all({}, '\p{{Nd}}'))".format
_A_TRAIN = f"""cast(length({strip_('brand')}) > 0 and contains(qt_, {strip_('brand')}) as int) as brand_exact, cast(length({strip_('category')}) > 0 and contains(qt_, {strip_('category')}) as int) as category_exact,
 len(list_filter(attributes_list, lambda a: contains(qt_, a) or list_has_any({tokens_('a')}, qs))) as attr_overlap_count,
 round(case when len(attributes_list) > 0 then len(list_filter(attributes_list, lambda a: contains(qt_, a) or list_has_any({tokens_('a')}, qs))) / len(attributes_list) else 0 end, 6) as attr_overlap_ratio,
 round(case when len({_RUNS('qt_')}) > 0 then len(list_filter({_RUNS('qt_')}, lambda d: list_contains({_RUNS('text_norm')}, d))) / len({_RUNS('qt_')}) else 0 end, 6) as digit_overlap_ratio, len({_RUNS('qt_')}) as num_query_digits,
 {overlap_(loose_('qs'), loose_('ps'))} as model_token_match, len(list_distinct({loose_('qs')})) as num_q_model_tokens"""


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, {bm25_(I.TRAIN, 'b3')}, {tfidf_(I.TFIDF_TRAIN, 't')}, {_FREQ}, {_CAND}, {_set_a(tokens_, 'q.query_norm', 'b3', 't', _A_TRAIN)}")
def f2_features_a_train(spark, sf):
    x = X.train_features(_candidates(spark, sf), qn(spark, sf), pn(spark, sf), roles.pairs(spark, sf), fuzzy=False)
    # All of set A but the fuzzy ratio, which SQL can't express (`t15_fuzzy_ratio`, `f4_all_features`).
    return x.drop("query", "title_fuzzy").withColumns({n: F.round(n, 6) for n in ("tfidf_cosine", "bm25", "jaccard_tokens", "attr_overlap_ratio", "digit_overlap_ratio")})


_AT = f"list_distinct(flatten(list_transform(attributes_list, lambda a: {split_tokens_('a')})))"
_A_SERVE = f"""cast(brand_norm <> '' and list_contains(qs, brand_norm) as int) as brand_exact, cast(category <> '' and list_contains(qs, lower(category)) as int) as category_exact,
 len(list_intersect(qs, {_AT})) as attr_overlap_count,
 round(case when len({_AT}) > 0 then len(list_intersect(qs, {_AT})) / len({_AT}) else 0 end, 6) as attr_overlap_ratio,
 round(case when len({_DIGITS('qt_')}) > 0 then {overlap_(_DIGITS('qt_'), _DIGITS('text_norm'))} / len({_DIGITS('qt_')}) else 0 end, 6) as digit_overlap_ratio, len({_DIGITS('qt_')}) as num_query_digits, 0 as model_token_match, 0 as num_q_model_tokens"""


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, {bm25_(I.SERVE, 'b2', 'query')}, {tfidf_(I.TFIDF_SERVE, 't', 'query')}, {_FREQ}, {_CAND}, {_set_a(split_tokens_, strip_('q.query'), 'b2', 't', _A_SERVE)}")
def f3_features_a_serve(spark, sf):
    x = X.serve_features(_candidates(spark, sf), qn(spark, sf), pn(spark, sf), roles.pairs(spark, sf), fuzzy=False)
    # All of set A but the fuzzy ratio, which SQL can't express (`t15_fuzzy_ratio`, `f4_all_features`).
    return x.drop("query", "title_fuzzy").withColumns({n: F.round(n, 6) for n in ("tfidf_cosine", "bm25", "jaccard_tokens", "attr_overlap_ratio", "digit_overlap_ratio")})


@query(None)
def f4_all_features(spark, sf):
    """All 16 features of set A by both rules, the fuzzy ratio included."""
    c, q, p, t = _candidates(spark, sf), qn(spark, sf), pn(spark, sf), roles.pairs(spark, sf)
    a, b = X.train_features(c, q, p, t), X.serve_features(c, q, p, t)
    return a.withColumn("rule", F.lit("train")).unionByName(b.withColumn("rule", F.lit("serve")))


# Learning to rank


def _labeled(spark, sf):
    return M.label(_candidates(spark, sf).select("query_id", "p_id", F.round("bm25", 9).alias("bm25")), roles.judged(spark, sf))


_LABELED = f"{PN}, {QN}, {bm25_(I.INDEX, 'b')}, {JUDGED}, lab as materialized (select c.query_id, c.p_id, bm25, case when pos.p_id is null then 0 else 1 end as label from {top_(PLACED.format('b'), 'bm25', 20)} c left join pos on pos.query_id = c.query_id and pos.p_id = c.p_id)"


@query(f"with {_LABELED} select query_id, p_id, label from lab")
def j5_label(spark, sf):
    return _labeled(spark, sf).select("query_id", "p_id", "label")


@query(f"""with {_LABELED}, w as (select *, sum(label) over (partition by query_id) as np, row_number() over (partition by query_id, label order by md5('42:' || query_id || ':' || p_id), p_id) as k from lab semi join pos on lab.query_id = pos.query_id)
select query_id, p_id, label from w where label = 1 or k <= 4 * greatest(np, 1)""")
def m1_training_data(spark, sf):
    x = _candidates(spark, sf).select("query_id", "p_id", "bm25")
    return M.prepare_training_data(x, roles.judged(spark, sf)).select("query_id", "p_id", "label")


@query(f"""with {_LABELED}, ids as (select distinct query_id from lab), v as (select query_id, row_number() over (order by md5('42:' || query_id), query_id) as k from ids)
select lab.query_id, p_id, k <= greatest(1, floor(0.1 * (select count(*) from ids))) as validation from lab join v using (query_id)""")
def m2_split(spark, sf):
    a, b = M.split_by_query(_labeled(spark, sf))
    return a.select("query_id", "p_id", F.lit(False).alias("validation")).unionByName(b.select("query_id", "p_id", F.lit(True).alias("validation")))


def _ranked(spark, sf):
    return V.bm25_candidates(qn(spark, sf), pt(spark, sf), 50).select("query_id", "p_id", F.col("bm25").alias("score"), "rank")


_PER = f"""{PN}, {QN}, {bm25_(I.INDEX, 'b')}, {JUDGED}, r as materialized {top_(PLACED.format('b'), 'bm25', 50)},
 h as (select r.query_id, r.rank, case when pos.p_id is null then 0 else 1 end as hit from r left join pos on pos.query_id = r.query_id and pos.p_id = r.p_id where r.rank <= 10),
 g as (select query_id, count(*) as n from pos group by 1),
 per as (select query_id, max(case when rank = 1 then hit else 0 end) as p1, sum(hit) / 10 as p10, case when any_value(n) > 0 then sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1 / log2(i + 1))) else 0 end as ndcg10 from h left join g using (query_id) group by query_id)"""


@query(f"with {_PER} select query_id, round(p1, 6) as p_at_1, round(p10, 6) as p_at_10, round(ndcg10, 6) as ndcg_at_10 from per")
def m8_per_query_metrics(spark, sf):
    m = M.per_query_metrics(_ranked(spark, sf), roles.judged(spark, sf))
    return m.select("query_id", *[F.round(n, 6).alias(n) for n in ("p_at_1", "p_at_10", "ndcg_at_10")])


@query(f"with {_PER} select round(avg(p1), 6) as p1, round(avg(p10), 6) as p10, round(avg(ndcg10), 6) as ndcg10 from per")
def m9_ranking_metrics(spark, sf):
    m = M.ranking_metrics(_ranked(spark, sf), roles.judged(spark, sf))
    return m.select(*[F.round(n, 6).alias(n) for n in m.columns])


@query(f"with {_LABELED} select query_id, p_id, row_number() over (partition by query_id order by round(bm25, 9) desc, p_id) as rank from lab")
def m7_baseline_ranking(spark, sf):
    return M.rank_by(_labeled(spark, sf), "bm25").select("query_id", "p_id", "rank")


@query(f"with {_LABELED} select avg(c) as mean_candidates from (select count(*) as c from lab group by query_id)")
def g24_group_size(spark, sf):
    return M.mean_group_size(_labeled(spark, sf))


@query(f"with {_LABELED}, g as (select query_id, count(*) as n, sum(label) as pos from lab group by 1) select sum(n)::bigint as n_rows, sum(pos)::bigint as n_positive, count(*) as n_queries, sum(case when pos > 0 then 1 else 0 end)::bigint as n_queries_with_positive, round(avg(pos), 6) as mean_positives from g")
def m12_label_diagnostics(spark, sf):
    return M.label_diagnostics(_labeled(spark, sf)).withColumn("mean_positives", F.round("mean_positives", 6))


@query(None)
def m3_ranker(spark, sf):
    """A pairwise ranker trained on part of the queries, ranking all candidates."""
    x = _labeled(spark, sf).withColumn("len", F.length("p_id"))
    model = M.train_ranker(x, ["bm25", "len"])
    return M.predict_and_rank(model, x, ["bm25", "len"])


@query(None)
def m3_lambda_ranker(spark, sf):
    """Pairs weighted by their NDCG change; the validation queries end the rounds."""
    x = _labeled(spark, sf).withColumn("len", F.length("p_id")).persist()  # read by every round
    train, validation = M.split_by_query(x)
    model, _ = M.train_lambda_ranker(train, validation, ["bm25", "len"], rounds=2)
    return M.predict_and_rank(model, x, ["bm25", "len"])


@query(f"""with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, a as materialized (select query_id, round(bm25, 6) as s from {top_(PLACED.format('b'), 'bm25', 50)})
select count(*) as n, round(avg(s), 4) as mean, round(stddev_pop(s), 4) as std, round(min(s), 4) as min, round(max(s), 4) as max, count(distinct s) as unique_scores, count(distinct query_id) as n_queries, (select count(*) from (select query_id from a group by query_id having min(s) = max(s))) as flat_queries from a""")
def m11_score_stats(spark, sf):
    d = M.score_diagnostics(_ranked(spark, sf).withColumn("score", F.round("score", 6)))
    return d.withColumns({n: F.round(n, 4) for n in ("mean", "std", "min", "max")})


@query(None)
def m4_classifier(spark, sf):
    x = _labeled(spark, sf).withColumn("len", F.length("p_id"))
    model = M.train_classifier(x, ["bm25", "len"])
    return M.predict_and_rank(model, x, ["bm25", "len"])


@query(f"with {_LABELED} select query_id, p_id, round(round(bm25, 9), 6) as bm25 from lab")
def m5_normalize_features(spark, sf):
    x = _labeled(spark, sf).withColumn("bm25", F.col("bm25").cast("string"))
    return M.normalize_features(x, ["bm25"]).select("query_id", "p_id", F.round("bm25", 6).alias("bm25"))


@query(f"""with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, a as materialized {top_(PLACED.format('b'), 'bm25', 50)}, {JUDGED}, m as (select query_id, p_id, row_number() over (partition by query_id order by p_id) as rank from a),
 hb as (select distinct query_id from a semi join pos on a.query_id = pos.query_id and a.p_id = pos.p_id where rank <= 10), hm as (select distinct query_id from m semi join pos on m.query_id = pos.query_id and m.p_id = pos.p_id where rank <= 10)
select query_id from hb where query_id not in (select query_id from hm) order by query_id limit 10""")
def m11_failing_queries(spark, sf):
    base = _ranked(spark, sf)
    other = base.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("p_id")))
    return M.failing_queries(other, base, roles.judged(spark, sf))


# Submission


_WIDE = f"wide as materialized (select q.ord, q.query, {', '.join(f'''coalesce(max(case when rank = {i} then p_id end), '') as pid{i}''' for i in range(1, 11))} from q left join {top_(PLACED.format('b'), 'bm25', 10)} r using (query_id) group by q.ord, q.query)"


def _wide(spark, sf):
    q = qn(spark, sf)
    return Q.export_wide(V.bm25_candidates(q, pt(spark, sf), 10), q)


@query(f"with {PN}, {QN}, {bm25_(I.INDEX, 'b')}, {_WIDE} select * from wide")
def m10_export_wide(spark, sf):
    return _wide(spark, sf)


def _preds(spark, sf):
    """Predictions: every customer, in upper case for each 5th."""
    c = roles.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("ord"), F.concat_ws(" ", name, (F.col("c_custkey") % 97).cast("string")).alias("query"), *[(F.col("c_custkey") * i % (20 + i)).cast("string").alias(n) for i, n in enumerate(Q.PIDS, 1)])


def _sample(spark, sf):
    c = roles.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("ord"), F.concat_ws(" ", F.lower("c_mktsegment"), (F.col("c_custkey") % 101).cast("string")).alias("query"))


_PREDS = f"preds as (select c_custkey as ord, (case when c_custkey % 5 = 0 then upper(c_mktsegment) else lower(c_mktsegment) end) || ' ' || (c_custkey % 97) as query, {', '.join(f'cast(c_custkey * {i} % {20 + i} as varchar) as pid{i}' for i in range(1, 11))} from customer)"
_SAMPLE = "sample as (select c_custkey as ord, lower(c_mktsegment) || ' ' || (c_custkey % 101) as query from customer)"

# Each sample row has one candidate list: the predictions of its text, else those of its folded text. The k-th sample row
# of a text takes the k-th of its list; rows beyond its end take the first. Here exact rows are lower-case only, so the
# exact lists of different texts don't meet; the folded lists of rows without an exact one are theirs alone.
_ALIGN = f"""{_PREDS}, {_SAMPLE}, s as (select *, exists (select 1 from preds p where p.query = sample.query) as ex, row_number() over (partition by query order by ord) as k from sample),
 pe as (select *, row_number() over (partition by query order by ord) as k, count(*) over (partition by query) as n from preds),
 pf as (select *, lower(query) as fold, row_number() over (partition by lower(query) order by ord) as k, count(*) over (partition by lower(query)) as n from preds),
 a as (select s.ord, s.query as sample_query, 'exact' as strategy, pe.ord as pred_ord from s join pe on s.ex and pe.query = s.query and pe.k = case when s.k <= pe.n then s.k else 1 end
   union all select s.ord, s.query, 'casefold', pf.ord from s join pf on not s.ex and pf.fold = s.query and pf.k = case when s.k <= pf.n then s.k else 1 end
   union all select s.ord, s.query, null, null from s where not s.ex and s.query not in (select fold from pf))"""


@query(f"with {_ALIGN} select a.ord, sample_query, strategy, pred_ord, coalesce(p.query, sample_query) as query, coalesce(pid1, '') as pid1 from a left join preds p on p.ord = a.pred_ord")
def q_a_align(spark, sf):
    return Q.align(_preds(spark, sf), _sample(spark, sf)).select("ord", "sample_query", "strategy", "pred_ord", "query", "pid1")


@query(f"with {_ALIGN} select coalesce(strategy, 'unmatched') as strategy, count(*) as n from a group by 1")
def q_a_counts(spark, sf):
    return Q.alignment_counts(Q.align(_preds(spark, sf), _sample(spark, sf)))


@query(f"with {_PREDS}, {_SAMPLE} select 'missing' as side, ord, query from sample where query not in (select query from preds) union all select 'extra', ord, query from preds where query not in (select query from sample)")
def q_d_coverage(spark, sf):
    missing, extra = Q.coverage(_preds(spark, sf), _sample(spark, sf))
    return missing.select(F.lit("missing").alias("side"), "ord", "query").unionByName(extra.select(F.lit("extra").alias("side"), "ord", "query"))


@query(f"""with {_PREDS}, {_SAMPLE}, f as (select query as missing_query, min(ord) as place from sample where query not in (select query from preds) group by 1)
select missing_query, place, 'sample' as side, s.ord, s.query from f join sample s on s.ord between place - 3 and place + 3 union all select missing_query, place, 'pred', p.ord, p.query from f join preds p on p.ord between place - 5 and place + 4""")
def q_e_context(spark, sf):
    return Q.missing_context(_preds(spark, sf), _sample(spark, sf))


@query(None)
def q_f_suggestions(spark, sf):
    p, s = _preds(spark, sf), _sample(spark, sf)
    return Q.fuzzy_suggestions(Q.coverage(p, s)[0], p)


_CELLS = "cells as (select ord, unnest([" + ", ".join(Q.PIDS) + "]) as p_id, unnest(range(10)) as col from preds)"


@query(f"with {_PREDS}, {_CELLS} select p_id, count(*) as n from cells where p_id <> '' group by p_id order by n desc, min({{'o': ord, 'c': col}}) limit 10")
def g11_popular_predictions(spark, sf):
    return Q.popular_pids(_preds(spark, sf)).select("p_id", "n")


@query(f"""with {_PREDS}, {_SAMPLE}, {_CELLS}, top as (select list(p_id order by n desc, f) as t from (select p_id, count(*) as n, min({{'o': ord, 'c': col}}) as f from cells where p_id <> '' group by p_id order by n desc, f limit 10)),
 l as (select * from (select *, row_number() over (partition by query order by ord desc) as k from preds) where k = 1)
select s.ord, s.query, {', '.join(f"coalesce(l.pid{i}, t[{i}], '') as pid{i}" for i in range(1, 11))} from sample s left join l on l.query = s.query, top""")
def q_g_fallback(spark, sf):
    return Q.fill_with_popular(_preds(spark, sf), _sample(spark, sf))


@query(None)
def q_c_format_check(spark, sf):
    s = _sample(spark, sf)
    return Q.format_check(_preds(spark, sf), s.select("ord", "query", *[F.lit("").alias(n) for n in Q.PIDS]))


@query(None)
def s13_report(spark, sf):
    return G.report(pn(spark, sf), _text_pairs(spark, sf)).select(F.to_json(F.struct("*")).alias("report"))
