"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Each (host, path) expands into the suffixes of the host at label boundaries that have
as many labels as some rule's host, times the prefixes of the path that have the
length of some rule's path. An expression's SHA-256 meets the rules by an equi-join
on its first four bytes; the full digest then confirms it. Of the rules that fit,
the longest wins (rule text length; at a tie the longer host, then block).

Scale. Only the url column is read. Distinct (host, path) pairs are judged, so a
url that a third of all pages share is expanded once; Spark picks a broadcast or
a shuffle join by the size of the rule table. A host or path of any length costs
what it takes to read it, for each of the few lengths that rules have. All of it is
DataFrame expressions.

A null url, or one without `://`, has empty host and path and gets the method's
verdict. Repeated rows are each returned. An empty table gives an empty result,
an empty rule set verdicts of the method. Other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: The method's verdict where no rule fits.
DEFAULT = "allow"
PREFIX_HEX = 8


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url by the contract's rules; both empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows of the form host + path, path from the first slash on."""
    rows = spark.createDataFrame(rules, "rule string, verdict string")
    return rows.dropDuplicates(["rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hashed = rules.select(
        F.col("rule"),
        F.col("verdict"),
        F.instr("rule", "/").alias("slash"),
    ).select("rule", "verdict", F.when(F.col("slash") > 0, F.length("rule") - F.col("slash") + 1).otherwise(F.lit(0)).alias("path_length"), F.size(F.split(F.substring_index("rule", "/", 1), "\\.")).alias("labels"), F.sha2("rule", 256).alias("digest"))
    hashed = hashed.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    # The lengths of rules' paths and the numbers of labels of their hosts: a few numbers, however many rules there are.
    found = hashed.agg(F.array_sort(F.collect_set("path_length")), F.array_sort(F.collect_set("labels"))).first()
    lengths, counts = found if found else ([], [])
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    distinct = rows.distinct().where(F.col("host") != "")
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    suffixes = F.array_compact(F.array(*(F.when(F.col("dots") >= n - 1, F.substring_index("host", ".", -n)) for n in counts)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    distinct = distinct.withColumn("dots", dots)
    expressions = distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    keyed = expressions.select("host", "path", F.length("suffix").alias("host_length"), F.sha2(F.concat("suffix", "prefix"), 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    fits = keyed.join(hashed, "short").where(F.col("full") == F.col("digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("host_length"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))).alias("best"))
    judged = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = rows.join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = f"""
with rules(rule, verdict) as (values {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
     cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
     urls as (select page_id, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} as host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
     parts as (select rule, verdict, substr(rule, 1, instr(rule, '/') - 1) as rhost, substr(rule, instr(rule, '/')) as rpath from rules),
     fits as (select distinct u.host, u.path, r.rule, r.verdict,
                     row_number() over (partition by u.host, u.path order by length(r.rule) desc, length(r.rhost) desc, r.verdict desc) as k
              from (select distinct host, path from urls) u
              join parts r on (u.host = r.rhost or ends_with(u.host, '.' || r.rhost)) and starts_with(u.path, r.rpath))
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, '{DEFAULT}') as verdict
from urls u left join fits f on f.k = 1 and f.host = u.host and f.path = u.path
"""
