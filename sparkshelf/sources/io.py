"""Sources and sinks: CSV under four null regimes, Parquet tables, CSV, JSON and text reports, raw-file checks.

Row order is part of the data model (ties, first and last wins, generated ids), so
readers add `ord`, the row's place in the input: 0-based and dense (`with_ord`).
"""

from __future__ import annotations

import codecs
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..functions import text as T

NULL_REGIMES = ("strict", "default", "empty", "nan_text")
BOMS = [("utf-8-sig", codecs.BOM_UTF8), ("utf-32-le", codecs.BOM_UTF32_LE), ("utf-32-be", codecs.BOM_UTF32_BE), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE)]
DELIMITERS = [",", ";", "\t", "|"]


def require_columns(df: DataFrame, names, what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")


def strip_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[n.strip().lstrip("﻿") for n in df.columns])


def with_ord(df: DataFrame, name: str = "ord") -> DataFrame:
    """df with its 0-based row number, in the JVM. Two passes: rows of each partition are counted, then numbered from the count
    of those before; nothing is shuffled."""
    if name in df.columns:
        return df
    tagged = df.withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", 33)
    before, total = {}, 0
    for r in tagged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a number for each partition
        before[r["part"]] = total
        total += r["count"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part bigint, _before bigint")
    numbered = tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).alias(name))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; only a session on one machine may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base}/scratch-{uuid.uuid4().hex}"


def head_bytes(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of the first file of a path, in any store that Spark reads; no more of the file is read."""
    jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted([(x.getPath().toString(), x) for x in fs.globStatus(at) or []], key=lambda f: f[0])
    while files and files[0][1].isDirectory():
        inside = [(x.getPath().toString(), x) for x in fs.listStatus(files[0][1].getPath()) if not x.getPath().getName().startswith(("_", "."))]
        files = sorted(inside + files[1:], key=lambda f: f[0])
    if not files:
        return b""
    stream = fs.open(files[0][1].getPath())
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By BOM, else UTF-8 where the head is valid UTF-8 (its last character may be cut), else Windows-1256 if Arabic letters come out, else Latin-1."""
    head = head_bytes(spark, path)
    for name, bom in BOMS:
        if head.startswith(bom):
            return name.replace("-sig", "")
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8"
    except UnicodeDecodeError:
        arabic = head.decode("cp1256", "replace")
        return "windows-1256" if sum("؀" <= x <= "ۿ" for x in arabic) * 4 > len(arabic) else "iso-8859-1"


def detect_bom(spark: SparkSession, path: str) -> list[str]:
    head = head_bytes(spark, path, 4)
    return [name for name, bom in BOMS if head.startswith(bom)]


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The delimiter that most evenly and most often splits the first lines."""
    lines = [x for x in head_bytes(spark, path).decode(encoding, "replace").splitlines()[:20] if x]
    def fitness(d: str):
        counts = [x.count(d) for x in lines]
        return (min(counts, default=0) > 0 and max(counts) == min(counts), sum(counts))
    return max(DELIMITERS, key=fitness) if lines else ","


def first_line_repr(spark: SparkSession, path: str, encoding: str = "utf-8", most: int = 400) -> str:
    return repr(head_bytes(spark, path).decode(encoding, "replace").split("\n", 1)[0][:most])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_files(spark: SparkSession, paths) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing input: {missing}")


def apply_nulls(df: DataFrame, regime: str = "strict") -> DataFrame:
    """strict: only empty is null. default: NA literals too. empty: null becomes ''. nan_text: null becomes the text nan."""
    if regime not in NULL_REGIMES:
        raise ValueError(f"null regime {regime!r} is none of {NULL_REGIMES}")
    texts = [f.name for f in df.schema if isinstance(f.dataType, st.StringType)]
    def one(n: str) -> Column:
        x = F.when(F.col(n) == "", None).otherwise(F.col(n))
        if regime == "default":
            x = F.when(F.col(n).isin(T.NA_LITERALS), None).otherwise(F.col(n))
        if regime == "empty":
            x = F.coalesce(x, F.lit(""))
        if regime == "nan_text":
            x = F.coalesce(x, F.lit("nan"))
        return x.alias(n)
    return df.select(*[one(n) if n in texts else F.col(n) for n in df.columns])


def read_csv(spark: SparkSession, path: str, nulls: str = "strict", encoding: str | None = None, sep: str | None = None, ordered: bool = False) -> DataFrame:
    """All columns as text, header names stripped; quoted newlines and doubled quotes are read."""
    encoding = encoding or detect_encoding(spark, path)
    sep = sep or ","
    df = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False, encoding=encoding, sep=sep).csv(path)
    df = apply_nulls(strip_header(df), nulls)
    return with_ord(df) if ordered else df


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> tuple[list[str], DataFrame, str]:
    """(header, rows, delimiter) of a text table whose delimiter may be unknown."""
    sep = sep or sniff_delimiter(spark, path)
    df = read_csv(spark, path, "empty", sep=sep, ordered=True)
    return [n for n in df.columns if n != "ord"], df, sep


def load_products(df: DataFrame, normalizer: T.Normalizer = T.Normalizer(), text_fields=("title", "brand", "category", "attributes")) -> DataFrame:
    """(p_id, text, text_norm): text is what there is of `text_fields`, joined; none of them is an error."""
    require_columns(df, ["p_id"], "products")
    fields = [n for n in text_fields if n in df.columns]
    if not fields:
        raise ValueError(f"products have none of {list(text_fields)}")
    text = T.concat_parts(*fields)
    keep = [n for n in ("ord",) if n in df.columns]
    return df.select(*keep, T.canonical_id("p_id").alias("p_id"), text.alias("text")).withColumn("text_norm", normalizer(F.col("text")))


def load_train_pairs(df: DataFrame, null_query: str = "nan") -> DataFrame:
    """(query, p_id) with queries that aren't blank; `null_query`: 'nan' keeps null queries as that text, 'drop' drops them."""
    require_columns(df, ["query", "p_id"], "train pairs")
    df = df.dropna(subset=["query"]) if null_query == "drop" else df.fillna({"query": "nan"})
    keep = [n for n in ("ord", "query_id") if n in df.columns]
    return df.where(F.length(T.strip("query")) > 0).select(*keep, "query", T.canonical_id("p_id").alias("p_id"))


def load_test_queries(df: DataFrame, normalizer: T.Normalizer = T.Normalizer(), null_text: str = "nan") -> DataFrame:
    """(query_id, query_raw, query, query_norm); without a query_id the row number is one."""
    require_columns(df, ["query"], "queries")
    if "query_id" not in df.columns:
        df = with_ord(df).withColumn("query_id", F.col("ord").cast("string"))
    raw = F.coalesce(F.col("query"), F.lit(null_text))
    keep = [n for n in ("ord",) if n in df.columns]
    return df.select(*keep, F.col("query_id").cast("string").alias("query_id"), raw.alias("query_raw"), raw.alias("query")).withColumn("query_norm", normalizer(F.col("query_raw")))


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_or_built(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; where there is none, what build() gives, saved there first."""
    if not exists(spark, path):
        save_table(build(), path)
    return load_table(spark, path)


def write_csv(df: DataFrame, path: str, order: str | None = "ord", single: bool = True) -> None:
    """One CSV with header, quoted where needed, in order. `single=False` keeps a sorted file for each partition."""
    if order and order in df.columns:
        df = df.orderBy(order).drop(order)
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, quoteAll=False, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """`line` by `ord` as one text file (a report: a bounded number of lines)."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def describe(df: DataFrame) -> DataFrame:
    return df.summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
